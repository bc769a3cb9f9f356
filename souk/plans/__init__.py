"""Staging, star schema, reports and checks."""
