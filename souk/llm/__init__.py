"""Operators for preparing training text at scale: filters, de-duplication, extraction, tokens."""
