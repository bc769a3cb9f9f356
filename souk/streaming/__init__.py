"""The incremental merge as a stream over arriving files."""
