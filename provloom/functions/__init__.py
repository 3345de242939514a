"""Column functions: canonical JSON, identifiers, text and version helpers."""
