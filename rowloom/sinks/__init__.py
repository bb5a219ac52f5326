"""Outputs: delimited text, databases, previews and row counts."""
