"""Column-level building blocks: parsing, expressions, dates, patterns."""
