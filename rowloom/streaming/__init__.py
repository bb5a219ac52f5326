"""The operators on Structured Streaming."""
