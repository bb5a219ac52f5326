"""Inputs: delimited text, JSON pages, file listings, databases, inline data."""
