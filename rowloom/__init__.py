"""Data-preparation operators for Spark DataFrames.

A one-input operator is called with its parameters and returns a step for
`df.transform`; an operator with several inputs or outputs takes and returns
DataFrames.
"""

from .operators.changes import apply_changes, last_changes, upsert
from .operators.cleaning import data_cleansing, datetime, find_replace, regex, text_to_columns
from .operators.columns import add_column, auto_field, cast, casts, fillna, map_columns, rename, select
from .operators.groups import aggregate, groupby, pivot, unpivot
from .operators.joins import append_fields, check_cardinality, join, merge
from .operators.models import naive_bayes, regression
from .operators.ordered import bfill, every_nth, ffill, row_index
from .operators.profile import correlation, field_summary, frequency_table
from .operators.rows import (
    chain, dedup, drop_duplicates, dummy, filter_advanced, filter_rows, filter_rules, fork, match_advanced, route, sampling, sort,
    split, union,
)
from .operators.sketches import estimate_sketches, merge_sketches, sketch_groups
from .session import session
from .sinks.csv import write_csv
from .sinks.jdbc import write_table
from .sinks.preview import browse, counted, preview
from .sources.csv import csv_preview, read_csv
from .sources.dialect import csv_scan
from .sources.inline import clock, data_grid, text_input
from .sources.jdbc import read_query, read_table
from .sources.json_pages import explode_records, json_pages
from .sources.listing import directory

__all__ = [
    "add_column", "aggregate", "append_fields", "apply_changes", "auto_field", "bfill", "browse", "cast", "casts",
    "chain", "check_cardinality", "clock", "correlation", "counted", "csv_preview", "csv_scan", "data_cleansing",
    "data_grid", "datetime", "dedup", "directory", "drop_duplicates", "dummy", "estimate_sketches", "every_nth", "explode_records", "ffill",
    "field_summary", "fillna", "filter_advanced", "filter_rows", "filter_rules", "find_replace", "fork",
    "frequency_table", "groupby", "join", "json_pages", "last_changes", "map_columns", "match_advanced", "merge", "merge_sketches",
    "naive_bayes", "pivot",
    "preview", "read_csv", "read_query", "read_table", "regex", "regression", "rename", "route", "row_index",
    "sampling", "select", "session", "sketch_groups", "sort", "split", "text_input", "text_to_columns", "union", "unpivot", "upsert",
    "write_csv", "write_table",
]
