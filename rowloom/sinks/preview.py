"""Look at a few rows, and count rows while they pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

PREVIEW_ROWS = 1000


def preview(df: DataFrame, n: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows of any step."""
    return df.limit(n)


def browse(df: DataFrame, limit: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows as JSON text, in one column `json`."""
    if limit < 1:
        raise ValueError("browse: limit must be at least 1")
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
    return df.limit(limit).select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The same rows with a counter: after an action, `observation.get["rows"]`. Needs no extra job."""
    observation = Observation(name)
    return df.observe(observation, F.count(F.lit(1)).alias("rows")), observation
