"""Reading physical plans."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame


def plan_of(df: DataFrame) -> str:
    """The formatted physical plan with nothing cut off."""
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.maxMetadataStringLength")
    conf.set("spark.sql.maxMetadataStringLength", "10000")
    out = io.StringIO()
    try:
        with contextlib.redirect_stdout(out):
            df.explain("formatted")
    finally:
        conf.set("spark.sql.maxMetadataStringLength", before)
    return out.getvalue()
