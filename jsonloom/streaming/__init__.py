"""Document functions in Structured Streaming.

All functions of ``jsonloom.functions`` work on streaming DataFrames; keys for
groups and deduplication are the BINARY ones of ``jsonloom.operators``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as J
from ..operators import _fresh


def _stamped(df: DataFrame, time: str, late: str) -> tuple[DataFrame, str]:
    """With a watermark on the time; a column that is no timestamp with a zone gets a fresh one beside it."""
    if dict(df.dtypes)[time] == "timestamp":
        return df.withWatermark(time, late), time
    name = _fresh("event_time", df)
    return df.withColumn(name, F.col(time).cast("timestamp")).withWatermark(name, late), name


def windowed_counts(df: DataFrame, time: str, doc: str, path: str, window: str = "7 days", late: str = "1 day") -> DataFrame:
    """Rows by window of event time and by what a path leads to, as text; late rows are dropped beyond the watermark."""
    key = J.try_to_str(J.get_by_path_first(doc, path))
    stamped, at = _stamped(df, time, late)
    return stamped.groupBy(F.window(at, window), key.alias("key")).agg(F.count("*").alias("n"))


def distinct_documents(df: DataFrame, time: str, doc: str, late: str = "1 day") -> DataFrame:
    """Each document once as long as the watermark remembers it; a column ``event_time`` is added if the time had to be cast."""
    stamped, _ = _stamped(df, time, late)
    key = _fresh("document_key", stamped)
    return stamped.withColumn(key, J.identity_key(doc)).dropDuplicatesWithinWatermark([key]).drop(key)
