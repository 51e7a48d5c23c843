"""Sharding by sampled splitters: records are range-partitioned on a sampled key, shards hold nearly equal bytes.

The key is (hash of the text, hash of the id), so equal texts lie side by side,
and the shard of a document does not depend on how the table is split; the lowest
bits of the latter differ for rows that are equal in both, which are
interchangeable. A sample of keys, drawn with chance proportional to size, gives quantile
boundaries of many more ranges than shards. A group of equal texts that takes
several boundaries is overfull: it is subdivided by the hash of the row. All
other boundaries are moved to the start of their group, so such groups stay
whole. Exact sizes of the ranges then tell at which byte a record or group
lies, and the shard that holds the middle of it takes it.

Null texts count as empty. Rows that agree in every column that counts each get
a slot of their own. A very long text is one record, however large; an empty table
gives no rows. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

#: Ranges for each shard, and expected sampled keys for each range.
RANGES, SAMPLES = 48, 8
#: Bits of the hash of a row that tell equal rows apart.
FREE_BITS = 16


def splitters(rows: DataFrame, total: int, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries (text hash, row hash), at most ``ranges`` of them, from a sample of about ranges * SAMPLES keys."""
    share = total / (ranges * SAMPLES)
    # a record is drawn once for each multiple of `share` that it holds, and by chance for the rest
    chance = F.pmod(F.xxhash64(F.shiftright("row_hash", FREE_BITS), F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.withColumn("times", F.floor(F.col("size") / share + chance)).where("times > 0")
    keys = drawn.select("text_hash", "row_hash", "times").toPandas().sort_values(["text_hash", "row_hash"], ignore_index=True)
    upto = np.cumsum(keys["times"].to_numpy())
    if not len(upto):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cut = np.searchsorted(upto, np.arange(1, ranges) * upto[-1] / ranges)
    text, row = keys["text_hash"].to_numpy()[cut], keys["row_hash"].to_numpy()[cut]
    values, times = np.unique(text, return_counts=True)
    whole = times[np.searchsorted(values, text)] == 1
    row = np.where(whole, np.iinfo(np.int64).min, row)
    both = pd.DataFrame({"text": text, "row": row}).drop_duplicates()
    return both["text"].to_numpy(), both["row"].to_numpy()


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns: the id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", (F.octet_length("text") + 16).cast("long").alias("size"), F.crc32(F.encode("text", "utf-8")).alias("text_crc32"), F.xxhash64("text").alias("text_hash"))
    # of equal rows, each gets a key of its own: a group of them must not be stuck on one
    free = (1 << FREE_BITS) - 1
    own, apart = F.xxhash64("doc_id", "size"), F.xxhash64(F.monotonically_increasing_id())
    rows = rows.withColumn("row_hash", own.bitwiseAND(F.lit(~free)).bitwiseOR(apart.bitwiseAND(F.lit(free))))
    rows = checkpoint(rows)
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    ranges = shards * RANGES
    text_cut, row_cut = splitters(rows, total, ranges) if total else (np.empty(0, np.int64), np.empty(0, np.int64))
    values, first = np.unique(text_cut, return_index=True)
    last = np.append(first[1:], len(text_cut))
    split = values[row_cut[first] > np.iinfo(np.int64).min]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            text_hash, row_hash = x["text_hash"].to_numpy(), x["row_hash"].to_numpy()
            at = np.searchsorted(values, text_hash)
            in_range = np.append(first, len(text_cut))[at]
            own = (at < len(values)) & (np.append(values, 0)[at] == text_hash)
            for group in np.unique(at[own]):
                rows_, a, b = np.flatnonzero(own & (at == group)), first[group], last[group]
                in_range[rows_] = a + np.searchsorted(row_cut[a:b], row_hash[rows_], side="right")
            yield x.assign(in_range=in_range.astype(np.int32), whole=~np.isin(text_hash, split))

    kept = "doc_id, size, text_crc32, text_hash, row_hash"
    schema = ", ".join(f.simpleString().replace(":", " ") for f in rows.schema)
    rows = rows.mapInPandas(place, f"{schema}, in_range int, whole boolean")
    sizes = rows.groupBy("in_range").agg(F.sum("size").alias("bytes"))
    before = F.sum("bytes").over(Window.orderBy("in_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("in_range", F.coalesce(before, F.lit(0)).alias("start"))
    # a whole group counts as one record: its middle decides
    order = Window.partitionBy("in_range").orderBy("text_hash", "row_hash", "doc_id")
    upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    same = Window.partitionBy("in_range", "text_hash")
    placed = rows.join(F.broadcast(starts), "in_range").withColumn("end", F.col("start") + upto)
    begin = F.when(F.col("whole"), F.min(F.col("end") - F.col("size")).over(same)).otherwise(F.col("end") - F.col("size"))
    finish = F.when(F.col("whole"), F.max("end").over(same)).otherwise(F.col("end"))
    middle = (begin + finish) / 2.0
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / float(max(total, 1)))).cast("int"))
    placed = checkpoint(placed.select(*kept.split(", "), "in_range", "shard"))
    counts = placed.groupBy("shard", "in_range").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("shard").orderBy("in_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("shard", "in_range", F.coalesce(earlier, F.lit(0)).alias("first"))
    number = F.row_number().over(Window.partitionBy("in_range", "shard").orderBy("text_hash", "row_hash", "doc_id"))
    out = placed.join(F.broadcast(counts), ["shard", "in_range"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + number - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
