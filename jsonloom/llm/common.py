"""What several operators share: reading, checkpoints, slices of Arrow batches, hashing of words."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that one step of a vectorised operator holds at a time; numpy needs up to a hundred times as much.
SLICE_BYTES = 512 << 10
#: Bytes of an Arrow batch between Spark and Python, about, and the setting for it with Spark's own value.
BATCH_BYTES, BATCH_SETTING, BATCH_DEFAULT = "2m", "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
#: Has Spark drop the shuffles of an execution when it ends.
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, unless the session has a limit of its own: texts are long, and both sides hold whole batches."""
    if spark.conf.get(BATCH_SETTING, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is executed inside leaves no shuffle files behind: its result is written elsewhere, and nothing reads its shuffles again."""
    before = spark.conf.get(CLEANUP_SETTING, "false")
    spark.conf.set(CLEANUP_SETTING, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP_SETTING, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the session names, for small results: its shuffles stay until Spark collects them.

    Only a local session that names none (as in tests) gets a folder of its own.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def first_row(df: DataFrame):  # noqa: ANN201
    """The first row of a small result; its shuffles go at once."""
    with shuffles_dropped(df.sparkSession):
        return df.first()


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about ``limit`` bytes of the column, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        ends = np.frombuffer(col.buffers()[1], np.int64 if pa.types.is_large_string(col.type) else np.int32)
        ends = ends[col.offset : col.offset + batch.num_rows + 1].astype(np.int64)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class HashIndex:
    """An open-addressed table from distinct non-negative int64 keys to their positions, for vectorised lookups."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(4, int(len(keys) * 3).bit_length())
        self.shift = np.uint64(64 - bits)
        # free slots hold -1; the chains at the end run on into spare slots
        spare = 4096
        self.keys, self.at = np.full((1 << bits) + spare, -1, np.int64), np.full((1 << bits) + spare, -1, np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == -1]
            self.keys[slot[free]] = keys[free]  # of several for one slot, the last stays
            placed = self.keys[slot[left]] == keys[left]
            self.at[slot[left[placed]]] = left[placed]
            left = left[~placed]
            slot[left] += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, -1 if it has none. Keys of -2 are never found."""
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.at[slot], -1)
        left = np.flatnonzero((found != keys) & (found != -1) & (keys != -2))
        while len(left):
            slot[left] += 1
            found = self.keys[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.at[slot[left[hit]]]
            left = left[~hit & (found != -1)]
        return out


class Known(dict):
    """Values of words; those asked for in vain count as nothing and are noted in ``missing``."""

    def __init__(self, nothing) -> None:  # noqa: ANN001
        super().__init__()
        self.nothing = nothing
        self.missing: list[str] = []

    def __missing__(self, word: str):  # noqa: ANN204
        self.missing.append(word)
        return self.nothing


def crc_mod(column: str, n: int):  # noqa: ANN201
    """crc32 of an id's decimal text, modulo n."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, as ``checkpoint`` uses it."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="jsonloom-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


class Work:
    """Tables that an operator writes on the way to one result, in the shared folder, and what it broadcasts for it.

    Whoever has written the result clears them; those of a Work that nobody
    clears go when the driver's Python ends. Other results are not touched.
    """

    _open: set[Work] = set()

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths, self.sent = spark, {}, []
        Work._open.add(self)

    def store(self, df: DataFrame) -> DataFrame:
        path = f"{checkpoint_dir(self.spark)}/{uuid.uuid4().hex}"
        with shuffles_dropped(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = out
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for path in [p for p, t in self.paths.items() if any(t is x for x in tables)]:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
            del self.paths[path]

    def send(self, value: object):  # noqa: ANN201
        """A broadcast, destroyed with its files on the driver and all executors when this is cleared."""
        self.sent.append(self.spark.sparkContext.broadcast(value))
        return self.sent[-1]

    def clear(self) -> None:
        self.drop(*self.paths.values())
        while self.sent:
            self.sent.pop().destroy()
        Work._open.discard(self)


@atexit.register
def _clear_all() -> None:
    for work in list(Work._open):
        with contextlib.suppress(Exception):  # Spark may have ended before
            work.clear()


def fresh(name: str, taken: list[str]) -> str:
    """A name like this one that is not taken."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def kept_apart(keep: list[str], own: list[str]) -> list[str]:
    """Names under which kept columns come back: their own, but with a line below if an operator's result has a column of that name."""
    out: list[str] = []
    for c in keep:
        out.append(fresh(c, [*own, *out]))
    return out


def row_order(docs: DataFrame) -> DataFrame:
    """Add ``ordinal``, a number from 0 that orders documents by doc_id; rows that agree in doc_id and text share it.

    Where they may do so, a column ``text_key`` is added, too.

    Ids that are unique numbers from 0 to below 2**35 are taken as they are. Otherwise ids
    and hashes of texts are sorted by range and numbered from the sizes of the
    ranges, null ids first.
    """
    kind = dict(docs.dtypes)["doc_id"]
    if kind in ("bigint", "int", "smallint", "tinyint"):
        found = first_row(docs.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.min("doc_id"), F.max("doc_id"), F.max("n"), F.count_if(F.isnull("doc_id"))))
        if found[0] is None or (found[0] >= 0 and found[1] < 1 << 35 and found[2] == 1 and not found[3]):
            return docs.withColumn("ordinal", F.col("doc_id").cast("long"))
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    keys = checkpoint(docs.select("doc_id", "text_key").distinct().sort(F.asc_nulls_first("doc_id"), "text_key").withColumn("row", F.monotonically_increasing_id()))
    # the sort has laid out ranges in order; within one, the lower bits count the rows
    part, place = F.shiftright("row", 33), F.col("row").bitwiseAND((1 << 33) - 1)
    sizes = keys.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    starts = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    numbered = keys.withColumn("part", part).join(starts, "part").select(F.col("doc_id").alias("own_id"), F.col("text_key").alias("own_key"), (F.col("start") + place).alias("ordinal"))
    joined = docs.join(numbered, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_key") == F.col("own_key")))
    return joined.drop("own_id", "own_key")
