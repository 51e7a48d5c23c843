"""A training corpus from raw documents: language, near-duplicates, repeated passages, benchmarks, packing.

Each stage takes (spark, docs, sf_dir) and gets what its predecessor kept,
written as Parquet and read again. All but the last return the columns of
``documents``; other columns are dropped at the first stage, so none clashes.
Null ids are documents like others. Texts of any length are handled whole, and
an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jsonloom.llm import decontamination, language_id, near_dedup, packing, substring_dedup
from jsonloom.llm.common import Work, checkpoint, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Ids that are broadcast, at most.
MAX_BROADCAST = 1_000_000
#: What the stage before has written on the way to its result, by session.
_before: dict[SparkSession, Work] = {}


def begun(spark: SparkSession) -> Work:
    """A stage begins: the result of the one before is written, so its tables and broadcasts can go."""
    if spark in _before:
        _before[spark].clear()
    _before[spark] = Work(spark)
    return _before[spark]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or without text, go; a language that is missing is filled in. Repeated rows stay."""
    out = language_id.identify(docs, keep=COLUMNS, work=begun(spark)).where("lang_pred <> 'und'")
    return out.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five words, similarity 0.8), the one with the smallest doc_id stays; of rows with one id and text, one; a null text stays."""
    return near_dedup.near_duplicates(docs, similarity=0.8, keep=COLUMNS, count_links=False, work=begun(spark)).where("kept").select(COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words and more that start earlier are cut out; documents with nothing left go, null and empty texts too. Rows with one id and text keep the same words."""
    out = substring_dedup.remove_repeats(docs, window=20, keep=COLUMNS, work=begun(spark)).where("n_removed < n_words")
    cut = F.col("n_removed") > 0
    out = out.withColumn("n_chars", F.when(cut, F.length("kept")).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.when(cut, F.col("kept")).otherwise(F.col("text"))).select(COLUMNS)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go, all rows of an id and text; null and empty texts stay."""
    work, key = begun(spark), F.xxhash64("text")
    texts = docs.select(F.struct("doc_id", key.alias("key")).alias("id"), "text")
    found = checkpoint(decontamination.located(texts, table(spark, sf_dir, "benchmark"), work=work).select("id.*").distinct().withColumnsRenamed({"doc_id": "own_id", "key": "own_key"}))
    if found.count() <= MAX_BROADCAST:
        found = F.broadcast(found)
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("own_id")) & (key == F.col("own_key")), "left_anti").select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids; each piece is a sequence. Every row has its own, a null or empty text the end id alone."""
    begun(spark)
    pieces = packing.pack(docs, limit=4096)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("substrings", without_repeats),
    ("benchmarks", without_benchmarks),
    ("packing", packed),
]

#: Automata, sketches and tokenizers can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, results = table(spark, sf_dir, "documents"), Work(spark)
    for _, stage in STAGES[:-1]:
        written = results.store(stage(spark, docs, sf_dir))
        results.drop(docs)
        docs = written
    return STAGES[-1][1](spark, docs, sf_dir)
