"""Substring dedup by level-wise doubling.

A word goes if a window of ``window`` words covers it whose words also start
earlier: at a smaller doc_id, or earlier in the same document. Windows are
judged on the input.

Levels double: ``start`` words, twice as many, and so on up to ``window``. Not
all windows of a level need a look: of the short windows in a long one, those
with the smallest hash stand for it, and equal long windows have the same ones.
Short windows that stand for a long one are counted; of those found once, no
extension can repeat. The others are extended to twice their length, until no
candidates survive or the windows are ``window`` words long; of those, the
earliest place of each hash stays. No longer level can change a result.

A place is the document's ordinal and the number of the word in one 64-bit
number, of which the longest text gets as many bits as it needs; if the
documents do not fit into the rest, it is an error. Short windows are told
apart by 64 bits, which can only add candidates, and windows of full length by 128.

Words are ``[^\\x20\\x09-\\x0D]+``. Null and empty texts have no words, an empty
table gives no rows, and a very long text is handled whole. Rows with the same
doc_id and text are one document; rows with the same doc_id and different texts
are ordered by a hash of the text. Null ids come first. A kept column whose name
the result has too comes back with a line below after its name.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, first_row, kept_apart, row_order, slices, small_batches
from .windows import TOP, Words, second_hashes, sliding, window_hashes


def word_bits(docs: DataFrame) -> int:
    """Bits for the number of a word: a word and what divides it from the next take two bytes."""
    found = first_row(docs.agg(F.max(F.octet_length("text")), F.max("ordinal")))
    bits = max(1, ((found[0] or 0) // 2 + 1).bit_length())
    if (found[1] or 0).bit_length() + bits > 63:
        raise ValueError(f"{found[1] + 1} documents and texts of {found[0]} bytes do not fit into a place of 63 bits: cut the longest texts first")
    return bits


def representatives(words: Words, hashes: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the window of ``length`` words at each word (TOP if there is none), and the smallest one in the long window there (0 if there is none)."""
    short = window_hashes(hashes, length)
    short = np.where(words.inside(length), np.minimum(short, TOP - np.uint64(1)), TOP)
    return short, np.where(words.inside(window), sliding(short, window - length + 1, np.minimum, TOP), np.uint64(0))


def candidates(words: Words, hashes: np.ndarray, repeated: pa.Array | None, length: int, window: int) -> np.ndarray:
    """Whether at each word a long window starts for which a repeated window of ``length`` words stands; all of them if ``repeated`` is not given."""
    if repeated is None:
        return words.inside(window)
    flags = np.zeros(len(words.of), bool)
    lens = repeated.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flags[repeated.flatten().to_numpy() + np.repeat(words.first[:-1], lens)] = True
    short, least = representatives(words, hashes, length, window)
    span = window - length + 1
    return (sliding(np.where(flags, short, TOP), span, np.minimum, TOP) == least) & (least > 0)


def short_windows(docs: DataFrame, length: int, window: int, bits: int, before: int | None = None) -> DataFrame:
    """Hash and place of the windows of ``length`` words that stand for a long one; given the level ``before``, for one that is still a candidate by ``repeated``."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(batch.column(1).to_pylist())
            hashes = words.hashes()
            short, least = representatives(words, hashes, length, window)
            if before is not None:
                least = np.where(candidates(words, hashes, batch.column(2), before, window), least, np.uint64(0))
            span = window - length + 1
            stands = np.flatnonzero((sliding(least[::-1], span, np.maximum, np.uint64(0))[::-1] == short) & (short < TOP)) if before is None else standing(short, least, span)
            yield pa.record_batch([pa.array(short[stands].view(np.int64)), pa.array(places(words, batch.column(0).to_numpy(), stands, bits))], ["hash", "at"])

    columns = ["ordinal", "text", *(["repeated"] if before is not None else [])]
    return docs.select(columns).where("text IS NOT NULL").mapInArrow(find, "hash long, at long")


def standing(short: np.ndarray, least: np.ndarray, span: int) -> np.ndarray:
    """The places of short windows that are the smallest in one of the long windows around them that count (``least`` above 0)."""
    out = np.zeros(len(short), bool)
    for j in range(min(span, len(short))):
        out[j:] |= (short[j:] == least[: len(least) - j]) & (least[: len(least) - j] > 0)
    return np.flatnonzero(out & (short < TOP))


def places(words: Words, ordinals: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    of = words.of[at]
    return (ordinals[of] << bits) + at - words.first[of]


def by_document(places_: DataFrame, name: str, bits: int) -> DataFrame:
    """The word numbers of each document as an array."""
    return places_.groupBy(F.shiftright("at", bits).alias("own")).agg(F.collect_list(F.col("at").bitwiseAND((1 << bits) - 1).cast("int")).alias(name))


def long_windows(docs: DataFrame, length: int, window: int, bits: int) -> DataFrame:
    """128 bits of hash and the place of the long windows for which a repeated one of ``length`` words (an array in ``repeated``) stands."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(batch.column(1).to_pylist())
            hashes = words.hashes()
            at = np.flatnonzero(candidates(words, hashes, batch.column(2), length, window))
            both = (h(hashes, window)[at].view(np.int64) for h in (window_hashes, second_hashes))
            yield pa.record_batch([*map(pa.array, both), pa.array(places(words, batch.column(0).to_numpy(), at, bits))], ["hash", "hash_b", "at"])

    return docs.select("ordinal", "text", "repeated").mapInArrow(find, "hash long, hash_b long, at long")


def remove_repeats(docs: DataFrame, window: int = 20, start: int | None = None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, work: Work | None = None) -> DataFrame:
    """Columns: doc_id, those in ``keep``, text, kept (the words left, joined by one space), n_words, n_removed.

    ``start``: words at the first level, half a window if not given; a window is start times a power of two.
    """
    length = start or window // 2
    if length < 1 or window % length or (window // length) & (window // length - 1) or window == length:
        raise ValueError("window must be start times a power of two")
    spark = docs.sparkSession
    small_batches(spark)
    work = work or Work(spark)
    extra = [c for c in keep or [] if c not in (id_col, text_col)]
    carried = [f"keep_{i}" for i in range(len(extra))]  # so that no name clashes
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(k) for c, k in zip(extra, carried, strict=True)))
    base = row_order(base)
    bits = word_bits(base)
    # what a level has found is written before the next one starts, so that its shuffles can go
    asked, before, marked = base, None, None
    while length < window:
        short = work.store(short_windows(asked, length, window, bits, before))
        # a table of its own, so that the join below has plain shuffles on both sides and a hot hash is split
        again = work.store(short.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"))
        repeated = work.store(by_document(short.join(again, "hash", "left_semi"), "repeated", bits))
        work.drop(short, again, *([marked] if marked is not None else []))
        before, length = length, 2 * length
        if length < window:
            marked = work.store(base.select("ordinal", "text").join(repeated, F.col("ordinal") == F.col("own")).drop("own").dropDuplicates(["ordinal"]))
            asked = marked
            if marked.isEmpty():
                break
    marked = work.store(base.join(repeated, F.col("ordinal") == F.col("own"), "left").drop("own"))
    work.drop(repeated)
    doubtful = marked.where("repeated IS NOT NULL")
    firsts = long_windows(doubtful, before, window, bits).groupBy("hash", "hash_b").agg(F.min("at").alias("at"))
    first = work.store(by_document(firsts, "firsts", bits))
    judged = doubtful.join(first, F.col("ordinal") == F.col("own"), "left").select("doc_id", *carried, "text", "repeated", "firsts")
    clean = marked.where("repeated IS NULL").select("doc_id", *carried, "text", "repeated", F.lit(None).cast("array<int>").alias("firsts"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 1 + len(carried)
        for batch in slices(batches, "text"):
            texts = batch.column(n).to_pylist()
            kept, total, gone = [], [], []
            covered = None
            if batch.column(n + 1).null_count < batch.num_rows:
                covered = removed(Words(texts), batch.column(n + 1), batch.column(n + 2), before, window)
            at = 0
            for text in texts:
                own = text.encode("utf-8", "surrogatepass").split() if text else []
                total.append(len(own))
                mask = covered[at : at + len(own)] if covered is not None else None
                at += len(own)
                gone.append(int(mask.sum()) if mask is not None else 0)
                if gone[-1]:
                    own = itertools.compress(own, (~mask).tolist())
                kept.append(b" ".join(own).decode("utf-8", "surrogatepass"))
            yield pa.record_batch([*batch.columns[: n + 1], pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names)

    kinds = dict(judged.dtypes)
    names = ["doc_id", *carried, "text", "kept", "n_words", "n_removed"]
    schema = ", ".join(f"{c} {kinds[c]}" for c in names[:-3]) + ", kept string, n_words long, n_removed long"
    out = judged.mapInArrow(judge, schema).unionByName(clean.mapInArrow(judge, schema))
    return out.withColumnsRenamed(dict(zip(carried, kept_apart(extra, names[:1] + names[-4:]), strict=True)))


def removed(words: Words, repeated: pa.Array, firsts: pa.Array, length: int, window: int) -> np.ndarray:
    """Whether each word is covered by a long window that also starts earlier."""
    later = candidates(words, words.hashes(), repeated, length, window).astype(np.int32)
    lens = firsts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    later[firsts.flatten().to_numpy() + np.repeat(words.first[:-1], lens)] = 0
    sums = np.cumsum(later)
    return sums - np.concatenate([np.zeros(min(window, len(sums)), sums.dtype), sums[:-window]]) > 0
