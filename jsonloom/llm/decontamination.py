"""Benchmark decontamination by template canonicalisation.

Texts fall into words: letters, digits, bytes beyond ASCII but for the blocks of
punctuation (general, of Latin-1, CJK and full width); each CJK sign is a word.
A point or comma between digits belongs to the number, and a number ends where
letters begin. Upper case of ASCII and Latin-1 goes to lower case. Numbers (in digits or as
words) become <num>, a unit after one <unit>, a capitalised word inside a
sentence <name>. Windows of WINDOW consecutive tokens are hashed with and
without <name>, and with <name> for capitalised words that begin a sentence, too;
documents are hash-joined with benchmark items on them. Windows with more than
half of their tokens in slots of numbers and units are hashed with their words
as they are.
Matches of a document and an item at the same offset are aligned: what stands
in a slot of the item must always become the same in the document, so that a
question with other numbers and names is caught; if it does not, only windows
without slots count there. The form with <name> at the start of sentences counts
where it is consistent as well and covers more. A document contains an item if matching windows
cover half of it, or LONG of its tokens.

Items of 4 to WINDOW - 1 tokens are one window. Those of 2 or 3 are one window of
their words as they are; an item of one word is found in a text of that word alone.
Null and empty texts have no windows. Every document row gives its own results,
equal rows equal ones; null ids stay null. Very long texts are looked at whole,
empty tables give no rows, and other columns are dropped, so none clashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HashIndex, Work, checkpoint, mix, slices, small_batches
from .windows import BYTES, weights, window_hashes

WINDOW, SHORTEST, LONG, SHARE = 8, 4, 13, 0.5
#: Words of a benchmark that documents are held against before the join, and windows that are broadcast, at most.
MAX_VOCABULARY, MAX_BROADCAST = 2_000_000, 500_000
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half dozen".split()
UNITS = "mm cm m km inch inches foot feet ft yard yards mile miles g kg mg gram grams kilogram kilograms ounce ounces pound pounds lb lbs ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years percent dollar dollars cent cents euro euros degree degrees meter meters metre metres kilometer kilometers kilometre kilometres mph kmh watt watts volt volts".split()
NUM, UNIT, NAME = 1, 2, 3

_byte = np.arange(256)
_digit = (_byte >= 48) & (_byte <= 57)
_upper = (_byte >= 65) & (_byte <= 90)
_letter = _upper | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 128) | (_byte == 95)
_stop = np.isin(_byte, list(b'.!?:;"\n'))


def punctuation(data: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Whether each byte belongs to a sign of U+00A0-BF (but for letters), U+2000-206F, U+3000-303F or the signs of U+FF01-FF65."""
    third = np.append(after[1:], 0).astype(np.uint8)
    two = (data == 0xC2) & (after >= 0xA0) & (after <= 0xBF) & ~np.isin(after, [0xAA, 0xB5, 0xBA])
    wide = (data == 0xEF) & (((after == 0xBC) & ((third <= 0x8F) | ((third >= 0x9A) & (third <= 0xA0)) | (third >= 0xBB))) | ((after == 0xBD) & ((third <= 0x80) | ((third >= 0x9B) & (third <= 0xA5)))))
    three = ((data == 0xE2) & ((after == 0x80) | (after == 0x81))) | ((data == 0xE3) & (after == 0x80)) | wide
    lead = two | three
    out = lead.copy()
    out[1:] |= lead[:-1]
    out[2:] |= three[:-2]
    return out


class Tokens:
    """Tokens of texts, end to end: a hash of the lower-case word, and whether it is a number, unit or name."""

    def __init__(self, texts: list[str | None]) -> None:
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        self.data = data = np.frombuffer(b"\n".join([b"", *raw, b""]), np.uint8)
        before, after = np.append(0, data[:-1]).astype(np.uint8), np.append(data[1:], 0).astype(np.uint8)
        digit, letter = _digit[data], _letter[data] & ~punctuation(data, after)
        number = digit | (((data == 46) | (data == 44)) & _digit[before] & _digit[after])
        solid = letter | number
        number_before, solid_before = np.append(False, number[:-1]), np.append(False, solid[:-1])
        # a CJK sign is a word of its own
        sign = letter & (((data >= 0xE4) & (data <= 0xE9)) | ((data == 0xE3) & (after >= 0x81)))
        begins = solid & (~solid_before | (number_before & letter & (data < 128)) | sign | np.append([False] * 3, sign[:-3])[: len(sign)])
        self.start = np.flatnonzero(begins)
        ends = np.cumsum([len(r) + 1 for r in raw]) + 1 if raw else np.zeros(0, np.int64)
        self.first = np.append(0, np.searchsorted(self.start, ends)).astype(np.int64)
        self.of = np.repeat(np.arange(len(raw)), np.diff(self.first))
        # a word ends where its last solid byte before the next one's start is
        count = np.cumsum(solid)
        n = len(self.start)
        solid_at = np.flatnonzero(solid)
        last = np.append(count[self.start[1:]] - 2, count[-1] - 1) if n else np.zeros(0, np.int64)
        self.end = solid_at[last] + 1 if n else np.zeros(0, np.int64)
        wide = (before == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
        lower = np.where(_upper[data] | wide, data + 32, data)
        if not n:
            self.hash, self.number, self.unit, self.name, self.capital = np.zeros(0, np.uint64), *(np.zeros(0, bool) for _ in range(4))
            return
        lens = self.end - self.start
        at = np.arange(len(data)) - np.repeat(np.append(0, self.start), np.diff(np.append(np.append(0, self.start), len(data))))
        longest = int(lens.max())
        values = np.where(solid, BYTES[lower] * weights(longest)[np.minimum(at, longest - 1)], np.uint64(0))
        self.hash = mix(np.add.reduceat(values, self.start) + lens.astype(np.uint64)) | np.uint64(8)
        self.number = (np.add.reduceat((solid & ~number).astype(np.int32), self.start) == 0)
        if _special is not None:
            self.number |= np.isin(self.hash, _special[0])
            follows = np.append(False, self.number[:-1] & (self.of[1:] == self.of[:-1]))
            self.unit = follows & ~self.number & np.isin(self.hash, _special[1])
            stops = np.cumsum(_stop[data])
            inner = np.append(False, (stops[self.start[1:]] == stops[self.end[:-1] - 1]) & (self.of[1:] == self.of[:-1]))
            capital = _upper[data[self.start]] | ((data[self.start] == 0xC3) & wide[np.minimum(self.start + 1, len(data) - 1)])
            self.capital = capital & ~self.number & ~self.unit
            self.name = self.capital & inner

    def value(self, i: int) -> str:
        return bytes(self.data[self.start[i] : self.end[i]]).decode("utf-8", "replace").lower()


_special: tuple[np.ndarray, np.ndarray] | None = None
_special = Tokens(NUMBERS).hash, Tokens(UNITS).hash


def windows(tokens: Tokens, lengths: list[int], vocabulary: HashIndex | None) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray, bool]]:
    """For each length and form: starts, hashes, the length, whether each token is in a slot, whether words that begin a sentence may be."""
    total = np.diff(tokens.first)
    ends = np.repeat(tokens.first[1:], total)
    known = np.ones(len(tokens.hash), bool) if vocabulary is None else vocabulary.find((tokens.hash >> np.uint64(1)).astype(np.int64)) >= 0
    plain = np.where(tokens.number, NUM, np.where(tokens.unit, UNIT, 0))
    within = lambda sums, at, n: sums[at + n - 1] - np.where(at > 0, sums[np.maximum(at - 1, 0)], 0)
    heavy = np.cumsum(plain > 0)
    for form in ("raw", "plain", "named", "initial"):
        slot = {"raw": np.zeros_like(plain), "plain": plain, "named": np.where(tokens.name, NAME, plain), "initial": np.where(tokens.capital, NAME, plain)}[form]
        code = np.where(slot > 0, slot.astype(np.uint64), tokens.hash)
        bad, held = np.cumsum(~known & (slot == 0)), np.cumsum(slot > 0)
        # what makes it another window than those before
        new = {"named": np.cumsum(tokens.name), "initial": np.cumsum(tokens.capital & ~tokens.name)}.get(form)
        for n in lengths:
            at = np.flatnonzero(np.arange(len(code)) + n <= ends)
            good = within(bad, at, n) == 0
            if form == "raw":
                if n >= SHORTEST:
                    good &= 2 * within(heavy, at, n) > n
                elif n == 1:
                    good &= total[tokens.of[at]] == 1
            else:
                good &= (2 * within(held, at, n) <= n) & (n >= SHORTEST)
            if new is not None:
                good &= within(new, at, n) > 0
            at = at[good]
            if len(at):
                yield at, window_hashes(code, n)[at] + np.uint64(n), n, slot, form == "initial"


def window_rows(texts: DataFrame, lengths: list[int], vocabulary: HashIndex | None) -> DataFrame:
    """id, at (number of the token), length, hash, slots (texts of the tokens in slots, as 'place:value'), n_tokens, initial (whether they may begin a sentence), of texts with columns id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            tokens = Tokens(batch.column(1).to_pylist())
            for at, hashes, n, slot, initial in windows(tokens, lengths, vocabulary):
                held = slot > 0
                sums = np.cumsum(held)
                some = sums[at + n - 1] - np.where(at > 0, sums[np.maximum(at - 1, 0)], 0) > 0
                values = [[f"{j}:{tokens.value(i + j)}" for j in range(n) if held[i + j]] if s else [] for i, s in zip(at.tolist(), some.tolist(), strict=True)]
                local = at - tokens.first[tokens.of[at]]
                total = np.diff(tokens.first)[tokens.of[at]]
                yield pa.record_batch([batch.column(0).take(pa.array(tokens.of[at])), pa.array(local), pa.array(np.full(len(at), n, np.int64)), pa.array(hashes.view(np.int64)), pa.array(values, pa.list_(pa.string())), pa.array(total), pa.array(np.full(len(at), initial))], ["id", "at", "length", "hash", "slots", "n_tokens", "initial"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.where("text IS NOT NULL").mapInArrow(run, f"id {kind}, at long, length long, hash long, slots array<string>, n_tokens long, initial boolean")


def word_hashes(texts: DataFrame) -> DataFrame:
    """word (a 63-bit hash) and n_tokens for each text's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            tokens = Tokens(batch.column(0).to_pylist())
            total = np.diff(tokens.first)
            yield pa.record_batch([pa.array((tokens.hash >> np.uint64(1)).astype(np.int64)), pa.array(total[tokens.of])], ["word", "n_tokens"])

    return texts.select("text").where("text IS NOT NULL").mapInArrow(run, "word long, n_tokens long")


def covered(places: str) -> str:
    """SQL: how many tokens the windows (structs at, length) in a sorted array cover."""
    return f"aggregate({places}, named_struct('n', 0L, 'upto', 0L), (s, x) -> named_struct('n', s.n + greatest(x.at + x.length - greatest(x.at, s.upto), 0L), 'upto', greatest(s.upto, x.at + x.length)), s -> s.n)"


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Columns: doc_id, item_id, n_covered and n_item (tokens), n_slots (kinds of values in aligned slots), changed (whether any differs).

    One row for each document row and item that it contains; documents without any have none.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    found = checkpoint(located(rows.select(F.struct("doc_id", "key").alias("id"), "text"), benchmark, window, item_col))
    found = found.select(F.col("id.doc_id").alias("own_id"), F.col("id.key").alias("own_key"), "item_id", "n_covered", "n_item", "n_slots", "changed")
    # rows equal in id and text have been one so far
    if found.count() <= MAX_BROADCAST:
        found = F.broadcast(found)
    out = rows.select("doc_id", "key").join(found, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("key") == F.col("own_key")))
    return out.drop("key", "own_id", "own_key")


def located(texts: DataFrame, benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id", work: Work | None = None) -> DataFrame:
    """As ``matches``, for texts with columns id, text; one row for each id and item."""
    small_batches(texts.sparkSession)
    items = benchmark.select(F.col(item_col).alias("id"), F.col("text").cast("string").alias("text"))
    words = word_hashes(items)
    size = words.agg(F.count_distinct("word").alias("n")).first()["n"]
    short = sorted(r[0] for r in words.where(F.col("n_tokens") < window).select("n_tokens").distinct().collect())
    vocabulary = None
    if 0 < size <= MAX_VOCABULARY:
        known = HashIndex(words.select("word").distinct().toPandas()["word"].to_numpy())
        vocabulary = _Shared((work or Work(texts.sparkSession)).send(known))
    lengths = [*short, window]
    asked = window_rows(items, lengths, None).where((F.col("length") == window) | (F.col("length") == F.col("n_tokens")))
    asked = asked.select(F.col("id").alias("item_id"), F.col("at").alias("item_at"), "hash", F.col("slots").alias("item_slots"), F.col("n_tokens").alias("n_item"), F.col("initial").alias("item_initial")).distinct()
    if asked.count() <= MAX_BROADCAST:
        asked = F.broadcast(asked)
    rows = window_rows(texts, lengths, vocabulary).drop("n_tokens")
    joined = rows.join(asked, "hash")
    place = F.struct(F.col("item_at").alias("at"), "length")
    pairs = F.expr("transform(item_slots, (v, i) -> named_struct('item', substring_index(v, ':', -1), 'doc', substring_index(slots[i], ':', -1)))")
    # at one offset: what an item's value becomes must be one value
    initial = F.col("initial") | F.col("item_initial")
    aligned = joined.groupBy("id", "item_id", "n_item", (F.col("at") - F.col("item_at")).alias("offset")).agg(
        F.collect_set(place).alias("all"), F.collect_set(F.when(~initial, place)).alias("inner"), F.collect_set(F.when(F.size("slots") == 0, place)).alias("plain"),
        F.array_distinct(F.flatten(F.collect_set(pairs))).alias("all_pairs"), F.array_distinct(F.flatten(F.collect_set(F.when(~initial, pairs)))).alias("pairs"),
    )
    one = lambda p: F.size(p) == F.size(F.array_distinct(F.col(f"{p}.item")))
    none = F.array().cast("array<struct<item:string,doc:string>>")
    aligned = aligned.select("id", "item_id", "n_item", "all", "all_pairs", one("all_pairs").alias("consistent"), F.when(one("pairs"), F.col("inner")).otherwise(F.col("plain")).alias("places"), F.when(one("pairs"), F.col("pairs")).otherwise(none).alias("pairs"))
    wider = F.col("consistent") & F.expr(f"{covered('array_sort(all)')} > {covered('array_sort(places)')}")
    aligned = aligned.select("id", "item_id", "n_item", F.when(wider, F.col("all")).otherwise(F.col("places")).alias("places"), F.when(wider, F.col("all_pairs")).otherwise(F.col("pairs")).alias("pairs"))
    whole = aligned.groupBy("id", "item_id", "n_item").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"))
    whole = whole.withColumn("n_covered", F.expr(covered("places")))
    whole = whole.where((F.col("n_covered") >= LONG) | ((F.col("n_covered") > 0) & (F.col("n_covered") >= SHARE * F.col("n_item"))))
    return whole.select("id", "item_id", "n_covered", "n_item", F.size("pairs").cast("long").alias("n_slots"), F.expr("exists(pairs, x -> x.item <> x.doc)").alias("changed"))


class _Shared:
    """A broadcast index, opened where it is used."""

    def __init__(self, shared) -> None:  # noqa: ANN001
        self.shared = shared

    def find(self, keys: np.ndarray) -> np.ndarray:
        return self.shared.value.find(keys)
