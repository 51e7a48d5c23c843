"""Packing by power-of-two decomposition.

A document's ids are cut into pieces of ``limit`` ids, and what remains into
pieces of falling powers of two, as in its binary form. Every piece is a
sequence of its own, so no sequence crosses documents, none is padded, and
sequences of equal length form buckets: sequence ids are dense, and those of a
bucket follow each other.

Null and empty texts have the end id alone. Repeated rows are packed each for
itself, and an empty table gives no pieces. A very long text is cut like any
other; a very long word is merged rank by rank, in time that grows with its
length. Other columns are dropped, so their names cannot clash.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HashIndex, checkpoint, slices, small_batches
from .merging import NONE, merge

#: The split that ``Encoder`` knows: contractions, runs of letters, single digits, runs of other signs.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words whose ids a worker remembers.
CACHE = 400_000
#: Characters of a word that is remembered, at most.
LONGEST = 64
#: Letters of Latin-1 in lower case, then signs of ASCII: two pre-tokens of which neither merges into the other.
PLAIN = re.compile("([a-z\u00df-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)")
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of words as the tokenizers library gives them.

    Words of plain letters, with signs after them, are merged here in numpy when the model is a
    byte-level one with word ends, as their normal form and pre-tokens are plain to see; all others
    go through the library.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.parts = Tokenizer.from_file(path), {}, {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        splits = [x.get("pattern", {}).get("Regex", "") for x in spec["pre_tokenizer"].get("pretokenizers", [])] if spec["pre_tokenizer"] else []
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        self.own = model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>" and not model["dropout"] and kinds == ["NFC", "Replace", "Lowercase"] and splits[:1] == [SPLIT]
        if not self.own:
            return
        vocab, bytes_ = model["vocab"], byte_characters()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.n = len(vocab)
        self.pairs = HashIndex(np.array([vocab[a] * self.n + vocab[b] for a, b in pairs], np.int64))
        self.product = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.inner = np.array([vocab[c] for c in bytes_], np.int64)
        self.last = np.array([vocab[c + "</w>"] for c in bytes_], np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        rank = self.pairs.find(left * self.n + right)
        return np.where(rank >= 0, rank, NONE)

    def merged(self, parts: list[str]) -> list[bytes]:
        """Ids of pre-tokens."""
        raw = [p.encode() for p in parts]
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        sym, ends = self.inner[data], np.cumsum(lens)
        sym[ends - 1] = self.last[data[ends - 1]]
        sym, seq = merge(sym, np.repeat(np.arange(len(raw)), lens), self.pair, self.product)
        out, to = sym.astype("<u4").tobytes(), (4 * np.cumsum(np.bincount(seq, minlength=len(raw)))).tolist()
        return [out[a:b] for a, b in zip([0, *to], to, strict=False)]

    def learn(self, words: list[str]) -> None:
        """Put the ids of the words into ``known``."""
        plain, rest = [], []
        for w in words:
            try:
                w.encode("latin-1")
                m = PLAIN.fullmatch(w.lower()) if self.own else None
            except UnicodeEncodeError:
                m = None
            if m:
                plain.append((w, m[1], m[2]))
            else:
                rest.append(w)
        if len(self.parts) > CACHE:
            self.parts = {}
        new = list({p for _, a, b in plain for p in (a, b) if p and p not in self.parts})
        if new:
            self.parts.update(zip(new, self.merged(new), strict=True))
        self.known.update((w, self.parts[a] + self.parts[b] if b else self.parts[a]) for w, a, b in plain)
        for p in new:
            if len(p) > LONGEST:
                del self.parts[p]
        if rest:
            ids = self.tokenizer.encode_batch(rest, add_special_tokens=False)
            self.known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(rest, ids, strict=True))


def byte_characters() -> list[str]:
    """The character that byte-level models write for each byte: itself if it shows, else one from 256 on."""
    shows = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shows]
    return [chr(b) if b in shows else chr(256 + hidden.index(b)) for b in range(256)]


def encode(texts: list[str | None], tokenizer_path: str, end_id: int) -> list[bytes]:
    """Ids of each text and the end id, as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and never joins what stands on two sides
    of a blank or line feed, so words between those are encoded once each.
    """
    if tokenizer_path not in _encoders:
        _encoders[tokenizer_path] = Encoder(tokenizer_path)
    encoder = _encoders[tokenizer_path]
    known = encoder.known
    if len(known) > CACHE:
        known.clear()
    end = int(end_id).to_bytes(4, "little")
    found, new = [], set()
    for text in texts:
        words = text.replace("\n", " ").split(" ") if text else []
        ids = list(map(known.get, words))
        gaps = []
        at = -1
        for _ in range(ids.count(None)):
            at = ids.index(None, at + 1)
            gaps.append((at, words[at]))
            new.add(words[at])
        found.append((ids, gaps))
    if new:
        encoder.learn(list(new))
    out = []
    for ids, gaps in found:
        for at, word in gaps:
            ids[at] = known[word]
        ids.append(end)
        out.append(b"".join(ids))
    for word in new:
        if len(word) > LONGEST:
            del known[word]
    return out


def piece_lengths(n: int, limit: int) -> list[int]:
    """``limit`` as often as it goes, then the powers of two in what remains, largest first."""
    whole, rest = divmod(n, limit)
    return [limit] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def decompose(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 2, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, 4 bytes an id), doc_tokens; bucket_part and bucket_row place it in its bucket."""
    if limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in slices(batches, "text"):
            coded = encode(batch.column(1).to_pylist(), tokenizer_path, end_id)
            of, start, length, ids, total, place = [], [], [], [], [], []
            for i, x in enumerate(coded):
                at, n = 0, len(x) // 4
                for size in piece_lengths(n, limit):
                    of.append(i)
                    start.append(at)
                    length.append(size)
                    ids.append(x[4 * at : 4 * (at + size)])
                    total.append(n)
                    place.append(seen.get(size, 0))
                    seen[size] = place[-1] + 1
                    at += size
            long = lambda x: pa.array(x, pa.int64())
            yield pa.record_batch([batch.column(0).take(long(of)), long(start), long(length), pa.array(ids, pa.binary()), long(total), long([part] * len(of)), long(place)], ["doc_id", "start", "length", "ids", "doc_tokens", "bucket_part", "bucket_row"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, bucket_part long, bucket_row long")


def assign_sequences(pieces: DataFrame) -> DataFrame:
    """Give every piece a dense sequence_id and offset 0; buckets in falling length.

    The pieces are materialised first, so that ids hold if a task runs again.
    What is numbered in one place are counts by task, for one length, and the
    counts of all lengths.
    """
    pieces = checkpoint(pieces)
    counts = pieces.groupBy("length", "bucket_part").agg(F.count("*").alias("n"))
    before = lambda order: F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lengths = counts.groupBy("length").agg(F.sum("n").alias("n")).select("length", before(Window.orderBy(F.desc("length"))).alias("base"))
    within = counts.select("length", "bucket_part", before(Window.partitionBy("length").orderBy("bucket_part")).alias("within"))
    starts = within.join(F.broadcast(lengths), "length").select("length", "bucket_part", (F.col("base") + F.col("within")).alias("first"))
    numbered = pieces.join(starts, ["length", "bucket_part"])
    return numbered.withColumns({"sequence_id": F.col("first") + F.col("bucket_row"), "offset": F.lit(0).cast("long")}).drop("first", "bucket_part", "bucket_row")


def pack(docs: DataFrame, **options) -> DataFrame:
    """Pieces with their ids, sequence_id and offset."""
    return assign_sequences(decompose(docs, **options))
