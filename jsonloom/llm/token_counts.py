"""Token counts by rank-synchronous merging over ragged numpy arrays.

The vocabulary is a byte-pair model with byte fallback whose pieces hold the
word mark only at their start, so a text falls into pre-tokens (marks, then
other characters) that never merge with each other. The distinct pre-tokens of
a slice that are not yet known are held as one ragged array of symbols; in each
round every sequence applies its pair of lowest rank, the leftmost if several,
and what survives is counted. Counts of pre-tokens are kept in a cache whose
size is bounded, and a text's count is the sum over its pre-tokens.

Null text counts as empty (0 bytes, 0 tokens). Rows are kept as they are,
repeated ones too; other columns are dropped, so their names cannot clash. A
very long text is a slice of its own, and a very long pre-token is merged rank
by rank, in time that grows with its length. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HashIndex, Known, slices, small_batches
from .merging import NONE, merge

MARK = "▁"
#: Pre-tokens whose counts a worker remembers.
CACHE = 600_000
#: Characters of a pre-token that is remembered, at most.
LONGEST = 64
PRETOKEN = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class MergeTable:
    """The merges of a sentencepiece byte-pair model, for lookups by pair."""

    def __init__(self, model_path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("not a byte-pair model without normalisation")
        pieces = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == 1}
        if any(MARK in p[1:] and p.strip(MARK) for p in pieces):
            raise ValueError("a piece holds the word mark inside")
        byte = sum(p.type == 6 for p in model.pieces) == 256
        ranked = sorted(pieces, key=lambda p: (-pieces[p][1], pieces[p][0]))
        self.rank = {p: i for i, p in enumerate(ranked)}
        self.n = len(ranked)
        self.bytes = byte
        self.chars = {p: r for p, r in self.rank.items() if len(p) == 1}
        keys, made = [], []
        for p, r in self.rank.items():
            for cut in range(1, len(p)):
                left, right = self.rank.get(p[:cut]), self.rank.get(p[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.n + right)
                    made.append(r)
        self.pairs, self.made = HashIndex(np.array(keys, np.int64)), np.append(np.array(made, np.int64), NONE)
        self.char_rank = np.full(0x110000, -1, np.int32)
        self.char_rank[[ord(c) for c in self.chars]] = list(self.chars.values())
        self.char_bytes = np.ones(0x110000, np.int8)
        if byte:
            for least, width in ((0x80, 2), (0x800, 3), (0x10000, 4)):
                self.char_bytes[least:] = width

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of what a pair becomes; NONE if it never merges. Unknown symbols are negative."""
        return self.made[self.pairs.find(np.where((left >= 0) & (right >= 0), left * self.n + right, -2))]

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sym = self.char_rank[points].astype(np.int64)
        seq = np.repeat(np.arange(len(words)), lens)
        # unknown characters never merge; each stands for its bytes
        extra = np.bincount(seq, np.where(sym < 0, self.char_bytes[points] - 1, 0), len(words)).astype(np.int64)
        return extra + np.bincount(merge(sym, seq, self.pair)[1], minlength=len(words))


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text; empty strings among them count nothing."""
    if not text:
        return []
    if "  " in text or text[0] == " " or MARK in text:
        return [x for part in PRETOKEN.findall(MARK + text.replace(" ", MARK)) for x in part.replace("\n", " \n ").split(" ")]
    return (MARK + text.replace(" ", " " + MARK).replace("\n", " \n ")).split(" ")


_tables: dict[str, tuple[MergeTable, Known]] = {}


def counts(texts: list[str | None], model_path: str) -> np.ndarray:
    """Tokens of each text."""
    if model_path not in _tables:
        _tables[model_path] = MergeTable(model_path), Known(0)
    merges, known = _tables[model_path]
    if not known or len(known) > CACHE:
        known.clear()
        known[""] = 0
    found, ends = [], []
    for t in texts:
        found.append(sum(map(known.__getitem__, pretokens(t))) if t else 0)
        ends.append(len(known.missing))
    n = np.array(found, np.int64)
    if known.missing:
        new = list(set(known.missing))
        known.update(zip(new, merges.count(new).tolist(), strict=True))
        of = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
        n += np.bincount(of, [known[w] for w in known.missing], len(texts)).astype(np.int64)
        known.missing = []
        for w in new:
            if len(w) > LONGEST:
                del known[w]
    return n


def count_tokens(docs: DataFrame, model_path: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns: the id, n_bytes, n_tokens, over_limit (more tokens than ``limit``)."""
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column(1).to_pylist()
            n_bytes = [len(t.encode()) if t else 0 for t in texts]
            n = counts(texts, model_path)
            yield pa.record_batch([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
