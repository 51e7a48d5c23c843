"""Toxicity by class-conditional Kneser-Ney models of the characters of words.

Both classes have a model of order six over the characters of a word (padded at
its start, with an end sign): absolute discounting, and back-off to continuation
counts that the classes share, so what only backs off says nothing about the
class. A rare or unseen form is judged by the parts it shares with known ones. A toxic
text is mostly ordinary text, so a word adds log(1 - e + e * ratio) of its two
likelihoods, with a small share e of toxic words. The sum is normalised by the
root of the number of words, and a logistic function, fitted on labelled rows
that were not counted, turns it into a score.

Models are fitted on about MAX_LABELLED labelled rows at most, chosen by a hash
of their id. Counts are document frequencies, of parts seen once, too: discounts
and continuation counts rest on these. Models end at the borders of words, so an
expression of several words counts by its words. Null and empty texts get the
score of a text without words. Very long texts are scored whole, rows are kept as
they are, an empty table gives none, and other columns are dropped. Labels that are null, and ids without text, teach nothing;
of several labels of an id, the largest holds. If one class has no rows, the
score is the smoothed share of toxic rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HashIndex, Known, crc_mod, mix, slices, small_batches

MAX_LABELLED = 40_000
ORDER = 6
DISCOUNT = 0.75
#: The share of a toxic text's words that the toxic model gives.
SHARE = 0.005
#: Words whose weights a worker remembers.
CACHE = 600_000
WORD = re.compile(r"\w+")
PAD, END = "\x02", "\x03"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of every part of six that a word has, one row each, and the word's number."""
    lens = np.fromiter(map(len, words), np.int64, len(words)) + ORDER
    text = "".join([PAD * (ORDER - 1) + w + END for w in words])
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = np.cumsum(lens)
    last = np.ones(len(points), bool)
    for j in range(ORDER - 1):
        last[ends - lens + j] = False
    at = np.flatnonzero(last)
    return points[at[:, None] + np.arange(1 - ORDER, 1)], np.repeat(np.arange(len(words)), lens - ORDER + 1)


def key_of(chars: np.ndarray) -> np.ndarray:
    """A non-negative 63-bit key of each row of characters."""
    x = np.full(len(chars), chars.shape[1], np.uint64)
    for j in range(chars.shape[1]):
        x = mix(x * np.uint64(0x100000001B3) + chars[:, j])
    return (x >> np.uint64(1)).astype(np.int64)


class Model:
    """Log ratios of the classes for known six-character parts, and of back-off weights for contexts."""

    def __init__(self, grams: list[str] | str, ordinary: np.ndarray, toxic: np.ndarray) -> None:
        text = grams if isinstance(grams, str) else "".join(grams)
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(-1, ORDER)
        shared = np.full(len(chars), 1.0 / max(1, len(np.unique(chars[:, -1]))))
        for k in range(1, ORDER):  # probability after k - 1 characters, from the kinds of characters before
            of, context = key_of(chars[:, -k - 1 :]), key_of(chars[:, -k:-1])
            _, kinds = np.unique(of, return_index=True)
            gram = self._counts(key_of(chars[:, -k:]), kinds)
            total = self._counts(context, kinds)
            _, distinct = np.unique(key_of(chars[:, -k:]), return_index=True)
            follow = self._counts(context, distinct)
            shared = (np.maximum(gram - DISCOUNT, 0) + DISCOUNT * follow * shared) / total
        context = key_of(chars[:, :-1])
        kinds, first, of = np.unique(context, return_index=True, return_inverse=True)
        logs, weights = [], []
        for n in (ordinary.astype(float), toxic.astype(float)):
            total, follow = np.bincount(of, n, len(kinds)), np.bincount(of, n > 0, len(kinds))
            weight = np.where(total > 0, DISCOUNT * follow / np.maximum(total, 1), 1.0)
            logs.append(np.log(np.maximum(n - DISCOUNT, 0) / np.maximum(total[of], 1) + weight[of] * shared))
            weights.append(np.log(weight))
        self.gram, self.ratio = HashIndex(key_of(chars)), np.append(logs[1] - logs[0], 0.0)
        self.context, self.backoff = HashIndex(kinds), np.append(weights[1] - weights[0], 0.0)

    @staticmethod
    def _counts(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """For each key, how many of the given rows have it."""
        kinds, of = np.unique(keys, return_inverse=True)
        return np.bincount(of[rows], minlength=len(kinds))[of]

    def weigh(self, words: list[str]) -> np.ndarray:
        """What each word adds to the log-likelihood ratio of a text."""
        chars, of = grams_of(words)
        at = self.gram.find(key_of(chars))
        ratio = np.where(at >= 0, self.ratio[at], self.backoff[self.context.find(key_of(chars[:, :-1]))])
        return np.logaddexp(np.log1p(-SHARE), np.log(SHARE) + np.bincount(of, ratio, len(words)))


def normalised(texts: list[str | None], model: Model, known: Known) -> np.ndarray:
    """The normalised log-likelihood ratio of each text."""
    if len(known) > CACHE:
        known.clear()
    sums, sizes, ends = [], [], []
    for text in texts:
        words = words_of(text)
        sums.append(sum(map(known.__getitem__, words)))
        sizes.append(len(words))
        ends.append(len(known.missing))
    out = np.array(sums, float)
    if known.missing:
        new = list(dict.fromkeys(known.missing))
        known.update(zip(new, model.weigh(new).tolist(), strict=True))
        of = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
        out += np.bincount(of, [known[w] for w in known.missing], len(texts))
        known.missing = []
    return out / np.sqrt(np.maximum(sizes, 1))


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of P(y = 1) by Newton steps, with a weak prior on both."""
    scale = x.std() or 1.0
    z = np.column_stack([x / scale, np.ones(len(x))])
    w, prior = np.zeros(2), np.diag([0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + prior, z.T @ (y - p) - prior @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, w[0]) / scale, w[1]


_models: dict[int, tuple[object, Known]] = {}


def scorer(shared):  # noqa: ANN001, ANN201
    """The function of one worker: the model and its cache live as long as the worker."""
    model = shared.value
    if id(model) not in _models:
        _models.clear()
        _models[id(model)] = model, Known(0.0)
    model, known = _models[id(model)]
    return lambda texts: normalised(texts, model, known)


def score(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Columns: doc_id, held_out (crc32 of the id modulo 5 is 0), score, predicted."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    marks = marks.where(crc_mod("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, max_labelled / max(1, marks.count()))
    marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003)
    # at most about max_labelled rows of two numbers
    taught = rows.join(F.broadcast(marks), "doc_id").where("text IS NOT NULL")
    fold = crc_mod("doc_id", 25) < 5  # a fifth of them: crc mod 5 is 1 to 4 here

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            seen: tuple[Counter, Counter] = Counter(), Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[toxic].update(set(words_of(text)))
            words = list(seen[0].keys() | seen[1].keys())
            if not words:
                continue
            chars, of = grams_of(words)
            keys, first, at = np.unique(key_of(chars), return_index=True, return_inverse=True)
            text = chars[first].astype("<u4").tobytes().decode("utf-32-le")
            sums = [np.bincount(at, np.array([seen[c][w] for w in words], float)[of], len(keys)).astype(np.int64) for c in (0, 1)]
            yield pa.record_batch([pa.array([text[i : i + ORDER] for i in range(0, len(text), ORDER)]), pa.array(sums[0]), pa.array(sums[1])], ["gram", "ordinary", "toxic"])

    grams = taught.where(~fold).select("text", "toxic").mapInArrow(count, "gram string, ordinary long, toxic long")
    grams = grams.groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")).toArrow().sort_by("gram")
    slope, intercept, shared = 0.0, None, None
    counts = [grams.column(c).to_numpy() for c in ("ordinary", "toxic")]
    if all((n > 0).any() for n in counts):
        # all parts end to end: no object for each
        text = "".join(b"".join(chunk.cast(pa.binary()).to_pylist()).decode() for chunk in grams.column("gram").chunks)
        del grams
        shared = spark.sparkContext.broadcast(Model(text, *counts))

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            run = scorer(shared)
            for batch in slices(batches, "text"):
                yield pa.record_batch([pa.array(run(batch.column(0).to_pylist())), batch.column(1)], ["x", "toxic"])

        held: pd.DataFrame = taught.where(fold).select("text", "toxic").mapInArrow(judge, "x double, toxic int").toPandas()
        if held["toxic"].nunique() == 2:
            slope, intercept = fit_logistic(held["x"].to_numpy(), held["toxic"].to_numpy())
    if intercept is None:
        n, ones = taught.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
        share = (ones + 0.5) / (n + 1)
        slope, intercept = 0.0, float(np.log(share / (1 - share)))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = scorer(shared) if shared is not None else lambda texts: np.zeros(len(texts))
        for batch in slices(batches, "text"):
            p = 1 / (1 + np.exp(-np.clip(slope * run(batch.column(1).to_pylist()) + intercept, -500, 500)))
            yield pa.record_batch([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = dict(rows.dtypes)["doc_id"]
    out = rows.mapInArrow(predict, f"doc_id {kind}, score double, predicted int")
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
