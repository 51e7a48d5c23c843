"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of labelled text. A text is parsed
greedily into the longest phrases that the automaton knows; the language that
needs the fewest phrases for each character wins, ties going to the smaller
name. Texts are parsed in segments of SEGMENT characters, side by side in numpy
arrays, so that a very long text costs no more for a character than a short
one; a phrase ends at the end of a segment.

Every letter of the labelled text has a symbol of its own. Transitions by the
commonest ones are in a dense table, those by the rest in a hash table.

Texts count as lower-case letters, with one space for whatever is between
them. Null texts and texts without letters are ``und`` with score 0. The score
is the second smallest number of phrases over the sum of the two smallest; 1 if
there is one language only. Without labelled rows all texts are ``und``.

Automata are fitted on labelled rows with letters in the order of a hash of
their id, at most MAX_ROWS for a language, as long as they fit into BUDGET
characters whole. A language that has only longer texts learns the shortest one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HashIndex, Work, crc_mod, kept_apart, slices, small_batches

#: Rows and characters that a language is learned from, at most.
MAX_ROWS, BUDGET = 200, 40_000
#: Letters and entries of the dense table, at most; other transitions are hashed.
DENSE, ENTRIES = 120, 1 << 25
SEGMENT = 256
SPACE, OTHER, PAD = 0, 1, 2


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The transitions of the states; state 0 is the start, and all states accept."""
    follow, link, length, last = [{}], [-1], [0], 0
    for x in symbols:
        new = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and x not in follow[p]:
            follow[p][x] = new
            p = link[p]
        if p >= 0:
            q = follow[p][x]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = copy
                while p >= 0 and follow[p].get(x) == q:
                    follow[p][x] = copy
                    p = link[p]
        last = new
    return follow


class Parser:
    """All languages' automata: a table of transitions by common letters, and a hash table of those by rare ones."""

    def __init__(self, taught: dict[str, list[str]], budget: int = BUDGET, dense: int = DENSE) -> None:
        self.langs = sorted(taught)
        letters: dict[str, int] = {}
        for c, n in Counter(c for texts in taught.values() for text in texts for c in text).items():
            if c.isalpha():
                letters[c.lower()[0]] = letters.get(c.lower()[0], 0) + n
        ids = {c: i + 3 for i, c in enumerate(sorted(letters, key=lambda c: (-letters[c], c)))}
        # letters only; each goes to its lower case, the first letter of it if there are several
        self.symbol = np.zeros(0x110000, np.int32)
        for code in range(0x110000):
            c = chr(code)
            if c.isalpha():
                self.symbol[code] = ids.get(c.lower()[0], OTHER)
        automata = []
        for lang in self.langs:
            symbols, left = [], budget
            texts = [self.symbols([text])[0].tolist() for text in taught[lang]]
            for x in texts:
                if len(x) < left:
                    symbols += [*x, SPACE]
                    left -= len(x) + 1
            if texts and not symbols:
                symbols = [*min(texts, key=len), SPACE]
            automata.append(suffix_automaton(symbols))
        states = sum(map(len, automata))
        self.width = 3 + max(0, min(len(ids), dense, ENTRIES // max(states, 1) - 3))
        parts, self.roots, base, keys, ends = [], [], 0, [], []
        for follow in automata:
            to = np.full((len(follow), self.width), -1, np.int64)
            for s, edges in enumerate(follow):
                for x, t in edges.items():
                    if x < self.width:
                        to[s, x] = t
                    else:
                        keys.append((s * self.width + base) << 20 | x)
                        ends.append(t * self.width + base)
            # a transition gives the next state's row in the table; where a phrase ends, its complement
            start = np.where(to[0] >= 0, to[0], 0)
            part = np.where(to >= 0, to * self.width + base, ~(start * self.width + base))
            part[:, PAD] = np.arange(len(follow)) * self.width + base
            parts.append(part.astype(np.int32).ravel())
            self.roots.append(base)
            base += part.size
        self.table = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.rare, self.rare_to = HashIndex(np.array(keys, np.int64)) if keys else None, np.array(ends, np.int32)

    def by_rare(self, rows: np.ndarray, letters: np.ndarray, roots: np.ndarray) -> np.ndarray:
        """What the table would give for rare letters."""
        at = self.rare.find(rows.astype(np.int64) << 20 | letters)
        out = self.rare_to[at]
        if len(end := np.flatnonzero(at < 0)):
            again = self.rare.find(roots[end].astype(np.int64) << 20 | letters[end])
            out[end] = ~np.where(again >= 0, self.rare_to[again], roots[end])
        return out

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all texts, runs of spaces made one, and the number of symbols of each."""
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        x = self.symbol[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        of = np.repeat(np.arange(len(texts)), lens)
        keep = np.ones(len(x), bool)
        if len(x):
            keep[1:] = (x[1:] != SPACE) | (x[:-1] != SPACE) | (of[1:] != of[:-1])
        return x[keep], np.bincount(of[keep], minlength=len(texts))

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases by language and text; symbols of each text; whether it has a letter."""
        x, lens = self.symbols(texts)
        of = np.repeat(np.arange(len(texts)), lens)
        letters = np.bincount(of, x != SPACE, len(texts)) > 0
        pieces = -(-lens // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), pieces)
        grid = np.full((len(owner), SEGMENT), PAD, np.int32)
        inside = np.arange(len(x)) - np.repeat(np.cumsum(lens) - lens, lens)
        grid[np.repeat(np.cumsum(pieces) - pieces, lens) + inside // SEGMENT, inside % SEGMENT] = x
        steps = np.ascontiguousarray(grid.T)
        roots = np.array(self.roots, np.int32)
        state = np.repeat(roots[:, None], len(owner), 1)
        count = np.ones(state.shape, np.int32)
        some_rare = (steps >= self.width).any(1) if self.rare is not None else np.zeros(SEGMENT, bool)
        for step, mixed in zip(steps, some_rare, strict=True):
            if mixed:
                rare = np.flatnonzero(step >= self.width)
                tops, rows, letter = np.repeat(roots, len(rare)), state[:, rare].ravel(), np.tile(step[rare], len(roots))
                step = np.where(step >= self.width, OTHER, step)
                to = self.table[state + step]
                to[:, rare] = self.by_rare(rows, letter, tops).reshape(len(roots), -1)
            else:
                state += step
                to = self.table[state]
            ended = to >> 31
            count -= ended
            state = to ^ ended
        out = np.zeros((len(self.langs), len(texts)))
        for i in range(len(self.langs)):
            out[i] = np.bincount(owner, count[i], len(texts))
        return out, lens, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        count, _, letters = self.phrases([t or "" for t in texts])
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        best = count.argmin(0)
        ranked = np.sort(count, 0)
        score = np.ones(len(texts)) if len(self.langs) == 1 else ranked[1] / np.maximum(ranked[0] + ranked[1], 1)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], np.where(letters, score, 0.0)


def fit(docs: DataFrame, max_rows: int = MAX_ROWS, budget: int = BUDGET) -> Parser:
    """Learn from documents whose crc32(doc_id) modulo 4 is not 2; columns doc_id, text, lang."""
    usable = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL").where(crc_mod("doc_id", 4) != 2).where(F.col("text").rlike(r"\p{L}"))
    # the first of each language by hash, longer texts after all others and by length; only ids, languages and lengths are ranked
    size, over = F.length("text"), F.greatest(F.length("text") - budget, F.lit(0))
    ids = usable.select("doc_id", "lang", size.alias("size"), over.alias("over"), F.xxhash64(F.col("doc_id").cast("string")).alias("place"))
    order = Window.partitionBy("lang").orderBy("over", "place", "doc_id", "size")
    first = ids.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_rows).where((F.col("over") == 0) | (F.col("rank") == 1))
    first = first.select("doc_id", "lang", "size", "place").distinct()
    texts = usable.select("doc_id", "text", F.col("lang").alias("own"), size.alias("length"))
    rows = texts.join(F.broadcast(first), "doc_id").where("own = lang AND length = size").select("lang", "place", "doc_id", "text").collect()
    taught: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r.lang, r.place, str(r.doc_id), r.text)):
        taught.setdefault(row.lang, []).append(row.text)
    return Parser(taught, budget)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None, work: Work | None = None, **options) -> DataFrame:
    """Columns: doc_id, held_out (crc32 of the id modulo 4 is 2), lang_pred, score, and the columns in ``keep``.

    Rows are kept as they are, repeated ones too; an empty table gives none, and
    very long texts are parsed whole. A kept column whose name the result has
    too comes back with a line below after its name.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    shared = (work or Work(spark)).send(fit(rows, **options))
    extra = [c for c in keep or [] if c not in ("doc_id", "text")]
    carried = [f"keep_{i}" for i in range(len(extra))]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(k) for c, k in zip(extra, carried, strict=True)))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 256 << 10):
            langs, score = shared.value.predict(batch.column(1).to_pylist())
            kept = [batch.column(0), *([batch.column(1)] if "text" in (keep or []) else []), *batch.columns[2:]]
            yield pa.record_batch([*kept, pa.array(langs, pa.string()), pa.array(score)], names)

    kinds = dict(rows.dtypes)
    names = ["doc_id", *(["text"] if "text" in (keep or []) else []), *carried, "lang_pred", "score"]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names[:-2]) + ", lang_pred string, score double"
    out = rows.mapInArrow(predict, schema).withColumn("held_out", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)))
    back = kept_apart(extra, ["doc_id", "text", "lang_pred", "score", "held_out"])
    return out.withColumnsRenamed(dict(zip(carried, back, strict=True)))
