"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

A tree of spherical k-means is fitted on a sample of about SAMPLE vectors and
SAMPLE_VALUES numbers; every vector is put into a leaf. A query walks the tree
through a priority queue of nodes by their cosine, so that leaves come nearest
first, and visits as many as gave queries of the sample RECALL of their true
neighbours among the sample, and more until they hold k vectors beside its own.
In the leaves it visits, all vectors are compared.

Leaves are dealt into bins of about BIN vectors, neighbours together, a larger
leaf into several; queries into blocks of about ASKED. A task compares one bin
with one block, so it is bounded whatever a leaf holds. A query's row goes to a
bin once, with the leaves that it visits there.

Vectors that are null, zero, or hold null or non-finite components take no part,
nor do those without an id. Vectors of another length than most are compared with
all of their length. A query id that is there repeatedly is asked once, by the
vector with the smallest hash; one row with that id and vector, its own, is no
candidate, the others are. Scores are cosines in double precision; ties go to
the smaller id. An empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, small_batches

SAMPLE, SAMPLE_VALUES, BRANCHES, LEAF, RECALL = 40_000, 4_000_000, 64, 32, 0.96
#: Vectors of a bin and queries of a block, about, and queries that are compared at a time.
BIN, ASKED, STEP = 8_000, 4_000, 256
#: Queries of the sample that the number of visits is calibrated on.
CALIBRATION = 400


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.add.reduce(x * x, axis=1))[:, None]


class Tree:
    """Nodes in one array of centres; children[i] is empty for a leaf."""

    def __init__(self, x: np.ndarray, seed: int = 7) -> None:
        self.centres, self.children, self.leaf_of = [np.zeros(x.shape[1])], [[]], {}
        self.rng = np.random.default_rng(seed)
        self._split(0, x)
        self.centres = np.array(self.centres)
        self.leaves = [i for i, c in enumerate(self.children) if not c]
        self.leaf_of = {node: i for i, node in enumerate(self.leaves)}
        self.visits = len(self.leaves)

    def _split(self, node: int, x: np.ndarray) -> None:
        if len(x) <= 2 * LEAF:
            return
        centres = x[self.rng.choice(len(x), min(BRANCHES, len(x) // LEAF), replace=False)]
        for _ in range(10):
            near = (x @ centres.T).argmax(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, x)
            size = np.linalg.norm(sums, axis=1)
            centres = sums[size > 1e-9] / size[size > 1e-9][:, None]
        near = (x @ centres.T).argmax(1)
        kinds = np.unique(near)
        if len(kinds) < 2:
            return
        own = []
        for k in kinds:
            own.append(len(self.centres))
            self.centres.append(centres[k])
            self.children.append([])
        self.children[node] = own
        for k, child in zip(kinds, own, strict=True):
            self._split(child, x[near == k])

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: down to the nearest child."""
        node = np.zeros(len(x), np.int64)
        todo = np.arange(len(x)) if self.children[0] else np.zeros(0, np.int64)
        while len(todo):
            for n in np.unique(node[todo]):
                rows = todo[node[todo] == n]
                below = np.array(self.children[n])
                node[rows] = below[(x[rows] @ self.centres[below].T).argmax(1)]
            todo = todo[[bool(self.children[n]) for n in node[todo]]]
        return np.array([self.leaf_of[n] for n in node], np.int64)

    def order(self, cosines: np.ndarray, visits: int, sizes: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first leaves by best-bin-first, given the query's cosine to every centre; more of them until they hold ``least`` vectors."""
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < visits or (sizes is not None and held < least)):
            _, node = heapq.heappop(queue)
            if below := self.children[node]:
                for c in below:
                    heapq.heappush(queue, (-cosines[c], c))
            else:
                leaf = self.leaf_of[node]
                out.append(leaf)
                held += int(sizes[leaf]) if sizes is not None else 0
        return out

    def calibrate(self, x: np.ndarray, k: int, recall: float) -> None:
        """Set ``visits`` to the fewest leaves that hold that share of the true neighbours of some of the sample; copies count once."""
        x = np.unique(x, axis=0)
        leaf = self.assign(x)
        asked = self.rng.choice(len(x), min(CALIBRATION, len(x)), replace=False)
        needed = []
        for q in asked:
            cosine = x @ x[q]
            cosine[q] = -2
            best = np.argsort(-cosine, kind="stable")[: min(k, len(x) - 1)]
            rank = {n: i for i, n in enumerate(self.order(self.centres @ x[q], len(self.leaves)))}
            needed += [rank[n] + 1 for n in leaf[best]]
        if needed:
            self.visits = max(1, int(np.quantile(needed, recall, method="higher")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def valid(vector: str) -> Column:
    sound = F.expr(f"forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists({vector}, x -> x <> 0)")
    return F.isnotnull(vector) & sound


def search(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """Columns query_id, rank (from 1), vec_id, score; the k nearest of every row that ``queries`` (on column vec_id) picks."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.isnotnull("vec_id") & valid("v"))
    kind = dict(rows.dtypes)["vec_id"]
    empty = spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    widths = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").first()
    if widths is None:
        return empty
    width, n = widths["width"], widths["n"]
    common = F.size("v") == width
    share = min(1.0, min(sample, SAMPLE_VALUES // width + 1) / n)
    drawn = rows.where(common & (F.rand(7) < share)).select("v").toArrow().column("v").combine_chunks()
    tree = Tree(unit(matrix(drawn, width)) if len(drawn) else np.ones((1, width)))
    if len(drawn) > 1:
        tree.calibrate(unit(matrix(drawn, width)), k, recall)
    shared = spark.sparkContext.broadcast(tree)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lens = batch.column(1).value_lengths().to_numpy()
            leaf = -lens.astype(np.int64)
            usual = lens == width
            if usual.any():
                leaf[usual] = shared.value.assign(unit(matrix(batch.column(1).filter(pa.array(usual)), width)))
            yield pa.record_batch([pa.array(leaf), *batch.columns], ["leaf", "vec_id", "v"])

    placed = checkpoint(rows.mapInArrow(assign, f"leaf long, vec_id {kind}, v array<double>"))
    # as many rows as the tree has leaves, and as there are other lengths
    counts = placed.groupBy("leaf").agg(F.count("*").alias("n")).orderBy("leaf").collect()
    bins, parts, at, held = {}, {}, 0, 0
    sizes = np.zeros(len(tree.leaves), np.int64)
    for leaf, size in counts:
        if held and held + size > BIN:
            at, held = at + 1, 0
        bins[leaf], parts[leaf] = at, -(-size // BIN)
        if leaf >= 0:
            sizes[leaf] = size
        held += size
        if parts[leaf] > 1:
            at, held = at + parts[leaf], 0
    where = F.broadcast(spark.createDataFrame([(leaf, bins[leaf], parts[leaf]) for leaf in bins], "leaf long, bin int, parts int"))
    asked = rows.where(queries).groupBy("vec_id").agg(F.min_by("v", F.struct(F.xxhash64("v"), "v")).alias("v"))
    asked = checkpoint(asked)
    blocks = -(-asked.count() // ASKED) or 1
    route = spark.sparkContext.broadcast((bins, parts, sizes))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        bins, parts, sizes = route.value
        for batch in batches:
            rows_, to, leaves = [], [], []
            for i, v in enumerate(batch.column(1)):
                v = np.array(v.as_py())
                visited = tree.order(tree.centres @ unit(v[None])[0], tree.visits, sizes, k + 1) if len(v) == width else [-len(v)]
                by: dict[int, list[int]] = {}
                for leaf in visited:
                    for part in range(parts.get(leaf, 0)):
                        by.setdefault(bins[leaf] + part, []).append(leaf)
                rows_ += [i] * len(by)
                to += by.keys()
                leaves += by.values()
            yield pa.record_batch([pa.array(to, pa.int32()), pa.array(leaves, pa.list_(pa.int64())), *(c.take(pa.array(rows_, pa.int64())) for c in batch.columns)], ["bin", "leaves", "query_id", "v"])

    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    dealt = placed.join(where, "leaf").select((F.col("bin") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int").alias("bin"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "leaf", "vec_id", "v")
    asking = asked.mapInArrow(visit, f"bin int, leaves array<long>, query_id {kind}, v array<double>").withColumn("block", block("query_id"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            leaf, ids = right.column("leaf").to_numpy(), right.column("vec_id").to_numpy()
            order = np.argsort(leaf, kind="stable")
            leaf, ids = leaf[order], ids[order]
            vectors = right.column("v").combine_chunks().take(pa.array(order))
            kinds, starts = np.unique(leaf, return_index=True)
            ends = np.append(starts[1:], len(leaf))
            names, wanted = left.column("query_id").to_numpy(), left.column("leaves").to_pylist()
            groups = {int(x): (int(a), int(b)) for x, a, b in zip(kinds, starts, ends, strict=True)}
            lens = left.column("v").combine_chunks().value_lengths().to_numpy()
            for size in np.unique(lens).tolist():
                own = np.flatnonzero(lens == size)
                of = {x: s for x, s in groups.items() if (x == -size if size != width else x >= 0)}
                if not of:
                    continue
                low, high = min(a for a, _ in of.values()), max(b for _, b in of.values())
                x, here = matrix(vectors.slice(low, high - low), size), ids[low:high]
                nx = unit(x)
                for begin in range(0, len(own), STEP):
                    at = own[begin : begin + STEP]
                    q = matrix(left.column("v").combine_chunks().take(pa.array(at)), size)
                    for i, pick in zip(at, nearest_in(q, x, nx, here, names[at], [[(of[y][0] - low, of[y][1] - low) for y in wanted[j] if y in of] for j in at], k), strict=True):
                        found[0] += [names[i]] * len(pick[0])
                        found[1] += pick[0]
                        found[2] += pick[1]
        return pa.table([pa.array(found[0], left.schema.field("query_id").type), pa.array(found[1], right.schema.field("vec_id").type), pa.array(found[2], pa.float64())], ["query_id", "vec_id", "score"])

    pairs = asking.groupBy("bin", "block").cogroup(dealt.groupBy("bin", "block")).applyInArrow(compare, f"query_id {kind}, vec_id {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_in(q: np.ndarray, x: np.ndarray, nx: np.ndarray, ids: np.ndarray, names: np.ndarray, spans: list[list[tuple[int, int]]], k: int) -> Iterator[tuple[list, list]]:
    """For each query, ids and scores of the k nearest in its spans of x, but for one row with its own id and vector."""
    near = np.full((len(q), len(x)), -np.inf)
    nq = unit(q)
    by: dict[tuple[int, int], list[int]] = {}
    for i, own in enumerate(spans):
        for span in own:
            by.setdefault(span, []).append(i)
    for (a, b), at in by.items():
        near[at, a:b] = nq[at] @ nx[a:b].T
    for i in range(len(q)):
        row = near[i]
        twin = np.flatnonzero((ids == names[i]) & (row > -np.inf))
        twin = twin[(x[twin] == q[i]).all(1)]
        row[twin[:1]] = -np.inf
        at = np.flatnonzero(row > -np.inf)
        if len(at) > k:
            at = at[row[at] >= np.partition(row[at], -k)[-k] - 1e-9]
        score = cosine(q[i], x[at])
        best = np.lexsort((ids[at], -score))[:k]
        yield ids[at[best]].tolist(), score[best].tolist()


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines summed in the same order whatever else is in ``x``, so that equal vectors tie."""
    if not len(x):
        return np.zeros(0)
    a, b = q / np.abs(q).max(), x / np.abs(x).max(1, keepdims=True)
    return np.add.reduce(b * a, axis=1) / (np.sqrt(np.add.reduce(a * a)) * np.sqrt(np.add.reduce(b * b, axis=1)))
