"""Near-duplicate documents by ProbMinHash.

Shingles are five consecutive words ``[^\\x20\\x09-\\x0D]+``; a text with fewer
words has one shingle of all of them. A shingle weighs 1 + ln(its count). Its
weight is the rate of a Poisson process whose arrivals fall on random registers
of the signature, and each register keeps the shingle that arrived first; two
texts agree in a register with the probability Jaccard similarity. A text's
arrivals end early, at a horizon by which its registers are most likely full; if
one isn't, the horizon is doubled.

Texts with equal sets of shingles form a class, and one of them stands for it.
BANDS bands of ROWS registers put these into buckets. All pairs of a small bucket
are candidates. In a large one, texts are compared with a centre; what is then
outside its largest component is compared with all of it, a block of the one
with a block of the other at a time. Candidates are linked if the Jaccard
similarity of their sets of shingles, computed exactly, is at least ``similarity``; linked classes form components.
``n_links`` counts the links of all pairs that share a bucket: those in a large
bucket are counted in blocks, each pair in the first bucket that it shares.

Null and empty texts have no shingle: each stands alone. Rows with equal doc_id
and text count as one document and get the same answer. Very long texts are
signed whole, one at a time. An empty table gives no rows. A kept column whose
name the result has too comes back with a line below after its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Work, kept_apart, mix, row_order, slices, small_batches
from .components import components
from .windows import Words, window_hashes

BANDS, ROWS, WORDS = 20, 4, 5
REGISTERS = BANDS * ROWS
#: Buckets of up to so many classes are compared in full; larger ones with a centre first, and then in blocks of so many.
SMALL, BLOCK = 8, 500
#: Classes in a block of those whose links are counted.
COUNTED = 1000
#: Shares of the rows of a component in a join on it.
SHARES = 32
GOLD = np.uint64(0x9E3779B97F4A7C15)


def salt(k: int) -> np.uint64:
    return np.uint64(k * int(GOLD) % (1 << 64))


def shingles(texts: list[str | None], n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, ordered by text and hash: number of the text, hash, count."""
    words = Words(texts)
    hashes = words.hashes()
    full = words.inside(n)
    sh, of = window_hashes(hashes, n)[full], words.of[full]
    size = np.diff(words.first)
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        whole = np.array([mix(np.bitwise_xor.reduce(mix(hashes[words.first[i] : words.first[i + 1]] + np.arange(1, size[i] + 1, dtype=np.uint64) * GOLD), keepdims=True))[0] for i in short], np.uint64)
        sh, of = np.append(sh, whole), np.append(of, short)
    order = np.lexsort((sh, of))
    sh, of = sh[order], of[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    return of[at], sh[at], np.diff(np.append(at, len(sh)))


def signatures(of: np.ndarray, sh: np.ndarray, counts: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """The shingle that arrived first at each register, by text; texts without shingles have zeros."""
    weight = 1.0 + np.log(counts)
    total = np.bincount(of, weight, n)
    first = np.full(n * registers, np.inf)
    out = np.zeros(n * registers, np.uint64)
    horizon = (np.log(registers) + 4.0) * registers / np.maximum(total, 1e-300)
    todo = total > 0
    while todo.any():
        live = np.flatnonzero(todo[of])
        h, w, text = sh[live], weight[live], of[live]
        time, arrival = np.zeros(len(h)), 0
        while len(h):
            arrival += 1
            r = mix(h + salt(arrival))
            time = time - np.log1p(-(r >> np.uint64(11)).astype(float) * 2.0**-53) / w
            keep = time < horizon[text]
            h, w, text, time = h[keep], w[keep], text[keep], time[keep]
            place = text * registers + (mix(r[keep] + GOLD) % np.uint64(registers)).astype(np.int64)
            np.minimum.at(first, place, time)
            won = time == first[place]
            out[place[won]] = h[won]
        empty = np.isinf(first).reshape(n, registers).any(1)
        todo &= empty
        horizon *= 2
    return out.reshape(n, registers)


def sign(docs: DataFrame) -> DataFrame:
    """ordinal; set_a, set_b: two hashes of the set of shingles; bands: a key for each band. Without shingles: no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n = batch.num_rows
            of, sh, counts = shingles(batch.column(1).to_pylist())
            some = np.bincount(of, minlength=n) > 0
            sums = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
            for i in (0, 1):
                np.add.at(sums[i], of, mix(sh + salt(2 * i + 1)))
            sig = signatures(of, sh, counts, n).reshape(n, BANDS, ROWS)
            key = np.arange(1, BANDS + 1, dtype=np.uint64) * GOLD + np.zeros((n, 1), np.uint64)
            for j in range(ROWS):
                key = mix(key * np.uint64(3) + sig[:, :, j])
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, some.sum() * BANDS + 1, BANDS, dtype=np.int32)), pa.array(key[some].view(np.int64).ravel()))
            yield pa.record_batch([batch.column(0).filter(pa.array(some)), *(pa.array(s[some].view(np.int64)) for s in sums), bands], ["ordinal", "set_a", "set_b", "bands"])

    return docs.select("ordinal", "text").where("text IS NOT NULL").mapInArrow(run, "ordinal long, set_a long, set_b long, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have at least that Jaccard similarity."""
    left = texts.select(F.col("ordinal").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("ordinal").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_a", 256 << 10):
            n = batch.num_rows
            of_a, a, _ = shingles(batch.column(2).to_pylist())
            of_b, b, _ = shingles(batch.column(3).to_pylist())
            of, sh = np.append(of_a, of_b), np.append(a, b)
            order = np.lexsort((sh, of))
            of, sh = of[order], sh[order]
            common = np.bincount(of[1:][(sh[1:] == sh[:-1]) & (of[1:] == of[:-1])], minlength=n)
            good = common >= similarity * (np.bincount(of, minlength=n) - common) - 1e-9
            mask = pa.array(good)
            yield pa.record_batch([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def link(docs: DataFrame, similarity: float, work: Work, count_links: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """Classes (ordinal, member_of: the class's smallest ordinal), links that make the components (a > b), components of these, n_links by ordinal."""
    signed = work.store(sign(docs))
    lead = signed.groupBy("set_a", "set_b").agg(F.min("ordinal").alias("member_of"))
    classes = work.store(signed.join(lead, ["set_a", "set_b"]).select("ordinal", "member_of"))
    heads = classes.where("ordinal = member_of").select("ordinal")
    keys = signed.join(heads, "ordinal", "left_semi").select("ordinal", F.posexplode("bands").alias("band", "bucket"))
    sizes = keys.groupBy("bucket").agg(F.count("*").alias("n"), F.min("ordinal").alias("centre")).where("n > 1")
    members = work.store(keys.join(sizes, "bucket"))
    work.drop(signed)
    involved = members.select("ordinal").distinct()
    texts = work.store(docs.select("ordinal", "text").join(involved, "ordinal", "left_semi").dropDuplicates(["ordinal"]))
    star = members.select(F.col("ordinal").alias("a"), F.col("centre").alias("b"))
    small = members.where(F.col("n") <= SMALL)
    other = small.select("bucket", F.col("ordinal").alias("b"))
    within = small.select("bucket", F.col("ordinal").alias("a")).join(other, "bucket").select("a", "b")
    pairs = star.unionByName(within).where("a > b").distinct()
    links = work.store(verified(pairs, texts, similarity))
    large = members.where(F.col("n") > SMALL).select("bucket", "ordinal")
    counts = None
    if count_links:
        near = links.join(within.where("a > b").distinct(), ["a", "b"], "left_semi")
        counts = near.select("a").unionByName(near.select(F.col("b").alias("a"))).groupBy("a").agg(F.count("*").alias("n_links"))
        counts = work.store(counts.unionByName(counted(members, texts, similarity)).groupBy("a").agg(F.sum("n_links").alias("n_links")))
    own = components(links, work)
    if not large.isEmpty():
        open_ = work.store(unsettled(large, own))
        found = work.store(remaining(open_, texts, similarity))
        work.drop(open_)
        if not found.isEmpty():
            links, before = work.store(links.unionByName(found).distinct()), links
            own = components(links, work)
            work.drop(before)
        work.drop(found)
    work.drop(members, texts)
    return classes, links, own, counts


def counted(members: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """a and n_links: links in large buckets, without those of pairs that share a small bucket, each in the first large one by band.

    The pairs of a bucket are compared by two blocks at a time, and only sums
    come back, so rows are no more than members times blocks.
    """
    shared = members.groupBy("ordinal").agg(F.map_from_entries(F.collect_list(F.struct("band", F.struct("bucket", (F.col("n") <= SMALL).alias("small"))))).alias("of"))
    slots = F.sequence(F.lit(0), F.lit(BANDS - 1))
    shared = shared.select("ordinal", F.transform(slots, lambda j: F.coalesce(F.col("of")[j]["bucket"], F.lit(0))).alias("keys"), F.transform(slots, lambda j: F.when(F.isnull(F.col("of")[j]), 0).when(F.col("of")[j]["small"], 2).otherwise(1)).alias("kinds"))
    blocks = F.ceil(F.col("n") / F.lit(COUNTED)).cast("int")
    placed = members.where(F.col("n") > SMALL).select("bucket", "band", "ordinal", F.pmod(F.xxhash64("ordinal"), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    placed = placed.select("bucket", "band", "ordinal", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    rows = placed.join(shared, "ordinal").join(texts, "ordinal")

    def count(group: pa.Table) -> pa.Table:
        n, band = group.num_rows, group.column("band")[0].as_py()
        ids, block = group.column("ordinal").to_numpy(), group.column("block").to_numpy()
        keys, kinds = (np.array(group.column(c).to_pylist()).reshape(n, BANDS) for c in ("keys", "kinds"))
        # pairs that agree here are counted elsewhere
        before = (kinds == 2) | ((kinds == 1) & (np.arange(BANDS) < band))
        of, sh, _ = shingles(group.column("text").to_pylist())
        _, sh = np.unique(sh, return_inverse=True)
        size = np.bincount(of, minlength=n)
        first = np.cumsum(size) - size
        apart = group.column("low")[0].as_py() != group.column("high")[0].as_py()
        links, mine = np.zeros(n, np.int64), np.zeros(int(sh.max()) + 1, bool)
        for i in range(n):
            others = np.flatnonzero(block > block[i]) if apart else np.arange(i + 1, n)
            for j in np.flatnonzero(before[i]):
                others = others[keys[others, j] != keys[i, j]]
            if not len(others):
                continue
            own = sh[first[i] : first[i] + size[i]]
            mine[own] = True
            lens = size[others]
            ends = np.cumsum(lens)
            hits = mine[sh[np.repeat(first[others] - (ends - lens), lens) + np.arange(ends[-1])]]
            common = np.add.reduceat(hits, ends - lens, dtype=np.int64)
            mine[own] = False
            good = others[common >= similarity * (lens + size[i] - common) - 1e-9]
            links[i] += len(good)
            links[good] += 1
        some = links > 0
        return pa.table([pa.array(ids[some]), pa.array(links[some])], ["a", "n_links"])

    return rows.groupBy("bucket", "low", "high").applyInArrow(count, "a long, n_links long")


def unsettled(large: DataFrame, own: DataFrame) -> DataFrame:
    """bucket, ordinal and component of the members of buckets that have not come together."""
    of = large.join(own, large["ordinal"] == own["node"], "left").select("bucket", "ordinal", F.coalesce("component", "ordinal").alias("component"))
    apart = of.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return of.join(apart.select("bucket"), "bucket")


def remaining(open_: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links between different components of a bucket: those that join each member outside its largest component.

    Both such members and all of them fall into blocks, and each block of the
    ones meets each of the others, so a task holds two blocks of texts whatever
    the bucket. There, texts are compared through an index of shingles, and of
    the links of a member to a component one comes back.
    """
    sizes = open_.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    most = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("of"), F.max("n").alias("most"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    most = most.select("bucket", "main", blocks(F.col("of")).alias("blocks"), blocks(F.col("of") - F.col("most")).alias("asking"))
    known = open_.join(most, "bucket").join(texts, "ordinal")
    place = lambda n: F.pmod(F.xxhash64("ordinal"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    inside = known.select("bucket", place(F.col("blocks")).alias("block"), each(F.col("asking")).alias("by"), "ordinal", "component", "text")
    outside = known.where("component <> main").select(F.col("bucket").alias("of_bucket"), each(F.col("blocks")).alias("of_block"), place(F.col("asking")).alias("of_by"), F.col("ordinal").alias("asked"), F.col("component").alias("kind"), F.col("text").alias("asked_text"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        if left.num_rows and right.num_rows:
            ids, kinds = right.column("ordinal").to_numpy(), right.column("component").to_numpy()
            of, sh, _ = shingles(right.column("text").to_pylist())
            size, order = np.bincount(of, minlength=len(ids)), np.argsort(sh, kind="stable")
            sh, of = sh[order], of[order]
            asked, own, _ = shingles(left.column("asked_text").to_pylist())
            ends = np.searchsorted(asked, np.arange(left.num_rows + 1))
            for i, (me, kind) in enumerate(zip(left.column("asked").to_pylist(), left.column("kind").to_pylist(), strict=True)):
                mine = own[ends[i] : ends[i + 1]]
                low, high = np.searchsorted(sh, mine, "left"), np.searchsorted(sh, mine, "right")
                n = high - low
                hits = np.repeat(low - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
                common = np.bincount(of[hits], minlength=len(ids))
                good = np.flatnonzero((common >= similarity * (size + len(mine) - common) - 1e-9) & (kinds != kind))
                for other in good[np.unique(kinds[good], return_index=True)[1]]:
                    found.append((max(me, ids[other]), min(me, ids[other])))
        return pa.table([pa.array([int(x[k]) for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return outside.groupBy("of_bucket", "of_block", "of_by").cogroup(inside.groupBy("bucket", "block", "by")).applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, count_links: bool = True, work: Work | None = None) -> DataFrame:
    """Columns: doc_id, those in ``keep``, component (the smallest doc_id in it), kept (the first row of its component), n_links (of its class to others; without ``count_links``, among those that make the components), copies (documents in its class)."""
    small_batches(docs.sparkSession)
    work = work or Work(docs.sparkSession)
    extra = [c for c in keep or [] if c != id_col]
    carried = [f"keep_{i}" for i in range(len(extra))]
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(k) for c, k in zip(extra, carried, strict=True)))
    base = row_order(base)
    classes, links, own, degree = link(base, similarity, work, count_links)
    degree = degree if degree is not None else links.select("a").unionByName(links.select(F.col("b").alias("a"))).groupBy("a").agg(F.count("*").alias("n_links"))
    copies = classes.groupBy(F.col("member_of").alias("head")).agg(F.count("*").alias("copies"))
    found = classes.join(copies, F.col("member_of") == F.col("head")).join(degree, F.col("member_of") == F.col("a"), "left").join(own, F.col("member_of") == F.col("node"), "left")
    found = found.select(F.col("ordinal").alias("own"), F.coalesce("component", "member_of").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "copies").dropDuplicates(["own"])
    if "text_key" not in base.columns:  # ordinals are the ids themselves
        found = found.withColumn("first_id", F.col("component").cast(dict(base.dtypes)["doc_id"]))
    else:  # a component may have very many rows, so its name goes to all shares of them
        names = base.select("ordinal", F.col("doc_id").alias("first_id")).join(found.select("component").distinct(), F.col("ordinal") == F.col("component"), "left_semi").dropDuplicates(["ordinal"])
        names = names.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
        salted = found.withColumn("own_share", F.pmod(F.xxhash64("own"), F.lit(SHARES)).cast("int"))
        found = salted.join(names, (F.col("component") == F.col("ordinal")) & (F.col("own_share") == F.col("share"))).drop("ordinal", "share", "own_share")
    out = base.join(found, F.col("ordinal") == F.col("own"), "left")
    # of equal rows one stays; where ids are unique there are none
    first_row = F.lit(True) if "text_key" not in base.columns else F.row_number().over(Window.partitionBy("ordinal").orderBy("text_key")) == 1
    out = out.select(
        "doc_id", *carried, F.when(F.isnull("own"), F.col("doc_id")).otherwise(F.col("first_id")).alias("component"),
        (F.coalesce(F.col("component") == F.col("ordinal"), F.lit(True)) & first_row).alias("kept"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
    )
    return out.withColumnsRenamed(dict(zip(carried, kept_apart(extra, ["doc_id", "component", "kept", "n_links", "copies"]), strict=True)))
