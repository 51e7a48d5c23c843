import random
import re

import numpy as np

from jsonloom.llm import near_dedup as N
from jsonloom.llm.components import components
from jsonloom.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else None)


def brute(docs, similarity=0.8):
    """The smallest doc_id of each document's component."""
    sets, parent = {d: shingle_set(t) for d, t in docs.items()}, {d: d for d in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(d for d in docs if sets[d])
    by = {}
    for d in ids:
        for s in sets[d]:
            by.setdefault(s, []).append(d)
    for a in ids:
        for b in {x for s in sets[a] for x in by[s] if x < a}:
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d in docs}


def edited(rng, words, share):
    return " ".join(rng.choice("qrstuv") + str(rng.randrange(99)) if rng.random() < share else w for w in words)


def test_against_brute_force(spark):
    rng = random.Random(4)
    docs = {}
    for i in range(40):
        words = [rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(rng.randrange(3, 200))]
        for _ in range(rng.randrange(1, 6)):
            docs[len(docs)] = edited(rng, words, rng.choice([0, 0.005, 0.02, 0.05]))
    hot = [f"h{i}" for i in range(120)]
    for _ in range(60):
        docs[len(docs)] = edited(rng, hot, 0.02)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    rows = N.near_duplicates(df).collect()
    assert {r.doc_id: r.component for r in rows} == brute(docs)
    assert all(r.kept == (r.component == r.doc_id) for r in rows)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op4_prob_min_hash"](spark, sf).collect()
    assert {r.doc_id: r.class_id for r in rows} == brute(docs)


def test_registers_estimate_similarity():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), edited(rng, words, 0.03)]
    of, sh, counts = N.shingles(texts)
    sig = N.signatures(of, sh, counts, 2, registers=1024)
    a, b = shingle_set(texts[0]), shingle_set(texts[1])
    assert abs((sig[0] == sig[1]).mean() - len(a & b) / len(a | b)) < 0.06
    again = N.signatures(of, sh, counts, 2, registers=1024)
    assert np.array_equal(sig, again)


def test_odd_rows(spark, odd, none):
    rows = N.near_duplicates(odd, keep=["n", "text"]).collect()
    assert len(rows) == odd.count() and all(r.n == 3 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.component, []).append(r)
    assert sum(r.kept for r in by[1]) == 1 and {r.doc_id for r in by[1]} == {1, 7}
    assert {r.doc_id for r in by[5]} == {5, 6}
    assert all(r.kept and r.n_links == 0 for r in rows if not (r.text or "").strip(" \n\t"))
    assert N.near_duplicates(none).collect() == []


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 101), (103, 101), (50, 60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 103: 100, 50: 50, 60: 50}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_links_are_all_counted(spark, monkeypatch):
    rng = random.Random(8)
    docs = {}
    for n in (70, 14, 4):
        words = [rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(120)]
        for _ in range(n):
            docs[len(docs)] = edited(rng, words, 0.012)
    sets = {d: shingle_set(t) for d, t in docs.items()}
    assert len(set(sets.values())) > 60
    links = {a: len({sets[b] for b in docs if sets[b] != sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9}) for a in docs}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    for block in (1000, 25):
        monkeypatch.setattr(N, "COUNTED", block)
        rows = N.near_duplicates(df).collect()
        # signatures miss hardly any pair
        assert sum(abs(r.n_links - links[r.doc_id]) for r in rows) <= 0.002 * sum(links.values())
        assert all(r.n_links <= links[r.doc_id] for r in rows)


def test_large_bucket_of_strangers_in_blocks(spark, monkeypatch):
    """Texts that meet in one bucket without being alike, in small blocks on both sides."""
    rng = random.Random(3)
    docs = {}
    for i in range(30):
        words = [f"{rng.choice('abcdefgh')}{rng.randrange(40)}" for _ in range(60)]
        for _ in range(5):
            docs[len(docs)] = edited(rng, words, 0.02)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    open_ = spark.createDataFrame([(1, d, d - d % 5) for d in docs], "bucket long, ordinal long, component long")
    monkeypatch.setattr(N, "BLOCK", 11)
    texts = df.withColumnRenamed("doc_id", "ordinal")
    # every document as a component of its own: all links but those inside components are to be joined
    alone = open_.withColumn("component", open_["ordinal"])
    links = {(r.a, r.b) for r in N.remaining(alone, texts, 0.8).collect()}
    parent = {d: d for d in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert {d: find(d) for d in docs} == brute(docs)
    assert N.remaining(open_, texts, 0.8).collect() == []


def test_clashing_and_salted_names(spark):
    """Columns named as results, ids that repeat with other texts, so that components are named by a join."""
    rows = [(i % 7, f"{'same words here in all of them ' * 3}", "k", 5) for i in range(40)] + [(3, "something else altogether that stands alone", "k", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component string, n_links int")
    out = N.near_duplicates(df, keep=["component", "n_links"])
    assert set(out.columns) == {"doc_id", "component", "kept", "n_links", "copies", "component_", "n_links_"}
    got = out.collect()
    assert {r.component_ for r in got} == {"k"} and {r.n_links_ for r in got} == {5} and sum(r.kept for r in got) == 2
