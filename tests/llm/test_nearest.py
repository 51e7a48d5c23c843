import numpy as np
from pyspark.sql import functions as F

from jsonloom.llm.nearest import Tree, search, unit
from jsonloom.llm.queries import QUERIES


def brute(ids, x, asked, k):
    n = unit(np.asarray(x, float))
    out = {}
    for q in asked:
        score = n @ n[ids.index(q)]
        order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-round(score[i], 12), ids[i]))
        out[q] = [ids[i] for i in order[:k]]
    return out


def recall(rows, expected):
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.vec_id)
    return sum(len(set(got[q]) & set(e)) for q, e in expected.items()) / sum(map(len, expected.values()))


def test_query_recall(spark):
    sf = "/root/testdata/sf0.01"
    v = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = [r.vec_id for r in v], [r.embedding for r in v]
    rows = QUERIES["op5_kmeans_tree_search"](spark, sf).collect()
    assert len(rows) == 5 * sum(i % 50 == 0 for i in ids)
    assert recall(rows, brute(ids, x, [i for i in ids if i % 50 == 0], 5)) >= 0.9
    for r in rows:
        a, b = np.asarray(x[ids.index(r.query_id)], float), np.asarray(x[ids.index(r.vec_id)], float)
        assert abs(r.score - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12


def test_clusters_and_a_hot_vector(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    x = [(centres[i % 20] + 0.3 * rng.normal(size=16)).tolist() for i in range(1500)] + [centres[0].tolist()] * 800
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(6)
    rows = search(df, F.col("vec_id") % 100 == 0, k=3, sample=600).collect()
    x32 = np.asarray(x, np.float32).astype(float)
    expected = brute(list(range(len(x))), x32, range(0, len(x), 100), 3)
    assert recall(rows, expected) >= 0.95
    hot = [r.vec_id for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == 2000]
    assert hot == [1500, 1501, 1502]


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.1], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [float("nan"), 1.0], 1), (5, [1.0, None], 1), (6, [float("inf"), 1.0], 1), (7, [1e300, 1e300], 1), (7, [1e300, 1e300], 1), (None, [1.0, 1.0], 1), (8, [1.0], 1), (50, [2.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = [(r.query_id, r["rank"], r.vec_id) for r in search(df, F.col("vec_id") % 50 == 0, k=5).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 50), (0, 2, 1), (0, 3, 7), (0, 4, 7), (50, 1, 0), (50, 2, 1), (50, 3, 7), (50, 4, 7)]
    assert search(df.where("false"), F.col("vec_id") % 50 == 0).collect() == []
    assert search(df.where("vec_id = 0"), F.col("vec_id") % 50 == 0).collect() == []


def test_tree_visits_every_leaf():
    x = unit(np.random.default_rng(1).normal(size=(3000, 8)))
    tree = Tree(x)
    assert sorted(tree.order(tree.centres @ x[0], 10**9)) == list(range(len(tree.leaves)))
    assert tree.order(tree.centres @ x[0], 1)[0] in range(len(tree.leaves))


def test_few_vectors_are_compared_where_they_form_groups():
    """On vectors with groups, a small share of all is visited at the recall that is asked for."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(300, 24))
    x = unit(centres[rng.integers(300, size=20_000)] + 0.25 * rng.normal(size=(20_000, 24)))
    tree = Tree(x[:6000])
    tree.calibrate(x[:6000], 5, 0.95)
    leaf = tree.assign(x)
    sizes = np.bincount(leaf, minlength=len(tree.leaves))
    share, hits = [], []
    for q in range(0, 20_000, 200):
        visited = tree.order(tree.centres @ x[q], tree.visits, sizes, 6)
        near = x @ x[q]
        near[q] = -2
        hits.append(np.isin(leaf[np.argsort(-near)[:5]], visited).mean())
        share.append(sizes[visited].sum() / len(x))
    assert np.mean(share) < 0.1 and np.mean(hits) >= 0.9


def test_visits_go_on_until_there_are_k(spark):
    """A lone query among tight groups of copies gets k rows, though its own leaves are nearly empty."""
    rng = np.random.default_rng(2)
    rows = [v.tolist() for v in rng.normal(size=(60, 6)) for _ in range(20)] + [rng.normal(size=6).tolist()]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = search(df, F.col("vec_id") == 1200, k=25).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 26))


def test_bins_blocks_and_lengths(spark, monkeypatch):
    """Small bins and blocks, a leaf in many bins, and two lengths of vectors: the same as all against all."""
    from jsonloom.llm import nearest as N

    for name, value in (("BIN", 40), ("ASKED", 7), ("STEP", 3)):
        monkeypatch.setattr(N, name, value)
    rng = np.random.default_rng(4)
    x = [rng.normal(size=5).tolist() for _ in range(300)] + [[1.0, 2.0, 3.0, 4.0, 5.0]] * 150 + [rng.normal(size=3).tolist() for _ in range(90)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    got = {}
    for r in search(df, F.col("vec_id") % 9 == 0, k=4, recall=1.0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    for size, low, high in ((5, 0, 450), (3, 450, 540)):
        ids = list(range(low, high))
        for q, best in brute(ids, x[low:high], [i for i in ids if i % 9 == 0], 4).items():
            found = [got[q][k] for k in sorted(got[q])]
            assert len(found) == 4 and len(set(found) & set(best)) >= (4 if size == 3 else 3), (q, found, best)


def test_repeated_ids(spark):
    """A repeated id is asked once; only one row with its id and vector is left out."""
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.6, 0.8]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in search(df, F.col("vec_id") == 0, k=5).orderBy("rank").collect()]
    assert len(got) == 3 and [v for _, _, v in got].count(0) == 2
