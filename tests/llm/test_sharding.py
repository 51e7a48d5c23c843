import zlib

from jsonloom.llm.queries import QUERIES
from jsonloom.llm.sharding import shard


def check(rows, shards):
    slots, sizes = {}, {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] = sizes.get(r.shard, 0) + r["size"]
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op6_sampled_splitters"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all((r["size"], r.text_crc32) == (len(docs[r.doc_id].encode()) + 16, zlib.crc32(docs[r.doc_id].encode())) for r in rows)
    sizes = check(rows, 40)
    mean, most = sum(sizes.values()) / 40, max(r["size"] for r in rows)
    assert len(sizes) == 40 and max(sizes.values()) <= mean + most and min(sizes.values()) >= mean - most


def test_hot_group_is_subdivided(spark):
    rows = [(i, "hot text " * 20 if i % 3 == 0 else f"text {i} " * 20) for i in range(3000)]
    got = shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=10).collect()
    sizes = check(got, 10)
    assert max(sizes.values()) < 1.1 * sum(sizes.values()) / 10
    groups = {}
    for r in got:
        groups.setdefault(r.text_crc32, set()).add(r.shard)
    assert max(map(len, groups.values())) >= 3


def test_equal_texts_stay_together(spark):
    rows = [(i, f"text {i // 3} " * 20) for i in range(3000)]
    got = shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=4).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(g) == 1 for g in groups.values())


def test_odd_rows(spark, odd, none):
    rows = shard(odd, shards=3).collect()
    assert len(rows) == odd.count()
    check(rows, 3)
    assert sorted(r["size"] for r in rows) == sorted(len((r.text or "").encode()) + 16 for r in odd.collect())
    assert shard(none).collect() == []


def test_shards_do_not_depend_on_the_layout(spark):
    rows = [(i, "hot text " * 20 if i % 3 == 0 else f"text {i // 2} " * (1 + i % 30)) for i in range(3000)] + [(7, "again and again")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string")
    digest = lambda d: sorted((r.doc_id, r["size"], r.text_crc32, r.shard) for r in shard(d, shards=10).collect())
    assert digest(df.repartition(3)) == digest(df.repartition(7).orderBy("text"))
