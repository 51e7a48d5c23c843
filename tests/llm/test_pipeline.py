from pyspark.sql import functions as F

import corpus_pipeline as C
from jsonloom.llm import packing

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark, tmp_path):
    docs, sizes = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for name, stage in C.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        sizes.append(docs.count())
        if name != C.STAGES[-1][0]:
            assert docs.columns == columns
    assert sizes[0] == 200 and sizes[1] < sizes[0]
    last = spark.read.parquet(f"{tmp_path}/benchmarks")
    ids = packing.encode([r.text for r in last.collect()], packing_path(), 2)
    assert docs.agg({"length": "sum"}).first()[0] == sum(len(x) // 4 for x in ids)
    got = C.run(spark, SF)
    digest = lambda df: sorted(tuple(r) for r in df.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect())
    assert digest(got) == digest(docs)


def packing_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_planted_cases(spark, tmp_path):
    """Copies, near copies, repeated passages and benchmark items go; clean documents stay as they are."""
    words = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    passage = words("shared", 60)
    texts = {1: words("clean", 50), 2: words("base", 100), 3: words("base", 100), 4: words("base", 100) + " tail", 5: f"{words('five', 40)} {passage} one", 6: f"{words('six', 40)} {passage} two", 7: f"{words('lead', 30)} {item} {words('out', 30)}", 8: "123 !", 9: words("fine  text\n", 40)}
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in texts.items()] + [(10, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in C.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert kept == {1: texts[1], 2: texts[2], 5: texts[5], 6: f"{words('six', 40)} two", 9: texts[9]}


def test_empty(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, stage in C.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() == 0


def test_stages_on_odd_rows(spark, odd, none, tmp_path):
    """Nulls, repeated rows, equal ids with other texts, very long texts and clashing columns pass through every stage."""
    clash = odd.withColumnsRenamed({"length": "n_words", "score": "lang_pred", "ordinal": "kept", "n": "component"}).withColumn("n_chars", F.col("n_words").cast("long"))
    for start, name in ((clash, "odd"), (clash.where("false"), "none")):
        docs = start
        for stage_name, stage in C.STAGES:
            stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}/{stage_name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}/{stage_name}")
            if stage_name != C.STAGES[-1][0]:
                assert docs.columns == C.COLUMNS
        if name == "none":
            assert docs.count() == 0
    read = lambda s: spark.read.parquet(f"{tmp_path}/odd/{s}").collect()
    assert sum(r.doc_id == 7 for r in read("language")) == 3 and sum(r.doc_id is None for r in read("language")) == 1
    # of the equal texts of 1 and 7 one stays, and 7's other text with it; of the long texts one; of 8, 9 and the null id, which share all but two words, the null id
    kept = sorted((r.doc_id or 0) for r in read("near_duplicates"))
    assert kept == [0, 1, 5, 7, 10, 11, 12]
    assert len(read("benchmarks")) == len(read("substrings"))


def test_a_stage_clears_only_what_the_stage_before_stored(spark):
    from jsonloom.llm import near_dedup

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    other = near_dedup.near_duplicates(docs)  # a result that nobody has executed yet
    C.known_language(spark, docs, SF)
    C.one_of_each_group(spark, docs, SF)
    C.without_benchmarks(spark, docs, SF)
    assert other.count() == 200
