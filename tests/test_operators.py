import pytest
from pyspark.sql import functions as F

from jsonloom import functions as J
from jsonloom import operators as R
from jsonloom import sources as S
from jsonloom import sql, streaming, values
from jsonloom.functions import documents


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", J.parse("t").alias("doc"))


def texts(df, doc="doc"):
    return sorted(r[0] for r in df.select(J.to_string(doc)).collect())


def test_groups_and_sets(spark):
    a, b = docs(spark, '{"a":1}', '{"a":1}', "1", "1.0", "[]"), docs(spark, "1", "[]", "null")
    assert texts(R.distinct_documents(a, "doc")) == ["1", "1.0", "[]", '{"a":1}']
    assert R.distinct_documents(a, "doc", numeric=True).count() == 3
    assert texts(R.union_documents(a, b, "doc")) == ["1", "1.0", "[]", "null", '{"a":1}']
    assert texts(R.intersect_documents(a, b, "doc")) == ["1", "[]"]
    assert texts(R.except_documents(a, b, "doc")) == ["1.0", '{"a":1}']
    counts = R.group_by_document(a, "doc", F.count("*").alias("n")).select(J.to_string("doc"), "n").collect()
    assert {tuple(r) for r in counts} == {('{"a":1}', 2), ("1", 1), ("1.0", 1), ("[]", 1)}


def test_order(spark):
    df = docs(spark, "null", "2", "10", '"a"', "[1]", '{"k":1}', "true", "false")
    assert [r[0] for r in R.order_by_document(df, "doc").select(J.to_string("doc")).collect()] == ["false", "true", "2", "10", '"a"', '{"k":1}', "[1]", "null"]
    assert [r[0] for r in R.order_by_document(df, "doc", ascending=False, limit=2).select(J.to_string("doc")).collect()] == ["null", "[1]"]


def test_joins(spark):
    a = docs(spark, '{"a":1,"b":[1,2]}', '["x","y"]', '{"a":2}', "[1,2]")
    b = docs(spark, '{"a":1}', '["x"]', "[2]", "{}").select(F.col("i").alias("j"), F.col("doc").alias("asked"))
    got = {(r.i, r.j) for r in R.join_on_containment(a, b, "doc", "asked").select("i", "j").collect()}
    assert got == {(0, 0), (1, 1), (3, 2), (0, 3), (2, 3)}
    assert R.join_on_document(a, b, "doc", "asked").count() == 0
    assert R.join_on_document(a, b, "doc", "asked", "left_anti").count() == 4


def test_no_column_is_lost(spark):
    """Columns with the names that operators add for a while come back as they were."""
    a = docs(spark, '{"a":1}', "[7]", "{}", "5").select("*", *(F.lit(n).alias(n) for n in ("document_key", "left_key", "path_key", "mark", "left_marks", "left_row")))
    b = docs(spark, '{"a":1}', "7", "5").select(F.col("doc").alias("asked"), F.lit("r").alias("right_key"), F.lit("o").alias("own_mark"))
    for out in (R.join_on_document(a, b, "doc", "asked"), R.join_on_containment(a, b, "doc", "asked")):
        assert set(out.columns) == {*a.columns, *b.columns}
        assert {(r.left_key, r.mark, r.right_key, r.own_mark) for r in out.collect()} == {("left_key", "mark", "r", "o")}
    assert R.join_on_containment(a, b, "doc", "asked").count() == 3
    assert R.order_by_document(a, "doc").columns == a.columns and R.order_by_document(a, "doc").first()["document_key"] == "document_key"
    keyed = a.withColumn("nation", F.lit("1"))
    assert R.join_on_path(keyed, keyed.select(F.col("nation").alias("other")), "doc", "$.a", "other", "left_semi").columns == keyed.columns


def test_numeric_groups_keep_apart_what_compare_tells_apart(spark):
    df = docs(spark, '["a","b"]', '["a\\u0001\\u0004b"]', "9007199254740992", "9007199254740993", "5", "5.0", "-0.0", "0")
    assert R.distinct_documents(df, "doc", numeric=True).count() == 6


def test_containment_of_any_kind(spark):
    wholes = ["{}", '{"a":1}', "[]", "[5]", "[5.0]", "[[5]]", "[{}]", '["x",[5]]', "5", '"x"', "null", "[null]", "true", '{"a":{"b":1}}']
    a, b = docs(spark, *wholes), docs(spark, *wholes).select(F.col("i").alias("j"), F.col("doc").alias("asked"))
    got = sorted((r.i, r.j) for r in R.join_on_containment(a, b, "doc", "asked").collect())
    vals = [values.parse(t) for t in wholes]
    assert got == sorted((i, j) for i, x in enumerate(vals) for j, y in enumerate(vals) if documents.contains(x, y))


def test_aggregates_and_rows(spark):
    df = docs(spark, "3", None, '{"k":1}')
    row = df.agg(J.to_string(R.json_array_agg("doc", "i")).alias("a"), J.to_string(R.json_object_agg(F.lit("k"), "doc", "i")).alias("o")).first()
    assert tuple(row) == ('[3,null,{"k":1}]', '{"k":{"k":1}}')
    wide = docs(spark, '{"b":[1,2],"a":3}')
    assert [(r.key, r.value) for r in R.explode_members(wide, "doc").select("key", F.to_json("value").alias("value")).collect()] == [("a", "3"), ("b", "[1,2]")]
    assert R.explode_path(wide, "doc", "$.b[*]").count() == 2
    assert [r.pos for r in R.explode_elements(docs(spark, "[5,6]"), "doc").select("pos").collect()] == [0, 1]


def test_files(spark, tmp_path):
    df = docs(spark, '{"b":1.5,"a":null}', "[]")
    S.write_json_lines(df, f"{tmp_path}/lines")
    assert texts(S.read_json_lines(spark, f"{tmp_path}/lines")) == ["[]", '{"a":null,"b":1.5}']
    assert texts(S.read_json_variant(spark, f"{tmp_path}/lines")) == ["[]", '{"a":null,"b":1.5}']
    S.write_wire(df, f"{tmp_path}/wire")
    assert texts(S.read_wire(spark, f"{tmp_path}/wire", tolerant=True)) == ["[]", '{"a":null,"b":1.5}']
    assert texts(S.read_wire(spark, f"{tmp_path}/wire")) == ["[]", '{"a":null,"b":1.5}']
    (tmp_path / "one.json").write_text('{\n"a": 1}')
    assert texts(S.read_json_files(spark, f"{tmp_path}/one.json")) == ['{"a":1}']


def test_sql(spark):
    sql.register(spark)
    row = spark.sql("""SELECT jl_array_length(parse_json('[1,2]')) a, jl_to_string(jl_get_by_name(parse_json('{"x":[1]}'), 'x')) b, jl_path_match(parse_json('{"x":5}'), '$.x > 4') c,
        jl_contains(parse_json('[1,2]'), parse_json('[2]')) d, jl_to_string(jl_get_by_path(parse_json('{"x":[1,2]}'), '$.x[*]')) e, jl_compare(parse_json('1'), parse_json('2')) f, jl_parse_error('[1,]') g""").first()
    assert tuple(row) == (2, "[1]", True, True, "[1,2]", -1, "expected value, pos 4")
    members = spark.sql("""SELECT t.id, e.key, to_json(e.value) v FROM (SELECT 7 id, parse_json('{"b":[1],"a":null}') d) t, LATERAL jl_object_each(t.d) e ORDER BY key""").collect()
    assert [tuple(r) for r in members] == [(7, "a", "null"), (7, "b", "[1]")]
    assert [r.pos for r in spark.sql("SELECT * FROM jl_array_each(parse_json('[5,6]'))").collect()] == [0, 1]


SQL_CASES = {
    "jl_to_string(jl_concat(parse_json('{\"p\":6}'), parse_json('{\"p\":7,\"q\":[]}')))": '{"p":7,"q":[]}', "jl_to_string(jl_delete_by_name(parse_json('{\"p\":6,\"q\":7}'), 'p'))": '{"q":7}', "jl_to_string(jl_delete_by_index(parse_json('[6,7,8]'), -1))": "[6,7]",
    "jl_to_string(jl_array_insert(parse_json('[6,7]'), -1, parse_json('5')))": "[6,5,7]", "jl_to_string(jl_object_insert(parse_json('{\"p\":6}'), 'p', parse_json('7'), true))": '{"p":7}', "jl_to_string(jl_object_pick(parse_json('{\"p\":6,\"q\":7}'), array('q')))": '{"q":7}',
    "jl_to_string(jl_object_delete(parse_json('{\"p\":6,\"q\":7}'), array('q')))": '{"p":6}', "jl_exists_all_keys(parse_json('[\"p\",6]'), array('p'))": True, "jl_exists_any_keys(parse_json('{\"p\":6}'), array('x'))": False, "jl_as_i64(parse_json('6.0'))": None, "jl_to_i64(parse_json('\"67\"'))": 67,
    "CAST(jl_as_u64(parse_json('18446744073709551615')) AS STRING)": "18446744073709551615", "jl_try_to_bool(parse_json('\"TRUE\"'))": True, "jl_to_f64(parse_json('\"2.5\"'))": 2.5, "jl_to_str(parse_json('6.0'))": "6.0", "jl_try_to_str(parse_json('[]'))": None, "jl_is_object(parse_json('{}'))": True, "jl_is_null(parse_json('6'))": False,
    "jl_to_string(jl_get_by_keypath(parse_json('{\"p\":[6,null]}'), '{p,1}'))": "null", "jl_to_string(jl_get_by_path_first(parse_json('[6,7]'), '$[*]'))": "6", "jl_to_string(jl_get_by_path_array(parse_json('[6,7]'), '$[5]'))": "[]", "jl_to_string(jl_strip_nulls(parse_json('{\"p\":null}')))": "{}",
    "jl_to_string(jl_get_by_name_ignore_case(parse_json('{\"Pq\":6}'), 'pQ'))": "6", "jl_to_string(jl_build_object(array('p'), array(parse_json('6'))))": '{"p":6}', "jl_to_string(jl_build_array(array(parse_json('6'))))": "[6]", "jl_to_string(jl_decode(jl_encode(parse_json('[6,{}]'))))": "[6,{}]",
    "jl_to_string(jl_try_decode(X'80'))": None, "jl_to_string(jl_delete_by_keypath(parse_json('{\"p\":{\"q\":6}}'), '{p,q}'))": '{"p":{}}', "jl_path_text('$.a  [*]')": "$.a[*]", "jl_traverse_check_string(parse_json('[[\"p\"]]'), 'p')": True, "jl_to_string(jl_array_except(parse_json('[6,6]'), parse_json('6')))": "[6]",
    "jl_type_of(jl_parse_lenient('{ \\\\n \"p\": 6}'))": "object", "jl_same_kind(parse_json('6'), parse_json('6.5'))": True, "jl_order_key(parse_json('6')) = jl_order_key(parse_json('6.0'))": True, "jl_to_json(parse_json('{\"q\":6}'))": '{"q":6}',
}


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql(f"SELECT {', '.join(f'{e} c{i}' for i, e in enumerate(SQL_CASES))}").first()
    assert dict(zip(SQL_CASES, row, strict=True)) == SQL_CASES
    for wrong, what in (("jl_to_i64(parse_json('2.5'))", "InvalidCast"), ("jl_object_pick(parse_json('6'), array('p'))", "InvalidObject"), ("jl_delete_by_index(parse_json('6'), 0)", "InvalidJsonType")):
        with pytest.raises(Exception, match=what):
            spark.sql(f"SELECT {wrong}").collect()


@pytest.mark.parametrize("kind", ["counts", "distinct"])
def test_streaming(spark, tmp_path, kind):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(source.schema).parquet(f"{tmp_path}/in").withColumn("doc", J.parse("props"))
    out = streaming.windowed_counts(stream, "ts", "doc", "$.k", late="3650 days") if kind == "counts" else streaming.distinct_documents(stream, "ts", "doc", late="3650 days").select("doc")
    if kind == "distinct":
        out = out.select(J.to_string("doc").alias("t"))
    q = out.writeStream.format("memory").queryName(f"out_{kind}").outputMode("complete" if kind == "counts" else "append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table(f"out_{kind}")
    if kind == "counts":
        assert got.agg(F.sum("n")).first()[0] == source.count()
    else:
        assert got.count() == got.distinct().count() == source.select("props").distinct().count()
