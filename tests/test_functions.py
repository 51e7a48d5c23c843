import pytest
from pyspark.sql import functions as F

from jsonloom import functions as J
from jsonloom import values
from jsonloom.functions import documents
from jsonloom.values import render


def run(spark, f, *docs):
    df = spark.createDataFrame([tuple(docs)], ", ".join(f"c{i} string" for i in range(len(docs))))
    out = df.select(f(*(J.parse(f"c{i}") for i in range(len(docs)))).alias("r")).first()["r"]
    return render(J.from_variant(out)) if type(out).__name__ == "VariantVal" else out


SHIP = '{"name":"Vega","hold":{"cargo":null,"crates":[7,null]},"berth":40}'
EMPTY = lambda text: F.parse_json(F.lit(text))
CASES = [
    (lambda v: J.get_by_index(v, 1), ["[7,8]"], "8"), (lambda v: J.get_by_index(v, 2), ["[7,8]"], None), (lambda v: J.get_by_index(v, 0), ['{"x":7}'], None),
    (lambda v: J.get_by_name(v, "xy", ignore_case=True), ['{"Xy":7,"xY":8,"xy":9}'], "9"), (lambda v: J.get_by_name(v, "XY", ignore_case=True), ['{"xY":8,"Xy":7,"xy":9}'], "7"), (lambda v: J.get_by_name(v, "w\"'"), ['{"w\\"\'":5}'], "5"),
    (lambda v: J.get_by_keypath(v, "{hold,crates,-2}"), [SHIP], "7"), (lambda v: J.get_by_keypath(v, "{}"), ["[7]"], "[7]"), (lambda v: J.get_by_keypath(v, "{hold,cargo}"), [SHIP], "null"), (lambda v: J.get_by_keypath(v, "{hold,0}"), [SHIP], None),
    (lambda v: J.get_by_keypath(v, F.lit("{hold,crates,0}")), [SHIP], "7"), (lambda v: J.get_by_keypath(v, F.lit("{hold,cargo}")), [SHIP], "null"), (lambda v: J.get_by_path(v, F.lit("$.hold.crates[*]")), [SHIP], "[7,null]"), (lambda v: J.get_by_path_array(v, "$.sail"), [SHIP], "[]"),
    (J.object_keys, [SHIP], ["berth", "hold", "name"]), (J.object_keys, ["[7]"], None), (J.array_length, ["[7,8,9]"], 3), (J.array_length, [SHIP], None),
    (J.contains, ['[4,[4,6],"y"]', '"y"'], True), (J.contains, ["[4,[4,6]]", "[[4]]"], True), (J.contains, ["[[4,6]]", "[4,6]"], False), (J.contains, ['[{"x":4}]', '{"x":4}'], False), (J.contains, [SHIP, '{"hold":{"crates":[7]}}'], True),
    (J.contains, ["[4]", "[4.0]"], False), (J.contains, ["[4,6]", "[6,6,4]"], True),
    (lambda v: J.exists_all_keys(v, ["name", "berth"]), [SHIP], True), (lambda v: J.exists_all_keys(v, ["x"]), ['["x",4]'], True), (lambda v: J.exists_all_keys(v, []), ["5"], True), (lambda v: J.exists_all_keys(v, ["x"]), ['"x"'], False), (lambda v: J.exists_all_keys(v, []), [None], None),
    (lambda v: J.exists_any_keys(v, ["z", "berth"]), [SHIP], True), (lambda v: J.exists_any_keys(v, ["x"]), ['"x"'], False), (lambda v: J.exists_any_keys(v, []), ["[]"], False),
    (lambda v: J.traverse_check_string(v, lambda s: s == "crates"), [SHIP], True), (lambda v: J.traverse_check_string(v, lambda s: s == "Ve"), [SHIP], False),
    (J.type_of, ["null"], "null"), (J.type_of, ["2.5"], "number"), (J.type_of, ["[]"], "array"), (J.type_of, ["{}"], "object"), (J.type_of, ['"w"'], "string"), (J.type_of, ["false"], "boolean"),
    (J.as_i64, ["6"], 6), (J.as_i64, ["6.0"], None), (J.as_i64, ["18446744073709551615"], None), (J.as_u64, ["18446744073709551615"], 2**64 - 1), (J.as_u64, ["-6"], None), (J.as_u64, ["6.0"], None), (J.as_f64, ["6"], 6.0), (J.as_bool, ["6"], None), (J.as_str, ['"w\\"x"'], 'w"x'),
    (J.as_null, ["null"], True), (J.as_null, ["6"], None), (J.as_number, ['"6"'], None), (J.as_number, ["6"], "6"), (J.is_i64, ["6.0"], False), (J.is_u64, ["6"], True), (J.is_u64, ["6.0"], False), (J.is_f64, ["6"], True),
    (J.try_to_bool, ['"FALSE"'], False), (J.try_to_bool, ["6"], None), (J.try_to_i64, ['"+67"'], 67), (J.try_to_i64, ["true"], 1), (J.try_to_i64, ["2.5"], None), (J.try_to_i64, ['"2.5"'], None), (J.try_to_u64, ['"-6"'], None), (J.try_to_u64, ["false"], 0),
    (J.try_to_f64, ['".25"'], 0.25), (J.try_to_f64, ['"-inf"'], float("-inf")), (J.try_to_f64, ['" 6"'], None), (J.try_to_str, ["6.0"], "6.0"), (J.try_to_str, ["3e21"], "3e21"), (J.try_to_str, ["true"], "true"), (J.try_to_str, ["[6]"], None), (J.try_to_str, ["18446744073709551615"], "18446744073709551615"), (J.try_to_str, ["-6"], "-6"),
    (lambda a, b: J.build_array(a, b), ["null", '{"w":6}'], '[null,{"w":6}]'), (lambda a, b: J.build_object(z=a, k=b), ["6", "[8]"], '{"k":[8],"z":6}'),
    (lambda a, b: J.build_object_from(F.array(F.lit("w"), F.lit("w")), F.array(a, b)), ["6", "8"], '{"w":8}'),
    (J.concat, ["null", "false"], "[null,false]"), (J.concat, ['"owl"', "[6,8]"], '["owl",6,8]'), (J.concat, ['{"p":6,"q":8}', "[6]"], '[{"p":6,"q":8},6]'), (J.concat, ['{"p":6,"q":8,"s":9}', '{"p":7,"q":5}'], '{"p":7,"q":5,"s":9}'),
    (lambda v: J.delete_by_name(v, "owl"), ['["owl","elk",6,"owl"]'], '["elk",6]'), (lambda v: J.delete_by_name(v, "q"), ['{"q":8}'], "{}"), (lambda v: J.delete_by_name(v, "q", strict=False), ["6"], None),
    (lambda v: J.delete_by_index(v, -4), ["[6,7,8]"], "[6,7,8]"), (lambda v: J.delete_by_index(v, -1), ["[6,7,8]"], "[6,7]"),
    (lambda v: J.delete_by_keypath(v, "{hold,crates,1}"), [SHIP], '{"berth":40,"hold":{"cargo":null,"crates":[7]},"name":"Vega"}'), (lambda v: J.delete_by_keypath(v, "{hold,crates,9,x}"), ['{"hold":{"crates":[7]}}'], '{"hold":{"crates":[7]}}'),
    (lambda v: J.delete_by_keypath(v, F.lit("{hold,cargo}")), [SHIP], '{"berth":40,"hold":{"crates":[7,null]},"name":"Vega"}'), (lambda v: J.delete_by_keypath(v, "{0,x}"), ['[{"x":1,"y":2},{"x":3}]'], '[{"y":2},{"x":3}]'), (lambda v: J.delete_by_keypath(v, "{}"), ["[6]"], "[6]"),
    (lambda v: J.array_insert(v, -1, EMPTY("5")), ["[6,8]"], "[6,5,8]"), (lambda v: J.array_insert(v, 30, EMPTY("5")), ["6"], "[6,5]"), (lambda v: J.array_insert(v, -30, EMPTY("5")), ["[6]"], "[5,6]"),
    (lambda v: J.object_insert(v, "q", EMPTY("5")), ['{"p":6}'], '{"p":6,"q":5}'), (lambda v: J.object_insert(v, "p", EMPTY("5"), update=True), ['{"p":6}'], '{"p":5}'), (lambda v: J.object_insert(v, "p", EMPTY("5"), strict=False), ['{"p":6}'], None),
    (lambda v: J.object_delete(v, ["p", "t"]), ['{"p":6,"q":8}'], '{"q":8}'), (lambda v: J.object_pick(v, ["p", "t"]), ['{"p":6,"q":8}'], '{"p":6}'),
    (J.strip_nulls, [SHIP], '{"berth":40,"hold":{"crates":[7,null]},"name":"Vega"}'), (J.strip_nulls, ['{"w":null}'], "{}"), (J.strip_nulls, ['[{"a":{"b":{"c":{"d":{"e":null,"f":":null"}}}}},null,6.0]'], '[{"a":{"b":{"c":{"d":{"f":":null"}}}}},null,6.0]'),
    (J.array_distinct, ['[6,6.0,null,null,6,{"w":6},{"w":6}]'], '[6,6.0,null,{"w":6}]'), (J.array_distinct, ["6"], "[6]"), (J.array_distinct, ['["p","q","p"]'], '["p","q"]'), (J.array_distinct, ['["p",null,"p",null]'], '["p",null]'), (J.array_distinct, ["[]"], "[]"),
    (J.array_intersection, ['["r","s","s","s","t"]', '["s","s","x"]'], '["s","s"]'), (J.array_except, ['["r","s","s","s","t"]', '["s","s"]'], '["r","s","t"]'), (J.array_intersection, ["[6,7,7]", "[7,8]"], "[7]"), (J.array_except, ["[6,7,7]", "[]"], "[6,7,7]"), (J.array_intersection, ["[6,7]", '["6"]'], "[]"),
    (J.array_except, ["[[6],6.0]", "[6,[6]]"], "[6.0]"), (J.array_overlap, ["[null,6]", "[null]"], True), (J.array_overlap, ["[6]", "8"], False), (J.array_overlap, ['["p"]', '["q","p"]'], True), (J.array_overlap, ["[]", "[]"], False),
    (J.compare, ["[6,8]", "null"], -1), (J.to_string, ['{"q":2.50,"p":"\\n\\u0001"}'], '{"p":"\\n\x01","q":2.5}'),
    (J.to_pretty_string, ['{"p":[6]}'], '{\n  "p": [\n    6\n  ]\n}'), (J.to_json_object, ["[6]"], None), (J.to_json_object, ['{"p":6}'], '{"p":6}'), (lambda v: J.decode(J.encode(v)), [SHIP], '{"berth":40,"hold":{"cargo":null,"crates":[7,null]},"name":"Vega"}'),
]
#: Constant right sides are compiled; they mean what they mean row by row.
PARTS = ["{}", "[]", "6", "6.0", '"y"', "null", "true", '{"x":6}', '{"x":{}}', '{"x":[]}', '{"x":[{"y":null}]}', "[6]", "[6.0,6]", '["y",[6]]', "[[]]", "[{}]", '[{"x":6},null]', "18446744073709551615", '{"w\\"":1,"x":6}', "[true]"]
WHOLES = [*PARTS, '{"x":[{"y":null,"z":1},6]}', '[6,"y",[6,7],{"x":6,"y":7},null,true,6.0]', '{"w\\"":1,"x":6,"y":2}', '{"x":{"x":6}}', "[[6],[[]],18446744073709551615]"]


def test_constant_parts_are_contained_alike(spark):
    df = spark.createDataFrame([(t,) for t in WHOLES], "t string").select("t", J.parse("t").alias("v"))
    row = df.select("t", *(J.contains("v", J.document(p)).alias(f"c{i}") for i, p in enumerate(PARTS)))
    assert "EvalPython" not in row._jdf.queryExecution().executedPlan().toString()
    for r in row.collect():
        for i, p in enumerate(PARTS):
            assert r[f"c{i}"] == documents.contains(values.parse(r.t), values.parse(p)), (r.t, p)


@pytest.mark.parametrize("case", range(len(CASES)))
def test_function(spark, case):
    f, docs, expected = CASES[case]
    assert run(spark, f, *docs) == expected


@pytest.mark.parametrize(
    ("f", "doc", "what"),
    [
        (J.to_i64, "1.5", "InvalidCast"), (J.to_bool, "1", "InvalidCast"), (J.to_str, "null", "InvalidCast"), (lambda v: J.delete_by_name(v, "a"), "1", "InvalidJsonType"), (lambda v: J.delete_by_index(v, 0), "{}", "InvalidJsonType"),
        (lambda v: J.object_insert(v, "a", v), '{"a":1}', "ObjectDuplicateKey"), (lambda v: J.object_insert(v, "a", v), "[]", "InvalidObject"), (lambda v: J.object_pick(v, ["a"]), "[]", "InvalidObject"), (lambda v: J.delete_by_keypath(v, "{a}"), "1", "InvalidJsonType"),
    ],
)
def test_errors(spark, f, doc, what):
    with pytest.raises(Exception, match=what):
        run(spark, f, doc)


def test_nulls_and_bad_text(spark):
    df = spark.createDataFrame([(None,), ("[7,]",), ('{"a":1}',)], "t string")
    rows = df.select(J.path_exists(J.parse("t"), "$.a").alias("e"), J.get_by_path_first(J.parse("t"), "$.a").cast("string").alias("v"), J.parse_error("t").alias("x"), J.to_string(J.parse("t")).alias("s")).collect()
    assert [tuple(r) for r in rows] == [(None, None, None, None), (None, None, "expected value, pos 4", None), (True, "1", None, '{"a":1}')]
    lenient = spark.createDataFrame([('{ \\x0C "d": 5}',), ("x",)], "t string").select(J.to_string(J.parse("t", lenient=True)).alias("s"))
    assert [r["s"] for r in lenient.collect()] == ['{"d":5}', None]


def test_damaged_and_odd_wire_bytes(spark):
    nan, bad = values.encode([float("nan"), float("inf"), -0.5]), values.encode({"x": [6, "y"]})[:-1]
    df = spark.createDataFrame([(bytearray(nan),), (bytearray(bad),), (None,), (bytearray(b"[6, 8]"),), (bytearray(b"\xff\xfe"),)], "w binary")
    assert [r[0] for r in df.select(J.to_string(J.try_decode("w"))).collect()] == ["[NaN,inf,-0.5]", None, None, "[6,8]", None]
    assert [r[0] for r in df.select(J.to_string(J.try_decode("w", text_too=False))).collect()] == ["[NaN,inf,-0.5]", None, None, None, None]
    with pytest.raises(Exception, match="expected|EOF|Wire"):
        df.select(J.to_string(J.decode("w"))).collect()


def test_deep_documents(spark):
    df = spark.createDataFrame([("[" * 400 + "]" * 400,), ("[" * 401 + "]" * 401,)], "t string").select(J.parse("t").alias("v"))
    keys = [r[0] for r in df.select(J.order_key("v")).collect()]
    assert keys[0] < keys[1] and df.select(J.sort_key("v")).count() == 2
    assert [r[0] for r in df.select(F.length(J.to_string(J.decode(J.encode("v"))))).collect()] == [800, 802]


def test_random_values_repeat(spark):
    make = lambda: [r[0] for r in spark.range(20, numPartitions=2).select(J.to_string(J.rand_value(5))).collect()]
    first = make()
    assert first == make() and len(set(first)) > 5


def test_native_functions_have_no_python(spark):
    df = spark.createDataFrame([(SHIP,)], "t string").select(J.parse("t").alias("v"))
    one = F.parse_json(F.lit("1"))
    native = [
        J.get_by_path("v", "$.hold.crates[*]"), J.path_match("v", "$.berth == 40"), J.get_by_keypath("v", "{hold,crates,0}"), J.delete_by_keypath("v", "{hold,cargo}"), J.contains("v", J.document("[6]")), J.get_by_name("v", "A", ignore_case=True), J.object_keys("v"), J.concat("v", one), J.delete_by_name("v", "a"),
        J.array_insert("v", 0, one), J.object_insert("v", "n", one), J.object_pick("v", ["a"]), J.type_of("v"), J.try_to_i64("v"), J.exists_all_keys("v", ["a"]), J.build_array("v", one),
    ]
    plan = df.select(*(c.alias(f"c{i}") for i, c in enumerate(native)))._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan


def test_identity_keys_and_text_are_the_same_in_both_ways(spark):
    """Where Spark's own text serves as key or is printed, Python gives the same; documents that differ have different keys."""
    import random

    rng = random.Random(7)
    strings = ["", "a", "\x00", "\x07\x1f", '"\\\\/', "\b\f\n\r\t", "é\x7f\u2028", "\ue000", "😀", "😀a", "null", ":null"]
    scalar = lambda: rng.choice([None, True, False, rng.randrange(-5, 5), 2**63 - 1, -(2**63), 2**64 - 1, 0.5, 1e21, 3.0, *strings])
    made = lambda d: scalar() if d == 0 or rng.random() < 0.3 else [made(d - 1) for _ in range(rng.randrange(4))] if rng.random() < 0.5 else {rng.choice(strings): made(d - 1) for _ in range(rng.randrange(4))}
    docs = [made(3) for _ in range(400)]
    df = spark.createDataFrame([(bytearray(values.encode(d)),) for d in docs], "w binary").select(J.decode("w").alias("v"))
    df = df.select("v", F.parse_json(F.to_json("v")).alias("again")).select(J.identity_key("v").alias("k"), J.to_string("v").alias("t"), J.plan.simple(F.col("v")).alias("simple")).collect()
    assert 100 < sum(r.simple for r in df) < 390
    for d, r in zip(docs, df, strict=True):
        assert bytes(r.k) == values.identity_bytes(d) and r.t == values.render(d)
    assert len({bytes(r.k) for r in df}) == len({values.encode(d) for d in docs})
