"""Documents from VARIANT bytes, and multisets on these bytes."""

import random
from decimal import Decimal
from timeit import repeat

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import VariantVal

from jsonloom import functions as J
from jsonloom.functions import documents, multisets
from jsonloom.functions.variant import read, to_bytes, to_variant
from jsonloom.values import parse, render

TEXTS = [
    "null", "true", "-1", "300", "-70000", "9007199254740993", "18446744073709551615", "1.0", "1.50", "-0.25", "1e300", "123456789012.5", '""', '"é\U0001f600"', '"' + "x" * 70 + '"', "[]", "{}",
    '[1,[2.0,{"b":null,"a":[false]}]]', '{"b":1,"a":{"b":2}}', "[" + ",".join(map(str, range(300))) + "]", "{" + ",".join(f'"k{i}":{i}.5' for i in range(300)) + "}",
]


@pytest.mark.parametrize("text", TEXTS)
def test_read(text):
    doc = parse(text)
    for v in (to_variant(doc), VariantVal.parseJson(text)):
        found = J.from_variant(v)
        assert repr(found) == repr(doc)


@pytest.mark.parametrize(("kind", "width"), [(8, 4), (9, 8), (10, 16)])
def test_read_decimals(kind, width):
    for n, scale in ((7, 0), (70, 1), (-5, 3), (0, 2), (123456789, 9)):
        v = VariantVal(bytes([kind << 2, scale]) + n.to_bytes(width, "little", signed=True), b"\x01\x00\x00")
        assert repr(J.from_variant(v)) == repr(float(Decimal(n).scaleb(-scale)) if scale else n)


def test_read_is_cheap():
    """It took longer than PySpark's reader, which it went through."""
    v = to_variant(parse('[[2,1,1.0,null,null,{"x":2}],[1,null,{"x":1},2]]'))
    own, theirs = (min(repeat(f, number=300, repeat=5)) for f in (lambda: J.from_variant(v), v.toPython))
    assert own < theirs / 2


NAMES = ("array_distinct", "array_intersection", "array_except", "array_overlap")


def test_on_bytes_as_on_values():
    rnd = random.Random(3)
    some = [parse(t) for t in [*TEXTS, "1", "2", '"s"', '{"a":{"b":2},"b":1}', "[1,1.0]", "[1.0,1]", "false", "-0.0", "0.0"]]
    for _ in range(60):
        a, b = ([rnd.choice(some) for _ in range(rnd.choice([0, 1, 5, 12, 300]))] for _ in "ab")
        a, b = a + b[:3], rnd.choice([b, b, rnd.choice(some)])
        for name in NAMES:
            docs = [a] if name == "array_distinct" else [a, b]
            found = getattr(multisets, name)(*to_bytes(docs))
            assert repr(read(*found) if isinstance(found, tuple) else found) == repr(getattr(documents, name)(*docs))


def test_in_spark(spark):
    """Numbers written in several ways, members in any order, long arrays, decimals and dates that are no JSON, NULL."""
    pairs = [
        ('[1.0,1.00,1e0,1,{"b":1,"a":2},{"a":2,"b":1}]', '[1.000,{"b":1,"a":2}]'), ("[" + "1.5,null," * 200 + "2]", "[1.5,null,null]"), ('["p",1,"' + "q" * 80 + '"]', '["' + "q" * 80 + '"]'), ("[1.0]", None), (None, "[1.0]"), ("1.0", "1"),
    ]
    a, b = J.parse("a"), J.parse("b")
    out = spark.createDataFrame(pairs, "a string, b string").select("a", "b", J.to_string(J.array_distinct(a)).alias("d"), J.to_string(J.array_intersection(a, b)).alias("i"), J.to_string(J.array_except(a, b)).alias("e"), J.array_overlap(a, b).alias("o"))
    for r in out.collect():
        x, y = (None if t is None else parse(t) for t in (r.a, r.b))
        assert r.d == (None if x is None else render(documents.array_distinct(x)))
        both = None not in (r.a, r.b)
        assert (r.i, r.e, r.o) == ((render(documents.array_intersection(x, y)), render(documents.array_except(x, y)), documents.array_overlap(x, y)) if both else (None, None, None))
    native = F.to_variant_object(F.array(*[F.lit(v).cast(t).cast("variant") for v, t in ((7, "decimal(5,0)"), (7, "int"), ("2020-01-01", "date"), (7, "decimal(5,1)"))]))
    assert spark.range(1).select(J.to_string(J.array_distinct(native))).head()[0] == '[7,"2020-01-01",7.0]'
