import math
import random

import pytest

from jsonloom import values as V
from jsonloom.functions import documents as D

#: The texts of errors are fixed values; the documents are not.
ERRORS = [
    ("n", "EOF while parsing a value, pos 1"), ("fals", "EOF while parsing a value, pos 4"), ("truest", "trailing characters, pos 5"), ("nuke", "expected ident, pos 3"), ("fan", "expected ident, pos 3"),
    ("[7, ]", "expected value, pos 5"), ("[7 8", "expected `,` or `]`, pos 3"), ("007", "invalid number, pos 2"), ("7.", "EOF while parsing a value, pos 2"), ('{7:8}', "key must be a string, pos 2"), ("", "EOF while parsing a value, pos 0"),
]


@pytest.mark.parametrize(("text", "message"), ERRORS)
def test_errors(text, message):
    with pytest.raises(V.SyntaxFault) as e:
        V.parse(text)
    assert str(e.value) == message


def test_error_position_counts_bytes():
    with pytest.raises(V.SyntaxFault) as e:
        V.parse('["é" x]')
    assert e.value.pos == 6


@pytest.mark.parametrize(
    ("text", "value"),
    [
        (" true ", True), ("18446744073709551615", 2**64 - 1), ("-9223372036854775808", -(2**63)), ("18446744073709551616", 2.0**64), ("1e400", math.inf), ("-0", 0), ("1.50", 1.5), ('{"a":1,"a":2}', {"a": 2}),
        ('"\\u{1234}\\n"', "\u1234\n"), ('"\\uD83D\\uDC8E"', "\U0001f48e"), ('"\\uDEAD"', "\\uDEAD"), ('"\\uD83Dx"', "\\uD83Dx"), ("{\\t\\n\\r \"d\": 5}", {"d": 5}), ('{ \\x0C "d": 5}', {"d": 5}), ('"a\tb"', "a\tb"),
    ],
)
def test_parse(text, value):
    got = V.parse(text)
    assert V.encode(got) == V.encode(value)


@pytest.mark.parametrize(("x", "text"), [(3e21, "3e21"), (98.7654, "98.7654"), (700.0, "700.0"), (1e-7, "1e-7"), (1e16, "1e16"), (1e15, "1000000000000000.0"), (0.001, "0.001"), (-0.0, "-0.0"), (math.inf, "inf"), (5, "5")])
def test_number_text(x, text):
    assert V.number_text(x) == text


def test_pretty():
    assert V.render({"b": [], "a": [1, {}]}, pretty=True) == '{\n  "a": [\n    1,\n    {\n\n    }\n  ],\n  "b": [\n\n  ]\n}'


@pytest.mark.parametrize(
    ("value", "wire"),
    [
        (None, "2000000100000000"), (True, "2000000140000000"), ("owl", "20000001100000036f776c"), (0, "200000012000000100"), (-77, "200000012000000240b3"), (2000, "20000001200000035007d0"), (1.5, "2000000120000009603ff8000000000000"),
        ([False, 1], "80000002300000002000000250" + "01"), ({"q": "r"}, "4000000110000001100000017172"),
    ],
)
def test_wire(value, wire):
    assert V.encode(value).hex() == wire
    assert V.encode(V.decode(bytes.fromhex(wire))).hex() == wire


def test_wire_truncated():
    with pytest.raises((V.JsonError, IndexError)):
        V.decode(V.encode({"k": [1, "x"]})[:-1])
    assert V.from_slice(b' {"a": 1}') == {"a": 1}


@pytest.mark.parametrize("seed", range(200))
def test_round_trips(seed):
    value = D.random_value(random.Random(seed))
    assert V.encode(V.decode(V.encode(value))) == V.encode(value)
    assert V.encode(V.parse(V.render(value))) == V.encode(value)
    assert V.encode(V.parse(V.render(value, pretty=True))) == V.encode(value)


#: A ladder of documents, each above those before it.
LADDER = [
    "false", "true", "-7e3", "-7", "-0.25", "0", "0.125", "41", "41.5", "9007199254740993", "18446744073709551614", '""', '"\\u0000"', '"\\u0000b"', '"\\u0001"', '"Zoe"', '"zoe"', '"zoe "', '"ü"', "{}", '{"":null}', '{"m":[]}', '{"m":null}', '{"m":null,"n":0}',
    '{"n":0}', "[]", "[false]", "[0]", "[0,0]", '["","\\u0001"]', '["\\u0000"]', '["a","b"]', '["a\\u0001b"]', "[{}]", "[[]]", "[[],0]", "[[0]]", "[null]", "null",
]


def test_order():
    docs = [V.parse(t) for t in LADDER]
    for i, a in enumerate(docs):
        for j, b in enumerate(docs):
            assert V.compare(a, b) == (i > j) - (i < j), (LADDER[i], LADDER[j])
            x, y = V.order_bytes(a), V.order_bytes(b)
            assert (x > y) - (x < y) == (i > j) - (i < j), (LADDER[i], LADDER[j])
    # the raw key orders what holds no low control characters and no large integers
    plain = [d for d, t in zip(docs, LADDER, strict=True) if "\\u00" not in t and "90071" not in t]
    assert sorted(plain, key=V.sort_key) == plain


def test_order_bytes_of_numbers_and_depth():
    assert V.order_bytes(2**53) != V.order_bytes(2**53 + 1) and V.order_bytes(2**64 - 2) < V.order_bytes(2**64 - 1)
    assert V.order_bytes(-0.0) == V.order_bytes(0) == V.order_bytes(0.0) and V.order_bytes(5) == V.order_bytes(5.0)
    assert V.order_bytes(math.inf) < V.order_bytes(math.nan) == V.order_bytes(-math.nan)
    deep = 0
    for _ in range(5000):
        deep = [deep]
    assert V.order_bytes(deep) < V.order_bytes([deep])


@pytest.mark.parametrize("seed", range(60))
def test_order_bytes_agree_with_compare(seed):
    rng = random.Random(seed)
    made = lambda d: rng.choice([None, True, False, rng.randrange(-3, 3), rng.choice([0.5, -1.5, 2.0]), rng.choice(["", "a", "a\x00", "a\x00b", "b"])]) if d == 0 or rng.random() < 0.4 else [made(d - 1) for _ in range(rng.randrange(3))] if rng.random() < 0.5 else {rng.choice("pq\x00"): made(d - 1) for _ in range(rng.randrange(3))}
    a, b = made(3), made(3)
    x, y = V.order_bytes(a), V.order_bytes(b)
    assert V.compare(a, b) == (x > y) - (x < y)


def test_compare_numbers():
    assert V.compare(2**63, 2**63 + 1) == -1
    assert V.compare(1, 1.0) == 0
    assert V.encode(1) != V.encode(1.0)
    assert V.compare(math.nan, math.inf) == 1
