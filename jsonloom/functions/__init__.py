"""Functions on columns that hold documents.

Documents are VARIANT columns; ``parse`` makes them from text, ``decode`` from
wire bytes. Most functions are Catalyst expressions. Those that recurse, compare
by bytes or print exactly run in Arrow batches (section "in Python"). A NULL
document gives NULL.
"""

from __future__ import annotations

import random
import sys
from collections.abc import Callable
from decimal import Decimal
from functools import lru_cache, reduce
from operator import and_
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import is_variant, to_arrow_type
from pyspark.sql.types import BinaryType, BooleanType, DataType, IntegerType, StringType, VariantType

from .. import values
from ..plans import compile as plan
from ..plans import evaluate
from ..plans.paths import parse_key_path, parse_path
from ..values import JsonError, Value
from . import documents, multisets
from .variant import U64, from_variant, read, to_bytes  # noqa: F401


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _arg(x: Any) -> Column:
    """An argument: a Column, or a constant."""
    return x if isinstance(x, Column) else F.lit(x)


def _fail(ok: Column, out: Column, what: str, strict: bool) -> Column:
    return F.when(ok, out).otherwise(F.raise_error(F.lit(what))) if strict else F.when(ok, out)


# ---------------------------------------------------------------- in Python


class _Missing:
    """Stands for NULL where None is the document null; workers know it by its name."""

    def __reduce__(self) -> str:
        return "MISSING"


MISSING = _Missing()


def _rows(column: pa.Array) -> list:
    """An Arrow column as Python values, VARIANT as pairs of its value and metadata."""
    if not (pa.types.is_struct(column.type) and is_variant(column.type)):
        return column.to_pylist()
    pairs = zip(column.field("value").to_pylist(), column.field("metadata").to_pylist(), strict=True)
    return list(pairs) if not column.null_count else [p if there else None for p, there in zip(pairs, column.is_valid().to_pylist(), strict=True)]


def _column(rows: list, returns: DataType) -> pa.Array:
    """The reverse of ``_rows``."""
    kind = to_arrow_type(returns)
    if not isinstance(returns, VariantType):
        return pa.array(rows, kind)
    value, metadata = (pa.array([b"" if r is None else r[i] for r in rows], pa.binary()) for i in (0, 1))
    return pa.StructArray.from_arrays([value, metadata], fields=list(kind), mask=pa.array([r is None for r in rows], pa.bool_()))


def vectorised(f: Callable, returns: DataType, strict: bool = True, raw: bool = False) -> Callable:
    """f on rows of Arrow batches as a UDF; VARIANT arguments come as values and go back as such, NULL in any gives NULL.

    What f finds wrong is an error, or NULL without ``strict``. With ``raw``, f
    takes one VARIANT as its value and metadata, and a VARIANT goes back as these.
    """
    document = isinstance(returns, VariantType)

    def one(row: tuple) -> Any:
        for x in row:
            if x is None:
                return None
        try:
            out = f(*row[0]) if raw else f(*(read(*x) if type(x) is tuple else x for x in row))
        except JsonError:
            if strict:
                raise
            return None
        if out is MISSING:
            return None
        return to_bytes(out) if document and not raw else out

    def run(*cols: pa.Array) -> pa.Array:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), DEEP))
        return _column([one(row) for row in zip(*map(_rows, cols), strict=True)], returns)

    return F.arrow_udf(run, returns)


def _python(f: Callable, returns: DataType, *args: Column, strict: bool = True, raw: bool = False) -> Column:
    return vectorised(f, returns, strict, raw)(*args)


#: Levels that documents may have in Python.
DEEP = 20_000
DOCUMENT = VariantType()


# ---------------------------------------------------------------- sources and sinks


def parse(text: Column | str, lenient: bool = False) -> Column:
    """Text to document; not JSON gives NULL. ``lenient`` also takes what ``values.parse`` takes, in Python."""
    c = _col(text)
    if not lenient:
        return F.try_parse_json(c)
    return F.coalesce(F.try_parse_json(c), _python(values.parse, DOCUMENT, c, strict=False))


def parse_error(text: Column | str) -> Column:
    """What is wrong with a text, with the byte it shows at; NULL if it is a document."""

    def run(s: str) -> str | None:
        try:
            values.parse(s)
        except JsonError as e:
            return str(e)
        return None

    return _python(run, StringType(), _col(text))


def encode(doc: Column | str) -> Column:
    """Document to wire bytes: equal documents have equal bytes."""
    return _python(values.encode, BinaryType(), _col(doc))


def decode(data: Column | str, text_too: bool = True) -> Column:
    """Wire bytes to document; also from text, unless ``text_too`` is false."""
    return _python(decoder(text_too), DOCUMENT, _col(data))


def try_decode(data: Column | str, text_too: bool = True) -> Column:
    """As ``decode``; bytes that hold no document give NULL."""
    return _python(decoder(text_too), DOCUMENT, _col(data), strict=False)


def decoder(text_too: bool) -> Callable[[bytes], Value]:
    def run(data: bytes) -> Value:
        try:
            return (values.from_slice if text_too else values.decode)(bytes(data))
        except (UnicodeDecodeError, IndexError, RecursionError):
            raise JsonError("InvalidWire") from None

    return run


def _printed(v: Column, f: Callable[[Value], str]) -> Column:
    """Compact text as Spark prints it where that is the same, else by f in Python."""
    text = F.to_json(v)
    # Spark escapes all control characters, and orders names by UTF-16 units
    same = F.coalesce(plan.simple(v) & ~text.contains("\\u00") & ~text.rlike(r"[\x{E000}-\x{10FFFF}]"), F.lit(False))
    # f gives a text for each document it gets, so where it has none Spark's text is the same
    return F.coalesce(_python(f, StringType(), F.when(~same, v)), text)


def to_string(doc: Column | str) -> Column:
    """Compact text, members in the order of their names."""
    return _printed(_col(doc), values.render)


def to_pretty_string(doc: Column | str) -> Column:
    return _python(lambda v: values.render(v, pretty=True), StringType(), _col(doc))


def to_json(doc: Column | str) -> Column:
    """Strict JSON text; an error for numbers that are not finite."""
    return _printed(_col(doc), lambda v: values.render(values.plain(v)))


def to_json_object(doc: Column | str) -> Column:
    """As ``to_json`` for objects; NULL for anything else."""
    return F.when(is_object(doc), to_json(doc))


def document(text: str) -> Column:
    """A constant document."""
    out = F.parse_json(F.lit(text))
    out.__dict__["_document"] = values.parse(text)
    return out


def _constant(c: Any) -> Value:
    """What a column from ``document`` holds; MISSING for other columns."""
    return c.__dict__.get("_document", MISSING) if isinstance(c, Column) else MISSING


def from_native(c: Column | str) -> Column:
    """A Spark value as document; maps, structs and arrays become objects and arrays."""
    return F.try_variant_get(F.to_variant_object(F.array(_col(c))), "$[0]", "variant")


def rand_value(seed: int) -> Column:
    """A random document for each row; rows differ, and a seed repeats them for a given number of rows in a partition."""
    return _python(lambda n: documents.random_value(random.Random(n)), DOCUMENT, F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)))


# ---------------------------------------------------------------- path selection


@lru_cache(maxsize=1024)
def _path(text: str):  # noqa: ANN202
    return parse_path(text)


def _selected(doc: Column | str, path: str | Column) -> plan.Nodes:
    if isinstance(path, Column):
        return plan.Nodes(many=plan.elements(_python(lambda v, p: evaluate.select(_path(p), v), DOCUMENT, _col(doc), path)))
    return plan.select(_path(path), _col(doc))


def get_by_path(doc: Column | str, path: str | Column) -> Column:
    """No hit: NULL; one: the hit; several: an array of them."""
    nodes = _selected(doc, path)
    if nodes.many is None:
        return nodes.single()
    a = nodes.many
    return F.when(F.size(a) == 1, F.get(a, F.lit(0))).when(F.size(a) > 1, F.to_variant_object(a))


def get_by_path_first(doc: Column | str, path: str | Column) -> Column:
    nodes = _selected(doc, path)
    return nodes.single() if nodes.many is None else F.get(nodes.many, F.lit(0))


def get_by_path_array(doc: Column | str, path: str | Column) -> Column:
    """An array of the hits, empty if there is none."""
    return F.when(F.isnotnull(_col(doc)), F.to_variant_object(_selected(doc, path).array()))


def get_by_path_all(doc: Column | str, path: str | Column) -> Column:
    """The hits as ARRAY<VARIANT>, for ``explode``."""
    return F.when(F.isnotnull(_col(doc)), _selected(doc, path).array())


def path_exists(doc: Column | str, path: str | Column) -> Column:
    if isinstance(path, Column):
        return _python(lambda v, p: evaluate.exists(_path(p), v), BooleanType(), _col(doc), path)
    return plan.exists(_path(path), _col(doc))


def path_match(doc: Column | str, path: str | Column) -> Column:
    """The truth of a predicate; other paths are an error."""
    if isinstance(path, Column):
        return _python(lambda v, p: evaluate.match(_path(p), v), BooleanType(), _col(doc), path)
    return plan.match(_path(path), _col(doc))


def path_text(path: Column | str) -> Column:
    """A path as it is printed; what is no path is an error."""
    return _python(lambda p: str(_path(p)), StringType(), _col(path))


def key_path_text(path: Column | str) -> Column:
    """A key path as it is printed."""
    return _python(lambda p: str(_key_path(p)), StringType(), _col(path))


# ---------------------------------------------------------------- access


def get_by_index(doc: Column | str, index: int | Column) -> Column:
    i = _arg(index)
    return F.when(i >= 0, F.get(plan.elements(_col(doc)), i))


def get_by_name(doc: Column | str, name: str | Column, ignore_case: bool = False) -> Column:
    """A member; with ``ignore_case`` the exact one, or else the first whose name differs in ASCII case alone."""
    v = _col(doc)
    if isinstance(name, str) and plan.plain_name(name) and not ignore_case:
        return F.try_variant_get(v, f'$["{name}"]', "variant")
    m, n = plan.members(v), _arg(name)
    exact = F.try_element_at(m, n)
    if not ignore_case:
        return exact
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(exact, F.try_element_at(m, F.get(F.array_sort(F.filter(F.map_keys(m), lambda k: lower(k) == lower(n))), F.lit(0))))


def get_by_keypath(doc: Column | str, path: str | Column) -> Column:
    if isinstance(path, Column):
        return _python(lambda v, p: (lambda ok, x: x if ok else MISSING)(*evaluate.get_key(v, _key_path(p))), DOCUMENT, _col(doc), path)
    v = _col(doc)
    for key in _key_path(path).keys:
        if isinstance(key.value, str) or key.quoted:
            v = get_by_name(v, str(key.value))
        else:
            a = plan.elements(v)
            v = F.get(a, F.lit(key.value) if key.value >= 0 else F.size(a) + key.value)
    return v


@lru_cache(maxsize=1024)
def _key_path(text: str):  # noqa: ANN202
    return parse_key_path(text)


def object_keys(doc: Column | str) -> Column:
    """Names of members in the order of their bytes, as ARRAY<STRING>; NULL for other documents."""
    return F.array_sort(F.map_keys(plan.members(_col(doc))))


def object_each(doc: Column | str) -> Column:
    """Members as ARRAY<STRUCT<key, value>> in the order of their names, for ``explode`` or ``inline``."""
    m = plan.members(_col(doc))
    return F.transform(F.array_sort(F.map_keys(m)), lambda k: F.struct(k.alias("key"), F.element_at(m, k).alias("value")))


def array_values(doc: Column | str) -> Column:
    """Elements as ARRAY<VARIANT>; NULL for other documents."""
    return plan.elements(_col(doc))


def array_length(doc: Column | str) -> Column:
    a = plan.elements(_col(doc))
    return F.when(F.isnotnull(a), F.size(a))


# ---------------------------------------------------------------- predicates


def contains(left: Column | str, right: Column | str) -> Column:
    """Whether left holds all of right. A constant right side (``document``) is compiled; others are compared in Python."""
    fixed = _constant(right)
    if fixed is not MISSING:
        v = _col(left)
        return F.when(F.isnotnull(v), plan.part_of(v, fixed))
    return _python(documents.contains, BooleanType(), _col(left), _col(right))


def _names(doc: Column | str) -> Column:
    v = _col(doc)
    strings = F.transform(F.filter(plan.elements(v), lambda x: F.schema_of_variant(x) == "STRING"), lambda x: plan.get(x, "string"))
    return F.coalesce(F.map_keys(plan.members(v)), strings, F.when(F.isnotnull(v), F.array().cast("array<string>")))


def _keys(keys: list[str] | Column) -> Column:
    return keys if isinstance(keys, Column) else F.array(*map(F.lit, keys)).cast("array<string>")


def exists_all_keys(doc: Column | str, keys: list[str] | Column) -> Column:
    """Whether an object has all the members, or an array string elements, of these names; without names, true for every document."""
    names = _names(doc)
    return F.when(F.isnotnull(_col(doc)), F.forall(_keys(keys), lambda k: F.array_contains(names, k)))


def exists_any_keys(doc: Column | str, keys: list[str] | Column) -> Column:
    names = _names(doc)
    return F.when(F.isnotnull(_col(doc)), F.exists(_keys(keys), lambda k: F.array_contains(names, k)))


def traverse_check_string(doc: Column | str, test: Callable[[str], bool]) -> Column:
    """Whether the test holds for any string in the document, names of members included."""
    return _python(lambda v: documents.any_string(v, test), BooleanType(), _col(doc))


# ---------------------------------------------------------------- kinds and casts


def type_of(doc: Column | str) -> Column:
    return plan.kind(_col(doc))


def same_kind(left: Column | str, right: Column | str) -> Column:
    return type_of(left) == type_of(right)


def _is(doc: Column | str, kind: str) -> Column:
    return plan.kind(_col(doc)) == kind


def is_null(doc: Column | str) -> Column:
    v = _col(doc)
    return F.when(F.isnotnull(v), F.is_variant_null(v))


def is_boolean(doc: Column | str) -> Column:
    return _is(doc, "boolean")


def is_number(doc: Column | str) -> Column:
    return _is(doc, "number")


def is_string(doc: Column | str) -> Column:
    return _is(doc, "string")


def is_array(doc: Column | str) -> Column:
    v = _col(doc)
    return F.when(F.isnotnull(v), F.isnotnull(plan.elements(v)))


def is_object(doc: Column | str) -> Column:
    v = _col(doc)
    return F.when(F.isnotnull(v), F.isnotnull(plan.members(v)))


def is_i64(doc: Column | str) -> Column:
    v = _col(doc)
    return F.when(F.isnotnull(v), F.isnotnull(as_i64(v)))


def is_u64(doc: Column | str) -> Column:
    v = _col(doc)
    return F.when(F.isnotnull(v), F.isnotnull(as_u64(v)))


def is_f64(doc: Column | str) -> Column:
    return is_number(doc)


def as_null(doc: Column | str) -> Column:
    """TRUE for null, else NULL."""
    return F.when(F.is_variant_null(_col(doc)), F.lit(True))


def as_bool(doc: Column | str) -> Column:
    v = _col(doc)
    return F.when(F.schema_of_variant(v) == "BOOLEAN", plan.get(v, "boolean"))


def as_number(doc: Column | str) -> Column:
    """A number as document, else NULL."""
    v = _col(doc)
    return F.when(is_number(v), v)


def as_i64(doc: Column | str) -> Column:
    return plan.integer(_col(doc))


def as_u64(doc: Column | str) -> Column:
    """DECIMAL(20, 0)."""
    n = plan.whole(_col(doc))
    return F.when((n >= 0) & (n <= F.lit(Decimal(U64))), n.cast("decimal(20,0)"))


def as_f64(doc: Column | str) -> Column:
    v = _col(doc)
    return F.when(is_number(v), plan.get(v, "double"))


def as_str(doc: Column | str) -> Column:
    v = _col(doc)
    return F.when(is_string(v), plan.get(v, "string"))


def _cast(doc: Column | str, out: Column, strict: bool) -> Column:
    v = _col(doc)
    if not strict:
        return out
    return F.when(F.isnotnull(v), F.coalesce(out, F.raise_error(F.lit("InvalidCast"))))


def _to_bool(v: Column) -> Column:
    s = F.lower(as_str(v))
    return F.coalesce(as_bool(v), F.when(s == "true", True).when(s == "false", False))


def _by_kind(v: Column, kind: str, text: Callable[[Column], Column], own: Column) -> Column:
    """A cast of strings by ``text``, of booleans as 0 and 1, and of the rest as they are."""
    s = F.schema_of_variant(v)
    return F.when(s == "STRING", text(plan.get(v, "string"))).when(s == "BOOLEAN", plan.get(v, "boolean").cast("int").cast(kind)).otherwise(own)


def _to_int(v: Column, own: Column, kind: str, pattern: str) -> Column:
    return _by_kind(v, kind, lambda t: F.when(t.rlike(pattern), t.try_cast(kind)), own)


def _to_u64(v: Column) -> Column:
    n = _to_int(v, as_u64(v), "decimal(20,0)", r"^\+?[0-9]+$")
    return F.when(n <= F.lit(Decimal(U64)), n)


FLOAT = r"^[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?)$"


def _to_f64(v: Column) -> Column:
    def text(t: Column) -> Column:
        low = F.lower(t)
        odd = F.when(low.rlike(r"^\+?inf(inity)?$"), F.lit(float("inf"))).when(low.rlike(r"^-inf(inity)?$"), F.lit(float("-inf"))).when(low.rlike(r"^[+-]?nan$"), F.lit(float("nan")))
        return F.when(t.rlike(FLOAT), t.try_cast("double")).otherwise(odd)

    return _by_kind(v, "double", text, as_f64(v))


def to_bool(doc: Column | str) -> Column:
    return _cast(doc, _to_bool(_col(doc)), True)


def try_to_bool(doc: Column | str) -> Column:
    return _to_bool(_col(doc))


def to_i64(doc: Column | str) -> Column:
    return _cast(doc, try_to_i64(doc), True)


def try_to_i64(doc: Column | str) -> Column:
    v = _col(doc)
    return _to_int(v, as_i64(v), "bigint", r"^[+-]?[0-9]+$")


def to_u64(doc: Column | str) -> Column:
    return _cast(doc, _to_u64(_col(doc)), True)


def try_to_u64(doc: Column | str) -> Column:
    return _to_u64(_col(doc))


def to_f64(doc: Column | str) -> Column:
    return _cast(doc, _to_f64(_col(doc)), True)


def try_to_f64(doc: Column | str) -> Column:
    return _to_f64(_col(doc))


def to_str(doc: Column | str) -> Column:
    """Text of a scalar; null, arrays and objects are an error."""
    return _cast(doc, try_to_str(doc), True)


def try_to_str(doc: Column | str) -> Column:
    v = _col(doc)
    s = F.schema_of_variant(v)
    # only numbers with a fraction, or too large for BIGINT, are printed in Python
    odd = s.rlike("^(DECIMAL|DOUBLE|FLOAT)")
    return F.when(odd, _python(documents.text_of, StringType(), F.when(odd, v))).when(~s.rlike("^(ARRAY|OBJECT|VOID)"), plan.get(v, "string"))


# ---------------------------------------------------------------- construction and change


def build_array(*items: Column | str) -> Column:
    return F.to_variant_object(F.array(*map(_col, items))) if items else F.parse_json(F.lit("[]"))


def build_object(**members: Column | str) -> Column:
    if not members:
        return F.parse_json(F.lit("{}"))
    null = F.parse_json(F.lit("null"))
    return F.to_variant_object(F.create_map(*[x for k, v in members.items() for x in (F.lit(k), F.coalesce(_col(v), null))]))


def build_object_from(keys: Column, items: Column) -> Column:
    """Names and documents to an object; the last of equal names wins."""
    names, values_ = F.reverse(keys), F.reverse(items)
    last = lambda k: F.element_at(values_, F.array_position(names, k).cast("int"))
    return F.to_variant_object(F.map_from_entries(F.transform(F.array_distinct(names), lambda k: F.struct(k.alias("k"), last(k).alias("v")))))


def _wrapped(v: Column) -> Column:
    return F.coalesce(plan.elements(v), F.array(v))


def _from_members(m: Column) -> Column:
    return F.to_variant_object(m)


def concat(left: Column | str, right: Column | str) -> Column:
    """Objects merge, the right wins; other documents become arrays that follow each other."""
    a, b = _col(left), _col(right)
    m, n = plan.members(a), plan.members(b)
    merged = F.map_concat(F.map_filter(m, lambda k, _: ~F.map_contains_key(n, k)), n)
    known = F.isnotnull(a) & F.isnotnull(b)
    return F.when(known & F.isnotnull(m) & F.isnotnull(n), _from_members(merged)).when(known, F.to_variant_object(F.concat(_wrapped(a), _wrapped(b))))


def delete_by_name(doc: Column | str, name: str | Column, strict: bool = True) -> Column:
    """Without the member of that name, or the string elements that equal it."""
    v, n = _col(doc), _arg(name)
    m, a = plan.members(v), plan.elements(v)
    fewer = F.filter(a, lambda x: ~F.coalesce((F.schema_of_variant(x) == "STRING") & (plan.get(x, "string") == n), F.lit(False)))
    out = F.when(F.isnotnull(m), _from_members(F.map_filter(m, lambda k, _: k != n))).otherwise(F.to_variant_object(fewer))
    return F.when(F.isnotnull(v), _fail(plan.is_container(v), out, "InvalidJsonType", strict))


def delete_by_index(doc: Column | str, index: int | Column, strict: bool = True) -> Column:
    v, i = _col(doc), _arg(index)
    a = plan.elements(v)
    at = F.when(i < 0, i + F.size(a)).otherwise(i)
    return F.when(F.isnotnull(v), _fail(F.isnotnull(a), F.to_variant_object(F.filter(a, lambda _, k: k != at)), "InvalidJsonType", strict))


def delete_by_keypath(doc: Column | str, path: str | Column, strict: bool = True) -> Column:
    if isinstance(path, Column):
        return _python(lambda v, p: documents.delete_by_keypath(v, _key_path(p)), DOCUMENT, _col(doc), path, strict=strict)
    v = _col(doc)
    return F.when(F.isnotnull(v), _fail(plan.is_container(v), plan.without(v, _key_path(path).keys), "InvalidJsonType", strict))


def array_insert(doc: Column | str, pos: int | Column, new: Column | str) -> Column:
    """A negative place counts from the end and comes before that element; beyond the ends goes to them."""
    v, x, p = _col(doc), _col(new), _arg(pos)
    a = _wrapped(v)
    n = F.size(a)
    at = F.least(F.greatest(F.when(p < 0, p + n).otherwise(p), F.lit(0)), n)
    out = F.concat(F.slice(a, F.lit(1), at), F.array(x), F.slice(a, at + 1, n - at))
    return F.when(F.isnotnull(v) & F.isnotnull(x) & F.isnotnull(p), F.to_variant_object(out))


def object_insert(doc: Column | str, key: str | Column, new: Column | str, update: bool = False, strict: bool = True) -> Column:
    v, k, x = _col(doc), _arg(key), _col(new)
    m = plan.members(v)
    out = _from_members(F.map_concat(F.map_filter(m, lambda own, _: own != k), F.create_map(k, x)))
    if not update:
        out = _fail(~F.map_contains_key(m, k), out, "ObjectDuplicateKey", strict)
    return F.when(F.isnotnull(v) & F.isnotnull(x) & F.isnotnull(k), _fail(F.isnotnull(m), out, "InvalidObject", strict))


def object_delete(doc: Column | str, keys: list[str] | Column, strict: bool = True) -> Column:
    v, ks = _col(doc), _keys(keys)
    m = plan.members(v)
    return F.when(F.isnotnull(v), _fail(F.isnotnull(m), _from_members(F.map_filter(m, lambda k, _: ~F.array_contains(ks, k))), "InvalidObject", strict))


def object_pick(doc: Column | str, keys: list[str] | Column, strict: bool = True) -> Column:
    v, ks = _col(doc), _keys(keys)
    m = plan.members(v)
    return F.when(F.isnotnull(v), _fail(F.isnotnull(m), _from_members(F.map_filter(m, lambda k, _: F.array_contains(ks, k))), "InvalidObject", strict))


#: Levels down to which nulls are stripped by Catalyst, and elements up to which arrays are compared by it.
NATIVE_DEPTH, NATIVE_SIZE = 3, 64


def strip_nulls(doc: Column | str) -> Column:
    """Without members that are null, at any depth; null elements stay. What has nulls below NATIVE_DEPTH levels goes through Python."""
    v = _col(doc)
    has = lambda x: F.to_json(x).contains(":null")  # noqa: E731  # or a string that looks like it, which does no harm
    native = F.when(has(v), plan.stripped(v, NATIVE_DEPTH)).otherwise(v)
    return F.coalesce(_python(documents.strip_nulls, DOCUMENT, F.when(has(native), native)), native)


# ---------------------------------------------------------------- arrays as multisets


def _plain(*docs: Column) -> tuple[Column, list[Column]]:
    """Whether all documents are small arrays of strings or all of 64-bit integers, and their elements as text: these alone are equal as documents if they are as text."""
    kinds = [F.schema_of_variant(v) for v in docs]
    own = lambda kind: reduce(and_, [(k == kind) | (F.size(plan.elements(v)) == 0) for k, v in zip(kinds, docs, strict=True)])
    items = [F.try_variant_get(v, "$", "array<string>") for v in docs]
    small = reduce(and_, [(F.size(a) <= NATIVE_SIZE) & (F.size(F.array_compact(a)) == F.size(a)) for a in items])
    return F.coalesce((own("ARRAY<STRING>") | own("ARRAY<BIGINT>")) & small, F.lit(False)), items


def _picked(v: Column, a: Column, keep: Callable) -> Column:
    """The elements of an array for which ``keep`` (on their text and place) holds. No lambda in another: Spark loses UDFs over such expressions."""
    return F.to_variant_object(F.filter(plan.elements(v), lambda _, i: keep(F.get(a, i), i)))


def _count(a: Column, x: Column) -> Column:
    return F.size(a) - F.size(F.array_remove(a, x))


def _else_python(f: Callable, returns: DataType, plain: Column, native: Column, *docs: Column) -> Column:
    """``native`` where it will do, else f in Python, which gets only those rows; what it has found is asked first, as that costs nothing."""
    known = reduce(and_, [F.isnotnull(v) for v in docs])
    both = F.when(known & ~plain, F.to_variant_object(F.array(*docs)))
    return F.coalesce(_python(f, returns, both, raw=True), F.when(plain, native))


def array_distinct(doc: Column | str) -> Column:
    """An array's distinct elements; another document counts as an array of itself."""
    v = _col(doc)
    plain, (a,) = _plain(v)
    return _else_python(multisets.array_distinct, DOCUMENT, plain, _picked(v, a, lambda x, i: F.array_position(a, x) == i + 1), v)


def array_intersection(left: Column | str, right: Column | str) -> Column:
    """Elements of left that right has, each of right's used once."""
    v, w = _col(left), _col(right)
    plain, (a, b) = _plain(v, w)
    return _else_python(multisets.array_intersection, DOCUMENT, plain, _picked(v, a, lambda x, i: _count(F.slice(a, F.lit(1), i + 1), x) <= _count(b, x)), v, w)


def array_except(left: Column | str, right: Column | str) -> Column:
    """Elements of left that right lacks, each of right's used once."""
    v, w = _col(left), _col(right)
    plain, (a, b) = _plain(v, w)
    return _else_python(multisets.array_except, DOCUMENT, plain, _picked(v, a, lambda x, i: _count(F.slice(a, F.lit(1), i + 1), x) > _count(b, x)), v, w)


def array_overlap(left: Column | str, right: Column | str) -> Column:
    v, w = _col(left), _col(right)
    plain, (a, b) = _plain(v, w)
    return _else_python(multisets.array_overlap, BooleanType(), plain, F.arrays_overlap(a, b), v, w)


# ---------------------------------------------------------------- order and identity


def identity_key(doc: Column | str) -> Column:
    """Bytes that are equal for equal documents alone, for GROUP BY, DISTINCT and joins: Spark's text where it is exact, else made in Python, which gives the same where both can."""
    v = _col(doc)
    simple = F.coalesce(plan.simple(v), F.lit(False))
    return F.coalesce(F.when(simple, F.encode(F.to_json(v), "utf-8")), _python(values.identity_bytes, BinaryType(), F.when(~simple, v)))




def compare(left: Column | str, right: Column | str) -> Column:
    """-1, 0 or 1: null > array > object > string > number > true > false."""
    return _python(values.compare, IntegerType(), _col(left), _col(right))


def sort_key(doc: Column | str) -> Column:
    """Bytes that sort nearly as the documents do (see ``values.sort_key``); ``order_key`` is exact."""
    return _python(values.sort_key, BinaryType(), _col(doc))


def order_key(doc: Column | str) -> Column:
    """Bytes that sort as ``compare`` orders documents, for ORDER BY, GROUP BY and joins by numeric equality."""
    return _python(values.order_bytes, BinaryType(), _col(doc))


def sort_key_of_text(text: Column | str) -> Column:
    """As ``sort_key``, from text; what is no document sorts below all, by its bytes."""

    def run(s: str) -> bytes:
        try:
            return values.sort_key(values.parse(s))
        except JsonError:
            return bytes([0, values.LEVELS["invalid"]]) + s.encode()

    return _python(run, BinaryType(), _col(text))
