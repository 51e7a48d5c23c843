"""Document functions in SQL: temporary functions named ``jl_...``.

What Catalyst can express is a SQL body that it inlines. Paths are arguments
here, so functions on them run in Arrow batches, as do those that print exactly,
recurse or compare; where a path is constant, the functions of
``jsonloom.functions`` compile it instead. Documents come and go as VARIANT.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, StringType

from . import functions as J
from . import values
from .functions import documents
from .plans import evaluate
from .plans.paths import parse_key_path, parse_path
from .values import JsonError

#: Session settings that the functions rely on.
SETTINGS = {"spark.sql.variant.allowDuplicateKeys": "true", "spark.sql.mapKeyDedupPolicy": "LAST_WIN", "spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true"}

A, M, S = "try_variant_get(v, '$', 'array<variant>')", "try_variant_get(v, '$', 'map<string,variant>')", "schema_of_variant(v)"
NUMBER = f"({S} IN ('BIGINT', 'DOUBLE', 'FLOAT') OR {S} LIKE 'DECIMAL%')"
LARGE = f"({S} RLIKE '^DECIMAL[(][0-9]+,0[)]$' AND try_variant_get(v, '$', 'decimal(38,0)') > 9223372036854775807)"
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Name: arguments, what it returns, body. Later ones may use those before them.
NATIVE = {
    "jl_parse": ("t STRING", "VARIANT", "try_parse_json(t)"),
    "jl_type_of": ("v VARIANT", "STRING", f"CASE WHEN is_variant_null(v) THEN 'null' WHEN {S} = 'BOOLEAN' THEN 'boolean' WHEN {NUMBER} THEN 'number' WHEN {S} LIKE 'ARRAY%' THEN 'array' WHEN {S} LIKE 'OBJECT%' THEN 'object' WHEN {S} IS NOT NULL THEN 'string' END"),
    "jl_same_kind": ("v VARIANT, w VARIANT", "BOOLEAN", "jl_type_of(v) = jl_type_of(w)"),
    **{f"jl_is_{k}": ("v VARIANT", "BOOLEAN", f"jl_type_of(v) = '{k}'") for k in ("null", "boolean", "number", "string", "array", "object")},
    "jl_as_null": ("v VARIANT", "BOOLEAN", "CASE WHEN is_variant_null(v) THEN true END"),
    "jl_as_bool": ("v VARIANT", "BOOLEAN", f"CASE WHEN {S} = 'BOOLEAN' THEN try_variant_get(v, '$', 'boolean') END"),
    "jl_as_number": ("v VARIANT", "VARIANT", "CASE WHEN jl_is_number(v) THEN v END"),
    "jl_as_i64": ("v VARIANT", "BIGINT", f"CASE WHEN {S} = 'BIGINT' THEN try_variant_get(v, '$', 'bigint') END"),
    "jl_as_u64": ("v VARIANT", "DECIMAL(20,0)", f"CASE WHEN ({S} = 'BIGINT' OR {LARGE}) AND try_variant_get(v, '$', 'decimal(38,0)') BETWEEN 0 AND 18446744073709551615 THEN CAST(try_variant_get(v, '$', 'decimal(38,0)') AS DECIMAL(20,0)) END"),
    "jl_as_f64": ("v VARIANT", "DOUBLE", "CASE WHEN jl_is_number(v) THEN try_variant_get(v, '$', 'double') END"),
    "jl_as_str": ("v VARIANT", "STRING", "CASE WHEN jl_is_string(v) THEN try_variant_get(v, '$', 'string') END"),
    "jl_is_i64": ("v VARIANT", "BOOLEAN", "CASE WHEN v IS NOT NULL THEN jl_as_i64(v) IS NOT NULL END"),
    "jl_is_u64": ("v VARIANT", "BOOLEAN", "CASE WHEN v IS NOT NULL THEN jl_as_u64(v) IS NOT NULL END"),
    "jl_is_f64": ("v VARIANT", "BOOLEAN", "jl_is_number(v)"),
    "jl_try_to_bool": ("v VARIANT", "BOOLEAN", "coalesce(jl_as_bool(v), CASE lower(jl_as_str(v)) WHEN 'true' THEN true WHEN 'false' THEN false END)"),
    "jl_try_to_i64": ("v VARIANT", "BIGINT", "coalesce(jl_as_i64(v), CAST(CAST(jl_as_bool(v) AS INT) AS BIGINT), CASE WHEN jl_as_str(v) RLIKE '^[+-]?[0-9]+$' THEN try_cast(jl_as_str(v) AS BIGINT) END)"),
    "jl_try_to_u64": (
        "v VARIANT",
        "DECIMAL(20,0)",
        "coalesce(jl_as_u64(v), CAST(CAST(jl_as_bool(v) AS INT) AS DECIMAL(20,0)), CASE WHEN jl_as_str(v) RLIKE '^[+]?[0-9]+$' AND try_cast(jl_as_str(v) AS DECIMAL(38,0)) <= 18446744073709551615 THEN try_cast(jl_as_str(v) AS DECIMAL(20,0)) END)",
    ),
    "jl_try_to_f64": (
        "v VARIANT",
        "DOUBLE",
        "coalesce(jl_as_f64(v), CAST(CAST(jl_as_bool(v) AS INT) AS DOUBLE), CASE WHEN jl_as_str(v) RLIKE '^[+-]?([0-9]+[.]?[0-9]*([eE][+-]?[0-9]+)?|[.][0-9]+([eE][+-]?[0-9]+)?)$' THEN try_cast(jl_as_str(v) AS DOUBLE) "
        "WHEN lower(jl_as_str(v)) RLIKE '^[+]?inf(inity)?$' THEN double('infinity') WHEN lower(jl_as_str(v)) RLIKE '^-inf(inity)?$' THEN double('-infinity') WHEN lower(jl_as_str(v)) RLIKE '^[+-]?nan$' THEN double('nan') END)",
    ),
    **{f"jl_to_{k}": ("v VARIANT", t, f"CASE WHEN v IS NOT NULL THEN coalesce(jl_try_to_{k}(v), raise_error('InvalidCast')) END") for k, t in (("bool", "BOOLEAN"), ("i64", "BIGINT"), ("u64", "DECIMAL(20,0)"), ("f64", "DOUBLE"))},
    "jl_array_length": ("v VARIANT", "INT", f"CASE WHEN {A} IS NOT NULL THEN size({A}) END"),
    "jl_array_values": ("v VARIANT", "ARRAY<VARIANT>", A),
    "jl_object_keys": ("v VARIANT", "ARRAY<STRING>", f"array_sort(map_keys({M}))"),
    "jl_get_by_index": ("v VARIANT, i INT", "VARIANT", f"CASE WHEN i >= 0 THEN get({A}, i) END"),
    "jl_get_by_name": ("v VARIANT, n STRING", "VARIANT", f"try_element_at({M}, n)"),
    "jl_get_by_name_ignore_case": ("v VARIANT, n STRING", "VARIANT", f"coalesce(try_element_at({M}, n), try_element_at({M}, get(array_sort(filter(map_keys({M}), k -> {LOWER.format('k')} = {LOWER.format('n')})), 0)))"),
    "jl_names": ("v VARIANT", "ARRAY<STRING>", f"coalesce(map_keys({M}), transform(filter({A}, x -> schema_of_variant(x) = 'STRING'), x -> try_variant_get(x, '$', 'string')), CASE WHEN v IS NOT NULL THEN CAST(array() AS ARRAY<STRING>) END)"),
    "jl_exists_all_keys": ("v VARIANT, ks ARRAY<STRING>", "BOOLEAN", "CASE WHEN v IS NOT NULL THEN forall(ks, k -> array_contains(jl_names(v), k)) END"),
    "jl_exists_any_keys": ("v VARIANT, ks ARRAY<STRING>", "BOOLEAN", "CASE WHEN v IS NOT NULL THEN exists(ks, k -> array_contains(jl_names(v), k)) END"),
    "jl_build_array": ("xs ARRAY<VARIANT>", "VARIANT", "to_variant_object(xs)"),
    "jl_build_object": ("ks ARRAY<STRING>, xs ARRAY<VARIANT>", "VARIANT", "to_variant_object(map_from_arrays(ks, xs))"),
    "jl_wrapped": ("v VARIANT", "ARRAY<VARIANT>", f"coalesce({A}, array(v))"),
    "jl_concat": (
        "v VARIANT, w VARIANT",
        "VARIANT",
        f"CASE WHEN v IS NULL OR w IS NULL THEN NULL WHEN {M} IS NOT NULL AND {M.replace('(v', '(w')} IS NOT NULL THEN to_variant_object(map_concat({M}, {M.replace('(v', '(w')})) ELSE to_variant_object(concat(jl_wrapped(v), jl_wrapped(w))) END",
    ),
    "jl_delete_by_name": (
        "v VARIANT, n STRING",
        "VARIANT",
        f"CASE WHEN v IS NULL THEN NULL WHEN {M} IS NOT NULL THEN to_variant_object(map_filter({M}, (k, x) -> k <> n)) WHEN {A} IS NOT NULL THEN to_variant_object(filter({A}, x -> NOT coalesce(schema_of_variant(x) = 'STRING' AND try_variant_get(x, '$', 'string') = n, false))) ELSE CAST(raise_error('InvalidJsonType') AS VARIANT) END",
    ),
    "jl_delete_by_index": ("v VARIANT, i INT", "VARIANT", f"CASE WHEN v IS NULL THEN NULL WHEN {A} IS NOT NULL THEN to_variant_object(filter({A}, (x, k) -> k <> if(i < 0, i + size({A}), i))) ELSE CAST(raise_error('InvalidJsonType') AS VARIANT) END"),
    "jl_array_insert": (
        "v VARIANT, i INT, x VARIANT",
        "VARIANT",
        "CASE WHEN v IS NOT NULL AND x IS NOT NULL AND i IS NOT NULL THEN to_variant_object(concat(slice(jl_wrapped(v), 1, least(greatest(if(i < 0, i + size(jl_wrapped(v)), i), 0), size(jl_wrapped(v)))), array(x), "
        "slice(jl_wrapped(v), least(greatest(if(i < 0, i + size(jl_wrapped(v)), i), 0), size(jl_wrapped(v))) + 1, size(jl_wrapped(v))))) END",
    ),
    "jl_object_insert": (
        "v VARIANT, n STRING, x VARIANT, overwrite BOOLEAN",
        "VARIANT",
        f"CASE WHEN v IS NULL OR n IS NULL OR x IS NULL THEN NULL WHEN {M} IS NULL THEN CAST(raise_error('InvalidObject') AS VARIANT) WHEN NOT overwrite AND map_contains_key({M}, n) THEN CAST(raise_error('ObjectDuplicateKey') AS VARIANT) ELSE to_variant_object(map_concat({M}, map(n, x))) END",
    ),
    "jl_object_delete": ("v VARIANT, ks ARRAY<STRING>", "VARIANT", f"CASE WHEN v IS NULL THEN NULL WHEN {M} IS NULL THEN CAST(raise_error('InvalidObject') AS VARIANT) ELSE to_variant_object(map_filter({M}, (k, x) -> NOT array_contains(ks, k))) END"),
    "jl_object_pick": ("v VARIANT, ks ARRAY<STRING>", "VARIANT", f"CASE WHEN v IS NULL THEN NULL WHEN {M} IS NULL THEN CAST(raise_error('InvalidObject') AS VARIANT) ELSE to_variant_object(map_filter({M}, (k, x) -> array_contains(ks, k))) END"),
}

#: Table functions: a row for each member, or for each element with its place.
TABLES = {
    "jl_object_each": ("key STRING, value VARIANT", f"SELECT m.key, m.value FROM (SELECT explode({M}) AS (key, value)) m"),
    "jl_array_each": ("pos INT, value VARIANT", f"SELECT e.pos, e.value FROM (SELECT posexplode({A}) AS (pos, value)) e"),
}


def _mixed(hits: list) -> values.Value:
    return J.MISSING if not hits else hits[0] if len(hits) == 1 else hits


def _strings(v: values.Value, text: str) -> bool:
    return documents.any_string(v, lambda s: s == text)


def _error_of(text: str) -> str | None:
    try:
        values.parse(text)
    except JsonError as e:
        return str(e)
    return None


def _number_or_text(v: values.Value, strict: bool) -> str | None:
    return None if not strict and (v is None or isinstance(v, (list, dict))) else documents.text_of(v)


DOC, TEXT, FLAG, BYTES = J.DOCUMENT, StringType(), BooleanType(), BinaryType()
#: Name: what it does to rows, what it returns, whether what is wrong is an error.
IN_BATCHES = {
    "jl_parse_lenient": (values.parse, DOC, False),
    "jl_parse_error": (_error_of, TEXT, True),
    "jl_to_string": (values.render, TEXT, True),
    "jl_to_pretty_string": (lambda v: values.render(v, pretty=True), TEXT, True),
    "jl_to_json": (lambda v: values.render(values.plain(v)), TEXT, True),
    "jl_to_str": (lambda v: _number_or_text(v, True), TEXT, True),
    "jl_try_to_str": (lambda v: _number_or_text(v, False), TEXT, True),
    "jl_encode": (values.encode, BYTES, True),
    "jl_decode": (J.decoder(True), DOC, True),
    "jl_try_decode": (J.decoder(True), DOC, False),
    "jl_compare": (values.compare, IntegerType(), True),
    "jl_sort_key": (values.sort_key, BYTES, True),
    "jl_order_key": (values.order_bytes, BYTES, True),
    "jl_contains": (documents.contains, FLAG, True),
    "jl_traverse_check_string": (_strings, FLAG, True),
    "jl_strip_nulls": (documents.strip_nulls, DOC, True),
    "jl_array_distinct": (documents.array_distinct, DOC, True),
    "jl_array_intersection": (documents.array_intersection, DOC, True),
    "jl_array_except": (documents.array_except, DOC, True),
    "jl_array_overlap": (documents.array_overlap, FLAG, True),
    "jl_delete_by_keypath": (lambda v, p: documents.delete_by_keypath(v, parse_key_path(p)), DOC, True),
    "jl_get_by_keypath": (lambda v, p: (lambda ok, x: x if ok else J.MISSING)(*evaluate.get_key(v, parse_key_path(p))), DOC, True),
    "jl_get_by_path": (lambda v, p: _mixed(evaluate.select(parse_path(p), v)), DOC, True),
    "jl_get_by_path_first": (lambda v, p: next(iter(evaluate.select(parse_path(p), v)), J.MISSING), DOC, True),
    "jl_get_by_path_array": (lambda v, p: evaluate.select(parse_path(p), v), DOC, True),
    "jl_path_exists": (lambda v, p: evaluate.exists(parse_path(p), v), FLAG, True),
    "jl_path_match": (lambda v, p: evaluate.match(parse_path(p), v), FLAG, True),
    "jl_path_text": (lambda p: str(parse_path(p)), TEXT, True),
    "jl_key_path_text": (lambda p: str(parse_key_path(p)), TEXT, True),
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def register(spark: SparkSession) -> None:
    """Register all functions that take columns alone."""
    configure(spark)
    for name, (args, returns, body) in NATIVE.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
    for name, (returns, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(v VARIANT) RETURNS TABLE({returns}) RETURN {body}")
    for name, (f, returns, strict) in IN_BATCHES.items():
        spark.udf.register(name, J.vectorised(f, returns, strict))
