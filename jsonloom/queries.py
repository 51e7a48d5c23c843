"""Registered queries over the JSON functions, each with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import functions as J
from . import operators as R
from . import sources, sql, streaming
from .sql import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(configure(spark), sf_dir)

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- documents made of rows


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, event_type, ts and the parsed props."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "user_id", "ts", J.parse("props").alias("doc"))


def event_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and {"id", "type", "user", "props"}."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    doc = F.to_variant_object(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.col("user_id").alias("user"), F.parse_json("props").alias("props")))
    return e.select(F.col("event_id").alias("id"), doc.alias("doc"))


def user_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, event_type and {"props", "user"}."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", "event_type", J.build_object(user=J.from_native("user_id"), props=J.parse("props")).alias("doc"))


def order_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and {"items": [{"flag", "n", "part"}, ...], "key", "status"}, items sorted by number, part and flag."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag")).alias("item"))
    items = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("item")).alias("items"))
    doc = F.to_variant_object(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), "items"))
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("id"), doc.alias("doc"))


def sparse_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and {"seg": segment, or null for every third customer, "nation": key}."""
    seg = F.when(F.col("c_custkey") % 3 == 0, F.parse_json(F.lit("null"))).otherwise(J.from_native("c_mktsegment"))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.col("c_custkey").alias("id"), J.build_object(seg=seg, nation=J.from_native("c_nationkey")).alias("doc"))


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, and the return flags of an order's first and other lines as arrays a and b."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    one = lambda test: F.to_variant_object(F.sort_array(F.collect_list(F.when(test, F.col("l_returnflag")))))
    return lines.groupBy(F.col("l_orderkey").alias("id")).agg(one(F.col("l_linenumber") <= 3).alias("a"), one(F.col("l_linenumber") > 1).alias("b"))


#: Texts of documents of all kinds, in SQL that both engines read; 5 and 5.0 among them, names out of order, deep ones.
MIXED_TEXT = (
    "CASE event_id % 9 WHEN 0 THEN 'null' WHEN 1 THEN concat('[', event_id % 50, ',\"x\"]') WHEN 2 THEN concat('{\"b\":{\"c\":', event_id % 50, '},\"a\":[]}') "
    "WHEN 3 THEN concat('\"s', lpad(concat('', event_id % 50), 2, '0'), '\"') WHEN 4 THEN concat('', event_id % 50) WHEN 5 THEN concat(event_id % 50, '.5') WHEN 6 THEN concat(event_id % 50, '.0') WHEN 7 THEN 'true' ELSE 'false' END"
)
#: Texts of objects whose members differ by row.
PARTLY_TEXT = (
    "concat('{\"id\":', event_id, CASE WHEN event_id % 2 = 0 THEN ',\"even\":true' ELSE '' END, CASE WHEN event_id % 3 = 0 THEN ',\"Third\":null' ELSE '' END, "
    "CASE WHEN event_id % 5 = 0 THEN concat(',\"type\":\"', event_type, '\"') ELSE '' END, '}')"
)


def mixed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and a document of any kind."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), J.parse(F.expr(MIXED_TEXT)).alias("doc"))


def partly_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and an object with some of the members id, even, Third, type."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), J.parse(F.expr(PARTLY_TEXT)).alias("doc"))


def multisets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, and arrays a and b with repeated, null and nested elements, and with 1 beside 1.0."""
    k = F.col("event_id") % 3
    a = F.concat(F.lit("["), k, F.lit(',1,1.0,null,null,{"x":'), k, F.lit("}]"))
    b = F.concat(F.lit('[1,null,{"x":'), F.col("event_id") % 2, F.lit("},"), k, F.lit("]"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), J.parse(a).alias("a"), J.parse(b).alias("b"))


MIXED = f"t AS (SELECT event_id AS id, event_id % 9 AS kind, event_id % 50 AS k, {MIXED_TEXT} AS t FROM events)"
#: Canonical text, level and number within a level.
RANKED = (
    f"{MIXED}, r AS (SELECT id, t, CASE WHEN kind = 2 THEN concat('{{\"a\":[],\"b\":{{\"c\":', k, '}}}}') ELSE t END AS canon, CASE json_type(t) WHEN 'NULL' THEN 7 WHEN 'ARRAY' THEN 6 WHEN 'OBJECT' THEN 5 WHEN 'VARCHAR' THEN 4 WHEN 'BOOLEAN' THEN CASE t WHEN 'true' THEN 2 ELSE 1 END ELSE 3 END AS level, "
    "CASE WHEN kind IN (0, 7, 8) THEN 0 WHEN kind = 5 THEN k + 0.5 ELSE k END AS num FROM t)"
)
PARTLY = f"t AS (SELECT event_id AS id, {PARTLY_TEXT} AS t FROM events)"
MULTISETS = (
    "m AS (SELECT event_id AS id, [CAST(event_id % 3 AS VARCHAR), '1', '1.0', 'null', 'null', concat('{\"x\":', event_id % 3, '}')] AS a, ['1', 'null', concat('{\"x\":', event_id % 2, '}'), CAST(event_id % 3 AS VARCHAR)] AS b FROM events), "
    "u AS (SELECT id, b, unnest(a) AS x, generate_subscripts(a, 1) AS pos FROM m), n AS (SELECT id, x, pos, row_number() OVER (PARTITION BY id, x ORDER BY pos) AS nth, len(list_filter(b, lambda y: y = x)) AS there FROM u)"
)
ITEMS = "items AS (SELECT l_orderkey AS id, list_sort(list({'n': l_linenumber, 'part': l_partkey, 'flag': l_returnflag})) AS items FROM lineitem GROUP BY 1), docs AS (SELECT id, o_orderstatus AS status, items FROM items JOIN orders ON o_orderkey = id)"
EVENTS = "e AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"
SPARSE = "s AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS seg, c_nationkey AS nation FROM customer)"
FLAGS = "f AS (SELECT l_orderkey AS id, coalesce(list_sort(list(l_returnflag) FILTER (l_linenumber <= 3)), []) AS a, coalesce(list_sort(list(l_returnflag) FILTER (l_linenumber > 1)), []) AS b FROM lineitem GROUP BY 1)"


def lit(text: str) -> Column:
    return F.parse_json(F.lit(text))


# ---------------------------------------------------------------- selection


@query(f"WITH {EVENTS} SELECT event_type, count(*) AS n, CAST(sum(k) AS BIGINT) AS sum_k FROM e WHERE k > 50 GROUP BY 1")
def events_by_json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose document has k > 50, counted and summed by type."""
    hot = events(spark, sf_dir).where(J.path_match("doc", "$.k > 50"))
    return hot.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(J.to_i64(J.get_by_path_first("doc", "$.k"))).alias("sum_k"))


@query("SELECT event_id, CASE json_type(props) WHEN 'OBJECT' THEN 'object' END AS kind, CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') THEN 'number' END AS k_kind FROM events")
def parse_and_type_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", J.type_of("doc").alias("kind"), J.type_of(J.get_by_name("doc", "k")).alias("k_kind"))


@query("SELECT event_id AS id, event_type AS type, user_id AS user_id FROM events")
def get_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_docs(spark, sf_dir).select("id", J.as_str(J.get_by_name("doc", "type")).alias("type"), J.as_i64(J.get_by_name("doc", "user")).alias("user_id"))


@query("SELECT event_id AS id, event_type AS type, CAST(NULL AS VARCHAR) AS exact FROM events")
def get_by_name_ignore_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_docs(spark, sf_dir).select("id", J.as_str(J.get_by_name("doc", "TYPE", ignore_case=True)).alias("type"), J.as_str(J.get_by_name("doc", "TYPE")).alias("exact"))


@query(f"WITH {ITEMS} SELECT id, items[1].part AS first_part, coalesce(items[4].part, -1) AS fourth_part FROM docs")
def get_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda i: J.as_i64(J.get_by_name(J.get_by_index(J.get_by_name("doc", "items"), i), "part"))
    return order_docs(spark, sf_dir).select("id", part(0).alias("first_part"), F.coalesce(part(3), F.lit(-1)).alias("fourth_part"))


@query(f"WITH {ITEMS} SELECT id, items[-1].flag AS last_flag, coalesce(items[2].part, -1) AS second_part FROM docs")
def get_by_keypath(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_docs(spark, sf_dir).select("id", J.as_str(J.get_by_keypath("doc", "{items,-1,flag}")).alias("last_flag"), F.coalesce(J.as_i64(J.get_by_keypath("doc", '{"items",1,part}')), F.lit(-1)).alias("second_part"))


@query(f"WITH {ITEMS} SELECT id, items[1].part AS part, items[-1].flag AS last_flag FROM docs")
def get_by_path_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_docs(spark, sf_dir).select("id", J.as_i64(J.get_by_path_first("doc", "$.items[*].part")).alias("part"), J.as_str(J.get_by_path_first("doc", "$.items[last].flag")).alias("last_flag"))


@query(f"WITH {ITEMS} SELECT id, '[' || array_to_string(list_transform(items[1:2], lambda x: x.part), ',') || ']' AS parts FROM docs")
def get_by_path_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_docs(spark, sf_dir).select("id", F.to_json(J.get_by_path_array("doc", "$.items[0 to 1].part")).alias("parts"))


@query(f"WITH {ITEMS} SELECT id, CASE WHEN len(items) = 1 THEN CAST(items[1].n AS VARCHAR) ELSE '[' || array_to_string(list_transform(items, lambda x: x.n), ',') || ']' END AS numbers FROM docs")
def get_by_path_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_docs(spark, sf_dir).select("id", F.to_json(J.get_by_path("doc", "items[*].n")).alias("numbers"))


@query("SELECT l_orderkey AS id, l_partkey AS part FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def get_by_path_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.explode_path(order_docs(spark, sf_dir), "doc", "$.items[*].part", "hit").select("id", J.as_i64("hit").alias("part"))


@query("SELECT l_orderkey AS id, l_partkey AS part FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND l_linenumber > 2")
def path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.explode_path(order_docs(spark, sf_dir), "doc", '$.items[*]?(@.flag == "R" && @.n > 2).part', "hit").select("id", J.as_i64("hit").alias("part"))


@query(f"WITH {ITEMS} SELECT id FROM docs WHERE len(list_filter(items, lambda x: x.flag = 'N')) > 0 AND len(items) > 0")
def path_filter_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_docs(spark, sf_dir).where(F.isnotnull(J.get_by_path_first("doc", '$?(exists(@.items[*]?(@.flag == "N")))'))).select("id")


@query(f"WITH {ITEMS} SELECT id, len(items) > 3 AS has_fourth, true AS predicate FROM docs")
def path_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_docs(spark, sf_dir).select("id", J.path_exists("doc", "$.items[3]").alias("has_fourth"), J.path_exists("doc", "$.key < 0").alias("predicate"))


@query(f"WITH {ITEMS} SELECT id, status = 'F' OR len(list_filter(items, lambda x: x.n = 6)) > 0 AS matches, len(list_filter(items, lambda x: x.part > id)) > 0 AS above FROM docs")
def path_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_docs(spark, sf_dir).select("id", J.path_match("doc", '$.status == "F" || $.items[*].n == 6').alias("matches"), J.path_match("doc", "$.items[*].part > $.key").alias("above"))


@query(f"WITH {EVENTS} SELECT event_id AS id, '[' || event_id || ',{{\"k\":' || k || '}},\"' || event_type || '\",' || user_id || ']' AS members FROM e")
def path_wildcard_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_docs(spark, sf_dir).select("id", F.to_json(J.get_by_path_array("doc", "$.*")).alias("members"))


@query(f"WITH {EVENTS} SELECT event_id AS id, event_type AS colon, event_type AS bracket, event_type AS quoted, event_type AS bare, k AS deep, '{{\"id\":' || event_id || ',\"props\":{{\"k\":' || k || '}},\"type\":\"' || event_type || '\",\"user\":' || user_id || '}}' AS empty FROM e")
def path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A member's name after a colon, in brackets, quoted and bare; and the empty path, which is the document."""
    text = lambda p: J.as_str(J.get_by_path_first("doc", p))
    return event_docs(spark, sf_dir).select(
        "id", text("$:type").alias("colon"), text('$["type"]').alias("bracket"), text('$."type"').alias("quoted"), text("type").alias("bare"), J.as_i64(J.get_by_path_first("doc", '$["props"]:k')).alias("deep"), J.to_string(J.get_by_path_first("doc", "")).alias("empty")
    )


@query(f"WITH {ITEMS} SELECT id, '[]' AS negative, items[1].part AS no_root, CASE WHEN len(items) > 1 THEN '[' || items[-2].part || ']' ELSE '[]' END AS before_last, items[len(items)].n AS lax FROM docs")
def path_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A negative place hits nothing; a path may begin with a step; ``[*]`` lets other documents pass."""
    d = order_docs(spark, sf_dir).select("id", "doc", J.get_by_name("doc", "items").alias("items"))
    return d.select(
        "id", F.to_json(J.get_by_path_array("items", "$[-1].part")).alias("negative"), J.as_i64(J.get_by_path_first("items", "[0].part")).alias("no_root"),
        F.to_json(J.get_by_path_array("items", "$[last - 1].part")).alias("before_last"), J.as_i64(J.get_by_path_first("doc", "$[*].items[last].n[*]")).cast("int").alias("lax"),
    )


@query("SELECT event_id AS id, user_id < value AS number_below, true AS text_above_number, value >= user_id AS mirrored, event_type >= 'purchase' AS text, event_id < user_id AS whole FROM events")
def path_value_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of values in predicates, by kind first."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    doc = J.build_object(id=J.from_native("event_id"), u=J.from_native("user_id"), v=J.from_native("value"), t=J.from_native("event_type"))
    e = e.select(F.col("event_id").alias("id"), doc.alias("doc"))
    test = lambda p: J.path_match("doc", p)
    return e.select("id", test("$.u < $.v").alias("number_below"), test("$.t > $.v").alias("text_above_number"), test("$.v >= $.u").alias("mirrored"), test('$.t >= "purchase"').alias("text"), test("$.id < $.u").alias("whole"))


@query(f"WITH {EVENTS} SELECT event_id AS id, '$.' || event_type || '[*]?(@.k > ' || k || ' && exists(@.u)).v' AS chain, '$.k + ' || k AS sum, '$.k == ' || k || ' || $.t != \"' || event_type || '\"' AS predicate, '{{' || event_type || ',' || k || ',\"q\"}}' AS keys FROM e")
def path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths as they are printed, arithmetic among them; and key paths."""
    k, kind = J.as_i64(J.get_by_path_first("doc", "$.k")).cast("string"), F.col("event_type")
    say = lambda *parts: J.path_text(F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]))
    return events(spark, sf_dir).select(
        F.col("event_id").alias("id"), say("$.", kind, " [ * ] ? (@.k>", k, "&&exists( @.u )).v").alias("chain"), say("$.k  +", k).alias("sum"), say("$.k==", k, '||$.t<>"', kind, '"').alias("predicate"),
        J.key_path_text(F.concat(F.lit("{ "), kind, F.lit(" , "), k, F.lit(', "q" }'))).alias("keys"),
    )


@query("SELECT event_id AS id, CAST(CASE event_type WHEN 'click' THEN event_id ELSE user_id END AS BIGINT) AS value FROM events")
def path_from_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(J.as_str(J.get_by_name("doc", "type")) == "click", "$.id").otherwise("$.user")
    return event_docs(spark, sf_dir).select("id", J.as_i64(J.get_by_path_first("doc", path)).alias("value"))


# ---------------------------------------------------------------- access


@query(f"WITH {PARTLY} SELECT id, array_to_string(list_sort(json_keys(t)), ',') AS keys FROM t")
def object_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partly_docs(spark, sf_dir).select("id", F.array_join(J.object_keys("doc"), ",").alias("keys"))


@query(
    f"WITH {EVENTS} SELECT event_id AS id, 'id' AS key, CAST(event_id AS VARCHAR) AS value FROM e UNION ALL SELECT event_id, 'user', CAST(user_id AS VARCHAR) FROM e "
    "UNION ALL SELECT event_id, 'type', '\"' || event_type || '\"' FROM e UNION ALL SELECT event_id, 'props', '{\"k\":' || k || '}' FROM e"
)
def object_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.explode_members(event_docs(spark, sf_dir), "doc").select("id", "key", F.to_json("value").alias("value"))


@query(f"WITH {ITEMS}, u AS (SELECT id, unnest(items) AS item, generate_subscripts(items, 1) - 1 AS pos FROM docs) SELECT id, CAST(pos AS INTEGER) AS pos, item.part AS part FROM u")
def array_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.explode_elements(order_docs(spark, sf_dir).select("id", J.get_by_name("doc", "items").alias("items")), "items")
    return out.select("id", "pos", J.as_i64(J.get_by_name("value", "part")).alias("part"))


@query(f"WITH {ITEMS} SELECT id, CAST(len(items) AS INTEGER) AS n, true AS none_of_object FROM docs")
def array_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_docs(spark, sf_dir).select("id", J.array_length(J.get_by_name("doc", "items")).alias("n"), F.isnull(J.array_length("doc")).alias("none_of_object"))


# ---------------------------------------------------------------- predicates


@query(f"WITH {ITEMS} SELECT id, status = 'O' AS status_o, len(list_filter(items, lambda x: x.flag = 'A')) > 0 AS has_a FROM docs")
def contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_docs(spark, sf_dir).select("id", J.contains("doc", J.document('{"status":"O"}')).alias("status_o"), J.contains("doc", J.document('{"items":[{"flag":"A"}]}')).alias("has_a"))


@query("SELECT event_id AS id, event_type = 'view' AND (event_id % 2 = 0) = (event_id % 3 = 0) AS holds FROM events")
def contains_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The right side differs by row."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    flag = lambda n: (F.col("event_id") % n == 0).cast("string")
    left = J.parse(F.concat(F.lit('{"t":["'), "event_type", F.lit('",{"even":'), flag(2), F.lit(',"more":1}]}')))
    right = J.parse(F.concat(F.lit('{"t":["view",{"even":'), flag(3), F.lit("}]}")))
    return e.select(F.col("event_id").alias("id"), J.contains(left, right).alias("holds"))


@query(f"WITH {PARTLY} SELECT id, list_has_all(json_keys(t), ['even', 'Third']) AS all_keys, list_has_all(json_keys(t), ['id', 'x']) AS more_keys, list_has_all(json_keys(t), CAST([] AS VARCHAR[])) AS no_keys FROM t")
def exists_all_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partly_docs(spark, sf_dir).select("id", J.exists_all_keys("doc", ["even", "Third"]).alias("all_keys"), J.exists_all_keys("doc", ["id", "x"]).alias("more_keys"), J.exists_all_keys("doc", []).alias("no_keys"))


@query(f"WITH {FLAGS} SELECT id, list_contains(a, 'R') OR list_contains(a, 'X') AS any_key FROM f")
def exists_any_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags(spark, sf_dir).select("id", J.exists_any_keys("a", ["R", "X"]).alias("any_key"))


@query(f"WITH {SPARSE} SELECT id, coalesce(seg = 'BUILDING', false) AS building, true AS has_name FROM s")
def traverse_check_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_docs(spark, sf_dir).select("id", J.traverse_check_string("doc", lambda s: s == "BUILDING").alias("building"), J.traverse_check_string("doc", lambda s: s == "nation").alias("has_name"))


# ---------------------------------------------------------------- kinds and casts


@query(
    f"WITH {MIXED}, j AS (SELECT id, t, json_type(t) AS j FROM t) SELECT id, j = 'NULL' AS a_null, j = 'VARCHAR' AS a_string, j IN ('UBIGINT', 'BIGINT', 'DOUBLE') AS a_number, j IN ('UBIGINT', 'BIGINT') AS an_i64, "
    "j IN ('UBIGINT', 'BIGINT') AS a_u64, j IN ('UBIGINT', 'BIGINT', 'DOUBLE') AS an_f64, j = 'BOOLEAN' AS a_boolean, j = 'OBJECT' AS an_object, j = 'ARRAY' AS an_array FROM j"
)
def is_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_docs(spark, sf_dir).select(
        "id", J.is_null("doc").alias("a_null"), J.is_string("doc").alias("a_string"), J.is_number("doc").alias("a_number"), J.is_i64("doc").alias("an_i64"), J.is_u64("doc").alias("a_u64"),
        J.is_f64("doc").alias("an_f64"), J.is_boolean("doc").alias("a_boolean"), J.is_object("doc").alias("an_object"), J.is_array("doc").alias("an_array"),
    )


@query(f"WITH {MIXED} SELECT a.id, (CASE WHEN json_type(a.t) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'NUMBER' ELSE json_type(a.t) END) = (CASE WHEN json_type(b.t) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'NUMBER' ELSE json_type(b.t) END) AS same FROM t a JOIN t b ON b.id = a.id + 1")
def same_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an event's document is of the kind of the next one's."""
    a, b = mixed_docs(spark, sf_dir), mixed_docs(spark, sf_dir).select((F.col("id") - 1).alias("id"), F.col("doc").alias("next"))
    return a.join(b, "id").select("id", J.same_kind("doc", "next").alias("same"))


@query(f"WITH {MIXED}, j AS (SELECT id, t, json_type(t) AS j FROM t) SELECT id, CASE WHEN j = 'BOOLEAN' THEN t = 'true' END AS bool, CASE WHEN j IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN t END AS number, CASE WHEN j IN ('UBIGINT', 'BIGINT') THEN t END AS u64, CASE WHEN j IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(t AS DOUBLE) END AS f64, CASE WHEN j = 'VARCHAR' THEN json_extract_string(t, '$') END AS str FROM j")
def as_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_docs(spark, sf_dir).select("id", J.as_bool("doc").alias("bool"), J.to_string(J.as_number("doc")).alias("number"), J.as_u64("doc").cast("string").alias("u64"), J.as_f64("doc").alias("f64"), J.as_str("doc").alias("str"))


@query("SELECT event_id AS id, CAST(CAST(9223372036854775800 AS HUGEINT) + event_id AS VARCHAR) AS u64, CAST(CASE WHEN event_id < 8 THEN 9223372036854775800 + event_id END AS BIGINT) AS i64, CAST(event_id AS VARCHAR) AS from_text, event_id > 7 AS above FROM events")
def to_u64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers on both sides of the largest one with a sign."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"))
    big = J.parse((F.col("id").cast("decimal(20,0)") + F.lit(9223372036854775800)).cast("string"))
    made = e.select("id", J.build_object(n=big).alias("doc"), J.from_native(F.col("id").cast("string")).alias("text"))
    n = J.get_by_name("doc", "n")
    return made.select("id", J.to_u64(n).cast("string").alias("u64"), J.try_to_i64(n).alias("i64"), J.to_u64("text").cast("string").alias("from_text"), J.path_match("doc", "$.n > 9223372036854775807").alias("above"))


@query(f"WITH {SPARSE} SELECT id, seg IS NULL AS seg_null, seg AS seg_str, CAST(nation AS BIGINT) AS i64, CAST(nation AS DOUBLE) AS f64, CAST(nation AS VARCHAR) AS u64, true AS no_bool FROM s")
def as_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg, nation = J.get_by_name("doc", "seg"), J.get_by_name("doc", "nation")
    return sparse_docs(spark, sf_dir).select("id", F.coalesce(J.as_null(seg), F.lit(False)).alias("seg_null"), J.as_str(seg).alias("seg_str"), J.as_i64(nation).alias("i64"), J.as_f64(nation).alias("f64"), J.as_u64(nation).cast("string").alias("u64"), F.isnull(J.as_bool(nation)).alias("no_bool"))


@query("SELECT event_id AS id, CAST(event_id AS BIGINT) AS i64, CAST(event_id AS DOUBLE) AS f64, event_id % 2 = 0 AS flag, CAST(event_id AS VARCHAR) AS str, true AS no_i64 FROM events")
def to_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = event_docs(spark, sf_dir).select("id", "doc", J.from_native(F.col("id").cast("string")).alias("text"), J.from_native(F.when(F.col("id") % 2 == 0, "TRUE").otherwise("False")).alias("flag"))
    return made.select("id", J.to_i64("text").alias("i64"), J.to_f64("text").alias("f64"), J.to_bool("flag").alias("flag"), J.to_str(J.get_by_name("doc", "id")).alias("str"), F.isnull(J.try_to_i64("doc")).alias("no_i64"))


# ---------------------------------------------------------------- construction and change


@query("SELECT o_orderkey AS id, '[' || o_orderkey || ',\"' || o_orderstatus || '\",null]' AS doc FROM orders")
def build_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("id"), F.to_json(J.build_array(J.from_native("o_orderkey"), J.from_native("o_orderstatus"), lit("null"))).alias("doc"))


@query("SELECT o_orderkey AS id, '{\"key\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\"}' AS doc FROM orders")
def build_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("id"), F.to_json(J.build_object(status=J.from_native("o_orderstatus"), key=J.from_native("o_orderkey"))).alias("doc"))


@query("SELECT n_regionkey AS id, '[' || string_agg('\"' || n_name || '\"', ',' ORDER BY n_nationkey) || ']' AS doc FROM nation GROUP BY 1")
def json_array_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").withColumn("name", J.from_native("n_name"))
    return n.groupBy(F.col("n_regionkey").alias("id")).agg(F.to_json(R.json_array_agg("name", "n_nationkey")).alias("doc"))


@query("SELECT n_regionkey AS id, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS doc FROM nation GROUP BY 1")
def json_object_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").withColumn("key", J.from_native("n_nationkey"))
    return n.groupBy(F.col("n_regionkey").alias("id")).agg(F.to_json(R.json_object_agg("n_name", "key", "n_nationkey")).alias("doc"))


@query(f"WITH {EVENTS} SELECT event_id AS id, '{{\"id\":-1,\"new\":true,\"props\":{{\"k\":' || k || '}},\"type\":\"' || event_type || '\",\"user\":' || user_id || '}}' AS doc FROM e")
def concat_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_docs(spark, sf_dir).select("id", F.to_json(J.concat("doc", lit('{"new":true,"id":-1}'))).alias("doc"))


@query(f"WITH {FLAGS} SELECT id, list_concat(a, b, ['Z']) AS doc FROM f")
def concat_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = J.concat(J.concat("a", "b"), lit('"Z"'))
    return flags(spark, sf_dir).select("id", F.transform(J.array_values(both), lambda x: J.as_str(x)).alias("doc"))


@query(f"WITH {FLAGS} SELECT id, list_filter(a, lambda x: x <> 'R') AS doc FROM f")
def delete_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags(spark, sf_dir).select("id", F.transform(J.array_values(J.delete_by_name("a", "R")), lambda x: J.as_str(x)).alias("doc"))


@query(f"WITH {FLAGS} SELECT id, CASE WHEN len(b) > 0 THEN b[1:len(b) - 1] ELSE b END AS doc FROM f")
def delete_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags(spark, sf_dir).select("id", F.transform(J.array_values(J.delete_by_index("b", -1)), lambda x: J.as_str(x)).alias("doc"))


@query("SELECT event_id AS id, '{\"id\":' || event_id || ',\"props\":{},\"type\":\"' || event_type || '\",\"user\":' || user_id || '}' AS doc FROM events")
def delete_by_keypath(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_docs(spark, sf_dir).select("id", J.to_string(J.delete_by_keypath("doc", "{props,k}")).alias("doc"))


@query(f"WITH {FLAGS} SELECT id, list_concat(b[1:greatest(len(b) - 1, 0)], ['Z'], b[greatest(len(b), 1):]) AS doc FROM f")
def array_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags(spark, sf_dir).select("id", F.transform(J.array_values(J.array_insert("b", -1, lit('"Z"'))), lambda x: J.as_str(x)).alias("doc"))


@query(f"WITH {SPARSE} SELECT id, '{{\"extra\":1,\"nation\":0,\"seg\":' || coalesce('\"' || seg || '\"', 'null') || '}}' AS doc FROM s")
def object_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = J.object_insert(J.object_insert("doc", "extra", lit("1")), "nation", lit("0"), update=True)
    return sparse_docs(spark, sf_dir).select("id", F.to_json(more).alias("doc"))


@query(f"WITH {SPARSE} SELECT id, '{{\"nation\":' || nation || '}}' AS doc FROM s")
def object_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_docs(spark, sf_dir).select("id", F.to_json(J.object_delete("doc", ["seg", "none"])).alias("doc"))


@query(f"WITH {SPARSE} SELECT id, '{{\"seg\":' || coalesce('\"' || seg || '\"', 'null') || '}}' AS doc FROM s")
def object_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_docs(spark, sf_dir).select("id", F.to_json(J.object_pick("doc", ["seg", "none"])).alias("doc"))


@query(f"WITH {SPARSE} SELECT id, '{{\"nation\":' || nation || coalesce(',\"seg\":\"' || seg || '\"', '') || '}}' AS doc FROM s")
def strip_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_docs(spark, sf_dir).select("id", J.to_string(J.strip_nulls("doc")).alias("doc"))


# ---------------------------------------------------------------- arrays as multisets


@query(f"WITH {FLAGS} SELECT id, list_sort(list_distinct(a)) AS doc FROM f")
def array_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags(spark, sf_dir).select("id", F.transform(J.array_values(J.array_distinct("a")), lambda x: J.as_str(x)).alias("doc"))


COUNTS = f"WITH {FLAGS}, c AS (SELECT id, a, b, unnest(['A', 'N', 'R']) AS x FROM f), n AS (SELECT id, x, len(list_filter(a, lambda y: y = x)) AS p, len(list_filter(b, lambda y: y = x)) AS q FROM c)"


@query(f"{COUNTS} SELECT id, string_agg(repeat(x, CAST(least(p, q) AS BIGINT)), '' ORDER BY x) AS doc FROM n GROUP BY id")
def array_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags(spark, sf_dir).select("id", F.array_join(F.transform(J.array_values(J.array_intersection("a", "b")), lambda x: J.as_str(x)), "").alias("doc"))


@query(f"{COUNTS} SELECT id, string_agg(repeat(x, CAST(greatest(p - q, 0) AS BIGINT)), '' ORDER BY x) AS doc FROM n GROUP BY id")
def array_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags(spark, sf_dir).select("id", F.array_join(F.transform(J.array_values(J.array_except("a", "b")), lambda x: J.as_str(x)), "").alias("doc"))


@query(f"WITH {MULTISETS} SELECT id, '[' || string_agg(x, ',' ORDER BY pos) FILTER (nth = 1) || ']' AS once, '[' || coalesce(string_agg(x, ',' ORDER BY pos) FILTER (nth <= there), '') || ']' AS both, '[' || coalesce(string_agg(x, ',' ORDER BY pos) FILTER (nth > there), '') || ']' AS rest, coalesce(bool_or(there > 0), false) AS overlap FROM n GROUP BY id")
def multisets_of_mixed_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = multisets(spark, sf_dir)
    return m.select("id", J.to_string(J.array_distinct("a")).alias("once"), J.to_string(J.array_intersection("a", "b")).alias("both"), J.to_string(J.array_except("a", "b")).alias("rest"), J.array_overlap("a", "b").alias("overlap"))


@query(f"WITH {FLAGS} SELECT id, list_has_any(a, b) AS overlap FROM f")
def array_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags(spark, sf_dir).select("id", J.array_overlap("a", "b").alias("overlap"))


# ---------------------------------------------------------------- order, groups, joins, sets


@query(f"WITH {EVENTS} SELECT event_id, CAST(sign(k - 50) AS INTEGER) AS c FROM e")
def compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", J.compare("doc", lit('{"k":50}')).alias("c"))


@query(f"WITH {EVENTS} SELECT event_id, k FROM e ORDER BY k DESC, event_id LIMIT 20")
def order_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", "doc", J.sort_key("doc").alias("key")).orderBy(F.desc("key"), "event_id").limit(20)
    return e.select("event_id", J.as_i64(J.get_by_name("doc", "k")).alias("k"))


@query(f"WITH {RANKED} SELECT a.id, CAST(sign(CASE WHEN a.level <> b.level THEN a.level - b.level ELSE a.num - b.num END) AS INTEGER) AS c FROM r a JOIN r b ON b.id = a.id + 1")
def compare_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event's document of any kind against the next one's."""
    a, b = mixed_docs(spark, sf_dir), mixed_docs(spark, sf_dir).select((F.col("id") - 1).alias("id"), F.col("doc").alias("next"))
    return a.join(b, "id").select("id", J.compare("doc", "next").alias("c"))


@query("SELECT event_id AS id, CAST(sign(CAST(user_id AS DOUBLE) - value) AS INTEGER) AS c, CAST(sign(user_id - event_id) AS INTEGER) AS whole FROM events")
def compare_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    user = J.from_native("user_id")
    return e.select(F.col("event_id").alias("id"), J.compare(user, J.from_native("value")).alias("c"), J.compare(user, J.from_native("event_id")).alias("whole"))


@query(f"WITH {RANKED} SELECT id, canon AS doc FROM r ORDER BY level DESC, num DESC, id LIMIT 2000")
def order_by_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top 2000 of documents of all kinds."""
    return R.order_by_document(mixed_docs(spark, sf_dir), "doc", F.col("id"), ascending=False, limit=2000).select("id", J.to_string("doc").alias("doc"))


@query(f"WITH {RANKED} SELECT canon AS doc, count(*) AS n, min(id) AS first_id FROM r GROUP BY 1")
def group_by_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.group_by_document(mixed_docs(spark, sf_dir), "doc", F.count("*").alias("n"), F.min("id").alias("first_id"))
    return out.select(J.to_string("doc").alias("doc"), "n", "first_id")


@query(f"WITH {RANKED} SELECT count(*) AS n, min(id) AS first_id FROM r GROUP BY level, num")
def group_by_number_of_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5 and 5.0 in one group."""
    return R.group_by_document(mixed_docs(spark, sf_dir), "doc", F.count("*").alias("n"), F.min("id").alias("first_id"), numeric=True).select("n", "first_id")


@query(f"WITH {EVENTS} SELECT k, count(*) AS n, min(event_id) AS first_id FROM e GROUP BY 1")
def group_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.group_by_document(events(spark, sf_dir), "doc", F.count("*").alias("n"), F.min("event_id").alias("first_id"))
    return out.select(J.as_i64(J.get_by_name("doc", "k")).alias("k"), "n", "first_id")


@query(f"WITH {EVENTS} SELECT DISTINCT k FROM e")
def distinct_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.distinct_documents(events(spark, sf_dir), "doc").select(J.as_i64(J.get_by_name("doc", "k")).alias("k"))


@query(f"WITH {EVENTS}, w AS (SELECT k FROM e WHERE event_type = 'purchase' GROUP BY 1) SELECT event_id, k FROM e JOIN w USING (k)")
def join_on_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    bought = R.distinct_documents(e.where("event_type = 'purchase'"), "doc").withColumnRenamed("doc", "other")
    return R.join_on_document(e, bought, "doc", "other").select("event_id", J.as_i64(J.get_by_name("other", "k")).alias("k"))


@query(f"WITH {EVENTS} SELECT event_id FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.event_type = 'purchase' AND b.k = a.k AND b.user_id = a.user_id)")
def anti_join_on_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose user and k no purchase has."""
    e = user_docs(spark, sf_dir)
    return R.join_on_document(e, e.where("event_type = 'purchase'").select(F.col("doc").alias("other")), "doc", "other", "left_anti").select("event_id")


@query("SELECT o_orderkey AS id, o_orderpriority AS priority FROM orders JOIN nation ON CAST(o_custkey % 25 AS INTEGER) = n_nationkey WHERE n_regionkey = 1")
def join_on_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority", J.build_object(nation=J.from_native(F.col("o_custkey") % 25)).alias("doc"))
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_regionkey = 1").select(F.col("n_nationkey").cast("string").alias("nation_key"))
    return R.join_on_path(o, n, "doc", "$.nation", "nation_key").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"))


@query(f"WITH {SPARSE} SELECT id, n_name AS name FROM s JOIN nation ON nation = n_nationkey WHERE n_regionkey = 2")
def join_on_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_regionkey = 2").select("n_name", J.build_object(nation=J.from_native("n_nationkey")).alias("asked"))
    return R.join_on_containment(sparse_docs(spark, sf_dir), n, "doc", "asked").select("id", F.col("n_name").alias("name"))


@query(
    f"WITH {EVENTS}, a AS (SELECT DISTINCT user_id AS u, k FROM e WHERE event_type = 'purchase'), b AS (SELECT DISTINCT user_id AS u, k FROM e WHERE event_type = 'click') SELECT 'union' AS op, u, k FROM (SELECT * FROM a UNION SELECT * FROM b) "
    "UNION ALL SELECT 'intersect', u, k FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', u, k FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"
)
def set_operations_on_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of the documents of purchases and clicks."""
    e = user_docs(spark, sf_dir)
    a, b = e.where("event_type = 'purchase'"), e.where("event_type = 'click'")
    sets = {"union": R.union_documents(a, b, "doc"), "intersect": R.intersect_documents(a, b, "doc"), "except": R.except_documents(b, a, "doc")}
    parts = [d.select(F.lit(op).alias("op"), J.as_i64(J.get_by_name("doc", "user")).alias("u"), J.as_i64(J.get_by_path_first("doc", "$.props.k")).alias("k")) for op, d in sets.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---------------------------------------------------------------- text, wire, relational


@query(f"WITH {EVENTS} SELECT event_id, '{{\"k\":' || k || '}}' AS doc FROM e")
def to_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", J.to_string("doc").alias("doc"))


@query(f"WITH {EVENTS} SELECT event_id, '{{' || chr(10) || '  \"k\": ' || k || chr(10) || '}}' AS doc FROM e")
def to_pretty_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", J.to_pretty_string("doc").alias("doc"))


@query(f"WITH {RANKED} SELECT id, canon AS doc, format('{{:08x}}', CASE json_type(t) WHEN 'ARRAY' THEN 2147483648 + json_array_length(t) WHEN 'OBJECT' THEN 1073741824 + len(json_keys(t)) ELSE 536870913 END) AS head FROM r")
def encode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    wire = mixed_docs(spark, sf_dir).select("id", J.encode("doc").alias("wire"))
    return wire.select("id", J.to_string(J.decode("wire", text_too=False)).alias("doc"), F.lower(F.hex(F.substring("wire", 1, 4))).alias("head"))


@query(f"WITH {RANKED} SELECT id, canon AS from_text, CASE WHEN json_type(t) IN ('ARRAY', 'OBJECT') THEN CAST(NULL AS VARCHAR) END AS cut FROM r WHERE json_type(t) IN ('ARRAY', 'OBJECT')")
def decode_text_or_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text where wire bytes are asked for, and wire bytes that lack the last one."""
    e = mixed_docs(spark, sf_dir).where(J.is_array("doc") | J.is_object("doc"))
    wire = e.select("id", F.to_json("doc").cast("binary").alias("text"), J.encode("doc").alias("wire"))
    cut = F.expr("substring(wire, 1, length(wire) - 1)")
    return wire.select("id", J.to_string(J.decode("text")).alias("from_text"), J.to_string(J.try_decode(cut)).alias("cut"))


@query(f"WITH {RANKED} SELECT id, canon AS doc, CASE WHEN json_type(t) = 'OBJECT' THEN canon END AS object_only FROM r")
def to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_docs(spark, sf_dir).select("id", J.to_json("doc").alias("doc"), J.to_json_object("doc").alias("object_only"))


@query("SELECT event_id AS id, '{\"a\":[' || event_id || ',null],\"m\":{\"' || event_type || '\":' || user_id || '},\"s\":\"' || event_type || '\",\"t\":' || (event_id % 2 = 0) || '}' AS doc FROM events")
def from_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structs, maps, arrays and scalars of Spark as documents."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    row = F.struct(F.array(F.col("event_id"), F.lit(None)).alias("a"), F.create_map("event_type", "user_id").alias("m"), F.col("event_type").alias("s"), (F.col("event_id") % 2 == 0).alias("t"))
    return e.select(F.col("event_id").alias("id"), J.to_string(J.from_native(row)).alias("doc"))


@query(f"WITH {EVENTS} SELECT event_id AS id, '{{\"' || event_type || '\":' || user_id || ',\"k\":' || k || '}}' AS doc FROM e WHERE event_type < 'k' UNION ALL SELECT event_id, '{{\"k\":' || k || ',\"' || event_type || '\":' || user_id || '}}' FROM e WHERE event_type > 'k'")
def build_object_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names from columns; of the two values for k the last stays."""
    e = events(spark, sf_dir)
    user, k = J.from_native("user_id"), J.get_by_name("doc", "k")
    return e.select(F.col("event_id").alias("id"), J.to_string(J.build_object_from(F.array(F.lit("k"), F.col("event_type"), F.lit("k")), F.array(user, user, k))).alias("doc"))


@query(f"WITH {EVENTS} SELECT event_id, CAST(dense_rank() OVER (ORDER BY k) AS INTEGER) AS place FROM e")
def sort_key_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("key", J.sort_key("doc"))
    place = e.select("key").distinct().withColumn("place", F.dense_rank().over(Window.orderBy("key")))
    return e.join(place, "key").select("event_id", "place")


@query("SELECT count(*) AS n, count(*) AS known, true AS small, true AS varied FROM events")
def rand_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of random documents: one for each row, of a known kind, of five members at most, and of all kinds."""
    made = events(spark, sf_dir).select(J.rand_value(11).alias("doc"))
    kind = J.type_of("doc")
    size = F.coalesce(J.array_length("doc"), F.size(J.object_keys("doc")))
    return made.agg(F.count("*").alias("n"), F.count_if(kind.isin("null", "boolean", "number", "string", "array", "object")).alias("known"), F.max(F.coalesce(F.nullif(size, F.lit(-1)), F.lit(0))).between(1, 5).alias("small"), (F.count_distinct(kind) == 6).alias("varied"))


@query(f"WITH {EVENTS} SELECT event_type, event_id, k FROM e QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY k DESC, event_id) <= 3")
def window_over_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_type", "event_id", J.to_i64(J.get_by_path_first("doc", "$.k")).alias("k"))
    rank = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("k"), "event_id"))
    return e.withColumn("r", rank).where("r <= 3").drop("r")


@query(f"WITH {EVENTS} SELECT event_id, k FROM e ORDER BY k DESC, event_id LIMIT 10")
def relational_topk_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", J.to_i64(J.get_by_path_first("doc", "$.k")).alias("k")).orderBy(F.desc("k"), "event_id").limit(10)


@query("SELECT conv_id AS id, count(*) AS n, '[' || string_agg('\"' || role || '\"', ',' ORDER BY turn, role) || ']' AS roles FROM conversations GROUP BY 1")
def conversation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = F.sort_array(F.collect_list(F.struct("turn", "role")))
    docs = c.groupBy(F.col("conv_id").alias("id")).agg(F.to_variant_object(turns).alias("doc"))
    return docs.select("id", J.array_length("doc").cast("bigint").alias("n"), F.to_json(J.get_by_path_array("doc", "$[*].role")).alias("roles"))


# ---------------------------------------------------------------- sources, streaming, SQL


@query(f"WITH {EVENTS} SELECT event_id, k FROM e")
def read_parquet_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.read_parquet_text(spark, f"{sf_dir}/events.parquet", "props").select("event_id", J.as_i64(J.get_by_name("doc", "k")).alias("k"))


@query(f"WITH {EVENTS} SELECT CAST(floor(epoch(ts) / 604800) AS BIGINT) AS week, CAST(k AS VARCHAR) AS key, count(*) AS n FROM e GROUP BY 1, 2")
def event_time_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming aggregate over a table at rest."""
    out = streaming.windowed_counts(events(spark, sf_dir), "ts", "doc", "$.k")
    return out.select((F.unix_timestamp(F.col("window.start")) / 604800).cast("bigint").alias("week"), "key", "n")


@query(f"WITH {RANKED} SELECT id, canon AS doc, CASE json_type(t) WHEN 'ARRAY' THEN CAST(json_array_length(t) AS INTEGER) END AS n, CASE WHEN kind_ IN (1, 2) THEN k END AS k, level FROM (SELECT r.*, id % 9 AS kind_, CAST(id % 50 AS BIGINT) AS k FROM r)")
def sql_scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(spark)
    docs = mixed_docs(spark, sf_dir)
    return docs.select(
        "id", F.expr("jl_to_string(doc)").alias("doc"), F.expr("jl_array_length(doc)").alias("n"), F.expr("coalesce(jl_as_i64(jl_get_by_index(doc, 0)), jl_as_i64(jl_get_by_keypath(doc, '{b,c}')))").alias("k"),
        F.expr("CASE jl_type_of(doc) WHEN 'null' THEN 7 WHEN 'array' THEN 6 WHEN 'object' THEN 5 WHEN 'string' THEN 4 WHEN 'number' THEN 3 ELSE if(jl_to_bool(doc), 2, 1) END").alias("level"),
    )


@query(f"WITH {ITEMS}, u AS (SELECT id, unnest(items) AS item, generate_subscripts(items, 1) - 1 AS pos FROM docs) SELECT id, CAST(pos AS INTEGER) AS pos, item.part AS part, 'flag,n,part' AS keys FROM u")
def sql_table_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(spark)
    items = "SELECT o.id, e.pos, e.value FROM (SELECT id, jl_get_by_name(doc, 'items') AS items FROM {orders}) o, LATERAL jl_array_each(o.items) e"
    return spark.sql(f"SELECT i.id, i.pos, max(CASE WHEN m.key = 'part' THEN jl_as_i64(m.value) END) AS part, array_join(array_sort(collect_list(m.key)), ',') AS keys FROM ({items}) i, LATERAL jl_object_each(i.value) m GROUP BY i.id, i.pos", orders=order_docs(spark, sf_dir))
