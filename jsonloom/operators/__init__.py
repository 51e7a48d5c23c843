"""Relational operators on document columns.

VARIANT can't be grouped, sorted or joined on. These operators put a BINARY key
beside it (``identity_key``: equal documents; ``order_key``: order and numeric
equality) and leave the rest to Catalyst, so aggregates combine before the
shuffle and joins are hash or sort-merge joins. Columns that are added for a
while get names that the tables don't have, so no column of theirs is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as J


def _fresh(name: str, *tables: DataFrame) -> str:
    """A name like this one that none of the tables has."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _key(doc: str | Column, numeric: bool) -> Column:
    return J.order_key(doc) if numeric else J.identity_key(doc)


def group_by_document(df: DataFrame, doc: str, *aggregates: Column, numeric: bool = False) -> DataFrame:
    """One row for each document: the document, and the aggregates. ``numeric``: 1 and 1.0 are one."""
    key = _fresh("document_key", df)
    return df.withColumn(key, _key(doc, numeric)).groupBy(key).agg(F.any_value(doc).alias(doc), *aggregates).drop(key)


def distinct_documents(df: DataFrame, doc: str, numeric: bool = False) -> DataFrame:
    return group_by_document(df.select(doc), doc, numeric=numeric)


def order_by_document(df: DataFrame, doc: str, *then: Column, ascending: bool = True, limit: int | None = None) -> DataFrame:
    """Sorted in the total order of documents, ties by ``then``; with a limit as a top-k, without a global sort."""
    name = _fresh("document_key", df)
    key = F.col(name)
    out = df.withColumn(name, J.order_key(doc)).orderBy(key.asc() if ascending else key.desc(), *then)
    return (out if limit is None else out.limit(limit)).drop(name)


def join_on_document(left: DataFrame, right: DataFrame, left_doc: str, right_doc: str, how: str = "inner", numeric: bool = False) -> DataFrame:
    """Equi-join on documents; for semi and anti joins only left columns come back."""
    a, b = _fresh("left_key", left, right), _fresh("right_key", left, right)
    out = left.withColumn(a, _key(left_doc, numeric)).join(right.withColumn(b, _key(right_doc, numeric)), F.col(a) == F.col(b), how)
    return out.drop(a, b)


def join_on_path(left: DataFrame, right: DataFrame, left_doc: str, path: str, right_key: str, how: str = "inner") -> DataFrame:
    """Join of what a path leads to, as text, with a string column: an ordinary equi-join."""
    key = _fresh("path_key", left, right)
    return left.withColumn(key, J.try_to_str(J.get_by_path_first(left_doc, path))).join(right, F.col(key) == F.col(right_key), how).drop(key)


def _mark(x: Column) -> Column:
    """A scalar's text by kind; equal scalars have equal ones. A sign of its kind for a container."""
    number = F.concat(F.lit("n"), J.as_f64(x).cast("string"))
    other = F.concat(F.lit("s"), J.as_str(x))
    return F.coalesce(number, other, F.when(J.is_null(x), "null"), F.concat(F.lit("b"), J.as_bool(x).cast("string")), F.when(J.is_array(x), "[]").otherwise("{}"))


def join_on_containment(left: DataFrame, right: DataFrame, left_doc: str, right_doc: str) -> DataFrame:
    """Pairs whose left document contains the right one.

    Every right document has one mark that a left document must have, too: a
    member's name, an element (or that there is one of its kind), the scalar
    itself, or for an empty container its kind. Pairs are found by an equi-join
    on marks, and checked; a mark that many share is split by the adaptive join.
    """
    named = lambda doc: F.transform(J.object_keys(doc), lambda k: F.concat(F.lit("k"), k))
    items = lambda doc: F.transform(J.array_values(doc), lambda x: F.concat(F.lit("v"), _mark(x)))
    whole = lambda doc: F.concat(F.lit("w"), _mark(F.col(doc)))
    none = F.array().cast("array<string>")
    # a scalar is part of itself and of arrays that have it
    scalar = F.when(~(J.is_array(left_doc) | J.is_object(left_doc)), F.array(F.concat(F.lit("v"), _mark(F.col(left_doc)))))
    all_marks = F.concat(F.coalesce(named(left_doc), items(left_doc), scalar, none), F.array(whole(left_doc)))
    # of an array's elements a scalar says most
    scalars = F.filter(items(right_doc), lambda m: ~m.isin("v[]", "v{}"))
    asked = F.when(J.is_object(right_doc), F.coalesce(F.get(named(right_doc), F.lit(0)), whole(right_doc)))
    asked = asked.when(J.is_array(right_doc), F.coalesce(F.get(scalars, F.lit(0)), F.get(items(right_doc), F.lit(0)), whole(right_doc))).otherwise(F.concat(F.lit("v"), _mark(F.col(right_doc))))
    mark, own = _fresh("mark", left, right), _fresh("own_mark", left, right)
    a = left.withColumn(mark, F.explode(F.array_distinct(all_marks)))
    return a.join(right.withColumn(own, asked), F.col(mark) == F.col(own)).drop(mark, own).where(J.contains(left_doc, right_doc))


def union_documents(left: DataFrame, right: DataFrame, doc: str) -> DataFrame:
    """Distinct documents of both."""
    return distinct_documents(left.select(doc).unionByName(right.select(doc)), doc)


def intersect_documents(left: DataFrame, right: DataFrame, doc: str) -> DataFrame:
    return distinct_documents(_known(left, right, doc, "left_semi"), doc)


def except_documents(left: DataFrame, right: DataFrame, doc: str) -> DataFrame:
    return distinct_documents(_known(left, right, doc, "left_anti"), doc)


def _known(left: DataFrame, right: DataFrame, doc: str, how: str) -> DataFrame:
    a, b = _fresh("left_key", left.select(doc)), _fresh("right_key", left.select(doc))
    keys = right.select(_key(doc, False).alias(b)).distinct()
    return left.select(doc, _key(doc, False).alias(a)).join(keys, F.col(a) == F.col(b), how).select(doc)


def json_array_agg(doc: Column | str, order: Column | str) -> Column:
    """An aggregate: an array of a group's documents in the given order; NULL counts as null."""
    value = F.coalesce(J._col(doc), F.parse_json(F.lit("null")))
    pairs = F.collect_list(F.struct(J._col(order).alias("o"), value.alias("v")))
    return F.to_variant_object(F.transform(_sorted(pairs), lambda p: p["v"]))


def json_object_agg(key: Column | str, doc: Column | str, order: Column | str) -> Column:
    """An aggregate: an object of a group's names and documents; of equal names the last in the given order wins."""
    value = F.coalesce(J._col(doc), F.parse_json(F.lit("null")))
    pairs = _sorted(F.collect_list(F.struct(J._col(order).alias("o"), J._col(key).alias("k"), value.alias("v"))))
    return J.build_object_from(F.transform(pairs, lambda p: p["k"]), F.transform(pairs, lambda p: p["v"]))


def _sorted(pairs: Column) -> Column:
    # documents have no order of their own, so only what is given is looked at
    before = lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)
    return F.array_sort(pairs, before)


def explode_path(df: DataFrame, doc: str, path: str, name: str = "value") -> DataFrame:
    """A row for each hit of a path."""
    return df.withColumn(name, F.explode(J.get_by_path_all(doc, path)))


def explode_members(df: DataFrame, doc: str) -> DataFrame:
    """A row for each member, with columns key and value."""
    return df.select("*", F.inline(J.object_each(doc)))


def explode_elements(df: DataFrame, doc: str, name: str = "value") -> DataFrame:
    """A row for each element, with its place ``pos``."""
    return df.select("*", F.posexplode(J.array_values(doc)).alias("pos", name))
