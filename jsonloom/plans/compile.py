"""Paths as Catalyst expressions over VARIANT.

A path becomes one ``try_variant_get`` where it can hit at most one node, and
higher-order functions over ``ARRAY<VARIANT>`` otherwise. Nothing here runs
Python on executors; what a compiled path gives agrees with ``evaluate``.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import evaluate
from .paths import Arithmetic, Current, Elements, Exists, Field, Filter, Index, Indices, Literal, Members, Operand, Path, PathError, Root, Slice


def none() -> Column:
    return F.array().cast("array<variant>")


def elements(v: Column) -> Column:
    """The elements of an array; NULL for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def members(v: Column) -> Column:
    """The members of an object as a map; NULL for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def in_key_order(m: Column) -> Column:
    return F.transform(F.array_sort(F.map_keys(m)), lambda k: F.element_at(m, k))


def is_container(v: Column) -> Column:
    return F.isnotnull(elements(v)) | F.isnotnull(members(v))


def plain_name(name: str) -> bool:
    return not any(c in name for c in "\"'\\")


@dataclass
class Nodes:
    """What a chain of steps hits: ``one`` (a VARIANT or NULL), reached by ``tail`` from it; or ``many`` (an array).

    at_root: whether a node may still be the root itself.
    """

    one: Column | None = None
    many: Column | None = None
    tail: str = "$"
    at_root: bool = False

    def single(self) -> Column:
        return self.one if self.tail == "$" else F.try_variant_get(self.one, self.tail, "variant")

    def array(self) -> Column:
        if self.many is not None:
            return self.many
        v = self.single()
        return F.when(F.isnotnull(v), F.array(v)).otherwise(none())

    def exists(self) -> Column:
        return F.isnotnull(self.single()) if self.many is None else F.size(self.many) > 0

    def any(self, test) -> Column:  # noqa: ANN001
        if self.many is None:
            return F.coalesce(test(self.single()), F.lit(False))
        return F.exists(self.many, test)


def present(a: Column) -> Column:
    return F.filter(a, lambda y: F.isnotnull(y))


def offset(index: Index, n: Column) -> Column:
    return n - 1 + F.lit(index.n) if index.from_last else F.lit(index.n)


def picked(v: Column, items: tuple) -> Column:
    """The elements of an array that the items name, in their order."""
    a, parts = elements(v), []
    n = F.size(a)
    for item in items:
        if isinstance(item, Slice):
            start, end = F.greatest(F.lit(0), offset(item.start, n)), F.least(n - 1, offset(item.end, n))
            parts.append(F.slice(a, start + 1, F.greatest(F.lit(0), end - start + 1)))
        elif item.from_last or item.n >= 0:
            at = offset(item, n)
            parts.append(F.when((at >= 0) & (at < n), F.array(F.get(a, at))).otherwise(none()))
    return F.coalesce(F.concat(*parts), none()) if parts else none()


def step(nodes: Nodes, how: Any, root: Column) -> Nodes:
    if isinstance(how, Filter):
        test = lambda x: holds(how.expr, root, Nodes(one=x, at_root=nodes.at_root))
        if nodes.many is None:
            v = nodes.single()
            return Nodes(one=F.when(F.isnotnull(v) & test(v), v), at_root=nodes.at_root)
        return Nodes(many=F.filter(nodes.many, test), at_root=nodes.at_root)
    if isinstance(how, Field):
        if nodes.many is None:
            if plain_name(how.name):
                return Nodes(one=nodes.one, tail=f'{nodes.tail}["{how.name}"]')
            return Nodes(one=F.try_element_at(members(nodes.single()), F.lit(how.name)))
        if plain_name(how.name):
            got = F.transform(nodes.many, lambda x: F.try_variant_get(x, f'$["{how.name}"]', "variant"))
        else:
            got = F.transform(nodes.many, lambda x: F.try_element_at(members(x), F.lit(how.name)))
        return Nodes(many=present(got))
    if isinstance(how, Indices) and len(how.items) == 1 and isinstance(how.items[0], Index):
        item = how.items[0]
        if not item.from_last and item.n < 0:
            return Nodes(many=none())
        if nodes.many is None and not item.from_last:
            return Nodes(one=nodes.one, tail=f"{nodes.tail}[{item.n}]")
        get = lambda x: F.get(elements(x), offset(item, F.size(elements(x))))
        if nodes.many is None:
            return Nodes(one=get(nodes.single()))
        return Nodes(many=present(F.transform(nodes.many, get)))
    if isinstance(how, Elements):
        below = lambda x: F.coalesce(elements(x), F.array(x))
    elif isinstance(how, Members):
        below = lambda x: F.coalesce(in_key_order(members(x)), none())
    elif isinstance(how, Indices):
        below = lambda x: picked(x, how.items)
    else:
        raise PathError(f"a step out of place: {how}")
    at_root = nodes.at_root and isinstance(how, Elements)
    if nodes.many is None:
        v = nodes.single()
        return Nodes(many=F.when(F.isnotnull(v), below(v)).otherwise(none()), at_root=at_root)
    return Nodes(many=F.flatten(F.transform(nodes.many, below)), at_root=at_root)


def walk(steps: tuple, root: Column, current: Nodes | None) -> Nodes:
    nodes = Nodes(one=root, at_root=True)
    for how in steps:
        if isinstance(how, Root):
            nodes = Nodes(one=root, at_root=True)
        elif isinstance(how, Current):
            nodes = current or nodes
        else:
            nodes = step(nodes, how, root)
    return nodes


def kind(v: Column) -> Column:
    """'null', 'boolean', 'number', 'string', 'array' or 'object'."""
    s = F.schema_of_variant(v)
    return (
        F.when(F.is_variant_null(v), "null")
        .when(s == "BOOLEAN", "boolean")
        .when((s == "BIGINT") | (s == "DOUBLE") | (s == "FLOAT") | s.startswith("DECIMAL"), "number")
        .when(s.startswith("ARRAY"), "array")
        .when(s.startswith("OBJECT"), "object")
        .when(F.isnotnull(s), "string")
    )


def rank(v: Column) -> Column:
    """The rank of a scalar's kind; NULL for containers."""
    s = F.schema_of_variant(v)
    return (
        F.when(F.is_variant_null(v), 0)
        .when(s == "BOOLEAN", 1)
        .when((s == "BIGINT") | (s == "DOUBLE") | (s == "FLOAT") | s.startswith("DECIMAL"), 2)
        .when(~s.startswith("ARRAY") & ~s.startswith("OBJECT"), 3)
    )


def compared(op: str, a: Column, b: Column) -> Column:
    return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def get(v: Column, kind_: str) -> Column:
    return F.try_variant_get(v, "$", kind_)


def integer(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "BIGINT", get(v, "bigint"))


def whole(v: Column) -> Column:
    """An integer of either sign, up to 64 bits, as DECIMAL(38, 0)."""
    n = get(v, "decimal(38,0)")
    s = F.schema_of_variant(v)
    # within 64 bits with a sign, what is no BIGINT has been written with a fraction
    large = s.rlike(r"^DECIMAL\(\d+,0\)$") & (n > F.lit(Decimal((1 << 63) - 1)))
    return F.when((s == "BIGINT") | large, n)


def simple(v: Column) -> Column:
    """Whether all scalars in a document are null, booleans, strings or BIGINT, and its arrays are not mixed: then its text says all. NULL for NULL."""
    return ~F.schema_of_variant(v).rlike("DECIMAL|DOUBLE|FLOAT|VARIANT|DATE|TIME|BINARY|UUID|INTERVAL")


def as_decimal(n: int) -> Column:
    return F.lit(Decimal(n)).cast("decimal(38,0)")


def against(op: str, x: Column, value: Any) -> Column:
    """Whether a scalar node stands in that relation to a literal."""
    r = evaluate.RANKS[evaluate.kind(value)]
    below, equal, above = (evaluate.TESTS[op](c) for c in (-1, 0, 1))
    if value is None:
        same = F.lit(equal)
    elif isinstance(value, bool):
        same = compared(op, get(x, "boolean"), F.lit(value))
    elif isinstance(value, str):
        same = compared(op, get(x, "string"), F.lit(value))
    elif isinstance(value, int):
        short = [compared(op, integer(x), F.lit(value).cast("bigint"))] if -(1 << 63) <= value < 1 << 63 else []
        same = F.coalesce(*short, compared(op, whole(x), as_decimal(value)), compared(op, get(x, "double"), F.lit(float(value))))
    else:
        same = compared(op, get(x, "double"), F.lit(float(value)))
    own = rank(x)
    return F.coalesce(F.when(own < r, F.lit(below)).when(own > r, F.lit(above)).when(own == r, same), F.lit(False))


def between(op: str, x: Column, y: Column) -> Column:
    """Whether two scalar nodes stand in that relation."""
    below, equal, above = (evaluate.TESTS[op](c) for c in (-1, 0, 1))
    a, b = rank(x), rank(y)
    numbers = F.coalesce(compared(op, integer(x), integer(y)), compared(op, whole(x), whole(y)), compared(op, get(x, "double"), get(y, "double")))
    same = F.when(a == 0, F.lit(equal)).when(a == 1, compared(op, get(x, "boolean"), get(y, "boolean"))).when(a == 2, numbers).otherwise(compared(op, get(x, "string"), get(y, "string")))
    return F.coalesce(F.when(a < b, F.lit(below)).when(a > b, F.lit(above)).when(a == b, same), F.lit(False))


MIRRORED = {"==": "==", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


def holds(expr: Any, root: Column, current: Nodes) -> Column:
    """An expression's truth, never NULL."""
    if isinstance(expr, Exists):
        return walk(expr.steps, root, current).exists()
    if isinstance(expr, Arithmetic):
        raise PathError(f"unsupported arithmetic: {expr}")
    if expr.op in ("&&", "||"):
        left, right = holds(expr.left, root, current), holds(expr.right, root, current)
        return left & right if expr.op == "&&" else left | right
    left, right, op = expr.left, expr.right, expr.op
    if isinstance(left, Literal) and isinstance(right, Literal):
        return F.lit(evaluate.TESTS[op](evaluate.order(left.value, right.value)))
    if isinstance(left, Literal):
        left, right, op = right, left, MIRRORED[op]
    if not isinstance(left, Operand):
        raise PathError(f"not supported: {left}")
    x = walk(left.steps, root, current)
    guard = x.at_root
    if isinstance(right, Literal):
        out = x.any(lambda v: against(op, v, right.value))
    else:
        y = walk(right.steps, root, current)
        guard = guard or y.at_root
        out = x.any(lambda v: y.any(lambda w: between(op, v, w)))
    # a scalar root is never compared
    return F.coalesce(out & is_container(root), F.lit(False)) if guard else out


def select(path: Path, doc: Column) -> Nodes:
    if path.predicate is not None:
        return Nodes(one=F.when(F.isnotnull(doc), match(path, doc).cast("variant")))
    return walk(path.steps, doc, None)


def match(path: Path, doc: Column) -> Column:
    if path.predicate is None:
        raise PathError("InvalidJsonPathPredicate")
    return F.when(F.isnotnull(doc), holds(path.predicate, doc, Nodes(one=doc, at_root=True)))


def exists(path: Path, doc: Column) -> Column:
    found = F.lit(True) if path.predicate is not None else walk(path.steps, doc, None).exists()
    return F.when(F.isnotnull(doc), found)


# ---------------------------------------------------------------- whole documents


def same_scalar(x: Column, value: Any) -> Column:
    """Whether a document is that scalar."""
    s = F.schema_of_variant(x)
    if value is None:
        return F.is_variant_null(x)
    if isinstance(value, bool):
        return (s == "BOOLEAN") & (get(x, "boolean") == F.lit(value))
    if isinstance(value, str):
        return (s == "STRING") & (get(x, "string") == F.lit(value))
    if isinstance(value, int):
        return F.coalesce(integer(x) == F.lit(value).cast("bigint") if -(1 << 63) <= value < 1 << 63 else whole(x) == as_decimal(value), F.lit(False))
    return F.coalesce((kind(x) == "number") & F.isnull(whole(x)) & (get(x, "double") == F.lit(value)), F.lit(False))


def part_of(x: Column, value: Any, top: bool = True) -> Column:
    """Whether a document contains a constant one, in the sense of ``contains``."""
    if isinstance(value, dict):
        found = F.isnotnull(members(x)) if not value else F.lit(True)
        for k, v in value.items():
            child = F.try_variant_get(x, f'$["{k}"]', "variant") if plain_name(k) else F.try_element_at(members(x), F.lit(k))
            found = found & part_of(child, v, False)
        return F.coalesce(found, F.lit(False))
    a = elements(x)
    if isinstance(value, list):
        found = F.isnotnull(a)
        for y in value:
            found = found & F.exists(a, _holding(y))
        return F.coalesce(found, F.lit(False))
    own = F.coalesce(same_scalar(x, value), F.lit(False))
    return F.coalesce(F.exists(a, lambda e: F.coalesce(same_scalar(e, value), F.lit(False))), own) if top else own


def _holding(value: Any):  # noqa: ANN202
    return lambda e: part_of(e, value, False)


def stripped(v: Column, depth: int) -> Column:
    """Without members that are null, down to that depth."""
    if not depth:
        return v
    m, a = members(v), elements(v)
    kept = F.transform_values(F.map_filter(m, lambda _, x: ~F.is_variant_null(x)), lambda _, x: stripped(x, depth - 1))
    return F.when(F.isnotnull(m), F.to_variant_object(kept)).when(F.isnotnull(a), F.to_variant_object(F.transform(a, lambda x: stripped(x, depth - 1)))).otherwise(v)


def without(v: Column, keys: tuple) -> Column:
    """Without what a chain of keys leads to; unchanged if it leads nowhere."""
    if not keys:
        return v
    key, rest = keys[0], keys[1:]
    if isinstance(key.value, int) and not key.quoted:
        a = elements(v)
        at = F.lit(key.value) if key.value >= 0 else F.size(a) + key.value
        fewer = F.filter(a, lambda _, i: i != at) if not rest else F.transform(a, lambda x, i: F.when(i == at, without(x, rest)).otherwise(x))
        return F.when(F.isnotnull(a), F.to_variant_object(fewer)).otherwise(v)
    m, name = members(v), F.lit(str(key.value))
    fewer = F.map_filter(m, lambda k, _: k != name) if not rest else F.transform_values(m, lambda k, x: F.when(k == name, without(x, rest)).otherwise(x))
    return F.when(F.isnotnull(m), F.to_variant_object(fewer)).otherwise(v)
