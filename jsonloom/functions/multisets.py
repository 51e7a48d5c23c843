"""Arrays as multisets, on the bytes of VARIANT.

Each function takes the value and the metadata of an array of the documents and
means what its namesake in ``documents`` does. Elements are told apart by their
documents and copied as bytes, so none is built again.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Hashable
from functools import lru_cache

from .documents import identity
from .variant import ARRAY, OBJECT, SHORT_STRING, array_of, parts_of, read

#: Bytes up to which an element and the names of its members are remembered, and how many are.
SMALL, SMALL_NAMES, REMEMBERED = 64, 1024, 4096


def _fresh(part: bytes, metadata: bytes) -> Hashable:
    return identity(read(part, metadata))


_remembered = lru_cache(maxsize=REMEMBERED)(_fresh)


def _identities(parts: list[bytes], metadata: bytes) -> list[Hashable]:
    nested = _remembered if len(metadata) <= SMALL_NAMES else _fresh
    out: list[Hashable] = []
    for p in parts:
        basic = p[0] & 3
        if basic == SHORT_STRING:
            out.append(p[1:].decode())
        elif len(p) > SMALL:
            out.append(_fresh(p, metadata))
        else:
            out.append(nested(p, metadata) if basic in (OBJECT, ARRAY) else _remembered(p, b""))
    return out


def array_distinct(value: bytes, metadata: bytes) -> tuple[bytes, bytes]:
    parts = parts_of(parts_of(value)[0])
    first: dict[Hashable, bytes] = {}
    for e, p in zip(_identities(parts, metadata), parts, strict=True):
        first.setdefault(e, p)
    return array_of(list(first.values())), metadata


def _kept(value: bytes, metadata: bytes, found: bool) -> tuple[bytes, bytes]:
    """Elements of the first array that the second has, each of its used once; or those that it lacks."""
    left, right = map(parts_of, parts_of(value))
    rest, kept = Counter(_identities(right, metadata)), []
    for e, p in zip(_identities(left, metadata), left, strict=True):
        there = rest[e] > 0
        if there:
            rest[e] -= 1
        if there == found:
            kept.append(p)
    return array_of(kept), metadata


def array_intersection(value: bytes, metadata: bytes) -> tuple[bytes, bytes]:
    return _kept(value, metadata, True)


def array_except(value: bytes, metadata: bytes) -> tuple[bytes, bytes]:
    return _kept(value, metadata, False)


def array_overlap(value: bytes, metadata: bytes) -> bool:
    left, right = map(parts_of, parts_of(value))
    return not set(_identities(left, metadata)).isdisjoint(_identities(right, metadata))
