"""Documents as Python values: text, numbers, wire bytes and order.

A value is None, bool, str, list, dict with str keys, int (-2**63 to 2**64 - 1)
or float. ``1`` and ``1.0`` are different documents, so documents are compared
by ``compare`` or by their wire bytes, never by ``==``.
"""

from __future__ import annotations

import math
import re
import struct
from decimal import Decimal
from functools import cmp_to_key

Value = None | bool | int | float | str | list | dict


class JsonError(ValueError):
    """A document, path or operation that is not valid."""


class SyntaxFault(JsonError):
    """Text that is not a document; ``pos`` counts bytes."""

    def __init__(self, what: str, pos: int) -> None:
        super().__init__(f"{what}, pos {pos}")
        self.pos = pos


# ---------------------------------------------------------------- text to value

_SPACE = re.compile(r"(?:[ \t\n\r\f]|\\[nrt]|\\x0C)*")
_DIGITS = re.compile(r"[0-9]*")
_PLAIN = re.compile(r'[^"\\]*')
_ESCAPES = {"\\": "\\", '"': '"', "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
_WORDS = {"n": ("null", None), "t": ("true", True), "f": ("false", False)}


class _Reader:
    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def fault(self, what: str, at: int | None = None) -> SyntaxFault:
        at = self.at if at is None else at
        extra = max(0, at - len(self.text))
        return SyntaxFault(what, len(self.text[:at].encode("utf-8", "surrogatepass")) + extra)

    def space(self) -> None:
        self.at = _SPACE.match(self.text, self.at).end()

    def peek(self) -> str:
        if self.at >= len(self.text):
            raise self.fault("EOF while parsing a value")
        return self.text[self.at]

    def document(self) -> Value:
        value = self.value()
        self.space()
        if self.at < len(self.text):
            raise self.fault("trailing characters", self.at + 1)
        return value

    def value(self) -> Value:
        self.space()
        c = self.peek()
        if c in _WORDS:
            return self.word(*_WORDS[c])
        if c == '"':
            return self.string()
        if c == "[":
            return self.array()
        if c == "{":
            return self.object()
        if c == "-" or "0" <= c <= "9":
            return self.number()
        raise self.fault("expected value", self.at + 1)

    def word(self, word: str, value: Value) -> Value:
        for c in word:
            found = self.peek()
            self.at += 1
            if found != c:
                raise self.fault("expected ident")
        return value

    def digits(self) -> None:
        if self.at == len(self.text):
            raise self.fault("EOF while parsing a value")
        end = _DIGITS.match(self.text, self.at).end()
        if end == self.at:
            raise self.fault("invalid number", self.at + 1)
        self.at = end

    def number(self) -> Value:
        start, whole = self.at, True
        if self.text[self.at] == "-":
            self.at += 1
        if self.text.startswith("0", self.at):
            self.at += 1
            if _DIGITS.match(self.text, self.at).end() > self.at:
                raise self.fault("invalid number", self.at + 1)
        else:
            self.digits()
        if self.text.startswith(".", self.at):
            whole = False
            self.at += 1
            self.digits()
        if self.text.startswith(("e", "E"), self.at):
            whole = False
            self.at += 1
            if self.text.startswith(("+", "-"), self.at):
                self.at += 1
            self.digits()
        token = self.text[start : self.at]
        if whole and len(token) <= 21:
            n = int(token)
            if -(1 << 63) <= n < 1 << 64:
                return n
        return float(token)

    def string(self) -> str:
        self.at += 1
        start, plain = self.at, True
        while True:
            self.at = _PLAIN.match(self.text, self.at).end()
            if self.peek() == '"':
                break
            plain = False
            self.at += 1
            if self.peek() == "u":
                self.at += 1
                self.at += 6 if self.peek() == "{" else 4
                if self.at > len(self.text):
                    raise self.fault("EOF while parsing a value")
            else:
                self.at += 1
        raw = self.text[start : self.at]
        self.at += 1
        return raw if plain else unescape(raw, lambda what, i: self.fault(what, start + i))

    def items(self, end: str, what: str):  # noqa: ANN202
        """Move to the next item until the end sign."""
        self.at += 1
        first = True
        while True:
            self.space()
            c = self.peek()
            if c == end:
                self.at += 1
                return
            if not first:
                if c != ",":
                    raise self.fault(what)
                self.at += 1
            first = False
            yield

    def array(self) -> list:
        return [self.value() for _ in self.items("]", "expected `,` or `]`")]

    def object(self) -> dict:
        out = {}
        for _ in self.items("}", "expected `,` or `}`"):
            key = self.value()
            if not isinstance(key, str):
                raise self.fault("key must be a string")
            self.space()
            if self.peek() != ":":
                raise self.fault("expected `:`")
            self.at += 1
            out[key] = self.value()
        return sort_keys(out)


def sort_keys(members: dict) -> dict:
    """Members in the order of their keys' UTF-8 bytes."""
    keys = sorted(members, key=lambda k: k.encode("utf-8", "surrogatepass"))
    return {k: members[k] for k in keys}


_HEX4 = re.compile(r"u(?:\{(.{4})\}|(.{4}))", re.S)


def unescape(raw: str, fault=lambda what, i: SyntaxFault(what, i)) -> str:  # noqa: ANN001
    """Resolve escapes; ``\\u{XXXX}`` is allowed, and surrogates without a partner stay as they are written."""
    out, at, pending = [], 0, None  # pending: the digits of a leading surrogate
    while at < len(raw):
        cut = raw.find("\\", at)
        if cut != at:
            if pending:
                out.append(f"\\u{pending}")
                pending = None
            cut = len(raw) if cut < 0 else cut
            out.append(raw[at:cut])
            at = cut
            continue
        c = raw[at + 1 : at + 2]
        if c != "u":
            if pending:
                out.append(f"\\u{pending}")
                pending = None
            if c not in _ESCAPES or not c:
                raise fault(f"invalid escaped '{ord(c or chr(0)):X}'", at + 2)
            out.append(_ESCAPES[c])
            at += 2
            continue
        m = _HEX4.match(raw, at + 1)
        if not m:
            raise fault("unexpected end of hex escape", at + 2)
        digits = m[1] or m[2]
        for d in digits:
            if d not in "0123456789abcdefABCDEF":
                raise fault(f"invalid hex '{d.encode()[0]:X}'", m.end())
        code = int(digits, 16)
        at = m.end()
        low = 0xDC00 <= code <= 0xDFFF
        if pending:
            if low:
                out.append(chr(0x10000 + ((int(pending, 16) - 0xD800) << 10) + code - 0xDC00))
            else:
                out.append(f"\\u{pending}\\u{digits}")
            pending = None
        elif 0xD800 <= code <= 0xDBFF:
            pending = digits
        else:
            out.append(f"\\u{digits}" if low else chr(code))
    if pending:
        out.append(f"\\u{pending}")
    return "".join(out)


def parse(text: str) -> Value:
    """The document that a text holds; lenient in the ways the test-suite lists, else a ``SyntaxFault``."""
    try:
        return _Reader(text).document()
    except RecursionError:
        raise JsonError("nested too deeply") from None


# ---------------------------------------------------------------- value to text

_ESCAPED = str.maketrans({"\\": "\\\\", '"': '\\"', "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"})


def number_text(x: float | int) -> str:
    """Shortest digits that round-trip; plain from 1e-5 to below 1e16, else with an exponent."""
    if isinstance(x, int):
        return str(x)
    if not math.isfinite(x):
        return "NaN" if math.isnan(x) else "inf" if x > 0 else "-inf"
    if 1e-4 <= abs(x) < 1e16:
        return repr(x)
    sign, digits, exponent = Decimal(repr(x)).as_tuple()
    text = "".join(map(str, digits)).rstrip("0")
    minus = "-" if sign else ""
    if not text:
        return f"{minus}0.0"
    point = len(digits) + exponent
    if len(text) <= point <= 16:
        return f"{minus}{text.ljust(point, '0')}.0"
    if 0 < point <= 16:
        return f"{minus}{text[:point]}.{text[point:]}"
    if -5 < point <= 0:
        return f"{minus}0.{'0' * -point}{text}"
    return f"{minus}{text[0]}{'.' + text[1:] if len(text) > 1 else ''}e{point - 1}"


def string_text(s: str) -> str:
    return f'"{s.translate(_ESCAPED)}"'


def render(value: Value, pretty: bool = False, depth: int = 0) -> str:
    """Compact text, or with two blanks for each level."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return string_text(value)
    if isinstance(value, (int, float)):
        return number_text(value)
    if isinstance(value, list):
        left, right, items = "[", "]", [render(v, pretty, depth + 1) for v in value]
    else:
        colon = ": " if pretty else ":"
        left, right, items = "{", "}", [f"{string_text(k)}{colon}{render(v, pretty, depth + 1)}" for k, v in sort_keys(value).items()]
    if not pretty:
        return f"{left}{','.join(items)}{right}"
    inner = "  " * (depth + 1)
    return f"{left}\n{',\n'.join(inner + x for x in items)}\n{'  ' * depth}{right}"


def plain(value: Value) -> Value:
    """For interchange with strict JSON; non-finite numbers are no JSON."""
    if isinstance(value, float) and not math.isfinite(value):
        raise JsonError("InvalidJson")
    if isinstance(value, list):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return value


# ---------------------------------------------------------------- identity

_SPARK_ESCAPED = {i: f"\\u{i:04X}" for i in range(32)} | {ord(k): v for k, v in {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}.items()}


def _exact(value: Value) -> bool:
    """Whether no number in a document has a fraction or more than 64 bits."""
    if isinstance(value, list):
        return all(map(_exact, value))
    if isinstance(value, dict):
        return all(map(_exact, value.values()))
    return not isinstance(value, float) and (not isinstance(value, int) or -(1 << 63) <= value < 1 << 63)


def _spark_text(value: Value) -> str:
    """The text that Spark prints for such a document."""
    if isinstance(value, str):
        return f'"{value.translate(_SPARK_ESCAPED)}"'
    if isinstance(value, list):
        return f"[{','.join(map(_spark_text, value))}]"
    if isinstance(value, dict):
        names = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return f"{{{','.join(f'{_spark_text(k)}:{_spark_text(value[k])}' for k in names)}}}"
    return render(value)


def identity_bytes(value: Value) -> bytes:
    """Bytes that differ for all different documents: Spark's text if numbers are exact in it, else the wire bytes after a zero."""
    return _spark_text(value).encode("utf-8", "surrogatepass") if _exact(value) else b"\x00" + encode(value)


# ---------------------------------------------------------------- wire format
# Fixed values of the format.
ARRAY, OBJECT, SCALAR = 0x80000000, 0x40000000, 0x20000000
T_NULL, T_STRING, T_NUMBER, T_FALSE, T_TRUE, T_CONTAINER = 0x00000000, 0x10000000, 0x20000000, 0x30000000, 0x40000000, 0x50000000
N_ZERO, N_NAN, N_INF, N_NEG_INF, N_INT, N_UINT, N_FLOAT = 0x00, 0x10, 0x20, 0x30, 0x40, 0x50, 0x60
LENGTH_BITS, ENTRY_BITS = 29, 28


def number_bytes(x: float | int) -> bytes:
    if isinstance(x, float):
        if math.isnan(x):
            return bytes([N_NAN])
        if math.isinf(x):
            return bytes([N_INF if x > 0 else N_NEG_INF])
        return bytes([N_FLOAT]) + struct.pack(">d", x)
    if x == 0:
        return bytes([N_ZERO])
    for width in (1, 2, 4, 8):
        limit = 1 << (8 * width)
        if (x > 0 and x < limit) or (x < 0 and -(limit >> 1) <= x):
            return bytes([N_UINT if x > 0 else N_INT]) + x.to_bytes(width, "big", signed=x < 0)
    raise JsonError("InvalidWireNumber")


def number_of(data: bytes) -> float | int:
    kind, body = data[0], data[1:]
    if kind == N_ZERO:
        return 0
    if kind in (N_NAN, N_INF, N_NEG_INF):
        return {N_NAN: math.nan, N_INF: math.inf, N_NEG_INF: -math.inf}[kind]
    if kind == N_FLOAT and len(body) == 8:
        return struct.unpack(">d", body)[0]
    if kind in (N_INT, N_UINT) and len(body) in (1, 2, 4, 8):
        return int.from_bytes(body, "big", signed=kind == N_INT)
    raise JsonError("InvalidWireNumber")


def _entry(value: Value) -> tuple[int, bytes]:
    if value is None:
        return T_NULL, b""
    if isinstance(value, bool):
        return (T_TRUE if value else T_FALSE), b""
    if isinstance(value, str):
        kind, body = T_STRING, value.encode("utf-8", "surrogatepass")
    elif isinstance(value, (int, float)):
        kind, body = T_NUMBER, number_bytes(value)
    else:
        kind, body = T_CONTAINER, _container(value)
    if len(body) >= 1 << ENTRY_BITS:
        raise JsonError("a member is too long")
    return kind | len(body), body


def _container(value: list | dict) -> bytes:
    if len(value) >= 1 << LENGTH_BITS:
        raise JsonError("too many members")
    if isinstance(value, list):
        kind, parts = ARRAY, [_entry(v) for v in value]
    else:
        members = sort_keys(value)
        kind, parts = OBJECT, [*map(_entry, members), *map(_entry, members.values())]
    head = struct.pack(f">{len(parts) + 1}I", kind | len(value), *(e for e, _ in parts))
    return head + b"".join(b for _, b in parts)


def encode(value: Value) -> bytes:
    """Wire bytes: big-endian header, entries, then the members' bytes."""
    if isinstance(value, (list, dict)):
        return _container(value)
    entry, body = _entry(value)
    return struct.pack(">2I", SCALAR | 1, entry) + body


def _take(data: bytes, at: int, n: int) -> bytes:
    if at + n > len(data):
        raise JsonError("InvalidWire")
    return data[at : at + n]


def _word(data: bytes, at: int) -> int:
    return int.from_bytes(_take(data, at, 4), "big")


def decode(data: bytes) -> Value:
    """The document of wire bytes."""
    head = _word(data, 0)
    kind, n = head & 0xE0000000, head & 0x1FFFFFFF
    if kind not in (ARRAY, OBJECT, SCALAR):
        raise JsonError("InvalidWireHeader")
    entries = n if kind == ARRAY else 2 * n if kind == OBJECT else 1
    _take(data, 4, 4 * entries)
    at, values = 4 + 4 * entries, []
    for i in range(entries):
        entry = _word(data, 4 + 4 * i)
        tag, body = entry & 0x70000000, _take(data, at, entry & 0x0FFFFFFF)
        at += len(body)
        if tag == T_STRING:
            values.append(body.decode("utf-8", "surrogatepass"))
        elif tag == T_NUMBER:
            values.append(number_of(body))
        elif tag == T_CONTAINER:
            values.append(decode(body))
        elif tag in (T_NULL, T_TRUE, T_FALSE):
            values.append({T_NULL: None, T_TRUE: True, T_FALSE: False}[tag])
        else:
            raise JsonError("InvalidWireEntry")
    if kind == SCALAR:
        return values[0]
    return values if kind == ARRAY else sort_keys(dict(zip(values[:n], values[n:], strict=True)))


def from_slice(data: bytes) -> Value:
    """Wire bytes, or else text."""
    try:
        return decode(data)
    except (JsonError, UnicodeDecodeError, IndexError):
        return parse(data.decode("utf-8"))


# ---------------------------------------------------------------- order
# Null > array > object > string > number > true > false.
LEVELS = {"null": 7, "array": 6, "object": 5, "string": 4, "number": 3, "true": 2, "false": 1, "invalid": 0}


def level(value: Value) -> int:
    if value is None:
        return LEVELS["null"]
    if isinstance(value, bool):
        return LEVELS["true" if value else "false"]
    if isinstance(value, str):
        return LEVELS["string"]
    if isinstance(value, (int, float)):
        return LEVELS["number"]
    return LEVELS["array" if isinstance(value, list) else "object"]


def compare_numbers(a: float | int, b: float | int) -> int:
    """Integers exactly; with a float on either side as doubles, NaN equal to itself and above all."""
    if isinstance(a, float) or isinstance(b, float):
        a, b = float(a), float(b)
        if math.isnan(a) or math.isnan(b):
            return math.isnan(a) - math.isnan(b)
    return (a > b) - (a < b)


def compare(a: Value, b: Value) -> int:
    """-1, 0 or 1 in the total order of documents."""
    la, lb = level(a), level(b)
    if la != lb:
        return 1 if la > lb else -1
    if isinstance(a, str):
        x, y = a.encode("utf-8", "surrogatepass"), b.encode("utf-8", "surrogatepass")
        return (x > y) - (x < y)
    if isinstance(a, list):
        for x, y in zip(a, b, strict=False):
            if c := compare(x, y):
                return c
        return (len(a) > len(b)) - (len(a) < len(b))
    if isinstance(a, dict):
        for (k, x), (m, y) in zip(sort_keys(a).items(), sort_keys(b).items(), strict=False):
            if c := compare(k, m) or compare(x, y):
                return c
        return (len(a) > len(b)) - (len(a) < len(b))
    if isinstance(a, (int, float)) and not isinstance(a, bool):
        return compare_numbers(a, b)
    return 0


order_key = cmp_to_key(compare)


def sort_key(value: Value, depth: int = 0) -> bytes:
    """Bytes that sort nearly as documents do, as a function of their own; ``order_bytes`` is exact.

    They depart from ``compare`` for integers beyond 2**53, for signed zeros, and
    where a string holds low control characters; all levels from 255 on count as one.
    """
    out = bytes([min(depth, 255), level(value)])
    if isinstance(value, str):
        return out + value.encode("utf-8", "surrogatepass")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return out + _double_bytes(float(value))
    if isinstance(value, list):
        return out + b"".join(sort_key(v, depth + 1) for v in value)
    if isinstance(value, dict):
        return out + b"".join(sort_key(k, depth + 1) + sort_key(v, depth + 1) for k, v in sort_keys(value).items())
    return out


def _double_bytes(x: float) -> bytes:
    bits = int.from_bytes(struct.pack(">d", x), "big")
    bits = bits ^ 0xFFFFFFFFFFFFFFFF if bits >> 63 else bits | 1 << 63
    return bits.to_bytes(8, "big")


def order_bytes(value: Value) -> bytes:
    """Bytes that sort as ``compare`` orders documents; those that it tells apart have different ones.

    Strings are escaped and ended, containers ended by a level below all others,
    so no document's bytes begin another's. A number is its double, then how far
    an integer lies from that, so integers are exact. (``compare`` takes an
    integer beyond 2**53 and a float for equal if they are so as doubles, though
    it tells such integers apart; here they differ as well.) Nesting may be of any depth.
    """
    out, todo = bytearray(), [value]
    while todo:
        v = todo.pop()
        if v is _END:
            out.append(0)
            continue
        out.append(level(v))
        if isinstance(v, str):
            out += v.encode("utf-8", "surrogatepass").replace(b"\x00", b"\x00\xff") + b"\x00\x00"
        elif isinstance(v, list):
            todo.append(_END)
            todo += reversed(v)
        elif isinstance(v, dict):
            todo.append(_END)
            for k, x in reversed(sort_keys(v).items()):
                todo += (x, k)
        elif isinstance(v, (int, float)) and not isinstance(v, bool):
            x = float(v)
            x = math.nan if math.isnan(x) else x + 0.0
            out += _double_bytes(x) + (0x8000 + (v - int(x) if isinstance(v, int) else 0)).to_bytes(2, "big")
    return bytes(out)


_END = object()
