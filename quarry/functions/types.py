"""The type system: a parser and a renderer of type names, legality rules, and delegates of aliases.

A type is a ``T``: a kind and its arguments. Rendering a parsed name gives its canonical spelling, and parsing
that gives the type again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from quarry.errors import UnsupportedType

MAX_DEPTH = 100

#: Bytes a row of each fixed-width kind takes.
WIDTHS = {
    "Int8": 1, "Int16": 2, "Int32": 4, "Int64": 8, "UInt8": 1, "UInt16": 2, "UInt32": 4, "UInt64": 8,
    "Float32": 4, "Float64": 8, "BFloat16": 2, "Int128": 16, "UInt128": 16, "Int256": 32, "UInt256": 32,
    "Date": 2, "Date32": 4, "DateTime": 4, "DateTime64": 8, "Time": 4, "Time64": 8,
    "UUID": 16, "IPv4": 4, "IPv6": 16, "Enum8": 1, "Enum16": 2, "Bool": 1, "Nothing": 1,
}
#: Interval kinds in the order of their binary tags.
INTERVALS = ("Nanosecond", "Microsecond", "Millisecond", "Second", "Minute", "Hour", "Day", "Week", "Month", "Quarter", "Year")
WIDTHS |= {f"Interval{k}": 8 for k in INTERVALS}

_PLAIN = {k for k in WIDTHS if k not in ("DateTime", "DateTime64", "Time64", "Enum8", "Enum16")} | {"String"}
GEO = ("Point", "Ring", "LineString", "MultiLineString", "Polygon", "MultiPolygon", "MultiPoint")
#: What stands for 32 dynamic types and 1024 dynamic paths is left out of a name.
DYNAMIC_TYPES, JSON_PATHS, JSON_TYPES = 32, 1024, 32
#: Functions whose merged state is a plain value.
SIMPLE_FUNCTIONS = (
    "any", "any_respect_nulls", "anyLast", "anyLast_respect_nulls", "min", "max", "sum", "sumWithOverflow",
    "groupBitAnd", "groupBitOr", "groupBitXor", "sumMap", "minMap", "maxMap", "sumMappedArrays", "minMappedArrays",
    "maxMappedArrays", "groupArrayArray", "groupArrayLastArray", "groupUniqArrayArray", "groupUniqArrayArrayMap",
)
#: Names that are always quoted.
KEYWORDS = ("null", "distinct", "all", "table", "select", "from", "values")


@dataclass(frozen=True)
class Json:
    """Arguments of a JSON type."""

    max_paths: int = JSON_PATHS
    max_types: int = JSON_TYPES
    typed: tuple = ()
    skip: tuple = ()
    skip_regexp: tuple = ()


@dataclass(frozen=True)
class T:
    """A type. ``args`` by kind: Nullable, LowCardinality, Array (T,); Map (K, V); Variant (T, ...); Tuple and
    Nested ((name or None, T), ...); Enum ((label, value), ...); Decimal (P, S); FixedString (N,); QBit (T, N);
    DateTime (zone or None,); DateTime64 (P, zone or None); Time64 (P,); Dynamic (max_types,); JSON (Json,);
    SimpleAggregateFunction (function, T); AggregateFunction (function, T, ...)."""

    kind: str
    args: tuple = ()

    def __str__(self) -> str:
        return render(self)


# ---- rendering


def quoted(text: str, quote: str = "'") -> str:
    """``text`` within quotes, with backslash escapes."""
    table = {"\\": "\\\\", quote: "\\" + quote, "\n": "\\n", "\t": "\\t", "\r": "\\r", "\0": "\\0", "\b": "\\b", "\f": "\\f"}
    return quote + "".join(table.get(c, c) for c in text) + quote


def name_text(name: str) -> str:
    """A name as it stands in a type: bare if it is a plain identifier, else in backticks."""
    bare = re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name) and name.lower() not in KEYWORDS
    return name if bare else quoted(name, "`")


def path_text(path: str) -> str:
    return name_text(path) if path.lower() != "skip" else quoted(path, "`")


def render(t: T) -> str:
    """The canonical name."""
    k, a = t.kind, t.args
    if k in ("Enum8", "Enum16"):
        return f"{k}({', '.join(f'{quoted(label)} = {value}' for label, value in a)})"
    if k == "DateTime":
        return "DateTime" if a[0] is None else f"DateTime('{a[0]}')"
    if k == "DateTime64":
        return f"DateTime64({a[0]})" if a[1] is None else f"DateTime64({a[0]}, '{a[1]}')"
    if k in ("Tuple", "Nested"):
        return f"{k}({', '.join(str(x) if n is None else f'{name_text(n)} {x}' for n, x in a)})"
    if k == "Dynamic":
        return "Dynamic" if a[0] == DYNAMIC_TYPES else f"Dynamic(max_types={a[0]})"
    if k == "JSON":
        j = a[0]
        parts = [f"max_dynamic_types={j.max_types}"] * (j.max_types != JSON_TYPES) + [f"max_dynamic_paths={j.max_paths}"] * (j.max_paths != JSON_PATHS)
        parts += [f"{path_text(p)} {x}" for p, x in j.typed] + [f"SKIP {path_text(p)}" for p in j.skip] + [f"SKIP REGEXP {quoted(p)}" for p in j.skip_regexp]
        return f"JSON({', '.join(parts)})" if parts else "JSON"
    if k == "Tuple" or a:
        return f"{k}({', '.join(str(x) for x in a)})"
    return k


# ---- parsing


def _split(text: str) -> list[str]:
    """Arguments at the commas outside parentheses and quotes."""
    parts, depth, start, i, n = [], 0, 0, 0, len(text)
    while i < n:
        c = text[i]
        if c in "'`":
            i = _quote_end(text, i)
            continue
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            parts.append(text[start:i].strip())
            start = i + 1
        i += 1
    parts.append(text[start:].strip())
    return [] if parts == [""] else parts


def _quote_end(text: str, i: int) -> int:
    """The place behind the quoted span that starts at ``i``; a doubled or escaped quote does not end it."""
    q, i = text[i], i + 1
    while i < len(text):
        if text[i] == "\\":
            i += 2
        elif text[i] == q:
            if text[i + 1 : i + 2] != q:
                return i + 1
            i += 2
        else:
            i += 1
    raise UnsupportedType("a quote is not closed")


def unquote(text: str) -> str:
    """The text of a quoted span."""
    if len(text) < 2 or text[0] not in "'`" or _quote_end(text, 0) != len(text):
        raise UnsupportedType(f"not a quoted text: {text}")
    q, body, out, i = text[0], text[1:-1], [], 0
    plain = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "f": "\f", "a": "\a", "v": "\v", "e": "\x1b"}
    while i < len(body):
        c = body[i]
        if c == "\\" and i + 1 < len(body):
            e = body[i + 1]
            if e == "x" and re.fullmatch("[0-9A-Fa-f]{2}", body[i + 2 : i + 4]):
                out.append(chr(int(body[i + 2 : i + 4], 16)))
                i += 4
                continue
            out.append(plain.get(e, e))
            i += 2
        elif c == q:
            out.append(q)
            i += 2
        else:
            out.append(c)
            i += 1
    return "".join(out)


def _number(text: str, low: int, high: int) -> int:
    if not re.fullmatch(r"\d+", text) or not low <= int(text) <= high:
        raise UnsupportedType(f"{text!r} is not a number from {low} to {high}")
    return int(text)


def _named(text: str) -> tuple[str | None, str]:
    """An optional leading name, and the rest."""
    if text.startswith("`"):
        end = _quote_end(text, 0)
        return unquote(text[:end]), text[end:].strip()
    m = re.match(r"([A-Za-z_][A-Za-z0-9_.]*)\s+(?=[A-Za-z`])", text)
    return (m[1], text[m.end() :]) if m else (None, text)


def _zone(text: str) -> str:
    zone = unquote(text)
    if "'" in zone or not zone:
        raise UnsupportedType(f"not a time zone: {text}")
    return zone


@lru_cache(maxsize=4096)
def parse(text: str) -> T:
    """The type that a name denotes; illegal names raise ``UnsupportedType``."""
    return _parse(text.strip(), 1)


def _parse(text: str, depth: int) -> T:
    if depth > MAX_DEPTH:
        raise UnsupportedType(f"types nest deeper than {MAX_DEPTH}")
    m = re.match(r"([A-Za-z0-9_]+)\s*(\(.*\))?\s*$", text, re.S)
    if not m:
        raise UnsupportedType(f"not a type: {text}")
    kind, inside = m[1], m[2]
    args = _split(inside[1:-1]) if inside else []
    sub = lambda x: _parse(x, depth + 1)
    if inside is None:
        if kind in _PLAIN or kind in GEO or kind == "Geometry":
            return T(kind)
        if kind == "DateTime":
            return T(kind, (None,))
        if kind == "Dynamic":
            return T(kind, (DYNAMIC_TYPES,))
        if kind == "JSON":
            return T(kind, (Json(),))
        raise UnsupportedType(f"unknown type {kind}")
    n = len(args)
    if kind == "DateTime" and n == 1:
        return T(kind, (_zone(args[0]),))
    if kind == "DateTime64" and n in (1, 2):
        return T(kind, (_number(args[0], 0, 9), _zone(args[1]) if n == 2 else None))
    if kind == "Time64" and n == 1:
        return T(kind, (_number(args[0], 0, 9),))
    if kind == "FixedString" and n == 1:
        return T(kind, (_number(args[0], 1, 0x7FFFFFFF),))
    if kind == "Decimal" and n == 2:
        p = _number(args[0], 1, 76)
        return T(kind, (p, _number(args[1], 0, p)))
    if kind in ("Decimal32", "Decimal64", "Decimal128", "Decimal256") and n == 1:
        p = {"Decimal32": 9, "Decimal64": 18, "Decimal128": 38, "Decimal256": 76}[kind]
        return T("Decimal", (p, _number(args[0], 0, p)))
    if kind in ("Enum8", "Enum16") and n:
        return T(kind, _enum(kind, args))
    if kind == "QBit" and n == 2:
        element = sub(args[0])
        if element.kind not in ("BFloat16", "Float32", "Float64"):
            raise UnsupportedType("QBit holds BFloat16, Float32 or Float64")
        return T(kind, (element, _number(args[1], 1, 1 << 30)))
    if kind in ("Nullable", "LowCardinality", "Array") and n == 1:
        return checked(T(kind, (sub(args[0]),)))
    if kind == "Map" and n == 2:
        return checked(T(kind, (sub(args[0]), sub(args[1]))))
    if kind == "Variant" and n:
        return variant(sub(a) for a in args)
    if kind in ("Tuple", "Nested"):
        pairs = []
        for a in args:
            name, rest = _named(a)
            pairs.append((name, sub(rest)))
        return checked(T(kind, tuple(pairs)))
    if kind == "Dynamic" and n == 1 and (d := re.fullmatch(r"max_types\s*=\s*(\d+)", args[0])):
        return T(kind, (_number(d[1], 0, 254),))
    if kind == "JSON":
        return T(kind, (_json(args, sub),))
    if kind == "SimpleAggregateFunction" and n == 2:
        if re.sub(r"\(.*\)$", "", args[0]) not in SIMPLE_FUNCTIONS:
            raise UnsupportedType(f"unknown simple aggregate function {args[0]}")
        return T(kind, (args[0], sub(args[1])))
    if kind == "AggregateFunction" and n:
        return T(kind, (args[0], *(sub(a) for a in args[1:])))
    raise UnsupportedType(f"not a type: {text}")


def _enum(kind: str, args: list[str]) -> tuple:
    low, high = (-128, 127) if kind == "Enum8" else (-32768, 32767)
    out, following = [], 1
    for a in args:
        if not a.startswith("'"):
            raise UnsupportedType(f"not an enum entry: {a}")
        end = _quote_end(a, 0)
        rest = a[end:].strip()
        if rest:
            m = re.fullmatch(r"=\s*([+-]?\d+)", rest)
            if not m:
                raise UnsupportedType(f"not an enum entry: {a}")
            following = int(m[1])
        if not low <= following <= high:
            raise UnsupportedType(f"{following} does not fit {kind}")
        out.append((unquote(a[:end]), following))
        following += 1
    if len({v for _, v in out}) < len(out) or len({x for x, _ in out}) < len(out):
        raise UnsupportedType(f"{kind} repeats a label or a value")
    return tuple(out)


def _json(args: list[str], sub) -> Json:
    paths, types, typed, skip, regexps = JSON_PATHS, JSON_TYPES, {}, [], []
    for a in args:
        if m := re.fullmatch(r"max_dynamic_paths\s*=\s*(\d+)", a):
            paths = _number(m[1], 0, 10_000)
        elif m := re.fullmatch(r"max_dynamic_types\s*=\s*(\d+)", a):
            types = _number(m[1], 0, 254)
        elif m := re.match(r"SKIP\s+REGEXP\s+", a, re.I):
            regexps.append(unquote(a[m.end() :]))
        elif m := re.match(r"SKIP\s+", a, re.I):
            rest = a[m.end() :]
            skip.append(unquote(rest) if rest.startswith("`") else rest)
        else:
            name, rest = _named(a)
            if name is None or name in typed:
                raise UnsupportedType(f"not a JSON argument: {a}")
            typed[name] = sub(rest)
    if len(typed) > 1000:
        raise UnsupportedType("JSON has more than 1000 typed paths")
    return Json(paths, types, tuple(sorted(typed.items())), tuple(sorted(set(skip))), tuple(regexps))


# ---- legality and delegates


def variant(alternatives) -> T:
    """A Variant of alternatives, sorted and made distinct by name."""
    named = {str(a): a for a in alternatives if delegate(a).kind != "Nothing"}
    for a in named.values():
        d = delegate(a)
        if d.kind in ("Nullable", "Variant", "Dynamic") or d.kind == "LowCardinality" and delegate(d.args[0]).kind == "Nullable":
            raise UnsupportedType(f"{a} can't be an alternative of a Variant")
    if not 1 <= len(named) <= 255:
        raise UnsupportedType("a Variant has 1 to 255 alternatives")
    return T("Variant", tuple(named[k] for k in sorted(named)))


#: Kinds that a dictionary may hold.
_DICTIONARY = {
    "Bool", "Int8", "Int16", "Int32", "Int64", "Int128", "Int256", "UInt8", "UInt16", "UInt32", "UInt64", "UInt128", "UInt256",
    "Float32", "Float64", "BFloat16", "String", "FixedString", "Date", "Date32", "DateTime", "Time", "UUID", "IPv4", "IPv6",
} | {f"Interval{k}" for k in INTERVALS}


def checked(t: T) -> T:
    """``t`` if it is legal by the kinds it directly holds."""
    if t.kind == "Nullable" and delegate(t.args[0]).kind in ("Nullable", "LowCardinality", "Array", "Map", "Variant", "Dynamic", "AggregateFunction"):
        raise UnsupportedType(f"{t.args[0]} can't be Nullable")
    if t.kind == "LowCardinality" and dictionary_value(t.args[0])[1].kind not in _DICTIONARY:
        raise UnsupportedType(f"{t.args[0]} can't have a dictionary")
    if t.kind == "Map":
        key = delegate(t.args[0])
        if key.kind == "Nullable" or key.kind == "LowCardinality" and dictionary_value(key.args[0])[0]:
            raise UnsupportedType("a Map's keys can't be null")
    if t.kind in ("Tuple", "Nested"):
        names = [n for n, _ in t.args]
        if any(n is not None for n in names) or t.kind == "Nested":
            if None in names or not names or len(set(names)) < len(names) or "" in names or any(n.lower() == "null" for n in names):
                raise UnsupportedType(f"{t.kind} needs distinct names for all elements or none")
    return t


_POINT = T("Tuple", ((None, T("Float64")), (None, T("Float64"))))
_array = lambda x: T("Array", (x,))
_EXPANDED = {"Point": _POINT, "Ring": _array(_POINT), "LineString": _array(_POINT), "MultiPoint": _array(_POINT)}
_EXPANDED |= {"MultiLineString": _array(_array(_POINT)), "Polygon": _array(_array(_POINT)), "MultiPolygon": _array(_array(_array(_POINT)))}
#: A Geometry's alternatives by discriminator.
GEOMETRY = ("LineString", "MultiLineString", "MultiPolygon", "Point", "Polygon", "Ring", "MultiPoint")


def delegate(t: T) -> T:
    """The type whose layout an alias has."""
    while True:
        if t.kind == "SimpleAggregateFunction":
            t = t.args[1]
        elif t.kind in _EXPANDED:
            return _EXPANDED[t.kind]
        elif t.kind == "Geometry":
            return T("Variant", tuple(T(k) for k in GEOMETRY))
        elif t.kind == "Nested":
            return _array(T("Tuple", t.args))
        else:
            return t


def dictionary_value(t: T) -> tuple[bool, T]:
    """Of what LowCardinality holds: whether it is nullable, and the type of the dictionary's values."""
    t = delegate(t)
    if t.kind == "Nullable":
        return True, delegate(t.args[0])
    return False, t


def decimal_width(precision: int) -> int:
    return 4 if precision <= 9 else 8 if precision <= 18 else 16 if precision <= 38 else 32


def fixed_width(t: T) -> int | None:
    """Bytes a row of a fixed-width type takes in bulk, or None."""
    if t.kind == "FixedString":
        return t.args[0]
    if t.kind == "Decimal":
        return decimal_width(t.args[0])
    return WIDTHS.get(t.kind)
