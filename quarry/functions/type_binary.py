"""Binary type descriptors: a tag byte for each kind and its arguments."""

from __future__ import annotations

from quarry.errors import ResourceLimit, UnsupportedType
from quarry.functions.types import GEO, INTERVALS, MAX_DEPTH, Json, T, checked, parse, variant
from quarry.functions.wire import Reader, string, varint

MAX_NODES, MAX_LIST = 2001, 1_000_000

#: Tags of kinds without arguments.
PLAIN = {
    "Nothing": 0x00, "UInt8": 0x01, "UInt16": 0x02, "UInt32": 0x03, "UInt64": 0x04, "UInt128": 0x05, "UInt256": 0x06,
    "Int8": 0x07, "Int16": 0x08, "Int32": 0x09, "Int64": 0x0A, "Int128": 0x0B, "Int256": 0x0C, "Float32": 0x0D, "Float64": 0x0E,
    "Date": 0x0F, "Date32": 0x10, "String": 0x15, "UUID": 0x1D, "IPv4": 0x28, "IPv6": 0x29, "Bool": 0x2D, "BFloat16": 0x31, "Time": 0x32,
}
#: Tags of kinds with arguments.
TAG = {
    "DateTime": 0x11, "DateTimeZone": 0x12, "DateTime64": 0x13, "DateTime64Zone": 0x14, "FixedString": 0x16, "Enum8": 0x17, "Enum16": 0x18,
    "Decimal32": 0x19, "Decimal64": 0x1A, "Decimal128": 0x1B, "Decimal256": 0x1C, "Array": 0x1E, "Tuple": 0x1F, "NamedTuple": 0x20,
    "Interval": 0x22, "Nullable": 0x23, "AggregateFunction": 0x25, "LowCardinality": 0x26, "Map": 0x27, "Variant": 0x2A, "Dynamic": 0x2B,
    "Custom": 0x2C, "SimpleAggregateFunction": 0x2E, "Nested": 0x2F, "JSON": 0x30, "Time64": 0x34, "QBit": 0x36,
}
_BY_TAG = {v: k for k, v in (PLAIN | TAG).items()}


def write(t: T) -> bytes:
    """The descriptor of ``t``; aliases and aggregate functions are written by name."""
    k, a = t.kind, t.args
    if k in PLAIN:
        return bytes([PLAIN[k]])
    if k in GEO or k in ("Geometry", "SimpleAggregateFunction", "AggregateFunction"):
        return bytes([TAG["Custom"]]) + string(str(t))
    if k.startswith("Interval"):
        return bytes([TAG["Interval"], INTERVALS.index(k.removeprefix("Interval"))])
    if k == "DateTime":
        return bytes([TAG["DateTime"]]) if a[0] is None else bytes([TAG["DateTimeZone"]]) + string(a[0])
    if k == "DateTime64":
        return bytes([TAG["DateTime64"], a[0]]) if a[1] is None else bytes([TAG["DateTime64Zone"], a[0]]) + string(a[1])
    if k == "Time64":
        return bytes([TAG[k], a[0]])
    if k == "FixedString":
        return bytes([TAG[k]]) + varint(a[0])
    if k in ("Enum8", "Enum16"):
        size = 1 if k == "Enum8" else 2
        return bytes([TAG[k]]) + varint(len(a)) + b"".join(string(x) + v.to_bytes(size, "little", signed=True) for x, v in a)
    if k == "Decimal":
        name = "Decimal32" if a[0] <= 9 else "Decimal64" if a[0] <= 18 else "Decimal128" if a[0] <= 38 else "Decimal256"
        return bytes([TAG[name], a[0], a[1]])
    if k == "QBit":
        return bytes([TAG[k]]) + write(a[0]) + varint(a[1])
    if k == "Dynamic":
        return bytes([TAG[k], a[0]])
    if k == "Tuple" and a and a[0][0] is not None or k == "Nested":
        return bytes([TAG["NamedTuple" if k == "Tuple" else k]]) + varint(len(a)) + b"".join(string(n) + write(x) for n, x in a)
    if k == "Tuple":
        return bytes([TAG[k]]) + varint(len(a)) + b"".join(write(x) for _, x in a)
    if k == "JSON":
        j = a[0]
        out = [bytes([TAG[k], 0]), varint(j.max_paths), bytes([j.max_types]), varint(len(j.typed))]
        out += [string(p) + write(x) for p, x in j.typed]
        return b"".join([*out, varint(len(j.skip)), *map(string, j.skip), varint(len(j.skip_regexp)), *map(string, j.skip_regexp)])
    if k == "Variant":
        return bytes([TAG[k]]) + varint(len(a)) + b"".join(map(write, a))
    if k in ("Nullable", "LowCardinality", "Array", "Map"):
        return bytes([TAG[k]]) + b"".join(map(write, a))
    raise UnsupportedType(f"no descriptor for {t}")


def read(r: Reader) -> T:
    """The type that a descriptor at the cursor denotes."""
    return _Descriptor(r).type(1)


class _Descriptor:
    def __init__(self, r: Reader):
        self.r = r
        self.nodes = 0

    def length(self) -> int:
        n = self.r.varint()
        if n > MAX_LIST:
            raise ResourceLimit(f"a descriptor lists {n} entries")
        return n

    def text(self) -> str:
        return self.r.string().decode()

    def type(self, depth: int) -> T:
        self.nodes += 1
        if depth > MAX_DEPTH or self.nodes > MAX_NODES:
            raise ResourceLimit("a descriptor is too deep or too large")
        r, tag = self.r, self.r.u8()
        kind = _BY_TAG.get(tag)
        if kind is None:
            raise UnsupportedType(f"no type has the tag {tag:#x}")
        if kind in PLAIN:
            return T(kind)
        sub = lambda: self.type(depth + 1)
        if kind in ("Nullable", "LowCardinality", "Array"):
            return checked(T(kind, (sub(),)))
        if kind == "Map":
            return checked(T(kind, (sub(), sub())))
        if kind == "Variant":
            return variant([sub() for _ in range(self.length())])
        if kind == "Tuple":
            return T(kind, tuple((None, sub()) for _ in range(self.length())))
        if kind in ("NamedTuple", "Nested"):
            return checked(T("Tuple" if kind == "NamedTuple" else kind, tuple((self.text(), sub()) for _ in range(self.length()))))
        if kind == "DateTime":
            return T(kind, (None,))
        if kind == "DateTimeZone":
            return parse(f"DateTime('{self.text()}')")
        if kind == "DateTime64":
            return parse(f"DateTime64({r.u8()})")
        if kind == "DateTime64Zone":
            return parse(f"DateTime64({r.u8()}, '{self.text()}')")
        if kind == "Time64":
            return parse(f"Time64({r.u8()})")
        if kind == "FixedString":
            return parse(f"FixedString({r.varint()})")
        if kind in ("Enum8", "Enum16"):
            size = 1 if kind == "Enum8" else 2
            return T(kind, tuple((self.text(), int.from_bytes(r.take(size), "little", signed=True)) for _ in range(self.length())))
        if kind.startswith("Decimal"):
            return parse(f"Decimal({r.u8()}, {r.u8()})")
        if kind == "Interval":
            n = r.u8()
            if n >= len(INTERVALS):
                raise UnsupportedType(f"no interval has the tag {n}")
            return T(f"Interval{INTERVALS[n]}")
        if kind == "QBit":
            return parse(f"QBit({sub()}, {r.varint()})")
        if kind == "Dynamic":
            return T(kind, (r.u8(),))
        if kind == "Custom":
            return parse(self.text())
        if kind == "JSON":
            if r.u8() != 0:
                raise UnsupportedType("a JSON descriptor of another version")
            paths, types = r.varint(), r.u8()
            typed = tuple(sorted((self.text(), sub()) for _ in range(self.length())))
            skip = tuple(sorted(self.text() for _ in range(self.length())))
            return T(kind, (Json(paths, types, typed, skip, tuple(self.text() for _ in range(self.length()))),))
        if kind == "AggregateFunction":
            r.varint()
            name = self.text()
            if self.length():
                raise UnsupportedType("aggregate functions with parameters have no codec")
            return T(kind, (name, *(sub() for _ in range(self.length()))))
        name = self.text()
        if self.length():
            raise UnsupportedType("aggregate functions with parameters have no codec")
        return parse(f"SimpleAggregateFunction({name}, {[sub() for _ in range(self.length())][0]})")
