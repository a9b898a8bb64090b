"""Serialized aggregate states: where one ends, and what it holds.

A state has no length of its own; only the functions below can be framed. ``read`` returns one state's bytes,
``value`` what it holds, ``make`` builds it.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from quarry.errors import InvalidData, NeedMore, UnsupportedType
from quarry.functions.types import T, decimal_width, delegate
from quarry.functions.wire import Reader, varint, varint_ends

#: How a sum accumulates each kind: bytes, signed, float.
_SUM = {k: ("Q", 8) for k in ("Bool", "UInt8", "UInt16", "UInt32", "UInt64")}
_SUM |= {k: ("q", 8) for k in ("Int8", "Int16", "Int32", "Int64", "Enum8", "Enum16")}
_SUM |= {k: ("d", 8) for k in ("BFloat16", "Float32", "Float64")}
_SUM |= {"UInt128": ("Q", 16), "Int128": ("q", 16), "UInt256": ("Q", 32), "Int256": ("q", 32)}


@dataclass(frozen=True)
class Codec:
    """A state's framing: ``count`` (a varint), ``zero`` (one zero byte) or ``sum`` (fixed width, maybe nullable)."""

    form: str
    kind: str = ""
    width: int = 0
    nullable: bool = False

    def read(self, r: Reader) -> bytes:
        start = r.pos
        if self.form == "count":
            r.varint()
        elif self.form == "zero":
            if r.u8() != 0:
                raise InvalidData("a state of nothing is not a zero byte")
        elif not self.nullable or r.u8() != 0:
            r.skip(self.width)
        return r.buf[start : r.pos]

    def read_many(self, r: Reader, n: int) -> np.ndarray:
        """The ends of ``n`` states, counted from the cursor, which moves behind the last."""
        if self.form == "count":
            return varint_ends(r, n)
        if self.form == "sum" and not self.nullable:
            r.skip(n * self.width)
            return np.arange(1, n + 1, dtype=np.int64) * self.width
        start, ends = r.pos, np.empty(n, dtype=np.int64)
        if self.form == "zero":
            if r.array("u1", n).any():
                raise InvalidData("a state of nothing is not a zero byte")
            return np.arange(1, n + 1, dtype=np.int64)
        buf, p, w = r.buf, r.pos, self.width + 1
        if n > r.remaining:
            raise NeedMore(f"{n} states need at least as many bytes", r.pos + n)
        for i in range(n):
            if p >= r.end:
                raise NeedMore("a state is cut short")
            p += w if buf[p] else 1
            ends[i] = p - start
        if p > r.end:
            raise NeedMore("a state is cut short")
        r.pos = p
        return ends

    def valid(self, state: bytes) -> bool:
        """Whether the bytes are exactly one state."""
        r = Reader(state)
        try:
            self.read(r)
        except (InvalidData, NeedMore):
            return False
        return r.remaining == 0

    def value(self, state: bytes):
        """The count or sum (decimals as their unscaled integer); None for a sum of nothing."""
        if self.form == "count":
            return Reader(state).varint()
        if self.form == "zero":
            return None
        if self.nullable:
            if state[0] == 0:
                return None
            state = state[1:]
        if self.kind == "d":
            return struct.unpack("<d", state)[0]
        return int.from_bytes(state, "little", signed=self.kind == "q")

    def make(self, value) -> bytes:
        """The state that holds ``value``; integers wrap at the accumulator's width."""
        if self.form == "count":
            return varint(value)
        if self.form == "zero":
            return b"\0"
        if self.nullable and value is None:
            return b"\0"
        if self.kind == "d":
            raw = struct.pack("<d", value)
        else:
            raw = (int(value) % (1 << 8 * self.width)).to_bytes(self.width, "little")
        return (b"\x01" if self.nullable else b"") + raw

    def merge(self, states: list[bytes]) -> bytes:
        """One state for the rows of all ``states``."""
        values = [v for v in map(self.value, states) if v is not None]
        if self.form == "zero":
            return b"\0"
        return self.make(sum(values) if values or not self.nullable else None)


def codec(t: T) -> Codec:
    """The codec of an AggregateFunction type; unknown functions raise ``UnsupportedType`` even for no rows."""
    function, *args = t.args
    nothing = len(args) == 1 and args[0] == T("Nullable", (T("Nothing"),))
    if function == "count" and len(args) <= 1 and not nothing:
        return Codec("count")
    if function in ("nothingUInt64", "nothingNull") and nothing:
        return Codec("zero")
    if function == "sum" and len(args) == 1:
        nullable = args[0].kind == "Nullable"
        inner = delegate(args[0].args[0] if nullable else args[0])
        if inner.kind == "Decimal":
            return Codec("sum", "q", max(16, decimal_width(inner.args[0])), nullable)
        if inner.kind in _SUM:
            return Codec("sum", *_SUM[inner.kind], nullable)
    raise UnsupportedType(f"no framing for states of {t}")
