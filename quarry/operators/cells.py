"""Single values: a binary type descriptor followed by one value, as shared Dynamic and JSON data hold them.

Values are Python objects as ``pyarrow`` gives them for the type's Arrow type.
"""

from __future__ import annotations

import base64
import datetime
import decimal
import json
import math
import struct
from functools import lru_cache

import pyarrow as pa

from quarry.errors import InconsistentBatch, InvalidData, ResourceLimit, UnsupportedType
from quarry.functions import type_binary
from quarry.functions.arrow_types import arrow_type, element_names
from quarry.functions.types import T, delegate, dictionary_value, parse
from quarry.functions.wire import Reader, string, varint

#: Most elements of a type that takes no bytes.
MAX_ZERO_WIDTH = 1_000_000


#: Kinds whose single values are packed directly.
_PACKED = {k: struct.Struct("<" + f) for k, f in {"Int8": "b", "Int16": "h", "Int32": "i", "Int64": "q", "UInt8": "B", "UInt16": "H", "UInt32": "I", "Float64": "d"}.items()}


@lru_cache(maxsize=4096)
def descriptor(t: T) -> bytes:
    """The binary descriptor of a type, made once."""
    return type_binary.write(t)


def supported(t: T) -> bool:
    """Whether single values of ``t`` have a codec."""
    t = delegate(t)
    if t.kind in ("Variant", "Dynamic", "AggregateFunction"):
        return False
    if t.kind in ("Tuple", "Nested"):
        return all(supported(x) for _, x in t.args)
    if t.kind in ("Nullable", "Array", "Map", "LowCardinality"):
        return all(supported(x) for x in t.args)
    return True


def type_prefix(cell: bytes) -> tuple[T, int]:
    """A cell's type and how many bytes its descriptor takes."""
    r = Reader(cell)
    t = type_binary.read(r)
    return t, r.pos


def decode(cell: bytes) -> tuple[T, object]:
    """A whole cell's type and value; bytes left over raise ``InvalidData``."""
    r = Reader(cell)
    t = type_binary.read(r)
    value = read_value(t, r)
    if r.remaining:
        raise InvalidData(f"{r.remaining} bytes follow a single value")
    return t, value


def encode(t: T, value) -> bytes:
    """A cell that holds ``value``."""
    return descriptor(t) + encode_value(t, value)


def _zero_width(t: T) -> bool:
    t = delegate(t)
    return t.kind == "Nothing" or t.kind == "Tuple" and all(_zero_width(x) for _, x in t.args)


def read_value(t: T, r: Reader):
    """One value of ``t`` at the cursor."""
    from quarry.operators.columns import Options, State, read_body

    packed = _PACKED.get(t.kind)
    if packed is not None:
        return packed.unpack(r.take(packed.size))[0]
    if t.kind == "String":
        try:
            return r.string().decode()
        except UnicodeDecodeError as e:
            raise InvalidData("a String is not UTF-8") from e
    t = delegate(t)
    k = t.kind
    if k == "Nullable":
        return None if r.u8() else read_value(t.args[0], r)
    if k == "LowCardinality":
        return read_value(t.args[0], r)
    if k in ("Array", "Map"):
        n = r.varint()
        if n > (MAX_ZERO_WIDTH if all(map(_zero_width, t.args)) else r.remaining):
            raise ResourceLimit(f"a value claims {n} elements")
        if k == "Array":
            return [read_value(t.args[0], r) for _ in range(n)]
        return [{"key": read_value(t.args[0], r), "value": read_value(t.args[1], r)} for _ in range(n)]
    if k == "Tuple":
        return {name: read_value(x, r) for name, (_, x) in zip(element_names(t), t.args, strict=True)}
    if k == "QBit":
        if r.varint() != t.args[1]:
            raise InvalidData("a vector has another size than its type")
        return read_body(t.args[0], t.args[1], r, State(), Options()).to_pylist()
    if k == "Nothing":
        return None
    if k == "JSON":
        out = {}
        for _ in range(r.varint()):
            path = r.string().decode()
            typed = dict(t.args[0].typed)
            x = typed.get(path) or type_binary.read(r)
            out[path] = jsonable(x, read_value(x, r))
        from quarry.operators.columns import _nested

        return json.dumps(_nested(out), separators=(",", ":"), ensure_ascii=False)
    if not supported(t):
        raise UnsupportedType(f"no single values of {t}")
    return read_body(t, 1, r, State(), Options())[0].as_py()


def encode_value(t: T, value) -> bytes:
    """The bytes of one value, without a descriptor."""
    from quarry.operators.columns import Options, write_column

    packed = _PACKED.get(t.kind)
    if packed is not None:
        try:
            return packed.pack(value)
        except struct.error as e:
            raise InconsistentBatch(f"{value!r} does not fit {t}") from e
    if t.kind == "String":
        return string(value)
    t = delegate(t)
    k = t.kind
    if k == "Nullable":
        return b"\x01" if value is None else b"\0" + encode_value(t.args[0], value)
    if k == "LowCardinality":
        return encode_value(t.args[0], value)
    if k == "Array":
        return varint(len(value)) + b"".join(encode_value(t.args[0], v) for v in value)
    if k == "Map":
        return varint(len(value)) + b"".join(encode_value(t.args[0], v["key"]) + encode_value(t.args[1], v["value"]) for v in value)
    if k == "Tuple":
        return b"".join(encode_value(x, value[name]) for name, (_, x) in zip(element_names(t), t.args, strict=True))
    if k == "QBit":
        return varint(t.args[1]) + write_column(t.args[0], pa.array(value, arrow_type(t.args[0])), Options())
    if k == "Nothing":
        return b""
    if k == "JSON":
        from quarry.operators.columns import _paths

        flat, typed = _paths(json.loads(value)), dict(t.args[0].typed)
        parts = [string(p) + (encode_value(typed[p], from_json(typed[p], v)) if p in typed else inferred(v)["raw"]) for p, v in sorted(flat.items())]
        return varint(len(parts)) + b"".join(parts)
    if not supported(t):
        raise UnsupportedType(f"no single values of {t}")
    return write_column(t, pa.array([value], arrow_type(t)), Options())


def infer(value) -> T:
    """The type under which a JSON value is stored."""
    if isinstance(value, bool):
        return T("Bool")
    if isinstance(value, int):
        return T("Int64") if -(1 << 63) <= value < 1 << 63 else T("UInt64") if 0 <= value < 1 << 64 else T("Float64")
    if isinstance(value, float):
        return T("Float64")
    if isinstance(value, str):
        return T("String")
    if isinstance(value, dict):
        return parse("JSON")
    kinds = {infer(v) for v in value if v is not None}
    if len(kinds) > 1 and kinds <= {T("Int64"), T("Float64")}:
        kinds = {T("Float64")}
    if len(kinds) > 1:
        raise UnsupportedType("a JSON array of mixed types has no column type; write such columns as text")
    inner = kinds.pop() if kinds else T("String")
    return T("Array", (inner if inner.kind in ("Array", "Map") else T("Nullable", (inner,)),))


def inferred(value) -> dict:
    """A Dynamic's row for a JSON value: its type, text and cell."""
    t = infer(value)
    v = from_json(t, value)
    return {"type": str(t), "value": json.dumps(value, separators=(",", ":"), ensure_ascii=False), "raw": encode(t, v)}


def from_json(t: T, value):
    """A JSON value as a value of ``t``."""
    t = delegate(t)
    if value is None:
        return None
    if t.kind == "Nullable":
        return from_json(t.args[0], value)
    if t.kind == "LowCardinality":
        return from_json(dictionary_value(t.args[0])[1], value)
    if t.kind == "Array":
        return [from_json(t.args[0], v) for v in value]
    if t.kind in ("Float32", "Float64", "BFloat16"):
        return float(value)
    if t.kind == "JSON":
        return json.dumps(value, separators=(",", ":"), ensure_ascii=False)
    if t.kind == "String" and not isinstance(value, str):
        return json.dumps(value, separators=(",", ":"), ensure_ascii=False)
    if t.kind == "UInt64" or t.kind == "Decimal":
        return decimal.Decimal(str(value))
    if pa.types.is_date(arrow_type(t)):
        return datetime.date.fromisoformat(value)
    return value


def jsonable(t: T, value):
    """A value as JSON has it; bytes in base64."""
    t = delegate(t)
    if value is None:
        return None
    if t.kind == "JSON":
        return json.loads(value)
    if isinstance(value, float) and not math.isfinite(value):
        return str(value)
    if t.kind in ("Nullable", "LowCardinality"):
        return jsonable(t.args[0], value)
    if t.kind in ("Array", "QBit"):
        return [jsonable(t.args[0], v) for v in value]
    if t.kind == "Map":
        return [[jsonable(t.args[0], v["key"]), jsonable(t.args[1], v["value"])] for v in value]
    if t.kind == "Tuple":
        return {n: jsonable(x, value[n]) for n, (_, x) in zip(element_names(t), t.args, strict=True)}
    if t.kind in ("Int128", "UInt128", "Int256", "UInt256"):
        return int.from_bytes(value, "little", signed=t.kind[0] == "I")
    if isinstance(value, decimal.Decimal):
        return int(value) if t.kind == "UInt64" else str(value)
    if isinstance(value, bytes):
        return base64.b64encode(value).decode()
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, datetime.timedelta):
        return value // datetime.timedelta(microseconds=1)
    return value


def text(t: T, value) -> str:
    """A value as JSON text."""
    return json.dumps(jsonable(t, value), separators=(",", ":"), ensure_ascii=False)
