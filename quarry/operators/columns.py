"""Column codecs: for each type the state prefix, and reading, writing and skipping its values.

A column is its state prefixes (pre-order, ahead of all values) and then its body. ``read_prefix`` returns the
state that ``read_body`` and ``skip_body`` need; ``write_prefix`` and ``write_body`` are their inverses over
Arrow arrays of ``arrow_type``. Values are moved with numpy, by column and never by row, but for the types whose
layout differs from row to row (strings' lengths, states, Dynamic and JSON).
"""

from __future__ import annotations

import datetime
import decimal
import json
import uuid as uuids
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quarry.errors import InconsistentBatch, InvalidData, NeedMore, ResourceLimit, UnsupportedSerialization, UnsupportedType
from quarry.functions import type_binary
from quarry.functions import wire
from quarry.functions.arrow_types import DYNAMIC, arrow_type
from quarry.functions.types import T, decimal_width, delegate, dictionary_value, fixed_width, parse
from quarry.functions.wire import Reader, u64, varint
from quarry.operators import states

FLAT_DYNAMIC_REVISION = 54473
_NUMPY = {"Int8": "i1", "Int16": "<i2", "Int32": "<i4", "Int64": "<i8", "UInt8": "u1", "UInt16": "<u2", "UInt32": "<u4", "UInt64": "<u8", "Float32": "<f4", "Float64": "<f8"}


@dataclass
class Options:
    """How blocks are read and written."""

    revision: int = 0
    binary_types: bool = False
    flattened: bool = False
    strings: str = "utf8"  # or "binary"; "utf8" rejects other bytes
    json_text: bool = False
    max_synthetic: int = 256 << 20


@dataclass
class State:
    """State of a column: what its prefix said, and the states of the types inside it."""

    inside: list = field(default_factory=list)
    word: int = 0
    types: list = field(default_factory=list)  # of a Dynamic, in the order of the wire's table
    paths: list = field(default_factory=list)  # of a JSON


def masked(a: pa.Array, null: np.ndarray | None) -> pa.Array:
    """``a`` with the rows of a boolean mask null."""
    if null is None or not null.any():
        return a
    if pa.types.is_null(a.type):
        return a
    return pc.if_else(pa.array(null), pa.scalar(None, a.type), a)


# ---------------------------------------------------------------- prefixes


def read_prefix(t: T, r: Reader, o: Options) -> State:
    t = delegate(t)
    s = State()
    if t.kind in ("Nullable", "Array"):
        s.inside = [read_prefix(t.args[0], r, o)]
    elif t.kind == "Tuple":
        s.inside = [read_prefix(x, r, o) for _, x in t.args]
    elif t.kind == "Map":
        s.inside = [read_prefix(x, r, o) for x in t.args]
    elif t.kind == "LowCardinality":
        if r.u64() != 1:
            raise UnsupportedSerialization("a dictionary's key version is not 1")
    elif t.kind == "Variant":
        if r.u64() != 0:
            raise UnsupportedSerialization("a Variant's mode is not 0")
        s.inside = [read_prefix(x, r, o) for x in t.args]
    elif t.kind == "Dynamic":
        _read_dynamic_prefix(t, r, o, s)
    elif t.kind == "JSON":
        _read_json_prefix(t, r, o, s)
    return s


def _type_entry(r: Reader, o: Options) -> T:
    return type_binary.read(r) if o.binary_types else parse(r.string().decode())


def _read_dynamic_prefix(t: T, r: Reader, o: Options, s: State) -> None:
    s.word = r.u64()
    if s.word not in (1, 2, 3):
        raise UnsupportedSerialization(f"a Dynamic's word is {s.word}")
    if s.word == 1:
        r.varint()
    n = r.varint()
    if s.word != 3 and n > min(254, t.args[0]):
        raise InvalidData(f"a Dynamic of {t.args[0]} types has {n}")
    s.types = [_type_entry(r, o) for _ in range(n)]
    if len(set(map(str, s.types))) < n:
        raise InvalidData("a Dynamic repeats a type")
    if s.word == 3:
        s.inside = [read_prefix(x, r, o) for x in s.types]
        return
    if r.u64() != 0:
        raise UnsupportedSerialization("a Dynamic's inner mode is not 0")
    s.types.sort(key=str)
    s.inside = [read_prefix(x, r, o) for x in s.types]


def _read_json_prefix(t: T, r: Reader, o: Options, s: State) -> None:
    j = t.args[0]
    s.word = r.u64()
    if s.word == 1:
        return
    if s.word not in (0, 2, 3):
        raise UnsupportedSerialization(f"a JSON's word is {s.word}")
    if s.word == 0:
        r.varint()
    n = r.varint()
    if s.word != 3 and n > j.max_paths:
        raise InvalidData(f"a JSON of {j.max_paths} paths has {n}")
    s.paths = [r.string().decode() for _ in range(n)]
    if len(set(s.paths)) < n:
        raise InvalidData("a JSON repeats a path")
    dynamic = T("Dynamic", (j.max_types,))
    s.inside = [read_prefix(x, r, o) for _, x in j.typed] + [read_prefix(dynamic, r, o) for _ in s.paths]


# ---------------------------------------------------------------- reading bodies


def read_body(t: T, n: int, r: Reader, s: State, o: Options, null: np.ndarray | None = None) -> pa.Array:
    """``n`` values of ``t``; ``null`` marks rows whose values are placeholders."""
    t = delegate(t)
    k = t.kind
    if k == "Nullable":
        mask = r.array("u1", n) != 0
        return read_body(t.args[0], n, r, s.inside[0], o, mask if null is None else mask | null)
    reader = _READ.get(k)
    if reader is not None:
        return reader(t, n, r, s, o, null)
    if k.startswith("Interval"):
        return pa.array(r.array("<i8", n), mask=null)
    raise UnsupportedType(f"no codec for {t}")


def _plain(t, n, r, s, o, null):
    a = r.array(_NUMPY[t.kind], n)
    if t.kind == "UInt64":
        return masked(decimals(np.stack([a, np.zeros(n, dtype="<u8")], axis=1), 20, 0), null)
    target = arrow_type(t, o.strings)
    return pa.array(a.astype(target.to_pandas_dtype()) if t.kind.startswith("U") else a, type=target, mask=null)


def decimals(words: np.ndarray, precision: int, scale: int) -> pa.Array:
    """A decimal array of 128-bit integers given as rows of two 64-bit words."""
    data = np.ascontiguousarray(words).tobytes()
    return pa.Array.from_buffers(pa.decimal128(precision, scale), len(words), [None, pa.py_buffer(data)])


def _fixed_bytes(width: int, n: int, r: Reader) -> pa.Array:
    data = r.take(width * n)
    return pa.Array.from_buffers(pa.binary(width), n, [None, pa.py_buffer(data)]).cast(pa.binary())


def _bytes_of(t, n, r, s, o, null):
    return masked(_fixed_bytes(fixed_width(t), n, r), null)


def _bool(t, n, r, s, o, null):
    return pa.array(r.array("u1", n) != 0, mask=null)


def _nothing(t, n, r, s, o, null):
    r.skip(n)
    return pa.nulls(n)


def _bfloat(t, n, r, s, o, null):
    return pa.array((r.array("<u2", n).astype("<u4") << 16).view("<f4"), mask=null)


def _date(t, n, r, s, o, null):
    a = r.array("<u2" if t.kind == "Date" else "<i4", n).astype("<i4")
    return pa.array(a, type=pa.int32(), mask=null).cast(pa.date32())


def _datetime(t, n, r, s, o, null):
    return pa.array(r.array("<u4", n).astype("<i8") * 1_000_000, type=pa.int64(), mask=null).cast(pa.timestamp("us", "UTC"))


def _ticks(t, n, r, s, o, null):
    a = r.array("<i8", n)
    if t.args[0] > 6:
        return pa.array(a, mask=null)
    return pa.array(a * 10 ** (6 - t.args[0]), mask=null).cast(arrow_type(t, o.strings))


def _time(t, n, r, s, o, null):
    return pa.array(r.array("<i4", n).astype("<i8") * 1_000_000, mask=null).cast(pa.duration("us"))


def _uuid(t, n, r, s, o, null):
    halves = r.array("<u8", 2 * n).astype(">u8").tobytes().hex()
    texts = [f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}" for h in (halves[i : i + 32] for i in range(0, 32 * n, 32))]
    return masked(pa.array(texts, pa.string()), null)


def _ipv4(t, n, r, s, o, null):
    return pa.array(r.array("<u4", n).astype("<i8"), mask=null)


def _enum(t, n, r, s, o, null):
    a = r.array(_NUMPY["Int8" if t.kind == "Enum8" else "Int16"], n)
    values = np.array([v for _, v in t.args])
    order = np.argsort(values)
    at = np.minimum(np.searchsorted(values[order], a), len(values) - 1)
    known = values[order][at] == a
    if null is not None:
        known |= null
    if not known.all():
        raise InvalidData(f"{t.kind} holds a value without a label")
    labels = pa.array([x for x, _ in t.args])
    return labels.take(pa.array(order[at], mask=null))


def _string(t, n, r, s, o, null):
    offsets, data = wire.read_strings(r, n)
    a = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    if o.strings == "utf8":
        try:
            a = a.cast(pa.string())
        except pa.ArrowInvalid as e:
            raise InvalidData("a String is not UTF-8; read with strings=binary") from e
    return masked(a, null)


def _decimal(t, n, r, s, o, null):
    width = decimal_width(t.args[0])
    if width == 32:
        return masked(_fixed_bytes(32, n, r), null)
    if width == 16:
        words = r.array("<u8", 2 * n).reshape(n, 2)
    else:
        low = r.array(f"<i{width}", n).astype("<i8")
        words = np.stack([low, low >> 63], axis=1)
    return masked(decimals(words, *t.args), null)


def _array(t, n, r, s, o, null):
    offsets = _offsets(n, r)
    inside = read_body(t.args[0], int(offsets[-1]), r, s.inside[0], o)
    return _list(offsets, inside, arrow_type(t, o.strings), null)


def _offsets(n: int, r: Reader) -> np.ndarray:
    ends = r.array("<u8", n)
    out = np.zeros(n + 1, dtype="<u8")
    out[1:] = ends
    if (out[1:] < out[:-1]).any():
        raise InvalidData("an Array's offsets fall")
    if out[-1] > 0x7FFFFFFF:
        raise InvalidData("an Array has too many elements for one block")
    if out[-1] > r.remaining:
        raise NeedMore("an Array's elements are cut short", r.pos + int(out[-1]))
    return out.astype("<i4")


def _list(offsets: np.ndarray, inside: pa.Array, kind: pa.DataType, null: np.ndarray | None) -> pa.Array:
    if inside.type != kind.value_type:
        inside = inside.cast(kind.value_type)
    a = pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets)], children=[inside])
    return masked(a, null)


def _map(t, n, r, s, o, null):
    offsets = _offsets(n, r)
    total = int(offsets[-1])
    keys = read_body(t.args[0], total, r, s.inside[0], o)
    items = read_body(t.args[1], total, r, s.inside[1], o)
    kind = arrow_type(t, o.strings)
    return _list(offsets, pa.StructArray.from_arrays([keys, items], fields=list(kind.value_type)), kind, null)


def _tuple(t, n, r, s, o, null):
    if not t.args:
        r.skip(n)
        a = pa.Array.from_buffers(pa.struct([]), n, [None])
    else:
        parts = [read_body(x, n, r, i, o) for (_, x), i in zip(t.args, s.inside, strict=True)]
        a = pa.StructArray.from_arrays(parts, fields=list(arrow_type(t, o.strings)))
    return masked(a, null)


def _spread(tags: np.ndarray, children: list[pa.Array]) -> list[pa.Array]:
    """Dense children laid out over all rows: null where the row's tag is another child's."""
    out = []
    for i, child in enumerate(children):
        own = tags == i
        at = np.cumsum(own) - 1
        out.append(child.take(pa.array(np.where(own, at, 0), mask=~own)))
    return out


def _counts(tags: np.ndarray, n: int) -> list[int]:
    return [int((tags == i).sum()) for i in range(n)]


def _variant(t, n, r, s, o, null):
    tags = r.array("u1", n)
    if ((tags >= len(t.args)) & (tags != 255)).any():
        raise InvalidData("a Variant's discriminator has no alternative")
    children = [read_body(a, c, r, i, o) for a, c, i in zip(t.args, _counts(tags, len(t.args)), s.inside, strict=True)]
    tag = pa.array(tags.astype("<i2"), mask=tags == 255)
    a = pa.StructArray.from_arrays([tag, *_spread(tags, children)], fields=list(arrow_type(t, o.strings)))
    return masked(a, null)


def _low_cardinality(t, n, r, s, o, null):
    nullable, value = dictionary_value(t.args[0])
    if n == 0:
        return pa.array([], arrow_type(t, o.strings))
    word = r.u64()
    if word & 0xFF > 3 or word & 0x100 or not word & 0x200:
        raise UnsupportedSerialization(f"a dictionary's index word is {word:#x}")
    keys = read_body(value, r.u64(), r, State(), o)
    if r.u64() != n:
        raise InvalidData("a dictionary column has another number of rows")
    at = r.array(("u1", "<u2", "<u4", "<u8")[word & 0xFF], n).astype("<i8")
    if n and (at >= len(keys)).any() or (at < 0).any():
        raise InvalidData("a dictionary index has no key")
    if nullable:
        null = (at == 0) if null is None else null | (at == 0)
    return keys.take(pa.array(at, mask=null))


def _qbit(t, n, r, s, o, null):
    element, size = t.args
    bits = {"BFloat16": 16, "Float32": 32, "Float64": 64}[element.kind]
    width = -(-size // 8)
    planes = r.array("u1", bits * n * width).reshape(bits, n, width)
    # The last byte of a row holds the first eight elements, least bit first; the first plane holds the top bits.
    flags = np.unpackbits(planes[:, :, ::-1], axis=2, bitorder="little")[:, :, :size]
    words = np.packbits(flags[::-1].transpose(1, 2, 0), axis=2, bitorder="little").reshape(n * size, bits // 8)
    raw = np.ascontiguousarray(words)
    values = (raw.view("<u2")[:, 0].astype("<u4") << 16).view("<f4") if bits == 16 else raw.view(f"<f{bits // 8}")[:, 0]
    return _list(np.arange(0, (n + 1) * size, size, dtype="<i4") if size else np.zeros(n + 1, "<i4"), pa.array(values), arrow_type(t, o.strings), null)


def _state(t, n, r, s, o, null):
    start = r.pos
    ends = states.codec(t).read_many(r, n)
    offsets = np.concatenate([[0], ends]).astype("<i4")
    return masked(pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(r.buf[start : r.pos])]), null)


def _dynamic(t, n, r, s, o, null):
    from quarry.operators import cells

    if s.word == 3:
        k = len(s.types)
        tags = r.array("u1" if k + 1 <= 256 else "<u2" if k + 1 <= 65536 else "<u4", n).astype("<i8")
        if (tags > k).any():
            raise InvalidData("a Dynamic's index has no type")
        order, shared = list(range(k)), -1
        tags = np.where(tags == k, 255 if k < 255 else -1, tags)
        valid = tags < k if k < 255 else tags >= 0
    else:
        names = sorted([*map(str, s.types), "SharedVariant"])
        shared = names.index("SharedVariant")
        order = [i for i in range(len(names)) if i != shared]
        tags = r.array("u1", n)
        if ((tags >= len(names)) & (tags != 255)).any():
            raise InvalidData("a Dynamic's discriminator has no type")
        valid = tags != 255
    kinds: list = [None] * n
    raws: list = [None] * n
    texts: list = [None] * n
    typed = iter(zip(s.types, s.inside, strict=True))
    for i in range(len(order) + (shared >= 0)):
        rows = np.flatnonzero((tags == i) & valid).tolist()
        if i == shared:
            offsets, data = wire.read_strings(r, len(rows))
            for row, a, b in zip(rows, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                x, value = cells.decode(data[a:b])
                kinds[row], raws[row], texts[row] = str(x), data[a:b], cells.text(x, value)
            continue
        x, state = next(typed)
        body = read_body(x, len(rows), r, state, o).to_pylist()
        head = cells.descriptor(x)
        for row, value in zip(rows, body, strict=True):
            kinds[row], texts[row] = str(x), cells.text(x, value)
            raws[row] = head + cells.encode_value(x, value) if cells.supported(x) else None
    a = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(texts, pa.string()), pa.array(raws, pa.binary())], fields=list(DYNAMIC))
    empty = np.array([x is None for x in kinds], dtype=bool)
    return masked(a, empty if null is None else empty | null)


def _json(t, n, r, s, o, null):
    from quarry.operators import cells

    if s.word == 1:
        return _string(t, n, r, s, replace(o, strings="utf8"), null)
    j = t.args[0]
    _check_pathless(j, n, s, o)
    rows: list[dict] = [{} for _ in range(n)]
    for (path, x), state in zip(j.typed, s.inside, strict=False):
        for row, value in zip(rows, read_body(x, n, r, state, o).to_pylist(), strict=True):
            row[path] = cells.jsonable(x, value)
    dynamic = T("Dynamic", (j.max_types,))
    for path, state in zip(s.paths, s.inside[len(j.typed) :], strict=True):
        for row, value in zip(rows, read_body(dynamic, n, r, state, o).to_pylist(), strict=True):
            if value is not None:
                row[path] = json.loads(value["value"])
    if s.word != 3:
        offsets = _offsets(n, r)
        total = int(offsets[-1])
        (po, paths), (vo, cellsd) = wire.read_strings(r, total), wire.read_strings(r, total)
        for row in range(n):
            for i in range(offsets[row], offsets[row + 1]):
                x, value = cells.decode(cellsd[vo[i] : vo[i + 1]])
                rows[row][paths[po[i] : po[i + 1]].decode()] = cells.jsonable(x, value)
    return masked(pa.array([json.dumps(_nested(x), separators=(",", ":"), ensure_ascii=False) for x in rows], pa.string()), null)


def _check_pathless(j, n: int, s: State, o: Options) -> None:
    """Flattened objects without any path take no bytes, so nothing else bounds their number."""
    if s.word == 3 and not j.typed and not s.paths and 16 * n > o.max_synthetic:
        raise ResourceLimit(f"{n} objects that take no bytes")


def _nested(flat: dict) -> dict:
    """An object of dotted paths as nested objects, keys in order.

    Where a path goes on below a value (``a`` and ``a.b``), its rest stays a dotted key beside that value.
    """
    out: dict = {}
    made = {id(out)}
    for path in sorted(flat):
        at, keys = out, path.split(".")
        while len(keys) > 1:
            inside = at.setdefault(keys[0], {})
            if inside == {}:
                made.add(id(inside))
            if id(inside) not in made:
                break
            at, keys = inside, keys[1:]
        at[".".join(keys)] = flat[path]
    return out


_READ = {
    **dict.fromkeys(_NUMPY, _plain), "Bool": _bool, "Nothing": _nothing, "BFloat16": _bfloat, "Date": _date, "Date32": _date, "DateTime": _datetime,
    "DateTime64": _ticks, "Time64": _ticks, "Time": _time, "UUID": _uuid, "IPv4": _ipv4, "IPv6": _bytes_of, "Enum8": _enum, "Enum16": _enum,
    "String": _string, "FixedString": _bytes_of, "Decimal": _decimal, "Array": _array, "Map": _map, "Tuple": _tuple, "Variant": _variant,
    "LowCardinality": _low_cardinality, "QBit": _qbit, "AggregateFunction": _state, "Dynamic": _dynamic, "JSON": _json,
    **dict.fromkeys(("Int128", "UInt128", "Int256", "UInt256"), _bytes_of),
}


# ---------------------------------------------------------------- skipping


def skip_body(t: T, n: int, r: Reader, s: State, o: Options) -> None:
    """Moves past ``n`` values without building them."""
    t = delegate(t)
    k = t.kind
    width = fixed_width(t)
    if width is not None:
        r.skip(n * width)
    elif k == "Nullable":
        r.skip(n)
        skip_body(t.args[0], n, r, s.inside[0], o)
    elif k == "String" or k == "JSON" and s.word == 1:
        wire.skip_strings(r, n)
    elif k == "Array":
        skip_body(t.args[0], int(_offsets(n, r)[-1]), r, s.inside[0], o)
    elif k == "Map":
        total = int(_offsets(n, r)[-1])
        for x, i in zip(t.args, s.inside, strict=True):
            skip_body(x, total, r, i, o)
    elif k == "Tuple":
        if not t.args:
            r.skip(n)
        for (_, x), i in zip(t.args, s.inside, strict=True):
            skip_body(x, n, r, i, o)
    elif k == "Variant":
        tags = r.array("u1", n)
        if ((tags >= len(t.args)) & (tags != 255)).any():
            raise InvalidData("a Variant's discriminator has no alternative")
        for x, c, i in zip(t.args, _counts(tags, len(t.args)), s.inside, strict=True):
            skip_body(x, c, r, i, o)
    elif k == "LowCardinality":
        if n:
            word = r.u64()
            if word & 0xFF > 3 or word & 0x100 or not word & 0x200:
                raise UnsupportedSerialization(f"a dictionary's index word is {word:#x}")
            keys = r.u64()
            skip_body(dictionary_value(t.args[0])[1], keys, r, State(), o)
            if r.u64() != n:
                raise InvalidData("a dictionary column has another number of rows")
            at = r.array(("u1", "<u2", "<u4", "<u8")[word & 0xFF], n)
            if (at >= keys).any():
                raise InvalidData("a dictionary index has no key")
    elif k == "QBit":
        r.skip({"BFloat16": 16, "Float32": 32, "Float64": 64}[t.args[0].kind] * n * -(-t.args[1] // 8))
    elif k == "AggregateFunction":
        states.codec(t).read_many(r, n)
    elif k == "Dynamic":
        _skip_dynamic(n, r, s, o)
    elif k == "JSON":
        j = t.args[0]
        _check_pathless(j, n, s, o)
        for (_, x), i in zip(j.typed, s.inside, strict=False):
            skip_body(x, n, r, i, o)
        for i in s.inside[len(j.typed) :]:
            skip_body(T("Dynamic", (j.max_types,)), n, r, i, o)
        if s.word != 3:
            total = int(_offsets(n, r)[-1])
            wire.skip_strings(r, 2 * total)
    else:
        raise UnsupportedType(f"no codec for {t}")


def _skip_dynamic(n: int, r: Reader, s: State, o: Options) -> None:
    k = len(s.types)
    if s.word == 3:
        tags = r.array("u1" if k + 1 <= 256 else "<u2" if k + 1 <= 65536 else "<u4", n)
        for i, (x, state) in enumerate(zip(s.types, s.inside, strict=True)):
            skip_body(x, int((tags == i).sum()), r, state, o)
        return
    names = sorted([*map(str, s.types), "SharedVariant"])
    tags = r.array("u1", n)
    typed = iter(zip(s.types, s.inside, strict=True))
    for i, name in enumerate(names):
        count = int((tags == i).sum())
        if name == "SharedVariant":
            wire.skip_strings(r, count)
        else:
            x, state = next(typed)
            skip_body(x, count, r, state, o)


# ---------------------------------------------------------------- writing


def write_column(t: T, a: pa.Array, o: Options) -> bytes:
    """A column's prefix and body; nothing for no rows."""
    if len(a) == 0:
        return b""
    head: list[bytes] = []
    body: list[bytes] = []
    _write(t, a, o, head, body)
    return b"".join(head) + b"".join(body)


def _write(t: T, a: pa.Array, o: Options, head: list[bytes], body: list[bytes]) -> None:
    """Appends the prefix of ``t`` to ``head`` and the values of ``a`` to ``body``."""
    t = delegate(t)
    k = t.kind
    if k == "Nullable":
        body.append(pc.is_null(a).cast(pa.uint8()).to_numpy(zero_copy_only=False).tobytes())
        _write(t.args[0], _filled(delegate(t.args[0]), a), o, head, body)
        return
    if a.null_count and k not in ("LowCardinality", "Variant", "Dynamic", "Nothing"):
        raise InconsistentBatch(f"{t} can't hold a null")
    if k == "Nothing" or k == "Tuple" and not t.args:
        body.append(b"0" * len(a))
    elif k == "Bool":
        body.append(a.cast(pa.uint8()).to_numpy(zero_copy_only=False).tobytes())
    elif k in _NUMPY:
        body.append(_numbers(k, a).tobytes())
    elif k.startswith("Interval"):
        body.append(a.cast(pa.int64()).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
    elif k == "BFloat16":
        body.append((a.cast(pa.float32()).to_numpy(zero_copy_only=False).astype("<f4").view("<u4") >> 16).astype("<u2").tobytes())
    elif k in ("Date", "Date32"):
        days = a.cast(pa.date32()).cast(pa.int32()).to_numpy(zero_copy_only=False)
        if k == "Date" and ((days < 0) | (days > 65535)).any():
            raise InconsistentBatch("a day does not fit Date")
        body.append(days.astype("<u2" if k == "Date" else "<i4").tobytes())
    elif k in ("DateTime", "DateTime64", "Time", "Time64"):
        body.append(_times(t, a))
    elif k == "UUID":
        raw = b"".join([uuids.UUID(x).bytes for x in a.to_pylist()])
        body.append(np.frombuffer(raw, dtype=">u8").astype("<u8").tobytes())
    elif k == "IPv4":
        body.append(a.cast(pa.int64()).to_numpy(zero_copy_only=False).astype("<u4").tobytes())
    elif k in ("Enum8", "Enum16"):
        at = pc.index_in(a, value_set=pa.array([x for x, _ in t.args], a.type))
        if at.null_count:
            raise InconsistentBatch(f"a label is not in {t}")
        body.append(np.array([v for _, v in t.args])[at.to_numpy(zero_copy_only=False)].astype("i1" if k == "Enum8" else "<i2").tobytes())
    elif k == "String":
        offsets, data = _string_buffers(a)
        body.append(wire.write_strings(offsets, data))
    elif k in ("FixedString", "IPv6", "Int128", "UInt128", "Int256", "UInt256") or k == "Decimal" and t.args[0] > 38:
        width = fixed_width(t)
        values = a.to_pylist()
        if k == "FixedString":
            values = [(v.encode() if isinstance(v, str) else v).ljust(width, b"\0") for v in values]
        if any(len(v) != width for v in values):
            raise InconsistentBatch(f"a value of {t} does not have {width} bytes")
        body.append(b"".join(values))
    elif k == "Decimal":
        words = _decimal_words(a.cast(pa.decimal128(*t.args)))
        width = decimal_width(t.args[0])
        body.append(words.tobytes() if width == 16 else words[:, 0].astype(f"<i{width}").tobytes())
    elif k == "Array":
        offsets, inside = _list_parts(a)
        body.append(offsets[1:].astype("<u8").tobytes())
        _write(t.args[0], inside, o, head, body)
    elif k == "Map":
        offsets, inside = _list_parts(a)
        body.append(offsets[1:].astype("<u8").tobytes())
        for x, part in zip(t.args, inside.flatten(), strict=True):
            _write(x, part, o, head, body)
    elif k == "Tuple":
        for (_, x), part in zip(t.args, a.flatten(), strict=True):
            _write(x, part, o, head, body)
    elif k == "Variant":
        head.append(u64(0))
        tag, *parts = a.flatten()
        tags = pc.fill_null(tag, 255).cast(pa.uint8()).to_numpy(zero_copy_only=False)
        body.append(tags.tobytes())
        for i, (x, part) in enumerate(zip(t.args, parts, strict=True)):
            _write(x, part.filter(pa.array(tags == i)), o, head, body)
    elif k == "LowCardinality":
        head.append(u64(1))
        if len(a):
            _write_dictionary(t, a, o, body)
    elif k == "QBit":
        body.append(_qbit_planes(t, a))
    elif k == "AggregateFunction":
        offsets, data = _string_buffers(a)
        joined = data[offsets[0] : offsets[-1]].tobytes()
        try:
            ends = states.codec(t).read_many(Reader(joined), len(a))
        except (InvalidData, NeedMore) as e:
            raise InconsistentBatch(f"not a state of {t}") from e
        if (ends != offsets[1:] - offsets[0]).any():
            raise InconsistentBatch(f"not a state of {t}")
        body.append(joined)
    elif k == "Dynamic":
        _write_dynamic(t, a.to_pylist(), o, head, body)
    elif k == "JSON":
        _write_json(t, a, o, head, body)
    else:
        raise UnsupportedType(f"no codec for {t}")


def default_value(t: T):
    """The placeholder of a null row, as a Python value."""
    t = delegate(t)
    k = t.kind
    if k in ("Enum8", "Enum16"):
        return min(t.args, key=lambda x: abs(x[1]))[0]
    if k == "Tuple":
        return {n if n is not None else str(i + 1): default_value(x) for i, (n, x) in enumerate(t.args)}
    if k == "Nullable":
        return None
    if k == "QBit":
        return [0.0] * t.args[1]
    if k == "UUID":
        return str(uuids.UUID(int=0))
    if k == "JSON":
        return "{}"
    if k in ("Array", "Map"):
        return []
    if k == "LowCardinality":
        nullable, x = dictionary_value(t.args[0])
        return None if nullable else default_value(x)
    kind = arrow_type(t)
    if pa.types.is_binary(kind):
        return b"\0" * (fixed_width(t) or 0)
    if pa.types.is_string(kind):
        return ""
    if pa.types.is_boolean(kind):
        return False
    if pa.types.is_decimal(kind):
        return decimal.Decimal(0)
    if pa.types.is_date(kind):
        return datetime.date(1970, 1, 1)
    if pa.types.is_timestamp(kind):
        return datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)
    if pa.types.is_duration(kind):
        return datetime.timedelta(0)
    return None if pa.types.is_null(kind) else 0


def _filled(t: T, a: pa.Array) -> pa.Array:
    if a.null_count == 0 or t.kind in ("Nothing", "Variant", "Dynamic"):
        return a
    if t.kind == "Tuple" or pa.types.is_list(a.type):
        return pa.array([default_value(t) if v is None else v for v in a.to_pylist()], a.type)
    return pc.fill_null(a, pa.scalar(default_value(t), a.type))


def _numbers(k: str, a: pa.Array) -> np.ndarray:
    if k == "UInt64":
        if pa.types.is_decimal(a.type):
            words = _decimal_words(a.cast(pa.decimal128(20, 0)))
            if words[:, 1].any():
                raise InconsistentBatch("a number does not fit UInt64")
            return words[:, 0].astype("<i8").view("<u8")
        v = a.to_numpy(zero_copy_only=False)
        if (v < 0).any():
            raise InconsistentBatch("a number does not fit UInt64")
        return v.astype("<u8")
    v = a.to_numpy(zero_copy_only=False)
    out = v.astype(_NUMPY[k])
    if k[0] in "IU" and not (out.astype(np.float64 if v.dtype.kind == "f" else np.int64) == v).all():
        raise InconsistentBatch(f"a number does not fit {k}")
    return out


def _decimal_words(a: pa.Array) -> np.ndarray:
    a = pa.concat_arrays([a]) if a.offset else a
    return np.frombuffer(a.buffers()[1], dtype="<i8", count=2 * (len(a) + a.offset)).reshape(-1, 2)[a.offset :]


def _times(t: T, a: pa.Array) -> bytes:
    if t.kind in ("DateTime64", "Time64") and t.args[0] > 6:
        return a.cast(pa.int64()).to_numpy(zero_copy_only=False).astype("<i8").tobytes()
    us = (a if pa.types.is_integer(a.type) else a.cast(pa.timestamp("us", a.type.tz) if pa.types.is_timestamp(a.type) else pa.duration("us")).cast(pa.int64())).to_numpy(zero_copy_only=False)
    precision = t.args[0] if t.kind in ("DateTime64", "Time64") else 0
    ticks = us // 10 ** (6 - precision)
    if t.kind == "DateTime" and ((ticks < 0) | (ticks > 0xFFFFFFFF)).any():
        raise InconsistentBatch("a time does not fit DateTime")
    return ticks.astype({"DateTime": "<u4", "Time": "<i4"}.get(t.kind, "<i8")).tobytes()


def _string_buffers(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    a = a.cast(pa.binary())
    if len(a) == 0:
        return np.zeros(1, dtype=np.int32), np.zeros(0, dtype=np.uint8)
    _, offsets, data = a.buffers()
    return np.frombuffer(offsets, dtype="<i4")[a.offset : a.offset + len(a) + 1], np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)


def _list_parts(a: pa.Array) -> tuple[np.ndarray, pa.Array]:
    if pa.types.is_map(a.type):
        a = a.cast(pa.list_(pa.struct([pa.field("key", a.type.key_type), pa.field("value", a.type.item_type)])))
    offsets = a.offsets.to_numpy().astype("<i8")
    if len(offsets) == 0:
        offsets = np.zeros(1, dtype="<i8")
    return offsets - offsets[0], a.flatten()


def _write_dictionary(t: T, a: pa.Array, o: Options, body: list[bytes]) -> None:
    nullable, value = dictionary_value(t.args[0])
    if a.null_count and not nullable:
        raise InconsistentBatch(f"{t} can't hold a null")
    default = pa.array([default_value(value)], a.type)
    encoded = a.dictionary_encode()
    keys, at = encoded.dictionary, encoded.indices
    if nullable:
        index = pc.fill_null(pc.add(at, 1), 0).to_numpy(zero_copy_only=False)
        keys = pa.concat_arrays([default, keys])
    else:
        # The default comes first, once.
        rest = keys.filter(pc.invert(pc.is_in(keys, value_set=default)))
        place = pc.fill_null(pc.add(pc.index_in(keys, value_set=rest), 1), 0).to_numpy(zero_copy_only=False)
        index = place[at.to_numpy(zero_copy_only=False)]
        keys = pa.concat_arrays([default, rest])
    n = len(keys)
    tag = 0 if n <= 255 else 1 if n <= 65535 else 2 if n < 1 << 32 else 3
    body.append(u64(0x600 | tag) + u64(n))
    _write(value, keys, o, [], body)
    body.append(u64(len(a)) + index.astype(("u1", "<u2", "<u4", "<u8")[tag]).tobytes())


def _qbit_planes(t: T, a: pa.Array) -> bytes:
    element, size = t.args
    bits = {"BFloat16": 16, "Float32": 32, "Float64": 64}[element.kind]
    offsets, inside = _list_parts(a)
    if (np.diff(offsets) != size).any():
        raise InconsistentBatch(f"a vector of {t} does not have {size} elements")
    n = len(a)
    values = inside.to_numpy(zero_copy_only=False)
    raw = (values.astype("<f4").view("<u4") >> 16).astype("<u2") if bits == 16 else values.astype(f"<f{bits // 8}")
    flags = np.unpackbits(raw.view("u1").reshape(n, size, bits // 8), axis=2, bitorder="little")  # row, element, bit
    planes = flags.transpose(2, 0, 1)[::-1]
    return np.ascontiguousarray(np.packbits(planes, axis=2, bitorder="little")[:, :, ::-1]).tobytes()


def _write_dynamic(t: T, rows: list, o: Options, head: list[bytes], body: list[bytes]) -> None:
    """Rows are None or ``type, value, raw`` with a cell in ``raw``."""
    from quarry.operators import cells

    decoded = [None if v is None or v["type"] is None else (v["type"], v["raw"]) for v in rows]
    names = sorted({v[0] for v in decoded if v is not None})
    flat = o.flattened and all(cells.supported(parse(x)) for x in names)
    kept = names if flat else names[: t.args[0]]
    shapes = [parse(x) for x in kept]
    entry = (lambda x: type_binary.write(x)) if o.binary_types else (lambda x: wire.string(str(x)))
    if flat:
        head.append(u64(3) + varint(len(kept)) + b"".join(map(entry, shapes)))
        at = {x: i for i, x in enumerate(kept)}
        k = len(kept)
        tags = np.array([k if v is None else at[v[0]] for v in decoded], dtype="u1" if k + 1 <= 256 else "<u2")
        body.append(tags.tobytes())
        order = kept
    else:
        word = 2 if o.revision >= FLAT_DYNAMIC_REVISION else 1
        head.append(u64(word) + (varint(len(kept)) if word == 1 else b"") + varint(len(kept)) + b"".join(map(entry, shapes)) + u64(0))
        order = sorted([*kept, "SharedVariant"])
        at = {x: i for i, x in enumerate(order)}
        shared = at["SharedVariant"]
        body.append(bytes(255 if v is None else at.get(v[0], shared) if v[0] in kept else shared for v in decoded))
    kept_set = set(kept)
    for name in order:
        if name == "SharedVariant" and not flat:
            body.append(b"".join(wire.string(v[1]) for v in decoded if v is not None and v[0] not in kept_set))
            continue
        x = parse(name)
        values = [cells.decode(v[1])[1] for v in decoded if v is not None and v[0] == name]
        _write(x, pa.array(values, arrow_type(x)), o, head, body)


def _paths(value: dict, prefix: str = "") -> dict:
    out = {}
    for key, v in value.items():
        path = f"{prefix}{key}"
        if isinstance(v, dict):
            out |= _paths(v, path + ".")
        elif v is not None:
            out[path] = v
    return out


def _write_json(t: T, a: pa.Array, o: Options, head: list[bytes], body: list[bytes]) -> None:
    from quarry.operators import cells

    j = t.args[0]
    if o.json_text:
        head.append(u64(1))
        offsets, data = _string_buffers(a)
        body.append(wire.write_strings(offsets, data))
        return
    objects = [json.loads(x) for x in a.to_pylist()]
    if not all(isinstance(x, dict) for x in objects):
        raise InconsistentBatch("a JSON value is not an object")
    flat = [_paths(x) for x in objects]
    typed = dict(j.typed)
    found = sorted({p for row in flat for p in row if p not in typed})
    kept = found if o.flattened else found[: j.max_paths]
    word = 3 if o.flattened else 2 if o.revision >= FLAT_DYNAMIC_REVISION else 0
    head.append(u64(word) + (varint(len(kept)) if word == 0 else b"") + varint(len(kept)) + b"".join(map(wire.string, kept)))
    for path, x in j.typed:
        values = [cells.from_json(x, row[path]) if path in row else default_value(x) for row in flat]
        _write(x, pa.array(values, arrow_type(x)), o, head, body)
    for path in kept:
        rows = [None if path not in row else cells.inferred(row[path]) for row in flat]
        _write_dynamic(T("Dynamic", (j.max_types,)), rows, o, head, body)
    if word != 3:
        rest = [[(p, cells.inferred(row[p])["raw"]) for p in sorted(row) if p not in typed and p not in set(kept)] for row in flat]
        body.append(np.cumsum([len(x) for x in rest], dtype="<u8").tobytes())
        body.append(b"".join(wire.string(p) for x in rest for p, _ in x))
        body.append(b"".join(wire.string(c) for x in rest for _, c in x))
