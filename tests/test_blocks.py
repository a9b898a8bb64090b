import datetime
import decimal
import json

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.errors import BlockError, InconsistentBatch, InvalidData, NeedMore, ResourceLimit, SchemaMismatch, UnsupportedRevision, UnsupportedSerialization, UnsupportedType
from quarry.functions import wire
from quarry.functions.arrow_types import arrow_type
from quarry.functions.types import parse
from quarry.functions.wire import Reader
from quarry.operators import cells, states
from quarry.operators.blocks import block_end, block_index, read_block, read_blocks, read_schema, write_block
from quarry.operators.columns import Options
from quarry.streaming.decoder import StreamDecoder

D, UTC = decimal.Decimal, datetime.timezone.utc
CELL = lambda name, value: {"type": name, "value": cells.text(parse(name), value), "raw": cells.encode(parse(name), value)}

#: Values of each type, as they come back.
VALUES = {
    "Int8": [-128, 0, 127], "Int16": [-32768, 0, 32767], "Int32": [-(2**31), 5, 2**31 - 1], "Int64": [-(2**63), 1, 2**63 - 1],
    "UInt8": [0, 7, 255], "UInt16": [0, 7, 65535], "UInt32": [0, 7, 2**32 - 1], "UInt64": [D(0), D(7), D(2**64 - 1)],
    "Float32": [0.5, -0.0, float("inf")], "Float64": [0.1, -1e300, 3.0], "BFloat16": [1.0, -2.5, 256.0], "Bool": [True, False, True], "Nullable(Nothing)": [None, None, None],
    "Int128": [bytes(16), b"\xff" * 16, b"\x01" + bytes(15)], "UInt256": [bytes(32), b"\xff" * 32, b"\x02" + bytes(31)],
    "String": ["", "é" * 200, "x" * 20000], "FixedString(4)": [b"abcd", b"a\0\0\0", b"\0\0\0\0"],
    "Date": [datetime.date(1970, 1, 1), datetime.date(2149, 6, 6), datetime.date(2000, 2, 29)], "Date32": [datetime.date(1900, 1, 1), datetime.date(2299, 12, 31), datetime.date(1969, 12, 31)],
    "DateTime": [datetime.datetime(1970, 1, 1, tzinfo=UTC), datetime.datetime(2106, 2, 7, 6, 28, 15, tzinfo=UTC), datetime.datetime(2020, 1, 1, tzinfo=UTC)],
    "DateTime64(3, 'UTC')": [datetime.datetime(1969, 12, 31, 23, 59, 59, 999000, tzinfo=UTC), datetime.datetime(2020, 1, 1, 0, 0, 0, 1000, tzinfo=UTC), datetime.datetime(2262, 1, 1, tzinfo=UTC)],
    "DateTime64(9)": [-1, 0, 2**62], "Time": [datetime.timedelta(hours=-999), datetime.timedelta(0), datetime.timedelta(hours=30, seconds=5)],
    "Time64(6)": [datetime.timedelta(microseconds=-1), datetime.timedelta(0), datetime.timedelta(hours=25)], "Time64(9)": [-5, 0, 5],
    "IntervalYear": [-1, 0, 2**40], "IntervalNanosecond": [-(2**63), 0, 9],
    "UUID": ["00112233-4455-6677-8899-aabbccddeeff", "00000000-0000-0000-0000-000000000000", "ffffffff-ffff-ffff-ffff-ffffffffffff"],
    "IPv4": [0, 3221226219, 2**32 - 1], "IPv6": [bytes(16), b"\x20\x01" + bytes(14), b"\xff" * 16],
    "Enum8('north' = 1, 'south' = 2, 'west' = -1)": ["west", "north", "south"], "Enum16('a' = 1000, 'b' = -1000)": ["a", "b", "a"],
    "Decimal(9, 4)": [D("-99999.9999"), D("0.0000"), D("1.5000")], "Decimal(18, 9)": [D("-1.000000001"), D("0E-9"), D("999999999.999999999")],
    "Decimal(38, 20)": [D("-1.00000000000000000001"), D("0E-20"), D("123456789012345678.00000000000000000001")], "Decimal(76, 50)": [bytes(32), b"\xff" * 32, b"\x09" + bytes(31)],
    "Nullable(Int32)": [None, 1, None], "Nullable(String)": ["a", None, ""], "Nullable(Enum8('x' = 5))": [None, "x", None], "Nullable(UUID)": [None, "ffffffff-ffff-ffff-ffff-ffffffffffff", None],
    "LowCardinality(String)": ["a", "", "a"], "LowCardinality(Nullable(String))": [None, "a", ""], "LowCardinality(Nullable(UInt32))": [None, 0, 7], "LowCardinality(Date)": [datetime.date(2020, 1, 1)] * 3,
    "LowCardinality(FixedString(2))": [b"ab", b"\0\0", b"ab"],
    "Array(Int32)": [[], [1, 2], [3]], "Array(Array(Int32))": [[], [[], [1]], [[2, 3]]], "Array(Nullable(Int32))": [[None], [], [1, None]], "Array(LowCardinality(String))": [[], [], []],
    "Array(LowCardinality(Nullable(String)))": [["a", None], [], ["b"]], "Tuple(Int32, String)": [{"1": 1, "2": "a"}, {"1": 2, "2": ""}, {"1": 3, "2": "c"}],
    "Tuple(a Int32, b Nullable(String))": [{"a": 1, "b": None}, {"a": 2, "b": "x"}, {"a": 3, "b": ""}], "Nullable(Tuple(Int32, String))": [None, {"1": 2, "2": "b"}, None],
    "Array(Tuple())": [[{}, {}], [], [{}]],
    "Map(String, Int32)": [[{"key": "a", "value": 1}, {"key": "a", "value": 2}], [], [{"key": "", "value": 0}]], "Map(LowCardinality(String), Array(UInt8))": [[{"key": "k", "value": [1, 2]}], [], []],
    "Nested(x UInt32, y String)": [[{"x": 1, "y": "a"}], [], [{"x": 2, "y": ""}, {"x": 3, "y": "c"}]],
    "Point": [{"1": 0.5, "2": 1.5}] * 3, "MultiPolygon": [[[[{"1": 0.0, "2": 1.0}]]], [], [[]]],
    "Variant(String, UInt64)": [{"tag": None, "v0": None, "v1": None}, {"tag": 0, "v0": "a", "v1": None}, {"tag": 1, "v0": None, "v1": D(5)}],
    "Dynamic": [None, CELL("String", "user"), CELL("Array(Int8)", [79, -13])], "Dynamic(max_types=1)": [CELL("Int64", 5), CELL("String", "s"), CELL("UInt8", 1)],
    "JSON": ['{"a":{"b":1},"c":"x"}', "{}", '{"a":{"b":[1,null]}}'], "JSON(max_dynamic_paths=1, `a.b` Int64)": ['{"a":{"b":13},"x":"u"}', '{"a":{"b":79},"y":7}', '{"a":{"b":0},"x":true,"z":[1,2]}'],
    "Nullable(JSON)": [None, '{"k":1.5}', None],
    "QBit(Float32, 9)": [[float(i) for i in range(9)], [-0.5] * 9, [2.0**100] * 9], "QBit(Float64, 2)": [[1.0, 2.0], [0.1, -0.1], [0.0, 3.0]], "QBit(BFloat16, 3)": [[1.0, 2.0, 4.0]] * 3,
    "Nullable(QBit(Float32, 2))": [None, [1.0, 2.0], None], "SimpleAggregateFunction(sum, Float64)": [1.0, 2.0, 3.0],
    "AggregateFunction(count, UInt64)": [b"\x00", b"\x80\x01", b"\x05"], "AggregateFunction(sum, UInt8)": [bytes(8), b"\x01" + bytes(7), b"\xff" * 8],
    "AggregateFunction(sum, Nullable(UInt8))": [b"\x00", b"\x01" + bytes(8), b"\x00"], "AggregateFunction(nothingNull, Nullable(Nothing))": [b"\x00"] * 3,
}
OPTIONS = [Options(), Options(revision=54460), Options(revision=54485), Options(revision=54485, binary_types=True), Options(revision=54460, flattened=True)]


def batch(**columns):
    fields = [(n, parse(t)) for n, (t, _) in columns.items()]
    arrays = [pa.array(v, arrow_type(parse(t))) for t, v in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns)), fields


@pytest.mark.parametrize("options", OPTIONS, ids=str)
@pytest.mark.parametrize("name", VALUES)
def test_round_trip(name, options):
    b, fields = batch(before=("UInt8", [1, 2, 3]), x=(name, VALUES[name]), after=("String", ["p", "q", "r"]))
    data = write_block(b, fields, options)
    back, _ = read_block(Reader(data), options)
    assert back.column(1).to_pylist() == VALUES[name]
    assert back.column(2).to_pylist() == ["p", "q", "r"]
    # A scan finds the same end, skipping the column gives the others, and no prefix is a whole block.
    assert block_end(data, options).length == len(data)
    rest, _ = read_block(Reader(data), options, {"after"})
    assert rest.column(0).to_pylist() == ["p", "q", "r"]
    for cut in {1, len(data) // 2, len(data) - 1}:
        assert block_end(data[:cut], options) is None
        with pytest.raises(NeedMore):
            read_block(Reader(data[:cut]), options)


@pytest.mark.parametrize("name", VALUES)
def test_no_rows(name):
    b, fields = batch(x=(name, []))
    data = write_block(b, fields, Options(revision=54460))
    back, found = read_block(Reader(data), Options(revision=54460))
    assert back.num_rows == 0 and found == fields and back.column(0).type == arrow_type(parse(name))


def test_literal_blocks():
    b, fields = batch(n=("Int32", [1]))
    assert write_block(b, fields, Options()).hex(" ") == "01 01 01 6e 05 49 6e 74 33 32 01 00 00 00"
    b, fields = batch(j=("JSON", ["{}"]))
    assert write_block(b, fields, Options(revision=54485)) == bytes.fromhex("010002ffffffff0300000101016a044a534f4e000200000000000000000000000000000000")
    b, fields = batch(u=("UUID", ["00112233-4455-6677-8899-aabbccddeeff"]))
    assert write_block(b, fields, Options())[-16:].hex() == "7766554433221100ffeeddccbbaa9988"


def test_zone_is_dropped_at_revision_0():
    b, fields = batch(d=("DateTime('UTC')", VALUES["DateTime"]))
    assert str(read_schema(write_block(b, fields, Options()), Options())[0][1]) == "DateTime"
    assert str(read_schema(write_block(b, fields, Options(revision=1)), Options(revision=1))[0][1]) == "DateTime('UTC')"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=300)), max_size=80), st.integers(1, 60))
def test_streams_do_not_depend_on_pieces(texts, piece):
    b, fields = batch(x=("LowCardinality(Nullable(String))", texts), y=("Array(String)", [[t] * 2 if t else [] for t in texts]))
    o = Options(revision=54485)
    data = write_block(b, fields, o) * 2
    decoder, found = StreamDecoder(o), []
    for at in range(0, len(data), piece):
        found += decoder.feed(data[at : at + piece])
    found += decoder.finish()
    assert [r for f in found for r in f.column(0).to_pylist()] == texts * 2


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=200), min_size=1, max_size=30), st.integers(1, 40))
def test_blocks_come_out_with_their_last_byte(texts, piece):
    rows = [{"a": i, "b": t} for i, t in enumerate(texts)]
    b, fields = batch(s=("String", texts), l=("Array(Nullable(String))", [[t, None] for t in texts]), m=("Map(String, UInt32)", [[(t, 7)] for t in texts]), i=("Int64", [r["a"] for r in rows]))
    o = Options(revision=54485)
    data = write_block(b, fields, o)
    decoder = StreamDecoder(o)
    for _ in range(3):
        for at in range(0, len(data) - 1, piece):
            assert decoder.feed(data[at : min(at + piece, len(data) - 1)]) == []
        assert decoder.buffered_bytes == len(data) - 1
        (found,) = decoder.feed(data[-1:])
        assert found.column(0).to_pylist() == texts and decoder.buffered_bytes == 0
    both = decoder.feed(data + data + data[:5])
    assert len(both) == 2 and decoder.buffered_bytes == 5
    assert len(decoder.feed(data[5:])) == 1 and decoder.finish() == []


def test_small_pieces_cost_few_scans(monkeypatch):
    from quarry.streaming import decoder as module

    tries = []
    monkeypatch.setattr(module, "block_end", lambda *a: tries.append(1) or block_end(*a))
    texts = [f"value {i} " * (i % 9) for i in range(20_000)]
    b, fields = batch(s=("String", texts), t=("Array(String)", [[t] for t in texts]), i=("Int64", list(range(20_000))))
    data = write_block(b, fields, Options())
    decoder, found = StreamDecoder(Options()), []
    for at in range(0, len(data), 64):
        found += decoder.feed(data[at : at + 64])
    assert len(found) == 1 and len(tries) < 1500 < len(data) // 64


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=400), max_size=50))
def test_strings(rows):
    offsets = np.cumsum([0, *map(len, rows)])
    data = wire.write_strings(offsets, np.frombuffer(b"".join(rows), dtype=np.uint8))
    assert data == b"".join(wire.string(r) for r in rows)
    o, joined = wire.read_strings(Reader(data), len(rows))
    assert [joined[a:b] for a, b in zip(o[:-1], o[1:], strict=True)] == rows


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**64 - 1))
def test_varints(n):
    assert Reader(wire.varint(n)).varint() == n


def test_guards():
    with pytest.raises(InvalidData):
        Reader(b"\x80" * 10 + b"\x01").varint()
    with pytest.raises(UnsupportedRevision):
        block_end(b"\0\0", Options(revision=54486))
    with pytest.raises(BlockError):
        list(read_blocks(b"", Options()))
    one, fields = batch(x=("Int8", [1]))
    other, more = batch(x=("Int16", [1]))
    with pytest.raises(SchemaMismatch):
        list(read_blocks(write_block(one, fields, Options()) + write_block(other, more, Options()), Options()))
    with pytest.raises(InconsistentBatch):
        write_block(pa.RecordBatch.from_pydict({"x": pa.array([None], pa.int8())}), fields, Options())
    with pytest.raises(InconsistentBatch):
        write_block(pa.RecordBatch.from_pydict({"x": pa.array([300])}), fields, Options())
    b, f = batch(x=("Int8", [1]))
    data = bytearray(write_block(b, f, Options(revision=54460)))
    data[data.index(b"Int8") + 4] = 1
    with pytest.raises(UnsupportedSerialization):
        read_block(Reader(bytes(data)), Options(revision=54460))
    with pytest.raises(UnsupportedType):
        read_block(Reader(b"\x01\x00\x01x" + wire.string("AggregateFunction(uniq, Int8)")), Options())
    dictionary, df = batch(x=("LowCardinality(String)", ["a", "b"]))
    spoiled = bytearray(write_block(dictionary, df, Options()))
    spoiled[-1] = 99
    with pytest.raises(InvalidData):
        block_end(bytes(spoiled), Options())


def test_objects_that_take_no_bytes():
    pathless = wire.varint(1) + wire.varint(1 << 30) + wire.string("j") + wire.string("JSON") + wire.u64(3) + wire.varint(0)
    for read in (lambda: block_end(pathless, Options()), lambda: read_block(Reader(pathless), Options())):
        with pytest.raises(ResourceLimit):
            read()
    few = pathless.replace(wire.varint(1 << 30), wire.varint(3))
    assert read_block(Reader(few), Options())[0].column(0).to_pylist() == ["{}"] * 3


def test_strings_that_are_not_text():
    t = parse("Array(LowCardinality(Nullable(String)))")
    b = pa.RecordBatch.from_pydict({"x": pa.array([[b"\xff", None], []], pa.list_(pa.binary()))})
    data = write_block(b, [("x", t)], Options())
    with pytest.raises(InvalidData):
        read_block(Reader(data), Options())
    assert read_block(Reader(data), Options(strings="binary"))[0].column(0).to_pylist() == [[b"\xff", None], []]


def test_impossible_counts():
    for name in ("Int32", "LowCardinality(String)", "Array(Int8)", "QBit(Float32, 8)", "Dynamic"):
        head = wire.varint(1) + wire.varint(1 << 50) + wire.string("x") + wire.string(name)
        with pytest.raises(ResourceLimit):
            read_block(Reader(head), Options())


def test_index():
    b, fields = batch(x=("Int8", [1, 2]))
    data = write_block(b, fields, Options()) * 3
    assert [(e.offset, e.rows, e.columns) for e in block_index(data, Options())] == [(0, 2, 1), (len(data) // 3, 2, 1), (2 * len(data) // 3, 2, 1)]
    with pytest.raises(NeedMore):
        block_index(data[:-1], Options())


def test_states():
    c = states.codec(parse("AggregateFunction(sum, Nullable(Int8))"))
    assert c.value(c.merge([c.make(5), c.make(None), c.make(-7)])) == -2 and c.merge([c.make(None)]) == b"\0"
    u = states.codec(parse("AggregateFunction(sum, UInt8)"))
    assert u.value(u.make(2**64 + 3)) == 3 and not u.valid(bytes(7)) and not u.valid(bytes(9))
    assert states.codec(parse("AggregateFunction(sum, Decimal(9, 2))")).width == 16
    with pytest.raises(UnsupportedType):
        states.codec(parse("AggregateFunction(count, Nullable(Nothing))"))


def test_cells():
    assert cells.encode(parse("Array(Tuple())"), [{}] * 79).hex() == "1e1f004f"
    assert cells.decode(bytes.fromhex("1e1e1f00020d00"))[1] == [[{}] * 13, []]
    assert json.loads(cells.text(*cells.decode(cells.encode(parse("JSON"), '{"a":{"b":7},"c":[1,2]}')))) == {"a": {"b": 7}, "c": [1, 2]}
    with pytest.raises(InvalidData):
        cells.decode(cells.encode(parse("Int8"), 1) + b"x")
    with pytest.raises(UnsupportedType):
        cells.encode(parse("Variant(Int8)"), None)
