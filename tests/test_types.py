import pytest

from quarry.errors import UnsupportedType
from quarry.functions import type_binary
from quarry.functions.arrow_types import arrow_type, spark_schema
from quarry.functions.types import delegate, parse
from quarry.functions.wire import Reader

NAMES = """Int8|Int16|Int32|Int64|UInt8|UInt16|UInt32|UInt64|Float32|Float64|Bool|String|FixedString(4)|Nullable(Int32)|Nullable(String)|Date|Date32
DateTime|DateTime('UTC')|DateTime64(3)|DateTime64(3, 'UTC')|LowCardinality(String)|LowCardinality(Nullable(String))|LowCardinality(UInt32)|LowCardinality(Date)
LowCardinality(Nullable(UInt32))|UUID|IPv4|IPv6|LowCardinality(UUID)|Enum8('north' = 1, 'south' = 2, 'west' = -1)|Enum16('north' = 1, 'south' = 2, 'west' = -1)
Decimal(9, 4)|Decimal(18, 9)|Decimal(38, 20)|Decimal(76, 50)|LowCardinality(IPv4)|LowCardinality(IPv6)|Array(Int32)|Array(String)|Array(Nullable(Int32))
Array(LowCardinality(String))|Array(Array(Int32))|Tuple(Int32, String)|Tuple(a Int32, b Nullable(String))|Array(Tuple(Int32, Int32))|Nullable(Tuple(Int32, String))
Map(String, Int32)|Map(LowCardinality(String), UInt8)|Map(String, Nullable(String))|Map(String, Array(Int32))|Array(Map(String, Int32))|Int128|UInt128|Int256|UInt256
Nullable(Int128)|LowCardinality(Int256)|Time|Time64(6)|Nullable(Time)|Nullable(Time64(6))|LowCardinality(Time)|SimpleAggregateFunction(sum, Float64)
SimpleAggregateFunction(anyLast, LowCardinality(Nullable(String)))|SimpleAggregateFunction(groupArrayLastArray(5), Array(UInt64))|Point|Nullable(Point)|Ring|MultiPolygon
Nested(x UInt32, y String)|Nullable(SimpleAggregateFunction(sum, UInt64))|LowCardinality(SimpleAggregateFunction(anyLast, String))
LowCardinality(SimpleAggregateFunction(anyLast, Nullable(String)))|IntervalYear|IntervalQuarter|IntervalMonth|IntervalWeek|IntervalDay|IntervalHour|IntervalMinute
IntervalSecond|IntervalMillisecond|IntervalMicrosecond|IntervalNanosecond|Nullable(IntervalDay)|LowCardinality(IntervalHour)|Map(IntervalDay, String)|BFloat16
Nullable(BFloat16)|LowCardinality(BFloat16)|Nullable(Nothing)|Array(Nothing)|AggregateFunction(count, UInt64)|AggregateFunction(nothingUInt64, Nullable(Nothing))
AggregateFunction(sum, UInt8)|AggregateFunction(sum, BFloat16)|AggregateFunction(sum, Decimal(9, 2))|AggregateFunction(sum, UInt256)|AggregateFunction(sum, Nullable(UInt8))
AggregateFunction(sum, Enum8('zero' = 0, 'one' = 1, 'two' = 2))|AggregateFunction(nothingNull, Nullable(Nothing))|Variant(String, UInt64)|Dynamic(max_types=1)
JSON(max_dynamic_paths=1, `a.b` Int64)|JSON|Nullable(JSON)|Geometry|Array(Geometry)|MultiPoint|QBit(BFloat16, 3)|QBit(Float32, 9)|QBit(Float64, 2)|Nullable(QBit(Float32, 2))"""
ALL = [n for line in NAMES.splitlines() for n in line.split("|")]


@pytest.mark.parametrize("name", ALL)
def test_canonical_names_come_back(name):
    t = parse(name)
    assert str(t) == name and parse(str(t)) == t
    assert str(type_binary.read(Reader(type_binary.write(t)))) == name
    arrow_type(t)


def test_every_type_has_a_spark_schema():
    schema = spark_schema([(f"c{i}", parse(n)) for i, n in enumerate(ALL)])
    assert [f.metadata["block_type"] for f in schema.fields] == ALL


@pytest.mark.parametrize(
    "name",
    ["Nullable(Nullable(Int8))", "Nullable(Array(Int8))", "Nullable(Map(String, Int8))", "LowCardinality(Array(Int8))", "LowCardinality(Decimal(9, 2))", "Map(Nullable(String), Int8)",
     "Map(LowCardinality(Nullable(String)), Int8)", "Variant(Nullable(Int8))", "Tuple(a Int8, String)", "Tuple(a Int8, a Int8)", "FixedString(0)", "Decimal(77, 1)", "Decimal(4, 5)",
     "Enum8('a' = 200)", "Enum8('a' = 1, 'a' = 2)", "DateTime64(10)", "Time", "Whatever", "JSON(max_dynamic_paths=10001)", "Dynamic(max_types=255)", "Array(Int8", "QBit(Int8, 3)", "Nested()",
     "SimpleAggregateFunction(median, Int8)", "Array(" * 101 + "Int8" + ")" * 101],
)
def test_illegal_names(name):
    if name == "Time":
        assert parse(name).kind == "Time"
        return
    with pytest.raises(UnsupportedType):
        parse(name)


@pytest.mark.parametrize(
    ("given", "name"),
    [("Nullable( Int32 )", "Nullable(Int32)"), ("Decimal32( 4 )", "Decimal(9, 4)"), ("Variant(UInt64,String)", "Variant(String, UInt64)"), ("Enum8('a','b')", "Enum8('a' = 1, 'b' = 2)"),
     ("Enum8('it\\'s'=1)", "Enum8('it\\'s' = 1)"), ("Enum8('a,b'=1,'c)'=2)", "Enum8('a,b' = 1, 'c)' = 2)"), ("Tuple(`a b` Int8)", "Tuple(`a b` Int8)"), ("Tuple(`select` Int8)", "Tuple(`select` Int8)"),
     ("JSON(b String, a Int64)", "JSON(a Int64, b String)"), ("JSON(SKIP z)", "JSON(SKIP z)"), ("JSON(`skip` Int8)", "JSON(`skip` Int8)")],
)
def test_spellings(given, name):
    assert str(parse(given)) == name


def test_delegates():
    assert str(delegate(parse("Polygon"))) == "Array(Array(Tuple(Float64, Float64)))"
    assert str(delegate(parse("SimpleAggregateFunction(any, SimpleAggregateFunction(any, Int8))"))) == "Int8"


@pytest.mark.parametrize(("name", "data"), [("QBit(Float32, 9)", "360d09"), ("QBit(Float64, 300)", "360eac02"), ("Array(Tuple())", "1e1f00")])
def test_binary_vectors(name, data):
    assert type_binary.write(parse(name)).hex() == data


@pytest.mark.parametrize("data", ["21", "24", "33", "35", "37"])
def test_unknown_tags(data):
    with pytest.raises(UnsupportedType):
        type_binary.read(Reader(bytes.fromhex(data)))
