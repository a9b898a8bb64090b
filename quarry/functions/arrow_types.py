"""How logical types look in Arrow and in Spark.

Only Arrow types that Spark takes are used: unsigned integers are widened, 128- and 256-bit integers and
decimals beyond 38 digits stay little-endian bytes, enums become their labels, unions become structs of a tag
and nullable fields. The canonical type name goes along as field metadata, so that writing a column read from
blocks needs no further schema.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import types as S
from pyspark.sql.pandas.types import from_arrow_schema

from quarry.functions import types as types
from quarry.functions.types import T, delegate

#: The metadata key of a field's canonical type name.
KEY = "block_type"

#: The Arrow type of each kind without arguments.
_SIMPLE = {
    "Nothing": pa.null(), "Bool": pa.bool_(), "Int8": pa.int8(), "Int16": pa.int16(), "Int32": pa.int32(), "Int64": pa.int64(),
    "UInt8": pa.int16(), "UInt16": pa.int32(), "UInt32": pa.int64(), "UInt64": pa.decimal128(20, 0),
    "Float32": pa.float32(), "Float64": pa.float64(), "BFloat16": pa.float32(), "Int128": pa.binary(), "UInt128": pa.binary(),
    "Int256": pa.binary(), "UInt256": pa.binary(), "String": pa.string(), "FixedString": pa.binary(), "Date": pa.date32(),
    "Date32": pa.date32(), "DateTime": pa.timestamp("us", "UTC"), "Time": pa.duration("us"), "UUID": pa.string(),
    "IPv4": pa.int64(), "IPv6": pa.binary(), "Enum8": pa.string(), "Enum16": pa.string(), "JSON": pa.string(), "AggregateFunction": pa.binary(),
}

DYNAMIC = pa.struct([pa.field("type", pa.string()), pa.field("value", pa.string()), pa.field("raw", pa.binary())])


def element_names(t: T) -> list[str]:
    """A Tuple's field names; unnamed elements are counted from 1."""
    return [n if n is not None else str(i + 1) for i, (n, _) in enumerate(t.args)]


def arrow_type(t: T, strings: str = "utf8") -> pa.DataType:
    """The Arrow type that columns of ``t`` are decoded to and encoded from; Strings as ``binary`` if asked for."""
    t = delegate(t)
    k = t.kind
    if k == "String" and strings == "binary":
        return pa.binary()
    if k in _SIMPLE:
        return _SIMPLE[k]
    if k.startswith("Interval"):
        return pa.int64()
    if k == "DateTime64":
        return pa.timestamp("us", "UTC") if t.args[0] <= 6 else pa.int64()
    if k == "Time64":
        return pa.duration("us") if t.args[0] <= 6 else pa.int64()
    if k == "Decimal":
        return pa.decimal128(*t.args) if t.args[0] <= 38 else pa.binary()
    if k == "Nullable":
        return arrow_type(t.args[0], strings)
    if k == "LowCardinality":
        return arrow_type(types.dictionary_value(t.args[0])[1], strings)
    if k == "Array":
        return pa.list_(pa.field("element", arrow_type(t.args[0], strings), nullable=True))
    if k == "Map":
        return pa.list_(pa.field("element", pa.struct([pa.field("key", arrow_type(t.args[0], strings)), pa.field("value", arrow_type(t.args[1], strings))])))
    if k == "Tuple":
        return pa.struct([pa.field(n, arrow_type(x, strings)) for n, (_, x) in zip(element_names(t), t.args, strict=True)])
    if k == "Variant":
        return pa.struct([pa.field("tag", pa.int16()), *(pa.field(f"v{i}", arrow_type(a, strings)) for i, a in enumerate(t.args))])
    if k == "Dynamic":
        return DYNAMIC
    if k == "QBit":
        return pa.list_(pa.field("element", arrow_type(t.args[0], strings)))
    raise types.UnsupportedType(f"no Arrow type for {t}")


def arrow_schema(fields: list[tuple[str, T]], strings: str = "utf8") -> pa.Schema:
    return pa.schema([pa.field(n, arrow_type(t, strings), metadata={KEY: str(t)}) for n, t in fields])


def spark_schema(fields: list[tuple[str, T]], strings: str = "utf8") -> S.StructType:
    """The Spark schema of a block's fields, type names in the metadata."""
    plain = from_arrow_schema(pa.schema([pa.field(n, arrow_type(t, strings)) for n, t in fields]))
    return S.StructType([S.StructField(f.name, f.dataType, True, {KEY: str(t)}) for f, (_, t) in zip(plain.fields, fields, strict=True)])


_DEFAULT = {
    S.BooleanType: "Bool", S.ByteType: "Int8", S.ShortType: "Int16", S.IntegerType: "Int32", S.LongType: "Int64", S.FloatType: "Float32",
    S.DoubleType: "Float64", S.StringType: "String", S.BinaryType: "String", S.DateType: "Date32", S.TimestampType: "DateTime64(6, 'UTC')",
    S.TimestampNTZType: "DateTime64(6, 'UTC')", S.DayTimeIntervalType: "Time64(6)", S.NullType: "Nothing",
}


def default_type(d: S.DataType, nullable: bool = True) -> str:
    """A type name for a Spark type without metadata."""
    if isinstance(d, S.ArrayType):
        return f"Array({default_type(d.elementType, d.containsNull)})"
    if isinstance(d, S.MapType):
        return f"Map({default_type(d.keyType, False)}, {default_type(d.valueType, d.valueContainsNull)})"
    if isinstance(d, S.StructType):
        name = f"Tuple({', '.join(f'{types.name_text(f.name)} {default_type(f.dataType, f.nullable)}' for f in d.fields)})"
    elif isinstance(d, S.DecimalType):
        name = f"Decimal({d.precision}, {d.scale})"
    else:
        found = next((n for k, n in _DEFAULT.items() if type(d) is k), None)
        if found is None:
            raise types.UnsupportedType(f"no block type for Spark's {d.simpleString()}")
        name = found
    return f"Nullable({name})" if nullable else name


def block_fields(schema: S.StructType, names: dict[str, str] | None = None) -> list[tuple[str, T]]:
    """The block types of a Spark schema: given by name, in the metadata, or by default."""
    given = names or {}
    return [(f.name, types.parse(given.get(f.name) or f.metadata.get(KEY) or default_type(f.dataType, f.nullable))) for f in schema.fields]
