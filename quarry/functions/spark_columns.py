"""Column functions over decoded values: intervals, addresses, wide integers, and merges of plain aggregate states."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.errors import UnsupportedType

#: Microseconds of each unit of a day-time interval.
_MICROS = {"Microsecond": 1, "Millisecond": 1_000, "Second": 1_000_000, "Minute": 60_000_000, "Hour": 3_600_000_000, "Day": 86_400_000_000, "Week": 604_800_000_000}
_MONTHS = {"Month": 1, "Quarter": 3, "Year": 12}


def interval(count: Column, unit: str) -> Column:
    """A count of interval units as a year-month or day-time interval; nanoseconds lose what is below a microsecond."""
    if unit in _MONTHS:
        return F.make_ym_interval(F.lit(0), (count * _MONTHS[unit]).cast("int"))
    if unit == "Nanosecond":
        micros = F.floor(count / 1000)
    elif unit in _MICROS:
        micros = count * _MICROS[unit]
    else:
        raise UnsupportedType(f"no interval unit {unit}")
    whole, rest = F.floor(micros / 1_000_000), F.pmod(micros, F.lit(1_000_000))
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (whole.cast("decimal(18,0)") + rest.cast("decimal(18,0)") / 1_000_000).cast("decimal(18,6)"))


def ipv4_text(address: Column) -> Column:
    """The dotted text of an IPv4 address given as a number."""
    parts = [F.shiftright(address, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    return F.concat_ws(".", *parts)


def ipv6_text(address: Column) -> Column:
    """The text of an IPv6 address given as 16 bytes."""

    @F.pandas_udf("string")
    def convert(raw: pd.Series) -> pd.Series:
        import ipaddress

        return raw.map(lambda x: None if x is None else str(ipaddress.IPv6Address(bytes(x))))

    return convert(address)


def wide_integer_text(value: Column, *, signed: bool) -> Column:
    """The decimal text of a 128- or 256-bit integer given as little-endian bytes."""

    @F.pandas_udf("string")
    def convert(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: None if x is None else str(int.from_bytes(bytes(x), "little", signed=signed)))

    return convert(value)


def simple_merge(function: str, value: Column, order: Column | None = None) -> Column:
    """The aggregate that merges columns of ``SimpleAggregateFunction(function, T)``.

    ``order`` says which row comes last where that matters; without it such functions take any order.
    """
    name = re.sub(r"\(.*\)$", "", function)
    last = F.max_by(value, order) if order is not None else F.last(value, ignorenulls=True)
    lists = F.flatten(F.collect_list(value))
    merges = {
        "any": lambda: F.any_value(value, F.lit(True)), "any_respect_nulls": lambda: F.any_value(value), "anyLast": lambda: last, "anyLast_respect_nulls": lambda: last,
        "min": lambda: F.min(value), "max": lambda: F.max(value), "sum": lambda: F.sum(value), "sumWithOverflow": lambda: F.sum(value),
        "groupBitAnd": lambda: F.bit_and(value), "groupBitOr": lambda: F.bit_or(value), "groupBitXor": lambda: F.bit_xor(value),
        "groupArrayArray": lambda: lists, "groupUniqArrayArray": lambda: F.array_distinct(lists), "groupUniqArrayArrayMap": lambda: F.array_distinct(lists),
        "groupArrayLastArray": lambda: F.slice(lists, -int(function.partition("(")[2].rstrip(")")), int(function.partition("(")[2].rstrip(")"))),
    }
    if name not in merges:
        raise UnsupportedType(f"{function} merges by entries; see merge_maps")
    return merges[name]()


def merge_maps(df: DataFrame, keys: list[str], entries: str, function: str) -> DataFrame:
    """Merges columns of ``sumMap``, ``minMap`` or ``maxMap`` (arrays of key and value) by the entries' keys."""
    how = {"sumMap": F.sum, "minMap": F.min, "maxMap": F.max, "sumMappedArrays": F.sum, "minMappedArrays": F.min, "maxMappedArrays": F.max}[function]
    each = df.select(*keys, F.explode(entries).alias("e")).groupBy(*keys, F.col("e.key").alias("key")).agg(how("e.value").alias("value"))
    return each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias(entries))
