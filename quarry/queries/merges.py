"""Queries over column functions and merges of plain states, all on columns that passed through blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.spark_columns import interval, ipv4_text, ipv6_text, merge_maps, simple_merge, wide_integer_text
from quarry.operators.columns import Options
from quarry.operators.frames import through_blocks

Query = Callable[[SparkSession, str], DataFrame]


def _passed(spark: SparkSession, sf_dir: str, given: str, types: dict[str, str]) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("quarry_lineitem")
    return through_blocks(spark.sql(f"SELECT {given} FROM quarry_lineitem"), types, Options(revision=54460))


def _merge(function: str, kind: str, value: str, out: str = "v") -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _passed(spark, sf_dir, f"l_returnflag AS k, {value} AS v", {"k": "String", "v": f"SimpleAggregateFunction({function}, {kind})"})
        return rows.groupBy("k").agg(simple_merge(function, F.col("v")).alias("v")).select("k", F.expr(out).alias("v"))

    return run


def _map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = "l_returnflag AS k, array(struct(l_linestatus AS key, cast(l_linenumber AS bigint) AS value)) AS m"
    rows = _passed(spark, sf_dir, given, {"k": "String", "m": "SimpleAggregateFunction(sumMap, Map(String, Int64))"})
    return merge_maps(rows, ["k"], "m", "sumMap").select("k", F.explode("m").alias("e")).select("k", "e.key", "e.value")


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _passed(spark, sf_dir, "l_orderkey AS k, cast(l_linenumber AS bigint) AS n, cast(l_linenumber AS bigint) AS m", {"k": "Int64", "n": "IntervalHour", "m": "IntervalQuarter"})
    spans = rows.select("k", interval(F.col("n"), "Hour").alias("d"), interval(F.col("m"), "Quarter").alias("y"))
    return spans.selectExpr("k", "cast(extract(DAY FROM d) * 24 + extract(HOUR FROM d) AS bigint) AS hours", "cast(extract(YEAR FROM y) * 12 + extract(MONTH FROM y) AS bigint) AS months")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = "l_orderkey AS k, l_orderkey * 7919 % 4294967296 AS a, unhex(rpad(lpad(hex(l_orderkey % 200), 2, '0'), 32, '0')) AS w, unhex(lpad(hex(l_orderkey % 10), 32, '0')) AS s"
    rows = _passed(spark, sf_dir, given, {"k": "Int64", "a": "IPv4", "w": "UInt128", "s": "IPv6"})
    return rows.select("k", ipv4_text(F.col("a")).alias("ip"), wide_integer_text(F.col("w"), signed=False).alias("w"), ipv6_text(F.col("s")).alias("ip6"))


def _sql(expression: str) -> str:
    return f"SELECT l_returnflag AS k, {expression} AS v FROM lineitem GROUP BY 1"


_ADDRESS = " || '.' || ".join(f"((l_orderkey * 7919 % 4294967296) >> {s} & 255)" for s in (24, 16, 8, 0))


def _entries() -> dict[str, tuple[Query, str]]:
    whole = "cast(l_linenumber AS bigint)"
    return {
        "saf_merge_min": (_merge("min", "Float64", "l_quantity"), _sql("min(l_quantity)")),
        "saf_merge_max": (_merge("max", "Float64", "l_quantity"), _sql("max(l_quantity)")),
        "saf_merge_sum": (_merge("sum", "Int64", whole), _sql("sum(l_linenumber)::BIGINT")),
        "saf_merge_any": (_merge("any", "Int64", whole, "v IS NOT NULL"), _sql("true")),
        "saf_merge_bit_and": (_merge("groupBitAnd", "Int64", whole), _sql("bit_and(l_linenumber)::BIGINT")),
        "saf_merge_bit_or": (_merge("groupBitOr", "Int64", whole), _sql("bit_or(l_linenumber)::BIGINT")),
        "saf_merge_bit_xor": (_merge("groupBitXor", "Int64", whole), _sql("xor(bit_xor(l_linenumber)::BIGINT, 0)")),
        "saf_merge_arrays": (_merge("groupUniqArrayArray", "Array(String)", "array(l_linestatus)", "array_join(array_sort(v), ',')"), _sql("string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus)")),
        "saf_merge_maps": (_map_merge, "SELECT l_returnflag AS k, l_linestatus AS key, sum(l_linenumber)::BIGINT AS value FROM lineitem GROUP BY 1, 2"),
        "interval_columns": (_intervals, "SELECT l_orderkey AS k, l_linenumber::BIGINT AS hours, l_linenumber::BIGINT * 3 AS months FROM lineitem"),
        "text_columns": (_texts, f"SELECT l_orderkey AS k, {_ADDRESS} AS ip, cast(l_orderkey % 200 AS VARCHAR) AS w, CASE WHEN l_orderkey % 10 = 0 THEN '::' ELSE '::' || (l_orderkey % 10) END AS ip6 FROM lineitem"),
    }


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in _entries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _entries().items()}
