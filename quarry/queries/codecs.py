"""``codec_*`` queries: table columns encoded into blocks, decoded again, and compared as plain Spark values.

A case names a table, the columns to encode (expression and block type), and what is selected after decoding.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from quarry.operators.columns import Options
from quarry.operators.frames import through_blocks

LINE = "l_orderkey, l_linenumber"
SECONDS = "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {})"
MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {})"


@dataclass
class Case:
    """One round trip: ``given`` maps names to (expression, type); ``out`` is selected from what is decoded."""

    source: str
    given: dict[str, tuple[str, str]]
    out: str
    oracle: str
    options: Options = field(default_factory=lambda: Options(revision=54460))

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        table, _, rest = self.source.partition(" ")
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(f"quarry_{table}")
        exprs = ", ".join(f"{e} AS {n}" for n, (e, _) in self.given.items())
        rows = spark.sql(f"SELECT {exprs} FROM quarry_{table} {rest}")
        decoded = through_blocks(rows, {n: t for n, (_, t) in self.given.items()}, self.options)
        return decoded.selectExpr(*(x.strip() for x in self.out.split(";")))


def _line(column: str, expression: str, kind: str, out: str, oracle: str, **more) -> Case:
    """A case over lineitem with its key; ``out`` and ``oracle`` give the value ``v``."""
    given = {"k": ("l_orderkey", "Int64"), "n": ("l_linenumber", "Int32"), column: (expression, kind)}
    return Case("lineitem", given, f"k; n; {out} AS v", f"SELECT l_orderkey AS k, l_linenumber AS n, {oracle} AS v FROM lineitem", **more)


def _cases() -> dict[str, Case]:
    c: dict[str, Case] = {}
    # ---- numbers
    for name, expression in {"int8": "l_linenumber - 4", "int16": "l_linenumber * 1000 - 3500", "int32": "l_orderkey % 100000 - 50000", "int64": "l_orderkey * 1000003 - 7"}.items():
        kind = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint"}[name]
        c[f"codec_{name}"] = _line("x", f"cast({expression} AS {kind})", name.capitalize(), "cast(x AS bigint)", f"cast({expression} AS bigint)")
    for name, expression in {"uint8": "l_linenumber + 200", "uint16": "l_orderkey % 65536", "uint32": "l_orderkey * 7919 % 4294967296"}.items():
        c[f"codec_{name}"] = _line("x", f"cast({expression} AS bigint)", "UInt" + name[4:], "cast(x AS bigint)", f"cast({expression} AS bigint)")
    c["codec_uint64"] = _line("x", "cast(18446744073709551615 - l_orderkey AS decimal(20,0))", "UInt64", "cast(x AS string)", "cast(18446744073709551615::DECIMAL(20,0) - l_orderkey AS VARCHAR)")
    c["codec_float32"] = _line("x", "cast(l_discount AS float)", "Float32", "cast(x AS double)", "cast(cast(l_discount AS FLOAT) AS DOUBLE)")
    c["codec_float64"] = _line("x", "l_extendedprice", "Float64", "x", "l_extendedprice")
    c["codec_bfloat16"] = _line("x", "cast(l_quantity AS float)", "BFloat16", "cast(x AS double)", "l_quantity")
    c["codec_bool"] = _line("x", "l_quantity > 25", "Bool", "x", "l_quantity > 25")
    c["codec_nothing"] = Case("lineitem", {"k": ("l_orderkey", "Int64"), "x": ("NULL", "Nullable(Nothing)")}, "k; x IS NULL AS v", "SELECT l_orderkey AS k, true AS v FROM lineitem")
    # ---- dates and times
    c["codec_date"] = _line("x", "cast(l_shipdate AS date)", "Date", "cast(x AS string)", "cast(cast(l_shipdate AS DATE) AS VARCHAR)")
    c["codec_date32"] = _line("x", "date_sub(cast(l_shipdate AS date), 20000)", "Date32", "cast(x AS string)", "cast(cast(l_shipdate AS DATE) - 20000 AS VARCHAR)")
    ship = SECONDS.format("l_shipdate")
    c["codec_datetime"] = _line("x", f"timestamp_seconds({ship})", "DateTime", "unix_seconds(x)", "cast(epoch(l_shipdate) AS BIGINT)")
    c["codec_datetime_tz"] = _line("x", f"timestamp_seconds({ship})", "DateTime('Europe/Amsterdam')", "unix_seconds(x)", "cast(epoch(l_shipdate) AS BIGINT)")
    events = {"k": ("event_id", "Int64")}
    ts = MICROS.format("ts")
    for p, unit in ((3, 1000), (6, 1)):
        given = events | {"x": (f"timestamp_micros({ts})", f"DateTime64({p}, 'UTC')")}
        c[f"codec_datetime64_{p}"] = Case("events", given, f"k; unix_micros(x) div {unit} AS v", f"SELECT event_id AS k, epoch_us(ts) // {unit} AS v FROM events")
    c["codec_datetime64_9"] = Case("events", events | {"x": (f"{ts} * 1000", "DateTime64(9)")}, "k; x AS v", "SELECT event_id AS k, epoch_us(ts) * 1000 AS v FROM events")
    day = f"{ts} % 86400000000"
    c["codec_time"] = Case("events", events | {"x": (f"make_dt_interval(0, 0, 0, cast(({day}) div 1000000 AS decimal(18,6)))", "Time")}, "k; cast(extract(DAY FROM x) * 86400 + extract(HOUR FROM x) * 3600 + extract(MINUTE FROM x) * 60 + cast(extract(SECOND FROM x) AS bigint) AS bigint) AS v", "SELECT event_id AS k, epoch_us(ts) % 86400000000 // 1000000 AS v FROM events")
    c["codec_time64"] = Case("events", events | {"x": (f"({day}) * 1000", "Time64(9)")}, "k; x AS v", "SELECT event_id AS k, epoch_us(ts) % 86400000000 * 1000 AS v FROM events")
    for unit in ("Year", "Quarter", "Month", "Week", "Day", "Hour", "Minute", "Second", "Millisecond", "Microsecond", "Nanosecond"):
        c[f"codec_interval_{unit.lower()}"] = _line("x", "cast(l_linenumber - 3 AS bigint)", f"Interval{unit}", "x", "cast(l_linenumber - 3 AS bigint)")
    # ---- addresses and identifiers
    c["codec_ipv4"] = _line("x", "l_orderkey * 7919 % 4294967296", "IPv4", "x", "cast(l_orderkey * 7919 % 4294967296 AS bigint)")
    c["codec_ipv6"] = _line("x", "unhex(md5(cast(l_orderkey AS string)))", "IPv6", "lower(hex(x))", "md5(cast(l_orderkey AS VARCHAR))")
    dashes = "regexp_replace(md5(cast(l_orderkey AS {})), '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '{}')"
    c["codec_uuid"] = _line("x", dashes.format("string", "$1-$2-$3-$4-$5"), "UUID", "x", dashes.format("VARCHAR", r"\1-\2-\3-\4-\5"))
    # ---- enums, strings, decimals, wide integers
    c["codec_enum8"] = Case("orders", {"k": ("o_orderkey", "Int64"), "x": ("o_orderstatus", "Enum8('F' = 1, 'O' = -2, 'P' = 3)")}, "k; x AS v", "SELECT o_orderkey AS k, o_orderstatus AS v FROM orders")
    segments = "Enum16('AUTOMOBILE' = 1000, 'BUILDING' = -1000, 'FURNITURE' = 3, 'HOUSEHOLD' = 4, 'MACHINERY' = 5)"
    c["codec_enum16"] = Case("customer", {"k": ("c_custkey", "Int64"), "x": ("c_mktsegment", segments)}, "k; x AS v", "SELECT c_custkey AS k, c_mktsegment AS v FROM customer")
    c["codec_string"] = Case("documents", {"k": ("doc_id", "Int64"), "x": ("text", "String")}, "k; md5(x) AS v; cast(length(x) AS bigint) AS n", "SELECT doc_id AS k, md5(text) AS v, length(text) AS n FROM documents")
    c["codec_fixedstring"] = Case("nation", {"k": ("n_nationkey", "Int32"), "x": ("cast(n_name AS binary)", "FixedString(24)")}, "k; cast(length(x) AS bigint) AS n; replace(cast(x AS string), decode(unhex('00'), 'UTF-8'), '') AS v", "SELECT n_nationkey AS k, 24::BIGINT AS n, n_name AS v FROM nation")
    cents = "cast(round(l_extendedprice * 100) AS bigint)"
    for bits, p, s in ((32, 9, 2), (64, 18, 4), (128, 38, 10)):
        value = f"cast({cents} % 1000000 AS decimal(20,0)) / 100" if bits == 32 else f"cast({cents} AS decimal(20,0)) / 100"
        c[f"codec_decimal{bits}"] = _line("x", f"cast({value} AS decimal({p},{s}))", f"Decimal({p}, {s})", "cast(x * 100 AS bigint)", f"{cents} % 1000000" if bits == 32 else cents)
    for name, width in (("int128", 16), ("uint128", 16), ("int256", 32), ("uint256", 32)):
        kind = ("UInt" if name[0] == "u" else "Int") + name.lstrip("u").removeprefix("int")
        digest = {16: "md5({})", 32: "sha2({}, 256)"}[width].format("cast(l_orderkey * 8 + l_linenumber AS string)")
        plain = {16: "md5({})", 32: "sha256({})"}[width].format("(l_orderkey * 8 + l_linenumber)::VARCHAR")
        c[f"codec_{name}"] = _line("x", f"unhex({digest})", kind, "lower(hex(x))", plain)
    c["codec_decimal256"] = _line("x", "unhex(rpad(substr(sha2(cast(l_orderkey AS string), 256), 1, 60), 64, '0'))", "Decimal(76, 20)", "lower(hex(x))", "rpad(sha256(l_orderkey::VARCHAR)[1:60], 64, '0')")
    # ---- nulls and dictionaries
    c["codec_nullable_int"] = _line("x", "nullif(l_linenumber, 1)", "Nullable(Int32)", "x", "nullif(l_linenumber, 1)")
    c["codec_nullable_string"] = Case("conversations", {"k": ("conv_id", "Int64"), "t": ("turn", "Int64"), "x": ("nullif(role, 'user')", "Nullable(String)")}, "k; t; x AS v", "SELECT conv_id AS k, turn AS t, nullif(role, 'user') AS v FROM conversations")
    c["codec_lc_string"] = _line("x", "l_returnflag", "LowCardinality(String)", "x", "l_returnflag")
    c["codec_lc_nullable"] = _line("x", "nullif(l_linestatus, 'F')", "LowCardinality(Nullable(String))", "x", "nullif(l_linestatus, 'F')")
    c["codec_lc_uint32"] = _line("x", "l_suppkey", "LowCardinality(UInt32)", "x", "l_suppkey")
    c["codec_lc_date"] = _line("x", "cast(l_shipdate AS date)", "LowCardinality(Date)", "cast(x AS string)", "cast(cast(l_shipdate AS DATE) AS VARCHAR)")
    c["codec_lc_fixedstring"] = _line("x", "cast(l_returnflag AS binary)", "LowCardinality(FixedString(1))", "cast(x AS string)", "l_returnflag")
    # ---- arrays, tuples, maps
    grouped = "lineitem GROUP BY l_orderkey"
    key = {"k": ("l_orderkey", "Int64")}
    listed = "transform(array_sort(collect_list(struct(l_linenumber AS a, l_quantity AS b))), {})"
    agg = "SELECT l_orderkey AS k, {} AS v FROM lineitem GROUP BY l_orderkey"
    joined = "string_agg(cast({} AS VARCHAR), ',' ORDER BY l_linenumber, l_quantity)"
    c["codec_array"] = Case(grouped, key | {"x": (listed.format("s -> s.a"), "Array(Int32)")}, "k; array_join(x, ',') AS v", agg.format(joined.format("l_linenumber")))
    c["codec_array_nullable"] = Case(grouped, key | {"x": (listed.format("s -> nullif(s.a, 1)"), "Array(Nullable(Int32))")}, "k; array_join(x, ',', '-') AS v", agg.format(joined.format("CASE WHEN l_linenumber = 1 THEN '-' ELSE cast(l_linenumber AS VARCHAR) END")))
    c["codec_array_lc"] = Case(grouped, key | {"x": ("array_sort(collect_list(l_returnflag))", "Array(LowCardinality(String))")}, "k; array_join(x, ',') AS v", agg.format("string_agg(l_returnflag, ',' ORDER BY l_returnflag)"))
    c["codec_array_array"] = Case(grouped, key | {"x": (listed.format("s -> array(s.a, cast(s.b AS int))"), "Array(Array(Int32))")}, "k; array_join(flatten(x), ',') AS v", agg.format(joined.format("l_linenumber || ',' || cast(l_quantity AS INT)")))
    line = {"k": ("l_orderkey", "Int64"), "n": ("l_linenumber", "Int32")}
    sql = "SELECT l_orderkey AS k, l_linenumber AS n, {} FROM lineitem"
    c["codec_tuple"] = Case("lineitem", line | {"x": ("struct(l_linenumber AS `1`, l_returnflag AS `2`)", "Tuple(Int32, String)")}, "k; n; x.`1` AS a; x.`2` AS b", sql.format("l_linenumber AS a, l_returnflag AS b"))
    c["codec_tuple_named"] = Case("lineitem", line | {"x": ("struct(l_linenumber AS a, nullif(l_returnflag, 'A') AS b)", "Tuple(a Int32, b Nullable(String))")}, "k; n; x.a AS a; x.b AS b", sql.format("l_linenumber AS a, nullif(l_returnflag, 'A') AS b"))
    c["codec_tuple_empty"] = Case("lineitem", line | {"x": ("array_repeat(struct(), l_linenumber)", "Array(Tuple())")}, "k; n; cast(size(x) AS bigint) AS v", sql.format("l_linenumber::BIGINT AS v"))
    c["codec_nullable_tuple"] = Case("lineitem", line | {"x": ("CASE WHEN l_linenumber > 2 THEN struct(l_linenumber AS `1`, l_returnflag AS `2`) END", "Nullable(Tuple(Int32, String))")}, "k; n; x.`1` AS a; x.`2` AS b", sql.format("CASE WHEN l_linenumber > 2 THEN l_linenumber END AS a, CASE WHEN l_linenumber > 2 THEN l_returnflag END AS b"))
    entry = "array(struct('q' AS key, {0} AS value), struct('d' AS key, {1} AS value))"
    c["codec_map"] = Case("lineitem", line | {"x": (entry.format("l_quantity", "l_discount"), "Map(String, Float64)")}, "k; n; filter(x, e -> e.key = 'q')[0].value AS q; filter(x, e -> e.key = 'd')[0].value AS d", sql.format("l_quantity AS q, l_discount AS d"))
    c["codec_map_lc_key"] = Case("lineitem", line | {"x": ("array(struct(l_returnflag AS key, l_linenumber AS value))", "Map(LowCardinality(String), UInt8)")}, "k; n; x[0].key AS a; cast(x[0].value AS int) AS b", sql.format("l_returnflag AS a, l_linenumber AS b"))
    c["codec_map_array_value"] = Case("lineitem", line | {"x": ("array(struct(l_returnflag AS key, array(l_linenumber, l_linenumber + 1) AS value))", "Map(String, Array(Int32))")}, "k; n; x[0].key AS a; array_join(x[0].value, ',') AS b", sql.format("l_returnflag AS a, l_linenumber || ',' || (l_linenumber + 1) AS b"))
    c["codec_nested"] = Case(grouped, key | {"x": ("array_sort(collect_list(struct(l_linenumber AS line, l_returnflag AS flag)))", "Nested(line UInt32, flag String)")}, "k; array_join(transform(x, e -> concat(e.line, e.flag)), ',') AS v", agg.format("string_agg(l_linenumber || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag)"))
    # ---- geometry
    point, other = "struct(l_quantity AS `1`, l_discount AS `2`)", "struct(l_discount AS `1`, l_linenumber + 0.5D AS `2`)"
    line1 = f"array({point}, {other})"
    line2 = f"array({line1}, array({other}))"
    line3 = f"array({line2}, array(array({point}, {other}, {point})))"
    shapes = ((point, "array(x)", "p"), (line1, "x", "pq"), (line2, "flatten(x)", "pqq"), (line3, "flatten(flatten(x))", "pqqpqp"))
    values = {"p": "(l_quantity * 100)::BIGINT || ' ' || round(l_discount * 100)::BIGINT", "q": "round(l_discount * 100)::BIGINT || ' ' || (l_linenumber * 100 + 50)"}
    for kind, depth in (("Point", 0), ("Ring", 1), ("LineString", 1), ("MultiPoint", 1), ("MultiLineString", 2), ("Polygon", 2), ("MultiPolygon", 3)):
        shape, points, order = shapes[depth]
        shown = f"array_join(transform({points}, e -> concat(cast(round(e.`1` * 100) AS bigint), ' ', cast(round(e.`2` * 100) AS bigint))), ',') AS v"
        expected = " || ',' || ".join(values[x] for x in order) + " AS v"
        c[f"codec_{kind.lower()}"] = Case("lineitem", line | {"x": (shape, kind)}, f"k; n; {shown}", sql.format(expected))
    empty = "cast(NULL AS {})"
    p, r2, r3, r4 = "struct<`1`:double,`2`:double>", "array<struct<`1`:double,`2`:double>>", "array<array<struct<`1`:double,`2`:double>>>", "array<array<array<struct<`1`:double,`2`:double>>>>"
    geometry = ", ".join(f"{v} AS v{i}" for i, v in enumerate([f"CASE WHEN l_linenumber % 3 = 1 THEN array({point}) END", empty.format(r3), empty.format(r4), f"CASE WHEN l_linenumber % 3 = 0 THEN {point} END", empty.format(r3), empty.format(r2), empty.format(r2)]))
    c["codec_geometry"] = Case("lineitem", line | {"x": (f"struct(cast(CASE l_linenumber % 3 WHEN 0 THEN 3 WHEN 1 THEN 0 END AS smallint) AS tag, {geometry})", "Geometry")}, "k; n; x.tag AS tag; coalesce(x.v3.`1`, x.v0[0].`1`) AS a", sql.format("cast(CASE l_linenumber % 3 WHEN 0 THEN 3 WHEN 1 THEN 0 END AS SMALLINT) AS tag, CASE WHEN l_linenumber % 3 < 2 THEN l_quantity END AS a"))
    # ---- unions, dynamic and JSON
    choice = "struct(cast(CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 END AS smallint) AS tag, CASE WHEN event_id % 4 = 2 THEN value END AS v0, CASE WHEN event_id % 4 = 1 THEN event_type END AS v1, CASE WHEN event_id % 4 = 0 THEN cast(user_id AS decimal(20,0)) END AS v2)"
    c["codec_variant"] = Case("events", events | {"x": (choice, "Variant(String, UInt64, Float64)")}, "k; x.tag AS tag; x.v0 AS f; x.v1 AS s; cast(x.v2 AS bigint) AS u", "SELECT event_id AS k, cast(CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 END AS SMALLINT) AS tag, CASE WHEN event_id % 4 = 2 THEN value END AS f, CASE WHEN event_id % 4 = 1 THEN event_type END AS s, CASE WHEN event_id % 4 = 0 THEN user_id END AS u FROM events")
    # A cell is a type's tag and the value: 0x0a and eight bytes, or 0x15, a length and text.
    number = "concat(unhex('0a'), unhex(concat_ws('', transform(sequence(7, 0, -1), i -> substr(lpad(hex(user_id), 16, '0'), 2 * i + 1, 2)))))"
    words = "concat(unhex('15'), unhex(lpad(hex(octet_length(event_type)), 2, '0')), cast(event_type AS binary))"
    dynamic = f"CASE event_id % 3 WHEN 0 THEN struct('Int64' AS type, '' AS value, {number} AS raw) WHEN 1 THEN struct('String' AS type, '' AS value, {words} AS raw) END"
    for name, o, kind in (("v1", Options(revision=54460), "Dynamic"), ("v2", Options(revision=54485), "Dynamic(max_types=1)"), ("flat", Options(revision=54460, flattened=True), "Dynamic")):
        c[f"codec_dynamic_{name}"] = Case("events", events | {"x": (dynamic, kind)}, "k; x.type AS t; x.value AS v", "SELECT event_id AS k, CASE event_id % 3 WHEN 0 THEN 'Int64' WHEN 1 THEN 'String' END AS t, CASE event_id % 3 WHEN 0 THEN cast(user_id AS VARCHAR) WHEN 1 THEN '\"' || event_type || '\"' END AS v FROM events", o)
    doc = "to_json(named_struct('type', event_type, 'user', named_struct('id', user_id), 'big', event_id % 2 = 0))"
    parsed = "k; get_json_object(x, '$.type') AS t; cast(get_json_object(x, '$.user.id') AS bigint) AS u; get_json_object(x, '$.big') AS b"
    plain = "SELECT event_id AS k, event_type AS t, user_id AS u, CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS b FROM events"
    for name, o, kind in (
        ("string", Options(revision=54460, json_text=True), "JSON"), ("v1", Options(revision=54460), "JSON"), ("v2", Options(revision=54485), "JSON(max_dynamic_paths=1)"),
        ("flat", Options(revision=54460, flattened=True), "JSON"), ("typed", Options(revision=54460), "JSON(max_dynamic_paths=1, `user.id` Int64)"),
    ):
        c[f"codec_json_{name}"] = Case("events", events | {"x": (doc, kind)}, parsed, plain, o)
    clash = """concat('{"a":', event_id, ',"a.b":', user_id, ',"a.b.c":"', event_type, '"}')"""
    conflict = """SELECT event_id AS k, '{"a":' || event_id || ',"a.b":' || user_id || ',"a.b.c":"' || event_type || '"}' AS v FROM events"""
    c["codec_json_conflict"] = Case("events", events | {"x": (clash, "JSON")}, "k; x AS v", conflict, Options(revision=54460))
    c["codec_json_props"] = Case("events", events | {"x": ("props", "JSON")}, "k; cast(variant_get(parse_json(x), '$.k') AS bigint) AS v", "SELECT event_id AS k, cast(json_extract(props, '$.k') AS BIGINT) AS v FROM events")
    # ---- vectors and functions
    vec = {"k": ("vec_id", "Int64")}
    vector = "k; cast(size(x) AS bigint) AS n; array_join(transform(x, e -> {}), ',') AS v"
    plain = "SELECT vec_id AS k, len(embedding)::BIGINT AS n, array_to_string([{} for i in range(1, len(embedding) + 1)], ',') AS v FROM embeddings"
    for name, kind in (("f32", "Float32"), ("f64", "Float64")):
        cast = "embedding" if name == "f32" else "transform(embedding, e -> cast(e AS double))"
        c[f"codec_qbit_{name}"] = Case("embeddings", vec | {"x": (cast, f"QBit({kind}, {{dim}})")}, vector.format("cast(round(cast(e AS double) * 1000000) AS bigint)"), plain.format("round(embedding[i]::DOUBLE * 1000000)::BIGINT"))
    c["codec_qbit_bf16"] = Case("embeddings", vec | {"x": ("transform(embedding, e -> cast(round(e * 4) AS float))", "QBit(BFloat16, {dim})")}, vector.format("cast(e AS bigint)"), plain.format("round(embedding[i] * 4)::BIGINT"))
    c["codec_saf"] = _line("x", "l_extendedprice", "SimpleAggregateFunction(sum, Float64)", "x", "l_extendedprice")
    return c


def _runner(case: Case) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if any("{dim}" in t for _, t in case.given.values()):
            size = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("max(size(embedding)) AS n").first()[0] or 1
            given = {n: (e, t.replace("{dim}", str(size))) for n, (e, t) in case.given.items()}
            return Case(case.source, given, case.out, case.oracle, case.options).run(spark, sf_dir)
        return case.run(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _runner(case) for name, case in _cases().items()}


def oracle_sql() -> dict[str, str]:
    return {name: case.oracle for name, case in _cases().items()}
