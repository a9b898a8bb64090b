"""Queries over type names, single values and packets: small tables of constants and table columns."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from quarry.functions import type_binary
from quarry.functions.types import decimal_width, delegate, parse
from quarry.functions.wire import Reader
from quarry.operators import cells
from quarry.operators.blocks import write_block
from quarry.operators.columns import Options
from quarry.operators.frames import encode_blocks
from quarry.plans import protocol

Query = Callable[[SparkSession, str], DataFrame]

#: Type names as written, and in canonical spelling.
NAMES = (
    ("Int32", "Int32"),
    ("Nullable( UInt64 )", "Nullable(UInt64)"),
    ("LowCardinality(Nullable(String))", "LowCardinality(Nullable(String))"),
    ("Decimal64(4)", "Decimal(18, 4)"),
    ("Decimal(9,2)", "Decimal(9, 2)"),
    ("DateTime64(3,'UTC')", "DateTime64(3, 'UTC')"),
    ("Enum8('a'=1,'b' = 2)", "Enum8('a' = 1, 'b' = 2)"),
    ("Tuple(a Int32,b String)", "Tuple(a Int32, b String)"),
    ("Tuple(Int32,String)", "Tuple(Int32, String)"),
    ("Map(String,Array( Int8 ))", "Map(String, Array(Int8))"),
    ("Variant(UInt64,String)", "Variant(String, UInt64)"),
    ("Dynamic", "Dynamic"),
    ("Dynamic(max_types=1)", "Dynamic(max_types=1)"),
    ("Nested(x UInt32,y String)", "Nested(x UInt32, y String)"),
    ("QBit(Float32,9)", "QBit(Float32, 9)"),
    ("AggregateFunction(sum,Nullable(UInt8))", "AggregateFunction(sum, Nullable(UInt8))"),
    ("SimpleAggregateFunction(anyLast,String)", "SimpleAggregateFunction(anyLast, String)"),
    ("MultiPolygon", "MultiPolygon"),
    ("IntervalDay", "IntervalDay"),
    ("JSON", "JSON"),
)
#: JSON types with arguments.
JSON_NAMES = (
    ("JSON(max_dynamic_paths=1,`a.b` Int64)", "JSON(max_dynamic_paths=1, `a.b` Int64)"),
    ("JSON(b String,a Int64)", "JSON(a Int64, b String)"),
    ("JSON(max_dynamic_paths=1024)", "JSON"),
    ("JSON(SKIP z, max_dynamic_types=2, SKIP REGEXP 'x.*')", "JSON(max_dynamic_types=2, SKIP z, SKIP REGEXP 'x.*')"),
)


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(pairs, columns: str = "given, name") -> str:
    rows = ", ".join("(" + ", ".join(_literal(x) if isinstance(x, str) else str(x) for x in p) + ")" for p in pairs)
    return f"SELECT * FROM (VALUES {rows}) AS t({columns})"


def _mapped(rows, schema: str, out: str, function) -> Query:
    """A table of constants with a Python function applied to each row on the executors."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        def each(batches):
            for batch in batches:
                found = [function(r) for r in batch.to_pylist()]
                yield pa.RecordBatch.from_pylist(found, schema=pa.schema([pa.field(f.name, _ARROW[type(f.dataType)]) for f in target]))

        target = S._parse_datatype_string(out)
        return spark.createDataFrame(rows, schema).mapInArrow(each, target)

    return run


_ARROW = {S.StringType: pa.string(), S.LongType: pa.int64(), S.BooleanType: pa.bool_(), S.BinaryType: pa.binary(), S.DoubleType: pa.float64()}


def _over(source: str, given: list[str], out: str, function) -> Query:
    """A Python function over each row of a table's columns, batch by batch on the executors."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        target = S._parse_datatype_string(out)
        schema = pa.schema([pa.field(f.name, _ARROW[type(f.dataType)]) for f in target])

        def each(batches):
            for batch in batches:
                yield pa.RecordBatch.from_pylist([function(r) for r in batch.to_pylist()], schema=schema)

        return spark.read.parquet(f"{sf_dir}/{source}.parquet").selectExpr(*given).mapInArrow(each, target)

    return run


def _cell(name: str, value: Callable) -> Callable:
    t = parse(name)

    def through(row: dict) -> dict:
        got, back = cells.decode(cells.encode(t, value(row)))
        return {"k": row["k"], "type": str(got), "v": cells.text(got, back)}

    return through


def _cell_query(name: str, value: Callable) -> Query:
    return _over("lineitem", ["l_orderkey AS k", "l_linenumber AS n", "l_returnflag AS f"], "k long, type string, v string", _cell(name, value))


def _cell_sql(name: str, value: str) -> str:
    return f"SELECT l_orderkey AS k, {_literal(name)} AS type, {value} AS v FROM lineitem"


# ---- packets


def _exchange(packets: list[bytes], pieces: int, *, compressed: bool = False, insert: list[bytes] | None = None) -> list[protocol.Event]:
    """A connection fed with a server's packets in pieces of a size; the query starts after the handshake."""
    c = protocol.Connection(compressed=compressed)
    c.feed(protocol.server_hello())
    out = [c.poll_event()]
    start = c.insert if insert is not None else c.query
    start(protocol.Query("SELECT 1"))
    stream = b"".join(packets)
    for at in range(0, len(stream), pieces):
        c.feed(stream[at : at + pieces])
        while (event := c.poll_event()) is not None:
            out.append(event)
            if event.kind == "insert_schema":
                for block in insert or ():
                    c.insert_data(block)
                c.finish_insert()
    return out


def _replay(spark: SparkSession, sf_dir: str, pieces: int, compressed: bool, code: int = protocol.DATA) -> DataFrame:
    """Orders in blocks, each sent in a Data packet and replayed on the executors; one row for each event."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    blocks = encode_blocks(orders, {"o_orderkey": "Int64", "o_totalprice": "Float64"}, Options(revision=protocol.REVISION), block_rows=1000)

    def run(batches):
        for batch in batches:
            for block, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packets = [protocol.server_block(code, block, compressed), protocol.server_progress(rows, 16 * rows, 0, 0, 0, 5), protocol.server_profile_info(rows, 1, 16 * rows, False, rows)]
                events = _exchange([*packets, protocol.varint(protocol.END_OF_STREAM)], pieces, compressed=compressed)
                found = [{"kind": e.kind, "rows": e.fields.get("rows", e.fields.get("read_rows", 0)), "same": e.block in (b"", block)} for e in events]
                yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("kind", pa.string()), ("rows", pa.int64()), ("same", pa.bool_())]))

    return blocks.select("block", "rows").mapInArrow(run, "kind string, rows long, same boolean")


def select_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replay(spark, sf_dir, 1 << 20, True).where("kind = 'data'").agg(F.sum("rows").alias("n"), F.min("same").alias("same"))


def split_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, other = (_replay(spark, sf_dir, p, True).groupBy("kind").agg(F.count(F.lit(1)).alias(f"n{p}"), F.sum("rows").alias(f"r{p}")) for p in (7000, 1 << 20))
    met = one.join(other, "kind")
    return met.select("kind", (F.col("n7000") == F.col(f"n{1 << 20}")).alias("same_count"), (F.col("r7000") == F.col(f"r{1 << 20}")).alias("same_rows"))


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _replay(spark, sf_dir, 1 << 20, False).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    blocks = per.agg(F.max("n").alias("most"), F.min("n").alias("least"), F.count(F.lit(1)).alias("kinds"))
    return blocks.select((F.col("most") == F.col("least")).alias("even"), "kinds")


def progress_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replay(spark, sf_dir, 1 << 20, False).where("kind = 'progress'").agg(F.sum("rows").alias("read_rows"))


def profile_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replay(spark, sf_dir, 1 << 20, False).where("kind = 'profile_info'").agg(F.sum("rows").alias("rows"))


def _extra_block(code: int, kind: str, grouped: str, fields: dict, out: str) -> Query:
    """A block of totals or extremes, sent as its packet and decoded again."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from quarry.operators.blocks import read_blocks

        spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("quarry_orders")
        blocks = encode_blocks(spark.sql(grouped).coalesce(1), fields, Options(revision=protocol.REVISION))

        def replay(batches):
            for batch in batches:
                for block in batch.column(0).to_pylist():
                    events = _exchange([protocol.server_block(code, block, True), protocol.varint(protocol.END_OF_STREAM)], 11, compressed=True)
                    for e in events:
                        if e.kind == kind:
                            for found in read_blocks(e.block, Options(revision=protocol.REVISION)):
                                yield found.replace_schema_metadata(None)

        return blocks.select("block").mapInArrow(replay, out)

    return run



def _hello_fields(r: dict) -> dict:
    reader = Reader(r["data"])
    return {"code": reader.varint(), "name": reader.string().decode(), "major": reader.varint(), "minor": reader.varint(), "revision": reader.varint(), "database": reader.string().decode()}


def _insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of an INSERT: how many bytes of blocks come out of its Data packets."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey").coalesce(1)
    blocks = encode_blocks(rows, {"o_orderkey": "Int64"}, Options(revision=protocol.REVISION), block_rows=2500)
    fields = [("o_orderkey", parse("Int64"))]

    def run(batches):
        from quarry.operators.blocks import read_block
        from quarry.operators.compression import decompress_stream

        head = write_block(pa.RecordBatch.from_pylist([], schema=pa.schema([("o_orderkey", pa.int64())])), fields, Options(revision=protocol.REVISION))
        for batch in batches:
            for block in batch.column(0).to_pylist():
                c = protocol.Connection(compressed=True)
                c.feed(protocol.server_hello())
                c.insert(protocol.Query("INSERT INTO t VALUES"))
                c.take_output()
                c.feed(protocol.server_block(protocol.DATA, head, True))
                c.insert_data(block)
                out = c.take_output()
                found = read_block(Reader(decompress_stream(out[2:])), Options(revision=protocol.REVISION))[0]
                yield pa.RecordBatch.from_pylist([{"rows": found.num_rows, "same": decompress_stream(out[2:]) == block}])

    return blocks.select("block").mapInArrow(run, "rows long, same boolean").agg(F.sum("rows").alias("n"), F.min("same").alias("same"))


def _exception_row(r: dict) -> dict:
    c = protocol.Connection()
    c.feed(protocol.server_hello())
    c.query(protocol.Query("SELECT 1", settings={"max_threads": "1"} if r["settings"] else {}))
    if r["answered"]:
        c.feed(protocol.server_progress(1, 2, 3, 4, 5, 6))
    c.feed(protocol.server_exception(r["code"], "Error", "message " + str(r["code"])))
    events = []
    while (e := c.poll_event()) is not None:
        events.append(e)
    return {"code": events[-1].fields["code"], "settings": r["settings"], "answered": r["answered"], "message": events[-1].fields["message"], "usable": c.state == protocol.State.READY}


def _query_row(r: dict) -> dict:
    q = protocol.Query(r["sql"], query_id="q", settings={"max_threads": "1"}, parameters={"p": r["p"]})
    data = q.encode(protocol.ClientHello(), False)
    return {"code": data[0], "has_sql": r["sql"].encode() in data, "quoted": protocol.quoted_parameter(r["p"])}


def _entries() -> dict[str, tuple[Query, str]]:
    named = "given string, name string"
    render = lambda r: {"given": r["given"], "name": str(parse(r["given"]))}
    binary = lambda r: {"given": r["given"], "name": str(type_binary.read(Reader(type_binary.write(parse(r["given"])))))}
    widths = [(p, decimal_width(p)) for p in (1, 9, 10, 18, 19, 38, 39, 76)]
    delegates = (
        ("Ring", "Array(Tuple(Float64, Float64))"),
        ("Nested(x UInt32, y String)", "Array(Tuple(x UInt32, y String))"),
        ("SimpleAggregateFunction(sum, Float64)", "Float64"),
        ("Geometry", "Variant(LineString, MultiLineString, MultiPolygon, Point, Polygon, Ring, MultiPoint)"),
    )
    tags = (("Int32", "09"), ("QBit(Float32, 9)", "360d09"), ("QBit(Float64, 300)", "360eac02"), ("Array(Tuple())", "1e1f00"), ("Nullable(Int64)", "230a"))
    both = {
        "type_parse": (_mapped(list(NAMES), named, named, render), _values(NAMES)),
        "type_render": (_mapped([(c, c) for _, c in NAMES], named, named, render), _values([(c, c) for _, c in NAMES])),
        "type_json_args": (_mapped(list(JSON_NAMES), named, named, render), _values(JSON_NAMES)),
        "type_decimal_bits": (_mapped([(p,) for p, _ in widths], "p long", "p long, width long", lambda r: {"p": r["p"], "width": decimal_width(r["p"])}), "SELECT p::BIGINT AS p, CASE WHEN p <= 9 THEN 4 WHEN p <= 18 THEN 8 WHEN p <= 38 THEN 16 ELSE 32 END::BIGINT AS width FROM (VALUES (1), (9), (10), (18), (19), (38), (39), (76)) AS t(p)"),
        "type_delegate": (_mapped(list(delegates), named, named, lambda r: {"given": r["given"], "name": str(delegate(parse(r["given"])))}), _values(delegates)),
        "type_binary_read": (_mapped([(c, c) for _, c in NAMES], named, named, binary), _values([(c, c) for _, c in NAMES])),
        "type_binary_write": (_mapped(list(tags), "given string, hex string", "given string, hex string", lambda r: {"given": r["given"], "hex": type_binary.write(parse(r["given"])).hex()}), _values(tags, "given, hex")),
        "cell_type_prefix": (_over("lineitem", ["l_orderkey AS k", "l_linenumber AS n"], "k long, type string, consumed long", lambda r: dict(zip(("k", "type", "consumed"), (r["k"], *map(lambda x: x if isinstance(x, int) else str(x), cells.type_prefix(cells.encode(parse("Array(Int32)"), [r["n"]])))), strict=True))), "SELECT l_orderkey AS k, 'Array(Int32)' AS type, 2::BIGINT AS consumed FROM lineitem"),
        "cell_decode_scalar": (_cell_query("Int64", lambda r: r["k"]), _cell_sql("Int64", "cast(l_orderkey AS VARCHAR)")),
        "cell_decode_array": (_cell_query("Array(Nullable(Int32))", lambda r: [r["n"], None]), _cell_sql("Array(Nullable(Int32))", "'[' || l_linenumber || ',null]'")),
        "cell_decode_map": (_cell_query("Map(String, Int32)", lambda r: [{"key": r["f"], "value": r["n"]}]), _cell_sql("Map(String, Int32)", "'[[\"' || l_returnflag || '\",' || l_linenumber || ']]'")),
        "cell_decode_tuple": (_cell_query("Tuple(a String, b Int32)", lambda r: {"a": r["f"], "b": r["n"]}), _cell_sql("Tuple(a String, b Int32)", "'{\"a\":\"' || l_returnflag || '\",\"b\":' || l_linenumber || '}'")),
        "cell_decode_json": (_cell_query("JSON", lambda r: json.dumps({"a": {"b": r["n"]}, "f": r["f"]})), _cell_sql("JSON", "'{\"a\":{\"b\":' || l_linenumber || '},\"f\":\"' || l_returnflag || '\"}'")),
        "cell_write_prefix": (_mapped(list(tags), "given string, hex string", "given string, hex string", lambda r: {"given": r["given"], "hex": type_binary.write(cells.type_prefix(bytes.fromhex(r["hex"]))[0]).hex()}), _values(tags, "given, hex")),
        "cell_roundtrip": (_cell_query("LowCardinality(Nullable(String))", lambda r: r["f"] if r["n"] > 2 else None), _cell_sql("LowCardinality(Nullable(String))", "CASE WHEN l_linenumber > 2 THEN '\"' || l_returnflag || '\"' ELSE 'null' END")),
        "tcp_client_hello": (_mapped([(protocol.ClientHello(database="db").encode(),)], "data binary", "code long, name string, major long, minor long, revision long, database string", _hello_fields), "SELECT 0::BIGINT AS code, 'quarry' AS name, 1::BIGINT AS major, 0::BIGINT AS minor, 54460::BIGINT AS revision, 'db' AS database"),
        "tcp_server_hello": (lambda spark, sf_dir: spark.createDataFrame([(e.fields["name"], e.fields["revision"], e.fields["timezone"]) for e in _exchange([protocol.varint(protocol.END_OF_STREAM)], 1)[:1]], "name string, revision long, timezone string"), "SELECT 'server' AS name, 54460::BIGINT AS revision, 'UTC' AS timezone"),
        "tcp_query_packet": (_mapped([("SELECT 1", "it's"), ("SELECT 2", "a\nb")], "sql string, p string", "code long, has_sql boolean, quoted string", _query_row), "SELECT 1::BIGINT AS code, true AS has_sql, '''it\\''s''' AS quoted UNION ALL SELECT 1, true, '''a\\nb'''"),
        "tcp_select_replay": (select_replay, "SELECT count(*) AS n, true AS same FROM orders"),
        "tcp_insert_packets": (_insert, "SELECT count(*) AS n, true AS same FROM orders"),
        "tcp_feed_split_invariant": (split_invariant, "SELECT kind, true AS same_count, true AS same_rows FROM (VALUES ('hello'), ('data'), ('progress'), ('profile_info'), ('end_of_stream')) AS t(kind)"),
        "tcp_event_counts": (event_counts, "SELECT true AS even, 5::BIGINT AS kinds"),
        "tcp_progress_sum": (progress_sum, "SELECT count(*) AS read_rows FROM orders"),
        "tcp_profile_info": (profile_info, "SELECT count(*) AS rows FROM orders"),
        "tcp_totals": (_extra_block(protocol.TOTALS, "totals", "SELECT count(*) AS n, max(o_orderkey) AS k FROM quarry_orders", {"n": "Int64", "k": "Int64"}, "n long, k long"), "SELECT count(*) AS n, max(o_orderkey) AS k FROM orders"),
        "tcp_extremes": (_extra_block(protocol.EXTREMES, "extremes", "SELECT min(o_orderkey) AS k FROM quarry_orders UNION ALL SELECT max(o_orderkey) FROM quarry_orders", {"k": "Int64"}, "k long"), "SELECT min(o_orderkey) AS k FROM orders UNION ALL SELECT max(o_orderkey) FROM orders"),
        "tcp_exception": (
            _mapped([(c, s, a) for c in (60, 99, 115, 701, 749) for s in (False, True) for a in (False, True)], "code long, settings boolean, answered boolean", "code long, settings boolean, answered boolean, message string, usable boolean", _exception_row),
            "SELECT code::BIGINT AS code, settings, answered, 'message ' || code AS message, code NOT IN (99, 101, 702, 720, 749) AND (answered OR NOT settings) AS usable "
            "FROM (VALUES (60), (99), (115), (701), (749)) AS t(code), (VALUES (false), (true)) AS s(settings), (VALUES (false), (true)) AS a(answered)",
        ),
    }
    return both


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in _entries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _entries().items()}
