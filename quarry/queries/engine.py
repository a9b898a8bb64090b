"""Queries over whole tables in blocks: sources, sinks, framing, scans, accessors, states, compression, streams."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.functions.arrow_types import block_fields, spark_schema
from quarry.operators import blocks as framing
from quarry.operators import compression
from quarry.operators.columns import Options
from quarry.operators.frames import decode_blocks, encode_blocks, index_blocks, make_states, state_values, through_blocks
from quarry.sources.blocks import BlockSource
from quarry.sources.files import fresh_path
from quarry.streaming.decoder import StreamDecoder

Query = Callable[[SparkSession, str], DataFrame]

TYPES = {
    "l_orderkey": "Int64", "l_partkey": "Int64", "l_suppkey": "UInt32", "l_linenumber": "Int32", "l_quantity": "Float64", "l_extendedprice": "Float64",
    "l_discount": "Float64", "l_tax": "Float64", "l_returnflag": "LowCardinality(String)", "l_linestatus": "Enum8('F' = 1, 'O' = 2)",
}
COLUMNS = list(TYPES)
_SELECT = "SELECT " + ", ".join("cast(l_suppkey AS BIGINT) AS l_suppkey" if c == "l_suppkey" else c for c in COLUMNS) + " FROM lineitem"


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*COLUMNS)


def _written(spark: SparkSession, df: DataFrame, types: dict, **options: str) -> str:
    """Block files of ``df`` in the shared folder."""
    spark.dataSource.register(BlockSource)
    path = fresh_path(spark, "block-files")
    df.write.format("blocks").options(types=json.dumps(types), **options).mode("append").save(path)
    return path


def _stored(select: tuple[str, ...] = (), **options: str) -> Query:
    """Written to files and read again; reading shares the options."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _written(spark, lineitem(spark, sf_dir), TYPES, **options)
        found = spark.read.format("blocks").options(**{k: v for k, v in options.items() if k != "blockRows"})
        if select:
            found = found.option("columns", ",".join(select))
        return found.load(path)

    return run


def _through(**more) -> Query:
    options = {k: more.pop(k) for k in ("revision", "binary_types") if k in more}
    return lambda spark, sf_dir: through_blocks(lineitem(spark, sf_dir), TYPES, Options(**({"revision": 54460} | options)), **more)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(revision="54460", blockRows="8192")(spark, sf_dir)


def next_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first block of each stream only: here each stream is one order's block."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    types = {"o_orderkey": "Int64", "o_totalprice": "Float64"}
    return through_blocks(orders, types, Options(), block_rows=1000)


def zero_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = block_fields(lineitem(spark, sf_dir).schema, TYPES)
    empty = pa.RecordBatch.from_pylist([], schema=pa.schema([pa.field(n, pa.int64()) for n, _ in fields]))
    block = framing.write_block(empty, fields, Options(revision=54460))
    frame = spark.createDataFrame([(block,)], "block binary")
    return decode_blocks(frame, framing.read_schema(block, Options(revision=54460)), Options(revision=54460))


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of at most 1000 rows, by the rows that the scan finds in them; batches end at partition borders."""
    one = lineitem(spark, sf_dir).coalesce(1)
    found = index_blocks(encode_blocks(one, TYPES, Options(revision=54485), block_rows=1000), Options(revision=54485))
    return found.groupBy().agg(F.sum("rows").alias("n"), F.max("columns").cast("bigint").alias("columns"), (F.sum("rows") == F.sum(F.least("rows", F.lit(1000)))).alias("bounded"))


def block_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan's lengths cover each stream exactly."""
    streams = encode_blocks(lineitem(spark, sf_dir), TYPES, Options(), block_rows=500)
    sizes = streams.select(F.sum(F.octet_length("block")).alias("bytes"), F.sum("rows").alias("n"))
    found = index_blocks(streams, Options()).agg(F.sum("length").alias("length"), F.sum("rows").alias("rows"))
    return sizes.join(found, F.lit(True)).select("n", (F.col("bytes") == F.col("length")).alias("exact"), (F.col("n") == F.col("rows")).alias("same"))


# ---- accessors


def _decoded(given: str, types: dict, source: str = "lineitem") -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.read.parquet(f"{sf_dir}/{source}.parquet").createOrReplaceTempView(f"quarry_{source}")
        return through_blocks(spark.sql(f"SELECT {given} FROM quarry_{source}"), types, Options(revision=54460))

    return run


def null_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _decoded("nullif(l_linenumber, 1) AS x", {"x": "Nullable(Int32)"})(spark, sf_dir)
    return d.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x").isNull()).alias("nulls"), F.count("x").alias("valid"))


def dictionary_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _decoded("l_returnflag AS x", {"x": "LowCardinality(String)"})(spark, sf_dir)
    return d.agg(F.count_distinct("x").alias("keys"), F.count("x").alias("n"))


def array_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _decoded("l_orderkey AS k, array_repeat(l_quantity, l_linenumber) AS x", {"k": "Int64", "x": "Array(Float64)"})(spark, sf_dir)
    return d.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("n"))


def vector_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("max(size(embedding)) AS n").first()[0]
    d = _decoded("vec_id AS k, embedding AS x", {"k": "Int64", "x": f"QBit(Float32, {size})"}, "embeddings")(spark, sf_dir)
    return d.agg(F.min(F.size("x")).cast("bigint").alias("least"), F.max(F.size("x")).cast("bigint").alias("most"))


_CHOICE = "event_id AS k, struct(cast(CASE WHEN event_id % 3 < 2 THEN event_id % 3 END AS smallint) AS tag, CASE WHEN event_id % 3 = 0 THEN event_type END AS v0, CASE WHEN event_id % 3 = 1 THEN cast(user_id AS decimal(20,0)) END AS v1) AS x"


def variant_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values each alternative has: a row's place within its child runs below that."""
    d = _decoded(_CHOICE, {"k": "Int64", "x": "Variant(String, UInt64)"}, "events")(spark, sf_dir)
    return d.groupBy(F.col("x.tag").cast("bigint").alias("tag")).agg(F.count(F.lit(1)).alias("n"), F.count("x.v0").alias("strings"), F.count("x.v1").alias("numbers"))


def dynamic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = "event_id AS k, CASE event_id % 3 WHEN 0 THEN struct('Bool' AS type, '' AS value, unhex('2d01') AS raw) WHEN 1 THEN struct('UInt8' AS type, '' AS value, unhex('0107') AS raw) END AS x"
    d = _decoded(cell, {"k": "Int64", "x": "Dynamic"}, "events")(spark, sf_dir)
    return d.groupBy(F.col("x.type").alias("type")).agg(F.count(F.lit(1)).alias("n"))


def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _decoded("event_id AS k, to_json(named_struct('a', event_id, 'b', named_struct('c', event_type))) AS x", {"k": "Int64", "x": "JSON"}, "events")(spark, sf_dir)
    return d.select(F.col("k"), F.get_json_object("x", "$.a").cast("bigint").alias("a"), F.get_json_object("x", "$.b.c").alias("c"))


def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = spark.read.parquet(f"{sf_dir}/region.parquet").coalesce(1)
    found = index_blocks(encode_blocks(one, {"r_regionkey": "Int32", "r_name": "String"}, Options(), block_rows=2), Options())
    return found.agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("chunks"), F.max("columns").cast("bigint").alias("columns"))


# ---- aggregate states: partial states, through blocks, merged and finalised


def _state_query(value: str, type_name: str, kind: str, nullable: bool = False, source: str = "lineitem", key: str = "l_returnflag", stages: int = 4, final: str = "value") -> Query:
    """Each group's rows in ``stages`` partial sums; their states pass through blocks and are merged by value."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.read.parquet(f"{sf_dir}/{source}.parquet").createOrReplaceTempView(f"quarry_{source}")
        part = spark.sql(f"SELECT {key} AS k, pmod(hash(*), {stages}) AS p, {value} AS v FROM quarry_{source}")
        function = F.count(F.lit(1)) if type_name.startswith("AggregateFunction(count") else F.sum("v")
        partial = part.groupBy("k", "p").agg(function.cast(kind).alias("v"))
        with_states = make_states(partial, "v", type_name).select("k", "state")
        passed = through_blocks(with_states, {"k": "String", "state": type_name}, Options(revision=54460))
        values = state_values(passed, "state", type_name, kind)
        return values.groupBy("k").agg(F.sum("value").cast(kind).alias("v")).select("k", F.expr(final.replace("value", "v")).alias("v"))

    return run


def nothing_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", F.unhex(F.lit("00")).alias("s"))
    passed = through_blocks(rows, {"r_regionkey": "Int32", "s": "AggregateFunction(nothingUInt64, Nullable(Nothing))"}, Options(revision=54460))
    return passed.select("r_regionkey", F.hex("s").alias("s"))


# ---- compression


def _compressed(method: str, block_rows: int = 4096) -> Query:
    return lambda spark, sf_dir: through_blocks(lineitem(spark, sf_dir), TYPES, Options(revision=54460), compression=method, block_rows=block_rows)


def frame_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header fields of each frame of region's blocks, and whether the checksum holds."""
    blocks = encode_blocks(spark.read.parquet(f"{sf_dir}/region.parquet").coalesce(1), {"r_regionkey": "Int32", "r_name": "String"}, Options(), compression="lz4")

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                f = compression.frame_header(data)
                ok = compression.checksum(data[16:]) == f.checksum
                yield pa.RecordBatch.from_pylist([{"method": f.method, "whole": f.length == len(data), "plain": f.plain, "ok": ok}])

    return blocks.select("block").mapInArrow(run, "method string, whole boolean, plain long, ok boolean")


def spoiled_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with their first checksum byte changed are all found out."""
    blocks = encode_blocks(lineitem(spark, sf_dir), TYPES, Options(), compression="lz4", block_rows=5000)

    def run(batches):
        for batch in batches:
            found = 0
            for data in batch.column(0).to_pylist():
                try:
                    compression.decompress_frame(bytes([data[0] ^ 1]) + data[1:])
                except compression.CompressionError:
                    found += 1
            yield pa.RecordBatch.from_pylist([{"found": found, "frames": batch.num_rows}], schema=pa.schema([("found", pa.int64()), ("frames", pa.int64())]))

    counts = blocks.select("block").mapInArrow(run, "found long, frames long")
    return counts.agg((F.sum("found") == F.sum("frames")).alias("all_found"))


# ---- streams


def stream_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every partition's stream is fed to a decoder in pieces of 997 bytes."""
    o = Options(revision=54460)
    fields = block_fields(lineitem(spark, sf_dir).schema, TYPES)
    blocks = encode_blocks(lineitem(spark, sf_dir), TYPES, o, block_rows=700)

    def run(batches):
        decoder = StreamDecoder(o)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                for at in range(0, len(data), 997):
                    for found in decoder.feed(data[at : at + 997]):
                        yield found.replace_schema_metadata(None)
        for found in decoder.finish():
            yield found.replace_schema_metadata(None)

    return blocks.select("block").mapInArrow(run, StructType(spark_schema(fields).fields))


def stream_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of several blocks in pieces of 64 bytes: each block is out with its last byte, and nothing is finished."""
    o = Options(revision=54460)
    fields = block_fields(lineitem(spark, sf_dir).schema, TYPES)
    blocks = encode_blocks(lineitem(spark, sf_dir), TYPES, o, block_rows=2000)

    def run(batches):
        decoder = StreamDecoder(o)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                last = (len(data) - 1) // 64 * 64
                for at in range(0, len(data), 64):
                    for found in decoder.feed(data[at : at + 64]):
                        if at == last and not decoder.buffered_bytes:
                            yield found.replace_schema_metadata(None)

    return blocks.select("block").mapInArrow(run, StructType(spark_schema(fields).fields))


def stream_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block files read by a stream until all is taken, then the table it wrote."""
    path = _written(spark, lineitem(spark, sf_dir).repartition(4, "l_orderkey"), TYPES, revision="54460", blockRows="500")
    schema = spark.read.format("blocks").option("revision", "54460").load(path).schema
    out, state = fresh_path(spark, "stream-out"), fresh_path(spark, "stream-state")
    stream = spark.readStream.format("blocks").schema(schema).option("revision", "54460").option("maxBytesPerTrigger", "1000000").load(path)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).start()
    query.processAllAvailable()
    query.stop()
    return spark.read.parquet(out).select(*COLUMNS)


def stream_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream cut inside a block ends with an error that names what is left."""
    blocks = encode_blocks(spark.read.parquet(f"{sf_dir}/region.parquet").coalesce(1), {"r_regionkey": "Int32", "r_name": "String"}, Options())

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                decoder, message = StreamDecoder(Options()), ""
                decoder.feed(data[:-1])
                try:
                    decoder.finish()
                except framing.NeedMore:
                    message = "cut short"
                yield pa.RecordBatch.from_pylist([{"left": len(data) - 1 - decoder.buffered_bytes, "message": message}])

    return blocks.select("block").mapInArrow(run, "left long, message string")


def arrow_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded batches as one Arrow table, taken back into Spark (region only: the driver holds it)."""
    decoded = through_blocks(spark.read.parquet(f"{sf_dir}/region.parquet"), {"r_regionkey": "Int32", "r_name": "LowCardinality(String)"}, Options())
    return spark.createDataFrame(decoded.toArrow())


def _group(value: str, function: str = "sum", kind: str = "BIGINT") -> str:
    return f"SELECT l_returnflag AS k, cast({function}({value}) AS {kind}) AS v FROM lineitem GROUP BY 1"


def _entries() -> dict[str, tuple[Query, str]]:
    cents = "cast(round(l_extendedprice * 100) AS bigint)"
    out: dict[str, tuple[Query, str]] = {
        "src_decode_all": (flagship, _SELECT),
        "src_decode_all_bin": (_stored(typeHeaders="binary", revision="54460"), _SELECT),
        "src_next_block": (next_block, "SELECT o_orderkey, o_totalprice FROM orders"),
        "sink_encode_block": (_through(), _SELECT),
        "sink_encode_block_bin": (_through(binary_types=True), _SELECT),
        "sink_encode_chunked": (_stored(revision="54485", blockRows="1000"), _SELECT),
        "frame_rev0": (_through(revision=0), _SELECT),
        "frame_rev54460": (_through(revision=54460, block_rows=2000), _SELECT),
        "frame_rev54485": (_through(revision=54485, block_rows=65536), _SELECT),
        "prune_columns": (_stored(("l_orderkey", "l_quantity"), revision="54460"), "SELECT l_orderkey, l_quantity FROM lineitem"),
        "zero_row_schema": (zero_rows, _SELECT + " WHERE false"),
        "scan_block_index": (indexed, "SELECT count(*) AS n, 10::BIGINT AS columns, true AS bounded FROM lineitem"),
        "scan_block_end": (block_ends, "SELECT count(*) AS n, true AS exact, true AS same FROM lineitem"),
        "acc_null_count": (null_count, "SELECT count(*) AS n, count(*) FILTER (WHERE l_linenumber = 1) AS nulls, count(*) FILTER (WHERE l_linenumber <> 1) AS valid FROM lineitem"),
        "acc_lc_cardinality": (dictionary_size, "SELECT count(DISTINCT l_returnflag) AS keys, count(*) AS n FROM lineitem"),
        "acc_array_size": (array_sizes, "SELECT l_linenumber AS size, count(*) AS n FROM lineitem GROUP BY 1"),
        "acc_qbit_size": (vector_sizes, "SELECT min(len(embedding))::BIGINT AS least, max(len(embedding))::BIGINT AS most FROM embeddings"),
        "acc_variant_position": (variant_positions, "SELECT CASE WHEN event_id % 3 < 2 THEN event_id % 3 END AS tag, count(*) AS n, count(*) FILTER (WHERE event_id % 3 = 0) AS strings, count(*) FILTER (WHERE event_id % 3 = 1) AS numbers FROM events GROUP BY 1"),
        "acc_dynamic_type_counts": (dynamic_counts, "SELECT CASE event_id % 3 WHEN 0 THEN 'Bool' WHEN 1 THEN 'UInt8' END AS type, count(*) AS n FROM events GROUP BY 1"),
        "acc_json_paths": (json_paths, "SELECT event_id AS k, event_id AS a, event_type AS c FROM events"),
        "acc_chunk_stats": (chunk_stats, "SELECT count(*) AS rows, (count(*) + 1) // 2 AS chunks, 2::BIGINT AS columns FROM region"),
        "agg_state_count": (_state_query("1", "AggregateFunction(count, UInt64)", "long"), "SELECT l_returnflag AS k, count(*) AS v FROM lineitem GROUP BY 1"),
        "agg_state_sum_int": (_state_query("cast(l_linenumber - 4 AS bigint)", "AggregateFunction(sum, Int32)", "long"), _group("l_linenumber - 4")),
        "agg_state_sum_uint": (_state_query("cast(l_linenumber AS bigint)", "AggregateFunction(sum, UInt8)", "long"), _group("l_linenumber")),
        "agg_state_sum_float": (_state_query("l_quantity", "AggregateFunction(sum, Float64)", "double"), _group("l_quantity", kind="DOUBLE")),
        "agg_state_sum_decimal": (_state_query(cents, "AggregateFunction(sum, Decimal(9, 2))", "long"), _group(cents)),
        "agg_state_sum_wide": (_state_query(cents, "AggregateFunction(sum, Int256)", "long"), _group(cents)),
        "agg_state_sum_enum": (_state_query("CASE l_linestatus WHEN 'F' THEN 1L ELSE 2L END", "AggregateFunction(sum, Enum8('F' = 1, 'O' = 2))", "long"), _group("CASE l_linestatus WHEN 'F' THEN 1 ELSE 2 END")),
        "agg_state_sum_nullable": (_state_query("CASE WHEN l_returnflag <> 'N' THEN cast(l_linenumber AS bigint) END", "AggregateFunction(sum, Nullable(Int32))", "long"), _group("CASE WHEN l_returnflag <> 'N' THEN l_linenumber END")),
        "agg_state_nothing": (nothing_states, "SELECT r_regionkey, '00' AS s FROM region"),
        "comp_none": (_compressed("none"), _SELECT),
        "comp_lz4": (_compressed("lz4"), _SELECT),
        "comp_zstd": (_compressed("zstd"), _SELECT),
        "comp_stream": (_stored(compression="lz4", revision="54460", blockRows="3000"), _SELECT),
        "comp_lz4_multiframe": (_compressed("lz4", 1 << 20), _SELECT),
        "comp_frame_header": (frame_headers, "SELECT 'lz4' AS method, true AS whole, 2 + 1 + 11 + 1 + 5 + 1 + 6 + 1 + 6 + sum(4 + 1 + strlen(r_name))::BIGINT AS plain, true AS ok FROM region"),
        "comp_checksum": (spoiled_checksums, "SELECT true AS all_found"),
        "stream_feed_chunks": (stream_feed, _SELECT),
        "stream_feed_live": (stream_live, _SELECT),
        "stream_files": (stream_files, _SELECT),
        "stream_finish_truncated": (stream_truncated, "SELECT 0::BIGINT AS left, 'cut short' AS message"),
        "arrow_batch": (_through(block_rows=512), _SELECT),
        "arrow_stream": (arrow_stream, "SELECT r_regionkey, r_name FROM region"),
    }
    return out


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in _entries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _entries().items()}
