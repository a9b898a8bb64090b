"""Blocks as rows of DataFrames: encoding, decoding, indexing, compression and states inside a query."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from quarry.functions.arrow_types import block_fields, spark_schema
from quarry.functions.types import T, parse
from quarry.functions.wire import Reader
from quarry.operators import states
from quarry.operators.blocks import block_index, read_block, read_blocks, write_block
from quarry.operators.columns import Options
from quarry.operators.compression import compress_frames, decompress_stream


def encode_blocks(df: DataFrame, types: dict[str, str] | None = None, options: Options | None = None, *, block_rows: int = 65536, compression: str = "none") -> DataFrame:
    """``block binary, rows long``: the rows of ``df`` in blocks, encoded where they lie, without a shuffle.

    A block never spans partitions or Arrow batches. No rows give no blocks.
    """
    o, fields = options or Options(), block_fields(df.schema, types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                piece = batch.slice(at, block_rows)
                block = write_block(piece, fields, o)
                if compression != "none":
                    block = compress_frames(block, compression)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary()), pa.array([piece.num_rows], pa.int64())], names=["block", "rows"])

    return df.mapInArrow(run, "block binary, rows long")


def decode_blocks(blocks: DataFrame, fields: list[tuple[str, T]], options: Options | None = None, *, columns: list[str] | None = None, compressed: bool = False) -> DataFrame:
    """The rows of all blocks in column ``block``; ``columns`` are read and the others skipped."""
    o = options or Options()
    kept = [f for f in fields if columns is None or f[0] in columns]
    names = [n for n, _ in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                for found in read_blocks(decompress_stream(block) if compressed else block, o, set(names)):
                    yield found.replace_schema_metadata(None)

    return blocks.select("block").mapInArrow(run, StructType(spark_schema(kept, o.strings).fields))


def through_blocks(df: DataFrame, types: dict[str, str] | None = None, options: Options | None = None, *, block_rows: int = 65536, compression: str = "none", columns: list[str] | None = None) -> DataFrame:
    """``df`` encoded into blocks and decoded again."""
    blocks = encode_blocks(df, types, options, block_rows=block_rows, compression=compression)
    return decode_blocks(blocks, block_fields(df.schema, types), options, columns=columns, compressed=compression != "none")


def index_blocks(blocks: DataFrame, options: Options | None = None) -> DataFrame:
    """``offset, length, rows long, columns int`` of every block, found by skipping."""
    o = options or Options()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [e for block in batch.column(0).to_pylist() for e in block_index(block, o)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([e.offset for e in found], pa.int64()), pa.array([e.length for e in found], pa.int64()), pa.array([e.rows for e in found], pa.int64()), pa.array([e.columns for e in found], pa.int32())],
                names=["offset", "length", "rows", "columns"],
            )

    return blocks.select("block").mapInArrow(run, "offset long, length long, rows long, columns int")


def make_states(df: DataFrame, value: str, type_name: str, out: str = "state") -> DataFrame:
    """``df`` with a column of states that hold ``value``, an integer, double or null."""
    codec = states.codec(parse(type_name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [codec.make(v) for v in batch.column(batch.schema.get_field_index(value)).to_pylist()]
            yield batch.append_column(out, pa.array(made, pa.binary()))

    return df.mapInArrow(run, StructType([*df.schema.fields]).add(out, "binary"))


def state_values(df: DataFrame, state: str, type_name: str, kind: str, out: str = "value") -> DataFrame:
    """``df`` with what its states hold, as Spark type ``kind`` (``long``, ``double``, ``decimal(38,0)``)."""
    codec = states.codec(parse(type_name))
    schema = StructType([*df.schema.fields]).add(out, kind)
    target = {"long": pa.int64(), "double": pa.float64()}.get(kind) or pa.decimal128(38, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if s is None else codec.value(s) for s in batch.column(batch.schema.get_field_index(state)).to_pylist()]
            yield batch.append_column(out, pa.array(found, target))

    return df.mapInArrow(run, schema)


def block_rows(data: bytes, o: Options) -> int:
    """Rows of one block."""
    found = read_block(Reader(data), o)
    return found[0].num_rows if found else 0
