import json

import pytest
from pyspark.sql import functions as F

from quarry.functions.arrow_types import block_fields
from quarry.operators.columns import Options
from quarry.operators.frames import encode_blocks, through_blocks
from quarry.queries.registry import oracle_sql, queries
from quarry.sources.blocks import BlockSource, index_files

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def rows(spark):
    return spark.range(1000).select(F.col("id"), (F.col("id") % 7).cast("string").alias("s"), F.when(F.col("id") % 3 > 0, F.col("id") * 1.5).alias("v"))


@pytest.mark.parametrize("options", [{}, {"compression": "lz4"}, {"typeHeaders": "binary", "revision": "54485"}, {"blockRows": "10"}], ids=str)
def test_write_and_read(spark, rows, tmp_path, options):
    spark.dataSource.register(BlockSource)
    path = str(tmp_path / "t")
    rows.write.format("blocks").options(types=json.dumps({"s": "LowCardinality(String)"}), **options).mode("append").save(path)
    found = spark.read.format("blocks").options(**options).option("splitBytes", "2000").load(path)
    assert found.schema["s"].metadata["block_type"] == "LowCardinality(String)"
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.collect()))
    again = str(tmp_path / "again")
    found.write.format("blocks").mode("append").save(again)  # types come from the metadata
    assert spark.read.format("blocks").load(again).schema["s"].metadata["block_type"] == "LowCardinality(String)"
    picked = spark.read.format("blocks").options(**options).option("columns", "v").load(path)
    assert picked.columns == ["v"] and picked.count() == 1000


def test_indexes(spark, rows, tmp_path):
    spark.dataSource.register(BlockSource)
    path = str(tmp_path / "t")
    rows.coalesce(1).write.format("blocks").option("blockRows", "100").mode("append").save(path)
    small = spark.read.format("blocks").option("splitBytes", "3000").load(path)
    parts = small.rdd.getNumPartitions()
    assert parts > 3 and small.count() == 1000
    for p in tmp_path.glob("t/.*.index"):
        p.unlink()
    whole = spark.read.format("blocks").option("splitBytes", "3000").load(path)
    assert whole.rdd.getNumPartitions() == 1 and sorted(map(tuple, whole.collect())) == sorted(map(tuple, rows.collect()))
    assert [(r.blocks, r.rows) for r in index_files(spark, path).collect()] == [(10, 1000)]
    assert spark.read.format("blocks").option("splitBytes", "3000").load(path).rdd.getNumPartitions() == parts


def test_overwrite(spark, rows, tmp_path):
    spark.dataSource.register(BlockSource)
    path = str(tmp_path / "t")
    for n in (10, 20):
        rows.limit(n).write.format("blocks").mode("overwrite").save(path)
        assert spark.read.format("blocks").load(path).count() == n


def test_default_types(spark, rows):
    assert [str(t) for _, t in block_fields(rows.schema)] == ["Int64", "Nullable(String)", "Nullable(Float64)"]
    nested = spark.sql("SELECT array(1, 2) AS a, map('k', 1.5D) AS m, struct(1 AS x, 'y' AS y) AS s, cast(1.25 AS decimal(9, 2)) AS d")
    back = through_blocks(nested, None, Options(revision=54460))
    assert back.selectExpr("a[1]", "m[0].key", "s.y", "d").first()[:3] == (2, "k", "y")


def test_no_rows(spark, rows):
    assert encode_blocks(rows.where("id < 0")).count() == 0


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql()) and len(queries()) > 130


def test_stream_offsets_end_at_blocks(tmp_path):
    import pyarrow as pa
    from pyspark.sql.types import LongType, StructField, StructType

    from quarry.functions.types import parse
    from quarry.operators.blocks import write_block
    from quarry.sources.blocks import BlockStreamReader

    blocks = [write_block(pa.RecordBatch.from_pydict({"x": pa.array([i, i])}), [("x", parse("Int64"))], Options(revision=54460)) for i in range(4)]
    file = tmp_path / "a.blocks"
    file.write_bytes(blocks[0] + blocks[1] + blocks[2][:-3])
    reader = BlockStreamReader(BlockSource({"path": str(tmp_path)}), StructType([StructField("x", LongType())]))
    first = reader.latestOffset()
    assert list(first.values()) == [len(blocks[0]) * 2]
    with file.open("ab") as f:
        f.write(blocks[2][-3:] + blocks[3])
    second = reader.latestOffset()
    rows = [v for part in reader.partitions(first, second) for b in reader.read(part) for v in b.column(0).to_pylist()]
    assert rows == [2, 2, 3, 3] and reader.partitions(second, second) == []
    # After a restart the offset comes from the checkpoint.
    again = BlockStreamReader(BlockSource({"path": str(tmp_path)}), StructType([StructField("x", LongType())]))
    again.partitions(first, first)
    assert again.latestOffset() == second
