"""Tables written once to the folder all executors share, to cut lineage and to survive lost executors."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a temporary one if all runs in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._written_at = path
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more: what was made of them is written itself."""
    for t in tables:
        path = getattr(t, "_written_at", None)
        if path is not None:
            where = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of plans that nothing refers to any more.

    Called where a step's tables are written and the next step is about to shuffle as much again.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
