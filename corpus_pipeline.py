"""The corpus pipeline: five stages from raw documents to token ids, each one operator of ``quarry.llm``.

Every stage takes all rows its predecessor kept. All but the last return the columns of ``documents``, and
whatever other columns came with them. Nulls, empty texts, repeated rows and empty tables are handled as the
operators' docstrings say; stages join on row numbers of their own or on hashes of texts, never on a column
that may clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.bpe import bpe_encode
from quarry.llm.decontam import keep_clean
from quarry.llm.line_dedup import line_dedup
from quarry.llm.minhash import near_duplicates
from quarry.llm.repetition import keep_good
from quarry.llm.scratch import written
from quarry.llm.tokenizers import WORD_BPE, tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject."""
    return keep_good(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines found in three documents or more from all but the one with the largest id.

    A document that loses nothing keeps its text as it is (a null stays null); ``n_chars`` follows the text.
    """
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    found = line_dedup(docs, keep=(*rest, "text"))
    names = ["doc_id", "text", "n_lines", "n_dropped", *(f"k{i}" for i in range(len(rest) + 1))]
    found = found.toDF(*names)
    text = F.when(F.col("n_dropped") == 0, F.col(f"k{len(rest)}")).otherwise(F.col("text"))
    found = found.withColumn("text", text)
    columns = {"doc_id": F.col("doc_id"), "text": F.col("text")} | {c: F.col(f"k{i}") for i, c in enumerate(rest)}
    if "n_chars" in rest:
        columns["n_chars"] = F.when(F.col("n_dropped") == 0, columns["n_chars"]).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*(columns[c].alias(c) for c in docs.columns))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates (five-word shingles, similarity 0.8) the smallest id.

    Of rows that repeat the kept id with the same text, one stays.
    """
    groups = near_duplicates(docs, shingle=5, percent=80)
    gone = written(groups.where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    left = docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(F.col("doc_id").alias("__id"))
    repeated = written(repeated, "repeated-ids")
    if repeated.isEmpty():
        return left
    flagged = left.join(repeated, left["doc_id"] == repeated["__id"], "left")
    # Only rows whose id is repeated can be repeated rows; all others pass without meeting each other.
    single = flagged.where("__id IS NULL").drop("__id")
    several = flagged.where("__id IS NOT NULL").drop("__id").dropDuplicates(["doc_id", "text"])
    return single.unionByName(several)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which at least a twentieth of the words stand in benchmark windows."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and the digest of the text that they decode to."""
    encoded = bpe_encode(docs, tokenizer_file(WORD_BPE))
    return encoded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", dedup_documents),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("bpe_encoding", encode_bpe),
]

#: SQL can't express the quality rules or the tokenizer; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
