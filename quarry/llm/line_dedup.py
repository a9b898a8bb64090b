"""Line dedup with levelled sorted runs of line hashes, in DataFrame operations only.

Documents come in batches of falling ids. A batch's line hashes are merge-anti-joined with the runs so far: a
hash that no run holds is new, and its largest id in this batch is its keeper, since later batches hold smaller
ids; a hash already held adds its number of documents only. The batch then becomes a sorted run of its own.
``fanout`` runs of a level are compacted into one of the next, which adds up the counts. When all batches are
in, the last compaction knows every hash's number of documents and its keeper.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from quarry.llm.scratch import discard, written

_SPACES = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(_SPACES)), _UPPER, _UPPER.lower())


class LineRuns:
    """Levels of sorted runs ``h1, h2, n_docs, keeper``; ``keeper`` is set in the one run where a hash was new."""

    def __init__(self, fanout: int = 2):
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def _union(self, runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, runs)

    def _compacted(self, runs: list[DataFrame]) -> DataFrame:
        merged = self._union(runs).groupBy(*_KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))
        return merged.sortWithinPartitions(*_KEY)

    def add(self, lines: DataFrame) -> DataFrame:
        """Adds a batch of ``h1, h2, doc_id`` (ids below all before it); returns its run, keeper set where new.

        A run is there until its level is compacted.
        """
        once = lines.groupBy(*_KEY, "doc_id").agg(F.lit(1).alias("one"))
        keys = once.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last"))
        if self.runs():
            held = self._union([r.where("keeper IS NOT NULL").select(*_KEY, F.lit(True).alias("held")) for r in self.runs()])
            keys = keys.join(held, _KEY, "left")
        else:
            keys = keys.withColumn("held", F.lit(None).cast("boolean"))
        keys = keys.select(*_KEY, "n_docs", F.when(F.col("held").isNull(), F.col("last")).alias("keeper"))
        run = written(keys.sortWithinPartitions(*_KEY), "line-run")
        self._push(0, run)
        return run

    def _push(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._push(level + 1, written(self._compacted(full), f"line-level{level + 1}"))
            discard(*full)

    def total(self) -> DataFrame:
        """One row for each hash: its number of documents and its keeper."""
        runs = self.runs()
        return runs[0] if len(runs) == 1 else self._compacted(runs)


def line_dedup(
    docs: DataFrame, *, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 2, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Drops lines that many documents share: ``doc_id, text string, n_lines long, n_dropped long``, then ``keep``.

    A line's key is the line stripped and lower-cased as in ``line_key``. Keys of at least ``min_chars`` code
    points found in at least ``min_docs`` documents lose all their lines but those in the largest id that holds
    them; the others stay, joined by a line feed. ``n_lines`` counts the lines before.

    A null or empty text is one empty line. Rows with one id are one document. A row with a null id is in no
    document: it is returned as it is. Repeated rows come back as often. An empty table gives no rows. ``keep``
    names further columns to return; others are left out, whatever their names. Ids are of any type that has
    an order. Keys are compared by 128 bits of hash. Shuffled are the hashes, the positions of dropped lines, and the texts once (to meet them).
    """
    numeric = docs.schema[doc_id].dataType.simpleString()
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("th"), *(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)))
    bounds = []
    if batches > 1 and isinstance(docs.schema[doc_id].dataType, NumericType):  # other ids go in one batch
        cut = rows.agg(F.percentile_approx("doc_id", [1 - (i + 1) / batches for i in range(batches - 1)], 1000)).first()[0]
        bounds = sorted(set(cut or []), reverse=True)
    batch = F.lit(0)
    for b in bounds:
        batch = batch + (F.col("doc_id") <= F.lit(b).cast(numeric)).cast("int")
    exploded = rows.where("doc_id IS NOT NULL").select("doc_id", "th", batch.alias("batch"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = exploded.select("doc_id", "th", "batch", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    hashed = keyed.select("doc_id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"), "batch")
    lines = written(hashed, "lines")
    runs = LineRuns(fanout)
    for b in range(len(bounds) + 1):
        runs.add(lines.where(F.col("batch") == b).select(*_KEY, "doc_id"))
    common = runs.total().where(F.col("n_docs") >= min_docs).select(*_KEY, "keeper")
    gone = lines.join(common, _KEY).where(F.col("doc_id") != F.col("keeper"))
    drops = gone.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    met = rows.join(drops, ["doc_id", "th"], "left")
    split, n = F.split("text", "\n", -1), F.size("gone")
    gaps = F.transform(
        F.sequence(F.lit(0), n),
        lambda i: F.slice(
            F.col("lines"),
            F.when(i == 0, F.lit(1)).otherwise(F.get("gone", i - 1) + 2),
            F.when(i == n, F.size("lines")).otherwise(F.get("gone", i)) - F.when(i == 0, F.lit(0)).otherwise(F.get("gone", i - 1) + 1),
        ),
    )
    out = met.withColumn("lines", split)
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(gaps), "\n"))
    dropped = F.coalesce(F.size("gone").cast("long"), F.lit(0).cast("long"))
    return out.select(
        "doc_id", kept.alias("text"), F.size("lines").cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), F.lit(0).cast("long")).otherwise(dropped).alias("n_dropped"), *(f"k{i}" for i in range(len(keep)))
    ).toDF("doc_id", "text", "n_lines", "n_dropped", *keep)
