"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the benchmark's windows of consecutive words. For patterns of one length ``m``, a shift table
over blocks of two words tells how far the end of a window may move without missing an occurrence: ``m - 1``
for blocks in no pattern, else the least distance of the block from a pattern's end. Where the shift is 0,
the block selects the bucket of patterns that end in it, and those are compared word by word.
"""

from __future__ import annotations

import uuid
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.scratch import written
from quarry.llm.text import ALNUM_LOWER, kept_by, slices, text_bytes, values

#: Benchmark text that one broadcast may hold; a larger benchmark is searched in several passes. A worker's tables
#: take about 30 times as much memory.
BENCHMARK_BYTES = 8 << 20


def bench_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text after A-Z are lower-cased."""
    return text.translate(ALNUM_LOWER).split()


class WuManber:
    """Search of many word sequences at once; each pattern carries a set of numbers (its items).

    Patterns stand as places in one list of words, and blocks as their hashes: a block that shares its hash with
    another shifts by the lesser of both distances, and occurrences are confirmed word by word.
    """

    def __init__(self, patterns: dict[tuple[bytes, ...], set[int]]):
        self._build((list(p), len(p), which) for p, which in patterns.items())

    @classmethod
    def of_texts(cls, texts: Iterable[tuple[int | None, bytes]], size: int) -> WuManber:
        """Patterns are the texts' runs of ``size`` words; a shorter text that has words is one run."""
        out = cls.__new__(cls)
        out._build((bench_words(body), size, [] if item is None else [item]) for item, body in texts)
        return out

    def _build(self, texts: Iterable[tuple[list[bytes], int, Iterable[int]]]) -> None:
        self.words: list[bytes] = []
        self.items: list[tuple[int, ...]] = []
        owner, starts = array("i"), defaultdict(lambda: array("i"))
        known: dict[bytes, bytes] = {}
        for words, size, which in texts:
            if words:
                m = min(size, len(words))
                starts[m].extend(range(len(self.words), len(self.words) + len(words) - m + 1))
                owner.extend([len(self.items)] * len(words))
                self.words.extend(known.setdefault(w, w) for w in words)
                self.items.append(tuple(which))
        self.owner = owner
        self.groups = [(m, *self._tables(m, starts[m])) for m in sorted(starts)]

    def _tables(self, m: int, starts: array) -> tuple[dict[int, int], list[int], array, array]:
        """Shifts by block (below 0: the bucket of patterns that end in it, less one), and buckets sorted by the patterns' hashes."""
        words, size = self.words, min(2, m)
        shift: dict[int, int] = {}
        for p in starts:
            for end in range(size, m + 1):
                block = hash(tuple(words[p + end - size : p + end]))
                if shift.get(block, m) > m - end:
                    shift[block] = m - end
        blocks = np.fromiter((hash(tuple(words[p + m - size : p + m])) for p in starts), np.int64, len(starts))
        hashes = np.fromiter((hash(tuple(words[p : p + m])) for p in starts), np.int64, len(starts))
        order = np.lexsort((hashes, blocks))
        blocks = blocks[order]
        bounds = np.flatnonzero(np.diff(blocks, prepend=~blocks[:1]))
        for k, block in enumerate(blocks[bounds].tolist(), 1):
            shift[block] = -k
        places = np.frombuffer(starts, dtype=np.int32)[order]
        return shift, [*bounds.tolist(), len(blocks)], array("q", hashes[order].tobytes()), array("i", places.tobytes())

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of all occurrences as (start, end), ordered within each pattern length, and the items that occur."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        n = len(words)
        for m, shift, bounds, hashes, places in self.groups:
            if n < m:
                break
            get, far, i = shift.get, max(m - 1, 1), m - 1
            while i < n:
                step = get(hash((words[i - 1], words[i])) if m > 1 else hash((words[i],)), far)
                if step > 0:
                    i += step
                    continue
                window = words[i - m + 1 : i + 1]
                key, end = hash(tuple(window)), bounds[-step]
                k, hit = bisect_left(hashes, key, bounds[-step - 1], end), False
                while k < end and hashes[k] == key:
                    p = places[k]
                    if self.words[p : p + m] == window:
                        hit = True
                        found.add(self.owner[p])
                    k += 1
                if hit:
                    spans.append((i - m + 1, i + 1))
                i += 1
        return spans, {x for o in found for x in self.items[o]}


#: The search tables of the worker's last benchmark part, by name.
_BUILT: dict[str, tuple] = {}


def _built(shared, name: str, size: int) -> tuple[WuManber, list[str]]:
    kept_by("decontamination", _BUILT)
    if name not in _BUILT:
        _BUILT.clear()
        rows = shared.value
        names = sorted({item for item, _ in rows if item is not None})
        number = {x: k for k, x in enumerate(names)}
        _BUILT[name] = (WuManber.of_texts(((None if item is None else number[item], body) for item, body in rows), size), names)
    return _BUILT[name]


def _search(docs: DataFrame, rows: list, size: int, doc_id: str, text: str, keep: str | None) -> DataFrame:
    """One pass over the documents with the patterns of ``rows`` (item as string, text as bytes)."""
    shared, name = docs.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, names = _built(shared, name, size)
        for whole in batches:
            for batch in slices(whole, "__text"):
                n_words, spans, items = [], [], []
                for t in values(batch.column(batch.num_columns - 1)):
                    words = bench_words(t)
                    found, which = search.find(words)
                    n_words.append(len(words))
                    spans.append([x for s in _union(found) for x in s])
                    items.append([names[k] for k in sorted(which)])
                columns = [*batch.columns[:-1], pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "n_words", "spans", "items"])

    kind = docs.schema[doc_id].dataType.simpleString()
    head = [F.col(doc_id).alias("doc_id")] + ([F.col(keep)] if keep else [])
    extra = f", {keep} binary" if keep else ""
    return docs.select(*head, text_bytes(docs, text).alias("__text")).mapInArrow(run, f"doc_id {kind}{extra}, n_words long, spans array<int>, items array<string>")


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, with those that touch or overlap joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def benchmark_parts(benchmark: DataFrame, item_id: str, text: str, limit: int) -> tuple[int, Iterator[list]]:
    """How many parts of about ``limit`` bytes the benchmark has, and their rows (item, body), one part at a time."""
    body = F.coalesce(benchmark[text], F.lit("")).cast("binary")
    total = benchmark.agg(F.sum(F.length(body))).first()[0] or 0
    n = max(1, -(-2 * total // limit)) if total > limit else 1
    rows = benchmark.select(benchmark[item_id].cast("string").alias("item"), body.alias("body"))
    part = F.pmod(F.xxhash64("item", "body"), F.lit(n))
    return n, ([(r.item, bytes(r.body)) for r in rows.where(part == k).toLocalIterator()] for k in range(n))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = 13,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    benchmark_bytes: int = BENCHMARK_BYTES,
) -> DataFrame:
    """Where benchmark windows occur: ``doc_id, n_words long, spans array<int>, items array<string>, n_hit long``.

    ``spans`` are start and end of the joined hit word ranges, in turn; ``items`` the ids (as strings, sorted)
    of the benchmark items with an occurring window; ``n_hit`` the words inside ``spans``. One row for each
    input row. A null text has no words; an item without words has no window; an item whose id is null hits
    words but is not named. An empty benchmark hits nothing. Other columns are left out, whatever their names.

    The benchmark is broadcast in parts of at most ``benchmark_bytes`` of text: up to that size the documents
    are read once and nothing is shuffled. A larger one takes a pass for each part, whose rows meet by
    document and text.
    """
    n_parts, parts = benchmark_parts(benchmark, item_id, item_text, benchmark_bytes)
    hit = F.aggregate(
        F.transform(F.col("spans"), lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x
    )
    if n_parts == 1:
        return _search(docs, next(parts), window, doc_id, text, None).withColumn("n_hit", hit)
    keyed = docs.select(F.col(doc_id), F.col(text), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("__key"))
    found = [_search(keyed, rows, window, doc_id, text, "__key") for rows in parts]
    rest = found[0]
    for more in found[1:]:
        rest = rest.unionByName(more)
    # Repeated rows are counted in the first part and come back as many times.
    starts = F.sequence(F.lit(1), F.size("spans") - 1, F.lit(2))
    pairs = F.transform(starts, lambda i: F.struct(F.element_at("spans", i).alias("a"), F.element_at("spans", i + 1).alias("b")))
    rest = rest.withColumn("pairs", F.when(F.size("spans") > 0, pairs).otherwise(F.array().cast("array<struct<a:int,b:int>>")))
    merged = rest.groupBy("doc_id", "__key").agg(
        F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("pairs")))).alias("pairs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        (F.count(F.lit(1)) / n_parts).cast("int").alias("copies"),
    )
    empty = F.array().cast("array<int>")
    joined = F.aggregate(
        "pairs",
        empty,
        lambda acc, p: F.when((F.size(acc) > 0) & (F.element_at(acc, -1) >= p["a"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.greatest(F.element_at(acc, -1), p["b"])))).otherwise(F.concat(acc, F.array(p["a"], p["b"]))),
    )
    rows = merged.withColumn("spans", joined).withColumn("__copy", F.explode(F.sequence(F.lit(1), "copies")))
    return rows.select("doc_id", "n_words", "spans", "items").withColumn("n_hit", hit)


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, share: int = 20, text: str = "text", item_id: str = "item_id", item_text: str = "text", benchmark_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """The rows of ``docs`` with no hit words or fewer than one in ``share``, all columns as they are.

    Nothing is shuffled. A benchmark above ``benchmark_bytes`` filters in several passes, each of which adds its
    hits to a column of spans, so that the share is taken of all hits together.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    names = [f"c{k}" for k in range(len(columns))]
    rows = docs.select(*(c.alias(n) for c, n in zip(columns, names, strict=True)), text_bytes(docs, text).alias("__text"), F.array().cast("array<int>").alias("__spans"))
    n_parts, parts = benchmark_parts(benchmark, item_id, item_text, benchmark_bytes)
    schema = rows.schema
    for k, part in enumerate(parts):
        last = k == n_parts - 1
        rows = rows.mapInArrow(_adding_hits(docs.sparkSession.sparkContext.broadcast(part), uuid.uuid4().hex, window, share if last else None), schema)
        if not last:  # else the tables of all parts would be in memory at once
            rows = written(rows, "hits")
    return rows.drop("__text", "__spans").toDF(*docs.columns)


def _adding_hits(shared, name: str, size: int, share: int | None):
    """A worker's function that adds spans and, with ``share``, drops the rows that have too many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, _ = _built(shared, name, size)
        for whole in batches:
            for batch in slices(whole, "__text"):
                spans, keep = [], []
                for t, before in zip(values(batch.column(batch.num_columns - 2)), values(batch.column(batch.num_columns - 1)), strict=True):
                    words = bench_words(t)
                    joined = _union([*zip(before[::2], before[1::2], strict=True), *search.find(words)[0]])
                    spans.append([x for s in joined for x in s])
                    keep.append(share is None or not joined or share * sum(b - a for a, b in joined) < len(words))
                out = pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(spans, pa.list_(pa.int32()))], names=batch.schema.names)
                yield out.filter(pa.array(keep))

    return run
