"""Sharding by a minimax contiguous partition, in DataFrame operations only.

Groups of equal texts are atomic and ordered by the hash of their text (texts of one 64-bit hash count as one
group). Binary search finds the smallest capacity with which a greedy pass over the groups needs no more than the
given shards, and the cuts are made there. Where that capacity leaves room (one huge group sets it, say), each cut
goes as near to an equal share of what remains as the capacity allows.

The driver never holds all groups: it starts from the sums of ``2 ** CELL_BITS`` cells of the hash order. The
smallest capacity lies between a bound for divisible cells and the optimum for undivided ones, which leaves a few
cells in which a cut may fall; those are split by the next ``STEP_BITS`` bits, again and again, until every cell
in reach of a cut holds one group. The cuts are then exact over groups.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.scratch import written

#: Bits of the hash that make a cell at first, and that split one further: the driver holds one sum for each cell.
CELL_BITS = 16
STEP_BITS = 8
#: Row ranges of a shard that number their rows on their own.
SLOT_BUCKETS = 1024


def _greedy(prefix: list[int], start: int, capacity: int) -> int:
    """Shards that a greedy pass over the cells from ``start`` on needs, none above ``capacity``."""
    used, last = 0, len(prefix) - 1
    while start < last:
        start = bisect_right(prefix, prefix[start] + capacity) - 1
        used += 1
    return used


def minimax_cuts(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """The smallest largest shard of a contiguous partition of ``sizes``, and the first cell of shards 1 and on.

    Later shards may be empty. No sizes at all give capacity 0 and cuts behind the end.
    """
    prefix = [0, *accumulate(sizes)]
    low, high = max([*sizes, -(-prefix[-1] // shards)], default=0), prefix[-1]
    while low < high:
        middle = (low + high) // 2
        if _greedy(prefix, 0, middle) <= shards:
            high = middle
        else:
            low = middle + 1
    cuts, start = [], 0
    for left in range(shards - 1, 0, -1):
        most = bisect_right(prefix, prefix[start] + low) - 1
        # The least cut after which the shards that are left still suffice: needs only fall as the cut moves on.
        a, b = start, most
        while a < b:
            middle = (a + b) // 2
            if _greedy(prefix, middle, low) <= left:
                b = middle
            else:
                a = middle + 1
        target = prefix[start] + (prefix[-1] - prefix[start]) / (left + 1)
        near = bisect_left(prefix, target)
        if near and (near >= len(prefix) or target - prefix[near - 1] <= prefix[near] - target):
            near -= 1
        start = min(max(near, a), most)
        cuts.append(start)
    return low, cuts


def _in_reach(cells: list[tuple[int, int, int, bool]], shards: int) -> list[int]:
    """Which cells (first hash, bits, size, whether one group) must be split before the cuts are exact."""
    prefix = [0, *accumulate(c[2] for c in cells)]
    most, _ = minimax_cuts([c[2] for c in cells], shards)
    least = max([-(-prefix[-1] // shards), *(c[2] for c in cells if c[3])])
    found = {k for k, c in enumerate(cells) if c[2] > least}
    low = high = 0
    for _ in range(shards - 1):
        # Where a greedy pass may cut, at the least and at the greatest capacity.
        low, high = prefix[bisect_right(prefix, low + least) - 1], min(prefix[-1], high + most)
        found.update(range(bisect_right(prefix, low) - 1, min(bisect_left(prefix, high), len(cells))))
    return sorted(k for k in found if not cells[k][3])


def _cells(rows: DataFrame, parents: list[tuple[int, int]] | None) -> list[tuple[int, int, int, bool]]:
    """Cells of all rows, or those that the given cells (first hash, bits) split into, in order."""
    at = lambda bits: F.shiftrightunsigned(F.col("h"), 64 - bits)
    sums = (F.sum("size"), F.min("h") == F.max("h"))
    if parents is None:
        parts = [(CELL_BITS, rows.groupBy(at(CELL_BITS)).agg(*sums).collect())]
    else:
        parts = []
        for bits in sorted({b for _, b in parents}):
            numbers = [(first >> (64 - bits),) for first, b in parents if b == bits]
            wanted = rows.sparkSession.createDataFrame(numbers, "parent long")
            inside = rows.join(F.broadcast(wanted), at(bits) == F.col("parent"), "left_semi")
            finer = min(bits + STEP_BITS, 64)
            parts.append((finer, inside.groupBy(at(finer)).agg(*sums).collect()))
    return sorted(((n % (1 << bits)) << (64 - bits), bits, size, single) for bits, found in parts for n, size, single in found)


def group_cuts(rows: DataFrame, shards: int) -> list[int]:
    """First hashes (unsigned) of shards 1 and on, for rows with ``h`` (the group's hash) and ``size``."""
    cells = _cells(rows, None)
    while cells:
        split = _in_reach(cells, shards)
        if not split:
            break
        finer = _cells(rows, [cells[k][:2] for k in split])
        gone = set(split)
        cells = sorted([c for k, c in enumerate(cells) if k not in gone] + finer)
    _, cuts = minimax_cuts([c[2] for c in cells], shards)
    return [cells[c][0] if c < len(cells) else 1 << 64 for c in cuts]


def shard(docs: DataFrame, *, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Puts whole groups of equal texts into shards of near equal bytes.

    Returns ``doc_id, size long, text_crc32 long, shard int, slot long``: ``size`` is the UTF-8 bytes plus 1 (a
    null text counts as empty), ``slot`` numbers each shard's rows from 0 without gaps. One row for each input
    row, repeated rows and null ids included; other columns are left out, whatever their names. An empty table
    gives no rows.

    The texts are read once. The driver gets one sum for each of ``2 ** CELL_BITS`` cells, and those of the cells
    that a cut may fall in; slots are numbered in ``shards * SLOT_BUCKETS`` ranges whose rows are dealt by the hash
    of id and text, so that neither a large group nor a large shard meets in one task (rows that repeat both do).
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = written(
        docs.select(
            F.col(doc_id).alias("doc_id"), (F.octet_length(body) + F.lit(1)).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("h")
        ),
        "shard-rows",
    )
    number = F.lit(0)
    for first in group_cuts(rows, shards):
        if first < 1 << 64:  # else the shard is empty
            number = number + (F.col("h").bitwiseXOR(F.lit(-(1 << 63))) >= F.lit(first - (1 << 63))).cast("int")
    bucket = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SLOT_BUCKETS)).cast("int")
    placed = rows.select("doc_id", "size", "text_crc32", number.alias("shard"), bucket.alias("bucket"))
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    offsets = counts.select(F.col("shard").alias("__s"), F.col("bucket").alias("__b"), before.alias("__before"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    numbered = placed.withColumn("__n", within)
    # At most shards * SLOT_BUCKETS rows: small at any size of the data.
    joined = numbered.join(F.broadcast(offsets), (F.col("shard") == F.col("__s")) & (F.col("bucket") == F.col("__b")))
    return joined.select("doc_id", "size", "text_crc32", "shard", (F.col("__before") + F.col("__n") - 1).cast("long").alias("slot"))
