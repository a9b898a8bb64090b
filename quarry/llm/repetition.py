"""Quality rules, with repetition measured by suffix arrays.

The words of many documents are numbered and laid end to end, each document's words in a number range of its
own, so that one suffix array serves them all and no repeat crosses documents. Doubling ranks (of runs of 1, 2,
4, ... words) sort the suffixes; only suffixes that still tie are sorted again. From the ranks follow the
longest common prefixes of neighbours, whose intervals are the maximal repeated substrings. A place in a
repeat of at least ``min_repeat`` words covers that many words; the union of those spans and the longest repeat
are what the rules limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.text import kept_by, slices, text_bytes, values

#: A repeat shorter than this many words is ordinary language.
MIN_REPEAT = 8
#: Of a document's words, the percentage that repeats may cover, and that the longest repeat may take.
MAX_COVERED = 40
MAX_LONGEST = 25
#: Of the non-space characters, the percentage that may be symbols; of the lines, the percentage of repeated ones.
MAX_SYMBOLS = 5
MAX_DUP_LINES = 40

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", dtype=np.uint8))
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", dtype=np.uint8))


def _ranks(first: np.ndarray) -> list[np.ndarray]:
    """Ranks of the runs of 1, 2, 4, ... items from each place on, until none tie; a run may end early at the end."""
    n = len(first)
    levels = [first]
    rank, k = first, 1
    while True:
        order_size = int(rank.max()) + 1 if n else 0
        counts = np.bincount(rank, minlength=order_size)
        tied = np.flatnonzero(counts[rank] > 1)
        if len(tied) == 0 or k >= n:
            return levels
        after = np.full(len(tied), -1, dtype=np.int64)
        inside = tied + k < n
        after[inside] = rank[tied[inside] + k]
        key = rank[tied] * np.int64(n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new_group = np.empty(len(order), dtype=bool)
        new_group[0] = True
        new_group[1:] = sorted_key[1:] != sorted_key[:-1]
        # A group of equal ranks is numbered from its first place on, so ranks of those no longer tied stay.
        base = rank[tied][order]
        place = np.arange(len(order))
        starts = np.flatnonzero(np.concatenate([[True], base[1:] != base[:-1]]))
        within = place - np.repeat(starts, np.diff(np.concatenate([starts, [len(order)]])))
        group_first = np.maximum.accumulate(np.where(new_group, place, 0))
        rank = rank.copy()
        rank[tied[order]] = base + within[group_first]
        levels.append(rank)
        k *= 2


def _dense(values: np.ndarray) -> np.ndarray:
    """Each value's number of smaller values: equal values get equal ranks."""
    order = np.argsort(values, kind="stable")
    s = values[order]
    first = np.maximum.accumulate(np.where(np.concatenate([[True], s[1:] != s[:-1]]), np.arange(len(s)), 0)) if len(s) else order
    out = np.empty(len(s), dtype=np.int64)
    out[order] = first
    return out


def longest_repeats(items: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each place, the length of the longest run from it on that also starts elsewhere; and the doubling ranks.

    ``items`` are integers; a run that must not leave its document needs a value of its own after each one.
    """
    n = len(items)
    if n == 0:
        return np.zeros(0, dtype=np.int64), []
    levels = _ranks(_dense(items))
    last = levels[-1]
    suffix = np.argsort(last, kind="stable")
    lcp = np.zeros(n + 1, dtype=np.int64)
    a, b = suffix[:-1], suffix[1:]
    live = np.flatnonzero(levels[0][a] == levels[0][b])
    length = np.zeros(len(live), dtype=np.int64)
    a, b = a[live], b[live]
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + length, b + length
        ok = (i < n) & (j < n)
        same = np.zeros(len(live), dtype=bool)
        same[ok] = levels[k][i[ok]] == levels[k][j[ok]]
        # Equal ranks of 2^k items also where both runs are cut short, which only the end of the data does.
        length[same] += 1 << k
    lcp[live + 1] = np.minimum(length, n - np.maximum(a, b))
    out = np.zeros(n, dtype=np.int64)
    out[suffix] = np.maximum(lcp[:-1], lcp[1:])
    return out, levels


def _per_doc_unions(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` places, whether a span covers it."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:-1]) > 0


def measure(texts: list[bytes], min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """The base counts and the repetition figures of many texts at once."""
    n_docs = len(texts)
    words = [t.split() for t in texts]
    n_words = np.array([len(w) for w in words], dtype=np.int64)
    buffer = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = np.concatenate([[0], ends[:-1]])

    def per_doc(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[ends] - total[starts]

    word_chars = per_doc(((buffer & 0xC0) != 0x80) & ~_SPACE[buffer])
    n_symbols = per_doc(_SYMBOL[buffer])
    n_lines, n_dup = np.zeros(n_docs, dtype=np.int64), np.zeros(n_docs, dtype=np.int64)
    for k, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if x and not x.isspace()]
        n_lines[k], n_dup[k] = len(lines), len(lines) - len(set(lines))
    # Each document's words get numbers of their own, and a closing item that occurs nowhere else.
    total = int(n_words.sum()) + n_docs
    items, number, at, used = np.empty(total, dtype=np.int64), {}, 0, 0
    doc_start = np.empty(n_docs, dtype=np.int64)
    for k, w in enumerate(words):
        doc_start[k] = at
        number.clear()
        items[at : at + len(w)] = [number.setdefault(x, len(number)) for x in w]
        items[at : at + len(w)] += used
        used += len(number)
        items[at + len(w)] = used
        used += 1
        at += len(w) + 1
    repeat, levels = longest_repeats(items)
    covered = np.zeros(total, dtype=bool)
    three = np.zeros(total, dtype=bool)
    if total:
        long = np.flatnonzero(repeat >= min_repeat)
        covered = _per_doc_unions(long, repeat[long], total)
        found = np.flatnonzero(repeat >= 3)
        three = _per_doc_unions(found, np.full(len(found), 3), total)

    def words_of(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask)])
        return c[doc_start + n_words] - c[doc_start]

    longest = np.maximum.reduceat(repeat, doc_start) if n_docs else np.zeros(0, dtype=np.int64)
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": n_symbols,
        "n_lines": n_lines,
        "n_dup_lines": n_dup,
        "n_repeat_words": words_of(three),
        "n_covered_words": words_of(covered),
        "longest_repeat": longest,
    }


def verdicts(m: dict[str, np.ndarray], max_covered: int, max_longest: int, max_symbols: int, max_dup_lines: int) -> tuple[np.ndarray, np.ndarray]:
    """``base_failed`` and ``kept`` for each text."""
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    good = (100 * m["n_covered_words"] <= max_covered * m["n_words"]) & (100 * m["longest_repeat"] <= max_longest * m["n_words"])
    good &= (100 * m["n_symbols"] <= max_symbols * m["word_chars"]) & (100 * m["n_dup_lines"] <= max_dup_lines * m["n_lines"])
    return failed, ~failed & good


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat")


def quality(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    min_repeat: int = MIN_REPEAT,
    max_covered: int = MAX_COVERED,
    max_longest: int = MAX_LONGEST,
    max_symbols: int = MAX_SYMBOLS,
    max_dup_lines: int = MAX_DUP_LINES,
) -> DataFrame:
    """Figures and verdict of every whole text, in no shuffle: ``doc_id``, the counts of ``COUNTS`` (long),
    ``base_failed`` and ``kept`` (boolean).

    ``kept`` is false if ``base_failed``, or if repeats of at least ``min_repeat`` words cover more than
    ``max_covered`` percent of the words, one repeat takes more than ``max_longest`` percent, symbols exceed
    ``max_symbols`` percent of the characters in words, or repeated lines ``max_dup_lines`` percent of the lines.
    A null or empty text has no words and fails. One row for each input row; repeated rows and null ids pass as
    they are; other columns are left out, whatever their names. Memory is bounded by the flush size and the
    longest single text.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("quality")
        for whole in batches:
            for batch in slices(whole, "__text", 2 << 20):
                m = measure(values(batch.column(1)), min_repeat)
                failed, kept = verdicts(m, max_covered, max_longest, max_symbols, max_dup_lines)
                columns = [batch.column(0), *(pa.array(m[c]) for c in COUNTS), pa.array(failed), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *COUNTS, "base_failed", "kept"])

    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean"
    return docs.select(F.col(doc_id).alias("__id"), text_bytes(docs, text).alias("__text")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, *, text: str = "text", **limits: int) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with all their columns as they are."""
    limit = {"max_covered": MAX_COVERED, "max_longest": MAX_LONGEST, "max_symbols": MAX_SYMBOLS, "max_dup_lines": MAX_DUP_LINES}
    min_repeat = limits.pop("min_repeat", MIN_REPEAT)
    limit |= limits
    columns = [F.col(f"`{c}`") for c in docs.columns]
    names = [f"c{k}" for k in range(len(columns))]
    packed = docs.select(*(c.alias(n) for c, n in zip(columns, names, strict=True)), text_bytes(docs, text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("quality")
        for whole in batches:
            for batch in slices(whole, "__text", 2 << 20):
                _, kept = verdicts(measure(values(batch.column(batch.num_columns - 1)), min_repeat), **limit)
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=names).filter(pa.array(kept))

    schema = packed.drop("__text").schema
    return packed.mapInArrow(run, schema).toDF(*docs.columns)
