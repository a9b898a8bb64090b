"""Token counts by unigram scores, with dynamic programming shared along a trie of distinct pre-tokens.

The best segmentation of a prefix depends on the prefix only. So the distinct pre-tokens (words) of a batch are
taken in the order of a trie's depth-first walk: what two neighbours share is on the stack already and is not
computed again, each further byte adds one entry (best score, number of pieces), and the entry at a word's end
is its terminal count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.text import kept_by, slices, text_bytes, values
from quarry.llm.unigram import vocabulary

#: Terminal counts that a worker keeps from one batch to the next.
KEPT = 300_000


class TrieCounter:
    """Terminal counts of words: best unigram score and number of pieces, most score first, then fewest pieces."""

    def __init__(self, pieces: list[bytes], log_p: list[float]):
        self.ends: dict = {}  # a trie over reversed pieces: which pieces end here?
        for piece, p in zip(pieces, log_p, strict=True):
            node = self.ends
            for b in reversed(piece):
                node = node.setdefault(b, {})
            node[-1] = max(p, node.get(-1, -np.inf))
        self.known: dict[bytes, tuple[float, int]] = {}
        self.steps = 0

    def count(self, words: set[bytes]) -> dict[bytes, tuple[float, int]]:
        """The terminal (score, pieces) of each word."""
        if len(self.known) > KEPT:
            self.known = {}
        known, ends = self.known, self.ends
        stack: list[tuple[float, int]] = [(0.0, 0)]
        last = b""
        for word in sorted(w for w in words if w not in known):
            s = b" " + word
            shared, most = 0, min(len(s), len(last))
            while shared < most and s[shared] == last[shared]:
                shared += 1
            del stack[shared + 1 :]
            for j in range(shared, len(s)):
                node, best, pieces = ends, -np.inf, 0
                for i in range(j, -1, -1):
                    node = node.get(s[i])
                    if node is None:
                        break
                    p = node.get(-1)
                    if p is not None:
                        x, n = stack[i]
                        x, n = x + p, n + 1
                        if x > best or x == best and n < pieces:
                            best, pieces = x, n
                stack.append((best, pieces))
                self.steps += 1
            last = s
            known[word] = stack[-1]
        return known


def token_counts(docs: DataFrame, model_path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_pretokens long, n_tokens long, best_score double`` of every whole text, in no shuffle.

    Pre-tokens are words ``[^\\x20\\x09-\\x0D]+``; each counts as many tokens as its best segmentation into the
    vocabulary's pieces has (natural log scores; ties go to fewer pieces; bytes in no piece are fallback
    pieces). A null or empty text has none. One row for each input row, repeated rows and null ids included;
    other columns are left out, whatever their names. The vocabulary (a fixed size) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(model_path))
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("token counts")
        counter = TrieCounter(*shared.value)
        for whole in batches:
            for batch in slices(whole, "__text"):
                words = [t.split() for t in values(batch.column(1))]
                counts = counter.count({w for ws in words for w in ws})
                found = [[counts[w] for w in ws] for ws in words]
                columns = [batch.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array([sum(n for _, n in f) for f in found], pa.int64()), pa.array([float(sum(x for x, _ in f)) for f in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_pretokens", "n_tokens", "best_score"])

    return docs.select(F.col(doc_id).alias("__id"), text_bytes(docs, text).alias("__text")).mapInArrow(run, f"doc_id {kind}, n_pretokens long, n_tokens long, best_score double")
