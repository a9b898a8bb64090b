"""Byte-level word and line helpers shared by the text operators.

Texts travel to Python workers as UTF-8 bytes: ASCII lower-casing is one ``bytes.translate`` and
splitting at ``[\\x20\\x09-\\x0D]`` is ``bytes.split()``, both far cheaper than working on ``str``.
"""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII lower-casing for ``bytes.translate``.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: Lower-cases and turns every ASCII byte but ``0-9a-z`` into a space.
ALNUM_LOWER = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)

#: Input bytes a worker gathers before it hands a record batch back.
FLUSH_BYTES = 8 << 20


_KEPT: dict[str, list] = {}


def kept_by(operator: str, *caches) -> None:
    """Called where a task of ``operator`` starts: a worker process keeps tables of one operator at a time.

    Workers are reused from task to task and what they keep between tasks is worth a lot to the next task of the
    same operator, but only costs memory under another's. ``caches`` (with a ``clear``) join those kept for it.
    """
    others = [o for o in _KEPT if o != operator]
    for other in others:
        for cache in _KEPT.pop(other):
            cache.clear()
    if others:
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim is not None:
            trim(0)
    pa.default_memory_pool().release_unused()
    held = _KEPT.setdefault(operator, [])
    held.extend(c for c in caches if all(c is not h for h in held))


def text_bytes(docs: DataFrame, text: str = "text") -> Column:
    """The text column as UTF-8 bytes; null counts as empty."""
    return F.coalesce(docs[text], F.lit("")).cast("binary")


def values(column: pa.Array) -> list:
    """An Arrow column as Python objects (bytes for binary)."""
    return column.to_pylist()


def slices(batch: pa.RecordBatch, name: str, limit: int = FLUSH_BYTES):
    """Cuts a record batch so that column ``name`` holds about ``limit`` bytes in each piece.

    A row longer than the limit is a piece of its own; no row is dropped.
    """
    column = batch.column(batch.schema.get_field_index(name))
    if batch.num_rows <= 1 or column.nbytes <= limit:
        yield batch
        return
    sizes = np.diff(np.frombuffer(column.buffers()[1], dtype=np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64))
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser over an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of words, kept for repeated words in a table of bounded size."""

    def __init__(self, limit: int = 300_000):
        self.limit = limit
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.limit:
            self.known.clear()
        get, hashed = self.known.get, self._hashed
        return np.fromiter((get(w) or hashed(w) for w in words), dtype=np.uint64, count=len(words))

    def _hashed(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self.known[word] = h
        return h


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive words; the whole run when there are fewer, none for no words."""
    if len(h) == 0:
        return h
    size = min(size, len(h))
    n = len(h) - size + 1
    out = np.full(n, np.uint64(0x9E3779B97F4A7C15) + np.uint64(size), dtype=np.uint64)
    for k in range(size):
        out = mix64(out * np.uint64(0xC2B2AE3D27D4EB4F) + h[k : k + n])
    return out
