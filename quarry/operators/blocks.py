"""Block framing: reading, scanning, indexing and writing whole blocks.

    block  := [info if revision > 0] varint columns, varint rows, column*
    info   := (varint 1, u8) (varint 2, i32) [(varint 3, varint n, i32*n) from revision 54480] varint 0
    column := string name, type, [u8 0 from revision 54454], prefix, body
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa

from quarry.errors import InvalidBlockInfo, InvalidData, NeedMore, ResourceLimit, SchemaMismatch, UnsupportedRevision, UnsupportedSerialization
from quarry.functions import type_binary
from quarry.functions.arrow_types import arrow_schema, arrow_type
from quarry.functions.types import T, delegate, fixed_width, parse, render
from quarry.functions.wire import Reader, string, varint
from quarry.operators import states
from quarry.operators.columns import Options, read_body, read_prefix, skip_body, write_column

#: The newest revision, and the revisions that added a marker byte and the bucket field.
NEWEST, MARKER_REVISION, BUCKETS_REVISION = 54485, 54454, 54480


@dataclass(frozen=True)
class BlockEntry:
    """One block of a stream: where it lies and what it declares."""

    offset: int
    length: int
    rows: int
    columns: int


@dataclass
class Progress:
    """How far a scan of one block got before the input ended: whole columns, and strings within the next one."""

    pos: int = 0
    shape: tuple[int, int] | None = None
    fields: list = field(default_factory=list)
    marks: dict = field(default_factory=dict)
    #: The length that the input must have before another try gets any further.
    needs: int = 0

    def shift(self, n: int) -> None:
        """The input's first ``n`` bytes, all before this block, were taken off."""
        if self.shape is not None:
            self.pos -= n
        self.marks = {at - n: (done, pos - n) for at, (done, pos) in self.marks.items()}
        self.needs = max(0, self.needs - n)


def check_revision(revision: int) -> None:
    if not 0 <= revision <= NEWEST:
        raise UnsupportedRevision(f"revision {revision} is not in 0..{NEWEST}")


def _read_info(r: Reader, revision: int) -> None:
    seen = set()
    while (number := r.varint()) != 0:
        if number in seen:
            raise InvalidBlockInfo(f"field {number} stands twice")
        seen.add(number)
        if number == 1:
            r.skip(1)
        elif number == 2:
            r.skip(4)
        elif number == 3 and revision >= BUCKETS_REVISION:
            n = r.varint()
            if 4 * n > r.remaining:
                raise NeedMore("bucket numbers are cut short", r.pos + 4 * n)
            r.skip(4 * n)
        else:
            raise InvalidBlockInfo(f"unknown field {number}")


def _info(revision: int) -> bytes:
    return b"" if revision == 0 else bytes([1, 0, 2, 255, 255, 255, 255]) + (bytes([3, 0]) if revision >= BUCKETS_REVISION else b"") + b"\0"


def _column_header(r: Reader, o: Options) -> tuple[str, T]:
    name = r.string().decode()
    t = type_binary.read(r) if o.binary_types else parse(r.string().decode())
    if o.revision >= MARKER_REVISION and r.u8() != 0:
        raise UnsupportedSerialization(f"column {name} has a serialization of its own")
    _check_states(t)
    return name, t


def _check_states(t: T) -> None:
    """Rejects states without framing even where there are no rows."""
    if t.kind == "AggregateFunction":
        states.codec(t)
    for a in t.args:
        if isinstance(a, T):
            _check_states(a)
        elif isinstance(a, tuple) and len(a) == 2 and isinstance(a[1], T):
            _check_states(a[1])


def _least_row(t: T) -> int:
    """The fewest bytes that a row of ``t`` takes."""
    t = delegate(t)
    if t.kind == "Array" or t.kind == "Map":
        return 8
    return fixed_width(t) or (0 if t.kind == "JSON" else 1)


def _walk(r: Reader, o: Options, visit, progress: Progress | None = None) -> tuple[int, int, list[tuple[str, T]]]:
    """One block: calls ``visit(name, type, rows, reader, state)`` at each column's body.

    With ``progress``, which keeps what is known of the columns passed, goes on behind the last of them.
    """
    progress = progress or Progress()
    if progress.shape is None:
        check_revision(o.revision)
        if o.revision:
            _read_info(r, o.revision)
        columns, rows = r.varint(), r.varint()
        if columns == 0 and rows:
            raise InvalidData("a block of no columns has rows")
        if 2 * columns > r.remaining:
            raise NeedMore("column headers are cut short", r.pos + 2 * columns)
        progress.shape, progress.pos = (columns, rows), r.pos
    (columns, rows), r.pos, fields = progress.shape, progress.pos, progress.fields
    while len(fields) < columns:
        name, t = _column_header(r, o)
        if rows * _least_row(t) > r.remaining:
            if rows > 1 << 40:
                raise ResourceLimit(f"a block claims {rows} rows")
            raise NeedMore(f"column {name} is cut short", r.pos + rows * _least_row(t))
        if rows:
            state = read_prefix(t, r, o)
            visit(name, t, rows, r, state)
        else:
            visit(name, t, 0, r, None)
        fields.append((name, t))
        progress.pos = r.pos
        if r.marks:
            r.marks.clear()
    return columns, rows, fields


def read_block(r: Reader, o: Options, columns: set[str] | None = None) -> tuple[pa.RecordBatch, list[tuple[str, T]]] | None:
    """The next block as a batch, or None at the clean end of the input; unwanted columns are skipped unread."""
    if r.remaining == 0:
        return None
    arrays: list[tuple[str, T, pa.Array]] = []

    def visit(name, t, rows, r, state):
        if columns is not None and name not in columns:
            if rows:
                skip_body(t, rows, r, state, o)
        else:
            a = read_body(t, rows, r, state, o) if rows else pa.array([], arrow_type(t, o.strings))
            arrays.append((name, t, a))

    _, _, fields = _walk(r, o, visit)
    schema = arrow_schema([(n, t) for n, t, _ in arrays], o.strings)
    return pa.RecordBatch.from_arrays([a for _, _, a in arrays], schema=schema), fields


def read_blocks(data: bytes, o: Options, columns: set[str] | None = None) -> Iterator[pa.RecordBatch]:
    """All blocks with rows; later blocks must have the first one's schema."""
    r, first = Reader(data), None
    while (found := read_block(r, o, columns)) is not None:
        batch, fields = found
        if first is None:
            first = fields
        elif fields != first:
            raise SchemaMismatch(f"a block has {[(n, str(t)) for n, t in fields]} after {[(n, str(t)) for n, t in first]}")
        if batch.num_rows:
            yield batch
    if first is None:
        raise InvalidData("no blocks in the input")


def read_schema(data: bytes, o: Options) -> list[tuple[str, T]]:
    """The fields of the first block; its values are skipped."""
    r = Reader(data)
    if not r.remaining:
        raise InvalidData("no blocks in the input")
    return _walk(r, o, lambda name, t, rows, r, s: skip_body(t, rows, r, s, o) if rows else None)[2]


def read_first_schema(chunks: Iterable[bytes], o: Options) -> list[tuple[str, T]]:
    """The fields of the first block of a stream in pieces; no more is read than it needs."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        try:
            return read_schema(bytes(held), o)
        except NeedMore:
            continue
    return read_schema(bytes(held), o)


def block_end(data: bytes, o: Options, start: int = 0, progress: Progress | None = None) -> BlockEntry | None:
    """Where the block at ``start`` ends, by skipping only; None if the input ends at or within it.

    With ``progress``, which belongs to this block, a later try with more of the input goes on where this one ended.
    """
    if start >= len(data):
        return None
    known = Progress() if progress is None else progress
    r = Reader(data, start, known.marks if progress is not None else None)
    try:
        columns, rows, _ = _walk(r, o, lambda name, t, rows, r, s: skip_body(t, rows, r, s, o) if rows else None, known)
    except NeedMore as e:
        known.needs = max(e.at, len(data) + 1)
        return None
    return BlockEntry(start, r.pos - start, rows, columns)


def block_index(data: bytes, o: Options) -> list[BlockEntry]:
    """All blocks of a complete stream; a cut-off tail raises ``NeedMore``."""
    out, at = [], 0
    while at < len(data):
        entry = block_end(data, o, at)
        if entry is None:
            raise NeedMore(f"the block at {at} is cut short")
        out.append(entry)
        at += entry.length
    return out


def write_block(batch: pa.RecordBatch, fields: list[tuple[str, T]], o: Options) -> bytes:
    """One block of a batch whose columns are the fields' in order; nothing is returned unless all of it fits."""
    check_revision(o.revision)
    out = [_info(o.revision), varint(len(fields)), varint(batch.num_rows)]
    for (name, t), a in zip(fields, batch.columns, strict=True):
        out.append(string(name))
        out.append(type_binary.write(t) if o.binary_types else string(_header_name(t, o)))
        if o.revision >= MARKER_REVISION:
            out.append(b"\0")
        a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
        out.append(write_column(t, a, o))
    return b"".join(out)


def _header_name(t: T, o: Options) -> str:
    """The name in a text header; revision 0 has no time zones."""
    if o.revision == 0 and t.kind in ("DateTime", "DateTime64"):
        return render(T(t.kind, (*t.args[:-1], None)))
    return str(t)
