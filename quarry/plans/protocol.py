"""Packets at revision 54460, without any input or output of its own.

``Connection`` takes the server's bytes in any pieces and gives events; what it has to send is taken from
``take_output``.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from enum import Enum

from quarry.errors import BlockError, CompressionError, NeedMore, ProtocolError
from quarry.functions.wire import Reader, string, u64, varint
from quarry.operators.blocks import block_end, Progress
from quarry.operators.columns import Options
from quarry.operators.compression import CHECKSUM, HEADER, compress_frame, compress_frames, decompress_frame, frame_header

REVISION = 54460
#: Packet codes of a server and of a client.
HELLO, DATA, EXCEPTION, PROGRESS, PONG, END_OF_STREAM, PROFILE_INFO, TOTALS, EXTREMES, LOG, TABLE_COLUMNS, PROFILE_EVENTS = 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 14
CLIENT_HELLO, CLIENT_QUERY, CLIENT_DATA, CLIENT_PING = 0, 1, 2, 4
#: Revisions from which a field is sent.
TIMEZONE, DISPLAY_NAME, PATCH, QUOTA_KEY = 54058, 54372, 54401, 54458
#: Exceptions after which a connection can't be used again.
TERMINAL = (99, 101, 702, 720, 749)
EMPTY_BLOCK = bytes([1, 0, 2, 255, 255, 255, 255, 0, 0, 0])
#: Limits on what a server may declare.
MAX_HELLO, MAX_EXCEPTION, MAX_TABLE_NAME, MAX_INSERT_FRAME = 64 << 10, 64 << 20, 4 << 10, 1 << 20


class State(Enum):
    HANDSHAKING = "handshaking"
    READY = "ready"
    QUERYING = "querying"
    AWAITING_INSERT_SCHEMA = "awaiting_insert_schema"
    INSERTING = "inserting"
    FINISHING_INSERT = "finishing_insert"
    AWAITING_PONG = "awaiting_pong"
    FAILED = "failed"
    CLOSED = "closed"


@dataclass
class Event:
    """One thing a server said: ``kind``, its numbers and texts, and the bytes of its block."""

    kind: str
    fields: dict = field(default_factory=dict)
    block: bytes = b""


@dataclass
class ClientHello:
    name: str = "quarry"
    major: int = 1
    minor: int = 0
    database: str = "default"
    user: str = "default"
    password: str = ""
    quota_key: str = ""

    def encode(self) -> bytes:
        numbers = varint(CLIENT_HELLO) + string(self.name) + varint(self.major) + varint(self.minor) + varint(REVISION)
        return numbers + string(self.database) + string(self.user) + string(self.password)


def quoted_parameter(value: str) -> str:
    """A parameter's value within single quotes, with backslash escapes."""
    table = {"\\": "\\\\", "'": "\\'", "\0": "\\0", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
    return "'" + "".join(table.get(c, c) for c in value) + "'"


@dataclass
class Query:
    sql: str
    query_id: str = ""
    initial_address: str = "0.0.0.0:0"
    start_us: int = 0
    os_user: str = ""
    hostname: str = ""
    settings: dict = field(default_factory=dict)
    parameters: dict = field(default_factory=dict)

    def encode(self, hello: ClientHello, compressed: bool) -> bytes:
        """The Query packet, without the empty Data packet that follows it."""
        out = [varint(CLIENT_QUERY), string(self.query_id), b"\x01", string(hello.user), string(self.query_id), string(self.initial_address), u64(self.start_us)]
        out += [b"\x01", string(self.os_user), string(self.hostname), string(hello.name), varint(hello.major), varint(hello.minor), varint(REVISION)]
        out += [string(hello.quota_key), varint(0), varint(0), b"\0", varint(0), varint(0), varint(0)]
        out += [string(k) + varint(1) + string(str(v)) for k, v in self.settings.items()]
        out += [string(""), string(""), varint(2), varint(int(compressed)), string(self.sql)]
        out += [string(k) + varint(2) + string(quoted_parameter(str(v))) for k, v in self.parameters.items()]
        return b"".join([*out, string("")])


def data_packet(block: bytes, compressed: bool) -> bytes:
    """A client's Data packet with one block, in frames of at most 1 MiB if compressed."""
    return varint(CLIENT_DATA) + string("") + (compress_frames(block, "lz4", MAX_INSERT_FRAME) if compressed else block)


class Connection:
    """One exchange with a server, as a state machine."""

    def __init__(self, hello: ClientHello | None = None, *, compressed: bool = False, max_block_bytes: int = 1 << 30):
        if max_block_bytes < 1 << 10:
            raise ProtocolError("blocks of less than 1 KiB can't be allowed")
        self.hello, self.compressed, self.max_block_bytes = hello or ClientHello(), compressed, max_block_bytes
        self.state, self.revision = State.HANDSHAKING, REVISION
        self._in, self._out, self._events = bytearray(), bytearray(self.hello.encode()), []
        self._answered, self._sent_settings = True, False
        # Of a packet that is not complete: the length its input must have, how far its block was scanned, and of
        # a framed block the bytes passed and what they hold.
        self._needs, self._progress, self._frames = 0, Progress(), (0, bytearray())

    # ---- calls

    def take_output(self) -> bytes:
        """Bytes to send."""
        out = bytes(self._out)
        self._out.clear()
        return out

    def poll_event(self) -> Event | None:
        return self._events.pop(0) if self._events else None

    def _need(self, *states: State) -> None:
        if self.state not in states:
            raise ProtocolError(f"not allowed while {self.state.value}")

    def query(self, query: Query) -> None:
        self._start(query, State.QUERYING)

    def insert(self, query: Query) -> None:
        self._start(query, State.AWAITING_INSERT_SCHEMA)

    def _start(self, query: Query, state: State) -> None:
        self._need(State.READY)
        self._out += query.encode(self.hello, self.compressed) + data_packet(EMPTY_BLOCK, self.compressed)
        self.state, self._answered, self._sent_settings = state, False, bool(query.settings)

    def insert_data(self, block: bytes) -> None:
        """Queues one whole block with columns."""
        self._need(State.INSERTING)
        if len(block) > self.max_block_bytes:
            raise ProtocolError("the block is too large")
        entry = block_end(block, Options(revision=REVISION))
        if entry is None or entry.length != len(block) or entry.columns == 0:
            raise ProtocolError("not exactly one block with columns")
        self._out += data_packet(block, self.compressed)

    def finish_insert(self) -> None:
        self._need(State.INSERTING)
        self._out += data_packet(EMPTY_BLOCK, self.compressed)
        self.state = State.FINISHING_INSERT

    def ping(self) -> None:
        self._need(State.READY)
        self._out += varint(CLIENT_PING)
        self.state = State.AWAITING_PONG

    def feed(self, data: bytes) -> None:
        """Takes bytes from the server; incomplete packets wait for more."""
        self._need(*(s for s in State if s not in (State.FAILED, State.CLOSED)))
        self._in += data
        if len(self._in) < self._needs:
            return
        r = Reader(bytes(self._in))
        done = self._needs = 0
        try:
            while r.remaining:
                self._packet(r)
                done = r.pos
        except NeedMore as e:
            self._needs = max(e.at, r.end + 1) - done
            self._progress.shift(0 if self._frames[1] else done)
        except (BlockError, UnicodeDecodeError) as e:
            self.state = State.FAILED
            raise e if isinstance(e, ProtocolError) else ProtocolError(str(e)) from e
        del self._in[:done]

    def finish(self) -> None:
        """The server closed the connection: fine between queries, an error within one."""
        if self._in or self.state not in (State.READY, State.CLOSED, State.FAILED):
            self.state = State.FAILED
            raise ProtocolError("the connection ends within an exchange")
        self.state = State.CLOSED

    # ---- packets

    def _emit(self, kind: str, block: bytes = b"", **fields) -> None:
        self._events.append(Event(kind, fields, block))

    def _text(self, r: Reader, limit: int) -> str:
        n = r.varint()
        if n > limit:
            raise ProtocolError(f"a text of {n} bytes")
        return r.take(n).decode()

    def _packet(self, r: Reader) -> None:
        code = r.varint()
        if self.state == State.HANDSHAKING:
            if code == HELLO:
                self._server_hello(r)
            elif code == EXCEPTION:
                self._exception(r)
            else:
                raise ProtocolError(f"packet {code} before the handshake")
            return
        if code == PONG:
            if self.state != State.AWAITING_PONG:
                raise ProtocolError("a pong that nobody asked for")
            self.state = State.READY
            self._emit("pong")
            return
        if self.state in (State.READY, State.AWAITING_PONG):
            raise ProtocolError(f"packet {code} outside a query")
        if code == EXCEPTION:
            self._exception(r)
        elif code in (DATA, TOTALS, EXTREMES, LOG, PROFILE_EVENTS):
            self._block(r, code)
        elif code == PROGRESS:
            names = ("read_rows", "read_bytes", "total_rows", "written_rows", "written_bytes", "elapsed_ns")
            self._emit("progress", **{n: r.varint() for n in names})
        elif code == PROFILE_INFO:
            rows, blocks, size, applied, before, _ = r.varint(), r.varint(), r.varint(), r.u8(), r.varint(), r.u8()
            self._emit("profile_info", rows=rows, blocks=blocks, bytes=size, applied_limit=bool(applied), rows_before_limit=before)
        elif code == TABLE_COLUMNS:
            self._emit("table_columns", table=self._text(r, MAX_TABLE_NAME), description=self._text(r, MAX_EXCEPTION))
        elif code == END_OF_STREAM:
            if self.state not in (State.QUERYING, State.FINISHING_INSERT):
                raise ProtocolError(f"the stream ends while {self.state.value}")
            self.state = State.READY
            self._emit("end_of_stream")
        else:
            raise ProtocolError(f"unknown packet {code}")
        self._answered = True

    def _server_hello(self, r: Reader) -> None:
        name, major, minor, revision = self._text(r, MAX_HELLO), r.varint(), r.varint(), r.varint()
        zone = self._text(r, MAX_TABLE_NAME) if revision >= TIMEZONE else ""
        shown = self._text(r, MAX_TABLE_NAME) if revision >= DISPLAY_NAME else ""
        patch = r.varint() if revision >= PATCH else 0
        self.revision = min(REVISION, revision)
        if self.revision >= QUOTA_KEY:
            self._out += string(self.hello.quota_key)
        self.state = State.READY
        self._emit("hello", name=name, major=major, minor=minor, revision=revision, timezone=zone, display_name=shown, patch=patch)

    def _exception(self, r: Reader) -> None:
        code = r.i32()
        name, message, stack = (self._text(r, MAX_EXCEPTION) for _ in range(3))
        if r.u8():
            raise ProtocolError("nested exceptions are not sent at this revision")
        # The server reads settings before anything else of a query: what fails there ends the connection, and the
        # packet does not tell it from other errors. After an earlier answer, the settings were read.
        fatal = self.state == State.HANDSHAKING or code in TERMINAL or self._sent_settings and not self._answered
        self.state = State.FAILED if fatal else State.READY
        self._emit("exception", code=code, name=name, message=message, stack=stack)

    def _block(self, r: Reader, code: int) -> None:
        self._text(r, MAX_TABLE_NAME)
        framed = self.compressed and code in (DATA, TOTALS, EXTREMES)
        block = self._framed_block(r) if framed else self._plain_block(r)
        entry = block_end(block, Options(revision=self.revision))
        kind = {DATA: "data", TOTALS: "totals", EXTREMES: "extremes", LOG: "log", PROFILE_EVENTS: "profile_events"}[code]
        if code == DATA and self.state == State.AWAITING_INSERT_SCHEMA:
            self.state, kind = State.INSERTING, "insert_schema"
        elif code == DATA and entry.columns == 0 and entry.rows == 0:
            return
        self._emit(kind, block, rows=entry.rows, columns=entry.columns)

    def _plain_block(self, r: Reader) -> bytes:
        entry = block_end(r.buf, Options(revision=self.revision), r.pos, self._progress)
        if entry is None:
            if r.remaining > self.max_block_bytes:
                raise ProtocolError("a block is too large")
            raise NeedMore("a block is cut short", self._progress.needs)
        self._progress = Progress()
        return r.take(entry.length)

    def _framed_block(self, r: Reader) -> bytes:
        passed, plain = self._frames
        r.skip(passed)
        while True:
            if r.remaining < CHECKSUM + HEADER:
                raise NeedMore("a frame is cut short", r.pos + CHECKSUM + HEADER)
            f = frame_header(r.buf, r.pos)
            if len(plain) + f.plain > self.max_block_bytes:
                raise ProtocolError("a block is too large")
            if f.length > r.remaining:
                raise NeedMore("a frame is cut short", r.pos + f.length)
            plain += decompress_frame(r.buf, r.pos)[0]
            r.skip(f.length)
            passed += f.length
            self._frames = (passed, plain)
            if len(plain) < self._progress.needs:
                continue
            entry = block_end(bytes(plain), Options(revision=self.revision), 0, self._progress)
            if entry is not None:
                self._progress, self._frames = Progress(), (0, bytearray())
                if entry.length != len(plain):
                    raise CompressionError("a frame reaches beyond its block")
                return bytes(plain)


# ---- what a server sends, for replays and tests


def server_hello(name: str = "server", major: int = 25, minor: int = 1, revision: int = REVISION, timezone: str = "UTC", display_name: str = "server", patch: int = 0) -> bytes:
    out = varint(HELLO) + string(name) + varint(major) + varint(minor) + varint(revision)
    out += string(timezone) if revision >= TIMEZONE else b""
    out += string(display_name) if revision >= DISPLAY_NAME else b""
    return out + (varint(patch) if revision >= PATCH else b"")


def server_block(code: int, block: bytes, compressed: bool = False, table: str = "") -> bytes:
    return varint(code) + string(table) + (compress_frame(block) if compressed else block)


def server_progress(*numbers: int) -> bytes:
    return varint(PROGRESS) + b"".join(varint(n) for n in numbers)


def server_profile_info(rows: int, blocks: int, size: int, applied_limit: bool, rows_before_limit: int) -> bytes:
    return varint(PROFILE_INFO) + varint(rows) + varint(blocks) + varint(size) + bytes([applied_limit]) + varint(rows_before_limit) + b"\0"


def server_exception(code: int, name: str, message: str, stack: str = "") -> bytes:
    return varint(EXCEPTION) + struct.pack("<i", code) + string(name) + string(message) + string(stack) + b"\0"
