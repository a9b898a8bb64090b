"""Checksummed compression frames.

    frame := 16 checksum bytes, u8 method, u32 size (of what follows the checksum), u32 plain size, payload

The checksum is CityHash128 (version 1.0.2) of everything behind it, low half first.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import pyarrow as pa

from quarry.errors import CompressionError
from quarry.operators.cityhash import city_hash128

#: Method bytes, header sizes and limits.
METHODS = {0x02: "none", 0x82: "lz4", 0x90: "zstd"}
BYTES = {v: k for k, v in METHODS.items()}
CHECKSUM, HEADER = 16, 9
MAX_SIZE = 1 << 30
FRAME_LIMIT = 1 << 20


@dataclass(frozen=True)
class Frame:
    """A frame's header: its method, whole length with checksum, and plain length."""

    checksum: bytes
    method: str
    length: int
    plain: int


def frame_header(data: bytes, at: int = 0) -> Frame:
    """The header of the frame at ``at``; implausible sizes raise before anything is allocated."""
    if len(data) - at < CHECKSUM + HEADER:
        raise CompressionError("a frame's header is cut short")
    method, size, plain = struct.unpack_from("<BII", data, at + CHECKSUM)
    if method not in METHODS:
        raise CompressionError(f"unknown compression method {method:#x}")
    if not HEADER <= size <= MAX_SIZE:
        raise CompressionError(f"a frame of {size} bytes")
    if not 0 < plain <= MAX_SIZE:
        raise CompressionError(f"a frame of {plain} plain bytes")
    payload = size - HEADER
    name = METHODS[method]
    if plain > {"none": payload, "lz4": 255 * payload + 24, "zstd": 32768 * payload}[name]:
        raise CompressionError(f"{payload} bytes can't hold {plain}")
    return Frame(data[at : at + CHECKSUM], name, CHECKSUM + size, plain)


def decompress_frame(data: bytes, at: int = 0, *, verify: bool = True) -> tuple[bytes, int]:
    """A frame's plain bytes, and the place behind it."""
    f = frame_header(data, at)
    end = at + f.length
    if end > len(data):
        raise CompressionError("a frame is cut short")
    if verify and checksum(data[at + CHECKSUM : end]) != f.checksum:
        raise CompressionError("a frame's checksum does not match")
    payload = data[at + CHECKSUM + HEADER : end]
    if f.method == "none":
        plain = payload
    else:
        try:
            plain = pa.decompress(payload, decompressed_size=f.plain, codec="lz4_raw" if f.method == "lz4" else "zstd", asbytes=True)
        except (OSError, pa.ArrowInvalid, ValueError) as e:
            raise CompressionError(f"a malformed {f.method} frame") from e
    if len(plain) != f.plain:
        raise CompressionError(f"a frame claims {f.plain} bytes and holds {len(plain)}")
    return plain, end


def decompress_stream(data: bytes, *, verify: bool = True) -> bytes:
    """The plain bytes of all frames in a row."""
    out, at = [], 0
    while at < len(data):
        plain, at = decompress_frame(data, at, verify=verify)
        out.append(plain)
    return b"".join(out)


def compress_frame(plain: bytes, method: str = "lz4") -> bytes:
    """One frame."""
    if not 0 < len(plain) <= MAX_SIZE:
        raise CompressionError(f"{len(plain)} bytes don't fit a frame")
    payload = plain if method == "none" else pa.compress(plain, codec="lz4_raw" if method == "lz4" else "zstd", asbytes=True)
    body = struct.pack("<BII", BYTES[method], len(payload) + HEADER, len(plain)) + payload
    return checksum(body) + body


def compress_frames(plain: bytes, method: str = "lz4", limit: int = FRAME_LIMIT) -> bytes:
    """Frames of at most ``limit`` plain bytes each."""
    if not 1 <= limit <= MAX_SIZE:
        raise CompressionError(f"a frame limit of {limit}")
    return b"".join(compress_frame(plain[i : i + limit], method) for i in range(0, len(plain), limit))


def checksum(body: bytes) -> bytes:
    low, high = city_hash128(body)
    return struct.pack("<QQ", low, high)
