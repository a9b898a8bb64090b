"""CityHash128, version 1.0.2, after its published description."""

from __future__ import annotations

import struct

_M = (1 << 64) - 1
#: The hash's multipliers.
K0, K1, K2, K3 = 0xC3A5C85C97CB3127, 0xB492B66FBE98F273, 0x9AE16A3B2F90404F, 0xC949D7C7509E6557
_MUL = 0x9DDFEA08EB382D69


def _rot(x: int, n: int) -> int:
    return (x >> n | x << (64 - n)) & _M if n else x


def _shift_mix(x: int) -> int:
    return x ^ x >> 47


def _u64(s: bytes, i: int) -> int:
    return int.from_bytes(s[i : i + 8], "little")


def _u32(s: bytes, i: int) -> int:
    return int.from_bytes(s[i : i + 4], "little")


def _hash16(u: int, v: int) -> int:
    a = _shift_mix((u ^ v) * _MUL & _M)
    b = _shift_mix((v ^ a) * _MUL & _M)
    return b * _MUL & _M


def _hash_short(s: bytes) -> int:
    """Up to 16 bytes."""
    n = len(s)
    if n > 8:
        a, b = _u64(s, 0), _u64(s, n - 8)
        return _hash16(a, _rot((b + n) & _M, n)) ^ b
    if n >= 4:
        return _hash16((n + (_u32(s, 0) << 3)) & _M, _u32(s, n - 4))
    if n:
        y, z = s[0] + (s[n >> 1] << 8), n + (s[n - 1] << 2)
        return _shift_mix((y * K2 ^ z * K3) & _M) * K2 & _M
    return K2


def _weak32(s: bytes, i: int, a: int, b: int) -> tuple[int, int]:
    w, x, y, z = struct.unpack_from("<4Q", s, i)
    a = (a + w) & _M
    b = _rot((b + a + z) & _M, 21)
    c = a
    a = (a + x + y) & _M
    b = (b + _rot(a, 44)) & _M
    return (a + z) & _M, (b + c) & _M


def _murmur(s: bytes, seed: tuple[int, int]) -> tuple[int, int]:
    a, b = seed
    n = len(s)
    left = n - 16
    if left <= 0:
        a = _shift_mix(a * K1 & _M) * K1 & _M
        c = (b * K1 + _hash_short(s)) & _M
        d = _shift_mix((a + (_u64(s, 0) if n >= 8 else c)) & _M)
    else:
        c = _hash16((_u64(s, n - 8) + K1) & _M, a)
        d = _hash16((b + n) & _M, (c + _u64(s, n - 16)) & _M)
        a = (a + d) & _M
        i = 0
        while left > 0:
            a = (a ^ _shift_mix(_u64(s, i) * K1 & _M) * K1 & _M) * K1 & _M
            b ^= a
            c = (c ^ _shift_mix(_u64(s, i + 8) * K1 & _M) * K1 & _M) * K1 & _M
            d ^= c
            i, left = i + 16, left - 16
    a, b = _hash16(a, c), _hash16(d, b)
    return a ^ b, _hash16(b, a)


def _seeded(s: bytes, seed: tuple[int, int]) -> tuple[int, int]:
    n = len(s)
    if n < 128:
        return _murmur(s, seed)
    x, y = seed
    z = n * K1 & _M
    v0 = (_rot((y ^ K1) & _M, 49) * K1 + _u64(s, 0)) & _M
    v1 = (_rot(v0, 42) * K1 + _u64(s, 8)) & _M
    w0 = (_rot((y + z) & _M, 35) * K1 + x) & _M
    w1 = _rot((x + _u64(s, 88)) & _M, 53) * K1 & _M
    i, left = 0, n
    while left >= 128:
        for _ in range(2):
            x = _rot((x + y + v0 + _u64(s, i + 16)) & _M, 37) * K1 & _M
            y = _rot((y + v1 + _u64(s, i + 48)) & _M, 42) * K1 & _M
            x ^= w1
            y ^= v0
            z = _rot(z ^ w0, 33)
            v0, v1 = _weak32(s, i, v1 * K1 & _M, (x + w0) & _M)
            w0, w1 = _weak32(s, i + 32, (z + w1) & _M, y)
            z, x = x, z
            i += 64
        left -= 128
    y = (y + _rot(w0, 37) * K0 + z) & _M
    x = (x + _rot((v0 + z) & _M, 49) * K0) & _M
    done = 0
    while done < left:
        done += 32
        y = (_rot((y - x) & _M, 42) * K0 + v1) & _M
        w0 = (w0 + _u64(s, n - done + 16)) & _M
        x = (_rot(x, 49) * K0 + w0) & _M
        w0 = (w0 + v0) & _M
        v0, v1 = _weak32(s, n - done, v0, v1)
    x = _hash16(x, v0)
    y = _hash16(y, w0)
    return (_hash16((x + v1) & _M, w1) + y) & _M, _hash16((x + w1) & _M, (y + v1) & _M)


def city_hash128(s: bytes) -> tuple[int, int]:
    """The hash's low and high 64 bits."""
    n = len(s)
    if n >= 16:
        return _seeded(s[16:], (_u64(s, 0) ^ K3, _u64(s, 8)))
    if n >= 8:
        return _seeded(b"", ((_u64(s, 0) ^ n * K0) & _M, _u64(s, n - 8) ^ K1))
    return _seeded(s, (K0, K1))
