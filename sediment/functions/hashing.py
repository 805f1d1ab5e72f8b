"""Content ids and checksums, as columns and for single values."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: xxhash64 of this long under Spark's seed 42 is 0, so what follows it is hashed with seed 0.
_SEED_ZERO = -365884300664092260

#: Fixed values of the 64-bit hash.
P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
_M = (1 << 64) - 1


def checksum(data) -> Column:
    """XXH64 with seed 0 of a binary column, as a signed long; runs in generated code."""
    return F.xxhash64(F.lit(_SEED_ZERO), data if isinstance(data, Column) else F.col(data))


def content_id_hex(data) -> Column:
    """First 128 bits of SHA-256, as 32 lower-case hexadecimal digits."""
    return F.substring(F.sha2(data, 256), 1, 32)


def content_id(data) -> Column:
    return F.unhex(content_id_hex(data))


def content_id_of(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:16]


def _turn(x: int, r: int) -> int:
    return ((x << r) | (x >> (64 - r))) & _M


def avalanche(h: int) -> int:
    """The last mixing of the 64-bit hash."""
    h = ((h ^ (h >> 33)) * P2) & _M
    h = ((h ^ (h >> 29)) * P3) & _M
    return h ^ (h >> 32)


def mix(acc: int, v: int) -> int:
    """Folds a value into a context hash."""
    h = ((acc + v + P3) * P1) & _M
    return h ^ (h >> 29)


def xxh64(data: bytes, seed: int = 0) -> int:
    """XXH64 of one value: four lanes over the 32-byte stripes, then the tail."""
    n, at = len(data), 0
    stripes = n // 32
    if stripes:
        lanes = [(seed + P1 + P2) & _M, (seed + P2) & _M, seed, (seed - P1) & _M]
        words = np.frombuffer(data, "<u8", stripes * 4)
        for row in words.reshape(stripes, 4).tolist():
            lanes = [(_turn((a + w * P2) & _M, 31) * P1) & _M for a, w in zip(lanes, row, strict=True)]
        h = sum(_turn(a, r) for a, r in zip(lanes, (1, 7, 12, 18), strict=True)) & _M
        for a in lanes:
            h = ((h ^ ((_turn((a * P2) & _M, 31) * P1) & _M)) * P1 + P4) & _M
        at = stripes * 32
    else:
        h = (seed + P5) & _M
    h = (h + n) & _M
    while at + 8 <= n:
        k = (_turn((int.from_bytes(data[at : at + 8], "little") * P2) & _M, 31) * P1) & _M
        h, at = (_turn(h ^ k, 27) * P1 + P4) & _M, at + 8
    if at + 4 <= n:
        h, at = (_turn(h ^ ((int.from_bytes(data[at : at + 4], "little") * P1) & _M), 23) * P2 + P3) & _M, at + 4
    for b in data[at:]:
        h = (_turn(h ^ ((b * P5) & _M), 11) * P1) & _M
    return avalanche(h)


def signed(x: int) -> int:
    """A 64-bit pattern as a signed long."""
    return x - (1 << 64) if x >> 63 else x
