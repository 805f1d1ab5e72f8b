"""Reversible byte filters and the analysis that chooses one for a block."""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Corrupt

NONE, X86, DELTA = 0, 1, 0x40
#: Sampling of a block: slices, bytes of a slice, smallest block, percent that delta must win, percent that is incompressible.
SLICES, SLICE_BYTES, LEAST_PROBE, MARGIN, INCOMPRESSIBLE = 8, 24 << 10, 8 << 10, 2, 98
MOST_STRIDE, STEP = 32, 7


def stride_of(byte: int) -> int:
    """Stride of a delta filter's byte, 0 for the others; unknown bytes are an error."""
    if byte in (NONE, X86):
        return 0
    if DELTA < byte < 2 * DELTA:
        return byte - DELTA
    raise Corrupt("unknown filter")


def _branches(data: np.ndarray) -> np.ndarray:
    """Positions of the call and jump opcodes that the filter acts on: each one rules out the four bytes after it."""
    at = np.flatnonzero((data[: max(0, len(data) - 4)] & 0xFE) == 0xE8)
    if len(at) < 2 or (np.diff(at) >= 5).all():
        return at
    kept, clear = [], -1
    for i in at.tolist():
        if i >= clear:
            kept.append(i)
            clear = i + 5
    return np.array(kept, np.int64)


def x86(data: bytes, forward: bool, base: int = 0) -> bytes:
    """Relative branch targets made absolute, or back. Operand bytes are never scanned, so both ways find the same ones."""
    out = np.frombuffer(data, np.uint8).copy()
    at = _branches(out)
    if len(at):
        cells = at[:, None] + np.arange(1, 5)
        value = (out[cells].astype(np.uint32) << (np.arange(4, dtype=np.uint32) * 8)).sum(1, dtype=np.uint32)
        following = ((at + 5 + base) & 0xFFFFFFFF).astype(np.uint32)
        value = value + following if forward else value - following
        out[cells] = (value[:, None] >> (np.arange(4, dtype=np.uint32) * 8)).astype(np.uint8)
    return out.tobytes()


def delta(data: bytes, stride: int, forward: bool) -> bytes:
    """Each byte less the one ``stride`` before it, or the running sums that undo that."""
    raw = np.frombuffer(data, np.uint8)
    if not stride or len(raw) <= stride:
        return data
    if forward:
        out = raw.copy()
        out[stride:] -= raw[:-stride]
        return out.tobytes()
    rows = -(-len(raw) // stride)
    padded = np.zeros(rows * stride, np.uint8)
    padded[: len(raw)] = raw
    return np.cumsum(padded.reshape(rows, stride), axis=0, dtype=np.uint8).reshape(-1)[: len(raw)].tobytes()


def apply(byte: int, data: bytes, base: int = 0) -> bytes:
    stride = stride_of(byte)
    return delta(data, stride, True) if stride else x86(data, True, base) if byte == X86 else data


def unapply(byte: int, data: bytes, base: int = 0) -> bytes:
    stride = stride_of(byte)
    return delta(data, stride, False) if stride else x86(data, False, base) if byte == X86 else data


def probe_starts(n: int) -> list[int]:
    """Where the slices of a sample begin."""
    size = min(SLICE_BYTES, n)
    count = max(1, min(SLICES, n // max(1, size)))
    return [min(i * (n // count), n - size) for i in range(count)]


def sample(data: bytes) -> bytes:
    size = min(SLICE_BYTES, len(data))
    return b"".join(data[a : a + size] for a in probe_starts(len(data)))


def looks_like_code(data: bytes) -> bool:
    """Whether branches with a plausible top byte are as frequent as one in 1024 bytes."""
    raw = np.frombuffer(data, np.uint8)
    top = raw[_branches(raw) + 4]
    return int(((top == 0) | (top == 255)).sum()) * 1024 >= len(raw)


def stride_scores(data: bytes) -> list[int]:
    """For strides 1 to 32: how many of every 7th bytes equal the one a stride before."""
    raw = np.frombuffer(data, np.uint8)
    return [int((raw[s::STEP] == raw[: len(raw) - s : STEP][: len(raw[s::STEP])]).sum()) for s in range(1, MOST_STRIDE + 1)]


def likely_stride(data: bytes) -> int:
    """The stride of fixed-width records, or 0."""
    if len(data) < MOST_STRIDE * 16:
        return 0
    scores = stride_scores(data)
    best = int(np.argmax(scores)) + 1
    return best if best >= 2 and scores[best - 1] * 8 > (len(data) - MOST_STRIDE) // STEP else 0


class Analysis(NamedTuple):
    filter: int
    incompressible: bool


def quick_size(data: bytes) -> int:
    """Bytes that a fast general coder takes: the default judge of samples."""
    return len(zlib.compress(data, 6))


def analyze(data: bytes, size_of=quick_size) -> Analysis:
    """Filter for a block and whether to store it, from a sample. ``size_of`` judges how small a sample gets: the
    default is a stand-in for the level-1 coder, which ``packing.level_one_size`` runs itself."""
    if len(data) < LEAST_PROBE:
        return Analysis(NONE, False)
    own = sample(data)
    if looks_like_code(own):
        return Analysis(X86, False)
    plain = size_of(own)
    if plain * 100 >= len(own) * INCOMPRESSIBLE:
        return Analysis(NONE, True)
    stride = likely_stride(own)
    if stride and size_of(delta(own, stride, True)) + plain * MARGIN // 100 < plain:
        return Analysis(DELTA + stride, False)
    return Analysis(NONE, False)


@F.pandas_udf(T.StructType([T.StructField("filter", T.ShortType()), T.StructField("incompressible", T.BooleanType())]))
def analyze_column(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([analyze(bytes(x or b"")) for x in data], columns=["filter", "incompressible"])


@F.pandas_udf(T.BinaryType())
def apply_column(byte: pd.Series, data: pd.Series) -> pd.Series:
    return pd.Series([apply(int(b), bytes(x)) if x is not None else None for b, x in zip(byte, data, strict=True)])


@F.pandas_udf(T.BinaryType())
def unapply_column(byte: pd.Series, data: pd.Series) -> pd.Series:
    return pd.Series([unapply(int(b), bytes(x)) if x is not None else None for b, x in zip(byte, data, strict=True)])


def sample_column(data: Column) -> Column:
    """The sample of a binary column, without leaving the JVM."""
    n = F.octet_length(data)
    size = F.least(n, F.lit(SLICE_BYTES))
    count = F.greatest(F.lit(1), F.least(F.lit(SLICES), F.floor(n / F.greatest(size, F.lit(1))))).cast("int")
    starts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.least(i * F.floor(n / count), n - size).cast("int"))
    return F.aggregate(F.transform(starts, lambda s: F.substring(data, s + 1, size)), F.lit(b""), lambda a, b: F.concat(a, b))
