"""Readable sizes and durations, ratios, option parsing, and the codes of methods and filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB")


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def format_bytes(n, largest: str = UNITS[-1]) -> Column:
    """``999 B``, ``1.5 KiB``, ``200 KiB``: a decimal below 100, ties to even; no unit above the ``largest``."""
    n = _col(n)
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(UNITS[1 : UNITS.index(largest) + 1], 1):
        v = n.cast("double") / float(1024**k)
        text = F.when(v >= 100, F.format_string("%.0f", F.bround(v, 0))).otherwise(F.format_string("%.1f", F.bround(v, 1)))
        out = F.when(n >= 1024**k, F.concat(text, F.lit(" " + unit))).otherwise(out)
    return out


def format_duration(seconds) -> Column:
    """``250 ms``, ``3.2 s``, ``2 m 5 s``."""
    s = _col(seconds).cast("double")
    minutes = F.concat(F.floor(s / 60).cast("string"), F.lit(" m "), F.format_string("%.0f", F.bround(s % 60, 0)), F.lit(" s"))
    return F.when(s < 1, F.concat(F.format_string("%.0f", F.bround(s * 1000, 0)), F.lit(" ms"))).when(s < 60, F.concat(F.format_string("%.1f", F.bround(s, 1)), F.lit(" s"))).otherwise(minutes)


def rate(n, seconds) -> Column:
    s = _col(seconds).cast("double")
    return F.when(s <= 0, F.lit("-")).otherwise(F.concat(format_bytes(F.floor(_col(n) / s)), F.lit("/s")))


def parse_size(text) -> Column:
    """Bytes of ``4096``, ``64K``, ``16M``, ``2G``, ``8MB`` in either case; null if it is no size or exceeds a long."""
    t = F.trim(_col(text))
    scale = F.upper(F.regexp_extract(t, r"(?i)^\+?[0-9]+\s*([KMG]?)B?$", 1))
    digits = F.regexp_extract(t, r"(?i)^\+?([0-9]+)\s*[KMG]?B?$", 1)
    n = F.expr("0") + F.when(digits != "", digits).try_cast("bigint")
    factor = F.when(scale == "K", 1 << 10).when(scale == "M", 1 << 20).when(scale == "G", 1 << 30).otherwise(1).cast("bigint")
    return F.try_multiply(n, factor)


def filter_of_name(spec) -> Column:
    """Filter byte of ``none``, ``x86`` or ``delta:N`` (1 to 63); -1 for ``auto``; null for anything else."""
    spec = _col(spec)
    stride = F.when(spec.rlike(r"^delta:\+?[0-9]+$"), F.regexp_extract(spec, "([0-9]+)$", 1)).try_cast("int")
    return F.when(spec == "auto", -1).when(spec == "none", 0).when(spec == "x86", 1).when(stride.between(1, 63), stride.bitwiseOR(F.lit(0x40)))


def filter_byte(kind, stride) -> Column:
    """Byte of a filter kind (``none``, ``x86``, ``delta``) and its stride."""
    kind = _col(kind)
    return F.when(kind == "none", 0).when(kind == "x86", 1).when((kind == "delta") & _col(stride).between(1, 63), _col(stride).bitwiseOR(F.lit(0x40)))


def filter_name(byte) -> Column:
    """Name of a filter byte; ``?`` for a byte that no filter has."""
    b = _col(byte)
    return F.when(b == 0, "none").when(b == 1, "x86").when(b.between(0x41, 0x7F), F.concat(F.lit("delta"), (b - 0x40).cast("string"))).otherwise("?")


def method_name(byte) -> Column:
    return F.when(_col(byte) == 0, "stored").when(_col(byte) == 1, "modelled").otherwise("?")


def ratio(raw, packed) -> Column:
    return _col(raw) / F.greatest(_col(packed), F.lit(1))


def bits_per_byte(raw, packed) -> Column:
    return _col(packed) * 8.0 / F.greatest(_col(raw), F.lit(1))


def saved_percent(raw, packed) -> Column:
    return 100.0 - _col(packed) * 100.0 / F.greatest(_col(raw), F.lit(1))


def size_is_sane(comp_len, raw_len) -> Column:
    """Whether a block of ``comp_len`` bytes can decode to ``raw_len``: expansion of 65536 at most, 2^33 bytes at most."""
    ceiling = (_col(comp_len).cast("decimal(38,0)") + 16) * 65536
    return (_col(raw_len) <= ceiling) & (_col(raw_len) <= F.lit(1 << 33))


#: Context models of each level, 1 to 9.
MODELS = (2, 3, 4, 5, 5, 6, 7, 10, 10)


def _shift(bits: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bits.cast("int"))


def _power(n: Column) -> Column:
    """log2 of the next power of two."""
    return F.when(n <= 1, 0).otherwise(F.length(F.ltrim(F.bin(n - 1), F.lit("0")))).cast("int")


def working_set(level, block_len) -> Column:
    """Bytes that coding a block of ``block_len`` takes at a level."""
    level, n = F.greatest(F.lit(1), F.least(F.lit(9), _col(level))), _col(block_len).cast("bigint")
    models = F.element_at(F.array(*map(F.lit, MODELS)), level).cast("bigint")
    share = _power(F.floor(_shift(level + 22) / models)) - 1
    table = F.greatest(F.lit(16), F.least(_power(F.greatest(n * 2, F.lit(65536))), share))
    match = F.greatest(F.lit(12), F.least(_power(F.greatest(n, F.lit(4096))) - 2, level + 15))
    return models * _shift(table) + _shift(match) * 4 + 65536 * 33 * 2 + 65536 + n


def thread_plan(available, per_thread, requested) -> Column:
    """Threads whose working sets fit in 60 % of the available bytes: one at least, as many as requested at most."""
    fits = F.greatest(F.lit(1), F.floor(F.floor(_col(available) * 60 / 100) / F.greatest(_col(per_thread), F.lit(1))))
    return F.least(fits, _col(requested))
