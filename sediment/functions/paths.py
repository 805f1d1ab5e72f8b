"""Archive paths: normalising, safety, selection, and the two notions of an extension."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_PATH_BYTES = 4096


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def _ascii_lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def archive_path(path) -> Column:
    """The path without root and ``.``, with ``..`` taking its parent away; an empty result is an error."""
    parts = F.filter(F.split(_col(path), "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p != "..", F.array_append(acc, p)).otherwise(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))))
    joined = F.array_join(kept, "/")
    return F.when(joined != "", joined).otherwise(F.raise_error(F.concat(F.lit("unsafe path: "), _col(path))).cast("string"))


def is_unsafe(path) -> Column:
    """True for a path that must not be restored: absolute, of a drive, with a backslash, NUL, or an odd component."""
    p = _col(path)
    odd = F.exists(F.split(p, "/"), lambda c: c.isin("", ".", ".."))
    drive = F.substring(F.encode(p, "utf-8"), 2, 1) == F.lit(b":")
    return (p == "") | (F.octet_length(p) > MOST_PATH_BYTES) | p.startswith("/") | p.contains("\\") | p.contains("\0") | drive | odd


def unsafe(path: str) -> bool:
    """``is_unsafe`` of one path."""
    raw = path.encode()
    return not path or len(raw) > MOST_PATH_BYTES or "\\" in path or "\0" in path or raw[1:2] == b":" or any(c in ("", ".", "..") for c in path.split("/"))


def selects(path, wanted: list[str]) -> Column:
    """Whether a selection names the path or a folder above it; an empty selection names every path."""
    p = _col(path)
    if not wanted:
        return F.lit(True)
    return p.isin(*wanted) | reduce(lambda a, b: a | b, (p.startswith(w.rstrip("/") + "/") for w in wanted))


def sort_extension(path) -> Column:
    """Lower-case text after the last dot of the whole path; empty without a dot."""
    p = _col(path)
    return F.when(p.contains("."), _ascii_lower(F.substring_index(p, ".", -1))).otherwise("")


def report_extension(path) -> Column:
    """Extension for reports: up to 8 ASCII letters and digits of the file name, not only digits; else ``(none)``."""
    name = F.substring_index(_col(path), "/", -1)
    ext = F.when(name.contains("."), F.substring_index(name, ".", -1)).otherwise("")
    return F.when(ext.rlike("^[A-Za-z0-9]{1,8}$") & ~ext.rlike("^[0-9]+$"), F.lower(ext)).otherwise("(none)")
