"""Command line: ``python -m sediment.cli COMMAND ...``; every command is a few lines over the library."""

from __future__ import annotations

import argparse
import bz2
import gzip
import lzma
import os
import sys
import time

from . import __version__
from .model import ArchiveError
from .operators import packing

ALIASES = {"create": ("c", "a", "add"), "extract": ("x",), "list": ("l", "ls"), "info": (), "test": ("verify", "t"), "compress": (), "decompress": ("d",), "bench": ()}


def parse_size(text: str) -> int:
    t = text.strip()
    t = t[:-1] if t[-1:] in ("b", "B") else t
    scale = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(t[-1:].lower(), 1)
    digits = (t[:-1] if scale > 1 else t).strip()
    if not digits.isascii() or not digits.isdigit():
        raise argparse.ArgumentTypeError(f"bad size {text!r}")
    return int(digits) * scale


def parse_filter(text: str) -> int | None:
    if text in ("auto", "none", "x86"):
        return {"auto": None, "none": 0, "x86": 1}[text]
    kind, _, stride = text.partition(":")
    if kind != "delta" or not stride.isdigit() or not 1 <= int(stride) <= 63:
        raise argparse.ArgumentTypeError(f"unknown filter {text!r}: auto, none, x86 or delta:1 to delta:63")
    return 0x40 | int(stride)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sediment")
    p.add_argument("-V", "--version", action="version", version=f"sediment {__version__}")
    sub = p.add_subparsers(dest="command", required=True)
    for name, others in ALIASES.items():
        c = sub.add_parser(name, aliases=others)
        c.set_defaults(command=name)
        c.add_argument("paths", nargs="*")
        c.add_argument("-l", "--level", type=int, default=5, choices=range(1, 10))
        c.add_argument("-o", "--output")
        c.add_argument("-C", "--directory", default=".")
        c.add_argument("-T", "-j", "--threads", type=int, default=os.cpu_count() or 1)
        c.add_argument("-b", "--block-size", type=parse_size, default=16 << 20)
        c.add_argument("--no-dedup", action="store_true")
        c.add_argument("--no-sort", action="store_true")
        c.add_argument("--filter", type=parse_filter, default=None)
        c.add_argument("--force-compress", action="store_true")
        c.add_argument("--exact", action="store_true", help="judge samples by the level-1 coder itself")
        for flag in ("keep-going", "force", "verbose", "quiet"):
            c.add_argument(f"-{flag[0]}", f"--{flag}", action="store_true")
    return p


def _session(threads: int):
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master(f"local[{max(1, threads)}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", max(1, threads))
    spark = s.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _read(path: str | None) -> bytes:
    if path in (None, "-"):
        return sys.stdin.buffer.read()
    with open(path, "rb") as f:
        return f.read()


def _write(path: str | None, data: bytes, force: bool) -> None:
    if path in (None, "-"):
        sys.stdout.buffer.write(data)
        return
    with open(path, "wb" if force else "xb") as f:
        f.write(data)


def _rows(df, quiet: bool = False) -> None:
    if not quiet:
        for r in df.collect():
            print("  ".join("-" if v is None else str(v) for v in r))


def compare(data: bytes, level: int) -> list[tuple[str, int, float]]:
    """(coder, bytes, seconds) of this coder and of general ones."""
    runs = {
        f"level {level}": lambda: packing.pack(data, level, effort=packing.ALWAYS).data, "gzip -9": lambda: gzip.compress(data, 9),
        "bzip2 -9": lambda: bz2.compress(data, 9), "xz -9e": lambda: lzma.compress(data, preset=9 | lzma.PRESET_EXTREME),
    }
    if packing.find_zstd():
        runs["zstd -19"] = lambda: packing.find_zstd().ZstdCompressor(level=19).compress(data)
    try:
        import brotli

        runs["brotli -11"] = lambda: brotli.compress(data, quality=11)
    except ImportError:
        pass
    out = []
    for name, run in runs.items():
        began = time.time()
        out.append((name, len(run()), time.time() - began))
    return out


def run(argv: list[str]) -> int:
    args = parser().parse_args(argv)
    if args.command in ("compress", "decompress", "bench"):
        data = _read(args.paths[0] if args.paths else None)
        if args.command == "compress":
            effort = packing.ALWAYS if args.force_compress else packing.ADAPTIVE
            _write(args.output, packing.write_stream(packing.pack(data, args.level, args.filter, effort, exact=args.exact), args.level), args.force)
        elif args.command == "decompress":
            _write(args.output, packing.unpack(*packing.read_stream(data), "the stream"), args.force)
        else:
            for name, size, seconds in compare(data, args.level):
                print(f"{name:<12} {size:>12} {size * 8 / max(1, len(data)):>8.3f} {len(data) / max(1, size):>8.2f}x {len(data) / 1e6 / max(seconds, 1e-9):>8.2f} MB/s")
        return 0
    from .plans import reports
    from .sources import container, tree

    archive, *rest = args.paths
    spark = _session(args.threads)
    if args.command == "create":
        began = time.time()
        rows = tree.scan(spark, rest, keep_going=args.keep_going)
        effort = packing.ALWAYS if args.force_compress else packing.ADAPTIVE
        stats = container.write_archive(rows, archive, args.level, args.block_size, not args.no_dedup, not args.no_sort, args.filter, effort, overwrite=args.force, exact=args.exact)
        _rows(reports.creation_summary(stats, time.time() - began), args.quiet)
    elif args.command == "extract":
        _rows(container.extract(spark, archive, args.output or args.directory, rest, overwrite=args.force).select("path"), not args.verbose)
    elif args.command == "list":
        entries = container.entries(spark, archive).orderBy("entry_idx")
        _rows(reports.listing(entries).orderBy("entry_idx").drop("entry_idx") if args.verbose else entries.select("path"))
    elif args.command == "info":
        entries, chunks, blocks = (f(spark, archive) for f in (container.entries, container.chunks, container.blocks))
        _rows(reports.info(entries, chunks, os.path.getsize(archive)))
        if args.verbose:
            attributed = reports.size_attribution(entries, chunks, blocks)
            for df in (reports.block_report(blocks), reports.stored_share(blocks), reports.by_extension(attributed), reports.largest(attributed)):
                print()
                _rows(df)
    else:
        bad = container.verify(spark, archive).filter("not ok")
        _rows(bad, args.quiet)
        return int(not bad.isEmpty())
    return 0


def main() -> None:
    try:
        sys.exit(run(sys.argv[1:]))
    except (ArchiveError, OSError) as e:
        sys.exit(f"sediment: {type(e).__name__}: {e}")


if __name__ == "__main__":
    main()
