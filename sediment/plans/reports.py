"""Reports on an archive's index: totals, blocks, sizes charged to entries, roll-ups. No data block is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formats import bits_per_byte, filter_name, format_bytes, format_duration, method_name, rate, ratio, saved_percent
from ..functions.paths import report_extension
from ..operators.layout import chunk_to_block

TOP = 15


def totals(entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: entries by kind, bytes of all files, of unique chunks, and the difference."""
    own = entries.agg(
        F.count_if(F.col("kind") == 0).alias("files"), F.count_if(F.col("kind") == 1).alias("dirs"), F.count_if(F.col("kind") == 2).alias("symlinks"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"),
    )
    unique = chunks.agg(F.coalesce(F.sum("len"), F.lit(0)).alias("unique_size"))
    return own.crossJoin(unique).withColumn("deduplicated", F.greatest(F.lit(0), F.col("total_size") - F.col("unique_size")))


def info(entries: DataFrame, chunks: DataFrame, archive_bytes: int) -> DataFrame:
    """Totals with the archive's ratio, bits per byte, per cent saved and per cent deduplicated."""
    size = F.lit(archive_bytes)
    return totals(entries, chunks).select(
        "*", size.alias("archive_bytes"), ratio("total_size", size).alias("ratio"), bits_per_byte("total_size", size).alias("bits_per_byte"),
        saved_percent("total_size", size).alias("saved_percent"), (F.col("deduplicated") * 100.0 / F.greatest("total_size", F.lit(1))).alias("dedup_percent"),
    )


def block_report(blocks: DataFrame) -> DataFrame:
    return blocks.select("block_idx", "raw_len", "comp_len", "n_chunks", (F.col("method") == 0).alias("stored"), method_name("method").alias("method"), filter_name("filter").alias("filter"))


def stored_share(blocks: DataFrame) -> DataFrame:
    """One row: bytes of blocks that are stored as they are, of all blocks, and whether most blocks are stored."""
    stored = F.col("method") == 0
    return blocks.agg(
        F.coalesce(F.sum(F.when(stored, F.col("raw_len"))), F.lit(0)).alias("stored_raw"), F.coalesce(F.sum("raw_len"), F.lit(0)).alias("raw"),
        F.count_if(stored).alias("stored_blocks"), F.count("*").alias("total_blocks"),
    ).withColumn("mostly_incompressible", mostly_incompressible())


def mostly_incompressible(stored: str = "stored_blocks", total: str = "total_blocks"):
    return (F.col(total) > 0) & (F.col(stored) * 2 > F.col(total))


def size_attribution(entries: DataFrame, chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """``packed`` of each entry: its block's share of every chunk that it is the first to refer to.

    Shares are exact: lengths times packed size are summed per entry and block in integers, divided last.
    """
    refs = entries.select("entry_idx", F.posexplode("chunks").alias("pos", "chunk_idx"))
    owners = refs.groupBy("chunk_idx").agg(F.min(F.struct("entry_idx", "pos"))["entry_idx"].alias("entry_idx"))
    owned = owners.join(chunks, "chunk_idx").join(chunk_to_block(blocks), "chunk_idx").groupBy("entry_idx", "block_idx").agg(F.sum("len").alias("len"))
    share = F.when(F.col("raw_len") > 0, F.col("len").cast("decimal(20,0)") * F.col("comp_len").cast("decimal(18,0)") / F.col("raw_len").cast("decimal(18,0)")).otherwise(0)
    packed = owned.join(blocks.select("block_idx", "comp_len", "raw_len"), "block_idx").groupBy("entry_idx").agg(F.floor(F.sum(share)).cast("long").alias("packed"))
    return entries.join(packed, "entry_idx", "left").withColumn("packed", F.coalesce("packed", F.lit(0)))


def by_extension(attributed: DataFrame, top: int | None = TOP) -> DataFrame:
    """Files, bytes and packed bytes of each extension, the largest packed first."""
    found = attributed.filter("kind = 0").groupBy(report_extension("path").alias("ext")).agg(F.count("*").alias("files"), F.sum("size").alias("raw"), F.sum("packed").alias("packed"))
    ordered = found.orderBy(F.col("packed").desc(), "ext")
    return ordered.limit(top) if top else ordered


def largest(attributed: DataFrame, top: int = TOP) -> DataFrame:
    """The files that take most packed bytes; ties in entry order."""
    return attributed.filter("kind = 0 and size > 0").orderBy(F.col("packed").desc(), "entry_idx").limit(top).select("entry_idx", "path", "size", "packed")


def listing(entries: DataFrame) -> DataFrame:
    """A line per entry: marker, octal mode, readable size, time, path with a link's target."""
    marker = F.when(F.col("kind") == 1, "d").when(F.col("kind") == 2, "l").otherwise("-")
    name = F.when(F.col("kind") == 2, F.concat("path", F.lit(" -> "), F.coalesce("link_target", F.lit("")))).otherwise(F.col("path"))
    return entries.select("entry_idx", marker.alias("marker"), F.conv(F.coalesce("mode", F.lit(0)).cast("string"), 10, 8).alias("mode"), format_bytes("size").alias("size"), F.timestamp_seconds("mtime").alias("mtime"), name.alias("name"))


def creation_summary(stats: DataFrame, seconds: float) -> DataFrame:
    """Readable lines of a write's statistics."""
    took = F.lit(float(seconds))
    return stats.select(
        format_bytes("raw_bytes").alias("input"), format_bytes("deduped_bytes").alias("deduped"), format_bytes("archive_bytes").alias("archive"), format_bytes("metadata_bytes").alias("index"),
        ratio("raw_bytes", "archive_bytes").alias("ratio"), bits_per_byte("raw_bytes", "archive_bytes").alias("bits_per_byte"), saved_percent("raw_bytes", "archive_bytes").alias("saved_percent"),
        format_duration(took).alias("took"), rate("raw_bytes", took).alias("rate"), mostly_incompressible().alias("mostly_incompressible"),
    )


def first_reference(refs: DataFrame) -> DataFrame:
    """References with ``charged``: true on the first one to each chunk."""
    return refs.withColumn("charged", F.row_number().over(Window.partitionBy("chunk_idx").orderBy("entry_idx", "pos")) == 1)
