"""Exact deduplication by content id: first occurrence wins, with numbering, ownership and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .layout import global_rank


def first_occurrences(rows: DataFrame, content: str = "chunk_id", order: tuple[str, ...] = ("entry_idx", "pos")) -> DataFrame:
    """Each row with ``first``, the order key of the first row of equal content, and ``is_first``.

    Firsts are minima, combined before the shuffle; the join back moves no payload if the rows have none.
    """
    key = F.struct(*order)
    firsts = rows.groupBy(content).agg(F.min(key).alias("first"))
    return rows.join(firsts, content).withColumn("is_first", key == F.col("first"))


def number_unique(rows: DataFrame, content: str = "chunk_id", order: tuple[str, ...] = ("entry_idx", "pos"), carry: tuple[str, ...] = ("len",)) -> DataFrame:
    """A row per distinct content in order of first occurrence: ``chunk_idx``, the content, ``first`` and the carried columns."""
    key = F.struct(*order)
    unique = rows.groupBy(content).agg(F.min(key).alias("first"), *(F.min_by(c, key).alias(c) for c in carry))
    return global_rank(unique, [F.col("first")], "chunk_idx").select("chunk_idx", content, "first", *carry)


def chunk_refs(rows: DataFrame, unique: DataFrame, content: str = "chunk_id") -> DataFrame:
    """Per entry the chunk indices of its content, in order, and its size."""
    placed = rows.join(unique.select(content, "chunk_idx"), content)
    refs = F.transform(F.sort_array(F.collect_list(F.struct("pos", "chunk_idx"))), lambda x: x["chunk_idx"])
    return placed.groupBy("entry_idx").agg(refs.alias("chunks"), F.sum("len").alias("size"))


def dedup_stats(rows: DataFrame, unique: DataFrame) -> DataFrame:
    """One row: raw_bytes, unique_bytes, deduplicated_bytes, chunks and unique chunks."""
    raw = rows.agg(F.coalesce(F.sum("len"), F.lit(0)).alias("raw_bytes"), F.count("*").alias("n_chunks"))
    own = unique.agg(F.coalesce(F.sum("len"), F.lit(0)).alias("unique_bytes"), F.count("*").alias("n_unique"))
    return raw.crossJoin(own).withColumn("deduplicated_bytes", F.greatest(F.lit(0), F.col("raw_bytes") - F.col("unique_bytes")))


def owner(refs: DataFrame, chunk: str = "chunk_idx", order: tuple[str, ...] = ("entry_idx", "pos")) -> Column:
    """Window column: true on the first reference to each chunk."""
    return F.row_number().over(Window.partitionBy(chunk).orderBy(*order)) == 1
