"""Byte operators as SQL functions: ``register(spark)`` names them in a session."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, filters
from ..operators.packing import pack_stream_column, unpack_stream_column


class _Chunks:
    """Rows of a value's chunks: pos, off, len, chunk_id."""

    def eval(self, data: bytes, least: int, average: int, most: int):
        off = 0
        for pos, n in enumerate(chunking.cuts(bytes(data or b""), (least, average, most))):
            yield pos, off, n, chunking.content_id_of(bytes(data[off : off + n]))
            off += n


def register(spark: SparkSession) -> None:
    """SQL: ``chunk(data, least, average, most)``, ``analyze_bytes``, ``apply_filter``, ``unapply_filter``."""
    spark.udtf.register("chunk", F.udtf(_Chunks, returnType="pos int, off bigint, len bigint, chunk_id binary"))
    spark.udf.register("analyze_bytes", filters.analyze_column)
    spark.udf.register("apply_filter", filters.apply_column)
    spark.udf.register("unapply_filter", filters.unapply_column)


__all__ = ["pack_stream_column", "register", "unpack_stream_column"]
