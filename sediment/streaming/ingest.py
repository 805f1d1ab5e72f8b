"""Files as a stream of chunks: each content is let through once.

The engine's own tables are written by batches; this keeps a chunk store up to date as files arrive. State is one
content id per chunk seen, in the checkpointed state store; with a watermark it is dropped after that time.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import CHUNK_SIZES
from ..operators.chunking import chunk

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def chunk_stream(files: DataFrame, sizes=CHUNK_SIZES, scaled: bool = False) -> DataFrame:
    """path, pos, off, len, chunk_id, data of the files' chunks."""
    return chunk(files, key="path", content="content", sizes=sizes, scaled=scaled, keep_data=True)


def first_seen(chunks: DataFrame) -> DataFrame:
    """The chunks whose content has not been seen before; ids are grouped, not payloads compared."""
    return chunks.dropDuplicates(["chunk_id"])


def ingest(spark: SparkSession, source: str, store: str, checkpoint: str, sizes=CHUNK_SIZES, scaled: bool = False, pattern: str = "*", available_now: bool = True):
    """Starts a query that appends the new chunks of files below ``source`` to the Parquet table ``store``."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(source)
    out = first_seen(chunk_stream(files, sizes, scaled)).writeStream.format("parquet").option("path", store).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if available_now else out).start()


def running_content_id(parts) -> bytes:
    """Content id of bytes that come in parts, however they are split."""
    h = hashlib.sha256()
    for p in parts:
        h.update(p)
    return h.digest()[:16]


def store_stats(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(store).agg(F.count("*").alias("n_chunks"), F.sum("len").alias("bytes"))
