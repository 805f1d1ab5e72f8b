"""Packing: concatenate and cut. Two passes of prefix sums give every document its place in one stream.

Pass one encodes each partition where it lies, with no shuffle, and writes ids with their place in the
partition; the partitions' totals, one row each, are added up on the driver. Pass two turns places into
global offsets, cuts the stream into windows of ``length`` ids and records the boundaries. Only the last
window is short, so padding is less than one window in all.

Null texts are empty documents (the end id alone). Rows with equal ids are documents of their own. An
empty table gives no pieces; other columns are ignored. Long documents span as many windows as they need.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_ids, stage
from .encoding import default_path, encoder, gathered
from .token_files import id_type, with_end

#: Partitions up to which their offsets, 16 bytes each, are broadcast; beyond, the ids are shuffled to meet them.
BROADCAST_ROWS = 500_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut(first: int, n: int, length: int):
    """(start in the document, ids, window, offset in the window) of the pieces of n ids that begin at ``first``."""
    at = first
    while at < first + n:
        stop = min(first + n, (at // length + 1) * length)
        yield at - first, stop - at, at // length, at % length
        at = stop


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, length: int = 2048, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids as binary)."""
    path = tokenizer or default_path("word_bpe_49k.json")
    dtype = id_type(path)

    def encode(batches):
        part, at = TaskContext.get().partitionId(), 0
        for b in gathered(batches, 1):
            flat, n = with_end(*encoder(path).encode(b.column(1)), end_id)
            ends = np.concatenate([[0], np.cumsum(n)])
            ids = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends * np.dtype(dtype).itemsize), pa.py_buffer(flat.astype(dtype))])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int64)), pa.array(at + ends[:-1]), b.column(0).cast(pa.int64()), ids.cast(pa.binary())], ["part", "place", "doc_id", "ids"])
            at += int(ends[-1])

    encoded = stage(docs.select("doc_id", "text").mapInArrow(encode, "part long, place long, doc_id long, ids binary"), "packed-ids")
    width = np.dtype(dtype).itemsize
    totals = encoded.groupBy("part").agg(F.sum(F.octet_length("ids") / F.lit(width)).cast("long").alias("total")).orderBy("part").collect()
    base = np.concatenate([[0], np.cumsum([r.total for r in totals])]).tolist()
    bases = docs.sparkSession.createDataFrame([(r.part, b) for r, b in zip(totals, base, strict=False)], "part long, base long")
    if len(totals) <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    placed = encoded.join(bases, "part").select("doc_id", (F.col("base") + F.col("place")).alias("first"), "ids")

    def pieces(batches):
        for b in batches:
            rows = []
            for doc_id, first, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                ids = np.frombuffer(raw.as_buffer(), dtype)
                for start, n, window, offset in cut(first, len(ids), length):
                    own = ids[start : start + n]
                    rows.append((doc_id, start, n, crc32_ids(own), len(ids), window, offset, *([own.tobytes()] if keep_ids else [])))
            names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * keep_ids
            types = [pa.int64()] * 7 + [pa.binary()] * keep_ids
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return placed.mapInArrow(pieces, PIECES + ", ids binary" * keep_ids)
