"""Token-id output: Arrow files of fixed-size lists, read back without copying.

A shard is two Arrow IPC files. ``NAME.arrow`` holds the ids of its documents, one after the other, cut
into rows of ``length`` ids (column ``ids``) with a mask that is true for real ids (column ``mask``). Every
record batch but the last has exactly ``ROWS`` rows, so row i is row i % ROWS of batch i // ROWS, and a
reader that maps the file gets each row as a view. ``NAME.docs.arrow`` has doc_id, start (ids of the
shard before the document) and n_tokens. Documents lie in ascending doc_id order within and across shards.

Null texts are empty documents (the end id alone); null ids come first; rows with equal ids are ordered
by a hash of their text, and may lie in several shards; an empty table writes no shard and reads back as no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_ids, filesystem, fresh, stage
from .encoding import default_path, encoder, gathered

#: Rows of a record batch.
ROWS = 256


def with_end(flat: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's ids with ``end_id`` after them."""
    return np.insert(flat, np.cumsum(counts), end_id), counts + 1


def id_type(path: str):
    return np.uint16 if encoder(path).vocabulary <= 1 << 16 else np.uint32


class ShardWriter:
    """Writes the two files of a shard; takes ids in pieces of any size."""

    def __init__(self, uri: str, length: int, dtype, rows: int = ROWS):
        self.fs, path = filesystem(uri)
        self.fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.length, self.size, self.dtype = length, length * rows, dtype
        item = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([pa.field("ids", pa.list_(item, length)), pa.field("mask", pa.list_(pa.bool_(), length))])
        self.docs_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.out = self.fs.open_output_stream(path + ".arrow")
        self.docs_out = self.fs.open_output_stream(path + ".docs.arrow")
        self.ids = pa.ipc.new_file(self.out, self.schema)
        self.docs = pa.ipc.new_file(self.docs_out, self.docs_schema)
        self.left = np.zeros(0, dtype)
        self.n_docs = self.n_tokens = 0

    def add(self, doc_ids: pa.Array, flat: np.ndarray, counts: np.ndarray) -> None:
        start = self.n_tokens + np.cumsum(counts) - counts
        self.docs.write_batch(pa.RecordBatch.from_arrays([doc_ids.cast(pa.int64()), pa.array(start), pa.array(counts.astype(np.int64))], schema=self.docs_schema))
        self.n_docs += len(counts)
        self.n_tokens += len(flat)
        self.left = np.concatenate([self.left, flat.astype(self.dtype)])
        full = len(self.left) // self.size * self.size
        for at in range(0, full, self.size):
            self._batch(self.left[at : at + self.size])
        self.left = self.left[full:].copy()

    def _batch(self, ids: np.ndarray) -> None:
        rows = -(-len(ids) // self.length)
        padded = np.zeros(rows * self.length, self.dtype)
        padded[: len(ids)] = ids
        mask = np.arange(rows * self.length) < len(ids)
        self.ids.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (padded, mask)], schema=self.schema))

    def close(self) -> None:
        if len(self.left):
            self._batch(self.left)
        for x in (self.ids, self.docs, self.out, self.docs_out):
            x.close()


class ShardReader:
    """Random access to the rows of a shard and to its documents' ids."""

    def __init__(self, uri: str):
        self.fs, path = filesystem(uri)
        local = type(self.fs).__name__ == "LocalFileSystem"
        open_ = pa.memory_map if local else self.fs.open_input_file
        self.ids, self.docs = pa.ipc.open_file(open_(path + ".arrow")), pa.ipc.open_file(open_(path + ".docs.arrow"))
        self.length = self.ids.schema.field("ids").type.list_size
        self.rows = len(self.ids.get_batch(0)) if self.ids.num_record_batches else 0
        self._at, self._flat = -1, None

    def row(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids, as a view of the file, and mask of row i."""
        batch, k = self.ids.get_batch(i // self.rows), i % self.rows
        return self._values(batch)[k * self.length : (k + 1) * self.length], batch.column("mask")[k].values

    @staticmethod
    def _values(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("ids").flatten().to_numpy(zero_copy_only=True)

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Ids from start to end of the shard's stream."""
        size, found = self.rows * self.length, []
        while start < end:
            k = start // size
            if k != self._at:
                self._at, self._flat = k, self._values(self.ids.get_batch(k))
            stop = min(end, (k + 1) * size)
            found.append(self._flat[start - k * size : stop - k * size])
            start = stop
        return found[0] if len(found) == 1 else np.concatenate(found or [np.zeros(0, np.uint16)])

    def documents(self):
        """Record batches of doc_id, start and n_tokens."""
        for i in range(self.docs.num_record_batches):
            yield self.docs.get_batch(i)


def write_token_files(docs: DataFrame, uri: str, tokenizer: str | None = None, end_id: int = 0, length: int = 2048) -> DataFrame:
    """Writes the shards under ``uri``, a folder that executors share; the manifest: shard, path, n_docs, n_tokens.

    An attempt that is lost leaves files that the manifest doesn't name.
    """
    path = tokenizer or default_path("byte_bpe_50k.json")
    dtype = id_type(path)

    def write(batches):
        writer, shard = None, TaskContext.get().partitionId()
        for b in gathered(batches, 1):
            if not len(b):
                continue
            if writer is None:
                target = f"{uri}/shard-{shard:07d}-{uuid.uuid4().hex}"
                writer = ShardWriter(target, length, dtype)
            flat, counts = with_end(*encoder(path).encode(b.column(1)), end_id)
            writer.add(b.column(0), flat, counts)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [target], "n_docs": [writer.n_docs], "n_tokens": [writer.n_tokens]})

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.spark_partition_id().alias("of"))  # so that equal ids don't fill one range
    dealt = keyed.repartitionByRange("doc_id", "hash", "of").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    return stage(dealt.mapInArrow(write, "shard long, path string, n_docs long, n_tokens long"), "manifest")


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start in the whole stream, n_tokens and ids_crc32 of each document, from the files.

    Pass one has written each shard's total; the driver adds them up (a row per shard), pass two reads.
    """
    base, rows = 0, []
    for r in manifest.orderBy("shard").collect():
        rows.append((r.path, base))
        base += r.n_tokens
    shards = spark.createDataFrame(rows, "path string, base long")

    def read(batches):
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                reader = ShardReader(path)
                for d in reader.documents():
                    start, n = d.column("start").to_numpy(), d.column("n_tokens").to_numpy()
                    crc = [crc32_ids(reader.tokens(a, a + k)) for a, k in zip(start.tolist(), n.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([d.column("doc_id"), pa.array(start + base), d.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.repartition(max(1, len(rows))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files_digest(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    return read_token_files(spark, write_token_files(docs, fresh(spark, "token-files"), tokenizer))
