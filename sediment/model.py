"""The data model: entries, chunks and blocks, their enumerations, sizes and errors."""

from __future__ import annotations

from pyspark.sql import types as T

FILE, DIRECTORY, SYMLINK = 0, 1, 2
STORED, MODELLED = 0, 1

#: Sentinels of the index become null in the tables that users see: mode 0, mtime 0, empty link target.
ENTRIES = T.StructType([
    T.StructField("entry_idx", T.LongType()), T.StructField("path", T.StringType()), T.StructField("kind", T.ByteType()),
    T.StructField("mode", T.LongType()), T.StructField("mtime", T.LongType()), T.StructField("size", T.LongType()),
    T.StructField("content_id", T.BinaryType()), T.StructField("chunks", T.ArrayType(T.LongType())), T.StructField("link_target", T.StringType()),
])
CHUNKS = T.StructType([T.StructField("chunk_idx", T.LongType()), T.StructField("len", T.LongType())])
BLOCKS = T.StructType([
    T.StructField("block_idx", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("comp_len", T.LongType()),
    T.StructField("raw_len", T.LongType()), T.StructField("first_chunk", T.LongType()), T.StructField("n_chunks", T.LongType()),
    T.StructField("method", T.ShortType()), T.StructField("filter", T.ShortType()), T.StructField("checksum", T.LongType()),
])
HEADER = T.StructType([
    T.StructField("version", T.IntegerType()), T.StructField("level", T.IntegerType()), T.StructField("deduplicated", T.BooleanType()),
    T.StructField("block_size", T.LongType()), T.StructField("meta_offset", T.LongType()), T.StructField("meta_comp_len", T.LongType()),
    T.StructField("meta_raw_len", T.LongType()), T.StructField("archive_bytes", T.LongType()),
])

HEADER_BYTES, FOOTER_BYTES = 16, 40
#: Chunk sizes: least, average, most.
CHUNK_SIZES = (8 << 10, 32 << 10, 128 << 10)
BLOCK_SIZE, LEAST_BLOCK, MOST_BLOCK = 16 << 20, 64 << 10, 1 << 30
DEFAULT_LEVEL = 5


class ArchiveError(Exception):
    """Any failure of an archive."""


class BadMagic(ArchiveError):
    """The bytes are no archive."""


class UnsupportedVersion(ArchiveError):
    """An archive of another version."""


class Corrupt(ArchiveError):
    """A structure that no writer makes."""


class IntegrityFailure(ArchiveError):
    """Bytes that differ from their checksum."""


class UnsafePath(ArchiveError):
    """A path that could leave the folder it is restored to."""
