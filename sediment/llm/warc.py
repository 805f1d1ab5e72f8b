"""WARC: archives of captures, and transactions assembled from their records.

A capture is three records: request, response (or revisit) and metadata; the request and the metadata name the
response in WARC-Concurrent-To. Records are gzip members of their own, one after the other, in files of up to
``FILE_BYTES`` of payload. Of captures with equal payloads (by length and SHA-1) the one with the smallest
page_id is the response; the others are revisits that refer to it and carry no payload. Reading gives a row per
record; captures are assembled by joining the records through their concurrent-to ids.

A null html is an empty payload; a null url is an empty target. Rows with equal page_id and payload are all
responses if theirs is the smallest id (revisits then name it by digest and page alone), and each row stays a capture
with record ids of its own. A null page_id never is the smallest unless all are null; then all are responses. An empty table writes no archive and
gives an empty result; columns beside page_id, url and html are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, fresh, hot_keys, scratch, stage

FILE_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "warc_type string, record_id string, concurrent_to string, refers_to string, target string, capture long, page_id long, payload_bytes long, payload_digest string, payload binary, length long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, fields: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": DATE, **fields, "Content-Length": str(len(block))}
    data = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def members(stream, size: int = 1 << 20):
    """The decompressed gzip members of a stream, one at a time."""
    rest = b""
    while True:
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof:
            if not rest and not (rest := stream.read(size)):
                if out:
                    raise ValueError("the archive ends within a record")
                return
            out.append(unpack.decompress(rest))
            rest = unpack.unused_data
        yield b"".join(out)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields, by lower-case name, and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a record: {version[:40]}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return fields, rest[: int(fields["content-length"])]


def _line(url: str | None) -> str:
    """A url as a header's value: no line breaks."""
    return "".join(c if c >= " " and c != "\x7f" else "%%%02X" % ord(c) for c in url or "")


def _id(capture: int | str, part: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'capture/{capture}/{part}')}"


def first_captures(pages: DataFrame) -> DataFrame:
    """For each payload (hash, size): the smallest page_id, how many rows have both, and how many rows ``n`` have the payload."""
    each = pages.groupBy("hash", "size", "page_id").agg(F.count("*").alias("rows"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "rows")).alias("first")
    return each.groupBy("hash", "size").agg(first, F.sum("rows").alias("n")).select("hash", "size", F.col("first.page_id").alias("first"), F.col("first.rows").alias("n_first"), "n")


def write_archives(pages: DataFrame, uri: str, least_bytes: int = 0) -> DataFrame:
    """Writes the archives under ``uri``, a folder that executors share; the manifest: path, captures, bytes.

    Payloads below ``least_bytes`` are all responses. The first captures of common payloads are broadcast, and pages that
    revisit one pass on without their html; the others meet theirs in a join.
    """
    with scratch():
        return _write_archives(pages, uri, least_bytes)


def _write_archives(pages: DataFrame, uri: str, least_bytes: int) -> DataFrame:
    html, key = F.coalesce(F.col("html"), F.lit("")).cast("binary"), ["hash", "size"]
    keyed = pages.select("page_id", "url", "html", F.sha1(html).alias("hash"), F.octet_length(html).alias("size"))
    firsts = stage(first_captures(keyed.select("page_id", *key)), "first-captures")
    hot = hot_keys(firsts, firsts.agg(F.sum("n")).first()[0] or 0)
    if hot is None:
        joined = keyed.join(firsts, key)
    else:
        few = F.broadcast(hot.drop("parts"))  # bounded, see hot_keys
        joined = keyed.join(few, key).unionByName(keyed.join(few, key, "left_anti").join(firsts, key))
    small = F.col("size") < least_bytes
    first, n_first = F.when(small, F.col("page_id")).otherwise(F.col("first")), F.when(small, 0).otherwise(F.col("n_first"))
    is_first = F.col("page_id").eqNullSafe(first)
    rows = joined.select(F.monotonically_increasing_id().alias("capture"), "page_id", "url", F.when(is_first, F.col("html")).alias("html"), "hash", "size", is_first.alias("is_first"), first.alias("first"), n_first.alias("n_first"))

    def write(batches):
        part, k, out, done, total, captures = TaskContext.get().partitionId(), 0, None, 0, 0, 0
        for b in batches:
            for capture, page_id, url, html, hash_, size, is_first, first, n_first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    fs, base = filesystem(uri)
                    fs.create_dir(base, recursive=True)
                    name = f"part-{part:07d}-{k:04d}-{uuid.uuid4().hex}.warc.gz"
                    out, total, captures, done = fs.open_output_stream(f"{base}/{name}", compression=None), 0, 0, 0
                target = _line(url)
                named = f"first/{hash_}/{size}/{first}" if n_first == 1 else None  # known to the revisits
                own = _id(named if is_first and named else capture, "response")
                fields = {"WARC-Target-URI": target, "WARC-Payload-Digest": f"sha1:{base64.b32encode(bytes.fromhex(hash_)).decode()}"}
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                if is_first:
                    payload = (html or "").encode("utf-8", "surrogatepass")
                    block = head + b"Content-Length: %d\r\n\r\n" % size + payload
                    main = record("response", own, fields | {"Content-Type": "application/http; msgtype=response"}, block)
                else:
                    refers = {"WARC-Profile": REVISIT, "Content-Type": "application/http; msgtype=response"} | ({"WARC-Refers-To": f"<{_id(named, 'response')}>"} if named else {})
                    main = record("revisit", own, fields | refers, head + b"\r\n")
                beside = {"WARC-Concurrent-To": f"<{own}>", "WARC-Target-URI": target}
                ask = record("request", _id(capture, "request"), beside | {"Content-Type": "application/http; msgtype=request"}, f"GET {target} HTTP/1.1\r\n\r\n".encode())
                about = [f"capture: {capture}", *([f"page-id: {page_id}"] if page_id is not None else []), f"payload-length: {size}", *([f"refers-to-page: {first}"] if not is_first else [])]
                meta = record("metadata", _id(capture, "metadata"), beside | {"Content-Type": "application/warc-fields"}, "".join(x + "\r\n" for x in about).encode())
                for x in (ask, main, meta):
                    out.write(x)
                    total += len(x)
                done, captures = done + (size if is_first else 0), captures + 1
                if max(done, total) >= FILE_BYTES:
                    out.close()
                    yield pa.RecordBatch.from_pydict({"path": [f"{uri}/{name}"], "captures": [captures], "bytes": [total]})
                    out, k = None, k + 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{uri}/{name}"], "captures": [captures], "bytes": [total]})

    return stage(rows.mapInArrow(write, "path string, captures long, bytes long"), "archives", keep=True)


def read_records(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """A row per record of the archives; with ``payload`` false the bytes are read and measured but not returned."""
    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in RECORDS.split(", "))])

    def row(fields: dict, block: bytes) -> dict:
        kind, out = fields["warc-type"], {}
        bare = lambda k: fields[k].strip("<>") if k in fields else None
        if kind == "response":
            body = block.partition(b"\r\n\r\n")[2]
            out = {"payload_bytes": len(body), "payload_digest": digest(body), "payload": body if payload else None}
            if fields["warc-payload-digest"] != f"sha1:{out['payload_digest']}":
                raise ValueError(f"{fields['warc-record-id']}: the payload differs from its digest")
        elif kind == "revisit":
            out = {"payload_digest": fields["warc-payload-digest"].removeprefix("sha1:")}
        elif kind == "metadata":
            own = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if x)
            out = {"capture": int(own["capture"]), "page_id": int(own["page-id"]) if "page-id" in own else None, "payload_bytes": int(own["payload-length"]), "refers_to": own.get("refers-to-page")}
        return {"warc_type": kind, "record_id": bare("warc-record-id"), "concurrent_to": bare("warc-concurrent-to"), "refers_to": bare("warc-refers-to"), "target": fields.get("warc-target-uri"), "length": len(block)} | out

    def read(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = filesystem(path)
                rows, size = [], 0
                with fs.open_input_stream(at, compression=None) as f:
                    for data in members(f):
                        rows.append(row(*parse(data)))
                        size += len(data)
                        if size > 8 << 20 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    n = max(1, manifest.count())
    return manifest.select("path").repartition(n).mapInArrow(read, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: response (or revisit) with the request and the metadata concurrent to it."""
    main = records.filter(F.col("warc_type").isin("response", "revisit")).select("record_id", "target", F.struct("warc_type", "payload_bytes", "payload_digest", "refers_to", "payload", "length").alias("response"))
    request = records.filter("warc_type = 'request'").select(F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id").alias("id"), "length").alias("request"))
    metadata = records.filter("warc_type = 'metadata'").select(F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id").alias("id"), "capture", "page_id", "payload_bytes", F.col("refers_to").cast("long").alias("refers_to_page")).alias("metadata"))
    return main.join(request, "record_id", "left").join(metadata, "record_id", "left")


def captures(spark: SparkSession, pages: DataFrame, payload: bool = False) -> DataFrame:
    """Archives written and read back: page_id, payload_bytes, payload_digest, record_type, refers_to of each row."""
    records = stage(read_records(write_archives(pages, fresh(spark, "warc")), payload), "records")
    return assemble(records).select(F.col("metadata.page_id").alias("page_id"), F.coalesce("response.payload_bytes", "metadata.payload_bytes").alias("payload_bytes"), "response.payload_digest", F.col("response.warc_type").alias("record_type"), F.col("metadata.refers_to_page").alias("refers_to"))
