"""WARC archives: writing, normalising monolithic gzip files, and reading by offset.

Records are first written the way crawlers often leave them: one gzip stream per file (Spark's text writer with
gzip; the record separator of the format is its line separator). The normaliser inflates each such file once,
as a stream, rewrites every record as a gzip member of its own and writes a sidecar index beside the archive,
one JSON line per record. The index also comes back as a table; a record is read by seeking to its offset.

An attempt of a task writes to names of its own and only the committed attempt's index rows are used, so lost
executors leave nothing but unused files. Files are reached through ``pyarrow.fs`` from the URI of the shared
folder. Memory: one input file's compressed bytes, one record, and a buffer.

Defined results: a NULL or empty page is a response with an empty payload; pages of equal payloads of at least
``LEAST_REVISIT`` bytes are revisits of the one with the largest page_id (rows that repeat that page_id are all
responses; a NULL page_id never is the one revisited while another exists); an empty table gives no archive and
no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from underwrite.session import materialize, scratch_path

LEAST_REVISIT = 1000
#: The archive's fixed capture time: records depend on their pages only.
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"
LEVEL = 4
INDEX = "archive string, offset long, length long, record_id string, record_type string"


def classify(pages: DataFrame) -> DataFrame:
    """page_id, url, html -> also digest, payload_bytes, record_type, refers_to.

    Only pages with a partner need a decision; they are found from digests, without the payloads.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    known = pages.select("page_id", "url", payload.alias("html"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    first = (
        known.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("digest", "payload_bytes")
        .agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null").select("digest", "payload_bytes", "keeper")
    )
    joined = known.join(first, ["digest", "payload_bytes"], "left")
    again = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return joined.select(
        "page_id", "url", "html", "digest", "payload_bytes",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("keeper")).alias("refers_to"),
    )


def record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.lit("page"), page_id.cast("string"), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))


def records(classified: DataFrame) -> DataFrame:
    """One string per record: header and block, without the closing blank lines."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", record_id(F.col("page_id"), F.col("digest"))),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20]", "")), F.lit("")), line("WARC-Date", F.lit(DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), F.coalesce(line("Page-ID", F.col("page_id").cast("string")), F.lit("")),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", record_id(F.col("refers_to"), F.col("digest"))), line("Refers-To-Page-ID", F.col("refers_to").cast("string")),
        )).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"),
    )
    return classified.select(F.concat(head, block).alias("value"))


def write_monolithic(recs: DataFrame, path: str) -> None:
    """One gzip stream per file."""
    recs.write.option("compression", "gzip").option("lineSep", END.decode()).text(path)


def stream_records(compressed: bytes | memoryview, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Records of a gzip file (one stream, or several members) without their closing blank lines."""
    inflater = zlib.decompressobj(31)
    buffer, view, at = bytearray(), memoryview(compressed), 0
    need = None  # bytes of the record at the front of the buffer, once its header is read
    while True:
        while True:
            if need is None:
                head = buffer.find(END)
                if head < 0:
                    break
                sizes = [h.split(b":", 1)[1] for h in bytes(buffer[:head]).split(b"\r\n")[1:] if h[:15].lower() == b"content-length:"]
                if not buffer.startswith(b"WARC/") or len(sizes) != 1:
                    raise ValueError("not a WARC record")
                need = head + 4 + int(sizes[0])
            if len(buffer) < need + 4:
                break
            if buffer[need : need + 4] != END:
                raise ValueError("a record does not end where its length says")
            yield bytes(buffer[:need])
            del buffer[: need + 4]
            need = None
        if inflater.eof:
            rest = inflater.unused_data
            if not rest:
                at_end = at >= len(view)
                if at_end:
                    break
            inflater = zlib.decompressobj(31)
            if rest:
                buffer += inflater.decompress(rest)
                continue
        if at >= len(view):
            break
        buffer += inflater.decompress(view[at : at + chunk])
        at += chunk
    if buffer or not inflater.eof and len(view):
        raise ValueError("the archive is cut off")


def fields(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block."""
    head, _, block = record.partition(END)
    pairs = (h.split(b":", 1) for h in head.split(b"\r\n")[1:])
    return {k.decode().strip().lower(): v.decode().strip() for k, v in pairs}, block


def member(record: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(record + END) + packer.flush()


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite every ``*.gz`` file below ``source`` as an archive with an index below ``target``; the index rows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path", "content")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                store, root = fs.FileSystem.from_uri(target)
                store.create_dir(root)
                stem = os.path.basename(batch.column(0)[row].as_py()).split(".")[0]
                name = f"{stem}-{uuid.uuid4().hex}"
                out, offset = [], 0
                with store.open_output_stream(f"{root}/{name}.warc.gz", compression=None) as archive:
                    for record in stream_records(batch.column(1)[row].as_buffer()):
                        packed, (head, _) = member(record), fields(record)
                        archive.write(packed)
                        out.append((f"{name}.warc.gz", offset, len(packed), head["warc-record-id"], head["warc-type"]))
                        offset += len(packed)
                with store.open_output_stream(f"{root}/{name}.idx.jsonl") as sidecar:
                    names = [f.split()[0] for f in INDEX.split(", ")]
                    sidecar.write("".join(json.dumps(dict(zip(names, o))) + "\n" for o in out).encode())
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)

    return materialize(files.mapInArrow(run, INDEX), "warc-index")


def read(index: DataFrame, target: str) -> DataFrame:
    """The records behind index rows: page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, payload.

    A response's payload is hashed again and must agree with its header; a revisit has no payload of its own.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, payload binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(target)
        name, archive = None, None
        for batch in batches:
            out, held = [], 0
            for archive_name, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if archive_name != name:
                    name, archive = archive_name, store.open_input_file(f"{root}/{archive_name}")
                archive.seek(offset)
                (record,) = stream_records(archive.read(length))
                head, block = fields(record)
                http, _, payload = block.partition(END)
                size = int(next(h.split(b":")[1] for h in http.split(b"\r\n") if h.lower().startswith(b"content-length:")))
                digest = head["warc-payload-digest"].removeprefix("sha1:")
                if head["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"payload of {head['warc-record-id']} is damaged")
                page, refers = head.get("page-id"), head.get("refers-to-page-id")
                out.append((page and int(page), size, digest, head["warc-type"], refers and int(refers), head["warc-record-id"], payload if head["warc-type"] == "response" else None))
                held += len(payload)
                if held > 1 << 22:
                    yield _rows(out, schema)
                    out, held = [], 0
            if out:
                yield _rows(out, schema)

    return index.select("archive", "offset", "length").mapInArrow(run, schema)


def _rows(out: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    parts = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*out), parts)], names=[n for n, _ in parts])


def archive(pages: DataFrame) -> tuple[DataFrame, str]:
    """Index of the normalised archives of ``pages`` (page_id, url, html), and the folder they are in."""
    spark = pages.sparkSession
    raw, target = scratch_path(spark, "warc-raw"), scratch_path(spark, "warc")
    if "://" not in target and not target.startswith("file:"):
        target = f"file://{target}"
    write_monolithic(records(classify(pages)), raw)
    return normalise(spark, raw, target), target
