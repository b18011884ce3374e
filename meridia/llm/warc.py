"""WARC archives: written by tasks, indexed first, read back in coalesced byte ranges."""

from __future__ import annotations

import gzip
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch

#: Bytes after which a task begins another file; the most bytes of one read; gaps that a read may span.
ROLL, READ, GAP = 256 << 20, 8 << 20, 64 << 10
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
INDEX = "file string, offset long, length long, page_id long, url string, record_type string, digest string, refers_to long"


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record of WARC 1.1; a revisit has HTTP headers and no payload."""
    block = HTTP + (payload if kind == "response" else b"")
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}')}>"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, lower-cased, and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def _write(base: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(base)
        store.create_dir(root, recursive=True)
        out, name, at = None, None, 0
        try:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    if out is None or at >= ROLL:
                        if out is not None:
                            out.close()
                        # a name of its own for each attempt: the index names whole files of tasks that ended well
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    data = gzip.compress(record(r["page_id"], r["url"], r["payload"], r["record_type"], r["digest"], r["refers_to"], date), 6, mtime=0)
                    out.write(data)
                    rows.append({"file": name, "offset": at, "length": len(data)} | {k: r[k] for k in ("page_id", "url", "record_type", "digest", "refers_to")})
                    at += len(data)
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("digest", pa.string()), ("refers_to", pa.int64())]))
        finally:
            if out is not None:
                out.close()

    return run


def write_archive(pages: DataFrame, *, least: int = 1000, date: str = "1970-01-01T00:00:00Z") -> tuple[str, DataFrame]:
    """(folder, index) of an archive with a record per row of pages(page_id, url, html).

    The payload is html in UTF-8, empty if null. Of equal payloads of at least `least` bytes, that of
    the largest page_id is a response and the others are revisits of it; a null page_id is smaller
    than any other, and rows with the responding page_id itself are all responses. The index has file,
    offset and length of each record, its url, digest, type and refers_to.
    """
    tables = Scratch(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).select("*", F.sha1("payload").alias("digest"))
    twins = rows.where(F.length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").select("digest", "response")
    rows = rows.join(tables.save(twins, "twins").withColumn("twin", F.lit(True)), "digest", "left")
    again = F.coalesce("twin", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("response"))
    rows = rows.select("page_id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("response")).alias("refers_to"))
    return tables.path("files"), tables.save(rows.mapInArrow(_write(tables.path("files"), date), INDEX), "index")


def _read(base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(base)
        name, source, group = None, None, []
        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

        def fetch():
            nonlocal name, source
            if group[0]["file"] != name:
                name, source = group[0]["file"], store.open_input_file(f"{root}/{group[0]['file']}")
            at = group[0]["offset"]
            data, out = memoryview(source.read_at(group[-1]["offset"] + group[-1]["length"] - at, at)), []
            for r in group:
                headers, payload = parse(zlib.decompress(data[r["offset"] - at :][: r["length"]], 31))
                out.append({"page_id": r["page_id"], "record_type": headers["warc-type"], "digest": headers["warc-payload-digest"].removeprefix("sha1:"), "refers_to": r["refers_to"], "payload": payload if headers["warc-type"] == "response" else None})
            return pa.RecordBatch.from_pylist(out, schema)

        for batch in batches:
            for r in batch.to_pylist():
                if group and (r["file"] != group[0]["file"] or r["offset"] - group[-1]["offset"] - group[-1]["length"] > GAP or r["offset"] + r["length"] - group[0]["offset"] > READ):
                    yield fetch()
                    group = []
                group.append(r)
        if group:
            yield fetch()

    return run


def read_records(folder: str, index: DataFrame) -> DataFrame:
    """page_id, record_type, digest, refers_to and payload (null for revisits) of the records in index.

    The rows of the index, all or some, are sorted by place; neighbours come in by one read.
    """
    part = F.floor(F.col("offset") / READ)
    rows = index.repartition("file", part).sortWithinPartitions("file", "offset").select("file", "offset", "length", "page_id", "refers_to")
    return rows.mapInArrow(_read(folder), "page_id long, record_type string, digest string, refers_to long, payload binary")


def round_trip(pages: DataFrame, **how) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all records, from the archive.

    Length and digest of a response are those of the payload that was read; a revisit has those of the
    response that it refers to.
    """
    folder, index = write_archive(pages, **how)
    tables = Scratch(pages.sparkSession, "warc-read")
    read = tables.save(read_records(folder, index).select("page_id", "record_type", "digest", "refers_to", F.length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("sha1")), "records")
    full = tables.save(read.where("record_type = 'response'").select(F.col("sha1").alias("digest"), F.col("page_id").alias("refers_to"), F.col("bytes").alias("full"), F.lit(True).alias("there")).distinct(), "responses")
    again = read.where("record_type = 'revisit'").join(full, ["digest", "refers_to"], "left").select("page_id", F.col("full").alias("payload_bytes"), F.when(F.col("there"), F.col("digest")).alias("payload_digest"), "record_type", "refers_to")
    return read.where("record_type = 'response'").select("page_id", F.col("bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")).union(again)
