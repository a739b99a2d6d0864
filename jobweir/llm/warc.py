"""WARC archives: written with an index first, read back by byte ranges.

``write`` packs each page as a gzip member of a WARC 1.1 file (.warc.gz), one
file for each task, and returns the index: archive, offset, length, URL, digest
and type of every record. Pages whose payload was seen under a smaller id
become revisit records without a body.

``read`` takes any selection of index rows, sorts them by place, merges
neighbours into one byte range while the gap is small, and reads each range
with one request; members are cut out of it by the index.

Archives count only when the index, a Parquet table that Spark commits, names
them; what a lost task wrote is never looked at.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import scratch, small_batches, written
from .token_file import open_store

#: Fixed, so that archives of equal pages are equal.
DATE = "2024-01-01T00:00:00Z"
GAP = 64 << 10
RANGE = 4 << 20
#: Bytes of archives that one task reads.
TASK = 16 << 20

INDEX = (
    "page_id long, archive string, offset long, length long, url string, "
    "payload_digest string, record_type string, refers_to long"
)


def plan_records(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = 100,
) -> DataFrame:
    """pages with digest and refers_to, the page that a revisit stands for.

    Only digests that occur twice or more meet the pages again, so the join is
    small; it is an equi join, which adaptive execution splits where one
    payload has very many copies.
    """
    body = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        body.alias("html"),
        F.sha2(body, 256).alias("digest"),
    )
    first = (
        rows.where(F.octet_length("html") >= min_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest", "first_id")
    )
    repeated = F.col("first_id") < F.col("page_id")
    return rows.join(written(first, "warc-first"), "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(repeated, F.col("first_id")).alias("refers_to")
    )


def _line(name: str, value) -> bytes:
    if value is None:
        return b""
    return f"{name}: {str(value).replace(chr(13), '%0D').replace(chr(10), '%0A')}\r\n".encode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id, url, html: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; the payload is the body of an HTTP response."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    http += _line("Content-Length", len(html)) + b"\r\n"
    block = http if refers_to is not None else http + html
    head = b"WARC/1.1\r\n" + _line("WARC-Type", "response" if refers_to is None else "revisit")
    head += _line("WARC-Record-ID", _urn(page_id)) + _line("WARC-Target-URI", url)
    head += _line("WARC-Date", DATE) + _line("WARC-Payload-Digest", "sha256:" + digest)
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head += _line("WARC-Refers-To", _urn(refers_to)) + _line("WARC-Profile", profile)
    head += _line("Content-Type", "application/http; msgtype=response")
    head += _line("Content-Length", len(block)) + b"\r\n"
    return head + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's parts; payload is None for a revisit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"]

    def page(x: str | None) -> int | None:
        return int(x[10:-1]) if x and x != _urn(None) else None

    revisit = fields["WARC-Type"] == "revisit"
    return {
        "page_id": page(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "payload": None if revisit else payload,
        "payload_bytes": int(size) if revisit else len(payload),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:")
        if revisit
        else hashlib.sha256(payload).hexdigest(),
        "record_type": fields["WARC-Type"],
        "refers_to": page(fields.get("WARC-Refers-To")),
    }


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _write(folder: str):
    schema = pa.schema(
        [("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()),
         ("length", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()),
         ("record_type", pa.string()), ("refers_to", pa.int64())]
    )

    def run(batches):
        out, at = None, 0
        for b in batches:
            if b.num_rows and out is None:
                path = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                store, place = open_store(path)
                store.create_dir(place.rpartition("/")[0], recursive=True)
                out = store.open_output_stream(place, compression=None)
            rows = []
            for i in range(b.num_rows):
                page_id, url, html, digest, refers_to = (c[i].as_py() for c in b.columns)
                data = _gzip(record(page_id, url, html.encode(), digest, refers_to))
                out.write(data)
                kind = "response" if refers_to is None else "revisit"
                rows.append((page_id, path, at, len(data), url, digest, kind, refers_to))
                at += len(data)
            cols = list(zip(*rows)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema
            )
        if out is not None:
            out.close()

    return run


def write(
    pages: DataFrame,
    folder: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = 100,
) -> DataFrame:
    """Write all pages; returns the index, one row for each record.

    Of records with equal payloads of at least min_bytes bytes, those with the
    smallest page_id are responses and the others revisits. Defined cases: null
    html is an empty payload; a null url leaves the header out; a null page_id
    is always a response; rows that repeat the smallest id are all responses;
    an empty table writes no archive and gives an empty index.
    """
    small_batches(pages.sparkSession)
    folder = folder or scratch(pages.sparkSession, "warc")
    rows = plan_records(pages, id_col, url_col, html_col, min_bytes)
    return written(rows.mapInArrow(_write(folder), INDEX), "warc-index")


def ranges(index: DataFrame, gap: int = GAP, most: int = RANGE) -> DataFrame:
    """(archive, lo, hi, records): selected records merged into byte ranges.

    A range ends where the next record starts over gap bytes later, and at each
    multiple of most bytes, so that no read grows with the archive.
    """
    w = Window.partitionBy("archive").orderBy("offset")
    cut = (F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(w) > gap) | (
        F.floor(F.col("offset") / most) != F.floor(F.lag("offset").over(w) / most)
    )
    return (
        index.select("archive", "offset", "length", F.coalesce(cut, F.lit(True)).cast("int").alias("c"))
        .withColumn("range", F.sum("c").over(w))
        .groupBy("archive", "range")
        .agg(
            F.min("offset").alias("lo"),
            F.max(F.col("offset") + F.col("length")).alias("hi"),
            F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"),
        )
    )


def _read(with_payload: bool):
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string())]
        + ([("payload", pa.string())] if with_payload else [])
        + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
           ("record_type", pa.string()), ("refers_to", pa.int64())]
    )

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                store, place = open_store(r["archive"])
                with store.open_input_file(place) as f:
                    data = f.read_at(r["hi"] - r["lo"], r["lo"])
                rows = []
                for x in r["records"]:
                    at = x["offset"] - r["lo"]
                    found = parse(zlib.decompress(data[at : at + x["length"]], 31))
                    if with_payload and found["payload"] is not None:
                        found["payload"] = found["payload"].decode()
                    rows.append({n: found[n] for n in schema.names})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read(index: DataFrame, with_payload: bool = False, gap: int = GAP) -> DataFrame:
    """The records of a selection of index rows, read from the archives.

    Ranges are dealt to tasks by their bytes, not by the size of the index. An
    empty selection gives no rows; a row that repeats in it is read each time.
    """
    columns = "page_id long, url string, " + "payload string, " * with_payload
    columns += "payload_bytes long, payload_digest string, record_type string, refers_to long"
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, math.ceil(total / TASK))
    return ranges(index, gap).repartition(tasks, "archive", "lo").mapInArrow(_read(with_payload), columns)
