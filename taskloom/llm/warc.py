"""WARC archives with an index first (operator 10).

Writing: each task appends its records, each a gzip member of its own, to archive files in a folder that all
executors share, and returns an index row per record: file, offset, length, URL, digest and type. A task that
runs again writes files under new names, and the index holds only the names of the task that won.

Reading: the index says which bytes to fetch. The selected index rows are dealt out by file and offset,
sorted, and neighbouring records are fetched with one read as long as the gap and the read stay under
their limits. A whole archive is never read to find a few records in it.

Revisits: of records with equal payloads (SHA-256 and length) the one with the largest id is the response; the
others carry headers only and name it. Owners come from one partial aggregation over digests; the join
back deals the rows of a hot digest out to many tasks (``join_owners``).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import join_owners, shuffle_partitions, stored, table, work_dir

#: An archive file is closed when it has this many bytes.
FILE_BYTES = 64 << 20
#: One read spans at most this many bytes (or one record), and bridges gaps up to that many.
READ_BYTES, GAP_BYTES = 8 << 20, 64 << 10

_INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string())])
_INDEX_SQL = "file string, offset long, length long, page_id long, url string, digest string, record_type string"
_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
_RECORD_SQL = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


#: Spark's names of stores that pyarrow knows by another one.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """(file system, path) of a folder as Spark names it: local paths, file, hdfs, viewfs, s3 (s3a, s3n), gs and abfs."""
    scheme, colon, rest = folder.partition("://")
    if not colon:
        scheme, rest = ("file", folder.removeprefix("file:")) if folder.startswith(("/", "file:")) else (folder.partition(":")[0], "")
    known = f"{_SCHEMES.get(scheme, scheme)}://{rest}"
    try:
        return fs.FileSystem.from_uri(known)
    except pa.ArrowInvalid as e:
        raise ValueError(f"archives cannot be written to {folder}: no file system is known for {scheme}; spark.checkpoint.dir has to lie in a local or shared folder, HDFS, S3, GCS or Azure") from e


def _line(value: str | None) -> str | None:
    """A header's value has no line breaks: they are percent-encoded."""
    return None if value is None else value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unline(value: str | None) -> str | None:
    return None if value is None else value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def _record_id(n: int | None) -> str:
    return f"<urn:page:{'' if n is None else n}>"


def write_record(page_id, url, kind, refers_to, payload: bytes, digest: str, date: str) -> bytes:
    """One record as a gzip member. A revisit's block is empty; its headers keep the digest and size of the payload."""
    block = payload if kind == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def parse_record(member: bytes) -> dict:
    """The fields of one gzip member; a payload that does not fit its digest raises."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(h["Content-Length"])]
    number = lambda x: int(x[len("<urn:page:") : -1]) if len(x) > len("<urn:page:>") else None
    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
    out = {"page_id": number(h["WARC-Record-ID"]), "url": _unline(h.get("WARC-Target-URI")), "record_type": h["WARC-Type"], "refers_to": number(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None, "payload_bytes": int(h["X-Payload-Length"]), "payload_digest": digest, "payload": block if h["WARC-Type"] == "response" else None}
    if out["payload"] is not None and base64.b32encode(hashlib.sha1(block).digest()).decode() != digest:
        raise ValueError(f"record {out['page_id']}: the payload does not fit its digest")
    return out


def mark_revisits(pages: DataFrame, min_revisit_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload, record_type, refers_to, one row per row of ``pages``."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumns({"sha": F.sha2("payload", 256), "size": F.octet_length("payload")})
    # payloads that occur once are responses: only ids of repeated ones are joined back
    owners = rows.groupBy("sha", "size").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) & (F.col("size") >= min_revisit_bytes))
    marked = join_owners(rows, owners, ["sha", "size"], "n", "left")
    revisit = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    return marked.select("page_id", "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("owner")).alias("refers_to"))


def write_warc(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write page_id, url, payload, record_type, refers_to below ``folder``; returns the index, itself stored."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, path = opened(folder)
        store.create_dir(path, recursive=True)
        out, name, at, n = None, None, 0, 0
        try:
            for batch in batches:
                index = []
                for row in batch.to_pylist():
                    if out is None:
                        name = f"part-{context.partitionId():06d}-{n:04d}-{uuid.uuid4().hex}.warc.gz"
                        out, at, n = store.open_output_stream(f"{path}/{name}", compression=None), 0, n + 1
                    digest = base64.b32encode(hashlib.sha1(row["payload"]).digest()).decode()
                    member = write_record(row["page_id"], row["url"], row["record_type"], row["refers_to"], row["payload"], digest, date)
                    out.write(member)
                    index.append({"file": name, "offset": at, "length": len(member), "page_id": row["page_id"], "url": row["url"], "digest": digest, "record_type": row["record_type"]})
                    at += len(member)
                    if at >= file_bytes:
                        out.close()
                        out = None
                yield pa.RecordBatch.from_pylist(index, schema=_INDEX)
        finally:
            if out is not None:
                out.close()

    return stored(records.mapInArrow(write, _INDEX_SQL), "warc-index")


def read_warc(index: DataFrame, folder: str, read_bytes: int = READ_BYTES, gap_bytes: int = GAP_BYTES, partitions: int | None = None) -> DataFrame:
    """The records that the rows of ``index`` name, by coalesced range reads; payload is null for revisits."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = opened(folder)

        def read(run: list[tuple]) -> pa.RecordBatch:
            file, start, end = run[0][0], run[0][1], run[-1][1] + run[-1][2]
            with store.open_input_file(f"{path}/{file}") as f:
                data = f.read_at(end - start, start)
            return pa.RecordBatch.from_pylist([parse_record(data[o - start : o - start + n]) for _, o, n in run], schema=_RECORD)

        run: list[tuple] = []
        for batch in batches:
            for x in zip(*(batch[c].to_pylist() for c in ("file", "offset", "length"))):
                if run and (x[0] != run[0][0] or x[1] - (run[-1][1] + run[-1][2]) > gap_bytes or x[1] + x[2] - run[0][1] > read_bytes):
                    yield read(run)
                    run = []
                run.append(x)
        if run:
            yield read(run)

    n = partitions or shuffle_partitions(index)
    places = index.select("file", "offset", "length").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return places.mapInArrow(fetch, _RECORD_SQL)


def archive_round_trip(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages, read all records back: id_col, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload; a null id sorts below all ids and is written without a number; repeated rows
    are separate records; those that repeat the response's id and payload are responses too. No rows give no archive.
    Columns besides these three are not read, whatever their names; a payload of any length is one record and one read."""
    index = write_warc(mark_revisits(pages, min_revisit_bytes, id_col, url_col, html_col), folder)
    return read_warc(index, folder).select(F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"), work_dir(spark, "warc"))


#: The alphabet of base 32; the SQL cuts 160 bits into eight groups of five hexadecimal digits.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS = " || ".join(f"substr('{_BASE32}', ((('0x' || substr(h, {1 + 5 * g}, 5))::BIGINT >> {s}) & 31)::INT + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))
OP10_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, payload, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS h FROM p),
o AS (SELECT payload, max(page_id) AS owner FROM p GROUP BY payload)
SELECT page_id, payload_bytes, {_DIGITS} AS payload_digest,
       CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM d JOIN o ON d.payload = o.payload
"""
