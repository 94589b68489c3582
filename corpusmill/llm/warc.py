"""WARC archives: write records, index first, then read selected records by coalesced byte ranges.

Writing: each task streams its rows into one archive of the shared folder, a gzip member a record,
and yields an index row - file, offset, length, URL, digest - for each. An archive's name carries a
fresh identifier, so a repeated task writes another file, and only the files of the attempt whose
index rows were committed are ever read. Reading: the index is selected first, dealt out by file and
offset, and every task reads its sorted ranges, neighbours merged into one read.

Cases: null payload counts as empty; a null URL is written as an empty header; a null id is written
empty and read back as null. Of equal payloads at or above ``revisit_from`` bytes the largest id
holds the response; rows that tie for it are all responses. An empty table writes no archive and
gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stored, table, text_of

REVISIT_FROM = 1000
INDEX = "file string, offset long, length long, url string, digest string, record_type string, id long"
RECORD = "id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
#: Ranges closer than GAP are read together, up to MOST bytes a read.
GAP, MOST = 64 * 1024, 8 * 1024 * 1024
#: Compressed bytes of records that a reading task is given.
TASK_BYTES = 4 * 1024 * 1024
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


_CONTROLS = re.compile(r"[\x00-\x1f\x7f-\x9f\u2028\u2029]|^ | $")


def _clean(value: str | None) -> str:
    """A header value on one line: controls, and spaces at its ends, are percent-escaped; all else stands as it is."""
    return _CONTROLS.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, name: str = "", date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One uncompressed WARC/1.1 record. ``name`` makes its record id unique where page ids repeat. A revisit has no
    body; its referent's page id and the full payload's length stand in its header."""
    body = b"" if refers_to is not None else payload
    heads = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{name}')}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", _clean(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if page_id is not None:
        heads.append(("X-Page-ID", str(page_id)))
    if url is None:
        heads.append(("X-Target-URI-Missing", "true"))
    elif url != _clean(url):  # the page's own spelling, for an exact round trip
        heads.append(("X-Target-URI-UTF8", url.encode().hex()))
    if refers_to is not None:
        heads += [("X-Refers-To-Page-ID", str(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    heads += [("Content-Type", "application/octet-stream"), ("Content-Length", str(len(body)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in heads) + "\r\n"
    return head.encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of one record; raises ValueError where the record is damaged."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    heads = dict(line.split(": ", 1) for line in lines[1:])
    n = int(heads["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record length and Content-Length disagree")
    return heads, rest[:n]


def _filesystem(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def plan_records(pages: DataFrame, id_col="page_id", url_col="url", payload_col="html", revisit_from=REVISIT_FROM) -> DataFrame:
    """id, url, payload (binary), digest and refers_to of the records to write.

    Winners are found on (digest, id) alone, partially aggregated, and only groups of two or more
    come back to the payloads; that table's size decides whether it is broadcast or shuffled, and
    the skew join deals a hot digest out."""
    payload = F.encode(text_of(payload_col), "UTF-8")
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest")
    )
    groups = rows.filter(F.octet_length("payload") >= revisit_from).groupBy("digest")
    winners = groups.agg(F.max("id").alias("winner"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "winner")
    winners = stored(winners, "winners").withColumnRenamed("digest", "d")
    large = F.octet_length("payload") >= revisit_from
    joined = rows.join(winners, (rows["digest"] == winners["d"]) & large, "left")
    refers = F.when(F.col("winner").isNotNull() & ~F.col("id").eqNullSafe(F.col("winner")), F.col("winner"))
    return joined.select("id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write rows of :func:`plan_records` below ``folder``; the stored index of what was written."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        out, name, at = None, f"{uuid.uuid4().hex}.warc.gz", 0
        date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        try:
            for batch in batches:
                rows: list[tuple] = []
                for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None:
                        fs.create_dir(base, recursive=True)
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
                    member = pack.compress(record(page_id, url, payload, digest, refers_to, f"{name}/{at}", date)) + pack.flush()
                    out.write(member)
                    rows.append((name, at, len(member), url, digest, "response" if refers_to is None else "revisit", page_id))
                    at += len(member)
                if rows:
                    yield _batch(rows, INDEX)
        finally:
            if out is not None:
                out.close()

    return stored(records.select("id", "url", "payload", "digest", "refers_to").mapInArrow(write, INDEX), "index")


_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = [pa.array(c, _TYPES[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=[n for n, _ in fields])


def coalesced(ranges: Iterator[tuple[str, int, int]], gap: int = GAP, most: int = MOST) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(file, start, end, members) of sorted (file, offset, length): neighbours share a read."""
    file, start, end, held = "", 0, 0, []
    for f, offset, length in ranges:
        if held and (f != file or offset - end > gap or offset + length - start > most):
            yield file, start, end, held
            held = []
        if not held:
            file, start, end = f, offset, offset
        held.append((offset, length))
        end = max(end, offset + length)
    if held:
        yield file, start, end, held


def read_records(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records that ``index`` names (any selection of index rows), payloads checked against their
    digest. Ranges are dealt out by file and offset, so that each task reads forward."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        ranges = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        opened, source = "", None
        rows: list[tuple] = []
        held = 0
        for file, start, end, members in coalesced(ranges):
            if file != opened:
                if source is not None:
                    source.close()
                opened, source = file, fs.open_input_file(f"{base}/{file}")
            source.seek(start)
            data = source.read(end - start)
            for offset, length in members:
                heads, body = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                rows.append(_row(heads, body, with_payload))
                held += len(body) if with_payload else 0
                if len(rows) >= 4096 or held > MOST:
                    yield _batch(rows, RECORD)
                    rows, held = [], 0
        if source is not None:
            source.close()
        if rows:
            yield _batch(rows, RECORD)

    # As many tasks as the ranges' bytes ask for; the index itself is small.
    size = index.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first().n
    tasks = max(1, math.ceil(size / TASK_BYTES))
    places = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return places.mapInArrow(read, RECORD)


def _row(heads: dict[str, str], body: bytes, with_payload: bool) -> tuple:
    number = lambda name: int(heads[name]) if name in heads else None
    kind, digest = heads["WARC-Type"], heads["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response":
        n, found = len(body), hashlib.sha1(body).hexdigest()
        if found != digest:
            raise ValueError(f"payload of {heads['WARC-Record-ID']} has SHA-1 {found}, not {digest}")
    else:
        n = number("X-Payload-Length")
    own = heads.get("X-Target-URI-UTF8")
    url = None if "X-Target-URI-Missing" in heads else bytes.fromhex(own).decode() if own else heads["WARC-Target-URI"]
    return number("X-Page-ID"), url, kind, n, digest, number("X-Refers-To-Page-ID"), body if with_payload and kind == "response" else None


def op10_warc(spark, sf_dir):
    folder = f"{shared_dir(spark)}/corpusmill/warc-{uuid.uuid4().hex}"
    index = write_archives(plan_records(table(spark, sf_dir, "pages")), folder)
    back = read_records(index, folder, with_payload=False)
    return back.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


OP10_SQL = """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, url, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p
), w AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS winner FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN winner IS NULL OR page_id IS NOT DISTINCT FROM winner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM winner THEN winner END AS refers_to,
       url
FROM w
"""
