"""WARC archives: a writer on Spark's text sink and a salvaging reader.

Every record is a gzip member of its own.  The reader checks each member and
record (gzip checksum, header, length, digest).  After a failed check it searches
for the next valid member or version line, goes on from there, and reports the
bytes in between as a quarantined gap.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import drop_table, shared_path, stage_table

MIN_SHARED = 100  # bytes of payload from which equal payloads are written once
RECORDS_PER_FILE = 4000  # bounds what a task holds when it reads an archive
DATE = "1970-01-01T00:00:00Z"
# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = b"WARC/1."
_FIRST = re.compile(rb"WARC/1\.[01]\r\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
GZIP = b"\x1f\x8b\x08"
END = b"\r\n\r\n"
FEED = 16 << 10  # bytes given to the decompressor at once: what a member leaves over is copied
# An empty gzip member: the text sink puts it between records, readers skip it.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to, size: int) -> bytes:
    """One WARC record; a revisit (``refers_to`` given) leaves out the payload."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {size}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    name = "" if page_id is None else page_id
    target = re.sub(r"[\r\n]+", " ", url or "")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}",
            f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


def _members(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            out = [gzip.compress(record_bytes(i, u, (h or "").encode(), d, r, n), level, mtime=0)
                   for i, u, h, d, n, r in zip(rows["page_id"], rows["url"], rows["html"],
                                               rows["digest"], rows["size"], rows["refers_to"])]
            yield pa.record_batch([pa.array(out, pa.binary())], ["member"])
    return run


def write_warc(pages: DataFrame, path: str, min_shared: int = MIN_SHARED, level: int = 6) -> None:
    """Write one record for each page to gzipped archives under ``path``.

    ``pages`` has ``page_id``, ``url`` and ``html``; other columns are ignored.
    The payload is the html in UTF-8 (null: empty).  Of equal payloads of at
    least ``min_shared`` bytes the one with the smallest page_id is a response
    and the others revisit it; if rows repeat that page_id, one of those with the
    smallest url (null first) is the response and the rest revisit it.  Rows with a
    null ``page_id`` are responses.  The sink's commit keeps files whole when an
    executor is lost.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"))
    body = F.coalesce("html", F.lit(""))
    rows = rows.withColumn("digest", F.sha2(body, 256)).withColumn("size", F.octet_length(body))
    shared = F.col("size") >= min_shared
    least = F.min(F.struct("page_id", "n"))
    heads = stage_table(
        rows.where(shared & F.col("page_id").isNotNull())
        .groupBy("digest", "page_id").agg(F.count("*").alias("n"))
        .groupBy(F.col("digest").alias("same")).agg(least.alias("least"), F.sum("n").alias("all"))
        .where("all > 1").select("same", F.col("least.page_id").alias("head"), F.col("least.n").alias("times")),
        "heads")
    # small payloads look for nothing, each under a key of its own
    key = F.when(shared, F.col("digest")).otherwise(F.concat(F.lit("page "), F.col("page_id")))
    found = (rows.withColumn("same", key).join(heads, "same", "left")
             .withColumn("refers_to", F.when(F.col("head") != F.col("page_id"), F.col("head"))))
    several = heads.where("times > 1")
    if not several.isEmpty():
        again = F.coalesce((F.col("head") == F.col("page_id")) & (F.col("times") > 1), F.lit(False))
        found = found.where(~again).select(*rows.columns, "refers_to").unionByName(
            _repeated_heads(rows.where(shared), several))
    (found.select("page_id", "url", "html", "digest", "size", "refers_to")
     .mapInArrow(_members(level), "member binary")
     .select(F.col("member").cast("string").alias("value"))
     .write.mode("errorifexists").option("encoding", "ISO-8859-1")
     .option("lineSep", EMPTY_MEMBER.decode("latin-1"))
     .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))
    drop_table(heads)


def _repeated_heads(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Rows of a response's page_id that repeat it: one response, the others revisit it.

    Equal rows are counted before they are dealt, so a page that fills the table is one row.
    """
    at = (F.col("digest") == F.col("same")) & (F.col("page_id") == F.col("head"))
    kinds = (rows.join(heads, at).groupBy("digest", "page_id", "url")
             .agg(F.min("html").alias("html"), F.min("size").alias("size"), F.count("*").alias("n")))
    least = kinds.groupBy("digest", "page_id").agg(F.min(F.struct("url")).alias("least"))
    kinds = (kinds.join(least, ["digest", "page_id"])
             .withColumn("lead", F.col("url").eqNullSafe(F.col("least.url"))))
    one = kinds.where("lead").select(*rows.columns, F.lit(None).cast("long").alias("refers_to"))
    rest = (kinds.withColumn("more", F.col("n") - F.col("lead").cast("long")).where("more > 0")
            .withColumn("k", F.explode(F.sequence(F.lit(1), F.col("more")))))
    return one.unionByName(rest.select("page_id", "url", F.lit(None).cast("string").alias("html"), "digest", "size",
                                       F.col("page_id").alias("refers_to")))


class Record(NamedTuple):
    """A parsed record, or a gap (``kind`` gap) with what failed in ``note``."""

    kind: str
    offset: int
    length: int
    headers: dict
    payload: bytes
    note: str


class Damaged(ValueError):
    """A check failed at this place."""


def parse_record(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """(headers, block, end) of the record at ``at``; raises Damaged."""
    if not _FIRST.match(data, at):
        raise Damaged("version line")
    headers = {}
    lo = data.find(b"\r\n", at) + 2
    while True:  # line by line: a header may be of any length, a bad line ends the search
        stop = data.find(b"\r\n", lo)
        if stop < 0:
            raise Damaged("header has no end")
        if stop == lo:
            break
        name, colon, value = data[lo:stop].partition(b":")
        if not colon:
            raise Damaged("header line")
        headers[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
        lo = stop + 2
    if not headers.get("content-length", "").isdigit():
        raise Damaged("content length")
    lo = stop + 2
    hi = lo + int(headers["content-length"])
    if data[hi:hi + len(END)] != END:
        raise Damaged("record end")
    block = data[lo:hi]
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha256:") and hashlib.sha256(block).hexdigest() != digest[7:]:
        raise Damaged("block digest")
    return headers, block, hi + len(END)


def _payload(headers: dict, block: bytes) -> bytes:
    """The payload of a block; notes the length that an HTTP header declares."""
    if not headers.get("content-type", "").startswith("application/http"):
        return block
    head, _, body = block.partition(END)
    declared = re.search(rb"(?im)^content-length:\s*(\d+)", head)
    if declared:
        headers["http-length"] = declared[1].decode()
    return body


def _next_start(data: bytes, at: int) -> int:
    """The next place at or after ``at`` where a member or a version line may begin."""
    found = _START.search(data, at)
    return found.start() if found else len(data)


def read_member(data: bytes, at: int) -> tuple[bytes, int]:
    """(content, end) of the gzip member at ``at``; raises Damaged."""
    view, engine, out = memoryview(data), zlib.decompressobj(31), []
    while not engine.eof:
        piece = view[at:at + FEED]
        if not piece:
            raise Damaged("member: cut off")
        try:
            out.append(engine.decompress(piece))
        except zlib.error as e:
            raise Damaged(f"member: {e}") from None
        at += len(piece)
    return b"".join(out), at - len(engine.unused_data)


def salvage(data: bytes, inner: bool = False) -> Iterator[Record]:
    """All valid records of an archive and the gaps between them.

    ``inner`` marks the content of a member, which holds no members itself.
    """
    at, bad, note = 0, -1, ""
    while at < len(data):
        try:
            if data.startswith(VERSION, at):
                headers, block, end = parse_record(data, at)
                found = [Record("record", at, end - at, headers, _payload(headers, block), "")]
            elif not inner and data.startswith(GZIP, at):
                body, end = read_member(data, at)
                found = [r._replace(offset=at, length=end - at) if r.kind == "record" else
                         r._replace(offset=at, length=end - at, note=f"in member: {r.note}")
                         for r in salvage(body, True)]
            else:
                raise Damaged("no member or version line")
        except Damaged as e:
            if bad < 0:
                bad, note = at, str(e)
            at = _next_start(data, at + 1)
            continue
        if bad >= 0:
            yield Record("gap", bad, at - bad, {}, b"", note)
            bad = -1
        yield from found
        at = end
    if bad >= 0:
        yield Record("gap", bad, len(data) - bad, {}, b"", note)


_SCHEMA = ("kind string, path string, offset long, length long, record_type string, record_id string, "
           "refers_to string, target_uri string, payload binary, payload_bytes long, "
           "payload_digest string, note string")


def _read(keep_payload: bool):
    names = [f.split()[0] for f in _SCHEMA.split(", ")]

    def rows(path: str, data: bytes) -> Iterator[tuple]:
        for r in salvage(data):
            h = r.headers
            kind, note = r.kind, r.note
            digest = hashlib.sha256(r.payload).hexdigest()
            size = len(r.payload)
            if kind == "record":
                told = h.get("warc-payload-digest", "")
                if h.get("warc-type") == "revisit":
                    digest = told.removeprefix("sha256:")
                    size = int(h["http-length"]) if "http-length" in h else None
                elif told.startswith("sha256:") and told[7:] != digest:
                    kind, note = "gap", "payload digest"
            if kind == "gap":
                yield (kind, path, r.offset, r.length, *[None] * 7, note)
            else:
                yield (kind, path, r.offset, r.length, h.get("warc-type"), h.get("warc-record-id"),
                       h.get("warc-refers-to"), h.get("warc-target-uri"),
                       r.payload if keep_payload else None, size, digest, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
        kinds = [types[f.split()[1]] for f in _SCHEMA.split(", ")]
        for batch in batches:
            for i in range(batch.num_rows):
                out, held = [], 0
                for row in rows(batch.column(0)[i].as_py(), batch.column(1)[i].as_py()):
                    out.append(row)
                    held += len(row[8] or b"")
                    if held > 1 << 24:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                        out, held = [], 0
                if out:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
    return run


def read_warc(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """Records and gaps of the archives under ``path``.

    ``kind`` is record or gap; gaps carry the byte range that was skipped and,
    in ``note``, the check that failed.  Files are read whole through Spark, so
    any store that Spark reads will do; archives from other writers should hold
    at most a few hundred MB each.  For a revisit the payload's size comes from
    the response's own header, which the record keeps.  Empty files give no rows.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_read(keep_payload), _SCHEMA)


def quarantine_log(parsed: DataFrame, path: str) -> None:
    """Write the gaps as JSON lines."""
    parsed.where("kind = 'gap'").select("path", "offset", "length", "note").write.json(path)


def page_archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` to archives and read them back, one row for each page.

    Null html is an empty payload; null and repeated page_ids come back as often
    as they went in; an empty table gives an empty result.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to.
    """
    spark = pages.sparkSession
    path = path or shared_path(spark, f"warc-{uuid.uuid4().hex}")
    write_warc(pages, path)
    number = r"^<urn:page:(-?\d+)>$"
    parsed = read_warc(spark, path, keep_payload=False).where("kind = 'record'")
    pick = lambda c: F.nullif(F.regexp_extract(c, number, 1), F.lit("")).cast("long")
    return parsed.select(pick("record_id").alias("page_id"), "payload_bytes", "payload_digest",
                         "record_type", pick("refers_to").alias("refers_to"))
