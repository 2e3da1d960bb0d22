"""WARC archives: a writer with revisit records, and a reader that salvages what a damaged archive still holds.

Each record is a gzip member of its own. Spark's text writer puts the members on whatever store holds the shared
folder; an empty gzip member, which every gzip reader passes over, stands between two records as its line
separator. The reader checks each member and record (CRC, lengths, digests of block and payload); after a failed check it searches for
the next version line in a member's content, then for the next gzip member or version line, goes on there, and logs the
bytes between as a quarantined gap. Of a broken member it keeps the records that pass their own checks.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import left_join_hot, prepared, scratch, table, written

REVISIT_FROM = 100
#: Payload bytes meant for one archive file.
FILE_BYTES = 24 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
ENCODED = re.compile(rb"(?i)\r\n(?:transfer|content)-encoding:")
PAGE = re.compile(r"<urn:page:(-?\d+)>")
MAGIC = b"\x1f\x8b\x08"
#: Bytes inflated at once.
PIECE = 65536


def member(data: bytes, level: int = 5) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


#: As text in ISO-8859-1, so that the writer's line separator is these bytes.
SEPARATOR = member(b"").decode("latin-1")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None) -> bytes:
    """One record; a revisit has no payload but its length and digest."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}"] if url else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    offset: int


class Damaged(ValueError):
    """A check failed."""


def differs(said: str, data: bytes) -> bool:
    """Whether a digest header, of an algorithm that is known here and in hex or base 32, is not that of the data."""
    name, _, value = said.partition(":")
    if name.lower() not in ("sha1", "sha256", "md5") or not value:
        return False
    got = hashlib.new(name.lower(), data).digest()
    return value.lower() != got.hex() and value.upper().rstrip("=") != base64.b32encode(got).decode().rstrip("=")


def payload_of(headers: dict[str, str], block: bytes) -> tuple[bytes, bytes]:
    """HTTP head and payload of a record; records of other content are all payload."""
    if headers.get("content-type", "").lower().startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        return head, payload
    return b"", block


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at a place; raises Damaged."""
    if not VERSION.match(data, at):
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damaged("headers without an end")
    try:
        headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in data[at:end].decode("utf-8").split("\r\n")[1:])}
        size = int(headers["content-length"])
    except (ValueError, KeyError) as e:
        raise Damaged("malformed headers") from e
    start = end + 4
    if size < 0 or data[start + size : start + size + 4] != b"\r\n\r\n":
        raise Damaged("wrong length")
    block = data[start : start + size]
    if differs(headers.get("warc-block-digest", ""), block):
        raise Damaged("wrong block digest")
    head, payload = payload_of(headers, block)
    # a revisit has no payload, and which form of an encoded one a foreign digest is of can't be told
    if headers.get("warc-type") != "revisit" and not ENCODED.search(head) and differs(headers.get("warc-payload-digest", ""), payload):
        raise Damaged("wrong payload digest")
    return headers, block, start + size + 4


def inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """Content of the gzip member at a place as far as it goes, its end, and what failed (nothing if it is whole)."""
    z, out, view, i = zlib.decompressobj(31), [], memoryview(data), at
    try:
        while not z.eof:
            if i >= len(data):
                return b"".join(out), len(data), "member without an end"
            out.append(z.decompress(view[i : i + PIECE]))
            i = min(len(data), i + PIECE)
    except zlib.error:
        # the content before the fault: from here byte by byte, which gives each byte as soon as it is known
        z = zlib.decompressobj(31)
        out = [z.decompress(view[at:i])]
        try:
            for j in range(i, min(len(data), i + PIECE)):
                out.append(z.decompress(view[j : j + 1]))
        except zlib.error:
            pass
        return b"".join(out), at, "broken member"
    return b"".join(out), i - len(z.unused_data), ""


def records_in(content: bytes) -> tuple[list[tuple[dict[str, str], bytes, int]], list[tuple[int, int, str]]]:
    """(headers, block, end) of all whole records in plain content, and the gaps between."""
    found, gaps, at = [], [], 0
    while at < len(content):
        try:
            headers, block, end = parse(content, at)
            found.append((headers, block, end))
        except Damaged as e:
            version = VERSION.search(content, at + 1)
            end = version.start() if version else len(content)
            if gaps and gaps[-1][0] + gaps[-1][1] == at:
                gaps[-1] = (gaps[-1][0], end - gaps[-1][0], gaps[-1][2])
            else:
                gaps.append((at, end - at, str(e)))
        at = end
    return found, gaps


def salvage(data: bytes) -> tuple[list[Record], list[tuple[int, int, str]]]:
    """All whole records of an archive, compressed or not, and its gaps as (offset, length, what failed).

    A record's offset is that of its member. A gap in a member that inflates whole is (the member's offset, bytes of
    content, what failed). A member that doesn't is a gap up to the next place where one may begin, but its records
    count as far as it inflates: of a broken one those whose block digest is right, of one without an end those that
    end before the cut.
    """
    records: list[Record] = []
    gaps: list[tuple[int, int, str]] = []
    again: list[tuple[dict[str, str], bytes]] = []  # of a failed member, which may hold them as they are
    at = 0
    while at < len(data):
        if data.startswith(MAGIC, at):
            content, end, failed = inflate(data, at)
            own, lost = records_in(content)
            if failed == "broken member":
                own = [x for x in own if x[0].get("warc-block-digest", "").partition(":")[0].lower() in ("sha1", "sha256", "md5")]
            elif failed:
                own = [x for x in own if x[2] < len(content)]
            records += [Record(headers, block, at) for headers, block, _ in own]
            again = [x[:2] for x in own] if failed else []
            if not failed:
                gaps += [(at, n, what) for _, n, what in lost] if own else [(at, end - at, what) for _, _, what in lost[:1]]
                at = end
                continue
        else:
            try:
                headers, block, end = parse(data, at)
                if (headers, block) in again:
                    again.remove((headers, block))
                else:
                    records.append(Record(headers, block, at))
                at = end
                continue
            except Damaged as e:
                failed = str(e)
        version = VERSION.search(data, at + 1)
        found = [x for x in (data.find(MAGIC, at + 1), version.start() if version else -1) if x >= 0]
        to = min(found, default=len(data))
        if gaps and gaps[-1][0] + gaps[-1][1] == at:
            gaps[-1] = (gaps[-1][0], gaps[-1][1] + to - at, gaps[-1][2])
        else:
            gaps.append((at, to - at, failed))
        at = to
    return records, gaps


def page_row(r: Record) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload bytes, payload digest, type, refers_to) of a record of any archive.

    The ids are null unless they are of pages written here. Bytes and SHA-256 are those of the payload that the record
    holds; of a revisit, those that it states (null bytes where it states none).
    """
    number = lambda x: int(m[1]) if (m := PAGE.fullmatch(r.headers.get(x, ""))) else None
    head, payload = payload_of(r.headers, r.block)
    kind = r.headers.get("warc-type", "unknown")
    if kind == "revisit":
        size = re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)
        return number("warc-record-id"), int(size[1]) if size else None, r.headers.get("warc-payload-digest", "").removeprefix("sha256:"), kind, number("warc-refers-to")
    return number("warc-record-id"), len(payload), hashlib.sha256(payload).hexdigest(), kind, None


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for page_id, url, html, digest, refers_to in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            out.append(member(record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), digest, refers_to)))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])


def write_archives(pages: DataFrame, to: str, file_bytes: int = FILE_BYTES) -> None:
    """Writes a record per row of pages (page_id, url, html).

    Null html is an empty payload. Of rows with equal payloads of 100 bytes or more, those with the smallest page_id
    are responses and the others revisit it: a repeated row at that id is a response again; a null page_id never is
    the smallest, and such a row is a response if there is no other. Other columns are ignored.
    """
    spark = pages.sparkSession
    prepared(spark)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    thin = written(pages.select("page_id", "digest", F.octet_length("html").alias("size")))
    n, total, most = thin.agg(F.count("*"), F.sum("size"), F.max("size")).first()
    groups = thin.where(F.col("size") >= REVISIT_FROM).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    rows = left_join_hot(pages, "digest", groups.select("digest", "first"), groups.select("digest", "n"), n)
    rows = rows.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    # files of about the bytes asked for: pages far over the average, at most an eighth of all, go to files of fewer pages
    mean = (total or 0) / max(1, n)
    cut = max(1, 8 * mean)
    size = F.octet_length("html")
    for part, each in ((rows.where(size <= cut), mean), (rows.where(size > cut), most)) if (most or 0) > cut else ((rows, mean),):
        members = part.mapInArrow(_members, "member binary").select(F.col("member").cast("string").alias("value"))
        members.write.mode("append").option("lineSep", SEPARATOR).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", max(1, int(file_bytes / max(1, each)))).text(to)


def _read(gaps: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                records, lost = salvage(content.as_py())
                if gaps:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(lost), pa.string()), *(pa.array([x[i] for x in lost], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string())))], names=["path", "start", "length", "reason"])
                else:
                    rows = [page_row(r) for r in records]
                    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return read


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record that can still be read.

    A file is read by one task as a whole (``write_archives`` keeps files to some ``FILE_BYTES``); foreign archives need
    executors with memory for a few times their largest file. Records without a type are of type unknown.
    """
    prepared(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_read(False), "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def quarantined(spark: SparkSession, path: str) -> DataFrame:
    """path, start, length and reason of each gap that the reader passed over."""
    prepared(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_read(True), "path string, start bigint, length bigint, reason string")


def op6_warc(spark, sf_dir: str) -> DataFrame:
    write_archives(table(spark, sf_dir, "pages"), path := scratch(spark))
    return read_archives(spark, path)


SQL = f"""
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html)) as size, sha256(html) as digest from p),
g as (select *, min(page_id) over (partition by digest) as first from d)
select page_id, cast(size as bigint) as payload_bytes, digest as payload_digest,
       case when size >= {REVISIT_FROM} and page_id > first then 'revisit' else 'response' end as record_type,
       case when size >= {REVISIT_FROM} and page_id > first then first end as refers_to
from g
"""
