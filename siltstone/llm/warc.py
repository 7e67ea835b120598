"""WARC archives: a writer with revisit records and a reader that salvages damaged files."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm._blocks import own_shuffle, parts_for, scratch, written

#: Bytes of an archive, about; a longer record has an archive of its own.
ARCHIVE_BYTES = 16 << 20
#: Bytes of archives that one task reads, about, one archive after the other.
READ_BYTES = 128 << 20
VERSION, END = b"WARC/1.1\r\n", b"\r\n\r\n"
GZIP = b"\x1f\x8b\x08"
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:siltstone:page:"


def base32_sha1(raw: bytes) -> str:
    """A digest as archives write it."""
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record_bytes(record_id: str, url: str | None, payload: bytes, date: str, refers_to: str | None, refers_url: str | None) -> bytes:
    """A response record with the payload, or a revisit record that refers to one."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    safe = lambda u: quote(u, safe="%/:?#[]@!$&'()*+,;=~-._")
    lines = [f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {safe(url)}")
    if refers_to:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
        if refers_url is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {safe(refers_url)}")
    lines += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(lines).encode() + END + block + END


@dataclass
class Record:
    """A record that passed all checks, and where it stood."""

    offset: int
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        """The block after the HTTP header, or all of it where there is none."""
        if "application/http" in self.headers.get("content-type", ""):
            return self.block.partition(b"\r\n\r\n")[2]
        return self.block

    @property
    def payload_bytes(self) -> int:
        """The length of the full payload; a revisit keeps it in its HTTP header."""
        if self.headers.get("warc-type") == "revisit":
            for line in self.block.partition(b"\r\n\r\n")[0].split(b"\r\n"):
                name, _, value = line.partition(b":")
                if name.strip().lower() == b"content-length" and value.strip().isdigit():
                    return int(value)
        return len(self.payload)


@dataclass
class Salvage:
    """What an archive gave: good records, quarantined gaps (start, end, reason), and doubtful records with reasons."""

    records: list[Record] = field(default_factory=list)
    gaps: list[tuple[int, int, str]] = field(default_factory=list)
    doubtful: list[tuple[Record, str]] = field(default_factory=list)


class Damaged(Exception):
    """Why a record failed its checks."""


def parsed(raw: memoryview, at: int, offset: int) -> tuple[Record, int]:
    """The record whose version line is at ``at``, after all checks, and where it ends."""
    if bytes(raw[at : at + 7]) != b"WARC/1.":
        raise Damaged("no version line")
    window = 1 << 13
    while True:
        head = bytes(raw[at : at + window])
        stop = head.find(END)
        if stop >= 0:
            break
        if at + window >= len(raw) or b"\r\nWARC/1." in head:
            raise Damaged("header without end")
        window *= 4
    version, *lines = head[:stop].split(b"\r\n")
    if version not in (b"WARC/1.0", b"WARC/1.1"):
        raise Damaged("unknown version line")
    headers = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without name")
        headers[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Damaged("no content length")
    begin = at + stop + len(END)
    end = begin + int(length)
    if end + len(END) > len(raw):
        raise Damaged("cut short")
    if bytes(raw[end : end + len(END)]) != END:
        raise Damaged("content length is wrong")
    record = Record(offset, headers, bytes(raw[begin:end]))
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != base32_sha1(record.block):
        raise Damaged("block digest differs")
    digest = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") != "revisit" and digest.startswith("sha1:") and digest[5:] != base32_sha1(record.payload):
        raise Damaged("payload digest differs")
    return record, end + len(END)


def member(raw: memoryview, at: int) -> tuple[bytes, int, str | None]:
    """The text of the gzip member at ``at``, where it ends, and what is wrong: then, the text inflated before that."""
    if bytes(raw[at : at + 3]) != GZIP:
        raise Damaged("no member header")
    machine, out, here = zlib.decompressobj(16 + zlib.MAX_WBITS), [], at
    try:
        while not machine.eof and here < len(raw):
            step = raw[here : here + (1 << 18)]
            out.append(machine.decompress(step))
            here += len(step)
    except zlib.error as e:
        return before_error(raw, at), here, f"member: {e}"
    return b"".join(out), here - len(machine.unused_data), None if machine.eof else "member cut short"


def before_error(raw: memoryview, at: int) -> bytes:
    """What a damaged member inflates to before the error."""
    machine, out, step = zlib.decompressobj(16 + zlib.MAX_WBITS), [], 1 << 18
    while True:
        before = machine.copy()
        try:
            out.append(machine.decompress(raw[at : at + step]))
            at += step
        except zlib.error:
            machine = before
            if step == 1:
                break
            step >>= 1
    tail = bytes(raw[at : at + 1])
    try:  # the error's byte may end some symbols first
        while (one := machine.decompress(tail, 1)) or machine.unconsumed_tail != tail:
            out.append(one)
            tail = machine.unconsumed_tail
    except zlib.error:
        pass
    return b"".join(out)


def inside(text: bytes, at: int) -> tuple[list[Record], list[tuple[int, int, str]]]:
    """The good records of a member's text, and the gaps between them as bytes of the text."""
    raw, here, gap, found, gaps = memoryview(text), 0, None, [], []
    while here < len(text):
        try:
            record, end = parsed(raw, here, at)
        except Damaged as e:
            gap = gap or (here, str(e))
            here = text.find(b"WARC/1.", here + 1)
            if here < 0:
                break
            continue
        if gap:
            gaps.append((gap[0], here, gap[1]))
            gap = None
        found.append(record)
        here = end
    if gap:
        gaps.append((gap[0], len(text), gap[1]))
    return found, gaps


def salvage(content: bytes) -> Salvage:
    """All records of an archive that pass their checks.

    After a failed check the search goes on at the next version line of the member's
    text, at the next gzip member and, in plain stretches, at the next version line;
    what lies between is a quarantined gap with the reason of the first failure in it.
    A gap between good records of one member is one for the whole member, and its
    reason names the bytes of the text. Records inflated whole from a member that is
    cut short or whose data or checksum is wrong are doubtful: they pass their own
    checks, but no digest covers their headers. An empty archive has neither records
    nor gaps.
    """
    raw, out, at, gap = memoryview(content), Salvage(), 0, None
    while at < len(raw):
        inner: list = []
        after = None
        try:
            if bytes(raw[at : at + 3]) == GZIP:
                text, end, error = member(raw, at)
                found, inner = inside(text, at)
                if error:
                    out.doubtful += [(r, error) for r in found]
                    raise Damaged(error)
                after = end
                if not found:
                    raise Damaged(inner[0][2] if inner else "empty member")
            else:
                record, end = parsed(raw, at, at)
                found = [record]
                # stored without compression, a doubtful record stands there in plain too
                out.doubtful = [d for d in out.doubtful if (d[0].headers, d[0].block) != (record.headers, record.block)]
        except Damaged as e:
            gap = gap or (at, str(e))
            at = after or next_start(content, at + 1)
            continue
        if gap:
            out.gaps.append((gap[0], at, gap[1]))
            gap = None
        out.records += found
        out.gaps += [(at, end, f"text bytes {a} to {b}: {reason}") for a, b, reason in inner]
        at = end
    if gap:
        out.gaps.append((gap[0], len(raw), gap[1]))
    return out


def next_start(content: bytes, at: int) -> int:
    """The next place that may start a member or a record; the end where there is none."""
    places = [p for p in (content.find(GZIP, at), content.find(b"WARC/1.", at)) if p >= 0]
    return min(places, default=len(content))


def store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder all executors share, and the path in it."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pyarrow.fs.FileSystem.from_uri(uri)


def write_archives(df: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Pages written as WARC archives; returns their list (path, n_records, n_bytes).

    Of pages with equal payloads of at least ``least_bytes`` bytes, the one with the
    greatest id is a response and the others are revisits that refer to it. Digests
    and lengths of payloads, not payloads, decide which are equal, and maxima are
    taken before they travel. A page is one gzip member. Each task attempt writes
    files of its own names, and only those of attempts that Spark commits are in the
    list, so lost executors leave no record twice. Null texts are empty payloads;
    null urls have no target; pages without an id are written but never referred to;
    rows with one id and payload are all responses. An empty table gives no archive.
    """
    spark = df.sparkSession
    folder = folder or scratch(spark)
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    pages = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    pages = pages.withColumn("digest", F.sha1("payload")).withColumn("size", F.length("payload"))
    leads = pages.filter((F.col("size") >= least_bytes) & F.col("id").isNotNull()).groupBy("digest", "size").agg(F.max("id").alias("lead"))
    pages = pages.join(own_shuffle(leads, "digest", "size"), ["digest", "size"], "left").withColumn("refers", F.when(F.col("lead") != F.coalesce("id", F.lit(-1)), F.col("lead")))
    pages = pages.select("id", "url", F.when(F.col("refers").isNull(), F.col("payload")).alias("payload"), "digest", "size", "refers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        files, path = store(folder)
        files.create_dir(path, recursive=True)
        done, buffer, n, loose = [], [], 0, 0

        def close() -> None:
            nonlocal buffer, n
            if buffer:
                raw = b"".join(buffer)
                name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{len(done):04d}.warc.gz"
                with files.open_output_stream(f"{path}/{name}", compression=None) as out:
                    out.write(raw)
                done.append((f"{folder}/{name}", len(buffer), len(raw)))
                buffer, n = [], 0

        for batch in batches:
            for row in range(batch.num_rows):
                page, url, body, digest, size, refers = (batch.column(k)[row].as_py() for k in range(6))
                if page is None:
                    name, loose = f"urn:siltstone:loose:{context.partitionId()}-{loose}", loose + 1
                else:
                    name = f"{RECORD_ID}{page}"
                raw = record_bytes(name, url, body, date, None, None) if refers is None else revisit_bytes(name, url, bytes.fromhex(digest), size, date, f"{RECORD_ID}{refers}")
                packer = zlib.compressobj(4, zlib.DEFLATED, 16 + zlib.MAX_WBITS)
                raw = packer.compress(raw) + packer.flush()
                if n and n + len(raw) > ARCHIVE_BYTES:
                    close()
                buffer.append(raw)
                n += len(raw)
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["path", "n_records", "n_bytes"])

    return written(pages.mapInArrow(run, "path string, n_records long, n_bytes long"))


def revisit_bytes(record_id: str, url: str | None, digest: bytes, size: int, date: str, refers_to: str) -> bytes:
    """A revisit record from the digest and length of its payload."""
    raw = record_bytes(record_id, url, b"", date, refers_to, None)
    # the record of an empty payload, with the real length and digest put in
    old = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: 0\r\n\r\n".encode()
    new = old.replace(b"Content-Length: 0", f"Content-Length: {size}".encode())
    head = raw[: raw.index(END)]
    head = head.replace(f"WARC-Payload-Digest: sha1:{base32_sha1(b'')}".encode(), b"WARC-Payload-Digest: sha1:" + base64.b32encode(digest))
    head = head.replace(f"WARC-Block-Digest: sha1:{base32_sha1(old)}".encode(), f"WARC-Block-Digest: sha1:{base32_sha1(new)}".encode())
    head = head.replace(f"Content-Length: {len(old)}".encode(), f"Content-Length: {len(new)}".encode())
    return head + END + new + END


FIELDS = "path string, offset long, end long, reason string, record_id string, record_type string, url string, payload_bytes long, payload_digest string, refers_to string, payload binary"


def read_archives(contents: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records and gaps of archives, one row each.

    ``contents`` has ``path`` and, where Spark has read the files (its ``binaryFile``
    source), ``content``; without that each task opens its paths in the shared store.
    Records have a ``record_id`` and no ``reason``; quarantined gaps have the bytes
    ``offset`` to ``end`` and the ``reason``; doubtful records of a member without a
    good checksum have both a ``record_id`` and a ``reason``. A task holds one archive at a time.
    """
    loaded = "content" in contents.columns

    def rows(path: str, content: bytes) -> list[tuple]:
        found = salvage(content)
        out = []
        for r, reason in [*((r, None) for r in found.records), *found.doubtful]:
            h = r.headers
            digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or base32_sha1(r.payload)
            bare = lambda x: x.strip("<>") if x else None
            out.append((path, r.offset, None, reason, bare(h.get("warc-record-id", "")), h.get("warc-type"), h.get("warc-target-uri"), r.payload_bytes, digest, bare(h.get("warc-refers-to")), r.payload if with_payload else None))
        return out + [(path, a, b, reason, *[None] * 7) for a, b, reason in found.gaps]

    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path = batch.column(0)[i].as_py()
                if loaded:
                    content = batch.column(1)[i].as_py()
                else:
                    files, inner = store(path)
                    with files.open_input_stream(inner, compression=None) as f:
                        content = f.read()
                found = rows(path, content)
                for low in range(0, len(found), 2000):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found[low : low + 2000], strict=True), types, strict=True)], names=names)

    columns = ["path", "content"] if loaded else ["path"]
    return contents.select(*columns).mapInArrow(run, FIELDS)


def dealt(archives: DataFrame, each: int = READ_BYTES) -> DataFrame:
    """The list of archives in as many partitions as it takes for about ``each`` bytes of archives in one."""
    n = archives.agg(F.sum("n_bytes")).first()[0] or 0
    return archives.repartition(max(parts_for(archives.sparkSession), int(n) // each + 1), "path")


def read_stored(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """The archives of any folder that Spark can read, one archive a task."""
    return read_archives(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content"), with_payload)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    archives = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    records = read_archives(dealt(archives)).filter("reason IS NULL")
    page = lambda c: F.regexp_extract(c, r"(-?\d+)$", 1).cast("long")
    own = F.when(F.col("record_id").startswith(RECORD_ID), page("record_id"))
    return records.select(own.alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("refers_to").isNotNull(), page("refers_to")).alias("refers_to"))


OP4_SQL = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, CAST(unhex(sha1(coalesce(html, ''))) AS BIT)::VARCHAR AS bits FROM pages
), d AS (
  SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT)::INT, 1)), 'string_agg', '') AS payload_digest FROM p
), m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS lead FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> lead THEN lead END AS refers_to FROM m
"""
