"""WARC archives and the normaliser of monolithic gzip files.

``write_archives`` writes one WARC file a task, compressed as one gzip stream over the whole file
(as naive tools do). ``normalise`` inflates each such file once, as a stream, rewrites every record
as a gzip member of its own and writes a sidecar index (record id, offset, length), so that a record can
be read by a seek. ``read_archives`` reads records back through the index. Each archive begins with a
warcinfo record; a revisit names its response's record id, and page ids have a header of their own.
Record ids are unique but for rows that repeat a page id and its payload in different archives.

Files live in a folder that all executors reach (``spark.checkpoint.dir`` for the query); they are
opened through ``pyarrow.fs``, written under a name of the attempt and renamed when complete, so
a lost executor leaves no half file and a second attempt replaces the first.

Payload digests are bare upper-case base32 SHA-1. Of equal payloads of at least ``min_bytes``,
the record with the smallest page id is a response and the others are revisits that name it.

Defined cases: a null html is the empty payload; equal empty payloads revisit each other like any
others (unless min_bytes says otherwise); repeated rows of the smallest page id are all
responses; a null page id is never the smallest unless all are null; a very long page is inflated
and rewritten in chunks, and held whole, once, by the task that writes or reads it; an empty table gives no records; other columns, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

import base64
import hashlib
import io
import itertools
import json
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, cleaned_shuffles, join_counted, table

CHUNK = 1 << 20
DATE = "2020-01-01T00:00:00Z"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with the scheme of Spark's default file system, if it has none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def fs_of(uri: str):
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


SPACE = uuid.UUID("5b0d7a1c-6f5e-4c0e-9d60-0a2c4d1f7a11")
#: Characters that a URI may hold, kept as they are; all others are percent-encoded.
URI_SAFE = "!#$&'()*+,/:;=?@[]%~"


def urn(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, ':'.join(map(str, parts)))}>"


def int_of(text: str | None) -> int | None:
    return int(text) if text else None


def member(kind: str, record_id: str, block: bytes, more: list[str], content: str = "application/http; msgtype=response") -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}", *more, f"Content-Type: {content}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info(archive: str) -> bytes:
    return member("warcinfo", urn("archive", archive), b"format: WARC File Format 1.1\r\n", [f"WARC-Filename: {archive}"], "application/warc-fields")


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, record_id: str | None = None) -> bytes:
    """One WARC 1.1 record; a revisit has the headers of the answer and no payload."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    more = [f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        more.append(f"WARC-Target-URI: {quote(url, safe=URI_SAFE)}")
        if quote(url, safe=URI_SAFE) != url or unquote(url) != url:
            more.append(f"X-Url: {json.dumps(url)}")  # as it was given
    if page_id is not None:
        more.append(f"X-Page-Id: {page_id}")
    if revisit:
        more += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn('response', refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    kind = "revisit" if revisit else "response"
    return member(kind, record_id or urn(kind, page_id, digest), http if revisit else http + payload, more)


def classify(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to) with the response that each revisit names."""
    scratch = Scratch(pages.sparkSession, "classify")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    # SHA-1 alone isn't safe against forged pairs: SHA-256 tells payloads apart.
    p = p.withColumn("key", F.sha2("html", 256)).withColumn("long_enough", F.octet_length("html") >= min_bytes)
    first = p.where("long_enough").groupBy("key").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).where("n > 1 AND least IS NOT NULL")
    # Pages of a payload that very many share stay where they are.
    p = join_counted(p, scratch.keep(first, "first"), ["key"], "n", "left")
    refers = F.when(F.col("long_enough") & ~F.coalesce(F.col("least") == F.col("page_id"), F.lit(False)), F.col("least"))
    return p.select("page_id", "url", "html", refers.alias("refers_to"))


def _commit(fs, tmp: str, final: str) -> None:
    fs.move(tmp, final)


def write_archives(pages: DataFrame, folder: str) -> None:
    """Write (page_id, url, html, refers_to) as ``folder``/part-N.warc.gz, one gzip stream a file."""
    folder = qualified(pages.sparkSession, folder)
    there, root = fs_of(folder)
    there.create_dir(root, recursive=True)

    def run(batches):
        fs, root = fs_of(folder)
        part = TaskContext.get().partitionId()
        tmp, final = f"{root}/.{part}-{uuid.uuid4().hex}", f"{root}/part-{part:06d}.warc.gz"
        n, pack = 0, zlib.compressobj(6, zlib.DEFLATED, 31)
        seen: set[tuple] = set()
        with fs.open_output_stream(tmp) as out:
            out.write(pack.compress(info(final.rsplit("/", 1)[1])))
            for batch in batches:
                for pid, url, html, ref in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    body = (html or "").encode()
                    digest = base32_sha1(body)
                    # A repeated row, or one without a page id, has a record id of its own.
                    own = urn("row", part, n) if pid is None or (pid, digest) in seen else None
                    seen.add((pid, digest))
                    out.write(pack.compress(record(pid, url, body, digest, ref, own)))
                    n += 1
            out.write(pack.flush())
        _commit(fs, tmp, final)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    with cleaned_shuffles(pages.sparkSession):
        pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "n long").agg(F.sum("n")).collect()


class Stream:
    """Decompressed bytes of a gzip file (any number of members), read once from the front."""

    def __init__(self, source) -> None:
        self.source, self.unpack, self.held, self.at_end = source, zlib.decompressobj(31), bytearray(), False

    def more(self) -> bool:
        """Inflate up to a chunk more."""
        if self.at_end:
            return False
        raw = self.unpack.unconsumed_tail
        if self.unpack.eof:
            raw = self.unpack.unused_data
            self.unpack = zlib.decompressobj(31)
        raw = raw or self.source.read(CHUNK)
        if not raw:
            self.held += (rest := self.unpack.flush())
            self.at_end = True
            return bool(rest)
        self.held += self.unpack.decompress(raw, CHUNK)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with ``mark``; None at the end of the file."""
        at = 0
        while (k := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                if self.held.strip():
                    raise ValueError("the archive ends inside a record")
                return None
        return self.take(k + len(mark))

    def take(self, n: int) -> bytes:
        return b"".join(self.chunks(n))

    def chunks(self, n: int):
        """The next ``n`` bytes in pieces of about a chunk."""
        while n:
            if not self.held and not self.more():
                raise ValueError("the archive ends inside a record")
            out = bytes(self.held[:n])
            del self.held[: len(out)]
            n -= len(out)
            if out:
                yield out


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode().strip().split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def records(stream: Stream):
    """(headers, pieces of the whole record) of each record, in order; take all pieces before the next."""
    while (head := stream.until(b"\r\n\r\n")) is not None:
        h = headers(head)
        yield h, itertools.chain([head], stream.chunks(int(h["content-length"]) + 4))


def normalise_file(fs, path: str, keep_source: bool = True) -> int | None:
    """Rewrite ``x.warc.gz`` as ``x.members.warc.gz`` with ``x.idx``; returns the number of records.

    The index is renamed last and the source is removed after it, so a second attempt finds either
    the source or a finished index (and then returns None)."""
    stem = path.removesuffix(".warc.gz")
    tmp, tmp_idx = f"{stem}.{uuid.uuid4().hex}", f"{stem}.{uuid.uuid4().hex}"
    offset = n = 0
    if not keep_source and fs.get_file_info(f"{stem}.idx").type == pafs.FileType.File:
        return None
    with fs.open_input_stream(path, compression=None) as src, fs.open_output_stream(tmp, compression=None) as out, fs.open_output_stream(tmp_idx, compression=None) as idx:
        for h, pieces in records(Stream(src)):
            pack, length = zlib.compressobj(6, zlib.DEFLATED, 31), 0
            for piece in itertools.chain(map(pack.compress, pieces), [None]):
                piece = pack.flush() if piece is None else piece
                out.write(piece)
                length += len(piece)
            idx.write(json.dumps({"id": h["warc-record-id"], "type": h["warc-type"], "offset": offset, "length": length}).encode() + b"\n")
            offset, n = offset + length, n + (h["warc-type"] != "warcinfo")
    _commit(fs, tmp, f"{stem}.members.warc.gz")
    _commit(fs, tmp_idx, f"{stem}.idx")
    if not keep_source:
        fs.delete_file(path)
    return n


def _files(spark: SparkSession, folder: str, ending: str) -> DataFrame:
    folder = qualified(spark, folder)
    fs, root = fs_of(folder)
    names = sorted(x.path for x in fs.get_file_info(pafs.FileSelector(root)) if x.path.endswith(ending) and not x.path.split("/")[-1].startswith(".") and ".members." not in x.path)
    return spark.createDataFrame([(n,) for n in names], "path string").repartition(max(1, len(names)), "path")


def normalise(spark: SparkSession, folder: str, keep_source: bool = True) -> None:
    """Normalise all archives of a folder, a file a task."""
    folder = qualified(spark, folder)

    def run(batches):
        fs, _ = fs_of(folder)
        for batch in batches:
            n = [normalise_file(fs, p, keep_source) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["n"])

    _files(spark, folder, ".warc.gz").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def parse(member: bytes) -> dict:
    whole = zlib.decompress(member, 31)
    head, _, rest = whole.partition(b"\r\n\r\n")
    h = headers(head)
    block = rest[: int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(headers(http)["content-length"])
    digest = h["warc-payload-digest"].removeprefix("sha1:")
    if h["warc-type"] == "response" and (len(payload) != length or base32_sha1(payload) != digest):
        raise ValueError(f"payload of {h['warc-record-id']} doesn't fit its headers")
    url = json.loads(h["x-url"]) if "x-url" in h else h.get("warc-target-uri")
    return {"page_id": int_of(h.get("x-page-id")), "url": url, "payload_bytes": length, "payload_digest": digest, "record_type": h["warc-type"], "refers_to": int_of(h.get("x-refers-to-page-id")), "payload": payload if h["warc-type"] == "response" else None}


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of all normalised archives, each read by its index entry."""
    folder = qualified(spark, folder)
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches):
        fs, _ = fs_of(folder)
        for batch in batches:
            for p in batch.column(0).to_pylist():
                stem = p.removesuffix(".idx")
                rows, held = [], 0
                with fs.open_input_file(f"{stem}.members.warc.gz") as f, fs.open_input_stream(p, compression=None) as idx:
                    for line in io.TextIOWrapper(idx, "utf-8"):
                        e = json.loads(line)
                        if e["type"] == "warcinfo":
                            continue
                        r = parse(f.read_at(e["length"], e["offset"]))
                        if not payloads:
                            r["payload"] = None
                        held += len(r["payload"] or b"")
                        rows.append(r)
                        if len(rows) >= 5000 or held > 8 * CHUNK:
                            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], k) for n, k in zip(names, kinds, strict=True)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    return _files(spark, folder, ".idx").mapInArrow(run, RECORD)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{Scratch(spark, 'warc').root}/archives"
    write_archives(classify(table(spark, sf_dir, "pages")), folder)
    normalise(spark, folder, keep_source=False)
    return read_archives(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS lo,
             list_transform(range(0, 40), lambda i: ascii(sha1(h)[i+1])) AS c FROM p),
b AS (SELECT *, list_transform(c, lambda x: CASE WHEN x >= 97 THEN x - 87 ELSE x - 48 END) AS v FROM m)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(((((v[(5*k)//4+1] << 8) | (v[least((5*k)//4+2, 40)] << 4) | 0) >> (7 - (5*k)%4)) & 31) AS INTEGER) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = lo THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> lo THEN lo END AS refers_to
FROM b
"""
