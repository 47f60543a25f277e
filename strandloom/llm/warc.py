"""WARC archives: one gzip member per record, written and read as streams.

The reader inflates a member piece by piece, frames the block by Content-Length
and verifies block and payload digests while the bytes pass, so its memory
doesn't grow with a record. Archives lie in a folder that the whole cluster
reaches; a task names its archives for its attempt and reports them in a
manifest table, whose commit leaves one attempt of each task. A lost executor
therefore costs a rerun and never a record twice.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import materialize, workspace

CHUNK = 1 << 16
#: Payloads from this size on are stored once; equal ones revisit the first.
LEAST_REVISIT = 100
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_shared(path: str, mode: str) -> BinaryIO:
    """A file in the shared folder: by the local mount, or by the store's own client."""
    if "://" not in path or path.startswith("file:"):
        return open(path.removeprefix("file:").replace("//", "/", 1) if path.startswith("file:") else path, mode)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_stream(inner) if "r" in mode else store.open_output_stream(inner)


def make_shared(path: str) -> None:
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    store.create_dir(inner, recursive=True)


def record_id(page: object, digest: str) -> bytes:
    return b"<urn:uuid:%s>" % str(uuid.UUID(bytes=hashlib.sha256(f"{page}:{digest}".encode()).digest()[:16])).encode()


def _clean(value: object) -> bytes:
    """A header value on one line."""
    return b" ".join(str(value).encode().splitlines())


def _name(page: object) -> bytes:
    """An id with its blanks and line ends escaped."""
    return quote(str(page), safe="").encode()


def _named(value: str | None) -> str | None:
    return None if value is None else unquote(value)


def member(page: object, url: str | None, payload: bytes, digest: str, refers_to: object = None, date: str = "2000-01-01T00:00:00Z") -> bytes:
    """One record as a gzip member; with ``refers_to`` a revisit without payload."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: " + record_id(page, digest), b"WARC-Date: " + date.encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + _clean(url))
    if page is not None:
        head.append(b"Page-ID: " + _name(page))
    if revisit:
        head += [b"WARC-Profile: " + PROFILE, b"WARC-Refers-To: " + record_id(refers_to, digest), b"Refers-To-Page-ID: " + _name(refers_to)]
    head += [b"Content-Type: application/http; msgtype=response", b"WARC-Payload-Digest: sha256:" + digest.encode(), b"WARC-Block-Digest: sha256:" + hashlib.sha256(block).hexdigest().encode(), b"Content-Length: %d" % len(block)]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def _inflated(f: BinaryIO) -> Iterator[Iterator[bytes]]:
    """For each gzip member, its pieces. A member must be used up before the next."""
    held = b""

    def pieces() -> Iterator[bytes]:
        nonlocal held
        z = zlib.decompressobj(31)
        while not z.eof:
            data = z.unconsumed_tail or held or f.read(CHUNK)
            held = b""
            if not data:
                raise ValueError("WARC: the archive ends within a member")
            if out := z.decompress(data, CHUNK):  # a few bytes of input may give none yet
                yield out
        held = z.unused_data

    while held or (held := f.read(CHUNK)):
        yield pieces()


def _headers(raw: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in raw.split(b"\r\n")[1:] if line)
    return {k.decode().strip().lower(): v.decode("utf-8", "replace").strip() for k, _, v in pairs}


def read_records(f: BinaryIO, payload: bool = False) -> Iterator[dict]:
    """Records of an archive in order: headers, http headers, payload_bytes,
    payload_digest, and the payload if asked for. A bad frame or digest raises
    ValueError. Of a revisit, size and digest are those of the full payload.
    """
    for pieces in _inflated(f):
        buf = b""
        while b"\r\n\r\n" not in buf:
            buf += next(pieces, b"") or _short("header")
        raw, _, buf = buf.partition(b"\r\n\r\n")
        if not raw.startswith(b"WARC/"):
            raise ValueError("WARC: a member doesn't start with a record")
        head = _headers(raw)
        left = int(head["content-length"])
        block, body, http, size, kept = hashlib.sha256(), hashlib.sha256(), b"", 0, []
        inside = False
        while left:
            if not buf:
                buf = next(pieces, None)
                if buf is None:
                    _short("block")
                continue
            part, buf = buf[:left], buf[left:]
            left -= len(part)
            block.update(part)
            if not inside:
                http += part
                if b"\r\n\r\n" not in http:
                    continue
                http, _, part = http.partition(b"\r\n\r\n")
                inside = True
            body.update(part)
            size += len(part)
            if payload:
                kept.append(part)
        rest = buf + b"".join(pieces)
        if rest != b"\r\n\r\n":
            raise ValueError("WARC: a record doesn't end where its length says")
        stated = head.get("warc-payload-digest", "").removeprefix("sha256:")
        if head.get("warc-block-digest", "sha256:" + block.hexdigest()) != "sha256:" + block.hexdigest():
            raise ValueError("WARC: block digest differs")
        revisit = head.get("warc-type") == "revisit"
        fields = _headers(http)
        if not revisit and (stated and stated != body.hexdigest() or int(fields.get("content-length", size)) != size):
            raise ValueError("WARC: payload digest or length differs")
        yield {"headers": head, "http": fields, "payload_bytes": int(fields["content-length"]) if revisit else size, "payload_digest": stated if revisit else body.hexdigest()} | ({"payload": b"".join(kept)} if payload else {})


def _short(what: str) -> bytes:
    raise ValueError(f"WARC: a member ends within a record's {what}")


def roles(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to): what to write for each row.

    Equal payloads of LEAST_REVISIT bytes or more refer to the least page_id that
    has them. Rows that repeat this page_id with it are each a response. Rows with
    a null page_id refer to the least one, or are responses if there is none.
    """
    p = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.encode(html, "UTF-8"), F.lit(b"")).alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    first = p.where(F.octet_length("payload") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = first.where((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "first")
    p = p.join(first, "digest", "left")  # one hot payload: adaptive execution splits its partition
    return p.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, archive_bytes: int = 32 << 20) -> DataFrame:
    """Write ``roles`` rows as archives below folder; returns the manifest (archive, records, bytes)."""
    make_shared(folder)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, k, f, n, size = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0, None, 0, 0
        try:
            for b in batches:
                for page, url, payload, digest, ref in zip(b["page_id"], b["url"], b["payload"], b["digest"], b["refers_to"]):
                    if f is None:
                        f, n, size = open_shared(f"{name}-{k:04d}.warc.gz", "wb"), 0, 0
                    m = member(page, url, bytes(payload), digest, ref)
                    f.write(m)
                    n, size = n + 1, size + len(m)
                    if size >= archive_bytes:
                        f.close()
                        f = None
                        yield pd.DataFrame({"archive": [f"{name}-{k:04d}.warc.gz"], "records": [n], "bytes": [size]})
                        k += 1
        finally:
            if f is not None:
                f.close()
        if f is not None:
            yield pd.DataFrame({"archive": [f"{name}-{k:04d}.warc.gz"], "records": [n], "bytes": [size]})

    # Ids go as text: pandas would turn nullable integers into floats.
    text = records.withColumn("page_id", F.col("page_id").cast("string")).withColumn("refers_to", F.col("refers_to").cast("string"))
    return materialize(text.mapInPandas(write, "archive string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, kind: str = "long") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of all records."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, count in zip(b["archive"], b["records"]):
                rows, done = [], 0
                with open_shared(path, "rb") as f:
                    for r in read_records(f):
                        h = r["headers"]
                        rows.append((_named(h.get("page-id")), r["payload_bytes"], r["payload_digest"], h["warc-type"], _named(h.get("refers-to-page-id")), h.get("warc-target-uri")))
                        done += 1
                        if len(rows) == 4096:
                            yield _rows(rows)
                            rows = []
                if done != count:
                    raise ValueError(f"WARC: {path} has {done} records; the manifest says {count}")
                yield _rows(rows)

    n = max(1, manifest.count())
    out = manifest.select("archive", "records").repartition(n).mapInPandas(read, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string")
    return out.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


def _rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None) -> DataFrame:
    """Write a record per row of pages, then read all archives back.

    Null html is an empty payload, a null url leaves out the target URI. An empty
    table gives no archive and no row. Further columns of pages are ignored.
    """
    folder = folder or workspace(pages.sparkSession, "warc")
    return read_archives(write_archives(roles(pages, page_id, url, html), folder), pages.schema[page_id].dataType.simpleString())


def oracle(table: str = "pages") -> str:
    """The result of ``round_trip`` in SQL for DuckDB."""
    return f"""
WITH p AS (SELECT page_id, url, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM {table}),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {LEAST_REVISIT} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, url
FROM p LEFT JOIN f USING (payload_digest)
"""
