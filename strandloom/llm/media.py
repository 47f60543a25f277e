"""Media columns: documents as interleaved sequences of text and media references.

HTML is parsed into ordered items: text, or a reference to a media payload by its
digest, with alternative text and caption. Payloads are kept apart, once per
digest and task, and met again by a join on the digest, so a payload that many
documents show isn't copied into them; positions and captions stay with the item.

A payload is a whole number of rows of ``WIDTH`` bytes and is stored as a PNG of
8-bit grey samples, which is lossless.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import materialize

WIDTH = 64
#: A digest with more references than HOT is dealt over PARTS tasks.
HOT, PARTS, BROADCAST_DIGESTS = 1000, 16, 100_000
SIGNATURE = b"\x89PNG\r\n\x1a\n"
ITEMS = "array<struct<position:int,kind:string,text:string,digest:string,alt:string,caption:string>>"
HIDDEN = {"script", "style", "template", "noscript"}
BLOCKS = {"p", "div", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tr", "td", "th", "figure", "figcaption", "br", "body", "nav", "header", "footer", "blockquote", "pre"}


def padded(raw: bytes) -> bytes:
    """raw with zero bytes up to a positive multiple of WIDTH."""
    return raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b"\0")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    """A grey 8-bit PNG whose samples are the payload's bytes, WIDTH a row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # a filter byte, none, before each row
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 3)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> bytes:
    """The samples of ``encode_png``; damage raises ValueError."""
    if data[:8] != SIGNATURE:
        raise ValueError("PNG: no signature")
    at, size, parts = 8, None, []
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("PNG: checksum differs")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    if size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("PNG: not 8-bit grey")
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("PNG: filtered rows aren't supported")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Rows, distinct bytes, sum of bytes, and counts of bytes by their upper three bits."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    eight = ",".join(map(str, counts.reshape(8, 32).sum(axis=1)))
    return f"rows={len(payload) // WIDTH};distinct={np.count_nonzero(counts)};sum={int(counts @ np.arange(256))};octaves={eight}"


class _Reader(HTMLParser):
    """Collects items; a figure's caption goes to the references in it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.hidden = 0
        self.figures: list[int] = []  # where the open figures' items start
        self.caption: list[str] | None = None

    def _flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self._item("text", text=text)

    def _item(self, kind: str, text: str | None = None, digest: str | None = None, alt: str | None = None) -> None:
        self.items.append({"position": len(self.items), "kind": kind, "text": text, "digest": digest, "alt": alt, "caption": None})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        elif tag in ("img", "audio", "video", "source") and not self.hidden:
            a = dict(attrs)
            if a.get("src"):
                self._flush()
                self._item("media", digest=a["src"].removeprefix("sha256:"), alt=a.get("alt"))
        elif tag in BLOCKS:
            self._flush()
            if tag == "figure":
                self.figures.append(len(self.items))
            elif tag == "figcaption":
                self.caption = []

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            text, self.caption = " ".join("".join(self.caption).split()), None
            for i in self.items[self.figures[-1] if self.figures else len(self.items) :]:
                if i["kind"] == "media":
                    i["caption"] = text
        elif tag in BLOCKS:
            self._flush()
            if tag == "figure" and self.figures:
                self.figures.pop()

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        (self.words if self.caption is None else self.caption).append(data)


def parse(source: str | None) -> list[dict]:
    """Items of one page in order; null and empty pages have none."""
    r = _Reader()
    r.feed(source or "")
    r.close()
    r._flush()
    return r.items


def interleave(pages: DataFrame, page_id: str = "page_id", source: str = "html") -> DataFrame:
    """(id, items) per row of pages."""
    kind = pages.schema[page_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("position", "kind", "text", "digest", "alt", "caption")
        item = pa.list_(pa.struct([(n, pa.int32() if n == "position" else pa.string()) for n in names]))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([parse(t) for t in b.column(1).to_pylist()], item)], ["id", "items"])

    return pages.select(F.col(page_id).alias("id"), F.col(source)).mapInArrow(run, f"id {kind}, items {ITEMS}")


def media_features(stored: DataFrame) -> DataFrame:
    """For each row of (digest, media): what the stored form decodes to, one row per digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for digest, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p = decode_png(media)
                sha = hashlib.sha256(p).hexdigest()
                if sha != digest:
                    raise ValueError(f"media: {digest} decodes to another payload")
                for o, v in zip(out, (digest, len(p), sha, zlib.crc32(p[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(p))):
                    o.append(v)
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    f = stored.mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return f.dropDuplicates(["digest"])


def hot_digests(stored: DataFrame) -> DataFrame | None:
    """(digest) of payloads with more than HOT references; None where they are too many to broadcast."""
    hot = stored.groupBy("digest").count().where(F.col("count") > HOT).select("digest")
    return hot if hot.count() <= BROADCAST_DIGESTS else None


def resolve(items: DataFrame, media: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Media references of (id, items) rows beside the columns of their digest in media.

    A reference without a payload keeps its place, with nulls. References to a digest
    of ``hot`` are dealt over PARTS tasks, and its row in media goes to each.
    """
    refs = items.select("id", F.explode("items").alias("i")).where("i.kind = 'media'")
    refs = refs.select("id", F.col("i.position").alias("position"), F.col("i.digest").alias("digest"), F.col("i.caption").alias("caption"))
    if hot is None:
        return refs.join(media, "digest", "left")
    mark = F.broadcast(hot.withColumn("hot", F.lit(True)))  # BROADCAST_DIGESTS rows at most
    part = F.when(F.col("hot"), F.pmod(F.xxhash64("id", "position"), F.lit(PARTS)).cast("int")).otherwise(0)
    refs = refs.join(mark, "digest", "left").withColumn("part", part).drop("hot")
    every = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    media = media.join(mark, "digest", "left").withColumn("part", F.explode(every)).drop("hot")
    return refs.join(media, ["digest", "part"], "left").drop("part")


def text_pages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, html): a page per document with its text and, as a figure, the text as a picture."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages = []
            for t in b.column(1).to_pylist():
                raw = (t or "").encode()
                d = hashlib.sha256(padded(raw)).hexdigest()
                pages.append(f'<article><p>{html.escape(t or "")}</p><figure><img src="sha256:{d}" alt="text"><figcaption>{len(raw)} bytes</figcaption></figure></article>')
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pages, pa.string())], ["doc_id", "html"])

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, f"doc_id {kind}, html string")


def store_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(digest, media) per document: the text as a picture.

    media is there for a task's first row of a digest and null for its repeats.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: set[bytes] = set()
        for b in batches:
            digests, media = [], []
            for t in b.column(0).to_pylist():
                p = padded((t or "").encode())
                h = hashlib.sha256(p)
                digests.append(h.hexdigest())
                media.append(None if h.digest() in have else encode_png(p))
                have.add(h.digest())
                if len(have) > 1 << 20:
                    have.clear()
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(media, pa.binary())], ["digest", "media"])

    return docs.select(F.col(text)).mapInArrow(run, "digest string, media binary")


def text_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text stored as media, found again through its document's items.

    (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, position, caption) per row of docs. Null text is empty:
    one row of zeros. Repeated rows come back as often, copies have equal values,
    texts of any length are stored whole, other columns are ignored.
    """
    stored = materialize(store_texts(docs, text), "media-store")
    media = media_features(stored.where("media is not null").select("digest", "media"))
    found = resolve(interleave(text_pages(docs, doc_id, text), "doc_id", "html"), media, hot_digests(stored))
    n: Column = F.regexp_extract("caption", r"^(\d+)", 1).cast("long")
    return found.select(F.col("id").alias("doc_id"), n.alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
