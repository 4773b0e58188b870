"""Media columns: interleaved document sequences with text and media references.

`interleave` parses HTML into one ordered sequence per page: structs of position, kind (text or
media), text (for media its caption) and reference. `resolve` joins the references to stored
payloads by digest; positions and captions stay with their item. `store_media` makes the payload
of a text: its UTF-8 bytes, filled with 255 to a positive multiple of `UNIT`, kept losslessly as
an 8-bit grey PNG of `WIDTH` columns and addressed by the SHA-256 of the text.

`media_features` writes the media table to the shared folder. A document's page is its lines as
paragraphs with the figure of its payload in their middle; it is parsed into a sequence, whose
reference is joined with what the stored payload holds when it is read back. Only digests and
features are shuffled, never payloads or pages; a payload is decoded where it is read. A digest
may be referred to by any share of the documents: features are grouped to one row per digest
before the join, with a combine on the map side.

Defined results: a null text is an empty one and gets one unit of fill; equal texts share a
payload; rows that repeat are answered each; broken HTML gives what the parser can read; a
reference without payload keeps its item with null payload fields; an empty table gives an empty
result; other columns are ignored.
"""
from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut

UNIT, WIDTH = 576, 576
PNG_HEAD = b"\x89PNG\r\n\x1a\n"
SEQUENCE = "array<struct<pos:int,kind:string,text:string,ref:string>>"


def payload_of(text: bytes) -> bytes:
    return text + b"\xff" * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def _part(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, width: int = WIDTH) -> bytes:
    rows = len(payload) // width
    lines = np.zeros((rows, width + 1), np.uint8)  # each line begins with filter 0
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, width)
    return PNG_HEAD + _part(b"IHDR", struct.pack(">IIBBBBB", width, rows, 8, 0, 0, 0, 0)) + _part(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _part(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    if media[:8] != PNG_HEAD:
        raise ValueError("not a stored payload")
    at, data, width = 8, [], 0
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at:at + 8])
        body = media[at + 8:at + 8 + size]
        if struct.unpack(">I", media[at + 8 + size:at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("a stored payload is damaged")
        if kind == b"IHDR":
            width = struct.unpack(">I", body[:4])[0]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Size of the picture, mean sample, share of fill-like samples, entropy of the samples in bits."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = counts[counts > 0] / len(payload)
    return f"{WIDTH}x{len(payload) // WIDTH};mean={counts @ np.arange(256) / len(payload):.4f};white={counts[255] / len(payload):.4f};bits={-(share * np.log2(share)).sum():.4f}"


class Sequencer(HTMLParser):
    """Text and media items in the order of the page; what scripts and styles hold is no text."""

    HIDDEN, BREAKS, MEDIA = {"script", "style", "template"}, {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "br", "article", "section", "figure", "figcaption", "nav", "ul", "ol", "table", "title", "blockquote", "pre"}, {"img", "video", "audio", "source"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[tuple[str, str, str | None]] = []
        self.parts: list[str] = []
        self.hidden = 0
        self.figure: int | None = None
        self.caption = False

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if not text:
            return
        if self.caption and self.figure is not None and self.figure < len(self.items):
            kind, _, ref = self.items[self.figure]
            self.items[self.figure] = (kind, text, ref)
        else:
            self.items.append(("text", text, None))

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self.hidden += 1
        if tag in self.BREAKS or tag in self.MEDIA:
            self.flush()
        if tag == "figure":
            self.figure = None
        if tag == "figcaption":
            self.caption = True
        if tag in self.MEDIA:
            own = dict(attrs)
            if own.get("src"):
                self.figure = len(self.items)
                self.items.append(("media", own.get("alt") or own.get("title") or "", own["src"]))

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if tag in self.BREAKS:
            self.flush()
        if tag == "figcaption":
            self.caption = False
        if tag == "figure":
            self.figure = None

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def sequence_of(page: str | None) -> list[dict]:
    parser = Sequencer()
    parser.feed(page or "")
    parser.close()
    parser.flush()
    return [{"pos": i, "kind": k, "text": t, "ref": r} for i, (k, t, r) in enumerate(parser.items)]


SEQUENCE_TYPE = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string())]))


def interleave(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: page_id and its sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sequence_of(x.as_py()) for x in batch.column(1)], SEQUENCE_TYPE)], ["page_id", "sequence"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")).mapInArrow(run, f"page_id long, sequence {SEQUENCE}")


def resolve(sequences: DataFrame, media: DataFrame) -> DataFrame:
    """sequences(page_id, sequence), media(digest, ...): one row per media item with its payload's columns, null if there is none."""
    items = sequences.select("page_id", F.size("sequence").alias("n_items"), F.inline("sequence")).where("kind = 'media'")
    digest = F.when(F.startswith("ref", F.lit("sha256:")), F.substring("ref", 8, 64))
    items = items.select("page_id", "n_items", "pos", F.col("text").alias("caption"), digest.alias("digest"))
    return items.join(media, "digest", "left")


def document_pages(docs: DataFrame) -> DataFrame:
    """doc_id, html: the lines of the text as paragraphs, halfway a figure that refers to the payload, captioned with its length in bytes."""
    text = F.coalesce("text", F.lit(""))
    plain = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.transform(F.split(plain, "\n"), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>")))
    figure = F.concat(F.lit('<figure><img src="sha256:'), F.sha2(text.cast("binary"), 256), F.lit('"><figcaption>'), F.octet_length(text).cast("string"), F.lit("</figcaption></figure>"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lines.alias("lines"), figure.alias("figure"))
    half = F.ceil(F.size("lines") / 2).cast("int")
    body = F.concat(F.array_join(F.slice("lines", F.lit(1), half), ""), "figure", F.array_join(F.slice("lines", half + 1, F.size("lines")), ""))
    return rows.select("doc_id", F.concat(F.lit("<html><body><article>"), body, F.lit("</article></body></html>")).alias("html"))


def store_media(docs: DataFrame) -> DataFrame:
    """One row per document: digest (of its text), media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, media, held = [], [], 0
            for text in batch.column(0):
                text = text.as_py() or b""
                digests.append(hashlib.sha256(text).hexdigest())
                media.append(to_png(payload_of(text)))
                held += len(media[-1])
                if held > 8_000_000:
                    yield _stored(digests, media)
                    digests, media, held = [], [], 0
            if digests:
                yield _stored(digests, media)

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "digest string, media binary")


def _stored(digests: list[str], media: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(media, pa.binary())], ["digest", "media"])


def describe(media: DataFrame) -> DataFrame:
    """digest, media: what the stored bytes hold when read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, stored in zip(batch.column(0).to_pylist(), batch.column(1)):
                stored = stored.as_py()
                payload = from_png(stored)
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(payload)))
            names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return media.select("digest", "media").mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_features(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, media_pos, n_items.

    n_bytes is the figure's caption, media_pos its place among the n_items of the document's sequence.
    """
    scratch = Scratch(docs.sparkSession)
    try:
        stored = scratch.keep(store_media(docs))
        found = describe(stored).groupBy("digest").agg(*[F.first(c).alias(c) for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")])
        items = resolve(interleave(document_pages(docs), "doc_id"), found)
        out = items.select(F.col("page_id").alias("doc_id"), F.col("caption").cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.col("pos").alias("media_pos"), "n_items")
        return cut(out)
    finally:
        scratch.drop()
