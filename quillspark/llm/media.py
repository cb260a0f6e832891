"""Media columns: interleaved sequences of text and media references, and a content-addressed store of payloads.

Pages are parsed into ordered structs (position, kind, text, source, caption, digest). Payloads are stored as 8-bit
greyscale PNG images of 64 samples a row, named by the SHA-256 of the payload; a digest join puts what is stored at
each reference, so positions and captions stay aligned with the text around them. Only references are shuffled for that, and those of a hot payload not even so.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import in_arrow, spread_join, texts_of, written
from quillspark.llm.html_extract import media_sequence

#: Samples in a row of the stored image; payloads are padded with bytes 0 to a positive multiple of it.
WIDTH = 64
#: Pages parsed at once: their items are Python objects until they are returned.
PAGE_ROWS = 32
_MAGIC = b"\x89PNG\r\n\x1a\n"


def _part(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """payload, a positive multiple of WIDTH bytes, as a greyscale PNG; each row is one filter byte 0 and its samples."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _MAGIC + _part(b"IHDR", head) + _part(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _part(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """The samples of an image that to_png made; ValueError if it is damaged or of another kind."""
    if data[:8] != _MAGIC:
        raise ValueError("not a PNG")
    at, packed, head = 8, b"", None
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged PNG")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed += body
        at += 12 + n
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit greyscale PNG")
    rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(head[1], head[0] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def feature(samples: bytes) -> str:
    """Mean and deviation of the samples, a 16-bin histogram's entropy, and a 64-bit average hash over an 8 by 8 grid of means."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x >> 4, minlength=16)
    p = counts[counts > 0] / len(x)
    edges = np.linspace(0, len(x), 65).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    grid = (total[edges[1:]] - total[edges[:-1]]) / np.maximum(1, np.diff(edges))
    bits = int("".join("1" if v > grid.mean() else "0" for v in grid), 2)
    mean = total[-1] / len(x)
    square = int((x.astype(np.int64) ** 2).sum()) / len(x)
    return f"mean={mean:.4f};dev={max(0.0, square - mean * mean) ** 0.5:.4f};entropy={-(p * np.log2(p)).sum() + 0.0:.4f};hash={bits:016x}"


def digest_of(payload: Column) -> Column:
    """What a payload is stored under: its SHA-256; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(payload.cast("binary"), F.lit(b"")), 256))


def store(payloads: DataFrame, name: str = "media") -> DataFrame:
    """(payload) -> the written store (digest, n_bytes, media): one task writes what it reads, no payload is shuffled.

    payload may be null (as empty). A task stores a payload once; copies met by different tasks are stored by each,
    under the same digest and with the same bytes, and readers take one row of a digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            digests, sizes, media = [], [], []
            for value in b["payload"]:
                raw = value.as_py() or b""
                key = hashlib.sha256(raw).digest()
                if key not in seen:
                    seen.add(key)
                    digests.append(key)
                    sizes.append(len(raw))
                    media.append(to_png(padded(raw)))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["digest", "n_bytes", "media"])

    return written(in_arrow(payloads.select(F.col("payload").cast("binary").alias("payload")), run, "digest binary, n_bytes long, media binary"), name)


def described(stored: DataFrame) -> DataFrame:
    """What the stored bytes hold, read back: one row (digest, n_bytes, payload_bytes, ..., feature) for each digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for media in b["media"]:
                data = media.as_py()
                samples = from_png(data)
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b["digest"], b["n_bytes"], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    out = in_arrow(stored, run, "digest binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return out.dropDuplicates(["digest"])


_ITEM = "struct<position:int,kind:string,text:string,src:string,caption:string>"


def sequences(pages: DataFrame) -> DataFrame:
    """pages (page_id, html) -> page_id, items: array of (position, kind 'text' or 'media', text, src, caption), in page order, positions from 0.

    An image takes its figure's figcaption, or else alt, as caption. Null and empty html: no items. Repeated page_ids are kept apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("src", pa.string()), ("caption", pa.string())]))
        for b in batches:
            items = [[dict(zip(("position", "kind", "text", "src", "caption"), (i, *x), strict=True)) for i, x in enumerate(media_sequence(v.as_py() or ""))] for v in b["html"]]
            yield pa.RecordBatch.from_arrays([b["page_id"], pa.array(items, kind)], names=["page_id", "items"])

    return in_arrow(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")), run, f"page_id long, items array<{_ITEM}>", PAGE_ROWS)


def interleaved(pages: DataFrame, media: DataFrame | None = None) -> DataFrame:
    """sequences(pages), and with media (src, payload) a digest in each item: what its source's payload is stored under.

    A reference without a payload keeps its place with a null digest; of several payloads of one source the one with the least digest is taken. Sequences are written
    once; references go to their payloads and come back as a map from positions to digests, so no text is taken apart.
    """
    base = sequences(pages)
    if media is None:
        return base
    base = written(base.withColumn("row", F.monotonically_increasing_id()), "items")
    named = written(media.where("src is not null").groupBy("src").agg(F.min(digest_of(F.col("payload"))).alias("digest")), "sources")
    asked = written(base.select("row", F.explode("items").alias("i")).where("i.src is not null").select("row", "i.position", "i.src"), "references")
    found = spread_join(asked, named, "src").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("position", "digest"))).alias("digests"))
    with_digest = F.transform("items", lambda i: F.struct(*(i[c].alias(c) for c in ("position", "kind", "text", "src", "caption")), F.try_element_at("digests", i["position"]).alias("digest")))
    return base.join(found, "row", "left").select("page_id", with_digest.alias("items"))


#: Before the digest in the source of a document's own payload.
SCHEME = "sha256:"


def document_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> page_id, html: each document as a page of its payload, a figure with a caption, and its text in a paragraph."""
    escaped = reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")), F.col("text"))
    figure = F.concat(F.lit(f'<figure><img src="{SCHEME}'), F.sha2("text", 256), F.lit('"><figcaption>Document '), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("</figcaption></figure><p>"))
    return texts_of(docs).select(F.col("doc_id").alias("page_id"), F.concat(figure, escaped, F.lit("</p>")).alias("html"))


def documents_as_media(docs: DataFrame) -> DataFrame:
    """Each document's text as one stored payload: doc_id, caption, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Documents become pages, pages are parsed into sequences, and the media item of each sequence is resolved by digest against the store. A null text counts as empty
    (64 bytes 0); equal texts have equal values; repeated rows are returned as often, and null doc_ids too. Payloads are never shuffled: only references and what was computed from the store are.
    """
    items = sequences(document_pages(docs)).select("page_id", F.explode("items").alias("i")).where("i.kind = 'media'")
    asked = written(items.select(F.col("page_id").alias("doc_id"), "i.caption", F.unhex(F.substring("i.src", len(SCHEME) + 1, 64)).alias("digest")), "references")
    facts = written(described(store(texts_of(docs).select(F.encode("text", "UTF-8").alias("payload")))), "facts")
    return spread_join(asked, facts, "digest").drop("digest")
