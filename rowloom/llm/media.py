"""Interleaved document sequences: ordered text and media references, with payloads joined by digest.

`parse` turns HTML into a sequence of structs in document order: a text run, or
a media reference with its digest, its alternative text and its caption.
`store` keeps every payload as a greyscale PNG of 8-bit samples (lossless), and
`features` reads the stored bytes back. `pages` lays a text out as HTML around
its payload. `resolve` makes equal payloads one row and joins references to them
by digest; `assemble` puts the sequence of a document together again, position
by position. `outline` is a sequence whose runs carry their length instead of
their characters, for sequences that travel.

A digest that many documents share is one row on the media side, and on the
reference side it is looked up without going through one task.
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

from rowloom.llm.common import bounded_batches, materialise, skewed_lookup, text_of

PAD, WIDTH = 255, 576
LEVEL = 3  # of deflate
URN = "urn:sha256:"
SIGNATURE = bytes([137, 80, 78, 71, 13, 10, 26, 10])  # of PNG

ITEM = "struct<position: int, kind: string, text: string, digest: string, src: string, caption: string>"


class _Sequence(HTMLParser):
    """Text runs and media references in document order; scripts and styles are no text."""

    MEDIA = {"img", "audio", "video", "source", "embed"}
    SILENT = {"script", "style", "template", "noscript"}
    BREAKS = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "section", "article", "nav", "header", "footer", "figure", "blockquote", "pre", "title"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.silent, self.figure, self.caption = 0, None, None

    def _flush(self) -> None:
        words = " ".join("".join(self.text).split())
        self.text = []
        if words:
            self.items.append({"kind": "text", "text": words, "digest": None, "src": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SILENT:
            self.silent += 1
        elif tag in self.MEDIA:
            given = dict(attrs)
            src = given.get("src")
            if src:
                self._flush()
                digest = src[len(URN) :].lower() if src.startswith(URN) else None
                self.items.append({"kind": "media", "text": given.get("alt") or None, "digest": digest, "src": src, "caption": None})
                if self.figure is not None:
                    self.figure.append(self.items[-1])
        elif tag == "figcaption":
            self._flush()
            self.caption = []
        elif tag in self.BREAKS:
            self._flush()
            if tag == "figure":
                self.figure = []

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in self.SILENT:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            caption, self.caption = " ".join("".join(self.caption).split()), None
            for item in self.figure or ():
                item["caption"] = caption or None
            if not self.figure and caption:
                self.items.append({"kind": "text", "text": caption, "digest": None, "src": None, "caption": None})
        elif tag in self.BREAKS:
            self._flush()
            if tag == "figure":
                self.figure = None

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)

    def done(self) -> list[dict]:
        self.close()
        self._flush()
        return [{"position": i} | item for i, item in enumerate(self.items)]


def sequence_of(page: str | None) -> list[dict]:
    """The interleaved sequence of one page; a null or empty page has none."""
    parser = _Sequence()
    parser.feed(page or "")
    return parser.done()


def parse(pages: DataFrame, *, key: str = "page_id", column: str = "html") -> DataFrame:
    """`key` and `items`, the ordered text and media-reference structs of every page. Repeated rows stay."""
    narrow = bounded_batches(pages).select(key, text_of(column).alias("__html"))
    kind = pa.list_(pa.struct([("position", pa.int32()), *((n, pa.string()) for n in ("kind", "text", "digest", "src", "caption"))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [sequence_of(p) for p in batch.column("__html").to_pylist()]
            yield pa.RecordBatch.from_pydict({key: batch.column(key), "items": pa.array(items, kind)})

    return narrow.mapInArrow(run, f"`{key}` {narrow.schema[key].dataType.simpleString()}, items array<{ITEM}>")


def outline(sequences: DataFrame) -> DataFrame:
    """The sequences with the number of code points (`chars`) of every text run instead of its text; media keep their alternative text."""
    is_text = lambda i: i["kind"] == "text"
    item = F.transform("items", lambda i: i.withField("chars", F.when(is_text(i), F.char_length(i["text"]))).withField("text", F.when(~is_text(i), i["text"])))
    return sequences.withColumn("items", item)


def references(sequences: DataFrame, *, key: str = "page_id") -> DataFrame:
    """One row per media reference with a digest: `key`, position, digest, alt, caption."""
    item = F.explode(F.filter("items", lambda i: i["digest"].isNotNull()))
    return sequences.select(key, item.alias("i")).select(key, "i.position", "i.digest", F.col("i.text").alias("alt"), "i.caption")


def padded(raw: bytes) -> bytes:
    return raw + bytes([PAD]) * (max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(payload: bytes) -> bytes:
    """A greyscale picture whose samples are the payload, row by row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # the first byte of a line names its filter: none
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def samples(stored: bytes) -> bytes:
    """The payload of a picture that `png` made; anything damaged raises."""
    if not stored.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    at, data, shape = len(SIGNATURE), [], None
    while at < len(stored):
        size, kind = struct.unpack(">I4s", stored[at : at + 8])
        body, crc = stored[at + 8 : at + 8 + size], stored[at + 8 + size : at + 12 + size]
        if struct.unpack(">I", crc)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged PNG")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    if shape is None or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit greyscale picture")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Lines, mean, entropy in hundredths of a bit, and a 64-bit difference hash of an 8 x 9 reduction."""
    s = np.frombuffer(payload, np.uint8)
    histogram = np.bincount(s, minlength=256)
    p = histogram[histogram > 0] / len(s)
    edges = np.linspace(0, len(s), 73).astype(np.int64)
    means = np.add.reduceat(s.astype(np.int64), edges[:-1]) / np.diff(edges)
    grid = means.reshape(8, 9)
    bits = np.packbits((grid[:, 1:] > grid[:, :-1]).ravel()).tobytes().hex()
    return f"lines={len(s) // WIDTH};mean={s.mean():.2f};entropy={round(-100 * float((p * np.log2(p)).sum()))};dhash={bits}"


def pages(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, n_bytes and `page`: HTML of the whole text, a paragraph per line, with its payload's picture after the first half of them.

    The picture's caption is the first line's first words. Columns only, no
    Python. A null or empty text is a page of the picture alone.
    """
    t = text_of(text)
    raw = F.encode(t, "UTF-8")
    size = F.octet_length(t)
    fill = F.greatest(F.lit(WIDTH), F.ceil(size / WIDTH).cast("int") * WIDTH) - size
    digest = F.sha2(F.concat(raw, F.unhex(F.repeat(F.lit(f"{PAD:02x}"), fill))), 256)
    escaped = t
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        escaped = F.replace(escaped, F.lit(char), F.lit(entity))
    lines = F.filter(F.split(F.col("__escaped"), "\n", -1), lambda line: line.rlike(r"[^\x00-\x20]"))
    paragraphs = F.transform("__lines", lambda line: F.concat(F.lit("<p>"), line, F.lit("</p>")))
    half = F.floor((F.size("__lines") + 1) / 2).cast("int")
    caption = F.array_join(F.slice(F.split(F.get("__lines", F.lit(0)), r"[\x00-\x20]+", 9), F.lit(1), F.lit(8)), " ")
    figure = F.concat(F.lit(f'<figure><img src="{URN}'), "__digest", F.lit('" alt="payload"><figcaption>'), F.coalesce(caption, F.lit("")), F.lit("</figcaption></figure>"))
    page = F.concat(
        F.lit("<article>"),
        F.array_join(F.slice("__paragraphs", F.lit(1), half), ""),
        figure,
        F.array_join(F.slice("__paragraphs", half + 1, F.size("__paragraphs")), ""),
        F.lit("</article>"),
    )
    made = docs.select(F.col(key), size.cast("bigint").alias("n_bytes"), digest.alias("__digest"), escaped.alias("__escaped"))
    return made.withColumn("__lines", lines).withColumn("__paragraphs", paragraphs).select(key, "n_bytes", page.alias("page"))


def store(docs: DataFrame, *, keep: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """Per row `keep` and `stored`, the picture of its text's payload. Repeated rows stay; a null text is empty."""
    narrow = bounded_batches(docs).select(*keep, text_of(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):  # pictures of a few hundred texts at a time
                part = batch.slice(low, 256)
                pictures = [png(padded(t.encode())) for t in part.column("__text").to_pylist()]
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in keep} | {"stored": pa.array(pictures, pa.binary())})

    fields = [f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in keep]
    return narrow.mapInArrow(run, ", ".join([*fields, "stored binary"]))


def features(media: DataFrame, *, keep: tuple[str, ...] = (), stored: str = "stored") -> DataFrame:
    """`keep`, and of every stored picture: digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    narrow = bounded_batches(media).select(*keep, F.col(stored).alias("__stored"))
    fields = [*(f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in keep)]
    fields.append("payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pictures = batch.column("__stored").to_pylist()
            out: dict = {c: [] for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for picture in pictures:
                payload = samples(picture)
                out["payload_bytes"].append(len(payload))
                out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                out["tail_crc32"].append(zlib.crc32(payload[-32:]))
                out["media_bytes"].append(len(picture))
                out["media_sha256"].append(hashlib.sha256(picture).hexdigest())
                out["feature"].append(feature_of(payload))
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in keep} | out)

    return narrow.mapInArrow(run, ", ".join(fields))


def resolve(refs: DataFrame, media: DataFrame, total: int, *, digest: str = "payload_sha256") -> DataFrame:
    """References with the columns of their media; `media` may hold a digest more than once, equal payloads being equal media.

    A reference whose digest has no media keeps its row with nulls.
    """
    values = [c for c in media.columns if c != digest]
    one = media.groupBy(F.col(digest).alias("digest")).agg(F.count("*").alias("__n"), *[F.min(c).alias(c) for c in values])
    return skewed_lookup(refs, materialise(one, "payloads"), "digest", "__n", total)


def assemble(sequences: DataFrame, resolved: DataFrame, *, key: str = "page_id") -> DataFrame:
    """`key` and `items` with the resolved columns of each media item as `media`, at its own position."""
    extra = [c for c in resolved.columns if c not in (key, "position", "digest", "alt", "caption")]
    by_key = resolved.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("position", F.struct(*extra)))).alias("__media"))
    item = F.transform("items", lambda i: i.withField("media", F.element_at("__media", i["position"])))
    return sequences.join(by_key, key, "left").select(key, item.alias("items"))
