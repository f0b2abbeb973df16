"""Media columns: interleaved sequences whose media lie in a content-addressed store.

A page's HTML becomes an ordered array of structs, text or media reference, each
with its position; a figure's caption stays with its reference. Payloads are
kept once by the SHA-256 of their bytes, in a lossless stored form (greyscale
PNG, 8 bits a sample). A reference names a digest, and a join on the digest
resolves it; positions and captions are untouched by the join. Features are
computed from the stored bytes before the join, once for each digest, so a
payload that many pages share moves once and the join carries short rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WIDTH = 64
_MAGIC = b"\x89PNG\r\n\x1a\n"
_SKIP = {"script", "style", "template", "noscript"}
_BLOCK = {"p", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "td", "th", "br", "table", "article", "section", "title", "nav", "header", "footer", "blockquote", "pre", "figure", "figcaption", "body", "head"}
SCHEME = "sha256:"


def padded(data: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of WIDTH."""
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def encode(payload: bytes) -> bytes:
    """A greyscale PNG, WIDTH samples a row, that holds the payload as its samples."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    filtered = np.zeros((len(rows), WIDTH + 1), np.uint8)
    filtered[:, 1:] = rows
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _MAGIC + part(b"IHDR", head) + part(b"IDAT", zlib.compress(filtered.tobytes(), 1)) + part(b"IEND", b"")


def decode(media: bytes) -> bytes:
    """The samples of such a PNG; any other stored form is a ValueError."""
    if media[:8] != _MAGIC:
        raise ValueError("not a PNG")
    at, data, rows = 8, [], None
    while at < len(media):
        length, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + length]
        if struct.unpack(">I", media[at + 8 + length : at + 12 + length])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged PNG")
        if kind == b"IHDR":
            width, rows, depth, colour = struct.unpack(">IIBB", body[:10])
            if (width, depth, colour) != (WIDTH, 8, 0):
                raise ValueError("not 8-bit greyscale of the stored width")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + length
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(rows, WIDTH + 1)
    if raw[:, 0].any():
        raise ValueError("filtered rows")
    return raw[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Size, mean and spread in thousandths, least and greatest sample, and a 64-bit average hash."""
    x = np.frombuffer(payload, np.uint8)
    n, total, squares = len(x), int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum())
    tiles = x.reshape(-1, WIDTH).sum(0, dtype=np.int64)
    bits = int("".join("1" if t * WIDTH >= total else "0" for t in tiles.tolist()), 2)
    return f"{WIDTH}x{n // WIDTH} mean={total * 1000 // n} var={(squares * n - total * total) * 1000 // (n * n)} min={x.min()} max={x.max()} hash={bits:016x}"


class _Sequence(HTMLParser):
    """Ordered (kind, text, reference, caption) parts of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[list] = []
        self.text: list[str] = []
        self.skipped = 0
        self.figures: list[dict] = []  # open figures: where their parts begin, and a caption that awaits media
        self.caption: list[str] | None = None
        self.pictures: list[str | None] = []  # open pictures: the first source seen, for want of an img

    def flush(self):
        joined = " ".join("".join(self.text).split())
        self.text.clear()
        if joined:
            self.parts.append(["text", joined, None, None])

    def media(self, values: dict):
        """One part for what an element refers to: src, or the first candidate of srcset."""
        reference = values.get("src") or ((values.get("srcset") or "").split() or [""])[0].rstrip(",")
        if reference:
            self.flush()
            waiting = next((f["caption"] for f in reversed(self.figures) if f["caption"]), None)
            self.parts.append(["media", None, reference, waiting or values.get("alt") or None])

    def end_caption(self):
        if self.caption is None:
            return
        words, self.caption = " ".join("".join(self.caption).split()), None
        if not words:
            return
        own = [p for p in self.parts[self.figures[-1]["first"] :] if p[0] == "media"] if self.figures else []
        for part in own:
            part[3] = words
        if self.figures:
            self.figures[-1]["caption"] = words  # for media that are still to come
        if not own and not self.figures:
            self.parts.append(["text", words, None, None])

    def end_figure(self):
        self.end_caption()
        self.flush()
        figure = self.figures.pop()
        if figure["caption"] and not any(p[0] == "media" for p in self.parts[figure["first"] :]):
            self.parts.append(["text", figure["caption"], None, None])

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skipped += 1
        elif self.skipped:
            return
        elif tag == "picture":
            self.pictures.append(None)
        elif tag == "source" and self.pictures:
            values = dict(attrs)
            self.pictures[-1] = self.pictures[-1] or values.get("srcset") or values.get("src")
        elif tag in ("img", "audio", "video", "source", "embed"):
            values = dict(attrs)
            if tag == "img" and self.pictures and not (values.get("src") or values.get("srcset")):
                values["srcset"] = self.pictures[-1]
            if self.pictures and tag == "img":
                self.pictures[-1] = None
            self.media(values)
        elif tag == "figcaption":
            self.end_caption()
            self.flush()
            self.caption = []
        elif tag in _BLOCK:
            if self.caption is not None and tag not in ("br", "p"):
                self.end_caption()  # a caption holds no such block, so it was never closed
            if self.caption is None:
                self.flush()
            else:
                self.caption.append(" ")
            if tag == "figure":
                self.figures.append({"first": len(self.parts), "caption": None})

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skipped = max(0, self.skipped - 1)
        elif self.skipped:
            return
        elif tag == "picture" and self.pictures:
            left = self.pictures.pop()
            if left:
                self.media({"srcset": left})
        elif tag == "figcaption":
            self.end_caption()
        elif tag == "figure" and self.figures:
            self.end_figure()
        elif tag in _BLOCK:
            if self.caption is not None and tag in ("p", "br"):
                self.caption.append(" ")
                return
            self.end_caption()
            self.flush()

    def handle_data(self, data):
        if not self.skipped:
            (self.text if self.caption is None else self.caption).append(data)

    def end(self):
        while self.figures:
            self.end_figure()
        self.end_caption()
        self.flush()


def sequence(page: str | None) -> list[tuple[int, str, str | None, str | None, str | None]]:
    """(position, kind, text, reference, caption) of a page's parts, in the order of the page.

    A figure's caption goes to all its media, before it or after it; without media
    it is text at its figure's end, and outside a figure text where it stands. A
    caption that is never closed ends with its figure or where a block begins.
    Without a caption media have their alt text. Null and empty pages have no parts.
    """
    if not page:
        return []
    parser = _Sequence()
    parser.feed(page)
    parser.close()
    parser.end()
    return [(i, *part) for i, part in enumerate(parser.parts)]


PART_DDL = "array<struct<position: int, kind: string, text: string, reference: string, caption: string>>"
_PARTS = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("reference", pa.string()), ("caption", pa.string())]))


def parse_pages(pages: DataFrame, id_col="page_id", html_col="html") -> DataFrame:
    """(page_id, parts): a row for each row of the input, whatever its other columns."""
    schema = pa.schema([("page_id", pa.int64()), ("parts", _PARTS)])
    names = ("position", "kind", "text", "reference", "caption")

    def run(batches):
        for b in batches:
            parts = [[dict(zip(names, p)) for p in sequence(page)] for page in b.column(1).to_pylist()]
            yield C.batch(schema, b.column(0), parts)

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")).mapInArrow(run, f"page_id long, parts {PART_DDL}")


def build_store(docs: DataFrame, data_col="text") -> DataFrame:
    """(digest, n_bytes, media): each distinct value of ``data_col`` once, null as empty.

    The digest is of the bytes before padding. A task keeps one row of each
    digest of a batch, and dropDuplicates() one of each task before it shuffles.
    """
    schema = pa.schema([("digest", pa.string()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches):
        for b in batches:
            kept = {}
            for data in b.column(0).to_pylist():
                data = data or b""
                digest = hashlib.sha256(data).hexdigest()
                if digest not in kept:
                    kept[digest] = (len(data), encode(padded(data)))
            yield C.batch(schema, list(kept), [n for n, _ in kept.values()], [m for _, m in kept.values()])

    return docs.select(F.col(data_col).cast("binary")).mapInArrow(run, "digest string, n_bytes long, media binary").dropDuplicates(["digest"])


_READ = pa.schema([("digest", pa.string()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
_READ_DDL = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_store(store: DataFrame) -> DataFrame:
    """Digests and features of each payload, computed from the stored bytes."""

    def run(batches):
        for b in batches:
            out = [[] for _ in range(6)]
            for media in b.column(2).to_pylist():
                payload = decode(media)
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload))
                for column, value in zip(out, row):
                    column.append(value)
            yield C.batch(_READ, b.column(0), b.column(1), *out)

    return store.mapInArrow(run, _READ_DDL)


def resolve(parsed: DataFrame, resolved: DataFrame) -> DataFrame:
    """The parts of parsed pages as rows, media references joined to ``resolved`` by digest.

    Every part is kept: text, and media that the store lacks, have nulls.
    """
    parts = parsed.select("page_id", F.explode("parts").alias("p")).select("page_id", "p.*")
    digest = F.when(F.col("reference").startswith(SCHEME), F.substring("reference", len(SCHEME) + 1, 64))
    return parts.withColumn("digest", digest).join(resolved, "digest", "left")


def document_pages(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(page_id, html): a page for each document, whose figure refers to the text's bytes by digest."""
    digest = F.sha2(F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary")), 256)
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("none"))
    page = F.concat(F.lit("<article><p>document "), name, F.lit(f'</p><figure><img src="{SCHEME}'), digest, F.lit('"><figcaption>text of '), name, F.lit("</figcaption></figure></article>"))
    return docs.select(F.col(id_col).cast("long").alias("page_id"), page.alias("html"))


def query(spark, sf_dir: str) -> DataFrame:
    """Documents as pages of one caption and one media part, resolved against the store of their texts."""
    docs = C.read(spark, sf_dir, "documents")
    parts = resolve(parse_pages(document_pages(docs)), read_store(build_store(docs)))
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "caption", "position")
    return parts.where("kind = 'media'").select(F.col("page_id").alias("doc_id"), *names)


def pages_query(spark, sf_dir: str) -> DataFrame:
    """The parts of all ``pages``, media resolved against the store of the documents' texts."""
    store = read_store(build_store(C.read(spark, sf_dir, "documents")))
    parts = resolve(parse_pages(C.read(spark, sf_dir, "pages")), store)
    return parts.select("page_id", "position", "kind", "text", "reference", "caption", "payload_sha256")
