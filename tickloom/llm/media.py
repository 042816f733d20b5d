"""Interleaved documents: HTML as an ordered sequence of texts and media references, payloads joined by digest.

Media are stored losslessly as binary greymaps (PGM): 64 samples of 8 bits in a row. A reference is an `img` whose `src`
is `sha256:` and the payload's digest; its caption is the `figcaption` of its figure, else its `alt`.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import folder, kept, per_text

WIDTH = 64
#: Paragraphs after which a document's page has its picture again.
EVERY = 4
#: Fixed values of HTML: elements whose end or start parts text, and those whose text isn't shown.
BLOCKS = {"address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "figure", "figcaption", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul"}
HIDDEN = {"script", "style", "title", "template"}
ITEM = "struct<pos:int,kind:string,text:string,ref:string,caption:string>"


class _Sequence(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.hidden = 0
        #: Of each open figure: its media, the parts of an open caption, the last whole caption and the item it stands before.
        self.figures: list[dict] = []

    def part(self) -> None:
        text, self.text = "".join(self.text), []
        if self.figures and self.figures[-1]["open"] is not None:
            self.figures[-1]["open"].append(text)
        elif text.strip():
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def end_caption(self) -> None:
        if self.figures and (parts := self.figures[-1]["open"]) is not None:
            self.figures[-1] |= {"open": None, "caption": "".join(parts).strip(), "at": len(self.items)}

    def end_figure(self) -> None:
        """The caption goes to all of the figure's media, before and behind it; without media it is text."""
        self.end_caption()
        figure = self.figures.pop()
        if figure["caption"] is not None:
            for item in figure["media"]:
                item["caption"] = figure["caption"]
            if figure["caption"] and not figure["media"]:
                self.items.insert(figure["at"], {"kind": "text", "text": figure["caption"], "ref": None, "caption": None})

    def close(self) -> None:
        super().close()
        self.part()
        while self.figures:
            self.end_figure()
        self.items = [{"pos": k} | item for k, item in enumerate(self.items)]

    def handle_starttag(self, tag, attrs) -> None:
        at = dict(attrs)
        if tag in HIDDEN:
            self.hidden += 1
        if self.hidden:
            return
        if tag in BLOCKS or tag == "img":
            self.part()
        if tag == "figure":
            self.figures.append({"media": [], "open": None, "caption": None, "at": 0})
        elif tag == "figcaption" and self.figures:
            self.end_caption()
            self.figures[-1]["open"] = []
        elif tag == "img":
            ref = (at.get("src") or "").removeprefix("sha256:")
            self.items.append({"kind": "media", "text": None, "ref": ref, "caption": at.get("alt")})
            if self.figures:
                self.figures[-1]["media"].append(self.items[-1])

    def handle_endtag(self, tag) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if self.hidden:
            return
        if tag in BLOCKS:
            self.part()
        if tag == "figcaption":
            self.end_caption()
        elif tag == "figure" and self.figures:
            self.end_figure()

    def handle_data(self, data) -> None:
        if not self.hidden:
            self.text.append(data)


def sequence(page: str | None) -> list[dict]:
    """The items of a page in order, numbered from 0. Null and empty pages have none. What is hidden, media too, doesn't count;
    a figcaption outside of a figure is text. Captions belong to all media of their figure."""
    p = _Sequence()
    p.feed(page or "")
    p.close()
    return p.items


def padded(text: bytes | None) -> bytes:
    """text and zeros up to a positive multiple of WIDTH."""
    text = text or b""
    return text + bytes(-len(text) % WIDTH if text else WIDTH)


def stored(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def samples(media: bytes) -> bytes:
    """The payload of a stored greymap."""
    m = re.match(rb"P5\s+(\d+)\s+(\d+)\s+255\s", media)
    if not m or len(media) - m.end() != int(m[1]) * int(m[2]):
        raise ValueError("not a greymap of 8 bits")
    return media[m.end() :]


def feature(payload: bytes) -> str:
    """Mean, standard deviation and entropy in bits of the samples, and the mean step between neighbours."""
    x = np.frombuffer(payload, np.uint8)
    p = np.bincount(x, minlength=256) / len(x)
    mean = float(p @ np.arange(256))
    deviation = float(np.sqrt(max(0.0, p @ np.arange(256.0) ** 2 - mean**2)))
    entropy = -float(p[p > 0] @ np.log2(p[p > 0]))
    step = float(np.abs(np.diff(x.astype(np.int16))).mean())
    return f"{mean:.3f} {deviation:.3f} {entropy:.3f} {step:.3f}"


def caption(k: int, text: str | None) -> str:
    return f"picture {k} of {len(text or '')} characters"


def page_of(text: str | None, ref: str) -> str:
    """A document as a page: its picture, and again after each EVERY paragraphs, between them; captions stand behind and in
    front of the pictures by turns. The paragraphs are the lines that aren't blank."""

    def figure(k: int) -> str:
        parts = f'<img src="sha256:{ref}" alt="">', f"<figcaption>{caption(k, text)}</figcaption>"
        return f"<figure>{''.join(parts if k % 2 else parts[::-1])}</figure>"

    out = [figure(1)]
    for n, x in enumerate((x for x in (text or "").split("\n") if x.strip()), 1):
        out.append(f"<p>{html.escape(x, quote=False)}</p>")
        if n % EVERY == 0:
            out.append(figure(1 + n // EVERY))
    return f"<article>{''.join(out)}</article>"


def write_media(docs: DataFrame, path: str) -> None:
    """The media of docs (text) at path: digest (of the payload) and media, a row for each text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                payloads = [padded(x.as_py()) for x in b.column(0).slice(at, 256)]
                digest, media = [hashlib.sha256(x).hexdigest() for x in payloads], [stored(x) for x in payloads]
                yield pa.RecordBatch.from_arrays([pa.array(digest), pa.array(media, pa.binary())], ["digest", "media"])

    docs.select(F.col("text").cast("binary")).mapInArrow(rows, "digest string, media binary").write.option("compression", "zstd").parquet(path)


FEATURES = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def examined(media: DataFrame) -> DataFrame:
    """media (digest, media) -> digest and FEATURES, from the bytes as stored."""

    def one(x: bytes) -> tuple:
        p = samples(x)
        return (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-WIDTH:]), len(x), hashlib.sha256(x).hexdigest(), feature(p))

    return per_text(media.select("digest", "media"), FEATURES, lambda: one, text="media")


def parsed(pages: DataFrame, page: str = "page") -> DataFrame:
    """The other columns of pages, and items: array of ITEM, the page's texts and references in order."""
    rest = [f for f in pages.schema.fields if f.name != page]
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                items = pa.array([sequence(x.as_py()) for x in part.column(len(rest))], kind)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(rest))), items], [*(f.name for f in rest), "items"])

    from pyspark.sql.types import StructType

    return pages.select(*[f.name for f in rest], page).mapInArrow(rows, StructType([*rest, *StructType.fromDDL(f"items array<{ITEM}>").fields]))


def resolved(sequences: DataFrame, key: str, media: DataFrame) -> DataFrame:
    """A row for each payload that a page of sequences (key, items) refers to: key, ref, places (position and caption of each
    reference, in order), and the columns of media (digest, one row for each) joined by digest; one without payload has nulls.
    Pages without media have no row."""
    refs = F.expr("filter(items, x -> x.kind = 'media')")
    each = sequences.select(key, refs.alias("refs")).select(key, "refs", F.explode(F.array_distinct(F.transform("refs", lambda x: x["ref"]))).alias("ref"))
    places = F.transform(F.filter("refs", lambda x: x["ref"] == F.col("ref")), lambda x: F.struct(x["pos"].alias("pos"), x["caption"].alias("caption")))
    return each.select(key, "ref", places.alias("places")).join(media, F.col("ref") == F.col("digest"), "left").drop("digest")


def interleaved(pages: DataFrame, key: str, media: DataFrame, page: str = "page") -> DataFrame:
    """pages (key, page) -> key, items: each page's texts and media in order, as ITEM with a struct `payload` of the columns of
    media (digest, one row for each) that the reference leads to; null for texts and for references without payload.

    key tells pages apart; of null keys, all payloads are looked up together. A null or empty page has no items.
    """
    sequences = kept(parsed(pages.select(key, page), page), "sequences")
    columns = [c for c in media.columns if c != "digest"]
    found = resolved(sequences, key, media).where(F.coalesce(*[F.col(c).isNotNull() for c in columns]))
    by_ref = found.groupBy(F.col(key).alias("of")).agg(F.map_from_entries(F.collect_set(F.struct("ref", F.struct(*columns).alias("payload")))).alias("payloads"))
    both = sequences.join(by_ref, F.col(key).eqNullSafe(F.col("of")), "left")
    return both.select(key, F.transform("items", lambda x: x.withField("payload", F.try_element_at("payloads", F.coalesce(x["ref"], F.lit(""))))).alias("items"))


def columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, FEATURES and items for each row of docs (doc_id, text): its text as a media payload, read back from an
    interleaved page. items is the page's sequence: position, kind, length of a text, caption of a picture.

    A null text is empty; an empty one has 64 zero bytes as payload. Texts however long are one payload. Equal texts have one
    digest and share a payload's features. Other columns are ignored; repeated rows stay. No rows: no rows.
    """
    spark = docs.sparkSession
    path = folder(spark, "media")
    write_media(docs, path)
    store = spark.read.schema("digest string, media binary").parquet(path)
    features = kept(examined(store).distinct(), "features")
    light = F.transform("items", lambda x: F.struct(x["pos"].alias("pos"), x["kind"].alias("kind"), F.length(x["text"]).alias("n_chars"), x["caption"].alias("caption"), x["ref"].alias("ref")))
    pages = parsed(paged(docs)).select(F.struct("who", F.transform(light, lambda x: x.dropFields("ref")).alias("items")).alias("page"), light.alias("items"))
    return resolved(pages, "page", features).select("page.who.doc_id", "page.who.n_bytes", *[x.split(" ")[0] for x in FEATURES.split(", ")], "page.items")


def paged(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> who (doc_id, n_bytes), page: the interleaved page of each document."""

    def one(text: bytes | None) -> tuple:
        return (len(text or b""), page_of((text or b"").decode("utf-8", "replace"), hashlib.sha256(padded(text)).hexdigest()))

    made = per_text(docs.select("doc_id", "text"), "n_bytes bigint, page string", lambda: one)
    return made.select(F.struct("doc_id", "n_bytes").alias("who"), "page")
