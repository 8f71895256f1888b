"""Listings from raw pages: one small per-row parser inside ``mapInPandas``."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from pathlib import PurePosixPath
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import DataFrame

LISTING_SCHEMA = (
    "page_id long, external_key string, url string, raw_title string, raw_price_text string, "
    "raw_stock_text string, image_url string, raw_fragment string"
)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "wbr"}


@dataclass(frozen=True)
class Pick:
    """Where a value sits: tag, optional required attribute, optional attribute to read."""

    tag: str
    where: tuple[str, str] | None = None
    attribute: str | None = None


@dataclass(frozen=True)
class SourceSpec:
    """One source's page layout; ``url`` None means the page itself is the listing."""

    title: Pick
    key: Pick | None = None
    url: Pick | None = None
    price: Pick | None = None
    stock: Pick | None = None
    image: Pick | None = None
    fragment_tag: str = "head"


class _Collector(HTMLParser):
    """First match of each pick, plus the source text of the fragment element."""

    def __init__(self, spec: SourceSpec) -> None:
        super().__init__(convert_charrefs=True)
        self.picks = {
            n: p for n in ("title", "key", "url", "price", "stock", "image") if (p := getattr(spec, n))
        }
        self.values: dict[str, str] = {}
        self.open: dict[str, list[str]] = {}
        self.depth: dict[str, int] = {}
        self.fragment_tag = spec.fragment_tag
        self.span: list[tuple[int, int]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        have = dict(attrs)
        if tag == self.fragment_tag and not self.span:
            self.span.append(self.getpos())
        for name, pick in self.picks.items():
            if name in self.open and tag == pick.tag and tag not in _VOID:
                self.depth[name] += 1
            if name in self.values or name in self.open or tag != pick.tag:
                continue
            if pick.where and have.get(pick.where[0]) != pick.where[1]:
                continue
            if pick.attribute:
                self.values[name] = (have.get(pick.attribute) or "").strip()
            else:
                self.open[name], self.depth[name] = [], 1

    def handle_endtag(self, tag: str) -> None:
        if tag == self.fragment_tag and len(self.span) == 1:
            self.span.append(self.getpos())
        for name in [n for n in self.open if self.picks[n].tag == tag]:
            self.depth[name] -= 1
            if self.depth[name] == 0:
                words = [w.strip() for w in self.open.pop(name)]
                self.values[name] = " ".join(w for w in words if w)

    def handle_data(self, data: str) -> None:
        for chunks in self.open.values():
            chunks.append(data)


def _fragment(html: str, span: list[tuple[int, int]], tag: str) -> str:
    if not span:
        return ""
    starts = [0]
    for line in html.split("\n"):
        starts.append(starts[-1] + len(line) + 1)
    begin = starts[span[0][0] - 1] + span[0][1]
    end = starts[span[1][0] - 1] + span[1][1] + len(tag) + 3 if len(span) > 1 else len(html)
    return html[begin:end]


def parse_listing(html: str, page_url: str, spec: SourceSpec) -> dict[str, str | None] | None:
    """The page's listing, or None without a url or title."""
    collector = _Collector(spec)
    collector.feed(html)
    got = {name: value or None for name, value in collector.values.items()}
    link = got.get("url") if spec.url else page_url
    if not link or not got.get("title"):
        return None
    url = urljoin(page_url, link)
    image = got.get("image")
    return {
        "external_key": got.get("key") or PurePosixPath(urlparse(url).path.rstrip("/")).name or url,
        "url": url,
        "raw_title": got["title"],
        "raw_price_text": got.get("price"),
        "raw_stock_text": got.get("stock"),
        "image_url": urljoin(page_url, image) if image else None,
        "raw_fragment": _fragment(html, collector.span, spec.fragment_tag) or html,
    }


def extract_html_listings(pages: DataFrame, spec: SourceSpec) -> DataFrame:
    """``pages`` (page_id, url, html) -> listing rows; each page is read whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [part.split()[0] for part in LISTING_SCHEMA.split(", ")]
        for pdf in batches:
            rows = []
            for page_id, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"], strict=True):
                listing = parse_listing(html or "", url, spec)
                if listing:
                    rows.append({"page_id": page_id, **listing})
            yield pd.DataFrame(rows, columns=columns)

    return pages.select("page_id", "url", "html").mapInPandas(run, LISTING_SCHEMA)
