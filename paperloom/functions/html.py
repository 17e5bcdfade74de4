"""HTML scanning in Arrow batches with the standard library's parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HIDDEN = frozenset(("script", "style", "template", "noscript"))


class _Scan(HTMLParser):
    """Anchors, table rows, texts of titles and headings, meta contents and label-value pairs of a document."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.anchors: list[tuple[str, str]] = []
        self.rows: list[list[str]] = []
        self.links: list[list[str | None]] = []  # first link of each cell
        self.texts: dict[str, str] = {}
        self.metas: dict[str, str] = {}
        self.pairs: list[tuple[str, str]] = []
        self.all: list[str] = []
        self._open: list[tuple[str, list[str]]] = []
        self._href: list[tuple[str, list[str]]] = []
        self._row: list[list[str]] | None = None
        self._row_links: list[str | None] = []
        self._hidden = 0
        self._label: str | None = None

    def handle_starttag(self, tag, attrs):
        values = {k: v or "" for k, v in attrs}
        if tag in _HIDDEN:
            self._hidden += 1
        if tag == "meta":
            name = values.get("name") or values.get("property")
            if name and name not in self.metas:
                self.metas[name] = squeeze(values.get("content", ""))
        if tag == "a":
            self._href.append((values.get("href", ""), []))
            if self._row_links and self._row is not None and not self._row_links[-1]:
                self._row_links[-1] = values.get("href") or None
        if tag == "tr":
            self._row, self._row_links = [], []
        if tag in ("td", "th") and self._row is not None:
            self._row.append([])
            self._row_links.append(None)
        if tag in ("br", "p", "div", "li", "td", "th", "dd", "dt"):
            self._text(" ")
        if tag in ("title", "h1", "h2", "h3", "th", "dt", "label", "strong", "b", "td", "dd"):
            self._open.append((tag, []))

    def handle_endtag(self, tag):
        if tag in _HIDDEN:
            self._hidden = max(0, self._hidden - 1)
        if tag == "a" and self._href:
            href, parts = self._href.pop()
            if href:
                self.anchors.append((href, squeeze("".join(parts))))
        if tag == "tr" and self._row is not None:
            self.rows.append([squeeze("".join(c)) for c in self._row])
            self.links.append(self._row_links)
            self._row = None
        if any(t == tag for t, _ in self._open):
            while self._open:
                t, parts = self._open.pop()
                if t == tag:
                    text = squeeze("".join(parts))
                    if tag in ("title", "h1", "h2", "h3"):
                        self.texts.setdefault(tag, text)
                    if tag in ("th", "dt", "label", "strong", "b") and not (self._label and any(x in ("td", "dd") for x, _ in self._open)):
                        self._label = text.rstrip(":").strip()
                    elif tag in ("td", "dd") and self._label:
                        self.pairs.append((self._label, text))
                        self._label = None
                    break

    def handle_data(self, data):
        self._text(data)

    def _text(self, data: str) -> None:
        if self._hidden:
            return
        self.all.append(data)
        for _, parts in self._href:
            parts.append(data)
        if self._row:
            self._row[-1].append(data)
        for _, parts in self._open:
            parts.append(data)


def squeeze(text: str) -> str:
    return " ".join(text.split())


def scan_html(html: str | None) -> _Scan:
    scan = _Scan()
    scan.feed(html or "")
    scan.close()
    while scan._href:
        href, parts = scan._href.pop()
        if href:
            scan.anchors.append((href, squeeze("".join(parts))))
    return scan


def strip_tags(text: str) -> str:
    """Text outside of tags; a `>` that closes no tag stays."""
    return re.sub(r"<[^<>]*>", " ", text)


# Entities that are decoded one after the other, & first.
_ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))


def decode_entities(text: str) -> str:
    for a, b in _ENTITIES:
        text = text.replace(a, b)
    return text


def scan_udf():
    """UDF that gives all of a document's parts as one struct."""
    return F.pandas_udf(_scan_batch, _SCAN)


_SCAN = ("struct<anchors:array<struct<href:string,label:string>>,rows:array<array<string>>,links:array<array<string>>,title:string,h1:string,metas:map<string,string>,pairs:array<struct<k:string,v:string>>,text:string>")


def _scan_batch(html: pd.Series) -> pd.DataFrame:
    scans = [scan_html(x) for x in html]
    return pd.DataFrame({
        "anchors": [[{"href": h, "label": t} for h, t in s.anchors] for s in scans],
        "rows": [[r for r in s.rows] for s in scans],
        "links": [[r for r in s.links] for s in scans],
        "title": [s.texts.get("title") for s in scans],
        "h1": [s.texts.get("h1") for s in scans],
        "metas": [s.metas for s in scans],
        "pairs": [[{"k": k, "v": v} for k, v in s.pairs] for s in scans],
        "text": [squeeze("".join(s.all)) for s in scans],
    })


def _plain_batch(html: pd.Series) -> pd.Series:
    return html.map(lambda x: None if x is None else decode_entities(squeeze(strip_tags(x))))


def plain_text():
    """UDF: tags to blanks, white space squeezed, then entities decoded."""
    return F.pandas_udf(_plain_batch, "string")
