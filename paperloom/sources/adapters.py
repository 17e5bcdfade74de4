"""Listings of the sources as rows for `records_of`: HTML anchors and tables, JSON answers, CSV indexes, and the
operators that only some sources have."""

from __future__ import annotations

import json
import urllib.parse
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text, url
from paperloom.functions.html import scan_udf
from paperloom.operators.search import InvalidRequest
from paperloom.sources.base import ASSETS, RECORD, Source, allowed, listed_links, merge_duplicates, mime_of, records_of, role_of


class SourceChanged(RuntimeError):
    """A page no longer has the shape that its source's rules read."""


def html_rows(source: Source, documents: DataFrame) -> DataFrame:
    """Rows of the allowed links of listing pages (ord, page_url, html); a source with tables has their rows first, and
    with what its links tell beside the address (a case number, a data set, a part)."""
    links = listed_links(source, documents)
    if source.columns:
        rows = table_rows(source, documents, source.columns)
        named = [F.lit(None).cast("string").alias(c) for c in ("title", "date", "description")]
        rest = links.join(rows.select("document_url").distinct(), "document_url", "left_anti")
        return rows.unionByName(rest.select("ord", (F.col("pos") + 1_000_000).alias("pos"), "document_url", "label", *named, F.create_map().cast("map<string,string>").alias("extra")))
    told = {
        "state": {"case_number": url.parameter(F.col("document_url"), "caseNumber")},
        "doj_epstein": {"data_set": data_set_number(F.col("document_url"), F.col("label"))},
        "fbi_vault": {"part": part_number(F.col("label")).cast("string")},
    }.get(source.name)
    if not told:
        return links
    return links.withColumn("extra", F.map_filter(F.create_map(*[x for k, v in told.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull()))


def table_rows(source: Source, documents: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows of the tables of listing pages by position of their cells: the first link of a row that may be listed and
    is one of the source's files is the record's. `columns` names the cells: title, subject, keywords, date, ... ; an
    empty name skips one. Topic and office together are a description."""
    scanned = documents.select("ord", "page_url", scan_udf()(F.col("html")).alias("s"))
    rows = scanned.select("ord", "page_url", F.posexplode(F.arrays_zip("s.rows", "s.links")).alias("row", "c")).select("ord", "page_url", "row", F.col("c.rows").alias("cells"), F.col("c.links").alias("links"))
    linked = rows.select("ord", "page_url", "row", "cells", F.posexplode("links").alias("cell", "href")).filter("href IS NOT NULL")
    linked = text.once(linked, document_url=url.canonical(url.absolutize(F.col("href"), F.col("page_url"))))
    parts, condition = allowed(source, F.col("document_url"))
    kept = text.once(linked, **parts, l=F.lower(F.get("cells", F.col("cell")))).filter(condition).filter(source.file)
    first = kept.groupBy("ord", "row").agg(F.min_by(F.struct("document_url", "cells", "cell"), "cell").alias("r")).select("ord", F.col("row").alias("pos"), "r.*")
    named = {c: F.nullif(F.get("cells", F.lit(i)), F.lit("")) for i, c in enumerate(columns) if c}
    extra = F.map_filter(F.create_map(*[x for c, v in named.items() if c not in ("title", "date", "description") for x in (F.lit(c), v)]), lambda k, v: v.isNotNull())
    if {"topic", "office"} <= set(named):
        named["description"] = F.nullif(F.concat_ws("; ", named["topic"], named["office"]), F.lit(""))
    label = F.get("cells", F.col("cell"))
    return first.select("ord", "pos", "document_url", label.alias("label"), *[named.get(c, F.lit(None).cast("string")).alias(c) for c in ("title", "date", "description")], extra.alias("extra"))


def first_array(payload: str, names: tuple[str, ...] = ("records", "body", "results", "items", "hits")) -> list[dict] | None:
    """The first array under one of the names, wherever it is nested; elements' `_source` is unwrapped."""

    def walk(x):
        if isinstance(x, list):
            return x
        if isinstance(x, dict):
            for n in names:
                if n in x:
                    found = walk(x[n])
                    if found is not None:
                        return found
        return None

    try:
        found = walk(json.loads(payload))
    except (ValueError, RecursionError):
        return None
    return None if found is None else [x.get("_source", x) for x in found if isinstance(x, dict)]


def _json_rows(read):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for o, payload in zip(frame["ord"], frame["payload"]):
                for i, item in enumerate(first_array(payload) or []):
                    row = read(item)
                    if row:
                        out.append({"ord": o, "pos": i, **row})
            yield pd.DataFrame(out, columns=["ord", "pos", "document_url", "label", "source_id", "title", "date", "description", "extra", "assets"])

    return run


_JSON_ROWS = "ord int, pos int, document_url string, label string, source_id string, title string, date string, description string, extra map<string,string>, assets " + ASSETS


def _text(x) -> str | None:
    return None if x is None or isinstance(x, (dict, list)) or not str(x).strip() else str(x).strip()


def _addresses(x) -> Iterator[str]:
    """Every string in a JSON value that is a web address, in order."""
    if isinstance(x, str):
        if x.startswith(("http://", "https://")):
            yield x
    elif isinstance(x, (list, dict)):
        for y in x.values() if isinstance(x, dict) else x:
            yield from _addresses(y)


# Parts of an address that tell a digital object's role, in order, and its type.
OBJECTS = ((".pdf", "pdf", "application/pdf"), (".png", "image", "image/png"), (".gif", "image", "image/gif"), (".tif", "image", "image/tiff"), (".jpg", "image", "image/jpeg"), (".jpeg", "image", "image/jpeg"), (".txt", "ocr_text", "text/plain"), ("ocr", "ocr_text", "text/plain"))
OBJECT_LABELS = {"pdf": "PDF", "image": "Digital object image", "ocr_text": "OCR text"}


def digital_objects(item: dict) -> list[dict]:
    """Attachments for the addresses in a catalogue record that are a PDF, an image or recognised text, each once."""
    out = {}
    for address in _addresses(item):
        kind = next(((role, mime) for part, role, mime in OBJECTS if part in address.lower()), None)
        if kind and address not in out:
            name = address.rsplit("/", 1)[-1].split("?")[0].split("#")[0]
            out[address] = {"asset_url": address, "label": name or OBJECT_LABELS[kind[0]], "mime_type": kind[1], "role": kind[0]}
    return list(out.values())


def _nara(item: dict) -> dict | None:
    sid = _text(item.get("naId"))
    if not sid:
        return None
    objects = digital_objects(item)
    extra = {k: _text(v[0] if isinstance(v, list) and v else v) for k, v in item.items()} | {"object_count": str(len(objects)), "object_url": objects[0]["asset_url"] if objects else None}
    return {"document_url": f"https://catalog.archives.gov/id/{sid}", "label": _text(item.get("title")), "source_id": sid, "title": _text(item.get("title")), "date": _text(item.get("inclusiveStartDate")), "description": _text(item.get("scopeAndContentNote")), "extra": {k: v for k, v in extra.items() if v}, "assets": objects or None}


# Download links in order with role and type; others follow by name.
DOWNLOADS = {"pdfLink": ("pdf", "application/pdf"), "xmlLink": ("other", "application/xml"), "modsLink": ("other", "application/mods+xml"), "txtLink": ("transcript", "text/plain"), "htmLink": ("html", "text/html"), "zipLink": ("other", None), "premisLink": ("other", None)}
OF_PACKAGE = ("zipLink", "premisLink")


def download_assets(links: dict, package: str, granule: str | None) -> list[dict]:
    """Attachments for a package's or granule's download links: only those of the official interface that are of this
    package and granule (archives and preservation data may be the package's); the PDF by its public address."""
    coded = urllib.parse.quote(package, safe="-_.~")
    own = urllib.parse.quote(granule, safe="-_.~") if granule else None
    out: dict[str, dict] = {}
    for key in [*DOWNLOADS, *sorted(set(links) - set(DOWNLOADS))]:
        address = _text(links.get(key))
        at = urllib.parse.urlsplit(address or "")
        if at.scheme != "https" or at.netloc.lower() != "api.govinfo.gov" or not at.path.startswith(f"/packages/{coded}/"):
            continue
        head, _, tail = at.path.partition(f"/packages/{coded}/granules/")
        of_granule = head == "" and at.path.startswith(f"/packages/{coded}/granules/")
        if (of_granule and (own is None or tail.split("/")[0] != own)) or (own is not None and not of_granule and key not in OF_PACKAGE):
            continue
        role, mime = DOWNLOADS.get(key, ("other", None))
        final = f"https://www.govinfo.gov/content/pkg/{coded}/pdf/{own or coded}.pdf" if key == "pdfLink" else address
        out.setdefault(final, {"asset_url": final, "label": key.removesuffix("Link").upper(), "mime_type": mime, "role": role})
    return list(out.values())


def _govinfo(item: dict) -> dict | None:
    package, granule = _text(item.get("packageId")), _text(item.get("granuleId"))
    if not package:
        return None
    sid = f"{package}/{granule}" if granule else package
    extra = {"collectionCode": _text(item.get("collectionCode")), "lastModified": _text(item.get("lastModified")), "authors": " | ".join(dict.fromkeys(item.get("governmentAuthor") or [])) or None}
    assets = download_assets(item.get("download") or {}, package, granule)
    return {"document_url": f"https://www.govinfo.gov/app/details/{sid}", "label": _text(item.get("title")), "source_id": sid, "title": _text(item.get("title")), "date": _text(item.get("dateIssued")), "description": None, "extra": {k: v for k, v in extra.items() if v}, "assets": assets or None}


_READERS = {"nara": _nara, "govinfo": _govinfo}


def json_rows(source: Source, payloads: DataFrame) -> DataFrame:
    """Rows of JSON answers (ord, payload). An answer without any list of records gives none; see `check_payloads`."""
    if source.name not in _READERS:
        raise InvalidRequest(f"{source.name} doesn't answer in JSON")
    return payloads.select("ord", "payload").mapInPandas(_json_rows(_READERS[source.name]), _JSON_ROWS)


def check_payloads(payloads: DataFrame, marks: tuple[str, ...]) -> None:
    """Raises SourceChanged if an answer has none of the marks that every answer of its source has."""
    has_mark = F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains("payload", m))
    missing = payloads.filter(~F.coalesce(has_mark, F.lit(False))).select("ord").limit(1).collect()
    if missing:
        raise SourceChanged(f"answer {missing[0][0]} has none of {', '.join(marks)}")


# Names that a field goes by in the index files.
CSV_ALIASES = {
    "document_url": ("url", "link", "fileurl", "documenturl"), "title": ("title", "filename", "name"), "source_id": ("virin", "id", "recordid"),
    "date": ("incidentdate", "date", "releasedate"), "description": ("description", "summary"), "agency": ("agency", "originatingagency"), "incident_location": ("incidentlocation", "location"), "type": ("type", "mediatype"), "release": ("release", "releasename"),
}


def normal_name(name: str) -> str:
    """Letters and digits of a column's name in lower case."""
    return "".join(c for c in name.lower() if c.isalnum())


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """An index file: quoted fields may hold line ends and doubled quotes, fields are trimmed, empty lines dropped."""
    raw = spark.read.options(header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).csv(path)
    return raw.filter(F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in raw.columns]).isNotNull())


def csv_rows(source: Source, index: DataFrame) -> DataFrame:
    """Rows of an index table, fields found by any of their names, the first non-blank one taken."""
    by_name: dict[str, list[str]] = {}
    for c in index.columns:
        by_name.setdefault(normal_name(c), []).append(c)

    def field(key: str) -> Column:
        found = [F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for n in CSV_ALIASES[key] for c in by_name.get(n, [])]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    extra = F.map_filter(F.create_map(*[x for k in ("agency", "incident_location", "type", "release") for x in (F.lit(k), field(k))]), lambda k, v: v.isNotNull())
    return index.select(
        F.lit(0).alias("ord"), F.monotonically_increasing_id().alias("pos"), field("document_url").alias("document_url"), field("title").alias("label"), field("source_id").alias("source_id"), field("title").alias("title"),
        field("date").alias("date"), field("description").alias("description"), extra.alias("extra"),
    ).filter("document_url IS NOT NULL")


# --- operators of single sources --------------------------------------------------------------------------------


def part_number(label: Column) -> Column:
    """Number after `part`; null without one or over 65535."""
    n = F.regexp_extract(F.lower(label), r"part[^0-9]*([0-9]+)", 1)
    value = F.when(n != "", n.try_cast("bigint"))
    return F.when(value <= 65535, value.cast("int"))


def part_order(label: Column) -> tuple[Column, Column]:
    """Sort keys that put parts by number, labels without one last."""
    return F.coalesce(part_number(label), F.lit(65535)), F.lower(label)


def data_set_number(source_id: Column, title: Column) -> Column:
    """Digits behind `data-set-` in the id, else behind `data set ` in the title (in any case), as they are written."""
    pick = lambda c, pattern: F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))
    return F.coalesce(pick(source_id, r"\A.*?data-set-([0-9]*)"), pick(F.lower(title), r"\A.*?data set ([0-9]*)"))


def accessions(query: Column) -> Column:
    """Distinct accession numbers in a text, in order: `AD` and letters or digits, 7 to 16 characters in all."""
    words = F.transform(F.split(F.upper(query), "[^A-Za-z0-9]+"), lambda w: w)
    return F.array_distinct(F.filter(words, lambda w: w.rlike(r"\AAD[A-Z0-9]{5,14}\z")))


# Agencies by what names them, and the one that is meant otherwise.
AGENCIES = (
    ("Department of Homeland Security (DHS)", ("department of homeland security", "kona blue")), ("National Archives and Records Administration (NARA)", ("national archives", "nara")),
    ("National Aeronautics and Space Administration (NASA)", ("nasa",)), ("Oak Ridge National Laboratory (ORNL)", ("oak ridge", "ornl")),
)
OTHER_AGENCY = "All-domain Anomaly Resolution Office (AARO)"


def agency_of(described: Column) -> Column:
    """First agency that a text names."""
    out = F.lit(OTHER_AGENCY)
    for agency, marks in reversed(AGENCIES):
        named = F.lit(False)
        for m in marks:
            named = named | F.contains(F.lower(described), F.lit(m))
        out = F.when(named, F.lit(agency)).otherwise(out)
    return out


def labelled_metadata(pairs: Column, aliases: dict[str, tuple[str, ...]]) -> Column:
    """Map of the fields whose label, in letters and digits of lower case, contains one of their names; the first pair
    with a value counts."""
    entries = []
    for key, names in aliases.items():
        values = F.transform(F.filter(pairs, _fits(names)), lambda p: p["v"])
        entries += [F.lit(key), F.get(values, F.lit(0))]
    return F.map_filter(F.create_map(*entries), lambda k, v: v.isNotNull())


def _fits(names: tuple[str, ...]):
    def test(p: Column) -> Column:
        label = F.regexp_replace(F.lower(p["k"]), "[^a-z0-9]", "")
        found = F.lit(False)
        for n in names:
            found = found | F.contains(label, F.lit(n))
        return found & (p["v"] != "")

    return test


def joined_entities(names: Column) -> Column:
    """Distinct non-blank names in order, joined by a bar."""
    return F.array_join(F.array_distinct(F.filter(F.transform(names, text.squeeze), lambda n: n != "")), " | ")


def pdf_before_appendix(attachments: Column) -> Column:
    """URL of the first PDF that isn't an appendix, else of the first PDF."""
    pdfs = F.filter(attachments, lambda a: a["role"] == "pdf")
    ranked = F.transform(pdfs, lambda a, i: F.struct(F.contains(F.lower(F.coalesce(a["label"], F.lit(""))), F.lit("appendix")).alias("x"), i.alias("i"), a["asset_url"].alias("u")))
    return F.array_min(ranked)["u"]


def detail_record(source: Source, document: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Record of a detail page (page_url, html): the heading is its title, allowed asset links its attachments, labelled
    values its metadata. A page without heading, text and assets gives none."""
    page = document.select("page_url", scan_udf()(F.col("html")).alias("s"))
    title = text.first_non_empty(F.col("s.h1"), F.col("s.title"), F.lit(""))
    assets = listed_links(source, document.withColumn("ord", F.lit(0))).filter(F.lower(url.without_query(F.col("document_url"))).rlike(r"\.(pdf|txt|zip|html?|jpe?g|png|mp4)\z"))
    role = role_of(F.col("document_url"), F.col("label"))
    found = assets.groupBy().agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.struct(F.col("document_url").alias("asset_url"), F.col("label"), mime_of(role).alias("mime_type"), role.alias("role")).alias("a")))), lambda x: x["a"]).alias("attachments"))
    told = labelled_metadata(F.col("s.pairs"), aliases)
    if source.name == "aaro":
        told = F.map_concat(F.map_filter(told, lambda k, v: k != "originating_agency"), F.create_map(F.lit("originating_agency"), agency_of(F.concat_ws(" ", title, F.col("s.text")))))
    rows = page.select(F.lit(0).alias("ord"), F.lit(0).alias("pos"), F.col("page_url").alias("document_url"), title.alias("label"), F.left("s.text", F.lit(320)).alias("text_preview"), told.alias("extra"), "s.text")
    record = records_of(source, rows.filter("label IS NOT NULL OR text <> ''"))
    attachments = found.first()["attachments"] if not found.isEmpty() else []
    own = F.from_json(F.lit(json.dumps([a.asDict() for a in attachments or []])), "array<struct<asset_url:string,label:string,mime_type:string,role:string>>")
    return record.withColumn("attachments", own).withColumn("pdf_url", pdf_before_appendix(F.col("attachments"))).drop("ord", "pos").select(*[c.split(" ")[0] for c in RECORD.split(", ")])
