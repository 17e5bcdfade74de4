"""What all sources share: the record schema, the specification of a source, and the steps of a listing."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import ident, text, url
from paperloom.functions.html import scan_udf
from paperloom.operators.search import InvalidRequest

RECORD = (
    "id string, document_key string, source string, source_id string, title string, date string, collection string, record_group string, description string, "
    "origin_url string, document_url string, pdf_url string, metadata map<string,string>, attachments array<struct<asset_url:string,label:string,mime_type:string,role:string>>, "
    "text_preview string, citation_note string, terms_note string"
)
MAX_LIMIT = 50


ASSETS = "array<struct<asset_url:string,label:string,mime_type:string,role:string>>"


@dataclass(frozen=True)
class Source:
    """Specification of a source. Conditions are SQL over `raw` (URL), `u` (URL in lower case), `path` and `p` (path as
    it is and in lower case), `l` or `t` (label or title in lower case) and `same` (same scheme and host as the base).

    `allow` tells which addresses may be listed, `leads` which of them are records. `categories` and `groups` give the
    first value whose condition holds; `collections` and `descriptions` go by the group. `columns` name the cells of the
    source's tables, `file` tells which link of a row is the record's.
    """

    name: str
    base: str
    collection: str
    kind: str  # html, html_table, json, csv
    allow: str
    home: str
    fields: tuple[str, ...]
    dedupe: str = "source_id"
    asset_order: str = "documents"
    lower_label: bool = True
    navigation: tuple[str, ...] = ("",)
    leads: str = "true"
    categories: tuple[tuple[str, str], ...] = ()
    category_key: str = "category"
    groups: tuple[tuple[str, str], ...] = ()
    collections: tuple[tuple[str, str], ...] = ()
    columns: tuple[str, ...] = ()
    file: str = "true"
    cursor: str | None = None  # page, offset or mark


def matches_query(query: str, fields: tuple[str, ...], metadata: bool = False) -> Column:
    """Whether the fields together, in lower case, have every word of the query. An empty query matches all, and so
    does every query where there are no fields: the source has searched itself."""
    if not fields and not metadata:
        return F.lit(True)
    parts = [F.coalesce(F.col(f), F.lit("")) for f in fields]
    if metadata:
        parts.append(F.array_join(F.map_values(F.coalesce("metadata", F.create_map().cast("map<string,string>"))), " "))
    hay = F.lower(F.concat_ws(" ", *parts))
    return reduce(lambda a, b: a & b, [F.contains(hay, F.lit(w)) for w in query.lower().split()], F.lit(True))


def role_of(u: Column, label: Column) -> Column:
    low, name = F.lower(url.without_query(u)), F.lower(F.coalesce(label, F.lit("")))
    ends = lambda *x: reduce(lambda a, b: a | b, [low.endswith(e) for e in x])
    return (
        F.when(ends(".pdf") | name.endswith(".pdf"), "pdf").when(ends(".txt"), "ocr_text").when(ends(".html", ".htm"), "html")
        .when(ends(".jpg", ".jpeg", ".png", ".gif", ".tif", ".tiff", ".webp"), "image").when(ends(".vtt", ".srt"), "transcript").otherwise("other")
    )


def mime_of(role: Column) -> Column:
    return F.when(role == "pdf", "application/pdf").when(role == "ocr_text", "text/plain").when(role == "html", "text/html")


def allowed(source: Source, u: Column) -> tuple[dict[str, Column], str]:
    """Columns and the condition over them that tells whether the source may list the URL."""
    wanted = {"raw": u, "u": F.lower(u), "path": url.path(u), "p": F.lower(url.path(u)), "same": url.same_origin(u, F.lit(source.base))}
    return wanted, source.allow


def listed_links(source: Source, documents: DataFrame) -> DataFrame:
    """Links of listing pages (page_url, html, in the order of `ord`): ord, pos, document_url, label; only those that
    the source's rules allow, without navigation."""
    scanned = documents.select("ord", "page_url", scan_udf()(F.col("html")).alias("s"))
    links = scanned.select("ord", "page_url", F.posexplode("s.anchors").alias("pos", "a"))
    links = text.once(links, absolute=url.absolutize(F.col("a.href"), F.col("page_url")), label=text.squeeze(F.col("a.label")))
    links = text.once(links, document_url=url.canonical(F.col("absolute")))
    parts, condition = allowed(source, F.col("document_url"))
    kept = text.once(links, **parts, l=F.lower(F.trim(F.col("label")))).filter(condition)
    if source.navigation:
        kept = kept.filter(~F.col("l").isin(*source.navigation))
    return kept.filter(source.leads).select("ord", "pos", "document_url", "label")


def first_that_holds(rules: tuple[tuple[str, str], ...]) -> Column:
    """First value whose condition holds."""
    out = F.lit(None).cast("string")
    for name, condition in reversed(rules):
        out = F.when(F.expr(condition), F.lit(name)).otherwise(out)
    return out


def records_of(source: Source, rows: DataFrame) -> DataFrame:
    """Records of rows (ord, pos, document_url, label and, where the source has them, title, date, description,
    text_preview, source_id, extra metadata map), deduplicated, the first of equal keys kept, in listing order."""
    have = set(rows.columns)
    opt = lambda name: F.col(name) if name in have else F.lit(None).cast("string")
    sid = F.coalesce(opt("source_id"), url.source_id_of(F.col("document_url"), source.home))
    rows = text.once(rows, _sid=sid, _role=role_of(F.col("document_url"), F.col("label")), u=F.lower("document_url"))
    rows = text.once(rows, _title=text.first_non_empty(opt("title"), F.col("label"), text.title_from_id(F.col("_sid"))))
    group = first_that_holds(source.groups) if source.groups else text.slug(F.lit(source.collection))
    rows = text.once(rows.withColumns({"t": F.lower("_title"), "raw": F.col("document_url")}), _group=group, _category=first_that_holds(source.categories))
    key = {"source_id": "_sid", "document_url": "document_url", "merge": "document_url"}[source.dedupe]
    others = [c for c in rows.columns if c != key]
    first = rows if source.dedupe == "merge" else rows.groupBy(key).agg(F.min_by(F.struct(*others), F.struct("ord", "pos")).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in others])
    extra = F.col("extra") if "extra" in have else F.create_map().cast("map<string,string>")
    collection = F.lit(source.collection)
    for name, value in source.collections:
        collection = F.when(F.col("_group") == name, F.lit(value)).otherwise(collection)
    entries = [
        ("source_id", F.col("_sid")), ("source_url", F.col("document_url")), ("title", F.col("_title")), (source.category_key, F.col("_category")),
        ("source_warning", F.lit(f"Listed by {source.name}; check the record at its official address before citing it.")),
        ("official_source", F.regexp_replace(F.lit(source.base), "^https://", "")),
    ]
    base = F.map_filter(F.create_map(*[x for k, v in entries for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    asset = F.array(F.struct(F.col("document_url").alias("asset_url"), F.col("_title").alias("label"), mime_of(F.col("_role")).alias("mime_type"), F.col("_role").alias("role")))
    assets = F.coalesce(F.col("assets"), asset) if "assets" in have else asset
    first_pdf = F.get(F.filter(assets, lambda a: a["role"] == "pdf"), F.lit(0))["asset_url"]
    records = first.select(
        "ord", "pos", ident.public_id(F.lit(source.name), F.col("_sid")).alias("id"), ident.document_key(F.lit(source.name), F.col("_sid")).alias("document_key"), F.lit(source.name).alias("source"),
        F.col("_sid").alias("source_id"), F.col("_title").alias("title"), opt("date").alias("date"), collection.alias("collection"), F.col("_group").alias("record_group"),
        opt("description").alias("description"), F.lit(source.base).alias("origin_url"), "document_url", first_pdf.alias("pdf_url"),
        F.map_concat(F.map_filter(F.coalesce(extra, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*[k for k, _ in entries])), base).alias("metadata"),
        assets.alias("attachments"), text.preview(opt("text_preview"), 240).alias("text_preview"), F.lit(f"Cite as listed by {source.name}; verify pages in the original.").alias("citation_note"), F.lit("Public record; see the source for terms.").alias("terms_note"),
    )
    if source.dedupe != "merge":
        return records
    merged = merge_duplicates(records.select(F.struct("ord", "pos").alias("at"), *[c for c in records.columns if c not in ("ord", "pos")]), "at")
    return merged.select("at.ord", "at.pos", *[c for c in records.columns if c not in ("ord", "pos")])


def merge_duplicates(records: DataFrame, order: str) -> DataFrame:
    """One record per source_id, ordered by it: the first non-null PDF link and description, the union of metadata (the
    first value of a key counts) and of attachments (the first of equal URLs). `order` is the column of the listing's
    order. A source_id's records are pre-aggregated; keys and URLs are distinct before they are put together."""
    o = F.col(order)
    others = [c for c in records.columns if c not in ("source_id", "pdf_url", "description", "metadata", "attachments", order)]
    base = records.groupBy("source_id").agg(
        F.min_by(F.struct(*others), o).alias("_r"), F.min_by("pdf_url", F.when(F.col("pdf_url").isNotNull(), o)).alias("pdf_url"),
        F.min_by("description", F.when(F.col("description").isNotNull(), o)).alias("description"), F.min(o).alias(order),
    )
    entries = records.select("source_id", o.alias("_o"), F.explode("metadata").alias("k", "v")).groupBy("source_id", "k").agg(F.min_by("v", "_o").alias("v"))
    metadata = entries.groupBy("source_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("metadata"))
    assets = records.select("source_id", o.alias("_o"), F.posexplode("attachments").alias("_p", "a")).groupBy("source_id", F.col("a.asset_url").alias("_u")).agg(F.min_by("a", F.struct("_o", "_p")).alias("a"), F.min(F.struct("_o", "_p")).alias("at"))
    listed = assets.groupBy("source_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "a"))), lambda x: x["a"]).alias("attachments"))
    joined = base.join(metadata, "source_id", "left").join(listed, "source_id", "left")
    out = joined.select("source_id", *[F.col(f"_r.{c}").alias(c) for c in others], "pdf_url", "description", "metadata", "attachments", order)
    return out.select(*records.columns).orderBy("source_id")


@dataclass
class SearchPage:
    """Records found, the cursor of the next page and warnings."""

    records: DataFrame
    next_cursor: str | None
    warnings: list[str]


def clamp(limit: int) -> int:
    if limit < 1:
        raise InvalidRequest("the limit must be at least 1")
    return min(limit, MAX_LIMIT)


def search_listing(source: Source, rows: DataFrame, query: str, limit: int = 10, cursor: str | None = None) -> SearchPage:
    """Records of a listing that match the query, in listing order, at most `limit`, from the cursor's place on.

    A source that counts pages gives one page of its listing (`ord`) at a time, others continue behind the records
    already given; without a cursor of its own a source gives all it has in one page.
    """
    plain = tuple(f for f in source.fields if f != "metadata")
    start, most = decode_cursor(source, cursor, 0), clamp(limit)
    if source.cursor == "page":
        pages = rows.select("ord").distinct().orderBy("ord").offset(start).limit(2).collect()
        rows = rows.filter(F.col("ord") == pages[0]["ord"]) if pages else rows.limit(0)
    found = records_of(source, rows).filter(matches_query(query, plain, "metadata" in source.fields))
    ordered = found.orderBy("ord", "pos")
    if source.cursor == "page":
        page = ordered.limit(most).drop("ord", "pos")
        following = encode_cursor(source, start + 1) if len(pages) > 1 else None
        empty = page.isEmpty()
    else:
        page = ordered.offset(start).limit(most).drop("ord", "pos")
        given = ordered.select("id").offset(start).limit(most + 1).count()  # at most 51
        empty = given == 0
        following = encode_cursor(source, start + most) if source.cursor and given > most else None
    return SearchPage(page, following, ["no records match the query"] if empty else [])


def encode_cursor(source: Source, number: int) -> str:
    return f"{source.name}-{source.cursor}-{number}"


def decode_cursor(source: Source, cursor: str | None, start: int) -> int:
    if not cursor:
        return start
    head, _, number = cursor.rpartition("-")
    if source.cursor is None or head != f"{source.name}-{source.cursor}" or not number.isdecimal():
        raise InvalidRequest(f"not a cursor of {source.name}: {cursor!r}")
    return int(number)
