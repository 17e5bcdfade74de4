"""Planning and running ingestion: records to plans, texts to pages, chunks and index rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.ident import public_id
from paperloom.functions.url import without_query
from paperloom.operators.chunking import TARGET, build_chunks
from paperloom.operators.fts_index import StoredIndex
from paperloom.operators.pages import split_pages
from paperloom.operators.store import SnapshotStore

#: Segments of the full-text index after which it is built anew.
MAX_SEGMENTS = 20
#: Kinds of ingestible asset in order of preference; the record's own PDF link comes second.
KINDS = ("pdf", "record_pdf", "ocr_text", "transcript", "plain_text", "html")


def asset_kind(role: Column, mime: Column, url: Column) -> Column:
    """Kind of an attachment, null if it can't be ingested."""
    address, m, r = without_query(url), F.lower(F.coalesce(mime, F.lit(""))), F.lower(F.coalesce(role, F.lit("")))
    return (
        F.when((r == "pdf") | (m == "application/pdf") | address.endswith(".pdf"), F.lit("pdf"))
        .when(r == "ocr_text", F.lit("ocr_text")).when(r == "transcript", F.lit("transcript"))
        .when((m == "text/plain") | address.endswith(".txt"), F.lit("plain_text"))
        .when((r == "html") | m.startswith("text/html") | address.endswith(".html") | address.endswith(".htm"), F.lit("html"))
    )


def text_source(kind: Column) -> Column:
    """Where the text of a chosen asset comes from."""
    return F.when(kind.isin("pdf", "record_pdf"), F.lit("embedded_pdf_text")).when(kind == "ocr_text", F.lit("source_ocr")).when(kind == "html", F.lit("html")).when(kind.isNotNull(), F.lit("api_text"))


def select_asset(records: DataFrame, id_col: str = "record_seq") -> DataFrame:
    """One row per record: id, kind, asset_url, text_source, roles.

    The first PDF among the attachments, else the record's PDF link, else the first recognised text, transcript, plain
    text, HTML. Without any the kind is null and `roles` tells what there was. Row-wise, no shuffle.
    """
    assets = F.coalesce("attachments", F.array().cast("array<struct<asset_url:string,label:string,mime_type:string,role:string>>"))
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    listed = F.transform(assets, lambda a, i: F.struct(rank[asset_kind(a["role"], a["mime_type"], a["asset_url"])].alias("rank"), i.alias("pos"), a["asset_url"].alias("url")))
    own = F.when(F.trim(F.coalesce("pdf_url", F.lit(""))) != "", F.array(F.struct(F.lit(1).alias("rank"), F.lit(-1).alias("pos"), F.col("pdf_url").alias("url")))).otherwise(F.array().cast("array<struct<rank:int,pos:int,url:string>>"))
    best = F.array_min(F.filter(F.concat(listed, own), lambda a: a["rank"].isNotNull()))
    out = records.select(id_col, best.alias("_b"), F.array_join(F.transform(assets, lambda a: F.coalesce(a["role"], F.lit("none"))), ", ").alias("roles"))
    kind = F.get(F.array(*[F.lit(k) for k in KINDS]), F.col("_b.rank"))
    return out.select(id_col, kind.alias("kind"), F.col("_b.url").alias("asset_url"), text_source(kind).alias("text_source"), "roles")


#: Rank of asset roles by family of sources (see the sources' specifications).
ROLE_ORDERS = {
    "documents": ("pdf", "html", "ocr_text,transcript", "image", "other"),
    "images": ("pdf", "html", "image", "ocr_text,transcript", "other"),
    "others": ("pdf", "html", "ocr_text,transcript", "other", "image"),
    "media": ("pdf", "image", "other", "html", "transcript", "ocr_text"),
    "recordings": ("pdf", "image", "other", "html", "ocr_text", "transcript"),
    "transcripts": ("transcript", "pdf", "html", "ocr_text", "image", "other"),
    "plain": ("pdf", "html", "*"),
}


def role_rank(role: Column, order: str) -> Column:
    ranks = ROLE_ORDERS[order]
    out = F.lit(len(ranks))
    for i in reversed(range(len(ranks))):
        names = ranks[i].split(",")
        out = F.lit(i) if names == ["*"] else F.when(role.isin(*names), F.lit(i)).otherwise(out)
    return out


def ordered_assets(records: DataFrame, order: str, id_col: str = "record_seq", lower_label: bool = True) -> DataFrame:
    """Attachments of each record in the source's order, the first of equal URLs: id, position, asset_url, role, label."""
    label = (lambda a: F.lower(F.coalesce(a["label"], F.lit("")))) if lower_label else (lambda a: F.coalesce(a["label"], F.lit("")))
    numbered = F.transform("attachments", lambda a, i: F.struct(role_rank(a["role"], order).alias("r"), label(a).alias("l"), i.alias("i"), a["asset_url"].alias("asset_url"), a["role"].alias("role"), a["label"].alias("label")))
    urls = F.transform("attachments", lambda a: a["asset_url"])
    first = F.filter(numbered, lambda a: F.array_position(urls, a["asset_url"]) == a["i"] + 1)
    return records.select(id_col, F.posexplode(F.sort_array(first)).alias("position", "_a")).select(id_col, F.col("position").cast("long").alias("position"), "_a.asset_url", "_a.role", "_a.label")


def plan_documents(records: DataFrame, id_col: str = "record_seq") -> DataFrame:
    """Document rows to be: identity, descriptive columns, and metadata as JSON with the plan and the source's own
    metadata (the preview isn't kept)."""
    chosen = select_asset(records, id_col)
    joined = records.join(chosen, id_col)
    plan = F.struct(F.col("kind").alias("asset_kind"), F.col("asset_url"), F.col("text_source"))
    return joined.select(
        id_col, "document_key", public_id(F.col("source"), F.col("source_id")).alias("public_id"), "source", "source_id", "title", "date", "collection", "record_group", "description",
        "origin_url", "document_url", "pdf_url", F.to_json(F.struct(plan.alias("ingest_plan"), F.col("metadata").alias("source_metadata"))).alias("metadata_json"), "citation_note", "terms_note",
    )


def ingest_texts(store: SnapshotStore, documents: DataFrame, texts: DataFrame, target: int = TARGET, separator: str = "\f") -> None:
    """Upserts document rows (unique document_key) and replaces their pages, chunks and index rows by those of the
    given texts (document_key, text), in one commit. Running it again with the same input changes nothing."""
    pages = split_pages(texts, ["document_key"], separator=separator)
    chunks = build_chunks(pages, target).join(documents.select("document_key", "source", "title"), "document_key")
    index = chunks.select("document_key", "chunk_id", "source", "title", F.col("text").alias("body"), "page_start", "page_end")
    new = {"documents": documents, "pages": pages, "chunks": chunks, "index": index}
    owners = documents.select("document_key")
    store.commit_keys({name: (df, owners) for name, df in new.items()}, "document_key")
    full_text(store).follow(store, index, owners)


class StoreIndex(StoredIndex):
    """The stored full-text index of a store's table `index`, which may lag behind it: its manifest names the version of
    the table that it has."""

    def tag(self, store: SnapshotStore) -> str:
        return json.dumps(store.manifest().get("index", {}).get("folders"), sort_keys=True)

    def current(self, store: SnapshotStore) -> bool:
        return self.manifest().get("tag") == self.tag(store)

    def follow(self, store: SnapshotStore, rows: DataFrame, owners: DataFrame) -> None:
        """After a commit: the documents' rows are replaced if the index had all else, or it is built anew from the
        table."""
        manifest, tag = self.manifest(), self.tag(store)
        if manifest["segments"] and manifest.get("tag") == self.tag_before(store) and len(manifest["segments"]) < MAX_SEGMENTS:
            self.replace(rows, owners, {"tag": tag})
        else:
            self.build(store.read("index"), {"tag": tag})

    def tag_before(self, store: SnapshotStore) -> str:
        return json.dumps(store.manifest(store.version() - 1).get("index", {}).get("folders"), sort_keys=True)


def full_text(store: SnapshotStore) -> StoreIndex:
    return StoreIndex(store.spark, f"{store.root}/full-text")
