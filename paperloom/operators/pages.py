"""From extracted text to numbered pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import page_text, trim_all, visible_chars
from paperloom.session import shared

FORM_FEED = "\f"
#: Characters other than white space on an average non-blank page below which a text layer is thought poor.
LOW_DENSITY = 40


def split_pages(df: DataFrame, id_cols: list[str], text_col: str = "text", separator: str = FORM_FEED) -> DataFrame:
    """One row per page of each text: the id columns, page_number, text.

    Parts between separators are numbered from 1 and normalised; blank pages inside keep their number, those before the
    first and after the last page with text are left out. Texts without a page that has text give no row.
    """
    once = lambda name, value: F.inline(F.array(F.struct(value.alias(name))))  # noqa: E731  (evaluated once per row)
    numbered = F.transform(F.split(text_col, separator), lambda x, i: F.struct((i + 1).cast("int").alias("page_number"), page_text(x).alias("text")))
    staged = df.select(*id_cols, once("_pages", numbered))
    full = F.transform(F.filter("_pages", lambda p: p["text"] != ""), lambda p: p["page_number"])
    staged = staged.select(*id_cols, "_pages", F.inline(F.array(F.struct(F.array_min(full).alias("_first"), F.array_max(full).alias("_last")))))
    pages = staged.select(*id_cols, "_first", "_last", F.inline("_pages"))
    return pages.filter(F.col("page_number").between(F.col("_first"), F.col("_last"))).select(*id_cols, "page_number", "text")


def quality(pages: DataFrame, doc_col: str = "document_key", text_col: str = "text") -> DataFrame:
    """Per document: n_pages, n_blank, n_visible and mean_visible (of non-blank pages, floor), warnings."""
    seen = visible_chars(F.coalesce(F.col(text_col), F.lit("")))
    counts = pages.groupBy(doc_col).agg(F.count("*").alias("n_pages"), F.count_if(seen == 0).alias("n_blank"), F.sum(seen.cast("long")).alias("n_visible"))
    full = F.col("n_pages") - F.col("n_blank")
    out = counts.withColumn("mean_visible", F.when(full > 0, F.floor(F.col("n_visible") / full)))
    warnings = F.array(
        F.when(F.col("n_blank") > 0, F.format_string("embedded PDF text contains %d blank page(s) among %d parsed page(s); OCR fallback may improve coverage", "n_blank", "n_pages")),
        F.when(F.col("mean_visible") < LOW_DENSITY, F.format_string("embedded PDF text has low density (%d visible chars/page); OCR fallback may improve quality", "mean_visible")),
    )
    return out.withColumn("warnings", F.array_compact(warnings))


def choose_text(embedded: DataFrame, ocr: DataFrame, doc_col: str = "document_key", use_ocr: bool = True) -> DataFrame:
    """Pages of each document from the embedded text layer or from recognition.

    Recognition replaces the layer of a document that has quality warnings or no text, if it has the same page
    numbers; documents that only recognition has come from it. text_source tells which one it was.
    """
    e = embedded.select(doc_col, "page_number", "text").withColumn("text_source", F.lit("embedded_pdf_text"))
    if not use_ocr:
        return e
    o = ocr.select(doc_col, "page_number", "text").withColumn("text_source", F.lit("local_ocr"))
    numbers = lambda df, name: df.groupBy(doc_col).agg(F.sort_array(F.collect_set("page_number")).alias(name))
    state = numbers(e, "en").join(numbers(o, "on"), doc_col, "full_outer").join(quality(e, doc_col).select(doc_col, (F.size("warnings") > 0).alias("poor")), doc_col, "left")
    pick = state.select(doc_col, (F.col("en").isNull() | (F.coalesce("poor", F.lit(False)) & F.coalesce(F.col("en") == F.col("on"), F.lit(False)))).alias("ocr"))
    return e.join(pick.filter("NOT ocr"), doc_col, "left_semi").unionByName(o.join(pick.filter("ocr"), doc_col, "left_semi"))


def page_range(pages: DataFrame, first: int, last: int, doc_col: str = "document_key") -> DataFrame:
    """Text of pages first..last of each document with page marks, the pages' citations and their number."""
    part = pages.filter(F.col("page_number").between(first, last))
    rows = part.groupBy(doc_col).agg(F.sort_array(F.collect_list(F.struct("page_number", F.coalesce("text", F.lit("")).alias("text")))).alias("p"))
    number = lambda p: p["page_number"].cast("string")
    return rows.select(
        doc_col,
        F.array_join(F.transform("p", lambda p: F.concat(F.lit("[page "), number(p), F.lit("]\n"), p["text"])), "\n\n").alias("text"),
        F.array_join(F.transform("p", lambda p: F.concat(F.col(doc_col), F.lit("#page="), number(p))), " ").alias("citations"),
        F.size("p").cast("long").alias("n_pages"),
    )


def one_delivery(pages: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first delivered of rows with equal keys, by `order`; the rest of the row comes with it, pre-aggregated per
    task, so a key delivered very often is no task's group."""
    others = [c for c in pages.columns if c not in keys]
    first = pages.groupBy(*keys).agg(F.min_by(F.struct(*others), F.col(order)).alias("_r"))
    return first.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others])


#: Rows of repeated deliveries whose ids are broadcast to leave them out, at most; beyond it they are joined.
MAX_REPEATED = 1_000_000


def one_row(pages: DataFrame, keys: list[str], order: str, last: bool = False) -> DataFrame:
    """The first (or last) of rows with equal keys by `order`, which is unique. Only keys and `order` are shuffled to find
    the others; where these are few, as with repeated deliveries, the rows themselves stay where they are. Keys aren't
    null."""
    ids = pages.select(*keys, F.col(order))
    best = ids.groupBy(*keys).agg((F.max(order) if last else F.min(order)).alias("_best"))
    others = shared(ids.join(best, keys).filter(F.col(order) != F.col("_best")).select(order))
    few = others.limit(MAX_REPEATED + 1).count() <= MAX_REPEATED
    return pages.join(F.broadcast(others) if few else others, order, "left_anti")


def is_blank(text: Column) -> Column:
    return trim_all(F.coalesce(text, F.lit(""))) == ""
