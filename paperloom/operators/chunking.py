"""Page-aware greedy chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import chunk_id, token_estimate, trim_all

TARGET = 800


def _assign(target: int):
    """Streams rows (doc, page, tokens) in order; only the open chunk's sum is kept, however long a document is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, number, total = None, 0, 0
        for batch in batches:
            out = []
            for d, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if d != doc:
                    doc, number, total = d, 1, n
                elif total + n > target:
                    number, total = number + 1, n
                else:
                    total += n
                out.append(number)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int32())], names=["document_key", "page_number", "chunk_no"])

    return run


def assign_chunks(pages: DataFrame, target: int = TARGET) -> DataFrame:
    """document_key, page_number, chunk_no: a chunk is closed before the page that would take it over `target`; a page
    over the target is a chunk of its own. `pages` has one row per document and page number.

    Only keys and token counts are shuffled, sorted by Spark (spilling if need be) and streamed; no group is collected.
    """
    sizes = pages.select("document_key", F.col("page_number").cast("int").alias("page_number"), token_estimate(F.coalesce("text", F.lit(""))).cast("long").alias("tokens"))
    return sizes.repartition("document_key").sortWithinPartitions("document_key", "page_number").mapInArrow(_assign(target), "document_key string, page_number int, chunk_no int")


def build_chunks(pages: DataFrame, target: int = TARGET) -> DataFrame:
    """Chunks of the pages: document_key, chunk_id, page_start, page_end, token_estimate, text.

    The text joins the trimmed non-empty page texts with a blank line; the page range includes blank pages.
    """
    placed = pages.select("document_key", F.col("page_number").cast("int").alias("page_number"), "text").join(assign_chunks(pages, target), ["document_key", "page_number"])
    grouped = placed.groupBy("document_key", "chunk_no").agg(F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"), F.sort_array(F.collect_list(F.struct("page_number", trim_all(F.coalesce("text", F.lit(""))).alias("t")))).alias("p"))
    text = F.array_join(F.transform(F.filter("p", lambda x: x["t"] != ""), lambda x: x["t"]), "\n\n")
    return grouped.select("document_key", chunk_id(F.col("chunk_no")).alias("chunk_id"), F.col("page_start").cast("long").alias("page_start"), F.col("page_end").cast("long").alias("page_end"), text.alias("text")).select("document_key", "chunk_id", "page_start", "page_end", token_estimate(F.col("text")).cast("long").alias("token_estimate"), "text")
