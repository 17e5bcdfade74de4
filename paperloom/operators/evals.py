"""Evaluation of a search backend over a named set of queries."""

from __future__ import annotations

import time
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHAPE = ("has_key", "has_chunk", "has_source", "has_title", "has_range", "has_snippet", "has_score")


class SearchBackend(Protocol):
    """Anything that answers a match expression with ranked hits."""

    def search(self, query: str, source: str | None, limit: int) -> DataFrame: ...


@dataclass(frozen=True)
class EvalQuery:
    name: str
    query: str
    source: str | None = None
    limit: int = 10


def evaluate(spark: SparkSession, backend: SearchBackend, queries: list[EvalQuery]) -> DataFrame:
    """name, rank, document_key, chunk_id, score, the seven shape flags and whether the hit keeps to the source filter;
    a query without hits has one row with a null rank. elapsed_ms is the query's time on the driver's clock."""
    rows = []
    for q in queries:  # a fixed set of queries of at most 100 hits each
        began = time.monotonic()
        hits = backend.search(q.query, q.source, q.limit).collect()
        elapsed = (time.monotonic() - began) * 1000
        for rank, h in enumerate(hits, 1):
            d = h.asDict()
            flags = [bool(d.get("document_key")), bool(d.get("chunk_id")), bool(d.get("source")), bool(d.get("title")), 0 < (d.get("page_start") or 0) <= (d.get("page_end") or 0), bool(d.get("snippet")), d.get("score") is not None]
            rows.append((q.name, rank, d.get("document_key"), d.get("chunk_id"), d.get("score"), *flags, q.source is None or d.get("source") == q.source, elapsed))
        if not hits:
            rows.append((q.name, None, None, None, None, *[None] * len(SHAPE), True, elapsed))
    return spark.createDataFrame(rows, "name string, rank int, document_key string, chunk_id string, score double, " + ", ".join(f"{s} boolean" for s in SHAPE) + ", keeps_filter boolean, elapsed_ms double")


def report(results: DataFrame) -> DataFrame:
    """Per query: hits, whether it is empty, whether all hits keep to the filter and have the full shape."""
    full = F.lit(True)
    for s in SHAPE:
        full = full & F.coalesce(F.col(s), F.lit(True))
    return results.groupBy("name").agg(F.count("rank").alias("n_hits"), (F.count("rank") == 0).alias("is_empty"), F.bool_and("keeps_filter").alias("keeps_filter"), F.bool_and(full).alias("full_shape"), F.max("elapsed_ms").alias("elapsed_ms"))
