"""Fetch-cache decisions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.operators.store import upsert

RESPECT, REVALIDATE, DO_NOT_PERSIST = "respect_source_headers", "always_revalidate", "do_not_persist"


def effective_policy(policy: Column, cache_control: Column) -> Column:
    """`no-store` or `private` among the header's directives forbids keeping."""
    directives = F.transform(F.split(F.lower(F.coalesce(cache_control, F.lit(""))), ","), lambda d: F.trim(F.split_part(d, F.lit("="), F.lit(1))))
    return F.when(F.arrays_overlap(directives, F.array(F.lit("no-store"), F.lit("private"))), F.lit(DO_NOT_PERSIST)).otherwise(policy)


def fresh(policy: Column, expires_at: Column, now: Column, force: bool = False) -> Column:
    """Whether an entry may be used without asking the source: headers are respected, nothing forces a fetch, and the
    entry hasn't expired (without an expiry it has)."""
    return F.coalesce((policy == RESPECT) & (expires_at > now), F.lit(False)) & F.lit(not force)


def lookup(entries: DataFrame, keys: DataFrame, now: str, force: bool = False) -> DataFrame:
    """Entries that answer the requested keys now."""
    return entries.join(keys.select("cache_key").distinct(), "cache_key", "left_semi").filter(fresh(F.col("policy"), F.col("expires_at"), F.lit(now).cast("timestamp"), force))


def store(entries: DataFrame, fetched: DataFrame) -> DataFrame:
    """The cache after fetches: entries that may be kept replace those of their key, others remove it."""
    decided = fetched.withColumn("policy", effective_policy(F.col("policy"), F.col("cache_control")))
    kept = upsert(entries, decided.filter(F.col("policy") != DO_NOT_PERSIST).select(*entries.columns), ["cache_key"])
    return kept.join(decided.filter(F.col("policy") == DO_NOT_PERSIST).select("cache_key"), "cache_key", "left_anti")
