"""References to records that do not exist at the time of the reference.

A blocked Bloom filter of the parents' keys (four keys to a 64-bit word) is aggregated in Spark, as large as the keys
need. A reference whose bits aren't all set is an orphan for certain. Up to a number of words the filter is broadcast, so
that most proven orphans are never shuffled; a larger one is joined by word. Only the references that pass go through the
exact join with the parents' lifetimes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits in a filter that is broadcast, at most: 2^20 words are 16 MB as broadcast rows. A filter has a word
#: for four keys, whatever their number.
MAX_WORDS = 1 << 20


@dataclass(frozen=True)
class Reference:
    """References of one table: rows with an id, key columns and the time at which the key must exist."""

    rows: DataFrame
    tbl: str
    id_col: str
    key_cols: tuple[str, ...]
    at_col: str


@dataclass(frozen=True)
class Parent:
    """Rows that can be referred to, alive from created_col up to, not including, deleted_col (null: for ever)."""

    rows: DataFrame
    key_cols: tuple[str, ...]
    created_col: str
    deleted_col: str | None = None

    @cached_property
    def lives(self) -> DataFrame:
        """One row per key (_k0, ...) and end of life (_gone) with its earliest beginning (_born)."""
        keys = [f"_k{i}" for i in range(len(self.key_cols))]
        deleted = F.col(self.deleted_col) if self.deleted_col else F.lit(None)
        rows = self.rows.select(*[F.col(c).alias(k) for c, k in zip(self.key_cols, keys)], F.col(self.created_col).cast("timestamp").alias("_born"), deleted.cast("timestamp").alias("_gone"))
        return rows.na.drop(subset=[*keys, "_born"]).groupBy(*keys, "_gone").agg(F.min("_born").alias("_born"))

    @cached_property
    def words(self) -> int:
        """Words of the filter: a power of two with a word for four keys. Counted once for all its references."""
        n = self.lives.select(F.approx_count_distinct(F.xxhash64(*[f"_k{i}" for i in range(len(self.key_cols))]))).first()[0]
        words = 64
        while words < n // 4 + 1:
            words *= 2
        return words


def _bits(hash_: str) -> Column:
    bit = lambda i: F.expr(f"shiftleft(1L, CAST(shiftrightunsigned({hash_}, {6 * i}) & 63 AS INT))")
    return bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2)).bitwiseOR(bit(3))


def _with_filter_columns(df: DataFrame, keys: list[str], words: int) -> DataFrame:
    return (
        df.withColumn("_h", F.xxhash64(*keys, F.lit(17)))
        .withColumn("_word", F.pmod(F.xxhash64(*keys), F.lit(words)))
        .withColumn("_mask", _bits("_h"))
        .drop("_h")
    )


def bloom_words(keys: DataFrame, cols: list[str], words: int) -> DataFrame:
    """The filter of the distinct keys: at most `words` rows (_word, _set)."""
    return _with_filter_columns(keys, cols, words).groupBy("_word").agg(F.bit_or("_mask").alias("_set"))


def find_orphans(ref: Reference, parent: Parent, max_words: int = MAX_WORDS) -> DataFrame:
    """References without a living parent: tbl, row_id, at, reason.

    reason is `unknown_key` (the filter proves that no parent ever had the key) or `not_alive` (no parent with the key
    was alive at that time; also a key that passed the filter by chance). Keys are compared exactly as stored. A
    reference with a null among its keys refers to nothing and isn't reported; one without a time is an orphan, as no
    parent can be shown to be alive. A parent without a creation time is never alive. Repeated rows are reported
    once each; other columns are ignored; with no parents every reference is an orphan.

    Parents are reduced to one row per key and end of life before the join, so a hot key of the parents is gone; a
    hot key among the references stays on the streamed side, which adaptive execution splits.
    """
    keys = [f"_k{i}" for i in range(len(ref.key_cols))]
    lives, words = parent.lives, parent.words
    bloom = bloom_words(lives, keys, words)
    refs = ref.rows.select(F.lit(ref.tbl).alias("tbl"), F.col(ref.id_col).alias("row_id"), *[F.col(c).alias(k) for c, k in zip(ref.key_cols, keys)], F.col(ref.at_col).cast("timestamp").alias("at")).na.drop(subset=keys)
    probed = _with_filter_columns(refs, keys, words).join(F.broadcast(bloom) if words <= max_words else bloom, "_word", "left")
    passes = F.coalesce(F.col("_set").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False))
    probed = probed.withColumn("_passes", passes)
    unknown = probed.filter(~F.col("_passes")).select("tbl", "row_id", "at", F.lit("unknown_key").alias("reason"))
    alive = [F.col(f"r.{k}") == F.col(f"p.{k}") for k in keys] + [F.col("p._born") <= F.col("r.at"), F.col("p._gone").isNull() | (F.col("p._gone") > F.col("r.at"))]
    condition = alive[0]
    for c in alive[1:]:
        condition = condition & c
    dead = probed.filter(F.col("_passes")).select("tbl", "row_id", "at", *keys).alias("r").join(lives.alias("p"), condition, "left_anti")
    return unknown.unionByName(dead.select("tbl", "row_id", "at", F.lit("not_alive").alias("reason")))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, month (YYYY-MM in UTC; null for references without a time) and reason."""
    month = F.substring(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_millis("at") / 86_400_000).cast("int")).cast("string"), 1, 7)
    return orphans.groupBy("tbl", month.alias("month"), "reason").agg(F.count("*").alias("n_orphans"))
