"""Queries for the general data problems: written dates (p4) and orphan references (p7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import timestamps
from paperloom.operators.orphans import Parent, Reference, find_orphans, orphan_report
from paperloom.operators.timestamps import normalize_timestamps
from paperloom.session import table


def p4_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every date of the three tables with its status and, where it can be pinned down, its normal form."""
    profiles = table(spark, sf_dir, "source_profiles")
    parts = [
        normalize_timestamps(table(spark, sf_dir, "source_records"), "record_seq", "date", profiles).withColumn("tbl", F.lit("source_records")),
        normalize_timestamps(table(spark, sf_dir, "frus_records"), "frus_seq", "date", profiles, source="frus").withColumn("tbl", F.lit("frus_records")),
        normalize_timestamps(table(spark, sf_dir, "stored_documents"), "id", "date", profiles).withColumn("tbl", F.lit("stored_documents")),
    ]
    return reduce(DataFrame.unionByName, parts).select("tbl", "row_id", "written", "normal_form", "granularity", "pattern", "status")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_normalized(spark, sf_dir).filter("status = 'ok'").select("tbl", "row_id", "normal_form")


def p7_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans of all four tables with the reason."""
    t = lambda name: table(spark, sf_dir, name)
    by_id = Parent(t("stored_documents"), ("id",), "created_at", "deleted_at")
    by_key = Parent(t("stored_documents"), ("document_key",), "created_at", "deleted_at")
    chunks = Parent(t("canonical_chunks"), ("document_key", "chunk_id"), "created_at")
    parts = [
        find_orphans(Reference(t("ingestion_jobs"), "ingestion_jobs", "job_id", ("document_id",), "updated_at"), by_id),
        find_orphans(Reference(t("fts_issues"), "fts_issues", "issue_id", ("document_key",), "reported_at"), by_key),
        find_orphans(Reference(t("canonical_chunks"), "canonical_chunks", "chunk_row_id", ("document_key",), "created_at"), by_key),
        find_orphans(Reference(t("search_hits"), "search_hits", "hit_id", ("document_key", "chunk_id"), "searched_at"), chunks),
    ]
    return reduce(DataFrame.unionByName, parts)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_orphans(spark, sf_dir).select("tbl", "row_id")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans counted per table, month of the reference and reason."""
    report = orphan_report(p7_orphans(spark, sf_dir))
    return report.groupBy("tbl", "month").agg(F.sum("n_orphans").alias("n_orphans"))


_ORPHANS_SQL = """
SELECT 'ingestion_jobs' AS tbl, job_id AS row_id, updated_at AS at_time FROM ingestion_jobs j
WHERE document_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM stored_documents d WHERE d.id = j.document_id AND d.created_at <= j.updated_at AND (d.deleted_at IS NULL OR d.deleted_at > j.updated_at))
UNION ALL
SELECT 'fts_issues', issue_id, reported_at FROM fts_issues j
WHERE document_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM stored_documents d WHERE d.document_key = j.document_key AND d.created_at <= j.reported_at AND (d.deleted_at IS NULL OR d.deleted_at > j.reported_at))
UNION ALL
SELECT 'canonical_chunks', chunk_row_id, created_at FROM canonical_chunks j
WHERE document_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM stored_documents d WHERE d.document_key = j.document_key AND d.created_at <= j.created_at AND (d.deleted_at IS NULL OR d.deleted_at > j.created_at))
UNION ALL
SELECT 'search_hits', hit_id, searched_at FROM search_hits j
WHERE document_key IS NOT NULL AND chunk_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM canonical_chunks d WHERE d.document_key = j.document_key AND d.chunk_id = j.chunk_id AND d.created_at <= j.searched_at)
"""



def _dates_sql() -> str:
    """The cascade's patterns over the three tables, with dates and zones read by SQL."""
    white = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    cases = []
    for name, pattern, groups in timestamps.CASCADE:
        plain = pattern.replace(r"\2", "([-/.])")  # no back references: the two signs are compared
        at = {g: k + 1 for k, g in enumerate(groups)} if plain == pattern else {"y": 1, "m": 3, "d": 5}
        fields = ", ".join(f"{f}: " + (f"regexp_extract(x, {quoted('^(?:' + plain + ')$')}, {at[f]})" if f in at else "''") for f in timestamps._FIELDS)
        same = "" if plain == pattern else f" AND regexp_extract(x, {quoted('^(?:' + plain + ')$')}, 2) = regexp_extract(x, {quoted('^(?:' + plain + ')$')}, 4)"
        cases.append(f"WHEN regexp_full_match(x, {quoted(plain)}){same} THEN {{pattern: '{name}', {fields}}}")
    number = lambda c: f"TRY_CAST(nullif({c}, '') AS INT)"
    months = ", ".join(f"'{m}'" for m in timestamps.MONTHS)
    zones = " ".join(f"WHEN upper(z) = '{k}' THEN {60 * v}" for k, v in timestamps.ZONE_HOURS.items())
    military = " ".join(f"WHEN upper(l) = '{c}' THEN {m}" for c, m in [("Z", 0), *((c, 60 * (k + 1)) for k, c in enumerate(timestamps.MILITARY_EAST)), *((c, -60 * (k + 1)) for k, c in enumerate(timestamps.MILITARY_WEST))])
    return rf"""
WITH r AS (SELECT 'source_records' AS tbl, record_seq AS row_id, source, date FROM source_records UNION ALL SELECT 'frus_records', frus_seq, 'frus', date FROM frus_records UNION ALL SELECT 'stored_documents', id, source, date FROM stored_documents),
t AS (SELECT tbl, row_id, source, lower(regexp_replace(regexp_replace(date, '^[{white}\[\](){{}}<>]+|[{white}\[\](){{}}<>]+$', '', 'g'), '[{white}]+', ' ', 'g')) AS x FROM r),
c AS (SELECT tbl, row_id, source, CASE {' '.join(cases)} END AS f FROM t WHERE x <> ''),
k AS (SELECT tbl, row_id, zone, slash_order, unnest(f) FROM c LEFT JOIN source_profiles USING (source) WHERE f IS NOT NULL),
n AS (SELECT tbl, row_id, zone, slash_order, a <> '' AS slashed, TRY_CAST(nullif(e, '') AS BIGINT) * 1000 AS es, TRY_CAST(nullif(t, '') AS BIGINT) AS ts,
  CASE WHEN v <> '' THEN 1900 + {number('v')} ELSE {number('y')} END AS yy,
  CASE WHEN n <> '' THEN list_position([{months}], substr(n, 1, 3)) WHEN a <> '' THEN CASE WHEN slash_order = 'mdy' THEN {number('a')} ELSE {number('b')} END ELSE {number('m')} END AS mm,
  CASE WHEN a <> '' THEN CASE WHEN slash_order = 'mdy' THEN {number('b')} ELSE {number('a')} END ELSE {number('d')} END AS dd,
  CASE WHEN p = '' THEN {number('h')} WHEN {number('h')} BETWEEN 1 AND 12 THEN {number('h')} % 12 + CASE WHEN p = 'pm' THEN 12 ELSE 0 END END AS hh,
  coalesce({number('i')}, 0) AS mi, coalesce({number('s')}, 0) AS se, CASE WHEN f <> '' THEN CAST(rpad(substr(f, 1, 3), 3, '0') AS INT) ELSE 0 END AS ms,
  CASE WHEN l <> '' THEN CASE {military} END WHEN z LIKE '+%' OR z LIKE '-%' THEN CASE WHEN z LIKE '-%' THEN -1 ELSE 1 END * (60 * CAST(substr(rpad(regexp_replace(z, '[^0-9]', '', 'g'), 4, '0'), 1, 2) AS INT) + CAST(substr(rpad(regexp_replace(z, '[^0-9]', '', 'g'), 4, '0'), 3, 2) AS INT)) WHEN z <> '' THEN CASE {zones} END END AS off,
  CASE WHEN e || t || h <> '' THEN 'instant' WHEN d <> '' OR a <> '' THEN 'day' WHEN m <> '' OR n <> '' THEN 'month' ELSE 'year' END AS grain FROM k),
d AS (SELECT *, coalesce(es, ts) AS epoch, CASE WHEN yy BETWEEN 1 AND 9999 THEN TRY_CAST(printf('%04d-%02d-%02d', yy::INT, coalesce(mm, 1)::INT, coalesce(dd, 1)::INT) AS DATE) END AS day FROM n),
w AS (SELECT *, CASE WHEN day IS NOT NULL AND hh < 24 AND mi < 60 AND se < 60 THEN day + to_hours(hh) + to_minutes(mi) + to_seconds(se) END AS wall FROM d),
z AS (SELECT *, grain = 'instant' AND epoch IS NULL AND off IS NULL AS local, CASE WHEN grain = 'instant' AND epoch IS NULL AND off IS NULL THEN timezone(zone, wall) END AS moment FROM w),
u AS (SELECT *, timezone(zone, moment) = wall AND len(list_filter([-60, -30, 30, 60], lambda o: timezone(zone, moment + to_minutes(o)) = wall)) = 0 AS clear FROM z),
i AS (SELECT *, CASE WHEN epoch IS NOT NULL THEN make_timestamp(epoch * 1000) WHEN local THEN timezone('UTC', moment) + to_milliseconds(ms) ELSE wall - to_minutes(off) + to_milliseconds(ms) END AS instant FROM u)
SELECT tbl, row_id, CASE grain WHEN 'instant' THEN strftime(instant, '%Y-%m-%dT%H:%M:%S.%gZ') WHEN 'day' THEN strftime(day, '%Y-%m-%d') WHEN 'month' THEN printf('%04d-%02d', yy::INT, mm::INT) ELSE printf('%04d', yy::INT) END AS normal_form FROM i
WHERE NOT (slashed AND slash_order IS NULL) AND CASE WHEN epoch IS NOT NULL THEN true WHEN grain = 'instant' THEN wall IS NOT NULL AND (NOT local OR clear) AND coalesce(abs(off), 0) <= 900 WHEN grain = 'month' THEN day IS NOT NULL AND mm BETWEEN 1 AND 12 ELSE day IS NOT NULL END"""


QUERIES = {"p4_found": p4_found, "p4_normalized": p4_normalized, "p7_found": p7_found, "p7_report": p7_report}
SQL = {
    "p4_found": _dates_sql(),
    "p7_found": f"SELECT tbl, row_id FROM ({_ORPHANS_SQL})",
    "p7_report": f"SELECT tbl, substr(CAST(CAST(epoch_ms(epoch_ms(at_time)) AS DATE) AS VARCHAR), 1, 7) AS month, count(*) AS n_orphans FROM ({_ORPHANS_SQL}) GROUP BY 1, 2",
}
