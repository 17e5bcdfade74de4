"""Queries over the project's tables for the search, ingestion, reconciliation and job operators, with their SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import ident, text, url
from paperloom.operators import chunking, evals, jobs, pages, reconcile, search, store
from paperloom.operators.fts_index import StoredIndex
from paperloom.plans import ingest
from paperloom.session import shared_folder, table
from paperloom.sources import adapters
from paperloom.sources.base import mime_of, role_of

WS = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def sql_trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


# --- search -----------------------------------------------------------------------------------------------------


def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "canonical_chunks")
    return chunks.select("document_key", "chunk_id", F.col("chunk_row_id").alias("row_id"), "source", "title", F.col("text").alias("body"), "page_start", "page_end")


_INDEXES: dict[tuple, StoredIndex] = {}


def chunk_index(spark: SparkSession, sf_dir: str) -> StoredIndex:
    """The stored index of the chunks in the shared folder, built when the application first asks for it or the table's
    files have changed."""
    rows = index_rows(spark, sf_dir)
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    files = [hadoop.Path(f) for f in sorted(rows.inputFiles())]
    states = [p.getFileSystem(conf).getFileStatus(p) for p in files]
    key = (spark.sparkContext.applicationId, sf_dir, *((str(s.getPath()), s.getLen(), s.getModificationTime()) for s in states))
    if key not in _INDEXES:
        index = StoredIndex(spark, f"{shared_folder(spark)}/fts-{uuid.uuid4().hex}", ("document_key", "chunk_id", "row_id"))
        index.build(rows)
        _INDEXES[key] = index
    return _INDEXES[key]


def _search(query: str, source: str | None = None, limit: int = 10):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        hits = chunk_index(spark, sf_dir).search(query, source, limit)
        return hits.select("row_id", "document_key", "chunk_id", "source", "page_start", "page_end", F.round("score", 6).alias("score"))

    return run


def _sql_count(p: search.Phrase) -> str:
    parts = []
    for c in p.columns:
        tokens = "tt" if c == "title" else "bt"
        n = len(p.words)
        tests = [f"starts_with({tokens}[i + {k}], '{w}')" if p.prefix and k == n - 1 else f"{tokens}[i + {k}] = '{w}'" for k, w in enumerate(p.words)]
        parts.append(f"len(list_filter(range(1, len({tokens}) + 1), lambda i: coalesce({' AND '.join(tests)}, false)))")
    return " + ".join(parts) or "0"


def _sql_match(m: search.Match, phrases: list[search.Phrase]) -> str:
    if m.kind == "phrase":
        return f"f{phrases.index(m.parts[0])} > 0"
    if m.kind == "near":
        a, b = (p.parts[0].words[0] for p in m.parts)
        k = m.distance
        return "(" + " OR ".join(f"len(list_filter(range(1, len({t}) + 1), lambda i: {t}[i] = '{a}' AND list_contains({t}[greatest(1, i - {k + 1}):i + {k + 1}], '{b}'))) > 0" for t in ("tt", "bt")) + ")"
    parts = [_sql_match(p, phrases) for p in m.parts]
    return f"({parts[0]} AND NOT {parts[1]})" if m.kind == "not" else "(" + f" {m.kind.upper()} ".join(parts) + ")"


_TOKENS = r"coalesce(regexp_extract_all(strip_accents(lower({})), '[\p{{L}}\p{{N}}]+'), [])"
_INDEX_SQL = f"SELECT chunk_row_id AS row_id, document_key, chunk_id, source, page_start, page_end, {_TOKENS.format('title')} AS tt, {_TOKENS.format('text')} AS bt FROM canonical_chunks"


def _search_sql(query: str, source: str | None = None, limit: int = 10) -> str:
    m = search.parse_match(query)
    phrases = list(dict.fromkeys(search._all_phrases(m)))
    counts = ", ".join(f"{_sql_count(p)} AS f{i}" for i, p in enumerate(phrases))
    stats = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(phrases)))
    idf = lambda i: f"CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END"
    counts_if = lambda alternatives: " AND ".join(["true", *(_sql_match(a, phrases) for a in alternatives)])
    score = " - ".join(["0.0", *(f"CASE WHEN {counts_if(a)} THEN ({idf(i)}) * (f{i} * 2.2) / (f{i} + 1.2 * (0.25 + 0.75 * len_ / avg_)) ELSE 0 END" for i, a in ((phrases.index(p), a) for p, a in m.scored()))])
    where = _sql_match(m, phrases) + (f" AND source = '{source}'" if source else "")
    return f"""
WITH ix AS ({_INDEX_SQL}), c AS (SELECT *, len(tt) + len(bt) AS len_, {counts} FROM ix),
s AS (SELECT count(*) AS n, avg(len_) AS avg_, {stats} FROM c)
SELECT row_id, document_key, chunk_id, source, page_start, page_end, round(CAST({score} AS DOUBLE), 6) AS score
FROM c, s WHERE {where} ORDER BY CAST({score} AS DOUBLE), document_key, chunk_id, row_id LIMIT {limit}"""


SEARCHES = {
    "search_bm25": ("observatory", None), "search_and_word": ("treaty AND observatory", None), "search_and": ("quarterly OR observatory harvest", None), "search_or": ('glacier OR "key list"', None),
    "search_not": ("garrison NOT senate", None), "search_phrase": ('"in spite of the glacier"', None), "search_prefix": ("hydrogr*", None),
    "search_title_filter": ("title : memorandum", None), "search_source_filter": ("observatory", "cia"), "search_near": ("NEAR(treaty harbor, 5)", None),
    "search_empty": ("nosuchword", None), "search_repeated": ("glacier glacier", None), "search_accents": ("télégramme", None),
}


def search_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top hits with snippets and their documents' metadata and notes."""
    query = "observatory harvest"
    hits = chunk_index(spark, sf_dir).search(query, None, 20)
    documents = table(spark, sf_dir, "stored_documents").select("document_key", "metadata_json", "citation_note", "terms_note")
    joined = search.with_snippets(hits, query).join(documents, "document_key", "left")
    return joined.withColumn("source_warning", search.source_warning(F.col("metadata_json"))).drop("body")


class ChunkSearch:
    """Search backend over the project's chunks."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.index = chunk_index(spark, sf_dir)

    def search(self, query: str, source: str | None, limit: int) -> DataFrame:
        return search.with_snippets(self.index.search(query, source, limit), query)


def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation harness over the named searches."""
    named = [evals.EvalQuery(name, q, s) for name, (q, s) in SEARCHES.items()]
    return evals.report(evals.evaluate(spark, ChunkSearch(spark, sf_dir), named)).drop("elapsed_ms")


def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = chunk_index(spark, sf_dir).postings()
    return stored.groupBy("term").agg(F.count("*").alias("n_rows"), F.sum((F.size("title") + F.size("body")).cast("long")).alias("n_occurrences"))


def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_index(spark, sf_dir).rows(columns=["row_id", "n_tokens"]).select("row_id", F.col("n_tokens").cast("long").alias("n_tokens"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each term's postings and its first and last position."""
    stored = chunk_index(spark, sf_dir).postings()
    sides = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("at")) for c in search.COLUMNS])
    p = stored.select("term", F.inline(sides)).filter(F.size("at") > 0)
    return p.groupBy("term", "col").agg(F.sum(F.size("at").cast("long")).alias("n_postings"), F.min(F.array_min("at")).cast("long").alias("first_pos"), F.max(F.array_max("at")).cast("long").alias("last_pos"))


def stored_hits_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per stored query: hits, whether all have a page range and a snippet with brackets, and their score's order."""
    hits = table(spark, sf_dir, "search_hits")
    return hits.groupBy("query").agg(
        F.count("*").alias("n_hits"), F.count_if((F.col("page_start") > 0) & (F.col("page_end") >= F.col("page_start"))).alias("n_ranged"),
        F.count_if(F.col("snippet").contains("[")).alias("n_marked"), F.countDistinct("document_key").alias("n_documents"),
    )


# --- pages, chunks ----------------------------------------------------------------------------------------------


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as first delivered."""
    rows = table(spark, sf_dir, "document_pages").select("document_key", "page_number", "page_row_id", "text", "text_source").filter("document_key IS NOT NULL AND page_number > 0")
    return pages.one_row(rows, ["document_key", "page_number"], "page_row_id")


_PAGES_SQL = "SELECT document_key, page_number, arg_min(page_row_id, page_row_id) AS page_row_id, first(text ORDER BY page_row_id) AS text, first(text_source ORDER BY page_row_id) AS text_source FROM document_pages WHERE document_key IS NOT NULL AND page_number > 0 GROUP BY 1, 2"


def page_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the corpus's documents as pages."""
    return pages.split_pages(table(spark, sf_dir, "documents"), ["doc_id"], separator="\n")


def quality_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = pages.quality(_pages(spark, sf_dir))
    return q.withColumn("warnings", F.array_join("warnings", "; "))


def document_page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "stored_documents").select("public_id", "document_key")
    counts = _pages(spark, sf_dir).groupBy("document_key").agg(F.count("*").alias("n"))
    return documents.join(counts, "document_key", "left").select("public_id", "document_key", F.coalesce("n", F.lit(0)).alias("n_pages"))


def page_range_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_range(_pages(spark, sf_dir), 2, 4)


def _chunk_assignment(target: int):
    return lambda spark, sf_dir: chunking.assign_chunks(_pages(spark, sf_dir), target)


def _chunks(target: int):
    return lambda spark, sf_dir: chunking.build_chunks(_pages(spark, sf_dir), target)


def _chunk_sql(target: int, texts: bool) -> str:
    head = rf"""
WITH RECURSIVE p AS ({_PAGES_SQL}),
t AS (SELECT document_key, page_number, text, greatest(len(regexp_extract_all(coalesce(text, ''), '[^{WS}]+')), 1) AS n, row_number() OVER (PARTITION BY document_key ORDER BY page_number) AS r FROM p),
g AS (SELECT document_key, r, page_number, n AS total, 1 AS chunk_no FROM t WHERE r = 1
UNION ALL SELECT t.document_key, t.r, t.page_number, CASE WHEN g.total + t.n > {target} THEN t.n ELSE g.total + t.n END, CASE WHEN g.total + t.n > {target} THEN g.chunk_no + 1 ELSE g.chunk_no END FROM g JOIN t ON t.document_key = g.document_key AND t.r = g.r + 1)
"""
    if not texts:
        return head + "SELECT document_key, page_number, chunk_no FROM g"
    return head + rf""",
c AS (SELECT g.document_key, chunk_no, min(g.page_number) AS page_start, max(g.page_number) AS page_end, coalesce(string_agg({sql_trim('text')}, chr(10) || chr(10) ORDER BY g.page_number) FILTER ({sql_trim('text')} <> ''), '') AS text FROM g JOIN t USING (document_key, r) GROUP BY 1, 2)
SELECT document_key, 'chunk-' || printf('%04d', chunk_no) AS chunk_id, page_start, page_end, greatest(len(regexp_extract_all(text, '[^{WS}]+')), 1) AS token_estimate, text FROM c"""


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks whose stored estimate is missing or wrong, with the right one."""
    chunks = table(spark, sf_dir, "canonical_chunks").select("chunk_row_id", F.col("token_estimate").alias("stored"), text.token_estimate(F.coalesce("text", F.lit(""))).cast("long").alias("token_estimate"))
    return chunks.filter(~F.col("stored").eqNullSafe(F.col("token_estimate")))


# --- identity, records ------------------------------------------------------------------------------------------


def document_key_fnv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys by the rule, beside the stored ones."""
    d = table(spark, sf_dir, "stored_documents")
    return d.select("id", F.col("document_key").alias("stored_key"), ident.document_key(F.col("source"), F.col("source_id")).alias("document_key"), ident.public_id(F.col("source"), F.col("source_id")).alias("public_id"))


def document_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.document_violations(table(spark, sf_dir, "stored_documents"))


def malformed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "canonical_chunks").filter(~ident.is_key(F.col("document_key"))).select("chunk_row_id", "document_key")


def duplicate_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.duplicate_keys(table(spark, sf_dir, "source_records"), ["id"])


def public_id_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks' documents by key, beside those whose public id equals it."""
    d = table(spark, sf_dir, "stored_documents")
    chunks = table(spark, sf_dir, "canonical_chunks").groupBy("document_key").agg(F.count("*").alias("n_chunks"))
    return d.join(chunks, "document_key").select("public_id", "document_key", "title", "n_chunks")


def record_dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "source_records").select("id", "record_seq", "title", "source")
    return pages.one_delivery(r, ["id"], "record_seq").select("id", "record_seq", "title", "source")


def record_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as first harvested, brought up to date by the later deliveries."""
    r = table(spark, sf_dir, "source_records").select("id", "record_seq", "title", "date")
    first = pages.one_delivery(r, ["id"], "record_seq")
    others = [c for c in r.columns if c != "id"]
    last = r.groupBy("id").agg(F.count("*").alias("n"), F.max_by(F.struct(*others), "record_seq").alias("_r")).filter("n > 1").select("id", *[F.col(f"_r.{c}").alias(c) for c in others])
    return store.upsert(first, last, ["id"]).select("id", "record_seq", "title", "date")


def record_query_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose listed fields together have every word of a query."""
    from paperloom.sources.base import matches_query

    r = table(spark, sf_dir, "source_records")
    return r.filter(matches_query("  Memorandum  SENATE ", ("title", "source_id", "document_url", "collection", "record_group", "description", "text_preview"))).select("record_seq", "id")


def asset_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.select_asset(table(spark, sf_dir, "source_records"))


def asset_priority_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.ordered_assets(table(spark, sf_dir, "source_records"), "documents").select("record_seq", "position", "asset_url")


def ingest_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.plan_documents(table(spark, sf_dir, "source_records"))


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("document_url")
    return table(spark, sf_dir, "source_records").filter("document_url IS NOT NULL").select(
        "record_seq", url.host(u).alias("host"), url.path(u).alias("path"), url.source_id_of(u, "home").alias("source_path"),
        url.same_origin(u, F.col("origin_url")).alias("same_origin"), url.without_query(F.coalesce("pdf_url", u)).alias("bare"),
    )


def url_absolutize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of the records' links seen from their listing."""
    u = F.col("document_url")
    return table(spark, sf_dir, "source_records").filter("document_url IS NOT NULL AND origin_url IS NOT NULL").select("record_seq", url.absolutize(url.path(u), F.col("origin_url")).alias("from_root"), url.absolutize(F.concat(F.lit("doc/"), F.col("record_seq").cast("string")), F.col("origin_url")).alias("from_folder"))


def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "source_records").filter("document_url IS NOT NULL AND source IS NOT NULL").select("record_seq", ident.cache_key(F.col("source"), F.col("document_url")).alias("cache_key"))


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("title")
    return table(spark, sf_dir, "source_records").filter("title IS NOT NULL").select("record_seq", text.slug(t).alias("slug"), text.squeeze(t).alias("squeezed"), text.visible_chars(t).cast("long").alias("visible"), F.left(t, F.lit(40)).alias("short"))


# --- jobs -------------------------------------------------------------------------------------------------------

#: A moment within the tables' time for which claims are asked.
NOW = "2016-01-01T00:00:00Z"


def job_first_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.first_deliveries(table(spark, sf_dir, "ingestion_jobs")).select("job_key", "job_id", "status", "attempts")


def job_claim_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty jobs that workers would claim next."""
    return jobs.next_claims(jobs.first_deliveries(table(spark, sf_dir, "ingestion_jobs")), NOW, 20).select("job_id", "job_key", "claim_rank")


def job_warning_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "ingestion_jobs")
    return j.filter("warnings IS NOT NULL").select("job_id", F.array_join(F.array_distinct("warnings"), "; ").alias("warnings"))


def job_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.check_jobs(table(spark, sf_dir, "ingestion_jobs"))


def _job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream read as a job log: a user is a job, the kinds of event are stages."""
    e = table(spark, sf_dir, "events")
    reported = F.when(F.col("event_type") == "view", 0.1).when(F.col("event_type") == "click", 0.35).when(F.col("event_type") == "signup", 0.6)
    status = F.when(F.col("event_type").isin("view", "click", "signup"), "running").when((F.col("event_type") == "purchase") & (F.col("value") > 90), "succeeded").when((F.col("event_type") == "error") & (F.col("value") > 95), "failed")
    warning = F.when(F.col("event_type") == "purchase", F.concat(F.lit("value over "), (F.floor(F.col("value") / 25) * 25).cast("string")))
    return e.select(F.col("user_id").alias("job"), F.col("ts").alias("at"), "event_id", status.alias("status"), reported.alias("reported"), warning.alias("warning"), F.when(F.col("event_type") == "error", F.col("props")).alias("error"))


_EVENTS_SQL = """SELECT user_id AS job, ts AS at_, event_id, CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'running' WHEN event_type = 'purchase' AND value > 90 THEN 'succeeded' WHEN event_type = 'error' AND value > 95 THEN 'failed' END AS status,
CASE event_type WHEN 'view' THEN 0.1 WHEN 'click' THEN 0.35 WHEN 'signup' THEN 0.6 END AS reported, CASE WHEN event_type = 'purchase' THEN 'value over ' || CAST(CAST(floor(value / 25) * 25 AS BIGINT) AS VARCHAR) END AS warning, CASE WHEN event_type = 'error' THEN props END AS error FROM events"""


def job_progress_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.progress_by_event(_job_events(spark, sf_dir)).select("event_id", "job", "progress")


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = jobs.fold_jobs(_job_events(spark, sf_dir))
    return s.select("job", "status", "progress", F.array_join("warnings", "; ").alias("warnings"), "n_events")


# --- reconciliation ---------------------------------------------------------------------------------------------


def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of living documents, as first delivered."""
    chunks = index_rows(spark, sf_dir).join(table(spark, sf_dir, "stored_documents").filter("deleted_at IS NULL").select("document_key"), "document_key", "left_semi")
    return pages.one_delivery(chunks, ["document_key", "chunk_id"], "row_id")


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index built from the deliveries of the first day holds: repeated rows, rows of documents that are gone."""
    early = table(spark, sf_dir, "canonical_chunks").filter("loaded_at <= created_at + INTERVAL 1 DAY").select(F.col("chunk_row_id").alias("row_id"))
    return index_rows(spark, sf_dir).join(early, "row_id", "left_semi")


_DRIFT_SQL = """
WITH r AS (SELECT chunk_row_id AS row_id, document_key, chunk_id, source, title, text AS body, page_start, page_end, loaded_at <= created_at + INTERVAL 1 DAY AS early FROM canonical_chunks),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_key, chunk_id ORDER BY row_id) AS k FROM r WHERE document_key IN (SELECT document_key FROM stored_documents WHERE deleted_at IS NULL)) WHERE k = 1),
i AS (SELECT * FROM r WHERE early),
d AS (SELECT c.document_key, c.chunk_id, i.row_id, list_filter([CASE WHEN c.source IS DISTINCT FROM i.source THEN 'source' END, CASE WHEN c.title IS DISTINCT FROM i.title THEN 'title' END, CASE WHEN c.body IS DISTINCT FROM i.body THEN 'body' END, CASE WHEN c.page_start IS DISTINCT FROM i.page_start THEN 'page_start' END, CASE WHEN c.page_end IS DISTINCT FROM i.page_end THEN 'page_end' END], lambda x: x IS NOT NULL) AS d FROM c LEFT JOIN i ON c.document_key = i.document_key AND c.chunk_id = i.chunk_id),
g AS (SELECT document_key, chunk_id, count(row_id) AS n, count(*) FILTER (row_id IS NOT NULL AND len(d) > 0) AS nd, array_to_string(arg_min(d, row_id) FILTER (row_id IS NOT NULL AND len(d) > 0), ', ') AS fd FROM d GROUP BY 1, 2),
issues AS (SELECT CASE WHEN n = 0 THEN 'missing' ELSE 'stale' END AS kind, document_key, chunk_id, CASE WHEN n = 0 THEN 'no index row' WHEN n = 1 THEN 'differs in ' || fd WHEN nd = 0 THEN n || ' matching rows' ELSE n || ' rows, the first divergent differs in ' || fd END AS detail FROM g WHERE n <> 1 OR nd > 0
UNION ALL SELECT 'orphaned', document_key, chunk_id, 'index row ' || row_id || ' has no canonical chunk' FROM i WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.document_key = i.document_key AND c.chunk_id = i.chunk_id))
"""


def fts_drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.in_report_order(reconcile.index_drift(_canonical(spark, sf_dir), _indexed(spark, sf_dir)))


def fts_repair_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.index_repair_plan(reconcile.index_drift(_canonical(spark, sf_dir), _indexed(spark, sf_dir)))


def fts_repair_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index rows per source after the repair."""
    repaired = reconcile.repaired_index(_canonical(spark, sf_dir), _indexed(spark, sf_dir), reconcile.INDEX_CONFIRMATION)
    return repaired.groupBy("source").agg(F.count("*").alias("n_rows"), F.count_if(F.col("row_id").isNull()).alias("n_rewritten"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files of all kinds as they would be after the first day: pages by row, of which the last delivery counts."""
    p = table(spark, sf_dir, "document_pages").filter("document_key IS NOT NULL AND page_number > 0 AND loaded_at <= created_at + INTERVAL 1 DAY")
    last = pages.one_row(p.select("document_key", "page_number", "page_row_id", "text", "text_source"), ["document_key", "page_number"], "page_row_id", last=True)
    name = F.when(F.col("kind") == "document_text", F.lit("document.txt")).otherwise(F.concat(F.col("page").cast("string"), F.lit(".txt")))
    return reconcile.expected_artifacts(last).select("document_key", "kind", name.alias("name"), F.lit(True).alias("is_file"), "sha256")


def artifact_drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of all kinds of text files: whole documents, pages, pages recognised locally."""
    return reconcile.artifact_drift(reconcile.expected_artifacts(_pages(spark, sf_dir)), _files(spark, sf_dir))


def artifact_repair_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.artifact_repair_plan(artifact_drift_report(spark, sf_dir))


_KINDS_SQL = """SELECT document_key, 'document_text' AS kind, NULL::INT AS page, sha256(string_agg('[page ' || page_number || ']' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY page_number)) AS h FROM {0} GROUP BY 1
UNION ALL SELECT document_key, 'page_text', page_number, sha256(coalesce(text, '')) FROM {0} UNION ALL SELECT document_key, 'ocr_page_text', page_number, sha256(coalesce(text, '')) FROM {0} WHERE text_source = 'local_ocr'"""
_ARTIFACT_SQL = f"""
WITH p AS ({_PAGES_SQL}), l AS (SELECT document_key, page_number, last(text ORDER BY page_row_id) AS text, last(text_source ORDER BY page_row_id) AS text_source FROM document_pages WHERE document_key IS NOT NULL AND page_number > 0 AND loaded_at <= created_at + INTERVAL 1 DAY GROUP BY 1, 2),
e AS ({_KINDS_SQL.format('p')}), f AS ({_KINDS_SQL.format('l')})
SELECT coalesce(e.document_key, f.document_key) AS document_key, coalesce(e.kind, f.kind) AS kind, coalesce(e.page, f.page) AS page, CASE WHEN f.h IS NULL THEN 'missing' WHEN e.h IS NULL THEN 'orphaned' ELSE 'stale' END AS issue,
CASE WHEN f.h IS NULL THEN 'no file' WHEN e.h IS NULL THEN 'unexpected entry ' || coalesce(f.page || '.txt', 'document.txt') ELSE 'other content' END AS detail
FROM e FULL JOIN f ON e.document_key = f.document_key AND e.kind = f.kind AND e.page IS NOT DISTINCT FROM f.page WHERE f.h IS DISTINCT FROM e.h"""


# --- rules of single sources over the records -------------------------------------------------------------------


def source_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sources' own rules read from each record: agency, data set, part, accession numbers, role and type."""
    r = table(spark, sf_dir, "source_records")
    described = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))
    role = role_of(F.coalesce("document_url", F.lit("")), F.col("title"))
    return r.select(
        "record_seq", adapters.agency_of(described).alias("agency"), adapters.data_set_number(F.coalesce("source_id", F.lit("")), F.coalesce("title", F.lit(""))).alias("data_set"), adapters.part_number(F.coalesce("title", F.lit(""))).alias("part"),
        F.array_join(adapters.accessions(F.concat_ws(" ", "source_id", "title", "description")), " ").alias("accessions"), role.alias("role"), mime_of(role).alias("mime_type"),
    )


_RULES_SQL = r"""
WITH r AS (SELECT record_seq, source_id, coalesce(title, '') AS t, lower(coalesce(title, '') || ' ' || coalesce(description, '')) AS d, lower(split_part(split_part(coalesce(document_url, ''), '?', 1), '#', 1)) AS u, upper(concat_ws(' ', source_id, title, description)) AS a FROM source_records),
k AS (SELECT *, CASE WHEN u LIKE '%.pdf' OR lower(t) LIKE '%.pdf' THEN 'pdf' WHEN u LIKE '%.txt' THEN 'ocr_text' WHEN regexp_matches(u, '[.]html?$') THEN 'html' WHEN regexp_matches(u, '[.](jpe?g|png|gif|tiff?|webp)$') THEN 'image' WHEN regexp_matches(u, '[.](vtt|srt)$') THEN 'transcript' ELSE 'other' END AS role FROM r)
SELECT record_seq, CASE WHEN contains(d, 'department of homeland security') OR contains(d, 'kona blue') THEN 'Department of Homeland Security (DHS)' WHEN contains(d, 'national archives') OR contains(d, 'nara') THEN 'National Archives and Records Administration (NARA)'
WHEN contains(d, 'nasa') THEN 'National Aeronautics and Space Administration (NASA)' WHEN contains(d, 'oak ridge') OR contains(d, 'ornl') THEN 'Oak Ridge National Laboratory (ORNL)' ELSE 'All-domain Anomaly Resolution Office (AARO)' END AS agency,
coalesce(nullif(regexp_extract(coalesce(source_id, ''), '^.*?data-set-([0-9]*)', 1), ''), nullif(regexp_extract(lower(t), '^.*?data set ([0-9]*)', 1), '')) AS data_set,
TRY_CAST(nullif(regexp_extract(lower(t), 'part[^0-9]*([0-9]+)', 1), '') AS INT) AS part,
array_to_string(list_distinct_in_order, ' ') AS accessions, role, CASE role WHEN 'pdf' THEN 'application/pdf' WHEN 'ocr_text' THEN 'text/plain' WHEN 'html' THEN 'text/html' END AS mime_type
FROM (SELECT *, list_filter(w, lambda x, i: list_position(w, x) = i) AS list_distinct_in_order FROM (SELECT *, list_filter(regexp_split_to_array(a, '[^A-Za-z0-9]+'), lambda x: regexp_full_match(x, 'AD[A-Z0-9]{5,14}')) AS w FROM k))"""


def asset_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments of each record in each of the sources' orders."""
    r = table(spark, sf_dir, "source_records")
    parts = [ingest.ordered_assets(r, order).select(F.lit(order).alias("asset_order"), "record_seq", "position", "asset_url") for order in sorted(ingest.ROLE_ORDERS)]
    return reduce(DataFrame.unionByName, parts)


def _orders_sql() -> str:
    parts = []
    for order in sorted(ingest.ROLE_ORDERS):
        ranks = ingest.ROLE_ORDERS[order]
        rank = "CASE " + " ".join("WHEN true THEN " + str(i) if names == "*" else "WHEN role IN (" + ", ".join(f"'{n}'" for n in names.split(",")) + f") THEN {i}" for i, names in enumerate(ranks)) + f" ELSE {len(ranks)} END"
        parts.append(f"SELECT '{order}' AS asset_order, record_seq, row_number() OVER (PARTITION BY record_seq ORDER BY {rank}, l, i) - 1 AS position, asset_url FROM f")
    return "WITH a AS (SELECT record_seq, unnest(attachments) AS a, generate_subscripts(attachments, 1) AS i FROM source_records), n AS (SELECT record_seq, i, a.asset_url AS asset_url, a.role AS role, lower(coalesce(a.label, '')) AS l FROM a), f AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY record_seq, asset_url ORDER BY i) = 1) " + " UNION ALL ".join(parts)


# --- job changes ------------------------------------------------------------------------------------------------


def job_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every job that worker-12 could claim by its key, as it would be claimed."""
    j = jobs.first_deliveries(table(spark, sf_dir, "ingestion_jobs"))
    out = jobs.claimed(j.filter(jobs.can_claim("worker-12", NOW)), "worker-12", "2016-01-01T00:05:00Z", NOW)
    return out.select("job_id", "job_key", "status", "attempts", "lease_owner", "lease_expires_at", "error", "next_action", "progress")


def job_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs under worker-12's lease at a later stage, and as they end each way."""
    j = jobs.first_deliveries(table(spark, sf_dir, "ingestion_jobs"))
    parts = [jobs.staged(j, "worker-12", "extracting_text", 0.6, NOW).withColumn("end", F.lit("staged"))]
    parts += [jobs.finished(j, "worker-12", end, NOW, F.lit("why"), F.lit("do")).withColumn("end", F.lit(end)) for end in ("succeeded", "failed", "interrupted")]
    return reduce(DataFrame.unionByName, [p.select("end", "job_id", "status", "stage", "progress", "lease_owner", "error", "next_action") for p in parts])


_FIRST_JOBS = "SELECT * FROM ingestion_jobs QUALIFY row_number() OVER (PARTITION BY job_key ORDER BY job_id) = 1"
_CLAIMS_SQL = f"""
SELECT job_id, job_key, 'running' AS status, attempts + CASE WHEN status = 'running' AND lease_owner = 'worker-12' THEN 0 ELSE 1 END AS attempts, 'worker-12' AS lease_owner, '2016-01-01T00:05:00Z' AS lease_expires_at, NULL::VARCHAR AS error,
'Claimed by worker-12 until 2016-01-01T00:05:00Z; ingestion execution may resume from stage.' AS next_action, progress
FROM ({_FIRST_JOBS}) WHERE status IN ('queued', 'interrupted') OR (status = 'running' AND (lease_owner = 'worker-12' OR TRY_CAST(replace(replace(lease_expires_at, 'T', ' '), 'Z', '') AS TIMESTAMP) <= TIMESTAMP '2016-01-01 00:00:00'))"""
_ENDS_SQL = f"""
WITH j AS ({_FIRST_JOBS}), h AS (SELECT * FROM j WHERE status = 'running' AND lease_owner = 'worker-12')
SELECT 'staged' AS "end", job_id, status, 'extracting_text' AS stage, greatest(progress, 0.6) AS progress, lease_owner, error, NULL::VARCHAR AS next_action FROM h
UNION ALL SELECT 'succeeded', job_id, 'succeeded', 'succeeded', 1.0, NULL, NULL, 'Ingestion completed; local search index is ready.' FROM h UNION ALL SELECT 'succeeded', job_id, status, stage, progress, lease_owner, error, next_action FROM j WHERE status = 'succeeded'
UNION ALL SELECT 'failed', job_id, 'failed', 'failed', progress, NULL, 'why', 'do' FROM h UNION ALL SELECT 'failed', job_id, status, stage, progress, lease_owner, error, next_action FROM j WHERE status = 'failed'
UNION ALL SELECT 'interrupted', job_id, 'interrupted', stage, progress, NULL, 'why', 'do' FROM h UNION ALL SELECT 'interrupted', job_id, status, stage, progress, lease_owner, error, next_action FROM j WHERE status = 'interrupted'"""


QUERIES = {
    **{name: _search(q, s) for name, (q, s) in SEARCHES.items()},
    "search_snippets": search_snippets, "eval_report": eval_report, "term_stats": term_stats, "doc_lengths": doc_lengths, "postings": postings, "stored_hits_shape": stored_hits_shape,
    "page_split": page_split, "quality_warnings": quality_warnings, "document_page_count": document_page_count, "page_range_text": page_range_text,
    "chunk_greedy_800": _chunk_assignment(800), "chunk_greedy_40": _chunk_assignment(40), "chunk_texts_800": _chunks(800), "token_estimate": token_estimate,
    "document_key_fnv": document_key_fnv, "document_rules": document_rules, "malformed_keys": malformed_keys, "duplicate_deliveries": duplicate_deliveries, "public_id_lookup": public_id_lookup,
    "record_dedupe_first": record_dedupe_first, "record_upsert": record_upsert, "record_query_filter": record_query_filter, "asset_select": asset_select, "asset_priority_order": asset_priority_order, "ingest_plan": ingest_plan,
    "url_parts": url_parts, "url_absolutize": url_absolutize, "cache_key": cache_key, "slugs": slugs,
    "job_first_deliveries": job_first_deliveries, "job_claim_next": job_claim_next, "job_warning_dedupe": job_warning_dedupe, "job_rules": job_rules, "job_progress_monotonic": job_progress_monotonic, "job_states": job_states,
    "fts_drift_report": fts_drift_report, "fts_repair_plan": fts_repair_plan, "fts_repair_apply": fts_repair_apply, "artifact_drift_report": artifact_drift_report, "artifact_repair_plan": artifact_repair_plan,
    "source_rules": source_rules, "asset_orders": asset_orders, "job_claims": job_claims, "job_ends": job_ends,
}

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
SQL = {
    "source_rules": _RULES_SQL, "asset_orders": _orders_sql(), "job_claims": _CLAIMS_SQL, "job_ends": _ENDS_SQL,
    "artifact_repair_plan": f"SELECT document_key, kind, page, CASE WHEN issue = 'orphaned' THEN 'manual_review' ELSE 'write_from_canonical' END AS action, count(*) AS n_issues FROM ({_ARTIFACT_SQL}) GROUP BY 1, 2, 3, 4",
    **{name: _search_sql(q, s) for name, (q, s) in SEARCHES.items()},
    "term_stats": f"WITH ix AS ({_INDEX_SQL}), t AS (SELECT row_id, unnest(tt || bt) AS term FROM ix) SELECT term, count(DISTINCT row_id) AS n_rows, count(*) AS n_occurrences FROM t GROUP BY 1",
    "doc_lengths": f"SELECT row_id, len(tt) + len(bt) AS n_tokens FROM ({_INDEX_SQL})",
    "postings": f"WITH ix AS ({_INDEX_SQL}), t AS (SELECT 'title' AS col, unnest(tt) AS term, generate_subscripts(tt, 1) - 1 AS pos FROM ix UNION ALL SELECT 'body', unnest(bt), generate_subscripts(bt, 1) - 1 FROM ix) SELECT term, col, count(*) AS n_postings, min(pos) AS first_pos, max(pos) AS last_pos FROM t GROUP BY 1, 2",
    "stored_hits_shape": "SELECT query, count(*) AS n_hits, count(*) FILTER (page_start > 0 AND page_end >= page_start) AS n_ranged, count(*) FILTER (contains(snippet, '[')) AS n_marked, count(DISTINCT document_key) AS n_documents FROM search_hits GROUP BY 1",
    "page_split": f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS page_number FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id, page_number, {sql_trim('x')} AS text FROM l), b AS (SELECT doc_id, min(page_number) AS a, max(page_number) AS z FROM t WHERE text <> '' GROUP BY 1) SELECT doc_id, page_number, text FROM t JOIN b USING (doc_id) WHERE page_number BETWEEN a AND z",
    "quality_warnings": rf"WITH p AS ({_PAGES_SQL}), v AS (SELECT document_key, length(regexp_replace(coalesce(text, ''), '[{WS}]', '', 'g')) AS v FROM p), g AS (SELECT document_key, count(*) AS n_pages, count(*) FILTER (v = 0) AS n_blank, sum(v) AS n_visible FROM v GROUP BY 1), m AS (SELECT *, CASE WHEN n_pages > n_blank THEN CAST(floor(n_visible / (n_pages - n_blank)) AS BIGINT) END AS mean_visible FROM g) SELECT document_key, n_pages, n_blank, CAST(n_visible AS BIGINT) AS n_visible, mean_visible, array_to_string(list_filter([CASE WHEN n_blank > 0 THEN 'embedded PDF text contains ' || n_blank || ' blank page(s) among ' || n_pages || ' parsed page(s); OCR fallback may improve coverage' END, CASE WHEN mean_visible < 40 THEN 'embedded PDF text has low density (' || mean_visible || ' visible chars/page); OCR fallback may improve quality' END], lambda x: x IS NOT NULL), '; ') AS warnings FROM m",
    "document_page_count": f"SELECT public_id, d.document_key, count(p.page_row_id) AS n_pages FROM stored_documents d LEFT JOIN ({_PAGES_SQL}) p USING (document_key) GROUP BY 1, 2",
    "page_range_text": f"SELECT document_key, string_agg('[page ' || page_number || ']' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY page_number) AS text, string_agg(document_key || '#page=' || page_number, ' ' ORDER BY page_number) AS citations, count(*) AS n_pages FROM ({_PAGES_SQL}) WHERE page_number BETWEEN 2 AND 4 GROUP BY 1",
    "chunk_greedy_800": _chunk_sql(800, False), "chunk_greedy_40": _chunk_sql(40, False), "chunk_texts_800": _chunk_sql(800, True),
    "token_estimate": rf"SELECT * FROM (SELECT chunk_row_id, token_estimate AS stored, greatest(len(regexp_extract_all(coalesce(text, ''), '[^{WS}]+')), 1) AS token_estimate FROM canonical_chunks) WHERE stored IS DISTINCT FROM token_estimate",
    "document_key_fnv": r"SELECT id, document_key AS stored_key, source || ':' || source_id AS public_id, CASE WHEN source = 'frus' THEN 'frus-' || regexp_replace(regexp_replace(lower(source_id), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') ELSE source || '-' || lower(lpad(hex(CAST(list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), list_transform(range(1, octet_length(encode(source || ':' || source_id)) + 1), lambda i: CAST(('0x' || substr(hex(encode(source || ':' || source_id)), CAST(2 * i - 1 AS INT), 2)) AS HUGEINT))), lambda h, b: (xor(h, b) * CAST(435 AS HUGEINT) + (xor(h, b) % CAST(16777216 AS HUGEINT)) * CAST(1099511627776 AS HUGEINT)) % CAST(18446744073709551616 AS HUGEINT)) AS UBIGINT)), 16, '0')) END AS document_key FROM stored_documents",
    "document_rules": "SELECT document_key, unnest(list_filter([CASE WHEN NOT coalesce(regexp_matches(document_key, '^[A-Za-z0-9_-]{1,160}$'), false) THEN 'document_key' END, CASE WHEN NOT coalesce(public_id <> document_key, false) THEN 'public_id' END, CASE WHEN NOT coalesce(source_id <> document_key, false) THEN 'source_id' END, CASE WHEN NOT (metadata_json IS NULL OR (starts_with(trim(metadata_json), '{') AND ends_with(trim(metadata_json), '}'))) THEN 'metadata_json' END], lambda x: x IS NOT NULL)) AS rule FROM stored_documents",
    "malformed_keys": "SELECT chunk_row_id, document_key FROM canonical_chunks WHERE NOT coalesce(regexp_matches(document_key, '^[A-Za-z0-9_-]{1,160}$'), false)",
    "duplicate_deliveries": "SELECT id, count(*) AS n FROM source_records GROUP BY 1 HAVING count(*) > 1",
    "public_id_lookup": "SELECT public_id, d.document_key, d.title, count(*) AS n_chunks FROM stored_documents d JOIN canonical_chunks c USING (document_key) GROUP BY 1, 2, 3",
    "record_dedupe_first": "SELECT id, record_seq, title, source FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY record_seq) AS k FROM source_records) WHERE k = 1",
    "record_upsert": "SELECT id, record_seq, title, date FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY record_seq DESC) AS k FROM source_records) WHERE k = 1",
    "record_query_filter": "SELECT record_seq, id FROM (SELECT record_seq, id, lower(concat_ws(' ', coalesce(title, ''), coalesce(source_id, ''), coalesce(document_url, ''), coalesce(collection, ''), coalesce(record_group, ''), coalesce(description, ''), coalesce(text_preview, ''))) AS h FROM source_records) WHERE contains(h, 'memorandum') AND contains(h, 'senate')",
    "asset_select": """
WITH a AS (SELECT record_seq, unnest(attachments) AS a, generate_subscripts(attachments, 1) AS pos FROM source_records),
k AS (SELECT record_seq, pos - 1 AS pos, a.asset_url AS url, lower(split_part(split_part(a.asset_url, '?', 1), '#', 1)) AS u, lower(coalesce(a.mime_type, '')) AS m, lower(coalesce(a.role, '')) AS r FROM a),
c AS (SELECT record_seq, pos, url, CASE WHEN r = 'pdf' OR m = 'application/pdf' OR coalesce(ends_with(u, '.pdf'), false) THEN 0 WHEN r = 'ocr_text' THEN 2 WHEN r = 'transcript' THEN 3 WHEN m = 'text/plain' OR coalesce(ends_with(u, '.txt'), false) THEN 4 WHEN r = 'html' OR starts_with(m, 'text/html') OR coalesce(ends_with(u, '.html') OR ends_with(u, '.htm'), false) THEN 5 END AS rank FROM k
UNION ALL SELECT record_seq, -1, pdf_url, 1 FROM source_records WHERE trim(coalesce(pdf_url, '')) <> ''),
b AS (SELECT record_seq, arg_min({'k': rank, 'u': url}, rank * 1000000 + pos) AS b FROM c WHERE rank IS NOT NULL GROUP BY 1)
SELECT s.record_seq, ['pdf', 'record_pdf', 'ocr_text', 'transcript', 'plain_text', 'html'][b.b.k + 1] AS kind, b.b.u AS asset_url, CASE WHEN b.b.k <= 1 THEN 'embedded_pdf_text' WHEN b.b.k = 2 THEN 'source_ocr' WHEN b.b.k = 5 THEN 'html' WHEN b.b.k IS NOT NULL THEN 'api_text' END AS text_source, array_to_string(list_transform(coalesce(s.attachments, []), lambda a: coalesce(a.role, 'none')), ', ') AS roles
FROM source_records s LEFT JOIN b USING (record_seq)""",
    "asset_priority_order": """
WITH a AS (SELECT record_seq, unnest(attachments) AS a, generate_subscripts(attachments, 1) AS pos FROM source_records),
f AS (SELECT *, row_number() OVER (PARTITION BY record_seq, a.asset_url ORDER BY pos) AS k FROM a)
SELECT record_seq, row_number() OVER (PARTITION BY record_seq ORDER BY CASE a.role WHEN 'pdf' THEN 0 WHEN 'html' THEN 1 WHEN 'ocr_text' THEN 2 WHEN 'transcript' THEN 2 WHEN 'image' THEN 3 WHEN 'other' THEN 4 ELSE 5 END, lower(coalesce(a.label, '')), pos) - 1 AS position, a.asset_url AS asset_url FROM f WHERE k = 1""",
    "url_parts": rf"SELECT record_seq, lower(regexp_replace(regexp_extract(document_url, '{_URL}', 2), '^.*@|:[0-9]*$', '', 'g')) AS host, regexp_extract(document_url, '{_URL}', 3) AS path, CASE WHEN trim(regexp_extract(document_url, '{_URL}', 3), '/') = '' THEN 'home' ELSE trim(regexp_extract(document_url, '{_URL}', 3), '/') END || CASE WHEN regexp_extract(document_url, '{_URL}', 4) <> '' THEN '?' || regexp_extract(document_url, '{_URL}', 4) ELSE '' END AS source_path, coalesce(lower(regexp_extract(document_url, '{_URL}', 1)) = lower(regexp_extract(origin_url, '{_URL}', 1)) AND lower(regexp_replace(regexp_extract(document_url, '{_URL}', 2), '^.*@|:[0-9]*$', '', 'g')) = lower(regexp_replace(regexp_extract(origin_url, '{_URL}', 2), '^.*@|:[0-9]*$', '', 'g')) AND regexp_extract(document_url, '{_URL}', 2) <> '', false) AS same_origin, lower(split_part(split_part(coalesce(pdf_url, document_url), '?', 1), '#', 1)) AS bare FROM source_records WHERE document_url IS NOT NULL",
    "url_absolutize": rf"SELECT record_seq, regexp_extract(origin_url, '^[^/]*//[^/?#]*') || regexp_extract(document_url, '{_URL}', 3) AS from_root, regexp_extract(origin_url, '^[^/]*//[^/?#]*') || regexp_replace(CASE WHEN regexp_extract(origin_url, '{_URL}', 3) = '' THEN '/' ELSE regexp_extract(origin_url, '{_URL}', 3) END, '[^/]*$', '') || 'doc/' || record_seq AS from_folder FROM source_records WHERE document_url IS NOT NULL AND origin_url IS NOT NULL",
    "cache_key": "SELECT record_seq, 'asset:sha256:' || sha256('asset-download:v1' || chr(0) || source || chr(0) || 'GET' || chr(0) || document_url) AS cache_key FROM source_records WHERE document_url IS NOT NULL AND source IS NOT NULL",
    "slugs": rf"SELECT record_seq, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, trim(regexp_replace(title, '[{WS}]+', ' ', 'g')) AS squeezed, length(regexp_replace(title, '[{WS}]', '', 'g')) AS visible, left(title, 40) AS short FROM source_records WHERE title IS NOT NULL",
    "job_first_deliveries": "SELECT job_key, job_id, status, attempts FROM (SELECT *, row_number() OVER (PARTITION BY job_key ORDER BY job_id) AS k FROM ingestion_jobs) WHERE k = 1",
    "job_claim_next": f"WITH j AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_key ORDER BY job_id) AS k FROM ingestion_jobs) WHERE k = 1), r AS (SELECT *, CASE WHEN status = 'queued' THEN 0 WHEN status = 'interrupted' THEN 1 WHEN status = 'running' AND TRY_CAST(lease_expires_at AS TIMESTAMPTZ) <= TIMESTAMPTZ '{NOW}' THEN 2 END AS claim_rank FROM j) SELECT job_id, job_key, claim_rank FROM r WHERE claim_rank IS NOT NULL ORDER BY claim_rank, updated_at, job_id LIMIT 20",
    "job_warning_dedupe": "SELECT job_id, array_to_string(list_filter(warnings, lambda x, i: list_position(warnings, x) = i), '; ') AS warnings FROM ingestion_jobs WHERE warnings IS NOT NULL",
    "job_rules": "SELECT job_id, unnest(list_filter([CASE WHEN NOT coalesce(status IN ('queued', 'running', 'succeeded', 'failed', 'cancelled', 'interrupted'), false) THEN 'status' END, CASE WHEN NOT coalesce(progress BETWEEN 0 AND 1, false) THEN 'progress' END, CASE WHEN NOT coalesce(attempts >= 0, false) THEN 'attempts' END, CASE WHEN NOT coalesce(status <> 'running' OR lease_owner IS NOT NULL, false) THEN 'lease' END], lambda x: x IS NOT NULL)) AS rule FROM ingestion_jobs",
    "job_progress_monotonic": f"SELECT event_id, job, greatest(coalesce(max(reported) OVER (PARTITION BY job ORDER BY at_, event_id ROWS UNBOUNDED PRECEDING), 0), 0)::DOUBLE AS progress FROM ({_EVENTS_SQL})",
    "job_states": f"WITH e AS ({_EVENTS_SQL}), t AS (SELECT job, arg_min(status, (at_, event_id)) FILTER (status IN ('succeeded', 'failed')) AS ended, arg_max(status, (at_, event_id)) FILTER (status IS NOT NULL) AS last, max(reported) AS reported, count(*) AS n_events FROM e GROUP BY 1), w AS (SELECT job, string_agg(warning, '; ' ORDER BY o) AS warnings FROM (SELECT job, warning, min((at_, event_id)) AS o FROM e WHERE warning IS NOT NULL GROUP BY 1, 2) GROUP BY 1) SELECT job, coalesce(ended, last, 'queued') AS status, CASE WHEN coalesce(ended, last) = 'succeeded' THEN 1.0 ELSE coalesce(reported, 0) END::DOUBLE AS progress, coalesce(warnings, '') AS warnings, n_events FROM t LEFT JOIN w USING (job)",
    "fts_drift_report": _DRIFT_SQL + "SELECT kind, document_key, chunk_id, detail FROM issues",
    "fts_repair_plan": _DRIFT_SQL + "SELECT document_key, chunk_id, CASE WHEN kind = 'orphaned' THEN 'manual_review' ELSE 'rewrite_from_canonical' END AS action, count(*) AS n_issues FROM issues GROUP BY 1, 2, 3",
    "fts_repair_apply": _DRIFT_SQL + ", w AS (SELECT DISTINCT document_key, chunk_id FROM issues WHERE kind <> 'orphaned'), u AS (SELECT source, false AS fresh FROM i ANTI JOIN w USING (document_key, chunk_id) UNION ALL SELECT source, true FROM c SEMI JOIN w USING (document_key, chunk_id)) SELECT source, count(*) AS n_rows, count(*) FILTER (fresh) AS n_rewritten FROM u GROUP BY 1",
    "artifact_drift_report": _ARTIFACT_SQL,
}

_FIELD = """'"{0}":' || to_json(s.{0})::VARCHAR"""
SQL["ingest_plan"] = f"""
WITH s AS (SELECT record_seq, kind AS asset_kind, asset_url, text_source FROM ({SQL['asset_select']}))
SELECT r.record_seq, document_key, source || ':' || source_id AS public_id, source, source_id, title, date, collection, record_group, description, origin_url, document_url, pdf_url,
'{{"ingest_plan":{{' || array_to_string(list_filter([{', '.join(_FIELD.format(c) for c in ('asset_kind', 'asset_url', 'text_source'))}], lambda x: x IS NOT NULL AND NOT ends_with(x, ':null')), ',') || '}}' ||
coalesce(',"source_metadata":{{' || array_to_string(list_transform(map_entries(metadata), lambda e: to_json(e.key)::VARCHAR || ':' || coalesce(to_json(e.value)::VARCHAR, 'null')), ',') || '}}', '') || '}}' AS metadata_json, citation_note, terms_note
FROM source_records r JOIN s ON r.record_seq = s.record_seq"""
