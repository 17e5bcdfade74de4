"""Report, plan and apply repairs of what is derived from the canonical tables: index rows and text artefacts.

Reports and plans are plain joins and never write. Repairs of the index give the repaired rows; the caller writes them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.operators.search import InvalidRequest

FIELDS = ("source", "title", "body", "page_start", "page_end")
IDENTITY = ("document_key", "chunk_id")
INDEX_CONFIRMATION = "apply sqlite fts repairs"
KIND_RANK = {"missing": 0, "orphaned": 1, "stale": 2}
ARTIFACTS = ("document_text", "page_text", "ocr_page_text")


def _differing(a: str, b: str) -> Column:
    """Names of the fields in which two sides differ, in the fields' order."""
    return F.array_compact(F.array(*[F.when(~F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}")), F.lit(f)) for f in FIELDS]))


def index_drift(canonical: DataFrame, index: DataFrame) -> DataFrame:
    """Issues between canonical chunks and index rows: kind, document_key, chunk_id, detail.

    Both sides have the identity columns and the fields; the index also row_id. `missing`: a canonical chunk without
    index row; `orphaned`: one issue per index row without canonical chunk; `stale`: the only row differs (the fields
    are named), or there are several rows of which one at least matches or differs (their number and the first
    differing row's fields are named). Identities are compared null-safely; a canonical identity must be unique.
    """
    c = canonical.select(*IDENTITY, F.struct(*FIELDS).alias("c"))
    rows = index.select(*IDENTITY, F.struct("row_id", *FIELDS).alias("i"))
    on = lambda a, b: F.col(f"{a}.document_key").eqNullSafe(F.col(f"{b}.document_key")) & F.col(f"{a}.chunk_id").eqNullSafe(F.col(f"{b}.chunk_id"))
    both = c.alias("x").join(rows.alias("y"), on("x", "y"), "full_outer")
    keyed = both.select(
        F.coalesce("x.document_key", "y.document_key").alias("document_key"), F.coalesce("x.chunk_id", "y.chunk_id").alias("chunk_id"),
        F.col("x.c").alias("c"), F.col("y.i").alias("i"),
    )
    orphaned = keyed.filter("c IS NULL").select(F.lit("orphaned").alias("kind"), *IDENTITY, F.concat(F.lit("index row "), F.col("i.row_id").cast("string"), F.lit(" has no canonical chunk")).alias("detail"))
    # Per identity only numbers and the first differing row's fields are kept, in each task before the shuffle.
    compared = keyed.filter("c IS NOT NULL").withColumn("d", F.when(F.col("i").isNotNull(), _differing("c", "i")))
    differs = F.size("d") > 0
    groups = compared.groupBy(*IDENTITY).agg(
        F.count("d").alias("n"), F.count_if(F.coalesce(differs, F.lit(False))).alias("n_differ"),
        F.min_by(F.when(differs, F.col("d")), F.when(differs, F.col("i.row_id"))).alias("first_d"),
    )
    fields = F.array_join("first_d", ", ")
    detail = (
        F.when(F.col("n") == 0, F.lit("no index row"))
        .when(F.col("n") == 1, F.concat(F.lit("differs in "), fields))
        .when(F.col("n_differ") == 0, F.concat(F.col("n").cast("string"), F.lit(" matching rows")))
        .otherwise(F.concat(F.col("n").cast("string"), F.lit(" rows, the first divergent differs in "), fields))
    )
    kind = F.when(F.col("n") == 0, F.lit("missing")).when((F.col("n") > 1) | (F.col("n_differ") > 0), F.lit("stale"))
    rest = groups.withColumn("kind", kind).filter("kind IS NOT NULL").select("kind", *IDENTITY, detail.alias("detail"))
    return rest.unionByName(orphaned)


def in_report_order(issues: DataFrame) -> DataFrame:
    rank = F.create_map(*[F.lit(x) for kv in KIND_RANK.items() for x in kv])
    return issues.orderBy("document_key", "chunk_id", rank[F.col("kind")], "detail")


def index_repair_plan(issues: DataFrame) -> DataFrame:
    """One action per identity: rewrite_from_canonical for missing and stale, manual_review for orphaned."""
    action = F.when(F.col("kind") == "orphaned", F.lit("manual_review")).otherwise(F.lit("rewrite_from_canonical"))
    return issues.groupBy(*IDENTITY, action.alias("action")).agg(F.count("*").alias("n_issues"))


def repaired_index(canonical: DataFrame, index: DataFrame, confirmation: str) -> DataFrame:
    """The index after repair: identities to rewrite have just their canonical row (row_id null: to be given by the
    writer), others keep their rows, orphaned rows stay for review. The confirmation must be exact."""
    if confirmation != INDEX_CONFIRMATION:
        raise InvalidRequest(f"the confirmation must be {INDEX_CONFIRMATION!r}")
    rewrite = index_repair_plan(index_drift(canonical, index)).filter("action = 'rewrite_from_canonical'").select(*IDENTITY)
    kept = index.select(*IDENTITY, *FIELDS, "row_id").join(rewrite, list(IDENTITY), "left_anti")
    fresh = canonical.select(*IDENTITY, *FIELDS).join(rewrite, list(IDENTITY), "left_semi").withColumn("row_id", F.lit(None).cast("long"))
    return kept.unionByName(fresh.select(*kept.columns))


# --- text artefacts ---------------------------------------------------------------------------------------------


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams pages (document, page, text, ocr) in order; only the open document's digest is kept."""
    document, digest = None, None
    for batch in batches:
        rows: list[tuple] = []
        for d, n, text, ocr in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if d != document:
                if digest is not None:
                    rows.append((document, ARTIFACTS[0], None, digest.hexdigest()))
                document, digest, mark = d, hashlib.sha256(), ""
            else:
                mark = "\n\n"
            body = (text or "").encode("utf-8", "surrogatepass")
            digest.update(f"{mark}[page {n}]\n".encode())
            digest.update(body)
            own = hashlib.sha256(body).hexdigest()
            rows.append((d, ARTIFACTS[1], n, own))
            if ocr:
                rows.append((d, ARTIFACTS[2], n, own))
        yield _artifact_batch(rows)
    if digest is not None:
        yield _artifact_batch([(document, ARTIFACTS[0], None, digest.hexdigest())])


def _artifact_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["document_key", "kind", "page", "sha256"])


def expected_artifacts(pages: DataFrame) -> DataFrame:
    """document_key, kind, page (null for whole documents), sha256 of the text that should be on disk.

    A document with any page has its whole text, every page its own, pages recognised locally one more. Pages are sorted
    by Spark and streamed, so a document of any length takes no more memory than a page.
    """
    rows = pages.filter("document_key IS NOT NULL").select("document_key", F.col("page_number").cast("int").alias("n"), "text", F.col("text_source").eqNullSafe("local_ocr").alias("ocr"))
    ordered = rows.repartition("document_key").sortWithinPartitions("document_key", "n", F.coalesce("text", F.lit("")), "ocr")
    return ordered.mapInArrow(_digests, "document_key string, kind string, page int, sha256 string")


def artifact_drift(expected: DataFrame, files: DataFrame) -> DataFrame:
    """document_key, kind, page, issue, detail. `files` has document_key, kind, name, is_file, sha256.

    missing: no entry; stale: not a regular file or other bytes; orphaned: a name that isn't `<n>.txt` (or
    `document.txt`), a page that isn't expected, an unexpected entry.
    """
    number = F.regexp_extract("name", r"\A([1-9]\d{0,8})\.txt\z", 1)
    page = F.when(number != "", number.try_cast("int"))
    well = F.when(F.col("kind") == "document_text", F.col("name") == "document.txt").otherwise(page.isNotNull())
    found = files.select("document_key", "kind", F.when(F.col("kind") != "document_text", page).alias("page"), "name", "is_file", F.col("sha256").alias("has"), well.alias("well"))
    misnamed = found.filter("NOT well").select("document_key", "kind", F.lit(None).cast("int").alias("page"), F.lit("orphaned").alias("issue"), F.concat(F.lit("unexpected entry "), F.col("name")).alias("detail"))
    e, f = expected.alias("e"), found.filter("well").alias("f")
    on = (F.col("e.document_key") == F.col("f.document_key")) & (F.col("e.kind") == F.col("f.kind")) & F.col("e.page").eqNullSafe(F.col("f.page"))
    both = e.join(f, on, "full_outer")
    issue = F.when(F.col("f.kind").isNull(), F.lit("missing")).when(F.col("e.kind").isNull(), F.lit("orphaned")).when(~F.col("f.is_file"), F.lit("stale")).when(~F.col("e.sha256").eqNullSafe(F.col("f.has")), F.lit("stale"))
    detail = F.when(issue == "missing", F.lit("no file")).when(issue == "orphaned", F.concat(F.lit("unexpected entry "), F.col("f.name"))).when(~F.col("f.is_file"), F.lit("not a regular file")).otherwise(F.lit("other content"))
    joined = both.select(F.coalesce("e.document_key", "f.document_key").alias("document_key"), F.coalesce("e.kind", "f.kind").alias("kind"), F.coalesce("e.page", "f.page").alias("page"), issue.alias("issue"), detail.alias("detail"))
    return joined.filter("issue IS NOT NULL").unionByName(misnamed)


def artifact_repair_plan(issues: DataFrame) -> DataFrame:
    """One action per artefact: write_from_canonical for missing and stale, manual_review for orphaned."""
    action = F.when(F.col("issue") == "orphaned", F.lit("manual_review")).otherwise(F.lit("write_from_canonical"))
    return issues.groupBy("document_key", "kind", "page", action.alias("action")).agg(F.count("*").alias("n_issues"))


# What to do after a report, a plan and a repair of the index.
def report_actions(issues: DataFrame) -> list[str]:
    if issues.isEmpty():
        return ["No SQLite FTS index drift detected."]
    if not issues.filter("kind = 'orphaned'").isEmpty():
        return ["Plan the drift before applying; orphaned chunk_fts rows are manual-review only."]
    return ["Plan the drift before applying."]


def plan_actions(plan: DataFrame) -> list[str]:
    if plan.isEmpty():
        return ["No repair actions were required."]
    if not plan.filter("action = 'manual_review'").isEmpty():
        return [f"Review manual-review items first; apply skips them. To rewrite safe items, confirm: {INDEX_CONFIRMATION}"]
    return [f"Apply only if the scope is correct, with confirmation: {INDEX_CONFIRMATION}"]


def apply_actions(n_issues: int, rewritten: int, skipped: int, for_review: int) -> list[str]:
    out = ["Manual-review chunk_fts rows remain; inspect the report and resolve them separately."] if for_review else []
    if not n_issues:
        return [*out, "No SQLite FTS index drift was present."]
    if skipped and not rewritten:
        return [*out, "All applicable repair targets were already current."]
    return [*out, "Re-run report or plan if the canonical SQLite chunks have changed."]


def check_artifact_confirmation(document_id: str, confirmation: str) -> None:
    if confirmation != f"apply derived artifact repairs for {document_id}":
        raise InvalidRequest(f"the confirmation must be 'apply derived artifact repairs for {document_id}'")
