"""The operations that a client calls, over a snapshot store."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.ident import locator_parts
from paperloom.operators import jobs as jobs_
from paperloom.operators import pages as pages_
from paperloom.operators import reconcile, search
from paperloom.operators.search import InvalidRequest
from paperloom.operators.store import Conflict, SnapshotStore
from paperloom.plans.artifacts import TextFolder
from paperloom.plans.ingest import full_text
from paperloom.plans.policy import DirectPolicy
from paperloom.sources import adapters, base, registry

MAX_PAGES = 50
JOBS = "job_id long, job_key string, document_key string, operation string, source string, source_id string, target_url string, next_action string, status string, stage string, progress double, attempts int, lease_owner string, lease_expires_at string, error string, warnings array<string>, created_at timestamp, updated_at timestamp"
OUTBOX = "job_key string, topic string, payload string, status string, created_at timestamp"


class Library:
    """Documents, pages, chunks and index of a store, its jobs, and listings of sources given as tables.

    `assets` has the texts of the sources' assets (asset_url, text), `trusted` the address prefixes that may be ingested
    directly, as `source=https://host/path`.
    """

    def __init__(self, spark: SparkSession, store: SnapshotStore, listings: dict[str, DataFrame] | None = None, assets: DataFrame | None = None, trusted: tuple[str, ...] = ()) -> None:
        self.spark, self.store, self.listings, self.assets = spark, store, listings or {}, assets
        self.queue, self.policy, self.texts = jobs_.JobQueue(store), DirectPolicy(trusted), TextFolder(spark, f"{store.root}/texts")

    # sources

    def list_sources(self) -> DataFrame:
        return registry.source_status(self.spark, {name: True for name in self.listings})

    def _rows(self, name: str) -> tuple[base.Source, DataFrame]:
        source = registry.source_named(name)
        if name not in self.listings:
            raise InvalidRequest(f"no listing of {name} is set up")
        listing = self.listings[name]
        if source.kind == "json":
            return source, adapters.json_rows(source, listing)
        if source.kind == "csv":
            return source, adapters.csv_rows(source, listing)
        return source, adapters.html_rows(source, listing)

    def search_source(self, name: str, query: str, limit: int = 10, cursor: str | None = None) -> base.SearchPage:
        source, rows = self._rows(name)
        return base.search_listing(source, rows, query, limit, cursor)

    def get_source_record(self, name: str, id_or_url: str) -> DataFrame:
        """The record with that source id, public id or address; at dtic also by an accession number in the text."""
        source, rows = self._rows(name)
        wanted = id_or_url.strip()
        known = (F.col("source_id") == wanted) | (F.col("id") == wanted) | (F.col("document_url") == wanted)
        if name == "dtic":
            known = known | F.exists(adapters.accessions(F.lit(wanted)), lambda a: F.upper("source_id").endswith(a))
        found = base.records_of(source, rows).filter(known).orderBy("ord", "pos").drop("ord", "pos").limit(1)
        if found.isEmpty():
            raise InvalidRequest(f"{name} lists no record {wanted!r}")
        return found

    # jobs

    def _enqueue(self, key: str, operation: str, source: str, source_id: str, force: bool) -> DataFrame:
        for _ in range(self.queue.TRIES):
            version = self.store.version()
            manifest = self.store.manifest(version)
            known = self.store.read("jobs", version) if "jobs" in manifest else self.spark.createDataFrame([], JOBS)
            now = datetime.now(timezone.utc).replace(tzinfo=None)
            number = (known.agg(F.max("job_id")).first()[0] or 0) + 1
            row = {"job_id": number, "job_key": key, "operation": operation, "source": source, "source_id": source_id, "status": "queued", "stage": "queued", "progress": 0.0, "attempts": 0, "warnings": [], "created_at": now, "updated_at": now}
            own = known.filter(F.col("job_key") == key)
            fresh, message = jobs_.enqueue(own, self.spark.createDataFrame([row], JOBS))
            if force:  # an ended job is queued again
                again = own.filter(F.col("status").isin("succeeded", "failed", "cancelled")).withColumns({"status": F.lit("queued"), "stage": F.lit("queued"), "progress": F.lit(0.0), "error": F.lit(None).cast("string")})
                fresh = fresh.select(*known.columns).unionByName(again)
            new = self.spark.createDataFrame(fresh.select(*known.columns).collect(), known.schema)
            if new.isEmpty():
                break
            sent = self.spark.createDataFrame(message.select("job_key", "topic", "payload", "status", "created_at").collect(), OUTBOX)
            keys = new.select("job_key")
            changes = {"jobs": (new, keys)} | ({} if sent.isEmpty() else {"outbox": (sent, keys)})
            try:
                self.store.commit_keys(changes, "job_key", version)
                break
            except Conflict:
                continue
        return self.store.read("jobs").filter(F.col("job_key") == key)

    def ingest_document(self, locator: str, force: bool = False) -> DataFrame:
        """Queues a document by `source:id`, or by `source:https://...` below a trusted prefix of the source."""
        source, _, address = locator.strip().partition(":")
        if address.lower().startswith(("http:", "https:")) and source in registry.BY_NAME:
            if not self.policy.allows(source, address):
                raise InvalidRequest(f"{source} has no trusted prefix for {address!r}")
            return self._enqueue(f"ingest:{locator.strip()}", "ingest", source, address, force)
        parts = self.spark.range(1).select(locator_parts(F.lit(locator)).alias("p")).first()["p"]
        if not parts["ok"]:
            raise InvalidRequest(f"not a document locator: {locator!r}")
        registry.source_named(parts["source"])
        return self._enqueue(f"ingest:{locator}", "ingest", parts["source"], parts["source_id"], force)

    def refresh_document(self, document_id: str, force: bool = False) -> DataFrame:
        d = self.get_document(document_id).first()
        return self._enqueue(f"refresh:{d['public_id']}", "refresh", d["source"], d["source_id"], force)

    def get_ingestion_job(self, key: str) -> DataFrame:
        found = self.store.read("jobs").filter((F.col("job_key") == key) | (F.col("job_id").cast("string") == key))
        if found.isEmpty():
            raise InvalidRequest(f"no job {key!r}")
        return found

    # documents

    def search_local_documents(self, query: str, source: str | None = None, limit: int = 10) -> tuple[DataFrame, list[str]]:
        if source is not None:
            registry.source_named(source)
        index = full_text(self.store)
        ranked = index.search(query, source, limit) if index.current(self.store) else search.search(search.build_index(self.store.read("index")), query, source, limit)
        rows = search.with_snippets(ranked, query).drop("body").collect()  # at most 100
        hits = self.spark.createDataFrame(rows, search.with_snippets(ranked, query).drop("body").schema)
        documents = self.store.read("documents")
        notes = [c for c in ("metadata_json", "citation_note", "terms_note") if c in documents.columns]
        own = documents.select("document_key", *notes).filter(F.col("document_key").isin([r["document_key"] for r in rows]) if rows else F.lit(False))
        joined = hits.join(F.broadcast(own), "document_key", "left").orderBy("score", "document_key", "chunk_id")  # at most 100 documents
        if "metadata_json" in notes:
            joined = joined.withColumn("source_warning", search.source_warning(F.col("metadata_json")))
        return joined, search.next_actions(len(rows), source)

    def get_document(self, document_id: str) -> DataFrame:
        """The document by public id or key, with its number of pages."""
        found = self.store.read("documents").filter((F.col("public_id") == document_id) | (F.col("document_key") == document_id))
        keys = [k for (k,) in found.select("document_key").collect()]  # ids are unique, so at most two
        if not keys:
            raise InvalidRequest(f"no document {document_id!r}")
        n = self.store.read("pages").filter(F.col("document_key").isin(*keys)).groupBy("document_key").agg(F.count("*").alias("n_pages"))
        return found.join(F.broadcast(n), "document_key", "left").withColumn("n_pages", F.coalesce("n_pages", F.lit(0)))

    def get_document_text(self, document_id: str, page_start: int, page_end: int) -> DataFrame:
        if page_start < 1 or page_end < page_start or page_end - page_start >= MAX_PAGES:
            raise InvalidRequest(f"pages must be 1 or more, in order, and at most {MAX_PAGES}")
        key = self.get_document(document_id).first()["document_key"]
        return pages_.page_range(self.store.read("pages").filter(F.col("document_key") == key), page_start, page_end)

    # repair

    def _index_sides(self) -> tuple[DataFrame, DataFrame]:
        documents = self.store.read("documents").select("document_key", "source", "title")
        canonical = self.store.read("chunks").drop("source", "title").join(documents, "document_key").select("document_key", "chunk_id", "source", "title", F.col("text").alias("body"), "page_start", "page_end")
        return canonical, self.store.read("index").withColumn("row_id", F.xxhash64("document_key", "chunk_id", "source", "title", "body", "page_start", "page_end"))

    def report_index_drift(self) -> DataFrame:
        return reconcile.in_report_order(reconcile.index_drift(*self._index_sides()))

    def plan_index_repairs(self) -> DataFrame:
        return reconcile.index_repair_plan(reconcile.index_drift(*self._index_sides()))

    def apply_index_repairs(self, confirmation: str) -> dict[str, int]:
        canonical, index = self._index_sides()
        plan = {r["action"]: r["n"] for r in self.plan_index_repairs().groupBy("action").agg(F.count("*").alias("n")).collect()}
        repaired = reconcile.repaired_index(canonical, index, confirmation).select(*self.store.read("index").columns)
        self.store.commit({"index": repaired})
        full_text(self.store).build(self.store.read("index"), {"tag": full_text(self.store).tag(self.store)})
        return {"rewritten": plan.get("rewrite_from_canonical", 0), "for_review": plan.get("manual_review", 0)}

    def _artifact_sides(self, document_id: str) -> tuple[str, DataFrame, DataFrame]:
        key = self.get_document(document_id).first()["document_key"]
        pages = self.store.read("pages").filter(F.col("document_key") == key)
        if "text_source" not in pages.columns:
            pages = pages.withColumn("text_source", F.lit("embedded_pdf_text"))
        return key, reconcile.expected_artifacts(pages), self.texts.files(key)

    def report_artifact_drift(self, document_id: str) -> DataFrame:
        _, expected, files = self._artifact_sides(document_id)
        return reconcile.artifact_drift(expected, files).orderBy("kind", "issue", "page", "detail")

    def plan_artifact_repairs(self, document_id: str) -> DataFrame:
        return reconcile.artifact_repair_plan(self.report_artifact_drift(document_id))

    def apply_artifact_repairs(self, document_id: str, confirmation: str) -> dict[str, int]:
        """Writes the text files that are missing or stale; unexpected entries stay for review, and a file that already
        has its text isn't written."""
        reconcile.check_artifact_confirmation(document_id, confirmation)
        key, expected, files = self._artifact_sides(document_id)
        plan = reconcile.artifact_repair_plan(reconcile.artifact_drift(expected, files)).collect()  # one document's files
        wanted = {(r["kind"], r["page"]) for r in plan if r["action"] == "write_from_canonical"}
        done = {"written": 0, "current": 0, "for_review": sum(r["action"] == "manual_review" for r in plan)}
        pages = self.store.read("pages").filter(F.col("document_key") == key).select("page_number", F.coalesce("text", F.lit("")).alias("text"))

        def put(kind: str, page: int | None, text: str) -> None:
            fresh = self.texts.write(key, kind, "document.txt" if page is None else f"{page}.txt", text)
            done["written" if fresh else "current"] += 1

        whole: list[str] = []
        for r in pages.orderBy("page_number").toLocalIterator():
            if (reconcile.ARTIFACTS[0], None) in wanted:
                whole.append(f"[page {r['page_number']}]\n{r['text']}")
            for kind in reconcile.ARTIFACTS[1:]:
                if (kind, r["page_number"]) in wanted:
                    put(kind, r["page_number"], r["text"])
        if (reconcile.ARTIFACTS[0], None) in wanted:
            put(reconcile.ARTIFACTS[0], None, "\n\n".join(whole))
        return done
