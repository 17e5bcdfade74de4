"""Running queued jobs: a batch of jobs is claimed and goes through all stages as tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators.jobs import LEASE_SECONDS
from paperloom.operators.pages import quality, split_pages
from paperloom.plans.api import Library
from paperloom.plans.ingest import ingest_texts, plan_documents, select_asset
from paperloom.session import shared
from paperloom.sources import base

# Where a shutdown may interrupt a job, and what each stage does next.
CHECKPOINTS = {
    "after_claim": "immediately after claim", "after_source_resolution": "after source resolution", "after_planning": "after planning", "before_download": "before asset download", "after_download": "after download",
    "before_extraction": "before extraction", "during_extraction": "during extraction", "before_persistence": "before persistence", "before_asset_write": "before final asset provenance write",
}
ACTIONS = {
    "resolving_source_record": "Resolving source record through configured adapter.", "planning_ingestion": "Selecting ingestible asset and building normalized document plan.",
    "downloading_asset": "Downloading selected asset with bounded size and explicit redirect policy.", "extracting_text": "Extracting page text and building chunks.",
    "persisting_document": "Persisting normalized document, pages, chunks, and local index rows.", "persisting_asset": "Persisting asset provenance after successful document/page/chunk upsert.",
}


class Interrupted(RuntimeError):
    """A shutdown was asked for at a checkpoint."""


def _iso(t: datetime) -> str:
    return t.strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"


class Worker:
    """Takes jobs from a library's queue. `cancelled` is asked at every checkpoint, with its name."""

    def __init__(self, library: Library, owner: str, cancelled: Callable[[str], bool] = lambda checkpoint: False, clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc)) -> None:
        self.library, self.owner, self.cancelled, self.clock = library, owner, cancelled, clock

    def _now(self) -> str:
        return _iso(self.clock())

    def _check(self, checkpoint: str) -> None:
        if self.cancelled(checkpoint):
            raise Interrupted(f"Shutdown interrupted this job {CHECKPOINTS[checkpoint]}; resume by reclaiming the job.")

    def run_batch(self, n: int = 1) -> dict[str, str]:
        """Claims up to `n` jobs and runs them together; the status that each of them ended with, by job key.

        A job whose record, asset or text is missing fails with the reason and stops no other. If the store or a source
        fails as a whole, all jobs of the batch do. Running a batch again after an interruption changes nothing that
        was written before.
        """
        queue = self.library.queue
        if not self.library.store.has("jobs"):
            return {}
        rows = queue.claim_next(self.owner, self._now(), _iso(self.clock() + timedelta(seconds=LEASE_SECONDS)), n)
        if not rows:
            return {}
        open_jobs = [r["job_key"] for r in rows]
        failed: dict[str, str] = {}

        def drop(reasons: dict[str, str]) -> None:
            if reasons:
                failed.update(reasons)
                queue.finish(list(reasons), self.owner, "failed", self._now(), reasons, "Correct what the error names, then queue the document again.")
                open_jobs[:] = [k for k in open_jobs if k not in reasons]

        def stage(name: str) -> None:
            if open_jobs:
                queue.stage(open_jobs, self.owner, name, self._now(), ACTIONS[name])

        try:
            self._check("after_claim")
            stage("resolving_source_record")
            found = shared(self._records(rows))
            known = {k for (k,) in found.select("job_key").collect()}  # at most n
            drop({r["job_key"]: f"{r['source']} lists no record {r['source_id']!r}" for r in rows if r["job_key"] not in known})
            self._check("after_source_resolution")
            stage("planning_ingestion")
            assets = shared(select_asset(found, "job_key"))
            drop({r["job_key"]: f"no asset can be ingested; the record has: {r['roles'] or 'none'}" for r in assets.filter("kind IS NULL").collect()})
            self._check("after_planning")
            stage("downloading_asset")
            self._check("before_download")
            texts = self.library.assets if self.library.assets is not None else self.library.spark.createDataFrame([], "asset_url string, text string")
            wanted = assets.filter("kind IS NOT NULL")
            held = shared(wanted.join(texts.select("asset_url", "text").filter("text IS NOT NULL").dropDuplicates(["asset_url"]), "asset_url").select("job_key", "asset_url", "kind", "text"))
            there = {k for (k,) in held.select("job_key").collect()}
            drop({r["job_key"]: f"the asset isn't available: {r['asset_url']}" for r in wanted.collect() if r["job_key"] not in there})
            self._check("after_download")
            stage("extracting_text")
            self._check("before_extraction")
            pages = shared(split_pages(held, ["job_key"]))
            full = {k for (k,) in pages.select("job_key").distinct().collect()}
            drop({k: "the asset has no text" for k in there - full})
            warned = {r["job_key"]: list(r["warnings"]) for r in quality(pages, "job_key").filter(F.size("warnings") > 0).collect()}
            self._check("during_extraction")
            stage("persisting_document")
            self._check("before_persistence")
            if open_jobs:
                good = found.filter(F.col("job_key").isin(*open_jobs))
                documents = plan_documents(good, "job_key")
                joined = documents.select("job_key", "document_key").join(held.select("job_key", "text"), "job_key")
                one = lambda df: df.dropDuplicates(["document_key"])  # noqa: E731  (two jobs of one document)
                ingest_texts(self.library.store, one(documents.drop("job_key")), one(joined.select("document_key", "text")))
                if any(k in open_jobs for k in warned):
                    queue.warn({k: v for k, v in warned.items() if k in open_jobs}, self.owner, self._now())
                queue.link(dict(map(tuple, documents.select("job_key", "document_key").collect())), self.owner, self._now())
            stage("persisting_asset")
            self._check("before_asset_write")
            if open_jobs:
                origin = held.filter(F.col("job_key").isin(*open_jobs)).join(found.select("job_key", "document_key"), "job_key").select("document_key", "asset_url", "kind", F.sha2("text", 256).alias("sha256")).dropDuplicates(["document_key"])
                self.library.store.commit_keys({"document_assets": (origin, origin.select("document_key"))}, "document_key")
                queue.finish(open_jobs, self.owner, "succeeded", self._now())
        except Interrupted as e:
            if open_jobs:
                queue.finish(open_jobs, self.owner, "interrupted", self._now(), {k: str(e) for k in open_jobs}, str(e))
            return {**{k: "failed" for k in failed}, **{k: "interrupted" for k in open_jobs}}
        except Exception as e:  # the batch as a whole: jobs must not stay running
            reason = f"{type(e).__name__}: {e}"[:2000]
            queue.finish(open_jobs, self.owner, "failed", self._now(), {k: reason for k in open_jobs}, "Correct what the error names, then queue the document again.")
            raise
        return {**{k: "failed" for k in failed}, **{k: "succeeded" for k in open_jobs}}

    def _records(self, rows: list) -> DataFrame:
        """The jobs' records with their job key: by source id, public id or address; the first in listing order."""
        spark, parts = self.library.spark, []
        for source in sorted({r["source"] for r in rows}):
            asked = spark.createDataFrame([(r["job_key"], r["source_id"].strip()) for r in rows if r["source"] == source], "job_key string, wanted string")
            if source not in self.library.listings:
                continue
            records = base.records_of(*self.library._rows(source))
            names = F.explode(F.array_distinct(F.array("source_id", "id", "document_url"))).alias("wanted")
            at = records.select(F.struct("ord", "pos").alias("_at"), F.struct(*[c for c in records.columns if c not in ("ord", "pos")]).alias("_r"), names)
            parts.append(at.join(F.broadcast(asked), "wanted").groupBy("job_key").agg(F.min_by("_r", "_at").alias("_r")).select("job_key", "_r.*"))  # at most a batch of jobs
        if not parts:
            return spark.createDataFrame([], "job_key string, " + base.RECORD)
        return reduce(DataFrame.unionByName, parts)

    def run_until_idle(self, n: int = 20) -> dict[str, str]:
        """Batches until nothing can be claimed."""
        out: dict[str, str] = {}
        while done := self.run_batch(n):
            out |= done
            if all(s == "interrupted" for s in done.values()):
                break
        return out
