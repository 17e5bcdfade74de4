"""Durable jobs: an append-only event log folded to current states, and the queue's picking rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.search import InvalidRequest
from paperloom.operators.store import Conflict, SnapshotStore

# Progress that each stage reports.
STAGES = {"resolving_source_record": 0.10, "planning_ingestion": 0.20, "downloading_asset": 0.35, "extracting_text": 0.60, "persisting_document": 0.80, "persisting_asset": 0.90, "succeeded": 1.0}
#: Seconds that a claim lasts.
LEASE_SECONDS = 300
STATUSES = ("queued", "running", "succeeded", "failed", "cancelled", "interrupted")


def enqueue(jobs: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New jobs whose key isn't known yet (the first of equal keys by created_at) and their outbox messages. A known
    key, also a finished one, is left as it is."""
    others = [c for c in new.columns if c != "job_key"]
    first = new.groupBy("job_key").agg(F.min_by(F.struct(*others), F.col("created_at")).alias("_r")).select("job_key", *[F.col(f"_r.{c}").alias(c) for c in others])
    fresh = first.join(jobs.select("job_key"), "job_key", "left_anti")
    outbox = fresh.select("job_key", F.lit("ingestion_job_enqueued").alias("topic"), F.to_json(F.struct("job_key", "source", "source_id")).alias("payload"), F.lit("pending").alias("status"), "created_at")
    return fresh, outbox


def lease_end(now: Column, seconds: int = LEASE_SECONDS) -> Column:
    """When a lease that begins now ends, as it is stored: ISO in UTC with milliseconds."""
    at = (now + F.make_interval(secs=F.lit(seconds))).cast("timestamp")
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def first_deliveries(jobs: DataFrame) -> DataFrame:
    """One row per job_key, the one with the least job_id."""
    others = [c for c in jobs.columns if c != "job_key"]
    return jobs.groupBy("job_key").agg(F.min_by(F.struct(*others), F.col("job_id")).alias("_r")).select("job_key", *[F.col(f"_r.{c}").alias(c) for c in others])


def claim_rank(now: Column) -> Column:
    """0 queued, 1 interrupted, 2 running with an expired lease; null for jobs that can't be claimed. A lease that ends
    now has expired."""
    expired = F.try_to_timestamp(F.col("lease_expires_at")) <= now
    return F.when(F.col("status") == "queued", 0).when(F.col("status") == "interrupted", 1).when((F.col("status") == "running") & F.coalesce(expired, F.lit(False)), 2)


def next_claims(jobs: DataFrame, now: str, n: int = 1) -> DataFrame:
    """The next `n` jobs to claim at `now` (ISO, UTC), in order: rank, updated_at, job_id."""
    ranked = jobs.withColumn("claim_rank", claim_rank(F.lit(now).cast("timestamp"))).filter("claim_rank IS NOT NULL")
    return ranked.orderBy("claim_rank", "updated_at", "job_id").limit(n)


def claimed(job: DataFrame, owner: str, lease_expires_at: str, now: str | None = None) -> DataFrame:
    """Claimed rows: running under `owner`, one more attempt (none for the same owner), error cleared."""
    again = (F.col("status") == "running") & F.col("lease_owner").eqNullSafe(F.lit(owner))
    out = job.withColumns({
        "attempts": F.col("attempts") + F.when(again, 0).otherwise(1), "status": F.lit("running"), "lease_owner": F.lit(owner),
        "lease_expires_at": F.lit(lease_expires_at), "error": F.lit(None).cast("string"),
    })
    if "next_action" in job.columns:
        out = out.withColumn("next_action", F.lit(f"Claimed by {owner} until {lease_expires_at}; ingestion execution may resume from stage."))
    return out if now is None else out.withColumn("updated_at", F.lit(now).cast("timestamp"))


def can_claim(owner: str, now: str) -> Column:
    """Whether a job that is asked for by key may be claimed: as in the queue, or again by its owner."""
    return claim_rank(F.lit(now).cast("timestamp")).isNotNull() | ((F.col("status") == "running") & F.col("lease_owner").eqNullSafe(F.lit(owner)))


def held_by(owner: str) -> Column:
    return (F.col("status") == "running") & F.col("lease_owner").eqNullSafe(F.lit(owner))


def staged(jobs: DataFrame, owner: str, stage: str, progress: float, now: str, next_action: str | None = None) -> DataFrame:
    """Jobs under the owner's lease at a stage; progress never falls."""
    if not 0 <= progress <= 1:
        raise InvalidRequest("progress must be between 0 and 1")
    return jobs.filter(held_by(owner)).withColumns({"stage": F.lit(stage), "progress": F.greatest("progress", F.lit(progress)), "next_action": F.lit(next_action).cast("string"), "updated_at": F.lit(now).cast("timestamp")})


def finished(jobs: DataFrame, owner: str, status: str, now: str, error: Column | None = None, next_action: Column | None = None) -> DataFrame:
    """Jobs under the owner's lease at their end: succeeded (progress 1), failed (progress kept) or interrupted (stage
    and progress kept); the lease is given up. Jobs that already have the status are as they are."""
    if status not in ("succeeded", "failed", "interrupted"):
        raise InvalidRequest(f"jobs don't end as {status!r}")
    ends = F.col("status") != status
    null = F.lit(None).cast("string")
    change = {
        "stage": F.col("stage") if status == "interrupted" else F.lit(status), "progress": F.lit(1.0) if status == "succeeded" else F.col("progress"),
        "lease_owner": null, "lease_expires_at": null, "error": null if error is None or status == "succeeded" else error,
        "next_action": F.lit("Ingestion completed; local search index is ready.") if status == "succeeded" else (null if next_action is None else next_action),
        "updated_at": F.lit(now).cast("timestamp"),
    }
    kept = jobs.filter((F.col("status") == status) | held_by(owner))
    return kept.withColumns({c: F.when(ends, v).otherwise(F.col(c)) for c, v in change.items()}).withColumn("status", F.lit(status))


class JobQueue:
    """The jobs of a store. Every change reads the jobs it is about and is committed only if no other writer came
    between; then it is tried again, so that two workers never hold one job."""

    TRIES = 20

    def __init__(self, store: SnapshotStore) -> None:
        self.store = store

    def _change(self, pick: Callable[[DataFrame], DataFrame], change: Callable[[DataFrame], DataFrame]) -> list:
        for _ in range(self.TRIES):
            version = self.store.version()
            table = self.store.read("jobs", version)
            rows = change(pick(table)).select(*table.columns).collect()  # the jobs of one claim
            if not rows:
                return []
            new = self.store.spark.createDataFrame(rows, table.schema)
            try:
                self.store.commit_keys({"jobs": (new, new.select("job_key"))}, "job_key", version)
            except Conflict:
                continue
            return rows
        raise Conflict("the jobs are changed too often by others")

    def _of(self, keys: list[str]) -> Callable[[DataFrame], DataFrame]:
        return lambda jobs: jobs.filter(F.col("job_key").isin(*keys))

    def _all(self, keys: list[str], rows: list, what: str) -> list:
        missing = sorted(set(keys) - {r["job_key"] for r in rows})
        if missing:
            raise InvalidRequest(f"jobs {', '.join(missing)} {what}")
        return rows

    def claim_next(self, owner: str, now: str, expires: str, n: int = 1) -> list:
        """The next `n` jobs, claimed; fewer if there are no more."""
        return self._change(lambda jobs: next_claims(jobs, now, n).drop("claim_rank"), lambda jobs: claimed(jobs, "", expires, now).withColumns({"lease_owner": F.lit(owner), "next_action": F.lit(f"Claimed by {owner} until {expires}; ingestion execution may resume from stage.")}))

    def claim(self, keys: list[str], owner: str, now: str, expires: str) -> list:
        """These jobs, claimed if all may be."""
        known = self.store.read("jobs").filter(F.col("job_key").isin(*keys) & can_claim(owner, now)).select("job_key").collect()
        self._all(keys, known, "cannot be claimed")
        return self._all(keys, self._change(self._of(keys), lambda jobs: claimed(jobs.filter(can_claim(owner, now)), owner, expires, now)), "cannot be claimed")

    def stage(self, keys: list[str], owner: str, stage: str, now: str, next_action: str | None = None) -> list:
        return self._all(keys, self._change(self._of(keys), lambda jobs: staged(jobs, owner, stage, STAGES[stage], now, next_action)), "are not running under the lease")

    def warn(self, warnings: dict[str, list[str]], owner: str, now: str) -> list:
        """Adds warnings that a job doesn't have yet."""
        new = F.create_map(*[x for k, v in warnings.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
        add = lambda jobs: jobs.filter(held_by(owner)).withColumns({"warnings": F.array_distinct(F.concat("warnings", new[F.col("job_key")])), "updated_at": F.lit(now).cast("timestamp")})
        return self._all(list(warnings), self._change(self._of(list(warnings)), add), "are not running under the lease")

    def link(self, documents: dict[str, str], owner: str, now: str) -> list:
        """Links jobs to their documents (key by job key), which must be stored."""
        stored = {k for (k,) in self.store.read("documents").filter(F.col("document_key").isin(*documents.values())).select("document_key").collect()}
        missing = sorted(set(documents.values()) - stored)
        if missing:
            raise InvalidRequest(f"no documents {', '.join(missing)}")
        key = F.create_map(*[F.lit(x) for kv in documents.items() for x in kv])
        return self._all(list(documents), self._change(self._of(list(documents)), lambda jobs: jobs.filter(held_by(owner)).withColumns({"document_key": key[F.col("job_key")], "updated_at": F.lit(now).cast("timestamp")})), "are not running under the lease")

    def finish(self, keys: list[str], owner: str, status: str, now: str, errors: dict[str, str] | None = None, next_action: str | None = None) -> list:
        """Ends jobs; ones that already ended so are left as they are."""
        error = F.create_map(*[F.lit(x) for kv in errors.items() for x in kv])[F.col("job_key")] if errors else None
        action = F.lit(next_action).cast("string")
        return self._all(keys, self._change(self._of(keys), lambda jobs: finished(jobs, owner, status, now, error, action)), f"cannot become {status}")


def progress_by_event(events: DataFrame) -> DataFrame:
    """Each event with the job's progress so far, which never falls: job, at, event_id, progress."""
    w = Window.partitionBy("job").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.select("job", "at", "event_id", F.greatest(F.max("reported").over(w), F.lit(0.0)).alias("progress"))


def fold_jobs(events: DataFrame) -> DataFrame:
    """Current state of each job from its events (job, at, event_id, status, reported, warning, error).

    Status and error are those of the last event that has one; after a terminal status later ones don't count;
    progress is the largest reported, 1 if succeeded; warnings are distinct in the order of their first event. All are
    partial aggregates, so a job with very many events is reduced before the shuffle (warnings to the distinct ones).
    """
    order = F.struct("at", "event_id")
    terminal = F.col("status").isin("succeeded", "failed", "cancelled")
    base = events.groupBy("job").agg(
        F.min_by(F.when(terminal, F.col("status")), F.when(terminal, order)).alias("ended"), F.max_by("status", F.when(F.col("status").isNotNull(), order)).alias("last"),
        F.max("reported").alias("reported"), F.max_by("error", F.when(F.col("error").isNotNull(), order)).alias("error"), F.count("*").alias("n_events"), F.max("at").alias("updated_at"),
    )
    warned = events.filter("warning IS NOT NULL").groupBy("job", "warning").agg(F.min(order).alias("o")).groupBy("job").agg(F.sort_array(F.collect_list(F.struct("o", "warning"))).alias("w"))
    status = F.coalesce("ended", "last", F.lit("queued"))
    joined = base.join(warned, "job", "left")
    return joined.select(
        "job", status.alias("status"), F.when(status == "succeeded", F.lit(1.0)).otherwise(F.greatest(F.least(F.coalesce("reported", F.lit(0.0)), F.lit(1.0)), F.lit(0.0))).alias("progress"),
        F.coalesce(F.transform("w", lambda x: x["warning"]), F.array().cast("array<string>")).alias("warnings"), F.when(status != "succeeded", F.col("error")).alias("error"), "n_events", "updated_at",
    )


def check_jobs(jobs: DataFrame) -> DataFrame:
    """Rows that break a rule of the job table: job_id and the rule."""
    rules = [
        ("status", F.col("status").isin(*STATUSES)), ("progress", F.col("progress").between(0, 1)), ("attempts", F.col("attempts") >= 0),
        ("lease", (F.col("status") != "running") | F.col("lease_owner").isNotNull()),
    ]
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]))
    return jobs.select("job_id", F.explode(broken).alias("rule"))
