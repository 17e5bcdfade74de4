"""The queue under leases, two writers, and jobs run to their end."""

import threading
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from paperloom.operators.jobs import JobQueue
from paperloom.operators.search import InvalidRequest
from paperloom.operators.store import Conflict, SnapshotStore
from paperloom.plans.api import Library
from paperloom.plans.policy import DirectPolicy
from paperloom.plans.worker import CHECKPOINTS, Worker
from paperloom.streaming.ingest import stream_worker

HTML = "".join(f"<a href='/readingroom/document/{n}.pdf'>File {n}</a>" for n in ("a1", "b2", "c3")) + "<a href='/readingroom/document/d4'>Page only</a>"


@pytest.fixture()
def library(spark, tmp_path):
    listing = spark.createDataFrame([(0, "https://www.cia.gov/readingroom/x", HTML)], "ord int, page_url string, html string")
    base = "https://www.cia.gov/readingroom/document/"
    assets = spark.createDataFrame([(base + "a1.pdf", "red stone\fblue " + "river " * 30), (base + "b2.pdf", " \f ")], "asset_url string, text string")
    return Library(spark, SnapshotStore(spark, str(tmp_path / "s"), 4), {"cia": listing}, assets, ("cia=https://www.cia.gov/readingroom/document/",))


def test_commits_of_keys(spark, tmp_path):
    s = SnapshotStore(spark, str(tmp_path), 4)
    df = lambda rows: spark.createDataFrame(rows, "k string, v int")
    s.commit_keys({"t": (df([(f"k{i}", i) for i in range(40)]), df([(f"k{i}", 0) for i in range(40)]))}, "k")
    before = s.manifest()["t"]["folders"]
    s.commit_keys({"t": (df([("k1", 100), ("k1", 101)]), df([("k1", 0)]))}, "k")
    after = s.manifest()["t"]["folders"]
    assert sum(before[b] != after[b] for b in after) == 1  # only the bucket of the key is written
    assert sorted(r["v"] for r in s.read("t").collect()) == sorted([*(i for i in range(40) if i != 1), 100, 101])
    version = s.version()
    s.commit({"u": df([("x", 1)])})
    with pytest.raises(Conflict):
        s.commit_keys({"t": (df([("k2", 5)]), df([("k2", 0)]))}, "k", version)
    assert s.read("t").filter("k = 'k2'").first()["v"] == 2
    s.commit_keys({"u": (df([]), df([("x", 0)]))}, "k")  # a whole table becomes one in buckets, here an empty one
    assert s.read("u").count() == 0 and s.read("t", version).count() == 41


def test_leases(spark, library):
    for n in ("a1.pdf", "b2.pdf"):
        library.ingest_document(f"cia:readingroom/document/{n}")
    q, now, later = library.queue, "2001-01-01T00:00:00Z", "2001-01-01T00:05:00Z"
    [job] = q.claim_next("w1", now, later)
    key = job["job_key"]
    assert job["attempts"] == 1 and job["next_action"].startswith("Claimed by w1 until 2001-01-01T00:05:00Z")
    for bad in (lambda: q.claim([key], "w2", now, later), lambda: q.stage([key], "w2", "planning_ingestion", now), lambda: q.finish([key], "w2", "succeeded", now), lambda: q.finish([key], "w1", "done", now), lambda: q.link({key: "nothing"}, "w1", now)):
        with pytest.raises((InvalidRequest, KeyError)):
            bad()
    assert q.claim([key], "w1", now, later)[0]["attempts"] == 1  # the same owner
    assert q.claim([key], "w2", later, "2001-01-01T00:10:00Z")[0]["attempts"] == 2  # an ended lease
    assert q.stage([key], "w2", "extracting_text", now)[0]["progress"] == 0.6 and q.stage([key], "w2", "planning_ingestion", now)[0]["progress"] == 0.6
    assert q.warn({key: ["a", "b"]}, "w2", now) and q.warn({key: ["b", "c"]}, "w2", now)[0]["warnings"] == ["a", "b", "c"]
    ended = q.finish([key], "w2", "failed", now, {key: "why"}, "do")[0]
    assert (ended["status"], ended["progress"], ended["error"], ended["lease_owner"], ended["next_action"]) == ("failed", 0.6, "why", None, "do")
    assert q.finish([key], "w9", "failed", now, {key: "other"})[0]["error"] == "why"  # already so
    with pytest.raises(InvalidRequest):
        q.finish([key], "w2", "succeeded", now)


def test_two_workers_never_hold_one_job(spark, library):
    for i in range(4):
        library._enqueue(f"k{i}", "ingest", "cia", str(i), False)
    got: list = []
    take = lambda owner: got.extend((owner, r["job_key"]) for _ in range(2) for r in JobQueue(library.store).claim_next(owner, "2001-01-01T00:00:00Z", "2001-01-01T00:05:00Z"))
    threads = [threading.Thread(target=take, args=(f"w{i}",)) for i in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(k for _, k in got) == ["k0", "k1", "k2", "k3"]


def test_jobs_run_to_their_end(spark, library):
    for n in ("a1.pdf", "b2.pdf", "c3.pdf", "d4", "zz"):
        library.ingest_document(f"cia:readingroom/document/{n}")
    done = Worker(library, "w").run_until_idle()
    rows = {r["source_id"].rsplit("/", 1)[1]: r for r in library.store.read("jobs").collect()}
    assert {k: r["status"] for k, r in rows.items()} == {"a1.pdf": "succeeded", "b2.pdf": "failed", "c3.pdf": "failed", "d4": "failed", "zz": "failed"} and len(done) == 5
    assert rows["a1.pdf"]["progress"] == 1.0 and rows["a1.pdf"]["stage"] == "succeeded" and rows["a1.pdf"]["document_key"] and rows["a1.pdf"]["lease_owner"] is None
    assert [rows[k]["error"].split(":")[0] for k in ("b2.pdf", "c3.pdf", "d4", "zz")] == ["the asset has no text", "the asset isn't available", "no asset can be ingested; the record has", "cia lists no record 'readingroom/document/zz'"]
    hits, _ = library.search_local_documents("river")
    assert [r["page_start"] for r in hits.collect()] == [1] and library.get_document(rows["a1.pdf"]["document_key"]).first()["n_pages"] == 2
    assert library.store.read("document_assets").first()["kind"] == "pdf"
    library.ingest_document("cia:readingroom/document/a1.pdf", force=True)
    assert Worker(library, "w").run_batch(5) == {"ingest:cia:readingroom/document/a1.pdf": "succeeded"} and library.store.read("pages").count() == 2
    assert library.search_local_documents("river")[0].count() == 1 and Worker(library, "w").run_batch() == {}


@pytest.mark.parametrize("at", ["after_claim", "before_persistence"])
def test_shutdown_interrupts(spark, library, at):
    library.ingest_document("cia:readingroom/document/a1.pdf")
    assert set(Worker(library, "w", lambda checkpoint: checkpoint == at).run_batch().values()) == {"interrupted"}
    row = library.store.read("jobs").first()
    assert row["status"] == "interrupted" and row["lease_owner"] is None and row["next_action"] == f"Shutdown interrupted this job {CHECKPOINTS[at]}; resume by reclaiming the job."
    assert not library.store.has("pages")
    clock = lambda: datetime.now(timezone.utc) + timedelta(seconds=1)
    assert set(Worker(library, "w2", clock=clock).run_batch().values()) == {"succeeded"} and library.store.read("jobs").first()["attempts"] == 2


def test_polling(spark, library, tmp_path):
    query = stream_worker(spark, Worker(library, "w"), str(tmp_path / "c"), "1 second")
    library.ingest_document("cia:readingroom/document/a1.pdf")
    for _ in range(60):
        if library.store.read("jobs").first()["status"] == "succeeded":
            break
        query.awaitTermination(1)
    query.stop()
    assert library.store.read("jobs").first()["status"] == "succeeded" and query.exception() is None


def test_trusted_addresses(library):
    policy = DirectPolicy(("cia=https://www.cia.gov/readingroom/docs/", "nsa=https://nsa.gov:8443/d"))
    ok = [("cia", "https://WWW.cia.gov/readingroom/docs/x"), ("nsa", "https://nsa.gov:8443/d?x=1"), ("cia", "https://www.cia.gov/readingroom/docs/")]
    bad = [("cia", "http://www.cia.gov/readingroom/docs/x"), ("cia", "https://u:p@www.cia.gov/readingroom/docs/x"), ("cia", "https://www.cia.gov/readingroom/docsx"), ("cia", "https://www.cia.gov/readingroom/docs/../x"), ("cia", "https://www.cia.gov/readingroom/docs/%2e%2e/x"), ("nsa", "https://nsa.gov/d"), ("dia", "https://nsa.gov:8443/d"), ("cia", "https://www.cia.gov:x/")]
    assert all(policy.allows(*x) for x in ok) and not any(policy.allows(*x) for x in bad)
    for entry in ("cia=http://a.org/x", "cia=https://a.org/", "=https://a.org/x", "cia=https://u@a.org/x", "cia"):
        with pytest.raises(InvalidRequest):
            DirectPolicy((entry,))
    job = library.ingest_document("cia:https://www.cia.gov/readingroom/document/a1.pdf").first()
    assert job["source_id"] == "https://www.cia.gov/readingroom/document/a1.pdf"
    with pytest.raises(InvalidRequest):
        library.ingest_document("cia:https://www.cia.gov/other")
    assert Worker(library, "w").run_batch() and library.store.read("documents").filter(F.col("source") == "cia").count() == 1
