import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from paperloom.functions import ident, text, url
from paperloom.operators import cache, chunking, jobs, pages, reconcile, store
from paperloom.operators.search import InvalidRequest
from paperloom.plans import ingest
from paperloom.plans.api import Library
from paperloom.streaming.ingest import EVENTS, TEXTS, arrivals, stream_jobs, stream_texts

T = datetime(2001, 2, 3)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# --- functions


def test_fnv(spark):
    def plain(s):
        h = 0xCBF29CE484222325
        for b in s.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        return f"{h:016x}"

    rng = random.Random(1)
    texts = ["", "a", "cia:CI-1", "état:é😀"] + ["".join(rng.choices("abcé:/-0123456789", k=rng.randint(1, 60))) for _ in range(50)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ident.fnv64(F.col("t")).alias("h"))
    assert {r["t"]: r["h"] for r in df.collect()} == {t: plain(t) for t in texts}
    assert one(spark, ident.document_key(F.lit("frus"), F.lit("Series 1/d_4"))) == "frus-series-1-d-4"


@pytest.mark.parametrize("locator,ok", [("cia:abc", True), ("cia:a:b", True), ("https://x.org/a", False), ("file:/etc", False), ("cia:../x", False), ("cia:/abs", False), ("c:\\x", False), ("cia:", False), ("nothing", False), ("./x:y", False)])
def test_locators(spark, locator, ok):
    assert one(spark, ident.locator_parts(F.lit(locator)))["ok"] is ok


@pytest.mark.parametrize("href,want", [("https://b.org/x", "https://b.org/x"), ("//b.org/x", "https://b.org/x"), ("/x/y", "https://a.org/x/y"), ("f.pdf", "https://a.org/dir/f.pdf"), ("./f.pdf", "https://a.org/dir/f.pdf"), ("?q=1", "https://a.org/dir/page?q=1"), ("mailto:me", "mailto:me")])
def test_absolutize(spark, href, want):
    assert one(spark, url.absolutize(F.lit(href), F.lit("https://a.org/dir/page"))) == want


def test_urls(spark):
    u = F.lit("HTTP://User@A.Org:80/P/Q?Case=3&b=#f")
    assert one(spark, url.host(u)) == "a.org" and one(spark, url.path(u)) == "/P/Q" and one(spark, url.query(u)) == "Case=3&b="
    assert one(spark, url.parameter(u, "case")) == "3" and one(spark, url.parameter(u, "z")) is None and one(spark, url.parameter(u, "b")) == ""
    assert one(spark, url.source_id_of(F.lit("https://a.org/"), "Home")) == "Home" and one(spark, url.source_id_of(u, "Home")) == "P/Q?Case=3&b="
    assert one(spark, url.percent_encode(F.lit("a b~*é+"))) == "a%20b~%2A%C3%A9%2B" and one(spark, url.plus_encode(F.lit("a b"))) == "a+b"
    assert one(spark, url.canonical(F.lit("http://A.org"))) == "https://a.org/"
    assert [one(spark, url.under_prefix(F.lit(x), "https://a.org/d/")) for x in ("https://a.org/d", "https://a.org/d/x", "https://a.org/dx", "https://a.org/d/../x")] == [True, True, False, False]
    go = lambda t, deny=False: one(spark, url.redirect_allowed(F.lit("https://a.org/x"), F.lit(t), deny))
    assert go("https://a.org/y") and not go("https://b.org/y") and not go("http://a.org/y") and not go("https://u@a.org/") and not go("https://a.org/y", True)


def test_texts(spark):
    assert one(spark, text.squeeze(F.lit(" a\xa0 b\n"))) == "a b" and one(spark, text.preview(F.lit("éé"), 3)) == "éé..." and one(spark, text.preview(F.lit("abc"), 3)) == "abc"
    assert one(spark, text.token_estimate(F.lit(""))) == 1 and one(spark, text.token_estimate(F.lit("a\xa0b c"))) == 3 and one(spark, text.chunk_id(F.lit(12345))) == "chunk-12345"
    assert one(spark, text.first_non_empty(F.lit(" "), F.lit(None), F.lit(" x "))) == "x" and one(spark, text.title_from_id(F.lit("a/my-great_file.pdf"))) == "My Great File"
    assert one(spark, text.tokenize(F.lit("Café—it's ÀB_c"))) == ["cafe", "it", "s", "ab", "c"] and one(spark, text.tokenize(F.lit(None).cast("string"))) == []


# --- pages and chunks


def test_page_split(spark):
    df = spark.createDataFrame([(1, "\f First  \n x \f \f\nThird\f \f"), (2, None), (3, " \f\n"), (4, "only"), (5, "a\fb" * 5000)], "id int, text string")
    got = pages.split_pages(df, ["id"]).collect()
    assert [(r["id"], r["page_number"], r["text"]) for r in got if r["id"] < 5] == [(1, 2, "First\n x"), (1, 3, ""), (1, 4, "Third"), (4, 1, "only")]
    assert sum(r["id"] == 5 for r in got) == 5001


def test_quality_and_choice(spark):
    rows = [("a", 1, "x" * 50), ("a", 2, " "), ("b", 1, "short"), ("c", 1, "y" * 80)]
    e = spark.createDataFrame(rows, "document_key string, page_number int, text string")
    q = {r["document_key"]: r for r in pages.quality(e).collect()}
    assert q["a"]["warnings"] == ["embedded PDF text contains 1 blank page(s) among 2 parsed page(s); OCR fallback may improve coverage"] and q["b"]["warnings"] == ["embedded PDF text has low density (5 visible chars/page); OCR fallback may improve quality"] and q["c"]["warnings"] == [] and q["a"]["mean_visible"] == 50
    o = spark.createDataFrame([("a", 1, "O1"), ("a", 2, "O2"), ("b", 1, "O"), ("b", 2, "extra"), ("c", 1, "O"), ("d", 1, "O")], e.schema)
    got = sorted((r["document_key"], r["page_number"], r["text_source"]) for r in pages.choose_text(e, o).collect())
    assert got == [("a", 1, "local_ocr"), ("a", 2, "local_ocr"), ("b", 1, "embedded_pdf_text"), ("c", 1, "embedded_pdf_text"), ("d", 1, "local_ocr")]
    assert pages.choose_text(e, o, use_ocr=False).filter("text_source <> 'embedded_pdf_text'").isEmpty()


@pytest.mark.parametrize("target", [1, 4, 50])
def test_chunks(spark, target):
    rng = random.Random(target)
    rows = [(f"d{d}", p, None if rng.random() < 0.1 else " ".join(["w"] * rng.randint(0, 9))) for d in range(12) for p in range(1, rng.randint(2, 40))]
    want = {}
    for d in {r[0] for r in rows}:
        n, total = 1, None
        for _, p, t in sorted(r for r in rows if r[0] == d):
            size = max(1, len((t or "").split()))
            n, total = (n, size) if total is None else (n + 1, size) if total + size > target else (n, total + size)
            want[d, p] = n
    df = spark.createDataFrame(rows, "document_key string, page_number int, text string").repartition(3)
    assert {(r[0], r[1]): r[2] for r in chunking.assign_chunks(df, target).collect()} == want
    built = chunking.build_chunks(df, target).collect()
    assert len(built) == len({(d, n) for (d, _), n in want.items()}) and all(r["page_start"] <= r["page_end"] for r in built)
    assert chunking.build_chunks(df.limit(0), target).count() == 0


def test_page_range(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, None), ("k", 3, "c")], "document_key string, page_number int, text string")
    r = pages.page_range(df, 2, 9).first()
    assert r["text"] == "[page 2]\n\n\n[page 3]\nc" and r["citations"] == "k#page=2 k#page=3" and r["n_pages"] == 2


# --- tables


def test_store(spark, tmp_path):
    s = store.SnapshotStore(spark, str(tmp_path))
    assert s.manifest() == {} and not s.has("a")
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    s.commit({"t": old})
    s.commit({"t": store.upsert(s.read("t"), new, ["k"]), "u": new})
    assert sorted(map(tuple, s.read("t").collect())) == [(1, "a"), (2, "B"), (3, "C")] and s.read("u").count() == 2
    assert sorted(map(tuple, store.insert_or_ignore(old, new, ["k"]).collect())) == [(3, "C")]
    assert sorted(map(tuple, store.replace_children(old, new, new.select("k"), "k").collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert sorted(map(tuple, store.delete_keys(old, new, "k").collect())) == [(1, "a")]
    with pytest.raises(InvalidRequest):
        s.read("missing")


def test_cache(spark):
    schema = "cache_key string, policy string, expires_at timestamp, cache_control string"
    entries = spark.createDataFrame([("a", cache.RESPECT, T, None), ("b", cache.RESPECT, T - timedelta(days=9), None), ("c", cache.REVALIDATE, T, None), ("d", cache.RESPECT, None, None)], schema)
    keys = entries.select("cache_key")
    now = (T - timedelta(days=1)).isoformat() + "Z"
    assert [r[0] for r in cache.lookup(entries, keys, now).collect()] == ["a"] and cache.lookup(entries, keys, now, force=True).isEmpty()
    fetched = spark.createDataFrame([("a", cache.RESPECT, T, "max-age=3, No-Store"), ("e", cache.RESPECT, T, 'private="x"'), ("b", cache.RESPECT, T, "no-storeish")], schema)
    assert sorted(r[0] for r in cache.store(entries, fetched).collect()) == ["b", "c", "d"]


def test_jobs(spark):
    def state(i, status, lease=None, at=0, owner="o"):
        return (i, f"k{i}", status, lease, T + timedelta(minutes=at), owner if status == "running" else None, 1, 0.5, "e")

    schema = "job_id long, job_key string, status string, lease_expires_at string, updated_at timestamp, lease_owner string, attempts int, progress double, error string"
    table = spark.createDataFrame([state(1, "running", "2001-02-03T00:00:00Z"), state(2, "interrupted"), state(3, "queued", at=5), state(4, "queued", at=1), state(5, "running", "2001-02-04T00:00:00Z"), state(6, "succeeded"), state(7, "running", "junk")], schema)
    got = jobs.next_claims(table, "2001-02-03T00:00:00Z", 9)
    assert [r["job_id"] for r in got.collect()] == [4, 3, 2, 1]
    rows = {r["job_id"]: r for r in jobs.claimed(got, "o", "x").collect()}
    assert rows[4]["attempts"] == 2 and rows[1]["attempts"] == 1 and rows[4]["error"] is None and rows[4]["progress"] == 0.5
    events = [("a", T, 1, "running", 0.35, "w1", None), ("a", T, 2, None, 0.2, "w2", None), ("a", T, 3, None, None, "w1", "bad"), ("a", T, 4, "failed", None, None, None), ("a", T, 5, "succeeded", 0.9, None, None), ("b", T, 6, "succeeded", None, None, "x"), ("c", T, 7, None, 0.2, None, None)]
    out = {r["job"]: r for r in jobs.fold_jobs(spark.createDataFrame(events, EVENTS)).collect()}
    assert (out["a"]["status"], out["a"]["progress"], out["a"]["warnings"], out["a"]["error"]) == ("failed", 0.9, ["w1", "w2"], "bad")
    assert (out["b"]["status"], out["b"]["progress"], out["b"]["error"]) == ("succeeded", 1.0, None) and out["c"]["status"] == "queued"
    assert [r["progress"] for r in jobs.progress_by_event(spark.createDataFrame(events, EVENTS)).filter("job = 'a'").orderBy("event_id").collect()] == [0.35, 0.35, 0.35, 0.35, 0.9]


# --- reconciliation


def test_index_drift(spark):
    canon = [("k1", "c1", "s", "t", "b", 1, 1), ("k2", "c1", "s", "t", "b", 1, 1), ("k3", "c1", "s", "t", "b", 1, 1), ("k4", "c1", "s", None, "b", 1, 1), ("k5", "c1", "s", "t", "b", 1, 1)]
    schema = "document_key string, chunk_id string, source string, title string, body string, page_start int, page_end int"
    index = [("k2", "c1", "x", "t", "B", 1, 1, 10), ("k3", "c1", "s", "t", "b", 1, 1, 11), ("k3", "c1", "s", "t", "b", 1, 1, 12), ("k4", "c1", "s", None, "b", 1, 1, 13), ("k5", "c1", "s", "t", "b", 1, 2, 15), ("k5", "c1", "s", "t", "b", 2, 1, 14), ("k9", "c1", "s", "t", "b", 1, 1, 16), ("k9", "c1", "s", "t", "b", 1, 1, 17)]
    c, i = spark.createDataFrame(canon, schema), spark.createDataFrame(index, schema + ", row_id long")
    got = [tuple(r) for r in reconcile.in_report_order(reconcile.index_drift(c, i)).collect()]
    assert got == [("missing", "k1", "c1", "no index row"), ("stale", "k2", "c1", "differs in source, body"), ("stale", "k3", "c1", "2 matching rows"), ("stale", "k5", "c1", "2 rows, the first divergent differs in page_start"),
                   ("orphaned", "k9", "c1", "index row 16 has no canonical chunk"), ("orphaned", "k9", "c1", "index row 17 has no canonical chunk")]
    assert {(r["document_key"], r["action"], r["n_issues"]) for r in reconcile.index_repair_plan(reconcile.index_drift(c, i)).collect()} == {("k1", "rewrite_from_canonical", 1), ("k2", "rewrite_from_canonical", 1), ("k3", "rewrite_from_canonical", 1), ("k5", "rewrite_from_canonical", 1), ("k9", "manual_review", 2)}
    with pytest.raises(InvalidRequest):
        reconcile.repaired_index(c, i, "yes")
    fixed = reconcile.repaired_index(c, i, reconcile.INDEX_CONFIRMATION).withColumn("row_id", F.coalesce("row_id", F.monotonically_increasing_id()))
    assert {r["kind"] for r in reconcile.index_drift(c, fixed).collect()} == {"orphaned"}
    assert reconcile.index_drift(c.limit(0), i.limit(0)).isEmpty()


def test_artifact_drift(spark):
    p = spark.createDataFrame([("k", 1, "a", "local_ocr"), ("k", 2, None, "html")], "document_key string, page_number int, text string, text_source string")
    expected = reconcile.expected_artifacts(p)
    assert {(r["kind"], r["page"]) for r in expected.collect()} == {("document_text", None), ("page_text", 1), ("page_text", 2), ("ocr_page_text", 1)}
    import hashlib

    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    files = [("k", "document_text", "document.txt", True, h("[page 1]\na\n\n[page 2]\n")), ("k", "page_text", "1.txt", True, h("b")), ("k", "page_text", "3.txt", True, h("")), ("k", "page_text", "01.txt", True, h("")), ("k", "ocr_page_text", "1.txt", False, None), ("k", "page_text", "x.tmp", True, h(""))]
    got = {(r["kind"], r["page"], r["issue"]) for r in reconcile.artifact_drift(expected, spark.createDataFrame(files, "document_key string, kind string, name string, is_file boolean, sha256 string")).collect()}
    assert got == {("page_text", 1, "stale"), ("page_text", 2, "missing"), ("page_text", 3, "orphaned"), ("page_text", None, "orphaned"), ("ocr_page_text", 1, "stale")}


def test_artifact_queries_against_brute_force(spark, tmp_path):
    import datetime
    import hashlib
    from collections import Counter

    from paperloom.plans import collection

    day = datetime.datetime(2024, 1, 1)
    late = day + datetime.timedelta(days=3)
    rows = [  # document, page, text, text_source, loaded_at; by row
        ("same", 1, "a", "local_ocr", day), ("same", 2, None, "html", day), ("same", 1, "a", "local_ocr", day),
        ("other", 1, "b", "local_ocr", day), ("other", 1, "c", "local_ocr", day), ("other", 10, "ten", "html", day), ("other", 2, "two", "html", day),
        ("gone", 1, "d", "local_ocr", late), ("gone", 2, "e", "html", late),
        ("part", 1, "f", "html", day), ("part", 2, "g", "local_ocr", late),
        ("kind", 1, "h", "html", day), ("kind", 1, "h", "local_ocr", day), (None, 1, "x", "html", day), ("same", 0, "x", "html", day),
    ]
    schema = "page_row_id long, document_key string, page_number int, text string, text_source string, created_at timestamp, loaded_at timestamp"
    spark.createDataFrame([(i, *r[:4], day, r[4]) for i, r in enumerate(rows)], schema).write.parquet(str(tmp_path / "document_pages.parquet"))

    def digests(delivered):
        pages = {}
        for d, n, t, source, _ in delivered:
            if d and n > 0:
                pages.setdefault(d, {})[n] = (t or "", source)
        h = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out = {(d, "document_text", None): h("\n\n".join(f"[page {n}]\n{t}" for n, (t, _) in sorted(p.items()))) for d, p in pages.items()}
        for d, p in pages.items():
            for n, (t, source) in p.items():
                out[d, "page_text", n] = h(t)
                if source == "local_ocr":
                    out[d, "ocr_page_text", n] = h(t)
        return out

    expected, files = digests(rows[::-1]), digests([r for r in rows if r[4] == day])
    want = {(*k, "missing" if k not in files else "orphaned" if k not in expected else "stale") for k in expected.keys() | files.keys() if expected.get(k) != files.get(k)}
    key = lambda r: (r["document_key"], r["kind"], r["page"])
    got = [(*key(r), r["issue"]) for r in collection.QUERIES["artifact_drift_report"](spark, str(tmp_path)).collect()]
    assert Counter(got) == Counter(want) and {(k, i) for _, k, _, i in want} >= {("document_text", "missing"), ("document_text", "stale"), ("ocr_page_text", "missing"), ("ocr_page_text", "stale"), ("ocr_page_text", "orphaned")}
    plan = {(*key(r), r["action"]) for r in collection.artifact_repair_plan(spark, str(tmp_path)).collect()}
    assert plan == {(*w[:3], "manual_review" if w[3] == "orphaned" else "write_from_canonical") for w in want}


# --- ingestion, client, streams


def test_asset_selection(spark):
    schema = "record_seq int, pdf_url string, attachments array<struct<asset_url:string,label:string,mime_type:string,role:string>>"
    a = lambda u, role="other", mime=None: (u, "l", mime, role)
    rows = [(1, "p", [a("x.html", "html"), a("y.PDF?z=1"), a("z.pdf")]), (2, "p", [a("x.txt")]), (3, None, [a("x.txt"), a("t", "transcript"), a("o", "ocr_text")]), (4, " ", [a("i.png", "image")]), (5, None, None), (6, None, [a("h", "html"), a("q", mime="text/plain")])]
    got = {r["record_seq"]: (r["kind"], r["asset_url"], r["text_source"]) for r in ingest.select_asset(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: ("pdf", "y.PDF?z=1", "embedded_pdf_text"), 2: ("record_pdf", "p", "embedded_pdf_text"), 3: ("ocr_text", "o", "source_ocr"), 4: (None, None, None), 5: (None, None, None), 6: ("plain_text", "q", "api_text")}


@pytest.fixture()
def library(spark, tmp_path):
    s = store.SnapshotStore(spark, str(tmp_path / "store"))
    docs = spark.createDataFrame([("cia-1", "cia:1", "cia", "1", "Red title", '{"source_warning":"careful"}'), ("nsa-2", "nsa:2", "nsa", "2", "Blue", None)], "document_key string, public_id string, source string, source_id string, title string, metadata_json string")
    texts = spark.createDataFrame([("cia-1", "stone river\f\fred stone"), ("nsa-2", "river")], "document_key string, text string")
    ingest.ingest_texts(s, docs, texts)
    ingest.ingest_texts(s, docs, texts)  # once more changes nothing
    html = "<a href='/readingroom/document/a1'>Red&nbsp;file</a><a href='/about'>About</a><a href='/readingroom/document/a1'>again</a><a href='/readingroom/document/b2'>Blue</a>"
    return Library(spark, s, {"cia": spark.createDataFrame([(0, "https://www.cia.gov/readingroom/x", html)], "ord int, page_url string, html string")})


def test_client(spark, library):
    hits, advice = library.search_local_documents("stone")
    assert [r["document_key"] for r in hits.collect()] == ["cia-1"] and hits.first()["source_warning"] == "careful" and "[stone]" in hits.first()["snippet"] and advice == []
    assert library.search_local_documents("nosuch", "cia")[1]
    assert library.get_document("cia:1").first()["n_pages"] == 3 and library.get_document("nsa-2").first()["n_pages"] == 1
    assert library.get_document_text("cia:1", 1, 3).first()["text"].count("[page ") == 3
    for bad in (lambda: library.get_document("x"), lambda: library.get_document_text("cia:1", 0, 3), lambda: library.get_document_text("cia:1", 3, 1), lambda: library.get_document_text("cia:1", 1, 51), lambda: library.search_local_documents("a", "zzz"), lambda: library.ingest_document("https://x"), lambda: library.search_source("zzz", ""), lambda: library.search_source("cia", "", 0)):
        with pytest.raises(InvalidRequest):
            bad()
    page = library.search_source("cia", "red FILE")
    assert [r["title"] for r in page.records.collect()] == ["Red file", "Blue"] and page.warnings == []  # this source filters itself
    assert library.get_source_record("cia", "readingroom/document/b2").first()["title"] == "Blue"
    assert library.list_sources().filter("status = 'enabled'").count() == 1 and library.list_sources().count() == 18
    job = library.ingest_document("cia:b2").first()
    assert job["status"] == "queued" and library.ingest_document("cia:b2").first()["job_id"] == job["job_id"] and library.get_ingestion_job("ingest:cia:b2").count() == 1
    assert library.store.read("outbox").count() == 1 and library.refresh_document("cia-1").first()["job_key"] == "refresh:cia:1"


def test_client_repairs(spark, library):
    assert library.report_index_drift().isEmpty()
    broken = library.store.read("index").filter("source = 'cia'").withColumn("body", F.lit("other"))
    library.store.commit({"index": broken})
    assert {r["kind"] for r in library.report_index_drift().collect()} == {"stale", "missing"}
    with pytest.raises(InvalidRequest):
        library.apply_index_repairs("please")
    assert library.apply_index_repairs(reconcile.INDEX_CONFIRMATION) == {"rewritten": 2, "for_review": 0} and library.report_index_drift().isEmpty()
    assert library.plan_artifact_repairs("cia:1").count() == 4
    with pytest.raises(InvalidRequest):
        library.apply_artifact_repairs("cia:1", "please")
    assert library.apply_artifact_repairs("cia:1", "apply derived artifact repairs for cia:1")["written"] == 4 and library.report_artifact_drift("cia:1").isEmpty()


def test_streams(spark, tmp_path):
    s = store.SnapshotStore(spark, str(tmp_path / "s"))
    put = lambda rows, schema, to: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / to))
    put([("a", "x:a", "x", "a", "t", "one\ftwo", T), ("b", "x:b", "x", "b", "t", "three", T)], TEXTS, "texts")
    run = lambda: stream_texts(spark, str(tmp_path / "texts"), s, str(tmp_path / "c1")).awaitTermination()
    run()
    put([("a", "x:a", "x", "a", "t", "new", T)], TEXTS, "texts")
    run()
    run()
    assert sorted((r["document_key"], r["text"]) for r in s.read("pages").collect()) == [("a", "new"), ("b", "three")] and s.read("index").count() == 2 and s.read("documents").count() == 2
    put([("j", T, 1, "running", 0.1, None, None), ("j", T, 1, "running", 0.1, None, None)], EVENTS, "events")
    stream_jobs(spark, str(tmp_path / "events"), s, str(tmp_path / "c2")).awaitTermination()
    put([("j", T, 2, "succeeded", None, None, None), ("j", T, 1, "running", 0.1, None, None)], EVENTS, "events")
    stream_jobs(spark, str(tmp_path / "events"), s, str(tmp_path / "c2")).awaitTermination()
    assert s.read("job_events").count() == 2 and s.read("jobs").first()["status"] == "succeeded"
    e = spark.createDataFrame([(T, "a"), (T + timedelta(hours=1), "a"), (T + timedelta(days=2), "b")], "at timestamp, kind string")
    assert sorted(r["n"] for r in arrivals(e).collect()) == [1, 2]
