import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from paperloom.operators import search
from paperloom.operators.evals import EvalQuery, evaluate, report
from paperloom.operators.search import InvalidRequest, parse_match

WORDS = "red green blue café alpha beta gamma delta it-is north42 éclair stone river old new".split()


def corpus(n=120, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        body = []
        for _ in range(rng.randint(0, 90)):
            body.append(rng.choice(WORDS) + rng.choice(["", "", "", ".", ",", ":"]))
        rows.append((f"k{i % 40:03d}", f"chunk-{i:04d}", rng.choice(["cia", "nsa"]), " ".join(rng.choices(WORDS, k=rng.randint(0, 5))), " ".join(body), 1, 2))
    return rows


@pytest.fixture(scope="module")
def both(spark):
    rows = corpus()
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(document_key UNINDEXED, chunk_id UNINDEXED, source UNINDEXED, title, body, tokenize='unicode61')")
    db.executemany("INSERT INTO f VALUES (?, ?, ?, ?, ?)", [r[:5] for r in rows])
    index = search.build_index(spark.createDataFrame(rows, "document_key string, chunk_id string, source string, title string, body string, page_start int, page_end int")).cache()
    return db, index


@pytest.mark.parametrize("query", ["red", "red green", "cafe", "Éclair", '"red green"', "red OR stone", "red NOT green", "red NOT (green OR blue)", "gre*", '"red gre" *', "title : old", "body : old", "{title body} : old new",
                                   "red red", "NEAR(red stone, 3)", "NEAR(red stone)", '"it is"', "nosuch", "red + green", "alpha AND beta AND gamma", "alpha beta OR gamma delta", "north42", "- title : red"])
def test_as_the_full_text_module_of_sqlite(both, query):
    db, index = both
    want = db.execute("SELECT document_key, chunk_id, bm25(f) AS s FROM f WHERE f MATCH ? ORDER BY s, document_key, chunk_id LIMIT 100", (query,)).fetchall()
    got = search.search(index, query, None, 100).select("document_key", "chunk_id", "score").collect()
    assert {(r[0], r[1]) for r in got} == {(r[0], r[1]) for r in want}
    if "NEAR" not in query:
        assert [(r[0], r[1]) for r in got] == [(r[0], r[1]) for r in want]
        assert all(abs(a[2] - b[2]) < 1e-12 for a, b in zip(got, want))


@pytest.mark.parametrize("query", ["red", "red stone", "cafe old new"])
def test_snippets(both, query):
    db, index = both
    want = dict(db.execute("SELECT chunk_id, snippet(f, 4, '[', ']', '...', 32) FROM f WHERE f MATCH ?", (query,)).fetchall())
    got = {r["chunk_id"]: r["snippet"] for r in search.with_snippets(search.search(index, query, None, 100), query).collect()}
    same = sum(want[k].replace("] [", " ") == got[k].replace("] [", " ") for k in got)
    assert len(got) == min(100, len(want)) and same == len(got)


def test_filter_keeps_the_statistics(both):
    _, index = both
    everything = {r["chunk_id"]: r["score"] for r in search.search(index, "red", None, 100).collect()}
    own = search.search(index, "red", "nsa", 100).collect()
    assert own and all(r["source"] == "nsa" and r["score"] == everything[r["chunk_id"]] for r in own)
    assert search.search(index, "red", None, 0).count() == 1 and search.search(index, "red", None, 1000).count() <= 100


@pytest.mark.parametrize("query", ["", "  ", '"open', "it's", "it-is", "author : x", "red AND", "OR red", "(red", "NEAR(red, x)", "red)", "{title : x", "red +"])
def test_bad_queries(query):
    with pytest.raises(InvalidRequest):
        parse_match(query)


def test_warnings(spark):
    cases = ['{"source_metadata":{"source_warning":" a "},"source_warning":"b"}', '{"source_warning":"b"}', '{"source_metadata":{"source_warning":5},"source_warning":"b"}', '{"source_metadata":{"source_warning":" "},"source_warning":"b"}', "{}", "nonsense", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, j string")
    got = {r["i"]: r["w"] for r in df.select("i", search.source_warning(F.col("j")).alias("w")).collect()}
    assert [got[i] for i in range(len(cases))] == ["a", "b", None, None, None, None, None]


def test_evaluation(spark, both):
    _, index = both

    class Backend:
        def search(self, query, source, limit):
            return search.with_snippets(search.search(index, query, source, limit), query)

    out = report(evaluate(spark, Backend(), [EvalQuery("a", "red", "cia", 5), EvalQuery("none", "nosuch")]))
    rows = {r["name"]: r for r in out.collect()}
    assert rows["a"]["n_hits"] == 5 and rows["a"]["keeps_filter"] and rows["none"]["is_empty"]


def test_postings_and_statistics(both):
    _, index = both
    p = search.postings(index, ["document_key", "chunk_id"])
    stats = {r["term"]: (r["n_rows"], r["n_occurrences"]) for r in search.term_stats(index).collect()}
    again = {r["term"]: (r["a"], r["b"]) for r in p.groupBy("term").agg(F.countDistinct("document_key", "chunk_id").alias("a"), F.count("*").alias("b")).collect()}
    assert stats == again
