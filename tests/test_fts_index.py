"""The stored index against the scan, with replaced documents, merging and two writers."""

import random

import pytest

from paperloom.operators import search as scan
from paperloom.operators.fts_index import StoredIndex
from paperloom.operators.search import InvalidRequest

SCHEMA = "document_key string, chunk_id string, source string, title string, body string, page_start long"
WORDS = ["alpha", "beta", "gamma", "delta", "Épsilon", "hydro", "hydrogen", "hydrate", "the", "of"]
QUERIES = [
    ("alpha", None), ("alpha beta", None), ("alpha OR gamma", "s1"), ('"alpha beta"', None), ('"the hydro*', None), ("hydr*", None), ("beta NOT gamma", None), ("title : alpha", None),
    ("NEAR(alpha delta, 2)", None), ('NEAR("alpha beta" delta, 3)', None), ("épsilon", None), ("nosuchword", None), ("beta beta", None), ("alpha AND delta", None), ('"alpha alpha alpha"', None), ('alpha OR "of the"', "s2"),
]


def rows_of(seed, keys):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    return [(k, f"chunk-{c}", f"s{rng.randint(1, 2)}", text(3) if c else None, text(rng.randint(0, 30)) if rng.random() > 0.05 else None, c) for k in keys for c in range(3)]


def same(index, spark, rows, queries=QUERIES):
    plain = scan.build_index(spark.createDataFrame(rows, SCHEMA))
    for query, source in queries:
        if query.count('"') % 2:
            with pytest.raises(InvalidRequest):
                index.search(query, source)
            continue
        key = lambda df: [(r["document_key"], r["chunk_id"], r["body"], round(r["score"], 9)) for r in df.collect()]
        assert key(index.search(query, source, 20)) == key(scan.search(plain, query, source, 20)), query


def test_stored_index_is_the_scan(spark, tmp_path):
    first, second = rows_of(1, [f"d{i}" for i in range(40)]), rows_of(2, [f"d{i}" for i in range(30, 45)])
    index = StoredIndex(spark, str(tmp_path))
    with pytest.raises(InvalidRequest):
        index.search("alpha")
    index.build(spark.createDataFrame(first, SCHEMA).repartition(3))
    same(index, spark, first)
    owners = [(f"d{i}",) for i in [*range(30, 45), 7]]  # 7 is only deleted
    index.replace(spark.createDataFrame(second, SCHEMA), spark.createDataFrame(owners, "document_key string"))
    kept = [r for r in first if (r[0],) not in owners] + second
    same(index, spark, kept)
    third = rows_of(3, ["d31"])
    index.replace(spark.createDataFrame(third, SCHEMA), spark.createDataFrame([("d31",)], "document_key string"))
    kept = [r for r in kept if r[0] != "d31"] + third
    same(index, spark, kept, QUERIES[:4])
    assert index.manifest()["n_rows"] == len(kept) and len(index.manifest()["segments"]) == 3
    index.merge()
    assert index.sweep() == 3 and len(index.manifest()["segments"]) == 1
    same(index, spark, kept, QUERIES[:4])


def test_term_is_pushed_down_and_empty(spark, tmp_path):
    index = StoredIndex(spark, str(tmp_path))
    index.build(spark.createDataFrame(rows_of(4, ["a", "b"]), SCHEMA))
    plan = index.postings({"alpha"}, set())._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [alpha])]" in plan or "EqualTo(term,alpha)" in plan
    assert index.postings({"zzz"}, set()) is None
    index.build(spark.createDataFrame([], SCHEMA))
    assert index.search("alpha").count() == 0


def test_second_writer_is_refused(spark, tmp_path, monkeypatch):
    one, two = (StoredIndex(spark, str(tmp_path)) for _ in range(2))
    one.build(spark.createDataFrame(rows_of(5, ["a"]), SCHEMA))
    old = two.manifest()
    one.build(spark.createDataFrame(rows_of(6, ["b"]), SCHEMA))
    monkeypatch.setattr(two, "manifest", lambda: old)
    with pytest.raises(OSError):
        two.build(spark.createDataFrame(rows_of(7, ["c"]), SCHEMA))
