from datetime import datetime, timedelta

from paperloom.operators.orphans import Parent, Reference, find_orphans, orphan_report

T = datetime(2000, 1, 1)


def frames(spark, refs, parents):
    return (
        Reference(spark.createDataFrame(refs, "id long, k string, at timestamp, tbl string"), "r", "id", ("k",), "at"),
        Parent(spark.createDataFrame(parents, "k string, born timestamp, gone timestamp"), ("k",), "born", "gone"),
    )


def test_lifetimes(spark):
    refs = [(1, "a", T, "x"), (2, "a", T - timedelta(days=1), "x"), (3, "b", T, "x"), (4, "b", T + timedelta(days=2), "x"), (5, None, T, "x"), (6, "a", None, "x"), (7, "zz", T, "x"), (7, "zz", T, "x"), (8, "A", T, "x"), (9, "b", T + timedelta(days=1), "x")]
    parents = [("a", T, None), ("a", T, None), ("b", T, T + timedelta(days=1)), (None, T, None), ("c", None, None)]
    out = find_orphans(*frames(spark, refs, parents))
    assert sorted((r["row_id"], r["reason"]) for r in out.filter("row_id <> 8 AND row_id <> 7").collect()) == [(2, "not_alive"), (4, "not_alive"), (6, "not_alive"), (9, "not_alive")]
    assert sorted(r["row_id"] for r in out.collect()) == [2, 4, 6, 7, 7, 8, 9]
    report = {(r["month"], r["reason"]): r["n_orphans"] for r in orphan_report(out).collect()}
    assert report[(None, "not_alive")] == 1 and sum(report.values()) == 7


def test_no_parents_and_no_references(spark):
    ref, parent = frames(spark, [(1, "a", T, "x")], [("a", T, None)])
    assert find_orphans(ref, Parent(parent.rows.limit(0), ("k",), "born", "gone")).count() == 1
    assert find_orphans(Reference(ref.rows.limit(0), "r", "id", ("k",), "at"), parent).count() == 0


def test_a_filter_that_is_joined_changes_nothing(spark):
    """More words than are broadcast: the filter is joined by word, as large as the keys need."""
    parents = [(f"k{i}", T, None) for i in range(3000)]
    refs = [(i, f"k{i}", T, "x") for i in range(0, 6000, 2)] + [(10_000 + i, "k1", T, "x") for i in range(2000)]
    ref, parent = frames(spark, refs, parents)
    assert parent.words == 1024
    joined = find_orphans(ref, parent, max_words=64)
    small = {r["row_id"] for r in joined.collect()}
    assert small == {r["row_id"] for r in find_orphans(ref, parent).collect()} == set(range(3000, 6000, 2))
    assert joined.filter("reason = 'unknown_key'").count() > 1000  # the filter still proves most of them
