from collections import Counter, defaultdict

import numpy as np

from paperloom.llm import repeated_lines as rl
from paperloom.llm.repeated_lines import eligible_lines, line_form, reduce_counters, repeated_lines, without_repeated_lines

SCHEMA = "page_row_id long, document_key string, source string, text string, form string, n_docs int"


def brute(rows):
    docs, seen, places = defaultdict(set), defaultdict(set), []
    for i, k, s, text, *_ in rows:
        if k is None or s is None:
            continue
        docs[s].add(k)
        for n, f in eligible_lines(text or ""):
            seen[s, f].add(k)
            places.append((s, f, i, n))
    good = {sf for sf, d in seen.items() if len(d) >= 3 and len(d) >= 0.08 * len(docs[sf[0]])}
    return Counter((i, n) for s, f, i, n in places if (s, f) in good)


def test_line_form():
    assert line_form("  Copy 12  of\xa0 3 — See\tNote ") == "copy # of # — see note"
    assert line_form("a\x1cb") == "a\x1cb"
    assert eligible_lines("one two three\none two three 4 four\n\nu1v2w3x") == [(2, "one two three # four"), (4, "u#v#w#x")]


def test_summary_keeps_what_is_frequent():
    rng = np.random.default_rng(1)
    keys = np.concatenate([rng.integers(0, 10_000, 5_000), np.repeat([1, 2, 3], 400)])
    u, n = np.unique(keys, return_counts=True)
    cut = 20
    kept, counts = reduce_counters(u, n, cut)
    assert {1, 2, 3} <= set(kept.tolist()) and len(kept) <= 10
    true = dict(zip(u.tolist(), n.tolist()))
    assert all(c <= true[k] <= c + cut for k, c in zip(kept.tolist(), counts.tolist()))


def test_against_brute_force(spark):
    rng = np.random.default_rng(7)
    lines = [f"Repeated notice number {i} of the reading room" for i in range(60)]
    rows = []
    for i in range(900):
        s = None if i % 97 == 0 else f"s{min(int(rng.integers(0, 6)), 3)}"
        k = "hot" if i % 3 == 0 and s == "s3" else f"{s}-{int(rng.integers(0, 40))}"
        text = None if i % 50 == 0 else "\n".join([lines[int(rng.zipf(1.3)) % 60].replace("number", "NUMBER" if i % 2 else "number ") for _ in range(6)] + [f"body line of page {'x' * (i % 300)} only here"])
        rows.append((i, k, s, text, "clash", 0))
    rows += rows[:20]
    confirmed, places = repeated_lines(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert Counter((r[0], r[1]) for r in places.collect()) == brute(rows)
    cleaned = without_repeated_lines(spark.createDataFrame(rows, SCHEMA), confirmed).collect()
    assert len(cleaned) == len(rows) and sum(r["n_removed"] for r in cleaned) == sum(brute(rows).values())
    assert all((r["text"] is None) == (rows[r["page_id"]][3] is None) for r in cleaned)


def test_empty(spark):
    confirmed, places = repeated_lines(spark.createDataFrame([], SCHEMA))
    assert confirmed.count() == 0 and places.count() == 0


def test_many_lines_are_joined(spark, monkeypatch):
    """More lines than are broadcast give the same candidates, places and pages by joins."""
    rows = [(i, f"k{i % 30}", f"s{i % 2}", "\n".join([f"Shared line {'abcdefg'[i % 7]} of this site", f"own line number {'x' * i} of page"]), "c", 0) for i in range(120)] + [(500, "k", None, "x", "c", 0), (501, None, "s1", None, "c", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    key = lambda found: sorted(map(str, found.collect()))
    confirmed, places = repeated_lines(df)
    want = key(confirmed), key(places), key(without_repeated_lines(df, confirmed))
    monkeypatch.setattr(rl, "MAX_BROADCAST_LINES", 1)
    confirmed, places = repeated_lines(df)
    assert (key(confirmed), key(places), key(without_repeated_lines(df, confirmed))) == want and len(want[0]) == 14


def test_summaries_are_sent_in_parts():
    """A task that counts too many lines sends its summaries and begins new ones; sums and errors still bound the truth."""
    rl_rows = [("s", f"d{i % 90}", "\n".join(f"Line {'abcdefghij'[k % (i % 9 + 1)]} of the whole site" for k in range(10))) for i in range(900)]
    batch = rl.pa.RecordBatch.from_pydict({"src": [r[0] for r in rl_rows], "doc": [r[1] for r in rl_rows], "text": [r[2] for r in rl_rows]})
    true = Counter(rl.line_hash(f) for _, _, t in rl_rows for _, f in eligible_lines(t))
    old, rl.TASK_LINES = rl.TASK_LINES, 1500
    try:
        out = [r for b in rl._summaries(0.08)(iter([batch])) for r in b.to_pylist()]
    finally:
        rl.TASK_LINES = old
    summed, err = Counter(), sum(r["cut"] for r in out)
    for r in out:
        if r["h"] is not None:
            summed[r["h"]] += r["n"]
    assert sum(r["doc"] is None and r["h"] is None for r in out) > 5 and err > 0
    assert {r["doc"] for r in out if r["doc"]} == {f"d{i}" for i in range(90)}
    assert all(summed[h] <= n <= summed[h] + err for h, n in true.items())
