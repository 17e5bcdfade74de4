from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import near_duplicates as nd

SCHEMA = "row_id long, own string, text string, h long, similarity double"


def corpus(seed, n=260):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)] + [f"rare{i}" for i in range(2000)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            base = (rows[int(rng.integers(0, len(rows)))][2] or "a b").split()
            for _ in range(int(rng.integers(0, 12))):
                k = int(rng.integers(0, max(1, len(base))))
                edit = rng.random()
                base[k:k + 1] = [] if edit < 0.3 else [words[int(rng.integers(0, len(words)))]] if edit < 0.7 else [words[3], *base[k:k + 1]]
            text = " ".join(base)
        else:
            text = " ".join(words[min(int(rng.zipf(1.2)), len(words) - 1)] for _ in range(int(rng.integers(0, 90))))
        rows.append((i, f"o{int(rng.integers(0, 100))}", text, 0, 0.0))
    return rows + [(n, None, rows[3][2], 0, 0.0), (n + 1, "x", None, 0, 0.0), (n + 2, "x", "", 0, 0.0), (n + 3, "y", "", 0, 0.0), (n + 4, "x", "Two words", 0, 0.0), (n + 5, "y", "two WORDS", 0, 0.0)]


def brute(rows, width, t):
    sets = {i: {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} for i, _, x, *_ in rows if x is not None for w in [x.lower().split()]}
    owner = {i: o for i, o, *_ in rows}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if owner[a] and owner[b] and owner[a] != owner[b] and sets[a] & sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def rows_of(spark, rows):
    return nd.text_rows(spark.createDataFrame(rows, SCHEMA).repartition(3), "row_id", "own", F.col("text"))


@pytest.mark.parametrize("seed,width,t,entries", [(1, 3, Fraction(1, 2), 10**9), (2, 3, Fraction(1, 2), 150), (3, 5, Fraction(4, 5), 90), (4, 2, Fraction(1, 3), 300)])
def test_against_brute_force(spark, monkeypatch, seed, width, t, entries):
    monkeypatch.setattr(nd, "PART_ENTRIES", entries)
    monkeypatch.setattr(nd, "BLOCK_EVENTS", 500)
    rows = corpus(seed)
    got = nd.similar_rows(rows_of(spark, rows), width, t, cells=1 << 16).collect()
    pairs = [(r["id_a"], r["id_b"]) for r in got]
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute(rows, width, t) and len(pairs) > 30


def test_groups(spark):
    rows = corpus(6, 120)
    groups = {r["row_id"]: r for r in nd.duplicate_groups(rows_of(spark, rows), cells=1 << 16).collect()}
    assert set(groups) == {i for i, _, x, *_ in rows if x is not None}
    text = {i: x for i, _, x, *_ in rows}
    first = {x: min(i for i in groups if text[i] == x) for x in {text[i] for i in groups}}
    near = {i: i for i in first.values()}
    links = brute([(i, str(i), text[i]) for i in first.values()], 3, Fraction(1, 2))
    for _ in near:
        for a, b in links:
            near[a] = near[b] = min(near[a], near[b])
    assert all(g["class_id"] == first[text[i]] and g["group_id"] == near[first[text[i]]] for i, g in groups.items())
    assert all(g["n_links"] == sum(first[text[i]] in p for p in links) for i, g in groups.items())


def test_empty(spark):
    none = rows_of(spark, corpus(1, 5)).limit(0)
    assert nd.similar_rows(none, cells=1 << 16).count() == 0 and nd.duplicate_groups(none, cells=1 << 16).count() == 0


def test_lists_in_cells(spark, monkeypatch):
    """Lists of more texts than a cell may hold are cut into cells of pairs, with the same result."""
    monkeypatch.setattr(nd, "CELL_TEXTS", 12)
    classes = np.round(np.log2(np.full(256, 60) + 1.0) * nd.STEPS).astype(np.uint8)
    assert nd.cells_by_class(np.append(classes[:1], np.zeros(1000, np.uint8)))[classes[0]] > 3
    rows = [(i, f"o{i}", f"a b c d e f g{i % 40} h{i}" if i % 2 else f"a b c d e x{i % 7} y{i}", 0, 0.0) for i in range(150)] + corpus(9, 40)[:40]
    rows = [(n, *r[1:]) for n, r in enumerate(rows)]
    got = [(r["id_a"], r["id_b"]) for r in nd.similar_rows(rows_of(spark, rows), cells=1 << 16).select("id_a", "id_b").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 3, Fraction(1, 2)) and len(got) > 3000


class Classes:
    """Frequency classes of the texts' shingles, as a broadcast."""

    def __init__(self, texts, cells=1 << 16):
        shingles = nd.Shingler(3)
        counts = np.bincount(np.concatenate([shingles(t) & np.uint64(cells - 1) for t in texts]).astype(np.int64), minlength=cells)
        self.value = np.round(np.log2(counts + 1.0) * nd.STEPS).astype(np.uint8).tobytes()


def sent(texts, parts, t=Fraction(1, 2)):
    batch = nd.pa.RecordBatch.from_pydict({"h": nd.pa.array(range(len(texts)), nd.pa.int64()), "text": nd.pa.array(texts)})
    return [(r["part"], r["entries"]) for b in nd._short_entries(3, t, parts, Classes(texts), np.ones(256, np.int64))(iter([batch])) for r in b.to_pylist()]


def test_entries_do_not_grow_with_parts():
    texts = [r[2] for r in corpus(5, 400) if r[2]]
    sizes = {p: sum(len(b) for _, b in sent(texts, p)) for p in (1, 6, 100, 1500)}
    assert len(set(sizes.values())) == 1
    pairs = lambda p: {x for part in {q for q, _ in sent(texts, p)} for a, b, *_ in nd.merge_lists(*nd._entries_of([b for q, b in sent(texts, p) if q == part]), Fraction(1, 2)) for x in zip(a.tolist(), b.tolist())}
    assert pairs(1) == pairs(100)


def test_list_of_many_texts():
    """20,000 texts share two runs of three words, the last in the order of nearly all: almost no events."""
    texts = [f"a b c d e{i} f{i} g{i} h{i}" for i in range(20_000)] + ["a b c", "a b c d x"]
    [(_, blob)] = sent(texts, 1)
    keys, docs, size, behind = nd._entries_of([blob])
    found = sum(len(a) for a, *_ in nd.merge_lists(keys, docs, size, behind, Fraction(1, 2)))
    assert found < 100_000


def test_long_chain(spark):
    """Components of a chain, a star and a pair."""
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(1, 300)]
    got = dict(map(tuple, nd.components(spark.createDataFrame(links, "u long, v long")).collect()))
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(200, 260)}, 7: 7, 1: 1, 300: 1}


def test_scale_of_sizes():
    n = np.array([0, 1, 4095, 4096, 5000, 123_456, 60_000_000, 1 << 33])
    code = nd.scaled(n)
    assert (nd.SCALE_LOW[code] <= n).all() and (n <= nd.SCALE_HIGH[code]).all() and (nd.SCALE_LOW[code][:3] == nd.SCALE_HIGH[code][:3]).all()
