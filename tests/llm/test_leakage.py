import numpy as np
import pytest
import xxhash

from paperloom.llm.leakage import BlockIndex, Vocabulary, leaked_items, shingle_similarity, simhashes


def plain_simhash(words):
    hashes = [xxhash.xxh64_intdigest(w) for w in words]
    return sum((2 * sum((h >> j) & 1 for h in hashes) >= len(words)) << j for j in range(64))


@pytest.mark.parametrize("width", [1, 2, 13, 60, 127])
def test_simhash(width):
    words = [f"w{i * i % 37}" for i in range(200)]
    v = Vocabulary()
    got = simhashes(v.lanes[v.number(words)], width)
    assert got.tolist() == [plain_simhash(words[i:i + width]) for i in range(len(words) - width + 1)]


@pytest.mark.parametrize("radius", [0, 1, 2, 5])
def test_blocks_find_all_within_the_radius(radius):
    rng = np.random.default_rng(3)
    stored = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    queries = np.concatenate([stored[:100] ^ np.uint64(1 << 5), stored[100:150] ^ np.uint64((1 << 63) | 3), stored[150:160], rng.integers(0, 1 << 63, 300, dtype=np.uint64)])
    q, s = BlockIndex(stored, radius).search(queries)
    want = {(i, j) for i in range(len(queries)) for j in range(len(stored)) if (int(queries[i]) ^ int(stored[j])).bit_count() <= radius}
    assert set(zip(q.tolist(), s.tolist())) == want


def test_similarity():
    a = tuple("abcdefghijklm")
    assert shingle_similarity(a, a) == 1 and shingle_similarity(a, a[::-1]) == 0 and 0 < shingle_similarity(a, ("z", *a[1:])) < 1


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(30)]
    text = lambda n: [words[i] for i in rng.integers(0, 30, n)]
    items = [(i, text(40)) for i in range(30)] + [(90, text(5)), (91, text(13))]
    docs = []
    for d in range(200):
        own = text(int(rng.integers(0, 120)))
        if d % 4 == 0:
            item, n = items[d % 30][1], 10 + d % 8
            own[5:5] = [w.upper() for w in item[3:3 + n]]
        docs.append((d, " ,\n".join(own)))
    docs += [(500, None), (501, ""), (502, " ".join(items[0][1]) * 1), (502, " ".join(items[1][1])), (503, "x " * 300_000 + " ".join(items[2][1]))]
    grams = lambda w: {tuple(w[i:i + 13]) for i in range(len(w) - 12)}
    want = {(d, i) for d, t in docs if t for i, w in items if grams(t.lower().replace(",", " ").split()) & grams(w)}
    df = spark.createDataFrame([(d, t, 0, "c") for d, t in docs], "doc_id long, text string, item_id long, similarity string").repartition(3)
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(95, None)], "item_id long, text string")
    found = leaked_items(df, it)
    assert {(r["doc_id"], r["item_id"]) for r in found.filter("n_exact > 0").collect()} == want
    assert leaked_items(df.limit(0), it).count() == 0 and leaked_items(df, it.limit(0)).count() == 0


@pytest.mark.parametrize("width,least", [(13, 0.8), (13, 0.3), (13, 1.0), (3, 0.8), (30, 0.6)])
def test_similar_windows_against_brute_force(spark, width, least):
    rng = np.random.default_rng(11)
    words = [f"word{i}"[: 2 + i % 6] + "x" * (i % 9) for i in range(400)]
    text = lambda n: [words[i] for i in rng.integers(0, 400, n)]
    items = [(i, text(int(rng.integers(10, 40)))) for i in range(12)] + [(50, ["a", "b", "c"] * 12)]
    docs = [(700, ["a", "b", "c"] * 15)]
    for d in range(60):
        own, leak = text(int(rng.integers(0, 40))), list(items[d % 12][1])
        edit, at = d % 4, int(rng.integers(0, len(leak)))  # as it is, one word replaced, left out or added
        leak[at:at + (edit in (1, 2))] = text(edit % 2)
        own[3:3] = leak
        docs.append((d, own))
    windows = lambda w: [tuple(w[i:i + width]) for i in range(len(w) - width + 1)]
    want = {}
    for d, w in docs:
        for i, v in items:
            near = [(shingle_similarity(a, b), a == b) for a in windows(w) for b in windows(v)]
            near = [x for x in near if x[0] >= least]
            if near:
                want[d, i] = (len(near), max(x for x, _ in near), sum(e for _, e in near))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string").repartition(3)
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["similarity"], r["n_exact"]) for r in leaked_items(df, it, width, least=least).filter("n_windows > 0").collect()}
    assert got == want and (least == 1 or width == 3 or any(n > 0 == e for n, _, e in want.values()))


@pytest.mark.parametrize("radius", [None, 2])
def test_repeated_item_id(spark, radius):
    texts = [" ".join(f"{a}{i}" for i in range(20)) for a in "xyz"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    it = spark.createDataFrame([(5, texts[0]), (5, texts[1]), (5, "short"), (6, texts[2])], "item_id long, text string")
    found = leaked_items(df, it, radius=radius).filter("n_exact > 0").distinct().collect()
    assert {(r["doc_id"], r["item_id"], r["n_exact"]) for r in found} == {(0, 5, 8), (1, 5, 8), (2, 6, 8)}


def test_near_copies_of_items(spark):
    """Of planted copies with a few words changed, inserted or left out, at least 0.9 of those that are similar enough."""
    rng = np.random.default_rng(21)
    words = [f"word{i}" for i in range(400)]
    text = lambda n: [words[i] for i in rng.integers(0, 400, n)]
    items = [(i, text(int(rng.integers(30, 300)))) for i in range(60)]
    docs, want = [], set()
    for d in range(400):
        own, (i, w) = text(200), items[d % 60]
        copy = list(w)
        for _ in range(d % 4):
            k = int(rng.integers(0, len(copy)))
            copy[k:k + 1] = [[], text(1), [copy[k], *text(1)]][int(rng.integers(0, 3))]
        own[50:50] = copy
        docs.append((d, " ".join(own)))
        windows = [shingle_similarity(tuple(own[p:p + len(w)]), tuple(w)) for p in range(45, 56)]
        if max(windows) >= 0.8:
            want.add((d, i))
    found = leaked_items(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r["item_similarity"] for r in found.filter("item_similarity > 0").collect()}
    assert all(v >= 0.8 for v in got.values()) and set(got) - want <= set() and len(set(got) & want) >= 0.9 * len(want) and len(want) > 200


def test_blocks_of_items(spark, monkeypatch):
    from paperloom.llm import leakage

    words = [f"w{i}" for i in range(50)]
    items = spark.createDataFrame([(i, " ".join(words[i:i + 20])) for i in range(30)], "item_id long, text string")
    docs = spark.createDataFrame([(d, " ".join(words[d:d + 25])) for d in range(25)], "doc_id long, text string")
    want = sorted(map(tuple, leaked_items(docs, items).collect()))
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 100)
    assert sorted(map(tuple, leaked_items(docs, items).collect())) == want and len(want) > 100
