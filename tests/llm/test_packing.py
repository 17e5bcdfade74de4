import random
from collections import Counter

import pytest

from paperloom.llm import packing
from paperloom.llm.packing import pack, pack_each, pack_tiers_of_each, packing_summary, plan_packing, token_sizes


@pytest.mark.parametrize("capacities", [[1], [7], [512], [3, 5], [64, 256, 1024]])
def test_plan(capacities):
    rng = random.Random(1)
    for _ in range(60):
        histogram = {rng.randint(1, capacities[-1]): rng.randint(1, 40) for _ in range(rng.randint(0, 50))}
        segments, opened = plan_packing(histogram, capacities)
        fill, seen = Counter(), Counter()
        for s in segments:
            for r in range(s.count):
                fill[s.tier, s.start + r // s.per] += s.size
                seen[s.size, s.first + r] += 1
        assert seen == Counter((size, r) for size, n in histogram.items() for r in range(n))
        assert all(full <= capacities[tier] for (tier, _), full in fill.items())
        assert [sum(t == i for t, _ in fill) for i in range(len(capacities))] == opened
        # Best fit leaves at most one container of the last tier half empty.
        assert sum(2 * full < capacities[-1] for (tier, _), full in fill.items() if tier == len(capacities) - 1) <= 1 or len(capacities) > 1


def test_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 50)  # one size holds a third of all rows and is ranked in parts
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 5, 5, 5, rng.randint(1, 30), rng.randint(100, 400)]), "c") for i in range(900)] + [(7, 5, "c")]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, container string").repartition(4)
    caps = {"b": 40, "a": 16, "z": 160}
    for out in (pack(df, caps), pack(df, {"b": 40})):
        got = out.collect()
        fill, total, parts = Counter(), Counter(), Counter()
        for r in got:
            fill[r["container"], r["container_no"]] += r["n_tokens"]
            total[r["doc_id"]] += r["n_tokens"]
            parts[r["doc_id"]] += 1
        largest = max(caps[c] for c, _ in fill)
        assert all(n <= caps[c] for (c, _), n in fill.items())
        assert total == Counter({i: sum(n for j, n, _ in rows if j == i) for i, _, _ in rows}) | Counter()
        assert all(parts[i] == -(-max(n, 1) // largest) for i, n, _ in rows if i != 7) and len(got) == sum(parts.values())
    both = packing_summary(pack_each(df, {"b": 40, "z": 160})).collect()
    assert {r["container"]: r["n_texts"] for r in both} == {"b": 900, "z": 900}
    tiers = pack_tiers_of_each(df, {"b": 40, "a": 16, "z": 160}).collect()
    for plan, within in (("a", {"a"}), ("b", {"a", "b"}), ("z", {"a", "b", "z"})):
        own = [r for r in tiers if r["plan"] == plan]
        assert {r["container"] for r in own} == within and len({r["doc_id"] for r in own}) == 900
        fill = Counter()
        for r in own:
            fill[r["container"], r["container_no"]] += r["n_tokens"]
        assert all(n <= caps[c] for (c, _), n in fill.items()) and sum(fill.values()) == sum(n for _, n, _ in rows)
        assert sum(fill.values()) >= 0.95 * sum(caps[c] for c, _ in fill)
    assert pack(df.limit(0), caps).count() == 0
    with pytest.raises(ValueError):
        pack(df, {"a": 0})


def test_sizes(spark):
    df = spark.createDataFrame([(1, "Hello world's", 9), (2, None, 9), (3, "", 9), (4, "é" * 20_000, 9)], "doc_id long, text string, n_tokens int")
    got = {r["doc_id"]: r["n_tokens"] for r in token_sizes(df).collect()}
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    assert got == {1: len(slow.encode("Hello world's", add_special_tokens=False).ids), 2: 0, 3: 0, 4: len(slow.encode("é" * 20_000, add_special_tokens=False).ids)}
