import numpy as np
import pytest

from paperloom.llm import quality
from paperloom.llm.quality import FEATURES, classify_form, fit_mixture, text_statistics


def frames(spark, docs):
    common = spark.createDataFrame([("en", w) for w in "the of and was in to".split()] + [("fr", "le"), (None, None)], "lang string, word string")
    return spark.createDataFrame(docs, "doc_id long, text string, n_words string"), common


def test_statistics(spark):
    df, common = frames(spark, [(1, "The cat, of Rome.\n\n12 abc 3d", "x"), (2, None, "x"), (3, " \n ", "x"), (4, "word " * 60_000, "x"), (1, "The cat, of Rome.\n\n12 abc 3d", "x")])
    rows = text_statistics(df, common).collect()
    assert len(rows) == 5
    r = next(r for r in rows if r["doc_id"] == 1)
    assert (r["n_words"], r["n_lines"]) == (7, 2)
    assert r["common_share"] == pytest.approx(2 / 7) and r["mean_word_length"] == pytest.approx(19 / 7) and r["punctuated_share"] == 0.5
    assert r["symbol_share"] == pytest.approx(2 / 21) and r["digit_share"] == pytest.approx(2 / 7)
    for i in (2, 3):
        assert all(next(r for r in rows if r["doc_id"] == i)[f] == 0 for f in FEATURES)
    assert text_statistics(df.limit(0), common).count() == 0


def test_mixture(spark):
    rng = np.random.default_rng(1)
    n = len(FEATURES)
    x = np.concatenate([rng.normal(0.2, 0.03, (600, n)), rng.normal(0.6, 0.05, (300, n)), rng.normal(0.9, 0.01, (40, n))])
    stats = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES)).repartition(3)
    model = fit_mixture(stats, components=3)
    assert sorted(np.round(model.weights * len(x)).astype(int).tolist()) == [40, 300, 600]
    labels = spark.createDataFrame([(i, "prose") for i in range(20)] + [(i, "table") for i in range(600, 612)] + [(900, "junk"), (901, "junk"), (3, "table"), (5, None), (77_777, "list")], "doc_id long, label string")
    kinds = {r["doc_id"]: r["kind"] for r in classify_form(stats, labels, components=3).collect()}
    assert all(kinds[i] == ("prose" if i < 600 else "table" if i < 900 else "junk") for i in kinds) and len(kinds) == len(x)


def test_no_rows_no_labels_one_row(spark):
    df, common = frames(spark, [(1, "The only text of all.", "x")])
    labels = spark.createDataFrame([], "doc_id long, label string")
    assert classify_form(text_statistics(df.limit(0), common), labels).count() == 0
    assert classify_form(text_statistics(df, common), labels).first()["kind"] == "prose"


def test_held_out_labels(spark):
    """Half of the labels name the components, the other half is predicted."""
    from paperloom.session import table

    sf = "/root/testdata/sf0.01"
    stats = text_statistics(table(spark, sf, "documents"), table(spark, sf, "common_words"))
    labels = table(spark, sf, "doc_labels").toPandas().sort_values("doc_id")
    named, held = labels.iloc[::2], labels.iloc[1::2]
    kinds = {r["doc_id"]: r["kind"] for r in classify_form(stats, spark.createDataFrame(named)).collect()}
    right = [(kinds[d] == "prose") == (k == "prose") for d, k in zip(held["doc_id"], held["label"])]
    assert sum(right) / len(right) >= 0.9
    assert quality.MAX_LABELS >= len(labels)
