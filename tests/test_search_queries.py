"""Queries over the stored index against their SQL, while no Arrow batch may hold more than its own rows."""

import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql.classic.dataframe import DataFrame

import __spark_entry__
from paperloom.operators import fts_index, search
from paperloom.plans import collection

WORDS = "observatory treaty quarterly harvest glacier key list garrison senate hydrogr hydrography hydrogram memorandum harbor télégramme Telegramme in spite of the".split()
#: Of the Arrow pool of a Python worker; the test's rows are below 4 MB a task, copied for each of their words 150 MB.
MOST_BYTES = 32 << 20
NAMES = [
    "doc_lengths",
    "search_bm25",
    "eval_report",
    "postings",
    "search_snippets",
    "term_stats",
    "search_accents",
    "search_not",
    "search_prefix",
    "search_source_filter",
    "search_and",
    "search_empty",
    "search_or",
    "search_repeated",
    "search_title_filter",
    "search_and_word",
    "search_near",
    "search_phrase",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, at = random.Random(8), str(tmp_path_factory.mktemp("tables"))
    rows = []
    for i in range(1, 801):
        body = rng.sample([f"w{k}" for k in range(3000)], 280) + rng.choices(WORDS, k=rng.choice([0, 1, 2, 5]))
        rng.shuffle(body)
        if i % 97 == 0:
            body[40:40] = "in spite of the glacier , treaty of the harbor , key list".split()
        rows.append((i, f"d{i % 300:03d}", f"chunk-{i:04d}", rng.choice(["cia", "nsa"]), " ".join(rng.choices([*WORDS, "report", "file", "note", "cable"], k=rng.choice([0, 1, 3]))), " ".join(body), i, i + 1))
    chunks = spark.createDataFrame(rows, "chunk_row_id long, document_key string, chunk_id string, source string, title string, text string, page_start long, page_end long")
    chunks.coalesce(1).write.parquet(f"{at}/canonical_chunks.parquet")
    documents = spark.createDataFrame([(f"d{i:03d}", '{"source_warning":"w"}', "c", "t") for i in range(300)], "document_key string, metadata_json string, citation_note string, terms_note string")
    documents.coalesce(1).write.parquet(f"{at}/stored_documents.parquet")
    plain, most = DataFrame.mapInArrow, MOST_BYTES

    def watched(self, func, *args, **kwargs):
        def run(batches):
            pool = pa.default_memory_pool()
            start = pool.bytes_allocated()
            for batch in func(batches):
                if pool.bytes_allocated() - start > most:
                    raise MemoryError(f"{pool.bytes_allocated() - start} bytes for a batch of {batch.num_rows} rows")
                yield batch

        return plain(self, run, *args, **kwargs)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(DataFrame, "mapInArrow", watched)
        yield at


def by_sql(folder, name):
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW canonical_chunks AS SELECT * FROM '{folder}/canonical_chunks.parquet/*.parquet'")
        return sorted(db.execute(__spark_entry__.oracle_sql()[name]).fetchall())


@pytest.mark.parametrize("name", NAMES)
def test_as_its_sql(spark, folder, name):
    got = [r.asDict() for r in __spark_entry__.queries()[name](spark, folder).collect()]
    if name == "eval_report":
        assert {r["name"]: r["n_hits"] for r in got} == {n: len(by_sql(folder, n)) for n in collection.SEARCHES}
    elif name == "search_snippets":
        want = search.search(search.build_index(collection.index_rows(spark, folder)), "observatory harvest", None, 20).collect()
        assert want and {(r["row_id"], round(r["score"], 9)) for r in got} == {(r["row_id"], round(r["score"], 9)) for r in want}
        assert all("[" in r["snippet"] or "observatory" in r["title"] or "harvest" in r["title"] for r in got) and {r["source_warning"] for r in got} == {"w"}
    else:
        want = by_sql(folder, name)
        assert bool(want) == (name != "search_empty") and len(got) == len(want)
        assert all(a == pytest.approx(b, abs=2e-6) if isinstance(b, float) else a == b for x, y in zip(sorted(tuple(r.values()) for r in got), want) for a, b in zip(x, y))


def test_packed_and_unpacked(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(fts_index, "SLICE_OCCURRENCES", 50)
    rid = rng.sample([*range(40), *range(1 << 33, (1 << 33) + 40)], 60)  # of two files
    sides = [[[rng.choice(["a", "é", "zz"]) for _ in range(rng.choice([0, 1, most]))] for _ in rid] for most in (3, 200)]
    batch = pa.RecordBatch.from_arrays([pa.array(rid), *(pa.array(s, pa.list_(pa.string())) for s in sides)], names=["rid", "title", "body"])
    packed = list(fts_index._packed(["a", "é", "é"])(iter([batch.slice(0, 20), batch.slice(20)])))
    assert {(t, f) for b in packed for t, f in zip(b.column("term").to_pylist(), b.column("file").to_pylist())} <= {("a", 0), ("a", 1), ("zz", 1), ("é", 1), ("é", 2), ("é", 3)}
    got = {(r["term"], r["rid"]): (r["title"], r["body"]) for b in fts_index._unpacked(iter([b.drop_columns(["file"]) for b in packed])) for r in b.to_pylist()}
    want = {}
    for side, texts in enumerate(sides):
        for i, tokens in zip(rid, texts):
            for k, t in enumerate(tokens):
                want.setdefault((t, i), ([], []))[side].append(k)
    assert got == want and sum(b.num_rows for b in fts_index._unpacked(iter([b.drop_columns(["file"]) for b in packed]))) == len(want)
