from pyspark.sql import functions as F

from paperloom.operators.pages import split_pages
from paperloom.sources import files


def test_blobs_and_programs(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, content in (("a.pdf", b"%PDF-one\ftwo"), ("b.pdf", b"%PDF-one\ftwo"), ("c.pdf", b"no pdf"), ("d.txt", b"x")):
        (folder / name).write_bytes(content)
    found = files.blobs(spark, str(folder), "*.pdf")
    assert found.count() == 3
    kept = files.store_blobs(found, None, str(tmp_path / "blobs"))
    assert kept.count() == 3 and spark.read.parquet(str(tmp_path / "blobs")).count() == 2
    files.store_blobs(found, spark.read.parquet(str(tmp_path / "blobs")), str(tmp_path / "blobs"))
    assert spark.read.parquet(str(tmp_path / "blobs")).count() == 2
    texts = files.extracted_texts(found, ("cp", "{input}", "{output}"))
    got = {r["path"][-5:]: (r["text"], r["error"]) for r in texts.collect()}
    assert got["a.pdf"] == ("%PDF-one\ftwo", None) and got["c.pdf"] == (None, "not a file of the expected kind")
    assert split_pages(texts.filter("text IS NOT NULL"), ["path"]).count() == 4
    errors = {c[0]: files.convert(found.filter("path LIKE '%a.pdf'"), c, 1).first()["error"] for c in (("sleep", "9"), ("false",), ("no-such-program",), ("true",))}
    assert errors["sleep"] == "sleep took more than 1 seconds" and errors["false"].startswith("false failed") and "can't be started" in errors["no-such-program"] and errors["true"] == "true wrote nothing"


def test_fetches(spark):
    df = spark.createDataFrame([("e", None, False, 304, 0, None), ("e", "m", True, 200, 5, None), (None, None, False, 200, 10**9, None), (None, None, False, 302, 0, "u"), (None, None, False, 500, 0, None), (None, None, False, 302, 0, None)], "etag string, modified string, force boolean, status int, n long, location string")
    got = df.select(files.conditional_headers(F.col("etag"), F.col("modified"), F.col("force")).alias("h"), files.fetch_outcome(F.col("status"), F.col("n"), F.col("location")).alias("o")).collect()
    assert [r["h"] for r in got][:3] == [{"If-None-Match": "e"}, {}, {}] and [r["o"] for r in got] == ["revalidated", "stored", "too_large", "redirected", "failed", "failed"]
    assert spark.range(1).select(files.blob_path(F.lit("pdf"), F.lit("ab"), F.lit("pdf")).alias("x")).first()["x"] == "blobs/pdf/sha256/ab.pdf"
