"""Files: content-addressed blobs, text by external programs, and what to ask of a source for a cached file."""

from __future__ import annotations

import os
import signal
import subprocess
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 100 * 1024 * 1024
PDF_TEXT = ("pdftotext", "-layout", "-enc", "UTF-8", "{input}", "{output}")
RECOGNITION = ("ocrmypdf", "--skip-text", "{input}", "{output}")


def blobs(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files of a folder: path, sha256, n_bytes, content; larger ones than MAX_BYTES are left out before they are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.filter(F.col("length") <= MAX_BYTES).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("n_bytes"), "content")


def whole_texts(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """path and text of whole files in UTF-8."""
    raw = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(folder, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def blob_path(kind: Column, sha256: Column, extension: Column) -> Column:
    """Where a blob is kept under its content's hash."""
    return F.concat(F.lit("blobs/"), kind, F.lit("/sha256/"), sha256, F.lit("."), extension)


def store_blobs(files: DataFrame, known: DataFrame | None, target: str) -> DataFrame:
    """Writes blobs that aren't kept yet, once per content, and returns their paths and hashes."""
    fresh = files.dropDuplicates(["sha256"])
    if known is not None:
        fresh = fresh.join(known.select("sha256"), "sha256", "left_anti")
    fresh.write.mode("append").parquet(target)
    return files.select("path", "sha256", "n_bytes")


def _run(command: tuple[str, ...], content: bytes, seconds: int, magic: bytes) -> tuple[bytes | None, str | None]:
    """Output of a program on one file, or why there is none. The program and its children end at the time limit."""
    if magic and not content.startswith(magic):
        return None, "not a file of the expected kind"
    with tempfile.TemporaryDirectory() as folder:
        source, target = os.path.join(folder, "in"), os.path.join(folder, "out")
        with open(source, "wb") as f:
            f.write(content)
        args = [a.format(input=source, output=target) for a in command]
        try:
            p = subprocess.Popen(args, stdin=subprocess.DEVNULL, stdout=subprocess.DEVNULL, stderr=subprocess.PIPE, start_new_session=True)
        except OSError as e:
            return None, f"{command[0]} can't be started: {e.strerror}"
        try:
            _, err = p.communicate(timeout=seconds)
        except subprocess.TimeoutExpired:
            os.killpg(p.pid, signal.SIGKILL)
            p.communicate()
            return None, f"{command[0]} took more than {seconds} seconds"
        if p.returncode:
            return None, f"{command[0]} failed: {err[-8192:].decode(errors='replace').strip()}"
        if not os.path.exists(target):
            return None, f"{command[0]} wrote nothing"
        with open(target, "rb") as f:
            return f.read(), None


def convert(files: DataFrame, command: tuple[str, ...], seconds: int = 60, magic: bytes = b"%PDF-") -> DataFrame:
    """Each file's output of an external program: path, sha256, output, error. `{input}` and `{output}` in the command
    stand for the files' names; a file that fails has a null output and the reason, and stops no other."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = [_run(command, bytes(c), seconds, magic) for c in frame["content"]]
            yield pd.DataFrame({"path": frame["path"], "sha256": frame["sha256"], "output": [o for o, _ in done], "error": [e for _, e in done]})

    return files.select("path", "sha256", "content").mapInPandas(run, "path string, sha256 string, output binary, error string")


def extracted_texts(files: DataFrame, command: tuple[str, ...] = PDF_TEXT, seconds: int = 60) -> DataFrame:
    """path, sha256, text (pages separated by form feeds), error of PDF files."""
    out = convert(files, command, seconds)
    return out.select("path", "sha256", F.decode("output", "UTF-8").alias("text"), "error")


def conditional_headers(etag: Column, last_modified: Column, force: Column) -> Column:
    """Headers that let a source answer that a cached file is still good; none for a forced fetch."""
    headers = F.create_map(F.lit("If-None-Match"), etag, F.lit("If-Modified-Since"), last_modified)
    return F.when(force, F.create_map().cast("map<string,string>")).otherwise(F.map_filter(headers, lambda k, v: v.isNotNull()))


def fetch_outcome(status: Column, n_bytes: Column, location: Column) -> Column:
    """What a fetch's answer means: revalidated, stored, too_large, redirected, failed."""
    return (
        F.when(status == 304, F.lit("revalidated")).when(status.between(300, 399) & location.isNotNull(), F.lit("redirected"))
        .when(status.between(200, 299) & (n_bytes > MAX_BYTES), F.lit("too_large")).when(status.between(200, 299), F.lit("stored")).otherwise(F.lit("failed"))
    )
