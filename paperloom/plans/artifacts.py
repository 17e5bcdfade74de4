"""Text files of documents: what is there, and writing one so that readers see the old or the new file."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.reconcile import ARTIFACTS
from paperloom.operators.search import InvalidRequest

FILES = "document_key string, kind string, name string, is_file boolean, sha256 string"
_KEY = re.compile(r"[A-Za-z0-9_-]{1,160}\Z")
_PAGE_NAME = re.compile(r"[1-9]\d{0,8}\.txt\Z")


class TextFolder:
    """Files `<root>/<document_key>/<kind>/<name>`: `document.txt` for a document, `<page>.txt` for a page. A document's
    files are few, so they are written by the driver; reading and digests are Spark's."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def path(self, key: str, kind: str, name: str) -> str:
        """The one place of an artefact; refused where key, kind or name aren't of its form."""
        if not _KEY.match(key or "") or kind not in ARTIFACTS:
            raise InvalidRequest(f"no place for text of {key!r}, {kind!r}")
        if name != "document.txt" if kind == ARTIFACTS[0] else not _PAGE_NAME.match(name or ""):
            raise InvalidRequest(f"{name!r} isn't a file name of {kind}")
        return f"{self.root}/{key}/{kind}/{name}"

    def files(self, key: str) -> DataFrame:
        """Entries of a document's folders with the digests of its files."""
        if not _KEY.match(key or ""):
            raise InvalidRequest(f"not a document key: {key!r}")
        fs, path = self._fs()
        entries, readable = [], []
        for kind in ARTIFACTS:
            folder = path(f"{self.root}/{key}/{kind}")
            for s in fs.listStatus(folder) if fs.exists(folder) else []:
                entries.append((key, kind, s.getPath().getName(), bool(s.isFile())))
                if s.isFile():
                    readable.append(s.getPath().toString())
        listed = self.spark.createDataFrame(entries, "document_key string, kind string, name string, is_file boolean")
        empty = F.when(F.col("is_file"), F.sha2(F.lit(""), 256))  # the reader leaves out files without bytes
        if not readable:
            return listed.withColumn("sha256", empty)
        parts = F.reverse(F.split(F.col("path"), "/"))
        read = self.spark.read.format("binaryFile").load(readable).select(parts[1].alias("kind"), parts[0].alias("name"), F.sha2("content", 256).alias("sha256"))
        return listed.join(read, ["kind", "name"], "left").select("document_key", "kind", "name", "is_file", F.coalesce("sha256", empty).alias("sha256"))

    def write(self, key: str, kind: str, name: str, text: str) -> bool:
        """Writes a file beside its place and renames it there; false if the file already has this text. What stands in
        its place must be a file."""
        fs, path = self._fs()
        target = path(self.path(key, kind, name))
        body = text.encode("utf-8", "surrogatepass")
        if fs.exists(target):
            status = fs.getFileStatus(target)
            if not status.isFile():
                raise InvalidRequest(f"{target} isn't a file")
            if status.getLen() == len(body):
                stream = fs.open(target)
                same = bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)) == body
                stream.close()
                if same:
                    return False
        fs.mkdirs(target.getParent())
        staged = path(f"{self.root}/{key}/.staged-{uuid.uuid4().hex}")
        out = fs.create(staged, True)
        out.write(bytearray(body))
        out.hsync()
        out.close()
        if fs.exists(target):
            fs.delete(target, False)
        if not fs.rename(staged, target):
            fs.delete(staged, False)
            raise OSError(f"can't write {target}")
        return True
