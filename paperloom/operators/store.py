"""Tables as versioned snapshots: constraints, upsert, keyed replacement, deletion, atomic switch with a check of the version."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.ident import is_key
from paperloom.operators.search import InvalidRequest


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` replace those of `old` with their key; the keys of `new` must be unique."""
    return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` whose key isn't in `old`; of equal keys in `new` one."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*new.columns)


def replace_children(old: DataFrame, new: DataFrame, owners: DataFrame, key: str = "document_key") -> DataFrame:
    """All rows of the given owners are replaced by `new` (owners without new rows end up with none)."""
    gone = owners.select(key).distinct()
    return old.join(gone, key, "left_anti").select(*old.columns).unionByName(new.join(gone, key, "left_semi").select(*old.columns))


def delete_keys(old: DataFrame, keys: DataFrame, key: str = "document_key") -> DataFrame:
    return old.join(keys.select(key).distinct(), key, "left_anti").select(*old.columns)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def document_violations(documents: DataFrame) -> DataFrame:
    """document_key and the rule broken, of rows that break one: key characters and length, ids that must differ from
    the key, metadata that is a JSON object."""
    rules = [
        ("document_key", is_key(F.col("document_key"))), ("public_id", F.col("public_id").isNotNull() & (F.col("public_id") != F.col("document_key"))),
        ("source_id", F.col("source_id").isNotNull() & (F.col("source_id") != F.col("document_key"))),
        ("metadata_json", F.col("metadata_json").isNull() | (F.trim(F.col("metadata_json")).startswith("{") & F.trim(F.col("metadata_json")).endswith("}"))),
    ]
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]))
    return documents.select("document_key", F.explode(broken).alias("rule"))


class Conflict(RuntimeError):
    """Another writer has committed since the version that this commit was made from."""


@dataclass
class SnapshotStore:
    """Parquet tables under one folder. A commit writes new files beside the old ones and then switches one manifest, so
    readers see all of it or nothing. Manifests are numbered and a number is taken by one rename: of two writers that
    began at the same version one gets a Conflict and nothing of its commit is seen.

    A table is whole, or in buckets by the hash of a key; a commit of keys writes only the buckets of these keys anew.
    """

    spark: SparkSession
    root: str
    buckets: int = 16

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def version(self) -> int:
        """Number of the last manifest, 0 before the first commit."""
        fs, path = self._fs()
        if not fs.exists(path(self.root)):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(path(self.root))]
        return max((int(n.removeprefix("manifest-")) for n in names if n.startswith("manifest-")), default=0)

    def manifest(self, version: int | None = None) -> dict[str, dict]:
        """Of each table its key (null for a whole table) and its folders, by bucket."""
        number = self.version() if version is None else version
        if not number:
            return {}
        fs, path = self._fs()
        stream = fs.open(path(f"{self.root}/manifest-{number:012d}"))
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        at = self.manifest(version).get(name)
        if at is None:
            raise InvalidRequest(f"no table {name}")
        return self._read(at, at["folders"])

    def _read(self, table: dict, buckets) -> DataFrame:
        folders = [table["folders"][b] for b in buckets]
        if not folders:
            return self.spark.createDataFrame([], table["schema"])
        return self.spark.read.parquet(*[f"{self.root}/{f}" for f in folders])

    def has(self, name: str) -> bool:
        return name in self.manifest()

    def bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.buckets)).cast("int")

    def commit(self, tables: dict[str, DataFrame], expected: int | None = None) -> None:
        """Writes whole tables and publishes them together, if the version still is the expected one."""
        self.commit_keys({}, "", expected, tables)

    def commit_keys(self, changes: dict[str, tuple[DataFrame, DataFrame]], key: str, expected: int | None = None, tables: dict[str, DataFrame] | None = None) -> None:
        """For every table (its new rows, the keys they are for): all rows with one of the keys are replaced by the new
        rows. Only the buckets of the keys are read and written."""
        number = self.version() if expected is None else expected
        current = self.manifest(number)
        label = f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        for name, df in (tables or {}).items():
            df.write.parquet(f"{self.root}/{name}/{label}")
            current[name] = {"key": None, "folders": {"all": f"{name}/{label}"}, "schema": df.schema.simpleString()}
        for name, (rows, keys) in changes.items():
            known = current.get(name)
            if known is not None and known["key"] != key:  # a whole table becomes one in buckets
                keys = keys.select(key).unionByName(self._read(known, known["folders"]).select(key)).distinct()
                rows = replace_children(self._read(known, known["folders"]), rows, changes[name][1], key)
                known = None
            gone = keys.select(key).distinct()
            touched = [str(b) for (b,) in gone.select(self.bucket(key)).distinct().collect()]  # at most `buckets`
            if known is not None:
                old = self._read(known, [b for b in touched if b in known["folders"]])
                rows = replace_children(old, rows.select(*[c for c in old.columns if c in rows.columns], *[F.lit(None).cast(dict(old.dtypes)[c]).alias(c) for c in old.columns if c not in rows.columns]), keys, key)
            else:
                rows = rows.join(gone, key, "left_semi").select(*rows.columns)
            rows.withColumn("_bucket", self.bucket(key)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{name}/{label}")
            fs, path = self._fs()
            written = {s.getPath().getName().removeprefix("_bucket=") for s in fs.listStatus(path(f"{self.root}/{name}/{label}")) if s.isDirectory()}
            kept = {b: f for b, f in (known["folders"] if known else {}).items() if b not in touched}
            current[name] = {"key": key, "folders": kept | {b: f"{name}/{label}/_bucket={b}" for b in sorted(written)}, "schema": rows.schema.simpleString()}
        self._publish(number + 1, current)

    def _publish(self, number: int, manifest: dict) -> None:
        fs, path = self._fs()
        staged, final = path(f"{self.root}/.staged-{uuid.uuid4().hex}"), path(f"{self.root}/manifest-{number:012d}")
        out = fs.create(staged, True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(staged, final):
            fs.delete(staged, False)
            raise Conflict(f"version {number} has been published by another writer")
