"""A stored full-text index: postings sorted by term, rows, and corpus statistics, in segments.

A segment is one write. Its postings have a row per term and slice of the index rows with the rows' numbers and the
positions in title and body, packed, sorted by term over files of bounded size; a small table has each file's first and
last term. A query reads the files that can have its terms, with the term as a pushed filter, and never the texts; keys,
source and length are in the rows, whose texts are read for the top hits only. Replacing documents writes a new segment
and the keys that it replaces; rows of older segments with these keys no longer count. `merge` makes one segment of all.
"""

from __future__ import annotations

import json
import time
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import search as scan
from paperloom.operators.search import COLUMNS, Phrase

#: Of manifests and postings; an index of another layout counts as not built.
LAYOUT = 2
#: Occurrences of terms in one file of postings, and index rows in one file of rows, about.
FILE_OCCURRENCES = 20_000_000
LEAST_OCCURRENCES = 500_000
FILE_ROWS = 200_000
#: Occurrences of terms packed or unpacked at once, but for a single row or posting list with more.
SLICE_OCCURRENCES = 1_000_000
#: Occurrences for each file of postings by which the files' terms are chosen.
SAMPLE_OCCURRENCES = 1_000
OWNER = "document_key"
PACKED = "term string, base long, n int, n_at int, rows binary, sizes binary, at binary"
UNPACKED = "term string, rid long, title array<int>, body array<int>"


def _varints(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Numbers in seven bits a byte; `ends`: where each element's numbers begin, and their end."""
    lengths = np.ones(len(values), np.int64)
    for k in range(1, 10):
        more = values >> (7 * k) > 0
        if not more.any():
            break
        lengths += more
    starts = np.concatenate([[0], np.cumsum(lengths)])
    out = np.empty(starts[-1], np.uint8)
    for k in range(int(lengths.max(initial=0))):
        own = lengths > k
        out[starts[:-1][own] + k] = (values[own] >> (7 * k) & 127) | ((lengths[own] > k + 1).astype(np.int64) << 7)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(starts[ends].astype(np.int32)), pa.py_buffer(out)])


def _numbers(packed: pa.Array) -> np.ndarray:
    """All elements' numbers one after the other."""
    edges = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset:packed.offset + len(packed) + 1]
    if not len(packed) or edges[0] == edges[-1]:
        return np.empty(0, np.int64)
    data = np.frombuffer(packed.buffers()[2], np.uint8)[edges[0]:edges[-1]]
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    values = (data[starts] & 127).astype(np.int64)
    lengths = ends - starts + 1
    for k in range(1, int(lengths.max())):
        own = np.flatnonzero(lengths > k)
        values[own] |= (data[starts[own] + k] & 127).astype(np.int64) << (7 * k)
    return values


def _running(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the steps so far within each of the groups that follow one another."""
    total = np.cumsum(steps)
    filled = sizes[sizes > 0]
    starts = np.cumsum(filled) - filled
    return total - np.repeat(total[starts] - steps[starts], filled)


def _steps(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Differences from the value before, the value itself at the beginnings of groups."""
    out = values.copy()
    out[1:] -= values[:-1]
    out[first] = values[first]
    return out


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of elements with no more than SLICE_OCCURRENCES in all; a larger element is alone."""
    at, total = 0, np.cumsum(sizes)
    while at < len(sizes):
        end = int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE_OCCURRENCES, "right"))
        end = max(end, at + 1)
        yield at, end
        at = end


def _packed(bounds: list[str]):
    """Rows (rid, title tokens, body tokens) to one row per term and slice of rows with its postings, and its file.

    A file has the terms from one bound to the next; a term that is itself several bounds is spread over their files.
    """

    def file_of(term: str, base: int) -> int:
        low, high = bisect_left(bounds, term), bisect_right(bounds, term)
        return low if low == high else low + zlib.crc32(base.to_bytes(8, "little")) % (high - low + 1)

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        rid = batch.column(0).to_numpy()
        by_rid = np.argsort(rid)  # a batch may be of several files
        rank = np.empty(len(rid), np.int64)
        rank[by_rid] = np.arange(len(rid))
        tokens, row, place = [], [], []
        for column in batch.columns[1:]:
            n = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            tokens.append(column.flatten())
            row.append(np.repeat(rank, n))
            place.append(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        coded = pa.concat_arrays(tokens).dictionary_encode()
        in_body = np.arange(len(coded)) >= len(tokens[0])
        key = coded.indices.to_numpy().astype(np.int64) * len(rid) + np.concatenate(row)
        order = np.argsort(key, kind="stable")  # by term, row, column and place
        key, in_body, place = key[order], in_body[order], np.concatenate(place)[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))  # of postings
        all_of = np.diff(np.append(starts, len(key)))
        body_of = np.add.reduceat(in_body.astype(np.int64), starts)
        lists = np.column_stack([all_of - body_of, body_of])  # positions in title and body
        code, own = np.divmod(key[starts], len(rid))
        firsts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))  # of terms
        edges = np.append(firsts, len(starts))
        sides = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (in_body[1:] != in_body[:-1])]))
        rids = rid[by_rid][own]
        steps = _steps(rids, firsts)
        steps[firsts] = 0
        terms = coded.dictionary.take(pa.array(code[firsts]))
        at = np.append(starts, len(key))[edges]
        base = rids[firsts]
        columns = [
            terms, pa.array(base), pa.array(np.diff(edges).astype(np.int32)), pa.array(np.diff(at).astype(np.int32)),
            _varints(steps, edges), _varints(lists.ravel(), 2 * edges), _varints(_steps(place, sides), at),
            pa.array([file_of(t, b) for t, b in zip(terms.to_pylist(), base.tolist())], pa.int32()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["term", "base", "n", "n_at", "rows", "sizes", "at", "file"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = sum(pc.list_value_length(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[1:])
            for a, b in _slices(sizes):
                if sizes[a:b].any():
                    yield pack(batch.slice(a, b - a))

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed postings to one row per term and index row with its positions."""
    for whole in batches:
        for a, b in _slices(whole.column("n_at").to_numpy()):
            batch = whole.slice(a, b - a)
            n = batch.column("n").to_numpy().astype(np.int64)
            block = np.repeat(np.arange(len(n)), n)
            rid = batch.column("base").to_numpy()[block] + _running(_numbers(batch.column("rows")), n)
            sizes = _numbers(batch.column("sizes"))
            at = _running(_numbers(batch.column("at")), sizes).astype(np.int32)
            in_body = np.repeat(np.arange(len(sizes)) % 2 == 1, sizes)
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes[side::2])]).astype(np.int32)), pa.array(at[in_body == bool(side)])) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("term").take(pa.array(block)), pa.array(rid), *lists], names=["term", "rid", "title", "body"])


class StoredIndex:
    """Index rows (document_key, other key columns, source, title, body and what else there is) under one folder.

    `keys` are the columns that order hits of equal score; they are stored with every posting. Readers see a segment
    once its manifest is renamed into place; a writer whose predecessor is no longer the last manifest is refused.
    """

    def __init__(self, spark: SparkSession, root: str, keys: tuple[str, ...] = ("document_key", "chunk_id")) -> None:
        self.spark, self.root, self.keys = spark, root, keys

    # segments

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def manifest(self) -> dict:
        """number, segments (oldest first), n_rows and n_tokens of all rows that count."""
        fs, path = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(path(self.root))] if fs.exists(path(self.root)) else []
        names = sorted(n for n in names if n.startswith("manifest-"))
        none = {"number": 0, "segments": [], "n_rows": 0, "n_tokens": 0}
        if not names:
            return none
        stream = fs.open(path(f"{self.root}/{names[-1]}"))
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        held = json.loads(text)
        return held if held.get("layout") == LAYOUT else none | {"number": held["number"]}

    def _publish(self, manifest: dict) -> None:
        fs, path = self._fs()
        manifest = manifest | {"number": manifest["number"] + 1, "layout": LAYOUT}
        staged, final = path(f"{self.root}/.staged-{uuid.uuid4().hex}"), path(f"{self.root}/manifest-{manifest['number']:012d}")
        out = fs.create(staged, True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(staged, final):
            raise OSError(f"another writer has published {final}")

    def _write(self, rows: DataFrame) -> tuple[dict, int, int]:
        """A segment, its rows and tokens."""
        name = f"s{time.time_ns():020d}-{uuid.uuid4().hex[:6]}"
        at = f"{self.root}/{name}"
        tasks = self.spark.sparkContext.defaultParallelism
        if rows.rdd.getNumPartitions() < tasks:  # one file of a small table isn't one task's work
            rows = rows.repartition(tasks)
        numbered = scan.build_index(rows).withColumn("rid", F.monotonically_increasing_id())
        numbered.write.option("maxRecordsPerFile", FILE_ROWS).option("compression", "zstd").parquet(f"{at}/rows")
        stored = self.spark.read.parquet(f"{at}/rows")
        n, tokens = stored.agg(F.count("*"), F.sum("n_tokens")).first()
        files = int(max(1, -(-(tokens or 0) // FILE_OCCURRENCES), min(tasks, (tokens or 0) // LEAST_OCCURRENCES)))
        made = stored.select("rid", "title_tokens", "body_tokens").mapInArrow(_packed(self._bounds(stored, files, tokens or 0)), f"{PACKED}, file int")
        sorted_ = made.repartitionById(files, "file").drop("file").sortWithinPartitions("term", "base")
        sorted_.write.option("parquet.block.size", str(16 << 20)).option("compression", "zstd").parquet(f"{at}/postings")
        terms = self.spark.read.parquet(f"{at}/postings").groupBy(F.input_file_name().alias("file")).agg(F.min("term").alias("first"), F.max("term").alias("last"))
        terms.coalesce(1).write.parquet(f"{at}/files")
        return {"name": name, "gone": False}, n, tokens or 0

    def _bounds(self, stored: DataFrame, files: int, tokens: int) -> list[str]:
        """Terms at which files of postings end, in order, by some of the occurrences. They only balance the files: all
        postings are written, whichever the bounds are."""
        if files == 1:
            return []
        rows = max(1, tokens // (20 * files * SAMPLE_OCCURRENCES))  # one row of so many, one of 20 occurrences
        some = stored.filter(F.pmod(F.xxhash64("rid"), F.lit(rows)) == 0).select("rid", F.posexplode(F.concat("title_tokens", "body_tokens")).alias("k", "term"))
        counts = sorted(some.filter(F.pmod(F.xxhash64("rid", "k"), F.lit(20)) == 0).groupBy("term").count().collect())
        if not counts:
            return []
        passed = np.cumsum([n for _, n in counts])
        return [counts[i][0] for i in np.searchsorted(passed, passed[-1] * np.arange(1, files) / files)]

    def build(self, rows: DataFrame, more: dict | None = None) -> None:
        """The index has these rows and no others. `more` is kept in the manifest."""
        old = self.manifest()
        segment, n, tokens = self._write(rows)
        self._publish({"number": old["number"], "segments": [segment], "n_rows": n, "n_tokens": tokens} | (more or {}))

    def replace(self, rows: DataFrame, owners: DataFrame, more: dict | None = None) -> None:
        """`rows` take the place of all rows of the given documents (document_key); documents without new rows end up
        with none. Older segments aren't rewritten."""
        old = self.manifest()
        keys = owners.select(OWNER).distinct()
        dead = self.rows(old, [OWNER, "n_tokens"]).join(keys, OWNER, "left_semi").agg(F.count("*"), F.sum("n_tokens")).first() if old["segments"] else (0, 0)
        segment, n, tokens = self._write(rows)
        keys.write.parquet(f"{self.root}/{segment['name']}/gone")
        self._publish({
            "number": old["number"], "segments": [*old["segments"], segment | {"gone": True}],
            "n_rows": old["n_rows"] - dead[0] + n, "n_tokens": old["n_tokens"] - (dead[1] or 0) + tokens,
        } | (more or {}))

    def merge(self) -> None:
        """One segment of all rows that count. Old segments stay for readers that have them open; `sweep` removes them."""
        self.build(self.rows(self.manifest()).drop("seg", "rid", "title_tokens", "body_tokens", "n_tokens"))

    def sweep(self) -> int:
        """Deletes the folders that the manifest doesn't name; their number."""
        fs, path = self._fs()
        live = {s["name"] for s in self.manifest()["segments"]}
        gone = [s.getPath() for s in fs.listStatus(path(self.root)) if s.isDirectory() and s.getPath().getName() not in live]
        for p in gone:
            fs.delete(p, True)
        return len(gone)

    def _living(self, df: DataFrame, manifest: dict) -> DataFrame:
        """Rows (with seg) whose document no later segment replaces."""
        parts = [self.spark.read.parquet(f"{self.root}/{s['name']}/gone").select(OWNER, F.lit(i).alias("by")) for i, s in enumerate(manifest["segments"]) if s["gone"] and i]
        if not parts:
            return df
        gone = reduce(DataFrame.unionByName, parts).groupBy(OWNER).agg(F.max("by").alias("by"))
        return df.join(gone, (df[OWNER] == gone[OWNER]) & (df["seg"] < gone["by"]), "left_anti")

    def rows(self, manifest: dict | None = None, columns: list[str] | None = None) -> DataFrame:
        """All rows that count, with their segment's place and their number in it."""
        manifest = manifest or self.manifest()
        parts = [self.spark.read.parquet(f"{self.root}/{s['name']}/rows").withColumn("seg", F.lit(i)) for i, s in enumerate(manifest["segments"])]
        everything = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return self._living(everything if columns is None else everything.select(*dict.fromkeys([*columns, OWNER, "seg"])), manifest)

    def postings(self, exact: set[str] | None = None, prefixes: set[str] | None = None, manifest: dict | None = None) -> DataFrame | None:
        """Postings (term, rid, title, body, seg) of the given terms and of those with the given beginnings, or all;
        null if no file can have them."""
        manifest = manifest or self.manifest()
        found = self._found(exact, prefixes, manifest)
        if found is None or not any(s["gone"] for s in manifest["segments"][1:]):
            return found
        return found.join(self.rows(manifest, ["rid"]), ["seg", "rid"], "left_semi")

    def _found(self, exact: set[str] | None, prefixes: set[str] | None, manifest: dict) -> DataFrame | None:
        """The same with those of rows that no longer count."""
        parts = []
        for i, s in enumerate(manifest["segments"]):
            at = f"{self.root}/{s['name']}"
            packed = None
            if exact is None:
                packed = self.spark.read.schema(PACKED).parquet(f"{at}/postings")
            else:
                may = [(F.col("first") <= w) & (F.col("last") >= w) for w in sorted(exact)] + [(F.substring("first", 1, len(p)) <= p) & (F.col("last") >= p) for p in sorted(prefixes or ())]
                files = [f for (f,) in self.spark.read.schema("file string, first string, last string").parquet(f"{at}/files").filter(reduce(lambda a, b: a | b, may, F.lit(False))).select("file").collect()]
                if files:
                    terms = [F.col("term").isin(*sorted(exact))] if exact else []
                    terms += [F.col("term").startswith(p) for p in sorted(prefixes or ())]
                    packed = self.spark.read.schema(PACKED).parquet(*files).filter(reduce(lambda a, b: a | b, terms))
            if packed is not None:
                parts.append(packed.mapInArrow(_unpacked, UNPACKED).withColumn("seg", F.lit(i)))
        return reduce(DataFrame.unionByName, parts) if parts else None

    # search

    def search(self, query: str, source: str | None = None, limit: int = 10) -> DataFrame:
        """The best rows with all their columns but the tokens, and score, as `search.search` gives them by a scan."""
        match = scan.parse_match(query)
        phrases = list(dict.fromkeys(scan._all_phrases(match)))
        manifest = self.manifest()
        if not manifest["segments"]:
            raise scan.InvalidRequest("nothing is indexed")
        if not all(p.words and p.columns for p in phrases):  # matches without a term need every row
            rows = self.rows(manifest)
            return scan.ranked(scan.counted(rows, phrases), match, phrases, source, limit, self.keys).drop("seg", "rid")
        exact = {w for p in phrases for w in (p.words[:-1] if p.prefix else p.words)}
        prefixes = {p.words[-1] for p in phrases if p.prefix}
        found = self._found(exact, prefixes, manifest)
        top: list = []
        if found is not None:
            starts = {(p, c): F.col(f"_s{i}_{c}") for i, p in enumerate(phrases) for c in p.columns}
            about = self.rows(manifest, ["rid", "source", *self.keys, "n_tokens"])  # those that count
            counted = _by_row(found, phrases).join(about, ["seg", "rid"]).withColumns({f"_f{i}": reduce(lambda a, b: a + b, [F.size(starts[p, c]) for c in p.columns]) for i, p in enumerate(phrases)})
            average = manifest["n_tokens"] / manifest["n_rows"] if manifest["n_rows"] else None
            hits = scan.ranked(counted, match, phrases, source, limit, self.keys, (manifest["n_rows"], average), starts)
            top = hits.select("seg", "rid", "score").collect()  # at most 100
        rows = self.rows(manifest)
        own = [s for s in ("title_tokens", "body_tokens", "n_tokens") if s in rows.columns]
        wanted = rows.drop(*own).filter(F.col("rid").isin([r["rid"] for r in top]) if top else F.lit(False))
        scores = self.spark.createDataFrame([tuple(r) for r in top], "seg int, rid long, score double")
        return wanted.join(F.broadcast(scores), ["seg", "rid"]).drop("seg", "rid").orderBy("score", *self.keys)  # at most 100 rows


def _less(k: int, v: Column) -> Column:
    return v - k


def _by_row(found: DataFrame, phrases: list[Phrase]) -> DataFrame:
    """One row per index row with, for every phrase and column, where the phrase begins (`_s{phrase}_{column}`)."""
    words = dict.fromkeys((w, p.prefix and k == len(p.words) - 1) for p in phrases for k, w in enumerate(p.words))
    names = {w: f"_w{i}" for i, w in enumerate(words)}
    is_word = lambda w, prefix: F.col("term").startswith(w) if prefix else F.col("term") == w
    none = F.array().cast("array<int>")
    if len(words) == 1 and not next(iter(words))[1]:  # a row has one posting of a term
        held = found.select("seg", "rid", *[F.col(c).alias(f"{names[next(iter(words))]}_{c}") for c in COLUMNS])
    else:
        lists = [F.flatten(F.collect_list(F.when(is_word(*w), F.col(c)))).alias(f"{n}_{c}") for w, n in names.items() for c in COLUMNS]
        held = found.groupBy("seg", "rid").agg(*lists)

    def begins(p: Phrase, c: str) -> Column:
        at = [F.col(f"{names[w, p.prefix and k == len(p.words) - 1]}_{c}") for k, w in enumerate(p.words)]
        shifted = [F.transform(x, partial(_less, k)) for k, x in enumerate(at)]
        return F.coalesce(F.array_sort(reduce(F.array_intersect, shifted)), none)

    return held.select("seg", "rid", *[begins(p, c).alias(f"_s{i}_{c}") for i, p in enumerate(phrases) for c in p.columns])
