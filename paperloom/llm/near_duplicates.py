"""Rows that share at least a given part of their word runs (problem 5).

T-occurrence search in the manner of DivideSkip, distributed. Two sets of sizes a <= b with Jaccard similarity t have at
least T = t (a + b) / (1 + t) elements in common. Of each text's inverted lists the T - 1 longest, in a global order by
frequency, are set aside for the binary probe; the rest, its rarest shingles, are merged.

Only entries of the short lists are shuffled, 16 bytes each whatever the number of parts: key, text, and the text's size
and elements behind the entry on a scale of 15 bits whose rounding is on the safe side. A part holds whole lists. In a
list, sorted by size, a text is compared with those up to 1/t times as large, and the event is kept if both texts have
T - c + 1 elements from this entry on, where c is COMMON or, for texts of very different size, what their short lists
have in common at least. The first c common elements of similar texts pass, so a pair with fewer events is none; no
similar pair is lost, and what passes doesn't depend on how the lists are cut into parts. A list that too many texts
share gives few events, because its element stands late in their order; where it does give them, it is cut into cells of
salted pairs of texts. Pairs with c events are verified by probing the sorted shingles of one text in those of the other.

Nothing is sampled and no list is capped. Exact copies are one text: a text goes by its 64-bit hash, so copies don't
multiply the lists, and links are between different texts. The order's frequencies come from a sketch of fixed size over
all rows; any order gives the same result, a poor one only costs time.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import once
from paperloom.session import shared

WORD = re.compile(r"[^\W_]+")
#: Counters of the frequency sketch and the piece of it that travels as one row.
CELLS = 1 << 22
_PIECE = 1 << 16
#: Frequency classes per doubling of the frequency.
STEPS = 4
#: Short-list entries in one part, about; entries of one task before they are sent; pairs looked at once in a task.
PART_ENTRIES = 750_000
SENT_ENTRIES = 2_000_000
BLOCK_EVENTS = 3_000_000
#: Common short lists, in the shortest prefixes that must have them, that make a pair a candidate.
COMMON = 5
#: Partitions of the exchange; parts beyond that number share partitions and are merged one after the other.
MAX_PARTITIONS = 50_000
#: Texts that a list or one of its cells holds, about, beyond twice the average of the sketch.
CELL_TEXTS = 50_000
#: Hashes of texts that a task remembers, so that copies among its rows are looked at once.
REMEMBERED = 1_000_000
#: Texts in candidate pairs whose hashes are broadcast to fetch their texts, at most; beyond it they are joined.
MAX_BROADCAST = 1_000_000

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)


class Shingler:
    """Sorted distinct 64-bit hashes of the runs of `width` words of a text."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.words: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        found = WORD.findall(text.lower())
        n = len(found) - self.width + 1
        if n < 1:
            return np.empty(0, np.uint64)
        if len(self.words) > 2_000_000:
            self.words.clear()
        known = self.words
        hashes = [known.get(w) or known.setdefault(w, xxhash.xxh64_intdigest(w) | 1) for w in found]
        h = np.array(hashes, dtype=np.uint64)
        s = np.zeros(n, dtype=np.uint64)
        for k in range(self.width):
            s = (s + h[k:k + n]) * _MIX[k % 4]
            s ^= s >> np.uint64(29)
        return np.unique(s)


def least_overlap(a: np.ndarray, b: np.ndarray, t: Fraction) -> np.ndarray:
    """Smallest number of common elements with which sets of these sizes have similarity t."""
    p, q = t.numerator, t.denominator
    return -(-(p * (a + b)) // (p + q))


def suffix_length(n: np.ndarray | int, t: Fraction):
    """Lists set aside of a set of n elements: one less than any similar set has in common with it."""
    return -(-(t.numerator * n) // t.denominator) - 1


#: Sizes on a scale of 15 bits: exact below 4,096, then 2,048 steps a doubling; least and most size of each step.
_EXACT, _TOP = 4096, (1 << 15) - 1
SCALE_LOW = np.concatenate([np.arange(_EXACT), np.ceil(_EXACT * 2.0 ** (np.arange(_TOP + 1 - _EXACT) / 2048))]).astype(np.int64)
SCALE_HIGH = np.append(np.maximum(SCALE_LOW[1:] - 1, SCALE_LOW[:-1]), np.int64(1) << 40)
_FLAG, _CODE = np.uint16(1 << 15), np.uint16(_TOP)


def scaled(n: np.ndarray) -> np.ndarray:
    return (np.searchsorted(SCALE_LOW, n, "right") - 1).astype(np.uint16)


def cells_by_class(classes: np.ndarray) -> np.ndarray:
    """By frequency class the number of salts of a list: 1 unless far above the average and CELL_TEXTS."""
    average = float(np.exp2(classes / STEPS).mean()) if len(classes) else 0.0
    most = np.exp2((np.arange(256) + 1) / STEPS)
    return np.where(most > 2 * average + CELL_TEXTS, np.ceil(most / (2 * average + CELL_TEXTS)), 1).astype(np.int64)


def _sketch(width: int, cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, counts = Shingler(width), np.zeros(cells, dtype=np.uint32)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i in range(0, len(texts), 500):
                parts = [shingles(t) for t in texts[i:i + 500]]
                cell, n = np.unique((np.concatenate(parts) & np.uint64(cells - 1)).astype(np.int64), return_counts=True)
                counts[cell] += n.astype(np.uint32)
        pieces = range(0, cells, _PIECE) if counts.any() else []
        yield pa.RecordBatch.from_pydict({"piece": pa.array([p // _PIECE for p in pieces], pa.int32()), "counts": pa.array([zlib.compress(counts[p:p + _PIECE].tobytes(), 1) for p in pieces], pa.binary())})

    return run


def _add_pieces(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(c), dtype=np.uint32).astype(np.uint64) for c in table.column("counts").to_pylist())
    classes = np.round(np.log2(total + 1.0) * STEPS).astype(np.uint8)  # steps of the logarithm, at most 32 doublings
    return pa.table({"piece": table.column("piece").slice(0, 1), "classes": pa.array([classes.tobytes()], pa.binary())})


def frequency_classes(texts: DataFrame, width: int, cells: int = CELLS) -> np.ndarray:
    """A byte per cell of the sketch: the class of frequency of the shingles that fall into it."""
    out = np.zeros(cells, dtype=np.uint8)
    pieces = texts.select("text").mapInArrow(_sketch(width, cells), "piece int, counts binary").groupBy("piece").applyInArrow(_add_pieces, "piece int, classes binary")
    for piece, classes in pieces.collect():  # `cells` bytes in all
        out[piece * _PIECE:piece * _PIECE + len(classes)] = np.frombuffer(bytes(classes), dtype=np.uint8)
    return out


def _mixed(key: np.ndarray, salt: np.ndarray, other: np.ndarray) -> np.ndarray:
    k = (key + (salt.astype(np.uint64) + np.uint64(1)) * _MIX[0] + (other.astype(np.uint64) + np.uint64(1)) * _MIX[1]) * _MIX[2]
    return k ^ (k >> np.uint64(29))


def short_lists(s: np.ndarray, rank: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A text's rarest shingles in order, their classes, and its size and the elements behind each on the scale. `s` is
    sorted, so ties go by hash. The flag on the second scale: the entry can't be the smaller text's of a pair."""
    n = len(s)
    chosen = np.argsort(rank, kind="stable")[:n - int(suffix_length(n, t))]
    size = np.full(len(chosen), scaled(np.array([n]))[0])
    behind = scaled(n - 1 - np.arange(len(chosen)))
    low = SCALE_LOW[size]
    larger_only = SCALE_HIGH[behind] + COMMON < least_overlap(low, low, t)
    return s[chosen], rank[chosen], size, behind | np.where(larger_only, _FLAG, np.uint16(0))


def cut_hot(keys: np.ndarray, cells: np.ndarray, docs: np.ndarray, size: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, ...]:
    """Entries of lists with more than one salt, once for every cell of their list: cell (v, w) pairs smaller texts of
    salt v with larger ones of salt w. The flag on the size: not the larger text's entry."""
    out = []
    salt = (docs.view(np.uint64) >> np.uint64(7)).astype(np.int64) % cells
    for i in range(len(keys)):
        own, m = np.array([salt[i]]), np.arange(cells[i])
        smaller = not behind[i] & _FLAG
        pairs = [(own, own, size[i], behind[i])]
        others = m[m != salt[i]]
        pairs.append((others, own, size[i], behind[i] | _FLAG))
        if smaller:
            pairs.append((own, others, size[i] | _FLAG, behind[i]))
        for v, w, z, r in pairs:
            v, w = np.broadcast_arrays(v, w)
            out.append((_mixed(np.full(len(v), keys[i]), v, w), np.full(len(v), docs[i]), np.full(len(v), z, np.uint16), np.full(len(v), r, np.uint16)))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (keys, docs, size, behind)


def _blob(keys: np.ndarray, docs: np.ndarray, size: np.ndarray, behind: np.ndarray) -> bytes:
    return (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + docs.tobytes() + size.tobytes() + behind.tobytes()


def _entries_of(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    columns: tuple[list, ...] = ([], [], [], [])
    for blob in blobs:
        n, at = len(blob) // 16, 0
        for column, kind in zip(columns, (np.uint32, np.int64, np.uint16, np.uint16)):
            column.append(np.frombuffer(blob, dtype=kind, count=n, offset=at))
            at += n * np.dtype(kind).itemsize
    return tuple(np.concatenate(c) for c in columns)


def _short_entries(width: int, t: Fraction, parts: int, classes, salts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, order = Shingler(width), np.frombuffer(classes.value, dtype=np.uint8)
        low = np.uint64(len(order) - 1)
        any_hot = bool((salts > 1).any())
        held: list[tuple[np.ndarray, ...]] = []
        seen: set[int] = set()
        size_held = 0

        def send() -> pa.RecordBatch:
            keys, docs, size, behind = (np.concatenate(x) for x in zip(*held)) if held else (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint16), np.empty(0, np.uint16))
            of = ((keys >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
            by = np.argsort(of, kind="stable")
            keys, docs, size, behind, of = keys[by], docs[by], size[by], behind[by], of[by]
            first = np.nonzero(np.concatenate([[True], of[1:] != of[:-1]]))[0] if len(of) else np.empty(0, np.int64)
            blobs = [_blob(keys[a:b], docs[a:b], size[a:b], behind[a:b]) for a, b in zip(first, np.append(first[1:], len(of)))]
            return pa.RecordBatch.from_pydict({"part": pa.array(of[first], pa.int64()), "entries": pa.array(blobs, pa.binary())})

        for batch in batches:
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if h in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(h)
                s = shingles(text)
                if not len(s):
                    continue
                keys, rank, size, behind = short_lists(s, order[(s & low).astype(np.int64)], t)
                docs = np.full(len(keys), h, np.int64)
                if any_hot and (hot := salts[rank] > 1).any():
                    held.append(cut_hot(keys[hot], salts[rank[hot]], docs[hot], size[hot], behind[hot]))
                    size_held += len(held[-1][0])
                    keys, docs, size, behind = keys[~hot], docs[~hot], size[~hot], behind[~hot]
                held.append((keys, docs, size, behind))
                size_held += len(keys)
                if size_held >= SENT_ENTRIES:
                    yield send()
                    held.clear()
                    size_held = 0
        yield send()

    return run


def merge_lists(keys: np.ndarray, docs: np.ndarray, size: np.ndarray, behind: np.ndarray, t: Fraction) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs of texts of one part with the number of their events and the number they need in all parts, in blocks; a
    pair may come in several blocks."""
    code = size & _CODE
    order = np.lexsort((docs, code, keys))
    keys, docs, size, behind, code = keys[order], docs[order], size[order], behind[order], code[order]
    if len(keys):  # copies of a text come once
        once = np.concatenate([[True], (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])])
        keys, docs, size, behind, code = keys[once], docs[once], size[once], behind[once], code[once]
    within = np.arange(_TOP + 1)
    largest = np.searchsorted(SCALE_LOW * t.numerator, SCALE_HIGH * t.denominator, "right") - 1  # by step, that of the largest partner
    place = keys.astype(np.uint64) << np.uint64(16) | code
    at = np.nonzero((behind & _FLAG) == 0)[0]
    end = np.searchsorted(place, keys[at].astype(np.uint64) << np.uint64(16) | np.minimum(largest, within[-1])[code[at]].astype(np.uint64), "right")
    at, n = at[end - at > 1], (end - at - 1)[end - at > 1]
    events = np.cumsum(n)
    low, rest, long_lists = SCALE_LOW[code], SCALE_HIGH[behind & _CODE], suffix_length(SCALE_HIGH[code], t)
    takes = (size & _FLAG) == 0
    i = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(events, (events[i - 1] if i else 0) + BLOCK_EVENTS, "right")))
        m = n[i:j]
        a = np.repeat(at[i:j], m)
        b = a + 1 + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        need = least_overlap(low[a], low[b], t)
        common = np.clip(need - np.maximum(long_lists[a], long_lists[b]), 1, COMMON)
        keep = takes[b] & (np.minimum(rest[a], rest[b]) + common >= need) & (docs[a] != docs[b])
        x, y, common = docs[a[keep]], docs[b[keep]], common[keep]
        first, second = np.minimum(x, y), np.maximum(x, y)
        by = np.lexsort((second, first))
        first, second, common = first[by], second[by], common[by]
        edge = np.nonzero(np.append(len(first) > 0, (first[1:] != first[:-1]) | (second[1:] != second[:-1])))[0]
        yield first[edge], second[edge], np.diff(np.append(edge, len(first))), common[edge]
        i = j


def _merge(t: Fraction):
    """Of sorted parts, one after the other, the pairs that are to be verified."""

    def pairs_of(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        for columns in merge_lists(*_entries_of(blobs), t):
            for k in range(0, len(columns[0]), 200_000):
                a, b, n, need = (c[k:k + 200_000] for c in columns)
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n.astype(np.int32)), "need": pa.array(need.astype(np.int32))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blobs = None, []
        for batch in batches:
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if p != part and blobs:
                    yield from pairs_of(blobs)
                    blobs = []
                part = p
                blobs.append(blob)
        if blobs:
            yield from pairs_of(blobs)

    return run


def _verify(width: int, t: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep, similarity = [], []
            for i, (x, y) in enumerate(zip(a, b)):
                if len(held) > 5000:
                    held.clear()
                for h, column in ((x, 2), (y, 3)):
                    if h not in held:
                        held[h] = shingles(batch.column(column)[i].as_py())
                s, l = sorted((held[x], held[y]), key=len)
                found = np.searchsorted(l, s)
                common = int((l[np.minimum(found, len(l) - 1)] == s).sum()) if len(l) else 0
                union = len(s) + len(l) - common
                if common and common * t.denominator >= union * t.numerator:
                    keep.append(i)
                    similarity.append(common / union)
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(similarity, pa.float64())], names=["a", "b", "similarity"])

    return run


def text_rows(df: DataFrame, id_col: str, owner_col: str, text) -> DataFrame:
    """row_id, owner, h (hash of the text), text of the rows with a text."""
    return df.select(F.col(id_col).cast("long").alias("row_id"), F.col(owner_col).cast("string").alias("owner"), text.alias("text")).filter("text IS NOT NULL").select("row_id", "owner", F.xxhash64("text").alias("h"), "text")


def similar_texts(rows: DataFrame, width: int = 3, threshold: Fraction = Fraction(1, 2), cells: int = CELLS) -> DataFrame:
    """Links between different texts: a, b (hashes of the texts, a < b) and similarity, each pair once.

    `rows` has h and text. Two texts are linked if the distinct runs of `width` words that both have are at least
    `threshold` of those that either has. A text under `width` words has no links. Texts may be of any length; they are
    compared whole. An empty table gives no links.
    """
    spark = rows.sparkSession
    chars = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    parts = int(max(1, chars // 13 // PART_ENTRIES))
    frequencies = frequency_classes(rows, width, cells)
    classes = spark.sparkContext.broadcast(frequencies.tobytes())
    entries = rows.select("h", "text").mapInArrow(_short_entries(width, threshold, parts, classes, cells_by_class(frequencies)), "part long, entries binary")
    n = min(parts, MAX_PARTITIONS)
    lists = entries.repartitionById(n, F.pmod("part", F.lit(n)).cast("int")).sortWithinPartitions("part")
    pairs = lists.mapInArrow(_merge(threshold), "a long, b long, n int, need int")
    candidates = shared(pairs.groupBy("a", "b").agg(F.sum("n").alias("n"), F.first("need").alias("need")).filter("n >= need").select("a", "b"))
    wanted = candidates.select(F.col("a").alias("h")).union(candidates.select("b")).distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= MAX_BROADCAST else wanted
    texts = rows.select("h", "text").join(wanted, "h", "left_semi").dropDuplicates(["h"])
    both = (
        candidates.join(texts.select(F.col("h").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("h").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
    )
    return both.mapInArrow(_verify(width, threshold), "a long, b long, similarity double")


def similar_rows(rows: DataFrame, width: int = 3, threshold: Fraction = Fraction(1, 2), cells: int = CELLS) -> DataFrame:
    """id_a, id_b, similarity of every pair of rows (id_a < id_b) of different owners with similar texts, copies
    included; rows without an owner are nobody's and pair with none. For classes instead of pairs see
    `duplicate_groups`."""
    links = similar_texts(rows, width, threshold, cells)
    members = rows.filter("owner IS NOT NULL").select("row_id", "owner", "h")
    left = members.select(F.col("row_id").alias("x"), F.col("owner").alias("ox"), F.col("h").alias("a"))
    right = members.select(F.col("row_id").alias("y"), F.col("owner").alias("oy"), F.col("h").alias("b"))
    between = links.join(left, "a").join(right, "b").filter("ox <> oy").select("x", "y", "similarity")
    copied = rows.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    repeated = once(rows.filter(F.col("owner").isNotNull()).join(copied, "h", "left_semi"), words=F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+")))
    copies = repeated.filter(F.col("words") >= width).select("row_id", "owner", "h")
    same = copies.alias("l").join(copies.alias("r"), (F.col("l.h") == F.col("r.h")) & (F.col("l.row_id") < F.col("r.row_id")) & (F.col("l.owner") != F.col("r.owner"))).select(F.col("l.row_id").alias("x"), F.col("r.row_id").alias("y"), F.lit(1.0).alias("similarity"))
    return between.unionByName(same).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")


def components(links: DataFrame) -> DataFrame:
    """Every linked u with the least member v of its component, itself included.

    Large stars and small stars in turn: a node's larger neighbours, then its smaller ones, are linked to the least of
    the neighbours and itself. Every round is written to the shared folder; rounds grow with the logarithm of the longest
    chain. Neighbours are never gathered in one row; only their least is.
    """
    edges = shared(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())

    def digest(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = None
    while (now := digest(edges)) != before:
        before = now
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = shared(large)
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(root.select("u", F.col("m").alias("v")))
        edges = shared(small.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    roots = edges.select(F.col("v").alias("u"), "v").distinct()
    return edges.unionAll(roots)


def duplicate_groups(rows: DataFrame, width: int = 3, threshold: Fraction = Fraction(1, 2), cells: int = CELLS) -> DataFrame:
    """One row per row: row_id, class_id (least row_id of the rows with this very text), group_id (least class_id
    that links lead to) and n_links (other texts the text is linked to)."""
    links = shared(similar_texts(rows, width, threshold, cells))
    classes = shared(rows.groupBy("h").agg(F.min("row_id").alias("class_id")))
    degree = links.select("a").unionAll(links.select("b")).groupBy(F.col("a").alias("h")).agg(F.count("*").alias("n_links"))
    first, second = classes.select(F.col("h").alias("a"), F.col("class_id").alias("u")), classes.select(F.col("h").alias("b"), F.col("class_id").alias("v"))
    label = components(links.join(first, "a").join(second, "b").select("u", "v")).join(classes, F.col("u") == F.col("class_id")).select("h", F.col("v").alias("label"))
    found = classes.join(degree, "h", "left").join(label, "h", "left")
    return rows.select("row_id", "h").join(found, "h").select("row_id", "class_id", F.coalesce("label", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
