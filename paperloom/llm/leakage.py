"""Evaluation passages in a corpus (problem 9).

Near copies of whole items: windows as long as the item. An item and a document's window have 64-bit SimHashes of their
word runs; the bits are cut into blocks, and a window within the radius of an item differs in at least one block by no
more than the radius allows a block, so tables of the items' blocks with that many bits changed pass every fingerprint
within it. What passes is compared, and what is within the radius is verified by the weighted similarity of word
shingles. Items are grouped by length in steps of a tenth; longer items than a byte counts go in tiles. The radius
follows from the similarity: runs of two passages of similarity 0.8 differ in about 9 of 64 bits.

Parts of items: windows of `width` words, the length that counts as leaked. They are similar if the weighted similarity
of their shingles is at least `least`. Such windows share a shingle, so an index of the items' shingles finds every
pair: of a document's window only those shingles are looked up that together weigh more than the part that may differ,
and only if all its shingles that occur in items weigh enough. (One word of 13 replaced flips about 7 bits of a SimHash,
so fingerprints can't find them.) With a radius given for parts, their candidates come from SimHashes as well.

The items are a stated query set: they are sent to the tasks in blocks of bounded size, one block at a time, and the
documents are read once per block without any shuffle of their text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
#: Words of items in one block; 2 million make tables of about 60 MB in a task.
BLOCK_WORDS = 2_000_000
#: Words of a shingle.
SHINGLE = 5
#: Item-sized windows: words of a run, bits that two fingerprints may differ in, blocks of bits, step of the lengths and
#: the most words of a window (a counter of a byte passes no more).
RUN, NEAR_RADIUS, NEAR_BLOCKS, STEP, TILE = 3, 14, 4, 1.1, 120
_SPREAD = np.array([sum(((b >> j) & 1) << (8 * j) for j in range(8)) for b in range(256)], dtype=np.uint64)
_ONES = np.uint64(0x0101010101010101)
_HIGH = np.uint64(0x8080808080808080)
_GATHER = np.uint64(0x0102040810204080)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Word numbers and, by number, the word's 64 hash bits spread over eight lanes of eight byte counters."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.lanes = np.zeros((1024, 8), dtype=np.uint64)
        self.hashes = np.zeros(1024, dtype=np.uint64)
        self.letters = np.zeros(1024, dtype=np.int64)

    def forget(self, kept: int) -> None:
        """Only the first `kept` words are kept."""
        self.numbers = {w: n for w, n in self.numbers.items() if n < kept}

    def number(self, words: list[str]) -> np.ndarray:
        known = self.numbers
        out = [known.get(w, -1) for w in words]
        if -1 in out:
            for i, n in enumerate(out):
                if n < 0:
                    out[i] = known.get(words[i], -1)
                    if out[i] < 0:
                        out[i] = self._add(words[i])
        return np.array(out, dtype=np.int64)

    def _add(self, word: str) -> int:
        n = len(self.numbers)
        if n == len(self.lanes):
            self.lanes = np.concatenate([self.lanes, np.zeros_like(self.lanes)])
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
        h = xxhash.xxh64_intdigest(word)
        self.hashes[n] = h
        self.letters[n] = len(word)
        self.lanes[n] = [_SPREAD[(h >> (8 * k)) & 255] for k in range(8)]
        self.numbers[word] = n
        return n


def simhashes(lanes: np.ndarray, width: int) -> np.ndarray:
    """SimHash of each window of `width` (under 128) words; lanes has a row of eight counter words per word."""
    total = np.zeros((len(lanes) + 1, 8), dtype=np.uint64)
    np.cumsum(lanes, axis=0, out=total[1:])
    counts = total[width:] - total[:-width]  # exact in each byte: sums are modulo 2^64 and no counter passes 127
    bits = ((counts + _ONES * np.uint64(128 - (width + 1) // 2)) & _HIGH) >> np.uint64(7)
    packed = (bits * _GATHER) >> np.uint64(56)
    shifts = np.arange(0, 64, 8, dtype=np.uint64)
    return np.bitwise_or.reduce(packed << shifts, axis=1)


class RunPrints:
    """SimHashes of all windows of a text's runs, for windows of any length (under 128 runs): the bits of the runs'
    hashes are summed once, a lane of eight byte counters after the other."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.total = np.zeros((8, len(hashes) + 1), dtype=np.uint64)
        for k in range(8):
            np.cumsum(_SPREAD[((hashes >> np.uint64(8 * k)) & np.uint64(255)).astype(np.int64)], out=self.total[k, 1:])

    def __call__(self, width: int) -> np.ndarray:
        n = self.total.shape[1] - width
        out = np.zeros(max(0, n), dtype=np.uint64)
        if n < 1:
            return out
        bits = np.empty(n, dtype=np.uint64)
        for k in range(8):
            np.subtract(self.total[k, width:], self.total[k, :n], out=bits)
            bits += _ONES * np.uint64(128 - (width + 1) // 2)
            bits &= _HIGH
            bits >>= np.uint64(7)
            bits *= _GATHER
            bits >>= np.uint64(56)
            bits <<= np.uint64(8 * k)
            out |= bits
        return out


class BlockIndex:
    """Finds every stored fingerprint within `radius` of a given one by tables over radius + 1 blocks of bits."""

    def __init__(self, prints: np.ndarray, radius: int) -> None:
        self.prints, self.radius = prints, radius
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = []
        for a, b in zip(edges, edges[1:]):
            key = self._key(prints, a, b)
            order = np.argsort(key, kind="stable")
            bits = min(b - a, 22)
            present = np.zeros(1 << bits, dtype=bool)
            present[(key & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
            self.blocks.append((a, b, np.uint64((1 << bits) - 1), present, key[order], order))

    @staticmethod
    def _key(prints: np.ndarray, a: int, b: int) -> np.ndarray:
        return (prints >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)

    def search(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions (query, stored) of all pairs within the radius, each once."""
        pairs = []
        for a, b, low, present, keys, order in self.blocks:
            key = self._key(prints, a, b)
            at = np.nonzero(present[(key & low).astype(np.int64)])[0]
            first, last = np.searchsorted(keys, key[at], "left"), np.searchsorted(keys, key[at], "right")
            n = last - first
            q = np.repeat(at, n)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            s = order[np.repeat(first, n) + within]
            near = np.bitwise_count(prints[q] ^ self.prints[s]) <= self.radius
            pairs.append(q[near].astype(np.int64) * len(self.prints) + s[near])
        both = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        return both // max(1, len(self.prints)), both % max(1, len(self.prints))


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words from each word on."""
    n = max(0, len(hashes) - size + 1)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        key = key * _MULTIPLIER + hashes[k:k + n]
        key ^= key >> np.uint64(29)
    return key


def window_lengths() -> list[int]:
    out = [RUN + 1]
    while out[-1] < TILE:
        out.append(min(TILE, max(out[-1] + 1, int(out[-1] * STEP))))
    return out


class NearIndex:
    """Items by length of window: fingerprints of their tiles, and by block the keys within the block's share of the
    radius."""

    def __init__(self, items: list[list[str]], vocabulary: Vocabulary, radius: int = NEAR_RADIUS, blocks: int = NEAR_BLOCKS) -> None:
        self.radius = radius
        lengths = np.array(window_lengths())
        tiles: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for n, words in enumerate(items):
            if len(words) < RUN + 1:
                continue
            parts = -(-len(words) // TILE)
            each = len(words) // parts
            width = int(lengths[np.searchsorted(lengths, each, "right") - 1])
            hashes = run_hashes(vocabulary.hashes[vocabulary.number(words)], RUN)
            for k in range(parts):
                tiles[width].append((n, k * each, int(RunPrints(hashes[k * each:k * each + width - RUN + 1])(width - RUN + 1)[0])))
        # Of each item its distinct shingles' hashes, sorted, with their letters.
        self.shingles = [self.weighed(vocabulary, vocabulary.number(words)) for words in items]
        self.edges = np.linspace(0, 64, blocks + 1).astype(int)
        self.by_width = []
        for width, own in sorted(tiles.items()):
            prints = np.array([x[2] for x in own], dtype=np.uint64)
            self.by_width.append((width, own, prints, [self._near(prints, a, b, radius // blocks) for a, b in zip(self.edges, self.edges[1:])]))

    @staticmethod
    def weighed(vocabulary: Vocabulary, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = run_hashes(vocabulary.hashes[numbers], SHINGLE)
        letters = np.concatenate([[0], np.cumsum(vocabulary.letters[numbers])])
        keys, at = np.unique(keys, return_index=True)
        return keys, (letters[SHINGLE:] - letters[:-SHINGLE])[at] if len(keys) else np.empty(0, np.int64)

    def may_be_similar(self, item: int, keys: np.ndarray, weights: np.ndarray, least: float) -> bool:
        """Whether the window of these shingles is similar enough by their hashes."""
        own, own_weights = self.shingles[item]
        if not len(own) or not len(keys):
            return True  # too short for shingles: the words decide
        keys, at = np.unique(keys, return_index=True)
        weights = weights[at]
        place = np.minimum(np.searchsorted(own, keys), len(own) - 1)
        common = int(weights[own[place] == keys].sum())
        return common >= least * (int(weights.sum()) + int(own_weights.sum()) - common) * (1 - 1e-9)

    @staticmethod
    def _near(prints: np.ndarray, a: int, b: int, changed: int) -> np.ndarray:
        keys = np.unique((prints >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1))
        for _ in range(changed):
            keys = np.unique(np.concatenate([keys, *(keys ^ np.uint64(1 << k) for k in range(b - a))]))
        present = np.zeros(1 << (b - a), dtype=bool)
        present[keys.astype(np.int64)] = True
        return present

    def search(self, runs: RunPrints, n_words: int) -> Iterator[tuple[np.ndarray, int, tuple[int, int, int]]]:
        """Positions of the windows within the radius of a tile, the window's words and the tile (item, offset, print)."""
        for width, own, prints, present in self.by_width:
            if n_words < width:
                break
            of = runs(width - RUN + 1)
            may = np.zeros(len(of), dtype=bool)
            for (a, b), keys in zip(zip(self.edges, self.edges[1:]), present):
                may |= keys[((of >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)).astype(np.int64)]
            at = np.nonzero(may)[0]
            passing = of[at]
            for k in range(len(prints)):
                near = at[np.bitwise_count(passing ^ prints[k]) <= self.radius]
                if len(near):
                    yield near, width, own[k]


class ShingleIndex:
    """Finds every stored window whose shingle similarity with a given one is at least `least`."""

    def __init__(self, numbers: list[np.ndarray], vocabulary: Vocabulary, width: int, least: float, size: int = SHINGLE) -> None:
        """numbers: of each text of at least `width` words its word numbers; windows count through all texts."""
        self.least, self.size, self.per = least, min(size, width), width - min(size, width) + 1
        keys, at, first = [], [], 0
        for n in numbers:
            key = self._keys(n, vocabulary)
            starts = np.arange(len(key) - self.per + 1)
            keys.append(np.lib.stride_tricks.sliding_window_view(key, self.per).ravel())
            at.append(np.repeat(first + starts, self.per))
            first += len(starts)
        key, window = (np.concatenate(x) if x else np.empty(0, kind) for x, kind in ((keys, np.uint64), (at, np.int64)))
        order = np.lexsort((window, key))
        key, window = key[order], window[order]
        once = np.ones(len(key), dtype=bool)
        once[1:] = (key[1:] != key[:-1]) | (window[1:] != window[:-1])
        self.windows = window[once]
        self.keys, self.first, self.counts = np.unique(key[once], return_index=True, return_counts=True)
        self.present = np.zeros(1 << 22, dtype=bool)
        self.present[(self.keys & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def _keys(self, numbers: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
        return run_hashes(vocabulary.hashes[numbers], self.size)

    def search(self, numbers: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """Positions (query, stored) of pairs that include all similar ones, each once; queries start at each word."""
        none = np.empty(0, np.int64)
        key = self._keys(numbers, vocabulary)
        maybe = np.nonzero(self.present[(key & np.uint64((1 << 22) - 1)).astype(np.int64)])[0]
        if not len(maybe) or not len(self.keys) or len(key) < self.per:
            return none, none
        slot = np.minimum(np.searchsorted(self.keys, key[maybe]), len(self.keys) - 1)
        stored = np.full(len(key), -1)
        stored[maybe] = np.where(self.keys[slot] == key[maybe], slot, -1)
        total = np.concatenate([[0], np.cumsum(stored >= 0)])
        at = np.nonzero(total[self.per:] > total[:-self.per])[0]
        if not len(at):
            return none, none
        # A shingle counts once in a window: where it occurs first.
        order = np.argsort(key, kind="stable")
        before = np.full(len(key), -1)
        equal = key[order[1:]] == key[order[:-1]]
        before[order[1:][equal]] = order[:-1][equal]
        letters = np.concatenate([[0], np.cumsum(vocabulary.letters[numbers])])
        weights = letters[self.size:] - letters[:-self.size]
        places = at[:, None] + np.arange(self.per)
        weight = weights[places] * (before[places] < at[:, None])
        known = stored[places] >= 0
        all_of = weight.sum(axis=1)
        enough = (weight * known).sum(axis=1) >= self.least * all_of * (1 - 1e-9)
        at, places, weight, known, all_of = at[enough], places[enough], weight[enough], known[enough], all_of[enough]
        # Shingles by number of stored windows, those in none first, until they weigh more than what may differ.
        slots = stored[places]
        number = np.where(weight == 0, np.iinfo(np.int64).max, np.where(known, self.counts[slots], 0))
        order = np.argsort(number, axis=1, kind="stable")
        weight, slots = np.take_along_axis(weight, order, 1), np.take_along_axis(slots, order, 1)
        earlier = np.cumsum(weight, axis=1) - weight
        look = (earlier <= (1 - self.least) * all_of[:, None] * (1 + 1e-9)) & (weight > 0) & (slots >= 0)
        row, column = np.nonzero(look)
        slot = slots[row, column]
        n = self.counts[slot]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        s = self.windows[np.repeat(self.first[slot], n) + within]
        both = np.unique(np.repeat(at[row], n) * (self.windows.max() + 1) + s)
        return both // (self.windows.max() + 1), both % (self.windows.max() + 1)


def shingle_similarity(a: tuple[str, ...], b: tuple[str, ...], size: int = SHINGLE) -> float:
    """Weighted Jaccard similarity of the word shingles of two windows; a shingle weighs as many as its letters."""
    x, y = ({w[i:i + size] for i in range(max(1, len(w) - size + 1))} for w in (a, b))
    weigh = lambda s: sum(len(w) for sh in s for w in sh)
    union = weigh(x | y)
    return weigh(x & y) / union if union else 1.0


class _Index:
    """A block of items as the tasks use it."""

    def __init__(self, items: list[tuple[int, list[str]]], width: int, radius: int | None, least: float) -> None:
        self.items, self.vocabulary = items, Vocabulary()
        self.windows, stated = [], []
        for n, (_, words) in enumerate(items):
            if len(words) >= width:
                stated.append(self.vocabulary.number(words))
                self.windows += [(n, i) for i in range(len(words) - width + 1)]
        if radius is None:
            self.parts = ShingleIndex(stated, self.vocabulary, width, least)
        else:
            prints = [simhashes(self.vocabulary.lanes[n], width) for n in stated]
            self.parts = BlockIndex(np.concatenate(prints) if prints else np.empty(0, np.uint64), radius)
        self.near = NearIndex([w for _, w in items], self.vocabulary)
        self.base = len(self.vocabulary.numbers)


_HELD: dict[tuple, _Index] = {}


def _matcher(block, key: int, width: int, radius: int | None, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = (key, width, radius, least)
        if asked not in _HELD:
            _HELD.clear()
            _HELD[asked] = _Index(block.value, width, radius, least)
        index = _HELD[asked]
        items, vocabulary, windows = index.items, index.vocabulary, index.windows

        def found(ids: list[int], docs: list[list[str]]) -> dict[tuple[int, int], list]:
            numbers = vocabulary.number([w for d in docs for w in d])
            owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
            start = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
            best: dict[tuple[int, int], list] = defaultdict(lambda: [0, 0.0, 0, 0.0])
            if len(numbers) >= width and len(windows):
                q, s = index.parts.search(numbers, vocabulary) if radius is None else index.parts.search(simhashes(vocabulary.lanes[numbers], width))
                same = owner[q] == owner[q + width - 1]
                for i, j in zip(q[same].tolist(), s[same].tolist()):
                    d, (n, k) = owner[i], windows[j]
                    item, words = items[n]
                    at = i - start[d]
                    mine, theirs = tuple(docs[d][at:at + width]), tuple(words[k:k + width])
                    exact = mine == theirs
                    similarity = 1.0 if exact else shingle_similarity(mine, theirs)
                    if similarity >= least:
                        x = best[ids[d], item]
                        x[0], x[1], x[2] = x[0] + 1, max(x[1], similarity), x[2] + exact
            if len(numbers) > RUN:
                runs = RunPrints(run_hashes(vocabulary.hashes[numbers], RUN))
                keys = run_hashes(vocabulary.hashes[numbers], SHINGLE)
                letters = np.concatenate([[0], np.cumsum(vocabulary.letters[numbers])])
                weights = letters[SHINGLE:] - letters[:-SHINGLE]
                for at, long, (n, offset, _) in index.near.search(runs, len(numbers)):
                    item, words = items[n]
                    for i in at[owner[at] == owner[at + long - 1]].tolist():
                        d = owner[i]
                        first = max(start[d], i - offset)
                        last = max(first, min(first + len(words), start[d + 1]) - SHINGLE + 1)
                        if not index.near.may_be_similar(n, keys[first:last], weights[first:last], least):
                            continue
                        first -= start[d]
                        similarity = shingle_similarity(tuple(docs[d][first:first + len(words)]), tuple(words))
                        if similarity >= least:
                            x = best[ids[d], item]
                            x[3] = max(x[3], similarity)
            if len(vocabulary.numbers) > index.base + 1_000_000:
                vocabulary.forget(index.base)  # words of documents only serve their group
            return best

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            group, docs, size = [], [], 0
            out: list[tuple] = []
            for n, (i, text) in enumerate(zip(ids, texts)):
                words = WORD.findall((text.as_py() or "").lower())
                if len(words) >= min(width, RUN + 1):
                    group.append(i)
                    docs.append(words)
                    size += len(words)
                if docs and (size > 50_000 or n == len(ids) - 1):
                    out += [(*key, *x) for key, x in found(group, docs).items()]
                    group, docs, size = [], [], 0
            if docs:
                out += [(*key, *x) for key, x in found(group, docs).items()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([x[0] for x in out], pa.int64()), "item_id": pa.array([x[1] for x in out], pa.int64()),
                "n_windows": pa.array([x[2] for x in out], pa.int64()), "similarity": pa.array([x[3] for x in out], pa.float64()), "n_exact": pa.array([x[4] for x in out], pa.int64()),
                "item_similarity": pa.array([x[5] for x in out], pa.float64()),
            })

    return run


def leaked_items(documents: DataFrame, items: DataFrame, width: int = 13, radius: int | None = None, least: float = 0.8, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Documents and the items that they leak: doc_id, item_id, n_windows, similarity, n_exact, item_similarity.

    n_windows counts pairs of windows of `width` words whose similarity is at least `least` (above 0, at most 1),
    similarity is the best of them, n_exact those of identical words. All such pairs are found; with a radius only those
    within it, which include all of identical words, since equal windows have equal fingerprints. item_similarity is the
    best similarity of a window of the item's length with the item, 0 if none within the fingerprints' radius reaches
    `least`. Words are runs of letters and digits in lower case. Null texts share nothing, texts under `width` words no
    windows; an item id or document id that occurs twice with other texts is compared with each (rows of one id are then
    repeated); other columns are ignored.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    spark = documents.sparkSession
    stated = items.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    words = F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+")).cast("long")
    n_blocks = max(1, -(-(stated.agg(F.sum(words)).first()[0] or 0) // BLOCK_WORDS))
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for n in range(n_blocks):
        own = stated.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == n).toLocalIterator() if n_blocks > 1 else stated.toLocalIterator()
        block = spark.sparkContext.broadcast([(item, WORD.findall(text.lower())) for item, text in own])  # about BLOCK_WORDS words
        part = rows.mapInArrow(_matcher(block, block._jbroadcast.id(), width, radius, least), "doc_id long, item_id long, n_windows long, similarity double, n_exact long, item_similarity double")
        out = part if out is None else out.unionByName(part)
    return out
