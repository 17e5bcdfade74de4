"""Filling containers of fixed capacity with texts (problem 8).

Only the histogram of sizes decides the packing, so it is planned on the driver over at most `capacity` distinct sizes
with their counts, whatever the number of texts: best fit by decreasing size where equal containers are kept as one
run. The plan is a list of segments (the first to the last text of a size go to a run of containers, q to each); a
text finds its segment by its rank among the texts of its size, which is counted in salted parts so that a size shared
by a third of all texts isn't one task's work.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import shared

#: Pattern of the byte-level vocabulary's pre-tokenizer (a fixed value of the public tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Texts that a salted part of a size holds on average, and containers per step group.
PART_ROWS = 100_000
STEP_CONTAINERS = 64

_ENCODERS: dict[str, object] = {}


def _encoder(path: str):
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODERS[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id and n_tokens of each row by a vocabulary file in rank format, which Spark sends to the executors; null texts
    have 0 tokens."""
    df.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(SparkFiles.get(name)).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


@dataclass
class Segment:
    """Texts of `size` with ranks from `first` on, `count` of them, go to tier containers from `start`, `per` to each."""

    size: int
    first: int
    count: int
    tier: int
    start: int
    per: int


def plan_packing(histogram: dict[int, int], capacities: list[int]) -> tuple[list[Segment], list[int]]:
    """Segments for all texts and the number of containers of each tier.

    `capacities` ascend. Sizes are routed to the smallest tier that holds them and tiers are packed from the largest,
    by decreasing size and best fit; gaps that a larger tier's containers keep are filled from the sizes of shorter
    tiers before those open containers of their own.
    """
    opened = [0] * len(capacities)
    gaps: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # space left: runs of (tier, start, containers)
    spaces: list[int] = []
    segments: list[Segment] = []

    def put(space: int, run: tuple[int, int, int]) -> None:
        if space and run[2]:
            if not gaps[space]:
                insort(spaces, space)
            gaps[space].append(run)

    def fill(size: int, first: int, left: int, space: int, run: tuple[int, int, int]) -> int:
        """Texts placed in a run of containers with `space` left in each."""
        tier, start, n = run
        per = min(space // size, left)
        whole = min(n, left // per)
        segments.append(Segment(size, first, whole * per, tier, start, per))
        put(space - per * size, (tier, start, whole))
        placed, rest = whole * per, left - whole * per
        if whole < n and 0 < rest < per:
            segments.append(Segment(size, first + placed, rest, tier, start + whole, rest))
            put(space - rest * size, (tier, start + whole, 1))
            placed, whole = placed + rest, whole + 1
        put(space, (tier, start + whole, n - whole))
        return placed

    for size in sorted(histogram, reverse=True):
        tier = bisect_left(capacities, size)
        left, first = histogram[size], 0
        while left:
            at = bisect_left(spaces, size)
            if at < len(spaces):
                space = spaces[at]
                run = gaps[space].pop()
                if not gaps[space]:
                    spaces.pop(at)
            else:
                space = capacities[tier]
                per = space // size
                run = (tier, opened[tier], -(-left // per))
                opened[tier] += run[2]
            done = fill(size, first, left, space, run)
            left, first = left - done, first + done
    return segments, opened


def pack(sizes: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """Assigns every text to containers of the given named capacities.

    `sizes` has doc_id and n_tokens. Result, one row per text or piece: container (name), container_no (from 0 within
    the name), step_no, doc_id, piece_no, n_pieces, token_start, n_tokens. Only texts over the largest capacity are
    divided: into full pieces and a rest. Texts without tokens take no space and get container 0 of the smallest
    capacity. Containers are dealt in turn to steps, so runs of equal containers are spread evenly over them. Rows of
    one doc_id are packed each; an empty table gives an empty result; capacities under 1 are refused.
    """
    names = sorted(capacities, key=lambda n: (capacities[n], n))
    caps = [capacities[n] for n in names]
    if not caps or caps[0] < 1:
        raise ValueError("capacities must be at least 1")
    spark = sizes.sparkSession
    largest = caps[-1]
    n_pieces = F.greatest(F.ceil(F.col("n_tokens") / largest), F.lit(1)).cast("int")
    pieces = sizes.select("doc_id", "n_tokens", n_pieces.alias("n_pieces"), F.explode(F.sequence(F.lit(0), n_pieces - 1)).alias("i")).select(
        "doc_id", (F.col("i") + 1).alias("piece_no"), "n_pieces", (F.col("i").cast("long") * largest).alias("token_start"),
        F.least(F.col("n_tokens") - F.col("i").cast("long") * largest, F.lit(largest).cast("long")).alias("size"),
    )
    counts = {s: n for s, n in pieces.groupBy("size").count().collect()}  # at most one entry per size up to the capacity
    segments, opened = plan_packing({s: n for s, n in counts.items() if s > 0}, caps)
    if counts.get(0):
        segments.append(Segment(0, 0, counts[0], 0, 0, counts[0]))
        opened[0] = max(1, opened[0])
    parts = max(1, -(-max(counts.values(), default=1) // PART_ROWS))
    salted = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(parts)).cast("int"))
    if parts > 1:
        before = salted.groupBy("size", "part").count().select("size", "part", F.expr("sum(count) OVER (PARTITION BY size ORDER BY part) - count").alias("before"))
        salted = salted.join(before, ["size", "part"])
    else:
        salted = salted.withColumn("before", F.lit(0).cast("long"))
    ranked = salted.withColumn("rank", F.expr("before + row_number() OVER (PARTITION BY size, part ORDER BY doc_id, piece_no) - 1"))
    plan = spark.createDataFrame([(s.size, s.first, s.first + s.count, names[s.tier], s.start, s.per, max(1, -(-opened[s.tier] // STEP_CONTAINERS))) for s in segments], "size long, first long, last long, container string, start long, per long, steps long")
    placed = ranked.alias("r").join(plan.alias("p"), (F.col("r.size") == F.col("p.size")) & (F.col("r.rank") >= F.col("p.first")) & (F.col("r.rank") < F.col("p.last")))
    number = F.col("start") + F.floor((F.col("rank") - F.col("first")) / F.col("per"))
    return placed.select(
        "container", number.cast("long").alias("container_no"), F.pmod(number, F.col("steps")).cast("long").alias("step_no"),
        "doc_id", "piece_no", "n_pieces", "token_start", F.col("r.size").alias("n_tokens"),
    )


def pack_each(sizes: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """All texts packed once for every capacity, in containers of that capacity only. Texts are tokenized once."""
    held = shared(sizes)
    out = None
    for name in sorted(capacities):
        part = pack(held, {name: capacities[name]})
        out = part if out is None else out.unionByName(part)
    return out


def pack_tiers_of_each(sizes: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """All texts packed once for every capacity as the largest (`plan` is its name): each text is routed to the smallest
    of the tiers up to it that holds it, and gaps of longer containers are filled from shorter tiers. Texts are
    tokenized once."""
    held = shared(sizes)
    out = None
    for name in sorted(capacities, key=lambda n: (capacities[n], n)):
        part = pack(held, {n: c for n, c in capacities.items() if c <= capacities[name]}).select(F.lit(name).alias("plan"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def packing_summary(packed: DataFrame) -> DataFrame:
    """Containers, texts, pieces, tokens and steps per container name, and plan where there are several."""
    return packed.groupBy(*(["plan"] if "plan" in packed.columns else []), "container").agg(
        F.countDistinct("container_no").alias("n_containers"), F.countDistinct("doc_id").alias("n_texts"), F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"),
        (F.max("step_no") + 1).alias("n_steps"),
    )
