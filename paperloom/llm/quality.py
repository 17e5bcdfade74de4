"""Statistics of a text's form and what they say about it (problem 10).

The statistics are column expressions. A Gaussian mixture with diagonal covariances is fitted to the standardised
statistics of all documents by expectation-maximisation: every iteration is one pass over the small table of
statistics whose tasks return sums of a fixed size. Components are named by labelled examples.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.repeated_lines import SPACE
from paperloom.session import shared

WORDS = r"[\p{L}\p{N}]+"
#: Statistics that the mixture is fitted to, all in the order of the fit.
FEATURES = ("common_share", "mean_word_length", "symbol_share", "punctuated_share", "digit_share", "distinct_share", "long_line_share", "sentence_share", "word_share")
#: Labelled documents that name the components, at most (by a hash of their id).
MAX_LABELS = 20_000
#: Passes that look for centres to start from, and centres that each adds.
SEED_ROUNDS, ROUND_SEEDS = 4, 40
#: Common words, a short list by their nature; a longer one is refused.
MAX_COMMON_WORDS = 50_000


def text_statistics(df: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `df`: doc_id, n_words, n_lines, and doubles from 0 to 1 (mean_word_length in letters):

    mean_word_length of the runs of letters and digits; symbol_share: characters other than white space that are
    neither letter nor digit, of those other than white space; punctuated_share: non-blank lines that end in . ! ? : ;
    or a closing mark after one, of all non-blank lines; common_share: words in `common_words` (all languages
    together), of all words; digit_share: words with a digit; distinct_share: distinct words over twenty times
    the square root of the number of words, at most 1 (a measure of vocabulary that hardly depends on length);
    long_line_share: characters that stand in lines of at least 50; sentence_share: places where one blank, perhaps
    after a comma, stands between letters, over the words; word_share: letters, of the characters other than white space.
    A null or blank text has zeros throughout. Repeated rows are repeated; other columns are ignored.
    """
    stop = [w for (w,) in common_words.select(F.lower("word")).filter("word IS NOT NULL").distinct().collect()]
    if len(stop) > MAX_COMMON_WORDS:
        raise ValueError(f"more than {MAX_COMMON_WORDS} common words")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("_text"))
    words = F.regexp_extract_all(F.lower("_text"), F.lit(WORDS), F.lit(0))
    rows = rows.select("*", F.inline(F.array(F.struct(words.alias("_w"), F.split("_text", "\n").alias("_l")))))
    n_words, dense = F.size("_w"), F.length(F.regexp_replace("_text", f"{SPACE}+", ""))
    letters = F.length(F.regexp_replace("_text", r"[^\p{L}]+", ""))
    in_words = F.length(F.array_join("_w", ""))
    full = F.filter("_l", lambda x: F.trim(x) != "")
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0)).cast("double")
    total = F.length("_text")
    measured = rows.select(
        "doc_id",
        n_words.cast("long").alias("n_words"), F.size(full).cast("long").alias("n_lines"),
        share(in_words, n_words).alias("mean_word_length"),
        share(F.greatest(dense - in_words, F.lit(0)), dense).alias("symbol_share"),
        share(F.regexp_count("_text", F.lit(r"(?m)[.!?:;…][\"'”’»)\]]*[ \t]*$")), F.size(full)).alias("_punctuated"),
        share(F.size(F.filter("_w", lambda w: w.isin(stop) if stop else F.lit(False))), n_words).alias("common_share"),
        share(F.regexp_count("_text", F.lit(r"\p{L}*\p{N}[\p{L}\p{N}]*")), n_words).alias("digit_share"),
        share(F.size(F.array_distinct("_w")), F.sqrt(n_words.cast("double"))).alias("_spread"),
        share(F.aggregate(F.col("_l"), F.lit(0), lambda acc, x: acc + F.when(F.length(x) >= 50, F.length(x)).otherwise(F.lit(0))), total).alias("long_line_share"),
        share(F.regexp_count("_text", F.lit(r"\p{L}[,;]? \p{L}")), n_words).alias("sentence_share"),
        share(letters, F.greatest(dense, F.lit(1))).alias("word_share"),
    )
    return measured.select("doc_id", "n_words", "n_lines", "mean_word_length", "symbol_share", F.least(F.col("_punctuated"), F.lit(1.0)).alias("punctuated_share"), "common_share", F.least(F.col("digit_share"), F.lit(1.0)).alias("digit_share"), F.least(F.col("_spread") / 20, F.lit(1.0)).alias("distinct_share"), "long_line_share", "sentence_share", "word_share")


@dataclass(frozen=True)
class Mixture:
    """A fitted mixture over standardised statistics; `names` has the label of each component."""

    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    names: tuple[str, ...] = ()

    def standard(self, x: np.ndarray) -> np.ndarray:
        return (x - self.center) / self.scale

    def log_density(self, z: np.ndarray) -> np.ndarray:
        """Log of weight times density, a column per component."""
        out = np.empty((len(z), len(self.weights)))
        for k, (w, m, v) in enumerate(zip(self.weights, self.means, self.variances)):
            out[:, k] = np.log(max(w, 1e-300)) - 0.5 * (np.log(2 * np.pi * v).sum() + ((z - m) ** 2 / v).sum(axis=1))
        return out

    def posterior(self, x: np.ndarray) -> np.ndarray:
        d = self.log_density(self.standard(x))
        p = np.exp(d - d.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(batch.schema.get_field_index(f)).to_numpy(zero_copy_only=False) for f in FEATURES]).astype(float) if batch.num_rows else np.empty((0, len(FEATURES)))


def _sums(model: Mixture):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, d = model.means.shape
        total = np.zeros((k, 1 + 2 * d))
        likelihood = 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            z = model.standard(_matrix(batch))
            dens = model.log_density(z)
            top = dens.max(axis=1, keepdims=True)
            p = np.exp(dens - top)
            s = p.sum(axis=1, keepdims=True)
            likelihood += float((np.log(s) + top).sum())
            p /= s
            total += np.column_stack([p.sum(axis=0), p.T @ z, p.T @ (z * z)])
        flat = [*total.ravel().tolist(), likelihood]
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(flat)), pa.int32()), "v": pa.array(flat, pa.float64())})

    return run


def _distances(z: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((z[:, None, :] - centres[None]) ** 2).sum(axis=2)


def _far_rows(center: np.ndarray, scale: np.ndarray, centres: np.ndarray, n: int):
    """The task's n rows with the largest keys, where a row's key is a random number (from its hash) to the power of one
    over its squared distance from the nearest centre: a sample without replacement in proportion to that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = np.empty(0), np.empty((0, len(FEATURES)))
        for batch in batches:
            x = _matrix(batch)
            for i in range(0, len(x), 5000):
                z = (x[i:i + 5000] - center) / scale
                far = _distances(z, centres).min(axis=1)
                u = ((batch.column(0).to_numpy()[i:i + 5000].view(np.uint64) >> np.uint64(11)).astype(float) + 1) / 2.0**53
                key = np.where(far > 1e-9, np.log(u) / np.maximum(far, 1e-9), -np.inf)
                keys, rows = np.concatenate([keys, key]), np.concatenate([rows, z])
                top = np.argsort(-keys, kind="stable")[:n]
                keys, rows = keys[top], rows[top]
        good = np.isfinite(keys)
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys[good], pa.float64()), "z": pa.array(rows[good].tolist(), pa.list_(pa.float64()))})

    return run


def _counts(center: np.ndarray, scale: np.ndarray, centres: np.ndarray):
    """Rows nearest to each centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(centres))
        for batch in batches:
            x = _matrix(batch)
            for i in range(0, len(x), 5000):
                total += np.bincount(_distances((x[i:i + 5000] - center) / scale, centres).argmin(axis=1), minlength=len(centres))
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "v": pa.array(total, pa.float64())})

    return run


def starting_centres(stats: DataFrame, center: np.ndarray, scale: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres and the shares of the rows that are nearest to them.

    All rows are looked at: every round samples rows in proportion to their squared distance from the centres so far,
    so a kind that is far from all others gets a centre however rare it is; then the candidates, weighted by the rows
    nearest to each, are reduced to `components` that are far from each other and moved to their means.
    """
    hashed = stats.select(F.xxhash64("doc_id", *FEATURES).alias("h"), *FEATURES)
    centres = np.zeros((1, len(FEATURES)))
    for _ in range(SEED_ROUNDS):
        found = hashed.mapInArrow(_far_rows(center, scale, centres, ROUND_SEEDS), "key double, z array<double>").orderBy(F.desc("key"), "z").limit(ROUND_SEEDS).select("z").collect()
        if not found:
            break
        centres = np.concatenate([centres, np.array([r["z"] for r in found])])
    weights = np.zeros(len(centres))
    for i, v in hashed.mapInArrow(_counts(center, scale, centres), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        weights[i] = v
    centres, weights = centres[weights > 0], weights[weights > 0]
    chosen = [int(np.argmin((centres**2).sum(axis=1)))]
    near = _distances(centres, centres[chosen]).min(axis=1)
    while len(chosen) < min(components, len(centres)) and near.max() > 1e-9:
        chosen.append(int(np.argmax(near)))
        near = np.minimum(near, _distances(centres, centres[chosen[-1:]])[:, 0])
    means = centres[chosen]
    for _ in range(5):  # far centres may be outliers
        own = _distances(centres, means).argmin(axis=1)
        means = np.array([np.average(centres[own == c], axis=0, weights=weights[own == c]) if (own == c).any() else means[c] for c in range(len(means))])
    own = _distances(centres, means).argmin(axis=1)
    return means, np.bincount(own, weights=weights, minlength=len(means)) / weights.sum()


def fit_mixture(stats: DataFrame, components: int = 10, iterations: int = 25, tolerance: float = 1e-3, floor: float = 0.02) -> Mixture | None:
    """Expectation-maximisation over all rows of `stats`; null if there are none.

    Starts from `starting_centres`. Stops when the mean log-likelihood gains less than `tolerance`. `floor` is the least
    variance of a standardised statistic.
    """
    first = stats.agg(*[F.avg(f).alias(f"m_{f}") for f in FEATURES], *[F.stddev_pop(f).alias(f"s_{f}") for f in FEATURES], F.count("*").alias("n")).first()
    if not first["n"]:
        return None
    center = np.array([first[f"m_{f}"] for f in FEATURES])
    scale = np.array([max(first[f"s_{f}"], 1e-6) for f in FEATURES])
    means, shares = starting_centres(stats, center, scale, components)
    k, d = means.shape
    model = Mixture(center, scale, shares + 1e-3, means, np.full((k, d), 0.5))
    before = -np.inf
    for _ in range(iterations):
        rows = stats.select(*FEATURES).mapInArrow(_sums(model), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        flat = np.zeros(k * (1 + 2 * d) + 1)
        for i, v in rows:
            flat[i] = v
        total, likelihood = flat[:-1].reshape(k, 1 + 2 * d), flat[-1] / first["n"]
        mass = np.maximum(total[:, :1], 1e-9)
        means = total[:, 1:1 + d] / mass
        model = Mixture(center, scale, total[:, 0] / first["n"], means, np.maximum(total[:, 1 + d:] / mass - means**2, floor))
        if likelihood - before < tolerance:
            break
        before = likelihood
    return model


def name_components(model: Mixture, stats: DataFrame, labels: DataFrame) -> Mixture:
    """Each component gets the label with the largest sum of posteriors among the labelled documents, per label in
    proportion to the label's number of documents; without any weight, the label of the nearest named component. At
    most MAX_LABELS labelled documents are used."""
    known = stats.join(labels.select(F.col("doc_id").cast("long"), "label").filter("label IS NOT NULL"), "doc_id").select("label", *FEATURES)
    sample = known.orderBy(F.xxhash64("label", *FEATURES), "label").limit(MAX_LABELS).toPandas()
    if sample.empty:
        return Mixture(model.center, model.scale, model.weights, model.means, model.variances, tuple(["prose"] * len(model.weights)))
    p = model.posterior(sample[list(FEATURES)].to_numpy(float))
    kinds = sorted(sample["label"].unique())
    mass = np.array([p[(sample["label"] == k).to_numpy()].sum(axis=0) for k in kinds])
    named = [kinds[int(mass[:, c].argmax())] if mass[:, c].sum() > 0.5 else None for c in range(p.shape[1])]
    have = [c for c, n in enumerate(named) if n]
    near = lambda c: min(have, key=lambda o: ((model.means[c] - model.means[o]) ** 2).sum()) if have else None
    final = tuple(n or (named[near(c)] if have else "prose") for c, n in enumerate(named))
    return Mixture(model.center, model.scale, model.weights, model.means, model.variances, final)


def _classes(model: Mixture):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = sorted(set(model.names))
        for batch in batches:
            p = model.posterior(_matrix(batch)) if batch.num_rows else np.empty((0, len(model.names)))
            by_kind = np.column_stack([p[:, [c for c, n in enumerate(model.names) if n == k]].sum(axis=1) for k in kinds])
            best = by_kind.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([kinds[b] for b in best], pa.string()), pa.array(by_kind.max(axis=1) if len(best) else [], pa.float64())], names=["doc_id", "kind", "confidence"])

    return run


def classify_form(stats: DataFrame, labels: DataFrame, components: int = 10) -> DataFrame:
    """doc_id, kind (prose, list, table or junk) and confidence of each row of `text_statistics`, by the mixture."""
    held = shared(stats)
    model = fit_mixture(held, components)
    if model is None:
        return held.select("doc_id", F.lit("").alias("kind"), F.lit(0.0).alias("confidence"))
    model = name_components(model, held, labels)
    return held.select("doc_id", *FEATURES).mapInArrow(_classes(model), "doc_id long, kind string, confidence double")
