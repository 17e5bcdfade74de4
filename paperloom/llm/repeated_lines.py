"""Lines that a source puts on many of its documents (problem 6).

Pass 1 keeps a mergeable heavy-hitter summary per source and task: counters of lines, from all of which the same amount
is subtracted at the end (a part of the task's documents of the source) and whenever a task holds too many. What was
subtracted bounds the error, so every line over the threshold is among the candidates, and few distinct lines of the
corpus are shuffled. Pass 2 finds where the candidates stand; only those few lines are shuffled, and counted exactly by
distinct document. Confirmed lines are removed with a broadcast of them; where there are too many to broadcast, the
pages are joined with the lines of their source.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import shared

#: Unicode white space, as a class of Java's regular expressions.
SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The same as a class of Python's.
PY_SPACE = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), SPACE)
#: Candidate or confirmed lines that are sent to every task, at most; beyond it they are joined with a shuffle.
MAX_BROADCAST_LINES = 200_000
#: Lines that a task counts before it sends its summaries and begins new ones, and the part of the threshold that a
#: summary may lack.
TASK_LINES = 3_000_000
SLACK = 0.25

_LETTERS = r"[^\W\d_²³¹¼-¾]"
_FOUR_RUNS = re.compile(rf"(?:{_LETTERS}+[\W\d_²³¹¼-¾]+){{3}}{_LETTERS}")
_DIGIT, _DIGITS = re.compile(r"\d"), re.compile(r"\d+")
_SPACES = re.compile(f"{PY_SPACE}+")
_SEPARATORS = re.compile("[\x1c-\x1f]")  # white space to str.split, not to Unicode


def _numbers_as_signs(text: str) -> str:
    low = text.lower()
    return _DIGITS.sub("#", low) if _DIGIT.search(low) else low


def _squeezed(line: str) -> str:
    return _SPACES.sub(" ", line).strip(" ") if _SEPARATORS.search(line) else " ".join(line.split())


def line_form(line: str) -> str:
    """Lower case, `#` for a run of digits, trimmed, one blank for a run of white space."""
    return _squeezed(_numbers_as_signs(line))


def page_forms(text: str) -> list[tuple[int, str]]:
    """Number (from 1) and form of the lines of more than six characters."""
    low = _numbers_as_signs(text)
    lines = low.split("\n")
    if _SEPARATORS.search(low):
        return [(n, _squeezed(x)) for n, x in enumerate(lines, 1) if len(x) > 6]
    return [(n, " ".join(x.split())) for n, x in enumerate(lines, 1) if len(x) > 6]


def eligible_lines(text: str) -> list[tuple[int, str]]:
    """Number (from 1) and form of the lines with at least four runs of letters."""
    low = _numbers_as_signs(text)
    if _SEPARATORS.search(low):
        return [(n, form) for n, form in page_forms(text) if _FOUR_RUNS.search(form)]
    out = []
    for n, x in enumerate(low.split("\n"), 1):
        if len(x) > 6:
            words = x.split()
            # Four words of letters alone have four runs; anything else is looked at in whole.
            if len(words) > 3 and words[0].isalpha() and words[1].isalpha() and words[2].isalpha() and words[3].isalpha():
                out.append((n, " ".join(words)))
                continue
            form = " ".join(words)
            if _FOUR_RUNS.search(form):
                out.append((n, form))
    return out


def line_hash(form: str) -> int:
    return xxhash.xxh64_intdigest(form) - (1 << 63)


def reduce_counters(keys: np.ndarray, counts: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray]:
    """A summary with `cut` subtracted from every counter: counters that have no more are left out."""
    keep = counts > cut
    return keys[keep], counts[keep] - cut


def _summaries(min_share: float):
    """Rows (src, doc, h, n, cut): the source's documents (doc set), its counters (h set) and what was subtracted from
    them (neither set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: dict[str, list[int]] = {}
        docs: dict[str, set[str]] = {}
        held = 0

        def send() -> pa.RecordBatch:
            src, doc, h, n, cuts = [], [], [], [], []
            for s, own in docs.items():
                keys, counts = np.unique(np.array(lines[s], dtype=np.int64), return_counts=True)
                cut = int(SLACK * min_share * len(own))
                keys, counts = reduce_counters(keys, counts, cut)
                k = len(keys)
                src += [s] * (len(own) + k + 1)
                doc += [*own, *[None] * (k + 1)]
                h += [*[None] * len(own), *keys.tolist(), None]
                n += [*[0] * len(own), *counts.tolist(), 0]
                cuts += [*[0] * (len(own) + k), cut]
            lines.clear()
            docs.clear()
            return pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(doc, pa.string()), pa.array(h, pa.int64()), pa.array(n, pa.int64()), pa.array(cuts, pa.int64())], names=["src", "doc", "h", "n", "cut"])

        for batch in batches:
            for s, d, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                own = docs.get(s)
                if own is None:
                    own, lines[s] = docs.setdefault(s, set()), []
                own.add(d)
                if text:
                    found = [line_hash(form) for _, form in eligible_lines(text)]
                    lines[s] += found
                    held += len(found)
                held += 1
                if held > TASK_LINES:
                    yield send()
                    held = 0
        yield send()

    return run


def _occurrences(wanted: dict[str, set[int]] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page, doc, src, no, form, hashes = [], [], [], [], [], []
            for p, d, s, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                own = wanted.get(s, ()) if wanted is not None else None
                if own is not None and not own:
                    continue
                # Candidates are forms of eligible lines, so a line with such a form is eligible.
                for n, f in eligible_lines(text) if own is None else page_forms(text):
                    h = line_hash(f)
                    if own is None or h in own:
                        page.append(p)
                        doc.append(d)
                        src.append(s)
                        no.append(n)
                        form.append(f)
                        hashes.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(page, pa.int64()), pa.array(doc, pa.string()), pa.array(src, pa.string()), pa.array(no, pa.int64()), pa.array(form, pa.string()), pa.array(hashes, pa.int64())], names=["page_id", "doc", "src", "line_no", "form", "h"])

    return run


def repeated_lines(pages: DataFrame, id_col: str = "page_row_id", text_col: str = "text", min_docs: int = 3, min_share: float = 0.08) -> tuple[DataFrame, DataFrame]:
    """The confirmed lines (src, form, n_docs, src_docs) and where they stand (page_id, line_no from 1).

    n_docs are the distinct documents with the line, src_docs those of the source. A line counts if it has at least
    four runs of letters; it is confirmed if at least `min_docs` and at least `min_share` of the source's documents
    have it. Lines are the same if their `line_form` is. A source's documents are counted over all its pages, also
    blank ones. Pages without source or document key neither give lines nor places, those without text no lines; a page
    delivered twice adds nothing to a distinct count and has its places twice; an empty table gives two empty results;
    other columns are ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col("document_key").cast("string").alias("doc"), F.col("source").cast("string").alias("src"), F.col(text_col).alias("text")).filter("src IS NOT NULL AND doc IS NOT NULL")
    summary = rows.select("src", "doc", "text").mapInArrow(_summaries(min_share), "src string, doc string, h long, n long, cut long")
    seen = shared(summary.groupBy("src", "doc", "h").agg(F.sum("n").alias("n"), F.sum("cut").alias("cut")))
    sizes = shared(seen.filter("doc IS NOT NULL").groupBy("src").agg(F.count("*").alias("src_docs")).filter(F.col("src_docs") >= min_docs))
    # What the tasks subtracted is the most that any line's sum can lack.
    errors = seen.filter("doc IS NULL AND h IS NULL").select("src", F.col("cut").alias("err"))
    reach = F.col("n") + F.col("err")
    candidates = shared(seen.filter("h IS NOT NULL").join(errors, "src").join(sizes, "src").filter((reach >= F.col("src_docs") * min_share) & (reach >= min_docs)).select("src", "h"))
    texts = rows.filter("text IS NOT NULL")
    first = candidates.limit(MAX_BROADCAST_LINES + 1).collect()
    few = len(first) <= MAX_BROADCAST_LINES
    wanted: dict[str, set[int]] = {}
    for src, h in first:
        wanted.setdefault(src, set()).add(h)
    places = texts.select("page_id", "doc", "src", "text").mapInArrow(_occurrences(wanted if few else None), "page_id long, doc string, src string, line_no long, form string, h long")
    places = shared(places if few else places.join(candidates, ["src", "h"], "left_semi").select("page_id", "doc", "src", "line_no", "form", "h"))
    counted = places.select("src", "form", "doc").distinct().groupBy("src", "form").agg(F.count("*").alias("n_docs")).join(sizes, "src")
    confirmed = shared(counted.filter((F.col("n_docs") >= min_docs) & (F.col("n_docs") >= F.col("src_docs") * min_share)).select("src", "form", "n_docs", "src_docs"))
    small = F.broadcast(confirmed) if confirmed.count() <= MAX_BROADCAST_LINES else confirmed
    return confirmed, places.join(small, ["src", "form"], "left_semi").select("page_id", "line_no")


class SourceForms:
    """Forms of the confirmed lines by source, sent with the task or, where they are too many, with the rows."""

    def __init__(self, forms: dict[str, object] | None, make=frozenset) -> None:
        self.forms, self.make, self.held = forms, make, {}

    def of(self, src: str | None, listed: pa.Array, at: int):
        """Made from the forms of the source, or null; a row's own list is read once per source and task."""
        if self.forms is not None:
            return self.forms.get(src)
        if src not in self.held:
            if len(self.held) > 1000:
                self.held.clear()
            own = listed[at].as_py()
            self.held[src] = self.make(own) if own else None
        return self.held[src]


def with_forms(rows: DataFrame, confirmed: DataFrame, make=frozenset) -> tuple[DataFrame, SourceForms]:
    """`rows` (with src) with a column `forms`, and the forms for the tasks. Up to MAX_BROADCAST_LINES lines travel with
    the tasks and the column is null; beyond it the rows are joined with their source's lines. A source has few of
    them: a line is on at least a given share of its documents."""
    found = confirmed.select("src", "form").limit(MAX_BROADCAST_LINES + 1).collect()
    if len(found) > MAX_BROADCAST_LINES:
        lists = confirmed.groupBy("src").agg(F.collect_set("form").alias("forms"))
        return rows.join(lists, "src", "left").select(*rows.columns, "forms"), SourceForms(None, make)
    forms: dict[str, set[str]] = {}
    for src, form in found:
        forms.setdefault(src, set()).add(form)
    return rows.withColumn("forms", F.lit(None).cast("array<string>")), SourceForms({s: make(f) for s, f in forms.items()})


def _without(forms: SourceForms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for i, (src, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                own = forms.of(src, batch.column(3), i)
                drop = {n for n, f in eligible_lines(text) if f in own} if own and text else set()
                removed.append(len(drop))
                kept.append("\n".join(x for n, x in enumerate(text.split("\n"), 1) if n not in drop) if drop else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int32()), pa.array(kept, pa.string())], names=["page_id", "n_removed", "text"])

    return run


def without_repeated_lines(pages: DataFrame, confirmed: DataFrame, id_col: str = "page_row_id", text_col: str = "text") -> DataFrame:
    """Every page without its source's confirmed lines: page_id, n_removed, text (null stays null). No page is
    shuffled unless more than MAX_BROADCAST_LINES lines are confirmed."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col("source").cast("string").alias("src"), F.col(text_col).alias("text"))
    listed, forms = with_forms(rows, confirmed)
    return listed.mapInArrow(_without(forms), "page_id long, n_removed int, text string")
