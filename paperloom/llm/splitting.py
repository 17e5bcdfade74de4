"""Splitting texts over a size limit at natural boundaries with overlap (problem 2).

Recursive bisection: a span over the limit is cut at the strongest boundary near its middle, halves that still exceed
the limit less the overlap are cut again, and every piece but the first then gets the tokens before it. Sizes are
counted in the scan's stage and only oversized rows reach Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.repeated_lines import PY_SPACE

#: White space to str.split, not to Unicode.
SEPARATORS = re.compile("[\x1c-\x1f]")
_TOKEN = re.compile(PY_SPACE.replace("[", "[^", 1) + "+")
_SENTENCE = re.compile(r"[.!?…][\"'”’»)\]]*\Z")
_CLAUSE = re.compile(r"[,;:—–][\"'”’»)\]]*\Z")

PIECES = "tbl string, row_id long, piece_no int, n_pieces int, token_start long, token_end long, overlap int, page_start long, page_end long, text string"


def boundary_strengths(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """Strength of the boundary before token i (i from 1): 5 blank line, 4 line end after a sentence, 3 sentence end,
    2 clause end, 1 line end, 0 white space."""
    out = [0]
    for (start, end), (nxt, _) in zip(spans, spans[1:]):
        gap, tail = text[end:nxt], text[max(start, end - 4):end]
        lines = gap.count("\n")
        if lines > 1:
            out.append(5)
        elif _SENTENCE.search(tail):
            out.append(4 if lines else 3)
        elif _CLAUSE.search(tail):
            out.append(2)
        else:
            out.append(1 if lines else 0)
    return out


def bisect(strengths: list[int], limit: int) -> list[int]:
    """Starts of the pieces of tokens 0..len(strengths)-1, none longer than `limit` (at least 1)."""
    cuts, todo = [], [(0, len(strengths))]
    while todo:
        a, b = todo.pop()
        if b - a <= limit:
            cuts.append(a)
            continue
        middle, reach = (a + b) // 2, max(1, (b - a) // 4)
        best = max(range(max(a + 1, middle - reach), min(b, middle + reach + 1)), key=lambda i: (strengths[i], -abs(i - middle)))
        todo += [(best, b), (a, best)]
    return cuts


def pieces_of(text: str, target: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """(token_start, token_end, overlap, text) of each piece. Texts within the target give one piece. Without their
    overlaps the pieces put together are the text, character by character. The overlap is at most target - 1."""
    target = max(1, target)
    overlap = max(0, min(overlap, target - 1))
    spans = [m.span() for m in _TOKEN.finditer(text)]
    if len(spans) <= target:
        return [(0, len(spans), 0, text)]
    starts = bisect(boundary_strengths(text, spans), target - overlap)
    out = []
    for k, a in enumerate(starts):
        b = starts[k + 1] if k + 1 < len(starts) else len(spans)
        back = min(overlap, a) if k else 0
        left = spans[a - back][0] if k else 0
        right = spans[b][0] if b < len(spans) else len(text)
        out.append((a - back, b, back, text[left:right]))
    return out


def has_more_tokens(text: str, n: int) -> bool:
    """Whether the text has more than n tokens."""
    if SEPARATORS.search(text):
        return sum(1 for _ in _TOKEN.finditer(text)) > n
    return len(text.split()) > n


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("tbl", pa.string()), ("row_id", pa.int64()), ("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("token_start", pa.int64()), ("token_end", pa.int64()), ("overlap", pa.int32()), ("page_start", pa.int64()), ("page_end", pa.int64()), ("text", pa.string())])
    for batch in batches:
        rows = []
        target, texts = batch.column("target").to_pylist(), batch.column("text").to_pylist()
        big = [i for i, (n, text) in enumerate(zip(target, texts)) if has_more_tokens(text, max(1, n))]
        for r in batch.take(pa.array(big, pa.int64())).to_pylist():
            found = pieces_of(r["text"], r["target"], r["overlap"])
            rows += [
                {"tbl": r["tbl"], "row_id": r["row_id"], "piece_no": i + 1, "n_pieces": len(found), "token_start": a, "token_end": b, "overlap": back, "page_start": r["page_start"], "page_end": r["page_end"], "text": t}
                for i, (a, b, back, t) in enumerate(found)
            ]
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def split_oversized(df: DataFrame, tbl: str, id_col: str, options: DataFrame, page_start: str, page_end: str, text_col: str = "text") -> DataFrame:
    """Pieces of the rows whose text has more tokens (runs of other than white space) than their source's target.

    Columns: tbl, row_id, piece_no (from 1), n_pieces, token_start, token_end (first and behind last token of the row's
    text, overlap included), overlap (tokens repeated from the piece before), page_start, page_end (the row's), text.
    Rows within the target, without text or without a row in `options` give nothing; a null or negative overlap is
    0; a null target exempts the source, one under 1 counts as 1. If `options` repeats a source, its least target and
    overlap count. Repeated rows are split each; other columns are ignored.
    """
    limits = options.groupBy(F.col("source").cast("string").alias("_src")).agg(F.min("target_tokens").cast("int").alias("target"), F.coalesce(F.min("overlap_tokens"), F.lit(0)).cast("int").alias("overlap"))
    rows = df.select(F.lit(tbl).alias("tbl"), F.col(id_col).cast("long").alias("row_id"), F.col("source").cast("string").alias("_src"), F.col(page_start).cast("long").alias("page_start"), F.col(page_end).cast("long").alias("page_end"), F.col(text_col).alias("text"))
    # A row with n tokens has at least 2n - 1 characters, so most rows need no counting; the others are counted in Arrow
    # batches.
    big = rows.join(limits, "_src").filter(F.length("text") >= 2 * F.col("target"))
    return big.select("tbl", "row_id", "page_start", "page_end", "target", "overlap", "text").mapInArrow(_split, PIECES)
