"""Ranked full-text search: match syntax, BM25, snippets, shaping.

Index rows hold the folded tokens of title and body. A query is parsed on the driver to phrases and an expression over
them; per row a phrase's occurrences are counted in the token arrays, so matching and scoring need no shuffle: one scan
aggregates the corpus statistics to a single row, another scores and keeps the top k.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import once, tokenize

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
SNIPPET_TOKENS = 32
COLUMNS = ("title", "body")


class InvalidRequest(ValueError):
    """The request can't be served as it is; nothing was done."""


# --- match syntax -----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    prefix: bool = False
    columns: tuple[str, ...] = COLUMNS


@dataclass(frozen=True)
class Match:
    """kind: phrase, and, or, not, near."""

    kind: str
    parts: tuple = ()
    distance: int = 10

    def scored(self) -> list[tuple[Phrase, tuple[Match, ...]]]:
        """Phrases that count for the score, repeated ones each, and the alternatives that must match for them to
        count; the right side of NOT doesn't."""
        if self.kind == "phrase":
            return [(self.parts[0], ())]
        parts = self.parts[:1] if self.kind == "not" else self.parts
        own = [(part, (part,) if self.kind == "or" and part.kind != "phrase" else ()) for part in parts]
        return [(p, outer + inner) for part, outer in own for p, inner in part.scored()]


_LEX = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([(){}:*+,])|(-)|([^\s"(){}:*+,\-]+))')
_BAREWORD = re.compile(r"[\w\x1a]+\Z")
_WORDS = re.compile(r"[^\W_]+")


@dataclass
class _Parser:
    text: str
    words: list = field(default_factory=list)
    at: int = 0

    def parse(self) -> Match:
        pos = 0
        while pos < len(self.text.rstrip()):
            m = _LEX.match(self.text, pos)
            if not m:
                raise InvalidRequest(f"the query has an unbalanced quote: {self.text!r}")
            quoted, sign, minus, bare = m.groups()
            if bare is not None and not _BAREWORD.match(bare):
                raise InvalidRequest(f"the query has a character that must be quoted: {bare!r}")
            self.words.append(("quoted", quoted.replace('""', '"')) if quoted is not None else (sign or minus, sign or minus) if sign or minus else ("bare", bare))
            pos = m.end()
        if not self.words:
            raise InvalidRequest("the query is empty")
        out = self.either()
        if self.at < len(self.words):
            raise InvalidRequest(f"the query can't be read from {self.words[self.at][1]!r} on")
        return out

    def look(self, kind: str, text: str | None = None, ahead: int = 0) -> bool:
        i = self.at + ahead
        return i < len(self.words) and self.words[i][0] == kind and (text is None or self.words[i][1] == text)

    def take(self, kind: str) -> str:
        if not self.look(kind):
            raise InvalidRequest(f"the query lacks {kind!r}")
        self.at += 1
        return self.words[self.at - 1][1]

    def either(self) -> Match:
        parts = [self.both()]
        while self.look("bare", "OR"):
            self.at += 1
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Match("or", tuple(parts))

    def both(self) -> Match:
        out = self.without()
        parts = [out]
        while self.look("bare", "AND"):
            self.at += 1
            parts.append(self.without())
        return parts[0] if len(parts) == 1 else Match("and", tuple(parts))

    def without(self) -> Match:
        out = self.row()
        while self.look("bare", "NOT"):
            self.at += 1
            out = Match("not", (out, self.row()))
        return out

    def row(self) -> Match:
        """Parts one after the other are joined by an implicit AND that binds tightest."""
        parts = [self.part()]
        while self.at < len(self.words) and not (self.look("bare", "AND") or self.look("bare", "OR") or self.look("bare", "NOT") or self.look(")")):
            parts.append(self.part())
        return parts[0] if len(parts) == 1 else Match("and", tuple(parts))

    def part(self) -> Match:
        columns = self.column_filter()
        if self.look("("):
            self.at += 1
            out = self.either()
            self.take(")")
        elif self.look("bare", "NEAR") and self.look("(", ahead=1):
            self.at += 2
            phrases, distance = [self.phrase()], 10
            while not self.look(")") and not self.look(","):
                phrases.append(self.phrase())
            if self.look(","):
                self.at += 1
                number = self.take("bare")
                if not number.isdecimal():
                    raise InvalidRequest("the distance of NEAR must be a number")
                distance = int(number)
            self.take(")")
            out = Match("near", tuple(Match("phrase", (p,)) for p in phrases), distance)
        else:
            out = Match("phrase", (self.phrase(),))
        return _restrict(out, columns) if columns else out

    def column_filter(self) -> tuple[str, ...] | None:
        start, inverse = self.at, False
        if self.look("-"):
            self.at += 1
            inverse = True
        names: list[str] = []
        if self.look("{"):
            self.at += 1
            while self.look("bare"):
                names.append(self.take("bare"))
            self.take("}")
        elif self.look("bare") and self.look(":", ahead=1):
            names.append(self.take("bare"))
        if not names or not self.look(":"):
            if inverse:
                raise InvalidRequest("a hyphen must be quoted")
            self.at = start
            return None
        self.at += 1
        wrong = [n for n in names if n.lower() not in COLUMNS]
        if wrong:
            raise InvalidRequest(f"no such column: {wrong[0]}")
        low = {n.lower() for n in names}
        return tuple(c for c in COLUMNS if (c in low) != inverse)

    def phrase(self) -> Phrase:
        if not (self.look("bare") or self.look("quoted")):
            raise InvalidRequest("the query lacks a word")
        if any(self.look("bare", w) for w in ("AND", "OR", "NOT")):
            raise InvalidRequest("an operator lacks one of its sides")
        words: list[str] = []
        while True:
            self.at += 1
            words += _WORDS.findall(self.words[self.at - 1][1])
            if not self.look("+"):
                break
            self.at += 1
            if not (self.look("bare") or self.look("quoted")):
                raise InvalidRequest("the query lacks a word after +")
        prefix = self.look("*")
        self.at += prefix
        return Phrase(tuple(_fold_word(w) for w in words), prefix)


def _fold_word(word: str) -> str:
    from paperloom.functions.text import _MARKED, _PLAIN

    return word.lower().translate(str.maketrans(_MARKED, _PLAIN))


def _restrict(match: Match, columns: tuple[str, ...]) -> Match:
    if match.kind == "phrase":
        p = match.parts[0]
        return Match("phrase", (Phrase(p.words, p.prefix, tuple(c for c in p.columns if c in columns)),))
    return Match(match.kind, tuple(_restrict(p, columns) for p in match.parts), match.distance)


def parse_match(text: str) -> Match:
    """Match expression: words one after the other (all must occur), AND, OR, NOT, "phrase", prefix*, column : x,
    {columns} : x, NEAR(a b, k), parentheses. Raises InvalidRequest for what can't be read."""
    return _Parser(text).parse()


# --- index ------------------------------------------------------------------------------------------------------


def build_index(rows: DataFrame) -> DataFrame:
    """Index rows of rows with title and body: all columns and title_tokens, body_tokens, n_tokens."""
    out = once(rows, title_tokens=tokenize(F.col("title")), body_tokens=tokenize(F.col("body")))
    return out.withColumn("n_tokens", F.size("title_tokens") + F.size("body_tokens"))


def postings(index: DataFrame, keys: list[str]) -> DataFrame:
    """term, col, the keys, pos: one row per occurrence. Written by term, a term's rows are one bucket's."""
    parts = [index.select(*keys, F.lit(c).alias("col"), F.posexplode(f"{c}_tokens").alias("pos", "term")) for c in COLUMNS]
    return parts[0].unionByName(parts[1]).select("term", "col", *keys, "pos")


def term_stats(index: DataFrame) -> DataFrame:
    """term, n_rows (index rows with the term), n_occurrences. Rows are pre-aggregated before they are exploded."""
    numbered = index.select("title_tokens", "body_tokens", F.monotonically_increasing_id().alias("_row"))
    counted = numbered.select(F.explode(F.concat("title_tokens", "body_tokens")).alias("term"), "_row")
    return counted.groupBy("term", "_row").agg(F.count("*").alias("n")).groupBy("term").agg(F.count("*").alias("n_rows"), F.sum("n").alias("n_occurrences"))


# --- scoring ----------------------------------------------------------------------------------------------------


def _starts(phrase: Phrase, column: str) -> Column:
    """Positions (from 0) in a column's tokens at which the phrase begins."""
    tokens = F.col(f"{column}_tokens")
    n = len(phrase.words)

    def here(x: Column, i: Column) -> Column:
        conditions = []
        for k, w in enumerate(phrase.words):
            t = x if k == 0 else F.get(tokens, i + k)
            conditions.append(F.coalesce(t.startswith(w) if phrase.prefix and k == n - 1 else t == F.lit(w), F.lit(False)))
        return reduce(lambda a, b: a & b, conditions)

    if not n:
        return F.array().cast("array<int>")
    marked = F.transform(tokens, lambda x, i: F.when(here(x, i), i))
    return F.array_compact(marked)


def _count(phrase: Phrase) -> Column:
    """Occurrences of the phrase in the columns it may be in."""
    if len(phrase.words) == 1 and phrase.columns:
        w = phrase.words[0]
        test = (lambda t: t.startswith(w)) if phrase.prefix else (lambda t: t == w)
        sizes = [F.size(F.filter(f"{c}_tokens", test)) for c in phrase.columns]
    elif not phrase.words:
        sizes = []
    else:  # tokens are letters and digits, so they need no quoting; the look-ahead lets occurrences overlap
        rest = " ".join(phrase.words[1:]) + ("" if phrase.prefix else " ")
        pattern = F.lit(f" {phrase.words[0]}(?= {rest})")
        sizes = [F.regexp_count(F.concat(F.lit(" "), F.array_join(f"{c}_tokens", " "), F.lit(" ")), pattern) for c in phrase.columns]
    return reduce(lambda a, b: a + b, sizes, F.lit(0))


def _widened(spans: Column, starts: Column, n: int) -> Column:
    """Spans with one more phrase of n words, at each of its starts."""
    wider = lambda x: F.transform(starts, lambda s: F.struct(F.least(x["a"], s).alias("a"), F.greatest(x["b"], s + n).alias("b"), (x["n"] + n).alias("n")))
    return F.flatten(F.transform(spans, wider))


def _near(match: Match, starts: dict | None = None) -> Column:
    """Whether some column has all phrases with at most `distance` tokens between the first's end and the last's start,
    in any order."""
    phrases = [p.parts[0] for p in match.parts]
    found = F.lit(False)
    at = (lambda p, c: starts[p, c]) if starts is not None else _starts
    for c in COLUMNS:
        if not all(c in p.columns for p in phrases):
            continue
        if len(phrases) == 1:
            found = found | (F.size(at(phrases[0], c)) > 0)
            continue
        # Every set of starts with one of each phrase: the span holds the phrases and no more than the distance.
        spans = F.transform(at(phrases[0], c), lambda s: F.struct(s.alias("a"), (s + len(phrases[0].words)).alias("b"), F.lit(len(phrases[0].words)).alias("n")))
        for p in phrases[1:]:
            spans = F.array_distinct(_widened(spans, at(p, c), len(p.words)))
        found = found | F.exists(spans, lambda x: x["b"] - x["a"] - x["n"] <= match.distance)
    return found


def _matches(match: Match, counts: dict[Phrase, Column], starts: dict | None = None) -> Column:
    if match.kind == "phrase":
        return counts[match.parts[0]] > 0 if match.parts[0].words else F.lit(True)
    if match.kind == "near":
        return _near(match, starts)
    parts = [_matches(p, counts, starts) for p in match.parts]
    if match.kind == "not":
        return parts[0] & ~parts[1]
    return reduce((lambda a, b: a & b) if match.kind == "and" else (lambda a, b: a | b), parts)


def _all_phrases(match: Match) -> list[Phrase]:
    if match.kind == "phrase":
        return [match.parts[0]]
    return [p for part in match.parts for p in _all_phrases(part)]


def search(index: DataFrame, query: str, source: str | None = None, limit: int = 10, tie: tuple[str, ...] = ("document_key", "chunk_id")) -> DataFrame:
    """The best index rows: all columns but the tokens, and score (lower is better), ordered by score and `tie`.

    BM25 over title and body together; every phrase's row count is taken over all index rows, whatever `source` is.
    `limit` is clamped to 1..100.
    """
    match = parse_match(query)
    phrases = list(dict.fromkeys(_all_phrases(match)))
    return ranked(counted(index, phrases), match, phrases, source, limit, tie)


def counted(index: DataFrame, phrases: list[Phrase]) -> DataFrame:
    """Index rows with the occurrences of each phrase as `_f{i}`."""
    return once(index, **{f"_f{i}": _count(p) for i, p in enumerate(phrases)})


def ranked(rows: DataFrame, match: Match, phrases: list[Phrase], source: str | None, limit: int, tie: tuple[str, ...], corpus: tuple[int, float | None] | None = None, starts: dict | None = None) -> DataFrame:
    """The best of counted rows. `corpus`: number of index rows and their mean length, if `rows` only has those with a
    word of the query; `starts`: where phrases begin by phrase and column, if the rows have no tokens."""
    wanted = [F.count_if(F.col(f"_f{i}") > 0).alias(f"_n{i}") for i in range(len(phrases))]
    found = rows.agg(F.count("*").alias("_n"), F.avg("n_tokens").alias("_avg"), *wanted).first()
    total, mean = corpus if corpus is not None else (found["_n"], found["_avg"])
    gone = ["title_tokens", "body_tokens", "n_tokens", *[c for c in rows.columns if re.fullmatch(r"_f\d+|_s\d+_\w+", c)]]
    if corpus is not None and not any(found[f"_n{i}"] for i in range(len(phrases))):
        return rows.limit(0).withColumn("score", F.lit(0.0)).drop(*gone)
    by_phrase = {p: F.col(f"_f{i}") for i, p in enumerate(phrases)}
    score = F.lit(0.0)
    for p, alternatives in match.scored():
        i = phrases.index(p)
        f = F.col(f"_f{i}").cast("double")
        part = _idf(found[f"_n{i}"], total) * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("n_tokens") / F.lit(mean or 1.0)))
        for a in alternatives:
            part = F.when(_matches(a, by_phrase, starts), part).otherwise(F.lit(0.0))
        score = score - part
    hits = rows.filter(_matches(match, by_phrase, starts))
    if source is not None:
        hits = hits.filter(F.col("source") == source)
    return hits.withColumn("score", score).drop(*gone).orderBy("score", *tie).limit(max(1, min(100, limit)))


def _idf(n: int, total: int) -> float:
    import math

    value = math.log((total - n + 0.5) / (n + 0.5))
    return value if value > 0 else LEAST_IDF


# --- snippets ---------------------------------------------------------------------------------------------------


def snippet(text: str | None, phrases: list[Phrase], width: int = SNIPPET_TOKENS, opening: str = "[", closing: str = "]", dots: str = "...") -> str:
    """The window of at most `width` tokens with most of the phrases, matches in brackets.

    A window beginning at a match scores 1000 for each phrase's first match in it and 1 for each further one and is
    centred; one beginning at the match's sentence scores 100 more, 120 at the text's start, and isn't moved.
    """
    text = text or ""
    spans = [m.span() for m in _WORDS.finditer(text)]
    folded = [_fold_word(text[a:b]) for a, b in spans]
    hits: list[tuple[int, int, int]] = []  # first token, behind the last, phrase
    for k, p in enumerate(phrases):
        n = len(p.words)
        if not n or "body" not in p.columns:
            continue
        for i in range(len(folded) - n + 1):
            own = folded[i:i + n]
            if own[:-1] == list(p.words[:-1]) and (own[-1].startswith(p.words[-1]) if p.prefix else own[-1] == p.words[-1]):
                hits.append((i, i + n, k))
    hits.sort()
    total = len(spans)
    start = 0
    if total > width and hits:
        sentences = [0] + [i for i in range(1, total) if re.search(r"[.:]\s", text[spans[i - 1][1]:spans[i][0]])]

        def score(at: int) -> tuple[int, int, int]:
            seen: set[int] = set()
            value, first, last = 0, -1, -1
            for a, b, k in hits:
                if at <= a and b <= at + width:
                    value += 1 if k in seen else 1000
                    seen.add(k)
                    first, last = (a if first < 0 else first), b - 1
            return value, first, last

        best = -1
        for a, _, _ in hits:
            value, first, last = score(a)
            if value > best:
                best, start = value, max(0, min(total - width, first - (width - (last + 1 - first)) // 2))
            begin = max(s for s in sentences if s <= a)
            if begin < a:
                value = score(begin)[0] + (120 if begin == 0 else 100)
                if value > best:
                    best, start = value, begin
    end = min(total, start + width)
    left = 0 if start == 0 else spans[start][0]
    right = len(text) if end == total else spans[end - 1][1]
    out, at, i = [dots if start else ""], left, 0
    merged: list[list[int]] = []
    for a, b, _ in hits:
        if a >= start and b <= end:
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
    for a, b in merged:
        out += [text[at:spans[a][0]], opening, text[spans[a][0]:spans[b - 1][1]], closing]
        at = spans[b - 1][1]
    return "".join(out) + text[at:right] + (dots if end < total else "")


def with_snippets(hits: DataFrame, query: str, body_col: str = "body") -> DataFrame:
    """Hits with a snippet of the body; call it on the top rows, which are at most 100."""
    phrases = [p for p, _ in parse_match(query).scored()]

    @F.pandas_udf("string")
    def cut(body: pd.Series) -> pd.Series:
        return body.map(lambda x: snippet(x, phrases))

    return hits.withColumn("snippet", cut(F.col(body_col)))


# --- shaping ----------------------------------------------------------------------------------------------------


def source_warning(metadata_json: Column) -> Column:
    """The warning in a hit's metadata: that of the nested source metadata if it has the key, else the top level's; not
    a string or blank gives none."""
    v = F.try_parse_json(metadata_json)
    nested = F.try_variant_get(v, "$.source_metadata.source_warning", "string")
    has_nested = F.get_json_object(metadata_json, "$.source_metadata.source_warning").isNotNull()
    top = F.try_variant_get(v, "$.source_warning", "string")
    is_text = lambda p: F.coalesce(F.schema_of_variant(F.try_variant_get(v, p, "variant")) == "STRING", F.lit(False))
    text = F.when(has_nested, F.when(is_text("$.source_metadata.source_warning"), nested)).when(is_text("$.source_warning"), top)
    return F.nullif(F.trim(text), F.lit(""))


def next_actions(hits: int, source: str | None) -> list[str]:
    """What to try when nothing was found."""
    if hits:
        return []
    return ["Search the source itself and ingest a record, then search again."] if source else ["Ingest documents first or search a single source for records.", "Try fewer or other words."]
