"""Repairing text from scanned pages (problem 3).

Four kinds of noise: words broken over a line end, misread characters, running headers and footers, page-number lines.

* Lines of the site are those of `repeated_lines`; a running header is an edge line that recurs on at least three pages
  of its document after page numbers are cut off and often-confused characters are folded together.
* A misread word is a rare word from which a frequent one is got by undoing one or two known confusions. The pairs are
  found in SQL by anagram hashes: a word's hash is the sum of its characters' hashes, so undoing a confusion adds a
  fixed difference, and rare words join frequent ones on hash plus difference. Spelling decides among the joined.
* A word at a line end is broken unless the corpus has it as a compound with its own hyphen.

Word counts, edge lines and line-end pairs are gathered in one pass; only decisions go back to the tasks. Where there are
more of them than are sent to every task, pages are joined with those that concern them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.encoding import undo_utf8
from paperloom.llm.repeated_lines import SourceForms, line_form, repeated_lines, with_forms
from paperloom.session import shared

# What is printed and what a scanner makes of it.
CONFUSIONS = [
    ("o", "0"), ("l", "1"), ("i", "1"), ("i", "!"), ("i", "|"), ("l", "|"), ("s", "5"), ("g", "9"), ("b", "6"), ("b", "8"), ("z", "2"), ("f", "{"),
    ("t", "f"), ("e", "c"), ("a", "o"), ("m", "rn"), ("d", "cl"), ("n", "ri"), ("h", "li"), ("u", "ii"), ("w", "vv"),
]
_FOLDS = [("vv", "w"), ("rn", "m"), ("ri", "n"), ("cl", "d"), ("li", "h"), ("ii", "u")]
_SIGNS = bytes.maketrans(b"01!|59{68", b"oliisgfbb")
_LIKE = bytes.maketrans(b"fco", b"tea")
_BYTE_FOLDS = [(a.encode(), b.encode()) for a, b in _FOLDS]

#: How much more frequent the right word must be: for words of at most three characters, and for longer ones.
SHORT_RATIO, LONG_RATIO = 20, 8
#: Corrections and compounds that are sent to every task, at most; beyond it they are joined to their pages.
MAX_DECISIONS = 1_000_000
#: Running headers that are sent to every task, at most; beyond it they are joined to their pages.
MAX_HEADERS = 1_000_000
#: Lines at the top and at the bottom of a page, site lines and page numbers apart, among which headers stand.
_EDGE = 3

_WORD = re.compile(r"[^\W_]*[{|!]?[^\W_]+(?:[{|!][^\W_]+)*")
_PLAIN_WORD = re.compile(r"[^\W_]+")
_SIGN = re.compile(r"[{|!]")
#: Signs beyond ASCII that stand next to words, and the ASCII characters that separate words.
_OTHER_SIGNS = re.compile("[\xa0-©«-¯°±²³´¶-¹»-¿×÷‐-⁯₠-⯿]")
_SEPARATE = bytes.maketrans(bytes(b for b in range(128) if not chr(b).isalnum() and chr(b) not in "{|!"), b" " * sum(1 for b in range(128) if not chr(b).isalnum() and chr(b) not in "{|!"))
_LETTER = re.compile(r"[^\W\d_]")
_THREE_LETTERS = re.compile(r"(?:[^\W\d_].*?){3}")
_HAS_LETTER = re.compile(rb"[a-z\x80-\xff]")
_SOFT = "¬\xad"
_HYPHENS = "-‐"
_BREAKERS = frozenset(_HYPHENS + _SOFT)
_BREAK = re.compile(r"([-‐¬\xad])[ \t\xa0]*\n[ \t\xa0]*")
_NEXT = re.compile(r"[^\W_]*[{|!]?[^\W_]+(?:[{|!][^\W_]+)*")
_PAGE_NO = re.compile(r"[\[({<\-–—|*. ]*(?:page|p|pg|pp)?[. ]*([0-9lIiO|!oSsgBzZ]{1,5}|[ivxlcdm]{1,7})(?: +(?:of|/) +[0-9lIiO|!oSsgBzZ]{1,5})?[\])}>\-–—|*. ]*", re.I)
_DIGITS = str.maketrans("lIi|!OoSsgBzZ", "1111100559822")
_LINE_END = re.compile(r"(?<!\n)\n(?!\n)")
_NUMBER = re.compile(r"[0-9lIiO|!oSs]{1,5}")
_NUMBER_SIGNS = frozenset("0123456789lIiO|!oSsgBzZ[]()-–—.")


def roman(n: int) -> str:
    out = ""
    for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out += sign * (n // value)
        n %= value
    return out


def fold(text: str) -> bytes:
    """One form for a text and what a scanner may make of it, in bytes."""
    w = text.lower().encode("utf-8", "replace").translate(_SIGNS)
    for a, b in _BYTE_FOLDS:
        w = w.replace(a, b)
    return w.translate(_LIKE)


def fold_column(word: Column) -> Column:
    w = F.translate(F.lower(word), "01!|59{68", "oliisgfbb")
    for a, b in _FOLDS:
        w = F.replace(w, F.lit(a), F.lit(b))
    return F.translate(w, "fco", "tea")


def states_page(line: str, page: int | None) -> bool:
    """Whether the line only states the page's number, also misread or in Roman numerals."""
    short = line.strip()
    core = short.strip("[](){}<>-–—*. ")
    if len(core) > 24 or not page or page < 1:  # label, number, `of` and number have no more
        return False
    at = short.index(core)
    m = _PAGE_NO.fullmatch(" ".join(short[max(0, at - 3):at + len(core) + 3].split()))
    if not m:
        return False
    text = m.group(1)
    return text.lower() == roman(page) or fold(text) == fold(roman(page)) or text.translate(_DIGITS) == str(page)


def _is_page(word: str, page: int | None) -> bool:
    return page is not None and word.strip("[]()-–—.").translate(_DIGITS) == str(page)


def header_form(line: str, page: int | None) -> bytes:
    """The line without page numbers at its ends, folded."""
    text = line.strip()
    words = text.split()
    if len(words) > 2 and text[0] in _NUMBER_SIGNS:
        first = words[0]
        # A number set off by more than one blank is the page's; so is the page's own number.
        if (not text[len(first):len(first) + 2].strip() and _NUMBER.fullmatch(first)) or _is_page(first, page):
            words.pop(0)
    if len(words) > 2 and text[-1] in _NUMBER_SIGNS:
        last = words[-1]
        at = len(text) - len(last)
        if (not text[at - 2:at].strip() and _NUMBER.fullmatch(last)) or _is_page(last, page):
            words.pop()
    return fold(" ".join(words))


def document_hash(document: str) -> int:
    return xxhash.xxh32_intdigest(document.encode("utf-8", "replace")) - (1 << 31)


def form_hash(document: int, form: bytes) -> int:
    """The document's hash in the upper half, the form's in the lower."""
    return (document << 32) | xxhash.xxh32_intdigest(form)


class SiteLines:
    """Repeated lines of a source, and their first words."""

    def __init__(self, forms: set[str]) -> None:
        self.forms = forms
        self.firsts = {f.split(" ", 1)[0] for f in forms}
        heads = {f[:1] for f in forms}
        #: First characters of lines that can't be the site's: letters that none of them begins with.
        self.others = frozenset(c for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" if c.lower() not in heads)


class Page:
    """A page's lines with what they are: site, blank, page_no, header or text."""

    def __init__(self, text: str, page: int | None, site: SiteLines | None) -> None:
        self.text = undo_utf8(text)
        self.page = page
        self.lines = self.text.split("\n")
        self.kind = ["text" if x and not x.isspace() else "blank" for x in self.lines]
        if site:
            others = site.others
            for n, line in enumerate(self.lines if self.text is text else text.split("\n")):
                if line[:1] in others:
                    continue
                first = line.split(None, 1)[:1]
                if first and (first[0].lower() in site.firsts or not first[0].isalpha()) and line_form(line) in site.forms:
                    self.kind[n] = "site"
        # Page numbers stand at the top or bottom, whatever header is beyond them.
        for i in self.edges(_EDGE):
            if states_page(self.lines[i], page):
                self.kind[i] = "page_no"

    def edges(self, n: int) -> dict[int, None]:
        """Positions of the first and last n lines that are neither blank nor the site's nor page numbers."""
        own = [i for i, k in enumerate(self.kind) if k == "text"]
        return dict.fromkeys(own[:n] + own[-n:])

    def candidates(self) -> list[tuple[int, bytes]]:
        """Edge lines that could be headers: position and form."""
        return [(i, header_form(self.lines[i], self.page)) for i in self.edges(_EDGE) if _THREE_LETTERS.search(self.lines[i])]

    def running(self) -> str:
        return "\n".join(x for x, k in zip(self.lines, self.kind) if k in ("text", "blank"))


def words_of(text: str) -> list[bytes]:
    """Words in lower case and UTF-8, also with a sign that may be a misread letter. Everything else separates."""
    low = text.lower()
    if not low.isascii():
        low = _OTHER_SIGNS.sub(" ", low)
    return low.encode("utf-8", "replace").translate(_SEPARATE).split()


Pairs = list[tuple[int, str, str, str, int]]


def _word_before(text: str, end: int) -> str:
    start = max(text.rfind(" ", 0, end), text.rfind("\n", 0, end)) + 1
    head = text[start:end].lstrip("([“‘\"'„«¿¡\xa0\t")
    for sign in "-‐¬\xad—–":
        if sign in head:
            head = head.rpartition(sign)[2]
    return head


def line_end_pairs(text: str) -> list[tuple[int, str, str, str, int]]:
    """Hyphens at line ends between words: position of the hyphen, word before, hyphen, word behind, its position."""
    out: Pairs = []
    if not any(x.rstrip()[-1:] in _BREAKERS for x in text.split("\n")[:-1]):
        return out
    for m in _BREAK.finditer(text):
        after = _NEXT.match(text, m.end())
        if after:
            head = _word_before(text, m.start())
            if _LETTER.search(head) and _LETTER.search(after.group()):
                out.append((m.start(), head, m.group(1), after.group(), m.end()))
    return out


def compounds_within_lines(text: str) -> list[tuple[str, str]]:
    """Neighbouring parts of words with hyphens inside."""
    out = []
    at = text.find("-")
    while at >= 0:
        after = _NEXT.match(text, at + 1)
        if after and at and not text[at - 1].isspace():
            head = _word_before(text, at)
            if head:
                out.append((head.lower(), after.group().lower()))
        at = text.find("-", at + 1)
    return out


def _join_soft(text: str, pairs: Pairs, compounds: set[tuple[str, str]] | tuple) -> tuple[str, int]:
    """`text` with broken words joined, and their number; compounds keep their hyphen and lose the line end."""
    if not pairs:
        return text, 0
    out, at, count = [], 0, 0
    for start, a, sign, b, end in pairs:
        whole = sign in _HYPHENS and (a.lower(), b.lower()) in compounds
        out += [text[at:start], sign if whole else ""]
        at = end
        count += not whole
    return "".join(out) + text[at:], count


def _gather(site: SourceForms):
    """Rows (kind, a, b, n, page): w word, c compound, p line-end pair with counts; e edge line of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        compounds: Counter[tuple[str, str]] = Counter()
        pairs: Counter[tuple[str, str]] = Counter()

        def rows(force: bool) -> Iterator[pa.RecordBatch]:
            if force or len(words) + len(pairs) > 1_000_000:
                for w in [w for w in words if not _HAS_LETTER.search(w)]:
                    del words[w]
                kind = ["w"] * len(words) + ["c"] * len(compounds) + ["p"] * len(pairs)
                a = [*(w.decode("utf-8", "replace") for w in words), *(x for x, _ in compounds), *(x for x, _ in pairs)]
                b = [""] * len(words) + [y for _, y in compounds] + [y for _, y in pairs]
                yield _batch(kind, a, b, [*words.values(), *compounds.values(), *pairs.values()], [0] * len(kind))
                for c in (words, compounds, pairs):
                    c.clear()

        for batch in batches:
            doc, number, edges = [], [], []
            for i, (d, s, n, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
                page = Page(text, n, site.of(s, batch.column(4), i))
                if d is not None and n is not None:
                    own = document_hash(d)
                    for _, form in page.candidates():
                        edges.append(form_hash(own, form))
                        number.append(n)
                running = page.running()
                broken = line_end_pairs(running)
                for _, a, sign, b, _ in broken:
                    if sign in _HYPHENS:
                        pairs[a.lower(), b.lower()] += 1
                joined, _ = _join_soft(running, broken, ())
                words.update(words_of(joined))
                compounds.update(compounds_within_lines(joined))
            yield _batch(["e"] * len(edges), [""] * len(edges), [""] * len(edges), edges, number)
            yield from rows(False)
        yield from rows(True)

    return run


def _batch(kind: list, a: list, b: list, n: list, page: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(n, pa.int64()), pa.array(page, pa.int64())], names=["kind", "a", "b", "n", "page"])


def _anagram(word: Column) -> Column:
    """Sum of the characters' hashes, 48 bits each."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda acc, c: acc + F.xxhash64(c).bitwiseAND(F.lit((1 << 48) - 1)))


def _hash_of(text: str) -> Column:
    return reduce(lambda x, y: x + y, [F.xxhash64(F.lit(c)).bitwiseAND(F.lit((1 << 48) - 1)) for c in text])


def corrections(words: DataFrame) -> DataFrame:
    """wrong, right: the most frequent word that undoing one or, in words of six characters and more, two confusions
    gives, if it's enough more frequent. `words` has word and n."""
    known = words.filter(F.length("word") > 0)
    ratio = F.when(F.length("word") <= 3, SHORT_RATIO).otherwise(LONG_RATIO)
    table = F.array(*[F.struct(F.lit(r).alias("right"), F.lit(w).alias("wrong"), (_hash_of(r) - _hash_of(w)).alias("change"), F.lit(max(len(w), len(r))).alias("cost")) for r, w in CONFUSIONS])
    rare = known.select("word", "n", (F.col("n") * ratio).alias("least"), _anagram(F.col("word")).alias("h"), F.filter(table, lambda c: F.contains(F.col("word"), c["wrong"])).alias("may")).filter(F.size("may") > 0)
    one = rare.select("word", "least", "h", F.explode("may").alias("x"))
    single = one.select("word", "least", (F.col("h") + F.col("x.change")).alias("to"), F.col("x.right").alias("right"), F.col("x.wrong").alias("wrong"), F.lit(None).cast("int").alias("cost"))
    twice = (
        rare.filter(F.length("word") >= 6).select("word", "least", "h", F.explode("may").alias("x"), "may")
        .select("word", "least", "h", "x", F.explode("may").alias("y"))
        .filter((F.col("x.wrong") < F.col("y.wrong")) | ((F.col("x.wrong") == F.col("y.wrong")) & (F.col("x.right") <= F.col("y.right"))))
        .select("word", "least", (F.col("h") + F.col("x.change") + F.col("y.change")).alias("to"), F.lit("").alias("right"), F.lit("").alias("wrong"), (F.col("x.cost") + F.col("y.cost")).alias("cost"))
    )
    frequent = known.filter(F.col("n") >= LONG_RATIO).select(F.col("word").alias("fit"), F.col("n").alias("fit_n"), _anagram(F.col("word")).alias("to"))
    joined = single.unionByName(twice).join(frequent, "to").filter((F.col("fit_n") >= F.col("least")) & (F.col("fit") != F.col("word")))
    # The same letters may stand elsewhere: one confusion must be undone in its place, two within their edit distance.
    in_place = F.expr("exists(sequence(1, length(word)), i -> substr(word, i, length(wrong)) = wrong AND concat(left(word, i - 1), right, substr(word, i + length(wrong))) = fit)")
    spelled = F.when(F.col("cost").isNull(), in_place).otherwise(F.levenshtein("word", "fit") <= F.col("cost"))
    best = joined.filter(spelled).groupBy("word").agg(F.max_by("fit", F.struct(F.col("cost").isNull(), "fit_n", "fit")).alias("right"))
    return best.select(F.col("word").alias("wrong"), "right")


def compounds_at_line_ends(gathered: DataFrame) -> DataFrame:
    """a, b: line-end pairs that are compounds with a hyphen of their own.

    Counted apart from misreadings: as a compound within lines, as a word without hyphen, and the parts by themselves.
    A pair that is known neither way is a compound if both its parts are words.
    """
    by_fold = lambda kind, key: gathered.filter(F.col("kind") == kind).groupBy(key.alias("f")).agg(F.sum("n").alias("n"))
    pairs = gathered.filter("kind = 'p'").select("a", "b", fold_column(F.col("a")).alias("fa"), fold_column(F.col("b")).alias("fb"), fold_column(F.concat("a", "b")).alias("fj"), "n")
    words = by_fold("w", fold_column(F.col("a")))
    hyphened = by_fold("c", F.concat(fold_column(F.col("a")), F.lit("-"), fold_column(F.col("b"))))
    found = (
        pairs.withColumn("fc", F.concat("fa", F.lit("-"), "fb"))
        .join(words.select(F.col("f").alias("fj"), F.col("n").alias("n_joined")), "fj", "left")
        .join(hyphened.select(F.col("f").alias("fc"), F.col("n").alias("n_compound")), "fc", "left")
        .join(words.select(F.col("f").alias("fa"), F.col("n").alias("n_a")), "fa", "left")
        .join(words.select(F.col("f").alias("fb"), F.col("n").alias("n_b")), "fb", "left")
        .na.fill(0, ["n_joined", "n_compound", "n_a", "n_b"])
    )
    # The joined count holds the line-end pairs themselves, which were joined when words were counted.
    own = F.col("n_joined") - F.col("n_pairs")
    found = found.join(pairs.groupBy("fj").agg(F.sum("n").alias("n_pairs")), "fj")
    unknown = (own <= 0) & (F.col("n_compound") == 0) & (F.col("n_a") >= 20) & (F.col("n_b") >= 20)
    return found.filter(((F.col("n_compound") > 0) & (F.col("n_compound") >= own)) | unknown).select("a", "b").distinct()


def _goes_on(line: str, behind: str) -> bool:
    """Is the last word of the line broken, and does the next line go on with it in the same case?"""
    return any((behind if len(b) == 1 else b).isupper() if a.isupper() else b[0].islower() for _, a, _, b, _ in line_end_pairs(f"{line}\n{behind}")[-1:])


def paragraphs(lines: list[str]) -> list[str]:
    """Lines of a page as paragraphs of trimmed lines: a line ends one if it is blank, wider than print, in capitals or
    ends a sentence short of the usual width; no line ends one whose last word goes on in the next."""
    trimmed = [x.strip() for x in lines]
    widths = sorted([len(x) for x in trimmed if x])
    wide = widths[int(len(widths) * 0.8)] if widths else 0
    out: list[list[str]] = [[]]
    short = 0.75 * wide
    for x, behind in zip(trimmed, [*trimmed[1:], ""]):
        if x:
            out[-1].append(x)
            ends = wide > 110 or (len(x) < short and x[-1] in ".!?:”\"") or (x[:2].isupper() and x.isupper())
            if not ends or (x[-1] in _BREAKERS and _goes_on(x, behind)):
                continue
        out.append([])
    return ["\n".join(p) for p in out if p]


def _page_rows(site: SourceForms):
    """What a page asks for, where decisions are joined: rows (id, kind, a, b, h) of its edge lines (e), words (w) and
    line-end pairs (p)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kinds, first, second, forms = [], [], [], [], []
            for i, (row, d, s, n, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)))):
                page = Page(text, n, site.of(s, batch.column(5), i))
                asked = [("e", "", "", form_hash(document_hash(d), form)) for _, form in page.candidates()] if d is not None and n is not None else []
                running = page.running()
                broken = line_end_pairs(running)
                asked += [("p", a.lower(), b.lower(), 0) for _, a, sign, b, _ in broken if sign in _HYPHENS]
                for whole in (running, _join_soft(running, broken, ())[0]):
                    asked += [("w", w.decode("utf-8", "replace"), "", 0) for w in set(words_of(whole)) if _HAS_LETTER.search(w)]
                for kind, a, b, h in dict.fromkeys(asked):
                    ids.append(row)
                    kinds.append(kind)
                    first.append(a)
                    second.append(b)
                    forms.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(first, pa.string()), pa.array(second, pa.string()), pa.array(forms, pa.int64())], names=["id", "kind", "a", "b", "h"])

    return run


def _repair(site: SourceForms, sent: tuple[set[int], dict[str, str], set[tuple[str, str]]] | None):
    """`sent`: headers, corrections and compounds of all pages; null if every page brings its own."""
    headers, wrong, compounds = sent if sent is not None else (set(), {}, set())
    documents = {h >> 32 for h in headers}
    wrong_words = {w.encode() for w in wrong}

    def right_case(word: str, wrong: dict[str, str]) -> str:
        fix = wrong.get(word.lower(), word)
        return fix.upper() if len(word) > 1 and word.upper() == word and any(c.isalpha() for c in word) else fix[:1].upper() + fix[1:] if word[:1].isupper() else fix

    def fix_words(text: str, wrong: dict[str, str], wrong_words: set[bytes]) -> tuple[str, int]:
        found = wrong_words.intersection(words_of(text))
        if not found:
            return text, 0
        low = text.lower()
        if len(low) != len(text):  # some capitals are longer in lower case
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        places = []
        for w in found:
            word = w.decode()
            at = low.find(word)
            while at >= 0:
                end = at + len(word)
                if not low[at - 1:at].isalnum() and not low[end:end + 1].isalnum():
                    places.append((at, end))
                at = low.find(word, end)
        out, done = [], 0
        for at, end in sorted(places):
            if at >= done:
                out += [text[done:at], right_case(text[at:end], wrong)]
                done = end
        return "".join(out) + text[done:], len(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out, n_hyphen, n_char, n_header, n_page = [], [], [], [], [], []
            for at, (i, d, s, n, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)))):
                page = Page(text, n, site.of(s, batch.column(5), at))
                own_headers, own_wrong, own_words, own_compounds = headers, wrong, wrong_words, compounds
                if sent is None:
                    own_headers = set(batch.column(6)[at].as_py() or ())
                    own_wrong = {x["a"]: x["b"] for x in batch.column(7)[at].as_py() or ()}
                    own_words = {w.encode() for w in own_wrong}
                    own_compounds = {(x["a"], x["b"]) for x in batch.column(8)[at].as_py() or ()}
                own = document_hash(d) if d is not None and n is not None else None
                if own is not None and (own in documents or (sent is None and own_headers)):
                    for line, form in page.candidates():
                        if form_hash(own, form) in own_headers:
                            page.kind[line] = "header"
                # With the headers gone, the number may stand at the edge.
                own = [j for j, k in enumerate(page.kind) if k == "text"]
                for j in {*own[:2], *own[-2:]}:
                    if states_page(page.lines[j], n):
                        page.kind[j] = "page_no"
                flowing = "\n\n".join(paragraphs([x for x, k in zip(page.lines, page.kind) if k in ("text", "blank")]))
                joined, hyphens = _join_soft(flowing, line_end_pairs(flowing), own_compounds)
                fixed, chars = fix_words(joined, own_wrong, own_words)
                ids.append(i)
                out.append(_LINE_END.sub(" ", fixed))
                n_hyphen.append(hyphens)
                n_char.append(chars)
                n_header.append(page.kind.count("header"))
                n_page.append(page.kind.count("page_no"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string()), *(pa.array(x, pa.int32()) for x in (n_hyphen, n_char, n_header, n_page))], names=["page_row_id", "repaired", "n_hyphen", "n_char", "n_header", "n_page_no"])

    return run


def repair_scans(pages: DataFrame) -> DataFrame:
    """Every page with a text, repaired: page_row_id, repaired, n_hyphen (words joined), n_char (words corrected),
    n_header and n_page_no (lines removed).

    `pages` has page_row_id, document_key, source, page_number and text; other columns are ignored. Null texts give no
    row, blank ones an empty text. Pages without document key or number have no headers; a page delivered twice is
    repaired twice and counts once as a page with its header. Text of pages that aren't scans passes through the same
    rules. An empty table gives an empty result.
    """
    rows = pages.select(F.col("page_row_id").cast("long"), F.col("document_key").cast("string").alias("doc"), F.col("source").cast("string").alias("src"), F.col("page_number").cast("long").alias("number"), "text").filter("text IS NOT NULL")
    confirmed, _ = repeated_lines(pages)
    rows, site = with_forms(rows, confirmed, SiteLines)
    seen = rows.select("doc", "src", "number", "text", "forms").mapInArrow(_gather(site), "kind string, a string, b string, n long, page long")
    # Edge lines are counted by distinct page, everything else is summed; one shuffle does both.
    key = F.when(F.col("kind") == "e", F.col("n"))
    gathered = shared(seen.groupBy("kind", "a", "b", key.alias("h"), "page").agg(F.sum(F.when(F.col("kind") != "e", F.col("n"))).alias("n")))
    recurring = shared(gathered.filter("kind = 'e'").groupBy("h").agg(F.count("*").alias("pages")).filter("pages >= 3").select("h"))
    wrong = shared(corrections(gathered.filter("kind = 'w'").select(F.col("a").alias("word"), "n")))
    compounds = shared(compounds_at_line_ends(gathered))
    out = "page_row_id long, repaired string, n_hyphen int, n_char int, n_header int, n_page_no int"
    columns = ["page_row_id", "doc", "src", "number", "text", "forms"]
    if recurring.count() <= MAX_HEADERS and wrong.count() <= MAX_DECISIONS and compounds.count() <= MAX_DECISIONS:
        sent = {h for (h,) in recurring.collect()}, dict(map(tuple, wrong.collect())), set(map(tuple, compounds.collect()))
        return rows.select(*columns).mapInArrow(_repair(site, sent), out)
    asked = rows.select(*columns).mapInArrow(_page_rows(site), "id long, kind string, a string, b string, h long")
    decided = (
        recurring.select(F.lit("e").alias("kind"), F.lit("").alias("a"), F.lit("").alias("b"), "h", F.lit("").alias("right"))
        .unionByName(wrong.select(F.lit("w").alias("kind"), F.col("wrong").alias("a"), F.lit("").alias("b"), F.lit(0).cast("long").alias("h"), "right"))
        .unionByName(compounds.select(F.lit("p").alias("kind"), "a", "b", F.lit(0).cast("long").alias("h"), F.lit("").alias("right")))
    )
    found = asked.join(decided, ["kind", "a", "b", "h"]).groupBy(F.col("id").alias("page_row_id")).agg(
        F.collect_set(F.when(F.col("kind") == "e", F.col("h"))).alias("headers"),
        F.collect_set(F.when(F.col("kind") == "w", F.struct("a", F.col("right").alias("b")))).alias("wrong"),
        F.collect_set(F.when(F.col("kind") == "p", F.struct("a", "b"))).alias("compounds"),
    )
    return rows.join(found, "page_row_id", "left").select(*columns, "headers", "wrong", "compounds").mapInArrow(_repair(site, None), out)
