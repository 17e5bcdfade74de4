"""Text decoded with the wrong character encoding (problem 1).

A noisy channel: text was written as bytes of one encoding and read as another, whole or in stretches, some bytes being
lost on the way. For every channel a token's characters are the bytes that its reader had, and a lattice over them has
arcs for characters that were read rightly, for whole sequences of UTF-8, and for sequences with lost bytes, which are
wildcards: a byte that left U+FFFD, one that left nothing, or both bytes of a letter. Viterbi search takes the cheapest
path, so damage may begin and end inside a token; wildcards are filled with the most frequent word that fits what is
left of their bytes. A second Viterbi search over a row's tokens finds the cheapest sequence of channels under the
corpus's word frequencies, with a price for entering a damaged stretch. Damage that left only ASCII is looked for too:
question marks inside words, and words without their letters beyond ASCII. A row is damaged if its sequence isn't clean
throughout.

Word frequencies aren't cut. Where there are more words than are sent to every task, the words that a row's readings ask
for are joined to the row.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import shared

#: Encodings that bytes of UTF-8 were read as, and pairs (written, read) of single-byte encodings (fixed values).
UTF8_READ_AS = ("cp1252", "cp1251", "cp1250", "cp437", "cp850", "mac_roman", "iso8859_2", "iso8859_15", "koi8_r", "cp866", "cp1253")
SINGLE_BYTE = (("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp1252", "cp1251"), ("cp1252", "cp1250"), ("cp1252", "cp1253"), ("cp1252", "koi8_r"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1250", "cp1252"), ("iso8859_2", "cp1252"))
#: Words and signs seen more than once that are sent to every task, at most; beyond it rows are joined with theirs.
MAX_LEXICON = 500_000

LOST = "�"
_ITEM = re.compile(r"[^\W_]+|█+|[^\w\s\x00-\x7f]")
_TOKEN = re.compile(r"[^ \t\n\r\f\v]*[^\x00-\x7f][^ \t\n\r\f\v]*")
#: Signs that texts properly have; a reading that makes them letters must give known words.
_PROPER_SIGNS = frozenset("\xa0\xad¬©«»‐–—‘’“”…█")
_CONTROL = re.compile("[\x80-\x9f]")
#: A question mark that stands for a letter, and tokens that have one.
_ASKED = re.compile(r"(?<=[^\W\d_])\?+(?=[^\W\d_])")
_ASKED_TOKEN = re.compile(r"[^ \t\n\r\f\v]*[^\W\d_]\?+[^\W\d_][^ \t\n\r\f\v]*")
#: Letters of a word that is left without those beyond ASCII, at least, and how much more frequent the whole word is.
_LEFT, _RATIO = 5, 50
#: Occurrences from which a word stands for itself, and the weight of a rare letter in the others.
_WELL_KNOWN, _RARE_LETTER = 50, 0.8
#: Letters and signs that a restored text may have beyond ASCII: Latin-1, Latin Extended-A, general punctuation and
#: the block sign of redactions.
_PLAUSIBLE = re.compile("[\x00-\x7f\xa0-ſ‐-•…‰‹›€™█]*\\Z")


def _byte_map(encoding: str) -> dict[str, int]:
    """Byte of each character; bytes without a character in the encoding stand for themselves as control characters."""
    out = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, b)
    for b in range(128, 160):  # a reader that keeps control characters is Latin-1 in these places
        out.setdefault(chr(b), b)
    return out


_BYTES = {e: _byte_map(e) for e in {*UTF8_READ_AS, *(r for _, r in SINGLE_BYTE)}}


def to_bytes(token: str, read_as: str) -> bytes | None:
    known = _BYTES[read_as]
    try:
        return bytes([known[c] for c in token])
    except KeyError:
        return None


_LEAD = {b: frozenset(c for x in range(0x80, 0xC0) for c in [bytes([b, x]).decode("utf-8")] if _PLAUSIBLE.match(c)) for b in range(0xC2, 0xC6)}
_SIGNS_OF = {b: frozenset(c for x in range(0x80, 0xC0) for c in [bytes([0xE2, b, x]).decode("utf-8")] if _PLAUSIBLE.match(c)) for b in (0x80, 0x82)}
_SIGNS = frozenset().union(*_SIGNS_OF.values())
_AFTER = {x: frozenset(c for b in range(0xC2, 0xC6) for c in [bytes([b, x]).decode("utf-8")] if _PLAUSIBLE.match(c)) for x in range(0x80, 0xC0)}
#: What a lattice needs besides kept characters, in characters of the bytes' values with \u0100 for a lost one.
_WHOLE = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}")
_BROKEN = re.compile("[\xc2-\xc5](?![\x80-\xbf])|\xe2[\x80-\xbf\u0100]|\u0100[\x80-\xbf]")
_KEEP, _KEEP_LOST, _WHOLE_ARC, _MISSING, _GIVEN = 1.5, 1.0, -2.0, 1.2, 0.8


def _as_bytes(token: str, read_as: str) -> str:
    known = _BYTES[read_as]
    return "".join("\u0100" if c == LOST else chr(known[c]) if c in known else "\u0200" for c in token)


def byte_lattice(token: str, read_as: str, final: bool = False) -> tuple[str, list[frozenset | None], int, int] | None:
    """Cheapest path through the token's bytes: text with U+FFFD for wildcards, what each of them may be (null: any
    letter), and the numbers of whole and of broken sequences; null if there are none. Damage on damage is undone: unless
    `final`, sequences may give characters that only are bytes of another sequence."""
    known = _BYTES[read_as]
    raw = _as_bytes(token, read_as)
    if not _WHOLE.search(raw) and not _BROKEN.search(raw):
        return None
    n = len(raw)
    best: list[tuple] = [(0.0, None, "", None, 0, 0)] + [(math.inf, None, "", None, 0, 0)] * n

    def arc(i: int, j: int, price: float, text: str, may=None, whole: int = 0, broken: int = 0) -> None:
        if j <= n and best[i][0] + price < best[j][0]:
            best[j] = (best[i][0] + price, i, text, may, whole, broken)

    for i, b in enumerate(map(ord, raw)):
        if best[i][0] == math.inf:
            continue
        follows = [ord(x) for x in raw[i + 1:i + 3]]
        second, third = (follows + [0, 0])[:2]
        if b < 0x80:
            arc(i, i + 1, 0.0, token[i])
            continue
        arc(i, i + 1, _KEEP_LOST if b == 0x100 else _KEEP, token[i])
        if 0xC2 <= b <= 0xDF and 0x80 <= second <= 0xBF:
            text = bytes([b, second]).decode("utf-8")
            if _PLAUSIBLE.match(text) or (not final and text in known):
                arc(i, i + 2, _WHOLE_ARC, text, whole=1)
        if 0xE0 <= b <= 0xEF and 0x80 <= second <= 0xBF and 0x80 <= third <= 0xBF:
            text = bytes([b, second, third]).decode("utf-8", errors="ignore")
            if text and (_PLAUSIBLE.match(text) or (not final and text in known)):
                arc(i, i + 3, _WHOLE_ARC, text, whole=1)
        if b in _LEAD:
            if second == 0x100:
                arc(i, i + 2, _GIVEN, LOST, _LEAD[b], broken=1)
            elif not 0x80 <= second <= 0xBF:
                arc(i, i + 1, _MISSING, LOST, _LEAD[b], broken=1)
        if b == 0xE2 and second in _SIGNS_OF:
            if third == 0x100:
                arc(i, i + 3, _GIVEN, LOST, _SIGNS_OF[second], broken=1)
            else:
                arc(i, i + 2, _MISSING, LOST, _SIGNS_OF[second], broken=1)
        if b == 0xE2 and second == 0x100:
            signs = frozenset(c for c in _SIGNS if ord(c) & 63 == third & 63) if 0x80 <= third <= 0xBF else _SIGNS
            arc(i, i + (3 if 0x80 <= third <= 0x100 else 2), _GIVEN, LOST, signs, broken=1)
        if b == 0x100 and 0x80 <= second <= 0xBF:
            arc(i, i + 2, _GIVEN, LOST, _AFTER[second], broken=1)
    out, may, whole, broken, j = [], [], 0, 0, n
    while j:
        _, i, text, allowed, w, k = best[j]
        out.append(text)
        if text == LOST:
            may.append(allowed)
        whole, broken, j = whole + w, broken + k, i
    if not whole and not broken:
        return None
    text = "".join(reversed(out))
    again = byte_lattice(text, read_as) if whole and not may and not text.isascii() else None
    if again and again[2] and not again[1]:
        return again
    if not final and not _PLAUSIBLE.match(text.replace(LOST, "")):
        return byte_lattice(token, read_as, True)
    return text, may[::-1], whole, broken


def read_utf8(token: str, read_as: str) -> tuple[str, int] | None:
    """Right reading of a token whose UTF-8 bytes were read as another encoding, and its lost characters; null if the
    bytes don't look like UTF-8. Damage on damage is undone."""
    found = byte_lattice(token, read_as)
    return (found[0], len(found[1])) if found and found[0] != token else None


def gap_form(word: str) -> str:
    return re.sub(r"[^\x00-\x7f]", LOST, word)


def left_of(word: str) -> str:
    """What is left of a word without its letters beyond ASCII."""
    return re.sub(r"[^\x00-\x7f]", "", word)


_GAPPED = re.compile(rf"(?:[^\W_]|{LOST})*{LOST}(?:[^\W_]|{LOST})*")


class Lexicon:
    """Log frequencies of words and signs, the words that fit a word with lost characters, and those of which a word is
    what is left. `total`: sum of all counts; `letters`: occurrences of the characters beyond ASCII in them."""

    def __init__(self, counts: dict[str, int], total: int | None = None, letters: dict[str, int] | None = None) -> None:
        self.counts = counts
        if letters is None:
            letters = Counter()
            for w, n in counts.items():
                if not w.isascii():
                    for c in w.lower():
                        letters[c] += n * (c > "\x7f")
        top = math.log(max(letters.values(), default=0) + 1.0)
        self.rarity = {c: _RARE_LETTER * (top - math.log(n + 1.0)) for c, n in letters.items()}
        self.rarest = _RARE_LETTER * top
        self.total = math.log((sum(counts.values()) if total is None else total) + 1000.0)
        self.by_gap: dict[str, list[str]] = defaultdict(list)
        self.by_rest: dict[str, str] = {}
        for w in counts:
            if not w.isascii() and w[0].lower() == w[0] and w[0] != "█":
                self.by_gap[gap_form(w)].append(w)
                rest = left_of(w)
                if len(rest) >= _LEFT and w[0] < "\x80":
                    held = self.by_rest.get(rest)
                    if held is None or (counts[w], w) > (counts[held], held):
                        self.by_rest[rest] = w
        self.by_rest = {r: w for r, w in self.by_rest.items() if counts[w] >= _RATIO * (counts.get(r, 0) + 1)}

    def log(self, item: str) -> float:
        n = self.counts.get(item, 0)
        score = math.log(n + 0.02) - self.total
        if n < _WELL_KNOWN and not item.isascii():  # a word that is hardly known is as likely as its rarest letter
            score -= max(self.rarity.get(c, self.rarest) for c in item if c > "\x7f")
        return score

    def score(self, text: str) -> float:
        low = text.lower()
        return sum(self.log(x) for x in _ITEM.findall(low))

    def fill(self, text: str, may: list[frozenset | None] | None = None) -> str:
        """`text` with lost characters replaced by those of the most frequent word that fits, where one does. `may`
        has for each lost character what it may be; null for anything."""
        passed = 0

        def one(m: re.Match) -> str:
            nonlocal passed
            word = m.group()
            own = may[passed:passed + word.count(LOST)] if may else None
            passed += word.count(LOST)
            fits = self.by_gap.get(gap_form(word.lower()), ())
            fits = [w for w in fits if all(b == LOST or b.lower() == a for a, b in zip(w, word))]
            if own and any(x is not None for x in own):
                at = [i for i, c in enumerate(word) if c == LOST]
                fits = [w for w in fits if all(x is None or w[i] in x or w[i].upper() in x for i, x in zip(at, own))]
            if not fits:
                return word
            best = max(fits, key=lambda w: (self.counts[w], w))
            if word.strip(LOST) != word and self.counts.get(word.strip(LOST).lower(), 0) > 20 * self.counts[best]:
                return word  # a word between lost signs
            upper = word.isupper() and len(word) > 1
            first = 2 * self.counts.get(best[:1].upper() + best[1:], 0) > self.counts[best]  # usually with a capital
            return "".join((a.upper() if upper or (i == 0 and first) else a) if b == LOST else b for i, (a, b) in enumerate(zip(best, word)))

        return _GAPPED.sub(one, text)


_CLEAN = 0
STATES = ["clean", *(f"utf8>{r}" for r in UTF8_READ_AS), *(f"{w}>{r}" for w, r in SINGLE_BYTE), "lost"]
_RUNS = re.compile(f"{LOST}+")
#: Capitals beyond ASCII behind a small letter, which words don't have, and their price.
_INNER_CAPITAL, _CAPITAL = re.compile("(?<=[a-zß-öø-ÿ])[À-ÖØ-Þ]"), 10.0
_ENTER, _TOKEN_PRICE, _SINGLE_PRICE, _UTF8_GAIN, _GAP_PRICE, _NEVER, _STRANGE = 5.0, 1.0, 3.0, 8.0, 6.0, 60.0, 20.0


def _strange(token: str) -> bool:
    """Whether letters of another script stand among Latin ones, or a sign that no text has."""
    if _PLAUSIBLE.match(token):
        return False
    odd = [c for c in token if not _PLAUSIBLE.match(c)]
    return any("a" <= c <= "z" or "A" <= c <= "Z" for c in token) or not any(c.isalpha() for c in odd)


class Restorer:
    """Readings and scores of tokens by channel (kept per distinct token) and the search over a row."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.known: dict[str, tuple[list[float], list[str | None], bool]] = {}

    def readings(self, token: str) -> tuple[list[float], list[str | None], bool]:
        """Score and reading of the token in each state, and whether it's clean beyond doubt."""
        held = self.known.get(token)
        if held is not None:
            return held
        lex = self.lexicon
        scores: list[float] = [-_NEVER * 10] * len(STATES)
        texts: list[str | None] = [None] * len(STATES)
        texts[_CLEAN] = token
        scores[_CLEAN] = lex.score(token) - _NEVER * (LOST in token) - 15.0 * len(_CONTROL.findall(token)) - _STRANGE * _strange(token) - _CAPITAL * len(_INNER_CAPITAL.findall(token))
        for k, read in enumerate(UTF8_READ_AS, 1):
            found = byte_lattice(token, read)
            if found and found[0] != token:
                text, may, whole, _ = found
                kept = sum(1 for c in token if c > "\x7f") - sum(1 for c in text if c > "\x7f" and c != LOST)
                text = lex.fill(text, may) if may else text
                # A part that stays unread speaks against the channel, unless sequences were whole.
                gain = _UTF8_GAIN if whole and kept > 0 and not may else 0.0
                texts[k] = text
                scores[k] = lex.score(text.replace(LOST, "")) + gain - _GAP_PRICE * len(may) - _TOKEN_PRICE - 20.0 * text.count(LOST)
        for k, (written, read) in enumerate(SINGLE_BYTE, 1 + len(UTF8_READ_AS)):
            raw = to_bytes(token, read)
            try:
                text = raw.decode(written) if raw is not None else None
            except UnicodeDecodeError:
                text = None
            if text and text != token and _PLAUSIBLE.match(text) and not _CONTROL.search(text) and self._credible(token, text):
                texts[k], scores[k] = text, lex.score(text) - _SINGLE_PRICE
        asked = _ASKED.sub(lambda m: LOST * len(m.group()), token)
        if LOST in asked:
            # As many letters as signs, or one for the two bytes of a letter or the three of a sign.
            forms = dict.fromkeys([asked, *(_RUNS.sub(lambda m, k=k: LOST * -(-len(m.group()) // k), asked) for k in (2, 3) if LOST * k in asked)])
            text = min(map(lex.fill, forms), key=lambda t: (t.count(LOST), -lex.score(t)))
            if LOST in token or LOST not in text:
                text = re.sub(rf"(?<=[^\W_]){LOST}(?=s\b)", "’", text)
                text = re.sub(rf"\A{LOST}+\Z", "—", text)
                text = re.sub(rf"\A{LOST}(?=\w)", "“", text)
                text = re.sub(rf"(?<=\w){LOST}(?=\W*\Z)", "”", text)
                text = re.sub(rf"(?<=[^\W_]){LOST}(?=[^\W_])", "\xa0", text)
                texts[-1], scores[-1] = text, lex.score(text.replace(LOST, "")) - _GAP_PRICE - 2.0 * text.count(LOST)
        elif token.isascii():
            text = re.sub(r"[A-Za-z]+", lambda m: self._whole(m.group(), m.group().lower()), token)
            if text != token:
                texts[-1], scores[-1] = text, lex.score(text) - _GAP_PRICE
        sure = max(scores[1:]) <= scores[_CLEAN]
        if len(self.known) > 500_000:
            self.known.clear()
        self.known[token] = scores, texts, sure
        return self.known[token]

    def _whole(self, word: str, low: str) -> str:
        """The word whose ASCII letters these are, if it's known and this one nearly isn't."""
        whole = self.lexicon.by_rest.get(low)
        if whole is None:
            return word
        rest = iter(word)
        out = "".join(next(rest) if c < "\x80" else c for c in whole)
        return out.upper() if word.isupper() else out

    def suspects(self, text: str) -> list[re.Match]:
        """Tokens with a character beyond ASCII, with a question mark inside a word or with a word that is what is left
        of a frequent one."""
        spans = {} if text.isascii() else {m.start(): m for m in _TOKEN.finditer(text)}
        if "?" in text:
            spans |= {m.start(): m for m in _ASKED_TOKEN.finditer(text)}
        if self.lexicon.by_rest:
            words = set(text.lower().split())
            words |= {w.strip(".,;:!?()\"'[]") for w in words if not w.isalpha()}
            for rest in words & self.lexicon.by_rest.keys():
                for m in re.finditer(rf"[^ \t\n\r\f\v]*(?<![^\W_]){rest}(?![^\W_])[^ \t\n\r\f\v]*", text, re.I):
                    spans.setdefault(m.start(), m)
        return [spans[k] for k in sorted(spans)]

    def _credible(self, token: str, text: str) -> bool:
        """Whether a single-byte reading may be: where proper signs become letters, every word must be a known one."""
        changed = [b for a, b in zip(token, text) if a in _PROPER_SIGNS and b not in _PROPER_SIGNS]
        if not changed:
            return True
        return all(b.isalpha() for b in changed) and all(w in self.lexicon.counts for w in _ITEM.findall(text.lower()))

    def restore(self, text: str) -> tuple[str, int, int]:
        """The text with its damaged tokens restored, their number, and how many of them can't be restored whole."""
        spans = self.suspects(text)
        if not spans:
            return text, 0, 0
        lattice = [self.readings(m.group()) for m in spans]
        if all(sure for _, _, sure in lattice):
            return text, 0, 0
        n = len(STATES)
        score = [0.0 if s == _CLEAN else -_ENTER for s in range(n)]
        back: list[list[int]] = []
        for emitted, _, _ in lattice:
            top = max(range(n), key=score.__getitem__)
            to_clean, entered = score[top], score[top] - _ENTER
            came, new = [], []
            for s in range(n):
                move = to_clean if s == _CLEAN else entered
                stay = score[s]
                came.append(s if stay >= move else top)
                new.append(max(stay, move) + emitted[s])
            back.append(came)
            score = new
        state = max(range(n), key=score.__getitem__)
        path = []
        for came in reversed(back):
            path.append(state)
            state = came[state]
        path.reverse()
        out, at, damaged, lost = [], 0, 0, 0
        for m, s, (_, texts, _) in zip(spans, path, lattice):
            if s != _CLEAN and texts[s] is not None and texts[s] != m.group():
                out += [text[at:m.start()], texts[s]]
                at = m.end()
                damaged += 1
                lost += LOST in texts[s]
            elif LOST in m.group() or (s != _CLEAN and texts[s] is None):
                damaged += LOST in m.group()
                lost += LOST in m.group()
        return "".join(out) + text[at:], damaged, lost


_RUN = re.compile("[^\x00-\x7f]{2,}")


@lru_cache(maxsize=200_000)
def _undo_token(token: str) -> str:
    for read in UTF8_READ_AS:
        found = byte_lattice(token, read)
        if found and found[2] and not found[1] and found[0] != token:
            return found[0]
    return token


def undo_utf8(text: str) -> str:
    """`text` with runs of characters whose bytes are whole UTF-8 in some reading put right, without a lexicon."""
    if text.isascii():
        return text
    runs = _RUN.findall(text)
    if not runs or not any(_undo_token(r) != r for r in set(runs)):
        return text
    return _RUN.sub(lambda m: _undo_token(m.group()), text)


def _count_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(_ITEM.findall(text))
        if len(counts) > 1_000_000:
            yield _item_batch(counts)
            counts.clear()
    yield _item_batch(counts)


def _item_batch(counts: Counter) -> pa.RecordBatch:
    """Counts in lower case, and once more as written for words with a capital beyond ASCII."""
    low: Counter[str] = Counter()
    for item, n in counts.items():
        low[item.lower()] += n
        if item[0] > "\x7f" and item[0].isupper() and item[1:].islower():
            low[item] += n
    return pa.RecordBatch.from_pydict({"item": pa.array(list(low), pa.string()), "n": pa.array(list(low.values()), pa.int64())})


def item_counts(texts: DataFrame) -> DataFrame:
    """item, n: words in lower case (words with a capital beyond ASCII also as written) and signs beyond ASCII of all
    rows of `texts` (one string column)."""
    return texts.filter(F.col(texts.columns[0]).isNotNull()).mapInArrow(_count_items, "item string, n long").groupBy("item").agg(F.sum("n").alias("n"))


def frequent_items(counts: DataFrame) -> dict[str, int]:
    """The most frequent items seen more than once, at most MAX_LEXICON."""
    rows = counts.filter("n > 1").orderBy(F.desc("n"), "item").limit(MAX_LEXICON).toPandas()
    return dict(zip(rows["item"], rows["n"].astype(int)))


def frequent_items(counts: DataFrame) -> dict[str, int] | None:
    """The items seen more than once; null if there are more than MAX_LEXICON."""
    known = counts.filter("n > 1")
    if known.limit(MAX_LEXICON + 1).count() > MAX_LEXICON:
        return None
    rows = known.toPandas()
    return dict(zip(rows["item"], rows["n"].astype(int)))


_RESTORER: dict[int, Restorer] = {}


def _restore(lexicon, key: int, total: int, letters: dict[str, int]):
    """With a lexicon in null, the rows bring the words that they ask for as a fourth and fifth column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = None
        if lexicon is not None:
            restorer = _RESTORER.get(key)
            if restorer is None:
                _RESTORER.clear()
                restorer = _RESTORER[key] = Restorer(Lexicon(lexicon.value, total, letters))
        for batch in batches:
            tbl, ids, texts, damaged, lost = [], [], [], [], []
            for at, (t, i, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                own = restorer or Restorer(Lexicon(dict(zip(batch.column(3)[at].as_py() or (), batch.column(4)[at].as_py() or ())), total, letters))
                fixed, n, gone = own.restore(text)
                if n:
                    tbl.append(t)
                    ids.append(i)
                    texts.append(fixed)
                    damaged.append(n)
                    lost.append(gone)
            yield pa.RecordBatch.from_arrays([pa.array(tbl, pa.string()), pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(damaged, pa.int32()), pa.array(lost, pa.int32())], names=["tbl", "row_id", "restored", "n_damaged", "n_lost"])

    return run


class _Asking(Lexicon):
    """Knows no word and notes what it's asked for."""

    def __init__(self) -> None:
        super().__init__({}, 0, {})
        self.items: set[str] = set()
        self.gaps: set[str] = set()

    def log(self, item: str) -> float:
        self.items.add(item)
        return 0.0

    def fill(self, text: str, may=None) -> str:
        for word in _GAPPED.findall(text):
            self.gaps.add(gap_form(word.lower()))
            self.items.add(word.strip(LOST).lower())
        return text


def _asks() -> object:
    """Rows (key, kind, item): items whose counts a row's readings need (i), forms of words with gaps (g) and words that
    may be what is left of another (r)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, kinds, items = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lexicon = _Asking()
                asking = Restorer(lexicon)
                for m in asking.suspects(text):
                    asking.readings(m.group())
                    # Single-byte readings are asked for even where their words must be known.
                    for written, read in SINGLE_BYTE:
                        raw = to_bytes(m.group(), read)
                        lexicon.items.update(_ITEM.findall(raw.decode(written, errors="ignore").lower()) if raw is not None else ())
                rest = {w for w in re.findall(r"(?<![^\W_])[a-z]+(?![^\W_])", text.lower()) if len(w) >= _LEFT}
                asked = [("i", x) for x in lexicon.items if x] + [("g", x) for x in lexicon.gaps] + [("r", x) for x in rest]
                keys += [key] * len(asked)
                kinds += [k for k, _ in asked]
                items += [x for _, x in asked]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(kinds, pa.string()), pa.array(items, pa.string())], names=["key", "kind", "item"])

    return run


def rows_with_words(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """`rows` (tbl, row_id, text) with the words that their readings ask for and the words' counts. A row's list is
    bounded by its text; what is joined are words, their forms with gaps, and what is left of them without letters beyond
    ASCII."""
    known = counts.filter("n > 1").select(F.col("item").alias("word"), "n")
    inner = known.filter(F.col("word").rlike(r"[^\x00-\x7F█]") & (F.lower("word") == F.col("word")))
    gaps = inner.select(F.lit("g").alias("kind"), F.regexp_replace("word", r"[^\x00-\x7F]", LOST).alias("item"), "word", "n")
    rest = inner.select(F.lit("r").alias("kind"), F.regexp_replace("word", r"[^\x00-\x7F]", "").alias("item"), "word", "n")
    best = rest.filter(F.length("item") >= _LEFT).groupBy("kind", "item").agg(F.max_by("word", F.struct("n", "word")).alias("word"), F.max("n").alias("n"))
    table = known.select(F.lit("i").alias("kind"), F.col("word").alias("item"), "word", "n").unionByName(gaps).unionByName(best)
    keyed = rows.withColumn("key", F.xxhash64("tbl", "row_id", "text"))
    asked = keyed.select("key", "text").mapInArrow(_asks(), "key long, kind string, item string").distinct()
    found = asked.join(table, ["kind", "item"]).select("key", "word", "n")
    # A word with a capital beyond ASCII is counted once more as written, and what is left of a word is a word too.
    written = found.join(known.select(F.col("word").alias("w"), F.col("n").alias("m")), F.concat(F.upper(F.substring("word", 1, 1)), F.expr("substring(word, 2)")) == F.col("w")).filter("w <> word").select("key", F.col("w").alias("word"), F.col("m").alias("n"))
    left = asked.filter("kind = 'r'").join(known, F.col("item") == F.col("word")).select("key", "word", "n")
    lists = found.unionByName(written).unionByName(left).distinct().groupBy("key").agg(F.collect_list("word").alias("words"), F.collect_list("n").alias("ns"))
    return keyed.join(lists, "key", "left").select("tbl", "row_id", "text", "words", "ns")


def restore_encoding(parts: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """Damaged rows of several tables: tbl, row_id, restored, n_damaged (tokens), n_lost (of them not wholly restored).

    `parts` are (table name, rows, id column, text column). Word frequencies are counted over all rows of all parts.
    Null and empty texts are never damaged; repeated rows are reported each; other columns are ignored; empty tables
    give nothing.
    """
    rows = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("tbl"), F.col(i).cast("long").alias("row_id"), F.col(t).alias("text")) for name, df, i, t in parts]).filter("text IS NOT NULL")
    counts = shared(item_counts(rows.select("text")))
    out = "tbl string, row_id long, restored string, n_damaged int, n_lost int"
    seen = counts.filter("n > 1")
    total = seen.agg(F.sum("n")).first()[0] or 0
    characters = seen.filter(F.col("item").rlike(r"[^\x00-\x7F]")).select(F.explode(F.split(F.lower("item"), "")).alias("c"), "n").filter(F.col("c").rlike(r"[^\x00-\x7F]"))
    letters = dict(map(tuple, characters.groupBy("c").agg(F.sum("n")).collect()))  # at most the characters of Unicode
    known = frequent_items(counts)
    if known is None:
        return rows_with_words(rows, counts).mapInArrow(_restore(None, 0, total, letters), out)
    lexicon = rows.sparkSession.sparkContext.broadcast(known)
    return rows.mapInArrow(_restore(lexicon, lexicon._jbroadcast.id(), total, letters), out)
