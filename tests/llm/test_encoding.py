import random

import pytest

from paperloom.llm import encoding as en
from paperloom.llm.encoding import SINGLE_BYTE, UTF8_READ_AS, Lexicon, Restorer, _BYTES, byte_lattice, read_utf8, restore_encoding, undo_utf8

WORDS = "während über größere Führung été déjà société côte année español niño también—“quoted” l’heure Šukisdal Łódź".replace("—", " — ").split()
TEXTS = [f"{a} the report {b} of {c} near Kraków" for a in WORDS for b in WORDS[:6] for c in WORDS[3:9]]


def misread(text, written, read):
    back = {b: c for c, b in reversed(_BYTES[read].items())}
    return "".join(back[b] for b in text.encode(written))


@pytest.mark.parametrize("read", UTF8_READ_AS)
def test_utf8_is_undone(read):
    for word in ("déjà", "“größer”", "Łódź", "— █████"):
        for token in word.split():
            bad = misread(token, "utf-8", read)
            assert read_utf8(bad, read) == (token, 0)
            assert undo_utf8(bad) == token or read in ("iso8859_2", "iso8859_15")  # close to cp1250 and cp1252, which are tried first
    assert undo_utf8("naïve “x” Éöçãressa Šåçino ÄÖÜ ½ ©") == "naïve “x” Éöçãressa Šåçino ÄÖÜ ½ ©"


def test_twice():
    bad = misread(misread("société’s", "utf-8", "cp1252"), "utf-8", "cp1252")
    assert undo_utf8(bad) == "société’s"


@pytest.mark.parametrize("written,read", [p for p in SINGLE_BYTE if p[0] in ("cp1252", "mac_roman", "cp850")])
def test_single_bytes_by_the_lexicon(written, read):
    from paperloom.llm.encoding import _ITEM
    from collections import Counter

    counts = Counter(x for t in TEXTS for x in _ITEM.findall(t.lower()))
    r = Restorer(Lexicon(dict(counts)))
    good = "Die größere Führung während der société déjà"
    bad = misread(good, written, read)
    fixed, n, lost = r.restore(bad)
    if bad != good:
        assert fixed == good and n >= 1 and lost == 0
    assert r.restore("Plain words, and über the report — “quoted”") == ("Plain words, and über the report — “quoted”", 0, 0)


def test_lost_characters():
    from paperloom.llm.encoding import _ITEM
    from collections import Counter

    r = Restorer(Lexicon(dict(Counter(x for t in TEXTS for x in _ITEM.findall(t.lower())))))
    assert r.restore("die F�hrung") == ("die Führung", 1, 0)
    fixed, n, lost = r.restore("xq�zv")
    assert n == 1 and "�" not in fixed or lost == 1


def lexicon():
    from collections import Counter

    return Lexicon(dict(Counter(x for t in TEXTS for _ in range(30) for x in en._ITEM.findall(t.lower()))))


def test_lattice_within_a_token():
    assert byte_lattice("tÃ©légramme.", "cp1252")[0] == "télégramme." and byte_lattice("DÉJÃ€", "cp1252")[0] == "DÉJÀ"
    assert byte_lattice("société", "cp1252") is None
    text, may, whole, broken = byte_lattice("sociÃ�tÃ©", "cp1252")  # the second byte of the first letter is lost
    assert (text, whole, broken) == ("soci�té", 1, 1) and "é" in may[0] and "ł" not in may[0]
    text, may, *_ = byte_lattice("�©t", "cp1252")  # the first byte is lost
    assert text == "�t" and {"é", "©"} <= may[0] and "è" not in may[0]


@pytest.mark.parametrize("bad", ["soci��t�� d��j��", "sociÃtÃ dÃjÃ", "soci�©t�© d�©j�\xa0", "soci?t? d?j?", "soci??t?? d??j??"])
def test_lost_bytes(bad):
    """Both bytes, the second or the first of every letter lost, or a question mark for a byte or a letter."""
    fixed, n, lost = Restorer(lexicon()).restore(bad)
    if "?" in bad:
        assert n == 2 or fixed.startswith("soci")  # a question mark at a word's end proves nothing
    else:
        assert (fixed, n, lost) == ("société déjà", 2, 0)


def test_letters_dropped():
    r = Restorer(lexicon())
    assert r.restore("the grere Fhrung of it") == ("the größere Führung of it", 2, 0)
    assert r.restore("F?hrung") == ("Führung", 1, 0) and r.restore("Is it? Yes") == ("Is it? Yes", 0, 0)


def test_words_by_join(spark, monkeypatch):
    """More words than are broadcast: rows are joined with the words they ask for, with the same result."""
    rng = random.Random(5)
    rows = [(i, rng.choice(TEXTS), "n", 0) for i in range(300)]
    kinds = [lambda t, r=r: misread(t, "utf-8", r) for r in UTF8_READ_AS[:3]] + [lambda t: misread(t, "cp1252", "cp437"), lambda t: t.replace("ü", "�"), lambda t: t.replace("ü", "??"), lambda t: t.replace("ü", ""), lambda t: t.replace("é", "Ã")]
    for i in range(80):
        try:
            rows.append((1000 + i, kinds[i % len(kinds)](rng.choice(TEXTS)), "n", 0))
        except KeyError:
            pass
    rows += [rows[-1], (5000, None, "n", 0), (5001, "", "n", 0)]
    df = spark.createDataFrame(rows, "id long, text string, restored string, tbl int").repartition(3)
    want = sorted(map(tuple, restore_encoding([("t", df, "id", "text")]).collect()))
    monkeypatch.setattr(en, "MAX_LEXICON", 3)
    assert sorted(map(tuple, restore_encoding([("t", df, "id", "text")]).collect())) == want and len(want) > 40


def test_rows(spark):
    rng = random.Random(3)
    good = [(i, rng.choice(TEXTS), "n", 0) for i in range(400)]
    bad = [(1000 + i, misread(rng.choice(TEXTS), "utf-8", rng.choice(UTF8_READ_AS)), "n", 0) for i in range(60)]
    bad = [b for b in bad if b[1] not in {t for _, t, *_ in good}]
    extra = [(2000, None, "n", 0), (2001, "", "n", 0), (2002, "ascii only", "n", 0), (bad[0][0], bad[0][1], "n", 0), (2003, "é " * 100_000, "n", 0), (2004, "Привет мир, это текст", "n", 0), (2005, "Καλημέρα κόσμε", "n", 0)]
    df = spark.createDataFrame(good + bad + extra, "id long, text string, restored string, tbl int").repartition(3)
    out = restore_encoding([("t", df, "id", "text")]).collect()
    assert sorted(r["row_id"] for r in out) == sorted([b[0] for b in bad] + [bad[0][0]])
    assert all(r["restored"] in TEXTS for r in out) and all(r["n_damaged"] > 0 for r in out)
    assert restore_encoding([("t", df.limit(0), "id", "text")]).count() == 0
