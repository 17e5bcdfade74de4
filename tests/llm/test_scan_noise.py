from paperloom.llm import repeated_lines as rl
from paperloom.llm import scan_noise as sn
from paperloom.llm.scan_noise import corrections, fold, header_form, line_end_pairs, paragraphs, repair_scans, roman, states_page

SCHEMA = "page_row_id long, document_key string, source string, page_number int, text string, repaired string, n_char int"
SENTENCES = ["the secretary reported about the northern harbor and the commission", "another committee examined the financial document before the minister", "their delegation returned to the embassy after the annual meeting", "the long-range survey measured the long-range current of the strait"]


def test_page_numbers():
    for good in ("12", " - 12 - ", "[12]", "—12—", "p. 12", "Page 12 of 40", "12.", "l2", "xii", "XII", "1Z"):
        assert states_page(good, 12), good
    for bad in ("13", "1994", "12 apples", "", "page", "x1i2"):
        assert not states_page(bad, 12), bad
    assert states_page("- . " * 200 + "12" + " - ." * 200, 12) and not states_page("." * 100_000 + "x", 12)
    assert not states_page("12", None) and roman(1994) == "mcmxciv"


def test_folding():
    for misread in ("f0rmal d0cket", "forrnal docket", "formol docket", "f{ormal".replace("{o", "o") + " docket", "formal clocket", "fonnal docket".replace("nn", "rrn".replace("rrn", "rm"))):
        assert fold(misread) == fold("formal docket"), misread
    assert header_form("4   Formal Docket — Series 92", 4) == header_form("Forrnal D0cket — Series 92   17", 17) == header_form(" Formal Docket — Series 92 ", 3)
    assert header_form("Series 15", 15) == header_form("Series 15", 4)


def test_line_ends():
    text = "first sec-\nond third¬ \nfourth x — \ny inter-\n  agency end-"
    assert [(a, s, b) for _, a, s, b, _ in line_end_pairs(text)] == [("sec", "-", "ond"), ("third", "¬", "fourth"), ("inter", "-", "agency")]


def test_corrections(spark):
    counts = [("the", 5000), ("tlie", 9), ("thc", 8), ("committee", 300), ("commiffee", 2), ("cornmittee", 3), ("and", 900), ("arid", 800), ("form", 100), ("forrn", 40), ("zzz", 1), ("", 3), ("modern", 90), ("modem", 1), ("on", 700), ("ri", 1)]
    got = dict(map(tuple, corrections(spark.createDataFrame(counts, "word string, n long")).collect()))
    assert got == {"tlie": "the", "thc": "the", "commiffee": "committee", "cornmittee": "committee"}
    assert corrections(spark.createDataFrame([], "word string, n long")).count() == 0


def test_paragraphs():
    assert paragraphs(["A line of the usual width of all lines", "that ends soon.", "Next one starts here and is as wide", "", "HEADING IN CAPITALS", "Last"]) == ["A line of the usual width of all lines\nthat ends soon.", "Next one starts here and is as wide", "HEADING IN CAPITALS", "Last"]


def pages():
    rows, n = [], 0
    for d in range(30):
        for p in range(1, 6):
            unique = ["".join(chr(97 + int(c)) for c in str(1000 + n * 10 + k)) for k in range(5)]
            body = [f"{w}z {SENTENCES[(d + p + k) % 4]} of {w}q" for k, w in enumerate(unique)]
            if d % 3 == 0:
                body[1] = body[1].replace("the ", "tlie ", 1)
            if d % 5 == 0:
                body[2] = body[2][:26] + ("-\n" if body[2][25].isalpha() and body[2][26].isalpha() else "\n") + body[2][26:]
            if d % 4 == 0:
                own = "".join(chr(97 + int(c)) for c in str(1000 + d))
                body.insert(0, f"{p}   Annual Report {own} Section" if p % 2 else f"Annual Report {own} Section   {p}".replace("t", "f"))
            if d % 2:
                body.append(f"- {p} -")
            n += 1
            rows.append((n, f"doc{d}", "s", p, "\n".join(body), "clash", 0))
    return rows


def test_repair(spark):
    rows = pages()
    extra = [(900, "doc0", "s", 1, rows[0][4], "c", 0), (901, None, "s", None, "the committee", "c", 0), (902, "doc1", None, 9, None, "c", 0), (903, "doc1", "s", 7, " \n", "c", 0), (904, "big", "s", 1, "the minister " * 40_000, "c", 0)]
    df = spark.createDataFrame(rows + extra, SCHEMA).repartition(4)
    got = {r["page_row_id"]: r for r in repair_scans(df).collect()}
    assert set(got) == {r[0] for r in rows + extra} - {902}
    for i, key, _, p, text, *_ in rows:
        d, r = int(key[3:]), got[i]
        assert (r["n_char"] > 0) == ("tlie" in text), (i, text, r)
        assert (r["n_header"] > 0) == (d % 4 == 0) and (r["n_page_no"] > 0) == (d % 2 == 1)
        assert (r["n_hyphen"] > 0) == ("-\n" in text and "long-\n" not in text)
        assert "tlie" not in r["repaired"] and "Section" not in r["repaired"] and "\n- " not in r["repaired"]
    assert got[903]["repaired"] == "" and got[904]["n_char"] == 0
    assert repair_scans(df.limit(0)).count() == 0


def test_decisions_by_join(spark, monkeypatch):
    """Headers, corrections, compounds and site lines beyond what is broadcast give the same pages."""
    site = [(i + 5000, f"doc{i % 30}", "s", 9, f"This notice stands on every page of site\n{r[4]}", "clash", 0) for i, r in enumerate(pages()[:60])]
    df = spark.createDataFrame(pages() + site, SCHEMA)
    want = sorted(map(tuple, repair_scans(df).collect()))
    assert sum(r[3] for r in want) and sum(r[2] for r in want)
    for module, name in ((sn, "MAX_HEADERS"), (sn, "MAX_DECISIONS"), (rl, "MAX_BROADCAST_LINES")):
        monkeypatch.setattr(module, name, 0)
        assert sorted(map(tuple, repair_scans(df).collect())) == want


def test_words_broken_between_capitals_and_on_wide_pages(spark):
    wide = "the whole report of this long session was read once more and printed in a very wide setting on one sheet for the "
    texts = [
        "SECRET CABLE TO THE COMMIT-\nTEE ON FOREIGN RELA-\nTIONS\nTHE END -\nOF PAGE\nplain words",
        f"{wide}commit-\n{wide}members of the assem-\nbly met {wide}\n{wide}",
        "TOP COMMIT-\n\nTEE",
        "MEMORANDUM ON INTER-\nNo deputy came",
    ]
    df = spark.createDataFrame([(i, f"d{i}", "s", 1, t) for i, t in enumerate(texts)], "page_row_id long, document_key string, source string, page_number int, text string")
    got = {r["page_row_id"]: (r["n_hyphen"], r["repaired"]) for r in repair_scans(df).collect()}
    assert [got[i][0] for i in range(4)] == [2, 2, 0, 0]
    assert got[0][1] == "SECRET CABLE TO THE COMMITTEE ON FOREIGN RELATIONS\n\nTHE END -\n\nOF PAGE\n\nplain words"
    assert "committhe whole report" in got[1][1] and "assembly met" in got[1][1]
