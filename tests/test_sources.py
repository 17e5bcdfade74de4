import json

import pytest
from pyspark.sql import functions as F

from paperloom.functions.html import decode_entities, plain_text, scan_html, strip_tags
from paperloom.operators.search import InvalidRequest
from paperloom.plans.ingest import ordered_assets
from paperloom.sources import adapters, base, registry

PAGES = {
    "aaro": ("https://www.aaro.mil/UAP-Records/", "/UAP-Records/a.pdf", "https://example.org/x"), "army": ("https://foia.army.mil/Home", "/Home/DocContent/7", "/other/x"), "cia": ("https://www.cia.gov/readingroom/", "/readingroom/document/x", "/about"),
    "dia": ("https://www.dia.mil/FOIA/", "/Portals/1/a.pdf", "/News/x"), "doe": ("https://www.osti.gov/opennet/", "/opennet/detail?osti-id=1", "/search"), "doj_epstein": ("https://www.justice.gov/epstein", "/epstein/files/a.pdf", "/news"),
    "doj_foia": ("https://www.justice.gov/oip", "https://www.atf.gov/foia", "https://example.org"), "dtic": ("https://apps.dtic.mil/sti/", "/sti/citations/ADA1234567", "/other"), "fbi_vault": ("https://vault.fbi.gov/x", "/case/part-1", "https://www.fbi.gov/x"),
    "frus": ("https://history.state.gov/search", "/historicaldocuments/frus1969-76v12/d34", "/historicaldocuments/frus1969-76v12"), "navy": ("https://www.secnav.navy.mil/foia/x", "/ig/report.pdf", "/news"), "noaa": ("https://repository.library.noaa.gov/x", "/view/noaa/16063", "/browse"),
    "nsa": ("https://www.nsa.gov/x", "/Helpful-Links/NSA-FOIA/Reading-Room/document", "/About"), "osd_joint_staff": ("https://www.esd.whs.mil/x", "/Portals/54/a.pdf", "/Other"), "state": ("https://foia.state.gov/Search/x", "/documents/a.pdf", "/about"),
}


@pytest.mark.parametrize("name", PAGES)
def test_html_sources(spark, name):
    page, good, bad = PAGES[name]
    html = f"<html><h1>List</h1><a href='{good}'>A good record document</a><a href='{bad}'>Bad record document</a><a href='{good}'>Second label document</a><a href='{good}'>Home</a></html>"
    source = registry.source_named(name)
    rows = adapters.html_rows(source, spark.createDataFrame([(0, page, html)], "ord int, page_url string, html string"))
    records = base.records_of(source, rows).collect()
    assert [r["title"] for r in records] == ["A good record document"]
    r = records[0]
    assert r["id"] == f"{name}:{r['source_id']}" and r["document_key"].startswith(name + "-") and r["source"] == name and r["attachments"][0]["asset_url"] == r["document_url"]
    assert (r["pdf_url"] is not None) == r["document_url"].endswith(".pdf") and r["metadata"]["source_url"] == r["document_url"]
    empty = base.search_listing(source, adapters.html_rows(source, spark.createDataFrame([(0, page, "<p>nothing"), (1, page, None)], "ord int, page_url string, html string")), "x")
    assert empty.records.isEmpty() and empty.warnings


def test_every_source_has_a_test_or_another_form():
    assert {s.name for s in registry.SOURCES if s.kind.startswith("html")} == set(PAGES) and len(registry.SOURCES) == 18
    with pytest.raises(InvalidRequest):
        registry.source_named("nowhere")


def test_tables(spark):
    html = "<table><tr><th>Title</th><th>Subject</th></tr><tr><td>Memo one</td><td>Subj</td><td></td><td>1967</td><td>Office</td><td><a href='/Home/DocContent/5'>View</a></td></tr><tr><td>Memo two</td><td></td><td></td><td></td><td></td><td><a href='/Home/DocContent/6'>View</a></td></tr></table>"
    source = registry.source_named("army")
    records = base.records_of(source, adapters.html_rows(source, spark.createDataFrame([(0, "https://foia.army.mil/Home", html)], "ord int, page_url string, html string"))).orderBy("pos").collect()
    assert [(r["title"], r["date"], r["source_id"], r["metadata"].get("subject"), r["metadata"].get("originator"), "keywords" in r["metadata"]) for r in records] == [("Memo one", "1967", "Home/DocContent/5", "Subj", "Office", False), ("Memo two", None, "Home/DocContent/6", None, None, False)]
    navy = registry.source_named("navy")
    html = "<table><tr><td><a href='/navaudsvc/a.pdf'>Audit</a></td><td>Topic</td><td>1 May 1999</td><td>Office</td></tr></table><a href='/ig/FOIA/x.pdf'>IG FOIA</a><a href='/ig/'>Reading Room</a>"
    r = base.records_of(navy, adapters.html_rows(navy, spark.createDataFrame([(0, "https://www.secnav.navy.mil/foia/", html)], "ord int, page_url string, html string"))).orderBy("pos").collect()
    assert [(x["title"], x["date"], x["description"], x["record_group"], x["collection"]) for x in r] == [("Audit", "1 May 1999", "Topic; Office", "naval_audit_service", "Naval Audit Service FOIA Reading Room"), ("IG FOIA", None, None, "naval_inspector_general", "Naval Inspector General FOIA Reading Room")]


def listed(spark, name, page, links):
    html = "".join(f"<a href='{h}'>{t}</a>" for h, t in links)
    source = registry.source_named(name)
    return base.records_of(source, adapters.html_rows(source, spark.createDataFrame([(0, page, html)], "ord int, page_url string, html string"))).orderBy("pos").collect()


def test_categories_groups_and_leads(spark):
    r = listed(spark, "doj_epstein", "https://www.justice.gov/epstein", [("/epstein/doj-disclosures/data-set-04-files", "Data Set 4 Files"), ("/epstein/doj-disclosures/court-records-x", "A v. B"), ("/epstein/doj-disclosures/foia-bop", "FOIA: Bureau"), ("/epstein/doj-disclosures/maxwell-proffer", "Proffer"), ("/media/9/dl", "Memorandum"), ("/media/8/dl", "Photo"), ("/epstein/doj-disclosures/", "Home"), ("/Epstein/doj-disclosures/x", "Case")])
    assert [(x["metadata"]["category"], x["metadata"].get("data_set")) for x in r] == [("efta_data_set", "04"), ("court_record", None), ("foia", None), ("prior_doj_disclosure", None), ("release", None)]
    r = listed(spark, "doj_foia", "https://www.justice.gov/oip", [("https://www.atf.gov/readingroom", "A"), ("https://www.dea.gov/foia-library", "B"), ("/x/foia", "C"), ("/x/y", "D"), ("https://evil-justice.gov.example.org/", "E")])
    assert [x["metadata"]["disclosure_category"] for x in r] == ["foia_reading_room", "foia_library", "proactive_disclosure", "component_disclosure"]
    r = listed(spark, "fbi_vault", "https://vault.fbi.gov/x", [("/proactive-disclosure/a", "A part 2"), ("/discretionary-x", "B"), ("/all-files", "C"), ("/case", "D")])
    assert [(x["metadata"]["category"], x["metadata"].get("part")) for x in r] == [("proactive_disclosure", "2"), ("discretionary_release", None), ("all_files", None), ("vault_file", None)]
    r = listed(spark, "nsa", "https://www.nsa.gov/x", [("/Helpful-Links/NSA-FOIA/Declassified-Documents/FOIA-x", "FOIA x"), ("/Helpful-Links/NSA-FOIA/FOIA-Handbook", "FOIA Handbook"), ("/portals/75/documents/a.pdf", "A"), ("/PORTALS/75/documents/b.pdf", "B pdf"), ("/Helpful-Links/NSA-FOIA/other", "no lead")])
    assert [(x["record_group"], x["collection"]) for x in r] == [("foia_reports_and_releases", "NSA FOIA Reports and Releases"), ("reading_room_policy", "NSA FOIA Reading Room Policy Records"), ("reading_room", "NSA FOIA Reading Room")]
    r = listed(spark, "aaro", "https://www.aaro.mil/", [("/UAP-Cases/a", "Case Resolution of A"), ("/UAP-Records/white-paper", "A paper"), ("/UAP-Records/x.pdf", "X"), ("/About", "About"), ("https://www.dvidshub.net/video/1", "V"), ("https://example.org/a.pdf", "pdf")])
    assert [(x["record_group"], x["collection"]) for x in r] == [("case_resolution", "AARO UAP Case Resolution Reports"), ("information_papers", "AARO Information Papers"), ("records", "AARO UAP Records"), ("records", "AARO UAP Records")]
    r = listed(spark, "state", "https://foia.state.gov/Search/", [("/FOIALIBRARY/SearchResults.aspx?caseNumber=F-1990-04213", "Case"), ("/Search/x", "Site map")])
    assert [x["metadata"].get("case_number") for x in r] == ["F-1990-04213"] and all(x["metadata"]["source_warning"] for x in r)


def test_paging(spark):
    cia = registry.source_named("cia")
    pages = [(n, "https://www.cia.gov/readingroom/", "".join(f"<a href='/readingroom/document/{n}-{k}'>D {n} {k}</a>" for k in range(3))) for n in range(2)]
    rows = adapters.html_rows(cia, spark.createDataFrame(pages, "ord int, page_url string, html string"))
    one = base.search_listing(cia, rows, "", 10)
    two = base.search_listing(cia, rows, "", 10, one.next_cursor)
    assert [r["title"] for r in one.records.collect()] == ["D 0 0", "D 0 1", "D 0 2"] and one.next_cursor == "cia-page-1" and two.records.count() == 3 and two.next_cursor is None
    nara = registry.source_named("nara")
    payload = json.dumps({"hits": [{"naId": n, "title": f"T{n}"} for n in range(5)]})
    rows = adapters.json_rows(nara, spark.createDataFrame([(0, payload)], "ord int, payload string"))
    seen, cursor = [], None
    for _ in range(3):
        page = base.search_listing(nara, rows, "", 2, cursor)
        seen += [r["source_id"] for r in page.records.collect()]
        cursor = page.next_cursor
    assert seen == ["0", "1", "2", "3", "4"] and cursor is None


def test_json(spark):
    nara = '{"body":{"hits":{"total":2,"hits":[{"_source":{"naId":7,"title":" T ","inclusiveStartDate":"1967","digitalObjects":[{"objectUrl":"https://s3.amazonaws.com/a/b.pdf?x=1","thumb":"https://s3.amazonaws.com/t.JPG"},{"objectUrl":"https://s3.amazonaws.com/a/b.pdf?x=1"},{"u":"https://x.org/page"}]}},{"title":"no id"}]}}}'
    gov = '{"count":1,"results":[{"title":"G","packageId":"P","granuleId":"Q","governmentAuthor":["a","b","a"],"download":{"zipLink":"https://api.govinfo.gov/packages/P/zip","pdfLink":"https://api.govinfo.gov/packages/P/granules/Q/pdf","xmlLink":"https://api.govinfo.gov/packages/P/xml","oddLink":"https://api.govinfo.gov/packages/P/granules/Q/odd","modsLink":"https://evil.org/packages/P/granules/Q/mods","txtLink":""}}]}'
    df = lambda x: spark.createDataFrame([(0, x), (1, "not json"), (2, '{"results":{}}')], "ord int, payload string")
    r = base.records_of(registry.source_named("nara"), adapters.json_rows(registry.source_named("nara"), df(nara))).collect()
    assert len(r) == 1 and (r[0]["source_id"], r[0]["title"], r[0]["date"], r[0]["pdf_url"]) == ("7", "T", "1967", "https://s3.amazonaws.com/a/b.pdf?x=1") and [(a["label"], a["role"], a["mime_type"]) for a in r[0]["attachments"]] == [("b.pdf", "pdf", "application/pdf"), ("t.JPG", "image", "image/jpeg")]
    r = base.records_of(registry.source_named("govinfo"), adapters.json_rows(registry.source_named("govinfo"), df(gov))).first()
    assert r["source_id"] == "P/Q" and r["metadata"]["authors"] == "a | b" and r["pdf_url"] == "https://www.govinfo.gov/content/pkg/P/pdf/Q.pdf"
    assert [(a["label"], a["role"], a["asset_url"].rsplit("/", 1)[1]) for a in r["attachments"]] == [("PDF", "pdf", "Q.pdf"), ("ZIP", "other", "zip"), ("ODD", "other", "odd")]
    with pytest.raises(adapters.SourceChanged):
        adapters.check_payloads(df(gov), ("results",))


def test_csv(spark, tmp_path):
    path = tmp_path / "i.csv"
    path.write_text('Agency,Release Date,Incident Date,Type,VIRIN,File Name,URL\nX , 2001,,pdf,V-1,"A ""quoted""\nname", https://e.org/a.pdf \n,,,,,,\nY,2002,1999,mp4,V-2,B,https://e.org/b.mp4\nX,2001,,pdf,V-1,again,https://e.org/c.pdf\n')
    source = registry.source_named("pursue")
    out = base.search_listing(source, adapters.csv_rows(source, adapters.read_index(spark, str(path))), "")
    got = [(r["source_id"], r["title"], r["date"], r["metadata"]["agency"]) for r in out.records.collect()]
    assert got == [("V-1", 'A "quoted"\nname', "2001", "X"), ("V-2", "B", "1999", "Y")]


def test_html_scan(spark):
    s = scan_html("<title>T &amp; U</title><script>var x='<a href=q>'</script><dl><dt>Date:</dt><dd>1 <b>May</b></dd></dl><a href='x'>one<br>two<a href=y>three")
    assert s.texts["title"] == "T & U" and [h for h, _ in s.anchors] == ["y", "x"] and s.anchors[1][1].startswith("one two")
    assert ("Date", "1 May") in s.pairs and "var" not in "".join(s.all)
    assert strip_tags("a<b>c > d") == "a c > d" and decode_entities("&amp;lt;") == "<"
    df = spark.createDataFrame([("<p>a&nbsp; b</p>",), (None,)], "h string").select(plain_text()(F.col("h")).alias("t")).collect()
    assert [r["t"] for r in df] == ["a  b", None]


def test_single_source_operators(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert [one(adapters.part_number(F.lit(x))) for x in ("Part 03 of 7", "PART-12", "nothing", "part 99999999999999999999", "part 65536")] == [3, 12, None, None, None]
    assert one(adapters.data_set_number(F.lit("https://x/data-set-04"), F.lit("Data Set 9"))) == "04" and one(adapters.data_set_number(F.lit("x"), F.lit("Data Set 9"))) == "9" and one(adapters.data_set_number(F.lit("x/data_set_4"), F.lit("DataSet 9"))) is None
    assert one(adapters.accessions(F.lit("see ada123456, AD-A123456 or ADA123456 AD1 "))) == ["ADA123456"]
    assert one(adapters.joined_entities(F.array(F.lit(" a  b"), F.lit("c"), F.lit("a b"), F.lit(" ")))) == "a b | c"
    assert [one(adapters.agency_of(F.lit(x))) for x in ("By NASA and the FAA", "KONA BLUE, held by the National Archives", "ORNL", "x")] == ["National Aeronautics and Space Administration (NASA)", "Department of Homeland Security (DHS)", "Oak Ridge National Laboratory (ORNL)", "All-domain Anomaly Resolution Office (AARO)"]
    assets = "array<struct<asset_url:string,label:string,mime_type:string,role:string>>"
    df = spark.createDataFrame([(1, [("u1", "Appendix", None, "pdf"), ("u2", "Body", None, "pdf"), ("u3", "b", None, "html"), ("u2", "again", None, "pdf"), ("u4", "a", None, "html")])], f"record_seq int, attachments {assets}")
    assert df.select(adapters.pdf_before_appendix(F.col("attachments")).alias("x")).first()["x"] == "u2"
    assert [r["asset_url"] for r in ordered_assets(df, "documents").orderBy("position").collect()] == ["u1", "u2", "u4", "u3"]


def test_merge(spark):
    schema = "source_id string, title string, pdf_url string, description string, metadata map<string,string>, attachments array<struct<asset_url:string,label:string,mime_type:string,role:string>>, ord int"
    rows = [("b", "first", None, None, {"x": "1"}, [("u1", "l", None, "pdf")], 0), ("b", "second", "p", "d", {"x": "2", "y": "3"}, [("u1", "m", None, "pdf"), ("u2", "n", None, "html")], 1), ("a", "only", None, None, None, None, 2)]
    got = adapters.merge_duplicates(spark.createDataFrame(rows, schema), "ord").collect()
    assert [r["source_id"] for r in got] == ["a", "b"] and got[1]["title"] == "first" and got[1]["pdf_url"] == "p" and got[1]["metadata"] == {"x": "1", "y": "3"} and [a["label"] for a in got[1]["attachments"]] == ["l", "n"]


def test_detail(spark):
    html = "<h1>Report 5</h1><dl><dt>Publication Date:</dt><dd>May 1970</dd><dt>Author</dt><dd></dd></dl><a href='/sti/pdfs/ADA1.pdf'>appendix A</a><a href='/sti/pdfs/ADA2.pdf'>text</a>"
    r = adapters.detail_record(registry.source_named("dtic"), spark.createDataFrame([("https://apps.dtic.mil/sti/citations/ADA1", html)], "page_url string, html string"), {"date": ("publicationdate",), "author": ("author",)}).first()
    assert r["title"] == "Report 5" and r["metadata"]["date"] == "May 1970" and "author" not in r["metadata"] and r["pdf_url"].endswith("ADA2.pdf") and len(r["attachments"]) == 2


def test_cursors():
    cia = registry.source_named("cia")
    assert base.decode_cursor(cia, base.encode_cursor(cia, 3), 0) == 3 and base.decode_cursor(cia, None, 1) == 1
    with pytest.raises(InvalidRequest):
        base.decode_cursor(cia, "nara-offset-3", 0)


def test_merged_listing(spark):
    r = listed(spark, "noaa", "https://repository.library.noaa.gov/x", [("/view/noaa/16063", "Report"), ("/view/noaa/16063", "Second label"), ("/view/noaa/9", "Nine")])
    assert [(x["source_id"], x["title"], len(x["attachments"])) for x in r] == [("view/noaa/16063", "Report", 1), ("view/noaa/9", "Nine", 1)]
