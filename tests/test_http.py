"""Requests against a server on this machine."""

import hashlib
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from paperloom.operators.jobs import lease_end
from paperloom.operators.search import InvalidRequest
from paperloom.plans.artifacts import TextFolder
from paperloom.sources import http
from paperloom.sources.files import whole_texts


class Handler(BaseHTTPRequestHandler):
    def log_message(self, *args):
        pass

    def _answer(self, status, body=b"", **headers):
        self.send_response(status)
        for k, v in headers.items():
            self.send_header(k.replace("_", "-"), v)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        if self.path == "/page":
            if self.headers.get("If-None-Match") == "v1":
                return self._answer(304)
            return self._answer(200, "<a href='x'>é</a>".encode(), ETag="v1")
        if self.path in ("/to", "/away", "/round"):
            return self._answer(302, Location={"/to": "/page", "/away": "http://other.example.org/", "/round": "/round"}[self.path])
        if self.path == "/big":
            return self._answer(200, b"x" * 5000)
        return self._answer(404)

    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"]))
        self._answer(200, body if self.headers["Content-Type"] == "application/json" else b"form " + body)


@pytest.fixture(scope="module")
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_requests(spark, server):
    rows = [
        (0, server + "/page", None, None, {}, False), (1, server + "/page", "GET", None, {"If-None-Match": "v1"}, False), (2, server + "/to", "GET", None, {}, False), (3, server + "/to", "GET", None, {}, True), (4, server + "/away", "GET", None, {}, True),
        (5, server + "/none", "GET", None, None, False), (6, server + "/big", "GET", None, {}, False), (7, server + "/x", "POST_JSON", '{"a":[1]}', {}, False), (8, server + "/x", "POST_FORM", '{"q":"a b","n":2}', {}, False), (9, "file:///etc/passwd", "GET", None, {}, False),
        (10, None, "GET", None, {}, False), (11, server + "/round", "GET", None, {}, True), (12, "http://127.0.0.1:1/", "GET", None, {}, False),
    ]
    answers = http.send(spark.createDataFrame(rows, http.REQUESTS).repartition(2), most=1000, test=True).persist()
    got = {r["ord"]: r for r in answers.collect()}
    assert bytes(got[0]["content"]).decode() == "<a href='x'>é</a>" and got[0]["etag"] == "v1" and got[0]["error"] is None
    assert (got[1]["status"], got[1]["content"], got[1]["error"]) == (304, None, None)
    assert "redirects are denied" in got[2]["error"] and bytes(got[3]["content"]).startswith(b"<a") and "another host" in got[4]["error"] and "too many" in got[11]["error"]
    assert got[5]["status"] == 404 and "404" in got[5]["error"] and "more than 1000 bytes" in got[6]["error"] and "isn't https" in got[9]["error"] and got[10]["error"] and "failed" in got[12]["error"]
    assert bytes(got[8]["content"]) == b"form q=a+b&n=2"
    pay = {r["ord"]: (r["payload"], r["error"]) for r in http.payloads(answers).collect()}
    assert pay[7] == ('{"a":[1]}', None) and "isn't JSON" in pay[8][1] and "404" in pay[5][1]
    assert [r["html"] for r in http.pages(answers.filter("ord = 0")).collect()] == ["<a href='x'>é</a>"]
    assert http.send(spark.createDataFrame([], http.REQUESTS)).count() == 0
    answers.unpersist()


def test_redirects():
    ok = lambda a, b: http.redirect_refused(a, b) is None
    assert ok("https://a.org/x", "https://A.org/y") and not ok("https://a.org/x", "http://a.org/y") and not ok("https://a.org", "https://u@a.org/") and not ok("https://a.org", "https://b.org/")
    assert not ok("https://127.0.0.1/", "https://127.0.0.1/x") and not ok("https://db.internal/", "https://db.internal/x")


def test_text_files(spark, tmp_path):
    t = TextFolder(spark, str(tmp_path / "t"))
    assert t.files("k").count() == 0
    assert t.write("k", "page_text", "1.txt", "é\n") and not t.write("k", "page_text", "1.txt", "é\n") and t.write("k", "page_text", "1.txt", "f") and t.write("k", "document_text", "document.txt", "")
    (tmp_path / "t/k/page_text/odd").mkdir()
    got = {(r["kind"], r["name"]): (r["is_file"], r["sha256"]) for r in t.files("k").collect()}
    h = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {("page_text", "1.txt"): (True, h(b"f")), ("document_text", "document.txt"): (True, h(b"")), ("page_text", "odd"): (False, None)}
    (tmp_path / "t/k/page_text/2.txt").mkdir()
    for bad in (("k", "page_text", "2.txt"), ("k", "page_text", "../x.txt"), ("k", "page_text", "01.txt"), ("../k", "page_text", "1.txt"), ("k", "other", "1.txt"), ("k", "document_text", "1.txt")):
        with pytest.raises(InvalidRequest):
            t.write(*bad, "x")
    assert not [p for p in (tmp_path / "t/k").iterdir() if p.name.startswith(".staged")]
    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.txt").write_text("one\ntwo é")
    assert [r["text"] for r in whole_texts(spark, str(tmp_path / "w")).collect()] == ["one\ntwo é"]


def test_lease_end(spark):
    assert spark.range(1).select(lease_end(F.lit("2001-01-01T00:00:00Z").cast("timestamp")).alias("x")).first()["x"] == "2001-01-01T00:05:00.000Z"
