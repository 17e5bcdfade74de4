"""Requests to sources as a table: pages, JSON answers, forms and bounded downloads.

Every row is one request; tasks send theirs one after the other, so the number of partitions bounds how many a source gets
at once. Redirects aren't followed unless the request allows it and their target is on the same host. An answer that
isn't usable has an error and no body, and stops no other.
"""

from __future__ import annotations

import ipaddress
import json
import re
import socket
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.sources.files import MAX_BYTES

TIMEOUT = 20
AGENT = "paperloom/1 (public records research)"
REQUESTS = "ord int, url string, method string, body string, headers map<string,string>, follow boolean"
ANSWERS = "ord int, page_url string, status int, content binary, etag string, last_modified string, location string, error string"
MAX_HOPS = 5
_LOCAL_NAME = re.compile(r"(?:.*\.)?(?:localhost|local|internal|lan|home|corp)\Z", re.I)


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args, **kwargs):
        return None


def redirect_refused(address: str, target: str, test: bool = False) -> str | None:
    """Why a redirect may not be followed; null if it may. `test` lets plain http on one machine pass."""
    a, b = urllib.parse.urlsplit(address), urllib.parse.urlsplit(target)
    if b.scheme.lower() != "https" and not (test and b.scheme == "http"):
        return "the target isn't https"
    if b.username is not None or b.password is not None:
        return "the target has a user"
    if (a.hostname or "").lower() != (b.hostname or "").lower():
        return "the target is on another host"
    if test:
        return None
    if _LOCAL_NAME.match(b.hostname or ""):
        return "the target is a local name"
    try:
        ipaddress.ip_address(b.hostname or "")
    except ValueError:
        return None
    return "the target is an address"


def _send(address: str, method: str, body: str | None, headers: dict, follow: bool, most: int, test: bool) -> dict:
    out = {"status": None, "content": None, "etag": None, "last_modified": None, "location": None, "error": None}
    opener = urllib.request.build_opener(_Stay)
    own = {"User-Agent": AGENT, **headers}
    data = None
    if method == "POST_JSON":
        data, own["Content-Type"] = (body or "{}").encode(), "application/json"
    elif method == "POST_FORM":
        data, own["Content-Type"] = urllib.parse.urlencode(json.loads(body or "{}")).encode(), "application/x-www-form-urlencoded"
    elif method != "GET":
        return out | {"error": f"unknown method {method!r}"}
    for hop in range(MAX_HOPS + 1):
        if not address.lower().startswith("https://") and not (test and address.startswith("http://")):
            return out | {"error": "the address isn't https"}
        try:
            with opener.open(urllib.request.Request(address, data=data, headers=own), timeout=TIMEOUT) as r:
                content = r.read(most + 1)
                out |= {"status": r.status, "etag": r.headers.get("ETag"), "last_modified": r.headers.get("Last-Modified")}
                if len(content) > most:
                    return out | {"error": f"the answer has more than {most} bytes"}
                return out | {"content": content}
        except urllib.error.HTTPError as e:
            e.close()
            location = e.headers.get("Location")
            out |= {"status": e.code, "location": location}
            if e.code == 304:
                return out
            if 300 <= e.code < 400 and location:
                target = urllib.parse.urljoin(address, location)
                why = redirect_refused(address, target, test) if follow else "redirects are denied"
                if why or hop == MAX_HOPS or data is not None:
                    return out | {"error": f"redirected to {location}: {why or 'too many redirects'}"}
                # What a cache knows is about the first address only.
                address, own = target, {k: v for k, v in own.items() if k not in ("If-None-Match", "If-Modified-Since")}
                continue
            return out | {"error": f"the source answered with {e.code}"}
        except (urllib.error.URLError, socket.timeout, OSError, ValueError) as e:
            return out | {"error": f"the request failed: {getattr(e, 'reason', e)}"}
    return out


def send(requests: DataFrame, most: int = MAX_BYTES, test: bool = False) -> DataFrame:
    """Answers of requests (ord, url, method: GET, POST_JSON or POST_FORM, body: JSON, headers, follow). Null methods are
    GET. A 304 is an answer without content and without error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for o, address, method, body, headers, follow in zip(*(frame[c] for c in ("ord", "url", "method", "body", "headers", "follow"))):
                answer = _send(address or "", method or "GET", body, dict(headers or {}), bool(follow), most, test)
                rows.append({"ord": o, "page_url": address, **answer})
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ANSWERS.split(", ")])

    return requests.select(*[c.split()[0] for c in REQUESTS.split(", ")]).mapInPandas(run, ANSWERS)


def pages(answers: DataFrame) -> DataFrame:
    """ord, page_url, html of answers with a body, as the listings' readers take them."""
    return answers.filter("content IS NOT NULL").select("ord", "page_url", F.decode("content", "UTF-8").alias("html"))


def payloads(answers: DataFrame) -> DataFrame:
    """ord, payload, error of JSON answers; one that isn't JSON has the error that its source has changed."""
    text = F.decode("content", "UTF-8")
    good = F.try_parse_json(text).isNotNull()
    return answers.select("ord", F.when(good, text).alias("payload"), F.coalesce("error", F.when(F.col("content").isNotNull() & ~good, F.lit("the source has changed: its answer isn't JSON"))).alias("error"))


def get(ord_: Column, url: Column, headers: Column | None = None, follow: bool = False) -> Column:
    """A GET request as a struct of the columns of REQUESTS."""
    none = F.lit(None).cast("string")
    return F.struct(ord_.cast("int").alias("ord"), url.alias("url"), F.lit("GET").alias("method"), none.alias("body"), (headers if headers is not None else F.create_map().cast("map<string,string>")).alias("headers"), F.lit(follow).alias("follow"))
