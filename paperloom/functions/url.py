"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"(?i)\A([a-z][a-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?\z"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def host(url: Column) -> Column:
    """Host in lower case without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(url, _PARTS, 2), r"\A.*@", ""), r":\d*\z", ""))


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), F.lower(F.regexp_extract(url, _PARTS, 2)))


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 3)


def query(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 4), F.lit(""))


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, plain http made https, no fragment, no default port."""
    safe = F.when(scheme(url) == "http", F.lit("https")).otherwise(scheme(url))
    authority = F.regexp_replace(F.lower(F.regexp_extract(url, _PARTS, 2)), r":(?:443|80)\z", "")
    q = query(url)
    return F.when(url.rlike(_PARTS), F.concat(safe, F.lit("://"), authority, F.when(path(url) == "", F.lit("/")).otherwise(path(url)), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))).otherwise(url)


def absolutize(href: Column, base: Column) -> Column:
    """An absolute link as it is; `//host` with the base's scheme; `/path` on its origin; anything else in its folder."""
    folder = F.regexp_replace(F.when(path(base) == "", F.lit("/")).otherwise(path(base)), r"[^/]*\z", "")
    return (
        F.when(href.rlike(r"(?i)\A[a-z][a-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin(base), href))
        .when(href.startswith("?"), F.concat(origin(base), path(base), href))
        .otherwise(F.concat(origin(base), folder, F.regexp_replace(href, r"\A(?:\./)+", "")))
    )


def same_origin(url: Column, base: Column) -> Column:
    """Same scheme and host, whatever the case."""
    return F.coalesce((scheme(url) == scheme(base)) & (host(url) == host(base)) & (host(url) != ""), F.lit(False))


def source_id_of(url: Column, when_empty: str) -> Column:
    """Path without slashes at its ends and the query, if any."""
    p = F.regexp_replace(path(url), r"\A/+|/+\z", "")
    q = query(url)
    return F.concat(F.when(p == "", F.lit(when_empty)).otherwise(p), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))


def without_query(url: Column) -> Column:
    """In lower case without query and fragment."""
    return F.lower(F.regexp_replace(url, r"[?#].*\z", ""))


def percent_encode(text: Column) -> Column:
    """Everything but the unreserved characters A-Z a-z 0-9 - . _ ~ as bytes in percent form."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def plus_encode(text: Column) -> Column:
    """As `percent_encode` with + for blanks."""
    return F.replace(percent_encode(text), F.lit("%20"), F.lit("+"))


def parameter(url: Column, name: str) -> Column:
    """Value of the first query parameter of that name, whatever its case; null if there is none."""
    pattern = rf"(?i)(?:\A|&){name}=([^&]*)"
    return F.when(query(url).rlike(pattern), F.regexp_extract(query(url), pattern, 1))


def under_prefix(url: Column, prefix: str) -> Column:
    """Whether the URL is the https prefix or below it at a path boundary; no dots segments, no user."""
    clean = prefix.rstrip("/")
    return F.coalesce((url == clean) | url.startswith(clean + "/") | url.startswith(clean + "?"), F.lit(False)) & ~url.rlike(r"(?i)(/|%2f)\.\.?(/|%2f|\z)|@") & F.lit(prefix.startswith("https://"))


_BLOCKED_NAMES = r"(?i)\A(localhost|.*\.(localhost|local|internal|lan|home|corp|test|example|invalid))\z"


def redirect_allowed(url: Column, target: Column, deny: bool = True) -> Column:
    """Whether a fetch may follow a redirect: never under the policy `deny`; else only to https without user, on the
    same host, that is neither an address nor a local name."""
    if deny:
        return F.lit(False)
    user = F.regexp_extract(target, _PARTS, 2).contains("@")
    address = host(target).rlike(r"\A(\d{1,3}(\.\d{1,3}){3}|\[.*\])\z")
    return F.coalesce((scheme(target) == "https") & ~user & (host(url) == host(target)) & ~address & ~host(target).rlike(_BLOCKED_NAMES), F.lit(False))
