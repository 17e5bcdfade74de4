"""Identity: document keys, public ids, digests, locators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.text import slug

# Fixed values of the FNV-1a hash of 64 bits.
_OFFSET = 0xCBF29CE484222325
_PRIME_LOW = 0x1B3  # the prime is 2^40 + 0x1B3
_MASK = 0xFFFFFFFF
KEY_PATTERN = r"\A[A-Za-z0-9_-]{1,160}\z"


def fnv64(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes as 16 lower-case hexadecimal digits.

    A fold over the bytes with the state in two halves of 32 bits, so no product leaves 63 bits. Null stays null.
    """
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))
    digit = lambda p, k: F.position(F.substr(p, F.lit(k), F.lit(1)), F.lit("0123456789ABCDEF")) - 1
    state = F.struct(F.lit(_OFFSET >> 32).cast("long").alias("hi"), F.lit(_OFFSET & _MASK).cast("long").alias("lo"))

    def step(acc: Column, pair: Column) -> Column:
        lo = acc["lo"].bitwiseXOR((digit(pair, 1) * 16 + digit(pair, 2)).cast("long"))
        low = lo * _PRIME_LOW
        hi = (acc["hi"] * _PRIME_LOW + F.shiftright(low, 32) + lo * 256).bitwiseAND(F.lit(_MASK))
        return F.struct(hi.cast("long").alias("hi"), low.bitwiseAND(F.lit(_MASK)).cast("long").alias("lo"))

    hexed = F.aggregate(pairs, state, step, lambda acc: F.concat(F.lpad(F.hex(acc["hi"]), 8, "0"), F.lpad(F.hex(acc["lo"]), 8, "0")))
    return F.lower(hexed)


def document_key(source: Column, source_id: Column) -> Column:
    """`source-` and the hash of `source:source_id`; for `frus` a slug of the id instead."""
    return F.when(source == "frus", F.concat(F.lit("frus-"), slug(source_id))).otherwise(F.concat(source, F.lit("-"), fnv64(F.concat(source, F.lit(":"), source_id))))


def public_id(source: Column, source_id: Column) -> Column:
    return F.concat(source, F.lit(":"), source_id)


def is_key(key: Column) -> Column:
    return F.coalesce(key.rlike(KEY_PATTERN), F.lit(False))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def cache_key(source: Column, url: Column) -> Column:
    """Key of a fetched asset in the cache."""
    return F.concat(F.lit("asset:sha256:"), F.sha2(F.concat(F.lit("asset-download:v1\0"), source, F.lit("\0GET\0"), url), 256))


def locator_parts(locator: Column) -> Column:
    """struct(source, source_id, ok): a locator is `source:id`; URLs, paths, `..` and drive letters are refused."""
    source, rest = F.split_part(locator, F.lit(":"), F.lit(1)), F.regexp_extract(locator, r"\A[^:]*:(.*)\z", 1)
    refused = rest.rlike(r"\A(//|/|\\|\./|\.\\|~)") | rest.rlike(r"(^|[/\\])\.\.([/\\]|$)") | source.rlike(r"(?i)\A(https?|file|ftp|data|[a-z])\z") | (rest == "") | ~source.rlike(r"\A[a-z][a-z0-9_]*\z")
    return F.struct(source.alias("source"), rest.alias("source_id"), F.coalesce(~refused, F.lit(False)).alias("ok"))
