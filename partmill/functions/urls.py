"""URL normalization, host extraction and source scoring as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (HOST_AUTHORITY, MANUFACTURER_AUTHORITY, SOURCE_CLASS,
                         UNKNOWN_HOST_AUTHORITY)
from ..scale import case_map
from .text import compact, strip

# Groups: scheme 1, authority 2, path 3, query 4 (the generic URI grammar).
URI = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def url_host(url: Column) -> Column:
    authority = F.lower(F.regexp_extract(strip(url), URI, 2))
    host = F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r":\d*$", "")
    return F.regexp_replace(host, r"^www\.", "")


def normalize_url(url: Column) -> Column:
    """Lower-case host without www., no trailing slash, query kept, fragment dropped."""
    text = strip(url)
    scheme = F.regexp_replace(F.lower(F.regexp_extract(text, URI, 1)), "^$", "https")
    host = F.regexp_replace(F.lower(F.regexp_extract(text, URI, 2)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(text, URI, 3), ";[^/]*$", "")
    path = F.regexp_replace(F.regexp_replace(path, "/+$", ""), "^(?!/)", "/")
    query = F.regexp_replace(F.regexp_extract(text, URI, 4), "^(?=.)", "?")
    return F.concat(scheme, F.lit("://"), host, path, query)


def host_suffixes(host: Column) -> Column:
    """a.b.c -> [a.b.c, b.c, c]: turns suffix matching into an equi-join."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)),
                       lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def _any(blob: Column, words: list[str]) -> Column:
    expr = F.lit(False)
    for w in words:
        expr = expr | blob.contains(w)
    return expr


def hit_blob(url: Column, title: Column, snippet: Column) -> Column:
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (url, title, snippet)])


def content_type(url: Column, title: Column, snippet: Column, host_kind: Column) -> Column:
    blob = F.lower(hit_blob(url, title, snippet))
    is_pdf = F.lower(url).rlike(r"\.pdf($|\?)") | blob.contains("filetype:pdf")
    manual = _any(blob, ["install", "manual", "instruction"])
    catalog = blob.contains("catalog")
    spec = _any(blob, ["spec", "datasheet", "data sheet"])
    return (
        F.when(is_pdf & manual, "INSTALLATION_MANUAL")
        .when(catalog, "CATALOG")
        .when(manual, "INSTALLATION_MANUAL")
        .when(spec, "SPECIFICATION")
        .when(is_pdf, "TECHNICAL_DOCUMENT")
        .when(host_kind == "manufacturer", "PRODUCT_PAGE")
        .otherwise("OTHER")
    )


def source_class(host_kind: Column) -> Column:
    return case_map(host_kind, SOURCE_CLASS, "OTHER")


def authority(host_kind: Column, content: Column) -> Column:
    return (
        F.when(host_kind == "manufacturer", case_map(content, MANUFACTURER_AUTHORITY, 0.80))
        .otherwise(case_map(host_kind, HOST_AUTHORITY, UNKNOWN_HOST_AUTHORITY))
    )


def mentions_part_number(mpn: Column, url: Column, title: Column, snippet: Column) -> Column:
    needle = compact(mpn)
    return (needle != "") & compact(hit_blob(url, title, snippet)).contains(needle)


def relevance(mpn, brand, product_type, url, title, snippet) -> Column:
    needle, kind, maker = compact(mpn), compact(product_type), compact(brand)
    base = (
        F.when(compact(url).contains(needle), 0.50)
        .when(compact(title).contains(needle), 0.40)
        .otherwise(0.30)
    )
    all_text = hit_blob(url, title, snippet)
    own_text = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit("")))
    score = (
        base
        + F.when((maker != "") & compact(all_text).contains(maker), 0.20).otherwise(0.0)
        + F.when((kind != "") & compact(own_text).contains(kind), 0.15).otherwise(0.0)
        + F.when(F.lower(url).contains(".pdf") | F.lower(all_text).contains("spec"), 0.10).otherwise(0.0)
    )
    return F.when(mentions_part_number(mpn, url, title, snippet),
                  F.least(F.lit(1.0), F.round(score, 4))).otherwise(0.0)


def rank_score(authority_score: Column, relevance_score: Column) -> Column:
    return authority_score * 100 + relevance_score * 50
