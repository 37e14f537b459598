"""Expressions over tag maps. Each takes and gives columns; nothing runs in Python."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Length of each unit in metres, and factors between units where they are agreed on with fewer digits
UNITS = {
    "km": {"km": 1.0, "m": 0.001, "mi": 1.6093, "ft": 0.0003048, "'": 0.0003048},
    "m": {"m": 1.0, "km": 1000.0, "mi": 1609.3, "ft": 0.3048, "'": 0.3048},
    "ft": {"ft": 1.0, "m": 3.28084, "km": 3280.84, "mi": 5280.0, "'": 1.0},
    "mi": {"mi": 1.0, "m": 0.0006213712, "km": 0.6213712, "ft": 0.0001893939, "'": 0.0001893939},
}
# Fixed value: a number with a decimal point or comma, and a unit of letters or the sign for feet
LENGTH = r"^\s*(\d+)(?:[.,](\d+))?\s*([a-zA-Z']*)"


def _value(tags: Column, key: str) -> Column:
    return F.element_at(tags, F.lit(key))


def first_of(tags: Column, *keys: str, default: str | None = None) -> Column:
    """Value of the first key that has one; null values are none."""
    return F.coalesce(*(_value(tags, k) for k in keys), F.lit(default).cast("string"))


def with_prefix(tags: Column, prefix: str) -> Column:
    """The entries whose key begins with prefix, without it."""
    some = F.map_filter(tags, lambda k, v: k.startswith(prefix))
    return F.transform_keys(some, lambda k, v: F.substr(k, F.lit(len(prefix) + 1)))


def booleans(tags: Column) -> Column:
    """Entries that read as yes/true or no/false in any case, as booleans."""
    some = F.map_filter(tags, lambda k, v: F.lower(v).isin("yes", "true", "no", "false"))
    return F.transform_values(some, lambda k, v: F.lower(v).isin("yes", "true"))


def localized(tags: Column, locales: Sequence[str]) -> Column:
    """Entries ``key:locale`` stand in for ``key``: of several, the locale named first; others with a locale go.

    A suffix that is no locale belongs to the key. A key is split at its first colon.
    """
    ranks = F.map_from_arrays(
        F.array(*(F.lit(x) for x in locales)) if locales else F.array().cast("array<string>"),
        F.array(*(F.lit(i) for i in range(len(locales)))) if locales else F.array().cast("array<int>"),
    )

    def ranked(e: Column) -> Column:
        colon = F.locate(":", e["key"])
        suffix = F.when(colon > 0, F.substr(e["key"], colon + 1))
        rank = F.when(colon > 0, F.try_element_at(ranks, suffix))
        base = F.when(rank.isNotNull(), F.substr(e["key"], F.lit(1), colon - 1)).otherwise(e["key"])
        return F.struct(base.alias("key"), F.coalesce(rank, F.lit(len(locales))).alias("rank"), e["value"].alias("value"))

    best = F.transform(F.map_entries(tags), ranked)
    order = F.array_sort(F.transform(best, lambda e: F.struct(e["key"].alias("key"), e["rank"].alias("rank"), e["value"].alias("value"))))
    kept = F.filter(order, lambda e, i: (i == 0) | (F.get(order, i - 1)["key"] != e["key"]))
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"], e["value"])))


def quoted(text: Column) -> Column:
    """Percent-encoding of everything but letters, digits and ``_.-~/``."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _language_entries(tags: Column) -> Column:
    """Map of language to page of the keys ``wikipedia:<two or three letters>`` whose value is no address."""
    ok = lambda k, v: k.startswith("wikipedia:") & F.length(k).isin(12, 13) & ~v.startswith("http")
    return F.transform_keys(F.map_filter(tags, ok), lambda k, v: F.substr(k, F.lit(11)))


def _page(tags: Column) -> tuple[Column, Column, Column]:
    entry = _value(tags, "wikipedia")
    colon = F.locate(":", entry)
    return entry, colon, F.substr(entry, F.lit(1), colon - 1)


def wikipedia_url(tags: Column) -> Column:
    """Address of the page: ``page`` (English), ``language:page``, else the first ``wikipedia:<language>`` entry."""
    entry, colon, language = _page(tags)
    address = lambda lang, page: F.concat(F.lit("https://"), lang, F.lit(".wikipedia.org/wiki/"), quoted(page))
    first = F.get(F.map_entries(_language_entries(tags)), 0)
    return (
        F.when(entry.isNotNull() & (colon == 0), address(F.lit("en"), entry))
        .when((colon > 0) & F.length(language).isin(2, 3), address(language, F.substr(entry, colon + 1)))
        .otherwise(address(first["key"], first["value"]))
    )


def wikipedia_pages(tags: Column) -> Column:
    """Map of language to page of all forms above. A page without a language is English, however short it is."""
    entry, colon, language = _page(tags)
    own = (
        F.when(entry.isNotNull() & (colon == 0), F.create_map(F.lit("en"), entry))
        .when((colon > 0) & F.length(language).isin(2, 3), F.create_map(language, F.substr(entry, colon + 1)))
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    others = _language_entries(tags)
    return F.when(tags.isNotNull(), F.map_concat(own, F.map_filter(others, lambda k, v: ~F.map_contains_key(own, k))))


def url(tags: Column, schemes: Sequence[str] = ("http", "https"), keys: Sequence[str] = ("url", "website")) -> Column:
    """The first address of the given keys, quotes encoded; null without a host or with another scheme."""
    raw = F.replace(F.replace(first_of(tags, *keys), F.lit('"'), F.lit("%22")), F.lit("'"), F.lit("%27"))
    scheme = F.lower(F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.-]*)://[^/?#]+", 1))
    return F.when(scheme.isin(*schemes), raw)


def length(tags: Column, *keys: str, unit: str = "km", default: str = "km") -> Column:
    """A length in unit: the beginning of the first key's value; null if it has no number or an unknown unit."""
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit}")
    text = first_of(tags, *keys)
    whole, part, given = (F.regexp_extract(text, LENGTH, i) for i in (1, 2, 3))
    number = F.concat(whole, F.lit("."), F.when(part == "", "0").otherwise(part)).try_cast("double")
    own = F.when(given == "", F.lit(default)).otherwise(F.lower(given))
    factors = F.create_map(*(F.lit(x) for kv in UNITS[unit].items() for x in kv))
    return F.when(F.coalesce(whole, F.lit("")) != "", number * F.try_element_at(factors, own))
