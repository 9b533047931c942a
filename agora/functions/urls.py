"""Addresses: page classes, links, and address builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT_LOCALE, LOCALES

SITE = "https://www.tiktok.com"


def page_class(url: Column) -> Column:
    """list, video or other. A list page has search or tag anywhere, or @ without video; that is looked at first."""
    has = lambda s: F.contains(url, F.lit(s))
    return F.when(has("search") | has("tag") | (has("@") & ~has("video")), F.lit("list")).when(has("@") & has("video"), F.lit("video")).otherwise(F.lit("other"))


def links(html: Column, part: str = "") -> Column:
    """href values of a page that contain `part`."""
    return F.filter(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit('href="([^"]*)"'), 1), lambda x: F.contains(x, F.lit(part)))


def first_with(values: Column, part: str) -> Column:
    """The first value that contains `part`, else null."""
    return F.get(F.filter(values, lambda x: F.contains(x, F.lit(part))), F.lit(0))


def locale(country: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in LOCALES.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, F.coalesce(country, F.lit(""))), F.lit(DEFAULT_LOCALE))


def video_url(author: Column, video: Column) -> Column:
    return F.concat(F.lit(f"{SITE}/@"), author, F.lit("/video/"), video)


def author_url(author: Column) -> Column:
    return F.concat(F.lit(f"{SITE}/@"), author)


def profile_url(name: Column, country: Column) -> Column:
    return F.concat(F.lit(f"{SITE}/@"), name, F.lit("?lang="), locale(country))


def tag_url(tag: Column, country: Column) -> Column:
    return F.concat(F.lit(f"{SITE}/tag/"), tag, F.lit("?lang="), locale(country))


def search_url(query: Column) -> Column:
    """Every white-space character becomes %20."""
    return F.concat(F.lit(f"{SITE}/search?q="), F.regexp_replace(query, "\\s", "%20"))


def choose(values: Column, seed: Column) -> Column:
    """One element, uniform over a hash of the seed, so that a rerun chooses the same; null for an empty list."""
    return F.when(F.size(values) > 0, F.get(values, F.pmod(F.xxhash64(seed), F.size(values)).cast("int")))
