"""Mappings written as text ``"k:v, k:v"``, as ordered arrays of (k, v)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from nameforge.functions.text import strip


def parse(text: Column, trim: bool = True, lower: bool = False, empty_keys: bool = True, valueless: bool = False) -> Column:
    """array<struct<k,v>> of a mapping text; a repeated key keeps its first place and its last value.

    Entries are separated by commas and split at their first colon. Four readings
    differ in what they do beyond that: trim (strip both sides), lower, empty_keys
    (keep an entry without a key), valueless (keep an entry without a colon, value
    NULL, instead of dropping it). NULL and '' give no entry.
    """
    parts = F.split(F.coalesce(text, F.lit("")), ",")
    if not valueless:
        parts = F.filter(parts, lambda p: F.contains(p, F.lit(":")))

    def side(x: Column) -> Column:
        x = strip(x) if trim else x
        return F.lower(x) if lower else x

    def entry(p: Column) -> Column:
        two = F.split(p, ":", 2)
        return F.struct(side(F.element_at(two, 1)).alias("k"), F.when(F.size(two) > 1, side(F.element_at(two, -1))).alias("v"))

    pairs = F.transform(parts, entry)
    if not empty_keys:
        pairs = F.filter(pairs, lambda e: e["k"] != "")
    if valueless:
        pairs = F.when(F.coalesce(text, F.lit("")) == "", F.slice(pairs, 1, 0)).otherwise(pairs)
    return last_wins(pairs)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body uses it: inside lambdas nothing else is shared."""
    return F.element_at(F.transform(F.array(value), body), 1)


def last_wins(pairs: Column) -> Column:
    """Of equal keys the first place and the last value, as in a dict."""

    def dict_like(p: Column) -> Column:
        keys = F.array_distinct(F.transform(p, lambda e: e["k"]))
        # Mostly no key is repeated, and the entries are the answer.
        return F.when(F.size(keys) == F.size(p), p).otherwise(F.transform(keys, lambda k: F.element_at(F.filter(p, lambda e: e["k"].eqNullSafe(k)), -1)))

    return let(pairs, dict_like)


def from_map(m: Column) -> Column:
    """Entries of a map in key order, so that results do not hang on map order; NULL gives none."""
    return F.coalesce(F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))), F.array().cast("array<struct<k:string,v:string>>"))


def keys(pairs: Column) -> Column:
    return F.transform(pairs, lambda e: e["k"])


def lookup(pairs: Column, key: Column) -> Column:
    """The key's value, or the key itself where it is absent; a present empty value stays empty."""
    hit = F.filter(pairs, lambda e: e["k"] == key)
    return F.when(F.size(hit) > 0, F.element_at(hit, -1)["v"]).otherwise(key)


def text_of(pairs: Column, sep: str = ", ") -> Column:
    """``k:v`` entries joined; NULL values as ''."""
    return F.array_join(F.transform(pairs, lambda e: F.concat(e["k"], F.lit(":"), F.coalesce(e["v"], F.lit("")))), sep)
