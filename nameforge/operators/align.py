"""Alignment of two views of the same functions by address, position and stack range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nameforge.operators.dedup import last_wins

#: Distance between offsets from the frame base and from rbp.
SHIFT = 16


def by_address(left: DataFrame, right: DataFrame, keys: list[str], ord_col: str, how: str = "inner") -> DataFrame:
    """left joined with the last record of each key of right, whose columns come as struct ``other``.

    left keeps its repeats. The key should name project and binary as well as the address.
    """
    rest = [c for c in right.columns if c not in keys]
    other = last_wins(right, keys, ord_col).select(*keys, F.struct(ord_col, *(c for c in rest if c != ord_col)).alias("other"))
    return left.join(other, keys, how)


def zip_names(a: Column, b: Column) -> Column:
    """Entries (k, v) of two arrays by position, as long as the shorter; a NULL key is the word null."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.struct(F.coalesce(x, F.lit("null")).alias("k"), y.alias("v")))


def frame_offset(location: Column) -> Column:
    """The offset of a location ``fp+8``; NULL for others."""
    return F.nullif(F.regexp_extract(location, r"fp([+-]?\d+)", 1), F.lit("")).cast("long")


def variable_name(var: Column, debug: Column, shift: int = SHIFT) -> Column:
    """The true name of a stack variable, ``-`` inside a larger one, NULL without either.

    debug: array of structs with name, location, stack_start, stack_end. The first
    whose offset equals wins; else containment in any of them.
    """
    hit = F.filter(debug, lambda d: frame_offset(d["location"]) + shift == var["rbp_offset_int"])
    inside = F.exists(debug, lambda d: (var["stack_start"] >= d["stack_start"] + shift) & (var["stack_end"] <= d["stack_end"] + shift))
    return F.when(F.size(hit) > 0, F.element_at(hit, 1)["name"]).when(F.coalesce(inside, F.lit(False)), F.lit("-"))


def align_variables(variables: Column, debug: Column, shift: int = SHIFT) -> Column:
    """Entries (k, v) of the variables that have a name or lie inside a larger one, in order, a later one replacing an earlier of the same name."""
    from nameforge.functions.pairs import last_wins as dict_like

    named = F.transform(variables, lambda v: F.struct(v["variable"].alias("k"), variable_name(v, debug, shift).alias("v")))
    return dict_like(F.filter(named, lambda e: e["v"].isNotNull()))


def clusters(variables: Column, debug: Column, shift: int = SHIFT) -> Column:
    """Entries (k = type, v = variables strictly inside a variable of that type); of equal types the last non-empty one counts."""
    from nameforge.functions.pairs import last_wins as dict_like

    def inside(d: Column) -> Column:
        kept = F.filter(
            variables,
            lambda v: (v["stack_start"] >= d["stack_start"] + shift) & (v["stack_end"] <= d["stack_end"] + shift) & ~((v["stack_start"] == d["stack_start"] + shift) & (v["stack_end"] == d["stack_end"] + shift)),
        )
        return F.transform(kept, lambda v: v["variable"])

    found = F.transform(debug, lambda d: F.struct(d["type"].alias("k"), inside(d).alias("v")))
    return dict_like(F.filter(found, lambda e: F.size(e["v"]) > 0))


def zip_callees(stripped: Column, named: Column) -> Column:
    """Distinct ``placeholder:name`` of two call lists by position, where they first occur."""
    return F.array_distinct(F.transform(zip_names(stripped, named), lambda e: F.concat(e["k"], F.lit(":"), e["v"])))


def upsert(base: DataFrame, new: DataFrame, keys: list[str], fields: list[str], ord_col: str) -> DataFrame:
    """base with ``fields`` replaced where new has the key (its last record counts); other rows and fields stay."""
    fresh = last_wins(new.select(*keys, ord_col, *fields), keys, ord_col).select(*keys, F.struct(*fields).alias("_n"))
    joined = base.join(fresh, keys, "left")
    return joined.select(*(F.when(F.col("_n").isNotNull(), F.col("_n")[c]).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in base.columns))


def with_both(df: DataFrame, *columns: str) -> DataFrame:
    """Records that have all of the columns."""
    for c in columns:
        df = df.where(F.col(c).isNotNull())
    return df
