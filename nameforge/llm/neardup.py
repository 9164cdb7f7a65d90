"""Near-duplicate records with small edits: binary-trie self-join over unary codes of the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nameforge.functions.names import name_of
from nameforge.operators import near
from nameforge.operators.cells import squeeze
from nameforge.session import checkpoint


def features(df: DataFrame, id_col: str = "func_id", name: str = "funname_aligned", code: str = "norm_code", index: str = "index", skip: tuple[str, ...] = ("main",)) -> DataFrame:
    """(id, block, loc, text) of the records that can have near-duplicates.

    Left out: no name, a name in ``skip``, code null or blank, index or one of its
    arg_count, return_type and loc null. block is equal for records of the same
    name, arg_count and return_type (trimmed, lower case); text is the code without
    white space in lower case.
    """
    trimmed = F.lower(F.btrim(F.col(index)["return_type"], F.lit(" \t\n\r\x0b\x0c")))
    named = name_of(F.col(name))
    return (
        df.select(
            F.col(id_col).alias("id"),
            F.concat_ws("\x01", named, F.col(index)["arg_count"].cast("string"), trimmed).alias("block"),
            F.col(index)["loc"].cast("long").alias("loc"),
            squeeze(F.col(code)).alias("text"),
            named.alias("_n"),
            (F.col(index)["arg_count"].isNotNull() & trimmed.isNotNull()).alias("_ok"),
        )
        .where(F.col("_n").isNotNull() & ~F.col("_n").isin(*skip) & F.col("_ok") & F.col("loc").isNotNull() & (F.col("text") != ""))
        .select("id", "block", "loc", "text")
    )


def keys(df: DataFrame, name: str = "funname_aligned", index: str = "index") -> DataFrame:
    """(block, loc) of every row that may be in ``features``: what counting blocks needs, without reading any code."""
    return features(df.select(F.lit(0).alias("func_id"), name, index, F.lit("x").alias("norm_code")), name=name, index=index).select("block", "loc")


def pairs(records: DataFrame, counted: DataFrame | None = None, per: int = 10, band: tuple[int, int] = (3, 10), cap: int = near.CAP) -> DataFrame:
    """(id_a, id_b), id_a < id_b: records of one block with likeness >= 1 - 1 / per.

    records: as from ``features``; ids unique. counted: (block, loc) of them, or of more
    rows, where that is cheaper to read. loc values differ by at most band[0] / band[1] of the larger. Likeness is
    1 - d / (la + lb), d insertions and deletions of single characters over whole
    texts. The trie prunes at the provable budget and what is left is checked exactly,
    so the result is exact. Equal texts of a cell are one leaf and checked once. An
    empty input gives no rows.
    """
    return near.pairs(records, records.select("block", "loc") if counted is None else counted, (1, per), ["loc"], [band], cap).select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))


def links(records: DataFrame, counted: DataFrame | None = None, per: int = 10, band: tuple[int, int] = (3, 10), cap: int = near.CAP) -> DataFrame:
    """One row per record: (id, class_id, copies, links).

    Records of equal block, text and loc form a class, named by its smallest id;
    only one of each class goes through the join, so copies cost nothing there.
    links: number of other records that are near-duplicates of it, copies included.
    """
    # Classes are made by two hashes of 64 bits; texts travel once, with the first record of each class.
    hashed = records.withColumns({"_h": F.xxhash64(F.lit(1), "block", "loc", "text"), "_g": F.xxhash64(F.lit(2), "text", "loc", "block")})
    classes = checkpoint(hashed.groupBy("_h", "_g").agg(F.min_by(F.struct("id", "block", "loc", "text"), "id").alias("r"), F.count("*").alias("copies")))
    first = classes.select("r.*")
    found = pairs(first, counted, per, band, cap)
    both = found.select(F.col("id_a").alias("class_id"), F.col("id_b").alias("other")).unionByName(found.select(F.col("id_b").alias("class_id"), F.col("id_a").alias("other")))
    size = classes.select(F.col("r.id").alias("other"), F.col("copies").alias("_m"))
    around = both.join(size, "other").groupBy("class_id").agg(F.sum("_m").alias("_near"))
    known = classes.select("_h", "_g", F.col("r.id").alias("class_id"), "copies")
    return (
        hashed.select("id", "_h", "_g")
        .join(known, ["_h", "_g"])
        .join(around, "class_id", "left")
        .select("id", "class_id", "copies", (F.col("copies") - 1 + F.coalesce("_near", F.lit(0))).alias("links"))
    )
