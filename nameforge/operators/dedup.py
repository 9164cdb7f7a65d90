"""Near-duplicate removal that keeps the first of its kind, in record order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nameforge.operators import near
from nameforge.session import Scratch


def comparable(df: DataFrame, index: str = "index") -> DataFrame:
    """arg_count and loc as numbers (0 where missing or unreadable), return_type trimmed in lower case ('' where missing)."""
    return df.withColumns(
        {
            "_args": F.coalesce(F.col(index)["arg_count"].cast("string").try_cast("int"), F.lit(0)),
            "_kind": F.lower(F.btrim(F.coalesce(F.col(index)["return_type"], F.lit("")), F.lit(" \t\n\r\x0b\x0c"))),
            "_loc": F.coalesce(F.col(index)["loc"].cast("string").try_cast("int"), F.lit(0)),
        }
    )


def greedy(df: DataFrame, ord_col: str, names: str = "funname_aligned", code: str = "norm_code", index: str = "index", band: tuple[int, int] = (3, 10), never: str = "main", rounds: int = 500, cap: int = near.CAP) -> DataFrame:
    """The ids (ord_col, unique whole numbers) of the records that stay.

    A record goes if an earlier record that stayed has the same name, arg_count and
    return_type, a loc within ``band`` of the larger, and a ratio that rounds to at least
    90 (so 89.5 or more). Records without a name or code go too; those named ``never``
    stay and are never compared. Names are compared as they are written.

    Of equal records only the first can stay, whatever happens to it, so only that one is
    compared. Similar pairs come from the trie in bounded cells; the order is then
    resolved over the pairs: in each round the records without an undecided earlier
    neighbour stay, and their later neighbours go. Rounds are written to the shared folder.
    """
    name = F.element_at(F.map_values(names), 1)
    ready = comparable(df.where((F.size(names) > 0) & (F.col(code) != "")), index).select(
        F.col(ord_col).cast("long").alias("id"), F.concat_ws("\x01", F.coalesce(name, F.lit("")), F.col("_args").cast("string"), "_kind").alias("block"), F.col("_loc").cast("long").alias("loc"), F.col(code).alias("text"), F.coalesce(name == never, F.lit(False)).alias("_free")
    )
    hashed = ready.where("not _free").select("id", "block", "loc", "text", F.xxhash64(F.lit(1), "block", "loc", "text").alias("h"), F.xxhash64(F.lit(2), "text", "loc", "block").alias("g"))
    scratch = Scratch(df.sparkSession)
    first = scratch.write(hashed.groupBy("h", "g").agg(F.min_by(F.struct("id", "block", "loc", "text"), "id").alias("r")).select("r.*"))
    pairs = scratch.write(near.pairs(first, first.select("block", "loc"), (21, 200), ["loc"], [band], cap).select("a", "b"))
    left, gone = pairs, None
    for _ in range(rounds):
        # a is earlier than b: a record that is b of no pair left is undecided no more, it stays.
        waits = left.select(F.col("b").alias("a"), F.lit(True).alias("w")).distinct()
        now = left.join(waits, "a", "left").where("w IS NULL").select(F.col("b").alias("v")).distinct()
        now = scratch.write(now)
        gone = now if gone is None else gone.unionByName(now)
        rest = left.join(now.select(F.col("v").alias("b")), "b", "left_anti").join(now.select(F.col("v").alias("a")), "a", "left_anti")
        # What stays has no undecided earlier neighbour, so its pairs are settled as well.
        left, count = scratch.write_counting(rest, F.lit(True))
        if not count:
            break
    else:
        raise RuntimeError(f"pairs are left after {rounds} rounds")
    kept = first.select("id").join(gone.select(F.col("v").alias("id")), "id", "left_anti")
    return kept.unionByName(ready.where("_free").select("id")).withColumnRenamed("id", ord_col)


def first_exact(df: DataFrame, ord_col: str, by: list[str]) -> DataFrame:
    """The first record of each combination of values, NULLs being equal; combined before the shuffle."""
    return df.groupBy(*by).agg(F.min(ord_col).alias(ord_col))


def last_wins(df: DataFrame, keys: list[str], ord_col: str) -> DataFrame:
    """The last record of each key, as when a dict is filled in order; combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), ord_col).alias("_r")).select(*keys, "_r.*")


def status_counts(df: DataFrame, column: str, statuses: list[str]) -> DataFrame:
    """Rows per status, zero for those that do not occur."""
    known = df.sparkSession.createDataFrame([(s,) for s in statuses], f"{column} string")
    return known.join(df.groupBy(column).count(), column, "left").select(column, F.coalesce("count", F.lit(0)).alias("rows"))
