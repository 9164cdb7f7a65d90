"""Copies hidden by formatting: commutative fingerprints of normalised fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nameforge.functions.names import WHITE
from nameforge.operators.cells import squeeze
from nameforge.session import Scratch

#: Characters that only lay out code.
MARKS = ";,(){}"
FINGERPRINT = ["table_name", "f1", "f2"]
#: Copies of one record that are held against it in one task; larger groups are cut into parts.
HOT = 10_000


def entries(output: Column) -> Column:
    """The set of comma-separated entries, white space and letter case ignored; empty entries and NULL give none."""
    return F.coalesce(F.array_distinct(F.filter(F.split(squeeze(output), ","), lambda e: e != "")), F.array().cast("array<string>"))


def records(df: DataFrame, table_name: str, id_col: str, code: str, output: str) -> DataFrame:
    """(table_name, id, text, pairs, f1, f2) of the rows whose code is neither null nor blank.

    text: the code without white space and marks in lower case. pairs: the set of
    output entries. The fingerprint combines the hashes of all (field, value) pairs, the
    code's and each entry's, by exclusive or, so it needs no order; two seeds make 128 bits.
    """
    base = df.where(F.btrim(F.col(code), F.lit(WHITE)) != "").select(
        F.lit(table_name).alias("table_name"),
        F.col(id_col).alias("id"),
        squeeze(F.col(code), MARKS).alias("text"),
        entries(F.col(output)).alias("pairs"),
    )

    def fold(seed: int) -> Column:
        return F.aggregate("pairs", F.xxhash64(F.lit(seed), F.lit("code"), "text"), lambda a, e: a.bitwiseXOR(F.xxhash64(F.lit(seed), F.lit("output"), e)))

    return base.select("*", fold(1).alias("f1"), fold(2).alias("f2"))


def _found(rows: DataFrame, hot: int) -> tuple[DataFrame, DataFrame]:
    """The pairs of ``copies``, and (table_name, id) of all rows."""
    scratch = Scratch(rows.sparkSession)
    narrow = scratch.write(rows.select("table_name", "id", "f1", "f2"))
    groups = scratch.write(narrow.groupBy(*FINGERPRINT).agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1"))
    parts = F.ceil(F.col("n") / hot).cast("int")
    # Rows of a hot fingerprint go to as many parts as it needs; there are at most rows / hot of those.
    placed = narrow.join(groups.where(F.col("n") > hot).select(*FINGERPRINT, parts.alias("k")), FINGERPRINT, "left") if groups.where(F.col("n") > hot).limit(1).count() else narrow.withColumn("k", F.lit(1))
    placed = placed.withColumn("part", F.pmod(F.xxhash64(F.lit(3), "id"), F.coalesce("k", F.lit(1))).cast("int")).drop("k")
    key = [*FINGERPRINT, "part"]
    spread = groups.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    members = scratch.write(placed.join(spread.select(*key, "first_id"), key))
    # Only members of a group are read with their texts; ids are unique, so no key is hot here.
    texts = scratch.write(rows.drop("f1", "f2").join(members, ["table_name", "id"]))
    firsts = texts.where(F.col("id") == F.col("first_id")).drop("part").join(groups.select(*FINGERPRINT, "n"), FINGERPRINT).select(*FINGERPRINT, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("text").alias("text0"), F.col("pairs").alias("pairs0"))
    same = (F.col("text") == F.col("text0")) & (F.size("pairs") == F.size("pairs0")) & (F.size(F.array_except("pairs", "pairs0")) == 0)
    verdict, unlike = scratch.write_counting(texts.where(F.col("id") != F.col("first_id")).join(firsts, key).select("table_name", "first_id", F.col("id").alias("copy_id"), same.alias("same")), ~F.col("same"))
    found = verdict.where("same").drop("same")
    if unlike:
        # A fingerprint shared by unequal records: those that are not like the first are grouped by their whole fields.
        whole = texts.join(verdict.where("not same").select("table_name", F.col("copy_id").alias("id")), ["table_name", "id"], "left_semi").select("table_name", "id", "text", F.array_sort("pairs").alias("pairs"))
        least = whole.groupBy("table_name", "text", "pairs").agg(F.min("id").alias("first_id"))
        found = found.unionByName(whole.join(least, ["table_name", "text", "pairs"]).where("id != first_id").select("table_name", "first_id", F.col("id").alias("copy_id")))
    return found, narrow.select("table_name", "id")


def copies(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """(table_name, first_id, copy_id): the smallest id of each group of copies with each of the others.

    rows: as from ``records``. Groups are found on fingerprints alone, combined
    before the shuffle; the members of groups of two or more are read once more with
    their texts, and each is held against the first one field by field, in parts of
    about ``hot``. Should a fingerprint be shared by unequal records, these are grouped
    by their whole fields instead.
    """
    return _found(rows, hot)[0]


def collapse(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """(table_name, first_id, copies): one row per distinct record with the number of records it stands for."""
    found, ids = _found(rows, hot)
    counts = found.groupBy("table_name", F.col("first_id").alias("id")).agg(F.count("*").alias("more"))
    kept = ids.join(found.select("table_name", F.col("copy_id").alias("id")), ["table_name", "id"], "left_anti")
    return kept.join(counts, ["table_name", "id"], "left").select("table_name", F.col("id").alias("first_id"), (F.coalesce("more", F.lit(0)) + 1).alias("copies"))
