"""Queries of the core over the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nameforge.functions.names import name_of
from nameforge.operators import skew
from nameforge.session import prepare


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def _named(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "functions_index").select(name_of(F.col("funname_aligned")).alias("fun_name"), "proj", "bin", F.col("index")["loc"].alias("loc"), "rec_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Names held by at least 1% of all rows."""
    rows = _named(spark, folder)
    return skew.heavy(skew.medians(rows, "fun_name", "loc", "rec_id"), "rows", rows.count()).select("fun_name")


def p3_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Records, distinct (proj, bin) and middle index.loc of every function name."""
    rows = _named(spark, folder)
    middle = skew.medians(rows, "fun_name", "loc", "rec_id")
    kinds = skew.distincts(rows, "fun_name", ["proj", "bin"], "rec_id")
    return middle.join(kinds, "fun_name").select("fun_name", F.col("rows").alias("records"), F.col("distinct").alias("programs"), F.col("median").alias("median_loc"))


NAMED_SQL = """
named AS (
  SELECT nullif(nullif(lower(trim(map_values(funname_aligned)[1], chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))), ''), 'unknown') AS fun_name,
         proj, bin, index.loc AS loc
  FROM functions_index)
"""

SQL = {
    "p3_found": f"""
WITH {NAMED_SQL}
SELECT fun_name FROM named WHERE fun_name IS NOT NULL
GROUP BY fun_name HAVING count(*) >= 0.01 * (SELECT count(*) FROM functions_index)
""",
    "p3_summary": f"""
WITH {NAMED_SQL}
SELECT fun_name, count(*) AS records, count(DISTINCT coalesce('p' || proj, '') || chr(1) || coalesce('b' || bin, '')) AS programs, CAST(median(loc) AS DOUBLE) AS median_loc
FROM named WHERE fun_name IS NOT NULL GROUP BY fun_name
""",
}

QUERIES = {"p3_found": p3_found, "p3_summary": p3_summary}
