"""Queries over the training-data operators, and the SQL that can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nameforge.llm import layout, leakage, lookalike, mixing, neardup, packing, qa, splits, tokens
from nameforge.session import checkpoint, prepare


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    functions = table(spark, folder, "functions_norm")
    return neardup.pairs(neardup.features(functions), neardup.keys(functions))


def p1_links(spark: SparkSession, folder: str) -> DataFrame:
    functions = table(spark, folder, "functions_norm")
    return neardup.links(neardup.features(functions), neardup.keys(functions)).withColumnRenamed("id", "func_id")


def _flagged(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    runs = table(spark, folder, "predictions")
    return runs, qa.flag(runs, qa.fit(table(spark, folder, "documents"), runs))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _flagged(spark, folder)[1]


def p2_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs and share of each defect per model_run; good pairs have the defect ``none``."""
    runs, flagged = _flagged(spark, folder)
    kinds = runs.select("pred_id", "model_run").join(flagged, "pred_id", "left")
    counted = kinds.groupBy("model_run", F.coalesce("defect", F.lit("none")).alias("defect")).agg(F.count("*").alias("pairs"))
    return counted.withColumn("share", F.round(F.col("pairs") / F.sum("pairs").over(Window.partitionBy("model_run")), 9))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    found = leakage.overlaps(leakage.features(table(spark, folder, "test")))
    return found.select(F.least("eval_id", "train_id").alias("id_a"), F.greatest("eval_id", "train_id").alias("id_b"))


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Overlaps per eval_set and proj."""
    test = table(spark, folder, "test")
    records = leakage.features(test)
    sources = test.where(F.col("in_train") == 0).select(F.col("test_id").alias("id"), "eval_set", F.col("proj").alias("source"))
    return leakage.report(records, leakage.overlaps(records), sources)


def _tied(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "domain_records")
    return splits.components(records, "rec_id", [splits.tie_key(F.col("proj")), splits.tie_key(F.col("bin"), path=True)])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _tied(spark, folder).where("id != first_id").select("first_id", F.col("id").alias("rec_id"))


def _split(spark: SparkSession, folder: str) -> tuple[DataFrame, list[tuple[str, float]]]:
    targets = [(r["split_name"], r["target_share"]) for r in table(spark, folder, "split_targets").orderBy("split_name").collect()]
    tied = checkpoint(_tied(spark, folder))
    groups = tied.groupBy("first_id").agg(F.count("*").alias("size"))
    return tied.join(splits.assign(groups, targets), "first_id"), targets


def p5_split(spark: SparkSession, folder: str) -> DataFrame:
    """The split of every record."""
    return _split(spark, folder)[0].select(F.col("id").alias("rec_id"), F.col("split").alias("split_name"))


def p5_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Records, components and share of each split beside its target."""
    placed, _ = _split(spark, folder)
    counted = placed.groupBy(F.col("split").alias("split_name")).agg(F.count("*").alias("records"), F.count_if(F.col("id") == F.col("first_id")).alias("components"))
    total = F.sum("records").over(Window.partitionBy())
    return table(spark, folder, "split_targets").join(counted, "split_name", "left").select("split_name", "target_share", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("components", F.lit(0)).alias("components"), F.coalesce(F.col("records") / total, F.lit(0.0)).alias("actual_share"))


def _layouts(spark: SparkSession, folder: str) -> DataFrame:
    return layout.records(table(spark, folder, "functions"), "functions", "func_id", "code", "output").unionByName(
        layout.records(table(spark, folder, "functions_norm"), "functions_norm", "func_id", "norm_code", "output")
    )


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return layout.copies(_layouts(spark, folder))


def p6_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    """One row per distinct record of either table with its number of copies."""
    return layout.collapse(_layouts(spark, folder))


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every text, or piece of a text over 2,048 tokens."""
    sized = tokens.count(table(spark, folder, "documents"), "text", ["doc_id"])
    return packing.pack(sized, "doc_id", "n_tokens").withColumnRenamed("id", "doc_id")


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill(p7_packed(spark, folder))


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, folder, "documents").withColumn("digest", F.md5("text"))
    targets = table(spark, folder, "mix_targets")
    listed = [(r["source"], r["target_share"], r["max_repeat"]) for r in targets.orderBy("source").collect()]
    return mixing.mix(tokens.count(documents, "text", ["doc_id", "source", "digest"]), listed), targets


def p8_mixed(spark: SparkSession, folder: str) -> DataFrame:
    """The collection: one row per use of a text."""
    return _mixed(spark, folder)[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(*_mixed(spark, folder))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = lookalike.twins(lookalike.forms(table(spark, folder, "documents"), "doc_id", "text"))
    return pairs.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p9_text(spark: SparkSession, folder: str) -> DataFrame:
    """The consistent form of every document."""
    return lookalike.consistent(table(spark, folder, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_links": p1_links, "p2_found": p2_found, "p2_rates": p2_rates, "p4_found": p4_found, "p4_report": p4_report, "p5_found": p5_found, "p5_split": p5_split, "p5_shares": p5_shares, "p6_found": p6_found, "p6_collapsed": p6_collapsed, "p7_packed": p7_packed, "p7_fill": p7_fill, "p8_mixed": p8_mixed, "p8_shares": p8_shares, "p9_found": p9_found, "p9_text": p9_text}


_WS = "chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"

_LAYOUT_SQL = f"""
marked AS (
  SELECT table_name, func_id, lower(regexp_replace(translate(code, {_WS}, ''), '[;,(){{}}]', '', 'g')) AS text,
         array_to_string(list_sort(list_distinct(list_filter(string_split(lower(translate(coalesce(output, ''), {_WS}, '')), ','), lambda e: e <> ''))), ',') AS pairs
  FROM (SELECT 'functions' AS table_name, func_id, code, output FROM functions
        UNION ALL SELECT 'functions_norm', func_id, norm_code, output FROM functions_norm)
  WHERE trim(code, {_WS}) <> ''),
grouped AS (SELECT *, min(func_id) OVER (PARTITION BY table_name, text, pairs) AS first_id, count(*) OVER (PARTITION BY table_name, text, pairs) AS copies FROM marked)
"""

_TIED_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT rec_id, nullif(translate(lower(trim(proj, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))), '_ ', '--'), '') AS p,
         nullif(translate(lower(trim(regexp_extract(bin, '([^/\\]*)$', 1), chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))), '_ ', '--'), '') AS b
  FROM domain_records),
links AS (
  SELECT DISTINCT x.rec_id AS a, y.rec_id AS b FROM keyed x JOIN (SELECT p, min(rec_id) AS rec_id FROM keyed GROUP BY p) y ON x.p = y.p
  UNION SELECT DISTINCT x.rec_id, y.rec_id FROM keyed x JOIN (SELECT b, min(rec_id) AS rec_id FROM keyed GROUP BY b) y ON x.b = y.b),
sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS rec_id, a AS spot FROM sym UNION SELECT r.rec_id, s.b FROM reach r JOIN sym s ON r.spot = s.a)"""

_SPLIT_SQL = f"""{_TIED_SQL},
found AS (SELECT rec_id, min(spot) AS first_id FROM reach GROUP BY rec_id),
tied AS (SELECT d.rec_id, coalesce(f.first_id, d.rec_id) AS first_id FROM domain_records d LEFT JOIN found f ON d.rec_id = f.rec_id),
groups AS (SELECT first_id, count(*) AS size FROM tied GROUP BY first_id),
line AS (SELECT first_id, (sum(size) OVER (ORDER BY size DESC, md5(CAST(first_id AS VARCHAR)), first_id) - size / 2) / sum(size) OVER () AS place FROM groups),
bounds AS (SELECT split_name, sum(target_share) OVER w / sum(target_share) OVER () AS bound, row_number() OVER w AS k, count(*) OVER () AS n FROM split_targets WINDOW w AS (ORDER BY target_share DESC, split_name)),
placed AS (SELECT first_id, arg_min(split_name, k) AS split_name FROM line JOIN bounds ON place < bound OR k = n GROUP BY first_id)
"""

SQL = {
    "p5_found": f"{_TIED_SQL} SELECT first_id, rec_id FROM (SELECT rec_id, min(spot) AS first_id FROM reach GROUP BY rec_id) WHERE first_id <> rec_id",
    "p5_split": f"{_SPLIT_SQL} SELECT rec_id, split_name FROM tied JOIN placed USING (first_id)",
    "p5_shares": f"""{_SPLIT_SQL},
counted AS (SELECT split_name, count(*) AS records, count(*) FILTER (rec_id = first_id) AS components FROM tied JOIN placed USING (first_id) GROUP BY split_name)
SELECT split_name, target_share, coalesce(records, 0) AS records, coalesce(components, 0) AS components, coalesce(records / sum(records) OVER (), 0.0) AS actual_share FROM split_targets LEFT JOIN counted USING (split_name)""",
    "p6_found": f"WITH {_LAYOUT_SQL} SELECT table_name, first_id, func_id AS copy_id FROM grouped WHERE func_id <> first_id",
    "p6_collapsed": f"WITH {_LAYOUT_SQL} SELECT table_name, first_id, copies FROM grouped WHERE func_id = first_id",
}

SQL["p9_found"] = f"""WITH s AS (SELECT doc_id, text, {lookalike.skeleton_sql('text')} AS form FROM documents WHERE text IS NOT NULL)
SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM s a JOIN s b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
