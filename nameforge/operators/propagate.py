"""Predicted names carried along call edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nameforge.functions.code import call_name
from nameforge.functions.pairs import let, lookup, parse
from nameforge.functions.text import lines, strip


def identity(df: DataFrame) -> Column:
    """The binary a record belongs to: binname where there is one, else bin."""
    return F.coalesce(F.col("binname"), F.col("bin")) if "binname" in df.columns else F.col("bin")


def mapping(predict: Column) -> Column:
    """(k, v) entries of a prediction; none for a blank one."""
    return parse(predict, empty_keys=False)


def edges(df: DataFrame, ord_col: str, callees: str = "callees", funname: str = "funname") -> DataFrame:
    """(bin_id, caller, ord, pos, callee): one row per entry of a call list, in order, repeats included."""
    return df.select(identity(df).alias("bin_id"), F.col(funname).alias("caller"), F.col(ord_col).alias("ord"), F.posexplode(callees).alias("pos", "_c")).select("bin_id", "caller", "ord", "pos", call_name(F.col("_c")).alias("callee"))


def ordered_distinct(value: str, *order: str) -> Column:
    """Aggregate: distinct values, each at its first place in the order; NULLs are left out."""
    got = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(*order, value))))
    return F.array_distinct(F.transform(got, lambda s: s[value]))


def predicted_signature(callee: Column, pairs: Column, params: Column) -> Column:
    """``callee:name(p1, p2)`` with predicted names where there are any."""
    named = F.transform(params, lambda p: lookup(pairs, p))
    return F.concat(callee, F.lit(":"), lookup(pairs, callee), F.lit("("), F.array_join(named, ", "), F.lit(")"))


def callee_context(df: DataFrame, ord_col: str, predict: str, predictions: DataFrame | None = None, params: str = "params_aligned", known_only: bool = True) -> DataFrame:
    """(ord, predict_callees): for each record the signatures of its callees that have a prediction.

    The callee is looked up by (binary, name); of several records the last counts.
    predictions defaults to df itself. params is an array of parameter placeholders.
    """
    source = df if predictions is None else predictions
    last = source.select(identity(source).alias("bin_id"), F.col("funname").alias("callee"), F.col(ord_col).alias("_o"), F.col(predict).alias("_p"), F.col(params).alias("_q")).groupBy("bin_id", "callee").agg(F.max_by(F.struct("_p", "_q"), "_o").alias("_t"))
    pairs = mapping(F.col("_t._p"))
    hit = F.when(F.size(pairs) > 0, predicted_signature(F.col("callee"), pairs, F.coalesce("_t._q", F.array().cast("array<string>"))))
    joined = edges(df, ord_col).join(last, ["bin_id", "callee"]).select("ord", "pos", hit.alias("sig")).where(F.col("sig").isNotNull() if known_only else F.lit(True))
    found = joined.groupBy("ord").agg(ordered_distinct("sig", "pos").alias("predict_callees"))
    return df.select(F.col(ord_col).alias("ord")).join(found, "ord", "left").select("ord", F.coalesce("predict_callees", F.array().cast("array<string>")).alias("predict_callees"))


def call_line(code: Column, callee: Column, pairs: Column) -> Column:
    """The first line that calls ``callee``, its names replaced by predictions, cut to the call up to its first closing parenthesis."""
    hits = F.filter(F.transform(lines(code), strip), lambda x: F.regexp_like(x, F.concat(F.lit(r"(?U)\b\Q"), callee, F.lit(r"\E\s*\("))))

    def swap(acc: Column, e: Column) -> Column:
        return F.regexp_replace(acc, F.concat(F.lit(r"(?U)\b\Q"), e["k"], F.lit(r"\E\b")), F.regexp_replace(e["v"], r"([\\$])", r"\\$1"))

    def cut(renamed: Column) -> Column:
        call = F.regexp_substr(renamed, F.concat(F.lit(r"(?U)\b\Q"), lookup(pairs, callee), F.lit(r"\E\s*\([^)]*\)")))
        return F.coalesce(strip(call), renamed)

    return let(F.try_element_at(hits, F.lit(1)), lambda first: F.when(first.isNotNull(), let(F.aggregate(pairs, first, swap), cut)))


def callsite_context(df: DataFrame, ord_col: str, predict: str, code: str = "code") -> DataFrame:
    """(ord, predict_callsites): for each record the renamed calls to it by records with a prediction.

    Of several records of one (binary, name) only the last receives calls.
    """
    pairs = mapping(F.col(predict))
    callers = df.withColumn("_m", pairs).where(F.size("_m") > 0)
    calls = callers.select(identity(df).alias("bin_id"), F.col(ord_col).alias("o"), "_m", F.col(code).alias("_code"), F.posexplode("callees").alias("pos", "_c"))
    calls = calls.select("bin_id", "o", "pos", call_name(F.col("_c")).alias("callee"), "_m", "_code").withColumn("line", call_line(F.col("_code"), F.col("callee"), F.col("_m")))
    target = df.select(identity(df).alias("bin_id"), F.col("funname").alias("callee"), F.col(ord_col).alias("_o")).groupBy("bin_id", "callee").agg(F.max("_o").alias("ord"))
    found = calls.where("line IS NOT NULL").select("bin_id", "callee", "o", "pos", "line").join(target, ["bin_id", "callee"]).groupBy("ord").agg(ordered_distinct("line", "o", "pos").alias("predict_callsites"))
    return df.select(F.col(ord_col).alias("ord")).join(found, "ord", "left").select("ord", F.coalesce("predict_callsites", F.array().cast("array<string>")).alias("predict_callsites"))
