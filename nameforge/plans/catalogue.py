"""Queries over the operators of the engine, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nameforge.functions import code, names, pairs, similarity, text
from nameforge.operators import align, answers, curate, dedup, metrics, propagate, retrieve
from nameforge.plans import generate, prompts, summaries
from nameforge.plans.corpus import table
from nameforge.session import checkpoint, spread
from nameforge.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _lines(x: str) -> str:
    """SQL: list of stripped non-empty lines of x, with repeats."""
    return rf"list_filter(list_transform(regexp_split_to_array({x}, '\r\n|[\n\r]'), lambda l: {_strip('l')}), lambda l: l <> '')"


def _distinct(x: str) -> str:
    """SQL: the distinct values of a list, each at its first place."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


# ---- text ---------------------------------------------------------------------------------------------------------

_STRINGS = _lines("coalesce(analysis.strings_truncated, '')")
_LIBS = _lines("coalesce(analysis.ldd_output, '')")


@query(f"SELECT rec_id, array_to_string({_distinct('l')}, chr(10)) AS evidence FROM (SELECT rec_id, {_STRINGS} AS l FROM domain_records)")
def evidence_lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "domain_records").select("rec_id", text.distinct_lines(F.col("analysis.strings_truncated")).alias("evidence"))


@query(rf"""SELECT rec_id, array_to_string({_distinct('l')}, chr(10)) AS evidence FROM (
  SELECT rec_id, list_filter({_STRINGS}, lambda x: NOT regexp_matches(x, '%[sdlu]') AND NOT regexp_matches(x, '0x[0-9a-fA-F]+') AND regexp_matches(x, '\p{{L}}')) AS l FROM domain_records)""")
def strings_filter(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "domain_records").select("rec_id", text.readable_strings(F.col("analysis.strings_truncated")).alias("evidence"))


@query(rf"""SELECT rec_id, array_to_string({_distinct('l')}, chr(10)) AS libraries, array_to_string({_distinct('f')}, chr(10)) AS kind FROM (
  SELECT rec_id, list_filter(list_transform({_LIBS}, lambda x: CASE WHEN contains(x, '=>') THEN {_strip("split_part(x, '=>', 1)")} ELSE {_strip("regexp_replace(x, '\\s*\\(0x[0-9a-fA-F]+\\)$', '')".replace(chr(92)*2, chr(92)))} END), lambda x: x <> '') AS l,
         list_filter(list_transform({_lines("coalesce(analysis.file_output, '')")}, lambda x: regexp_replace(x, '^[^:]+:\s*', '')), lambda x: x <> '') AS f FROM domain_records)""")
def tool_evidence(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "domain_records").select("rec_id", text.library_evidence(F.col("analysis.ldd_output")).alias("libraries"), text.file_evidence(F.col("analysis.file_output")).alias("kind"))


@query("SELECT DISTINCT proj, CASE WHEN contains('12_' || proj, '_') THEN substr('12_' || proj, strpos('12_' || proj, '_') + 1) ELSE proj END AS project FROM functions")
def project_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "functions").select("proj").distinct().select("proj", prompts.project_of(F.concat(F.lit("12_"), "proj")).alias("project"))


# ---- code ---------------------------------------------------------------------------------------------------------

_BARE = r"regexp_replace(regexp_replace(code, '(?s)/\*.*?\*/', '', 'g'), '//[^\n]*', '', 'g')"
_OUTPUT = f"list_filter(list_transform(string_split(coalesce(output, ''), ','), lambda p: CASE WHEN contains(p, ':') THEN {_strip("split_part(p, ':', 1)")} || chr(1) || {_strip("substr(p, strpos(p, ':') + 1)")} END), lambda p: p IS NOT NULL)"


def _last_wins(x: str) -> str:
    """SQL: of entries ``key chr(1) value`` the first place and the last value of each key."""
    first = f"list_filter(list_transform({x}, lambda e: split_part(e, chr(1), 1)), lambda k, i: list_position(list_transform({x}, lambda e: split_part(e, chr(1), 1)), k) = i)"
    return f"list_transform({first}, lambda k: list_filter({x}, lambda e: split_part(e, chr(1), 1) = k)[-1])"


@query(rf"""SELECT func_id, md5(lower(regexp_replace(list_reduce(list_prepend({_BARE}, m), lambda acc, e: regexp_replace(acc, '([^a-zA-Z0-9_@]|^)' || regexp_escape(split_part(e, chr(1), 1)) || '([^a-zA-Z0-9_@])', '\1' || split_part(e, chr(1), 2) || '\2', 'g')), '\s+', '', 'g'))) AS digest
FROM (SELECT func_id, code, {_last_wins('o')} AS m FROM (SELECT func_id, code, {_OUTPUT} AS o FROM functions)) WHERE code IS NOT NULL""")
def norm_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = spread(table(spark, folder, "functions").where("code IS NOT NULL").select("func_id", "code", "output"))
    return rows.select("func_id", F.md5(code.norm_code(F.col("code"), pairs.parse(F.col("output")))).alias("digest"))


def _chain(x: str) -> str:
    """SQL: the normal form for retrieval, from the same fixed prefixes."""
    marks = [(rf"\b(?:{'|'.join(p)})[0-9a-fA-F]+\b", m) for p, m in ((code.FUNCTION_PREFIXES, "<fun>"), (code.LABEL_PREFIXES, "<label>"), (code.GLOBAL_PREFIXES, "<global_var>"))]
    for pattern, mark in [*marks, (r"\b0[xX][0-9a-fA-F]+\b", "<hex>"), (r"\b[0-9a-fA-F]+[hH]\b", "<hex>")]:
        x = f"regexp_replace({x}, '{pattern}', '{mark}', 'g')"
    return rf"lower(regexp_replace({x}, '\s+', '', 'g'))"


@query(f"SELECT func_id, md5({_chain(_BARE)}) AS digest FROM functions WHERE code IS NOT NULL")
def norm_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "functions").where("code IS NOT NULL").select("func_id", F.md5(code.norm_placeholders(F.col("code"))).alias("digest"))


_QUOTED = f"regexp_replace(code, '{code.IGNORED.replace(chr(39), chr(39) * 2)}', '', 'g')"
_NUMBERS = rf"list_sort(list_distinct(list_transform(list_filter(regexp_split_to_array({_QUOTED}, '[^{code.NAME_RUN}]+'), lambda t: regexp_matches(t, '{code.LITERAL}')), lambda t: lower(regexp_replace(t, '{code.SUFFIX}', '')))))"


@query(f"SELECT func_id, array_to_string({_NUMBERS}, ' ') AS literals FROM functions WHERE code IS NOT NULL")
def number_literals(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "functions").where("code IS NOT NULL").select("func_id", F.array_join(code.number_tokens(F.col("code")), " ").alias("literals"))


_VALUE = "CASE WHEN starts_with(t, '0x') THEN CAST(CAST(t AS HUGEINT) AS VARCHAR) WHEN ends_with(t, 'h') THEN CAST(CAST('0x' || rtrim(t, 'h') AS HUGEINT) AS VARCHAR) ELSE CAST(CAST(t AS HUGEINT) AS VARCHAR) END"


@query(f"SELECT func_id, array_to_string(list_sort(list_distinct(list_transform({_NUMBERS}, lambda t: {_VALUE}))), ' ') AS numbers FROM functions")
def numeric_constants(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "functions").select("func_id", F.array_join(code.numbers(F.col("code")), " ").alias("numbers"))


_QUIET = r"""regexp_replace(regexp_replace(regexp_replace(coalesce(code, ''), '"(?:\\.|[^"\\])*"', '""', 'g'), '(?s)/\*.*?\*/', '', 'g'), '//[^\r\n]*', '', 'g')"""
_COUNTED = "len(list_filter(string_split({0}, chr(10)), lambda l: " + _strip("l") + " NOT IN ('', '{{', '}}')))"
_CONVENTION_SQL = rf"^(?s)(.*?\b__(?:{'|'.join(code.CONVENTIONS)})\b)"


@query(rf"""WITH b AS (SELECT func_id, coalesce(funname, '') AS f, regexp_replace({_QUIET}, '^\s+', '') AS t FROM functions),
n AS (SELECT *, CASE WHEN f <> '' AND contains(t, f) THEN strpos(t, f) ELSE 0 END AS named FROM b),
o AS (SELECT *, CASE WHEN named > 0 AND contains(substr(t, named + length(f)), '(') THEN named + length(f) - 1 + strpos(substr(t, named + length(f)), '(') ELSE strpos(t, '(') END AS opened FROM n),
c AS (SELECT *, CASE WHEN opened > 0 AND contains(substr(t, opened), ')') THEN opened - 1 + strpos(substr(t, opened), ')') ELSE 0 END AS closed FROM o),
h AS (SELECT *, {_strip("substr(t, opened + 1, closed - opened - 1)")} AS inside, CASE WHEN named > 0 THEN substr(t, 1, named - 1) WHEN regexp_matches(substr(t, 1, opened - 1), '{_CONVENTION_SQL}') THEN regexp_extract(substr(t, 1, opened - 1), '{_CONVENTION_SQL}', 1) ELSE regexp_replace(substr(t, 1, opened - 1), '[A-Za-z_$?][A-Za-z0-9_$?@]*\s*$', '') END AS kind FROM c)
SELECT func_id, CAST(CASE WHEN closed = 0 OR lower(inside) IN ('', 'void') THEN 0 ELSE len(string_split(inside, ',')) END AS INTEGER) AS arg_count, CASE WHEN closed = 0 THEN '' ELSE lower(regexp_replace({_strip("kind")}, '\s+', ' ', 'g')) END AS return_type,
  CAST(CASE WHEN contains(substr(t, closed + 1), '{{') THEN {_COUNTED.format("substr(substr(t, closed + 1), strpos(substr(t, closed + 1), '{') + 1)")} ELSE 0 END AS INTEGER) AS loc, CAST({_COUNTED.format("t")} AS INTEGER) AS full_loc FROM h""")
def code_features(spark: SparkSession, folder: str) -> DataFrame:
    """Structural features; the SQL follows headers without nested brackets and comments within one line, the tests cover the rest."""
    return spread(table(spark, folder, "functions").select("func_id", "code", "funname")).select("func_id", code.features("code", "funname").alias("index")).select("func_id", "index.*")


@query(rf"""SELECT func_id, array_to_string(list_transform(list_filter(list_transform(CASE WHEN p IN ('', 'void') THEN [] ELSE string_split(p, ',') END, lambda x: {_strip('x')}), lambda x: x NOT IN ('', '...')),
  lambda x: CASE WHEN regexp_matches(x, '[*\s]') AND regexp_matches(x, '(?:^|[*\s])[A-Za-z_]\w*\s*(?:\[\s*\])?$') THEN regexp_extract(x, '(?:^|[*\s])([A-Za-z_]\w*)\s*(?:\[\s*\])?$', 1) ELSE 'null' END), ',') AS parameters
FROM (SELECT func_id, {_strip("regexp_extract(split_part(coalesce(code, ''), '{', 1), '(?s)@(([^()]*)@)', 1)".replace("@", chr(92)))} AS p FROM functions)""")
def header_parameters(spark: SparkSession, folder: str) -> DataFrame:
    """Parameter names; the SQL follows headers without nested parentheses, the tests cover the rest."""
    return table(spark, folder, "functions").select("func_id", F.array_join(code.parameters("code"), ",", "null").alias("parameters"))


@query(rf"""SELECT func_id, array_to_string({_distinct('c')}, chr(10)) AS calls FROM (SELECT func_id, list_transform(CASE WHEN funname <> '' THEN regexp_extract_all(coalesce(code, ''), '(?:^|[^A-Za-z0-9_.>])(' || regexp_escape(funname) || '[^(]*@([^()]*@))', 1) ELSE [] END, lambda x: {_strip('x')}) AS c FROM functions)""".replace("@", chr(92)))
def own_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls of each function in its own text (recursion and declaration); the SQL follows calls without nested parentheses, the tests cover the rest."""
    return table(spark, folder, "functions").select("func_id", F.array_join(code.calls("funname", F.array("code")), "\n").alias("calls"))


@query()
def caller_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls of each function in the codes of its callers, the records of its binary that list it; by caller, in order of occurrence."""
    rows = table(spark, folder, "functions")
    targets = rows.select("func_id", "bin", "funname")
    listed = propagate.edges(rows, "func_id").select("bin_id", "ord", "callee").distinct()
    edges = listed.join(targets, (F.col("bin_id") == F.col("bin")) & (F.col("callee") == F.col("funname"))).select("func_id", "ord", "callee")
    scanned = edges.join(rows.select(F.col("func_id").alias("ord"), "code"), "ord").select("func_id", "ord", F.posexplode(code.calls("callee", F.array("code"))).alias("pos", "call"))
    found = scanned.groupBy("func_id").agg(propagate.ordered_distinct("call", "ord", "pos").alias("_calls"))
    return targets.select("func_id").join(found, "func_id", "left").select("func_id", F.array_join(F.coalesce("_calls", F.array().cast("array<string>")), "\n").alias("calls"))


@query(r"""SELECT func_id, pos, CASE WHEN n = '' THEN regexp_replace(c, '^\s+|\s+$', '', 'g') WHEN p = '' THEN n || '()' ELSE n || '(' || array_to_string(list_transform(list_filter(list_transform(string_split(p, ','), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), lambda x: regexp_replace(regexp_split_to_array(x, '\s+')[-1], '[*&]', '', 'g')), ', ') || ')' END AS signature
FROM (SELECT func_id, pos, c, regexp_extract(c, '(?s)([A-Za-z_]\w*)\s*\((.*?)\)', 1) AS n, regexp_replace(regexp_extract(c, '(?s)([A-Za-z_]\w*)\s*\((.*?)\)', 2), '^\s+|\s+$', '', 'g') AS p
      FROM (SELECT func_id, unnest(range(len(callees))) AS pos, unnest(list_transform(callees, lambda e: substr(e, strpos(e, ':') + 1))) AS c FROM functions))""")
def callee_signatures(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "functions").select("func_id", F.posexplode("callees").alias("pos", "c"))
    return rows.select("func_id", F.col("pos").cast("long").alias("pos"), code.signature(text.after_first(F.col("c"), ":")).alias("signature"))


@query(r"""SELECT func_id, CASE WHEN n = '' THEN regexp_replace(c, '^\s+|\s+$', '', 'g') WHEN p = '' THEN n || '()' ELSE n || '(' || array_to_string(list_transform(list_filter(list_transform(string_split(p, ','), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), lambda x: regexp_replace(regexp_split_to_array(x, '\s+')[-1], '[*&]', '', 'g')), ', ') || ')' END AS signature
FROM (SELECT func_id, c, regexp_extract(c, '(?s)([A-Za-z_]\w*)\s*\((.*?)\)', 1) AS n, regexp_replace(regexp_extract(c, '(?s)([A-Za-z_]\w*)\s*\((.*?)\)', 2), '^\s+|\s+$', '', 'g') AS p
      FROM (SELECT func_id, split_part(code, '{', 1) AS c FROM functions WHERE code IS NOT NULL))""")
def header_signatures(spark: SparkSession, folder: str) -> DataFrame:
    """The signature in each function's own header."""
    return table(spark, folder, "functions").where("code IS NOT NULL").select("func_id", code.callee_signature(F.col("code")).alias("signature"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 3 = 0 THEN 'fp' || CASE WHEN l_quantity >= 25 THEN '+' ELSE '' END || CAST(CAST(l_quantity AS BIGINT) - 25 AS VARCHAR) WHEN l_suppkey % 3 = 1 THEN 'DW_OP_reg' || CAST(l_linenumber AS VARCHAR) ELSE 'addr_0x' || CAST(l_partkey AS VARCHAR) END AS location,
  CASE l_suppkey % 3 WHEN 0 THEN 'stack' WHEN 1 THEN 'reg' ELSE 'global' END AS location_type,
  CASE WHEN l_suppkey % 3 = 0 THEN CAST(l_quantity AS BIGINT) - 25 + 8 END AS stack_end FROM lineitem""")
def debug_locations(spark: SparkSession, folder: str) -> DataFrame:
    """Location texts made from numbers, classified."""
    kind = F.col("l_suppkey") % 3
    offset = (F.col("l_quantity").cast("long") - 25).cast("string")
    raw = F.when(kind == 0, F.concat(F.lit("2 byte block: (DW_OP_fbreg: "), offset, F.lit(")"))).when(kind == 1, F.concat(F.lit("(DW_OP_reg"), F.col("l_linenumber").cast("string"), F.lit(" (rax))"))).otherwise(F.concat(F.lit("(DW_OP_addr: "), F.col("l_partkey").cast("string"), F.lit(")")))
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", code.location(raw, F.lit(8).cast("long")).alias("x"))
    return rows.select("l_orderkey", "l_linenumber", "x.location", "x.location_type", "x.stack_end")


# ---- mappings -----------------------------------------------------------------------------------------------------


def _pairs_sql(trim: bool, lower: bool, empty: bool, valueless: bool, source: str = "predict", base: str = "predictions", key: str = "pred_id") -> str:
    def side(x: str) -> str:
        x = _strip(x) if trim else x
        return f"lower({x})" if lower else x

    v = side("substr(p, strpos(p, ':') + 1)")
    entry = f"{side("split_part(p, ':', 1)")} || chr(1) || " + (f"CASE WHEN contains(p, ':') THEN {v} ELSE chr(2) END" if valueless else v)
    kept = "list_filter(string_split(t, ','), lambda p: " + ("t <> ''" if valueless else "contains(p, ':')") + ")"
    listed = f"list_transform({kept}, lambda p: {entry})"
    if not empty:
        listed = f"list_filter({listed}, lambda e: split_part(e, chr(1), 1) <> '')"
    return f"SELECT {key}, array_to_string(list_transform({_last_wins('l')}, lambda e: replace(replace(e, chr(1), '='), chr(2), 'NULL')), '|') AS entries FROM (SELECT {key}, {listed} AS l FROM (SELECT {key}, coalesce({source}, '') AS t FROM {base}))"


def _pairs(spark: SparkSession, folder: str, **how) -> DataFrame:
    got = pairs.parse(F.col("predict"), **how)
    return table(spark, folder, "predictions").select("pred_id", F.array_join(F.transform(got, lambda e: F.concat(e["k"], F.lit("="), F.coalesce(e["v"], F.lit("NULL")))), "|").alias("entries"))


@query(_pairs_sql(True, False, True, False))
def pairs_strip(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder)


@query(_pairs_sql(True, False, False, False))
def pairs_drop_empty(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder, empty_keys=False)


@query(_pairs_sql(False, False, True, True))
def pairs_as_written(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder, trim=False, valueless=True)


@query(_pairs_sql(True, True, True, False))
def pairs_lower(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder, lower=True)


# ---- joins, order, sets -------------------------------------------------------------------------------------------


@query("SELECT proj, bin, funname, func_id, addr FROM functions QUALIFY row_number() OVER (PARTITION BY proj, bin, funname ORDER BY func_id DESC) = 1")
def last_record(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.last_wins(table(spark, folder, "functions").select("proj", "bin", "funname", "func_id", "addr"), ["proj", "bin", "funname"], "func_id")


@query("SELECT min(func_id) AS func_id, md5(code) AS digest FROM functions GROUP BY md5(code)")
def dedup_exact(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.first_exact(table(spark, folder, "functions").select("func_id", F.md5("code").alias("digest")), "func_id", ["digest"])


@query()
def dedup_greedy(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.greedy(table(spark, folder, "functions_norm"), "func_id")


@query("""SELECT f.func_id, o.other_id, coalesce(o.funname, 'unknown') AS other_name FROM functions f LEFT JOIN (
  SELECT proj, bin, addr, func_id AS other_id, funname FROM functions_norm QUALIFY row_number() OVER (PARTITION BY proj, bin, addr ORDER BY func_id DESC) = 1) o
ON f.proj = o.proj AND f.bin = o.bin AND f.addr = o.addr""")
def align_by_address(spark: SparkSession, folder: str) -> DataFrame:
    right = table(spark, folder, "functions_norm").select("proj", "bin", "addr", "func_id", "funname")
    out = align.by_address(table(spark, folder, "functions").select("func_id", "proj", "bin", "addr"), right, ["proj", "bin", "addr"], "func_id", "left")
    return out.select("func_id", F.col("other.func_id").alias("other_id"), F.coalesce("other.funname", F.lit("unknown")).alias("other_name"))


@query("""SELECT f.func_id, o.other_id FROM functions f JOIN (
  SELECT proj, bin, addr, func_id AS other_id FROM functions_norm QUALIFY row_number() OVER (PARTITION BY proj, bin, addr ORDER BY func_id DESC) = 1) o
ON f.proj = o.proj AND f.bin = o.bin AND f.addr = o.addr""")
def align_inner(spark: SparkSession, folder: str) -> DataFrame:
    """Functions that stand in both tables."""
    right = table(spark, folder, "functions_norm").select("proj", "bin", "addr", "func_id")
    out = align.by_address(table(spark, folder, "functions").select("func_id", "proj", "bin", "addr"), right, ["proj", "bin", "addr"], "func_id")
    return out.select("func_id", F.col("other.func_id").alias("other_id"))


@query("SELECT func_id FROM functions WHERE params_aligned IS NOT NULL AND vars_aligned IS NOT NULL")
def params_and_variables(spark: SparkSession, folder: str) -> DataFrame:
    """Functions with both parameters and variables."""
    return align.with_both(table(spark, folder, "functions"), "params_aligned", "vars_aligned").select("func_id")


_ZIP = "CASE WHEN callees IS NOT NULL AND callsites IS NOT NULL THEN list_transform(range(1, least(len(callees), len(callsites)) + 1), lambda i: callees[i] || ':' || callsites[i]) END"


@query(f"SELECT func_id, array_to_string({_distinct('z')}, '|') AS zipped FROM (SELECT func_id, {_ZIP} AS z FROM functions)")
def zip_positions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "functions").select("func_id", F.array_join(align.zip_callees(F.col("callees"), F.col("callsites")), "|").alias("zipped"))


def _stack(spark: SparkSession, folder: str) -> DataFrame:
    """Stack variables and debug variables made from the lines of each order."""
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    lines = table(spark, folder, "lineitem").select("l_orderkey", number.alias("l_linenumber"), (F.col("l_partkey") % 64).cast("long").alias("s"), (F.col("l_suppkey") % 64).cast("long").alias("d"), (F.col("l_quantity").cast("long") % 16 + 1).alias("w"))
    variable = F.struct(F.concat(F.lit("v"), F.col("l_linenumber").cast("string")).alias("variable"), (F.col("s") + 16).alias("rbp_offset_int"), (F.col("s") + 16).alias("stack_start"), (F.col("s") + 24).alias("stack_end"))
    debug = F.struct(F.concat(F.lit("name"), F.col("l_linenumber").cast("string")).alias("name"), F.concat(F.lit("t"), (F.col("w") % 3).cast("string")).alias("type"), F.concat(F.lit("fp+"), F.col("d").cast("string")).alias("location"), F.col("d").alias("stack_start"), (F.col("d") + F.col("w") * 4).alias("stack_end"))
    got = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", variable.alias("x"), debug.alias("y")))).alias("a"))
    return got.select("l_orderkey", F.transform("a", lambda e: e["x"]).alias("variables"), F.transform("a", lambda e: e["y"]).alias("debug"))


_STACK_SQL = """WITH l AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n, l_partkey % 64 AS s, l_suppkey % 64 AS d, CAST(l_quantity AS BIGINT) % 16 + 1 AS w FROM lineitem)"""


@query(f"""{_STACK_SQL}, hit AS (SELECT v.o, v.n, min_by('name' || d.n, d.n) AS name FROM l v JOIN l d ON v.o = d.o AND d.d = v.s GROUP BY v.o, v.n),
inside AS (SELECT DISTINCT v.o, v.n FROM l v JOIN l d ON v.o = d.o AND v.s >= d.d AND v.s + 8 <= d.d + d.w * 4)
SELECT l.o AS l_orderkey, 'v' || l.n AS variable, coalesce(hit.name, CASE WHEN inside.n IS NOT NULL THEN '-' END) AS name FROM l LEFT JOIN hit USING (o, n) LEFT JOIN inside USING (o, n) WHERE coalesce(hit.name, CAST(inside.n AS VARCHAR)) IS NOT NULL""")
def align_stack(spark: SparkSession, folder: str) -> DataFrame:
    rows = _stack(spark, folder).select("l_orderkey", F.explode(align.align_variables(F.col("variables"), F.col("debug"))).alias("e"))
    return rows.select("l_orderkey", F.col("e.k").alias("variable"), F.col("e.v").alias("name"))


@query(f"""{_STACK_SQL}, c AS (SELECT d.o, d.n, 't' || (d.w % 3) AS type, string_agg('v' || v.n, ',' ORDER BY v.n) AS members FROM l d JOIN l v ON v.o = d.o AND v.s >= d.d AND v.s + 8 <= d.d + d.w * 4 AND NOT (v.s = d.d AND v.s + 8 = d.d + d.w * 4) GROUP BY d.o, d.n, d.w)
SELECT o AS l_orderkey, type, members FROM c QUALIFY row_number() OVER (PARTITION BY o, type ORDER BY n DESC) = 1""")
def stack_clusters(spark: SparkSession, folder: str) -> DataFrame:
    rows = _stack(spark, folder).select("l_orderkey", F.explode(align.clusters(F.col("variables"), F.col("debug"))).alias("e"))
    return rows.select("l_orderkey", F.col("e.k").alias("type"), F.array_join("e.v", ",").alias("members"))


@query("""SELECT f.func_id, CASE WHEN n.addr IS NOT NULL THEN n.output ELSE f.output END AS output FROM functions f LEFT JOIN (
  SELECT proj, bin, addr, output FROM functions_norm QUALIFY row_number() OVER (PARTITION BY proj, bin, addr ORDER BY func_id DESC) = 1) n ON f.proj = n.proj AND f.bin = n.bin AND f.addr = n.addr""")
def upsert_fields(spark: SparkSession, folder: str) -> DataFrame:
    base = table(spark, folder, "functions").select("func_id", "proj", "bin", "addr", "output")
    return align.upsert(base, table(spark, folder, "functions_norm"), ["proj", "bin", "addr"], ["output"], "func_id").select("func_id", "output")


@query(rf"""WITH s AS (SELECT proj, bin, min({_strip('domain_summary')}) AS lo, max({_strip('domain_summary')}) AS hi FROM domain_records WHERE {_strip('domain_summary')} <> '' GROUP BY proj, bin)
SELECT f.func_id, CASE WHEN lo = hi THEN lo END AS domain_summary, CASE WHEN lo IS NULL THEN 'missing' WHEN lo = hi THEN 'found' ELSE 'conflict' END AS lookup_status FROM functions f LEFT JOIN s ON f.proj = s.proj AND f.bin = s.bin""")
def summary_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return curate.lookup_join(table(spark, folder, "functions").select("func_id", "proj", "bin"), table(spark, folder, "domain_records"), ["proj", "bin"], "domain_summary").select("func_id", "domain_summary", "lookup_status")


@query(rf"SELECT proj, bin, count(DISTINCT {_strip('domain_summary')}) AS values FROM domain_records WHERE {_strip('domain_summary')} <> '' GROUP BY proj, bin HAVING count(DISTINCT {_strip('domain_summary')}) > 1")
def summary_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    return curate.lookup_conflicts(table(spark, folder, "domain_records"), ["proj", "bin"], "domain_summary")


# ---- retrieval ----------------------------------------------------------------------------------------------------


def _nearest(spark: SparkSession, folder: str, keep: tuple[str, ...] = (), threshold: float = 90.0) -> DataFrame:
    """The most similar other function by the ratio of normalised code, over 90; numeric constants decide ties only."""
    rows = spread(table(spark, folder, "functions_norm").select(F.col("func_id").alias("id"), "index", F.col("norm_code").alias("code")))
    # Written once: blocks, pairs and ties read it, and the normal form is costly.
    rows = checkpoint(rows.withColumn("text", code.norm_placeholders(F.col("code"))).withColumn("numbers", code.numbers(F.col("code"))))
    return retrieve.retrieve(rows, rows, text="text", source="code", numbers="numbers", keep=keep, threshold=threshold, not_self=True)


def _diagnostics(df: DataFrame) -> DataFrame:
    r = F.col("retrieval")
    return df.select(
        "id",
        r["status"].alias("status"),
        F.col("match.id").alias("match_id"),
        r["best_score"].alias("best"),
        r["second_best_score"].alias("second"),
        r["qualified_candidate_count"].alias("qualified"),
        r["size_filtered_candidate_count"].alias("sized"),
        r["top_similarity_candidate_count"].alias("top"),
        r["selection_method"].alias("method"),
        F.round(r["best_numeric_constant_jaccard"], 9).alias("best_jaccard"),
        F.round(r["second_best_numeric_constant_jaccard"], 9).alias("second_jaccard"),
        r["top_jaccard_candidate_count"].alias("top_jaccard"),
    )


@query()
def retrieve_similar(spark: SparkSession, folder: str) -> DataFrame:
    return _diagnostics(_nearest(spark, folder))


@query()
def retrieval_counts(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.status_counts(_nearest(spark, folder).select(F.col("retrieval.status").alias("status")), "status", retrieve.STATUSES)


_NORM_VALUES = f"list_sort(list_distinct(list_transform({_NUMBERS.replace('regexp_replace(code,', 'regexp_replace(norm_code,', 1)}, lambda t: {_VALUE})))"
_RETRIEVE_SQL = f"""
WITH r AS (SELECT func_id AS id, index AS ix, norm_code, {_chain(_BARE.replace("regexp_replace(code,", "regexp_replace(norm_code,"))} AS txt, {_NORM_VALUES} AS nums,
  index IS NOT NULL AND index.arg_count IS NOT NULL AND index.return_type IS NOT NULL AND index.loc IS NOT NULL AND index.full_loc IS NOT NULL AS has FROM functions_norm),
p AS (SELECT a.id AS t, c.id AS c, a.nums AS n0, c.nums AS n1, a.txt = c.txt AS hit
  FROM r a JOIN r c ON a.has AND c.has AND a.ix.arg_count = c.ix.arg_count AND a.ix.return_type = c.ix.return_type AND a.id <> c.id AND a.txt IS NOT NULL AND length(c.norm_code) > 0 AND NOT a.ix.loc BETWEEN 1 AND 1
   AND abs(a.ix.loc - c.ix.loc) * 10 <= greatest(a.ix.loc, c.ix.loc) * 3 AND abs(a.ix.full_loc - c.ix.full_loc) * 10 <= greatest(a.ix.full_loc, c.ix.full_loc) * 3),
b AS (SELECT t, count(*) AS sized FROM p GROUP BY t),
j AS (SELECT t, c, CASE WHEN len(n0) > 0 THEN len(list_intersect(n0, n1)) / len(list_distinct(n0 || n1)) END AS j FROM p WHERE hit),
k AS (SELECT t, count(*) AS top, min(c) AS one, count(*) FILTER (j IS NULL) AS gaps, max(j) AS j1 FROM j GROUP BY t),
m AS (SELECT j.t, count(*) AS topj, min(c) AS jc FROM j JOIN k ON j.t = k.t AND j.j = k.j1 GROUP BY j.t),
n AS (SELECT j.t, max(j) AS j2 FROM j JOIN k ON j.t = k.t AND j.j < k.j1 GROUP BY j.t)
SELECT r.id, CASE WHEN NOT has THEN 'missing_index' WHEN ix.loc BETWEEN 1 AND 1 THEN 'short_loc' WHEN top IS NULL THEN 'no_match' WHEN top = 1 THEN 'matched' WHEN gaps > 0 THEN 'ambiguous' WHEN topj = 1 THEN 'matched' ELSE 'ambiguous' END AS status,
  CASE WHEN top = 1 THEN one WHEN top > 1 AND gaps = 0 AND topj = 1 THEN jc END AS match_id, CASE WHEN top IS NOT NULL THEN CAST(100 AS DOUBLE) END AS best, CASE WHEN top > 1 THEN CAST(100 AS DOUBLE) END AS second, coalesce(top, 0) AS qualified, coalesce(sized, 0) AS sized, coalesce(top, 0) AS top,
  CASE WHEN top = 1 THEN 'similarity' WHEN gaps > 0 THEN 'numeric_constant_jaccard_unavailable' WHEN topj = 1 THEN 'numeric_constant_jaccard' WHEN topj > 1 THEN 'unresolved_numeric_constant_jaccard' END AS method,
  round(CASE WHEN top > 1 AND gaps = 0 THEN j1 END, 9) AS best_jaccard, round(CASE WHEN top > 1 AND gaps = 0 THEN CASE WHEN topj > 1 THEN j1 ELSE j2 END END, 9) AS second_jaccard,
  CASE WHEN top > 1 AND gaps > 0 THEN top WHEN top > 1 THEN topj ELSE 0 END AS top_jaccard
FROM r LEFT JOIN b ON r.id = b.t LEFT JOIN k ON r.id = k.t LEFT JOIN m ON r.id = m.t LEFT JOIN n ON r.id = n.t"""


@query(_RETRIEVE_SQL)
def retrieve_equal(spark: SparkSession, folder: str) -> DataFrame:
    """The same retrieval where only equal normalised code scores high enough: all that SQL can follow of it."""
    return _diagnostics(_nearest(spark, folder, threshold=99.999))


@query("""WITH b AS (SELECT p_brand, max(p_retailprice) AS best FROM part GROUP BY p_brand)
SELECT p_brand, min(p_partkey) FILTER (p_retailprice = best) AS best_id, best, CASE WHEN count(*) FILTER (p_retailprice = best) > 1 THEN best ELSE max(p_retailprice) FILTER (p_retailprice < best) END AS second, count(*) FILTER (p_retailprice = best) AS ties FROM part JOIN b USING (p_brand) GROUP BY p_brand, best""")
def top_and_runner_up(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.top_with_runner_up(table(spark, folder, "part"), "p_brand", "p_retailprice", "p_partkey")


# ---- context ------------------------------------------------------------------------------------------------------


def _called(spark: SparkSession, folder: str) -> DataFrame:
    """Functions whose names are known, seen as predictions."""
    rows = table(spark, folder, "functions").withColumn("ord", F.col("func_id")).withColumn("predict", F.col("output"))
    return rows.withColumn("params", F.array_sort(F.coalesce(F.map_keys("params_aligned"), F.array().cast("array<string>")))).withColumn("callees", F.coalesce("callees", F.array().cast("array<string>")))


_MAPPED = f"list_filter({_OUTPUT}, lambda e: split_part(e, chr(1), 1) <> '')"


@query(f"""WITH f AS (SELECT func_id, bin, funname, {_last_wins('m')} AS m, list_sort(coalesce(map_keys(params_aligned), [])) AS ps FROM (SELECT func_id, bin, funname, {_MAPPED} AS m, params_aligned FROM functions)),
t AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY bin, funname ORDER BY func_id DESC) = 1),
e AS (SELECT func_id, bin, unnest(range(len(callees))) AS pos, unnest(list_transform(callees, lambda c: {_strip("split_part(c, ':', 1)")})) AS callee FROM functions),
s AS (SELECT e.func_id, e.pos, callee || ':' || coalesce(split_part(list_filter(m, lambda x: split_part(x, chr(1), 1) = callee)[1], chr(1), 2), callee) || '(' || array_to_string(list_transform(ps, lambda p: coalesce(split_part(list_filter(m, lambda x: split_part(x, chr(1), 1) = p)[1], chr(1), 2), p)), ', ') || ')' AS sig
      FROM e JOIN t ON e.bin = t.bin AND e.callee = t.funname WHERE len(m) > 0),
d AS (SELECT func_id, sig, min(pos) AS pos FROM s GROUP BY func_id, sig)
SELECT f.func_id AS ord, coalesce(string_agg(sig, '|' ORDER BY d.pos), '') AS predict_callees FROM f LEFT JOIN d ON f.func_id = d.func_id GROUP BY f.func_id""")
def propagate_callees(spark: SparkSession, folder: str) -> DataFrame:
    return propagate.callee_context(_called(spark, folder), "ord", "predict", params="params").select("ord", F.array_join("predict_callees", "|").alias("predict_callees"))


_CODE_LINES = _lines("code")
_CALL_LINES = rf"""WITH f AS (SELECT func_id, bin, code, callees, {_last_wins('m')} AS m FROM (SELECT func_id, bin, code, callees, {_MAPPED} AS m FROM functions)),
e AS (SELECT func_id AS o, bin, code, m, unnest(range(len(callees))) AS pos, unnest(list_transform(callees, lambda c: {_strip("split_part(c, ':', 1)")})) AS callee FROM f WHERE len(m) > 0),
h AS (SELECT o, bin, pos, callee, m, list_filter({_CODE_LINES}, lambda l: regexp_matches(l, '\b' || regexp_escape(callee) || '\s*\('))[1] AS line FROM e),
r AS (SELECT o, bin, pos, callee, coalesce(split_part(list_filter(m, lambda x: split_part(x, chr(1), 1) = callee)[1], chr(1), 2), callee) AS name,
        list_reduce(list_prepend(line, m), lambda acc, x: regexp_replace(acc, '\b' || regexp_escape(split_part(x, chr(1), 1)) || '\b', split_part(x, chr(1), 2), 'g')) AS line FROM h WHERE line IS NOT NULL),
l AS (SELECT o, bin, pos, callee, coalesce(nullif({_strip("regexp_extract(line, '@b' || regexp_escape(name) || '@s*@([^)]*@)')".replace("@", chr(92)))}, ''), line) AS line FROM r)"""


@query(f"{_CALL_LINES} SELECT o AS func_id, pos, line FROM l")
def call_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The first call of each callee in a function's code, with predicted names: what callsite_context hands on."""
    rows = _called(spark, folder).withColumn("m", propagate.mapping(F.col("predict"))).where(F.size("m") > 0)
    calls = rows.select("func_id", "code", "m", F.posexplode("callees").alias("pos", "c")).select("func_id", F.col("pos").cast("long").alias("pos"), propagate.call_line(F.col("code"), code.call_name(F.col("c")), F.col("m")).alias("line"))
    return calls.where("line IS NOT NULL")


@query(f"""{_CALL_LINES},
t AS (SELECT bin, funname AS callee, max(func_id) AS ord FROM functions GROUP BY ALL),
d AS (SELECT t.ord, line, min(o * 1000000 + pos) AS at FROM l JOIN t ON l.bin = t.bin AND l.callee = t.callee GROUP BY t.ord, line)
SELECT f.func_id AS ord, coalesce(string_agg(line, '|' ORDER BY d.at), '') AS predict_callsites FROM functions f LEFT JOIN d ON f.func_id = d.ord GROUP BY f.func_id""")
def propagate_callsites(spark: SparkSession, folder: str) -> DataFrame:
    return propagate.callsite_context(_called(spark, folder), "ord", "predict").select("ord", F.array_join("predict_callsites", "|").alias("predict_callsites"))


@query()
def context_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """Two rounds of prediction and propagation with the offline stand-in for a model.

    What is similar is the winner of the retrieval, the summary that of the program; records without one go without.
    """
    rows = _called(spark, folder).drop("predict").where("code IS NOT NULL")
    rows = rows.withColumn("variables", F.array_sort(F.coalesce(F.map_keys("vars_aligned"), F.array().cast("array<string>"))))
    rows = curate.lookup_join(rows, table(spark, folder, "domain_records"), ["proj", "bin"], "domain_summary").withColumnRenamed("domain_summary", "summary")
    # Written once: the rounds read it several times, and the retrieval is costly.
    won = checkpoint(_nearest(spark, folder, ("code",)).where("match IS NOT NULL").select(F.col("id").alias("ord"), F.col("match.code").alias("similar")))
    rows = rows.join(won, "ord", "left")
    out = generate.rounds(rows.select("ord", "bin", "funname", "code", "callees", "params", "variables", "output", "summary", "similar"), 2)
    return out.select("ord", F.md5("input").alias("prompt_digest"), "predict", F.size("predict_callees").alias("callees_known"))


# ---- prompts ------------------------------------------------------------------------------------------------------

_TARGETS = "array_to_string(list_sort(coalesce(map_keys(params_aligned), [])) || list_sort(coalesce(map_keys(vars_aligned), [])) || [funname] || list_transform(coalesce(callees, []), lambda c: split_part(c, ':', 1)), ', ')"


@query(f"""SELECT func_id, md5(chr(10) || '<SUMMARY>' || chr(10) || 's' || chr(10) || '</SUMMARY>' || chr(10) || '<CallSites>' || chr(10) || array_to_string(coalesce(callsites, []), ', ') || chr(10) || '</CallSites>' || chr(10) || '<Callees>' || chr(10) || array_to_string(coalesce(callees, []), ', ') || chr(10) || '</Callees>' || chr(10) || '<code>' || chr(10) || code || chr(10) || '</code>' || chr(10) || 'predict the original names of ' || {_TARGETS} || '.' || chr(10) || '    ') AS digest FROM functions WHERE code IS NOT NULL""")
def prompt_context(spark: SparkSession, folder: str) -> DataFrame:
    rows = _called(spark, folder).where("code IS NOT NULL")
    asked = prompts.targets(F.col("params"), F.array_sort(F.map_keys("vars_aligned")), F.col("funname"), F.col("callees"))
    return rows.select("func_id", F.md5(prompts.context_prompt(F.lit("<SUMMARY>s</SUMMARY>"), F.col("callsites"), F.col("callees"), F.col("code"), asked)).alias("digest"))


_EMPTY = f"CASE WHEN len({{0}}) = 0 THEN '{{1}}' ELSE array_to_string({{0}}, chr(10)) END"


@query(f"""SELECT rec_id, '{prompts.DOMAIN_TASK}' || chr(10) || '<PROJECT_NAME>' || chr(10) || {_strip("coalesce(analysis.project_name, '')")} || chr(10) || '</PROJECT_NAME>' || chr(10) || '<FILE_OUTPUT>' || chr(10) || {_strip("coalesce(analysis.file_output, '')")} || chr(10) || '</FILE_OUTPUT>' || chr(10) || '<LDD_OUTPUT>' || chr(10)
  || {_EMPTY.format('libs', prompts.NO_LIBRARIES)} || chr(10) || '</LDD_OUTPUT>' || chr(10) || '<STRINGS_OUTPUT>' || chr(10) || {_EMPTY.format('strs', prompts.NO_STRINGS)} || chr(10) || '</STRINGS_OUTPUT>' || chr(10) AS prompt, len(libs) = 0 AS no_libraries, len(strs) = 0 AS no_strings
FROM (SELECT rec_id, analysis, {_distinct('l')} AS libs, {_distinct('s')} AS strs FROM (SELECT rec_id, analysis, {_LIBS} AS l, {_STRINGS} AS s FROM domain_records))""")
def prompt_domain(spark: SparkSession, folder: str) -> DataFrame:
    made = prompts.domain_prompt(F.col("analysis.project_name"), F.col("analysis.file_output"), F.col("analysis.ldd_output"), F.col("analysis.strings_truncated"))
    rows = table(spark, folder, "domain_records").select("rec_id", made.alias("p"))
    return rows.select("rec_id", prompts.cut_domain(F.col("p.prompt")).alias("prompt"), "p.no_libraries", "p.no_strings")


@query(rf"""SELECT rec_id, CASE WHEN {_strip("coalesce(domain_summary, '')")} <> '' THEN 'completed' WHEN analysis IS NULL THEN 'missing_prompt' ELSE 'pending' END AS status, {_strip("coalesce(domain_summary, '')")} <> '' OR analysis IS NOT NULL AS summarised FROM domain_records""")
def domain_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """The first summary stage with the offline stand-in for a model."""
    got = summaries.domain_summaries(table(spark, folder, "domain_records"))
    return got.select("rec_id", "status", (F.coalesce("domain_summary", F.lit("")) != "").alias("summarised"))


@query(rf"""WITH s AS (SELECT proj, bin, min({_strip('domain_summary')}) AS lo, max({_strip('domain_summary')}) AS hi FROM domain_records WHERE {_strip('domain_summary')} <> '' GROUP BY proj, bin)
SELECT f.func_id, CASE WHEN lo IS NULL THEN 'missing' WHEN lo = hi THEN 'found' ELSE 'conflict' END AS lookup_status, CASE WHEN lo = hi AND {_strip("coalesce(code, '')")} <> '' AND funname IS NOT NULL THEN 'pending' ELSE 'missing_prompt' END AS status
FROM functions f LEFT JOIN s ON f.proj = s.proj AND f.bin = s.bin""")
def identifier_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """The second summary stage over the summaries that the programs have."""
    got = summaries.identifier_summaries(table(spark, folder, "functions"), table(spark, folder, "domain_records"))
    return got.select("func_id", "lookup_status", "status")


_BODY = f"CASE WHEN starts_with(c, 'code:') THEN CASE WHEN contains(c, chr(10)) THEN substr(c, strpos(c, chr(10)) + 1) ELSE '' END ELSE c END"
_CALLED = _distinct("k")


@query(f"""SELECT func_id, length(t) AS chars, md5(t) AS digest FROM (
  SELECT func_id, CASE WHEN body <> '' THEN '{prompts.IDENTIFIER_TASK}' || chr(10) || '<SUMMARY>' || chr(10) || 'a program' || chr(10) || '</SUMMARY>' || chr(10) || '<FUNCTION_CODE>' || chr(10) || body || chr(10) || '</FUNCTION_CODE>' || chr(10) || '<IDENTIFIERS>' || chr(10)
    || array_to_string(list_transform(list_sort(coalesce(map_keys(params_aligned), [])), lambda n: 'PARAM: ' || n) || list_transform(list_sort(coalesce(map_keys(vars_aligned), [])), lambda n: 'VAR: ' || n) || ['FUNC: ' || funname] || list_transform({_CALLED}, lambda n: 'CALL: ' || n), chr(10)) || chr(10) || '</IDENTIFIERS>' || chr(10) END AS t
  FROM (SELECT *, {_BODY} AS body FROM (SELECT func_id, funname, params_aligned, vars_aligned, {_strip("coalesce(code, '')")} AS c, list_filter(list_transform(coalesce(callees, []), lambda e: {_strip("split_part(e, ':', 1)")}), lambda e: e <> '') AS k FROM functions)))""")
def prompt_identifiers(spark: SparkSession, folder: str) -> DataFrame:
    rows = _called(spark, folder)
    made = prompts.identifier_prompt(F.lit("<SUMMARY> a program </SUMMARY>"), F.col("code"), F.col("params"), F.array_sort(F.map_keys("vars_aligned")), F.col("funname"), F.col("callees"))
    return rows.select("func_id", F.length(prompts.cut_identifier(made)).alias("chars"), F.md5(prompts.cut_identifier(made)).alias("digest"))


@query("""SELECT doc_id, md5(CASE WHEN length(p) <= 400 THEN p ELSE substr('<STRINGS_OUTPUT>' || CASE WHEN contains(r, chr(10)) THEN substr(r, 1, length(r) - strpos(reverse(r), chr(10))) ELSE r END || m || '</STRINGS_OUTPUT>', 1, 400) END) AS digest
FROM (SELECT doc_id, p, m, substr(text, 1, 400 - 16 - 17 - length(m)) AS r FROM (SELECT doc_id, text, '<STRINGS_OUTPUT>' || text || '</STRINGS_OUTPUT>' AS p, chr(10) || '...[STRINGS TRUNCATED TO FIT MODEL CONTEXT]...' || chr(10) AS m FROM documents WHERE text IS NOT NULL))""")
def prompt_cut(spark: SparkSession, folder: str) -> DataFrame:
    """Cut to 400 characters, so that there is something to cut; prompt_cut_production has the limit of the models."""
    return _cut(spark, folder, 400)


def _cut(spark: SparkSession, folder: str, most: int) -> DataFrame:
    rows = table(spark, folder, "documents").where("text IS NOT NULL")
    return rows.select("doc_id", F.md5(prompts.cut_domain(F.concat(F.lit("<STRINGS_OUTPUT>"), "text", F.lit("</STRINGS_OUTPUT>")), most)).alias("digest"))


@query(SQL["prompt_cut"].replace("400", str(prompts.MOST_CHARS)))
def prompt_cut_production(spark: SparkSession, folder: str) -> DataFrame:
    return _cut(spark, folder, prompts.MOST_CHARS)


# ---- scores -------------------------------------------------------------------------------------------------------


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    truth = table(spark, folder, "test").select("test_id", "funname_aligned", "params_aligned", "vars_aligned", "in_train")
    rows = table(spark, folder, "predictions").where(F.col("predict") != "").select("pred_id", "test_id", "predict").join(truth, "test_id")
    return metrics.scored_pairs(rows, pairs.parse(F.col("predict")), "pred_id", {"fun": "funname_aligned", "param": "params_aligned", "var": "vars_aligned"}, ("in_train",))


_PREDICT = _OUTPUT.replace("output", "predict")
_SCORED_SQL = f"""
WITH q AS (SELECT pred_id, test_id, unnest({_last_wins('m')}) AS e FROM (SELECT pred_id, test_id, {_PREDICT} AS m FROM predictions WHERE predict <> '')),
j AS (SELECT q.pred_id, split_part(e, chr(1), 1) AS name, split_part(e, chr(1), 2) AS pred, t.* FROM q JOIN test t USING (test_id)),
x AS (SELECT 'fun' AS kind, in_train, pred, funname_aligned[name] AS gt FROM j WHERE map_contains(funname_aligned, name)
  UNION ALL SELECT 'param', in_train, pred, params_aligned[name] FROM j WHERE map_contains(params_aligned, name)
  UNION ALL SELECT 'var', in_train, pred, vars_aligned[name] FROM j WHERE map_contains(vars_aligned, name))"""


@query(f"""{_SCORED_SQL}, y AS (SELECT kind, in_train, CASE WHEN gt IS NOT NULL AND lower(gt) = lower(pred) THEN 1.0 ELSE 0.0 END AS p FROM x),
z AS (SELECT k.kind, s.split, p FROM y, LATERAL (SELECT unnest([y.kind, CASE WHEN y.kind <> 'fun' THEN 'params_vars' END, 'total']) AS kind) k, LATERAL (SELECT unnest([CASE WHEN in_train IN (0, 1) THEN CAST(in_train AS VARCHAR) END, 'all']) AS split) s WHERE k.kind IS NOT NULL AND s.split IS NOT NULL)
SELECT split, kind, count(*) AS names, round(avg(p), 9) AS precision, round(avg(p), 9) AS recall, round(CASE WHEN avg(p) > 0 THEN avg(p) ELSE 0 END, 9) AS f1 FROM z GROUP BY split, kind""")
def scores_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Average scores by kind and split where only an equal name counts."""
    hit = F.when(F.lower("gt") == F.lower("pred"), 1.0).otherwise(0.0)
    return metrics.averages(_scored(spark, folder).withColumn("precision", hit).withColumn("recall", hit)).select("split", "kind", "names", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


def _words(x: str) -> str:
    """SQL: words of a lower-case name; neighbouring single letters are one word."""
    t = rf"list_filter(regexp_split_to_array({x}, '[^\p{{L}}]+'), lambda w: w <> '')"
    joined = "array_to_string(list_transform(range(1, len(t.t) + 1), lambda i: CASE WHEN i = 1 OR (length(t.t[i]) = 1 AND length(t.t[i - 1]) = 1) THEN '' ELSE ' ' END || t.t[i]), '')"
    return f"(SELECT list_filter(string_split({joined}, ' '), lambda w: w <> '') FROM (SELECT {t} AS t) t)"


_NEAR = "x = y OR starts_with(x, y) OR starts_with(y, x) OR (length(x) > 1 AND length(y) > 1 AND x[1] = y[1] AND levenshtein(x, y) * 3 < greatest(length(x), length(y)))"
_SAME = "x = y OR (least(length(x), length(y)) >= 2 AND (starts_with(x, y) OR starts_with(y, x) OR ends_with(x, y) OR ends_with(y, x)))"


def _name_scores(match: str, source: str, keep: str) -> str:
    """SQL: keep columns with p and r, the scores of pred against gt in a source."""

    def share(a: str, b: str) -> str:
        return f"CASE WHEN g IS NULL OR q IS NULL THEN 0.0 WHEN g = q THEN 1.0 WHEN len(tg) = 0 OR len(tq) = 0 THEN 0.0 ELSE len(list_distinct(list_filter({a}, lambda x: len(list_filter({b}, lambda y: {match})) > 0))) / len({a}) END"

    cut = f"SELECT *, {_words('g')} AS tg, {_words('q')} AS tq FROM (SELECT *, lower(gt) AS g, lower(pred) AS q FROM {source})"
    return f"SELECT {keep}, {share('tq', 'tg')} AS p, {share('tg', 'tq')} AS r FROM ({cut})"


def _averages(match: str) -> str:
    return f"""{_SCORED_SQL}, y AS ({_name_scores(match, 'x', 'kind, in_train')}),
z AS (SELECT k.kind, s.split, p, r FROM y, LATERAL (SELECT unnest([y.kind, CASE WHEN y.kind <> 'fun' THEN 'params_vars' END, 'total']) AS kind) k, LATERAL (SELECT unnest([CASE WHEN in_train IN (0, 1) THEN CAST(in_train AS VARCHAR) END, 'all']) AS split) s WHERE k.kind IS NOT NULL AND s.split IS NOT NULL)
SELECT split, kind, count(*) AS names, round(avg(p), 9) AS precision, round(avg(r), 9) AS recall, round(CASE WHEN avg(p) + avg(r) > 0 THEN 2 * avg(p) * avg(r) / (avg(p) + avg(r)) ELSE 0 END, 9) AS f1 FROM z GROUP BY split, kind"""


def _averaged(rows: DataFrame) -> DataFrame:
    got = metrics.averages(rows.withColumn("precision", F.col("s.precision")).withColumn("recall", F.col("s.recall")))
    return got.select("split", "kind", "names", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query(_averages(_NEAR))
def scores_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Average scores by kind and split, token by token."""
    return _averaged(spread(_scored(spark, folder)).withColumn("s", similarity.score_names(F.col("gt"), F.col("pred"))))


@query(_averages(_SAME))
def scores_suffix(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the stricter token match: equal, or a prefix or suffix of two letters or more."""
    return _averaged(_scored(spark, folder).withColumn("s", similarity.score_names(F.col("gt"), F.col("pred"), match=similarity.same_token)))


def _letters(x: str) -> str:
    return f"list_transform(range(97, 123), lambda c: CAST(length({x}) - length(replace({x}, chr(CAST(c AS INTEGER)), '')) AS DOUBLE))"


def _letter_words(x: str) -> str:
    return f"regexp_extract_all(lower(trim({x}, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))), '[a-z]+')"


_LOWER_PAIRS = {c: _OUTPUT.replace("output", c).replace(_strip("split_part(p, ':', 1)"), f"lower({_strip("split_part(p, ':', 1)")})").replace(_strip("substr(p, strpos(p, ':') + 1)"), f"lower({_strip("substr(p, strpos(p, ':') + 1)")})") for c in ("predict", "output")}
_REWARD_ONE = f"""CASE WHEN p = g THEN 1.0 WHEN p = '-' OR g = '-' THEN 0.0 ELSE
  0.2 * (CASE WHEN greatest(length(p), length(g)) = 0 THEN 0.0 ELSE (greatest(length(p), length(g)) - levenshtein(regexp_replace(p, '[^\\x00-\\x7F]', chr(1), 'g'), g)) / greatest(length(p), length(g)) END)
  + 0.6 * (len(list_intersect({_letter_words('p')}, {_letter_words('g')})) / greatest(1, len(list_distinct({_letter_words('g')}))))
  + 0.2 * coalesce(CASE WHEN regexp_matches(p, '[a-z]') AND regexp_matches(g, '[a-z]') THEN list_cosine_similarity({_letters('p')}, {_letters('g')}) END, 0.0) END"""


@query(f"""WITH b AS (SELECT pred_id, {_LOWER_PAIRS['predict']} AS a, {_LOWER_PAIRS['output']} AS o FROM (SELECT p.pred_id, p.predict, t.output FROM predictions p JOIN test t USING (test_id))),
u AS (SELECT pred_id, {_last_wins('a')} AS a, {_last_wins('o')} AS o FROM b),
k AS (SELECT *, list_sort(list_transform(a, lambda e: split_part(e, chr(1), 1))) = list_sort(list_transform(o, lambda e: split_part(e, chr(1), 1))) AND len(o) > 0 AS same FROM u),
e AS (SELECT pred_id, a, unnest(o) AS y, len(o) AS n FROM k WHERE same),
v AS (SELECT pred_id, n, split_part(list_filter(a, lambda x: split_part(x, chr(1), 1) = split_part(y, chr(1), 1))[1], chr(1), 2) AS p, split_part(y, chr(1), 2) AS g FROM e),
w AS (SELECT pred_id, sum({_REWARD_ONE}) / any_value(n) AS reward FROM v GROUP BY pred_id)
SELECT b.pred_id, round(coalesce(w.reward, 0.0), 9) AS reward FROM b LEFT JOIN w USING (pred_id)""")
def reward_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "predictions").select("pred_id", "test_id", "predict").join(table(spark, folder, "test").select("test_id", "output"), "test_id")
    return rows.select("pred_id", F.round(similarity.hybrid_reward(pairs.parse(F.col("predict"), lower=True), pairs.parse(F.col("output"), lower=True), similarity.letter_cosine), 9).alias("reward"))


@query(r"""SELECT e.k AS placeholder, e.v AS name, count(*) AS rows FROM (SELECT unnest(list_transform(map_entries(vars_aligned), lambda m: {'k': m.key, 'v': m.value})) AS e FROM test)
WHERE regexp_replace(coalesce(e.v, ''), '^\s+|\s+$', '', 'g') <> '' AND NOT regexp_matches(e.v, '^(?:v\d+\b|a\d+\b|[_0-9]+\b)') AND e.v NOT IN ('i', 'j', 'k', 'ret') GROUP BY ALL""")
def interesting_names(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "test").select(F.explode("vars_aligned").alias("placeholder", "name"))
    return rows.where(names.interesting(F.col("name"))).groupBy("placeholder", "name").agg(F.count("*").alias("rows"))


@query(f"SELECT name, array_to_string({_words('name')}, ' ') AS words FROM (SELECT DISTINCT lower(unnest(map_values(funname_aligned))) AS name FROM test) WHERE name IS NOT NULL")
def name_words(spark: SparkSession, folder: str) -> DataFrame:
    """Words of the lower-case names."""
    rows = table(spark, folder, "test").select(F.explode(F.map_values("funname_aligned")).alias("n")).select(F.lower("n").alias("name")).distinct()
    return rows.where("name IS NOT NULL").select("name", F.array_join(names.words(F.col("name")), " ").alias("words"))


@query(rf"SELECT count(*) FILTER (regexp_matches(funname, '{names.COMPILER_PREFIX}') OR funname IN {names.COMPILER_MADE}) AS compiler, count(*) FILTER (regexp_matches(func_name, '^(sub_|FUN_)')) AS generated FROM functions, (SELECT NULL AS func_name) UNION ALL SELECT 0, count(*) FROM predictions WHERE regexp_matches(func_name, '^(sub_|FUN_)')")
def name_filters(spark: SparkSession, folder: str) -> DataFrame:
    made = table(spark, folder, "functions").agg(F.count_if(names.compiler_made(F.col("funname"))).alias("compiler"), F.lit(0).cast("long").alias("generated"))
    old = answers.legacy_names(table(spark, folder, "predictions")).agg(F.lit(0).cast("long").alias("compiler"), F.count("*").alias("generated"))
    return made.unionByName(old)


# ---- ranked answers -----------------------------------------------------------------------------------------------


@query()
def answers_read(spark: SparkSession, folder: str) -> DataFrame:
    """Every ranked answer with its entries in key order, raw texts read where they can be."""
    got = answers.ranked(table(spark, folder, "predictions"), "pred_id")
    return got.select("pred_id", "pos", "prob", pairs.text_of(pairs.from_map(F.col("answer")), "|").alias("answer"), "error")


@query("""SELECT pred_id, name, count(*) AS answers, max(prob) AS best FROM (SELECT pred_id, p.prob AS prob, unnest(map_keys(p.answer)) AS name FROM (SELECT pred_id, unnest(answer_and_probs) AS p FROM predictions) WHERE NOT map_contains(p.answer, 'Error')) GROUP BY pred_id, name""")
def answers_by_name(spark: SparkSession, folder: str) -> DataFrame:
    rows = answers.ranked(table(spark, folder, "predictions").withColumn("answer_and_probs", F.filter("answer_and_probs", lambda a: ~F.map_contains_key(a["answer"], "Error"))), "pred_id")
    return answers.by_name(rows, "pred_id").groupBy("pred_id", "name").agg(F.count("*").alias("answers"), F.max("prob").alias("best"))


@query("SELECT model_run, count(*) AS answers, count(*) FILTER (map_contains(a.answer, 'Error')) AS errors, round(count(*) FILTER (map_contains(a.answer, 'Error')) / count(*), 9) AS error_share FROM (SELECT model_run, unnest(answer_and_probs) AS a FROM predictions) GROUP BY model_run")
def answer_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of each run that could not be read as a map."""
    return answers.error_rates(table(spark, folder, "predictions"), "model_run").withColumn("error_share", F.round("error_share", 9))


def _ranked_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of every answer for each function and variable that counts; raw texts that could be read included."""
    records = table(spark, folder, "predictions")
    got = answers.by_name(answers.ranked(records, "pred_id"), "pred_id")
    truth = records.select("pred_id", F.explode(F.array("func_id_maps", "var_id_maps")).alias("_m")).select("pred_id", F.explode("_m").alias("name", "gt"))
    rows = answers.to_score(got, truth.distinct(), ["pred_id"])
    s = similarity.score_names(F.col("gt"), F.col("value"), match=similarity.same_token)
    return rows.select("pred_id", "name", "gt", "pos", "prob", "value", s["precision"].alias("precision"), s["recall"].alias("recall"))


@query()
def best_of_three(spark: SparkSession, folder: str) -> DataFrame:
    """Of the three likeliest answers for each name the one that the fold over both scores ends with."""
    return metrics.best_of(_ranked_scores(spark, folder), ["pred_id", "name", "gt"], "prob", "pos")


@query()
def first_answer(spark: SparkSession, folder: str) -> DataFrame:
    """The answer that stands first for each name, with its scores."""
    return answers.first(_ranked_scores(spark, folder), ["pred_id", "name", "gt"])


_READABLE = f"""
WITH a AS (SELECT pred_id, generate_subscripts(answer_and_probs, 1) - 1 AS pos, unnest(answer_and_probs) AS x FROM predictions),
e AS (SELECT pred_id, pos, x.prob AS prob, unnest(map_entries(x.answer)) AS m FROM a WHERE x.answer IS NOT NULL AND NOT map_contains(x.answer, 'Error')),
t AS (SELECT DISTINCT pred_id, m.key AS name, m.value AS gt FROM (SELECT pred_id, unnest(map_entries(func_id_maps)) AS m FROM predictions UNION ALL SELECT pred_id, unnest(map_entries(var_id_maps)) FROM predictions)),
s AS (SELECT e.pred_id, t.name, t.gt, e.pos, e.prob, e.m.value AS pred FROM e JOIN t ON e.pred_id = t.pred_id AND e.m.key = t.name
  WHERE gt <> name AND {_strip("gt")} <> '' AND NOT regexp_matches(gt, '^(?:v\\d+\\b|a\\d+\\b|[_0-9]+\\b)') AND gt NOT IN ('i', 'j', 'k', 'ret')),
c AS ({_name_scores(_SAME, 's', 'pred_id, name, gt, pos, prob, pred')})"""


def _readable(spark: SparkSession, folder: str) -> DataFrame:
    """As _ranked_scores, of the answers that are maps."""
    records = table(spark, folder, "predictions").withColumn("answer_and_probs", F.transform("answer_and_probs", lambda a: F.when(~F.map_contains_key(a["answer"], "Error"), a)))
    got = answers.by_name(answers.ranked(records, "pred_id"), "pred_id")
    truth = records.select("pred_id", F.explode(F.array("func_id_maps", "var_id_maps")).alias("_m")).select("pred_id", F.explode("_m").alias("name", "gt"))
    s = similarity.score_names(F.col("gt"), F.col("value"), match=similarity.same_token)
    return answers.to_score(got, truth.distinct(), ["pred_id"]).select("pred_id", "name", "gt", "pos", "prob", "value", s["precision"].alias("precision"), s["recall"].alias("recall"))


@query(f"{_READABLE} SELECT pred_id, name, gt, arg_min(pred, pos) AS value, round(arg_min(p, pos), 9) AS precision, round(arg_min(r, pos), 9) AS recall FROM c GROUP BY pred_id, name, gt")
def first_readable(spark: SparkSession, folder: str) -> DataFrame:
    """first_answer over the answers that need no recovery: what SQL can follow of it."""
    got = answers.first(_readable(spark, folder), ["pred_id", "name", "gt"])
    return got.select("pred_id", "name", "gt", "value", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query(f"""{_READABLE}, d AS (SELECT *, row_number() OVER (PARTITION BY pred_id, name, gt ORDER BY prob DESC NULLS LAST, pos) AS n FROM c),
w AS (SELECT pred_id, name, gt, list({{'v': pred, 'p': p, 'r': r}} ORDER BY n) AS l FROM d WHERE n <= 3 GROUP BY ALL),
f AS (SELECT pred_id, name, gt, list_reduce(l, lambda acc, x: CASE WHEN x.p >= acc.p AND x.r >= acc.r THEN x ELSE acc END) AS b FROM w)
SELECT pred_id, name, gt, b.v AS value, round(b.p, 9) AS precision, round(b.r, 9) AS recall FROM f""")
def best_readable(spark: SparkSession, folder: str) -> DataFrame:
    """best_of_three over the answers that need no recovery."""
    got = metrics.best_of(_readable(spark, folder), ["pred_id", "name", "gt"], "prob", "pos")
    return got.select("pred_id", "name", "gt", "value", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


# ---- curation -----------------------------------------------------------------------------------------------------


@query(rf"""SELECT CASE WHEN {_strip("coalesce(domain_summary, '')")} <> '' THEN 'completed' WHEN {_strip("coalesce(input, '')")} = '' THEN 'missing_prompt' ELSE 'pending' END AS status, count(*) AS rows FROM domain_records GROUP BY 1""")
def pending_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "domain_records").groupBy(curate.pending_status(F.col("domain_summary"), F.col("input")).alias("status")).agg(F.count("*").alias("rows"))


@query("SELECT func_id FROM functions WHERE func_id NOT IN (SELECT func_id FROM functions_norm)")
def resume_tasks(spark: SparkSession, folder: str) -> DataFrame:
    return curate.resume(table(spark, folder, "functions").select("func_id"), table(spark, folder, "functions_norm"), "func_id")


@query(rf"SELECT func_id FROM functions WHERE {_strip("coalesce(output, '')")} <> '' AND len(list_filter(regexp_split_to_array(coalesce(code, '') || output, '\s+'), lambda w: w <> '')) <= 120")
def clean_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of up to 120 words, so that some are too long; clean_records_production has the limit of the models."""
    return _cleaned(spark, folder, 120)


def _cleaned(spark: SparkSession, folder: str, most: int) -> DataFrame:
    return curate.clean(table(spark, folder, "functions").withColumn("code", F.coalesce("code", F.lit(""))), "code", "output", generate.words_count, most).select("func_id")


@query(SQL["clean_records"].replace("<= 120", "<= 16384"))
def clean_records_production(spark: SparkSession, folder: str) -> DataFrame:
    return _cleaned(spark, folder, 16384)


@query("SELECT count(*) AS total, count(*) FILTER (code IS NULL) AS no_code, count(*) FILTER (proj IS NULL) AS no_proj, count(*) FILTER (len(callees) = 0) AS no_callee FROM functions")
def run_counters(spark: SparkSession, folder: str) -> DataFrame:
    return curate.counters(table(spark, folder, "functions"), no_code=F.col("code").isNull(), no_proj=F.col("proj").isNull(), no_callee=F.size("callees") == 0)


@query(r"""SELECT count(*) AS records, sum(256) AS tokens, sum(least(n + m + 1, 256)) AS attended, sum(greatest(0, least(n + m + 1, 256) - n)) AS labelled FROM (SELECT len(list_filter(regexp_split_to_array(code, '\s+'), lambda w: w <> '')) AS n, len(list_filter(regexp_split_to_array(output, '\s+'), lambda w: w <> '')) AS m FROM functions WHERE code <> '' AND output <> '')""")
def sft_encode(spark: SparkSession, folder: str) -> DataFrame:
    """Totals over the encoded records, cut to 256 tokens, so that there is something to cut; sft_encode_production has the limit of the models."""
    return _encoded(spark, folder, 256)


def _encoded(spark: SparkSession, folder: str, most: int) -> DataFrame:
    got = generate.encode(table(spark, folder, "functions"), "code", "output", generate.word_ids, 0, most, cut=True)
    return got.agg(F.count("*").alias("records"), F.sum(F.size("input_ids")).alias("tokens"), F.sum(F.size(F.array_remove("attention_mask", 0))).alias("attended"), F.sum(F.size(F.array_remove("labels", -100))).alias("labelled"))


@query(SQL["sft_encode"].replace("256", "4096"))
def sft_encode_production(spark: SparkSession, folder: str) -> DataFrame:
    return _encoded(spark, folder, 4096)


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS rows FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    return incremental.counts(table(spark, folder, "events"), "ts", "1 day", ["event_type"])


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT l_orderkey, count(*) AS lines, round(sum(l_quantity), 6) AS quantity, max(l_shipdate) AS last_shipped FROM lineitem GROUP BY l_orderkey")
def order_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 6).alias("quantity"), F.max("l_shipdate").alias("last_shipped"))


@query("SELECT func_id, md5('42-' || func_id) AS place FROM functions")
def shuffled(spark: SparkSession, folder: str) -> DataFrame:
    """All records in a random order that a seed fixes: by range of a digest, so no task takes in more than its share."""
    return table(spark, folder, "functions").select("func_id", F.md5(F.concat(F.lit("42-"), F.col("func_id").cast("string"))).alias("place")).orderBy("place", "func_id")
