"""Registered queries over small tables made here."""

import random
from hashlib import md5

from pyspark.sql import functions as F

from nameforge.functions import similarity
from nameforge.functions.similarity import lcs
from nameforge.plans import prompts
from nameforge.plans.catalogue import QUERIES

INDEX = "struct<arg_count int, return_type string, loc int, full_loc int>"


def _norm_rows():
    rng = random.Random(5)
    bases = ["".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(3)]
    rows = []
    for i in range(40):
        t = list(bases[i % 3])
        for _ in range(rng.randrange(5)):
            t[rng.randrange(len(t))] = "z"
        rows.append((i, " ".join(["".join(t), ";", str(rng.choice([7, 8])), ";"]), (1, "int", rng.choice([10, 9, 5]), 12)))
    # Tied in the text, apart in the numbers: the placeholder <hex> hides what they are.
    rows += [(50, "f(){ x = 0x10; y = 3; }", (2, "int", 5, 5)), (51, "f(){ x = 0x10; y = 4; }", (2, "int", 5, 5)), (52, "f(){ x = 0x11; y = 4; }", (2, "int", 5, 5))]
    return rows + [(60, None, (1, "int", 10, 12)), (61, "", (1, "int", 10, 12)), (62, "f", None), (63, "f", (1, "int", 1, 12))]


def _expected(rows):
    import re

    def text(c):
        return None if c is None else re.sub(r"\s+", "", re.sub(r"\b0[xX][0-9a-fA-F]+\b", "<hex>", c)).lower()

    def constants(c):
        return {int(x, 0) for x in re.findall(r"(?<![\w.])(?:0x[0-9a-f]+|[0-9]+)(?![\w.])", c)}

    def ratio(a, b):
        return 200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0

    def close(a, b):
        return abs(a - b) / max(a, b, 1) <= 0.3

    want = {}
    for i, c, x in rows:
        if x is None or x[2] == 1:
            want[i] = ("missing_index" if x is None else "short_loc", None, None, 0)
            continue
        got = [(ratio(text(c), text(d)), j, d) for j, d, y in rows if j != i and d and y and y[:2] == x[:2] and close(x[2], y[2]) and close(x[3], y[3]) and c is not None]
        best = max((s for s, *_ in got), default=None)
        top = [(j, d) for s, j, d in got if s == best]
        win = None
        if best is not None and best > 90:
            if len(top) == 1:
                win = top[0][0]
            elif constants(c):
                by = [(len(constants(c) & constants(d)) / len(constants(c) | constants(d)), j) for j, d in top]
                most = [j for s, j in by if s == max(by)[0]]
                win = most[0] if len(most) == 1 else None
        status = "no_match" if best is None or best <= 90 else "ambiguous" if win is None else "matched"
        want[i] = (status, win, best if best is not None and best > 90 else None, len(got))
    return want


def test_retrieval_query_scores_code_and_breaks_ties_by_numbers(spark, tmp_path):
    rows = _norm_rows()
    spark.createDataFrame(rows, f"func_id long, norm_code string, index {INDEX}").write.parquet(str(tmp_path / "functions_norm.parquet"))
    got = QUERIES["retrieve_similar"](spark, str(tmp_path)).collect()
    want = _expected(rows)
    assert {r["id"]: (r["status"], r["match_id"], r["best"], r["sized"]) for r in got} == want
    methods = {r["method"] for r in got}
    assert {"similarity", "numeric_constant_jaccard", "unresolved_numeric_constant_jaccard"} <= methods
    counts = {r["status"]: r["rows"] for r in QUERIES["retrieval_counts"](spark, str(tmp_path)).collect()}
    assert counts == {s: sum(w[0] == s for w in want.values()) for s in counts}


def test_texts_side_by_side_score_as_single_ones(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcé𝒳 ") for _ in range(rng.randrange(30))) for _ in range(60)] + ["", "a" * 8, "a" * 16]
    rows = [(rng.choice(texts), rng.choice(texts)) for _ in range(400)] + [(None, "a"), ("a", None)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", similarity.indel_ratio("a", F.col("b")).alias("s")).collect()
    for a, b, s in got:
        assert s == (None if a is None or b is None else 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b)))
    assert similarity.lcs_many(texts, "abécab", most=50) == [lcs(t, "abécab") for t in texts]


FUNCTIONS = "func_id long, proj string, bin string, funname string, code string, callees array<string>, params_aligned map<string,string>, vars_aligned map<string,string>, output string"


def test_prompt_queries_cut_at_the_limit_of_the_models(spark, tmp_path):
    at, limit = str(tmp_path), prompts.MOST_CHARS
    strings = ["\n".join(f"line {k}" for k in range(n)) for n in (300, 40_000)]
    evidence = "struct<project_name string, file_output string, ldd_output string, strings_truncated string>"
    spark.createDataFrame([(i, ("p", "ELF", "libc", x)) for i, x in enumerate(strings)], f"rec_id int, analysis {evidence}").write.parquet(f"{at}/domain_records.parquet")
    codes = ["f()\n{\n" + "x = 1;\n" * n + "}" for n in (500, 1, 50_000)]
    spark.createDataFrame([(i, "p", "b", "f", c, [], {}, {}, "f:run") for i, c in enumerate(codes)], FUNCTIONS).write.parquet(f"{at}/functions.parquet")
    texts = ["a\n" * 5_000, "b\n" * 200_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").write.parquet(f"{at}/documents.parquet")

    whole, cut = (r["prompt"] for r in QUERIES["prompt_domain"](spark, at).orderBy("rec_id").collect())
    assert strings[0] in whole and prompts.STRINGS_MARK not in whole
    assert prompts.STRINGS_MARK in cut and limit - 20 < len(cut) <= limit
    chars = [r["chars"] for r in QUERIES["prompt_identifiers"](spark, at).orderBy("func_id").collect()]
    assert chars[0] - chars[1] == len(codes[0]) - len(codes[1]) and chars[2] == limit
    digests = [r["digest"] for r in QUERIES["prompt_cut_production"](spark, at).orderBy("doc_id").collect()]
    assert digests[0] == md5(f"<STRINGS_OUTPUT>{texts[0]}</STRINGS_OUTPUT>".encode()).hexdigest()
    assert digests[1] != md5(f"<STRINGS_OUTPUT>{texts[1]}</STRINGS_OUTPUT>".encode()).hexdigest()
    assert [r[0] for r in QUERIES["clean_records_production"](spark, at).orderBy("func_id").collect()] == [0, 1]
    n = [len(c.split()) for c in codes]
    got = QUERIES["sft_encode_production"](spark, at).first()
    assert (got["records"], got["tokens"], got["attended"], got["labelled"]) == (3, 3 * 4096, n[0] + n[1] + 4 + 4096, 4)
    small = spark.createDataFrame([("<STRINGS_OUTPUT>" + "ab\n" * 100 + "</STRINGS_OUTPUT>",)], "t string").select(prompts.cut_domain(F.col("t"), 120)).first()[0]
    assert len(small) <= 120 and prompts.STRINGS_MARK in small and small.endswith("</STRINGS_OUTPUT>")


def test_rounds_are_fed_by_retrieval_and_summaries(spark, tmp_path):
    at, index = str(tmp_path), (1, "int", 5, 5)
    rows = [(i, "p", b, n, c, [], {}, {}, f"{n}:run") for i, b, n, c in ((1, "b", "f", "f(){}"), (2, "b", "g", "g(){}"), (3, "c", "h", "h(){}"), (4, "b", "k", "k(){}"))]
    spark.createDataFrame(rows, FUNCTIONS).write.parquet(f"{at}/functions.parquet")
    text = "open(path); read(path, size); close(path);"
    norm = [(1, text + "a", index), (2, text + "b", index), (3, "something else", (2, "int", 5, 5))]
    spark.createDataFrame(norm, f"func_id long, norm_code string, index {INDEX}").write.parquet(f"{at}/functions_norm.parquet")
    sums = [("p", "b", " reads files "), ("p", "c", "x"), ("p", "c", "y")]
    spark.createDataFrame(sums, "proj string, bin string, domain_summary string").write.parquet(f"{at}/domain_records.parquet")

    def known(similar, code, name):
        return f"<unstripped_code>\n{similar}\n</unstripped_code>\n<code>\n{code}\n</code>\npredict the original names of {name}."

    def context(summary, code, name):
        return f"\n<SUMMARY>\n{summary}\n</SUMMARY>\n<CallSites>\n\n</CallSites>\n<Callees>\n\n</Callees>\n<code>\n{code}\n</code>\npredict the original names of {name}.\n    "

    want = {1: known(text + "b", "f(){}", "f"), 2: known(text + "a", "g(){}", "g"), 3: context("", "h(){}", "h"), 4: context("reads files", "k(){}", "k")}
    got = {r["ord"]: r["prompt_digest"] for r in QUERIES["context_rounds"](spark, at).collect()}
    assert got == {i: md5(x.encode()).hexdigest() for i, x in want.items()}


def test_calls_are_found_in_the_codes_of_callers(spark, tmp_path):
    at = str(tmp_path)
    rows = [
        (1, "b", "g", "int g(a)\n{ return 0; }", []),
        (2, "b", "f", "f() { g(1); x.g(2); g(h(3)); }", ["g:g()", "g:g()"]),
        (3, "b", "k", "k() { g(1); g(4); }", [" g :g()"]),
        (4, "b", "r", "r(n) { r(n - 1); }", ["r:r()"]),
        (5, "c", "m", "m() { g(9); }", ["g:g()"]),
        (6, "b", "n", None, ["g:g()"]),
    ]
    spark.createDataFrame([(i, "p", b, n, c, e, {}, {}, None) for i, b, n, c, e in rows], FUNCTIONS).write.parquet(f"{at}/functions.parquet")
    got = {r["func_id"]: r["calls"] for r in QUERIES["caller_calls"](spark, at).collect()}
    assert got == {1: "g(1)\ng(h(3))\ng(4)", 2: "", 3: "", 4: "r(n)\nr(n - 1)", 5: "", 6: ""}


def test_words_of_names_with_neighbouring_single_letters(spark, tmp_path):
    names = ["a_b_tree", "x_y", "Read_File", "a_bc_d", None]
    spark.createDataFrame([({"s": n},) for n in names], "funname_aligned map<string,string>").write.parquet(f"{tmp_path}/test.parquet")
    got = {r["name"]: r["words"] for r in QUERIES["name_words"](spark, str(tmp_path)).collect()}
    assert got == {"a_b_tree": "ab tree", "x_y": "xy", "read_file": "read file", "a_bc_d": "a bc d"}
