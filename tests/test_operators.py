"""Core operators against small brute-force versions."""

import json
import random
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nameforge.functions.similarity import lcs
from nameforge.operators import align, answers, curate, dedup, metrics, propagate, retrieve, skew
from nameforge.plans import generate, prompts, summaries
from nameforge.sources import records, sinks
from nameforge.streaming import incremental

ROWS = "rec_id long, name string, loc int, proj string, bin string"


def _skewed(n=600):
    rng = random.Random(3)
    return [(i, None if rng.random() < 0.05 else "hot" if rng.random() < 0.5 else f"n{rng.randrange(20)}", None if rng.random() < 0.1 else rng.randrange(30), rng.choice(["p", "q", None]), rng.choice(["b", "c", None])) for i in range(n)]


def test_skew_against_brute_force(spark):
    rows = _skewed()
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    got = {r["name"]: (r["rows"], r["median"]) for r in skew.medians(df, "name", "loc", "rec_id").collect()}
    kinds = {r["name"]: r["distinct"] for r in skew.distincts(df, "name", ["proj", "bin"], "rec_id").collect()}
    by = defaultdict(list)
    for r in rows:
        if r[1] is not None:
            by[r[1]].append(r)
    assert set(got) == set(by) == set(kinds)
    for k, v in by.items():
        locs = sorted(x[2] for x in v if x[2] is not None)
        mid = (locs[(len(locs) - 1) // 2] + locs[len(locs) // 2]) / 2 if locs else None
        assert got[k] == (len(v), mid)
        assert kinds[k] == len({(x[3], x[4]) for x in v})


def test_skew_edges(spark):
    empty = spark.createDataFrame([], ROWS)
    assert skew.medians(empty, "name", "loc", "rec_id").count() == 0
    assert skew.distincts(empty, "name", ["proj"], "rec_id").count() == 0
    same = spark.createDataFrame([(i, "k", None, None, None) for i in range(50)], ROWS)
    assert [tuple(r) for r in skew.medians(same, "name", "loc", "rec_id").collect()] == [("k", 50, None)]
    assert skew.distincts(same, "name", ["proj", "bin"], "rec_id").first()["distinct"] == 1


def test_skew_ignores_other_columns_named_like_its_own(spark):
    df = spark.createDataFrame(_skewed(80), ROWS).withColumn("pid", F.lit("x")).withColumn("rows", F.lit(1)).withColumn("median", F.lit(2))
    assert skew.medians(df, "name", "loc", "rec_id").agg(F.sum("rows")).first()[0] == sum(r[1] is not None for r in _skewed(80))


def test_greedy_keeps_the_first(spark):
    rng = random.Random(1)
    base = "".join(rng.choice("abcdefgh") for _ in range(60))
    rows = []
    for i in range(80):
        t = list(base if i % 2 else base[::-1])
        for _ in range(rng.randrange(8)):
            t[rng.randrange(len(t))] = "z"
        rows.append((i, {"s": rng.choice(["f", "g", "main"])}, "".join(t), (rng.choice([1, 2]), " Int", rng.choice([10, 7, 6]))))
    rows += [(100, {}, "abc", None), (101, {"s": "f"}, None, None), (102, None, "x", None)]
    df = spark.createDataFrame(rows, "id long, funname_aligned map<string,string>, norm_code string, index struct<arg_count int, return_type string, loc int>")
    got = sorted(r[0] for r in dedup.greedy(df.repartition(7), "id").collect())
    seen, want = defaultdict(list), []
    for i, m, t, ix in rows:
        if not m or not t:
            continue
        n = m["s"]
        key = (n, ix[0])
        if n != "main":
            if any(abs(ix[2] - l) / max(ix[2], l, 1) <= 0.3 and round(200 * lcs(t, u) / (len(t) + len(u))) >= 90 for l, u in seen[key]):
                continue
            seen[key].append((ix[2], t))
        want.append(i)
    assert got == want


def test_last_wins_and_status(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, None, "z")], "ord long, k string, v string")
    assert {r["k"]: r["v"] for r in dedup.last_wins(df, ["k"], "ord").collect()} == {"a": "y", None: "z"}
    got = {r["v"]: r["rows"] for r in dedup.status_counts(df, "v", ["x", "q"]).collect()}
    assert got == {"x": 1, "q": 0}


INDEX = "struct<arg_count int, return_type string, loc int, full_loc int>"


def _retrieved(targets, candidates, not_self):
    """Every diagnostic by comparing all pairs; a score that is not over 90 is not told."""

    def close(a, b):
        return 10 * abs(a - b) <= 3 * max(a, b)

    out = {}
    for i, x, a, _, n in targets:
        if x is None or None in x:
            out[i] = ("missing_index", None, None, None, 0, 0, 0, None, None, None, 0)
            continue
        if x[2] == 1:
            out[i] = ("short_loc", None, None, None, 0, 0, 0, None, None, None, 0)
            continue
        near = [(j, b, m) for j, y, b, s, m in candidates if a is not None and b is not None and s and y is not None and None not in y and x[:2] == y[:2] and close(x[2], y[2]) and close(x[3], y[3]) and not (not_self and i == j)]
        hits = sorted(((100.0 if not a + b else 200 * lcs(a, b) / (len(a) + len(b)), j, m) for j, b, m in near), reverse=True)
        hits = [h for h in hits if h[0] > 90]
        if not hits:
            out[i] = ("no_match", None, None, None, 0, len(near), 0, None, None, None, 0)
            continue
        top = [h for h in hits if h[0] == hits[0][0]]
        second = hits[1][0] if len(hits) > 1 else None
        j1 = j2 = None
        if len(top) == 1:
            status, win, method, tied = "matched", top[0][1], "similarity", 0
        elif not n or any(m is None for *_, m in top):
            status, win, method, tied = "ambiguous", None, "numeric_constant_jaccard_unavailable", len(top)
        else:
            shares = sorted((len(set(n) & set(m)) / len(set(n) | set(m)) for *_, m in top), reverse=True)
            j1, j2 = shares[:2]
            tied = shares.count(j1)
            best = [j for _, j, m in top if len(set(n) & set(m)) / len(set(n) | set(m)) == j1]
            status, win, method = ("matched", best[0], "numeric_constant_jaccard") if tied == 1 else ("ambiguous", None, "unresolved_numeric_constant_jaccard")
        out[i] = (status, win, hits[0][0], second, len(hits), len(near), len(top), method, j1, j2, tied)
    return out


@pytest.mark.parametrize(("not_self", "cap"), [(True, 4000), (True, 9), (False, 4000)])
def test_retrieval_diagnostics(spark, not_self, cap):
    rng = random.Random(21)
    base = ["".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(5)]

    def rows(n, start):
        out = []
        for i in range(start, start + n):
            t = list(rng.choice(base))
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                t[rng.randrange(4)] = "z"
            index = rng.choice([None, (1, "int", 1, 4), (1, None, 9, 9)] + [(rng.choice([1, 2]), "int", rng.choice([0, 5, 6, 10, 13]), rng.choice([10, 12, 30]))] * 9)
            out.append((i, index, rng.choice(["".join(t)] * 9 + [None, ""]), rng.choice(["s"] * 9 + ["", None]), rng.choice([["1"], ["1", "2"], ["2", "3"], ["1", "3", "4"], ["5", "1"]] * 2 + [[], None])))
        return out

    t = rows(110, 1)
    c = t if not_self else rows(60, 40)
    schema = f"id long, index {INDEX}, text string, src string, numbers array<string>"
    frames = [spark.createDataFrame(x, schema).repartition(3) for x in (t, c)]
    got = retrieve.retrieve(*frames, "text", "src", "numbers", not_self=not_self, cap=cap).collect()
    want = _retrieved(t, c, not_self)
    fields = ["status", "best_score", "second_best_score", "qualified_candidate_count", "size_filtered_candidate_count", "top_similarity_candidate_count", "selection_method", "best_numeric_constant_jaccard", "second_best_numeric_constant_jaccard", "top_jaccard_candidate_count"]
    assert len(got) == len(t)
    for r in got:
        x = r["retrieval"]
        assert (x["status"], r["match"]["id"] if r["match"] else None, *(x[f] for f in fields[1:])) == want[r["id"]], (r["id"], want[r["id"]])
    kinds = {(w[0], w[7]) for w in want.values()}
    assert {("matched", "similarity"), ("matched", "numeric_constant_jaccard"), ("ambiguous", "unresolved_numeric_constant_jaccard"), ("ambiguous", "numeric_constant_jaccard_unavailable"), ("no_match", None)} <= kinds


def test_alignment(spark):
    v = [("v1", -8, -8, 0), ("v2", 4, 4, 8), ("v3", 40, 40, 48)]
    d = [("n", "t", "fp-24", -24, -16), ("m", "t", "fp-16", -16, 32), ("k", "t", None, None, None)]
    df = spark.createDataFrame([(v, d)], "v array<struct<variable string, rbp_offset_int long, stack_start long, stack_end long>>, d array<struct<name string, type string, location string, stack_start long, stack_end long>>")
    got = [tuple(e) for e in df.select(align.align_variables(F.col("v"), F.col("d"))).first()[0]]
    assert got == [("v1", "n"), ("v2", "-"), ("v3", "-")]
    assert [(e["k"], e["v"]) for e in df.select(align.clusters(F.col("v"), F.col("d"))).first()[0]] == [("t", ["v2", "v3"])]
    zipped = spark.createDataFrame([(["a", None, "a"], ["x", "y", "z", "w"])], "a array<string>, b array<string>").select(align.zip_names(F.col("a"), F.col("b"))).first()[0]
    assert [tuple(e) for e in zipped] == [("a", "x"), ("null", "y"), ("a", "z")]


def test_propagation(spark):
    rows = [
        (1, "b", "f", "f(a) {\n x = g(a1, 2);\n}", ["g:g(x)", "h:h()", "g:g(y)"], ["a1"], "g:run, a1:len"),
        (2, "b", "g", "g(a1)", [], ["a1"], "g:first, a1:old"),
        (3, "b", "g", "g(a1)", ["f:f()"], ["a1"], "g:last, a1:new"),
        (4, "c", "h", "h()", ["g:g()"], [], " "),
    ]
    df = spark.createDataFrame(rows, "ord long, bin string, funname string, code string, callees array<string>, params array<string>, predict string")
    callees = {r["ord"]: r["predict_callees"] for r in propagate.callee_context(df, "ord", "predict", params="params").collect()}
    assert callees == {1: ["g:last(new)"], 2: [], 3: ["f:f(len)"], 4: []}
    sites = {r["ord"]: r["predict_callsites"] for r in propagate.callsite_context(df, "ord", "predict").collect()}
    assert sites == {1: [], 2: [], 3: ["run(len, 2)"], 4: []}


def test_rounds(spark):
    rows = [(1, "b", "f", "f() { g(); }", ["g:g()"], ["a1"], ["v1"], "a1:x", "s", None), (2, "b", "g", "g()", [], [], [], "g:y", "s", "known code"), (3, "b", "h", "h()", [], [], [], " ", "s", None)]
    df = spark.createDataFrame(rows, "ord long, bin string, funname string, code string, callees array<string>, params array<string>, variables array<string>, output string, summary string, similar string")
    got = {r["ord"]: r for r in generate.rounds(df, 2).collect()}
    assert set(got) == {1, 2}
    assert got[1]["predict"] == "a1:name_0, v1:name_1, f:name_2, g:name_3"
    assert got[1]["predict_callees"] == ["g:name_0()"]
    assert "<unstripped_code>\nknown code" in got[2]["input"]
    assert generate.rounds(df, 0).where("predict IS NULL").count() == 1


def test_prompts(spark):
    df = spark.createDataFrame([(1,)], "x int")
    p = df.select(prompts.context_prompt(F.lit("<SUMMARY>s</SUMMARY>"), F.array(F.lit("f(1)")), F.array(F.lit("g:r()")), F.lit("code"), F.lit("a1, f"))).first()[0]
    assert p == "\n<SUMMARY>\ns\n</SUMMARY>\n<CallSites>\nf(1)\n</CallSites>\n<Callees>\ng:r()\n</Callees>\n<code>\ncode\n</code>\npredict the original names of a1, f.\n    "
    assert df.select(prompts.forced_prefix(F.lit("p"), F.lit("a1:x"))).first()[0] == "pa1:"
    d = df.select(prompts.domain_prompt(F.lit(" p "), F.lit("ELF"), F.lit(""), F.lit(None).cast("string"))).first()[0]
    assert d["no_libraries"] and d["no_strings"] and prompts.NO_STRINGS in d["prompt"]


def test_metrics(spark):
    rows = [("fun", 1, 1.0, 0.5), ("param", 1, 0.0, 0.0), ("var", 0, 1.0, 1.0), ("var", None, 0.0, 1.0)]
    got = {(r["split"], r["kind"]): (r["names"], r["precision"], r["recall"]) for r in metrics.averages(spark.createDataFrame(rows, "kind string, in_train int, precision double, recall double")).collect()}
    assert got["all", "total"] == (4, 0.5, 0.625)
    assert got["1", "total"] == (2, 0.5, 0.25)
    assert got["all", "params_vars"] == (3, pytest.approx(1 / 3), pytest.approx(2 / 3))
    assert ("0", "fun") not in got
    best = spark.createDataFrame([(1, 0, 0.9, 0.5, 0.5, "a"), (1, 1, 0.8, 0.6, 0.4, "b"), (1, 2, 0.7, 0.5, 0.9, "c"), (1, 3, 0.1, 1.0, 1.0, "d")], "k int, pos int, prob double, precision double, recall double, v string")
    assert metrics.best_of(best, ["k"], "prob", "pos").first()["v"] == "c"


def test_answers(spark):
    texts = ["{'a1': 'x', 'v2': 'y'}", "so: {'a1': 'x', 'v2': 'y', bad", "{bad, 'a1': 'x'}", "nothing"]
    df = spark.createDataFrame([(i, [({"Error": t}, 0.5), ({"k": "v"}, 0.1)]) for i, t in enumerate(texts)], "id int, answer_and_probs array<struct<answer map<string,string>, prob double>>")
    rows = {(r["id"], r["pos"]): r for r in answers.ranked(df, "id").collect()}
    assert rows[0, 0]["answer"] == {"a1": "x", "v2": "y"}
    assert rows[1, 0]["answer"] == {"a1": "x", "v2": "y"}
    assert rows[2, 0]["answer"] == {"a1": "x"}
    assert rows[3, 0]["answer"] is None and rows[3, 0]["error"] == "nothing"
    good, bad = answers.with_errors(answers.ranked(df, "id"))
    assert (good.count(), bad.count()) == (7, 1)


def test_curation(spark):
    side = spark.createDataFrame([("p", "b", "s"), ("p", "b", " s "), ("p", "c", "x"), ("p", "c", "y"), ("p", "d", " ")], "proj string, bin string, sum string")
    df = spark.createDataFrame([("p", x) for x in "bcde"] + [(None, "b")], "proj string, bin string")
    got = {(r["proj"], r["bin"]): (r["sum"], r["lookup_status"]) for r in curate.lookup_join(df, side, ["proj", "bin"], "sum").collect()}
    assert got == {("p", "b"): ("s", "found"), ("p", "c"): (None, "conflict"), ("p", "d"): (None, "missing"), ("p", "e"): (None, "missing"), (None, "b"): (None, "missing")}
    tasks = spark.createDataFrame([(1,), (2,)], "id int")
    assert [r[0] for r in curate.resume(tasks, tasks.where("id = 1"), "id").collect()] == [2]


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, [{"x": 2}, 3], 4]')
    (tmp_path / "b.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    (tmp_path / "c.json").write_text('{\n "x": 7\n}')
    (tmp_path / "bad.jsonl").write_text('{"x": 1}\nnot json\n')
    assert [records.detect(spark, str(tmp_path / f)) for f in ("a.json", "b.jsonl", "c.json")] == ["json", "jsonl", "json"]
    assert sorted(r["x"] for r in records.read_any(spark, str(tmp_path / "a.json"), "x int").collect()) == [1, 2]
    assert sorted(r["x"] for r in records.read_any(spark, str(tmp_path / "b.jsonl"), "x int").collect()) == [1, 2]
    assert [r["x"] for r in records.read_any(spark, str(tmp_path / "c.json"), "x int").collect()] == [7]
    assert [r["x"] for r in records.read_array(spark, str(tmp_path / "c.json"), "x int").collect()] == [7]
    loose = records.read_lines(spark, str(tmp_path / "bad.jsonl"), "x int", strict=False).cache()
    assert loose.where("_corrupt_record IS NOT NULL").count() == 1
    with pytest.raises(Exception, match="FAILFAST|MALFORMED"):
        records.read_lines(spark, str(tmp_path / "bad.jsonl"), "x int").collect()
    with pytest.raises(Exception, match="line 2"):
        records.read_any(spark, str(tmp_path / "bad.jsonl"), "x int").collect()
    with open(tmp_path / "a.json") as f:
        assert list(records.iter_array(f, 3)) == [{"x": 1}, [{"x": 2}, 3], 4]
    for broken in ("{}", "[1 2]", "[1,"):
        (tmp_path / "x.json").write_text(broken)
        with open(tmp_path / "x.json") as f, pytest.raises(ValueError):
            list(records.iter_array(f, 2))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "é", None), (1, "a", 3)], "ord long, t string, n int")
    assert sinks.export_file(df, str(tmp_path / "o" / "x.json"), "ord") == 2
    assert json.loads((tmp_path / "o" / "x.json").read_text()) == [{"ord": 1, "t": "a", "n": 3}, {"ord": 2, "t": "é"}]
    sinks.export_file(df, str(tmp_path / "x.jsonl"), "ord")
    assert len((tmp_path / "x.jsonl").read_text().splitlines()) == 2
    with pytest.raises(ValueError):
        sinks.write(df, str(tmp_path / "y"), "xml")


def test_encode(spark):
    df = spark.createDataFrame([("a b", "c"), ("a b c d e f", "g"), ("", "x")], "x string, y string")
    rows = generate.encode(df, "x", "y", generate.word_ids, 9, 6).collect()
    assert len(rows) == 1
    assert rows[0]["labels"][:2] == [-100, -100] and rows[0]["labels"][3:] == [9, -100, -100] and rows[0]["attention_mask"] == [1, 1, 1, 1, 0, 0]
    assert generate.encode(df, "x", "y", generate.word_ids, 9, 6, cut=True).count() == 2


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    df = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 00:10:00"), (3, "b", "2024-01-01 00:20:00")], "id long, k string, t string").withColumn("t", F.to_timestamp("t"))
    df.coalesce(1).write.parquet(str(src))
    stream = incremental.first_seen(incremental.read(spark, str(src), df.schema), ["k"], "t")
    incremental.run(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    df.limit(1).withColumn("id", F.lit(9).cast("long")).write.mode("append").parquet(str(src))
    incremental.run(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_sources_by_suffix_and_clusters(spark, tmp_path):
    at = str(tmp_path)
    for name, body in (("a.json", '[{"x": 1}, {"x": 2}]'), ("b.jsonl", '{"x": 3}\n{"x": 4}\n'), ("c.result", '[{"x": 5}]'), ("d.txt", "x")):
        (tmp_path / name).write_text(body)
    got = {n: sorted(r["x"] for r in records.read_by_suffix(spark, f"{at}/{n}", "x int").collect()) for n in ("a.json", "b.jsonl", "c.result", "d.txt")}
    assert got == {"a.json": [1, 2], "b.jsonl": [3, 4], "c.result": [5], "d.txt": []}
    assert sorted(r["x"] for r in records.read_list(spark, f"{at}/a.json", "x int").collect()) == [1, 2]
    (tmp_path / "one.json").write_text('{"x": 1}')
    with pytest.raises(ValueError):
        records.read_list(spark, f"{at}/one.json", "x int")
    (tmp_path / "w.json").write_text('{"len": [1, 2], "size": [2]}')
    assert records.read_clusters(spark, f"{at}/w.json") == {"len": [1, 2], "size": [2]}
    with pytest.raises(ValueError):
        records.read_clusters(spark, f"{at}/w.json", most=1)


def test_batches_go_on_where_they_stopped(spark, tmp_path):
    df = spark.range(50).select("id", (F.col("id") * 2).alias("v"))
    path = f"{tmp_path}/out"
    assert sinks.write_in_batches(df, path, "id", 4) == 4
    import shutil

    shutil.rmtree(f"{path}/batch=2")
    assert sinks.write_in_batches(df, path, "id", 4) == 1
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [2 * i for i in range(50)]


def test_main_and_error_outputs(spark, tmp_path):
    df = spark.createDataFrame([(1, [({"Error": "nothing"}, 0.5), ({"k": "v"}, 0.1)])], "id int, answer_and_probs array<struct<answer map<string,string>, prob double>>")
    good, bad = answers.with_errors(answers.ranked(df, "id"))
    sinks.write_with_errors(good, bad, f"{tmp_path}/o")
    assert spark.read.json(f"{tmp_path}/o").count() == 1 and spark.read.json(f"{tmp_path}/o.dbg").first()["error"] == "nothing"


def test_skip_rules_and_first_answers(spark):
    got = spark.createDataFrame([(1, "v1", 0, 0.1, "a"), (1, "v1", 1, 0.9, "b"), (1, "v2", 0, 0.5, "c"), (1, "v3", 0, 0.5, "d")], "id int, name string, pos int, prob double, value string")
    truth = spark.createDataFrame([(1, "v1", "size"), (1, "v2", "v2"), (1, "v3", "i"), (1, "v4", "len")], "id int, name string, gt string")
    rows = answers.to_score(got, truth, ["id"])
    assert sorted((r["name"], r["value"]) for r in rows.collect()) == [("v1", "a"), ("v1", "b")]
    assert [(r["name"], r["value"]) for r in answers.first(rows, ["id", "name"]).collect()] == [("v1", "a")]


def test_settings_and_dry_run(spark):
    for bad in ({"batch": 0}, {"most_input": "9"}, {"loops": -1}, {"loops": True}, {"memory_share": 0.0}, {"memory_share": 1.5}):
        with pytest.raises(ValueError):
            generate.Settings(**bad)
    rows = [(1, "f", "f()", [], [], [], "f:x", "known code"), (2, "g", "g()", [], [], [], "g:y", None), (3, "h", "h()", [], [], [], " ", "k"), (4, "k", "k()", [], [], [], "k:z " * 30, None)]
    df = spark.createDataFrame(rows, "ord long, funname string, code string, callees array<string>, params array<string>, variables array<string>, output string, similar string")
    got = generate.dry_run(df, generate.Settings(loops=2, batch=1, most_input=20)).first().asDict()
    assert got == {"records": 4, "known": 2, "too_long": 1, "no_label": 1, "anchor_batches": 1, "batches_a_round": 2, "loops": 2}


def test_models_are_made_once_a_worker(spark, tmp_path):
    log = str(tmp_path / "made")

    def make():
        with open(log, "a") as f:
            f.write("x")
        return lambda asked: [p.upper() for p in asked]

    df = spark.range(40).select("id", F.concat(F.lit("p"), "id").alias("prompt"))
    for _ in range(2):
        assert {r["answer"] for r in generate.generate(df.repartition(8), "prompt", "answer", make).collect()} == {f"P{i}" for i in range(40)}
    assert len(open(log).read()) <= 8


def test_summary_stages(spark):
    evidence = "struct<project_name string, file_output string, ldd_output string, strings_truncated string>"
    programs = spark.createDataFrame([("p", "a", ("p", "ELF", "libc", "hello"), None), ("p", "b", ("p", "ELF", "", ""), " done "), ("p", "c", None, None)], f"proj string, bin string, analysis {evidence}, domain_summary string")
    made = summaries.domain_summaries(programs, lambda: lambda asked: [f" about {len(p)} " for p in asked])
    got = {r["bin"]: r for r in made.collect()}
    assert [got[k]["status"] for k in "abc"] == ["pending", "completed", "missing_prompt"]
    assert got["a"]["domain_summary"] == f"about {len(got['a']['input'])}" and got["b"]["domain_summary"] == " done " and got["c"]["domain_summary"] is None
    again = {r["bin"]: r["domain_summary"] for r in summaries.domain_summaries(programs, lambda: lambda asked: ["new" for _ in asked], overwrite=True).collect()}
    assert again == {"a": "new", "b": "new", "c": None}
    functions = spark.createDataFrame([(1, "p", "a", "f", "int f() {}"), (2, "p", "c", "g", "g"), (3, "p", "b", "h", " "), (4, "p", "b", "k", "k()")], "func_id long, proj string, bin string, funname string, code string")
    functions = functions.withColumns({"callees": F.array(F.lit("z:z()")), "params_aligned": F.lit(None).cast("map<string,string>"), "vars_aligned": F.create_map(F.lit("v1"), F.lit("x"))})
    rows = {r["func_id"]: r for r in summaries.identifier_summaries(functions, made, lambda: lambda asked: ["s" for _ in asked]).collect()}
    assert [(rows[i]["lookup_status"], rows[i]["status"], rows[i]["identifier_summary"]) for i in (1, 2, 3, 4)] == [("found", "pending", "s"), ("missing", "missing_prompt", None), ("found", "missing_prompt", None), ("found", "pending", "s")]
    assert "VAR: v1\nFUNC: f\nCALL: z" in rows[1]["input"]


def test_encoding_keeps_the_order(spark):
    df = spark.createDataFrame([(3, "a b", "c"), (1, "a " * 9, "c"), (2, "a", "b c"), (4, "", "x")], "ord int, x string, y string")
    got = {r["ord"]: (r["attention_mask"], [v != -100 for v in r["labels"]]) for r in generate.encode(df, "x", "y", generate.word_ids, 0, 5, keep=("ord",)).collect()}
    assert got == {3: ([1, 1, 1, 1, 0], [False, False, True, True, False]), 2: ([1, 1, 1, 1, 0], [False, True, True, True, False])}


def test_encoding_hands_on_batches_of_bounded_size(spark):
    class Caught:
        """A table of which only the Python function of encode is wanted."""

        dtypes = []

        def where(self, *_):
            return self

        select = where

        def mapInArrow(self, run, _):
            self.run = run
            return self

    caught = Caught()
    generate.encode(caught, "x", "y", generate.word_ids, 0, 4096, cut=True)
    got = list(caught.run(iter([pa.RecordBatch.from_pydict({"x": ["w " * 1500] * 2000, "y": ["v"] * 2000})])))
    assert sum(b.num_rows for b in got) == 2000 and max(b.nbytes for b in got) < 5_000_000


def test_encoding_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(generate, "IDS_A_BATCH", 20)
    rng, ids_of, most, eos = random.Random(5), generate.word_ids(), 8, 9
    rows = [(i, " ".join(rng.choices("abcd", k=rng.randrange(12))), " ".join(rng.choices("xyz", k=rng.randrange(4)))) for i in range(300)] + [(300, " \t", " "), (301, None, "x"), (302, "a", None)]
    df = spark.createDataFrame(rows, "ord int, x string, y string").repartition(2)
    for cut in (True, False):
        want = {}
        for i, x, y in rows:
            if x and y and (cut or len(x.split()) + len(y.split()) < most):
                a, z = ids_of(x), [*ids_of(y), eos]
                ids, pad = (a + z)[:most], max(0, most - len(a) - len(z))
                want[i] = (ids + [eos] * pad, [1] * len(ids) + [0] * pad, ([-100] * len(a) + z)[:most] + [-100] * pad)
        got = generate.encode(df, "x", "y", generate.word_ids, eos, most, cut=cut, keep=("ord",)).collect()
        assert len(got) == len(want) and {r["ord"]: (r["input_ids"], r["attention_mask"], r["labels"]) for r in got} == want


def test_top_and_runner_up(spark):
    df = spark.createDataFrame([("a", 5.0, 1), ("a", 5.0, 2), ("a", 3.0, 3), ("b", 2.0, 4), ("b", 1.0, 5), ("c", 1.0, 6), ("d", None, 7)], "k string, v double, id int")
    got = {r["k"]: (r["best_id"], r["best"], r["second"], r["ties"]) for r in metrics.top_with_runner_up(df, "k", "v", "id").collect()}
    assert got == {"a": (1, 5.0, 5.0, 2), "b": (4, 2.0, 1.0, 1), "c": (6, 1.0, None, 1)}
