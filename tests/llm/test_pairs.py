"""Near-duplicates, cross-split overlaps, layout copies and look-alikes against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nameforge.llm import layout, leakage, lookalike, neardup
from nameforge.operators import cells

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
INDEX = "struct<arg_count int, return_type string, loc int, full_loc int>"


def _text(rng, n=40):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def _edit(rng, t, k):
    t = list(t)
    for _ in range(k):
        at = rng.randrange(len(t))
        t[at : at + rng.randrange(2)] = rng.choice("abcxyz")
    return "".join(t)


def _name(m):
    v = next(iter(m.values())) if m else None
    v = v.strip(" \t\n\r\x0b\x0c").lower() if v is not None else None
    return v if v not in (None, "", "unknown") else None


def _dp(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _functions(rng, n=220):
    seeds = [_text(rng) for _ in range(10)]
    rows = []
    for i in range(n):
        t = _edit(rng, rng.choice(seeds), rng.choice([0, 1, 3, 9, 15, 30]))
        if rng.random() < 0.2 and rows:
            t = rng.choice(rows)[2] or t
        ix = None if rng.random() < 0.05 else (rng.choice([1, 1, 1, 2, None]), rng.choice(["int", " INT", "Int", "void", None]), rng.choice([10, 10, 12, 20, None]), 1)
        m = rng.choice([{"s": "Foo"}, {"s": " foo\n"}, {"s": "foo"}, {"s": "FOO"}, {"s": "main"}, {"s": "unknown"}, {}, None, {"s": None}, {"s": "bar"}])
        rows.append((i, m, rng.choice([t, t, t, t.upper().replace(" ", "\n\t"), None, "  "]), ix))
    return rows


def _p1(rows):
    ok = []
    for i, m, c, ix in rows:
        n = _name(m)
        t = re.sub(r"[ \t\n\r\x0b\x0c]", "", c or "").lower()
        if n and n != "main" and t and ix and None not in ix[:3]:
            ok.append((i, (n, ix[0], ix[1].strip().lower()), ix[2], t))
    return {(min(a[0], b[0]), max(a[0], b[0])) for k, a in enumerate(ok) for b in ok[:k] if a[1] == b[1] and 10 * abs(a[2] - b[2]) <= 3 * max(a[2], b[2]) and 10 * (len(a[3]) + len(b[3]) - 2 * _dp(a[3], b[3])) <= len(a[3]) + len(b[3])}


@pytest.mark.parametrize("cap", [2000, 15])
def test_near_duplicates(spark, cap):
    rows = _functions(random.Random(4))
    df = spark.createDataFrame(rows, f"func_id long, funname_aligned map<string,string>, norm_code string, index {INDEX}").withColumn("text", F.lit("x")).withColumn("block", F.lit(1)).repartition(5)
    found = [tuple(r) for r in neardup.pairs(neardup.features(df), neardup.keys(df), cap=cap).collect()]
    want = _p1(rows)
    assert len(found) == len(set(found)) and set(found) == want and want
    links = neardup.links(neardup.features(df), neardup.keys(df), cap=cap).collect()
    count = Counter(x for p in want for x in p)
    assert {r["id"]: r["links"] for r in links} == {r["id"]: count[r["id"]] for r in links}
    assert len({r["id"] for r in links}) == len(links)


def test_near_duplicates_of_a_hot_text_and_long_texts(spark):
    long = "ab" * 20_000
    rows = [(i, {"s": "f"}, "same text here", (1, "int", 5, 5)) for i in range(120)] + [(200, {"s": "g"}, long, (1, "int", 5, 5)), (201, {"s": "g"}, long[:-1000], (1, "int", 5, 5))]
    df = spark.createDataFrame(rows, f"func_id long, funname_aligned map<string,string>, norm_code string, index {INDEX}")
    assert neardup.pairs(neardup.features(df), cap=20).count() == 120 * 119 // 2 + 1
    links = {r["id"]: (r["class_id"], r["copies"], r["links"]) for r in neardup.links(neardup.features(df)).collect()}
    assert links[7] == (0, 120, 119) and links[200] == (200, 1, 1)
    assert neardup.pairs(neardup.features(df.where("false"))).count() == 0
    assert neardup.links(neardup.features(df.where("false"))).count() == 0


def _tests(rng, n=260):
    seeds = [_text(rng, 30) for _ in range(12)]
    rows = []
    for i in range(n):
        t = _edit(rng, rng.choice(seeds), rng.choice([0, 1, 3, 10, 40]))
        c = rng.choice([t, t, "/* note */" + t.upper(), t.replace(" ", "\n") + "// end", None, ""])
        rows.append((i, rng.choice([{"s": "f"}, {"s": "F "}, {"s": "main"}, None, {"s": "unknown"}]), rng.choice([0, 1, 1, None]), c, rng.choice(["valid", "test", None]), rng.choice(["p", None])))
    return rows


@pytest.mark.parametrize("cap", [2000, 12])
def test_overlaps(spark, cap):
    rows = _tests(random.Random(5))
    df = spark.createDataFrame(rows, "test_id long, funname_aligned map<string,string>, in_train int, code string, eval_set string, proj string").withColumn("side", F.lit("x")).repartition(4)
    recs = leakage.features(df)
    got = leakage.overlaps(recs, cap=cap, sound=True).collect()
    ok = [(i, _name(m), s, re.sub(r"[ \t\n\r\x0b\x0c]", "", re.sub(r"//[^\r\n]*", "", re.sub(r"(?s)/\*.*?\*/", "", c))).lower()) for i, m, s, c, *_ in rows if c is not None and _name(m) and s is not None]
    want = {(a[0], b[0]) for a in ok for b in ok if a[2] == 0 and b[2] == 1 and a[1] == b[1] and a[3] and b[3] and 10 * (len(a[3]) + len(b[3]) - 2 * _dp(a[3], b[3])) <= len(a[3]) + len(b[3])}
    assert len(got) == len({(r["eval_id"], r["train_id"]) for r in got})
    assert {(r["eval_id"], r["train_id"]) for r in got} == want and want
    assert all(0 <= r["containment"] <= 1 for r in got)
    sources = df.where("in_train = 0").select(F.col("test_id").alias("id"), "eval_set", F.col("proj").alias("source"))
    rep = leakage.report(recs, leakage.overlaps(recs, cap=cap, sound=True), sources).collect()
    assert sum(r["overlaps"] for r in rep) == len(want) and sum(r["records"] for r in rep) == sum(r[2] == 0 for r in rows)
    assert leakage.overlaps(leakage.features(df.where("false"))).count() == 0
    hits = {(r["eval_id"], r["train_id"]): r["containment"] for r in leakage.overlaps(recs, cap=cap).collect()}
    assert hits.keys() <= want and hits == {(r["eval_id"], r["train_id"]): r["containment"] for r in got if r["containment"] >= leakage.LEAST}


def test_shingles_are_the_same_in_every_process():
    known = {}
    assert leakage.shingles("a b c d e f", known).tolist() == leakage.shingles("a b c d e f", {}).tolist()
    assert len(leakage.shingles("a b c d e f", known)) == 2 and len(leakage.shingles("a b", known)) == 1 and len(leakage.shingles(" ", known)) == 0
    assert leakage.shingles("a b c d e", {})[0] == 16147818580917457420


def test_containment_is_the_nested_loop():
    rng = np.random.default_rng(4)
    ask, have = ([np.unique(rng.integers(0, 40, rng.integers(0, 12)).astype(np.uint64)) for _ in range(n)] for n in (25, 30))
    for most in (1 << 20, 5):
        got = {(int(q), int(h)): float(s) for a, b, c in leakage.contained(ask, have, 0.3, most) for q, h, s in zip(a, b, c)}
        want = {(i, j): len(np.intersect1d(x, y)) / len(x) for i, x in enumerate(ask) for j, y in enumerate(have) if len(x) and 0 < len(np.intersect1d(x, y)) >= 0.3 * len(x)}
        assert got == want


def test_cells_meet_once(spark):
    df = spark.range(90).select("id", F.lit("b").alias("block"), F.when(F.col("id") % 3 == 0, 1).otherwise(2).alias("side"))
    placed = cells.cross_cells(df, df, "block", "side", "id", 7).collect()
    at = defaultdict(lambda: ([], []))
    for r in placed:
        at[r["cell_i"], r["cell_j"]][r["side"] - 1].append(r["id"])
    pairs = Counter((a, b) for x, y in at.values() for a in x for b in y)
    assert len(pairs) == 30 * 60 and max(pairs.values()) == 1


def test_layout_copies(spark):
    rng = random.Random(6)
    rows = []
    for i in range(150):
        base = rng.choice(["int f(a){b;}", "Int F ( a ) { b ; }", "intfab", "int f(a){c;}", None, " \n"])
        out = rng.choice(["a:x, b:y", "B:Y,a:x", "a:x,a:x, b:y", None, "", "a:x, b:z"])
        rows.append((i, base, out))
    df = spark.createDataFrame(rows, "func_id long, code string, output string").withColumn("text", F.lit(1)).withColumn("f1", F.lit(2))
    recs = layout.records(df, "functions", "func_id", "code", "output")

    def key(c, o):
        return re.sub(r"[\s;,(){}]", "", c).lower(), frozenset(e for e in re.sub(r"\s", "", o or "").lower().split(",") if e)

    groups = defaultdict(list)
    for i, c, o in rows:
        if c and c.strip():
            groups[key(c, o)].append(i)
    want = {("functions", g[0], x) for g in groups.values() for x in g[1:]}
    assert {tuple(r) for r in layout.copies(recs).collect()} == want
    assert {r["first_id"]: r["copies"] for r in layout.collapse(recs).collect()} == {g[0]: len(g) for g in groups.values()}
    assert {tuple(r) for r in layout.copies(recs, hot=4).collect()} == want
    assert {r["first_id"]: r["copies"] for r in layout.collapse(recs, hot=3).collect()} == {g[0]: len(g) for g in groups.values()}
    assert layout.copies(recs.where("false")).count() == 0
    # Equal fingerprints of unequal records are told apart by their fields.
    clash = recs.withColumns({c: F.lit(1).cast("long") for c in ("f1", "f2")})
    assert {tuple(r) for r in layout.copies(clash).collect()} == want


def test_look_alikes(spark):
    # The corpus knows the words; the second of each pair only looks the same.
    texts = [
        "Notes on the café résumé: see sub_40A1 and file fix",
        "Nоtеs оn thе cafe\u0301 ré\u200bsumé: sее ѕub_40А1 and ｆｉｌｅ ﬁx",
        "Обзор проекта, а также с файлом ещё",
        "Oбзop прoeктa, a тaкже c фaйлoм еще\u0308",
        "Notes on the cafe résumé: see sub_40A1 and file fix",
        "Notes on the café Résumé: see sub_40A1 and file fix",
        "plain",
        "plain",
        "plain\u00a0 text",
        "plain  text",
        "",
        None,
        "line one\nline two",
        "line one line two",
        "x" * 200_000 + " еnd",
        "x" * 200_000 + " end",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("form", F.lit(1)).withColumn("raw", F.lit("r"))
    found = {tuple(r) for r in lookalike.twins(lookalike.forms(df, "doc_id", "text")).collect()}
    assert found == {(0, 1), (2, 3), (8, 9), (14, 15)}
    fixed = {r["id"]: r["text"] for r in lookalike.consistent(df, "doc_id", "text").collect()}
    assert fixed[1] == texts[0] and fixed[3] == texts[2] and fixed[6] == "plain" and fixed[11] is None and fixed[10] == ""
    assert len(fixed) == len(texts)
    empty = df.where("false")
    assert lookalike.twins(lookalike.forms(empty, "doc_id", "text")).count() == 0


def test_unknown_results_are_not_substituted(spark):
    df = spark.createDataFrame([(1, "the wоrd is unique"), (2, "another text")], "doc_id long, text string")
    assert {r["id"]: r["text"] for r in lookalike.consistent(df, "doc_id", "text").collect()}[1] == "the wоrd is unique"


def test_twins_of_many_copies(spark):
    rows = [(i, "hеllo wоrld" if i == 0 else "hello world") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in lookalike.twins(lookalike.forms(df, "doc_id", "text")).collect()}
    assert got == {(0, i) for i in range(1, 300)}


def test_width_is_no_difference():
    assert lookalike.plain("ｶﾞﾊﾟｱｰ｡") == "ガパアー。"
    assert lookalike.plain("ﾡￂ") == lookalike.plain("ㄱㅏ")
    assert lookalike.plain("￠￡￢￣￤￥￦") == "¢£¬¯¦¥₩"
    assert lookalike.plain("aﾠb") == "ab"


def test_look_alikes_with_accents_and_without_letters_of_one_script_only(spark):
    texts = [
        "Später wäre das möglich",
        "Ѕрӓtеr wӓrе dаѕ mο̈glіch",
        "Обзор: цикл while и файл",
        "Обзор: цикл whіlе и файл",
        "Обзор: цикл ԝһіӏе и файл",
        "no pair\U000e0041 here️",
        "no pair here",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {tuple(r) for r in lookalike.twins(lookalike.forms(df, "doc_id", "text")).collect()} == {(0, 1), (2, 3), (2, 4), (3, 4), (5, 6)}
