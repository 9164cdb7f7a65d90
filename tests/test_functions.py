"""Scalar functions against values worked out by hand."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nameforge.functions import code, names, pairs, similarity, text


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()) or "x string"
    return spark.createDataFrame([tuple(values.values()) or (None,)], schema).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("given_", "want"),
    [(" a\n\nb \r\na\rc", "a\nb\nc"), ("", ""), (None, ""), (" x ", "x"), ("a\x0bb\x1cc", "a\nb\nc")],
)
def test_distinct_lines(spark, given_, want):
    assert one(spark, text.distinct_lines(F.col("t")), t=given_) == want


def test_lines_has_no_trailing_piece(spark):
    assert one(spark, text.lines(F.col("t")), t="a\nb\n") == ["a", "b"]
    assert one(spark, text.lines(F.col("t")), t="\n") == [""]


def test_evidence(spark):
    assert one(spark, text.file_evidence(F.col("t")), t="/bin/x: ELF 64\n ELF 64") == "ELF 64"
    assert one(spark, text.library_evidence(F.col("t")), t="libc.so => /lib/libc.so (0x7f)\n /lib/ld.so (0x7ff)\nlibc.so => x") == "libc.so\n/lib/ld.so"
    assert one(spark, text.readable_strings(F.col("t")), t="hello\nn %d\n0xff a\n123 --\nhello\ná") == "hello\ná"


def test_tags_and_headers(spark):
    assert one(spark, text.between_tags(F.col("t"), "S"), t="x <S> a </S> b </S> y") == "a </S> b"
    assert one(spark, text.between_tags(F.col("t"), "S"), t=" no tags ") == "no tags"
    assert one(spark, text.drop_header(F.col("t")), t="code: f\nbody") == "body"
    assert one(spark, text.after_first(F.col("t"), "_"), t="12_a_b") == "a_b"


def test_cut_between(spark):
    marker = "#"
    t = "ab<E>" + "line1\nline2\nline3" + "</E>cd"
    got = one(spark, text.cut_between(F.col("t"), 22, "E", marker, 4, 5), t=t)
    assert got == "ab<E>line1#</E>cd" and len(got) <= 22
    assert one(spark, text.cut_between(F.col("t"), 100, "E", marker, 4, 5), t=t) == t
    plain = "0123456789" * 3
    assert one(spark, text.cut_between(F.col("t"), 20, "E", marker, 4, 5), t=plain) == plain[:15] + "#" + plain[-4:]
    both = one(spark, text.cut_between(F.col("t"), 24, "E", marker, 4, 4, (3, 4)), t="<E>" + "a" * 20 + "b" * 20 + "</E>")
    assert both == "<E>" + "a" * 12 + "#" + "b" * 4 + "</E>"


@pytest.mark.parametrize(
    ("how", "want"),
    [
        ({}, [("a", "b"), ("c", "d:e"), ("", "z")]),
        ({"empty_keys": False}, [("a", "b"), ("c", "d:e")]),
        ({"trim": False, "valueless": True}, [("a", "b"), (" c", "d:e"), (" junk", None), (" ", "z")]),
        ({"lower": True}, [("a", "b"), ("c", "d:e"), ("", "z")]),
    ],
)
def test_pair_readings(spark, how, want):
    got = one(spark, pairs.parse(F.col("t"), **how), t="a:x, c:d:e, junk, :z".replace("a:x", "a:b"))
    assert [(e["k"], e["v"]) for e in got] == want


def test_pairs_last_wins_first_place(spark):
    assert [tuple(e) for e in one(spark, pairs.parse(F.col("t")), t="a:1, b:2, a:3")] == [("a", "3"), ("b", "2")]
    assert one(spark, pairs.parse(F.col("t")), t=None) == []
    assert one(spark, pairs.parse(F.col("t"), valueless=True), t="") == []
    assert one(spark, pairs.lookup(pairs.parse(F.lit("a:")), F.col("t")), t="a") == ""


def test_rename_quirks(spark):
    rename = code.rename(F.col("c"), F.lit("a1"), F.lit("x"))
    assert one(spark, rename, c="f(a1,a1);") == "f(x,a1);"
    assert one(spark, rename, c="b = a1") == "b = a1"
    assert one(spark, rename, c="a1@ a1;") == "a1@ x;"
    assert one(spark, code.rename(F.col("c"), F.lit("a"), F.lit(r"$1\q")), c="(a)") == r"($1\q)"
    chained = code.rename_all(F.col("c"), pairs.parse(F.lit("a:b, b:c")))
    assert one(spark, chained, c="(a)") == "(c)"


def test_normal_forms(spark):
    assert one(spark, code.norm_code(F.col("c"), pairs.parse(F.lit("a1:Len"))), c="int a1; // x\n/* y */ g(a1) ;") == "intlen;g(len);"
    got = one(spark, code.norm_placeholders(F.col("c")), c="sub_40F0(dword_1A, 0x1F, 0FFh, each, loc_10);")
    assert got == "<fun>(<global_var>,<hex>,<hex>,<hex>,<label>);"


def test_numbers(spark):
    c = "0x1F 12u 0FFh 017 08 1.5 v3 'a1' \"77\" 0b11 18446744073709551617 /* 5 */ // 6"
    assert one(spark, code.numbers(F.col("c")), c=c) == sorted(["31", "12", "255", "15", "8", "3", "18446744073709551617"])
    assert one(spark, code.numbers(F.col("c")), c=None) is None


@pytest.mark.parametrize(
    ("c", "name", "want"),
    [
        ("void f(void)\n{\n  x;\n}\n", "f", (0, "void", 1, 2)),
        ("int __usercall f@<rax>(int a@<rdi>, char *b)\n{\n\n  return 1;\n}", "f", (2, "int __usercall", 1, 2)),
        ("int g(void (*cb)(int, int), int x) {}", None, (2, "int", 0, 1)),
        ("std::map<int,int> h(map<int, int> m)", None, (1, "std::map<int,int>", 0, 1)),
        ("  ", "f", (0, "", 0, 0)),
        ("no parenthesis", "f", (0, "", 0, 1)),
        ("int f(int a) // {\n{\n/* a\n b */ x;\n}", "f", (1, "int", 1, 2)),
    ],
)
def test_features(c, name, want):
    assert code.code_features(c, name) == want


def test_parameters():
    assert code.parameters_of("int f(int a, char *b, void (*cb)(int), ...) {") == ["a", "b", "cb"]
    assert code.parameters_of("int f(void)") == []
    assert code.parameters_of("int f(int)") == [None]
    assert code.parameters_of(None) == []


def test_calls():
    assert code.call_texts("f", ["x = f(a, g(b)); my_f(1); f(a, g(b))", "f(open"]) == ["f(a, g(b))", "f(open"]
    assert code.call_texts("", ["f()"]) == []


def test_stack_variables(spark):
    got = one(spark, code.stack_variables(F.col("c")), c="  int v4; // [rsp+8h] [rbp-18h]\n  char *s[4]; // [rbp+10h]\n  int q; // none")
    assert [(v["type"], v["variable"], v["rbp_offset_int"], v["size"], v["stack_end"]) for v in got] == [("int", "v4", -24, 4, -20), ("char *", "s", 16, 8, 24)]


def test_signature(spark):
    assert one(spark, code.signature(F.col("t")), t="int f(char *a, int &b)") == "f(a, b)"
    assert one(spark, code.signature(F.col("t")), t="int f()") == "f()"
    assert one(spark, code.signature(F.col("t")), t=" none ") == "none"


def test_compiler_made(spark):
    for n, want in [("frame_dummy", True), ("deregister_tm_clones", True), ("register_tm_clones", True), ("_dl_relocate_static_pie", False), ("__gmon_start__", True), ("_start_up", True), (".plt", True), ("start", False), (None, False)]:
        assert one(spark, names.compiler_made(F.col("n")), n=n) is want


def test_external_segment(spark):
    for x, want in [(".plt", True), (".got.plt", True), ("extern", False), (".extern", True), (".text", False), (None, False)]:
        assert one(spark, names.external_segment(F.col("n")), n=x) is want


def test_letter_cosine(spark):
    for a, b, want in [("ab", "BA", 1.0), ("ab", "cd", 0.0), ("a1", "", 0.0), ("aab", "ab", 3 / (5**0.5 * 2**0.5))]:
        assert one(spark, similarity.letter_cosine(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want)


def test_clusters(spark):
    match = similarity.cluster_match({"len": [1, 2], "size": [2], "buf": [3]})
    got = [one(spark, similarity.score_names(F.col("g"), F.col("p"), match=match)["recall"], g=g, p=p) for g, p in [("len", "size"), ("len", "buf"), ("len", "lens"), ("zzz", "size")]]
    assert got == [1.0, 0.0, 1.0, 0.0]
    with pytest.raises(ValueError):
        similarity.cluster_match({"a": [1], "b": [1]}, most=1)


def test_names(spark):
    for n, want in [("v1", False), ("v1.x", False), ("_12", False), ("i", False), ("ret", False), ("size", True), ("", False), (None, False), ("v1x", True)]:
        assert one(spark, names.interesting(F.col("n")), n=n) is want
    assert one(spark, names.words(F.col("n")), n="readSHA") == ["read", "sha"]
    assert one(spark, names.words(F.col("n")), n="get_a_b_len") == ["get", "ab", "len"]
    assert one(spark, names.name_of(F.create_map(F.lit("k"), F.col("n"))), n=" UnKnown\n") is None
    assert one(spark, names.base_name(F.col("n")), n="ns::Cls<int>::run(int, char)") == "run"


def _dp(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcé", max_size=40), st.text("abcé", max_size=40))
def test_lcs_is_the_dynamic_program(a, b):
    assert similarity.lcs(a, b) == _dp(a, b)


def test_ratio(spark):
    assert one(spark, similarity.indel_ratio(F.lit("abcd"), F.col("t")), t="abed") == pytest.approx(75.0)
    assert one(spark, similarity.indel_ratio(F.lit(""), F.col("t")), t="") == 100.0
    assert one(spark, similarity.rounded_ratio(F.lit(89.5)), t="") == 90
    assert one(spark, similarity.rounded_ratio(F.lit(88.5)), t="") == 88


@pytest.mark.parametrize(("g", "p", "want"), [("Len", "len", (1, 1)), ("buf_len", "len", (1, 0.5)), ("a", None, (0, 0)), ("", "x", (0, 0)), ("size_len", "sizes", (1, 0.5)), ("len_len", "len", (1, 0.5))])
def test_name_scores(spark, g, p, want):
    got = one(spark, similarity.score_names(F.col("g"), F.col("p")), g=g, p=p)
    assert (got["precision"], got["recall"]) == pytest.approx(want)


def test_reward(spark):
    def r(p, g):
        return one(spark, similarity.hybrid_reward(pairs.parse(F.col("p"), lower=True), pairs.parse(F.col("g"), lower=True)), p=p, g=g)

    assert r("a:x", "a:x") == 1
    assert r("a:x", "b:x") == 0
    assert r("a:-", "a:x") == 0
    assert r("", "") == 0
    assert r("a:len, b:x", "a:lens, b:x") == pytest.approx((0.2 * 0.75 + 1) / 2)
