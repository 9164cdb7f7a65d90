import os

import pytest
from pyspark.sql import functions as F

from nameforge.functions import plugins, similarity
from nameforge.functions.code import number_tokens
from nameforge.operators import retrieve
from nameforge.sources import evidence

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def test_defaults(spark):
    df = spark.createDataFrame([("a b",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(plugins.tokens(F.col("t"), plugins.plain_words)).collect()] == [["a", "b"], None, []]
    assert [r[0] for r in df.select(plugins.texts(F.col("t"), plugins.unchanged)).collect()] == ["a b", None, ""]
    v = df.where("t <> ''").select(similarity.cosine(plugins.vectors(F.col("t"), plugins.letter_shares()), plugins.vectors(F.lit("ba"), plugins.letter_shares()))).first()[0]
    assert v == pytest.approx(1)


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no vocabulary file")
def test_pieces(spark):
    df = spark.createDataFrame([("read buffer",)], "t string")
    got = df.select(plugins.tokens(F.col("t"), plugins.pieces(MODEL))).first()[0]
    assert "".join(got) == "readbuffer"


def test_demangle(spark):
    def make():
        return lambda names: ["ns::Cls::run(int)" if n == "_ZRun" else n for n in names]

    df = spark.createDataFrame([("_ZRun",), ("_ZRun_2",), ("plain",)], "t string")
    assert [r[0] for r in df.select(plugins.demangle(F.col("t"), make)).collect()] == ["run", "run", "plain"]


def test_evidence(spark, tmp_path):
    (tmp_path / "x").write_text("hi")
    files = spark.createDataFrame([(f"file:{tmp_path}/x",)], "path string")
    raw = evidence.collect(files, tools={"file_output": ("echo", "kind"), "ldd_output": ("no-such-tool",), "strings_output": ("cat",)}, timeout=20).first()
    assert raw["file_output"].startswith("kind") and raw["ldd_output"] == "" and raw["strings_output"] == "hi"
    slow = evidence.output_of(["sleep", "5"], 0.2)
    assert slow == ""
    rows = spark.createDataFrame([("/x: ELF", "a => b", "hello\n%d", "7_proj")], "file_output string, ldd_output string, strings_output string, folder string")
    assert tuple(evidence.analysis(rows, "folder").first()["analysis"]) == ("ELF", "a", "hello", "proj")


def test_retrieval_by_insertions_and_deletions(spark):
    ix = (1, "int", 10, 10)
    code = "if(a1>0x10){return f(a1,7);}" * 4
    rows = [(1, ix, code), (2, ix, code.replace("7", "8", 1)), (3, ix, "while(x){y();}"), (4, ix, code + ";;")]
    df = spark.createDataFrame(rows, "id long, index struct<arg_count int, return_type string, loc int, full_loc int>, text string").withColumn("src", F.col("text")).withColumn("numbers", number_tokens(F.col("text")))
    got = {r["id"]: (r["match"]["id"] if r["match"] else None, r["retrieval"]["best_score"]) for r in retrieve.retrieve(df, df, "text", "src", "numbers", not_self=True).collect()}
    assert got[3][0] is None
    assert got[1][0] in (2, 4) and got[1][1] == pytest.approx(200 * len(code) / (2 * len(code) + 2))
