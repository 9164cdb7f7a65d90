"""Models behind small interfaces, and the loop of rounds that feeds predictions back as context."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from types import ModuleType
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nameforge.functions.text import strip
from nameforge.operators.curate import clean, split_by_presence
from nameforge.operators.propagate import callee_context, callsite_context
from nameforge.plans.prompts import context_prompt, prompt, retrieval_prompt, targets
from nameforge.session import checkpoint


class Generator(Protocol):
    """Answers a batch of prompts in order; one instance per Python worker."""

    def __call__(self, prompts: list[str]) -> list[str]: ...


def echo_names() -> Generator:
    """An offline stand-in: names every placeholder asked for after its position, so runs can be repeated."""

    def answer(prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            asked = p.rstrip().rsplit("predict the original names of ", 1)[-1].rstrip(".").split(", ")
            out.append(", ".join(f"{a}:name_{k}" for k, a in enumerate(asked)))
        return out

    return answer


def _once(make: Callable[[], Generator], name: str) -> Generator:
    """The model of this Python worker: made when its first task needs it, kept for the next ones."""
    held = sys.modules.setdefault("_nameforge_models", ModuleType("_nameforge_models")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]


def generate(df: DataFrame, prompt_col: str, output: str, make: Callable[[], Generator] = echo_names, batch: int = 256) -> DataFrame:
    """df with ``output``: the model's answer to each prompt, NULL for a NULL prompt. Rows are independent of their batch."""
    rest = [c for c in df.columns if c != output]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.select(*rest).dtypes), f"`{output}` string"])
    name = hashlib.sha256(cloudpickle.dumps(make)).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _once(make, name)
        for b in batches:
            asked = b.column(rest.index(prompt_col)).to_pylist()
            at = [k for k, p in enumerate(asked) if p is not None]
            answers: list[str | None] = [None] * len(asked)
            for lo in range(0, len(at), batch):
                part = at[lo : lo + batch]
                for k, a in zip(part, model([asked[k] for k in part]), strict=True):
                    answers[k] = a
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(answers, pa.string())], names=[*rest, output])

    return df.select(*rest).mapInArrow(run, schema)


def words_count(text: Column) -> Column:
    """The default token count: words between white space. Any function of a column will do instead."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def rounds(df: DataFrame, loops: int, ord_col: str = "ord", make: Callable[[], Generator] = echo_names, tokens: Callable[[Column], Column] = words_count, most: int = 16384) -> DataFrame:
    """Predictions after an anchor round and ``loops`` rounds of context.

    df: ord, bin, funname, code, callees, params and variables (arrays of
    placeholders), output (label), summary, similar (NULL where nothing similar is
    known). First only records with a similar function are predicted; then each round
    rebuilds prompts from the context, drops what is too long, predicts all, and
    carries names along the call edges, but for the last. Context is made anew each
    round. loops = 0 gives the anchor round with its callee context.
    """
    asked = targets(F.col("params"), F.col("variables"), F.col("funname"), F.col("callees"))
    start = df.withColumn("input", retrieval_prompt(F.col("similar"), F.col("code"), asked))
    start = clean(start, "input", "output", tokens, most)
    known, other = split_by_presence(start, "similar")
    anchored = checkpoint(generate(known, "input", "predict", make).unionByName(other.withColumn("predict", F.lit(None).cast("string"))))

    def joined(base: DataFrame, *contexts: DataFrame) -> DataFrame:
        for c in contexts:
            base = base.join(c.withColumnRenamed("ord", ord_col), ord_col)
        return base

    state = joined(anchored, callee_context(anchored, ord_col, "predict", params="params")).withColumn("predict_callsites", F.array().cast("array<string>"))
    for k in range(loops):
        text = prompt(F.col("similar"), context_prompt(F.coalesce("summary", F.lit("")), F.col("predict_callsites"), F.col("predict_callees"), F.col("code"), asked), F.col("input"))
        ready = clean(state.withColumn("input", text), "input", "output", tokens, most)
        state = checkpoint(generate(ready.drop("predict"), "input", "predict", make))
        if k + 1 < loops:
            bare = state.drop("predict_callees", "predict_callsites")
            state = joined(bare, callee_context(bare, ord_col, "predict", params="params"), callsite_context(bare, ord_col, "predict"))
    return state


@dataclass(frozen=True)
class Settings:
    """Settings of a run, checked when they are made."""

    loops: int = 1
    batch: int = 8192
    most_input: int = 16384
    most_output: int = 16384
    memory_share: float = 0.9

    def __post_init__(self) -> None:
        for n in ("batch", "most_input", "most_output"):
            v = getattr(self, n)
            if isinstance(v, bool) or not isinstance(v, int) or v <= 0:
                raise ValueError(f"{n} must be a whole number above 0, not {v!r}")
        if isinstance(self.loops, bool) or not isinstance(self.loops, int) or self.loops < 0:
            raise ValueError(f"loops must be a whole number of 0 or more, not {self.loops!r}")
        if not 0 < self.memory_share <= 1:
            raise ValueError(f"memory_share must be above 0 and at most 1, not {self.memory_share!r}")


def dry_run(df: DataFrame, settings: Settings, ord_col: str = "ord", tokens: Callable[[Column], Column] = words_count) -> DataFrame:
    """One row about what ``rounds`` would do with df in its anchor round; no model is asked.

    records, known (with a similar function), too_long, no_label, and the calls of the
    model: batches of the anchor round, and of each round after it at most.
    """
    asked = targets(F.col("params"), F.col("variables"), F.col("funname"), F.col("callees"))
    text = retrieval_prompt(F.col("similar"), F.col("code"), asked)
    n = tokens(F.concat(F.coalesce(text, F.lit("")), F.coalesce("output", F.lit(""))))
    blank = F.coalesce(strip(F.col("output")), F.lit("")) == ""
    fits = ~blank & (n <= settings.most_input)
    counts = df.agg(F.count(ord_col).alias("records"), F.count("similar").alias("known"), F.count_if(~blank & (n > settings.most_input)).alias("too_long"), F.count_if(blank).alias("no_label"), F.count_if(fits & F.col("similar").isNotNull()).alias("_a"), F.count_if(fits).alias("_b"))
    calls = [F.ceil(F.col(c) / settings.batch).alias(a) for c, a in (("_a", "anchor_batches"), ("_b", "batches_a_round"))]
    return counts.select("records", "known", "too_long", "no_label", *calls, F.lit(settings.loops).alias("loops"))


#: Numbers in one batch that ``encode`` hands on; what its worker holds doesn't grow with the rows of a task.
IDS_A_BATCH = 1 << 20


def encode(df: DataFrame, text: str, label: str, tokenize: Callable[[], Callable[[str], list[int]]], eos: int, most: int, cut: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(input_ids, attention_mask, labels), each ``most`` long, of prompt and answer with an end mark, and the columns to keep (an order, say).

    Labels of the prompt and of the padding are -100. Records without text or label
    are left out; too long ones are cut or left out. Python only makes the tokens, all
    that repeats is filled in by native expressions, row by row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = tokenize()

        def made(b: pa.RecordBatch, at: list[int], ids: list[np.ndarray], asked: list[int]) -> pa.RecordBatch:
            rest = [b.column(2 + k).take(pa.array(at, pa.int64())) for k in range(len(keep))]
            return pa.RecordBatch.from_arrays([*rest, pa.array(ids, pa.list_(pa.int32())), pa.array(asked, pa.int32())], names=[*keep, "_ids", "_asked"])

        for b in batches:
            at, ids, asked, held = [], [], [], 0
            for k in range(b.num_rows):
                a, z = ids_of(b.column(0)[k].as_py()), [*ids_of(b.column(1)[k].as_py()), eos]
                if len(a) + len(z) > most and not cut:
                    continue
                at.append(k)
                ids.append(np.array((a + z)[:most], np.int32))
                asked.append(min(len(a), most))
                held += len(ids[-1])
                if held >= IDS_A_BATCH:
                    yield made(b, at, ids, asked)
                    at, ids, asked, held = [], [], [], 0
            if at:
                yield made(b, at, ids, asked)

    def times(value: int, n: Column) -> Column:
        return F.array_repeat(F.lit(value).cast("int"), n)

    ready = df.where((F.col(text) != "") & (F.col(label) != "")).select(text, label, *keep)
    kinds = dict(df.dtypes)
    got = ready.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "_ids array<int>, _asked int"]))
    n, asked = F.size("_ids"), F.col("_asked")
    pad = F.lit(most) - n
    return got.select(
        *keep,
        F.concat("_ids", times(eos, pad)).alias("input_ids"),
        F.concat(times(1, n), times(0, pad)).alias("attention_mask"),
        F.concat(times(-100, asked), F.slice("_ids", asked + 1, n - asked), times(-100, pad)).alias("labels"),
    )


def word_ids() -> Callable[[str], list[int]]:
    """A tokenizer without a vocabulary: a stable number for each word between white space."""
    import zlib

    return lambda text: [zlib.crc32(w.encode()) % 32_000 for w in text.split()]
