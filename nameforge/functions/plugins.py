"""Places for what needs a model or an outside library, each with an offline default.

A plug-in is a factory: it is called once in each Python worker and gives a
function over a batch of strings, so a model is loaded once and used on whole
batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

Batch = Callable[[list[str]], list]


def tokens(column: Column, make: Callable[[], Batch]) -> Column:
    """array<string> of each text by a segmenter; NULL stays NULL."""
    return _udf(make, ArrayType(StringType()))(column)


def texts(column: Column, make: Callable[[], Batch]) -> Column:
    """A text for each text: a lemmatiser's words joined, a demangled name."""
    return _udf(make, StringType())(column)


def vectors(column: Column, make: Callable[[], Batch]) -> Column:
    """array<float> of each text by an encoder, to be compared with ``similarity.cosine``."""
    return _udf(make, ArrayType(FloatType()))(column)


def _udf(make: Callable[[], Batch], kind):
    @F.pandas_udf(kind)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        work = make()
        for s in batches:
            known = s[s.notna()]
            out = pd.Series([None] * len(s), index=s.index, dtype=object)
            out[known.index] = pd.Series(work(known.tolist()), index=known.index, dtype=object)
            yield out

    return apply


def pieces(model_file: str) -> Callable[[], Batch]:
    """Segmenter by a SentencePiece model: pieces without the word mark, so a lone mark is an empty token."""

    def make() -> Batch:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        return lambda names: [[p.replace("▁", "") for p in row] for row in model.encode(names, out_type=str, num_threads=1)]

    return make


def plain_words() -> Batch:
    """Default segmenter: words between blanks."""
    return lambda names: [n.split() for n in names]


def unchanged() -> Batch:
    """Default lemmatiser and demangler."""
    return lambda names: names


def demangle(column: Column, make: Callable[[], Batch] = unchanged) -> Column:
    """The base name of a demangled name; a name that does not change is tried again without its copy suffix."""
    from nameforge.functions.names import base_name

    first = texts(column, make)
    bare = F.regexp_replace(column, r"_[0-3]$", "")
    second = texts(bare, make)
    out = F.when(first != column, first).when(second != bare, second).otherwise(column)
    return F.when(F.contains(out, F.lit("(")), base_name(out)).otherwise(out)


def letter_shares(width: int = 26) -> Callable[[], Batch]:
    """Default encoder: shares of the letters a to z, of length 1; needs no model."""

    def make() -> Batch:
        def encode(names: list[str]) -> list[list[float]]:
            out = []
            for n in names:
                v = [0.0] * width
                for c in n.lower():
                    if "a" <= c <= "z":
                        v[(ord(c) - 97) % width] += 1
                size = sum(x * x for x in v) ** 0.5 or 1.0
                out.append([x / size for x in v])
            return out

        return encode

    return make
