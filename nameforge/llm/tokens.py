"""Token counts by a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary file: one base64 token and its rank a line.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this public tokenizer cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LOADED: dict[tuple[str, str], object] = {}


def encoder(vocabulary: str = VOCABULARY, pattern: str = PATTERN):
    """The encoder of a vocabulary file, loaded once a process."""
    if (vocabulary, pattern) not in _LOADED:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[vocabulary, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[vocabulary, pattern]


def count(df: DataFrame, text: str, keep: list[str], vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """The columns ``keep`` and n_tokens of every row whose text is not null; whole texts, one pass without a shuffle."""
    rows = df.where(F.col(text).isNotNull()).select(*(F.col(c).alias(f"_{k}") for k, c in enumerate(keep)), F.col(text).alias("_text"))
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, pattern).encode_ordinary
        for b in batches:
            n = pa.array([len(encode(t)) for t in b.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), n], names=[*keep, "n_tokens"])

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_tokens long"]))
