"""Evidence about program files from outside tools, as text columns."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nameforge.functions.text import after_first, file_evidence, library_evidence, readable_strings

#: Column and command of each tool; the file's path is appended.
TOOLS = {"file_output": ("file",), "ldd_output": ("ldd",), "strings_output": ("strings",)}


def output_of(command: list[str], timeout: float) -> str:
    """What a command prints; its exit code does not count. A missing tool or a timeout gives ''."""
    try:
        return subprocess.run(command, capture_output=True, timeout=timeout, check=False).stdout.decode("utf-8", "replace")
    except (OSError, subprocess.TimeoutExpired):
        return ""


def collect(files: DataFrame, path: str = "path", tools: dict[str, tuple[str, ...]] | None = None, timeout: float = 3600) -> DataFrame:
    """(path, one column a tool): raw outputs for each file that every executor can read at its path."""
    use = dict(tools or TOOLS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0).to_pylist()
            local = [n.removeprefix("file:") for n in names]
            cols = [pa.array([output_of([*c, n], timeout) for n in local]) for c in use.values()]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=[path, *use])

    return files.select(path).mapInArrow(run, ", ".join(f"`{c}` string" for c in (path, *use)))


def analysis(raw: DataFrame, folder: str) -> DataFrame:
    """raw with ``analysis``: cleaned evidence and the project's name out of ``folder`` (``number_project``)."""
    return raw.withColumn(
        "analysis",
        F.struct(
            file_evidence(F.col("file_output")).alias("file_output"),
            library_evidence(F.col("ldd_output")).alias("ldd_output"),
            readable_strings(F.col("strings_output")).alias("strings_truncated"),
            after_first(F.col(folder), "_").alias("project_name"),
        ),
    )
