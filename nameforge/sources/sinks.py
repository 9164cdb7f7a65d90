"""Writers of record lists."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write(df: DataFrame, path: str, form: str = "parquet", mode: str = "overwrite") -> None:
    """A data set of parquet, orc, csv or jsonl files; the committer makes it appear whole or not at all."""
    if form == "jsonl":
        df.write.mode(mode).option("ignoreNullFields", "true").json(path)
    elif form in ("parquet", "orc", "csv"):
        df.write.mode(mode).format(form).options(**({"header": "true"} if form == "csv" else {})).save(path)
    else:
        raise ValueError(f"unknown form {form!r}")


def write_in_batches(df: DataFrame, path: str, key: str, batches: int) -> int:
    """df in ``batches`` parts by hash of a key, each committed on its own; parts that stand already are left alone.

    A run that breaks off goes on where it stopped when it is started again with the same
    number of batches. Returns the number of parts written now. Read them back from ``path``.
    """
    spark = df.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    made = 0
    for k in range(batches):
        part = f"{path.rstrip('/')}/batch={k}"
        if system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{part}/_SUCCESS")):
            continue
        df.where(F.pmod(F.xxhash64(key), F.lit(batches)) == k).write.mode("overwrite").parquet(part)
        made += 1
    return made


def export_file(df: DataFrame, path: str, ord_col: str) -> int:
    """One local .json (array) or .jsonl file in record order, replaced in one step; returns the number of records.

    Rows come to the driver one partition at a time. For results meant for people;
    large ones belong into ``write``.
    """
    array = path.endswith(".json")
    if not array and not path.endswith(".jsonl"):
        raise ValueError("the path must end in .json or .jsonl")
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    count = 0
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        for row in df.orderBy(ord_col).toLocalIterator():
            text = json.dumps({k: v for k, v in row.asDict(recursive=True).items() if v is not None}, ensure_ascii=False, default=str)
            f.write(("[\n" if array and not count else ",\n" if array else "") + text + ("" if array else "\n"))
            count += 1
        if array:
            f.write("\n]" if count else "[]")
    os.chmod(f.name, 0o644)
    os.replace(f.name, path)
    return count


def write_with_errors(good: DataFrame, bad: DataFrame, path: str) -> None:
    """Main output and, beside it, what could not be read. Both read what they have in common twice: checkpoint it before."""
    write(good, path, "jsonl")
    write(bad, path.rstrip("/") + ".dbg", "jsonl")
