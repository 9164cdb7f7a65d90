"""Record lists in JSON files: arrays, single objects, one object a line."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SUFFIXES = {".json": "json", ".result": "json", ".decompiled": "json", ".jsonl": "jsonl"}


def detect(spark: SparkSession, path: str) -> str:
    """json or jsonl, by the first two non-blank lines of a file on any file system and its name."""
    heads = spark.read.text(path).where(F.trim("value") != "").limit(2).collect()
    first = heads[0]["value"].strip() if heads else ""
    if first.startswith("["):
        return "json"
    lined = path.endswith(".jsonl")
    if not first:
        return "jsonl" if lined else "json"
    try:
        value = json.loads(first)
    except ValueError:
        return "json"
    return "jsonl" if isinstance(value, dict) and (lined or len(heads) > 1) else "json"


def read_lines(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """One object a line. strict: a bad line is an error; else it is a row with ``_corrupt_record``."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    shape = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    with_bad = StructType([*shape.fields]).add("_corrupt_record", "string")
    return spark.read.schema(with_bad).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_array(spark: SparkSession, path: str, schema: StructType | str, glob: str | None = None) -> DataFrame:
    """Whole files with an array of objects or one object, by folder if wanted; each row with its file's path."""
    reader = spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST")
    if glob:
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return reader.json(path).withColumn("_file", F.col("_metadata.file_path"))


def read_list(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One file that must hold an array of objects; anything else is an error."""
    head = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    if not head or not head[0]["value"].lstrip().startswith("["):
        raise ValueError(f"{path}: not a list")
    return read_array(spark, path, schema).drop("_file")


def read_by_suffix(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Records of a file or folder by its ending: arrays (.json, .result, .decompiled) or lines (.jsonl); another ending has none."""
    kind = SUFFIXES.get(os.path.splitext(path.rstrip("/"))[1].lower())
    if kind == "json":
        return read_array(spark, path, schema).drop("_file")
    return read_lines(spark, path, schema) if kind == "jsonl" else spark.createDataFrame([], schema)


def read_clusters(spark: SparkSession, path: str, most: int = 20_000) -> dict[str, list[int]]:
    """The word clusters of a JSON file {word: [numbers]}, a side table of at most ``most`` words, for ``similarity.cluster_match``."""
    entries = spark.read.text(path, wholetext=True).select(F.explode(F.map_entries(F.from_json("value", "map<string,array<int>>"))).alias("e"))
    rows = entries.select("e.key", "e.value").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} words")
    return {r["key"]: r["value"] for r in rows}


def read_any(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Files of any of the forms. In an array, objects count, lists in it are flattened one level, other values are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out = [json.dumps(r, ensure_ascii=False) for r in _records(text, name)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(out)), pa.array(range(len(out)), pa.int64()), pa.array(out)], names=["_file", "ord", "_r"])

    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("_file"), "value")
    rows = texts.mapInArrow(run, "_file string, ord long, _r string")
    return rows.select("_file", "ord", F.from_json("_r", schema).alias("_r")).select("_file", "ord", "_r.*")


def _records(text: str, name: str) -> Iterator[dict]:
    try:
        whole = json.loads(text)
    except ValueError:
        for k, line in enumerate(text.splitlines(), 1):
            if not line.strip():
                continue
            try:
                value = json.loads(line)
            except ValueError as e:
                raise ValueError(f"{name}, line {k}: {e}") from None
            if not isinstance(value, dict):
                raise ValueError(f"{name}, line {k}: not an object")
            yield value
        return
    if isinstance(whole, dict):
        yield whole
    elif isinstance(whole, list):
        for x in whole:
            if isinstance(x, dict):
                yield x
            elif isinstance(x, list):
                yield from (y for y in x if isinstance(y, dict))
    else:
        raise ValueError(f"{name}: neither a list nor an object")


def iter_array(stream, chunk: int = 1 << 20) -> Iterator[object]:
    """The values of one JSON array read piece by piece: memory holds one value and a chunk."""
    decoder = json.JSONDecoder()
    text, at, end = "", 0, False

    def more() -> bool:
        nonlocal text, at, end
        got = stream.read(chunk)
        end = not got
        text, at = text[at:] + got, 0
        return not end

    def peek() -> str:
        nonlocal at
        while True:
            while at < len(text) and text[at].isspace():
                at += 1
            if at < len(text):
                return text[at]
            if not more():
                raise ValueError("the array does not end")

    if peek() != "[":
        raise ValueError("not an array")
    at += 1
    if peek() == "]":
        return
    while True:
        peek()
        while True:
            try:
                value, stop = decoder.raw_decode(text, at)
                if stop < len(text) or end:
                    break
            except ValueError:
                if end:
                    raise
            if not more() and at >= len(text):
                raise ValueError("the array does not end")
        at = stop
        yield value
        mark = peek()
        at += 1
        if mark == "]":
            return
        if mark != ",":
            raise ValueError(f"{mark!r} between two values")


def discover(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, length, modificationTime) of files under a root, without their content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "length", "modificationTime")


#: Endings of program files; no ending counts too.
PROGRAM_ENDINGS = ("exe", "dll", "so", "bin", "elf", "out")


def program_files(files: DataFrame) -> DataFrame:
    """Files that may be programs, by their ending in any letter case, in path order."""
    name = F.element_at(F.split("path", "/"), -1)
    ending = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    return files.where(~F.contains(name, F.lit(".")) | ending.isin(*PROGRAM_ENDINGS)).orderBy("path")
