"""Per-key results where a few keys hold most rows.

Rows are range-partitioned on (key, secondary order, id) by sampled quantiles, so a
heavy key is split over as many partitions as its share deserves. Every partition
is one contiguous piece of the global order: keys inside it are complete, only its
first and last key may go on next door. Those edge states, at most two a partition,
are stitched; nothing else crosses a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nameforge.session import checkpoint


def ranged(df: DataFrame, key: str, order: list[str], tie: str) -> DataFrame:
    """df range-partitioned and sorted by key, order and tie, in the shared folder (two passes must see the same pieces)."""
    by = [key, *order, tie]
    return checkpoint(df.select(*dict.fromkeys(by)).repartitionByRange(*by).sortWithinPartitions(*by), eager=True)


def _segments(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.Table]]:
    """(key, its rows) in order; a partition's rows are sorted by key."""
    held: list[pa.Table] = []
    name: object = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        codes = t.column(key).combine_chunks().dictionary_encode()
        ix = codes.indices.to_numpy()
        cuts = np.flatnonzero(np.append(True, ix[1:] != ix[:-1]))
        for s, e in zip(cuts, np.append(cuts[1:], len(ix)), strict=True):
            k = codes.dictionary[int(ix[s])].as_py()
            if held and k != name:
                yield name, pa.concat_tables(held)
                held = []
            name = k
            held.append(t.slice(int(s), int(e - s)))
    if held:
        yield name, pa.concat_tables(held)


def _edges(items: Iterator[tuple[object, pa.Table]]) -> Iterator[tuple[object, pa.Table, bool]]:
    """With whether the segment is the partition's first or last."""
    ahead = next(items, None)
    first = True
    while ahead is not None:
        now, ahead = ahead, next(items, None)
        yield (*now, first or ahead is None)
        first = False


def medians(df: DataFrame, key: str, value: str, tie: str) -> DataFrame:
    """(key, rows, median) of every non-null key; the median of its non-null values as double, NULL without any.

    The middle two values are averaged. Edge keys take a second pass over the same
    pieces, which reads off the wanted ranks; those ranks are at most four for every
    partition and travel with the tasks.
    """
    pieces = ranged(df.where(F.col(key).isNotNull()), key, [value], tie)
    kind = dict(df.dtypes)[key]

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        rows = []
        for k, t, edge in _edges(_segments(batches, key)):
            col = t.column(value)
            have = len(col) - col.null_count
            mid = None
            if not edge and have:
                v = col.drop_null().to_numpy()
                mid = (float(v[(have - 1) // 2]) + float(v[have // 2])) / 2
            rows.append((pid, k, t.num_rows, have, edge, mid))
            if len(rows) >= 10_000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    def _batch(rows):
        c = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1]), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.bool_()), pa.array(c[5], pa.float64())], names=["pid", key, "rows", "have", "edge", "median"])

    states = checkpoint(pieces.mapInArrow(first_pass, f"pid int, {key} {kind}, rows long, have long, edge boolean, median double"))
    edge = states.where("edge")
    upto = Window.partitionBy(key).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(key)
    placed = (
        edge.withColumn("before", F.coalesce(F.sum("have").over(upto), F.lit(0)))
        .withColumn("all", F.sum("have").over(whole))
        .withColumn("rank", F.explode(F.array(F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2))))
        .where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("have")))
        .select("pid", key, (F.col("rank") - F.col("before")).alias("at"))
    )
    wanted: dict[int, dict[object, list[int]]] = {}
    for r in placed.collect():  # at most four small rows a partition, whatever the data: 10,000 partitions have 40,000
        wanted.setdefault(r["pid"], {}).setdefault(r[key], []).append(r["at"])
    shared = df.sparkSession.sparkContext.broadcast(wanted)  # one copy an executor, not one a task

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value.get(TaskContext.get().partitionId())
        if not mine:
            for _ in batches:
                pass
            return
        keys, values = [], []
        for k, t in _segments(batches, key):
            for at in mine.get(k, ()):
                keys.append(k)
                values.append(float(t.column(value).drop_null()[at].as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values, pa.float64())], names=[key, "v"])

    picked = pieces.mapInArrow(second_pass, f"{key} {kind}, v double").groupBy(key).agg(F.avg("v").alias("median"))
    stitched = edge.groupBy(key).agg(F.sum("rows").alias("rows")).join(picked, key, "left")
    return states.where("not edge").select(key, "rows", "median").unionByName(stitched)


def distincts(df: DataFrame, key: str, values: list[str], tie: str) -> DataFrame:
    """(key, distinct): distinct combinations of values per non-null key; nulls count as equal values.

    A run of equal values that crosses a partition border is counted on both sides
    and taken off once where the states are stitched.
    """
    pieces = ranged(df.where(F.col(key).isNotNull()), key, values, tie)
    kind = dict(df.dtypes)[key]

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        rows = []

        def batch() -> pa.RecordBatch:
            c = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1]), pa.array(c[2], pa.int64()), pa.array(c[3]), pa.array(c[4])], names=["pid", key, "n", "first", "last"])

        for k, t in _segments(batches, key):
            new = np.zeros(t.num_rows, dtype=bool)
            new[0] = True
            for c in values:
                ix = t.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= ix[1:] != ix[:-1]
            ends = [repr([t.column(c)[at].as_py() for c in values]) for at in (0, t.num_rows - 1)]
            rows.append((pid, k, int(new.sum()), *ends))
            if len(rows) >= 10_000:
                yield batch()
                rows = []
        if rows:
            yield batch()

    out = pieces.mapInArrow(states, f"pid int, {key} {kind}, n long, first string, last string")
    # A key has one state for each partition it reaches, so this window is as small as their number.
    again = F.when(F.lag("last").over(Window.partitionBy(key).orderBy("pid")) == F.col("first"), 1).otherwise(0)
    return out.withColumn("_again", again).groupBy(key).agg((F.sum("n") - F.sum("_again")).alias("distinct"))


def heavy(counts: DataFrame, rows: str, total: int, share: float = 0.01) -> DataFrame:
    """The keys that hold at least ``share`` of ``total`` rows."""
    return counts.where(F.col(rows) >= share * total)
