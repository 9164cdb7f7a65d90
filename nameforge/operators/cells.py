"""Bounded cells for joins of records with equal block keys.

A block (for instance all records of one function name) may hold any share of the
rows. A block beyond ``cap`` rows is laid out by the size of its records: only
records of the same or of neighbouring size bins can match. Bins beyond ``cap`` rows
are cut into hash chunks, and each pair of chunks that has to meet is a *cell*. Every
pair of rows that can match meets in exactly one cell and no cell holds more than
about two chunks, so one task never takes in a whole hot block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Largest number of rows of chunk counts that are broadcast; beyond it they are joined by shuffle.
HOT_BROADCAST_ROWS = 20_000
CELL = ["cell_a", "cell_i", "cell_j"]


def _hot_lookup(df: DataFrame, hot: DataFrame, on: list[str]) -> DataFrame:
    """Left join of the chunk counts of hot blocks, broadcast only when their number is within bounds."""
    known = hot.limit(HOT_BROADCAST_ROWS + 1).collect()  # at most that many narrow rows
    if len(known) <= HOT_BROADCAST_ROWS:
        few = df.sparkSession.createDataFrame(known, hot.schema)
        return df.join(F.broadcast(few), on, "left")
    return df.join(hot, on, "left")


def size_bin(size: Column, band: tuple[int, int]) -> Column:
    """Bins of sizes of which only equal or neighbouring ones hold sizes with |x - y| <= up / down max(x, y); below 1 all share one."""
    up, down = band
    # A little wider than the band, so that rounding never puts two bins between matching sizes.
    return F.when(size >= 1, F.floor(F.ln(size) / F.lit(math.log(down / (down - up)) * 1.000001))).otherwise(-2).cast("int")


def self_cells(df: DataFrame, keys: DataFrame, block: str, id_col: str, cap: int, size: str | None = None, band: tuple[int, int] | None = None) -> DataFrame:
    """df with the columns ``CELL`` and side: the cells of a self-join within ``block``.

    keys: one row per row of df with at least ``block`` and ``size`` (a narrower
    projection, or an upper bound of df). band (up, down): rows whose sizes differ by
    more than up / down of the larger need not meet. In a cell of side 0 all rows pair
    among themselves; else side 1 pairs with side 2.
    """

    def binned(d: DataFrame) -> DataFrame:
        return d.withColumn("_b", size_bin(F.col(size), band) if size else F.lit(0))

    per = binned(keys).groupBy(block, "_b").agg(F.count("*").alias("_n"))
    near = Window.partitionBy(block).orderBy("_b")

    def chunks(n: Column) -> Column:
        return F.ceil(n / cap).cast("int")

    hot = (
        per.withColumn("_all", F.sum("_n").over(Window.partitionBy(block)))
        .withColumn("_up", F.when(F.lead("_b").over(near) == F.col("_b") + 1, chunks(F.lead("_n").over(near))).otherwise(0))
        .withColumn("_down", F.when(F.lag("_b").over(near) == F.col("_b") - 1, chunks(F.lag("_n").over(near))).otherwise(0))
        .where(F.col("_all") > cap)
        .select(block, "_b", chunks(F.col("_n")).alias("_own"), "_up", "_down")
    )
    out = _hot_lookup(binned(df), hot, [block, "_b"])
    cold = F.col("_own").isNull()
    out = out.withColumn("_c", F.when(cold, 0).otherwise(F.pmod(F.xxhash64(F.lit(29), F.col(id_col)), F.col("_own"))).cast("int"))

    def cell(a: Column, i: Column, j: Column, side) -> Column:
        return F.struct(a.cast("int").alias("cell_a"), i.cast("int").alias("cell_i"), j.cast("int").alias("cell_j"), side.cast("int").alias("side"))

    def each(n: str, one) -> Column:
        return F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.col(n) - 1), one)).otherwise(F.array().cast("array<struct<cell_a:int,cell_i:int,cell_j:int,side:int>>"))

    c, at = F.col("_c"), F.col("_b") * 2
    own = each("_own", lambda x: cell(at, F.least(c, x), F.greatest(c, x), F.when(c == x, 0).when(c < x, 1).otherwise(2)))
    up = each("_up", lambda x: cell(at + 1, c, x, F.lit(1)))
    down = each("_down", lambda x: cell(at - 1, x, c, F.lit(2)))
    lone = F.array(cell(F.lit(0), F.lit(0), F.lit(0), F.lit(0)))
    out = out.withColumn("_x", F.explode(F.when(cold, lone).otherwise(F.concat(own, up, down))))
    return out.select(*df.columns, "_x.*")


def cross_cells(df: DataFrame, keys: DataFrame, block: str, side: str, id_col: str, cap: int) -> DataFrame:
    """df with the columns ``CELL``: the cells of a join of side 1 with side 2 within ``block``."""
    hot = (
        keys.groupBy(block)
        .agg(F.count_if(F.col(side) == 1).alias("n0"), F.count_if(F.col(side) == 2).alias("n1"))
        .where((F.col("n0") > cap) | (F.col("n1") > cap))
        .select(block, F.greatest(F.lit(1), F.ceil(F.col("n0") / cap)).cast("int").alias("_k0"), F.greatest(F.lit(1), F.ceil(F.col("n1") / cap)).cast("int").alias("_k1"))
    )
    out = _hot_lookup(df, hot, [block]).fillna(1, ["_k0", "_k1"])
    zero = F.col(side) == 1
    own = F.pmod(F.xxhash64(F.lit(29), F.col(id_col)), F.when(zero, F.col("_k0")).otherwise(F.col("_k1"))).cast("int")
    out = out.withColumn("_c", own).withColumn("_x", F.explode(F.when(zero, F.expr("sequence(0, _k1 - 1)")).otherwise(F.expr("sequence(0, _k0 - 1)"))))
    return out.select(*df.columns, F.lit(0).alias("cell_a"), F.when(zero, F.col("_c")).otherwise(F.col("_x")).alias("cell_i"), F.when(zero, F.col("_x")).otherwise(F.col("_c")).alias("cell_j"))


def map_cells(df: DataFrame, block: str, work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str, carry: list[str], rows: int = 4096) -> DataFrame:
    """Runs ``work(table, cell codes)`` over whole cells, many small cells at a time.

    Rows are hash-partitioned and sorted by cell; each call sees all rows of the
    cells in it and at least ``rows`` rows unless the partition ends.
    """
    key = [block, *CELL]
    ready = df.select(*key, *carry).repartition(*key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def codes(t: pa.Table) -> np.ndarray:
            new = np.zeros(t.num_rows, dtype=bool)
            for x in (t.column(block).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(), *(t.column(c).to_numpy() for c in CELL)):
                new[1:] |= x[1:] != x[:-1]
            return np.cumsum(new)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count < rows:
                continue
            t = pa.Table.from_batches(held)
            c = codes(t)
            cut = int(np.searchsorted(c, c[-1]))  # the last cell may go on in the next batch
            if cut:
                yield from work(t.slice(0, cut), c[:cut])
            rest = t.slice(cut).combine_chunks()
            held, count = rest.to_batches(), rest.num_rows
        if held:
            t = pa.Table.from_batches(held)
            yield from work(t, codes(t))

    return ready.mapInArrow(run, schema)


def squeeze(text: Column, also: str = "") -> Column:
    """Without ASCII white space (and the characters in ``also``), in lower case."""
    return F.lower(F.translate(text, " \t\n\r\x0b\x0c" + also, ""))
