"""Splits that keep related records together: random-mate contraction and cumulative weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nameforge.functions.names import WHITE
from nameforge.session import Scratch, checkpoint

#: Rounds whose mappings are unwound in one plan.
UNWIND = 3


def tie_key(value: Column, path: bool = False) -> Column:
    """The form in which values tie records: trimmed, lower case, ``-``, ``_`` and blank alike; NULL if blank.

    path: only what follows the last ``/`` or ``\\`` counts.
    """
    if path:
        value = F.regexp_extract(value, r"([^/\\]*)$", 1)
    value = F.lower(F.btrim(value, F.lit(WHITE)))
    return F.when(value != "", F.translate(value, "_ ", "--"))


def contract(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(v, root) of every vertex that an edge (a, b) touches: vertices of one component share a root.

    First every vertex with a single neighbour collapses into it. Then in each round
    every vertex tosses a coin by hash; a vertex with tails collapses into its
    smallest neighbour with heads, edges are renamed and made distinct, until none is
    left. A round writes one table to the shared folder, its edges with the vertices
    they collapse into; the number of edges left comes from that same write. The
    mappings are unwound backwards, each no larger than the one before. Nothing is held
    by the driver but the number of edges left.
    """
    scratch = Scratch(edges.sparkSession)
    left = edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    done: list[DataFrame] = []
    count = 1
    while count:
        if len(done) > rounds:
            raise RuntimeError(f"edges are left after {rounds} rounds")
        now = left.distinct()
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not done:
            into = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p"), F.count("*").alias("n")).where("n = 1")
            # Of two vertices that have only each other the smaller stays.
            pair = into.select(F.col("v").alias("p"), F.col("p").alias("v"), F.lit(True).alias("mutual"))
            into = into.join(pair, ["v", "p"], "left").where("mutual IS NULL OR p < v").select("v", "p")
        else:

            def heads(c: str, at: int = len(done)) -> Column:
                return F.pmod(F.xxhash64(F.lit(at), F.col(c)), F.lit(2)) == 1

            into = both.where(~heads("a") & heads("b")).groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p"))
        for c in ("a", "b"):
            now = now.join(into.select(F.col("v").alias(c), F.col("p").alias(f"p{c}")), c, "left")
        table, count = scratch.write_counting(now.select("a", "b", F.coalesce("pa", "a").alias("pa"), F.coalesce("pb", "b").alias("pb")), F.col("pa") != F.col("pb"))
        done.append(table)
        left = table.where("pa != pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))

    def ends(t: DataFrame) -> DataFrame:
        """(v, p): what each vertex of a round became."""
        return t.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("pa").alias("p")), F.struct(F.col("b").alias("v"), F.col("pb").alias("p")))).alias("e")).select("e.v", "e.p").distinct()

    roots = ends(done[-1]).select("v", F.col("p").alias("root"))
    for k, t in enumerate(reversed(done[:-1]), 1):
        # A vertex that the next round does not know has lost its last edge: what it became is its root.
        roots = ends(t).join(roots.select(F.col("v").alias("p"), "root"), "p", "left").select("v", F.coalesce("root", "p").alias("root"))
        if k % UNWIND == 0:
            roots = scratch.write(roots)
    return roots


def components(df: DataFrame, id_col: str, keys: list[Column]) -> DataFrame:
    """(id, first_id, size): every record with the smallest id and the size of its component.

    Records are tied by equal non-null values of any one of ``keys`` (key 1 of one
    with key 1 of the other, and so on), and ties carry on. A record without any key
    is a component of its own. Ids must be unique and not null.
    """
    n = len(keys)
    rows = df.select(F.col(id_col).alias("id"), *(k.alias(f"k{i}") for i, k in enumerate(keys)))
    # A vertex is a value of a key, numbered by the smallest id that has it; combined before any shuffle.
    values = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"k{i}").alias("k")) for i in range(n))))
    vertex = checkpoint(rows.select("id", values.alias("x")).where(F.col("x.k").isNotNull()).groupBy("x.i", "x.k").agg((F.min("id") * n + F.first("x.i")).alias("v"), F.min("id").alias("least")))
    linked = rows.select(*(f"k{i}" for i in range(n))).distinct()
    for i in range(n):
        linked = linked.join(vertex.where(F.col("i") == i).select(F.col("k").alias(f"k{i}"), F.col("v").alias(f"v{i}")), f"k{i}", "left")
    spokes = F.filter(F.array(*(f"v{i}" for i in range(n))), lambda x: x.isNotNull())
    edges = linked.select(spokes.alias("s")).where(F.size("s") > 1).select(F.col("s")[0].alias("a"), F.explode(F.slice("s", 2, n)).alias("b"))
    roots = contract(edges)
    label = vertex.join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
    first = label.groupBy("root").agg(F.min("least").alias("first_id"))
    label = checkpoint(label.join(first, "root").select("i", "k", "first_id"))
    # Each record is looked up once, by the first key that it has.
    which = F.coalesce(*(F.when(F.col(f"k{i}").isNotNull(), i) for i in range(n)))
    out = rows.select("id", which.alias("i"), F.coalesce(*(f"k{i}" for i in range(n))).alias("k")).join(label, ["i", "k"], "left").select("id", F.coalesce("first_id", "id").alias("first_id"))
    return out


def assign(groups: DataFrame, targets: list[tuple[str, float]], digits: int = 2) -> DataFrame:
    """(first_id, split): components (first_id, size) over splits with target shares of the total size.

    All components line up by size, largest first, then by digest, and are cut where their cumulative
    weight reaches the shares, that of the largest share first; a component stands at
    the middle of its weight. So the cuts fall among small components, and the shares
    are met to about the size of one, unless a single component is larger than the
    first share. The largest components are therefore all in the split with the largest
    share. Shares are normalised; no target gives an error.
    """
    if not targets:
        raise ValueError("no split to assign to")
    scale = sum(w for _, w in targets) or 1
    # The running weight in two steps: over (size, first digits of the digest), then inside each of them.
    line = groups.withColumn("h", F.md5(F.col("first_id").cast("string"))).withColumn("piece", F.substring("h", 1, digits))
    order = Window.orderBy(F.desc("size"), "piece")
    sums = line.groupBy("size", "piece").agg(F.sum("size").alias("w")).withColumn("before", F.sum("w").over(order) - F.col("w")).withColumn("all", F.sum("w").over(Window.partitionBy()))
    inside = F.row_number().over(Window.partitionBy("size", "piece").orderBy("h", "first_id"))
    at = line.withColumn("k", inside).join(sums, ["size", "piece"]).withColumn("at", (F.col("before") + (F.col("k") - 0.5) * F.col("size")) / F.col("all"))
    split, bound = F.lit(None).cast("string"), 0.0
    names = sorted(targets, key=lambda t: (-t[1], t[0]))
    for name, share in names[:-1]:
        bound += share / scale
        split = F.coalesce(split, F.when(F.col("at") < bound, F.lit(name)))
    return at.select("first_id", F.coalesce(split, F.lit(names[-1][0])).alias("split"))
