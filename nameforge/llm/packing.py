"""Filling containers of fixed capacity: grouping genetic algorithm on islands with elite migration."""

from __future__ import annotations

import random
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce
from operator import mul

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nameforge.session import checkpoint

#: Items of a shard (all islands of a shard pack the same items); islands a shard; individuals an island; generations without a better packing that end an island's epoch.
SHARD, ISLANDS, POPULATION, PATIENCE = 1000, 3, 4, 10
#: Fitness that differs by less is the same.
EPS = 1e-12
#: Island states a task evolves.
PER_TASK = 8
#: Containers filled less than this go into the last, merged round.
KEEP = 0.995

Bins = list[list[int]]


def best_fit(bins: Bins, room: list[int], items: list[int], size: list[int], capacity: int) -> None:
    """Puts items, largest first, where the least room is left; opens a container where nothing fits."""
    # Room and container in one whole number, as those compare faster than pairs, and small ones faster still.
    shift = (len(bins) + len(items)).bit_length()
    mask = (1 << shift) - 1
    free = sorted(r << shift | b for b, r in enumerate(room) if r)
    own = set()  # containers may be shared with other packings
    for i in sorted(items, key=size.__getitem__, reverse=True):
        s = size[i]
        k = bisect_left(free, s << shift)
        if k < len(free):
            x = free.pop(k)
            r, b = x >> shift, x & mask
        elif s == 0 and bins:
            r, b = 0, 0
        else:
            r, b = capacity, len(bins)
            bins.append([])
            room.append(capacity)
            own.add(b)
        if b in own:
            bins[b].append(i)
        else:
            bins[b] = [*bins[b], i]
            own.add(b)
        room[b] = r - s
        if r > s:
            insort(free, r - s << shift | b)


def _square(fill: list[int], capacity: int) -> float:
    return sum(map(mul, fill, fill)) / capacity**2 / max(1, len(fill))


def fitness(bins: Bins, size: list[int], capacity: int) -> float:
    """Mean square of the fill: prefers few containers, and full ones."""
    return _square([sum(size[i] for i in b) for b in bins], capacity)


def ideal(size: list[int], capacity: int) -> float:
    """The fitness that no packing passes: the least number of containers, all full but one."""
    full, rest = divmod(sum(size), capacity)
    return (full + (rest / capacity) ** 2) / max(1, full + (rest > 0))


class Packing:
    """A packing with what its children need: the room left in each container, the container of each item, the better filled half of the containers, and all of them from the emptiest on."""

    __slots__ = ("bins", "room", "where", "good", "rising", "fit")

    def __init__(self, bins: Bins, room: list[int], n: int, capacity: int) -> None:
        self.bins, self.room, self.where = bins, room, _labels(bins, n)
        order = range(len(bins))
        self.good = sorted(order, key=room.__getitem__)[: max(1, len(bins) // 2)]
        self.rising = sorted(order, key=room.__getitem__, reverse=True)
        self.fit = _square([capacity - r for r in room], capacity)


def _fitted(room: list[int], sizes: list[int], capacity: int) -> float:
    """The fitness that ``best_fit`` comes to, by sizes alone: which item goes into which container is left open."""
    n = len(room)
    free = sorted(r for r in room if r)
    for s in sorted(sizes, reverse=True):
        k = bisect_left(free, s)
        if k < len(free):
            r = free.pop(k)
        elif s == 0 and n:
            continue
        else:
            n += 1
            r = capacity
        if r > s:
            insort(free, r - s)
    fill = [capacity - r for r in free]
    return ((n - len(free)) * capacity**2 + sum(map(mul, fill, fill))) / capacity**2 / max(1, n)


def cross(a: Packing, b: Packing, size: list[int], capacity: int, least: float, rng: random.Random) -> Packing | None:
    """A child of a, if it is fitter than ``least``: whole well-filled containers of b come in, containers of a with the same items go, what they held besides is fitted in again."""
    come = [k for k in b.good if rng.random() < 0.5] or [b.good[0]]
    taken = set().union(*(b.bins[k] for k in come))
    gone = {a.where[i] for i in taken}
    stay = [k for k in a.rising if k not in gone]
    loose = [i for k in sorted(gone) for i in a.bins[k] if i not in taken]
    # Mutation: the emptiest of the kept containers are dissolved too.
    cut = min(len(stay), rng.randint(1, 3))
    for k in stay[:cut]:
        loose += a.bins[k]
    room = [b.room[k] for k in come] + [a.room[k] for k in stay[cut:]]
    # Most children are no better; their containers need not be made.
    if _fitted(room, [size[i] for i in loose], capacity) <= least:
        return None
    child = [b.bins[k] for k in come] + [a.bins[k] for k in stay[cut:]]
    best_fit(child, room, loose, size, capacity)
    return Packing(child, room, len(size), capacity)


def evolve(population: list[Bins], size: list[int], capacity: int, patience: int, rng: random.Random) -> list[Bins]:
    """The population, best first, once no packing can be better or so many generations brought no better one; the worst makes room for each child that is better."""
    ranked = [Packing(p, [capacity - sum(size[i] for i in b) for b in p], len(size), capacity) for p in population]
    ranked.sort(key=lambda x: -x.fit)
    best = ideal(size, capacity) - EPS
    stalled = 0
    while stalled < patience and ranked[0].fit < best:
        before = ranked[0].fit
        for _ in range(len(ranked)):
            x, y = rng.sample(range(len(ranked)), 2) if len(ranked) > 1 else (0, 0)
            child = cross(ranked[min(x, y)], ranked[max(x, y)], size, capacity, ranked[-1].fit, rng)
            if child is not None:
                ranked[-1] = child
                ranked.sort(key=lambda z: -z.fit)  # of equal ones the older stays in front
        stalled = 0 if ranked[0].fit > before + EPS else stalled + 1
    return [x.bins for x in ranked]


def start(size: list[int], capacity: int, count: int, rng: random.Random) -> list[Bins]:
    """Best fit in decreasing order, and the same with sizes blurred more and more."""
    out = []
    for k in range(count):
        blurred = sorted(range(len(size)), key=lambda i: -size[i] * (1 + rng.uniform(-1, 1) * 0.3 * k / max(1, count)))
        bins: Bins = []
        room: list[int] = []
        for part in range(0, len(blurred), 64 if k else len(blurred) or 1):
            best_fit(bins, room, blurred[part : part + (64 if k else len(blurred))], size, capacity)
        out.append(bins)
    return out


_STATE = "shard long, island int, ids array<long>, parts array<int>, sizes array<int>, population array<array<int>>, fit double, open boolean, was double"


def _labels(bins: Bins, n: int) -> list[int]:
    out = [0] * n
    for b, x in enumerate(bins):
        for i in x:
            out[i] = b
    return out


def _bins(labels: list[int]) -> Bins:
    out: Bins = [[] for _ in range(max(labels, default=-1) + 1)]
    for i, b in enumerate(labels):
        out[b].append(i)
    return [b for b in out if b]


def _whole(x: pa.ListScalar) -> list[int]:
    """The numbers of a list; its own ``as_py`` makes an object of each first."""
    return x.values.to_numpy().tolist()


def _epoch(state: DataFrame, capacity: int, population: int, patience: int, epoch: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grown, fit, opened = [], [], []
            for shard, island, sizes, held in zip(batch["shard"].to_pylist(), batch["island"].to_pylist(), batch["sizes"], batch["population"]):
                rng = random.Random(f"{seed} {epoch} {shard} {island}")
                size = _whole(sizes)
                # Only the first epoch starts anew; later ones go on with what the island has, immigrants included.
                come = [_bins(_whole(x)) for x in held] or start(size, capacity, population, rng)
                best = evolve(come, size, capacity, patience, rng)[:population]
                grown.append([_labels(p, len(size)) for p in best])
                fit.append(fitness(best[0], size, capacity))
                opened.append(fit[-1] < ideal(size, capacity) - EPS)
            new = {"population": pa.array(grown, pa.list_(pa.list_(pa.int32()))), "fit": pa.array(fit, pa.float64()), "open": pa.array(opened, pa.bool_())}
            yield pa.RecordBatch.from_arrays([new.get(c, batch[c]) for c in batch.schema.names], names=batch.schema.names)

    return state.mapInArrow(run, _STATE)


def _round(items: DataFrame, n: int, capacity: int, shard: int, islands: int, population: int, patience: int, seed: int) -> DataFrame:
    """(shard, bin, id, part, size): the best packing of every shard."""
    shards = max(1, -(-n // shard))
    # Shards are hash groups of about ``shard`` items, whatever the keys are like.
    grouped = items.groupBy(F.pmod(F.xxhash64(F.lit(seed), "id", "part"), F.lit(shards)).alias("shard")).agg(F.array_sort(F.collect_list(F.struct("id", "part", "size"))).alias("x"))
    state = grouped.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("x.id").alias("ids"), F.col("x.part").alias("parts"), F.col("x.size").alias("sizes"), F.array().cast("array<array<int>>").alias("population"), F.lit(0.0).alias("fit"), F.lit(True).alias("open"), F.lit(-1.0).alias("was"))
    parts = []
    epoch = 0
    while shards:
        # The states are small but costly: their number decides on the tasks, not their bytes.
        state = checkpoint(_epoch(state.repartition(max(1, -(-shards * islands // PER_TASK)), "shard", "island"), capacity, population, patience, epoch, seed))
        tops = state.groupBy("shard").agg(F.max_by("island", F.struct("fit", -F.col("island"))).alias("island"), F.max("fit").alias("top"), F.max("was").alias("was"), F.bool_and("open").alias("open"))
        # A shard goes on until no packing can be better, or an epoch of all its islands brought none.
        live = F.col("open") & (F.col("top") > F.col("was") + EPS)
        won = state.join(tops.where(~live), ["shard", "island"], "left_semi")
        rows = won.select("shard", F.explode(F.arrays_zip(F.element_at("population", 1).alias("bin"), F.col("ids").alias("id"), F.col("parts").alias("part"), F.col("sizes").alias("size"))).alias("x"))
        parts.append(rows.select("shard", "x.bin", "x.id", "x.part", "x.size"))
        going = tops.where(live).select("shard", F.col("top").alias("was"))
        shards = going.count()
        # The best of an island goes to the next one in the ring, whose worst makes room for it.
        moved = state.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.slice("population", 1, 1).alias("come"))
        held = F.slice("population", 1, max(1, population - 1))
        state = state.drop("was").join(going, "shard").join(moved, ["shard", "island"]).select("shard", "island", "ids", "parts", "sizes", F.concat(held, "come").alias("population"), "fit", "open", "was")
        epoch += 1
    return reduce(DataFrame.unionByName, parts)


def pack(sized: DataFrame, id_col: str, size_col: str, capacity: int = 2048, shard: int = SHARD, islands: int = ISLANDS, population: int = POPULATION, patience: int = PATIENCE, seed: int = 11) -> DataFrame:
    """(container, id, part, first, size): every item in a container of ``capacity``.

    An item larger than the capacity is cut into full containers and a rest; no
    other item is split. Sizes are whole numbers; null ids or sizes are left out,
    an item of size 0 goes into any container. ids must be unique. Shards of items
    are evolved on islands with elite migration until no packing can be better or none
    comes any more; then the containers that are not nearly full are dissolved over all
    shards and their items packed once more.
    """
    base = checkpoint(sized.where(F.col(size_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.greatest(F.lit(0), F.col(size_col)).cast("long").alias("n")))
    full = F.floor(F.col("n") / capacity)
    whole = base.where(full > 0).select("id", F.posexplode(F.sequence(F.lit(1), full)).alias("part", "_k")).select("id", "part", F.lit(capacity).alias("size"))
    items = checkpoint(base.where((F.col("n") % capacity > 0) | (F.col("n") == 0)).select("id", full.cast("int").alias("part"), (F.col("n") % capacity).cast("int").alias("size")))
    args = (capacity, shard, islands, population, patience)
    first = checkpoint(_round(items, items.count(), *args, seed))
    fill = first.groupBy("shard", "bin").agg(F.sum("size").alias("fill"))
    kept = first.join(fill.where(F.col("fill") >= KEEP * capacity), ["shard", "bin"], "left_semi")
    loose = checkpoint(first.join(kept.select("shard", "bin").distinct(), ["shard", "bin"], "left_anti").select("id", "part", "size"))
    last = _round(loose, loose.count(), *args, seed + 1)
    # Containers are numbered by round, shard and bin; those of cut items by item and part.
    out = kept.select(F.struct(F.lit(1).alias("r"), F.col("shard").alias("a"), F.col("bin").alias("b")).alias("container"), "id", "part", "size")
    out = out.unionByName(last.select(F.struct(F.lit(2).alias("r"), F.col("shard").alias("a"), F.col("bin").alias("b")).alias("container"), "id", "part", "size"))
    out = out.unionByName(whole.select(F.struct(F.lit(0).alias("r"), F.col("id").alias("a"), F.col("part").alias("b")).alias("container"), "id", "part", "size"))
    name = F.concat_ws("-", F.col("container.r").cast("string"), F.col("container.a").cast("string"), F.col("container.b").cast("string"))
    return out.select(name.alias("container"), "id", "part", (F.col("part").cast("long") * capacity).alias("first"), "size")


def fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, tokens, the least possible number of containers, and the mean fill."""
    total = F.sum("size")
    return packed.agg(F.countDistinct("container").alias("containers"), F.coalesce(total, F.lit(0)).alias("tokens"), F.coalesce(F.ceil(total / capacity), F.lit(0)).alias("least_containers"), (total / (F.countDistinct("container") * capacity)).alias("mean_fill"))
