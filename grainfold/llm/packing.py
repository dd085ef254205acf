"""Filling containers of equal capacity: a grouping genetic algorithm on islands.

Items are hashed to shards of about ``SHARD`` items. Each shard has ``ISLANDS`` islands that evolve
their own populations while that gives better packings; between epochs the elite of an island migrates to the next one, and at the
end the best elite of a shard is taken. A crossover injects the well-filled containers of one parent
whole, adds the containers of the other parent that share no item with them, dissolves those that
would duplicate an item, and best-fits the displaced items in order of size. The emptiest containers
of each shard are then pooled with those of its neighbours and packed again in the same way, so that
what stays unused doesn't grow with the number of shards.

Defined cases: an item of null, zero or negative size needs no space (container NULL, one piece of
size 0). An item larger than a container is cut into full containers of its own and a remainder that
is packed like any item. Repeated keys are packed as separate items.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainfold.plans.runtime import cut, ranges

SHARD, ISLANDS, EPOCHS = 2048, 2, 2
POPULATION, IDLE = 4, 100
WELL_FILLED, RELEASE_BELOW, RELEASE_MOST, POOL = 0.985, 0.97, 24, 64

Bins = list[list[int]]


def filling(bins: Bins, size: list[int]) -> list[int]:
    of = size.__getitem__
    return [sum(map(of, x)) for x in bins]


def best_fit(order: list[int], size: list[int], capacity: int, bins: Bins | None = None, fill: list[int] | None = None) -> Bins:
    """Put each item, in order, into the container that it fills best; fill is that of the bins, if known."""
    bins = [list(b) for b in bins or []]
    free = sorted((capacity - n, k) for k, n in enumerate(fill or filling(bins, size)) if n < capacity)
    for i in order:
        at = bisect_left(free, (size[i], -1))
        if at < len(free):
            left, k = free.pop(at)
            bins[k].append(i)
        else:
            left, k = capacity, len(bins)
            bins.append([i])
        if left > size[i]:
            insort(free, (left - size[i], k))
    return bins


def fitness(fill: list[int]) -> tuple[int, int]:
    """Fewest containers first, then those that are filled unevenly; larger is better."""
    return -len(fill), sum(n * n for n in fill)


def crossover(a: Bins, b: Bins, size: list[int], capacity: int, rng: np.random.Generator, fills: tuple[list[int], list[int]] | None = None) -> Bins:
    of_a, of_b = fills or (filling(a, size), filling(b, size))
    least = WELL_FILLED * capacity
    filled = [(x, n) for x, n in zip(a, of_a) if n >= least]
    chosen = [x for x, keep in zip(filled, rng.random(len(filled)) < 0.9) if keep]
    used = {i for x, _ in chosen for i in x}
    for x, n in zip(b, of_b):
        if n >= least and used.isdisjoint(x):
            chosen.append((x, n))
            used.update(x)
    displaced = [i for i in range(len(size)) if i not in used]
    noise = rng.uniform(0.8, 1.2, len(displaced))
    order = [displaced[k] for k in np.argsort([-size[i] * e for i, e in zip(displaced, noise)])]
    return best_fit(order, size, capacity, [x for x, _ in chosen], [n for _, n in chosen])


def evolve(size: list[int], capacity: int, seed: int, parents: list[Bins]) -> Bins:
    """The elite when it can't be better or IDLE crossovers in a row gave none; parents are elites of this island and of its neighbour."""
    rng = np.random.default_rng(seed)
    population = list(parents)
    if not population:
        population.append(best_fit(sorted(range(len(size)), key=lambda i: -size[i]), size, capacity))
    while len(population) < POPULATION:
        noise = rng.uniform(0.7, 1.3, len(size))
        population.append(best_fit([int(i) for i in np.argsort(-np.array(size) * noise)], size, capacity))
    ranked = sorted(((fitness(fill), x, fill) for x in population for fill in [filling(x, size)]), key=lambda x: x[0], reverse=True)
    # All containers full but one.
    full, rest = divmod(sum(size), capacity)
    ideal = -full - (rest > 0), full * capacity**2 + rest**2
    idle = 0
    while idle < IDLE and ranked[0][0] < ideal:
        (_, a, of_a), (_, b, of_b) = (ranked[k] for k in rng.choice(len(ranked), 2, replace=False))
        child = crossover(a, b, size, capacity, rng, (of_a, of_b))
        fill = filling(child, size)
        score, elite = fitness(fill), ranked[0][0]
        # Of packings alike one is kept: a crossover of equals has nothing to combine.
        if all(score != x[0] for x in ranked):
            ranked = sorted([*ranked, (score, child, fill)], key=lambda x: x[0], reverse=True)[:-1]
        idle = 0 if score > elite else idle + 1
    return ranked[0][1]


def island(capacity: int, seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One epoch of one island; columns shard, island, origin (-1: no parent yet), item, size, bin."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows[rows.origin == rows.origin.max()].sort_values("item")
        size = first["size"].tolist()
        parents = []
        for origin in sorted(x for x in rows.origin.unique() if x >= 0):
            own = rows[rows.origin == origin].sort_values("item")
            parents.append(split(own.bin.to_numpy()))
        at = int(rows.shard.iloc[0]) * 1009 + int(rows.island.iloc[0])
        elite = evolve(size, capacity, seed + at, parents)
        place = np.zeros(len(size), np.int32)
        for k, b in enumerate(elite):
            place[b] = k
        return first.assign(bin=place, origin=0)[["shard", "island", "origin", "item", "size", "bin"]]

    return run


def split(bin_of: np.ndarray) -> Bins:
    order = np.argsort(bin_of, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(bin_of[order])) + 1)]


STATE = "shard bigint, island int, origin int, item bigint, size bigint, bin int"


def pack_shards(items: DataFrame, capacity: int, seed: int) -> DataFrame:
    """(shard, item, size, bin, fill) of items (shard, item, size) after all epochs."""
    state = items.select("shard", F.explode(F.array(*map(F.lit, range(ISLANDS)))).alias("island"), F.lit(-1).alias("origin"), "item", "size", F.lit(-1).alias("bin"))
    for epoch in range(EPOCHS):
        state = state.groupBy("shard", "island").applyInPandas(island(capacity, seed + 7919 * epoch), STATE)
        if epoch < EPOCHS - 1:
            # The elite stays, and a copy of it goes to the next island.
            state = state.select("shard", "item", "size", "bin", F.explode(F.array(F.struct("island", F.lit(0).alias("origin")), F.struct(((F.col("island") + 1) % ISLANDS).alias("island"), F.lit(1).alias("origin")))).alias("to")).select("shard", "to.island", "to.origin", "item", "size", "bin")

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        fill = rows.groupby(["island", "bin"])["size"].sum()
        score = pd.DataFrame({"n": fill.groupby("island").size(), "even": (fill.astype(float) ** 2).groupby("island").sum()}).sort_values(["n", "even"], ascending=[True, False], kind="stable")
        own = rows[rows.island == score.index[0]].copy()
        own["fill"] = own.groupby("bin")["size"].transform("sum")
        return own[["shard", "item", "size", "bin", "fill"]]

    return state.groupBy("shard").applyInPandas(best, "shard bigint, item bigint, size bigint, bin int, fill bigint")


def pack(df: DataFrame, key: str, size: str, capacity: int, seed: int = 0) -> DataFrame:
    """(key, piece_no, piece_size, container, container_fill) of every row; see the module for the defined cases."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    sized = df.select(F.col(key).alias("key"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("all"), F.monotonically_increasing_id().alias("item"))
    sized = cut(sized)
    shards = ranges(sized, SHARD)
    whole = F.when(F.col("all") > capacity, F.floor(F.col("all") / capacity)).otherwise(F.lit(0)).cast("bigint")
    items = sized.withColumn("whole", whole).withColumn("size", F.col("all") - F.col("whole") * capacity)
    shard = F.pmod(F.xxhash64("item"), F.lit(shards))
    packed = cut(pack_shards(items.where("size > 0").select(shard.alias("shard"), "item", "size"), capacity, seed))
    # The emptiest containers of each shard are opened again and packed with those of other shards.
    bins = packed.groupBy("shard", "bin").agg(F.first("fill").alias("fill"))
    worst = bins.where(F.col("fill") < RELEASE_BELOW * capacity).withColumn("n", F.row_number().over(Window.partitionBy("shard").orderBy("fill", "bin"))).where(F.col("n") <= RELEASE_MOST).select("shard", "bin")
    kept = packed.join(worst, ["shard", "bin"], "left_anti").select("item", F.concat_ws("-", F.lit("a"), "shard", "bin").alias("container"), "fill")
    opened = packed.join(worst, ["shard", "bin"], "left_semi").select(F.floor(F.col("shard") / POOL).cast("bigint").alias("shard"), "item", "size")
    again = pack_shards(opened, capacity, seed + 1).select("item", F.concat_ws("-", F.lit("b"), "shard", "bin").alias("container"), "fill")
    placed = items.join(kept.union(again), "item", "left")
    piece = F.struct(F.col("whole").cast("int").alias("piece_no"), F.col("size").alias("piece_size"), "container", F.col("fill").alias("container_fill"))
    full = F.transform(
        F.when(F.col("whole") > 0, F.sequence(F.lit(0), (F.col("whole") - 1).cast("int"))).otherwise(F.array().cast("array<int>")),
        lambda k: F.struct(k.alias("piece_no"), F.lit(capacity).cast("bigint").alias("piece_size"), F.concat_ws("-", F.lit("x"), F.col("item"), k).alias("container"), F.lit(capacity).cast("bigint").alias("container_fill")),
    )
    rest = F.when((F.col("size") > 0) | (F.col("whole") == 0), F.array(piece)).otherwise(F.array().cast("array<struct<piece_no:int,piece_size:bigint,container:string,container_fill:bigint>>"))
    return placed.select(F.col("key").alias(key), F.explode(F.concat(full, rest)).alias("p")).select(key, "p.*")
