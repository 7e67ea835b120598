"""Pairs of hashes for labels: strata by distance, drawn without listing all pairs where that can be, and exactly where it must."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import scalars as S
from siltstone.operators import similarity as N
from siltstone.operators.review import block_pairs
from siltstone.sources.shared import written

#: The greatest distances of the first two strata, and their names; the first is left to the clusters.
NEAR, BOUNDARY = 10, 25
STRATA = ("near_duplicate", "boundary", "negative_control")
#: Pairs of a stratum, draws of the first round and of the last, and rows of a block.
EACH, FIRST, MOST, BLOCK = 60, 20_000, 1 << 22, 2048


def stratum(distance):
    """The stratum of a distance."""
    return F.when(distance <= NEAR, STRATA[0]).when(distance <= BOUNDARY, STRATA[1]).otherwise(STRATA[2])


def drawn(items: DataFrame, draws: int, seed: int) -> DataFrame:
    """(draw, a, b, distance, stratum) of a seeded row of draws from all pairs of (id, h, cluster).

    Each draw names two ids between the least and the greatest; those that meet no two
    rows, a pair drawn before, or two rows of one cluster are passed over.
    """
    low, high = items.agg(F.min("id"), F.max("id")).first()
    pick = lambda k: F.pmod(F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("id").cast("string"), F.lit(k))), 1, 12), 16, 10).cast("long"), F.lit(int(high) - int(low) + 1)) + F.lit(int(low))
    named = items.sparkSession.range(draws).select(F.col("id").alias("draw"), pick("a").alias("x"), pick("b").alias("y"))
    named = named.filter("x <> y").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("draw").alias("draw"))
    side = lambda c: items.select(F.col("id").alias(c), F.col("h").alias(f"h{c}"), F.col("cluster").alias(f"c{c}"))
    pairs = named.join(side("a"), "a").join(side("b"), "b").filter("ca IS NULL OR cb IS NULL OR ca <> cb")
    pairs = pairs.select("draw", "a", "b", S.hamming(F.col("ha"), F.col("hb")).alias("distance"))
    return pairs.withColumn("stratum", stratum(F.col("distance"))).filter(F.col("stratum") != STRATA[0])


def first_each(pairs: DataFrame, order: str, each: int) -> DataFrame:
    """The first pairs of each stratum by a column, chosen in two steps."""
    salted = pairs.withColumn("_s", F.pmod(F.xxhash64("a", "b"), F.lit(32)))
    some = salted.withColumn("_r", F.row_number().over(Window.partitionBy("stratum", "_s").orderBy(order, "a", "b"))).filter(F.col("_r") <= each)
    return some.withColumn("_r", F.row_number().over(Window.partitionBy("stratum").orderBy(order, "a", "b"))).filter(F.col("_r") <= each).drop("_s", "_r")


def mixed(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """A number that puts pairs into an order of chance; at most 62 bits."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(seed))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return (x >> np.uint64(2)).astype(np.int64)


def listed(items: DataFrame, seed: int, keep: int, block: int = BLOCK) -> DataFrame:
    """(draw, a, b, distance, stratum, n): of each pair of blocks and stratum, the number of its pairs and the ``keep`` first by chance.

    All pairs are looked at, in blocks, each of which passes on a bounded number.
    """
    rows = items.select(F.lit(0).cast("long").alias("grp"), "id", F.struct("h", "cluster").alias("v"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        side, ids = part["side"].to_numpy(), part["id"].to_numpy()
        h = np.array([v["h"] for v in part["v"]], dtype=np.int64).view(np.uint64)
        own = np.array([v["cluster"] is None for v in part["v"]])
        cluster = np.array([v["cluster"] or 0 for v in part["v"]], dtype=np.int64)
        first, second = np.flatnonzero(side & 1 > 0), np.flatnonzero(side & 2 > 0)
        distance = np.bitwise_count(h[first][:, None] ^ h[second][None, :]).astype(np.int64)
        ok = own[first][:, None] | own[second][None, :] | (cluster[first][:, None] != cluster[second][None, :])
        ok &= (ids[first][:, None] < ids[second][None, :]) if (side == 3).all() else ids[first][:, None] != ids[second][None, :]
        out = []
        for name, low, high in ((STRATA[1], NEAR, BOUNDARY), (STRATA[2], BOUNDARY, 64)):
            x, y = np.nonzero(ok & (distance > low) & (distance <= high))
            a, b = np.minimum(ids[first][x], ids[second][y]), np.maximum(ids[first][x], ids[second][y])
            chance = mixed(a, b, seed)
            at = np.argsort(chance, kind="stable")[:keep]
            out.append(pd.DataFrame({"draw": chance[at], "a": a[at], "b": b[at], "distance": distance[x, y][at], "stratum": name, "n": len(x)}))
        return pd.concat(out)

    return block_pairs(rows, block).groupBy("grp", "i", "j").applyInPandas(run, "draw long, a long, b long, distance long, stratum string, n long")


def stratified_pairs(items: DataFrame, each: int = EACH, seed: int = 42, first: int = FIRST, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """(stratum, draw, a, b, distance): ``each`` pairs of each stratum, or all if it has fewer.

    ``items`` has (id, h, cluster); pairs of one cluster are left out, rows without one are
    in none. Draws go on in rounds, four times as many each, until every stratum is full.
    Where listing all pairs costs no more than the next round, or ``most`` draws left a
    stratum short, all pairs are gone through in blocks, and a stratum that is short
    gets its other pairs by chance, with draws numbered on. Rows without a hash are in no
    pair; ids are there once.
    """
    items = written(items.filter("h IS NOT NULL").select(F.col("id").cast("long"), F.col("h").cast("long"), F.col("cluster").cast("long")))
    n, draws = items.count(), first
    if n < 2:
        return items.sparkSession.createDataFrame([], "stratum string, draw long, a long, b long, distance int")
    while True:
        found = written(first_each(drawn(items, draws, seed), "draw", each))
        sizes = {r["stratum"]: r["count"] for r in found.groupBy("stratum").count().collect()}
        short = [s for s in STRATA[1:] if sizes.get(s, 0) < each]
        if not short or 4 * draws > most or n * (n - 1) // 2 <= 4 * draws:
            break
        draws *= 4
    out = found.select("stratum", "draw", "a", "b", F.col("distance").cast("int").alias("distance"))
    if not short:
        return out
    # those already drawn are fewer than ``each``, so twice as many of each pair of blocks are enough
    more = listed(items, seed, 2 * each, block).filter(F.col("stratum").isin(*short)).join(found.select("a", "b"), ["a", "b"], "left_anti")
    more = first_each(more, "draw", each)
    place = Window.partitionBy("stratum").orderBy("draw", "a", "b")  # at most ``each`` rows of a stratum
    left = F.when(F.lit(False), 0)
    for s in STRATA[1:]:
        left = left.when(F.col("stratum") == s, each - sizes.get(s, 0))
    more = more.withColumn("_r", F.row_number().over(place)).filter(F.col("_r") <= left).withColumn("draw", F.lit(draws) + F.col("_r") - 1)
    return out.unionByName(more.select("stratum", F.col("draw").cast("long").alias("draw"), "a", "b", F.col("distance").cast("int").alias("distance")))


def label_candidates(items: DataFrame, most: int = 15, each: int = EACH, seed: int = 42) -> DataFrame:
    """(stratum, candidate, id, distance): what is to be labelled: the clusters of near hashes, whole, and pairs of the other strata from outside them.

    ``items`` has (id, h). ``distance`` is a pair's; clusters have none.
    """
    found = written(N.components(N.hamming_links(items, most, "id", "h")))
    near = found.select(F.lit(STRATA[0]).alias("stratum"), F.concat(F.lit("near-"), F.col("component").cast("string")).alias("candidate"), "id", F.lit(None).cast("int").alias("distance"))
    pairs = stratified_pairs(items.join(found.select("id", F.col("component").alias("cluster")), "id", "left"), each, seed)
    named = F.concat_ws("-", "stratum", F.col("draw").cast("string"))
    return near.unionByName(pairs.select("stratum", named.alias("candidate"), F.explode(F.array("a", "b")).alias("id"), "distance"))
