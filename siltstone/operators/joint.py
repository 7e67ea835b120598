"""The best pair of thresholds over all that are observed, without trying all pairs.

How many pairs pass two thresholds is a dominance count. Counts on a coarse grid of ranks
bound what the thresholds between its lines can reach: recall by the lower corner,
false positives by the upper one. Blocks that can't beat the best point are left out, the
others are cut finer, the most promising first, until single thresholds are left. Each
round is one pass over the points, which adds them up by cell in the tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.places import placed
from siltstone.sources.shared import written

#: Lines of the first grid on each side, blocks cut in a round, and pieces of a block's side.
LINES, BLOCKS, PIECES = 64, 32, 8


def cell_counts(points: DataFrame, xs: np.ndarray, ys: np.ndarray, tiers: int) -> np.ndarray:
    """[tier, i, j, (n, p)]: pairs and positive ones with ranks of at least xs[i] and ys[j], from (tier, r1, r2, n, p)."""
    shape = (tiers, len(xs) + 1, len(ys) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((*shape, 2), dtype=np.int64)
        for batch in batches:
            t, a, b, n, p = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            at = (t, np.searchsorted(xs, a, side="right"), np.searchsorted(ys, b, side="right"))
            np.add.at(sums[..., 0], at, n)
            np.add.at(sums[..., 1], at, p)
        cell = np.flatnonzero(sums[..., 0])
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(sums[..., 0].reshape(-1)[cell]), pa.array(sums[..., 1].reshape(-1)[cell])], names=["cell", "n", "p"])

    found = points.select("tier", "r1", "r2", "n", "p").mapInArrow(run, "cell long, n long, p long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    out = np.zeros((*shape, 2), dtype=np.int64)
    for r in found.collect():  # at most a number for each cell of the grid
        out.reshape(-1, 2)[r["cell"]] = r["n"], r["p"]
    return out[:, ::-1, ::-1].cumsum(axis=1).cumsum(axis=2)[:, ::-1, ::-1][:, 1:, 1:]


def lines(ranges: list[tuple[int, int]], pieces: int) -> np.ndarray:
    """The ranks at which some ranges begin, end and are cut."""
    return np.unique(np.concatenate([np.append(np.unique(np.linspace(a, b, pieces, endpoint=False).astype(np.int64)), b) for a, b in ranges]))


def best_ranks(points: DataFrame, m1: int, m2: int, positives: np.ndarray, least_precision: float, least_recall: float, n_lines: int = LINES) -> tuple[float, int, int] | None:
    """(worst recall, x, y): the ranks at which every tier has enough precision and recall and the worst recall is greatest, the least x, then y, on ties."""
    best: tuple[float, int, int] | None = None
    queue = [(-1.0, 0, m1, 0, m2)]
    pieces = n_lines
    while queue:
        chosen = []
        while queue and len(chosen) < BLOCKS:
            block = heapq.heappop(queue)
            if can_win(-block[0], block[1], block[3], best):
                chosen.append(block)
        if not chosen:
            break
        xs, ys = lines([(b[1], b[2]) for b in chosen], pieces), lines([(b[3], b[4]) for b in chosen], pieces)
        counts = cell_counts(points, xs, ys, len(positives))
        n, tp = counts[..., 0], counts[..., 1]
        recall = np.divide(tp, positives[:, None, None], out=np.zeros(tp.shape), where=positives[:, None, None] > 0)
        precision = np.divide(tp, n, out=np.zeros(tp.shape), where=n > 0)
        worst = recall.min(axis=0)
        ok = ((precision >= least_precision) & (n > 0) & (recall >= least_recall)).all(axis=0)
        for i, j in zip(*np.nonzero(ok & (worst == np.max(worst, where=ok, initial=-1))), strict=True):
            best = min(filter(None, (best, (float(worst[i, j]), int(xs[i]), int(ys[j])))), key=lambda v: (-v[0], v[1], v[2]))
        # what thresholds from a line up to the next can reach at most
        wrong = (n - tp)[:, 1:, 1:]
        most = np.divide(tp[:, :-1, :-1], tp[:, :-1, :-1] + wrong, out=np.zeros(wrong.shape), where=tp[:, :-1, :-1] + wrong > 0)
        hope = ((most >= least_precision) & (recall[:, :-1, :-1] >= least_recall)).all(axis=0)
        inside = np.zeros(hope.shape, dtype=bool)
        for _, x0, x1, y0, y1 in chosen:
            inside[np.searchsorted(xs, x0) : np.searchsorted(xs, x1), np.searchsorted(ys, y0) : np.searchsorted(ys, y1)] = True
        single = (np.diff(xs)[:, None] == 1) & (np.diff(ys)[None, :] == 1)
        for i, j in zip(*np.nonzero(hope & inside & ~single), strict=True):
            if can_win(float(worst[i, j]), int(xs[i]), int(ys[j]), best):
                heapq.heappush(queue, (-float(worst[i, j]), int(xs[i]), int(xs[i + 1]), int(ys[j]), int(ys[j + 1])))
        pieces = PIECES
    return best


def can_win(reach: float, x: int, y: int, best: tuple[float, int, int] | None) -> bool:
    """Whether thresholds from (x, y) on with that recall at most can still be better than the best."""
    return reach < 0 or best is None or reach > best[0] or (reach == best[0] and (x, y) < best[1:])


def joint_best(pairs: DataFrame, least_precision: float, least_recall: float = 0.0, tier: str | None = None, n_lines: int = LINES) -> DataFrame:
    """(x, y, worst_recall): the pair of observed thresholds at which pairs (s1, s2, positive) that reach both are precise enough in every tier.

    Of such points that of the greatest recall counts, the worst tier's where there are
    several; on ties the least x, then the least y. Tiers are never pooled; a tier in which
    nothing passes isn't precise, and one without positives has no recall. No row where no
    point is good enough. Pairs without both scores are in no count but that of positives.
    """
    rows = pairs.select((F.col(tier) if tier else F.lit(0)).cast("string").alias("name"), F.col("s1").cast("double").alias("s1"), F.col("s2").cast("double").alias("s2"), F.coalesce("positive", F.lit(False)).cast("long").alias("p"))
    names = {r["name"]: (i, r["p"]) for i, r in enumerate(rows.groupBy("name").agg(F.sum("p").alias("p")).orderBy("name").collect())}
    known = rows.filter("s1 IS NOT NULL AND s2 IS NOT NULL")
    values = [written(placed(known.select(c).distinct().withColumn("_all", F.lit(0)), "_all", (c,), "_n").select(F.col(c).alias(f"v{c}"), F.col("at").alias(f"r{c[1]}"))) for c in ("s1", "s2")]
    nothing = pairs.sparkSession.createDataFrame([], "x double, y double, worst_recall double")
    if not names or any(v.isEmpty() for v in values):
        return nothing
    code = F.lit(0)
    for name, (i, _) in names.items():
        code = F.when(F.col("name").eqNullSafe(F.lit(name)), i).otherwise(code)
    points = known.join(values[0], F.col("s1") == F.col("vs1")).join(values[1], F.col("s2") == F.col("vs2"))
    points = written(points.groupBy(code.cast("long").alias("tier"), "r1", "r2").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("p")))
    found = best_ranks(points, values[0].count(), values[1].count(), np.array([p for _, p in names.values()]), least_precision, least_recall, n_lines)
    if found is None:
        return nothing
    x, y = (v.filter(F.col(f"r{k}") == r).first()[f"vs{k}"] for k, v, r in ((1, values[0], found[1]), (2, values[1], found[2])))
    return pairs.sparkSession.createDataFrame([(x, y, found[0])], nothing.schema)
