"""Many k-means starts at once: every step of all starts is one pass over the points.

A pass scores a batch of points against the centres of all running starts and
adds up, for each centre, its points, their number and their cost; these small
partial tables are summed by Spark, so the driver sees one row a centre. Starts
that have settled drop out of later passes. Centres are seeded as k-means++
does, one pass for each centre: the next one is drawn with a chance in
proportion to the squared distance, by the smallest of exponential numbers that
are hashed from seed and point, so the draw is the same on any partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the fits: starts, steps, and the moved distance (squared, over the mean variance) that counts as settled.
STARTS, MAX_ITER, TOLERANCE = 20, 500, 1e-4


@dataclass
class Fit:
    """Centres of one start, their cost (sum of squared distances) and the steps taken."""

    seed: int
    centers: np.ndarray
    cost: float = math.inf
    steps: int = 0

    @property
    def k(self) -> int:
        return len(self.centers)

    def label(self, columns: Sequence[str]) -> Column:
        """The nearest centre's number as a column expression."""
        far = F.array(*[
            sum((((F.col(c) - F.lit(float(x))) * (F.col(c) - F.lit(float(x)))) for c, x in zip(columns, center, strict=True)), F.lit(0.0))
            for center in self.centers
        ])
        return (F.array_position(far, F.array_min(far)) - 1).cast("int")


def points(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``id`` (a hash of the key) and ``x`` of every row without missing values."""
    x = F.array(*[F.col(c).cast("double") for c in columns])
    complete = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v))
    return df.select(F.xxhash64(key).alias("id"), x.alias("x")).where(complete)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch["x"]
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances, rows by centres."""
    far = (x * x).sum(1)[:, None] + (centers * centers).sum(1)[None, :] - 2 * (x @ centers.T)
    return np.maximum(far, 0)


def _hashed(ids: np.ndarray, seed: int, turn: int) -> np.ndarray:
    """Uniform numbers in (0, 1) from point, seed and turn."""
    z = ids.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03 + 1) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53) + 1e-17


def seeded(rows: DataFrame, seeds: Sequence[int], k: int) -> list[np.ndarray]:
    """First centres for every seed, ``k`` passes in all; fewer centres where there are fewer distinct points."""
    centers: list[list[list[float]]] = [[] for _ in seeds]
    for turn in range(k):
        held = [np.array(c) for c in centers]

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple[float, int, list[float]]] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, ids = _matrix(batch), batch["id"].to_numpy()
                for s, seed in enumerate(seeds):
                    weight = _distances(x, held[s]).min(1) if turn else np.ones(len(x))
                    with np.errstate(divide="ignore"):
                        wait = np.where(weight > 1e-18, -np.log(_hashed(ids, seed, turn)) / weight, np.inf)
                    at = int(np.lexsort((ids, wait))[0])
                    found = (float(wait[at]), int(ids[at]), x[at].tolist())
                    if math.isfinite(found[0]) and (s not in best or found[:2] < best[s][:2]):
                        best[s] = found
            columns = [[*best], [b[0] for b in best.values()], [b[1] for b in best.values()], [b[2] for b in best.values()]]
            kinds = [pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["s", "wait", "id", "x"])

        drawn = rows.mapInArrow(draw, "s int, wait double, id long, x array<double>")
        first = Window.partitionBy("s").orderBy("wait", "id")
        for r in drawn.withColumn("n", F.row_number().over(first)).where("n = 1").collect():  # a row a start
            centers[r.s].append(list(r.x))
    return [np.array(c) for c in centers]


def _pass(rows: DataFrame, fits: list[Fit]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each fit the sums and counts of its centres' points, and the cost of its present centres."""
    centers = [f.centers for f in fits]
    starts = np.cumsum([0, *[len(c) for c in centers]])
    stacked, width = np.concatenate(centers), centers[0].shape[1]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, costs = np.zeros_like(stacked), np.zeros(len(stacked), np.int64), np.zeros(len(stacked))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch)
            far = _distances(x, stacked)
            for a, b in zip(starts, starts[1:], strict=False):
                own = far[:, a:b].argmin(1)
                counts[a:b] += np.bincount(own, minlength=b - a)
                costs[a:b] += np.bincount(own, weights=far[np.arange(len(x)), a + own], minlength=b - a)
                for j in range(width):
                    sums[a:b, j] += np.bincount(own, weights=x[:, j], minlength=b - a)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array(counts[at]), pa.array(costs[at]), pa.array(sums[at].tolist(), pa.list_(pa.float64()))],
            names=["c", "n", "cost", "x"],
        )

    parts = rows.mapInArrow(add_up, "c int, n long, cost double, x array<double>")
    total = parts.groupBy("c").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), *[F.sum(F.col("x")[j]).alias(f"x{j}") for j in range(width)])
    sums, counts, costs = np.zeros_like(stacked), np.zeros(len(stacked), np.int64), np.zeros(len(stacked))
    for r in total.collect():  # a row a centre
        sums[r.c], counts[r.c], costs[r.c] = [r[f"x{j}"] for j in range(width)], r.n, r.cost
    return [(sums[a:b], counts[a:b], float(costs[a:b].sum())) for a, b in zip(starts, starts[1:], strict=False)]


def fit_all(rows: DataFrame, starts: Sequence[tuple[int, int]], max_iter: int = MAX_ITER, tolerance: float = TOLERANCE) -> list[Fit]:
    """A fit for each (k, seed) of ``starts``. ``rows`` (``id``, ``x``) are read once a step, so they should be written or cheap."""
    moments = rows.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.var_pop("v").alias("s")).agg(F.avg("s")).first()
    enough = tolerance * (moments[0] or 0.0)
    largest: dict[int, int] = {}
    for k, seed in starts:
        largest[seed] = max(k, largest.get(seed, 0))
    order = list(largest)
    drawn = dict(zip(order, seeded(rows, order, max(largest.values())), strict=True))
    if any(not len(c) for c in drawn.values()):
        raise ValueError("no rows without missing values to cluster")
    fits = [Fit(seed, drawn[seed][:k]) for k, seed in starts]  # the first k draws of a seed are its draws for k
    running = list(fits)
    for _ in range(max_iter):
        moved = []
        for fit, (sums, counts, cost) in zip(running, _pass(rows, running), strict=True):
            after = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], fit.centers)
            shift = float(((after - fit.centers) ** 2).sum())
            fit.centers, fit.cost, fit.steps = after, cost, fit.steps + 1
            if shift > enough:
                moved.append(fit)
        running = moved
        if not running:
            break
    for fit, (_, _, cost) in zip(fits, _pass(rows, fits), strict=True):
        fit.cost = cost
    return fits


def cheapest(fits: Sequence[Fit]) -> Fit:
    """The fit of least cost; the first one of equals."""
    return min(fits, key=lambda f: f.cost)
