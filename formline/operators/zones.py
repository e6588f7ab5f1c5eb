"""Shot grids and zones: smoothed location histograms, and their non-negative factorisation."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import linalg
from ..session import cut
from .profiles import KEYS, is_style, shots_in

LENGTH, WIDTH = 105, 68
NX, NY = 10, 20
X_EDGES, Y_EDGES = np.linspace(70, LENGTH, NX + 1).tolist(), np.linspace(0, WIDTH, NY + 1).tolist()
RADIUS = 4


def _cell(metres: Column, edges: list[float]) -> Column:
    """Place of the cell; values beyond the edges go into the outer cells."""
    inside = F.greatest(F.lit(edges[0]), F.least(metres, F.lit(edges[-1] - 1e-9)))
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= inside)) - 1


def shot_cell(x: Column, y: Column) -> Column:
    return _cell(x * LENGTH, X_EDGES) * NY + _cell(y * WIDTH, Y_EDGES)


def kernel(spark) -> DataFrame:
    """(cell, target, w): the share of a cell's mass that the Gaussian of one cell puts on each target; some falls off the border."""
    taps = np.exp(-np.arange(-RADIUS, RADIUS + 1) ** 2 / 2)
    taps /= taps.sum()
    near = range(-RADIUS, RADIUS + 1)
    rows = [
        (ix * NY + iy, (ix + dx) * NY + iy + dy, float(taps[dx + RADIUS] * taps[dy + RADIUS]))
        for ix, iy, dx, dy in product(range(NX), range(NY), near, near)
        if 0 <= ix + dx < NX and 0 <= iy + dy < NY
    ]
    return spark.createDataFrame(rows, "cell int, target int, w double")


def cell_counts(shots: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """Style shots for each key and cell; cells without a shot are absent."""
    return shots.where(is_style()).groupBy(*by, shot_cell(F.col("X"), F.col("Y")).alias("cell")).agg(F.count("*").alias("n"))


def smoothed(counts: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """(by, cell, share): the counts under the kernel, summing to 1. The kernel has a fixed size, so it is broadcast."""
    spread = counts.join(F.broadcast(kernel(counts.sparkSession)), "cell").groupBy(*by, F.col("target").alias("cell")).agg(F.sum(F.col("n") * F.col("w")).alias("mass"))
    return spread.join(spread.groupBy(*by).agg(F.sum("mass").alias("whole")), by).select(*by, "cell", (F.col("mass") / F.col("whole")).alias("share"))


def grids(shots: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """(by, grid array<double>): all cells in order; keys without style shots are absent."""
    cells = smoothed(cell_counts(shots, by), by).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("cell", "share"))).alias("m"))
    return cells.select(*by, F.transform(F.sequence(F.lit(0), F.lit(NX * NY - 1)), lambda c: F.coalesce(F.element_at("m", c), F.lit(0.0))).alias("grid"))


def _summed(frame: DataFrame, size: int, work) -> dict:
    """key -> sums over its grids of `size` numbers; work(key, matrix of grids) gives those of one batch."""

    def run(batches):
        total: dict = {}
        for pdf in batches:
            for key, part in pdf.groupby("key"):
                total[key] = total.get(key, 0.0) + work(key, np.stack(part["grid"].to_numpy()))
        for key, v in total.items():
            yield pd.DataFrame({"key": key, "at": np.arange(size), "v": v})

    rows = frame.select("key", "grid").mapInPandas(run, "key long, at int, v double").groupBy("key", "at").agg(F.sum("v").alias("v")).toPandas()
    return {int(key): part.sort_values("at")["v"].to_numpy() for key, part in rows.groupby("key")}


#: Rounds after which a fit that hasn't converged ends the job, and the residual that counts as converged.
ROUNDS, RESIDUAL = 2000, 1e-4
#: Sweeps over the components with the same sums, and how far a round's change is carried on.
SWEEPS, MOMENTUM = 10, 0.5


class NotConverged(RuntimeError):
    pass


class Factors(dict):
    """Components (k x cells) of each key, with the rounds each took and its residual, which certifies that they're stationary.

    With the best weights for these components, the residual is the size of what of the error's gradient the bound at zero
    doesn't explain, relative to weights' x grids.
    """

    def __init__(self):
        super().__init__()
        self.rounds: dict[int, int] = {}
        self.residual: dict[int, float] = {}


def fit_each(grid_frame: DataFrame, by: str | None, k: int = 6, rounds: int = ROUNDS, residual: float = RESIDUAL) -> Factors:
    """Value of `by` (a whole number, such as a seed) -> components (k x cells) of the non-negative factorisation of its grids.

    All values are fitted in the same rounds. Weights are never stored: each round recomputes them from the components
    where the grids are, and only k x cells and k x k sums leave the tasks; several sweeps over the components then use the same
    sums, and the change is carried on a little as long as the error falls. The grids are cut off from their lineage,
    and their Gram matrices (cells x cells) give the starts. A value is done once its residual is low enough; one that
    isn't after `rounds` raises NotConverged. by None is one fit, under 0.
    """
    cells = NX * NY
    key = F.lit(0).cast("long") if by is None else F.col(by).cast("long")
    frame = cut(grid_frame.where("grid is not null").select(key.alias("key"), "grid"))
    gram: dict[int, np.ndarray] = {}
    found = Factors()
    for at, v in _summed(frame, cells * cells + 2, lambda _, x: np.r_[(x.T @ x).ravel(), x.sum(), len(x)]).items():
        gram[at] = v[:-2].reshape(cells, cells)
        found[at] = linalg.start_components(gram[at], v[-2] / v[-1] / cells * 0.01, k)
    momentum, settled, errors = dict.fromkeys(found, MOMENTUM), dict.fromkeys(found), dict.fromkeys(found, np.inf)
    going = set(found)
    for number in range(rounds):
        if not going:
            break
        here = {at: found[at] for at in going}

        def sums(at, x, here=here):
            w = linalg.nonnegative_weights(x, here[at])
            return np.r_[(w.T @ x).ravel(), (w.T @ w).ravel()]

        for at, v in _summed(frame.where(F.col("key").isin(sorted(going))), k * cells + k * k, sums).items():
            wx, ww, h = v[: k * cells].reshape(k, cells), v[k * cells :].reshape(k, k), here[at]
            found.rounds[at], found.residual[at] = number + 1, linalg.stationary_residual(h, wx, ww)
            if found.residual[at] <= residual:
                going.discard(at)
                continue
            error = np.trace(gram[at]) - 2 * (wx * h).sum() + (ww * (h @ h.T)).sum()
            better = h
            for _ in range(SWEEPS):
                better = linalg.update_components(better, wx, ww)
            if error > errors[at] or settled[at] is None:
                momentum[at] *= 0.5 if settled[at] is not None else 1.0
                found[at] = better
            else:
                momentum[at] = min(1.0, momentum[at] * 1.1)
                found[at] = np.maximum(0, better + momentum[at] * (better - settled[at]))
            settled[at], errors[at] = better, error
    if going:
        raise NotConverged(f"the zones of {sorted(going)[:10]} did not converge in {rounds} rounds: {max(found.residual.get(at, np.inf) for at in going):.1e} is over {residual:.1e}")
    return found


def fit(grid_frame: DataFrame, k: int = 6, rounds: int = ROUNDS, residual: float = RESIDUAL) -> np.ndarray:
    """Components (k x cells) of the non-negative factorisation of all grids."""
    found = fit_each(grid_frame, None, k, rounds, residual)
    if not found:
        raise ValueError("no grids to fit")
    return found[0]


def weights_each(grid_frame: DataFrame, components: dict[int, np.ndarray], of: Column, by: list[str] = KEYS) -> DataFrame:
    """(by, zone_1..zone_k): each grid's non-negative weights, summing to 1, under the components that `of` names; null where there is no grid or there are no components."""
    k = max((len(h) for h in components.values()), default=0)

    @F.pandas_udf("array<double>")
    def weigh(grid: pd.Series, keys: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(grid), index=grid.index, dtype=object)
        for key, part in grid[grid.notna()].groupby(keys):
            if key in components:
                w = linalg.nonnegative_weights(np.stack(part.to_numpy()), components[key])
                out[part.index] = pd.Series(list(w / np.maximum(w.sum(1, keepdims=True), 1e-12)), index=part.index)
        return out

    return grid_frame.withColumn("w", weigh("grid", of.cast("long"))).select(*by, *[F.get("w", F.lit(i)).alias(f"zone_{i + 1}") for i in range(k)])


def weights(grid_frame: DataFrame, components: np.ndarray, by: list[str] = KEYS) -> DataFrame:
    """(by, zone_1..zone_k) under one set of components."""
    return weights_each(grid_frame, {0: components}, F.lit(0), by)


def zone_model(shots: DataFrame, appearances: DataFrame, profiles: DataFrame, k: int = 6) -> np.ndarray:
    """Components fitted on exactly the pool's shots."""
    return fit(grids(shots_in(shots, appearances.join(profiles.select(*KEYS), KEYS, "left_semi"))), k)


def component_cells(spark, components: np.ndarray) -> DataFrame:
    """(zone, ix, iy, share) of each component, summing to 1."""
    rows = [(z + 1, c // NY, c % NY, float(v / h.sum())) for z, h in enumerate(components) for c, v in enumerate(h)]
    return spark.createDataFrame(rows, "zone int, ix int, iy int, share double")


def centres(cells: DataFrame) -> DataFrame:
    """(zone, depth, lateral): metres from the goal line, and to the attacker's right of the middle."""
    x_mid = F.lit(X_EDGES[0]) + (F.col("ix") + 0.5) * ((X_EDGES[-1] - X_EDGES[0]) / NX)
    y_mid = (F.col("iy") + 0.5) * (WIDTH / NY)
    whole = F.sum("share")
    return cells.groupBy("zone").agg((LENGTH - F.sum(F.col("share") * x_mid) / whole).alias("depth"), (WIDTH / 2 - F.sum(F.col("share") * y_mid) / whole).alias("lateral"))


def describe(centre: DataFrame) -> DataFrame:
    """Adds a long label ('shots from the right of the box') and a short one ('right, ~13 m out')."""
    depth, lateral = F.col("depth"), F.col("lateral")
    side = F.when(F.abs(lateral) < 4, "").when(lateral > 0, "right").otherwise("left")
    comma = F.when(side == "", "").otherwise(F.concat(F.lit(", "), side))
    middle = F.when(side == "", "centre").otherwise(side)
    where = (
        F.when(depth < 9, F.concat(F.lit("close range"), F.when(side == "", "").otherwise(F.concat(comma, F.lit(" side")))))
        .when(depth < 15, F.concat(F.lit("the "), middle, F.lit(" of the box")))
        .when(depth < 20, F.concat(F.lit("the edge of the box"), comma))
        .otherwise(F.concat(F.lit("outside the box"), comma))
    )
    return centre.select("*", F.concat(F.lit("shots from "), where).alias("label"), F.format_string("%s, ~%d m out", middle, F.round(depth).cast("int")).alias("short_label"))


def export(cells: DataFrame) -> DataFrame:
    """(zone, grid array<array<double>>): shares rounded to 6 digits, NX rows of NY cells; a cell that isn't given is 0."""
    shares = cells.groupBy("zone").agg(F.map_from_entries(F.collect_list(F.struct((F.col("ix") * NY + F.col("iy")).cast("int").alias("cell"), F.round("share", 6).alias("v")))).alias("m"))
    places = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    row = lambda x: F.transform(places(NY), lambda y: F.coalesce(F.try_element_at("m", x * NY + y), F.lit(0.0)))
    return shares.select("zone", F.transform(places(NX), row).alias("grid"))


def heatmap(zone_weights: DataFrame, cells: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """(by, ix, iy, value, opacity): each key's mixture of the zones; opacity is (value / peak) ** 0.8.

    zone_weights: by, zone, weight. The zones' cells have a fixed size, so they are broadcast.
    """
    mixed = zone_weights.where("weight > 0").join(F.broadcast(cells), "zone").groupBy(*by, "ix", "iy").agg(F.sum(F.col("weight") * F.col("share")).alias("value"))
    peak = mixed.groupBy(*by).agg(F.max("value").alias("peak"))
    return mixed.join(peak, by).select(*by, "ix", "iy", "value", F.pow(F.try_divide(F.col("value"), F.col("peak")), F.lit(0.8)).alias("opacity"))


def by_weight(zone_weights: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """(by, zones array<struct<zone, weight>>): each key's zones of any weight, heaviest first (ties by number). zone_weights: by, zone, weight."""
    heavy = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("o"), "zone", "weight")))
    return zone_weights.where("weight > 0").groupBy(*by).agg(F.transform(heavy, lambda x: F.struct(x["zone"].alias("zone"), x["weight"].alias("weight"))).alias("zones"))
