"""Standardised profiles, similarity, rankings and their explanation."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

RATE_FEATURES = ["npxg_per90", "shots_per90", "xa_per90", "key_passes_per90", "xgchain_per90", "xgbuildup_per90", "npxg_per_shot", "buildup_share_of_chain"]
STYLE_PREFIXES = ("last_action_", "shot_type_")
#: Rows of one block of the all-pairs search, and the partial counts that one pair of blocks emits.
BLOCK = 2048

#: Readable names of the profile's columns.
LABELS = {
    "npxg_per90": "non-penalty xG per 90",
    "shots_per90": "shots per 90",
    "xa_per90": "expected assists (xA) per 90",
    "key_passes_per90": "key passes per 90",
    "xgchain_per90": "involvement in attacks that end in a shot (xGChain per 90)",
    "xgbuildup_per90": "involvement in build-up play (xGBuildup per 90)",
    "npxg_per_shot": "average shot quality (npxG per shot)",
    "buildup_share_of_chain": "share of attacking involvement that is build-up",
    "shot_type_head": "share of shots with the head",
    "shot_type_left_foot": "share of shots with the left foot",
    "shot_type_right_foot": "share of shots with the right foot",
    "shot_type_other": "share of shots with another body part",
}
#: Readable names of last actions.
ACTIONS = {
    "pass": "a pass", "cross": "a cross", "take_on": "a take-on (dribble)", "rebound": "a rebound", "aerial": "an aerial duel", "chipped": "a chipped ball",
    "ball_recovery": "winning the ball back", "ball_touch": "a first touch", "head_pass": "a headed pass", "throughball": "a through ball", "other": "another action", "missing": "an unrecorded action",
}
#: Position codes by role.
ROLES = {"Striker": ["FW", "FWL", "FWR"], "Attacking midfielder": ["AMC"], "Winger": ["AML", "AMR"], "Wide midfielder": ["ML", "MR"]}


def feature_sets(columns: list[str]) -> dict[str, list[str]]:
    """Named groups of the feature columns that are present."""
    rates = [c for c in columns if c in RATE_FEATURES]
    style = [c for c in columns if c.startswith(STYLE_PREFIXES)]
    zones = [c for c in columns if c.startswith("zone_")]
    out = {"all": rates + style + zones, "rates only": rates, "style only": style}
    if zones:
        out["zones only"] = zones
    return out | {"npxG only": ["npxg_per90"]}


def standardise(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None, by: list[str] | None = None, prefix: str = "") -> DataFrame:
    """z-scores of columns by the means and population deviations of fit_on (else df), for each value of `by`.

    Nulls are first set to the mean; a deviation of 0 counts as 1. The statistics are one row for each value of by.
    """
    by = by or []
    base = df if fit_on is None else fit_on
    # deviation after imputation: nulls stand at the mean, so they only enlarge the count
    means = [F.avg(c).alias(f"__m{i}") for i, c in enumerate(columns)]
    spread = [F.sqrt(F.coalesce(F.var_pop(c) * F.count(c) / F.count("*"), F.lit(0.0))).alias(f"__s{i}") for i, c in enumerate(columns)]
    stats = base.groupBy(*by).agg(*means, *spread)
    joined = df.join(F.broadcast(stats), by, "left") if by else df.crossJoin(F.broadcast(stats))  # one row for each seed, or one
    z = {f"{prefix}{c}": F.coalesce((F.col(c) - F.col(f"__m{i}")) / F.when(F.col(f"__s{i}") > 0, F.col(f"__s{i}")).otherwise(1.0), F.lit(0.0)) for i, c in enumerate(columns)}
    return joined.withColumns(z).drop(*stats.columns[len(by) :])


def imputed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values of each column, and of all."""
    each = [F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    return df.agg(*each).select(*columns, sum((F.col(c) for c in columns), F.lit(0)).alias("missing"))


def vector(columns: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-12)) * F.greatest(norm(b), F.lit(1e-12)))


def neg_euclidean(a: Column, b: Column) -> Column:
    return -F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def similarity(a: Column, b: Column, metric: str = "cosine", features: int = 2) -> Column:
    """A single feature always uses the distance."""
    return cosine(a, b) if metric == "cosine" and features > 1 else neg_euclidean(a, b)


def ranked_for(vectors: DataFrame, key: int, id_col: str, vector_col: str, metric: str = "cosine") -> DataFrame:
    """Every other row by similarity to one key's row, which is broadcast."""
    own = vectors.where(F.col(id_col) == key).select(F.col(vector_col).alias("__own")).limit(1)
    others = vectors.where(F.col(id_col) != key).crossJoin(F.broadcast(own))
    return others.withColumn("similarity", similarity(F.col(vector_col), F.col("__own"), metric)).drop("__own")


def _block_similarity(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine" and a.shape[1] > 1:
        return (a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)) @ (b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)).T
    squared = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T
    return -np.sqrt(np.maximum(squared, 0))


def packed_blocks(rows: DataFrame, size: int, by: list[str], columns: list[str]) -> DataFrame:
    """(by, block, blocks, rows array<struct>): the rows of each `by` in blocks of about `size`, one row for a block, written once."""
    counts = rows.groupBy(*by).agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    dealt = rows.join(F.broadcast(counts), by) if by else rows.crossJoin(F.broadcast(counts))  # one row for each seed, or one
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")
    return cut(dealt.groupBy(*by, block, "blocks").agg(F.collect_list(F.struct("id", *columns)).alias("rows")))


#: Blocks that a task holds of one side, and tasks that a search has at least if there are blocks enough.
HELD, TASKS = 4, 48


def block_pairs(left: DataFrame, right: DataFrame, blocks: int, by: list[str] | None = None) -> DataFrame:
    """Every block of left beside every block of right (of the same `by`). Tasks read both from the checkpoint; no block is copied on disk or broadcast."""
    parts = max(1, -(-blocks // HELD))
    left, right = left.coalesce(max(parts, min(blocks, -(-TASKS // parts)))), right.coalesce(parts)
    if not by:
        return left.hint("shuffle_replicate_nl").crossJoin(right)
    right = right.withColumnsRenamed({c: f"__{c}" for c in by})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
    return left.hint("shuffle_replicate_nl").join(right, same).drop(*[f"__{c}" for c in by])


def near_cells(rows: DataFrame, size: int) -> DataFrame:
    """rows (id, v) with `cell`: the nearest, by direction, of some rows' vectors. Cells only tell which rows share a block, for any choice of them."""
    dealt = rows.count() // size
    if dealt < 2:
        return rows.withColumn("cell", F.lit(0))
    pivots = np.stack([r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(min(dealt, 1024)).select("v").collect()])
    pivots = pivots / np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-12)

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        return pd.Series([int(c) for s in range(0, len(v), 4096) for c in (np.stack(v.iloc[s : s + 4096].to_numpy()) @ pivots.T).argmax(1)], index=v.index, dtype="int32")

    return rows.withColumn("cell", nearest("v"))


def topk(vectors: DataFrame, n: int = 10, metric: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, candidate: str | None = None, digits: int | None = None) -> DataFrame:
    """(id, other, similarity, rank) of each row's n most similar others (for which `candidate` holds, if given), by pairs of blocks.

    A block is one row, of vectors of about the same direction. Each block is first searched by itself, which gives a bound on each row's n-th best; of another block
    only rows' products are made that its mean direction and greatest angle from it (or centre and radius) let reach this bound. Pairs of blocks aren't
    copied on disk, and a task keeps n rows for each id. digits: similarities are rounded to so many and then tie, the smaller id first.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v"), (F.lit(True) if candidate is None else F.coalesce(candidate, F.lit(False))).alias("ok"))
    rows = near_cells(cut(rows), block)
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    dealt = rows.join(F.broadcast(sizes), "cell")  # at most 1,024 cells
    packed = cut(dealt.groupBy("cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")).agg(F.collect_list(F.struct("id", "v", "ok")).alias("rows")))
    slack = 1e-9 if digits is None else 0.5 * 10.0**-digits + 1e-9

    def shown(s: np.ndarray) -> np.ndarray:
        return s if digits is None else np.floor(np.abs(s) * 10.0**digits + 0.5) / 10.0**digits * np.sign(s)

    def side(rows):
        rows = sorted(rows, key=lambda r: r["id"])
        return np.array([r["id"] for r in rows], np.int64), np.stack([r["v"] for r in rows]), np.array([r["ok"] for r in rows], bool)

    def centred(x: np.ndarray) -> tuple:
        """What `reach` needs of a block: its centre, and how far its rows are from it."""
        if metric == "cosine" and x.shape[1] > 1:
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        centre = x.mean(0)
        return centre, float(np.sqrt(((x - centre) ** 2).sum(1).max()))

    def reach(a: np.ndarray, centre: np.ndarray, radius: float) -> np.ndarray:
        """No row of the block is more similar to a's rows than this."""
        if metric == "cosine" and a.shape[1] > 1:
            length = np.linalg.norm(a, axis=1, keepdims=True)
            near = np.maximum(np.sqrt(((a / np.maximum(length, 1e-12) - centre) ** 2).sum(1)) - radius, 0)
            return np.where(length[:, 0] > 1e-6, 1 - near * near / 2, np.inf)  # unit vectors at a distance d have the cosine 1 - d*d/2
        return -np.maximum(np.sqrt(((a - centre) ** 2).sum(1)) - radius, 0)

    def best(ids, x, others, y, ok, floor):
        """The n best of others for each row, from floor on: places of rows, others, similarities."""
        out = []
        for s in range(0, len(ids), 512):
            sim = shown(_block_similarity(x[s : s + 512], y, metric))
            sim[(ids[s : s + 512, None] == others) | ~ok] = -np.inf
            if sim.shape[1] > n:
                floor_here = np.maximum(floor[s : s + 512], np.partition(sim, sim.shape[1] - n, axis=1)[:, -n])
            else:
                floor_here = floor[s : s + 512]
            at, of = np.nonzero((sim >= floor_here[:, None] - 1e-15) & np.isfinite(sim))
            out.append((at + s, others[of], sim[at, of]))
        at, other, sim = (np.concatenate(c) for c in zip(*out))
        order = np.lexsort((other, -sim, at))
        at, other, sim = at[order], other[order], sim[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        return at[place < n], other[place < n], sim[place < n]

    def alone(batches):
        for pdf in batches:
            for cell, part, rows in zip(pdf["cell"], pdf["part"], pdf["rows"]):
                ids, x, ok = side(rows)
                at, _, sim = best(ids, x, ids, x, ok, np.full(len(ids), -np.inf))
                floor = np.full(len(ids), -np.inf)
                full = np.bincount(at, minlength=len(ids)) >= n
                low = np.full(len(ids), np.inf)
                np.minimum.at(low, at, sim)
                floor[full] = low[full]
                centre, radius = centred(x)
                yield pd.DataFrame({"k": [f"{cell}/{part}"], "ids": [ids], "x": [x.ravel()], "ok": [ok], "floor": [floor], "centre": [centre], "radius": [radius]})

    made = cut(packed.mapInPandas(alone, "k string, ids array<long>, x array<double>, ok array<boolean>, floor array<double>, centre array<double>, radius double"))
    blocks = made.count()
    pairs = block_pairs(made.select("k", "ids", "x", "floor"), made.select(F.col("ids").alias("others"), F.col("x").alias("y"), "ok", "centre", "radius"), blocks)

    def run(batches):
        key, found = None, None

        def told():
            at, other, sim = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0))
            order = np.lexsort((other, -sim, at))
            at, other, sim = at[order], other[order], sim[order]
            keep = np.arange(len(at)) - np.searchsorted(at, at) < n
            return at[keep], other[keep], sim[keep]

        for pdf in batches:
            for k, ids_, x_, floor_, others, y_, ok, centre, radius in pdf.itertuples(index=False):
                if k != key:
                    if key is not None and found:
                        at, other, sim = told()
                        yield pd.DataFrame({"id": ids[at], "other": other, "similarity": sim})
                    key, found = k, []
                    ids, floor = np.asarray(ids_), np.array(floor_)
                    x = np.asarray(x_).reshape(len(ids), -1)
                asks = np.flatnonzero(reach(x, np.asarray(centre), radius) + slack >= floor)
                if not len(asks):
                    continue
                others = np.asarray(others)
                at, other, sim = best(ids[asks], x[asks], others, np.asarray(y_).reshape(len(others), -1), np.asarray(ok), floor[asks])
                found.append((asks[at], other, sim))
                if len(found) > 8:
                    at, other, sim = told()
                    found = [(at, other, sim)]
                    full = np.flatnonzero(np.bincount(at, minlength=len(ids)) >= n)
                    ends = np.searchsorted(at, full, "right") - 1
                    floor[full] = np.maximum(floor[full], sim[ends])
        if key is not None and found:
            at, other, sim = told()
            yield pd.DataFrame({"id": ids[at], "other": other, "similarity": sim})

    parts = pairs.mapInPandas(run, "id long, other long, similarity double")
    order = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def own_ranks(vectors: DataFrame, metric: str = "cosine", by: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """(by, id, rank): A vectors at least as similar to the B vector as the id's own A vector is (ties count against it).

    vectors: by, id, a, b. A block is one row; own and other similarities are the same sums over the features, so that
    equal vectors tie exactly; only counts leave a task. Vectors of one number are ranked along the line.
    """
    by = by or []
    return _block_ranks(vectors.where(F.size("a") != 1), metric, by, block).unionByName(line_ranks(vectors.where(F.size("a") == 1), by))


#: Distances that differ by less are the same.
TOLERANCE = 1e-12


def line_ranks(vectors: DataFrame, by: list[str]) -> DataFrame:
    """own_ranks of vectors of one number: how many a lie within |a - b| of b, from running counts along the line; nothing is paired."""
    a, b = F.col("a")[0].cast("double"), F.col("b")[0].cast("double")
    reach = F.abs(a - b) + TOLERANCE + 1e-15 * (F.abs(a) + F.abs(b))
    # at one value: where a reach begins, then the a, then where a reach ends
    marks = F.array(*[F.struct(v.alias("at"), F.lit(kind).alias("kind")) for kind, v in ((0, b - reach), (1, a), (2, b + reach))])
    line = Window.partitionBy(*(by or [F.lit(0)])).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = vectors.select(*by, "id", F.inline(marks)).withColumn("n", F.sum((F.col("kind") == 1).cast("long")).over(line))
    return counted.groupBy(*by, "id").agg(F.sum(F.when(F.col("kind") == 2, F.col("n")).when(F.col("kind") == 0, -F.col("n"))).cast("int").alias("rank"))


def _block_ranks(vectors: DataFrame, metric: str, by: list[str], block: int) -> DataFrame:
    packed = packed_blocks(vectors.select(*by, "id", "a", "b"), block, by, ["a", "b"])
    asks = packed.select(*by, F.col("rows").alias("ask"))
    holds = packed.select(*by, F.transform("rows", lambda r: r["a"]).alias("hold"))
    kinds = dict(vectors.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*by, "id"]) + ", n long"

    def run(batches):
        for pdf in batches:
            for k in range(len(pdf)):
                ask, hold = pdf["ask"].iloc[k], np.stack(pdf["hold"].iloc[k])
                own, b = (np.stack([r[c] for r in ask]) for c in ("a", "b"))
                counts = np.concatenate([_counts_at_least(own[s : s + CHUNK], b[s : s + CHUNK], hold, metric) for s in range(0, len(b), CHUNK)])
                yield pd.DataFrame({**{c: pdf[c].iloc[k] for c in by}, "id": [r["id"] for r in ask], "n": counts})

    parts = block_pairs(asks, holds, packed.count(), by).select(*by, "ask", "hold").mapInPandas(run, schema)
    return parts.groupBy(*by, "id").agg(F.sum("n").cast("int").alias("rank"))


#: Rows compared with a block at once.
CHUNK = 32


def _counts_at_least(own: np.ndarray, b: np.ndarray, hold: np.ndarray, metric: str) -> np.ndarray:
    """For each row of b, how many rows of hold are at least as similar to it as its row of own is."""
    if metric == "cosine" and b.shape[1] > 1:
        lengths = [np.maximum(np.sqrt((x * x).sum(-1)), 1e-12) for x in (own, hold)]
        mine, others = (own * b).sum(-1) / lengths[0], (hold[None] * b[:, None]).sum(-1) / lengths[1]
    else:
        mine, others = -((own - b) ** 2).sum(-1), -((hold[None] - b[:, None]) ** 2).sum(-1)
    return (others >= mine[:, None]).sum(1)


def placed(rows: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """rows with same, before and whole: how many rows of their `by` have the same value, a smaller one, and any; nulls have none of these.

    Places are found where the rows are. They are dealt into ranges of (by, value, a hash of the row), so that a value that
    most rows share lies in many ranges, and counted within each; what the ranges' first and last values share with
    other ranges is a table of at most four rows for each range, which is broadcast. The ranges are checkpointed, so that
    both uses see the same ones.
    """
    own = rows.columns
    dealt = rows.where(F.col(column).isNotNull()).withColumn("__spread", F.xxhash64(*own)).repartitionByRange(*by, column, "__spread").withColumn("__range", F.spark_partition_id())
    below, same = Window.partitionBy("__range", *by).orderBy(column), Window.partitionBy("__range", *by, column)
    local = cut(dealt.withColumns({"__below": F.rank().over(below) - 1, "__same": F.count("*").over(same)}).drop("__spread"))
    end = F.struct(column, F.col("__same").alias("n"))
    ranges = local.groupBy("__range", *by).agg(F.count("*").alias("size"), F.min(end).alias("first"), F.max(end).alias("last"))
    order = Window.partitionBy(*(by or [F.lit(0)]))
    summed = ranges.select("__range", *by, "first", "last", "size", F.coalesce(F.sum("size").over(order.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"), F.sum("size").over(order).alias("whole"))
    ends = summed.select("__range", *by, "earlier", "size", F.explode(F.array_distinct(F.array("first", "last"))).alias("e"), F.col("first").alias("f"))
    # an end's rows begin where its range does if it's the first value, else behind the rest of the range
    begins = F.col("earlier") + F.when(F.col("e") == F.col("f"), 0).otherwise(F.col("size") - F.col("e.n"))
    edges = ends.select("__range", *by, F.col(f"e.{column}").alias("__value"), F.col("e.n").alias("n"), begins.alias("begins"))
    whole_edges = edges.groupBy(*by, "__value").agg(F.sum("n").alias("__edge_same"), F.min("begins").alias("__edge_before"))
    edges = edges.select("__range", *by, "__value").join(whole_edges, [*by, "__value"])
    offsets = summed.select("__range", *by, "earlier", "whole")
    told = local.join(F.broadcast(offsets), ["__range", *by])
    marked = edges.select(F.col("__range").alias("__r"), *[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], "__value", "__edge_same", "__edge_before")
    at_edge = (F.col("__range") == F.col("__r")) & (F.col(column) == F.col("__value"))
    for i, c in enumerate(by):
        at_edge &= F.col(c).eqNullSafe(F.col(f"__by{i}"))
    told = told.join(F.broadcast(marked), at_edge, "left")
    out = told.select(*own, F.coalesce("__edge_same", "__same").alias("same"), F.coalesce(F.col("__edge_before"), F.col("earlier") + F.col("__below")).alias("before"), "whole")
    none = rows.where(F.col(column).isNull()).select(*own, *[F.lit(None).cast("long").alias(c) for c in ("same", "before", "whole")])
    return out.unionByName(none)


def distinctiveness(df: DataFrame, distance: str = "distance", name: str = "distinctiveness") -> DataFrame:
    """100 x the share of other rows of a strictly smaller distance; null for a null distance, which counts for no other row either."""
    value = 100.0 * F.col("before") / F.greatest(F.col("whole") - 1, F.lit(1))
    return placed(df, distance).withColumn(name, value).drop("same", "before", "whole")


def contributions(pairs: DataFrame, features: list[str], a: str = "za", b: str = "zb") -> DataFrame:
    """One row for each pair and feature: its part of the cosine, and both z-scores."""
    names = F.array(*[F.lit(f) for f in features])
    size = F.greatest(norm(F.col(a)), F.lit(1e-12)) * F.greatest(norm(F.col(b)), F.lit(1e-12))
    rest = [c for c in pairs.columns if c not in (a, b)]
    parts = F.arrays_zip(names.alias("feature"), F.col(a).alias("z_player"), F.col(b).alias("z_other"))
    return pairs.select(*rest, size.alias("__size"), F.explode(parts).alias("p")).select(
        *rest, F.col("p.feature").alias("feature"), (F.col("p.z_player") * F.col("p.z_other") / F.col("__size")).alias("contribution"), F.col("p.z_player").alias("z_player"), F.col("p.z_other").alias("z_other")
    )


def explain(parts: DataFrame, keys: list[str], top: int = 3) -> DataFrame:
    """The top contributions, the most negative one and the total for each pair, rounded as shown to users."""
    item = F.struct(F.round("contribution", 4).alias("contribution"), "feature", F.round("z_player", 2).alias("z_player"), F.round("z_other", 2).alias("z_other"))
    order = F.struct((-F.col("contribution")).alias("o"), "feature", item.alias("item"))
    listed = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(order)).alias("all"), F.min_by(item, F.struct("contribution", "feature")).alias("against"), F.round(F.sum("contribution"), 4).alias("total"))
    return listed.select(*keys, F.transform(F.slice("all", 1, top), lambda x: x["item"]).alias("top"), "against", "total")


def explanation_text(explained: DataFrame, labels: dict[str, str], other: str) -> DataFrame:
    """Adds shared and difference texts; `other` is the column of the other one's name."""
    named = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    label = lambda f: F.coalesce(named[f], F.replace(f, F.lit("_"), F.lit(" ")))
    traits = F.transform(F.filter("top", lambda x: x["contribution"] > 0), lambda x: F.concat(F.when(x["z_player"] > 0, "high ").otherwise("low "), label(x["feature"])))
    against = F.col("against")
    higher = F.when(against["z_other"] > against["z_player"], " higher").otherwise(" lower")
    return explained.withColumns({
        "shared": F.when(F.size(traits) > 0, F.concat(F.lit("Both: "), F.array_join(traits, ", "))).otherwise("No strongly shared traits"),
        "difference": F.when(against["contribution"] < 0, F.concat(F.lit("Main difference: "), label(against["feature"]), F.lit(": "), F.col(other), higher)).otherwise("Main difference: no clear difference"),
    })


def feature_percentiles(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """(keys, feature, value, percentile): average rank over the non-null rows of a feature, times 100."""
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("p")).select(*keys, "p.feature", "p.value").where("value is not null")
    percentile = (F.col("before") + (F.col("same") + 1) / 2) / F.col("whole") * 100
    return placed(long, "value", ("feature",)).select(*keys, "feature", "value", percentile.alias("percentile"))


def style_map(df: DataFrame, features: list[str], keys: list[str]) -> tuple[DataFrame, list[float]]:
    """(keys, x, y) on the first two principal components of the centred features, and their explained variance.

    Each component's sign makes its loading of the greatest size positive.
    """
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    means = df.agg(*[F.avg(c).alias(c) for c in features]).first()
    centred = df.select(*keys, *[(F.col(c) - (means[c] or 0.0)).alias(c) for c in features])
    assembled = VectorAssembler(inputCols=features, outputCol="__v").transform(centred)
    model = PCA(k=2, inputCol="__v", outputCol="__p").fit(assembled)
    loadings = model.pc.toArray()
    sign = [1.0 if loadings[np.abs(loadings[:, k]).argmax(), k] > 0 else -1.0 for k in range(2)]
    p = vector_to_array("__p")
    placed = model.transform(assembled).select(*keys, (p[0] * sign[0]).alias("x"), (p[1] * sign[1]).alias("y"))
    return placed, [round(float(v), 3) for v in model.explainedVariance.toArray()]


def map_scale(points: DataFrame, width: float = 800.0, height: float = 560.0, pad: float = 24.0) -> DataFrame:
    """Scales x and y into a frame, y upwards; the bounds are one row."""
    bounds = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    span = lambda a, b: F.when(F.col(b) > F.col(a), F.col(b) - F.col(a)).otherwise(1.0)
    return points.crossJoin(F.broadcast(bounds)).withColumns({"px": pad + (F.col("x") - F.col("x0")) / span("x0", "x1") * (width - 2 * pad), "py": height - pad - (F.col("y") - F.col("y0")) / span("y0", "y1") * (height - 2 * pad)}).drop("x0", "x1", "y0", "y1")


def role(position: Column, roles: dict[str, list[str]] = ROLES) -> Column:
    out = F.lit("Other")
    for name, codes in roles.items():
        out = F.when(position.isin(codes), name).otherwise(out)
    return out


def feature_label(column: Column, zone_labels: dict[str, str] | None = None, labels: dict[str, str] = LABELS, actions: dict[str, str] = ACTIONS) -> Column:
    """Readable name of a profile column."""
    plain = lambda c: F.replace(c, F.lit("_"), F.lit(" "))
    mapped = lambda d, c: F.create_map(*[F.lit(x) for p in d.items() for x in p])[c] if d else F.lit(None).cast("string")
    action = F.substring(column, 13, 1000)
    return (
        F.when(mapped(zone_labels or {}, column).isNotNull(), F.concat(F.lit("share of "), mapped(zone_labels or {}, column)))
        .when(column.startswith("last_action_"), F.concat(F.lit("share of shots after "), F.coalesce(mapped(actions, action), plain(action))))
        .otherwise(F.coalesce(mapped(labels, column), plain(column)))
    )


def visible(points: DataFrame, hidden: list[str], role_col: str = "role") -> DataFrame:
    """Without the hidden roles, inactive rows first."""
    return points.where(~F.col(role_col).isin(hidden)).orderBy(F.col("active").asc_nulls_first())


def feature_group(column: Column) -> Column:
    return F.when(column.startswith("last_action_"), "How shots are created").when(column.startswith("shot_type_"), "Body part").otherwise("Output and involvement")


def shown_value(column: Column, value: Column) -> Column:
    """Shares as whole percents, rates with two digits, a dash for null."""
    share = column.startswith("last_action_") | column.startswith("shot_type_") | (column == "buildup_share_of_chain")
    return F.when(value.isNull(), "—").when(share, F.format_string("%d%%", F.floor(value * 100 + 0.5))).otherwise(F.format_string("%.2f", value))
