"""Style profiles: one row for each player and season (or any other key) from appearances and shots."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

KEYS = ["player_id", "season"]
#: Positions, thresholds and categories of the reference's profiles.
ATTACKING_POSITIONS = ["FW", "FWL", "FWR", "AMC", "AML", "AMR", "ML", "MR"]
MIN_STARTS, MIN_MINUTES, RARE_SHARE = 5, 900, 0.02
EXCLUDED_SITUATIONS = ["Penalty", "DirectFreekick"]
SHOT_TYPES = {"Head": "head", "LeftFoot": "left_foot", "RightFoot": "right_foot"}
RATES = {"xA": "xa", "key_passes": "key_passes", "xGChain": "xgchain", "xGBuildup": "xgbuildup"}


def is_style(excluded: list[str] = EXCLUDED_SITUATIONS) -> Column:
    """No own goal, penalty or direct free kick; an unknown situation counts as style."""
    return ~F.col("is_own_goal") & ~F.coalesce(F.col("situation").isin(excluded), F.lit(False))


def style_shots(shots: DataFrame, excluded: list[str] = EXCLUDED_SITUATIONS) -> DataFrame:
    return shots.where(is_style(excluded))


def shots_in(shots: DataFrame, appearances: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """Shots of the given appearances, with the appearance's season and other keys (joined on match and player alone)."""
    own = [k for k in by if k != "player_id"]
    keys = appearances.select("match_id", "player_id", *own).distinct()
    return shots.drop(*own).join(keys, ["match_id", "player_id"])


def primary_position(appearances: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """Among starts, the position of the most minutes; ties: more starts, then the alphabet."""
    each = appearances.where("started").groupBy(*by, "position").agg(F.sum("minutes").alias("m"), F.count("*").alias("n"))
    return each.groupBy(*by).agg(F.min_by("position", F.struct(-F.col("m"), -F.col("n"), "position")).alias("primary_position"))


def by_minutes(appearances: DataFrame, column: str, name: str, by: list[str] = KEYS) -> DataFrame:
    """Different values of a column by minutes (descending, then the value), joined by a comma."""
    each = appearances.groupBy(*by, column).agg(F.sum("minutes").alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("m"), F.col(column).alias("v"))))
    return each.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x["v"]), ", ").alias(name))


def totals(appearances: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """Player name (of the first match), minutes, starts and sums of every rate column."""
    return appearances.groupBy(*by).agg(
        F.min_by("player", F.struct("date", "match_id")).alias("player"),
        F.sum("minutes").alias("minutes"),
        F.count_if("started").alias("starts"),
        *[F.sum(c).alias(f"sum_{name}") for c, name in RATES.items()],
    )


def last_action_categories(shots: DataFrame, rare: float = RARE_SHARE, excluded: list[str] = EXCLUDED_SITUATIONS) -> DataFrame:
    """Last actions of at least `rare` of the style shots; unknown ones count in the denominator only."""
    n = style_shots(shots, excluded).groupBy("lastAction").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).where((F.col("n") / F.col("total") >= rare) & F.col("lastAction").isNotNull()).select("lastAction", "n", (F.col("n") / F.col("total")).alias("share"))


def snake(name: str) -> str:
    return re.sub(r"([A-Z])", r"_\1", name).lower().lstrip("_")


def snake_column(c: Column) -> Column:
    return F.ltrim(F.lower(F.regexp_replace(c, "([A-Z])", "_$1")), F.lit("_"))


def action_label(actions: list[str]) -> Column:
    c = F.col("lastAction")
    return F.when(c.isNull(), "Missing").when(c.isin(actions), c).otherwise("Other")


def shot_type_label(types: dict[str, str] = SHOT_TYPES) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in types.items() for x in pair])[F.col("shotType")], F.lit("other"))


def category_columns(actions: list[str], types: dict[str, str] = SHOT_TYPES) -> dict[str, tuple[str, str]]:
    """Column name -> (label column, label), in a stable order."""
    out = {f"last_action_{snake(a)}": ("action", a) for a in sorted(actions)}
    out |= {f"last_action_{snake(a)}": ("action", a) for a in ("Other", "Missing")}
    return out | {f"shot_type_{t}": ("kind", t) for t in sorted({*types.values(), "other"})}


def labelled(shots: DataFrame, actions: list[str], types: dict[str, str] = SHOT_TYPES) -> DataFrame:
    return shots.withColumns({"action": action_label(actions), "kind": shot_type_label(types)})


def style_counts(shots: DataFrame, columns: dict[str, tuple[str, str]], by: list[str] = KEYS) -> DataFrame:
    """Style shots (n) and the number in each category, in one aggregation."""
    return shots.groupBy(*by).agg(F.count("*").alias("shots"), *[F.count_if(F.col(k) == v).alias(c) for c, (k, v) in columns.items()])


def style_priors(shots: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """One row with every category's share of all style shots; 0 where there is none."""
    n = F.count("*")
    return shots.agg(*[F.coalesce(F.try_divide(F.count_if(F.col(k) == v), n), F.lit(0.0)).alias(c) for c, (k, v) in columns.items()])


def shrunk(counts: DataFrame, columns: list[str], k: float = 0, priors: DataFrame | None = None) -> DataFrame:
    """Shares (count + k * prior) / (shots + k); null without shots if k is 0, else the prior."""
    if not k:
        return counts.withColumns({c: F.try_divide(F.coalesce(c, F.lit(0)), F.col("shots")) for c in columns})
    p = priors.select(*[F.col(c).alias(f"__{c}") for c in columns])
    joined = counts.crossJoin(F.broadcast(p))  # priors are one row
    return joined.withColumns({c: (F.coalesce(c, F.lit(0)) + k * F.col(f"__{c}")) / (F.col("shots") + k) for c in columns}).drop(*p.columns)


#: What a sum of appearances or shots holds, and how sums of the same key are put together.
APPEARANCE_SUMS = ["minutes", "starts", "started_minutes", *[f"sum_{name}" for name in RATES.values()]]
SHOT_SUMS = ["n", "xg"]


def appearance_sums(appearances: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """Appearances summed up by key, position, team and league. Sums of disjoint appearances can be merged."""
    return appearances.groupBy(*by, "position", "team", "league").agg(
        F.min(F.struct("date", "match_id", "player")).alias("first"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.sum("minutes").alias("minutes"),
        F.count_if("started").alias("starts"),
        F.sum(F.when(F.col("started"), F.col("minutes"))).alias("started_minutes"),
        *[F.sum(c).alias(f"sum_{name}") for c, name in RATES.items()],
    )


def merged_appearance_sums(sums: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """Sums of a key, position, team and league in one row each."""
    parts = [F.min("first").alias("first"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date")]
    return sums.groupBy(*by, "position", "team", "league").agg(*parts, *[F.sum(c).alias(c) for c in APPEARANCE_SUMS])


def shot_sums(shots: DataFrame, by: list[str] = KEYS, types: dict[str, str] = SHOT_TYPES, excluded: list[str] = EXCLUDED_SITUATIONS) -> DataFrame:
    """Shots with their keys, counted by last action, kind, and whether they count for style and for npxG. Sums of disjoint shots can be merged."""
    scored = ~F.col("is_own_goal") & ~F.coalesce(F.col("situation") == excluded[0], F.lit(False))
    tagged = shots.select(*by, "lastAction", shot_type_label(types).alias("kind"), is_style(excluded).alias("style"), scored.alias("scored"), "xG")
    return tagged.groupBy(*by, "lastAction", "kind", "style", "scored").agg(F.count("*").alias("n"), F.sum("xG").alias("xg"))


def merged_shot_sums(sums: DataFrame, by: list[str] = KEYS) -> DataFrame:
    return sums.groupBy(*by, "lastAction", "kind", "style", "scored").agg(*[F.sum(c).alias(c) for c in SHOT_SUMS])


def summed_categories(sums: DataFrame, rare: float = RARE_SHARE) -> list[str]:
    """The last actions of at least `rare` of the style shots, as last_action_categories gives them, from sums of shots."""
    n = sums.where("style").groupBy("lastAction").agg(F.sum("n").alias("n")).collect()  # a row for each last action
    total = sum(r.n for r in n)
    return sorted(r.lastAction for r in n if r.lastAction is not None and r.n / total >= rare)


def rolled_up(appearances: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """Totals, primary position, teams and leagues of each key (as totals, primary_position and by_minutes give them) in one pass.

    Appearances are summed up by position, team and league first; the few sums of a key then meet in one list.
    """
    return rolled_up_sums(appearance_sums(appearances, by), by)


def rolled_up_sums(fine: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """rolled_up from sums of appearances, one row for each key, position, team and league."""
    sums = ["minutes", "starts", *[f"sum_{name}" for name in RATES.values()]]
    part = F.struct("position", "team", "league", "minutes", "starts", "started_minutes")
    listed = fine.groupBy(*by).agg(F.min("first")["player"].alias("player"), *[F.sum(c).alias(c) for c in sums], F.collect_list(part).alias("parts"))

    def total(column: str, field: str, value: Column) -> Column:
        return F.aggregate(F.filter("parts", lambda p: p[column].eqNullSafe(value)), F.lit(0).cast("long"), lambda s, p: s + F.coalesce(p[field], F.lit(0)).cast("long"))

    def ordered(column: str, name: str) -> Column:
        values = F.array_distinct(F.transform("parts", lambda p: p[column]))
        ranked = F.array_sort(F.transform(values, lambda v: F.struct((-total(column, "minutes", v)).alias("m"), v.alias("v"))))
        return F.array_join(F.transform(ranked, lambda x: x["v"]), ", ").alias(name)

    started = F.array_distinct(F.transform(F.filter("parts", lambda p: p["starts"] > 0), lambda p: p["position"]))
    positions = F.array_sort(F.transform(started, lambda v: F.struct((-total("position", "started_minutes", v)).alias("m"), (-total("position", "starts", v)).alias("n"), v.alias("v"))))
    return listed.select(*by, "player", *sums, F.get(positions, F.lit(0))["v"].alias("primary_position"), ordered("team", "teams"), ordered("league", "leagues"))


def per90(total: Column) -> Column:
    return total.cast("double") / (F.col("minutes").cast("double") / 90.0)


def build(
    shots: DataFrame,
    appearances: DataFrame,
    by: list[str] = KEYS,
    *,
    last_actions: list[str] | None = None,
    rare: float = RARE_SHARE,
    types: dict[str, str] = SHOT_TYPES,
    excluded: list[str] = EXCLUDED_SITUATIONS,
    min_starts: int = MIN_STARTS,
    min_minutes: int = MIN_MINUTES,
    positions: list[str] | None = ATTACKING_POSITIONS,
    shrinkage_k: float = 0,
    priors: DataFrame | None = None,
) -> DataFrame:
    """The profile of each key in `by`, for any subset of appearances.

    Shots meet their appearances once and are summed up by key, last action and kind; from these few sums the categories
    are counted (if last_actions doesn't fix them) and the profile's columns made. positions None and zero
    minima switch the pool filter off.
    """
    sums = shot_sums(shots_in(shots, appearances, by), by, types, excluded)
    if last_actions is None or (shrinkage_k and priors is None):
        sums = cut(sums)  # read more than once
    kept = {"rare": rare, "types": types, "min_starts": min_starts, "min_minutes": min_minutes, "positions": positions}
    return from_sums(sums, appearance_sums(appearances, by), by, last_actions=last_actions, shrinkage_k=shrinkage_k, priors=priors, **kept)


def from_sums(
    shots: DataFrame,
    appearances: DataFrame,
    by: list[str] = KEYS,
    *,
    last_actions: list[str] | None = None,
    rare: float = RARE_SHARE,
    types: dict[str, str] = SHOT_TYPES,
    min_starts: int = MIN_STARTS,
    min_minutes: int = MIN_MINUTES,
    positions: list[str] | None = ATTACKING_POSITIONS,
    shrinkage_k: float = 0,
    priors: DataFrame | None = None,
) -> DataFrame:
    """The profiles of shot_sums and appearance_sums of the same keys; sums of shots are read twice unless last_actions is given."""
    if last_actions is None:
        last_actions = summed_categories(shots, rare)
    columns = category_columns(last_actions, types)
    tagged = shots.withColumn("action", action_label(last_actions))
    counted = lambda k, v: F.coalesce(F.sum(F.when(F.col("style") & (F.col(k) == v), F.col("n"))), F.lit(0))
    if shrinkage_k and priors is None:
        n = F.sum(F.when(F.col("style"), F.col("n")))
        priors = tagged.agg(*[F.coalesce(F.try_divide(counted(k, v), n), F.lit(0.0)).alias(c) for c, (k, v) in columns.items()])
    rolled = tagged.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col("style"), F.col("n"))), F.lit(0)).alias("shots"),
        F.sum(F.when(F.col("style"), F.col("xg"))).alias("style_xg"),
        F.sum(F.when(F.col("scored"), F.col("xg"))).alias("npxg"),
        *[counted(k, v).alias(c) for c, (k, v) in columns.items()],
    )
    joined = rolled_up_sums(appearances, by).join(rolled, by, "left").withColumn("shots", F.coalesce("shots", F.lit(0)))
    named = ["player", "teams", F.split("leagues", ", ")[0].alias("league"), "minutes", "starts", "primary_position", "shots"]
    return pool(finished(joined, by, columns, named, shrinkage_k, priors), min_starts, min_minutes, positions)


def finished(joined: DataFrame, by: list[str], columns: dict[str, tuple[str, str]], named: list, shrinkage_k: float = 0, priors: DataFrame | None = None) -> DataFrame:
    """Rates and shares of each key's totals: minutes, the sums of RATES, shots, style_xg, npxg and the counts of `columns`; named columns stand before them."""
    shared = shrunk(joined, list(columns), shrinkage_k, priors)
    return shared.select(
        *by, *named,
        per90(F.coalesce("npxg", F.lit(0))).alias("npxg_per90"),
        per90(F.col("shots")).alias("shots_per90"),
        *[per90(F.col(f"sum_{n}")).alias(f"{n}_per90") for n in RATES.values()],
        F.when(F.col("shots") > 0, F.col("style_xg").cast("double") / F.col("shots")).alias("npxg_per_shot"),
        F.when(F.col("sum_xgchain") > 0, F.col("sum_xgbuildup").cast("double") / F.col("sum_xgchain").cast("double")).alias("buildup_share_of_chain"),
        *columns,
    )


def counted_at_once(rows: DataFrame, by: list[str], last_actions: list[str], types: dict[str, str] = SHOT_TYPES, excluded: list[str] = EXCLUDED_SITUATIONS) -> DataFrame:
    """The totals that `finished` takes, in one aggregation of appearances and shots in one table.

    The column `what` tells them apart; rows that are neither only make sure that their key is there. Counts of a key without appearances are null.
    """
    columns = category_columns(last_actions, types)
    shot = F.col("what") == "shot"
    style = F.coalesce(shot & is_style(excluded), F.lit(False))
    scored = shot & ~F.col("is_own_goal") & ~F.coalesce(F.col("situation") == excluded[0], F.lit(False))
    tagged = rows.withColumns({"action": action_label(last_actions), "kind": shot_type_label(types), "style": style, "scored": scored, "appears": F.col("what") == "appearance"})
    known = lambda c: F.when(F.count_if("appears") > 0, c)
    return tagged.groupBy(*by).agg(
        F.sum("minutes").alias("minutes"), known(F.count_if(F.col("appears") & F.col("started"))).alias("starts"), *[F.sum(c).alias(f"sum_{name}") for c, name in RATES.items()],
        known(F.count_if("style")).alias("shots"), F.sum(F.when(F.col("style"), F.col("xG"))).alias("style_xg"), F.sum(F.when(F.col("scored"), F.col("xG"))).alias("npxg"),
        *[F.count_if(F.col("style") & (F.col(k) == v)).alias(c) for c, (k, v) in columns.items()],
    )


def pool(profiles: DataFrame, min_starts: int = MIN_STARTS, min_minutes: int = MIN_MINUTES, positions: list[str] | None = ATTACKING_POSITIONS) -> DataFrame:
    kept = profiles.where((F.col("starts") >= min_starts) & (F.col("minutes") >= min_minutes))
    return kept if positions is None else kept.where(F.col("primary_position").isin(positions))


def pool_report(profiles: DataFrame) -> DataFrame:
    """Profiles by league, by primary position and in all, in one pass."""
    grouped = profiles.groupingSets([["league"], ["primary_position"], []], "league", "primary_position")
    return grouped.agg(F.grouping_id().alias("level"), F.count("*").alias("profiles"))


def top_by_rate(profiles: DataFrame, n: int = 10, column: str = "npxg_per90") -> DataFrame:
    return profiles.orderBy(F.desc(column), "player_id", "season").limit(n)


def start_positions(appearances: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """'position n, position n' of the starts, most frequent first."""
    n = appearances.where("started").groupBy(*by, "position").agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "position", "n")))
    return n.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: F.concat_ws(" ", x["position"], x["n"])), ", ").alias("start_positions"))


def seeded_sample(df: DataFrame, n: int, seed: int, keys: list[str] = KEYS) -> DataFrame:
    """n rows in the order of a hash of seed and keys: the same rows however the input is partitioned."""
    return df.withColumn("draw", F.md5(F.concat_ws("|", F.lit(seed), *keys))).orderBy("draw", *keys).limit(n)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Concatenates tables whose columns may differ."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
