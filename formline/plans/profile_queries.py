"""Queries on profile features, grids and zones."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import profiles, zones
from ..session import cut, ensure_checkpoint_dir, table
from ..sources import io
from ..sources.adapters import APPEARANCES_SQL, MIN_MINUTES, MIN_STARTS, POSITIONS, RARE, SHOT_TYPES, SHOTS_SQL, appearances, shots
from .registry import query

A, S, AS = f"WITH {APPEARANCES_SQL} ", f"WITH {SHOTS_SQL} ", f"WITH {APPEARANCES_SQL}, {SHOTS_SQL} "
STYLE = "(NOT is_own_goal AND NOT coalesce(situation IN ('Penalty', 'DirectFreekick'), FALSE))"
IN_POOL = f"starts >= {MIN_STARTS} AND minutes >= {MIN_MINUTES} AND primary_position IN ('1-URGENT', '2-HIGH', '3-MEDIUM')"
PRIMARY = """, prim AS (SELECT player_id, season, arg_min("position", struct_pack(a := -m, b := -n, c := "position")) AS primary_position
  FROM (SELECT player_id, season, "position", sum(minutes) AS m, count(*) AS n FROM appearances WHERE started GROUP BY ALL) GROUP BY ALL)"""
#: Rates, shot-type shares and pool filter of the composed profile, as SQL.
PROFILE = f"""{PRIMARY}, tot AS (SELECT player_id, season, arg_min(player, struct_pack(a := "date", b := match_id)) AS player, sum(minutes)::BIGINT AS minutes, count(*) FILTER (WHERE started) AS starts,
    sum(xA)::DOUBLE AS xa, sum(key_passes)::DOUBLE AS kp, sum(xGChain)::DOUBLE AS chain, sum(xGBuildup)::DOUBLE AS buildup FROM appearances GROUP BY ALL),
  own AS (SELECT s.*  FROM shots AS s SEMI JOIN appearances AS a ON s.match_id = a.match_id AND s.player_id = a.player_id),
  sh AS (SELECT player_id, season, count(*) FILTER (WHERE {STYLE}) AS shots, (sum(xG) FILTER (WHERE {STYLE}))::DOUBLE AS style_xg, (sum(xG) FILTER (WHERE NOT is_own_goal AND situation <> 'Penalty'))::DOUBLE AS npxg,
    count(*) FILTER (WHERE {STYLE} AND shotType = 'SMALL') AS head, count(*) FILTER (WHERE {STYLE} AND shotType = 'LARGE') AS left_foot, count(*) FILTER (WHERE {STYLE} AND lastAction IS NULL) AS missing FROM own GROUP BY ALL),
  prof AS (SELECT t.player_id, t.season, t.player, t.minutes, t.starts, primary_position, coalesce(shots, 0) AS shots,
    coalesce(npxg, 0) / (t.minutes::DOUBLE / 90.0) AS npxg_per90, coalesce(shots, 0)::DOUBLE / (t.minutes::DOUBLE / 90.0) AS shots_per90, xa / (t.minutes::DOUBLE / 90.0) AS xa_per90, kp / (t.minutes::DOUBLE / 90.0) AS key_passes_per90,
    chain / (t.minutes::DOUBLE / 90.0) AS xgchain_per90, buildup / (t.minutes::DOUBLE / 90.0) AS xgbuildup_per90, CASE WHEN shots > 0 THEN style_xg / shots END AS npxg_per_shot, CASE WHEN chain > 0 THEN buildup / chain END AS buildup_share_of_chain,
    CASE WHEN shots > 0 THEN head::DOUBLE / shots END AS shot_type_head, CASE WHEN shots > 0 THEN left_foot::DOUBLE / shots END AS shot_type_left_foot, CASE WHEN shots > 0 THEN missing::DOUBLE / shots END AS last_action_missing
    FROM tot AS t LEFT JOIN sh USING (player_id, season) LEFT JOIN prim USING (player_id, season))"""
COLUMNS = ["player_id", "season", "player", "minutes", "starts", "primary_position", "shots", "npxg_per90", "shots_per90", "xa_per90", "key_passes_per90", "xgchain_per90", "xgbuildup_per90", "npxg_per_shot", "buildup_share_of_chain", "shot_type_head", "shot_type_left_foot", "last_action_missing"]
SELECTED = ", ".join(COLUMNS)


def built(spark, sf, pool=True, **settings):
    limits = {"min_starts": MIN_STARTS, "min_minutes": MIN_MINUTES, "positions": POSITIONS} if pool else {"min_starts": 0, "min_minutes": 0, "positions": None}
    return profiles.build(shots(spark, sf), appearances(spark, sf), rare=RARE, types=SHOT_TYPES, **limits, **settings)


@query("f1_style_shots", S + f"SELECT season, count(*) AS shots, sum(xG)::DOUBLE AS xg FROM shots WHERE {STYLE} GROUP BY season")
def _(spark, sf):
    return profiles.style_shots(shots(spark, sf)).groupBy("season").agg(F.count("*").alias("shots"), F.sum("xG").cast("double").alias("xg"))


@query("f2_shots_in", AS + "SELECT s.match_id, s.player_id, s.shot_no, a.season FROM shots AS s JOIN (SELECT DISTINCT match_id, player_id, season FROM appearances WHERE started) AS a ON s.match_id = a.match_id AND s.player_id = a.player_id")
def _(spark, sf):
    return profiles.shots_in(shots(spark, sf), appearances(spark, sf).where("started")).select("match_id", "player_id", "shot_no", "season")


@query("f3_primary_position", A + PRIMARY + " SELECT * FROM prim")
def _(spark, sf):
    return profiles.primary_position(appearances(spark, sf))


@query("f4_teams_by_minutes", A + "SELECT player_id, season, string_agg(team, ', ' ORDER BY m DESC, team) AS teams FROM (SELECT player_id, season, team, sum(minutes) AS m FROM appearances GROUP BY ALL) GROUP BY ALL")
def _(spark, sf):
    return profiles.by_minutes(appearances(spark, sf), "team", "teams")


@query("f5_main_league", A + "SELECT player_id, season, arg_min(league, struct_pack(a := -m, b := league)) AS league FROM (SELECT player_id, season, league, sum(minutes) AS m FROM appearances GROUP BY ALL) GROUP BY ALL")
def _(spark, sf):
    return profiles.by_minutes(appearances(spark, sf), "league", "leagues").select("player_id", "season", F.split("leagues", ", ")[0].alias("league"))


@query("f6_totals", A + 'SELECT player_id, season, arg_min(player, struct_pack(a := "date", b := match_id)) AS player, sum(minutes)::BIGINT AS minutes, count(*) FILTER (WHERE started) AS starts, sum(xA)::DOUBLE AS xa FROM appearances GROUP BY ALL')
def _(spark, sf):
    return profiles.totals(appearances(spark, sf)).select("player_id", "season", "player", "minutes", "starts", F.col("sum_xa").cast("double").alias("xa"))


@query("f8_rates", AS + PROFILE + " SELECT player_id, season, shots, npxg_per90, shots_per90, xa_per90, key_passes_per90, xgchain_per90, xgbuildup_per90, npxg_per_shot, buildup_share_of_chain FROM prof")
def _(spark, sf):
    return built(spark, sf, False).select("player_id", "season", "shots", "npxg_per90", "shots_per90", "xa_per90", "key_passes_per90", "xgchain_per90", "xgbuildup_per90", "npxg_per_shot", "buildup_share_of_chain")


@query("f12_last_action_categories", S + f"SELECT lastAction, n, n::DOUBLE / total AS share FROM (SELECT lastAction, count(*) AS n, sum(count(*)) OVER () AS total FROM shots WHERE {STYLE} GROUP BY ALL) WHERE n::DOUBLE / total >= {RARE} AND lastAction IS NOT NULL")
def _(spark, sf):
    return profiles.last_action_categories(shots(spark, sf), RARE)


@query("f13_style_categories", S + f"""SELECT CASE WHEN lastAction IS NULL THEN 'Missing' WHEN lastAction IN ('Brand#1', 'Brand#2', 'Brand#3') THEN lastAction ELSE 'Other' END AS "action",
  CASE shotType WHEN 'SMALL' THEN 'head' WHEN 'LARGE' THEN 'left_foot' WHEN 'MEDIUM' THEN 'right_foot' ELSE 'other' END AS kind, count(*) AS n FROM shots WHERE {STYLE} GROUP BY ALL""")
def _(spark, sf):
    return profiles.labelled(profiles.style_shots(shots(spark, sf)), ["Brand#1", "Brand#2", "Brand#3"], SHOT_TYPES).groupBy("action", "kind").agg(F.count("*").alias("n"))


@query("f14_snake", "SELECT p_partkey, ltrim(lower(regexp_replace(replace(p_type, 'O', 'o'), '([A-Z])', '_\\1', 'g')), '_') AS snake FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", profiles.snake_column(F.replace("p_type", F.lit("O"), F.lit("o"))).alias("snake"))


SHARES = """SELECT player_id, season, count(*) AS shots, count(*) FILTER (WHERE shotType = 'SMALL') AS head, count(*) FILTER (WHERE shotType = 'LARGE') AS left_foot, count(*) FILTER (WHERE shotType = 'MEDIUM') AS right_foot,
  count(*) FILTER (WHERE shotType NOT IN ('SMALL', 'LARGE', 'MEDIUM')) AS other FROM shots WHERE """ + STYLE + " GROUP BY ALL"
KINDS = {f"shot_type_{k}": ("kind", k) for k in ("head", "left_foot", "other", "right_foot")}


@query("f15_style_shares", S + f"SELECT player_id, season, shots, head::DOUBLE / shots AS shot_type_head, left_foot::DOUBLE / shots AS shot_type_left_foot, right_foot::DOUBLE / shots AS shot_type_right_foot, other::DOUBLE / shots AS shot_type_other FROM ({SHARES})")
def _(spark, sf):
    return profiles.shrunk(profiles.style_counts(profiles.labelled(profiles.style_shots(shots(spark, sf)), [], SHOT_TYPES), KINDS), list(KINDS))


@query("f16_style_priors", S + f"SELECT sum(head)::DOUBLE / sum(shots) AS shot_type_head, sum(left_foot)::DOUBLE / sum(shots) AS shot_type_left_foot, sum(right_foot)::DOUBLE / sum(shots) AS shot_type_right_foot, sum(other)::DOUBLE / sum(shots) AS shot_type_other FROM ({SHARES})")
def _(spark, sf):
    return profiles.style_priors(profiles.labelled(profiles.style_shots(shots(spark, sf)), [], SHOT_TYPES), KINDS)


@query("f17_shrunk_shares", S + f", c AS ({SHARES}), p AS (SELECT sum(head)::DOUBLE / sum(shots) AS h, sum(left_foot)::DOUBLE / sum(shots) AS l FROM c) SELECT player_id, season, (head + 10 * h) / (shots + 10) AS shot_type_head, (left_foot + 10 * l) / (shots + 10) AS shot_type_left_foot FROM c, p")
def _(spark, sf):
    tagged = profiles.labelled(profiles.style_shots(shots(spark, sf)), [], SHOT_TYPES)
    return profiles.shrunk(profiles.style_counts(tagged, KINDS), list(KINDS), 10, profiles.style_priors(tagged, KINDS)).select("player_id", "season", "shot_type_head", "shot_type_left_foot")


@query("f19_build_profiles", AS + PROFILE + f" SELECT {SELECTED} FROM prof WHERE {IN_POOL}")
def _(spark, sf):
    return built(spark, sf).select(*COLUMNS)


@query("f19_recent_profiles", f"WITH base AS (WITH {APPEARANCES_SQL} SELECT * FROM appearances), " + SHOTS_SQL.replace("year(o_orderdate)", "0") + """, appearances AS (
  SELECT * REPLACE (CAST(max(season) OVER (PARTITION BY player_id) AS INTEGER) AS season) FROM (SELECT *, coalesce(sum(minutes) OVER (PARTITION BY player_id ORDER BY "date" DESC, match_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM base) WHERE before < 2000)
""" + PROFILE.replace("SELECT s.*  FROM shots AS s SEMI JOIN appearances AS a ON", "SELECT s.* REPLACE (a.season AS season) FROM shots AS s JOIN appearances AS a ON") + f" SELECT {SELECTED} FROM prof WHERE starts >= {MIN_STARTS}")
def _(spark, sf):
    from ..operators.windows import recent_window

    window = recent_window(appearances(spark, sf))
    return profiles.build(shots(spark, sf), window, rare=RARE, types=SHOT_TYPES, min_starts=MIN_STARTS, min_minutes=0, positions=None).select(*COLUMNS)


@query("flagship_top_rates", AS + PROFILE + f" SELECT {SELECTED} FROM prof WHERE {IN_POOL} ORDER BY npxg_per90 DESC, player_id, season LIMIT 10")
def _(spark, sf):
    return profiles.top_by_rate(built(spark, sf)).select(*COLUMNS)


@query("f20_pool_report", AS + PROFILE + f", lg AS (SELECT player_id, season, arg_min(league, struct_pack(a := -m, b := league)) AS league FROM (SELECT player_id, season, league, sum(minutes) AS m FROM appearances GROUP BY ALL) GROUP BY ALL) SELECT league, primary_position, grouping_id(league, primary_position) AS level, count(*) AS profiles FROM prof JOIN lg USING (player_id, season) WHERE {IN_POOL} GROUP BY GROUPING SETS ((league), (primary_position), ())")
def _(spark, sf):
    return profiles.pool_report(built(spark, sf))


@query("f22_start_positions", A + "SELECT player_id, season, string_agg(\"position\" || ' ' || n, ', ' ORDER BY n DESC, \"position\") AS start_positions FROM (SELECT player_id, season, \"position\", count(*) AS n FROM appearances WHERE started GROUP BY ALL) GROUP BY ALL")
def _(spark, sf):
    return profiles.start_positions(appearances(spark, sf))


@query("f23_seeded_sample", A + "SELECT player_id, season FROM (SELECT DISTINCT player_id, season FROM appearances) ORDER BY md5(concat_ws('|', 7, player_id, season)), player_id, season LIMIT 15")
def _(spark, sf):
    return profiles.seeded_sample(appearances(spark, sf).select("player_id", "season").distinct(), 15, 7).select("player_id", "season")


#: The cell of a shot by counting edges, which agrees on every edge.
CELL = "((SELECT count(*) FROM unnest([{x}]) AS e(v) WHERE v <= greatest(70.0, least(X * 105, 105 - 1e-9))) - 1) * 20 + (SELECT count(*) FROM unnest([{y}]) AS e(v) WHERE v <= greatest(0.0, least(Y * 68, 68 - 1e-9))) - 1".format(
    x=", ".join(f"{e!r}::DOUBLE" for e in zones.X_EDGES), y=", ".join(f"{e!r}::DOUBLE" for e in zones.Y_EDGES)
)
KERNEL = """kern AS (WITH taps AS (SELECT d, exp(-d * d / 2.0) / (SELECT sum(exp(-x * x / 2.0)) FROM range(-4, 5) AS t(x)) AS w FROM range(-4, 5) AS t(d))
  SELECT (ix * 20 + iy)::INTEGER AS cell, ((ix + a.d) * 20 + iy + b.d)::INTEGER AS target, a.w * b.w AS w FROM range(10) AS i(ix), range(20) AS j(iy), taps AS a, taps AS b WHERE ix + a.d BETWEEN 0 AND 9 AND iy + b.d BETWEEN 0 AND 19)"""
COUNTS = f", cells AS (SELECT X, Y, {CELL} AS cell FROM (SELECT DISTINCT X, Y FROM shots)), counts AS (SELECT player_id, season, cell::INTEGER AS cell, count(*) AS n FROM shots JOIN cells USING (X, Y) WHERE {STYLE} GROUP BY ALL)"


@query("z1_cell_counts", S + COUNTS + " SELECT * FROM counts")
def _(spark, sf):
    return zones.cell_counts(shots(spark, sf))


@query("z3_smoothed_grid", S + COUNTS + f", {KERNEL}, spread AS (SELECT player_id, season, target AS cell, sum(n * w) AS mass FROM counts JOIN kern USING (cell) GROUP BY ALL) SELECT player_id, season, cell, round(mass / sum(mass) OVER (PARTITION BY player_id, season), 6) + 0.0 AS share FROM spread")
def _(spark, sf):
    return zones.smoothed(zones.cell_counts(shots(spark, sf))).withColumn("share", F.round("share", 6))


#: Zones made of the data, one for each situation, for the operators on components.
ZONES = S + COUNTS.replace("player_id, season, cell::INTEGER AS cell, count(*) AS n FROM shots", "dense_rank() OVER (ORDER BY shotType)::INTEGER AS zone, cell::INTEGER AS cell, n FROM (SELECT shotType, cell, count(*) AS n FROM shots").replace(f"WHERE {STYLE} GROUP BY ALL)", f"WHERE {STYLE} GROUP BY ALL))") + ", comp AS (SELECT zone, cell // 20 AS ix, cell % 20 AS iy, n::DOUBLE / sum(n) OVER (PARTITION BY zone) AS share FROM counts)"


def situation_zones(spark, sf):
    kinds = {"ECONOMY": 1, "LARGE": 2, "MEDIUM": 3, "PROMO": 4, "SMALL": 5, "STANDARD": 6}
    zone = F.create_map(*[F.lit(x) for p in kinds.items() for x in p])[F.col("shotType")].alias("zone")
    n = profiles.style_shots(shots(spark, sf)).groupBy(zone, zones.shot_cell(F.col("X"), F.col("Y")).alias("cell")).agg(F.count("*").alias("n"))
    total = n.groupBy("zone").agg(F.sum("n").alias("whole"))
    return n.join(total, "zone").select("zone", F.floor(F.col("cell") / 20).cast("int").alias("ix"), (F.col("cell") % 20).alias("iy"), (F.col("n") / F.col("whole")).alias("share"))


CENTRES = ', cen AS (SELECT zone, 105 - sum(share * (70 + (ix + 0.5) * 3.5)) / sum(share) AS depth, 34 - sum(share * ((iy + 0.5) * 3.4)) / sum(share) AS "lateral" FROM comp GROUP BY zone)'


@query("z7_zone_centres", ZONES + CENTRES + ' SELECT zone, round(depth, 6) AS depth, round("lateral", 6) AS "lateral" FROM cen')
def _(spark, sf):
    return zones.centres(situation_zones(spark, sf)).select("zone", F.round("depth", 6).alias("depth"), F.round("lateral", 6).alias("lateral"))


@query("z8_describe_zones", ZONES + CENTRES + """ SELECT zone, 'shots from ' || CASE WHEN depth < 9 THEN 'close range' || CASE WHEN side = '' THEN '' ELSE ', ' || side || ' side' END WHEN depth < 15 THEN 'the ' || CASE WHEN side = '' THEN 'centre' ELSE side END || ' of the box'
  WHEN depth < 20 THEN 'the edge of the box' || comma ELSE 'outside the box' || comma END AS label FROM (SELECT *, CASE WHEN side = '' THEN '' ELSE ', ' || side END AS comma FROM (SELECT *, CASE WHEN abs("lateral") < 4 THEN '' WHEN "lateral" > 0 THEN 'right' ELSE 'left' END AS side FROM cen))""")
def _(spark, sf):
    return zones.describe(zones.centres(situation_zones(spark, sf))).select("zone", "label")


@query("z9_zone_export", ZONES + " SELECT zone, string_agg(row, ';' ORDER BY x) AS grid FROM (SELECT z.zone, x, string_agg(round(coalesce(share, 0), 6)::DECIMAL(9,6)::VARCHAR, ',' ORDER BY y) AS row FROM (SELECT DISTINCT zone FROM comp) AS z CROSS JOIN range(10) AS a(x) CROSS JOIN range(20) AS b(y) LEFT JOIN comp AS c ON c.zone = z.zone AND c.ix = x AND c.iy = y GROUP BY z.zone, x) GROUP BY zone")
def _(spark, sf):
    line = lambda r: F.array_join(F.transform(r, lambda v: v.cast("decimal(9,6)").cast("string")), ",")
    return zones.export(situation_zones(spark, sf)).select("zone", F.array_join(F.transform("grid", line), ";").alias("grid"))


@query("s7_zones_document", ZONES + CENTRES + """ SELECT concat('zone_', zone) AS "column", ix::INTEGER AS ix, iy::INTEGER AS iy, round(share, 6) AS share, 105 AS length, 68 AS width FROM comp JOIN cen USING (zone) WHERE share > 0""")
def _(spark, sf):
    """The zones as one JSON document, written, read and taken apart again."""
    held = cut(situation_zones(spark, sf))
    document = io.zones_document(zones.export(held), zones.describe(zones.centres(held)), zones.X_EDGES, zones.Y_EDGES, 105, 68)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/zones-{uuid.uuid4().hex}"
    document.write.text(path)
    zone = spark.read.json(path).select("pitch.length", "pitch.width", F.explode("zones").alias("z"))
    cells = zone.select("length", "width", F.col("z.column").alias("column"), F.posexplode("z.grid").alias("ix", "row")).select("length", "width", "column", "ix", F.posexplode("row").alias("iy", "share"))
    return cells.where("share > 0").select("column", "ix", "iy", F.round("share", 6).alias("share"), F.col("length").cast("int").alias("length"), F.col("width").cast("int").alias("width"))


def situation_weights(spark, sf):
    """(player_id, season, zone, weight): the share of each shot type among a player's style shots."""
    kinds = {"ECONOMY": 1, "LARGE": 2, "MEDIUM": 3, "PROMO": 4, "SMALL": 5, "STANDARD": 6}
    zone = F.create_map(*[F.lit(x) for p in kinds.items() for x in p])[F.col("shotType")]
    n = profiles.style_shots(shots(spark, sf)).groupBy("player_id", "season", zone.alias("zone")).agg(F.count("*").alias("n"))
    return n.join(n.groupBy("player_id", "season").agg(F.sum("n").alias("whole")), ["player_id", "season"]).select("player_id", "season", "zone", (F.col("n") / F.col("whole")).alias("weight"))


@query("z10_heatmap", ZONES + f""", w AS (SELECT player_id, season, dense_rank() OVER (ORDER BY shotType)::INTEGER AS zone, n::DOUBLE / sum(n) OVER (PARTITION BY player_id, season) AS weight FROM (SELECT player_id, season, shotType, count(*) AS n FROM shots WHERE {STYLE} GROUP BY ALL)),
  mixed AS (SELECT player_id, season, ix, iy, sum(weight * share) AS value FROM w JOIN comp USING (zone) GROUP BY ALL) SELECT player_id, season, ix::INTEGER AS ix, iy::INTEGER AS iy, round(value, 6) AS value, round(pow(value / max(value) OVER (PARTITION BY player_id, season), 0.8), 6) AS opacity FROM mixed""")
def _(spark, sf):
    return zones.heatmap(situation_weights(spark, sf), situation_zones(spark, sf)).select("player_id", "season", "ix", "iy", F.round("value", 6).alias("value"), F.round("opacity", 6).alias("opacity"))


@query("z2_dense_grids", S + COUNTS + f", {KERNEL}, spread AS (SELECT player_id, season, target AS cell, sum(n * w) AS mass FROM counts JOIN kern USING (cell) GROUP BY ALL), keys AS (SELECT player_id, season, sum(mass) AS whole FROM spread GROUP BY ALL) SELECT k.player_id, k.season, c::INTEGER AS cell, round(coalesce(mass, 0) / whole, 6) + 0.0 AS share FROM keys AS k CROSS JOIN range(200) AS r(c) LEFT JOIN spread AS p ON p.player_id = k.player_id AND p.season = k.season AND p.cell = c")
def _(spark, sf):
    return zones.grids(shots(spark, sf)).select("player_id", "season", F.posexplode("grid").alias("cell", "share")).withColumn("share", F.round("share", 6) + 0.0)


@query("z10_zones_by_weight", S + f"""SELECT player_id, season, string_agg(zone, ',' ORDER BY n DESC, zone) AS zones FROM (SELECT player_id, season, dense_rank() OVER (ORDER BY shotType)::INTEGER AS zone, n FROM (SELECT player_id, season, shotType, count(*) AS n FROM shots WHERE {STYLE} GROUP BY ALL)) GROUP BY ALL""")
def _(spark, sf):
    return zones.by_weight(situation_weights(spark, sf)).select("player_id", "season", F.array_join(F.transform("zones", lambda z: z["zone"]), ",").alias("zones"))


@query("z4_fitted_zones")
def _(spark, sf):
    grid = cut(zones.grids(shots(spark, sf)))
    return zones.weights(grid, zones.fit(grid))


@query("z4_zone_certificate", S + f"SELECT season, TRUE AS converged, TRUE AS nonnegative, 4 AS zones, FALSE AS empty FROM shots WHERE {STYLE} GROUP BY season")
def _(spark, sf):
    """The zones of each season: what the fit itself certifies, since the components are those of no closed formula."""
    grid = zones.grids(shots(spark, sf), ["player_id", "season"])
    found = zones.fit_each(grid, "season", 4)
    rows = [(at, found.residual[at] <= zones.RESIDUAL, bool((h >= 0).all()), len(h), bool((h.sum(1) == 0).any())) for at, h in found.items()]
    return spark.createDataFrame(rows, "season int, converged boolean, nonnegative boolean, zones int, empty boolean")


@query("z6_zone_model")
def _(spark, sf):
    return zones.component_cells(spark, zones.zone_model(shots(spark, sf), appearances(spark, sf), built(spark, sf)))
