"""Queries on facts, data quality and recency."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import facts, windows
from ..session import cut, ensure_checkpoint_dir, table
from ..sources import io
from ..sources.adapters import APPEARANCES_SQL, DOCUMENTS_SQL, SHOTS_SQL, SOUND_SQL, appearances, documents, leagues, shots, sound_documents
from ..streaming import incremental
from ..sources.versions import Versions
from .registry import query

A, S, AS, D = f"WITH {APPEARANCES_SQL} ", f"WITH {SHOTS_SQL} ", f"WITH {APPEARANCES_SQL}, {SHOTS_SQL} ", f"WITH {DOCUMENTS_SQL} "
METRICS = ["click", "purchase", "view"]


@query("s5_appearances", A + 'SELECT match_id, player_id, player, team, league, season, "date", "position", started, minutes, goals, key_passes, CAST(xA AS DOUBLE) AS xA, CAST(xGChain AS DOUBLE) AS xGChain FROM appearances')
def _(spark, sf):
    return appearances(spark, sf).select("match_id", "player_id", "player", "team", "league", "season", "date", "position", "started", "minutes", "goals", "key_passes", F.col("xA").cast("double").alias("xA"), F.col("xGChain").cast("double").alias("xGChain"))


def joined(spark, sf):
    return facts.join_fixtures(documents(spark, sf), facts.finished_fixtures(leagues(spark, sf)))


@query("p1_finished_fixtures", D + 'SELECT league, season, match_id, "date", home, away FROM fixtures')
def _(spark, sf):
    return facts.finished_fixtures(leagues(spark, sf))


@query("p2_joined_documents", D + 'SELECT match_id, league, season, "date", home, away, count(DISTINCT side)::INTEGER AS sides FROM entries GROUP BY ALL')
def _(spark, sf):
    return joined(spark, sf).select("match_id", "league", "season", "date", "home", "away", F.size("rosters").alias("sides"))


@query("p3_flatten_shots", D + 'SELECT match_id, side, team, league, season, "date", "at", id::VARCHAR AS id, player_id::VARCHAR AS player_id, result, lastAction, X::VARCHAR AS X FROM entries')
def _(spark, sf):
    return facts.flatten_shots(joined(spark, sf)).select("match_id", "side", "team", "league", "season", "date", "at", "id", "player_id", "result", "lastAction", "X")


@query("p4_flatten_rosters", D + 'SELECT match_id, side, team, league, season, "date", "at", id::VARCHAR AS id, player_id::VARCHAR AS player_id, minutes::VARCHAR AS "time" FROM entries')
def _(spark, sf):
    return facts.flatten_rosters(joined(spark, sf)).select("match_id", "side", "team", "league", "season", "date", "at", "id", "player_id", "time")


@query("p5_dedupe_roster", D + 'SELECT match_id, side, player_id::VARCHAR AS player_id, min("at") AS "at", min(id)::VARCHAR AS id FROM entries GROUP BY match_id, side, player_id')
def _(spark, sf):
    return facts.dedupe_roster(facts.flatten_rosters(joined(spark, sf))).select("match_id", "side", "player_id", "at", "id")


@query("p6_dedupe_shots", D + 'SELECT match_id, side, player_id::VARCHAR AS player_id, min("at") AS "at", min(id)::VARCHAR AS id FROM entries GROUP BY match_id, side, player_id, result, lastAction, X')
def _(spark, sf):
    return facts.dedupe_shots(facts.flatten_shots(joined(spark, sf))).select("match_id", "side", "player_id", "at", "id")


def place(spark, name):
    """A new folder among the shared checkpoints."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("s3_csv_gz", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders")
def _(spark, sf):
    path = place(spark, "csv")
    table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").write.option("header", True).option("compression", "gzip").csv(path)
    return io.read_csv(spark, path, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string", "o_orderkey")


@query("s5_facts_by_season", A + "SELECT match_id, player_id, minutes, season, league FROM appearances")
def _(spark, sf):
    path = place(spark, "facts")
    io.write_facts(appearances(spark, sf).select("match_id", "player_id", "minutes", "season", "league"), path)
    return io.read_facts(spark, path, ["match_id", "player_id", "minutes", "season", "league"])


@query("s6_small_csv", "SELECT n_nationkey, n_name FROM nation")
def _(spark, sf):
    path = place(spark, "mapping")
    io.write_small_csv(table(spark, sf, "nation").select("n_nationkey", "n_name"), path)
    return io.read_csv(spark, path, "n_nationkey int, n_name string")


@query("p7_duplicate_report", "SELECT l_orderkey, count(*) AS dropped FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem) WHERE n > 1 GROUP BY l_orderkey")
def _(spark, sf):
    return facts.duplicate_report(table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber"), ["l_orderkey", "l_suppkey"], ["l_linenumber", "l_partkey"], "dropped", "l_orderkey")


@query("p8_clean_shots", D + """SELECT id AS shot_id, match_id, player_id, X::DOUBLE AS X, NULL::DOUBLE AS Y, 7 AS minute, concat('O', chr(39), player_id) AS player, replace(team, '&amp;', '&') AS team, league, season, "date", result, nullif(lastAction, 'None') AS lastAction, result = 'OwnGoal' AS is_own_goal
  FROM (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY match_id, side, player_id, result, lastAction, X ORDER BY "at") = 1)""")
def _(spark, sf):
    made = facts.flatten_matches(documents(spark, sf), facts.finished_fixtures(leagues(spark, sf)))[0]
    return made.select("shot_id", "match_id", "player_id", "X", "Y", "minute", "player", "team", "league", "season", "date", "result", "lastAction", "is_own_goal")


@query("p8_clean_rosters", D + """SELECT id AS roster_id, match_id, player_id, concat('O', chr(39), player_id) AS player, replace(team, '&amp;', '&') AS team, league, season, "date", NOT sub AS started, minutes, l_tax AS xG, 0 AS goals
  FROM (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY match_id, side, player_id ORDER BY "at") = 1)""")
def _(spark, sf):
    made = facts.flatten_matches(documents(spark, sf), facts.finished_fixtures(leagues(spark, sf)))[1]
    return made.select("roster_id", "match_id", "player_id", "player", "team", "league", "season", "date", "started", "minutes", "xG", "goals")


@query("p11_html_unescape", "SELECT page_id, replace(replace(replace(replace(replace(replace(html, '&#039;', ''''), '&#39;', ''''), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS html FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", facts.unescape_common(F.col("html")).alias("html"))


@query("p14_union_sources", "SELECT c_custkey AS id, c_name AS name, 'customer' AS kind, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier', NULL FROM supplier")
def _(spark, sf):
    from ..operators.profiles import union_all

    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("customer").alias("kind"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("kind"))
    return union_all([c, s])


@query("v1_duplicate_ids", "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1")
def _(spark, sf):
    return facts.duplicated(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"), ["l_orderkey", "l_linenumber"])


@query("v2_duplicate_appearance", "SELECT l_orderkey AS match_id, l_suppkey AS player_id, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("match_id"), F.col("l_suppkey").alias("player_id"))
    return facts.duplicated(rows, ["match_id", "player_id"]).groupBy("match_id", "player_id").agg(F.count("*").alias("n"))


@query("v3_range_check", S + "SELECT count(*) FILTER (WHERE NOT coalesce(X BETWEEN 0 AND 0.9, FALSE)) AS x_outside, count(*) FILTER (WHERE NOT coalesce(Y BETWEEN 0.1 AND 1, FALSE)) AS y_outside, count(*) FILTER (WHERE NOT coalesce(xG BETWEEN 0 AND 1, FALSE)) AS xg_outside FROM shots")
def _(spark, sf):
    return shots(spark, sf).agg(F.count_if(facts.outside("X", 0, 0.9)).alias("x_outside"), F.count_if(facts.outside("Y", 0.1, 1)).alias("y_outside"), F.count_if(facts.outside("xG", 0, 1)).alias("xg_outside"))


@query("v4_minutes_check", A + "SELECT match_id, player_id, minutes FROM appearances WHERE NOT coalesce(minutes BETWEEN 0 AND 45, FALSE)")
def _(spark, sf):
    return appearances(spark, sf).where(facts.outside("minutes", 0, 45)).select("match_id", "player_id", "minutes")


@query("v5_orphans", AS + "SELECT match_id, player_id, shot_no FROM shots AS s WHERE NOT EXISTS (SELECT 1 FROM appearances AS a WHERE a.match_id = s.match_id AND a.player_id = s.player_id AND started)")
def _(spark, sf):
    return facts.orphans(shots(spark, sf), appearances(spark, sf).where("started")).select("match_id", "player_id", "shot_no")


@query("v6_reconcile_shots", AS + "SELECT a.match_id, a.player_id, a.key_passes, coalesce(n, 0) AS events FROM appearances AS a LEFT JOIN (SELECT match_id, player_id, count(*) AS n FROM shots WHERE NOT is_own_goal GROUP BY ALL) AS s ON a.match_id = s.match_id AND a.player_id = s.player_id WHERE a.key_passes <> coalesce(n, 0)")
def _(spark, sf):
    s = shots(spark, sf).where("not is_own_goal")
    return facts.mismatches(appearances(spark, sf), s, "key_passes").select("match_id", "player_id", "key_passes", "events")


@query("v7_reconcile_goals", AS + "SELECT a.match_id, a.player_id, a.goals, coalesce(n, 0) AS events FROM appearances AS a LEFT JOIN (SELECT match_id, player_id, count(*) AS n FROM shots WHERE is_own_goal GROUP BY ALL) AS s ON a.match_id = s.match_id AND a.player_id = s.player_id WHERE a.goals <> coalesce(n, 0)")
def _(spark, sf):
    return facts.mismatches(appearances(spark, sf), shots(spark, sf).where("is_own_goal"), "goals").select("match_id", "player_id", "goals", "events")


@query(
    "v8_violations",
    AS
    + """, bad AS (
  SELECT 'minutes outside [0, 130]' AS "check", concat_ws('/', match_id, player_id) AS key FROM appearances WHERE NOT coalesce(minutes BETWEEN 0 AND 130, FALSE)
  UNION ALL SELECT 'shots don''t reconcile', concat_ws('/', a.match_id, a.player_id) FROM (SELECT *, CAST(key_passes AS INTEGER) AS shots FROM appearances) AS a LEFT JOIN (SELECT match_id, player_id, count(*) AS n FROM shots WHERE NOT is_own_goal GROUP BY ALL) AS s ON a.match_id = s.match_id AND a.player_id = s.player_id WHERE a.shots <> coalesce(n, 0)
  UNION ALL SELECT 'own goals don''t reconcile', concat_ws('/', a.match_id, a.player_id) FROM appearances AS a LEFT JOIN (SELECT match_id, player_id, count(*) AS n FROM shots WHERE is_own_goal GROUP BY ALL) AS s ON a.match_id = s.match_id AND a.player_id = s.player_id WHERE a.goals <> coalesce(n, 0)
  UNION ALL SELECT 'duplicate shot_id', concat_ws('/', match_id, player_id, shot_id) FROM (SELECT *, count(*) OVER (PARTITION BY shot_id) AS c FROM (SELECT match_id, player_id, match_id * 10 + shot_no AS shot_id FROM shots)) WHERE c > 1)
SELECT "check", count(*) AS violations, array_to_string(list_sort(list(key ORDER BY key))[1:10], ',') AS sample FROM bad GROUP BY "check" """,
)
def _(spark, sf):
    s = shots(spark, sf).withColumn("shot_id", F.col("match_id") * 10 + F.col("shot_no"))
    a = appearances(spark, sf).withColumns({"shots": F.col("key_passes").cast("int"), "own_goals": F.col("goals")})
    return facts.violations(s, a).withColumn("sample", F.array_join("sample", ","))


RECENT = """, recent AS (
  SELECT *, max(season) OVER (PARTITION BY player_id) AS window_season FROM (
    SELECT *, coalesce(sum(minutes) OVER (PARTITION BY player_id ORDER BY "date" DESC, match_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM appearances)
  WHERE before < 2000)"""


@query("r1_recent_window", A + RECENT + ' SELECT match_id, player_id, "date", minutes, CAST(window_season AS INTEGER) AS season FROM recent')
def _(spark, sf):
    return windows.recent_window(appearances(spark, sf)).select("match_id", "player_id", "date", "minutes", "season")


@query("r1_recent_events", "SELECT user_id, event_id, value FROM (SELECT *, coalesce(sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events) WHERE before < 100")
def _(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", "value", F.col("value").cast("decimal(18,2)").alias("amount"))
    return windows.recent_window(e, 100, "user_id", ("ts", "event_id"), "amount", None).select("user_id", "event_id", "value")


@query("r3_active_players", A + "SELECT player_id, max(season) = (SELECT max(season) FROM appearances) AS active FROM appearances GROUP BY player_id")
def _(spark, sf):
    return windows.active_players(appearances(spark, sf))


@query("r4_window_dates", A + RECENT + ' SELECT player_id, CAST(window_season AS INTEGER) AS season, min("date") AS window_start, max("date") AS window_end FROM recent GROUP BY ALL')
def _(spark, sf):
    return windows.window_dates(windows.recent_window(appearances(spark, sf)), ["player_id", "season"])


@query("r6_active_summary", A + RECENT + """, dated AS (SELECT player_id, min("date") AS s, max("date") AS e FROM recent GROUP BY ALL), act AS (SELECT player_id, max(season) = (SELECT max(season) FROM appearances) AS active FROM appearances GROUP BY player_id)
SELECT count(*) AS profiles, count(*) FILTER (WHERE active) AS active, min(s) AS first_start, max(s) AS last_start, min(e) AS first_end, max(e) AS last_end FROM dated JOIN act USING (player_id)""")
def _(spark, sf):
    a = appearances(spark, sf)
    w = windows.recent_window(a)
    by = ["player_id", "season"]
    return windows.active_summary(windows.attach(w.select(*by).distinct(), w, a, by))


@query("i1_pending", "SELECT year(o_orderdate)::INTEGER AS season, count(*) AS finished, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')) AS to_fetch FROM orders WHERE o_orderstatus <> 'O' GROUP BY ALL")
def _(spark, sf):
    finished = table(spark, sf, "orders").where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("match_id"), F.year("o_orderdate").alias("season"))
    landed = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("match_id"))
    return incremental.pending_counts(finished, landed, group="season")


@query("i1_pending_matches", D + "SELECT match_id FROM fixtures WHERE match_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(spark, sf):
    landed = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("match_id"))
    return incremental.pending(facts.finished_fixtures(leagues(spark, sf)), landed).select("match_id")


@query("i2_land_once", "SELECT user_id * 10 + length(event_type) AS match_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def _(spark, sf):
    """Events land in two runs, the newer half first; then all land again. The first of a key counts."""
    events = table(spark, sf, "events")
    rows = events.select((F.col("user_id") * 10 + F.length("event_type")).alias("match_id"), "event_id", F.col("ts").alias("landed"))
    path = place(spark, "landed")
    versions = Versions(spark, path)
    first = rows.groupBy("match_id").agg(F.min_by("landed", F.struct("landed", "event_id")).alias("at"))
    for part in (rows.join(first, "match_id").where("landed <= at + interval 1 day").drop("at"), rows):
        part.write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(part.schema).parquet(f"{path}/in")
        incremental.run_available(stream, incremental.land_once(versions, order=("landed", "event_id")), f"{path}/state")
    return versions.table("rows").select("match_id", "event_id")


def weeks(spark, sf, corrections=True):
    """A refresh of two runs over sound documents: odd orders, then even ones together with documents that landed before or don't parse."""
    path = place(spark, "refresh")
    docs = sound_documents(spark, sf).select("match_id", F.concat("match_id", F.lit(".json")).alias("file"), F.lit(1).cast("timestamp").alias("landed"), "rosters", "shots", F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("record"))
    fixtures = cut(facts.finished_fixtures(leagues(spark, sf)))
    job = incremental.Refresh(spark, path, fixtures)
    odd = F.col("match_id") % 2 == 1
    again = docs.where(odd & (F.col("match_id") % 3 == 0) & (F.col("match_id") % 97 != 0)).withColumns({"landed": F.lit(90 * 86400).cast("timestamp"), "shots": F.create_map().cast(docs.schema["shots"].dataType)})
    broken = docs.where(F.col("match_id") % 50 == 0).select(F.lit(None).cast("long").alias("match_id"), "file", "landed", *[F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in ("rosters", "shots")], F.lit("not JSON").alias("reason"), F.lit("{").alias("record"))
    for part in (docs.where(odd), docs.where(~odd).unionByName(again).unionByName(broken)):
        part.write.mode("append").parquet(f"{path}/in")
        incremental.run_available(spark.readStream.schema(docs.schema).parquet(f"{path}/in"), job.batch, f"{path}/checkpoint")
    return job


PROFILE_SQL = """SELECT '{mode}' AS mode, player_id, season, minutes::BIGINT AS minutes, starts, primary_position, coalesce(shots, 0)::BIGINT AS shots, round(coalesce(npxg, 0) * 100)::BIGINT AS npxg_hundredths, round(xa * 100)::BIGINT AS xa_hundredths,
    nullif(head, CASE WHEN coalesce(shots, 0) = 0 THEN head END)::BIGINT AS heads, nullif(missing, CASE WHEN coalesce(shots, 0) = 0 THEN missing END)::BIGINT AS missing, window_start, window_end, active
  FROM (SELECT player_id, season, sum(minutes) AS minutes, count(*) FILTER (WHERE "position" <> 'Sub') AS starts, max("position") FILTER (WHERE "position" <> 'Sub') AS primary_position, sum(xA) AS xa, {dates} FROM {apps} GROUP BY player_id, season)
  LEFT JOIN (SELECT player_id, a.season, count(*) FILTER (WHERE situation <> 'Penalty' AND NOT is_own_goal) AS shots, sum(xG) FILTER (WHERE situation <> 'Penalty' AND NOT is_own_goal) AS npxg,
    count(*) FILTER (WHERE kind = 'head' AND situation <> 'Penalty' AND NOT is_own_goal) AS head, count(*) FILTER (WHERE lastAction IS NULL AND situation <> 'Penalty' AND NOT is_own_goal) AS missing
    FROM shots AS s JOIN (SELECT match_id, player_id, season FROM {apps}) AS a USING (match_id, player_id) GROUP BY ALL) USING (player_id, season) {active}"""


@query(
    "i3_refreshed_profiles",
    f"""WITH {SOUND_SQL}, recent AS (SELECT match_id, player_id, "date", "position", minutes, xA, max(season) OVER (PARTITION BY player_id) AS season FROM (SELECT *, coalesce(sum(minutes) OVER (PARTITION BY player_id ORDER BY "date" DESC, match_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM appearances) WHERE before < 600),
  act AS (SELECT player_id, max(season) = (SELECT max(season) FROM appearances) AS active FROM appearances GROUP BY player_id)
  {PROFILE_SQL.format(mode="season", apps="appearances", dates="NULL::TIMESTAMP AS window_start, NULL::TIMESTAMP AS window_end, NULL::BOOLEAN AS active", active="")}
  UNION ALL {PROFILE_SQL.format(mode="recent", apps="recent", dates='min("date") AS window_start, max("date") AS window_end', active="JOIN act USING (player_id)")}""",
)
def _(spark, sf):
    job = weeks(spark, sf)
    job.window_minutes = 600
    job.finish(min_starts=0, min_minutes=0, positions=None)
    columns = ["player_id", "season", "minutes", "starts", "primary_position", "shots"]
    columns += [F.round(F.col(f"{c}_per90") * F.col("minutes") / 90 * 100).cast("long").alias(f"{c}_hundredths") for c in ("npxg", "xa")]  # sums again, which no order of adding changes
    columns += [F.round(F.col(c) * F.col("shots")).cast("long").alias(name) for c, name in (("shot_type_head", "heads"), ("last_action_missing", "missing"))]
    none = [F.lit(None).cast(t).alias(c) for c, t in (("window_start", "timestamp"), ("window_end", "timestamp"), ("active", "boolean"))]
    season = job.public.table("profiles").select(F.lit("season").alias("mode"), *columns, *none)
    return season.unionByName(job.public.table("profiles_recent").select(F.lit("recent").alias("mode"), *columns, "window_start", "window_end", "active"))


@query(
    "i4_run_counters",
    f"""WITH {SOUND_SQL}, l AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), good AS (SELECT * FROM lineitem JOIN fixtures ON l_orderkey = match_id WHERE l_orderkey % 97 <> 0)
  SELECT 'landed' AS name, (SELECT count(*) FROM l) + (SELECT count(*) FROM l WHERE k % 6 = 3 AND k % 97 <> 0) + (SELECT count(*) FROM l WHERE k % 50 = 0) AS n
  UNION ALL SELECT 'corrupt', count(*) FROM l WHERE k % 50 = 0
  UNION ALL SELECT 'set_aside', count(*) FROM l JOIN fixtures ON k = match_id WHERE k % 97 = 0
  UNION ALL SELECT 'taken', (SELECT count(*) FROM l) - (SELECT count(*) FROM l JOIN fixtures ON k = match_id WHERE k % 97 = 0)
  UNION ALL SELECT 'dropped_shots', count(DISTINCT l_orderkey) FROM good WHERE l_orderkey % 10 = 0
  UNION ALL SELECT 'dropped_appearances', count(DISTINCT (l_orderkey, l_suppkey)) FROM good WHERE l_orderkey % 10 = 0
  UNION ALL SELECT 'shots', count(*) FROM good UNION ALL SELECT 'appearances', count(DISTINCT (l_orderkey, l_suppkey)) FROM good""",
)
def _(spark, sf):
    found = incremental.totals(weeks(spark, sf).progress.history())
    names = ["landed", "corrupt", "set_aside", "taken", "dropped_shots", "dropped_appearances", "shots", "appearances"]
    return spark.createDataFrame([(c, found[c]) for c in names], "name string, n long")


@query("s4_mapping_with_comments", "SELECT c_custkey::INTEGER AS c_custkey, c_name FROM customer WHERE c_custkey % 7 <> 0")
def _(spark, sf):
    """A hand-kept table in which every seventh line is a remark."""
    path = place(spark, "mapping")
    c = table(spark, sf, "customer")
    line = F.concat(F.when(F.col("c_custkey") % 7 == 0, "# ").otherwise(""), F.col("c_custkey"), F.lit(","), F.col("c_name"))
    head = spark.createDataFrame([(-1, "c_custkey,c_name")], "at long, value string")
    head.unionByName(c.select(F.col("c_custkey").cast("long").alias("at"), line.alias("value"))).coalesce(1).sortWithinPartitions("at").select("value").write.text(path)
    return io.read_csv(spark, path, "c_custkey int, c_name string", comment="#")


@query("s8_run_status", "SELECT o_orderstatus AS step, count(*) AS n, count(*) > 100 AS ok, round(sum(o_custkey) / count(*), 3) AS mean FROM orders GROUP BY 1")
def _(spark, sf):
    """A record for each order status, with its types, as runs would append them."""
    path = place(spark, "status")
    found = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_custkey") / F.count("*"), 3).alias("mean")).collect()  # three rows
    for r in found:
        io.append_status(spark, path, {"step": r.o_orderstatus, "n": r.n, "ok": r.n > 100, "mean": r.mean, "failed": None})
    return spark.read.json(path).select("step", "n", "ok", "mean")


@query("v9_published_facts", f"WITH {SOUND_SQL} SELECT season, league, count(*) AS shots, (SELECT count(*) FROM appearances AS a WHERE a.season = s.season AND a.league = s.league) AS appearances, FALSE AS bad_published FROM shots AS s GROUP BY season, league")
def _(spark, sf):
    """Facts that pass the checks are published; the same with one shot less aren't, and leave what is there."""
    path = place(spark, "facts")
    made = [cut(df) for df in facts.flatten_checked(sound_documents(spark, sf).where("match_id % 97 <> 0"), facts.finished_fixtures(leagues(spark, sf)))]
    facts.publish(made[0], made[1], path)
    try:
        facts.publish(made[0].where("minute > 1"), made[1], path)
        bad = True
    except facts.ValidationError:
        bad = False
    held = Versions(spark, path)
    n = {name: held.table(name).groupBy("season", "league").agg(F.count("*").alias(name)) for name in ("shots", "appearances")}
    return n["shots"].join(n["appearances"], ["season", "league"], "left").withColumn("bad_published", F.lit(bad))


@query("s1_rejected_numbers", f"""SELECT l_orderkey AS match_id, 'shots' AS source, (l_orderkey * 100 + n)::VARCHAR AS id, 'X' AS "column", 'n/a' AS value, 'not a number: X' AS reason FROM (SELECT DISTINCT l_orderkey FROM lineitem JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O') ON l_orderkey = o_orderkey WHERE l_orderkey % 97 = 0), unnest([1, 51]) AS t(n) WHERE n = 1 OR l_orderkey % 10 = 0""")
def _(spark, sf):
    flat = facts.flatten_shots(facts.join_fixtures(sound_documents(spark, sf), facts.finished_fixtures(leagues(spark, sf))))
    return facts.quarantined(flat, facts.SHOT_NUMBERS, "shots")[1]


@query("s10_latest_metric", " UNION ALL ".join(f"SELECT '{m}' AS metric, arg_max(value, event_id) AS value, max(event_id) AS run_ts FROM events WHERE event_type = '{m}' AND user_id % 2 = 0" for m in METRICS))
def _(spark, sf):
    logged = table(spark, sf, "events").select(F.col("event_type").alias("metric"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("config"), F.col("value").alias("mean"), F.col("event_id").alias("run_ts"))
    path = place(spark, "metrics")
    for config in ("even", "odd"):  # as two runs would append them
        io.append_metrics(logged.where(F.col("config") == config), path)
    logged = spark.read.parquet(path)
    found = [io.latest_metric(logged, m, "even").select(F.lit(m).alias("metric"), "value", "run_ts") for m in METRICS]
    return reduce(DataFrame.unionByName, found)
