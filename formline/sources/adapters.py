"""Facts made of the driver's tables: appearances and shots, as DataFrames and as SQL.

A match is an order, a player a supplier, a team a nation, a league a market segment; see README.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.facts import LEAGUE_SCHEMA, MATCH_SCHEMA, ROSTER_FIELDS, SHOT_FIELDS
from ..session import table

MONEY = "decimal(18,2)"


def appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("match_id"), F.col("l_suppkey").alias("player_id")).agg(
        F.sum("l_quantity").cast("int").alias("minutes"),
        F.count_if(F.col("l_returnflag") == "R").cast("int").alias("goals"),
        F.count("*").alias("key_passes"),
        F.sum(F.col("l_discount").cast(MONEY)).alias("xA"),
        F.sum(F.col("l_discount").cast(MONEY) + F.col("l_tax").cast(MONEY)).alias("xGChain"),
        F.sum(F.col("l_tax").cast(MONEY)).alias("xGBuildup"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return (
        lines.join(orders, F.col("match_id") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(suppliers, F.col("player_id") == F.col("s_suppkey"))
        .select(
            "match_id", "player_id", F.col("s_name").alias("player"), F.col("n_name").alias("team"), F.col("c_mktsegment").alias("league"),
            F.year("o_orderdate").alias("season"), F.col("o_orderdate").alias("date"), F.col("o_orderpriority").alias("position"),
            (F.col("o_orderpriority") != "5-LOW").alias("started"), "minutes", "goals", "key_passes", "xA", "xGChain", "xGBuildup",
        )
    )


APPEARANCES_SQL = """
appearances AS (
  SELECT l.match_id, l.player_id, s_name AS player, n_name AS team, c_mktsegment AS league,
         CAST(year(o_orderdate) AS INTEGER) AS season, o_orderdate AS "date", o_orderpriority AS "position",
         o_orderpriority <> '5-LOW' AS started, l.minutes, l.goals, l.key_passes, l.xA, l.xGChain, l.xGBuildup
  FROM (SELECT l_orderkey AS match_id, l_suppkey AS player_id, CAST(sum(l_quantity) AS INTEGER) AS minutes,
               CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS INTEGER) AS goals, count(*) AS key_passes,
               sum(CAST(l_discount AS DECIMAL(18,2))) AS xA,
               sum(CAST(l_discount AS DECIMAL(18,2)) + CAST(l_tax AS DECIMAL(18,2))) AS xGChain,
               sum(CAST(l_tax AS DECIMAL(18,2))) AS xGBuildup
        FROM lineitem GROUP BY l_orderkey, l_suppkey) AS l
  JOIN orders ON l.match_id = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON l.player_id = s_suppkey)"""


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_discount", "l_returnflag", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type", "p_brand")
    flag = F.col("l_returnflag")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("l_orderkey").alias("match_id"), F.col("l_suppkey").alias("player_id"), F.col("l_linenumber").alias("shot_no"), F.year("o_orderdate").alias("season"),
            F.col("l_discount").cast(MONEY).alias("xG"), F.when(flag == "R", "Penalty").when(flag == "A", "OpenPlay").otherwise("SetPiece").alias("situation"),
            (F.col("p_size") == 1).alias("is_own_goal"), F.col("p_type").alias("shotType"), F.nullif("p_brand", F.lit("Brand#7")).alias("lastAction"),
            (F.col("p_size") / F.lit(50.0)).alias("X"), (F.col("l_quantity") / F.lit(50.0)).alias("Y"),
        )
    )


SHOTS_SQL = """
shots AS (
  SELECT l_orderkey AS match_id, l_suppkey AS player_id, l_linenumber AS shot_no, CAST(year(o_orderdate) AS INTEGER) AS season,
         CAST(l_discount AS DECIMAL(18,2)) AS xG,
         CASE l_returnflag WHEN 'R' THEN 'Penalty' WHEN 'A' THEN 'OpenPlay' ELSE 'SetPiece' END AS situation,
         p_size = 1 AS is_own_goal, p_type AS shotType, nullif(p_brand, 'Brand#7') AS lastAction,
         p_size / 50.0 AS X, l_quantity / 50.0 AS Y
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

#: What the adapter's codes mean for the operators.
SHOT_TYPES = {"SMALL": "head", "LARGE": "left_foot", "MEDIUM": "right_foot"}
RARE = 0.04
MIN_STARTS, MIN_MINUTES = 5, 2250
POSITIONS = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


#: Order keys that one page of a schedule spans, so that a page stays small however many orders there are.
PAGE = 65_536


def leagues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(league, season, dates): a raw schedule for each market segment and year, in pages of neighbouring order keys, by way of JSON."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    title = lambda c: F.struct(c.alias("title"))
    date = F.struct(
        F.col("o_orderkey").cast("string").alias("id"), (F.col("o_orderstatus") != "O").alias("isResult"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("datetime"),
        title(F.concat(F.lit("A&amp;"), "n_name")).alias("h"), title(F.concat(F.lit("B "), "c_mktsegment")).alias("a"),
    )
    page = F.floor(F.col("o_orderkey") / PAGE).alias("page")
    raw = orders.groupBy(F.col("c_mktsegment").alias("league"), F.year("o_orderdate").alias("season"), page).agg(F.to_json(F.struct(F.collect_list(date).alias("dates"))).alias("json"))
    return raw.select("league", "season", F.from_json("json", LEAGUE_SCHEMA)["dates"].alias("dates"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(match_id, rosters, shots): a raw document for each order, by way of JSON; a line is a roster entry and a shot."""
    text = lambda c: F.col(c).cast("string")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice"))
    number = (F.col("l_orderkey") * 100 + F.col("place")).cast("string")
    player = F.concat(F.lit("O&#039;"), text("l_suppkey"))
    roster = {"id": number, "player_id": text("l_suppkey"), "player": player, "position": F.when(F.col("l_linenumber") > 4, "Sub").otherwise("FW"), "time": F.col("l_quantity").cast("int").cast("string"), "xG": text("l_tax")}
    shot = {"id": number, "player_id": text("l_suppkey"), "player": player, "result": F.when(F.col("l_returnflag") == "R", "OwnGoal").otherwise("Goal"), "lastAction": F.when(F.col("l_linenumber") % 2 == 0, "None").otherwise("Pass"), "X": F.round(F.col("l_discount") * 10).cast("int").cast("string"), "minute": F.lit("7")}
    field = lambda given, name: given.get(name, F.lit("0") if given is roster else F.lit(None).cast("string")).alias(name)
    lines = table(spark, sf_dir, "lineitem").withColumn("place", place).select(
        F.col("l_orderkey").alias("match_id"), "place", F.when(F.col("l_suppkey") % 2 == 0, "h").otherwise("a").alias("side"),
        F.struct(*[field(roster, c) for c in ROSTER_FIELDS]).alias("r"), F.struct(*[field(shot, c) for c in SHOT_FIELDS]).alias("s"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("place", "r", "s")))
    sides = lines.groupBy("match_id", "side").agg(ordered.alias("e"))
    entries = F.map_from_entries(F.transform("e", lambda x: F.struct(x["r"]["id"], x["r"])))
    whole = sides.groupBy("match_id").agg(F.map_from_entries(F.collect_list(F.struct("side", entries))).alias("rosters"), F.map_from_entries(F.collect_list(F.struct("side", F.transform("e", lambda x: x["s"])))).alias("shots"))
    parsed = F.from_json(F.to_json(F.struct("rosters", "shots")), MATCH_SCHEMA)
    return whole.select("match_id", parsed.alias("d")).select("match_id", "d.rosters", "d.shots")


#: The same fixtures, and the entries of the documents with a finished fixture, as SQL.
DOCUMENTS_SQL = """
fixtures AS (SELECT c_mktsegment AS league, year(o_orderdate)::INTEGER AS season, o_orderkey AS match_id, date_trunc('second', o_orderdate)::TIMESTAMP AS "date", 'A&amp;' || n_name AS home, 'B ' || c_mktsegment AS away
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus <> 'O'),
entries AS (SELECT *, CASE side WHEN 'h' THEN home ELSE away END AS team, row_number() OVER (PARTITION BY match_id, side ORDER BY id)::INTEGER - 1 AS "at" FROM (
  SELECT f.*, CASE WHEN l_suppkey % 2 = 0 THEN 'h' ELSE 'a' END AS side, l_linenumber, l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice) AS id, l_suppkey AS player_id, l_quantity::INTEGER AS minutes, l_tax, l_linenumber > 4 AS sub,
    CASE l_returnflag WHEN 'R' THEN 'OwnGoal' ELSE 'Goal' END AS result, CASE WHEN l_linenumber % 2 = 0 THEN 'None' ELSE 'Pass' END AS lastAction, round(l_discount * 10)::INTEGER AS X FROM lineitem JOIN fixtures AS f ON l_orderkey = f.match_id))"""


def sound_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(match_id, rosters, shots) of every order such that the checks hold: a roster entry for each player, a shot for each line.

    Every tenth order repeats its first shot and each roster entry under other ids; every 97th has a shot whose X is no number.
    """
    text = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice"))
    lines = table(spark, sf_dir, "lineitem").withColumn("place", place).withColumn("number", F.col("l_orderkey") * 100 + F.col("place"))
    own, number, repeated = F.col("l_returnflag") == "R", F.col("number"), F.col("l_orderkey") % 10 == 0
    player = F.concat(F.lit("P"), text("l_suppkey"))

    def struct(given: dict, names: list[str], other: str | None) -> F.Column:
        return F.struct(*[given.get(c, F.lit(other)).cast("string").alias(c) for c in names])

    shot = lambda i: struct({
        "id": i, "player_id": F.col("l_suppkey"), "player": player, "result": F.when(own, "OwnGoal").otherwise("Goal"), "situation": F.when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 1), "Penalty").otherwise("OpenPlay"),
        "shotType": F.element_at(F.array(F.lit("Head"), F.lit("LeftFoot"), F.lit("RightFoot")), F.col("l_linenumber") % 3 + 1), "lastAction": F.when(F.col("l_linenumber") % 5 == 0, "None").when(F.col("l_linenumber") % 2 == 0, "Pass").otherwise("Cross"),
        "X": F.when((F.col("l_orderkey") % 97 == 0) & (F.col("place") == 1), F.lit("n/a")).otherwise(text("l_discount")), "Y": F.col("l_tax"), "xG": F.col("l_discount"), "minute": F.col("place"),
    }, SHOT_FIELDS, None)
    shots = F.when(repeated & (F.col("place") == 1), F.array(shot(number), shot(number + 50))).otherwise(F.array(shot(number)))
    players = lines.groupBy("l_orderkey", "l_suppkey").agg(
        F.min("number").alias("number"), F.min("l_linenumber").alias("line"), F.least(F.sum("l_quantity").cast("int"), F.lit(130)).alias("minutes"), F.count_if(~own).alias("shots"), F.count_if(own).alias("own_goals"), F.count("*").alias("passes"),
        F.sum(F.col("l_tax").cast(MONEY)).alias("tax"), F.sum(F.col("l_discount").cast(MONEY)).alias("discount"), F.array_sort(F.collect_list(F.struct("number", shots.alias("s")))).alias("s"),
    )
    entry = lambda i: struct({
        "id": i, "player_id": F.col("l_suppkey"), "player": player, "team_id": F.lit(1), "position": F.when(F.col("line") > 3, "Sub").when(F.col("l_suppkey") % 2 == 0, "FW").otherwise("AMC"), "time": F.col("minutes"), "shots": F.col("shots"), "own_goals": F.col("own_goals"),
        "key_passes": F.col("passes"), "xA": F.col("tax"), "xGChain": F.col("discount") + F.col("tax"), "xGBuildup": F.col("tax"),
    }, ROSTER_FIELDS, "0")
    entries = F.when(repeated, F.array(entry(number), entry(number + 50))).otherwise(F.array(entry(number)))
    sides = players.groupBy(F.col("l_orderkey").alias("match_id"), F.when(F.col("l_suppkey") % 2 == 0, "h").otherwise("a").alias("side")).agg(F.flatten(F.collect_list(entries)).alias("r"), F.flatten(F.transform(F.array_sort(F.flatten(F.collect_list("s"))), lambda x: x["s"])).alias("s"))
    by_id = F.map_from_entries(F.transform("r", lambda x: F.struct(x["id"], x)))
    return sides.groupBy("match_id").agg(F.map_from_entries(F.collect_list(F.struct("side", by_id))).alias("rosters"), F.map_from_entries(F.collect_list(F.struct("side", "s"))).alias("shots"))


#: The facts that these documents make, without the matches that hold a bad number, as SQL.
SOUND_SQL = """
fixtures AS (SELECT c_mktsegment AS league, year(o_orderdate)::INTEGER AS season, o_orderkey AS match_id, date_trunc('second', o_orderdate)::TIMESTAMP AS "date", 'A&' || n_name AS home, 'B ' || c_mktsegment AS away
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus <> 'O'),
shots AS (SELECT f.*, l_suppkey AS player_id, l_returnflag = 'R' AS is_own_goal, CASE WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN 'Penalty' ELSE 'OpenPlay' END AS situation, ['head', 'left_foot', 'right_foot'][l_linenumber % 3 + 1] AS kind,
    CASE WHEN l_linenumber % 5 = 0 THEN NULL WHEN l_linenumber % 2 = 0 THEN 'Pass' ELSE 'Cross' END AS lastAction, l_discount AS xG
  FROM lineitem JOIN fixtures AS f ON l_orderkey = f.match_id WHERE l_orderkey % 97 <> 0),
appearances AS (SELECT f.*, player_id, CASE WHEN player_id % 2 = 0 THEN home ELSE away END AS team, CASE WHEN line > 3 THEN 'Sub' WHEN player_id % 2 = 0 THEN 'FW' ELSE 'AMC' END AS "position", minutes, xA, key_passes
  FROM (SELECT l_orderkey, l_suppkey AS player_id, min(l_linenumber) AS line, least(sum(l_quantity)::INTEGER, 130) AS minutes, sum(l_tax) AS xA, count(*) AS key_passes FROM lineitem WHERE l_orderkey % 97 <> 0 GROUP BY l_orderkey, l_suppkey)
  JOIN fixtures AS f ON l_orderkey = f.match_id)"""
