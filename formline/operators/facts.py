"""From raw match documents to validated facts."""

from __future__ import annotations

import html
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.versions import Versions

#: The raw fields, all strings.
ROSTER_FIELDS = ["id", "player_id", "player", "team_id", "position", "time", "goals", "own_goals", "shots", "xG", "xA", "assists", "key_passes", "xGChain", "xGBuildup", "yellow_card", "red_card", "roster_in", "roster_out"]
SHOT_FIELDS = ["id", "player_id", "player", "player_assisted", "result", "situation", "shotType", "lastAction", "X", "Y", "xG", "minute"]
_ROSTER = "struct<" + ",".join(f"{c}:string" for c in ROSTER_FIELDS) + ">"
_SHOT = "struct<" + ",".join(f"{c}:string" for c in SHOT_FIELDS) + ">"
MATCH_SCHEMA = f"rosters map<string,map<string,{_ROSTER}>>, shots map<string,array<{_SHOT}>>"
LEAGUE_SCHEMA = "dates array<struct<id:string,isResult:boolean,datetime:string,h:struct<title:string>,a:struct<title:string>>>"

#: The entities that built-in functions decode; the whole HTML table needs the helper.
COMMON_ENTITIES = {"&#039;": "'", "&#39;": "'", "&quot;": '"', "&lt;": "<", "&gt;": ">", "&amp;": "&"}


def finished_fixtures(leagues: DataFrame) -> DataFrame:
    """leagues: league, season, dates -> one row for each finished fixture."""
    return leagues.select("league", "season", F.explode("dates").alias("d")).where("d.isResult").select(
        "league", "season", F.col("d.id").cast("long").alias("match_id"), F.to_timestamp("d.datetime").alias("date"), F.col("d.h.title").alias("home"), F.col("d.a.title").alias("away")
    )


def join_fixtures(documents: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Documents with their fixture's columns; fixtures whose document hasn't landed are left out."""
    return documents.join(fixtures, "match_id")


def _sided(documents: DataFrame, column: str, keep: list[str]) -> DataFrame:
    side = documents.select("match_id", *keep, F.explode(column).alias("side", "entries"))
    return side.withColumn("team", F.when(F.col("side") == "h", F.col("home")).otherwise(F.col("away")))


def flatten_shots(documents: DataFrame) -> DataFrame:
    """One row for each shot, with the side's team, the league, season and date, and its place in the list."""
    rows = _sided(documents, "shots", ["league", "season", "date", "home", "away"])
    return rows.select("match_id", "side", "team", "league", "season", "date", F.posexplode("entries").alias("at", "s")).select("match_id", "side", "team", "league", "season", "date", "at", "s.*")


def flatten_rosters(documents: DataFrame) -> DataFrame:
    rows = _sided(documents, "rosters", ["league", "season", "date", "home", "away"])
    entries = F.array_sort(F.map_entries("entries"), lambda a, b: F.when(a["key"].cast("long") < b["key"].cast("long"), -1).when(a["key"].cast("long") > b["key"].cast("long"), 1).otherwise(0))
    return rows.select("match_id", "side", "team", "league", "season", "date", F.posexplode(entries).alias("at", "e")).select("match_id", "side", "team", "league", "season", "date", "at", "e.value.*")


def first_of(rows: DataFrame, same: list[str], order: list[str]) -> DataFrame:
    """Numbers rows that agree on `same` (nulls agree too); 1 is the one to keep."""
    return rows.withColumn("copy", F.row_number().over(Window.partitionBy(*same).orderBy(*order)))


def dedupe_roster(rosters: DataFrame) -> DataFrame:
    """The first entry of a player in a match and side, whatever the other fields."""
    return first_of(rosters, ["match_id", "side", "player_id"], ["at"]).where("copy = 1").drop("copy")


def dedupe_shots(shots: DataFrame) -> DataFrame:
    """The first of the shots that agree in every field but the id, within a match and side."""
    same = ["match_id", "side", *[c for c in SHOT_FIELDS if c != "id"]]
    return first_of(shots, same, ["at"]).where("copy = 1").drop("copy")


def duplicate_report(rows: DataFrame, same: list[str], order: list[str], name: str, key: str = "match_id") -> DataFrame:
    """Dropped rows for each match with any."""
    return first_of(rows, same, order).groupBy(key).agg(F.count_if(F.col("copy") > 1).alias(name)).where(F.col(name) > 0)


def unescape_common(c: Column) -> Column:
    """Decodes the common entities with built-in functions, the ampersand last."""
    for entity, text in COMMON_ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(text))
    return c


@F.pandas_udf(T.StringType())
def unescape(names: pd.Series) -> pd.Series:
    """Decodes every HTML entity; null stays null."""
    return names.map(html.unescape, na_action="ignore")


#: The numbers of the raw rows and what they're cast to.
SHOT_NUMBERS = {"id": "long", "player_id": "long", "X": "double", "Y": "double", "xG": "double", "minute": "int"}
ROSTER_NUMBERS = {
    **dict.fromkeys(("id", "player_id", "team_id"), "long"),
    **dict.fromkeys(("time", "goals", "own_goals", "shots", "assists", "key_passes", "yellow_card", "red_card"), "int"),
    **dict.fromkeys(("xG", "xA", "xGChain", "xGBuildup"), "double"),
}


def bad_numbers(numbers: dict[str, str]) -> Column:
    """The columns (column, value) of a raw row that hold text which is no number of their type; null is none."""
    told = [F.when(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(), F.struct(F.lit(c).alias("column"), F.col(c).alias("value"))) for c, t in numbers.items()]
    return F.filter(F.array(*told), lambda x: x.isNotNull())


def quarantined(rows: DataFrame, numbers: dict[str, str], source: str) -> tuple[DataFrame, DataFrame]:
    """(sound raw rows, rejected) of raw rows with a match_id: a row with any bad number goes as a whole.

    rejected: match_id, source (the table's name), id (as it stands), column, value, reason; one row for each bad number.
    """
    marked = rows.withColumn("__bad", bad_numbers(numbers))
    rejected = marked.select("match_id", F.lit(source).alias("source"), "id", F.explode("__bad").alias("b")).select(
        "match_id", "source", "id", "b.column", "b.value", F.concat(F.lit("not a number: "), "b.column").alias("reason")
    )
    return marked.where(F.size("__bad") == 0).drop("__bad"), rejected


def clean_shots(shots: DataFrame, strict: bool = True) -> DataFrame:
    """Typed shots. strict: a bad number ends the job; otherwise it becomes null."""
    to = (lambda c, t: F.col(c).cast(t)) if strict else (lambda c, t: F.col(c).try_cast(t))
    return shots.select(
        to("id", "long").alias("shot_id"), "match_id", to("player_id", "long").alias("player_id"), to("X", "double").alias("X"), to("Y", "double").alias("Y"), to("xG", "double").alias("xG"),
        to("minute", "int").alias("minute"), unescape("player").alias("player"), unescape("player_assisted").alias("player_assisted"), unescape("team").alias("team"),
        "league", "season", "date", "situation", "result", "shotType", F.nullif("lastAction", F.lit("None")).alias("lastAction"), (F.col("result") == "OwnGoal").alias("is_own_goal"),
    )


def clean_rosters(rosters: DataFrame, strict: bool = True) -> DataFrame:
    to = (lambda c, t: F.col(c).cast(t)) if strict else (lambda c, t: F.col(c).try_cast(t))
    ints = ["goals", "own_goals", "shots", "assists", "key_passes", "yellow_card", "red_card"]
    return rosters.select(
        to("id", "long").alias("roster_id"), "match_id", to("player_id", "long").alias("player_id"), to("team_id", "long").alias("team_id"), unescape("player").alias("player"), unescape("team").alias("team"),
        "league", "season", "date", "position", (F.col("position") != "Sub").alias("started"), to("time", "int").alias("minutes"), *[to(c, "int").alias(c) for c in ints], *[to(c, "double").alias(c) for c in ("xG", "xA", "xGChain", "xGBuildup")],
    )


def flatten_matches(documents: DataFrame, fixtures: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(shots, appearances) of raw documents: joined to fixtures, flattened, deduplicated and typed."""
    joined = join_fixtures(documents, fixtures)
    return clean_shots(dedupe_shots(flatten_shots(joined)), strict), clean_rosters(dedupe_roster(flatten_rosters(joined)), strict)


def flatten_checked(documents: DataFrame, fixtures: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(shots, appearances, rejected) of raw documents: rows with bad numbers are set aside instead of ending the job."""
    joined = join_fixtures(documents, fixtures)
    shots, bad_shots = quarantined(dedupe_shots(flatten_shots(joined)), SHOT_NUMBERS, "shots")
    rosters, bad_rosters = quarantined(dedupe_roster(flatten_rosters(joined)), ROSTER_NUMBERS, "rosters")
    return clean_shots(shots), clean_rosters(rosters), bad_shots.unionByName(bad_rosters)


def duplicated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Every row whose key occurs more than once; counted first, so that only keys of copies are joined."""
    again = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n")
    return rows.join(again, keys, "left_semi")


def outside(c: str, low: float, high: float) -> Column:
    """Not between the bounds; null is outside."""
    return ~F.coalesce(F.col(c).between(low, high), F.lit(False))


def orphans(shots: DataFrame, appearances: DataFrame) -> DataFrame:
    return shots.join(appearances, ["match_id", "player_id"], "left_anti")


def mismatches(appearances: DataFrame, shots: DataFrame, column: str, name: str = "events") -> DataFrame:
    """Appearances whose roster count differs from the number of shot rows (none counts as 0)."""
    n = shots.groupBy("match_id", "player_id").agg(F.count("*").alias(name))
    joined = appearances.join(n, ["match_id", "player_id"], "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return joined.where(F.col(column) != F.col(name))


def _counted(shots: DataFrame, appearances: DataFrame) -> DataFrame:
    """One row with the number of violations of each check but the shot ids', from one shuffle of either table by match and player."""
    keys = ["match_id", "player_id"]
    known = F.col("match_id").isNotNull() & F.col("player_id").isNotNull()
    own = F.coalesce(F.col("is_own_goal"), F.lit(False))
    by_shot = shots.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col("is_own_goal")).alias("own"), F.count_if(~own & F.col("is_own_goal").isNotNull()).alias("other"), *[F.count_if(outside(c, 0, 1)).alias(f"bad_{c}") for c in ("X", "Y", "xG")]
    )
    by_appearance = appearances.groupBy(*keys).agg(F.count("*").alias("copies"), F.count_if(outside("minutes", 0, 130)).alias("bad_minutes"), F.collect_list(F.struct("shots", "own_goals")).alias("told"))
    both = by_appearance.join(by_shot, keys, "full")
    differ = lambda field, n: F.sum(F.size(F.filter("told", lambda x: x[field] != F.coalesce(F.col(n), F.lit(0)))).cast("long"))
    found = {
        "duplicate appearance": F.sum(F.when(known & (F.col("copies") > 1), F.col("copies"))),
        **{f"{c} outside [0, 1]": F.sum(f"bad_{c}") for c in ("X", "Y", "xG")},
        "minutes outside [0, 130]": F.sum("bad_minutes"),
        "shot without appearance": F.sum(F.when(F.col("copies").isNull(), F.col("n"))),
        "shots don't reconcile": differ("shots", "other"),
        "own goals don't reconcile": differ("own_goals", "own"),
    }
    return both.agg(*[F.coalesce(c, F.lit(0)).alias(name) for name, c in found.items()])


def violations(shots: DataFrame, appearances: DataFrame, sample: int = 10) -> DataFrame:
    """check, violations, and up to `sample` keys, for each failed check.

    All checks are counted first, in two jobs; rows are looked up for those that fail.
    """
    shot_key = F.concat_ws("/", "match_id", "player_id", "shot_id")
    app_key = F.concat_ws("/", "match_id", "player_id")
    rows = {
        "duplicate shot_id": lambda: duplicated(shots, ["shot_id"]).select(shot_key.alias("key")),
        "duplicate appearance": lambda: duplicated(appearances, ["match_id", "player_id"]).select(app_key.alias("key")),
        **{f"{c} outside [0, 1]": lambda c=c: shots.where(outside(c, 0, 1)).select(shot_key.alias("key")) for c in ("X", "Y", "xG")},
        "minutes outside [0, 130]": lambda: appearances.where(outside("minutes", 0, 130)).select(app_key.alias("key")),
        "shot without appearance": lambda: orphans(shots, appearances).select(shot_key.alias("key")),
        "shots don't reconcile": lambda: mismatches(appearances, shots.where(~F.col("is_own_goal")), "shots").select(app_key.alias("key")),
        "own goals don't reconcile": lambda: mismatches(appearances, shots.where("is_own_goal"), "own_goals").select(app_key.alias("key")),
    }
    again = shots.where("shot_id is not null").groupBy("shot_id").agg(F.count("*").alias("n")).where("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    counts = {"duplicate shot_id": again.first().n} | _counted(shots, appearances).first().asDict()
    failed = {check: n for check, n in counts.items() if n}
    told = shots.sparkSession.createDataFrame(list(failed.items()), "check string, violations long")
    if not failed:
        return told.withColumn("sample", F.array().cast("array<string>"))
    some = reduce(DataFrame.unionByName, [rows[check]().orderBy("key").limit(sample).select(F.lit(check).alias("check"), "key") for check in failed])
    return told.join(some.groupBy("check").agg(F.array_sort(F.collect_list("key")).alias("sample")), "check")


class ValidationError(RuntimeError):
    pass


def publish(shots: DataFrame, appearances: DataFrame, path: str) -> int:
    """Publishes both facts by season and league as one version, if no check fails; returns the version.

    Readers see both tables of a version or both of the one before (sources.versions.Versions(spark, path).table(name)).
    """
    failed = violations(shots, appearances).collect()  # one row for each failed check
    if failed:
        raise ValidationError("; ".join(f"{r.check}: {r.violations}" for r in failed))
    versions = Versions(shots.sparkSession, path)
    last = versions.latest()
    number = last.version + 1 if last else 0
    versions.publish(number, {name: versions.write(df, name, number, ("season", "league")) for name, df in (("shots", shots), ("appearances", appearances))})
    return number
