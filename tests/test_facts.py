import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from formline.operators import facts
from formline.sources import io
from formline.sources.versions import Versions

ROSTER = {c: "0" for c in facts.ROSTER_FIELDS} | {"id": "50", "player_id": "7", "player": "Dara O&#039;Shea", "position": "FW", "time": "90", "shots": "1"}
SHOT = {c: None for c in facts.SHOT_FIELDS} | {"id": "1", "player_id": "7", "player": "Ngal&#039;ayel Mukau", "result": "MissedShots", "lastAction": "None", "X": "0.9", "Y": "0.5", "xG": "0.1", "minute": "3"}


def land(folder, number, rosters, shots):
    folder.mkdir(exist_ok=True)
    doc = {"rosters": {"h": {r["id"]: r for r in rosters}, "a": {}}, "shots": {"h": shots, "a": []}}
    (folder / f"{number}.json").write_text(json.dumps(doc))


@pytest.fixture
def league(tmp_path):
    folder = tmp_path / "leagues"
    folder.mkdir()
    dates = [{"id": str(i), "isResult": i < 3, "datetime": "2025-08-16 14:00:00", "h": {"title": "Home"}, "a": {"title": "Away"}} for i in (1, 2, 3)]
    (folder / "La_liga_2025.json").write_text(json.dumps({"dates": dates}))
    return str(folder)


def loaded(spark, tmp_path, league):
    fixtures = facts.finished_fixtures(io.read_leagues(spark, league))
    return facts.flatten_matches(io.read_matches(spark, str(tmp_path / "matches")), fixtures)


def test_league_name_is_cut_at_the_last_underscore(spark, league):
    rows = facts.finished_fixtures(io.read_leagues(spark, league)).orderBy("match_id").collect()
    assert [(r.league, r.season, r.match_id, r.home) for r in rows] == [("La_liga", 2025, 1, "Home"), ("La_liga", 2025, 2, "Home")]


def test_clean_match(spark, tmp_path, league):
    land(tmp_path / "matches", 1, [ROSTER], [SHOT])
    shots, apps = loaded(spark, tmp_path, league)
    s, a = shots.collect(), apps.collect()
    assert [(r.shot_id, r.player, r.lastAction, r.is_own_goal, r.team, r.player_assisted) for r in s] == [(1, "Ngal'ayel Mukau", None, False, "Home", None)]
    assert [(r.roster_id, r.player, r.started, r.minutes, r.date) for r in a] == [(50, "Dara O'Shea", True, 90, dt.datetime(2025, 8, 16, 14))]
    assert facts.violations(shots, apps).count() == 0


def test_duplicates(spark, tmp_path, league):
    again, other = ROSTER | {"id": "51", "roster_out": "9"}, ROSTER | {"id": "52", "player_id": "8"}
    shots = [SHOT, SHOT | {"id": "2"}, SHOT | {"id": "3", "X": "0.8"}]
    land(tmp_path / "matches", 1, [ROSTER, again, other], shots)
    s, a = loaded(spark, tmp_path, league)
    assert sorted(r.shot_id for r in s.collect()) == [1, 3]
    assert sorted(r.roster_id for r in a.collect()) == [50, 52]


def test_bad_number_ends_the_job_unless_lenient(spark, tmp_path, league):
    land(tmp_path / "matches", 1, [ROSTER], [SHOT | {"X": "far"}])
    fixtures = facts.finished_fixtures(io.read_leagues(spark, league))
    docs = io.read_matches(spark, str(tmp_path / "matches"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|far"):
        facts.flatten_matches(docs, fixtures)[0].collect()
    assert facts.flatten_matches(docs, fixtures, strict=False)[0].first().X is None


def typed(spark, shots, apps):
    s = spark.createDataFrame(shots, "shot_id long, match_id long, player_id long, X double, Y double, xG double, is_own_goal boolean")
    a = spark.createDataFrame(apps, "match_id long, player_id long, minutes int, shots int, own_goals int")
    return s, a


@pytest.mark.parametrize(
    "shots, apps, expected",
    [
        ([(1, 1, 7, 0.9, 0.5, 0.1, False), (2, 1, 7, 0.9, 0.5, 0.1, True)], [(1, 7, 90, 1, 1)], {}),
        ([(1, 1, 7, 0.9, 0.5, 0.1, False)], [(1, 7, 90, 2, 0)], {"shots don't reconcile": 1}),
        ([(1, 1, 7, 1.4, None, 0.1, False)], [(1, 7, 90, 1, 0)], {"X outside [0, 1]": 1, "Y outside [0, 1]": 1}),
        ([(1, 1, 7, 0.9, 0.5, 0.1, False)], [(1, 7, 90, 1, 0), (1, 7, 20, 1, 0)], {"duplicate appearance": 2}),
        ([(1, 2, 7, 0.9, 0.5, 0.1, False)], [(1, 7, 131, 0, 0)], {"shot without appearance": 1, "minutes outside [0, 130]": 1}),
    ],
)
def test_violations(spark, shots, apps, expected):
    assert {r.check: r.violations for r in facts.violations(*typed(spark, shots, apps)).collect()} == expected


def test_publish_is_gated(spark, tmp_path):
    s, a = typed(spark, [(1, 1, 7, 1.4, 0.5, 0.1, False)], [(1, 7, 90, 1, 0)])
    with pytest.raises(facts.ValidationError):
        facts.publish(s, a, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    good, a = typed(spark, [(1, 1, 7, 0.4, 0.5, 0.1, False)], [(1, 7, 90, 1, 0)])
    keys = {"season": F.lit(2025), "league": F.lit("EPL")}
    out = str(tmp_path / "out")
    assert [facts.publish(good.withColumns(keys), a.withColumns(keys), out) for _ in range(2)] == [0, 1]
    assert Versions(spark, out).table("shots").select("X", "season").collect() == [(0.4, 2025)]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    io.write_small_csv(df, str(tmp_path / "csv"))
    assert sorted(io.read_csv(spark, str(tmp_path / "csv"), "id long, name string", "id").collect()) == sorted(df.collect())


def test_run_tables(spark, tmp_path):
    io.append_status(spark, str(tmp_path / "status"), {"step": "facts", "ok": True})
    io.append_status(spark, str(tmp_path / "status"), {"step": "profiles", "ok": True})
    io.append_status(spark, str(tmp_path / "status"), {"step": "market", "ok": None, "share": 0.5, "rows": 3})
    told = spark.read.json(str(tmp_path / "status")).orderBy("at").drop("at").collect()
    assert [(r.step, r.ok, r.rows, r.share) for r in told] == [("facts", True, None, None), ("profiles", True, None, None), ("market", None, 3, 0.5)]
    rows = [("recall_10", "recent", 0.2, 1), ("recall_10", "recent", 0.3, 2), ("mrr", "recent", 0.9, 3)]
    io.append_metrics(spark.createDataFrame(rows, "metric string, config string, mean double, run_ts long"), str(tmp_path / "metrics"))
    assert io.latest_metric(spark.read.parquet(str(tmp_path / "metrics")), "recall_10", "recent").first() == (0.3, 2)
