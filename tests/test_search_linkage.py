import datetime as dt
import difflib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from formline.functions import text
from formline.operators import linkage, search


def test_tokens():
    assert text.tokens("Kylian Mbappé-Lottin") == ["kylian", "mbappe", "lottin"]
    assert text.tokens("Semih Kılıçsoy") == ["semih", "kilicsoy"]
    assert text.tokens("Martin Ødegaard") == ["martin", "odegaard"]
    assert [w for w in text.tokens("1.FC Köln") if w not in text.CLUB_STOPWORDS] == ["koln"]


def brute_score(a, b, stopwords=frozenset()):
    """The formula by plain definition: the fewer words' best matches, and the sorted lines."""
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
    p, q = ([w for w in text.tokens(n) if w not in stopwords] for n in (a, b))
    if not p or not q:
        return 0.0
    few, many = (p, q) if len(p) <= len(q) else (q, p)
    best = []
    for x in few:
        found = []
        for y in many:
            if len(x) == 1 or len(y) == 1:
                found.append(float(x[:1] == y[:1]))
            elif min(len(x), len(y)) >= 4 and (x in y or y in x):
                found.append(1.0)
            else:
                found.append(ratio(x, y))
        best.append(max(found))
    return 0.8 * sum(best) / len(best) + 0.2 * ratio(" ".join(sorted(p)), " ".join(sorted(q)))


PAIRS = [("Son Heung-Min", "Heung-min Son"), ("V. Júnior", "Vinicius Junior"), ("Kylian Mbappe-Lottin", "Kylian Mbappé"), ("Erling Haaland", "Bukayo Saka"), ("", "Bukayo Saka"), ("...", "x"), ("Lyon", "Olympique Lyonnais"), ("FC Nice", "OGC Nice"), ("a b c", "c b"), ("Raul", "Raul"), ("ab cd", "abcd")]


@pytest.mark.parametrize("stopwords", [frozenset(), text.CLUB_STOPWORDS])
def test_name_scores_equal_the_formula(spark, stopwords):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 6)))
    pairs = PAIRS + [(" ".join(word() for _ in range(rnd.randint(0, 4))), " ".join(word() for _ in range(rnd.randint(1, 4)))) for _ in range(150)]
    df = spark.createDataFrame([(*p, 1) for p in pairs] + [(None, "x", 1), ("x", None, 1), (*PAIRS[0], 2)], "a string, b string, score2 int")
    got = text.name_scores(df, "a", "b", stopwords).collect()
    assert len(got) == len(pairs) + 3
    for r in got:
        assert r.score is None if None in (r.a, r.b) else r.score == pytest.approx(brute_score(r.a, r.b, stopwords))
    assert brute_score(*PAIRS[0]) == pytest.approx(1.0) and brute_score(*PAIRS[1]) > 0.9 and brute_score(*PAIRS[3]) < 0.5


def test_fuzzy_search_is_complete(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 7)))
    names = ["jose leu", "lu", "a smith", "abc", "ac"] + [" ".join(word() for _ in range(rnd.randint(1, 3))) for _ in range(60)]
    queries = ["lu", "leu", "a", "ac", "abc", "", "aXc"] + [" ".join(word() for _ in range(rnd.randint(1, 2))) for _ in range(60)]
    q = spark.createDataFrame([(x, x) for x in sorted(set(queries))], "query string, q string")
    n = spark.createDataFrame(list(enumerate(names)), "id long, n string")
    best = lambda a, b: max(difflib.SequenceMatcher(None, a, p).ratio() for p in [b, *b.split(" ")])
    expected = {(a, i) for a in set(queries) - {""} for i, b in enumerate(names) if best(a, b) >= 0.8}
    got = search.find_fuzzy(q, n).collect()
    assert {(r.query, r.id) for r in got} == expected and len(got) == len(expected)
    assert all(r.score == pytest.approx(best(r.query, names[r.id])) for r in got)


def test_many_short_queries(spark):
    names = ["".join(p) for p in itertools.product("abcd", "xyz ", "mn")]
    queries = sorted({"".join(p) for k in (0, 1, 2) for p in itertools.product("abcdxyzmnopqrstuvwefghijk", repeat=k)} | {"a m", "x n", "bz"})
    assert len(queries) > 500
    got = search.find_words(spark.createDataFrame([(x, x) for x in queries], "query string, q string"), spark.createDataFrame(list(enumerate(names)), "id long, n string")).collect()
    expected = {(a, i) for a in queries for i, b in enumerate(names) if all(w in b for w in a.split(" "))}
    assert {(r.query, r.id) for r in got} == expected and len(got) == len(expected)


def test_assignment_with_runner_up(spark):
    rows = [("L", "a", 1, "One", 0.9), ("L", "a", 2, "Two", 0.8), ("L", "b", 1, "One", 0.85), ("L", "b", 2, "Two", 0.1), ("M", "c", 3, "Three", 0.4)]
    got = {r.team: (r.club_id, r.club, r.score, r.runner_up_score) for r in linkage.assign(spark.createDataFrame(rows, "league string, team string, club_id long, name string, score double")).collect()}
    assert got == {"a": (2, "Two", 0.8, 0.9), "b": (1, "One", 0.85, 0.1), "c": (3, "Three", 0.4, 0.0)}


def test_similar_tables(spark):
    rng = np.random.default_rng(8)
    features = ["f0", "f1", "f2"]
    rows = [(i, i % 4 != 0, int(20 + i % 9), None, None, *v) for i, v in enumerate(rng.normal(size=(25, 3)).tolist())]
    pool = spark.createDataFrame(rows, "id long, active boolean, age int, value_m double, contract_end date, f0 double, f1 double, f2 double")
    got = search.similar_tables(pool, features, 4, max_age=25).collect()
    x = {r[0]: np.array(r[5:]) for r in rows}
    cos = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    good = [r[0] for r in rows if r[1] and r[2] <= 25]
    for i, row in enumerate(rows):
        own = sorted((r for r in got if r.id == i), key=lambda r: r["rank"])
        assert [r.other for r in own] == sorted((j for j in good if j != i), key=lambda j: -cos(x[i], x[j]))[:4]
        others = [r for r in rows if r[0] != i]
        for r in own:
            assert (r.candidates, r.inactive_excluded, r.removed_by_filters) == (sum(o[1] for o in others), sum(not o[1] for o in others), sum(o[1] and o[2] > 25 for o in others))
            assert r.total == pytest.approx(cos(x[i], x[r.other]), abs=1e-3) and len(r.top) == 3
            assert r.distinctiveness == pytest.approx(100 * np.mean([np.linalg.norm(x[o[0]]) < np.linalg.norm(x[i]) for o in others]))


NAMES = ["Kylian Mbappé", "Ferran Torres", "Óliver Torres", "Raul", "Raul García", "Jean-Philippe Mateta"]


@pytest.mark.parametrize(
    "query, ids, tier",
    [("kylian mbappe", [0], 1), ("torres", [1, 2], 2), ("raul", [3], 1), ("RAUL G", [4], 2), ("Mateta", [5], 2), ("Mbape", [0], 3), ("Zzzzz", [], None)],
)
def test_tiers(spark, query, ids, tier):
    names = spark.createDataFrame(list(enumerate(NAMES)), "id long, name string")
    hits = search.find_players(spark.createDataFrame([(query,)], "query string"), names).collect()
    assert sorted(r.id for r in hits) == ids and {r.tier for r in hits} <= {tier}


RANKED = "id long, player string, similarity double, active boolean, age int, value_m double, contract_end date"
ROWS = [
    (1, "A", 0.9, True, 20, 10.0, dt.date(2027, 6, 30)),
    (2, "B", 0.8, True, 30, 20.0, dt.date(2026, 6, 30)),
    (3, "C", 0.7, True, 24, None, None),
    (4, "D", 0.6, True, None, 30.0, dt.date(2028, 6, 30)),
    (5, "E", 0.5, True, 22, 50.0, dt.date(2030, 6, 30)),
]


@pytest.mark.parametrize(
    "filters, kept",
    [({"max_age": 24}, "ACE"), ({"max_value": 30}, "ABD"), ({"contract_before": 2028}, "AB"), ({"max_age": 24, "max_value": 30, "contract_before": 2028}, "A"), ({}, "ABCDE")],
)
def test_filters(spark, filters, kept):
    found = search.search(spark.createDataFrame(ROWS, RANKED), **filters).collect()
    assert "".join(r.player for r in found) == kept
    assert found[0].removed_by_filters == 5 - len(kept)


def test_inactive(spark):
    rows = [(*r[:3], a, *r[4:]) for r, a in zip(ROWS, [True, False, True, None, True])]
    found = search.search(spark.createDataFrame(rows, RANKED)).collect()
    assert [r.player for r in found] == ["A", "C", "E"] and (found[0].inactive_excluded, found[0].candidates) == (2, 3)


def test_verify(spark):
    m = spark.createDataFrame([(1, 11), (2, 12), (3, None), (4, 14)], "player_id long, match_id long")
    ours = spark.createDataFrame([(1, 10, 900), (2, 3, 900), (3, 1, 90)], "player_id long, goals int, minutes int")
    theirs = spark.createDataFrame([(11, 7, 900), (12, 3, 600)], "player_id long, goals int, minutes_played int")
    got = {r.player_id: (r.flag_reason, r.verification_flag) for r in linkage.verify(m, ours, theirs).collect()}
    assert got[1] == ("goals", True) and got[2] == ("minutes", True) and got[3] == ("unmatched", False)
    assert got[4][0].startswith("no 2025/26") and not got[4][1]


def test_clubs_in_two_stages(spark):
    teams = spark.createDataFrame([("Ligue_1", "Nice", 2025), ("Ligue_1", "Troyes", 2026), ("Ligue_1", "Le Mans", 2026)], "league string, team string, season int")
    clubs = spark.createDataFrame(
        [("Ligue_1", 417, "OGC Nice", ["OGC Nice", "ogc nice"], True), ("Ligue_1", 1095, "ESTAC Troyes", ["ESTAC Troyes"], False), ("Ligue_1", 99, "Stade Brestois", ["Stade Brestois"], False)],
        "league string, club_id long, name string, variants array<string>, in_league boolean",
    )
    assert {r.team: r.club_id for r in linkage.map_clubs(teams, clubs, 2025).collect()} == {"Nice": 417, "Troyes": 1095, "Le Mans": None}


def test_overrides(spark):
    players = spark.createDataFrame([(11, "Kylian Mbappé"), (12, "Ousmane Dembélé")], "player_id long, name string")
    matches = spark.createDataFrame([(1, "K. Mbappe", None, None, 0.0, ""), (2, "O. Dembele", 11, "Kylian Mbappé", 0.1, "name")], "player_id long, player string, match_id long, match_name string, match_score double, match_method string")
    o = spark.createDataFrame([(2, 12)], "player_id long, match_id long")
    got = {r.player_id: r for r in linkage.apply_overrides(matches, o, players).collect()}
    assert (got[2].match_id, got[2].match_method) == (12, "override") and got[2].match_score > 0.9 and got[1].match_id is None
    with pytest.raises(ValueError, match="77"):
        linkage.apply_overrides(matches, spark.createDataFrame([(1, 77)], "player_id long, match_id long"), players)


def test_match_players(spark):
    pool = spark.createDataFrame([(1, "Kylian Mbappe", "Real"), (2, "Nobody", "Lost")], "player_id long, player string, teams string")
    club_map = spark.createDataFrame([("Real", 9), ("Lost", None)], "team string, club_id long")
    players = spark.createDataFrame([(11, "Kylian Mbappé", 9), (12, "Jude Bellingham", 9), (13, None, 9)], "player_id long, name string, current_club_id long")
    apps = spark.createDataFrame([(9, 11)], "player_club_id long, player_id long")
    got = {r.player_id: r for r in linkage.match_players(pool, club_map, linkage.club_candidates(apps, players), players).collect()}
    assert (got[1].match_id, got[1].candidates, got[1].match_method) == (11, 3, "name")
    assert (got[2].match_id, got[2].candidates, got[2].match_score) == (None, 0, 0.0)


def test_latest_valuation_skips_null(spark):
    rows = [(1, dt.date(2026, 1, 1), 5.0), (1, dt.date(2026, 2, 1), None), (1, dt.date(2025, 1, 1), 9.0)]
    r = linkage.latest_valuation(spark.createDataFrame(rows, "player_id long, date date, market_value_in_eur double")).first()
    assert (r.market_value_eur, r.value_date) == (5.0, dt.date(2026, 1, 1))


def test_labels(spark):
    row = spark.range(1).select(search.value_label(F.lit(12.4)), search.value_label(F.lit(5.5)), search.value_label(F.lit(None).cast("double")), search.contract_label(F.lit("2027-06-30").cast("date"))).first()
    assert tuple(row) == ("€12m", "€5.5m", "—", "2027-06")


def test_best_names_equal_brute_force(spark):
    """Best-first matching within blocks against all pairs, with ties, misspelt names, initials and names without words."""
    import random

    from formline.functions import text

    rnd = random.Random(4)
    part = lambda: rnd.choice(["jo", "joao", "silva", "sylva", "b", "ann", "anna", "müller", "muller", "o", "1", "łukasz"]) + rnd.choice(["", "", "a", "ss"])
    name = lambda: " ".join(part() for _ in range(rnd.randint(1, 3)))
    ours = sorted({name() for _ in range(40)} | {"--", "日本"})
    theirs = {n: k for k, n in enumerate(sorted({name() for _ in range(60)} | {"..."}))}
    pairs = spark.createDataFrame([(a, b) for a in ours for b in theirs], "a string, b string")
    best = {}
    for r in text.name_scores(pairs, "a", "b").collect():
        best[r.a] = max(best.get(r.a, (-1.0, 0)), (round(r.score, 12), -theirs[r.b]))
    left = spark.createDataFrame([(k, n) for n in ours for k in (1, 2)], "club long, name string")
    right = spark.createDataFrame([(1, n, i) for n, i in theirs.items()], "club long, candidate string, candidate_id long")
    for block in (1024, 7):
        got = text.best_names(left, right, "club", block).collect()
        assert {r.name: (round(r.score, 12), -r.candidate_id) for r in got} == best and {r.club for r in got} == {1}
    assert sum(r.scored for r in text.best_names(left, right, "club").collect()) < 0.5 * len(ours) * len(theirs)


def test_bounds_are_never_below_scores():
    from formline.functions import text

    scorer = text.Scorer()
    names = [text.tokens(n) for n in ("Ann-Marie O Brien", "brien anne", "x", "Łukasz Fabianski", "fabiański l", "", "a b c", "abcd", "abcde abc")]
    bounds = text.name_bounds(names, names)
    assert all(scorer.score(a, b) <= max(bounds[i, j], 0) + text.ROUNDING for i, a in enumerate(names) for j, b in enumerate(names))


def test_names_are_never_broadcast(spark, tmp_path):
    """Repeated names take few bytes in a file, so that the planner would broadcast them and their substrings."""
    spark.range(20_000).select("id", F.concat(F.lit("name "), (F.col("id") % 5).cast("string")).alias("n")).write.parquet(str(tmp_path / "names"))
    names = spark.read.parquet(str(tmp_path / "names"))
    found = search.find_words(spark.createDataFrame([("e 3", "e 3")], "query string, q string"), names)
    assert found.count() == 4000
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
