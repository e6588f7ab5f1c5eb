import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from formline.functions import linalg
from formline.operators import evaluation, profiles, similarity, windows, zones
from formline.session import cut

APP = "match_id long, player_id long, player string, team string, league string, season int, minutes int, position string, started boolean, xA double, key_passes int, xGChain double, xGBuildup double, date timestamp"
SHOT = "match_id long, player_id long, season int, xG double, situation string, is_own_goal boolean, shotType string, lastAction string, X double, Y double"


def app(match=1, player=7, minutes=90, position="FW", season=2025, day=1, **more):
    row = {"match_id": match, "player_id": player, "player": "P", "team": "T", "league": "L", "season": season, "minutes": minutes, "position": position, "started": position != "Sub", "xA": 0.0, "key_passes": 0, "xGChain": 0.0, "xGBuildup": 0.0, "date": dt.datetime(2025, 8, 1) + dt.timedelta(days=day)} | more
    return tuple(row.values())


def shot(match=1, player=7, xG=0.1, situation="OpenPlay", own=False, kind="RightFoot", action="Pass", x=0.9, y=0.5):
    return (match, player, 2025, xG, situation, own, kind, action, x, y)


def build(spark, apps, shots, **settings):
    a, s = spark.createDataFrame(apps, APP), spark.createDataFrame(shots, SHOT)
    return {r.player_id: r for r in profiles.build(s, a, **({"min_starts": 0, "min_minutes": 0, "positions": None, "last_actions": ["Pass"]} | settings)).collect()}


def test_per_90(spark):
    apps = [app(1, xA=0.1, key_passes=1, xGChain=0.6, xGBuildup=0.2), app(2, minutes=45, xA=0.2, key_passes=2, xGChain=0.6, xGBuildup=0.4)]
    r = build(spark, apps, [shot(1, xG=0.1), shot(1, xG=0.2), shot(2, xG=0.3)])[7]
    assert r.npxg_per90 == pytest.approx(0.6 / 135 * 90) and r.shots_per90 == pytest.approx(3 / 135 * 90)
    assert r.xa_per90 == pytest.approx(0.3 / 135 * 90) and r.key_passes_per90 == pytest.approx(3 / 135 * 90)
    assert r.npxg_per_shot == pytest.approx(0.2) and r.buildup_share_of_chain == pytest.approx(0.6 / 1.2)


def test_exclusions(spark):
    shots = [shot(xG=0.2, kind="LeftFoot"), shot(xG=0.7, situation="Penalty"), shot(xG=0.05, situation="DirectFreekick", kind="Head"), shot(xG=0.5, own=True)]
    r = build(spark, [app()], shots)[7]
    assert (r.shots, r.shot_type_left_foot, r.shot_type_head) == (1, 1.0, 0.0)
    assert r.npxg_per_shot == pytest.approx(0.2) and r.npxg_per90 == pytest.approx(0.25)


def test_unknown_situation_is_style(spark):
    assert build(spark, [app()], [shot(situation=None)])[7].shots == 1


def test_subset_of_matches(spark):
    r = build(spark, [app(1, xA=0.1)], [shot(1, xG=0.2), shot(2, xG=0.9)])[7]
    assert (r.minutes, r.shots) == (90, 1) and r.npxg_per90 == pytest.approx(0.2)


def test_pool_and_primary_position(spark):
    apps = [app(m, 1) for m in range(10)] + [app(m, 2) for m in range(4)] + [app(m, 3, position="DC") for m in range(10)]
    assert set(build(spark, apps, [shot()], min_starts=5, min_minutes=900, positions=profiles.ATTACKING_POSITIONS)) == {1}
    mixed = [app(m, minutes=60) for m in range(5)] + [app(10 + m, position="Sub") for m in range(10)] + [app(30 + m, minutes=50, position="DMC") for m in range(5)]
    assert build(spark, mixed, [shot()])[7].primary_position == "FW"


def test_shrinkage(spark):
    apps, shots = [app(1, 7), app(1, 8)], [shot(kind="Head"), shot(), *[shot(player=8, kind="Head")] * 0]
    prior = spark.createDataFrame([(0.2, 0.3, 0.4, 0.1, 0.5, 0.2, 0.3)], "shot_type_head double, shot_type_left_foot double, shot_type_right_foot double, shot_type_other double, last_action_pass double, last_action_other double, last_action_missing double")
    r = build(spark, apps, shots, shrinkage_k=10, priors=prior)
    assert r[7].shot_type_head == pytest.approx((1 + 2) / 12)
    assert sum(getattr(r[7], f"shot_type_{k}") for k in ("head", "left_foot", "right_foot", "other")) == pytest.approx(1)
    assert r[8].shot_type_head == pytest.approx(0.2)
    assert build(spark, apps, shots)[8].shot_type_head is None


@pytest.mark.parametrize("rows, kept, total", [(25, 23, 2070), (5, 5, 450)])
def test_recent_window_reaches_the_limit(spark, rows, kept, total):
    a = spark.createDataFrame([app(i, day=i, season=2025 + (i > 20)) for i in range(rows)], APP)
    w = windows.recent_window(a).collect()
    assert (len(w), sum(r.minutes for r in w)) == (kept, total)
    assert {r.season for r in w} == {2026 if rows > 21 else 2025}


def test_active(spark):
    a = spark.createDataFrame([app(1, 1, season=2026), app(2, 2, season=2025)], APP)
    assert {r.player_id: r.active for r in windows.active_players(a).collect()} == {1: True, 2: False}


def sided(player, low, high, n=20):
    rnd = random.Random(player)
    return [shot(player=player, x=rnd.uniform(0.85, 0.97), y=rnd.uniform(low, high)) for _ in range(n)]


def test_grids(spark):
    s = spark.createDataFrame(sided(1, 0.1, 0.3) + sided(2, 0.6, 0.9) + [shot(player=3, x=0.3), shot(player=3, situation="Penalty"), shot(player=4, situation="Penalty")], SHOT)
    g = {r.player_id: np.array(r.grid) for r in zones.grids(s).collect()}
    assert set(g) == {1, 2, 3}
    assert all(x.sum() == pytest.approx(1) and (x >= 0).all() for x in g.values())


def test_zones_find_the_sides(spark):
    s = spark.createDataFrame([r for p in range(10) for r in sided(p, 0.15, 0.35)] + [r for p in range(20, 30) for r in sided(p, 0.65, 0.85)], SHOT)
    grid = zones.grids(s)
    h = zones.fit(grid, 2)
    right = {r.zone for r in zones.centres(zones.component_cells(spark, h)).collect() if r.lateral > 0}
    assert len(right) == 1
    share = {r.player_id: r[f"zone_{right.copy().pop()}"] for r in zones.weights(grid, h).collect()}
    assert min(share[p] for p in range(10)) > 0.9 and max(share[p] for p in range(20, 30)) < 0.1


def test_assignment_equals_brute_force():
    from itertools import permutations

    rng = np.random.default_rng(1)
    for n, m in [(1, 1), (3, 3), (4, 6), (6, 4), (7, 7)]:
        s = rng.random((n, m))
        total = sum(s[i, j] for i, j in linalg.assignment(s))
        wide = s if n <= m else s.T
        assert total == pytest.approx(max(sum(wide[i, j] for i, j in enumerate(p)) for p in permutations(range(wide.shape[1]), len(wide))))


def test_nonnegative_weights_recover_a_mixture():
    rng = np.random.default_rng(2)
    h, w = rng.random((3, 40)), rng.random((10, 3))
    assert np.allclose(linalg.nonnegative_weights(w @ h, h, 2000), w, atol=1e-4)


def test_split_is_independent_of_order(spark):
    rows = [app(m, p, day=m) for p in (1, 2, 3) for m in range(7)]
    halves = lambda r, seed: {(x.player_id, x.match_id, x.half) for x in evaluation.split_halves(spark.createDataFrame(r, APP), [seed]).collect()}
    first = halves(rows, 1)
    assert first == halves(rows[::-1], 1) != halves(rows, 2)
    assert all(sum(1 for p, _, h in first if p == q and h == "A") == 3 for q in (1, 2, 3))


def test_identical_halves_rank_first(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist(), v.tolist()) for i, v in enumerate(rng.normal(size=(30, 8)))]
    df = spark.createDataFrame(rows, "id long, a array<double>, b array<double>")
    for metric in ("cosine", "euclidean"):
        assert {r["rank"] for r in similarity.own_ranks(df, metric, block=7).collect()} == {1}


def test_ties_count_against(spark):
    rows = [(1, [1.0, 0.0], [1.0, 0.0]), (2, [2.0, 0.0], [2.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, a array<double>, b array<double>")
    assert sorted(r["rank"] for r in similarity.own_ranks(df).collect()) == [2, 2]
    assert sorted(r["rank"] for r in similarity.own_ranks(df, "euclidean").collect()) == [1, 1]


def test_metrics(spark):
    ranks = spark.createDataFrame([("x", 0, r) for r in (1, 2, 6, 11)], "feature_set string, seed int, rank int")
    m = evaluation.metrics(ranks).first()
    assert (m.recall_1, m.recall_5, m.recall_10) == (0.25, 0.5, 0.75)
    assert m.mrr == pytest.approx((1 + 1 / 2 + 1 / 6 + 1 / 11) / 4)
    b = evaluation.random_baseline(spark, 4).first()
    assert (b.recall_1, b.recall_10) == (0.25, 2.5)
    assert evaluation.quality_ok(0.199) and not evaluation.quality_ok(0.198)


@pytest.mark.parametrize("block", [7, 1000])
def test_block_topk_equals_the_naive_search(spark, sf, block):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").limit(120)
    got = {(r.id, r.other): r["rank"] for r in similarity.topk(v, 5, block=block).collect()}
    rows = v.collect()
    x = np.array([r.embedding for r in rows], float)
    s = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    ids = [r.vec_id for r in rows]
    np.fill_diagonal(s, -9)
    expected = {(ids[i], ids[j]): k + 1 for i in range(len(ids)) for k, j in enumerate(sorted(range(len(ids)), key=lambda j: (-s[i, j], ids[j]))[:5])}
    assert got == expected


def test_contributions_sum_to_the_cosine(spark):
    rng = np.random.default_rng(5)
    features = [f"f{i}" for i in range(6)]
    rows = [(i, *v) for i, v in enumerate(rng.normal(size=(14, 6)).tolist())]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{f} double" for f in features))
    z = similarity.standardise(df, features).select("id", similarity.vector(features).alias("za"))
    pairs = z.join(z.where("id = 0").select(z.za.alias("zb")).limit(1)).where("id <> 0")
    cos = {r.id: r.c for r in pairs.select("id", similarity.cosine(pairs.za, pairs.zb).alias("c")).collect()}
    e = {r.id: r for r in similarity.explain(similarity.contributions(pairs, features), ["id"]).collect()}
    assert all(e[i].total == pytest.approx(cos[i], abs=1e-3) for i in cos)
    assert all([t.contribution for t in r.top] == sorted((t.contribution for t in r.top), reverse=True) and r.against.contribution <= r.top[-1].contribution for r in e.values())


def season(players=8, matches=10, seed=0):
    rng = np.random.default_rng(seed)
    apps = [app(m, p, day=m, xA=0.05 * p, key_passes=p % 4, xGChain=0.1 * p, xGBuildup=0.05 * p) for p in range(1, players + 1) for m in range(matches)]
    shots = [shot(m, p, xG=0.02 * p, kind=["Head", "LeftFoot", "RightFoot"][p % 3], action=["Pass", "Cross", None][p % 3], x=rng.uniform(0.8, 0.97), y=rng.uniform(0.1, 0.9)) for p in range(1, players + 1) for m in range(matches) for _ in range(2)]
    return apps, shots


def test_zones_are_fitted_on_half_a_of_each_seed(spark):
    apps, shots = season()
    a, s = spark.createDataFrame(apps, APP), spark.createDataFrame(shots, SHOT)
    pool = a.select("player_id", "season").distinct()
    halves = evaluation.half_profiles(s, a, pool, ["Pass", "Cross"], (4, 9), k_zones=3)
    assert [c for c in halves.columns if c.startswith("zone_")] == ["zone_1", "zone_2", "zone_3"]
    rows = {(r.player_id, r.seed, r.half): r for r in halves.collect()}
    assert len(rows) == 8 * 2 * 2 and all(r.zone_1 + r.zone_2 + r.zone_3 == pytest.approx(1) for r in rows.values())
    for seed in (4, 9):  # a fit of this seed's half A alone gives the same weights for both halves
        split = evaluation.split_halves(a, [seed])
        by = ["player_id", "season", "half"]
        grid = zones.grids(profiles.shots_in(s, split, by), by)
        for r in zones.weights(grid, zones.fit(grid.where("half = 'A'"), 3), by).collect():
            assert [r.zone_1, r.zone_2, r.zone_3] == pytest.approx([rows[r.player_id, seed, r.half][f"zone_{k}"] for k in (1, 2, 3)], abs=1e-6)


def test_evaluation_of_a_configuration(spark):
    apps, shots = season(12)
    a, s = spark.createDataFrame(apps, APP), spark.createDataFrame(shots, SHOT)
    pool = a.select("player_id", "season").distinct()
    configs = [{"zones": 0}, {"zones": 0, "shrinkage_k": 10, "split": "stratified"}, {"zones": 2, "metric": "euclidean"}]
    grid = evaluation.config_grid(s, a, pool, ["Pass", "Cross"], configs, range(2)).collect()
    assert len(grid) == 2 * 12 * (4 + 4 + 5) and all(1 <= r["rank"] <= 12 for r in grid)
    assert {(r.mode, r.split, r.metric, r.shrinkage_k, r.zones) for r in grid} == {("season", "random", "cosine", 0, 0), ("season", "stratified", "cosine", 10, 0), ("season", "random", "euclidean", 0, 2)}
    ranks, halves = evaluation.evaluate_config(s, a, pool, ["Pass", "Cross"], range(2), zones=0)
    # a one-feature set by hand
    got = {(r.player_id, r.seed): r["rank"] for r in ranks.where("feature_set = 'npxG only'").collect()}
    h = {(r.player_id, r.seed, r.half): r.npxg_per90 for r in halves.collect()}
    for p, seed in got:
        assert got[p, seed] == sum(abs(h[q, seed, "A"] - h[p, seed, "B"]) <= abs(h[p, seed, "A"] - h[p, seed, "B"]) + 1e-12 for q in range(1, 13))
    share = evaluation.imputed_share(halves, ["npxg_per_shot", "xa_per90"]).collect()
    assert {(r.seed, r.imputed, r.n_values) for r in share} == {(0, 0, 48), (1, 0, 48)}


def test_population(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "league string")
    assert tuple(evaluation.population(df).first()) == (4, "b 2, a 1, c 1")


def test_rolled_up_equals_its_parts(spark):
    rnd = random.Random(3)
    apps = [app(m, p, rnd.randint(0, 90), rnd.choice(["FW", "AMC", "Sub", None]), team=rnd.choice("XYZ"), league=rnd.choice(["L", "M"]), day=rnd.randint(1, 5), started=rnd.random() < 0.7) for p in range(6) for m in range(12)]
    a = spark.createDataFrame(apps, APP)
    got = {(r.player_id, r.season): r for r in profiles.rolled_up(a).collect()}
    for r in profiles.totals(a).collect():
        assert (r.player, r.minutes, r.starts, r.sum_xa) == tuple(got[r.player_id, r.season][c] for c in ("player", "minutes", "starts", "sum_xa"))
    assert {(r.player_id, r.primary_position) for r in profiles.primary_position(a).collect()} == {(p, r.primary_position) for (p, _), r in got.items()}
    for column, name in (("team", "teams"), ("league", "leagues")):
        assert {(r.player_id, r[name]) for r in profiles.by_minutes(a, column, name).collect()} == {(p, r[name]) for (p, _), r in got.items()}


def test_zones_by_weight(spark):
    w = spark.createDataFrame([(1, 2025, 1, 0.2), (1, 2025, 2, 0.0), (1, 2025, 3, 0.5), (1, 2025, 4, 0.2)], "player_id long, season int, zone int, weight double")
    assert [(z.zone, z.weight) for z in zones.by_weight(w).first().zones] == [(3, 0.5), (1, 0.2), (4, 0.2)]


def test_configurations_share_halves_and_are_logged(spark, tmp_path):
    from formline.sources import io

    apps, shots = season(12)
    a, s = spark.createDataFrame(apps, APP), spark.createDataFrame(shots, SHOT)
    pool = a.select("player_id", "season").distinct()
    configs = [{"zones": 0}, {"zones": 0, "metric": "euclidean"}, {"zones": 0, "mode": "recent"}]
    ranks = cut(evaluation.config_grid(s, a, {"season": pool, "recent": pool}, ["Pass", "Cross"], configs, range(2), window_minutes=300))
    for metric in ("cosine", "euclidean"):  # as one configuration alone
        alone = evaluation.evaluate_config(s, a, pool, ["Pass", "Cross"], range(2), metric=metric, zones=0)[0]
        keys = ["player_id", "season", "seed", "feature_set", "rank"]
        assert sorted(map(tuple, ranks.where((F.col("metric") == metric) & (F.col("mode") == "season")).select(*keys).collect())) == sorted(map(tuple, alone.select(*keys).collect()))
    io.append_metrics(evaluation.config_metrics(ranks), str(tmp_path / "metrics"))
    logged = spark.read.parquet(str(tmp_path / "metrics"))
    assert logged.count() == 3 * 4 * 4
    found = io.latest_metric(logged, "mrr", {"mode": "season", "metric": "euclidean", "feature_set": "all"}).first().value
    per_seed = evaluation.metrics(ranks.where("metric = 'euclidean' and feature_set = 'all'")).collect()
    assert found == pytest.approx(sum(r.mrr for r in per_seed) / 2)


def test_a_fit_certifies_itself_or_ends(spark):
    rng = np.random.default_rng(6)
    parts = rng.dirichlet(np.ones(200) * 0.1, 3)
    rows = [(int(i % 2), [float(x) for x in rng.dirichlet(np.ones(3)) @ parts]) for i in range(120)]
    grid = spark.createDataFrame(rows, "seed int, grid array<double>")
    found = zones.fit_each(grid, "seed", 3)
    assert set(found) == {0, 1} and all(r <= zones.RESIDUAL for r in found.residual.values()) and all((h >= 0).all() for h in found.values())
    x = np.array([g for s, g in rows if s == 0])
    w = linalg.nonnegative_weights(x, found[0])
    assert linalg.stationary_residual(found[0], w.T @ x, w.T @ w) <= zones.RESIDUAL * 1.01
    assert ((x - w @ found[0]) ** 2).sum() < 1e-3 * (x**2).sum()  # three planted parts
    with pytest.raises(zones.NotConverged):
        zones.fit_each(grid, "seed", 3, rounds=1)


def test_places_of_rows(spark):
    """Against sorted lists: ties that most rows share, nulls, several groups, more ranges than values."""
    rnd = random.Random(9)
    rows = [(i, rnd.choice("ab"), rnd.choice([0.0, 0.0, 0.0, 1.5, -2.0, float(i), None])) for i in range(300)] + [(300, "c", None), (301, "d", 4.0)]
    df = spark.createDataFrame(rows, "id int, g string, x double").repartition(7)
    for by in ((), ("g",)):
        got = {r.id: (r.same, r.before, r.whole) for r in similarity.placed(df, "x", by).collect()}
        assert len(got) == len(rows)
        for i, g, x in rows:
            others = [y for _, h, y in rows if y is not None and (not by or h == g)]
            assert got[i] == ((None, None, None) if x is None else (others.count(x), sum(y < x for y in others), len(others)))
    few = similarity.distinctiveness(spark.createDataFrame([(1, None), (2, 1.0), (3, 2.0)], "id int, distance double"))
    assert sorted(map(tuple, few.collect())) == [(1, None, None), (2, 1.0, 0.0), (3, 2.0, 100.0)]


def test_style_map_has_the_components_of_a_singular_value_decomposition(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4)) @ np.diag([5.0, 2.0, 1.0, 0.1]) @ rng.normal(size=(4, 4)) + 7
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double, d double")
    points, explained = similarity.style_map(df, ["a", "b", "c", "d"], ["id"])
    centred = x - x.mean(0)
    u, size, _ = np.linalg.svd(centred, full_matrices=False)
    assert explained == pytest.approx([round(v, 3) for v in (size**2 / (size**2).sum())[:2]], abs=1e-3)
    got = np.array([(r.x, r.y) for r in points.orderBy("id").collect()])
    for k in range(2):
        assert np.abs(got[:, k]) == pytest.approx(np.abs(u[:, k] * size[k]), abs=1e-6)
    assert abs((got[:, 0] * got[:, 1]).sum()) < 1e-6


def test_causes_of_difficulty(spark):
    apps, shots = season(12)
    a, s = spark.createDataFrame(apps, APP), spark.createDataFrame(shots, SHOT)
    pool = a.select("player_id", "season").distinct()
    halves = evaluation.Halves(s, a, pool, range(3))
    both = halves.profiles(["Pass", "Cross"])
    columns = ["npxg_per90", "xa_per90", "key_passes_per90"]
    ranks = evaluation.evaluate(both, {"all": columns})
    rows = evaluation.difficulty_causes(ranks, both, halves.split, columns).collect()
    z = {}
    for seed in range(3):
        held = both.where(f"seed = {seed}").collect()
        part = {h: {r.player_id: np.array([r[c] for c in columns]) for r in held if r.half == h} for h in "AB"}
        all_a = np.array(list(part["A"].values()))
        std = np.where(all_a.std(0) > 0, all_a.std(0), 1)
        for p in part["A"]:
            u, v = ((part[h][p] - all_a.mean(0)) / std for h in "AB")
            z.setdefault(p, []).append(u @ v / max(np.linalg.norm(u), 1e-12) / max(np.linalg.norm(v), 1e-12))
    assert {r.player_id: pytest.approx(r.own_cosine, abs=1e-9) for r in rows} == {p: sum(v) / 3 for p, v in z.items()}
    assert all(r.starts_gap == 0 for r in rows)
    ranked = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 4.0), (3, 3.0, 3.0), (4, 3.0, 1.0)], "k int, a double, b double")
    assert evaluation.spearman(ranked, "a", ["b"]).first().b == pytest.approx(-0.9486832980505138)


def test_masks_split_as_the_seeds_do_behind_one_shuffle(spark):
    rnd = random.Random(3)
    apps = [app(m, p, season=2024 + m % 2, position=rnd.choice(["FW", "Sub"])) for p in range(9) for m in range(rnd.randint(1, 40))]
    a = spark.createDataFrame(apps, APP)
    keys = ["player_id", "season", "match_id", "seed", "half"]
    for stratify, seeds in ((None, range(20)), ("started", range(70))):  # more seeds than a number has bits
        masks = evaluation.half_masks(evaluation.dealt(a, profiles.KEYS, seeds), seeds, stratify=stratify)
        split = evaluation.split_halves(a, seeds, stratify=stratify)
        assert sorted(map(tuple, evaluation.unmasked(masks, seeds).select(*keys).collect())) == sorted(map(tuple, split.select(*keys).collect()))
    sums = evaluation.split_halves(a).groupBy("player_id", "season", "seed", "half").count()
    assert sums._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # copies for the seeds aren't shuffled


def test_numbers_of_halves_equal_their_profiles(spark):
    apps, shots = season()
    a, s = spark.createDataFrame(apps + [app(1, 99)], APP), spark.createDataFrame(shots, SHOT)  # the last has no half A
    halves = evaluation.Halves(s, a, None, (1, 2))
    numbers = {(r.player_id, r.seed, r.half): r for r in halves.numbers(["Pass"]).collect()}
    assert len(numbers) == 9 * 2 * 2 and numbers[99, 1, "A"].minutes is None and numbers[99, 1, "A"].shots is None
    for h in "AB":
        rows = profiles.build(s, evaluation.split_halves(a, [2]).where(F.col("half") == h), last_actions=["Pass"], min_starts=0, min_minutes=0, positions=None).collect()
        assert len(rows) == 8 + (h == "B")
        for r in rows:
            n = numbers[r.player_id, 2, h]
            assert all(getattr(n, c) == pytest.approx(r[c]) if r[c] is not None else getattr(n, c) is None for c in n.asDict() if c not in ("seed", "half"))


def test_ranks_along_a_line(spark):
    rnd = random.Random(5)
    rows = [(i % 2, i, [float(rnd.randint(0, 9))], [rnd.choice([0.1, 1.0, 4.3]) * rnd.randint(0, 9)]) for i in range(80)]
    df = spark.createDataFrame(rows, "g int, id int, a array<double>, b array<double>")
    got = similarity.own_ranks(df, "euclidean", ["g"])
    assert "ArrowPython" not in similarity.line_ranks(df, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r["rank"] for r in got.collect()} == {i: sum(abs(c[0] - b[0]) <= abs(a[0] - b[0]) + 1e-12 for h, _, c, _ in rows if h == g) for g, i, a, b in rows}
