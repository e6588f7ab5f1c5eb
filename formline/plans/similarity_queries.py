"""Queries on standardised profiles, similarity, search and maps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import search, similarity
from ..session import cut, table
from ..sources.adapters import APPEARANCES_SQL, POSITIONS, SHOTS_SQL
from .profile_queries import PROFILE, STYLE, built, situation_weights
from .registry import query

AS = f"WITH {APPEARANCES_SQL}, {SHOTS_SQL} "
FEATURES = ["npxg_per90", "shots_per90", "xa_per90", "key_passes_per90", "shot_type_head", "last_action_missing"]
PROF = AS + PROFILE
Z_STATS = ", st AS (SELECT " + ", ".join(f"avg({c}) AS m{i}, stddev_pop(coalesce({c}, (SELECT avg({c}) FROM prof))) AS s{i}" for i, c in enumerate(FEATURES)) + " FROM prof)"
Z = Z_STATS + ", z AS (SELECT player_id, season, " + ", ".join(f"coalesce(({c} - m{i}) / CASE WHEN s{i} > 0 THEN s{i} ELSE 1 END, 0) AS z{i}" for i, c in enumerate(FEATURES)) + " FROM prof, st)"
VEC = "[" + ", ".join(f"z{i}" for i in range(len(FEATURES))) + "]"
Z_ROUNDED = ", ".join(f"round(z{i}, 6) + 0.0 AS {c}" for i, c in enumerate(FEATURES))


def standardised(spark, sf):
    p = built(spark, sf, False)
    return similarity.standardise(p, FEATURES)


def thousandths(v):
    """Rounded as SQL's round rounds a double that isn't negative; F.round takes its decimal digits, which differs for some ties."""
    return F.floor(v * 1000 + 0.5) / 1000


def rounded(*columns):
    return [(F.round(c, 6) + 0.0).alias(c) for c in columns]


SETS = {"rates only": ["npxg_per90", "shots_per90", "xa_per90", "key_passes_per90", "xgchain_per90", "xgbuildup_per90", "npxg_per_shot", "buildup_share_of_chain"], "style only": ["shot_type_head", "shot_type_left_foot", "last_action_missing"], "npxG only": ["npxg_per90"]}
SETS = SETS | {"all": SETS["rates only"] + SETS["style only"]}


@query("n1_feature_sets", PROF + " " + " UNION ALL ".join(f"SELECT '{k}' AS feature_set, {len(v)} AS features, " + " + ".join(f"count({c})" for c in v) + " AS known FROM prof" for k, v in SETS.items()))
def _(spark, sf):
    p = built(spark, sf, False, last_actions=[])
    sets = similarity.feature_sets([c for c in p.columns if c not in ("shot_type_right_foot", "shot_type_other", "last_action_other")])
    named = F.array(*[F.struct(F.lit(k).alias("feature_set"), F.lit(len(v)).alias("features"), sum((F.col(c).isNotNull().cast("long") for c in v), F.lit(0)).alias("known")) for k, v in sets.items()])
    return p.select(F.inline(named)).groupBy("feature_set", "features").agg(F.sum("known").alias("known"))


@query("n2_imputed", PROF + f" SELECT count(*) FILTER (WHERE npxg_per_shot IS NULL) AS npxg_per_shot, count(*) FILTER (WHERE shot_type_head IS NULL) AS shot_type_head, count(*) FILTER (WHERE npxg_per_shot IS NULL) + count(*) FILTER (WHERE shot_type_head IS NULL) AS missing FROM prof")
def _(spark, sf):
    return similarity.imputed(built(spark, sf, False), ["npxg_per_shot", "shot_type_head"])


@query("n3_zscore", PROF + Z + f" SELECT player_id, season, {Z_ROUNDED} FROM z")
def _(spark, sf):
    return standardised(spark, sf).select("player_id", "season", *rounded(*FEATURES))


@query("n4_cosine_to_one", "SELECT b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0 AS similarity FROM embeddings AS a, embeddings AS b WHERE a.vec_id = 7 AND b.vec_id <> 7")
def _(spark, sf):
    return similarity.ranked_for(table(spark, sf, "embeddings"), 7, "vec_id", "embedding").select("vec_id", *rounded("similarity"))


@query("n5_euclidean_to_one", "SELECT b.vec_id, round(-list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0 AS similarity FROM embeddings AS a, embeddings AS b WHERE a.vec_id = 7 AND b.vec_id <> 7")
def _(spark, sf):
    return similarity.ranked_for(table(spark, sf, "embeddings"), 7, "vec_id", "embedding", "euclidean").select("vec_id", *rounded("similarity"))


@query("n6_similar_topk", "SELECT a.vec_id AS id, b.vec_id AS other, rank FROM (SELECT a.vec_id AS ai, b.vec_id AS bi, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS rank FROM embeddings AS a JOIN embeddings AS b ON a.vec_id <> b.vec_id) AS t JOIN embeddings AS a ON a.vec_id = ai JOIN embeddings AS b ON b.vec_id = bi WHERE rank <= 10")
def _(spark, sf):
    return similarity.topk(table(spark, sf, "embeddings"), 10).select("id", "other", "rank")


@query("n7_distance_from_mean", PROF + Z + f" SELECT player_id, season, round(sqrt(list_sum(list_transform({VEC}, lambda x: x * x))), 6) AS distance FROM z")
def _(spark, sf):
    z = standardised(spark, sf)
    return z.select("player_id", "season", F.round(similarity.norm(similarity.vector(FEATURES)), 6).alias("distance"))


@query("n8_distinctiveness", PROF + " SELECT player_id, season, round(100 * percent_rank() OVER (ORDER BY minutes), 6) AS distinctiveness, 100 * percent_rank() OVER (ORDER BY minutes) < 20 AS low_reliability FROM prof")
def _(spark, sf):
    d = similarity.distinctiveness(built(spark, sf, False), "minutes")
    return d.select("player_id", "season", *rounded("distinctiveness"), (F.col("distinctiveness") < search.LOW_DISTINCTIVENESS).alias("low_reliability"))


ID = "{0}.player_id * 10000 + {0}.season"
#: Each player-season's nearest others, and each feature's part of these cosines.
NEAREST = f"SELECT {ID.format('a')} AS id, {ID.format('b')} AS other, row_number() OVER (PARTITION BY a.player_id, a.season ORDER BY round(list_cosine_similarity({VEC.replace('z', 'a.z')}, {VEC.replace('z', 'b.z')}), 9) DESC, {ID.format('b')}) AS rank FROM z AS a JOIN z AS b ON (a.player_id, a.season) <> (b.player_id, b.season)"
PAIRED = (
    f", pairs AS (SELECT a.player_id, a.season, near.other, " + ", ".join(f"a.z{i} AS a{i}, b.z{i} AS b{i}" for i in range(6)) + ", sqrt(" + " + ".join(f"a.z{i} * a.z{i}" for i in range(6)) + ") * sqrt(" + " + ".join(f"b.z{i} * b.z{i}" for i in range(6))
    + f") AS size FROM ({NEAREST}) AS near JOIN z AS a ON {ID.format('a')} = near.id JOIN z AS b ON {ID.format('b')} = near.other WHERE rank <= 3), parts AS ("
    + " UNION ALL ".join(f"SELECT player_id, season, other, '{c}' AS feature, a{i} * b{i} / size AS contribution, a{i} AS z_player, b{i} AS z_other FROM pairs" for i, c in enumerate(FEATURES)) + ")"
)


def pairs(spark, sf):
    z = cut(standardised(spark, sf).select("player_id", "season", (F.col("player_id") * 10000 + F.col("season")).alias("id"), similarity.vector(FEATURES).alias("za")))
    near = similarity.topk(z, 3, id_col="id", vector_col="za", digits=9).select("id", "other")
    return z.join(near, "id").join(z.select(F.col("id").alias("other"), F.col("za").alias("zb")), "other").select("player_id", "season", "other", "za", "zb")


@query("n10_contributions", PROF + Z + PAIRED + " SELECT player_id, season, other, feature, round(contribution, 6) + 0.0 AS contribution, round(z_player, 6) + 0.0 AS z_player, round(z_other, 6) + 0.0 AS z_other FROM parts")
def _(spark, sf):
    return similarity.contributions(pairs(spark, sf), FEATURES).select("player_id", "season", "other", "feature", *rounded("contribution", "z_player", "z_other"))


EXPLAINED = ", ex AS (SELECT player_id, season, other, list(feature ORDER BY contribution DESC, feature)[1:3] AS top3, arg_min(feature, struct_pack(a := contribution, b := feature)) AS against, round(sum(contribution), 4) + 0.0 AS total FROM parts GROUP BY ALL)"


@query("n11_explanation", PROF + Z + PAIRED + EXPLAINED + " SELECT player_id, season, other, array_to_string(top3, ',') AS top3, against, total FROM ex")
def _(spark, sf):
    e = similarity.explain(similarity.contributions(pairs(spark, sf), FEATURES), ["player_id", "season", "other"])
    return e.select("player_id", "season", "other", F.array_join(F.transform("top", lambda x: x["feature"]), ",").alias("top3"), F.col("against.feature").alias("against"), (F.col("total") + 0.0).alias("total"))


@query("n12_explanation_text", PROF + Z + PAIRED + """ SELECT player_id, season, other, CASE WHEN count(*) FILTER (WHERE n <= 3 AND round(contribution, 4) > 0) > 0 THEN 'Both: ' || string_agg(CASE WHEN round(z_player, 2) > 0 THEN 'high ' ELSE 'low ' END || replace(feature, '_', ' '), ', ' ORDER BY n) FILTER (WHERE n <= 3 AND round(contribution, 4) > 0) ELSE 'No strongly shared traits' END AS shared,
  'Main difference: ' || CASE WHEN round(min(contribution), 4) < 0 THEN min(replace(feature, '_', ' ') || ': ' || other || CASE WHEN round(z_other, 2) > round(z_player, 2) THEN ' higher' ELSE ' lower' END) FILTER (WHERE m = 1) ELSE 'no clear difference' END AS difference
  FROM (SELECT *, row_number() OVER (PARTITION BY player_id, season, other ORDER BY contribution DESC, feature) AS n, row_number() OVER (PARTITION BY player_id, season, other ORDER BY contribution, feature) AS m FROM parts) GROUP BY ALL""")
def _(spark, sf):
    e = similarity.explain(similarity.contributions(pairs(spark, sf), FEATURES), ["player_id", "season", "other"])
    labels = {f: f.replace("_", " ") for f in FEATURES}
    return similarity.explanation_text(e.withColumn("name", F.col("other").cast("string")), labels, "name").select("player_id", "season", "other", "shared", "difference")


PCT = " UNION ALL ".join(f"SELECT player_id, season, '{c}' AS feature, {c} AS value, (rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) / count(*) OVER () * 100 AS p FROM prof WHERE {c} IS NOT NULL" for c in FEATURES)


@query("n13_feature_percentiles", PROF + f" SELECT player_id, season, feature, round(p, 6) AS percentile FROM ({PCT})")
def _(spark, sf):
    return similarity.feature_percentiles(built(spark, sf, False), ["player_id", "season"], FEATURES).select("player_id", "season", "feature", *rounded("percentile"))


@query("n14_style_map")
def _(spark, sf):
    z = cut(standardised(spark, sf).select("player_id", "season", *FEATURES))
    return similarity.style_map(z, FEATURES, ["player_id", "season"])[0]


@query("n15_map_scale", PROF + " SELECT player_id, season, round(24 + (npxg_per90 - x0) / CASE WHEN x1 > x0 THEN x1 - x0 ELSE 1 END * 752, 6) AS px, round(536 - (xa_per90 - y0) / CASE WHEN y1 > y0 THEN y1 - y0 ELSE 1 END * 512, 6) AS py FROM prof, (SELECT min(npxg_per90) AS x0, max(npxg_per90) AS x1, min(xa_per90) AS y0, max(xa_per90) AS y1 FROM prof)")
def _(spark, sf):
    p = built(spark, sf, False).select("player_id", "season", F.col("npxg_per90").alias("x"), F.col("xa_per90").alias("y"))
    return similarity.map_scale(p).select("player_id", "season", *rounded("px", "py"))


@query("n16_position_role", "SELECT o_orderpriority, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Striker' WHEN o_orderpriority = '3-MEDIUM' THEN 'Winger' ELSE 'Other' END AS role, count(*) AS n FROM orders GROUP BY ALL")
def _(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderpriority", similarity.role(F.col("o_orderpriority"), {"Striker": POSITIONS[:2], "Winger": POSITIONS[2:]}).alias("role")).groupBy("o_orderpriority", "role").agg(F.count("*").alias("n"))


@query("n17_feature_label", "SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN 'share of small ones' WHEN p_name LIKE 'red %' THEN replace(p_name, '_', ' ') ELSE 'share of shots after ' || replace(p_name, '_', ' ') END AS label FROM part")
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_type") == "SMALL", "zone_1").when(F.col("p_name").startswith("red "), F.col("p_name")).otherwise(F.concat(F.lit("last_action_"), "p_name")).alias("c"))
    return p.select("p_partkey", similarity.feature_label(F.col("c"), {"zone_1": "small ones"}).alias("label"))


@query("n18_visible_roles", "SELECT c_custkey, c_mktsegment, c_acctbal > 0 AS active FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", (F.col("c_acctbal") > 0).alias("active"))
    return similarity.visible(c, ["BUILDING", "MACHINERY"], "c_mktsegment")


@query("n19_feature_groups", PROF + """, long AS (SELECT player_id, season, 'shot_type_head' AS feature, shot_type_head AS v FROM prof UNION ALL SELECT player_id, season, 'last_action_missing', last_action_missing FROM prof UNION ALL SELECT player_id, season, 'starts', starts::DOUBLE FROM prof)
  SELECT player_id, season, feature, CASE WHEN feature LIKE 'last%' THEN 'How shots are created' WHEN feature LIKE 'shot_type%' THEN 'Body part' ELSE 'Output and involvement' END AS grp, CASE WHEN v IS NULL THEN '—' WHEN feature = 'starts' THEN printf('%.2f', v) ELSE floor(v * 100 + 0.5)::INTEGER || '%' END AS shown FROM long""")
def _(spark, sf):
    p = built(spark, sf, False)
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in ("shot_type_head", "last_action_missing", "starts")]))
    long = p.select("player_id", "season", parts.alias("p")).select("player_id", "season", "p.*")
    return long.select("player_id", "season", "feature", similarity.feature_group(F.col("feature")).alias("grp"), similarity.shown_value(F.col("feature"), F.col("v")).alias("shown"))


def names(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


def asked(spark, sf):
    """Queries made of the data: whole names, their last words, and their beginnings."""
    p = table(spark, sf, "part")
    n = F.col("p_name")
    return p.select(F.explode(F.array(n, F.element_at(F.split(n, " "), -1), F.concat(F.upper(F.substring(n, 1, 3)), F.lit("!")))).alias("query")).distinct()


ASKED = "WITH asked AS (SELECT DISTINCT unnest([p_name, split_part(p_name, ' ', -1), upper(substr(p_name, 1, 3)) || '!']) AS query FROM part), q AS (SELECT query, trim(regexp_replace(lower(query), '[^a-z0-9]+', ' ', 'g')) AS q FROM asked), n AS (SELECT p_partkey AS id, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS n FROM part)"


@query("q2_find_exact", ASKED + " SELECT query, id FROM q JOIN n ON q = n")
def _(spark, sf):
    from ..functions.text import normalised_ascii

    q = asked(spark, sf).select("query", normalised_ascii(F.col("query")).alias("q"))
    return search.find_exact(q, names(spark, sf).select("id", normalised_ascii(F.col("name")).alias("n")))


@query("q3_find_words", ASKED + " SELECT query, id FROM q JOIN n ON list_bool_and(list_transform(string_split(q, ' '), lambda w: contains(n, w)))")
def _(spark, sf):
    from ..functions.text import normalised_ascii

    q = asked(spark, sf).select("query", normalised_ascii(F.col("query")).alias("q"))
    return search.find_words(q, names(spark, sf).select("id", normalised_ascii(F.col("name")).alias("n")))


TIERS = ", ex AS (SELECT query, id, 1 AS tier FROM q JOIN n ON q = n), wd AS (SELECT query, id, 2 AS tier FROM q JOIN n ON list_bool_and(list_transform(string_split(q, ' '), lambda w: contains(n, w))) WHERE query NOT IN (SELECT query FROM ex)), hits AS (SELECT * FROM ex UNION ALL SELECT * FROM wd)"


@query("q5_tiered_search", ASKED + TIERS + " SELECT query, id, tier FROM hits")
def _(spark, sf):
    return search.find_players(asked(spark, sf), names(spark, sf), True).select("query", "id", "tier")


@query("q4_fuzzy_search")
def _(spark, sf):
    misspelt = table(spark, sf, "part").select(F.concat(F.substring("p_name", 1, 3), F.substring(F.col("p_name"), F.lit(5), F.length("p_name"))).alias("query")).distinct()
    return search.find_players(misspelt, names(spark, sf))


@query("q16_suggestions", ASKED + TIERS + " SELECT query, id FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier, id) AS n FROM hits WHERE length(query) >= 2) WHERE n <= 8")
def _(spark, sf):
    return search.suggestions(asked(spark, sf), names(spark, sf), ascii_only=True).select("query", "id")


def market(spark, sf):
    """Market fields of the customers: age from the key, value from the balance, contract from the last order."""
    last = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("player_id")).agg(F.max("o_orderdate").alias("contract_expiration_date"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("player_id"), (F.col("c_custkey") % 25 + 15.5).alias("age_at_snapshot"), (F.col("c_acctbal") * 1000).alias("market_value_eur"))
    return c.join(last, "player_id", "left")


RANKED = "WITH last AS (SELECT o_custkey, max(o_orderdate) AS d FROM orders GROUP BY 1), ranked AS (SELECT c_custkey AS id, c_acctbal AS similarity, c_mktsegment <> 'BUILDING' AS active, floor(c_custkey % 25 + 15.5)::INTEGER AS age, c_acctbal * 1000 / 1e6 AS value_m, d::DATE AS contract_end FROM customer LEFT JOIN last ON c_custkey = o_custkey)"


def ranked(spark, sf):
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("player_id"), F.col("c_acctbal").alias("similarity"), (F.col("c_mktsegment") != "BUILDING").alias("active"))
    return search.with_market(base, market(spark, sf)).withColumnRenamed("player_id", "id")


@query("q6_with_market", RANKED + " SELECT id, age, value_m, contract_end FROM ranked")
def _(spark, sf):
    return ranked(spark, sf).select("id", "age", "value_m", "contract_end")


@query("q7_exclude_inactive", RANKED + " SELECT id, active FROM ranked WHERE active")
def _(spark, sf):
    return search.exclude_inactive(ranked(spark, sf)).select("id", "active")


@query("q8_market_filters", RANKED + " SELECT id, age FROM ranked WHERE age <= 24 AND coalesce(value_m <= 5, FALSE) AND coalesce(year(contract_end) < 2001, FALSE)")
def _(spark, sf):
    return ranked(spark, sf).where(search.market_filter(24, 5, 2001)).select("id", "age")


@query("q9_search", RANKED + " SELECT id, similarity, (SELECT count(*) FROM ranked WHERE active) AS candidates, (SELECT count(*) FROM ranked WHERE NOT active) AS inactive_excluded, (SELECT count(*) FROM ranked WHERE active AND NOT (age <= 24)) AS removed_by_filters FROM ranked WHERE active AND age <= 24 ORDER BY similarity DESC, id LIMIT 10")
def _(spark, sf):
    return search.search(ranked(spark, sf), 10, max_age=24).select("id", "similarity", "candidates", "inactive_excluded", "removed_by_filters")


@query("q10_season_slice", PROF + " SELECT player_id, minutes FROM prof WHERE season = 1998")
def _(spark, sf):
    return search.season_slice(built(spark, sf, False), 1998).select("player_id", "minutes")


@query("q12_player_card", PROF + f", pct AS ({PCT}) SELECT player_id, season, p.player, p.minutes, string_agg(feature || '=' || round(p, 3)::DECIMAL(9,3), ',' ORDER BY feature) AS features FROM pct JOIN prof AS p USING (player_id, season) GROUP BY ALL")
def _(spark, sf):
    p = built(spark, sf, False)
    d = similarity.distinctiveness(p, "minutes")
    c = search.cards(search.summary(p), similarity.feature_percentiles(p, ["player_id", "season"], FEATURES), d)
    shown = F.array_join(F.transform("features", lambda x: F.concat(x["feature"], F.lit("="), thousandths(x["percentile"]).cast("decimal(9,3)").cast("string"))), ",")
    return c.select("player_id", "season", "player", "minutes", shown.alias("features"))


@query("q12_cards_with_zones", PROF + f""", counted AS (SELECT player_id, season, dense_rank() OVER (ORDER BY shotType)::INTEGER AS zone, n FROM (SELECT player_id, season, shotType, count(*) AS n FROM shots WHERE {STYLE} GROUP BY ALL)),
  weighed AS (SELECT player_id, season, zone, n::DOUBLE / sum(n) OVER (PARTITION BY player_id, season) AS weight FROM counted),
  shown AS (SELECT player_id, season, string_agg(zone || ':' || floor(weight * 1000 + 1e-9)::BIGINT, ',' ORDER BY zone) AS zones FROM weighed GROUP BY ALL)
  SELECT player_id, season, p.player, zones, round(100.0 * (SELECT count(*) FROM prof AS o WHERE o.minutes < p.minutes) / ((SELECT count(*) FROM prof) - 1), 6) AS distinctiveness FROM prof AS p LEFT JOIN shown USING (player_id, season)""")
def _(spark, sf):
    p = cut(built(spark, sf, False))
    c = search.cards(search.summary(p), similarity.feature_percentiles(p, ["player_id", "season"], FEATURES), similarity.distinctiveness(p, "minutes"), situation_weights(spark, sf))
    shown = F.array_join(F.transform("zones", lambda z: F.concat(z["zone"].cast("string"), F.lit(":"), F.floor(z["weight"] * 1000 + 1e-9).cast("string"))), ",")
    return c.select("player_id", "season", "player", shown.alias("zones"), F.round("distinctiveness", 6).alias("distinctiveness"))


@query("q13_similar_table", PROF + Z + f" SELECT id, other, rank FROM ({NEAREST}) WHERE rank <= 5")
def _(spark, sf):
    v = standardised(spark, sf).select((F.col("player_id") * 10000 + F.col("season")).alias("id"), similarity.vector(FEATURES).alias("v"))
    return similarity.topk(v, 5, id_col="id", vector_col="v", digits=9).select("id", "other", "rank")


FILTERED = Z.replace("player_id, season, ", "player_id * 10000 + season AS id, starts >= 3 AS active, (minutes % 40)::INTEGER AS age, ", 1).replace(", z AS (SELECT", ", z AS (SELECT", 1)


@query("q13_filtered_tables", PROF + FILTERED + f""", w AS (SELECT count(*) FILTER (WHERE active) AS a, count(*) FILTER (WHERE NOT active) AS i, count(*) FILTER (WHERE active AND age > 24) AS f FROM z)
  SELECT id, other, rank, candidates, inactive_excluded, removed_by_filters FROM (SELECT a.id, b.id AS other, w.a - a.active::INTEGER AS candidates, i - (NOT a.active)::INTEGER AS inactive_excluded, f - (a.active AND a.age > 24)::INTEGER AS removed_by_filters,
    row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity({VEC.replace('z', 'a.z')}, {VEC.replace('z', 'b.z')}), 9) DESC, b.id) AS rank FROM z AS a JOIN z AS b ON a.id <> b.id AND b.active AND b.age <= 24, w) WHERE rank <= 10""")
def _(spark, sf):
    z = standardised(spark, sf).select((F.col("player_id") * 10000 + F.col("season")).alias("id"), (F.col("starts") >= 3).alias("active"), (F.col("minutes") % 40).cast("int").alias("age"), F.lit(None).cast("double").alias("value_m"), F.lit(None).cast("date").alias("contract_end"), *FEATURES)
    return search.similar_tables(cut(z), FEATURES, 10, digits=9, max_age=24).select("id", "other", "rank", "candidates", "inactive_excluded", "removed_by_filters")


@query("q14_pool_meta", RANKED + " SELECT (SELECT max(o_orderdate) FROM orders) AS data_until, (SELECT count(*) FROM customer) AS pool_size, (SELECT max(l_shipdate) FROM lineitem) AS valuations_as_of")
def _(spark, sf):
    p = market(spark, sf).select(F.col("contract_expiration_date").alias("window_end"))
    return search.pool_meta(p, table(spark, sf, "lineitem").select(F.col("l_shipdate").alias("valuations_as_of")))


@query("q15_display_format", RANKED + " SELECT id, CASE WHEN value_m IS NULL THEN '—' WHEN value_m >= 10 THEN '€' || floor(value_m + 0.5)::INTEGER || 'm' ELSE printf('€%.1fm', floor(value_m * 10 + 0.5) / 10) END AS value, coalesce(strftime(contract_end, '%Y-%m'), '—') AS contract, coalesce(strftime(contract_end, '%b %Y'), '—') AS month FROM (SELECT id, floor(abs(value_m) * 2) / 4 AS value_m, contract_end FROM ranked)")
def _(spark, sf):
    r = ranked(spark, sf).withColumn("value_m", F.floor(F.abs("value_m") * 2) / 4)
    return r.select("id", search.value_label(F.col("value_m")).alias("value"), search.contract_label(F.col("contract_end")).alias("contract"), search.month_label(F.col("contract_end")).alias("month"))
