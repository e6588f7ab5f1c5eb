"""Player lookups and similar-player search with market filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import cut
from . import similarity

FUZZY_CUTOFF, LOW_DISTINCTIVENESS = 0.8, 20


def find_exact(queries: DataFrame, names: DataFrame) -> DataFrame:
    """queries: query, q (normalised); names: id, n (normalised) -> (query, id)."""
    return queries.join(names.hint("merge"), F.col("q") == F.col("n")).select("query", "id")


def grams(c: Column, size: int) -> Column:
    """Different substrings of `size` letters; the empty one for size 0."""
    if not size:
        return F.array(F.lit(""))
    last = F.length(c) - size + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(c, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def find_words(queries: DataFrame, names: DataFrame, gram: int = 3) -> DataFrame:
    """Names that hold every word of a query as a substring; an empty query is held by every name.

    The first `gram` letters of the query's longest word (all of it, if it is shorter) are looked up among the names'
    substrings of that length by an equality join; the other words are then checked. Each different name is looked up once
    and meets its ids afterwards. Substrings are many times what the planner expects of them, and so are names in few
    bytes of a file, so that none of these is ever broadcast.
    """
    longest = F.array_max(F.transform("words", lambda w: F.struct(F.length(w).alias("l"), w.alias("w"))))["w"]
    asked = queries.select("query", F.split("q", " ").alias("words")).withColumn("g", F.substring(longest, 1, gram))
    holds = F.forall("words", lambda w: F.contains(F.col("n"), w))
    indexed = names.where("n is not null").select("n").distinct().select("n", F.explode(F.flatten(F.array(*[grams(F.col("n"), k) for k in range(gram + 1)]))).alias("g"))
    found = asked.join(indexed.hint("merge"), "g").where(holds).select("query", "n").distinct()
    return found.join(names.select("id", "n").hint("merge"), "n").select("query", "id").distinct()


def spelling_keys(part: Column) -> Column:
    """What two strings of a ratio of 0.8 or more always share: a bigram (numbered where it is repeated) or, in short ones, an end.

    A ratio of 0.8 leaves at most a fifth of the letters unmatched. Matching blocks of one letter each need an
    unmatched one between them, so strings of more than five letters together share a block of two. Of the shorter
    ones only 'xy' and 'x?y', and equal single letters, are left.
    """
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(part) - 1, F.lit(1))), lambda i: F.substr(part, i, F.lit(2)))
    pairs = F.filter(pairs, lambda g: F.length(g) == 2)
    numbered = F.transform(pairs, lambda g, i: F.concat(F.lit("2"), g, F.size(F.filter(F.slice(pairs, F.lit(1), i + 1), lambda x: x == g)).cast("string")))
    ends = F.when(F.length(part) == 3, F.array(F.concat(F.lit("^"), F.substring(part, 1, 1), F.substring(part, 3, 1)))).when(F.length(part) == 2, F.array(F.concat(F.lit("^"), part))).when(F.length(part) == 1, F.array(F.concat(F.lit("1"), part)))
    return F.concat(numbered, F.coalesce(ends, F.array().cast("array<string>")))


def find_fuzzy(queries: DataFrame, names: DataFrame, cutoff: float = FUZZY_CUTOFF) -> DataFrame:
    """(query, id, score): the best ratio of the query to the name or one of its words, at cutoff (0.8 or more) or above.

    Matching strings of n and m letters share at least (n + m) / 5 - 1 bigrams, and m is 2 n / 3 at least, so that a query
    has n / 3 - 1 of its n - 1 bigrams in common with any match. It is therefore looked up under its rarest bigrams only, of which
    so many may be missing; common ones gather no candidates. Each different pair of strings is then compared once.
    """
    if cutoff < FUZZY_CUTOFF:
        raise ValueError("the keys find all close spellings from a ratio of 0.8 on")
    parts = F.array_distinct(F.array_append(F.split("n", " "), F.col("n")))
    held = cut(names.where("n is not null").select("n").distinct().select("n", F.explode(F.array_distinct(F.flatten(F.transform(parts, spelling_keys)))).alias("g")))
    keys = queries.where("q <> ''").select("q").distinct().select("q", F.explode(spelling_keys(F.col("q"))).alias("g"))
    common = held.groupBy("g").agg(F.count("*").alias("names"))
    pair = F.col("g").startswith("2")
    order = Window.partitionBy("q", pair).orderBy(F.coalesce("names", F.lit(0)), "g")
    needed = F.length("q") - F.greatest(F.lit(1), F.ceil(F.length("q") / 3.0 - 1))
    asked = keys.join(common, "g", "left").withColumn("place", F.row_number().over(order)).where(~pair | (F.col("place") <= needed)).select("q", "g")
    # a word of the name, or the name, must be about as long as the query
    fits = F.exists(parts, lambda p: 2 * F.least(F.length(p), F.length("q")) >= (F.length(p) + F.length("q")) * (cutoff - 1e-9))
    scored = text.close_spellings(asked.join(held.hint("merge"), "g").where(fits).select("q", "n")).where(F.col("score") >= cutoff)
    return queries.join(scored, "q").join(names.hint("merge"), "n").select("query", "id", "score")


def find_players(queries: DataFrame, names: DataFrame, ascii_only: bool = False) -> DataFrame:
    """(query, id, tier, score): exact matches, else names with all words, else close spellings.

    queries: query; names: id, name. Only the first tier with a hit answers a query; fuzzy matching is done for
    queries without one.
    """
    norm = text.normalised_ascii if ascii_only else text.normalised
    q = queries.select("query", norm(F.col("query")).alias("q")).distinct()
    n = names.select("id", norm(F.col("name")).alias("n"))
    exact = find_exact(q, n).withColumns({"tier": F.lit(1), "score": F.lit(1.0)})
    open_q = q.join(exact.select("query").distinct(), "query", "left_anti")
    words = find_words(open_q, n).withColumns({"tier": F.lit(2), "score": F.lit(1.0)})
    rest = open_q.join(words.select("query").distinct(), "query", "left_anti")
    fuzzy = find_fuzzy(rest, n).withColumn("tier", F.lit(3)).select("query", "id", "tier", "score")
    return exact.unionByName(words).unionByName(fuzzy)


def suggestions(queries: DataFrame, names: DataFrame, least: int = 2, most: int = 8, ascii_only: bool = False) -> DataFrame:
    """The first hits for queries of `least` letters or more."""
    hits = find_players(queries.where(F.length("query") >= least), names, ascii_only)
    order = Window.partitionBy("query").orderBy("tier", F.desc("score"), "id")
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def with_market(profiles: DataFrame, market: DataFrame, key: str = "player_id") -> DataFrame:
    """Adds age (whole years), value in millions and the contract's end."""
    m = market.select(key, F.floor("age_at_snapshot").cast("int").alias("age"), (F.col("market_value_eur") / 1e6).alias("value_m"), F.to_date("contract_expiration_date").alias("contract_end"))
    return profiles.join(m, key, "left")


def exclude_inactive(ranked: DataFrame) -> DataFrame:
    return ranked.where(F.coalesce("active", F.lit(False)))


def market_filter(max_age: int | None = None, max_value: float | None = None, contract_before: int | None = None) -> Column:
    """A missing value fails only the filter that is set."""
    keep = F.lit(True)
    for limit, test in ((max_age, F.col("age") <= max_age), (max_value, F.col("value_m") <= max_value), (contract_before, F.year("contract_end") < contract_before)):
        if limit is not None:
            keep = keep & F.coalesce(test, F.lit(False))
    return keep


def search(ranked: DataFrame, n: int = 10, include_inactive: bool = False, own: DataFrame | None = None, **filters) -> DataFrame:
    """The n most similar rows that pass, with the counts of candidates, inactive and filtered rows beside them.

    ranked: id, similarity, active, age, value_m, contract_end. Candidates are counted without the inactive rows
    and before the market filters. own: the asking player's one row with distinctiveness, which is added to each.
    """
    passes = market_filter(**filters)
    active = F.lit(True) if include_inactive else F.coalesce("active", F.lit(False))
    counts = ranked.agg(F.count_if(active).alias("candidates"), F.count_if(~active).alias("inactive_excluded"), F.count_if(active & ~passes).alias("removed_by_filters"))
    if own is not None:
        counts = counts.crossJoin(F.broadcast(own.select("distinctiveness", (F.col("distinctiveness") < LOW_DISTINCTIVENESS).alias("low_reliability")).limit(1)))
    return ranked.where(active & passes).orderBy(F.desc("similarity"), "id").limit(n).crossJoin(F.broadcast(counts))  # counts are one row


def similar_tables(pool: DataFrame, features: list[str], n: int = 10, metric: str = "cosine", include_inactive: bool = False, digits: int | None = None, **filters) -> DataFrame:
    """The n most similar players that pass for every player of the pool, each with its explanation and the asking player's counters.

    pool: id, active, age, value_m, contract_end and z-scored features. The filters don't depend on who asks, so
    everybody is held against the same candidates; counters leave out the asking player.
    """
    active = F.lit(True) if include_inactive else F.coalesce("active", F.lit(False))
    v = similarity.vector(features)
    marked = pool.select("id", v.alias("v"), active.alias("__active"), market_filter(**filters).alias("__passes"))
    found = similarity.topk(marked.withColumn("__candidate", F.col("__active") & F.col("__passes")), n, metric, "id", "v", candidate="__candidate", digits=digits)
    whole = marked.agg(F.count_if("__active").alias("a"), F.count_if(~F.col("__active")).alias("i"), F.count_if(F.col("__active") & ~F.col("__passes")).alias("f"))
    less = lambda total, own: F.col(total) - own.cast("long")
    counted = similarity.distinctiveness(marked.withColumn("distance", similarity.norm(F.col("v")))).crossJoin(F.broadcast(whole)).select(  # one row
        "id", "distinctiveness", (F.col("distinctiveness") < LOW_DISTINCTIVENESS).alias("low_reliability"),
        less("a", F.col("__active")).alias("candidates"), less("i", ~F.col("__active")).alias("inactive_excluded"), less("f", F.col("__active") & ~F.col("__passes")).alias("removed_by_filters"),
    )
    vectors = marked.select("id", "v")
    pairs = found.select("id", "other").join(vectors.withColumnRenamed("v", "za"), "id").join(vectors.select(F.col("id").alias("other"), F.col("v").alias("zb")), "other")
    explained = similarity.explain(similarity.contributions(pairs, features), ["id", "other"])
    return found.join(counted, "id").join(explained, ["id", "other"])


def season_slice(profiles: DataFrame, season: int) -> DataFrame:
    return profiles.where(F.col("season") == season)


def summary(profiles: DataFrame) -> DataFrame:
    """One record for each player: ids, team, league, position, window and market fields that exist."""
    wanted = ["player_id", "season", "player", "teams", "league", "primary_position", "minutes", "window_start", "window_end", "active", "age", "value_m", "contract_end"]
    return profiles.select(*[c for c in wanted if c in profiles.columns])


def cards(summaries: DataFrame, percentiles: DataFrame, distinct: DataFrame, zones: DataFrame | None = None, keys: tuple[str, ...] = ("player_id", "season")) -> DataFrame:
    """Everything about a player in one row: summary, percentiles, distinctiveness and zone weights."""
    p = percentiles.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("feature", "value", "percentile"))).alias("features"))
    out = summaries.join(distinct.select(*keys, "distinctiveness"), list(keys), "left").join(p, list(keys), "left")
    if zones is not None:
        z = zones.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("zone", "weight"))).alias("zones"))
        out = out.join(z, list(keys), "left")
    return out.withColumn("low_reliability", F.col("distinctiveness") < LOW_DISTINCTIVENESS)


def pool_meta(profiles: DataFrame, market: DataFrame) -> DataFrame:
    a = profiles.agg(F.max("window_end").alias("data_until"), F.count("*").alias("pool_size"))
    return a.crossJoin(market.agg(F.max("valuations_as_of").alias("valuations_as_of")))  # two single rows


def window_label(start: Column, end: Column) -> Column:
    return F.concat(F.date_format(start, "yy-MM"), F.lit("–"), F.date_format(end, "yy-MM"))


def value_label(millions: Column) -> Column:
    """'€12m' from ten millions on, '€5.5m' below, a dash for null."""
    return F.when(millions.isNull(), "—").when(millions >= 10, F.format_string("€%dm", F.floor(millions + 0.5))).otherwise(F.format_string("€%.1fm", millions))


def month_label(date: Column) -> Column:
    return F.coalesce(F.date_format(date, "MMM yyyy"), F.lit("—"))


def contract_label(date: Column) -> Column:
    return F.coalesce(F.date_format(date, "yyyy-MM"), F.lit("—"))
