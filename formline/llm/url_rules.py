"""URL filters: given host and path rules, and rules mined from labels by FP-growth.

Mining: the tokens of each labelled url, and an item for a bad label, are one transaction. Tokens that no rule can hold
are left out, and tokens of the same urls become one item, so that a url of a common template isn't a set of a thousand
parts. Spark's FP-growth finds the frequent sets of items; where a url still has more than MOST_ITEMS items, whose parts
can't be gone through, sets are found one size after the other instead. Sets with the urls of one of their parts are left out.
The rules "items -> bad" above the support and confidence bounds stay, unless chance explains
them or a rule on a part of their items has at least their confidence. Chance explains a rule if so many bad urls
among its urls aren't surely rarer than CHANCE, whatever number of sets is tried. Matching: each rule stands in an inverted index under its rarest
token, so that a url meets only rules of its own tokens; the other tokens are then checked on its token array.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

BAD = "=bad"
#: Probability that any rule of all is there by chance, the most items of a rule, and the most items of a url for FP-growth.
CHANCE, MOST_TOKENS, MOST_ITEMS = 0.05, 6, 14
#: Rules a broadcast may hold; more are joined by shuffle.
BROADCAST_RULES = 20_000


def ascii_lower(c: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, upper, upper.lower())


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: then up to ?, # or the end. Else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substr({0}, instr({0}, '://') + 3)".format("url"))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct lower-case alphanumeric parts of a url."""
    return F.array_distinct(F.filter(F.split(ascii_lower(F.coalesce(url, F.lit(""))), "[^a-z0-9]+"), lambda t: t != ""))


def listed_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest (verdict, rule) of a given list that fits, with rules like 'example.net/en/'; (rule, verdict) or nulls.

    A rule fits its host and all its subdomains, if the path starts with the rule's path; a url without a path
    after the host doesn't fit a rule with one. Of equally long rules the first in alphabetical order wins.
    """
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        own_host, _, own_path = text.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith("/" + own_path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def parts_of(rule: Column) -> Column:
    """All proper, non-empty parts of a sorted array of tokens, each sorted."""
    every = F.aggregate(rule, F.array(F.array().cast("array<string>")), lambda some, t: F.concat(some, F.transform(some, lambda x: F.array_append(x, t))))
    return F.filter(every, lambda x: (F.size(x) > 0) & (F.size(x) < F.size(rule)))


def surprise(urls: Column, confidence: Column, base: Column) -> Column:
    """-log of a bound (Chernoff's) of the probability that this share or a greater one of the urls is bad by chance."""
    rest = F.when(confidence < 1, (1 - confidence) * F.log((1 - confidence) / (1 - base))).otherwise(0.0)
    return urls * (confidence * F.log(confidence / base) + rest)


def _items(baskets: DataFrame, total: int, least: int) -> tuple[DataFrame, int]:
    """(id, items, bad) of baskets (id, t, bad): tokens that a rule can hold, those of the same urls as one item; and how many frequent tokens no rule can hold.

    Tokens of every url and those with too few bad urls are left out. A url's tokens bound the size of an item.
    """
    each = baskets.select("id", F.explode("t").alias("token"), "bad")
    other = F.xxhash64("id", F.lit("urls"))
    known = cut(each.groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("nb"), F.sum(F.col("id").cast("decimal(38,0)")).alias("s1"), F.sum(other.cast("decimal(38,0)")).alias("s2")))
    useful = known.where((F.col("nb") >= least) & (F.col("n") < total))
    items = useful.groupBy("n", "s1", "s2").agg(F.array_sort(F.collect_list("token")).alias("tokens")).select(F.array_join("tokens", "+").alias("item"), F.explode("tokens").alias("token"))
    held = each.join(items, "token").groupBy("id").agg(F.array_sort(F.collect_set("item")).alias("items"), F.bool_or("bad").alias("bad"))
    return cut(held), known.where((F.col("nb") < least) & (F.col("n") >= least)).count()


def _parts(items: Column) -> Column:
    """The parts of a sorted array that lack one of its items, each joined to one string."""
    return F.transform(items, lambda x: F.array_join(F.filter(items, lambda y: y != x), " "))


def _minimal(sets: DataFrame, smaller: DataFrame) -> DataFrame:
    """The rows of sets (items, n, ...) that hold fewer urls than each of their parts (items, n) with one item less."""
    one = sets.where(F.size("items") == 1)
    parts = sets.where(F.size("items") > 1).select("*", F.explode(_parts(F.col("items"))).alias("part"))
    known = smaller.select(F.array_join("items", " ").alias("part"), F.col("n").alias("of_part"))
    own = [c for c in sets.columns if c != "items"]
    good = parts.join(known, "part").where("of_part > n").groupBy("items").agg(F.count("*").alias("found"), *[F.first(c).alias(c) for c in own]).where("found = size(items)")
    return one.unionByName(good.select(*sets.columns))


def _grown(baskets: DataFrame, least: int) -> DataFrame:
    """(items, n, nb) of the minimal sets by Spark's FP-growth; nb is null for sets that are no rule's."""
    sized = baskets.select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items"))
    total = sized.count()
    model = FPGrowth(itemsCol="items", minSupport=max(0.0, (least - 0.5) / total), minConfidence=0.0).fit(sized)
    short = model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("n")).where(F.size("items") <= MOST_TOKENS + 1)
    sets = cut(short.where(~F.array_contains("items", BAD) & (F.size("items") <= MOST_TOKENS)))
    rules = model.associationRules.where(F.array_contains("consequent", BAD)).select(F.array_join(F.array_sort("antecedent"), " ").alias("key"), F.round(F.col("support") * total).cast("long").alias("nb"))
    return _minimal(sets, sets).withColumn("key", F.array_join("items", " ")).join(rules, "key", "left").select("items", "n", "nb")


def _levels(baskets: DataFrame, least: int) -> DataFrame:
    """(items, n, nb) of the minimal sets, one size after the other: for urls of so many items that FP-growth would go through all their parts."""
    held = baskets.select("id", "bad", F.explode("items").alias("item")).select("id", "bad", F.array("item").alias("items"))
    found = None
    for size in range(1, MOST_TOKENS + 1):
        counted = held.groupBy("items").agg(F.count("*").alias("n"), F.count_if("bad").alias("nb")).where(F.col("n") >= least)
        level = cut(counted if found is None else _minimal(counted, level))
        found = level if found is None else found.unionByName(level)
        if size == MOST_TOKENS or level.isEmpty():
            break
        more = held.join(level.select("items"), "items").join(baskets.select("id", F.col("items").alias("all")), "id")
        held = cut(more.select("id", "bad", "items", F.explode(F.filter("all", lambda x: x > F.element_at("items", -1))).alias("next")).select("id", "bad", F.array_append("items", F.col("next")).alias("items")))
    return found


def mine(labelled: DataFrame, url_col: str = "url", bad_col: str = "bad", min_support: float = 0.0005, min_confidence: float = 0.5, min_count: int = 5, chance: float = CHANCE, most_items: int = MOST_ITEMS) -> DataFrame:
    """(rule array<string>, confidence, support, key) from urls and boolean labels; rows with a null label are left out.

    Different urls count, not rows: each url once for each of its labels. min_support is the share of these that hold the
    rule's tokens together with a bad label; min_count is the least number of them. Tokens that always occur together are
    one item; rules hold MOST_TOKENS items at most, and all tokens of each. A set of items with the urls of one of its
    parts is no rule of its own. Chance is judged by the number of all other frequent sets, of whatever label.
    Null and empty urls have no tokens, equal confidences leave the rule of fewer items, and empty labels give no rules.
    """
    known = labelled.where(F.col(bad_col).isNotNull()).select(F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.col(bad_col).alias("bad")).distinct()
    baskets = cut(known.select(F.xxhash64("url", "bad").alias("id"), tokens(F.col("url")).alias("t"), "bad"))
    spark = labelled.sparkSession
    total, bad = baskets.agg(F.count("*"), F.count_if("bad")).first()
    least = max(min_count, math.ceil(min_support * total))
    held, others = _items(baskets, total, least) if bad and bad < total else (None, 0)  # else nothing to tell apart
    longest = held.agg(F.max(F.size("items"))).first()[0] if held is not None else None
    if not longest:
        return spark.createDataFrame([], "rule array<string>, confidence double, support double, key string")
    sets = cut(_grown(held, least) if longest <= most_items else _levels(held, least))
    tried = sets.count() + others
    share = F.col("nb") / F.col("n")
    found = sets.where((F.col("nb") >= least) & (share >= min_confidence) & (share > bad / total)).select("items", share.alias("confidence"), (F.col("nb") / total).alias("support"), "n")
    kept = cut(found.where(surprise(F.col("n"), F.col("confidence"), F.lit(bad / total)) >= math.log(tried / chance)))
    # a part of at least a rule's confidence makes it superfluous
    smaller = kept.select(F.col("items").alias("part"), F.col("confidence").alias("part_confidence"))
    covered = kept.select("items", "confidence", F.explode(parts_of(F.col("items"))).alias("part")).join(smaller, "part").where("part_confidence >= confidence").select("items").distinct()
    pruned = kept.join(covered, "items", "left_anti").select(F.array_sort(F.split(F.array_join("items", "+"), "[+]")).alias("rule"), "confidence", "support")
    rarity = baskets.select(F.explode("t").alias("token")).groupBy("token").agg(F.count("*").alias("freq"))
    key = pruned.select("rule", F.explode("rule").alias("token")).join(rarity, "token").groupBy("rule").agg(F.min_by("token", F.struct("freq", "token")).alias("key"))
    return pruned.join(key, "rule").select("rule", "confidence", "support", "key")


def match(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, mined_rule, confidence) of the most confident mined rule that fits; urls without one are absent.

    Urls meet the index through distinct (url, token) rows, so that copies of a url are matched once.
    """
    urls = pages.select(F.col(url_col).alias("url")).where("url is not null").distinct()
    index = F.broadcast(rules) if rules.count() <= BROADCAST_RULES else rules
    hits = (
        urls.select("url", tokens(F.col("url")).alias("t"))
        .select("url", "t", F.explode("t").alias("key"))
        .join(index, "key")
        .where(F.size(F.array_except("rule", "t")) == 0)
        .groupBy("url")
        .agg(F.max_by(F.struct("rule", "confidence"), F.struct("confidence", "rule")).alias("best"))
    )
    return hits.select("url", F.array_join("best.rule", "+").alias("mined_rule"), F.col("best.confidence").alias("confidence"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], mined: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule, confidence for each row of pages.

    A listed rule decides (rule is then not null); else a fitting mined rule blocks; else the url is allowed. Null
    urls and urls without :// have an empty host and path and fit no listed rule; a null url is allowed. Of mined rules
    with equal confidence the last in alphabetical order is named. Urls of any length are read whole; repeated rows are judged each; an empty table gives no rows; other columns aren't read.
    """
    picked = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    parts = picked.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    listed = parts.select("*", rule.alias("rule"), verdict.alias("listed"))
    hits = match(picked, mined, "page_id", "url")
    # null urls have no tokens, and would all meet under one key
    none = listed.where("url is null").withColumns({"mined_rule": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    return listed.where("url is not null").join(hits, "url", "left").unionByName(none).select(
        "page_id", "host", "path", "rule", F.coalesce("listed", F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")).alias("verdict"), "mined_rule", "confidence"
    )
