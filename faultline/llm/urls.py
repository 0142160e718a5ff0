"""URL filter: fixed host and path rules, else association rules over URL tokens. DataFrame functions and Spark ML only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from faultline.llm.common import attach_small
from faultline.session import cut

#: (verdict, host and path); the longest that fits decides.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
MIN_SUPPORT = 0.002
#: Least confidence of a rule as a multiple of the share of unwanted pages.
MIN_LIFT = 1.5
#: Greatest chance that any combination tested gives a rule although urls tell nothing.
MAX_CHANCE = 0.01
UNWANTED = "label=unwanted"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits the host or a domain above it and begins the path; else NULL."""

    def fits(rule: str) -> Column:
        h, _, p = rule.partition("/")
        return ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)

    ordered = sorted(rules, key=lambda r: -len(r[1]))
    choose = lambda pick: reduce(lambda c, r: c.when(fits(r[1]), pick(r)), ordered, F.when(F.lit(False), F.lit("")))
    return choose(lambda r: r[1]), choose(lambda r: r[0])


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: host labels, path segments with digits as 0, names of query fields, the fragment."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit(""))
    named = lambda kind, words: F.transform(F.filter(words, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    parts = F.split(F.regexp_replace(F.translate(path, UPPER, LOWER), "[0-9]+", "0"), "[/.]")
    fields = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    mark = F.when(url.contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(named("h:", F.split(host, r"\.")), named("p:", parts), named("q:", fields), mark))


def mine_rules(
    labelled: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_confidence: float | None = None,
    min_lift: float = MIN_LIFT,
    max_chance: float = MAX_CHANCE,
) -> DataFrame:
    """(tokens, key, confidence, lift, pages) of token combinations that point to unwanted pages.

    `labelled` has tokens and unwanted (boolean). The base rate is the share of unwanted pages in it. Combinations below
    the support, or below the confidence (if not given: the base rate times `min_lift`), are pruned by the mining itself;
    then those that `pages` pages with that confidence don't prove: by the Chernoff bound, pages that are unwanted at the
    base rate must give such a rule with a chance of at most `max_chance` over all combinations tested. `key` is the
    combination's rarest token. An empty table gives no rules.
    """
    label = F.when(F.col("unwanted"), F.array(F.lit(UNWANTED))).otherwise(F.array().cast("array<string>"))
    baskets = labelled.select(F.concat("tokens", label).alias("items"))
    total, bad = labelled.agg(F.count("*"), F.count_if("unwanted")).first()
    base = bad / total if total else 0.0
    least = min(1.0, base * min_lift) if min_confidence is None else min_confidence
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=least).fit(baskets)
    tested = max(1, model.freqItemsets.where(~F.array_contains("items", UNWANTED)).count())
    rules = model.associationRules.where((F.element_at("consequent", 1) == UNWANTED) & (F.col("lift") > 1))
    rules = rules.withColumn("pages", F.round(F.col("support") * total / F.col("confidence")).cast("bigint"))
    rules = rules.where(F.col("pages") * divergence(F.col("confidence"), base) >= math.log(tested / max_chance))
    rules = cut(rules.select(F.array_sort("antecedent").alias("tokens"), "confidence", "lift", "pages"))
    single = model.freqItemsets.where(F.size("items") == 1).select(F.element_at("items", 1).alias("key"), "freq")
    each = rules.select("*", F.explode("tokens").alias("key")).join(single, "key")
    return cut(each.groupBy("tokens", "confidence", "lift", "pages").agg(F.min_by("key", F.struct("freq", "key")).alias("key")))


def divergence(share: Column, base: float) -> Column:
    """Of a share from a base rate, in nats; 0 where the base rate leaves nothing to tell."""
    if not 0 < base < 1:
        return F.lit(0.0)
    rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    return F.when(share > 0, share * F.log(share / base)).otherwise(0.0) + rest


def judge(
    pages: DataFrame,
    labels: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: tuple[tuple[str, str], ...] = RULES,
    min_support: float = MIN_SUPPORT,
    min_confidence: float | None = None,
    min_lift: float = MIN_LIFT,
    max_chance: float = MAX_CHANCE,
) -> DataFrame:
    """page_id, host, path, rule, verdict, and confidence of the strongest mined rule that fits, if any.

    `labels` (doc_id, quality, toxic) marks pages by id; a page of quality 0 or toxic is unwanted. The verdict is that
    of the fixed rule, else block if a mined rule fits, else allow. Mined rules are found through an inverted index on
    their rarest token; the other tokens are compared within the row. NULL or odd urls have empty host and path and are
    judged like any other; repeated rows each get a verdict; without labels nothing is mined.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"))
    rows = rows.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    tokens = url_tokens(F.col("url"), F.col("host"), F.col("path"))
    rows = cut(rows.select("page_id", "host", "path", tokens.alias("tokens"), F.monotonically_increasing_id().alias("row")))
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("unwanted"))
    mined = mine_rules(rows.join(marks, "page_id").select("tokens", "unwanted"), min_support, min_confidence, min_lift, max_chance)
    index = mined.groupBy("key").agg(F.collect_list(F.struct("tokens", "confidence")).alias("postings"))
    posted = rows.select("row", "tokens", F.explode("tokens").alias("key"))
    met = attach_small(posted, index, ["key"], "inner").select("row", "tokens", F.explode("postings").alias("p"))
    hits = met.where(F.size(F.array_except("p.tokens", "tokens")) == 0).groupBy("row").agg(F.max("p.confidence").alias("confidence"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    out = rows.join(hits, "row", "left")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "confidence")
