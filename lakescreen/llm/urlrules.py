"""URL filters: listed rules first, then association rules mined by Spark's FP-growth from the pages that they judge.

A listed rule gives a page its label. FP-growth runs over the labelled pages' baskets: all their supported URL tokens, and
the label. Rules with a label on the right are pruned by support and confidence, and by rules that say the same with fewer
tokens. As FP-growth lists every frequent set, and a long URL has 2 ** n of them, corpora with baskets of more than
``BASKET`` supported tokens are mined level by level instead, which meets the same rules without listing the sets that
pruning takes away. A page without a listed rule meets the mined ones in an inverted index: each rule is filed under its
rarest token, the page's tokens look it up, and a rule fires if the page has all its tokens. The surest rule decides;
without one, allow.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread, staged


class Rule(NamedTuple):
    name: str
    verdict: str


#: The listed rules: host, slash, beginning of the path.
RULES = (
    Rule("com/", "allow"),
    Rule("example.com/en/", "block"),
    Rule("www.example.com/en/", "allow"),
    Rule("net/es/", "block"),
    Rule("net/fr/", "block"),
)
#: Shares of the labelled pages and of a rule's pages.
SUPPORT, CONFIDENCE = 0.005, 0.9
#: Mined rules up to this number are sent to all executors; more are joined.
BROADCAST_RULES = 10_000
#: Supported tokens of a page, at most, for which FP-growth is asked.
BASKET = 14


def parts(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a URL; both empty without ``://``."""
    after = F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)


def listed(rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits (host, path), as (rule, listed_verdict), or null."""
    found = F.lit(None)
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        own, slash, path = r.name.partition("/")
        fits = ((F.col("host") == own) | F.col("host").endswith(f".{own}")) & F.col("path").startswith(slash + path)
        found = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def tokens() -> Column:
    """Distinct tokens of host and path: labels and their hyphened words, the top label, path parts, an ending; digits as 0."""
    labels = F.filter(F.split("host", r"\."), lambda x: x != "")
    words = F.filter(F.split(F.regexp_replace("host", r"[0-9]+", "0"), r"[.-]"), lambda x: x != "")
    steps = F.filter(F.split(F.regexp_replace(F.lower("path"), r"[0-9]+", "0"), "/"), lambda x: x != "")
    of = F.concat(
        F.transform(words, lambda x: F.concat(F.lit("h:"), x)),
        F.transform(F.slice(F.reverse(labels), 1, 1), lambda x: F.concat(F.lit("t:"), x)),
        F.transform(F.slice(labels, 1, 1), lambda x: F.concat(F.lit("f:"), F.regexp_replace(x, r"[0-9]+", "0"))),
        F.transform(steps, lambda x: F.concat(F.lit("p:"), x)),
    )
    return F.array_sort(F.array_distinct(of))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, basket: int = BASKET) -> DataFrame:
    """(left, verdict, confidence, n) of the rules mined from rows (row, tokens, verdict), each as short as it can be.

    n: rows with all tokens and the verdict, a share ``support`` of all at least. A rule is left out if one of its parts
    says the same at least as surely. Both ways of mining give the same rows.
    """
    total = labelled.count()
    least = max(2, int(support * total))
    each = labelled.select("row", "verdict", F.explode("tokens").alias("token"))
    frequent = each.groupBy("token").agg(F.countDistinct("row").alias("n")).where(F.col("n") >= least).select("token")
    held = each.join(frequent, "token").groupBy("row", "verdict").agg(F.array_sort(F.collect_set("token")).alias("held"))
    baskets = staged(held.groupBy("held", "verdict").agg(F.count("*").alias("w")), "baskets")
    most = baskets.agg(F.max(F.size("held"))).first()[0] or 0
    if most <= basket:
        return by_fp_growth(baskets, least, confidence)
    return by_levels(baskets, labelled.groupBy("verdict").agg((F.lit(total) - F.count("*")).alias("fewest"), F.lit(0.0).alias("best")), least, confidence)


def by_fp_growth(baskets: DataFrame, least: int, confidence: float) -> DataFrame:
    """The rules of ``mine`` from (held, verdict, w), by FP-growth."""
    items = baskets.select(F.concat("held", F.array(F.concat(F.lit("="), F.col("verdict")))).alias("items"), F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))))
    n = baskets.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / max(1, n)), minConfidence=confidence).fit(items.select("items"))
    rules = model.associationRules.where(F.element_at("consequent", 1).startswith("=")).select(
        F.array_sort("antecedent").alias("left"),
        F.substring(F.element_at("consequent", 1), 2, 9).alias("verdict"),
        F.round("confidence", 9).alias("confidence"),
        F.round(F.col("support") * n).cast("long").alias("n"),
    )
    return shortest(staged(rules, "mined"))


def filed(rules: DataFrame) -> DataFrame:
    """``rules`` (left, verdict, confidence, n) with the token that each is filed under: the rarest of its left."""
    rarity = rules.select(F.explode("left").alias("token")).groupBy("token").agg(F.count("*").alias("uses"))
    under = rules.withColumn("token", F.explode("left")).join(rarity, "token").groupBy("left", "verdict", "confidence", "n")
    return under.agg(F.min(F.struct("uses", "token"))["token"].alias("token"))


def shortest(rules: DataFrame) -> DataFrame:
    """``rules`` without those of which a part has the same verdict at least as surely."""
    parts = filed(rules).select("token", "verdict", F.col("left").alias("part"), F.col("confidence").alias("c"))
    met = rules.withColumn("token", F.explode("left")).join(parts, ["token", "verdict"])
    within = (F.size("part") < F.size("left")) & (F.size(F.array_except("part", "left")) == 0) & (F.col("c") >= F.col("confidence"))
    return rules.join(met.where(within).select("left", "verdict").distinct(), ["left", "verdict"], "left_anti")


def by_levels(baskets: DataFrame, others: DataFrame, least: int, confidence: float) -> DataFrame:
    """The rules of ``mine`` from (held, verdict, w), and (verdict, fewest, best) to begin with.

    Sets of tokens grow one by one, each counted over equal baskets at once. A set goes on for a verdict only while each of
    its tokens takes rows of other verdicts away and some are left: else every larger set has a part that is at least as
    sure. So all supported tokens and all lengths are met, and few sets are counted.
    """
    hits = baskets.select(F.explode(F.transform("held", lambda x: F.array(x))).alias("left"), "held", "verdict", "w")
    sets = hits.select("left", "verdict").distinct().join(others, "verdict")
    size, found = 1, []
    while True:
        counts = hits.groupBy("left", "verdict").agg(F.sum("w").alias("n"))
        of = counts.groupBy("left").agg(F.sum("n").alias("of"))
        sure = F.col("n") / F.col("of")
        told = staged(
            sets.join(counts, ["left", "verdict"]).join(of, "left").where(F.col("n") >= least)
            .select("left", "verdict", "n", (F.col("of") - F.col("n")).alias("others"), "fewest", "best", sure.alias("sure")),
            "level",
        )
        found.append(told.where((F.col("sure") >= confidence) & (F.col("sure") > F.col("best"))))
        grows = told.where((F.col("others") < F.col("fewest")) & (F.col("others") > 0))
        if grows.isEmpty():
            break
        within = staged(hits.join(grows.select("left").distinct(), "left", "left_semi").withColumnRenamed("left", "part"), "within")
        size += 1
        heads = grows.select("verdict", "left", F.slice("left", 1, size - 2).alias("head"), F.element_at("left", -1).alias("last"))
        pairs = heads.join(heads.select("verdict", "head", F.col("last").alias("next")), ["verdict", "head"]).where(F.col("last") < F.col("next"))
        larger = pairs.select("verdict", F.concat("left", F.array("next")).alias("left"), F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("k"))
        parts = larger.select("verdict", "left", F.expr("filter(left, (x, i) -> i <> k)").alias("part"))
        known = grows.select("verdict", F.col("left").alias("part"), "others", F.greatest("best", "sure").alias("sure"))
        sets = staged(
            parts.join(known, ["verdict", "part"]).groupBy("left", "verdict")
            .agg(F.count("*").alias("parts"), F.min("others").alias("fewest"), F.max("sure").alias("best"))
            .where(F.col("parts") == size).drop("parts"),
            "sets",
        )
        if sets.isEmpty():
            break
        wanted = sets.select(F.slice("left", 1, size - 1).alias("part"), F.element_at("left", -1).alias("next")).distinct()
        hits = within.join(wanted, "part").where(F.expr("array_contains(held, next)")).select(
            F.concat("part", F.array("next")).alias("left"), "held", "verdict", "w"
        )
    return reduce(DataFrame.unionByName, found).select("left", "verdict", F.round("sure", 9).alias("confidence"), "n")


def fire(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, mined_rule, mined_verdict): the surest rule that each of ``pages`` (key, tokens) fires, by an inverted index."""
    by_token = filed(rules)
    index = by_token if by_token.count() > BROADCAST_RULES else F.broadcast(by_token)
    looked = pages.select("key", "tokens", F.explode("tokens").alias("token"))
    met = looked.join(index, "token").where(F.size(F.array_except("left", "tokens")) == 0)
    surest = F.max(F.struct("confidence", "n", (-F.size("left")).alias("short"), "verdict", "left"))
    return met.groupBy("key").agg(surest.alias("s")).select(
        "key", F.array_join("s.left", " ").alias("mined_rule"), F.col("s.verdict").alias("mined_verdict")
    )


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_rule) of every row of ``pages``.

    rule: the longest listed rule that fits; verdict: its own, else that of the surest mined rule, else allow. A null URL,
    or one without ``://``, has an empty host and path, no rule, and is allowed. Rows are judged one by one, so repeated
    ones alike; of rules tied in all that counts the one of the larger verdict and tokens, as strings, decides. Very long
    URLs keep all their tokens. An empty table gives no rows. Columns other than page_id and url are not looked at. Without
    labelled pages nothing is mined.
    """
    host, path = parts()
    split = spread(pages.select("page_id", "url")).select("page_id", host.alias("host"), path.alias("path"))
    known = staged(split.withColumn("listed", listed(rules)).withColumn("tokens", tokens()).withColumn("row", F.monotonically_increasing_id()), "urls")
    labelled = known.where("listed is not null").select("row", "tokens", F.col("listed.verdict").alias("verdict"))
    if labelled.isEmpty():
        fired = known.limit(0).select(F.xxhash64("tokens").alias("key"), F.lit("").alias("mined_rule"), F.lit("").alias("mined_verdict"))
    else:
        mined = staged(mine(labelled, support, confidence), "rules")
        # Pages of equal tokens fire alike: one lookup for each set of tokens.
        open_ = known.where("listed is null and size(tokens) > 0").select(F.array_join("tokens", " ").alias("key"), "tokens").dropDuplicates(["key"])
        # Written first, so that a set of tokens that very many pages have can be split in the join.
        fired = staged(fire(open_, mined), "fired")
    judged = known.join(
        fired, F.col("listed").isNull() & (F.array_join("tokens", " ") == F.col("key")), "left"
    )
    return judged.select(
        "page_id", "host", "path", F.col("listed.rule").alias("rule"),
        F.coalesce("listed.verdict", "mined_verdict", F.lit("allow")).alias("verdict"), "mined_rule",
    )


def op8_digest(pages: DataFrame) -> DataFrame:
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")
