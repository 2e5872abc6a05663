"""What happens to findings after detection: ignore, category and whitelist filters, custom patterns, blacklist."""

from __future__ import annotations

import functools
import re
import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rx
from ..plans import dims
from . import terms

#: Own patterns that one reading of the texts tries; more are tried by further readings.
AT_A_TIME = 1000
#: Matches that a custom pattern gives, and categories that a whitelist never clears.
MOST_MATCHES = 200
NEVER_WHITELISTED = r"prosjektsum|fødselsdato|fodselsdato|budsjettall|budsjett"


def ignore(findings: DataFrame, ignored: DataFrame) -> DataFrame:
    """Drop e-mails of ignored addresses or domains and ignored names. ignored: (kind, value), kinds email, domain, name.

    Equal values go by hashed anti joins. A sub-domain matches through each of its parents, so no pair is compared.
    """
    value = F.lower(F.trim("text"))
    domain = F.element_at(F.split(value, "@"), -1)
    labels = F.split(domain, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    keys = F.when(
        F.col("category") == "e-post", F.concat(F.array(F.concat(F.lit("email:"), value)), F.transform(parents, lambda p: F.concat(F.lit("domain:"), p)))
    ).when(F.col("category") == "navn (person)", F.array(F.concat(F.lit("name:"), value)))
    names = ignored.where("kind = 'name'").select(F.explode(F.split(F.trim("value"), r"\s+")).alias("value")).where("length(value) > 2")
    listed = ignored.select("kind", "value").unionByName(names.select(F.lit("name").alias("kind"), "value"))
    listed = listed.select(F.concat_ws(":", "kind", F.lower(F.trim("value"))).alias("_key")).distinct()
    tagged = findings.withColumn("_id", F.struct("doc_id", "det_ord", "sub_ord", "match_ord"))
    gone = tagged.select("_id", F.explode(keys).alias("_key")).join(listed, "_key", "left_semi").select("_id").distinct()
    return tagged.join(gone, "_id", "left_anti").drop("_id")


def whitelistable(category: str | Column = "category") -> Column:
    col = F.col(category) if isinstance(category, str) else category
    return ~F.lower(col).rlike(NEVER_WHITELISTED)


def mark_whitelisted(findings: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Findings whose text is in ``whitelist`` (value) turn green, unless their category never does."""
    listed = whitelist.select(F.lower("value").alias("_value")).distinct().withColumn("_listed", F.lit(True))
    found = findings.join(listed, F.lower("text") == F.col("_value"), "left")
    hit = F.coalesce(F.col("_listed"), F.lit(False)) & whitelistable()
    return found.withColumn("severity", F.when(hit, "grønn").otherwise(F.col("severity"))).withColumn("whitelisted", hit).drop("_value", "_listed")


def drop_whitelisted(findings: DataFrame, whitelist: DataFrame) -> DataFrame:
    return mark_whitelisted(findings, whitelist).where("not whitelisted").drop("whitelisted")


def in_categories(findings: DataFrame, categories: list[str] | None) -> DataFrame:
    return findings.where(dims.category_filter(dims.selected_keys(categories)))


def parse_patterns(content: str) -> list[dict]:
    """Custom patterns from TOML ``[[patterns]]`` blocks; a ValueError names what is wrong with which block."""
    try:
        blocks = tomllib.loads(content).get("patterns", [])
    except tomllib.TOMLDecodeError as error:
        raise ValueError(f"TOML: {error}") from error
    if not isinstance(blocks, list):
        raise ValueError("patterns: a list of [[patterns]] blocks is needed")
    out = []
    for n, block in enumerate(blocks, 1):
        own = {"name": "", "regex": "", "severity": "gul", "ignore_case": True} | (block if isinstance(block, dict) else {})
        own = {k: own[k] for k in ("name", "regex", "severity", "ignore_case")} | {"name": str(own["name"]).strip(), "severity": str(own["severity"]).strip().lower()}
        wrong = [k for k in ("name", "regex") if not own[k]] + [k for k, ok in (("severity", own["severity"] in dims.LEVELS), ("ignore_case", isinstance(own["ignore_case"], bool))) if not ok]
        if wrong:
            raise ValueError(f"pattern {n}: {', '.join(wrong)}")
        try:
            re.compile(own["regex"])
        except re.error as error:
            raise ValueError(f"pattern {n} ({own['name']}): {error}") from error
        out.append(own)
    return out


def _found(docs: DataFrame, patterns: list[str], most: int, first: int = 0) -> DataFrame:
    """(doc_id, n, ord, k, start, end, m, g, pre, post): ``most`` hits at most of each pattern k in texts of n characters."""
    of = lambda p: f"slice({rx.hits_sql('doc.text', p)}, 1, {most})"
    each = ", ".join(f"transform({of(p)}, h -> named_struct('k', {k}, 'h', h))" for k, p in enumerate(patterns, first))
    none = f"cast(array() as array<struct<k:int,h:{rx.HIT[6:-1]}>>)"
    all_ = f"transform(array(named_struct('text', text)), doc -> flatten(array({', '.join([none, each] if each else [none])})))[0]"
    rows = docs.where("text is not null").select("doc_id", F.length("text").alias("n"), F.posexplode(F.expr(all_)).alias("ord", "r"))
    return rows.select("doc_id", "n", (F.col("ord") + first * most).alias("ord"), "r.k", "r.h.*")


def custom(docs: DataFrame, patterns: list[dict]) -> DataFrame:
    """Findings of own patterns, ``MOST_MATCHES`` matches of each at most, each value once, with the pattern's severity.

    Any pattern may be told, so each is tried on each text, ``AT_A_TIME`` of them in one reading of the texts.
    """
    java = [rx.java(p["regex"], "i" if p["ignore_case"] else "") for p in patterns]
    rows = [_found(docs, java[at : at + AT_A_TIME], MOST_MATCHES, at) for at in range(0, len(java), AT_A_TIME)] or [_found(docs, [], MOST_MATCHES)]
    own = docs.sparkSession.createDataFrame([(k, f"Egendefinert: {p['name']}", p["severity"]) for k, p in enumerate(patterns)], "k int, category string, severity string")
    told = functools.reduce(DataFrame.unionByName, rows).where("m <> ''")
    first = told.groupBy("doc_id", "k", "m").agg(F.min(F.struct("ord", "n", "start", "end", "pre", "post")).alias("f"))
    return _told(first.select("doc_id", "k", "m", "f.*").join(own, "k"), 90, 60)


def blacklist(docs: DataFrame, listed: list[str] | DataFrame) -> DataFrame:
    """Findings of listed terms, as parts of words too and whatever their case; once for each place and value.

    ``listed``: terms, or a table (term) or (k, term) of them, of any number.
    """
    told = terms.find(docs, listed).select("*", F.lit("Blacklist").alias("category"), F.lit("rød").alias("severity"))
    first = told.groupBy("doc_id", F.lower("m"), "start").agg(F.min(F.struct("ord", "k", "m", "n", "category", "severity", "end", "pre", "post")).alias("f"))
    return _told(first.select("doc_id", "start", "f.*"), 99, 70)


def clients(docs: DataFrame, listed: list[str] | DataFrame) -> DataFrame:
    """Findings of listed client names as whole words, whatever their case, each place told; ``listed`` as for ``blacklist``."""
    told = terms.find(docs, listed, whole_words=True).select("*", F.lit("kundenavn").alias("category"), F.lit("gul").alias("severity"))
    return _told(told, 14, 50)


def named(listed: list[str] | DataFrame | None) -> bool:
    """Whether a list of terms names any: a table may."""
    return isinstance(listed, DataFrame) or bool(listed)


def _told(rows: DataFrame, det_ord: int, radius: int) -> DataFrame:
    return rows.select(
        "doc_id", F.lit(det_ord).alias("det_ord"), F.col("k").alias("sub_ord"), F.col("ord").alias("match_ord"),
        F.lit({90: "custom", 14: "client"}.get(det_ord, "blacklist")).alias("detector"), F.lit("rule").alias("engine"), "category", F.col("m").alias("text"),
        F.col("m").alias("raw_text"), rx.snippet(F.col("pre"), F.col("m"), F.col("post"), F.col("start"), F.col("end"), F.col("n"), F.lit(radius)).alias("context"),
        "start", "end", "severity", F.lit(None).cast("string").alias("confidence"), F.lit(None).cast("string").alias("reason"),
    )


def try_pattern(spark: SparkSession, text: str, regex: str, most: int = 20) -> DataFrame:
    """The first matches of a pattern in one text, with their places."""
    one = spark.createDataFrame([(text,)], "text string")
    return one.select(F.inline(F.slice(rx.offsets(F.col("text"), rx.java(regex, "i"), may_be_empty=True), 1, most))).select(F.col("m").alias("text"), "start", "end")
