"""The public face: scanning tables of documents and reading what comes out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import language, rx
from .operators import detect, langmodel, names, post, risk


@dataclass(frozen=True)
class Options:
    language: str = "auto"
    profile: str = "normal"
    categories: list[str] | None = None
    ignored: DataFrame | None = None
    whitelist: DataFrame | None = None
    blacklist: list[str] | DataFrame = field(default_factory=list)
    patterns: list[dict] = field(default_factory=list)
    clients: list[str] | DataFrame = field(default_factory=list)
    names: bool = False
    name_lists: names.Lists | None = None
    name_provider: object | None = None
    only: tuple[str, ...] | None = None
    language_model: DataFrame | None = None


def is_scan(df: DataFrame) -> bool:
    """Whether the plan only reads, picks and computes columns of files."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        plan = todo.pop()
        if plan.nodeName() not in ("Project", "Filter") and not plan.nodeName().startswith(("LogicalRelation", "Relation")):
            return False
        todo += [plan.children().apply(k) for k in range(plan.children().size())]
    return True


#: Rows that a task gets of a table whose rows are small and cost much.
ROWS_A_TASK = 50_000


def dealt(df: DataFrame, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """Deal rows of a few bytes out to tasks by number, as many to each, however few row groups and files hold them.

    Columns that are made of them are best made afterwards, so that they are not shuffled.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows_a_task)))


def spread(df: DataFrame) -> DataFrame:
    """Deal a scan with fewer partitions than cores out to all; larger inputs, and what is no scan, stay as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    if is_scan(df) and df._jdf.queryExecution().toRdd().getNumPartitions() < min(n, 64):
        return df.repartition(n)
    return df


def prepare(docs: DataFrame, options: Options) -> DataFrame:
    """(doc_id, text, language, technical): what detectors read. A learnt model decides for ``auto`` where there is one."""
    wish = F.col("lang") if options.language == "column" else F.lit(options.language)
    if options.language == "auto" and options.language_model is not None:
        docs = docs.join(langmodel.detect(docs, options.language_model).select("doc_id", F.col("language").alias("_told")), "doc_id", "left")
        wish = F.coalesce("_told", F.lit("en"))
    return docs.select(
        "doc_id", "text", language.resolve(wish, F.col("text")).alias("language"),
        (language.profile(F.lit(options.profile), F.col("text")) == "technical").alias("technical"),
    )


def scan(docs: DataFrame, options: Options | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, suppressed) of ``docs`` (doc_id, text).

    In this order: detectors, own patterns, names; ignore list; categories; whitelist; and last the blacklist, which
    nothing clears.
    """
    options = options or Options()
    ready = prepare(docs, options)
    rows = detect.scan(ready, options.categories, options.only)
    if options.patterns:
        rows = rows.unionByName(post.custom(ready, options.patterns), allowMissingColumns=True)
    if post.named(options.clients):
        rows = rows.unionByName(post.clients(ready, options.clients), allowMissingColumns=True)
    if options.names:
        found = names.names(ready, options.name_lists, options.name_provider)
        rows = rows.unionByName(
            found.select(
                "doc_id", F.lit(95).alias("det_ord"), F.lit(0).alias("sub_ord"), F.col("start").alias("match_ord"), F.lit("names").alias("detector"), F.lit("rule").alias("engine"),
                F.when(F.col("start") < 0, "⚠ Detektor-feil").otherwise("navn (person)").alias("category"), "text", F.col("text").alias("raw_text"), F.lit("").alias("context"), "start", (F.col("start") + F.length("text")).alias("end"),
                F.lit("gul").alias("severity"), F.lit(None).cast("string").alias("confidence"), "reason",
            )
        )
    kept = rows.where("reason is null")
    if options.ignored is not None:
        kept = post.ignore(kept, options.ignored)
    kept = post.in_categories(kept, options.categories)
    kept = post.mark_whitelisted(kept, options.whitelist) if options.whitelist is not None else kept.withColumn("whitelisted", F.lit(False))
    if options.names and options.name_provider is None:
        kept = kept.unionByName(_no_provider(ready).withColumn("whitelisted", F.lit(False)), allowMissingColumns=True)
    if post.named(options.blacklist):
        kept = kept.unionByName(post.blacklist(ready, options.blacklist).withColumn("whitelisted", F.lit(False)))
    return kept.drop("reason"), post.in_categories(rows.where("reason is not null"), options.categories)


def _no_provider(docs: DataFrame) -> DataFrame:
    """A warning for each document that capitalised words stood in for a name model; it makes a scan partial."""
    return docs.select(
        "doc_id", F.lit(98).alias("det_ord"), F.lit(0).alias("sub_ord"), F.lit(0).alias("match_ord"), F.lit("names").alias("detector"), F.lit("rule").alias("engine"),
        F.lit("⚠ NER ikke tilgjengelig").alias("category"), F.lit("no name model").alias("text"), F.lit("").alias("raw_text"), F.lit("").alias("context"), F.lit("gul").alias("severity"),
    )


def results(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """One row a document with its risk."""
    return risk.assess(docs, findings)


def register(spark) -> None:
    """SQL function ``match_text(text)``: rows (detector, text) of what the plain patterns match in one text.

    A raw matcher for looking at single texts: no checks, no context rules, no categories. ``scan`` applies all of them.
    """
    from pyspark.sql.functions import udtf

    specs = [(d.name, rx.java(d.pattern, d.flags)) for d in detect.registry(spark) if d.pattern and not d.near]

    @udtf(returnType="detector string, text string")
    class MatchText:
        """Matches of the plain patterns."""

        def __init__(self):
            import re

            self.compiled = [(n, re.compile(p.replace("(?dU", "(?").replace("(?)", ""))) for n, p in specs]

        def eval(self, text: str):
            for name, pattern in self.compiled:
                for m in pattern.finditer(text or ""):
                    yield name, m[0]

    spark.udtf.register("match_text", MatchText)
