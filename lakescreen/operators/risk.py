"""Risk of documents from their findings, and the merging of rule findings with those of a language model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import dims
from .post import whitelistable


def graded(findings: DataFrame) -> DataFrame:
    """Severity as the risk rules see it: custom patterns and whitelisted findings keep theirs, others go by category."""
    own = F.lower("category").startswith("egendefinert: ") | (F.col("severity") == "grønn")
    return findings.withColumn("severity", F.when(own, F.col("severity")).otherwise(dims.severity()))


def assess(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """One row a document: risk_level, risk_ord, risk_summary, finding_count and alert_count; documents without findings are green."""
    levels = graded(findings).groupBy("doc_id").agg(
        F.max(dims.level_ord("severity")).alias("risk_ord"),
        F.count("*").alias("finding_count"),
        F.count_if(~F.col("category").startswith("⚠")).alias("shown_count"),
        F.count_if(F.col("severity").isin("rød", "svart")).alias("alert_count"),
    )
    joined = docs.join(levels, "doc_id", "left")
    ord_ = F.coalesce("risk_ord", F.lit(0))
    return joined.select(
        *docs.columns,
        ord_.cast("int").alias("risk_ord"),
        dims.level_name(ord_).alias("risk_level"),
        dims.summary(dims.level_name(ord_)).alias("risk_summary"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("finding_count", "shown_count", "alert_count")),
    )


def scan_status(error: str = "error", warning: str = "warning_code", degraded: str = "degraded") -> Column:
    return F.when(F.col(error).isNotNull(), "failed").when(F.col(warning).isNotNull() | F.col(degraded), "partial").otherwise("success")


def exit_code(status: str = "scan_status", level: str = "risk_level") -> Column:
    return F.when(F.col(status) == "failed", 4).otherwise(dims.level_ord(level)).cast("int")


def badges(findings: DataFrame) -> DataFrame:
    """Counts of each severity by document."""
    return findings.groupBy("doc_id").pivot("severity", list(dims.LEVELS)).count().na.fill(0)


def merge(rule: DataFrame, ai: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Rule findings and those of a model that say something new, by severity, then order.

    A model's finding goes if its document has the text already, by rule or earlier by the model.
    """
    listed = whitelist.select(F.lower("value").alias("_value")).distinct().withColumn("_listed", F.lit(True))
    known = rule.select("doc_id", F.lower("text").alias("_text")).distinct()
    first = Window.partitionBy("doc_id", "_text").orderBy("ord")
    new = (
        ai.where("text <> ''")
        .withColumn("_text", F.lower("text"))
        .join(known, ["doc_id", "_text"], "left_anti")
        .withColumn("_n", F.row_number().over(first))
        .where("_n = 1")
        .join(listed, F.col("_text") == F.col("_value"), "left")
    )
    plain = F.trim(F.replace("category", F.lit("🤖"), F.lit("")))
    green = whitelistable() & (F.coalesce(F.col("severity") == "grønn", F.lit(False)) | F.coalesce("_listed", F.lit(False)))
    told = new.select(
        "doc_id", "ord", "category", "text", F.coalesce("context", F.lit("")).alias("context"),
        F.when(green, "grønn").otherwise(dims.severity(plain)).alias("severity"), F.lit("AI").alias("engine"),
        F.coalesce("confidence", F.lit("")).alias("confidence"), green.alias("whitelisted"),
    )
    ruled = rule.select(
        "doc_id", "ord", "category", "text", "context", "severity", F.lit("Regelbasert").alias("engine"), F.lit("deterministisk").alias("confidence"),
        ((F.col("severity") == "grønn") & whitelistable()).alias("whitelisted"),
    )
    both = ruled.withColumn("_ai", F.lit(0)).unionByName(told.withColumn("_ai", F.lit(1)))
    place = Window.partitionBy("doc_id").orderBy(dims.level_ord("severity").desc(), "_ai", "ord")
    return both.withColumn("rank", F.row_number().over(place)).drop("_ai")


def combined(results: DataFrame, merged: DataFrame) -> DataFrame:
    """Overall level of (doc_id, risk_level, policy_level) with merged findings."""
    most = merged.where("severity <> 'grønn'").groupBy("doc_id").agg(F.max(dims.level_ord("severity")).alias("_most"))
    counts = merged.groupBy("doc_id").agg(F.count("*").alias("finding_count"))
    joined = results.join(most, "doc_id", "left").join(counts, "doc_id", "left")
    policy = F.when(F.col("policy_level").isin(*dims.LEVELS), dims.level_ord("policy_level")).otherwise(0)
    base = F.when(F.col("risk_level").isin(*dims.LEVELS), dims.level_ord("risk_level")).otherwise(0)
    level = dims.level_name(F.greatest(base, policy, F.coalesce("_most", F.lit(0))))
    return joined.select("doc_id", level.alias("risk_level"), dims.summary(level).alias("risk_summary"), F.coalesce("finding_count", F.lit(0)).alias("finding_count"))


def policy_warning(labels: Column, keywords: tuple[str, ...]) -> Column:
    """Whether a label's text holds one of the keywords."""
    low = F.transform(labels, lambda x: F.lower(x))
    return F.coalesce(F.exists(low, lambda x: x.rlike("|".join(keywords))), F.lit(False))


def suggested_label(level: str = "risk_level") -> Column:
    return F.when(F.lower(level).isin("svart", "rød"), "Highly Confidential").when(F.lower(level) == "gul", "Confidential").otherwise("Internal")


def label_metadata(label: str = "suggested_label", level: str = "risk_level", count: str = "finding_count", at: str = "scanned_at") -> Column:
    """What is written beside a suggested label: its name, level, number of findings, time, and who says so."""
    return F.struct(F.col(label).alias("label"), F.col(level).alias("risk_level"), F.col(count).alias("finding_count"), F.col(at).alias("scanned_at"), F.lit("lakescreen").alias("source"))


def rollup(results: DataFrame, *by: str) -> DataFrame:
    """Extension: documents and findings by level over rolled-up dimensions."""
    return results.rollup(*by).agg(
        F.count("*").alias("n_docs"), F.sum("finding_count").cast("long").alias("n_findings"), F.max("risk_ord").alias("max_risk_ord")
    )
