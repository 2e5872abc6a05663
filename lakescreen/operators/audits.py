"""The log of redacted copies: entries that are added, checked again and replaced, the last ones of which are kept.

The log is a folder of Parquet files in buckets by entry. Putting entries there replaces those of the same id, so doing it
twice is doing it once: the buckets concerned are merged in a folder of their own first, and then written over whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared
from . import redact, risk

BUCKETS = 32
VERIFICATION = "struct<status:string,passed:boolean,checked_at:timestamp,risk_level:string,finding_count:bigint,removed:bigint,remaining:bigint,error:string>"
#: details: whether an entry may tell the values that were taken out; one that may not holds none.
ENTRY = f"id string, created_at timestamp, path string, details boolean, selected array<struct<category:string,text:string>>, verification {VERIFICATION}"
COLUMNS = ("id", "created_at", "path", "details", "selected", "verification")
#: Fixed value: what is said of a copy that is no longer there.
GONE = "the file is no longer there"


def squeezed(text: str | Column) -> Column:
    """A text for comparing: no white space, lower case."""
    return F.lower(F.regexp_replace(text, r"(?U)\s+", ""))


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of the log with their bucket; none where there is no log."""
    schema = f"{ENTRY}, bucket int"
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def last(spark: SparkSession, folder: str, n: int = redact.AUDITS) -> DataFrame:
    """The last n entries of the log, by time and id."""
    return entries(spark, folder).drop("bucket").orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def put(spark: SparkSession, folder: str, rows: DataFrame, n: int = redact.AUDITS) -> None:
    """Add ``ENTRY`` rows, in place of those of the same ids; the buckets that are written keep none older than the last n.

    Of rows that share an id the one checked last counts.
    """
    newest = F.max_by(F.struct("*"), F.struct(F.col("verification.checked_at"), F.xxhash64("*")))
    new = rows.select(*COLUMNS).groupBy("id").agg(newest.alias("r")).select("r.*")
    new = new.withColumn("selected", F.when(F.col("details"), F.col("selected")).otherwise(F.array().cast("array<struct<category:string,text:string>>")))
    new = new.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int"))
    merged_at = shared.folder(spark, "audits")
    new.write.parquet(f"{merged_at}/new")
    new = spark.read.parquet(f"{merged_at}/new")
    touched = entries(spark, folder).join(new.select("bucket").distinct(), "bucket", "left_semi")
    touched.join(new.select("id"), "id", "left_anti").unionByName(new).write.parquet(f"{merged_at}/all")
    merged = spark.read.parquet(f"{merged_at}/all")
    untouched = entries(spark, folder).join(new.select("bucket").distinct(), "bucket", "left_anti")
    oldest = merged.unionByName(untouched).select("created_at", "id").orderBy(F.desc("created_at"), F.desc("id")).limit(n).agg(F.min(F.struct("created_at", "id")).alias("m")).first().m
    kept = merged if oldest is None else merged.where(F.struct("created_at", "id") >= F.struct(F.lit(oldest.created_at), F.lit(oldest.id)))
    kept.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)


def verified(rows: DataFrame, copies: DataFrame, scan: Callable[[DataFrame], DataFrame], now: Column) -> DataFrame:
    """``ENTRY`` rows with what their copies (path, text, error) are found to be; ``scan`` gives findings of (doc_id, text).

    A copy passes if its scan is green and no value that was taken out is in it, whatever its case and white space. One that
    is not among ``copies`` is gone; one that could not be read says why.
    """
    there = rows.join(copies.select("path", "text", "error", F.lit(True).alias("there")), "path", "left")
    read = there.where("there and error is null")
    graded = risk.assess(read.select(F.col("id").alias("doc_id")), scan(read.select(F.col("id").alias("doc_id"), "text")))
    values = F.array_distinct(F.filter(F.transform("selected", lambda s: squeezed(s["text"])), lambda v: v != ""))
    left = F.size(F.filter(values, lambda v: F.contains(squeezed("text"), v)))
    told = there.join(graded.select(F.col("doc_id").alias("id"), "risk_level", "finding_count"), "id", "left")
    failed = F.when(F.col("there").isNull(), F.lit(GONE)).otherwise(F.col("error"))
    passed = (F.col("risk_level") == "grønn") & (left == 0)
    said = F.when(
        failed.isNotNull(),
        F.struct(F.lit("error").alias("status"), F.lit(False).alias("passed"), now.alias("checked_at"), *(F.lit(None).alias(c) for c in ("risk_level", "finding_count", "removed", "remaining")), failed.alias("error")).cast(VERIFICATION),
    ).otherwise(
        F.struct(
            F.when(passed, "passed").otherwise("needs_review").alias("status"), passed.alias("passed"), now.alias("checked_at"), "risk_level", "finding_count",
            (F.size(values) - left).alias("removed"), left.alias("remaining"), F.lit(None).alias("error"),
        ).cast(VERIFICATION)
    )
    return told.withColumn("verification", said).select(*COLUMNS)


def refresh(spark: SparkSession, folder: str, ids: DataFrame, copies: DataFrame, scan: Callable[[DataFrame], DataFrame], now: Column | None = None) -> None:
    """Check the copies of the entries ``ids`` (id) again, and replace the entries. Ids that the log does not have are passed over."""
    asked = entries(spark, folder).drop("bucket").join(ids.select("id").distinct(), "id", "left_semi")
    put(spark, folder, verified(asked, copies, scan, F.current_timestamp() if now is None else now))
