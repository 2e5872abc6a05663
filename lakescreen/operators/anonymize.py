"""Anonymisation: consistent labels by document, longest-first replacement in two phases, verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rx
from ..plans import dims

def clean(value: Column) -> Column:
    """White space collapsed, characters that XML forbids removed. Texts are taken to be composed (NFC)."""
    return rx.squeeze(F.regexp_replace(value, r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]", ""))


def replacements(findings: DataFrame) -> DataFrame:
    """(doc_id, ord, target, label) of each value to replace, in the order of its first finding (ord).

    Families of categories share one numbering; a value keeps the label of its first finding.
    """
    target = clean(F.when(F.coalesce("raw_text", F.lit("")) != "", F.col("raw_text")).otherwise(F.col("text")))
    cat = F.regexp_replace(F.lower("category"), "^[🤖 ]+", "")
    alpha, number = dims.by_prefix(cat, dims.ALPHA_LABELS, F.lit(None)), dims.by_prefix(cat, dims.NUMBER_LABELS, F.lit(None))
    fixed = dims.by_prefix(F.lower("category"), dims.PLACEHOLDERS, F.lit("<sensitiv-info>"))
    ai = F.col("category").startswith("🤖")
    rows = findings.withColumn("target", target).where("target <> ''").where(~F.col("target").contains("…") & ~F.col("category").startswith("⚠"))
    first = rows.groupBy("doc_id", "target").agg(F.min(F.struct("ord", "category")).alias("f")).select("doc_id", "target", "f.*")
    family = F.when(ai, F.lit(None)).otherwise(F.coalesce(alpha, number))
    placed = first.withColumn("family", family).withColumn("lettered", ~ai & alpha.isNotNull())
    nth = F.dense_rank().over(Window.partitionBy("doc_id", "family").orderBy("ord", "target"))
    letter = F.when(F.col("lettered") & (nth <= 26), F.char(F.lit(64) + nth)).otherwise(nth.cast("string"))
    label = F.when(ai, "[ANONYMISERT]").when(F.col("family").isNotNull(), F.concat(F.lit("<"), "family", F.lit(" "), letter, F.lit(">"))).otherwise(fixed)
    return placed.select("doc_id", "ord", "target", label.alias("label"))


#: Tokens write their number in private-use characters, between two others.
DIGITS, OPEN, CLOSE = "\ue001\ue002\ue003\ue004\ue005\ue006\ue007\ue008\ue009\ue00a", "\ue000", "\ue00b"


def token(k: Column) -> Column:
    """A stand-in that no text holds and no replacement can hit."""
    return F.concat(F.lit(OPEN), F.translate(k.cast("string"), "0123456789", DIGITS), F.lit(CLOSE))


def _put(text: Column, old: Column, new: Column) -> Column:
    """Replace a value; one of digits only where no digit is beside it."""
    bounded = F.regexp_replace(text, F.concat(F.lit(r"(?<!\d)"), old, F.lit(r"(?!\d)")), new)
    return F.when(old.rlike("^[0-9]+$"), bounded).otherwise(F.replace(text, old, new))


def anonymize(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, …) with column ``anonymized``. labels: of ``replacements``."""
    pairs = labels.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.length("target")).alias("n"), "ord", "target", "label"))).alias("pairs"))
    joined = docs.join(pairs, "doc_id", "left")
    numbered = F.transform("pairs", lambda p, k: F.struct(p["target"].alias("o"), token(k).alias("t"), p["label"].alias("l")))
    hidden = F.aggregate(numbered, F.col("text"), lambda text, p: _put(text, p["o"], p["t"]))
    shown = F.aggregate(numbered, hidden, lambda text, p: F.replace(text, p["t"], p["l"]))
    return joined.select(*docs.columns, F.when(F.col("pairs").isNull(), F.col("text")).otherwise(shown).alias("anonymized"))


def by_span(docs: DataFrame, findings: DataFrame, labels: DataFrame) -> DataFrame:
    """Extension: replace the places of findings instead of values, so differently written values go too."""
    clean_raw = clean(F.when(F.coalesce("raw_text", F.lit("")) != "", F.col("raw_text")).otherwise(F.col("text")))
    placed = findings.withColumn("target", clean_raw).join(labels.select("doc_id", "target", "label"), ["doc_id", "target"])
    spans = placed.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end", "label"))).alias("spans"))
    joined = docs.join(spans, "doc_id", "left")
    text = F.col("text")
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.when(s["start"] < a["at"], a).otherwise(
        F.struct(s["end"].alias("at"), F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), s["label"]).alias("out"))
    )
    done = F.aggregate("spans", begin, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.length(text))))
    return joined.select(*docs.columns, F.when(F.col("spans").isNull(), text).otherwise(done).alias("anonymized"))


def preview(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, target, label, n): how often each value stands in its text."""
    joined = labels.join(docs.select("doc_id", "text"), "doc_id")
    n = (F.length("text") - F.length(F.replace("text", F.col("target"), F.lit("")))) / F.length("target")
    return joined.select("doc_id", "ord", "target", "label", n.cast("long").alias("n"))


def verify(anonymized: DataFrame, chosen: DataFrame) -> DataFrame:
    """Of each chosen value (doc_id, target): removed, not_found or remaining, white space and case aside."""
    flat = lambda c: F.lower(F.regexp_replace(c, r"(?U)\s+", ""))
    joined = chosen.join(anonymized.select("doc_id", "text", "anonymized"), "doc_id")
    status = F.when(flat("anonymized").contains(flat("target")), "remaining").when(flat("text").contains(flat("target")), "removed").otherwise("not_found")
    return joined.select("doc_id", "target", status.alias("status"))
