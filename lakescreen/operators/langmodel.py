"""Language by a model of letter trigrams that is learnt from documents of known language.

A word, with a blank at each end, is cut into trigrams; the model says for each trigram how likely it is in each language,
smoothed. A text's language is the one in which its trigrams are likeliest together. To learn, words are counted before they
are cut, once: the counts are written. To tell, a text's trigrams meet the model where the text is read; most words are of one
text only, so there is no list of all words in between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import shared

#: What is added to each count, so that no trigram of one language is impossible in another.
SMOOTHING = 0.5
#: Characters that decide a text's language, characters below which it is English.
LOOKED_AT, LEAST = 3000, 80
LONG_ENOUGH = rf"(?sU)\A\s*+\S.{{{LEAST - 2},}}?\S"
DEFAULT = "en"
MOST_LANGUAGES = 200
#: Measured bytes of a model up to which it is sent to all tasks, and what a row of it takes besides its trigram.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 32


def words(text: str | Column) -> Column:
    """Runs of letters in lower case."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(col), F.lit(r"\p{L}+"), F.lit(0))


def trigrams(word: str) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(F.concat(F.lit(" "), F.col(word), F.lit(" ")), i, F.lit(3)))


def trigrams_of(text: Column) -> Column:
    """Trigrams of all words of a text, in their order, repeats included: a letter with its neighbours each."""
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"\P{L}+", " "), F.lit(" "))
    return F.regexp_extract_all(spaced, F.lit(r"(?=([\p{L} ]\p{L}[\p{L} ]))"), F.lit(1))


def train(docs: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """(gram, language, n, weight) of each trigram and language, from whole texts (text, lang).

    n: how often the language has the trigram, 0 included; weight: the logarithm of its smoothed share. Texts that are null
    or of no known language teach nothing.
    """
    known = docs.where("lang is not null and text is not null")
    by_word = known.select("lang", F.explode(words("text")).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    counts = by_word.select("lang", "n", F.explode(trigrams("word")).alias("gram")).groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    spark = docs.sparkSession
    at = shared.folder(spark, "trigrams")  # written, as texts are read again for each use of it otherwise
    counts.write.parquet(at)
    shared.remove_at_exit(spark, at)
    counts = spark.read.schema(counts.schema).parquet(at)
    # Languages are few: what is known of them, a row each, comes to the driver as constants.
    size = counts.select("gram").distinct().count()
    total = {r.lang: r.total for r in counts.groupBy("lang").agg(F.sum("n").alias("total")).collect()}
    if len(total) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    own = counts.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("own"))
    languages = [F.struct(F.lit(k).alias("language"), F.lit(float(t)).alias("total")) for k, t in sorted(total.items())] or [F.struct(F.lit(DEFAULT).alias("language"), F.lit(0.0).alias("total"))]
    each = own.select("gram", "own", F.inline(F.array(*languages)))
    n = F.coalesce(F.try_element_at("own", F.col("language")), F.lit(0))
    return each.select("gram", "language", n.cast("long").alias("n"), F.log((n + smoothing) / (F.col("total") + smoothing * size)).alias("weight"))


def detect(docs: DataFrame, model: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, language, margin) of each row of docs (doc_id, text), by its first ``LOOKED_AT`` characters.

    margin: by how much, for each trigram, the language is likelier than the next one. Null and short texts, and those
    without a trigram of the model, are ``DEFAULT`` without a margin. Of languages that are as likely the first by name wins.
    Rows of one doc_id are one document. A model of more than ``broadcast_bytes`` is joined by trigram.
    """
    held = model.groupBy("language").agg(F.sum(F.octet_length("gram") + ROW_BYTES).alias("bytes")).collect()
    languages = sorted(r.language for r in held) or [DEFAULT]
    weights = [F.sum(F.when(F.col("language") == k, F.col("weight"))).alias(f"w{i}") for i, k in enumerate(languages)]
    wide = model.groupBy(F.col("gram").alias("own")).agg(*weights).withColumn("h", F.xxhash64("own"))
    long_enough = docs.where(F.col("text").rlike(LONG_ENOUGH))
    grams = long_enough.select("doc_id", F.explode(trigrams_of(F.substr("text", F.lit(1), F.lit(LOOKED_AT)))).alias("gram"))
    if sum(r.bytes for r in held) <= broadcast_bytes:
        grams, wide = grams.withColumn("times", F.lit(1)), F.broadcast(wide)
    else:
        grams = grams.groupBy("doc_id", "gram").agg(F.count("*").alias("times"))
    # Joined by a number, which is faster than by a string; where two trigrams share it, only the right one counts.
    each = grams.withColumn("h", F.xxhash64("gram")).join(wide, "h")
    times = F.when(F.col("gram") == F.col("own"), F.col("times"))
    sums = [F.sum(times * F.col(f"w{i}")).alias(f"s{i}") for i in range(len(languages))]
    seen = [F.sum(F.when(F.col(f"w{i}").isNotNull(), times)).alias(f"n{i}") for i in range(len(languages))]
    of = F.array(*[F.struct((-F.col(f"s{i}")).alias("down"), F.lit(k).alias("language"), F.col(f"n{i}").alias("grams")) for i, k in enumerate(languages)])
    ranked = each.groupBy("doc_id").agg(*sums, *seen).select("doc_id", F.array_sort(F.filter(of, lambda x: x["grams"] > 0)).alias("r"))
    best = ranked.select("doc_id", F.col("r")[0]["language"].alias("best"), ((F.get("r", F.lit(1))["down"] - F.col("r")[0]["down"]) / F.col("r")[0]["grams"]).alias("margin"))
    return docs.select("doc_id").distinct().join(best, "doc_id", "left").select("doc_id", F.coalesce("best", F.lit(DEFAULT)).alias("language"), "margin")
