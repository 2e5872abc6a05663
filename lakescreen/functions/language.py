"""Language and profile of a text, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import dims
from ..plans.patterns import TECHNICAL
from .rx import java

#: Own stop words; a text's language is the one of whose words it has most.
STOP_WORDS = {
    "nb": "og ikke jeg det som på med av er til har den vi ble mellom eller også være hvor etter noen",
    "sv": "och inte jag det som på med av är till har den vi blev mellan eller också vara hur efter några",
    "en": "the of and to in is that for it as was with be by on not he his this are or from at which",
    "da": "og ikke jeg det som på med af er til har den vi blev mellem eller også være hvor efter nogle",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce",
    "es": "de la que el en y los del se las por un para con no una su al lo como más pero sus",
}


def detect(text: Column) -> Column:
    """A code of ``dims.LANGUAGES`` from the first 3000 characters; English for short or unclear texts."""
    words = F.array_distinct(F.split(F.lower(F.substr(text, F.lit(1), F.lit(3000))), r"[^\p{L}]+"))
    score = lambda own, of: F.size(F.array_intersect(of, F.array(*map(F.lit, own.split()))))
    row = lambda code, own, of: F.struct(score(own, of).alias("n"), F.lit(code == "en").cast("int").alias("tie"), F.lit(code).alias("code"))
    # Inside a lambda the words are split once for all languages.
    best = F.transform(F.array(words), lambda of: F.array_max(F.array(*(row(code, own, of) for code, own in STOP_WORDS.items()))))[0]
    short = F.length(F.trim(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))) < 80
    return F.when(short | text.isNull() | (best["n"] < 3), "en").otherwise(best["code"])


def resolve(requested: Column, text: Column) -> Column:
    """``auto`` is detected; a code that is not known is English."""
    return F.when(requested == "auto", detect(text)).when(requested.isin(*dims.LANGUAGES), requested).otherwise("en")


def looks_technical(text: Column) -> Column:
    """Whether weighted signs of technical or academic text in the first 50 000 characters reach 3."""
    sample = F.substr(text, F.lit(1), F.lit(50_000))
    total, strong = F.lit(0), F.lit(False)
    for pattern, weight in TECHNICAL:
        n = F.regexp_count(sample, F.lit(java(pattern.removeprefix("(?i)"), "i" if pattern.startswith("(?i)") else "")))
        total = total + F.least(n, F.lit(3)) * weight
        if weight >= 3:
            strong = strong | (n > 0)
    return F.coalesce(strong | (total >= 3), F.lit(False))


def profile(requested: Column, text: Column) -> Column:
    """normal or technical."""
    wish = F.lower(F.trim(F.coalesce(requested, F.lit("normal"))))
    technical = (wish == "auto") & looks_technical(text) | wish.isin("technical", "academic")
    return F.when(technical, "technical").otherwise("normal")
