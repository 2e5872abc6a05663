"""Person names: candidates from a provider or from capitalised words, and the rules that reject most of them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rx
from ..plans.patterns import NAME_CHARS, UPPER

# Limits, contexts, parts that are no surnames though in capitals.
NER_CHARS, WINDOW, TECHNICAL_WINDOW = 100_000, 90, 140
REFERENCE = (
    r"(?:\bet\s+al\.?(?=\W|$)|\b(?:doi|isbn|issn|references?|bibliograph(?:y|ies|ic)|citation|citations|cited|journal|proceedings|conference"
    r"|volume|vol\.|pages?|pp\.)\b)"
)
POSITIVE = (
    r"(?:\b(?:author|authors|supervisor|supervisors|advisor|advisors)\s*:?|\b(?:performed|written|prepared|created|developed)\s+by\b"
    r"|\b(?:forfatter|forfattere|veileder|veiledere)\s*:?|\b(?:skrevet|utarbeidet|utført|laget|utviklet)\s+av\b)"
)
ACRONYMS = ("ai", "api", "cnn", "cpu", "cst", "db", "doi", "gpu", "isbn", "issn", "llm", "ml", "ocr", "pdf", "ui", "ux")
SEPARATORS = r"[,;:/|]|\s+(?:og|och|and|samt|eller|or)\s+"
PUNCTUATION = ".,;:()[]{}«»\"'"

#: Own rule: two to four capitalised words, the last perhaps in capitals.
CANDIDATE = rf"(?<![\w@])[{UPPER}][{NAME_CHARS}'-]+(?:[ ][{UPPER}][{NAME_CHARS}'-]+){{1,3}}(?![\w@])"


@dataclass(frozen=True)
class Lists:
    """Word lists of the filter, a parameter; these defaults are short, and callers bring their own."""

    stopwords: tuple[str, ...] = ("database", "system", "service", "server", "model", "report", "invoice", "order", "group", "team", "manager", "director", "azure", "python")
    org_keywords: tuple[str, ...] = ("as", "asa", "ab", "oy", "ltd", "limited", "gmbh", "inc", "llc", "kommune", "direktoratet", "departementet")
    org_names: tuple[str, ...] = ("microsoft", "google", "amazon", "oslo kommune")
    generic: tuple[str, ...] = ("abstract", "appendix", "chapter", "conference", "document", "figure", "introduction", "journal", "method", "results", "section", "summary", "table", "project", "analysis", "machine", "learning", "network", "signal", "processing")
    technical: tuple[str, ...] = ("machine", "neural", "signal", "transformer", "encoder", "decoder", "simulation", "solver", "python")
    preceders: tuple[str, ...] = ("the", "of", "in")
    followers: tuple[str, ...] = ("area", "basin", "block", "field", "formation", "gas", "oil", "platform", "prospect", "reservoir", "unit", "well", "zone")
    extra: dict = field(default_factory=dict)


def _isin(x: Column, words: tuple[str, ...]) -> Column:
    return x.isin(*words) if words else F.lit(False)


def _words(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit("[a-zæøåäöüéèáàóòíìñß]+"), F.lit(0))


def base_reason(name: Column, technical: Column, positive: Column, lists: Lists) -> Column:
    """Why a name is none by itself, the first rule that says so; null if it may be one."""
    flat = rx.squeeze(name)
    low, words, parts = F.lower(flat), _words(flat), F.split(flat, " ")
    bare = F.transform(parts, lambda p: rx.strip(p, PUNCTUATION))
    n = F.size(parts)
    generic = (*lists.generic, *lists.stopwords)
    wide = (*generic, *lists.technical)
    telling = F.size(F.filter(words, lambda w: _isin(w, lists.technical)))
    known = F.size(F.filter(words, lambda w: _isin(w, wide)))
    any_part = lambda rule: F.exists(bare, rule)
    pieces = F.flatten(F.transform(bare, lambda p: F.filter(F.split(p, "-"), lambda s: s != "")))
    capital = lambda s: F.substr(s, F.lit(1), F.lit(1)).rlike(r"^\p{Lu}")
    # A surname in capitals passes after an author word, beside a part in normal case.
    normal = F.exists(F.slice(bare, 1, F.greatest(n - 1, F.lit(1))), lambda p: p.rlike(r"^\p{Lu}[\p{L}]*\p{Ll}"))
    surname = F.element_at(bare, -1)
    allowed = positive & normal & surname.rlike(r"^[\p{L}-]+$") & ~_isin(F.lower(surname), ACRONYMS)
    shout = lambda s: s.rlike(r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$") & (F.length(s) > 2)
    judged = F.when(allowed, F.slice(bare, 1, F.greatest(n - 1, F.lit(1)))).otherwise(bare)
    return (
        F.when(flat == "", "tom kandidat")
        .when(_isin(low, lists.org_names), "kjent organisasjonsnavn")
        .when(flat.rlike(rx.java(SEPARATORS, "i")), "liste eller sammensatt frase")
        .when(F.exists(words, lambda w: _isin(w, tuple(k for k in lists.org_keywords if "-" not in k))), "organisasjonsord")
        .when((n < 2) | (n > 4), "ikke 2-4 navnedeler")
        .when((F.size(words) >= 2) & F.forall(words, lambda w: _isin(w, generic)), "generisk tittel-/fagfrase")
        .when(technical & (F.size(words) >= 2) & (telling > 0) & (known >= F.size(words) - 1), "teknisk/akademisk tittel-frase")
        .when(any_part(lambda p: F.length(p) < 2), "for kort navnedel")
        .when(any_part(lambda p: p.rlike("[0-9]")), "inneholder siffer")
        .when(any_part(lambda p: p.rlike("[’'`]")), "inneholder apostrof eller kodetegn")
        .when(any_part(lambda p: _isin(F.lower(p), lists.stopwords)), "generisk stoppord")
        .when(F.exists(pieces, lambda s: ~capital(s)), "navnedel starter ikke med stor bokstav")
        .when(F.exists(F.flatten(F.transform(judged, lambda p: F.split(p, "-"))), shout), "akronym i kandidat")
        .when(F.exists(pieces, lambda s: _isin(F.lower(s), lists.stopwords)), "generisk stoppord")
    )


def reason(name: Column, pre: Column, post: Column, technical: Column, lists: Lists) -> Column:
    """Why a candidate in its surroundings is no name; null if it is one."""
    positive = rx.last(pre, WINDOW).rlike(rx.java(POSITIVE, "i"))
    radius = F.when(technical, TECHNICAL_WINDOW).otherwise(WINDOW)
    window = F.concat(F.substr(pre, F.greatest(F.lit(1), F.length(pre) - radius + 1), radius), name, F.substr(post, F.lit(1), radius))
    before = F.element_at(F.concat(F.array(F.lit("")), _words(rx.last(pre, WINDOW))), -1)
    after = F.slice(_words(F.substr(post, F.lit(1), F.lit(WINDOW))), 1, 4)
    thing = _isin(before, lists.preceders) & F.exists(after, lambda w: _isin(w, lists.followers))
    negative = window.rlike(rx.java(REFERENCE, "i")) | thing
    return F.coalesce(base_reason(name, technical, positive, lists), F.when(~positive & negative, "referanse-, sted- eller fagkontekst"))


def candidates(docs: DataFrame, provider: Callable[[list[str], list[str]], list[list[tuple[int, int]]]] | None = None) -> DataFrame:
    """(doc_id, technical, start, m, pre, post) of possible names in the first ``NER_CHARS`` characters.

    provider: a model, from texts and languages to places; without one, runs of capitalised words stand in. A batch on
    which it fails gives one row a document whose start is -1 and whose m tells the error.
    """
    text = F.substr("text", F.lit(1), F.lit(NER_CHARS))
    if provider is None:
        rows = docs.where("text is not null").select("doc_id", "technical", F.explode(rx.hits(text, rx.java(CANDIDATE))).alias("h"))
        return rows.select("doc_id", "technical", "h.start", "h.m", "h.pre", "h.post")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            try:
                told = provider(part.text.tolist(), part.language.tolist())
            except Exception as error:  # the scan goes on without names
                rows = [(r.doc_id, r.technical, -1, f"{type(error).__name__}: {error}", "", "") for r in part.itertuples()]
                told = [[]] * len(part)
            for r, found in zip(part.itertuples(), told, strict=True):
                rows += [(r.doc_id, r.technical, a, r.text[a:b], r.text[max(0, a - rx.AROUND) : a], r.text[b : b + rx.AROUND]) for a, b in found]
            yield pd.DataFrame(rows, columns=["doc_id", "technical", "start", "m", "pre", "post"])

    slim = docs.where("text is not null").select("doc_id", "technical", "language", text.alias("text"))
    return slim.mapInPandas(run, "doc_id long, technical boolean, start int, m string, pre string, post string")


def names(docs: DataFrame, lists: Lists | None = None, provider: Callable | None = None) -> DataFrame:
    """(doc_id, start, text, reason): each distinct candidate once, reason null where it is a name, and where start is -1."""
    lists = lists or Lists()
    found = candidates(docs, provider)
    first = Window.partitionBy("doc_id", "m").orderBy("start")
    once = found.where(~F.col("m").rlike("^[#-]")).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    why = F.when(F.col("start") >= 0, reason(F.col("m"), F.col("pre"), F.col("post"), F.col("technical"), lists))
    return once.select("doc_id", "start", F.col("m").alias("text"), why.alias("reason"))


def parse_lists(path: str) -> Lists:
    """Lists from a TOML file with a ``person_names`` table."""
    import tomllib

    with open(path, "rb") as file:
        table = tomllib.load(file).get("person_names", {})
    name = {"generic": "generic_title_case_words", "technical": "technical_title_case_words", "preceders": "place_or_thing_preceders", "followers": "place_or_thing_followers"}
    of = lambda k: tuple(dict.fromkeys(re.sub(r"\s+", " ", str(w)).strip().lower() for w in table.get(name.get(k, k), [])))
    return Lists(**{k: of(k) for k in ("stopwords", "org_keywords", "org_names", "generic", "technical", "preceders", "followers") if name.get(k, k) in table})
