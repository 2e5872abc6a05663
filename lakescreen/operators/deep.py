"""The deterministic parts of a language-model scan: chunks, answers, grounding, tables, and a hook for the model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rx
from ..plans import ai as A
from ..plans import patterns as P
from . import detect, names

# Words of a chunk, words that chunks share.
CHUNK, OVERLAP = 1600, 60
ANSWER = "struct<findings:array<struct<category:string,text:string,context:string,confidence:string>>>"


def chunks(docs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk, text): overlapping windows of words; a text of one window stays as it is, a blank one has none."""
    words = F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")
    n, step = F.size(words), size - overlap
    # Windows start every ``step`` words, and the first that reaches the end is the last.
    many = F.when(n <= size, 1).otherwise(F.ceil((n - size) / step) + 1).cast("int")
    cut = F.transform(F.sequence(F.lit(0), many - 1), lambda k: F.array_join(F.slice(words, k * step + 1, size), " "))
    rows = docs.where(n > 0).select("doc_id", F.posexplode(F.when(n <= size, F.array("text")).otherwise(cut)).alias("chunk", "text"))
    return rows


def parse_answers(rows: DataFrame, raw: str = "response") -> DataFrame:
    """Findings of a model's answers: the whole as JSON, else from its first to its last brace."""
    inner = F.regexp_extract(F.col(raw), r"(?s)(\{.*\})", 1)
    parsed = F.coalesce(F.from_json(F.trim(raw), ANSWER)["findings"], F.from_json(inner, ANSWER)["findings"])
    return rows.select(*[c for c in rows.columns if c != raw], F.posexplode(parsed).alias("ord", "f")).select(*[c for c in rows.columns if c != raw], "ord", "f.*")


def grounded(reported: Column, source: Column) -> Column:
    """Whether a reported text stands in its source, white space and case aside; or, from four characters, separators too."""
    flat = lambda c: F.lower(rx.squeeze(c))
    tight = lambda c: F.regexp_replace(flat(c), r"(?U)[\s.\-_/()]+", "")
    value = F.coalesce(reported, F.lit(""))
    return (flat(value) != "") & (flat(source).contains(flat(value)) | (F.length(tight(value)) >= 4) & tight(source).contains(tight(value)))


def confident(confidence: Column, least: str) -> Column:
    order = F.create_map(*[F.lit(x) for x in ("low", 0, "medium", 1, "high", 2)])
    return F.coalesce(order[F.lower(confidence)], F.lit(1)) >= {"low": 0, "medium": 1, "high": 2}[least]


def deduplicate(findings: DataFrame) -> DataFrame:
    """The first finding of each category and text in a document."""
    key = F.lower(F.trim(F.concat_ws("|", F.coalesce("category", F.lit("")), F.coalesce("text", F.lit("")))))
    first = Window.partitionBy("doc_id", "_key").orderBy("ord")
    return findings.withColumn("_key", key).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_key", "_n")


def is_amount(cell: Column) -> Column:
    """Whether a table cell is an amount: no date, no bare year, no share."""
    return ~cell.contains("%") & ~cell.rlike(rx.java(A.DATE_CELL)) & cell.rlike(rx.java(A.AMOUNT_CELL, "i"))


def cells_of(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c))


def table_values(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, header, text, context): amounts in the financial columns of tables drawn with bars.

    A header holds for the table lines that follow it, up to the next header or line without a bar. Lines of a text are
    read in its row, where each header takes the slice of lines up to the next one, so only amounts leave it. Rows of one
    doc_id are read one by one, and told together.
    """
    headed = lambda c: c.rlike(rx.java(A.MONEY_HEADER, "i")) & ~c.rlike(rx.java(A.OTHER_HEADER, "i"))
    money = lambda cells: F.filter(F.transform(cells, lambda c, k: F.when(headed(c), k)), lambda k: k.isNotNull())
    said = F.filter(F.transform(F.split("text", r"\r?\n"), lambda x, k: F.struct(k.alias("line"), x.alias("said"))), lambda x: x["said"].contains("|"))
    # Lines next to one another have numbers next to one another, which tells the blocks.
    cut = F.transform(said, lambda x, k: F.struct(x["line"].alias("line"), (x["line"] - k).alias("block"), x["said"].alias("said"), cells_of(x["said"]).alias("cells")))
    full = F.filter(cut, lambda x: ~F.forall(x["cells"], lambda c: c.rlike("^-*$")))
    lines = F.transform(full, lambda x: F.struct(x["line"].alias("line"), x["block"].alias("block"), x["said"].alias("said"), x["cells"].alias("cells"), money(x["cells"]).alias("money")))
    row = docs.where(F.contains("text", F.lit("|"))).select("doc_id", lines.alias("lines"))
    heads = F.transform("lines", lambda x, k: F.when(F.size(x["money"]) > 0, F.struct(k.alias("at"), x["block"].alias("block"), x["cells"].alias("cells"), x["money"].alias("money"))))
    row = row.withColumn("heads", F.filter(heads, lambda h: h.isNotNull()))
    until = lambda k: F.coalesce(F.get("heads", k + 1)["at"], F.size("lines"))
    below = lambda h, k: F.filter(F.slice("lines", h["at"] + 2, until(k) - h["at"] - 1), lambda x: (x["block"] == h["block"]) & (F.size(x["cells"]) > F.array_max(h["money"])))
    parts = row.select("doc_id", F.inline(F.transform("heads", lambda h, k: F.struct(h["cells"].alias("head"), h["money"].alias("money"), below(h, k).alias("body")))))
    each = parts.select("doc_id", "head", "money", F.explode("body").alias("x")).select("doc_id", "head", "x", F.explode("money").alias("col"))
    told = each.select("doc_id", "x.line", "col", F.get("head", "col").alias("header"), F.get("x.cells", "col").alias("text"), F.trim("x.said").alias("context")).where(is_amount(F.col("text")))
    first = told.groupBy("doc_id", F.lower("header").alias("_h"), F.lower("text").alias("_t")).agg(F.min(F.struct("line", "col", "header", "text", "context")).alias("f"))
    return first.select("doc_id", (F.col("f.line").cast("long") * 1_000_000 + F.col("f.col")).alias("ord"), "f.header", "f.text", "f.context")


def prompts(parts: DataFrame, categories: list[str], language: str = "nb") -> DataFrame:
    """``parts`` of texts (…, text) with a prompt for each pass: the general one, and one of its own for medical categories."""
    asked = [k for k in A.ASKED if k in categories]
    passes = [p for p in ([k for k in asked if k not in A.MEDICAL_PASS], [k for k in asked if k in A.MEDICAL_PASS]) if p]
    told = F.array(*(F.struct(F.lit(n).alias("pass"), F.lit(
        "List what the text holds of the following, word for word, and nothing else.\n" + "\n".join(f"- {k}: {A.ASKED[k]}" for k in p)
        + f'\nAnswer in {A.ANSWER_IN.get(language, A.ANSWER_IN["nb"])} with JSON: {{"findings": [{{"category", "text", "context", "confidence"}}]}}.\n\nText:\n'
    ).alias("rules")) for n, p in enumerate(passes)))
    if not passes:
        return parts.limit(0).select("*", F.lit(0).alias("pass"), F.lit("").alias("prompt"))
    rows = parts.withColumn("_p", F.explode(told))
    return rows.select(*parts.columns, F.col("_p.pass").alias("pass"), F.concat("_p.rules", "text").alias("prompt"))


def ask(prompts: DataFrame, model: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """Answers (…, response) of ``model``, a function from prompts to answers, batch by batch; without one, empty answers."""
    if model is None:
        return prompts.withColumn("response", F.lit('{"findings": []}'))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(response=model(part["prompt"].tolist()))

    return prompts.mapInPandas(run, prompts.schema.add("response", "string"))


def payload_findings(rows: DataFrame) -> DataFrame:
    """Model findings from requests: (doc_id, ord, category, text, context), trimmed, once for each text, category and context."""
    trimmed = rows.select("doc_id", "ord", F.trim("text").alias("text"), F.coalesce(F.trim("category"), F.lit("🤖 AI-funn")).alias("category"), F.coalesce(F.trim("context"), F.lit("")).alias("context"))
    first = Window.partitionBy("doc_id", F.lower("text"), F.lower("category"), F.lower("context")).orderBy("ord")
    return trimmed.where("text <> ''").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def category_key(category: str | Column = "category") -> Column:
    col = F.col(category) if isinstance(category, str) else category
    return F.lower(F.trim(F.replace(F.coalesce(col, F.lit("")), F.lit("🤖"), F.lit(""))))


def family(category: str | Column = "category") -> Column:
    """The family of a model's category, whatever the model calls it; null for others."""
    key, out = category_key(category), F
    for name, equal, parts, begins in A.FAMILIES:
        fits = key.isin(*equal) if equal else F.lit(False)
        for p in parts:
            fits = fits | key.contains(p)
        for p in begins:
            fits = fits | key.startswith(p)
        if name == "person":
            fits = fits | key.contains("person") & key.rlike("|".join(A.SENSITIVE))
        out = out.when(fits, name)
    return out


def _bibliographic(value: Column, around: Column) -> Column:
    """Whether a value stands beside a reference in a text."""
    at = F.position(F.lower(value), F.lower(around))
    window = F.substr(around, F.greatest(F.lit(1), at - 48), F.length(value) + 96)
    page = F.substr(around, F.greatest(F.lit(1), at - 48), F.least(at - 1, F.lit(48))).rlike(rx.java(P.PAGE_BEFORE, "i"))
    return F.coalesce((at > 0) & (window.rlike(rx.java(P.BIBLIOGRAPHIC, "i")) | page), F.lit(False))


def phone_text(text: Column, context: Column, source: Column) -> Column:
    """The number in a reported phone number; null where there is none, or where it belongs to a reference."""
    raw = rx.squeeze(text)
    local = F.filter(rx.hits(raw, rx.java(P.PHONE_NO)), lambda h: detect.phone_reason(detect.Hit(h), F.lit(False)).isNull())
    foreign = rx.java(A.FOREIGN_PHONE)
    found = F.coalesce(F.get(local, F.lit(0))["m"], F.nullif(F.regexp_extract(raw, rx.java(P.US_PHONE), 0), F.lit("")), F.nullif(F.trim(F.regexp_extract(raw, foreign, 0)), F.lit("")))
    cited = F.concat_ws(" ", raw, context).rlike(rx.java(P.BIBLIOGRAPHIC, "i"))
    return F.when((raw != "") & ~cited & ~_bibliographic(raw, source) & ~_bibliographic(raw, context), found)


def bank_text(text: Column) -> Column:
    """A valid account number in the text, or the text if it is a valid IBAN and nothing else."""
    digits = lambda h: F.regexp_replace(h["m"], "[^0-9]", "")
    accounts = F.filter(rx.hits(text, rx.java(P.KONTO)), lambda h: detect.account_ok(digits(h)))
    raw = rx.squeeze(text)
    compact = F.upper(F.regexp_replace(raw, r"(?U)\s", ""))
    return F.coalesce(F.get(accounts, F.lit(0))["m"], F.when(raw.rlike(rx.java(f"^{P.IBAN}$", "i")) & detect.iban_ok(compact), raw))


def amount_text(text: Column, context: Column) -> Column:
    """An amount with its currency, or a bare one beside a word for money."""
    flat = rx.squeeze(text)
    priced = F.trim(F.regexp_extract(flat, rx.java(A.PRICED, "i"), 0))
    bare = (flat != "") & is_amount(flat) & F.concat_ws(" ", flat, context).rlike(rx.java(A.MONEY_HEADER, "i"))
    return F.coalesce(F.nullif(priced, F.lit("")), F.when(bare, flat))


def is_address(text: Column) -> Column:
    flat = rx.squeeze(text)
    numbered = flat.rlike(rx.java(A.HOUSE_NUMBER)) & flat.rlike("[A-Za-zÆØÅæøåÄÖäö]")
    fits = (flat != "") & (F.length(flat) <= A.MOST_ADDRESS) & ~flat.rlike(rx.java(A.NO_ADDRESS, "i"))
    return fits & (flat.rlike(rx.java(A.BOX, "i")) | numbered)


def in_context(text: Column, context: Column, kind: str, lists: names.Lists) -> Column:
    """Whether a reported statement says something of its kind, of someone where the kind asks for that."""
    flat = rx.squeeze(text)
    both = F.trim(F.concat_ws(" ", flat, rx.squeeze(F.coalesce(context, F.lit("")))))
    fits = (flat != "") & (F.length(flat) <= A.MOST_CONTEXT) & ~both.rlike(rx.java(A.NO_CASE, "i")) & both.rlike(rx.java(A.CONTEXTS[kind], "i"))
    if kind != "person":
        return fits
    someone = names.base_reason(both, F.lit(False), F.lit(False), lists).isNull() | both.rlike(rx.java(A.TWO_NAMES)) | both.rlike(rx.java(A.SOMEONE, "i"))
    return fits & someone


def is_medical(text: Column, context: Column, confidence: Column, source: Column) -> Column:
    """Whether a statement is medical: by its words, or by what a sure model has read word for word."""
    flat = rx.squeeze(text)
    both = F.trim(F.concat_ws(" ", flat, rx.squeeze(F.coalesce(context, F.lit("")))))
    generic = both.rlike(rx.java(A.NOT_MEDICAL, "i"))
    says = (flat != "") & (F.length(flat) <= A.MOST_MEDICAL) & ~generic & both.rlike(rx.java(A.MEDICAL, "i"))
    exact = (F.lower(F.coalesce(confidence, F.lit(""))) == "high") & (flat != "") & F.lower(rx.squeeze(source)).contains(F.lower(flat)) & ~generic
    return says | exact


def precise(findings: DataFrame, lists: names.Lists | None = None) -> DataFrame:
    """Model findings (…, category, text, context, confidence, source) whose text is what their category says.

    Their texts are cut to the value itself, and categories get the family's name; those of no family stay as they are.
    """
    lists = lists or names.Lists()
    text, context, source = F.col("text"), F.coalesce("context", F.lit("")), F.coalesce("source", F.lit(""))
    kept = lambda ok: F.when(ok, text)
    mail = F.trim(F.regexp_extract(text, rx.java(A.EMAIL, "i"), 0), F.lit("<>()[]{}.,;:'\""))
    told = {
        "email": F.nullif(mail, F.lit("")),
        "phone": phone_text(text, context, source),
        "bank": bank_text(text),
        "financial": amount_text(text, context),
        "name": kept(names.base_reason(text, F.lit(False), F.lit(False), lists).isNull()),
        "address": kept(is_address(text)),
        "medical": kept(is_medical(text, context, F.col("confidence"), source)),
    } | {k: kept(in_context(text, context, k, lists)) for k in A.CONTEXTS}

    def chosen(row: Column) -> Column:
        out = F
        for k, v in told.items():
            out = out.when(F.col("_family") == k, v)
        return out.otherwise(text)

    called = F.create_map(*[F.lit(x) for pair in A.NAMES.items() for x in pair])
    bank = F.when(category_key() == "iban", "IBAN").otherwise("Kontonummer")
    rows = findings.withColumn("_family", family())
    rows = rows.withColumn("_text", chosen(text)).where("_text is not null")
    category = F.when(F.col("_family") == "bank", bank).otherwise(F.coalesce(called[F.col("_family")], F.col("category")))
    return rows.withColumn("category", category).withColumn("text", F.col("_text")).drop("_family", "_text")


def phones_among_urls(findings: DataFrame, keep: bool) -> DataFrame:
    """Web addresses that are American phone numbers become phone numbers, or go where none are asked for."""
    mistaken = category_key().isin(*A.URL_CATEGORIES) & F.col("text").rlike(rx.java(P.US_PHONE))
    mistaken = mistaken & ~F.concat_ws(" ", "text", "context").rlike(rx.java(P.BIBLIOGRAPHIC, "i"))
    rows = findings if keep else findings.where(~mistaken)
    confidence = F.when(mistaken, F.coalesce(F.nullif("confidence", F.lit("")), F.lit("high"))).otherwise(F.col("confidence"))
    return rows.withColumn("confidence", confidence).withColumn("category", F.when(mistaken, "Telefonnummer").otherwise(F.col("category")))


#: Detectors that are surer than a model, by the category that asks for them, and what their findings are called.
SUPPLEMENTS = (
    ("nettadresse", ("url_http", "url_www"), "Nettadresse"), ("personnummer", ("fnr",), None), ("epost", ("email",), "E-post"),
    ("telefon", ("us_phone",), "Telefonnummer"), ("bankkonto", ("konto",), "Kontonummer"), ("bankkonto", ("iban",), "IBAN"),
)
#: Places of the findings of a model, of supplements, of tables and of listed terms, in the order in which they are told.
AFTER_MODEL, AFTER_RULES, AFTER_TABLES = 10**9, 10**12, 10**16


def supplements(docs: DataFrame, categories: list[str]) -> DataFrame:
    """(doc_id, ord, category, text, context, confidence) of what rules find for the asked categories."""
    asked = [(d, n) for c, d, n in SUPPLEMENTS if c in categories]
    only = tuple(x for d, _ in asked for x in d)
    ready = docs.select("doc_id", "text", F.lit("en").alias("language"), F.lit(False).alias("technical"))
    named = {x: n for d, n in asked for x in d}
    found = detect.scan(ready, None, only) if only else detect.scan(ready.limit(0), None, ("email",))
    found = found.where("reason is null")
    name = F
    for x, n in named.items():
        name = name.when(F.col("detector") == x, F.lit(n) if n else F.concat(F.upper(F.substr("category", F.lit(1), F.lit(1))), F.substr("category", F.lit(2), F.lit(99))))
    sure = F.when(F.col("category") == "mulig personnummer (format)", "medium").otherwise("high")
    place = F.lit(AFTER_MODEL) + F.col("sub_ord").cast("long") * 10**9 + F.col("match_ord")
    told = found.select("doc_id", place.cast("long").alias("ord"), (name.otherwise(F.col("category")) if named else F.col("category")).alias("category"), "text", "context", sure.alias("confidence"))
    if "budsjett_tall" in categories:
        tables = table_values(docs).select("doc_id", (F.col("ord") + AFTER_RULES).alias("ord"), F.lit("Budsjettall").alias("category"), "text", "context", F.lit("high").alias("confidence"))
        told = told.unionByName(tables)
    return told


def refine(
    ai: DataFrame, docs: DataFrame, least: str = "low", whitelist: DataFrame | None = None, blacklist: list[str] | DataFrame | None = None,
    categories: list[str] | None = None, ignored: DataFrame | None = None, lists: names.Lists | None = None,
) -> DataFrame:
    """Model findings (doc_id, ord, category, text, context, confidence) as they are told.

    In this order: only what stands in the source and is what its category says; what rules find for the asked categories
    added; the first of each; enough confidence; phone numbers among web addresses; ignored ones gone; whitelisted ones
    green; listed terms added; the first of each again; and a mark before the category. Only documents with findings of
    the model meet their texts, in one join.
    """
    from . import post

    sourced = ai.join(docs.select("doc_id", F.col("text").alias("source")), "doc_id").where(grounded(F.col("text"), F.col("source")))
    kept = precise(sourced, lists).drop("source").select("doc_id", F.col("ord").cast("long").alias("ord"), "category", "text", "context", "confidence")
    if categories:
        kept = kept.unionByName(supplements(docs, categories))
    kept = deduplicate(kept).where(confident(F.col("confidence"), least))
    kept = deduplicate(phones_among_urls(kept, categories is None or "telefon" in categories)).withColumn("severity", F.lit("gul"))
    if ignored is not None:
        named = F.when(family() == "name", "navn (person)").when(F.col("text").rlike(rx.java(f"^{A.EMAIL}$", "i")), "e-post").otherwise("")
        keyed = kept.withColumn("_own", F.col("category")).withColumn("category", named).select("*", *(F.lit(0).alias(c) for c in ("det_ord", "sub_ord")), F.col("ord").alias("match_ord"))
        kept = post.ignore(keyed, ignored).drop("category", "det_ord", "sub_ord", "match_ord").withColumnRenamed("_own", "category")
    kept = post.mark_whitelisted(kept, whitelist) if whitelist is not None else kept.withColumn("whitelisted", F.lit(False))
    if post.named(blacklist):
        listed = post.blacklist(docs, blacklist).select(
            "doc_id", (F.col("match_ord") + AFTER_TABLES).alias("ord"), "category", "text", "context", F.lit("high").alias("confidence"), "severity", F.lit(False).alias("whitelisted")
        )
        kept = deduplicate(kept.select(*listed.columns).unionByName(listed))
    return kept.withColumn("category", F.when(F.col("category").startswith("🤖"), F.col("category")).otherwise(F.concat(F.lit("🤖 "), "category")))


def replacement_texts(ai: DataFrame) -> DataFrame:
    """(doc_id, ord, text): what to replace for model findings: their texts, and of financial ones the amounts in table cells too."""
    money = F.coalesce(family() == "financial", F.lit(False))
    lines = F.filter(F.split(F.concat_ws("\n", F.col("text"), F.col("context")), r"\r?\n"), lambda x: x.contains("|"))
    cells = F.filter(F.flatten(F.transform(lines, cells_of)), is_amount)
    values = F.concat(F.array(F.trim("text")), F.when(money, cells).otherwise(F.array().cast("array<string>")))
    each = ai.select("doc_id", "ord", F.posexplode(values).alias("nth", "text")).where("text <> ''")
    first = each.groupBy("doc_id", F.lower("text").alias("_t")).agg(F.min(F.struct("ord", "nth", "text")).alias("f"))
    return first.select("doc_id", "f.ord", "f.text")
