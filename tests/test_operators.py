"""Filters, risk, anonymisation, batches, texts, model answers and streams on small tables."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lakescreen import engine
from lakescreen.functions import language
from lakescreen.operators import anonymize, batch, deep, names, post, risk
from lakescreen.sources import extract
from lakescreen.streaming import watch
from lakescreen.worked import office

FIND = "doc_id long, ord int, category string, text string, raw_text string, severity string"


def finds(spark, *rows):
    return spark.createDataFrame([(1, k, c, t, r, "gul") for k, (c, t, r) in enumerate(rows)], FIND)


def test_labels_are_shared_by_family_and_kept_by_value(spark):
    rows = finds(spark, ("navn (person)", "Ola Berg", ""), ("kontonummer", "123", ""), ("bankgiro (SV)", "45", ""), ("navn (person)", "Kari Vik", ""), ("navn (person)", "Ola Berg", ""),
                 ("IBAN", "NO…6", "NO93"), ("kredittkort (Visa)", "4111 ****", "4111"), ("⚠ NER", "x", ""), ("🤖 Navn", "Per", ""), ("ukjent", "zzz", ""))
    got = {r.target: r.label for r in anonymize.replacements(rows).collect()}
    assert got == {"Ola Berg": "<Person A>", "Kari Vik": "<Person B>", "123": "<Konto 1>", "45": "<Konto 2>", "NO93": "<IBAN 1>", "4111": "<kredittkort>", "Per": "[ANONYMISERT]", "zzz": "<sensitiv-info>"}


def test_longest_values_go_first_and_labels_are_safe(spark):
    docs = spark.createDataFrame([(1, "Per Hansen og Per, 10 av 100, Person"), (2, "rent"), (3, None)], "doc_id long, text string")
    rows = finds(spark, ("navn (person)", "Per", ""), ("navn (person)", "Per Hansen", ""), ("prosjektsum", "10", ""))
    out = {r.doc_id: r.anonymized for r in anonymize.anonymize(docs, anonymize.replacements(rows)).collect()}
    assert out == {1: "<Person B> og <Person A>, <prosjektsum> av 100, <Person A>son", 2: "rent", 3: None}


def test_anonymising_twice_changes_nothing_more(spark):
    docs = spark.createDataFrame([(1, "a@b.no skrev til c@d.no")], "doc_id long, text string")
    found = engine.scan(docs, engine.Options(language="nb", only=("email",)))[0].withColumn("ord", F.col("match_ord"))
    labels = anonymize.replacements(found)
    once = anonymize.anonymize(docs, labels).select("doc_id", F.col("anonymized").alias("text"))
    assert once.first().text == "<Epost 1> skrev til <Epost 2>"
    assert anonymize.anonymize(once, labels).first().anonymized == once.first().text
    assert {r.status for r in anonymize.verify(anonymize.anonymize(docs, labels), labels).collect()} == {"removed"}
    assert anonymize.by_span(docs, found, labels).first().anonymized == "<Epost 1> skrev til <Epost 2>"


def test_ignore_whitelist_blacklist(spark):
    docs = spark.createDataFrame([(1, "ola@sub.firma.no kari@annet.no HEMMELIG prosjekt"), (2, None)], "doc_id long, text string")
    ignored = spark.createDataFrame([("domain", "Firma.no"), ("name", "Ola Berg")], "kind string, value string")
    allowed = spark.createDataFrame([("KARI@annet.no",), ("hemmelig",)], "value string")
    found, _ = engine.scan(docs, engine.Options(language="nb", only=("email", "confidential"), ignored=ignored, whitelist=allowed, blacklist=["hemmelig pro"]))
    got = {(r.category, r.text, r.severity) for r in found.collect()}
    assert got == {("e-post", "kari@annet.no", "grønn"), ("konfidensielt dokument (brødtekst)", "HEMMELIG", "grønn"), ("Blacklist", "HEMMELIG pro", "rød")}


def test_custom_patterns(spark):
    patterns = post.parse_patterns("[[patterns]]\nname = 'Kode'\nregex = 'PRJ-\\d{2}'\nseverity = 'svart'\n")
    docs = spark.createDataFrame([(1, "prj-12 PRJ-12 PRJ-34")], "doc_id long, text string")
    assert sorted((r.category, r.text, r.severity) for r in post.custom(docs, patterns).collect()) == [("Egendefinert: Kode", t, "svart") for t in ("PRJ-12", "PRJ-34", "prj-12")]
    for bad in ("[[patterns]]\nname='x'", "[[patterns]]\nname='x'\nregex='('", "[[patterns]]\nname='x'\nregex='a'\nseverity='blå'", "x="):
        with pytest.raises(ValueError):
            post.parse_patterns(bad)
    assert [(r.text, r.start, r.end) for r in post.try_pattern(spark, "ab AB", "ab").collect()] == [("ab", 0, 2), ("AB", 3, 5)]


def test_risk_is_the_highest_and_green_does_not_count(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    rows = spark.createDataFrame([(1, "e-post", "a", "gul"), (1, "IBAN", "b", "gul"), (2, "kontonummer", "c", "grønn"), (2, "Egendefinert: x", "d", "rød")], "doc_id long, category string, text string, severity string")
    assert [(r.doc_id, r.risk_level, r.finding_count) for r in risk.assess(docs, rows).orderBy("doc_id").collect()] == [(1, "rød", 2), (2, "rød", 2), (3, "grønn", 0)]


def test_merge_prefers_rules(spark):
    rule = spark.createDataFrame([(1, 0, "e-post", "A@b.no", "", "gul")], "doc_id long, ord int, category string, text string, context string, severity string")
    ai = spark.createDataFrame([(1, 0, "🤖 Epost", "a@B.no", "", "", "high"), (1, 1, "🤖 Medisinsk", "astma", "", "", "low"), (1, 2, "🤖 X", "ASTMA", "", "", "low")], "doc_id long, ord int, category string, text string, context string, severity string, confidence string")
    merged = risk.merge(rule, ai, spark.createDataFrame([], "value string"))
    assert [(r.text, r.severity, r.engine) for r in merged.orderBy("rank").collect()] == [("astma", "rød", "AI"), ("A@b.no", "gul", "Regelbasert")]
    results = spark.createDataFrame([(1, "gul", "svart")], "doc_id long, risk_level string, policy_level string")
    assert risk.combined(results, merged).first().risk_level == "svart"


def test_access(spark):
    rows = spark.createDataFrame([("/d", "/d Everyone:(OI)(RX)\n  Dom\\Domain Users:(DENY)(R)\n  X\\y:(I)(F)\nSuccessfully processed 1 files")], "path string, output string")
    got = batch.acl_summary(batch.acl_entries(rows)).first()
    assert (got.access_level, got.broad_identities, got.denied_identities, got.inherited_entries) == ("broad", ["Everyone"], ["Dom\\Domain Users"], 1)
    files = spark.createDataFrame([("/d/a.txt",), ("/e/b.txt",)], "source_path string")
    joined = batch.with_folder_access(files, batch.acl_summary(batch.acl_entries(rows))).orderBy("source_path").collect()
    assert [r.access and r.access.access_level for r in joined] == ["broad", None]


def test_exports_are_safe(spark):
    cells = spark.createDataFrame([("=1+1",), ("-2",), ("ok",), (None,)], "c string").select(batch.safe_cell(F.col("c")).alias("c"))
    assert [r.c for r in cells.collect()] == ["'=1+1", "'-2", "ok", ""]
    assert spark.range(1).select(batch.escape(F.lit("<a href='x'>&")).alias("x")).first().x == "&lt;a href=&#x27;x&#x27;&gt;&amp;"
    named = spark.createDataFrame([("x/a-redacted.pdf",), ("a-redacted-2.txt",), ("redacted.txt",)], "p string").select(batch.is_redacted("p").alias("r"))
    assert [r.r for r in named.collect()] == [True, True, False]


@pytest.mark.parametrize(("suffix", "data", "text"), [
    (".txt", "blåbær".encode("cp1252"), "blåbær"), (".html", b"<script>x</script><p>A &amp; B</p>", "A & B"), (".csv", b"a,b\n,\nc,", "a | b\nc"),
    (".eml", b"From: a@b.no\nSubject: Hei\n\nInnhold", "From: a@b.no\nSubject: Hei\nInnhold"), (".rtf", rb"{\rtf1\b Hei\b0  der}", "Hei der"),
    (".docx", office(".docx", "Hei", "B"), "Hei said\nA | B | C\n--- | --- | ---\n |  | C\nwide | C | \nalone | B"), (".xlsx", office(".xlsx", "navn", "x"), "[One]\nnavn | 12\n[Two]\nx"),
    (".pptx", office(".pptx", "Lysbilde", "7"), "Lysbilde\nmore\nnote\nItem | 7\n--- | ---\nx |"), (".odt", office(".odt", "en", "to"), "en\nto end"),
])
def test_extraction(suffix, data, text):
    assert extract.extract(suffix, data)[:2] == (text, None)


def test_extraction_of_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / ".git").mkdir()
    for name, data in (("b.txt", b"tekst " * 20), ("a/c.csv", b"x,y"), (".git/d.txt", b"no"), ("e.bin", b"no"), ("f.docx", b"broken")):
        (tmp_path / name).write_bytes(data)
    plan = extract.folder_plan(spark, str(tmp_path), recursive=True)
    assert [r.relative_path for r in plan.collect()] == ["a/c.csv", "b.txt", "f.docx"]
    cut = extract.folder_plan(spark, str(tmp_path), recursive=True, max_files=1)
    assert [r.relative_path for r in cut.collect()] == ["b.txt"] and extract.plan_summary(cut).first().truncated
    n = plan.count()
    for most in (n, n + 1):
        assert not extract.plan_summary(extract.folder_plan(spark, str(tmp_path), recursive=True, max_files=most)).first().truncated
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).select("path", "content")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error and r.error.split(":")[0], r.warning_code) for r in extract.texts(files).collect()}
    assert got["c.csv"] == ("x | y", None, "little_text_extracted") and got["f.docx"][1] == "BadZipFile" and got["b.txt"][2] is None


def test_zip_limits(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, size in (("a.txt", 5), ("../x.txt", 5), ("big.txt", 50), ("c.exe", 5), ("d.txt", 9), ("e.txt", 1)):
            z.writestr(name, b"x" * size)
    rows = extract.zip_members(spark.createDataFrame([("z.zip", bytearray(out.getvalue())), ("n.zip", bytearray(b"no"))], "path string, content binary"), max_bytes=18, max_member=20)
    assert [(r.path, r.skipped) for r in rows.where("zip = 'z.zip'").orderBy("ord").collect()] == [
        ("a.txt", None), ("../x.txt", "unsafe path"), ("big.txt", "member too large"), ("c.exe", "unsupported"), ("d.txt", "archive too large"), ("e.txt", None)]


def test_chunks_tables_answers(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(25))), (2, "  "), (3, "kort  tekst")], "doc_id long, text string")
    got = [(r.doc_id, r.chunk, r.text.split()[0], len(r.text.split())) for r in deep.chunks(docs, 10, 2).orderBy("doc_id", "chunk").collect()]
    assert got == [(1, 0, "w0", 10), (1, 1, "w8", 10), (1, 2, "w16", 9), (3, 0, "kort", 2)]
    table = "| Date | Budget | Cost % |\n|---|---|---|\n| 2024 | 1 200 | 5% |\nbreak\n| x | 300 | 4 |"
    rows = deep.table_values(spark.createDataFrame([(1, table)], "doc_id long, text string")).collect()
    assert [(r.header, r.text) for r in rows] == [("Budget", "1 200")]
    raw = spark.createDataFrame([(1, 'x {"findings":[{"category":"Navn","text":"Ola"}]} y'), (2, "tull")], "doc_id long, response string")
    assert [(r.doc_id, r.text) for r in deep.parse_answers(raw).collect()] == [(1, "Ola")]


def test_language_and_profile(spark):
    rows = [("Dette er en norsk tekst som ikke er så lang, men den har mange små ord og det er også nok til å se hva den er." , "nb"),
            ("Der Hund und die Katze sind nicht auf dem Dach, sondern sie sind in der Küche und das ist auch gut so für alle.", "de"), ("short", "en")]
    docs = spark.createDataFrame([(t,) for t, _ in rows], "text string").select(language.resolve(F.lit("auto"), F.col("text")).alias("l"))
    assert [r.l for r in docs.collect()] == [x for _, x in rows]
    texts = spark.createDataFrame([("see doi.org/10.1000/1",), ("plain",), ("Fig. 1 et al. results",)], "text string")
    assert [r.p for r in texts.select(language.profile(F.lit("auto"), F.col("text")).alias("p")).collect()] == ["technical", "normal", "technical"]


def test_names(spark):
    docs = spark.createDataFrame([(1, "Møte med Kari Nordmann om Machine Learning. Written by Jane DOE.", False), (2, "As cited in Ola Berg et al. 2019", False)], "doc_id long, text string, technical boolean")
    got = {(r.doc_id, r.text): r.reason for r in names.names(docs).collect()}
    assert got[(1, "Kari Nordmann")] is None and got[(1, "Machine Learning")] == "generisk tittel-/fagfrase"
    assert got[(1, "Jane DOE")] is None and got[(2, "Ola Berg")] == "referanse-, sted- eller fagkontekst"


def test_changes_and_alerts(spark):
    looks = spark.createDataFrame([("/a", 1.0, 5, 1), ("/a", 1.0, 5, 2), ("/a", 2.0, 5, 3), ("/b", 1.0, 1, 3), ("/~$x", 1.0, 1, 3)], "path string, mtime double, size long, look long")
    assert sorted((r.path, r.look) for r in watch.changes(looks).collect()) == [("/a", 1), ("/a", 3), ("/b", 3)]


def test_clients_and_the_missing_model(spark):
    docs = spark.createDataFrame([(1, "Møte hos ACME i dag, acmex ikke"), (2, None)], "doc_id long, text string")
    found, _ = engine.scan(docs, engine.Options(language="nb", only=("email",), clients=["Acme"], names=True))
    assert {(r.doc_id, r.category, r.text) for r in found.collect()} == {(1, "kundenavn", "ACME"), (1, "⚠ NER ikke tilgjengelig", "no name model"), (2, "⚠ NER ikke tilgjengelig", "no name model")}


def test_model_findings_are_refined(spark):
    docs = spark.createDataFrame([(1, "Skriv til ola@firma.no eller ring 22 33 44 55. Hemmelig sak.")], "doc_id long, text string")
    ai = spark.createDataFrame([(1, 0, "Epost", "OLA@firma.no", "", "high"), (1, 1, "epost", "ola@firma.no", "", "high"), (1, 2, "Epost", "Skriv til", "", "high"), (1, 3, "Telefon", "22334455", "", "low"),
                               (1, 4, "Navn", "Kari", "", "high"), (1, 5, "Telefon", "22 33 44 55", "", None)], "doc_id long, ord int, category string, text string, context string, confidence string")
    allowed = spark.createDataFrame([("22 33 44 55",)], "value string")
    got = {(r.category, r.text, r.severity) for r in deep.refine(ai, docs, "medium", allowed, ["hemmelig"]).collect()}
    assert got == {("🤖 E-post", "OLA@firma.no", "gul"), ("🤖 Telefonnummer", "22 33 44 55", "grønn"), ("🤖 Blacklist", "Hemmelig", "rød")}


def test_summaries(spark):
    results = spark.createDataFrame([("a", 1, 2, "success"), ("a", 3, 1, "failed"), ("b", 0, 0, "success")], "zip string, risk_ord int, finding_count long, scan_status string")
    assert {(r.zip, r.risk_ord, r.n_files, r.scan_status) for r in batch.archive_summary(results).collect()} == {("a", 3, 2, "partial"), ("b", 0, 1, "success")}
    checked = spark.createDataFrame([(1, "x", "removed"), (1, "y", "remaining"), (2, "z", "removed")], "doc_id long, target string, status string")
    assert {(r.doc_id, r.removed, r.passed) for r in batch.redaction_audit(checked).collect()} == {(1, 1, False), (2, 1, True)}
    payloads = ['{"value": [{"sensitivityLabel": {"id": "7", "displayName": "Confidential"}}, {"labelId": "7", "name": "Again"}]}', '{"id": "1", "name": "budget.docx"}', None, "no {json", "[" * 100_000]
    rows = spark.createDataFrame(list(enumerate(payloads)), "doc_id long, payload string")
    assert [(r.doc_id, r.ord, r.id, r.name) for r in batch.labels(rows).collect()] == [(0, 0, "7", "Confidential")]
    alerts = spark.createDataFrame([(1, "a"), (3, "b")], "timestamp long, f string")
    assert [r.f for r in batch.merge_alerts(alerts, alerts.where("timestamp = 1"), n=2).collect()] == ["b", "a"]


def test_tables_say_what_their_rows_say():
    assert extract.table_lines([["Item", "Amount"], ["", ""]]) == "Item | Amount"
    assert extract.table_lines([["a", "b", "c"], [""], ["d"]]) == "a | b | c\n--- | --- | ---\nd |  | "
    assert extract.table_lines([]) == extract.table_lines([["", ""]]) == ""
