"""Lists, redacted copies, providers that fail, and streams of alerts on small tables."""

import io
import zipfile
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from lakescreen import engine, worked
from lakescreen.operators import deep, lists, post, redact
from lakescreen.streaming import watch


def test_ignore_lists_are_read_and_merged(spark):
    rows = lists.parse_ignore('[ignore]\nemail_domains = ["Firma.no", " "]\nemails = ["a@b.no"]\nnames = ["Ola Berg"]\n')
    assert rows == [("domain", "Firma.no"), ("email", "a@b.no"), ("name", "Ola Berg")]
    with pytest.raises(ValueError):
        lists.parse_ignore("x=")
    one = spark.createDataFrame(rows, "kind string, value string")
    more = spark.createDataFrame([("email", " a@b.no "), ("email", None), (None, "x"), ("name", "")], "kind string, value string")
    assert sorted(map(tuple, lists.ignore_list(one, more).collect())) == sorted(rows)


def test_lists_are_kept(spark, tmp_path):
    values = spark.createDataFrame([(0, "Acme"), (1, "acme"), (2, "Acme "), (3, ""), (4, None)], "ord int, value string")
    lists.saved(spark, str(tmp_path / "black"), values, case=False)
    lists.saved(spark, str(tmp_path / "white"), values, case=True)
    read = lambda n: {(r.ord, r.value) for r in spark.read.parquet(str(tmp_path / n)).collect()}
    assert read("black") == {(0, "Acme")} and read("white") == {(0, "Acme"), (1, "acme")}


def test_office_files_are_patched_across_runs(spark):
    files = [(1, "a.docx", worked.office(".docx", "Ola Nordmann", "z")), (2, "b.docx", b"no zip"), (3, "c.pdf", b"x"), (4, "d.docx", worked.office(".docx", "Kari", "z")), (5, "e.docx", None)]
    labels = spark.createDataFrame([(1, "Ola Nordmann", "<Person A>"), (2, "x", "y")], "doc_id long, target string, label string")
    got = {r.doc_id: r for r in redact.patch_files(spark.createDataFrame(files, "doc_id long, path string, content binary"), labels).collect()}
    assert "BadZipFile" in got[2].error and got[3].error == "unsupported: .pdf" and got[5].error
    with zipfile.ZipFile(io.BytesIO(bytes(got[1].content))) as z:
        said = z.read("word/document.xml").decode()
    assert "Person A" in said and "Nordmann" not in said
    with zipfile.ZipFile(io.BytesIO(bytes(got[4].content))) as z, zipfile.ZipFile(io.BytesIO(files[3][2])) as was:
        assert z.read("word/document.xml") == was.read("word/document.xml")


def test_values_of_digits_are_replaced_whole():
    assert redact._put("10 av 100, 10", [("10", "<n>"), ("av", "of")]) == "<n> of 100, <n>"
    assert redact._put("Per Hansen og Per", [("Per", "<B>"), ("Per Hansen", "<A>")]) == "<A> og <B>"


def test_audit_log_without_details(spark):
    rows = spark.createDataFrame([(k, f"v{k}", "t", "c") for k in range(130)], "timestamp int, target string, text string, context string")
    assert redact.audit_log(rows).count() == 100
    assert redact.audit_log(rows, details=False).columns == ["timestamp"]


def test_many_terms_are_one_expression(spark):
    docs = spark.createDataFrame([(1, "term7 and TERM70, term"), (2, None)], "doc_id long, text string")
    got = {(r.text, r.start) for r in post.blacklist(docs, [f"term{k}" for k in range(120)]).collect()}
    assert got == {("term7", 0), ("TERM7", 10), ("TERM70", 10)}
    assert post.blacklist(docs, []).count() == 0 and post.clients(docs, []).count() == 0


def test_prompts_without_categories(spark):
    parts = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert deep.prompts(parts, []).count() == 0
    assert [r["pass"] for r in deep.prompts(parts, ["medisinsk"], "sv").collect()] == [0]


def test_raw_matches_in_sql(spark):
    engine.register(spark)
    got = {tuple(r) for r in spark.sql("select * from match_text('mail a@b.no, host 10.1.2.3')").collect()}
    assert ("email", "a@b.no") in got and ("ipv4", "10.1.2.3") in got


def test_watched_files_are_scanned_and_told(spark, tmp_path):
    schema = "path string, mtime double, size long, look long"
    for k, path in enumerate(("/a-svart", "/b-gul")):
        spark.createDataFrame([(path, 1.0, 5, 2)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stable = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    told = []
    scan = lambda files: files.select(F.col("look").alias("timestamp"), "path", F.regexp_extract("path", "-(.*)", 1).alias("risk_level"), F.lit(1).alias("finding_count"))
    running = watch.scan_changes(stable, scan, str(tmp_path / "history"), lambda severe: told.extend(r.path for r in severe.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
    running.processAllAvailable()
    running.stop()
    assert told == ["/a-svart"]
    assert {r.path for r in spark.read.parquet(str(tmp_path / "history")).collect()} == {"/a-svart", "/b-gul"}
    with pytest.raises(ValueError):
        watch.watch_all(spark, ["a", "b", "c", "d"])
