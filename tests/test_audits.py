"""The log of redacted copies: entries are put, replaced and kept to the last."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lakescreen import engine
from lakescreen.operators import audits


@pytest.fixture
def scan():
    return lambda docs: engine.scan(docs, engine.Options(language="nb", only=("email",)))[0]


def entry(k, details=True, values=("Ola Nordmann", "ola@firma.no", "OLA NORDMANN", " ")):
    return (f"id{k}", datetime(2024, 1, 1, 0, k % 60, k // 60), f"/c/{k}", details, [("navn", v) for v in values], None)


def test_a_copy_is_checked_again_and_its_entry_replaced(spark, tmp_path, scan):
    folder = str(tmp_path / "log")
    assert audits.last(spark, folder).count() == 0
    rows = spark.createDataFrame([entry(k, details=k != 2) for k in range(5)], audits.ENTRY)
    copies = lambda *of: spark.createDataFrame(list(of), "path string, text string, error string")
    first = copies(("/c/0", "rent", None), ("/c/1", "kontakt ola@ firma.no", None), ("/c/2", "Ola Nordmann", None), ("/c/3", None, "BadZipFile"), ("/c/9", "x", None))
    audits.put(spark, folder, audits.verified(rows, first, scan, F.lit(datetime(2024, 2, 1))))
    told = lambda: {r.id: (r.verification.status, r.verification.removed, r.verification.remaining, r.verification.error) for r in audits.last(spark, folder).collect()}
    assert told() == {"id0": ("passed", 2, 0, None), "id1": ("needs_review", 1, 1, None), "id2": ("needs_review", 1, 1, None), "id3": ("error", None, None, "BadZipFile"), "id4": ("error", None, None, audits.GONE)}
    assert {r.id: len(r.selected) for r in audits.last(spark, folder).collect()} == {"id0": 4, "id1": 4, "id2": 0, "id3": 4, "id4": 4}
    again = copies(("/c/0", "ny adresse kari@firma.no", None), ("/c/1", "rent", None), ("/c/2", "Ola Nordmann", None))
    ids = spark.createDataFrame([("id0",), ("id1",), ("id2",), ("id4",), ("none",), ("id1",)], "id string")
    for _ in range(2):  # twice is once
        audits.refresh(spark, folder, ids, again, scan)
        assert told() == {"id0": ("needs_review", 2, 0, None), "id1": ("passed", 2, 0, None), "id2": ("passed", 0, 0, None), "id3": ("error", None, None, "BadZipFile"), "id4": ("error", None, None, audits.GONE)}
    assert audits.entries(spark, folder).count() == 5


def test_the_last_entries_are_kept(spark, tmp_path):
    folder = str(tmp_path / "log")
    for part in (range(0, 90), range(90, 150), range(150, 151)):
        audits.put(spark, folder, spark.createDataFrame([entry(k) for k in part], audits.ENTRY), n=40)
    times = sorted((entry(k)[1], f"id{k}") for k in range(151))[-40:]
    assert [r.id for r in audits.last(spark, folder, 40).collect()] == [i for _, i in reversed(times)]
    assert audits.entries(spark, folder).count() < 151
