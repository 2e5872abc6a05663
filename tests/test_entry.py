"""The driver's contract, with the training-data subpackage and without it."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_sql_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 40


def test_the_rest_imports_without_training_data(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e, bench; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120, check=True)
    n, ops = out.stdout.split()
    assert int(n) > 40 and ops == "False"


def test_flagship(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark)
    assert rows.columns == ["doc_id", "risk_ord", "risk_level", "finding_count"] and rows.count() > 0
