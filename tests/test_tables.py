"""Amounts in tables, read line by line in their row."""

from lakescreen.operators import deep


def test_table_values_read_lines_in_their_row(spark):
    lines = ["| Item | Cost |", "| a | 3000 |", "| --- | --- |", "| b | 3100 |", "| Amount | x |", "| 3200 | 3300 |", "no bar", "| c | 3400 |", "| Price | Cost |", "| 3500 | 3600 |"]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (1, "\n".join(lines[:2])), (2, None), (3, "|")], "doc_id long, text string")
    found = deep.table_values(docs)
    assert sorted((r.doc_id, r.ord, r.header, r.text) for r in found.collect()) == [
        (1, 1_000_001, "Cost", "3000"), (1, 3_000_001, "Cost", "3100"), (1, 5_000_000, "Amount", "3200"), (1, 9_000_000, "Price", "3500"), (1, 9_000_001, "Cost", "3600"),
    ]
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
