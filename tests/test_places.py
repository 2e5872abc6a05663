"""Places of matches, told without compiling a pattern for each text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lakescreen.functions import rx


@pytest.mark.parametrize("pattern", [r"a+b?", r"(?<=x)b|ab", r"b$", r"(a)(x)?\b", "[^a]x"])
def test_places_are_those_of_a_plain_search(spark, pattern):
    r = random.Random(7)
    texts = ["", *("".join(r.choice("aabx \n\r\U0001f600é") for _ in range(r.randrange(40))) for _ in range(300))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    java = "(?mU)" + pattern if "$" in pattern else "(?U)" + pattern
    told = rows.select("id", F.expr(rx.offsets_sql("text", java)).alias("s"), rx.offsets(F.col("text"), java).alias("o"), F.expr(rx.offsets_sql("text", java, may_be_empty=True)).alias("e")).collect()
    for row in told:
        assert row.s == row.o == row.e
        if "$" not in pattern:  # line ends differ
            assert [(o.start, o.end, o.m) for o in row.o] == [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, texts[row.id])]


def test_fixed_patterns_are_not_compiled_for_each_text():
    assert "split(" not in rx.offsets_sql("text", "a+") and "split(" in rx.hits_sql("text", "a*")
