"""Draws of the mix: near each source's target, by class, whatever holds most of a source."""

import random

import pytest
from pyspark.sql import functions as F

from lakescreen.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def off(spark, rows, **more):
    """By source: taken words less target, and sizes."""
    out = {}
    for r in mixing.plan(spark.createDataFrame(rows, SCHEMA).repartition(3), **more).collect():
        s = out.setdefault(r.source, [-r.target, []])
        s[0] += r.taken
        s[1].append(r.size)
        assert r.taken <= 3 * r.size and r.taken == r.size * r.copies
    return out


@pytest.mark.parametrize("seed", ["mix", "a", "b"])
def test_taken_words_come_to_the_target(spark, seed):
    rng = random.Random(seed)
    sizes = {"even": [100] * 300, "huge": [30_000, *(rng.randrange(1, 60) for _ in range(600))], "two": [9000, 8000, *[3] * 400], "few": [50, 60, 70], "many": [rng.randrange(400) for _ in range(900)], None: [7, 7, 7, 0, 1, 1]}
    rows = [(k, "w " * n, s) for k, (s, n) in enumerate((s, n) for s, of in sizes.items() for n in of)]
    for s, (distance, own) in off(spark, rows, seed=seed).items():
        # What the smallest documents cannot make up for is left.
        assert abs(distance) <= max(min(own), 3 * sorted(own)[len(own) // 3]), s


def test_one_document_holds_a_source(spark):
    got = off(spark, [(1, "w " * 100_000, "a"), *((k, "w " * 10, "b") for k in range(2, 4000))])
    assert abs(got["a"][0]) <= 100_000 and abs(got["b"][0]) <= 10


def test_equal_rows_draw_alike_and_others_apart(spark):
    rows = [(k % 50, "same text", "a") for k in range(200)] + [(None, f"t {k}", "b") for k in range(400)] + [(None, None, None), (7, "", "a")]
    docs = spark.createDataFrame(rows, SCHEMA)
    plan = mixing.plan(docs).collect()
    assert docs.where("source = 'b'").select(mixing.draw()).distinct().count() == 400
    by = {}
    for r in plan:
        by.setdefault((r.source, r.doc_id, r.size), set()).add(r.copies)
    assert all(len(v) == 1 for (s, *_), v in by.items() if s == "a")


def test_of_a_class_the_smallest_hashes_are_drawn(spark):
    rows = [(k, "w " * (100 + k % 2), "a") for k in range(3000)] + [(k, "w", "b") for k in range(3000, 5000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    sizes = docs.select("doc_id", "source", mixing.words().alias("size"), mixing.draw().alias("drawn")).cache()
    by = mixing.targets(sizes)
    classes = sizes.groupBy("source", mixing.size_class().alias("class")).agg(F.count("*").alias("n"), F.sum("size").alias("w"))
    classes = classes.join(by.select("source", (F.col("rate") - F.floor("rate")).alias("fraction")), "source")
    k = {(r.source, r["class"]): r.k for r in mixing.draws(classes).collect()}
    upto = {(r.of, r["class"]): r.most for r in mixing.thresholds(sizes, by).collect()}
    drawn = {}
    for r in sizes.select("source", mixing.size_class().alias("c"), "drawn").collect():
        drawn.setdefault((r.source, r.c), []).append(r.drawn)
    assert any(0 < n < len(drawn[c]) for c, n in k.items()) and set(upto) == {c for c, n in k.items() if n}
    assert all(sorted(drawn[c])[k[c] - 1] == most for c, most in upto.items())


def test_sizes_of_a_class_are_nearly_equal(spark):
    rows = spark.range(1, 40_000).selectExpr("id as size").select("size", mixing.size_class().alias("c")).collect()
    assert all(r.c <= r.size < r.c * (1 + 1 / 63) for r in rows) and len({r.c for r in rows}) < 64 * 16
