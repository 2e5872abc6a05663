"""The graph against brute force: recall, scores, exact answers of small tables, copies, odd rows."""

import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from lakescreen.llm import anngraph, queries

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain_score(q, v):
    total = 0.0
    for a, b in zip(q, v, strict=True):
        total += a * b
    return total


def brute(rows, every=20, k=20):
    """Exact answers from (vec_id, vector) rows, vectors of equal length compared."""
    rows = {(i, tuple(map(float, v))) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    out = {}
    for i, q in sorted(rows):
        if i % every == 0:
            best = sorted((-plain_score(q, v), j) for j, v in rows if j != i and len(v) == len(q))[:k]
            out[i] = [(j, -s) for s, j in best]
    return out


def told(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def recall(got, want):
    return sum(len({j for j, _ in got.get(i, [])} & {j for j, _ in w}) for i, w in want.items()) / sum(map(len, want.values()))


@pytest.mark.parametrize("kind", ["sphere", "norms", "clusters", "line"])
def test_recall_over_several_shards(spark, kind):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(3000, 32))
    if kind == "norms":
        v *= np.exp(rng.normal(size=(3000, 1)) * 2)
        v[:3] *= 1e9
        v[3:5] *= 1e-200
    elif kind == "clusters":
        v = v * 0.05 + rng.normal(size=(30, 32))[rng.integers(0, 30, 3000)]
    elif kind == "line":
        v = np.c_[np.arange(3000) / 3000, np.ones((3000, 1)), np.zeros((3000, 30))]
    rows = [(k, r.tolist(), 0) for k, r in enumerate(v)]
    held = anngraph.fit_vectors(spark.createDataFrame(rows, SCHEMA).repartition(4)).cache()
    indexed = anngraph.index(held, 21, shard_nodes=700).cache()
    assert indexed.count() == 3000 and indexed.select("part").distinct().count() > 3
    got = told(anngraph.search(indexed, held.where("vec_id % 20 = 0"), query_rows=40))
    want = brute([r[:2] for r in rows])
    assert set(got) == set(want) and recall(got, want) > 0.95
    assert all(s == plain_score(v[i].tolist(), v[j].tolist()) for i, a in got.items() for j, s in a)
    assert all(a == sorted(a, key=lambda x: (-x[1], x[0])) and len({j for j, _ in a}) == 20 for a in got.values())


def test_copies_odd_rows_and_clashing_columns_are_exact_in_a_small_table(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=4).tolist()) for k in range(60)]
    rows += [(k, [1.0, 2.0, 3.0, 4.0]) for k in range(100, 160)]  # one vector, more often than an answer is long
    rows += [(100, [1.0, 2.0, 3.0, 4.0]), (20, rows[20][1]), (40, [9.0, 9.0, 9.0, 0.0]), (7, [-1.0, 0.5, 0.0, 0.0])]
    rows += [(200 + k, rng.normal(size=3).tolist()) for k in range(5)] + [(220, [-0.0, 0.0, 1.0]), (221, [0.0, -0.0, 1.0])]
    rows += [(300, None), (320, [0.0] * 4), (340, [1.0, None, 1.0, 1.0]), (360, [math.nan] * 4), (380, [math.inf] * 4), (400, []), (None, [1.0] * 4)]
    table = spark.createDataFrame([(*r, 0, "x", 1.0) for r in rows], SCHEMA + ", score string, rank double").repartition(3)
    table.write.parquet(str(tmp_path / "embeddings.parquet"))
    df = queries.QUERIES["op12_ann_graph"](spark, str(tmp_path))
    assert [(c, t) for c, t in df.dtypes] == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    got = told(df)
    # A repeated query asks with one of its vectors.
    want = brute(rows)
    both = {i for i, n in {i: len({tuple(v) for j, v in rows if j == i}) for i in want}.items() if n > 1}
    assert both == {40} and {i: a for i, a in got.items() if i != 40} == {i: a for i, a in want.items() if i != 40}
    assert len(got[40]) == 20
    assert 221 in [j for j, _ in got[220]] and len(got[220]) == 6
    assert told(anngraph.op12_digest(spark.createDataFrame([], SCHEMA))) == {}
    assert told(anngraph.op12_digest(spark.createDataFrame([(0, [1.0, 1.0], 0), (1, [2.0, 0.0], 0)], SCHEMA))) == {0: [(1, 2.0)]}


def test_every_node_of_a_graph_is_reached():
    rng = np.random.default_rng(8)
    far = np.vstack([rng.normal(size=(900, 8)), rng.normal(size=(30, 8)) + 100 * np.eye(8)[rng.integers(0, 8, 30)]])
    graph = anngraph.build(far, degree=4, beam=6)
    assert anngraph._reached(graph).all()
    assert all(k not in graph.edges[k] for k in range(len(far)))


def test_pruning_keeps_the_nearest_and_edges_in_other_directions():
    x = np.array([[0, 0], [1, 0], [1.1, 0], [5, 0], [0, 3], [-9, 0]], np.float32)
    got = anngraph.pruned(x, np.array([0]), np.array([[5, 4, 3, 2, 1, 0, 1, -1]]), 4, 1.2)
    assert got.tolist() == [[1, 4, 5, -1]]


def test_recall_on_the_given_vectors(spark):
    folder = "/root/testdata/sf0.01"
    got = told(queries.QUERIES["op12_ann_graph"](spark, folder))
    rows = pq.read_table(f"{folder}/embeddings.parquet").to_pylist()
    assert recall(got, brute([(r["vec_id"], r["embedding"]) for r in rows])) > 0.99
