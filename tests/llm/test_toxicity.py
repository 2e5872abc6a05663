"""Scores of whole texts by a plain loop over words and windows; learning from long texts; repeated and tied rows."""

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lakescreen.llm import toxicity as X

RNG = random.Random(21)
MILD = ["river", "stone", "cloud", "paper", "green", "walking", "slowly", "bread"]


def say(n):
    return " ".join(RNG.choice(MILD) + str(RNG.randrange(30)) for _ in range(n))


def plain_score(model, text):
    """The highest window's score, one word and one state at a time."""
    column = pa.array([text])
    words = X.split(*X.text_bytes(column), X.IS_WORD)
    n, d = len(words.start), X.HIDDEN
    rows = np.arange(n)
    hashes, (ends, buckets), begins = X.hashes(words), X.trigrams(words, rows), X.beginnings(words, rows)
    w = {k: v.astype(float) for k, v in model.w.items()}
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    vocab = {h: k + 1 for k, h in enumerate(model.vocab.tolist())}
    x = []
    for k in range(n):
        own = buckets[ends[k - 1] if k else 0 : ends[k]]
        x.append([*w["word"][vocab.get(int(hashes[k]), 0)], *np.mean([w["char"][b] for b in own], axis=0), max(w["prefix"][b] for b in begins[k])])
    best = -math.inf
    for start in range(0, max(1, n - X.SPAN + X.STEP), X.STEP):
        window = x[start : start + X.SPAN]
        states = [[0.0] * (2 * d) for _ in window]
        for way, order, off in (("f", range(len(window)), 0), ("b", range(len(window) - 1, -1, -1), d)):
            h = [0.0] * d
            for t in order:
                a = [sum(window[t][i] * w[f"x{way}"][i, j] for i in range(len(window[t]))) + w[f"c{way}"][j] for j in range(3 * d)]
                b = [sum(h[i] * w[f"h{way}"][i, j] for i in range(d)) for j in range(3 * d)]
                z, r = [sigmoid(a[j] + b[j]) for j in range(d)], [sigmoid(a[d + j] + b[d + j]) for j in range(d)]
                h = [z[j] * h[j] + (1 - z[j]) * math.tanh(a[2 * d + j] + r[j] * b[2 * d + j]) for j in range(d)]
                states[t][off : off + d] = h
        weigh = [math.exp(sum(math.tanh(v) * u for v, u in zip(s, w["att"], strict=True))) for s in states]
        pooled = [sum(g * s[j] for g, s in zip(weigh, states, strict=True)) / sum(weigh) for j in range(2 * d)]
        best = max(best, sum(p * o for p, o in zip(pooled, w["out"], strict=True)) + w["bias"][0])
    return sigmoid(best)


def test_scores_equal_a_plain_loop():
    texts = [say(RNG.randrange(1, 90)) + (" vermin scum" if k % 3 == 0 else "") for k in range(240)]
    model = X.train(texts, [int(k % 3 == 0) for k in range(240)])
    asked = ["x", "scum", say(23), say(24), say(25), say(36) + " SCUM", say(61), "vermin " + say(47), "é ß 😀 vermins, scum!", "unheardof words only here"]
    got = X.score_texts(model, pa.array(asked))
    assert np.allclose(got, [plain_score(model, t) for t in asked], atol=2e-4) and got.max() > 0.7 > 0.3 > got.min()


def test_long_labelled_texts_are_learnt_from(spark):
    rows = [(k, " vermin scum ".join(say(20) for _ in range(40)) if k % 2 else say(880), k % 2) for k in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y, "x") for k, _, y in rows] + [(k, None, "x") for k in range(3)], "doc_id long, toxic int, text string")
    model = X.learn(docs, labels, chars=3000)
    assert model.constant is None
    got = {r.doc_id: r.predicted for r in X.scores(docs, model).collect()}
    assert sum(got[k] == y for k, _, y in rows) >= 580


def test_pieces_of_a_long_text(spark):
    texts = ["short text", " ".join(f"w{k}" for k in range(4000)), None]
    cut = [r.p for r in spark.createDataFrame([(t,) for t in texts], "text string").select(X.in_pieces(F.col("text"), 1000).alias("p")).collect()]
    assert cut[0] == texts[0] and cut[2] is None and len(cut[1]) <= 1020
    words = cut[1].split()
    assert set(words) <= set(texts[1].split()) and words == sorted(words, key=lambda w: int(w[1:])) and int(words[0][1:]) < 5 and int(words[-1][1:]) > 3990


def test_repeated_and_tied_rows_score_by_their_texts(spark):
    docs = spark.createDataFrame([(1, "scum"), (1, "scum"), (1, "river"), (2, "scum")], "doc_id long, text string")
    model = X.train(["scum"] * 40 + ["river"] * 40, [1] * 40 + [0] * 40)
    got = sorted((r.doc_id, r.score) for r in X.scores(docs, model).collect())
    by = dict(zip(("river", "scum"), X.score_texts(model, pa.array(["river", "scum"])).tolist(), strict=True))
    assert got == [(1, by["river"]), (1, by["scum"]), (1, by["scum"]), (2, by["scum"])]
