"""The pipeline's rows against a plain version of its stages."""

import hashlib
import math
import random

import corpus_pipeline
import pyarrow as pa
import pyarrow.parquet as pq
from lakescreen.llm import mixing, tokenbin, toxicity
from test_decontam import brute as contaminated
from test_llm_operators import level, print_of, union


def tables(folder):
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice(["red", "green", "blue", "grey", "pink"]) + str(rng.randrange(90)) for _ in range(n))
    items = [say(20) for _ in range(4)]
    texts = []
    for k in range(240):
        text = say(rng.randrange(5, 90))
        if k % 6 == 0:
            text += f" what an {rng.choice(['idiot', 'moron'])} " + say(4)
        if k % 11 == 0:
            text += " " + items[k % 4]
        texts.append(text)
    texts += [texts[1], texts[2] + " ", None, "", "", texts[3]]
    docs = {"doc_id": list(range(len(texts))), "text": texts, "lang": ["en"] * len(texts), "source": [f"s{k % 3}" if k % 7 else None for k in range(len(texts))], "n_chars": [len(t or "") for t in texts]}
    pq.write_table(pa.table(docs), f"{folder}/documents.parquet")
    pq.write_table(pa.table({"doc_id": list(range(240)), "quality": [0] * 240, "toxic": [int(k % 6 == 0) for k in range(240)]}), f"{folder}/labels.parquet")
    pq.write_table(pa.table({"item_id": list(range(4)), "text": items}), f"{folder}/benchmark.parquet")
    return [dict(zip(docs, row, strict=True)) for row in zip(*docs.values(), strict=True)], list(enumerate(items))


def unit(said):
    """A number below 1 by a string's MD5."""
    return int(hashlib.md5(said.encode()).hexdigest()[:13], 16) / 2**52


def drawn(docs, source, fraction, seed="mix"):
    """Of a source's documents (doc_id, text, words) those that get another copy: from the largest sizes on, by plain sums."""
    classes = {}
    for doc, text, n in docs:
        shift = max(n.bit_length() - 7, 0)
        classes.setdefault(n >> shift << shift, []).append((unit(f"{seed}:{doc}:{hashlib.md5((text or '').encode()).hexdigest()}"), doc, n))
    total, seen, took, out = float(sum(n for *_, n in docs)), 0.0, 0.0, set()
    for c in sorted(classes, reverse=True):
        own = sorted(classes[c])
        w, u = float(sum(n for *_, n in own)), unit(f"{seed}:{'=' + source if source is not None else ''}:{c}")
        seen += w
        if c == 0:
            k = math.floor(fraction * len(own) + u)
        else:
            mean = w / len(own)
            most, least = math.floor((fraction * total - took) / mean), math.ceil((fraction * total - took - (total - seen)) / mean)
            k = math.floor((fraction * seen - took) / mean + u)
            k = k if least > most else min(most, max(least, k))
            k = min(len(own), max(0, k))
            took += k * mean
        out |= {doc for _, doc, _ in own[:k]}
    return out


def test_pipeline_equals_its_stages(spark, tmp_path):
    rows, items = tables(str(tmp_path))
    sf = str(tmp_path)
    ordered = corpus_pipeline.run(spark, sf).collect()

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    score = toxicity.score_texts(model, pa.array([r["text"] for r in rows], pa.string()))
    rows = [r for r, s in zip(rows, score, strict=True) if s < toxicity.THRESHOLD]
    assert 30 < 246 - len(rows) < 50

    prints = [print_of(r["text"]) for r in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    comp = union(len(rows), near)
    rows = [r for i, r in enumerate(rows) if comp[i] == i]

    bad = {r[0] for r in contaminated([(r["doc_id"], r["text"]) for r in rows], items) if r[5]}
    assert bad
    rows = [r for r in rows if r["doc_id"] not in bad]

    words = {r["doc_id"]: len((r["text"] or "").split()) for r in rows}
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + words[r["doc_id"]]
    targets = level(sizes, mixing.WEIGHTS)
    rates = {s: min(3.0, targets[s] / n) for s, n in sizes.items()}
    more = {s: drawn([(r["doc_id"], r["text"], words[r["doc_id"]]) for r in rows if r["source"] == s], s, rate - int(rate)) for s, rate in rates.items()}
    want = {r["doc_id"]: n for r in rows if (n := int(rates[r["source"]]) + (r["doc_id"] in more[r["source"]]))}

    tokenizer = tokenbin.Tokenizer(tokenbin.vocabulary())
    of = {r["doc_id"]: len(tokenizer.encode(r["text"] or "")) // 2 + 1 for r in rows}
    assert sum(r.n_tokens for r in ordered) == sum(n * of[d] for d, n in want.items())
    assert {d for r in ordered for d in r.doc_ids} == set(want)
    assert sorted(r.slot for r in ordered) == list(range(len(ordered)))


def test_stages_keep_the_columns(spark, tmp_path):
    tables(str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0
