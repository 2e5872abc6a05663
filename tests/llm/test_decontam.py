import hashlib
import random
import re

import pytest

from lakescreen.llm import decontam

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def brute(docs, bench):
    items = [(str(i), WORD.findall(lowered(t))) for i, t in bench]
    out = []
    for doc_id, text in docs:
        words, hit, named = WORD.findall(lowered(text)), set(), set()
        for name, item in items:
            size = min(13, len(item))
            windows = {tuple(item[k : k + size]) for k in range(len(item) - size + 1)} if size else set()
            for k in range(len(words) - size + 1) if size else ():
                if tuple(words[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    named.add(name)
        sha = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(named), sha, len(hit) > 0 and 20 * len(hit) >= len(words)))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(5)
    vocab = ["a", "B", "c1", "ü", "dd", "extraordinarily", "naïveté", "x" * 40]
    say = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    bench = [(k, say(rng.choice([1, 3, 12, 13, 14, 20, 40])) if k > 2 else say(20)) for k in range(12)]
    bench += [(40, None), (41, "..."), (3, say(30)), (42, bench[4][1])]
    docs = [(0, None), (1, ""), (2, "!?"), (3, bench[5][1]), (3, bench[5][1]), (None, say(5))]
    for k in range(10, 60):
        item = bench[rng.randrange(12)][1]
        docs.append((k, say(rng.randrange(200)) + rng.choice(["", item, item[3:], item.upper()]) + " " + say(rng.randrange(200))))
    return docs, [b for b in bench if b[1] is None or len(WORD.findall(lowered(b[1]))) != 1 or b[0] > 9]


@pytest.mark.parametrize("block", [16_000_000, 300])
def test_equals_brute_force(spark, block):
    docs, bench = cases()
    frame = spark.createDataFrame([(*d, "s") for d in docs], "doc_id long, text string, n_hit string")
    found = decontam.contamination(frame, spark.createDataFrame(bench, "item_id long, text string"), block_chars=block)
    rows = [tuple(r)[:6] for r in found.collect()]
    assert sorted(rows, key=repr) == brute(docs, bench)


def test_matches_are_longest(spark):
    item = " ".join(f"w{k}" for k in range(30))
    text = "start " + " ".join(f"w{k}" for k in range(5, 25)) + " end"
    found = decontam.contamination(
        spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    ).first()
    assert [tuple(m) for m in found.matches] == [(1, 20, "7", 5)]


@pytest.mark.parametrize("block", [16_000_000, 40])
def test_removal_keeps_clean_rows_and_columns(spark, block):
    item = " ".join(f"w{k}" for k in range(13))
    docs = spark.createDataFrame([(1, "x " + item, 9), (2, "w1 w2 w3", 9), (None, None, None)], "doc_id long, text string, words int")
    bench = spark.createDataFrame([(1, item), (2, "other text of some words")], "item_id long, text string")
    kept = decontam.decontaminate(docs, bench, block_chars=block)
    assert kept.columns == docs.columns
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, docs.where("doc_id = 2 or doc_id is null").collect()))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(docs, bench).first().contaminated is False
    assert decontam.contamination(docs.limit(0), bench).count() == 0
    assert decontam.decontaminate(docs, bench).count() == 1


@pytest.mark.parametrize("block", [16_000_000, 40])
def test_removal_goes_by_row_not_by_id(spark, block):
    item = " ".join(f"w{k}" for k in range(13))
    other = "other text of some words that are not said anywhere else here"
    rows = [(1, f"x {item}"), (1, "clean"), (1, None), (None, f"{other} y"), (None, "clean too"), (None, None), (None, "clean too"), (2, f"x {item}"), (2, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, other)], "item_id long, text string")
    kept = [tuple(r) for r in decontam.decontaminate(docs, bench, block_chars=block).collect()]
    assert sorted(kept, key=repr) == sorted((r for r in rows if item not in (r[1] or "") and other not in (r[1] or "")), key=repr)


def test_blocks_are_bounded_and_whole(spark):
    items = [(k % 50, f"{k % 60} " + "word " * (k % 9)) for k in range(240)] + [(7, "same text of one item")] * 200 + [(8, None)]
    dealt, blocks = decontam._dealt(spark.createDataFrame(items, "item_id long, text string"), 300)
    got = [decontam._block(dealt, b) for b in blocks]
    assert len(got) > 5 and all(sum(len(t) for _, t in b) <= 300 + max(len(t) for _, t in items if t) for b in got)
    assert sorted(i for b in got for i in b) == sorted({(str(k), t) for k, t in items if t})


def test_one_block_at_a_time_is_held(spark, monkeypatch):
    log, build, block = [], decontam.build_index, decontam._block
    monkeypatch.setattr(decontam, "_block", lambda *a: log.append("brought") or block(*a))
    monkeypatch.setattr(decontam, "build_index", lambda *a: log.append("used") or build(*a))
    docs, bench = cases()
    decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), block_chars=300)
    assert len(log) > 4 and log == ["brought", "used"] * (len(log) // 2)


def longest(words, items):
    """The longest match at each word that begins a window, but those inside another: (word, length, its places)."""
    out = {}
    for p in range(len(words)):
        for name, item in items:
            size = min(13, len(item))
            for q in range(len(item)):
                n = 0
                while p + n < len(words) and q + n < len(item) and words[p + n] == item[q + n]:
                    n += 1
                if size and n >= size:
                    out.setdefault(p, {}).setdefault(n, set()).add((name, q))
    best = {p: max(by) for p, by in out.items()}
    return {(p, n): out[p][n] for p, n in best.items() if best.get(p - 1, 0) - 1 < n}


def test_longest_matches_equal_brute_force(spark):
    docs, bench = cases()
    docs += [(90, "go " * 60), (91, "x go go go " * 9), (92, docs[20][1] + " " + docs[21][1])]
    bench += [(60, "go " * 40), (61, "go go go x go go go x go go go x go go go")]
    items = [(str(i), WORD.findall(lowered(t))) for i, t in bench]
    found = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    texts = {d: t for d, t in docs if d is not None and d != 3}
    some = 0
    for r in found.where("doc_id is not null and doc_id <> 3").collect():
        want = longest(WORD.findall(lowered(texts[r.doc_id])), items)
        got = {(m.doc_word, m.n_words): (m.item_id, m.item_word) for m in r.matches}
        assert set(got) == set(want), r.doc_id
        assert all(got[k] in want[k] for k in got)
        some += len(got)
    assert some > 30


def test_repeated_words_stay_small():
    import tracemalloc

    import numpy as np
    import pyarrow as pa
    from lakescreen.llm.wordarray import split, text_bytes

    index = decontam.build_index([("a", "go " * 200_000), ("b", "we go on " * 20)])
    words = split(*text_bytes(pa.array(["go " * 200_000, "we go on " * 10])), decontam.IS_WORD)
    tracemalloc.start()
    hits = decontam.search(words, index, decontam._maybe(index))
    assert tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()
    assert len(hits.words) == 200_030 and hits.items[0].tolist() == [0] and hits.items[1].tolist() == [1]
    assert hits.runs == [(0, 200_000, 0), (200_000, 30, hits.runs[1][2])] and np.isin(hits.runs[1][2], 200_000 + np.arange(60))
