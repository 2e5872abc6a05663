import hashlib
import os
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from lakescreen.llm import tokenbin as T
from lakescreen.llm import tokencount as C

TEXTS = [
    "", None, "Hello world, it's  two spaces", " lead", "trail ", "a\n b \n\n  c\tд ж x", "naïve café 1234567 word " * 300, "x" * 5000,
    "line one.\nLine two.\n\n\n  Indented.   wide", "  ", "\n \n", "a  ", "tab\t tab", "don't can't I'm we'll", "a\r\n b",
]


def whole():
    return T.Tokenizer(T.vocabulary())


@pytest.mark.parametrize("text", [t for t in TEXTS if t])
def test_pieces_encode_as_the_whole(text):
    t = whole()
    for _ in range(2):  # the second time from memory
        assert np.frombuffer(t.encode(text), T.ID).tolist() == t.encoding.encode_ordinary(text)
    assert t.decode(t.encode(text)) == text


@pytest.mark.parametrize("remembered", [0, 3, 1000])
def test_many_texts_encode_as_each(remembered):
    rng, t = random.Random(4), T.Tokenizer(T.vocabulary(), remembered)
    parts = ["a", "Bc", " ", "  ", "\n", "\t", "é", "12", "'s", "-", "\u2003", "\u3000", "\u1680", "\u205f", "\u00a0", "\u0085", "\x1c", "\r", " word", "日本", "x" * 50]
    for _ in range(60):
        texts = [rng.choice([None, ""]) if rng.random() < 0.2 else "".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(rng.randrange(8))]
        ids, n = t.encode_all(pa.array(texts, pa.string()))
        want = [t.encoding.encode_ordinary(x or "") for x in texts]
        assert n.tolist() == [len(w) for w in want]
        assert ids.tolist() == [k for w in want for k in w]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_feistel_is_a_permutation(n):
    slots = T.feistel(np.arange(n), n)
    assert sorted(slots.tolist()) == list(range(n))
    assert T.feistel(slots, n, inverse=True).tolist() == list(range(n))
    if n > 60:
        assert (slots != T.feistel(np.arange(n), n, key=1)).any()


def brute(spark, rows, length):
    """Each slot's ids, tokens and doc_ids, from the stream of all ids."""
    t = whole()
    docs = spark.createDataFrame([(d, x, n) for n, (d, x) in enumerate(rows)], "doc_id long, text string, row int")
    order = docs.selectExpr("row", "doc_id", "xxhash64(text) as t", f"pmod(xxhash64(doc_id, xxhash64(text)), {T.BUCKETS}) as bucket").collect()
    order.sort(key=lambda r: (r.bucket, r.doc_id is not None, r.doc_id or 0, r.t))
    ids, owner = [], []
    for r in order:
        mine = [*t.encoding.encode_ordinary(rows[r.row][1] or ""), T.END]
        ids += mine
        owner += [(r.row, r.doc_id)] * len(mine)
    n = -(-len(ids) // length)
    out = {}
    for k, slot in enumerate(T.feistel(np.arange(n), n).tolist()):
        part = ids[k * length : (k + 1) * length]
        who = list(dict.fromkeys(owner[k * length : (k + 1) * length]))
        out[slot] = (len(part), [d for _, d in who], np.array(part + [T.END] * (length - len(part)), T.ID).tobytes())
    return out


@pytest.mark.parametrize("files", [1, 3, 9])
def test_order_is_that_of_the_documents(spark, tmp_path, files):
    """The same slots however the documents are split, equal to a plain version byte for byte."""
    rows = [(k if k != 4 else None, t) for k, t in enumerate(TEXTS + TEXTS[:3])] + [(5, TEXTS[5]), (5, "other"), (None, None), (None, None), (70, "long text " * 4000)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, slot int").repartition(files)
    docs.write.parquet(str(tmp_path / "docs"))
    want = brute(spark, rows, 16)
    assert len(want) > 200
    for frame in (spark.read.parquet(str(tmp_path / "docs")), docs):
        got = T.training_order(frame, length=16, shard_rows=8).collect()
        assert all(r.byte_offset == r.slot % 8 * 32 and r.shard == r.slot // 8 for r in got)
        assert len(got) == len(want)
        assert {r.slot: (r.n_tokens, r.doc_ids, bytes(r.ids)) for r in got} == want


def test_round_trip_and_resumption(spark, tmp_path):
    rows = list(enumerate(TEXTS + TEXTS[:3]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(spark, rows, 16)
    for folder in (str(tmp_path / "a"), f"file:{tmp_path}/b", f"file://{tmp_path}/c"):
        told = T.write_shards(docs, folder, length=16, shard_rows=8).collect()
        assert sum(m.n_sequences for m in told) == len(want)
        assert sum(m.n_bytes for m in told) == 32 * len(want)
        got = [x.tobytes() for x in T.read_from(folder, 5, shard_rows=8, length=16)]
        assert got == [want[k][2] for k in range(5, len(want))]


def test_tasks_of_several_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "MOST_TASKS", 3)
    rows = list(enumerate(TEXTS))
    want = brute(spark, rows, 16)
    T.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path), length=16, shard_rows=4).collect()
    assert [x.tobytes() for x in T.read_from(str(tmp_path), 0, shard_rows=4, length=16)] == [want[k][2] for k in range(len(want))]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert T.training_order(docs).count() == 0


def test_edits_count_as_the_edited_text():
    t = whole()
    cases = [
        ("one two three four", [(4, 7, "2"), (8, 13, "")]),
        ("one two three four", [(0, 0, " x "), (18, 18, "  tail")]),
        ("a b", [(1, 2, "")]),
        ("a  b \n c", [(2, 3, "zz"), (5, 6, "\n\n")]),
        ("", [(0, 0, "new text")]),
        ("word " * 1000, [(k * 5, k * 5 + 4, "longer phrase") for k in range(0, 1000, 37)]),
    ]
    for text, edits in cases:
        tree = C.Tree.of(t, text)
        before = tree.total()
        assert before == len(t.encoding.encode_ordinary(text))
        tree.apply(edits)
        edited, at = [], 0
        for a, b, new in edits:
            edited += [text[at:a], new]
            at = b
        edited = "".join([*edited, text[at:]])
        assert tree.text() == edited
        assert tree.total() == len(t.encoding.encode_ordinary(edited)), (text[:20], edits)


def depth(node):
    return 0 if node.left is None else 1 + max(depth(node.left), depth(node.right))


@pytest.mark.parametrize("seed", range(40))
def test_any_edits_count_as_the_edited_text(seed):
    rng, t = random.Random(seed), whole()
    say = lambda n: "".join(rng.choice(["a", "Bc", " ", "  ", "\n", "\t", "é", "12", "'s", "-", "\u2003", "\x1c", " word"]) for _ in range(n))
    text = say(rng.choice([0, 5, 60, 900]))
    tree = C.Tree.of(t, text)
    for _ in range(4):
        at, edits = 0, []
        while at < len(text):
            a = at + rng.choice([0, 0, 1, 3, 40])
            b = a + rng.choice([0, 1, 2, 30])
            if b > len(text):
                break
            edits.append((a, b, say(rng.choice([0, 0, 1, 5]))))
            at = b + (a == b)
        tree.apply(edits)
        text = C.edited(text, edits)
        assert tree.text() == text
        assert tree.total() == len(t.encoding.encode_ordinary(text))
        assert not tree.root or depth(tree.root) <= 3 * np.log2(tree.root.leaves + 1) + 2


@pytest.mark.parametrize("make", [
    lambda n: [(k * 40, k * 40 + 1, "Y") for k in range(n)],
    lambda n: [(k * 5 + 4, k * 5 + 5, "") for k in range(n)],  # every space goes: all becomes one pre-token
    lambda n: [(k * 5 + 3, k * 5 + 4, " ") for k in range(n)],  # every word ends in blanks
    lambda n: [(k * 80 + 79, k * 80 + 80, "") for k in range(n // 2)],
])
def test_encoded_again_is_linear_in_edits(make):
    text, t = "word " * 200_000, whole()
    for n in (1, 100, 5000):
        tree, edits = C.Tree.of(t, text), make(n)
        tree.apply(edits)
        assert tree.encoded <= sum(4 * 5 * C.LEAF + len(new) for _, _, new in edits)
        assert tree.encoded <= 2 * len(text)
        assert tree.text() == C.edited(text, edits)
        tree.apply([(len(tree.text()) // 2 // 5 * 5, len(tree.text()) // 2 // 5 * 5 + 1, "z")])


def test_counts_of_rows(spark):
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate([*TEXTS, "mail a.b@c.de and 10.0.0.1 now", "same", "same"])], "doc_id long, text string, n_tokens int")
    t = whole()
    for r in C.counts(docs).collect():
        text = ([*TEXTS, "mail a.b@c.de and 10.0.0.1 now", "same", "same"][r.doc_id]) or ""
        assert r.n_tokens == len(t.encoding.encode_ordinary(text))
        edited = C.edited(text, C.mask_edits(text))
        assert r.n_tokens_edited == len(t.encoding.encode_ordinary(edited))
        assert (r.n_edits > 0) == (edited != text)
    assert C.counts(docs.limit(0)).count() == 0


def test_queries_write_their_shards(spark, tmp_path, monkeypatch):
    import corpus_pipeline
    from lakescreen.llm import queries

    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for k, run in enumerate([lambda: queries.op4_token_binary(spark, str(tmp_path)), lambda: corpus_pipeline.STAGES[-1][1](spark, docs, "")]):
        monkeypatch.setattr(T, "shared_dir", lambda _, k=k: str(tmp_path / f"shared{k}"))
        by_slot = {r.slot: r.ids_md5 for r in run().collect()}
        (folder,) = (f for f in (tmp_path / f"shared{k}").iterdir() if f.name.startswith("shards"))
        want = brute(spark, list(enumerate(TEXTS)), T.LENGTH)
        assert [x.tobytes() for x in T.read_from(str(folder), 0)] == [want[n][2] for n in range(len(want))]
        assert by_slot == {n: hashlib.md5(w[2]).hexdigest() for n, w in want.items()}
        assert all(f.name.startswith("shard-") for f in folder.iterdir())


def test_shards_are_whole_whatever_is_read_of_the_rows(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"document {k} " * (k % 9 + 1)) for k in range(200)], "doc_id long, text string").repartition(3)
    want, some = str(tmp_path / "all"), str(tmp_path / "some")
    n = T.sharded(docs, want, length=16, shard_rows=8).count()
    rows = T.sharded(docs, some, length=16, shard_rows=8)
    names = sorted(os.listdir(some))
    assert names == sorted(os.listdir(want)) and len(names) == -(-n // 8)
    before = {x: os.stat(f"{some}/{x}").st_mtime_ns for x in names}
    assert len(rows.limit(1).collect()) == 1 and rows.select("slot").count() == n
    assert {x: os.stat(f"{some}/{x}").st_mtime_ns for x in names} == before
    assert all(open(f"{some}/{x}", "rb").read() == open(f"{want}/{x}", "rb").read() for x in names)
