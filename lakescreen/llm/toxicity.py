"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters the network as two inputs: an embedding of the word, if the training sample knows it, and the mean of
hashed embeddings of its character trigrams. Gated recurrences read each window of ``SPAN`` words both ways, attention
pools their states, and a logistic unit scores the window. Windows start every ``STEP`` words, so all words but the last
few are read in two of them; a document's score is that of its highest window.

Labels are of documents, not windows. Training alternates: each toxic training document lends its window that scores
highest so far, each other one its highest and a few at random. The first round scores windows by word log-odds; toxic
documents without a telling window are left out as wrong labels.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, spread
from .wordarray import Words, byte_slices, hashes, split, text_bytes

SPAN, STEP = 24, 12
WORD_DIM, CHAR_DIM, HIDDEN = 6, 6, 8
CHAR_ROWS = 1 << 12
#: Word beginnings of so many bytes are characters' evidence too; their log-odds are kept in so many rows.
PREFIXES, PREFIX_ROWS = range(4, 9), 1 << 18
#: Bounds of the training sample: rows, characters of one document in it, the pieces that a longer one gives, known words.
SAMPLE_ROWS, SAMPLE_CHARS, PIECES, VOCAB = 4000, 20_000, 20, 20_000
#: Rounds of training, passes over a round's windows, least log-odds of a word that tells.
ROUNDS, PASSES, CLEAR = 3, 3, 1.2
THRESHOLD = 0.7
EMPTY = 0.0
#: Windows that the network reads at once.
AT_ONCE = 4096

#: ASCII letters, digits and every byte of other characters.
IS_WORD = np.array([chr(b).isalnum() for b in range(128)] + [True] * 128)


class Model(NamedTuple):
    vocab: np.ndarray  # sorted hashes of known words
    w: dict[str, np.ndarray]
    constant: float | None  # the score of every document, where the sample has labels of one kind only


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def trigrams(words: Words, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word of ``rows``: where its trigrams (with a mark at both ends) end, and their buckets."""
    size = words.size[rows]
    word = np.repeat(np.arange(len(rows)), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    here = words.start[rows][word] + at
    last = at + 1 == size[word]
    a = np.where(at > 0, words.data[here - 1], 1).astype(np.uint32)
    c = np.where(last, 1, words.data[np.minimum(here + 1, len(words.data) - 1)]).astype(np.uint32)
    key = (a << 16 | words.data[here].astype(np.uint32) << 8 | c) * np.uint32(0x9E3779B1)
    return np.cumsum(size), (key >> np.uint32(20)).astype(np.int64) % CHAR_ROWS


def beginnings(words: Words, rows: np.ndarray) -> np.ndarray:
    """(len(rows), len(PREFIXES)) buckets of each word's first bytes; 0 where the word is shorter."""
    view = np.ndarray((len(words.data) - 7,), "<u8", words.data, strides=(1,))
    head, out = view[words.start[rows]], np.zeros((len(rows), len(PREFIXES)), np.int64)
    for k, size in enumerate(PREFIXES):
        key = (head & np.uint64((1 << 8 * size) - 1)) * np.uint64(0x9E3779B97F4A7C15)
        key = (key ^ key >> np.uint64(29)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(46)
        out[:, k] = np.where(words.size[rows] >= size, np.maximum(key, 1), 0)
    return out


def _log_odds(toxic: np.ndarray, df: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What the odds are at least, by two standard errors: what few documents hold shows little."""
    clean = df - toxic
    odds = np.log((toxic + 0.5) / (y.sum() + 1)) - np.log((clean + 0.5) / (len(y) - y.sum() + 1))
    return np.clip(odds - 2 * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5)), -0.5, 5)


def _counts(docs: np.ndarray, what: np.ndarray, n: int, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Toxic documents and documents of each of n things, from rows (document, thing)."""
    seen = np.unique(docs * np.int64(n) + what)
    return np.bincount(seen % n, weights=y[seen // n], minlength=n), np.bincount(seen % n, minlength=n)


def _inputs(w: dict[str, np.ndarray], known: np.ndarray, ends: np.ndarray, buckets: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Of distinct words: the word's embedding, the mean of its trigrams', the most that a beginning tells."""
    told = w["prefix"][begins].max(1)[:, None] if len(begins) else np.zeros((0, 1))
    return np.concatenate([w["word"][known], _mean_rows(w["char"], ends, buckets), told], axis=1).astype(np.float32)


def _mean_rows(table: np.ndarray, ends: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    if not len(ends):
        return np.zeros((0, table.shape[1]), np.float32)
    begins = np.r_[0, ends[:-1]]
    return np.add.reduceat(table[buckets], begins, axis=0) / (ends - begins)[:, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _initial(rng: np.random.Generator, known: int, odds: np.ndarray) -> dict[str, np.ndarray]:
    d, h = WORD_DIM + CHAR_DIM + 1, HIDDEN
    one = lambda *shape, scale=0.3: (rng.standard_normal(shape) * scale).astype(np.float32)
    w = {"word": one(known + 1, WORD_DIM, scale=0.1), "char": one(CHAR_ROWS, CHAR_DIM)}
    w["word"][1:, 0] = odds
    w["word"][0] = 0
    for way in "fb":
        w |= {f"x{way}": one(d, 3 * h), f"h{way}": one(h, 3 * h), f"c{way}": np.zeros(3 * h, np.float32)}
        w[f"c{way}"][:h] = 1.0  # keep the state by default
    return w | {"att": one(2 * h), "out": one(2 * h), "bias": np.full(1, -1.0, np.float32)}


def _read(w: dict[str, np.ndarray], way: str, x: np.ndarray, live: np.ndarray, keep: bool = False):
    """States (T, B, H) of one reading of x (T, B, 3H), which already holds the inputs' share; live: (T, B) flags."""
    steps, rows, _ = x.shape
    h = HIDDEN
    state, out, held = np.zeros((rows, h), np.float32), np.empty((steps, rows, h), np.float32), []
    for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
        part = state @ w[f"h{way}"]
        gates = _sigmoid(x[t, :, : 2 * h] + part[:, : 2 * h])
        z, r = gates[:, :h], gates[:, h:]
        new = np.tanh(x[t, :, 2 * h :] + r * part[:, 2 * h :])
        moved = z * state + (1 - z) * new
        on = live[t][:, None]
        if keep:
            held.append((t, state, z, r, new, part[:, 2 * h :], on))
        state = np.where(on, moved, state)
        out[t] = state
    return out, held


def _pool(w: dict[str, np.ndarray], s: np.ndarray, live: np.ndarray):
    score = np.where(live, np.tanh(s) @ w["att"], np.float32(-1e9))
    a = np.exp(score - score.max(0))
    a *= live
    a /= a.sum(0)
    pooled = np.einsum("tb,tbh->bh", a, s)
    return pooled @ w["out"] + w["bias"][0], pooled, a


def forward(w: dict[str, np.ndarray], of_word: dict[str, np.ndarray], index: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Logits of windows; of_word: each distinct word's share in the gates, index: (T, B) distinct words."""
    s = np.concatenate([_read(w, way, of_word[way][index], live)[0] for way in "fb"], axis=2)
    return _pool(w, s, live)[0]


def _gates(w: dict[str, np.ndarray], x: np.ndarray) -> dict[str, np.ndarray]:
    return {way: (x @ w[f"x{way}"] + w[f"c{way}"]).astype(np.float32) for way in "fb"}


def _backward(w: dict[str, np.ndarray], x: np.ndarray, live: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the mean log loss, and with respect to the inputs x (T, B, D)."""
    h, g = HIDDEN, {}
    read = {way: _read(w, way, x @ w[f"x{way}"] + w[f"c{way}"], live, keep=True) for way in "fb"}
    s = np.concatenate([read["f"][0], read["b"][0]], axis=2)
    logit, pooled, a = _pool(w, s, live)
    d = (_sigmoid(logit) - y) / len(y)
    g["out"], g["bias"] = d @ pooled, np.array([d.sum()], np.float32)
    dp = d[:, None] * w["out"]
    da = np.einsum("bh,tbh->tb", dp, s)
    de = a * (da - (a * da).sum(0))
    th = np.tanh(s)
    g["att"] = np.einsum("tb,tbh->h", de, th)
    ds = a[:, :, None] * dp + de[:, :, None] * (1 - th * th) * w["att"]
    dx = np.zeros_like(x)
    for k, way in enumerate("fb"):
        dstate = np.zeros(s.shape[1:2] + (h,), np.float32)
        gx = np.zeros(s.shape[:2] + (3 * h,), np.float32)
        g[f"h{way}"] = np.zeros_like(w[f"h{way}"])
        for t, before, z, r, new, part, on in reversed(read[way][1]):
            full = dstate + ds[t, :, k * h : (k + 1) * h]
            moved = np.where(on, full, 0)
            dz = moved * (before - new) * z * (1 - z)
            dn = moved * (1 - z) * (1 - new * new)
            dr = dn * part * r * (1 - r)
            gate = np.concatenate([dz, dr, dn], axis=1)
            gx[t] = gate
            inner = np.concatenate([dz, dr, dn * r], axis=1)
            g[f"h{way}"] += before.T @ inner
            dstate = np.where(on, moved * z + inner @ w[f"h{way}"].T, full)
        g[f"x{way}"] = np.einsum("tbd,tbg->dg", x, gx)
        g[f"c{way}"] = gx.sum((0, 1))
        dx += gx @ w[f"x{way}"].T
    return g, dx


def _windows(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and text of every window."""
    n = np.diff(words.first)
    many = np.where(n > 0, np.maximum(1, -(-(n - SPAN) // STEP) + 1), 0)
    text = np.repeat(np.arange(len(n)), many)
    at = (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)) * STEP
    return words.first[text] + at, np.minimum(SPAN, n[text] - at), text


def _score(w: dict[str, np.ndarray], of_word: dict[str, np.ndarray], ids: np.ndarray, start: np.ndarray, live: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), np.float32)
    steps = np.arange(SPAN)[:, None]
    order = np.argsort(-live, kind="stable")  # short windows together, so that full ones need no padding
    for k in range(0, len(start), AT_ONCE):
        rows = order[k : k + AT_ONCE]
        most = int(live[rows].max())
        on = steps[:most] < live[rows]
        index = ids[np.minimum(start[rows] + steps[:most], len(ids) - 1)]
        out[rows] = forward(w, of_word, index, on)
    return out


def train(texts: list[str | None], labels: list[int], seed: int = 7) -> Model:
    """A model from labelled texts; the sample's bounds are those of ``learn``."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return Model(np.empty(0, np.uint64), {}, float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    words = split(*text_bytes(pa.array(texts, pa.string())), IS_WORD)
    h = hashes(words)
    distinct, first, ids = np.unique(h, return_index=True, return_inverse=True)
    doc_of = np.repeat(np.arange(len(y)), np.diff(words.first))
    toxic, df = _counts(doc_of, ids, len(distinct), y)
    sure = _log_odds(toxic, df, y)
    chosen = np.sort(np.lexsort((distinct, -df))[:VOCAB])
    chosen = chosen[df[chosen] >= 2]
    known = np.zeros(len(distinct), np.int64)
    known[chosen] = np.arange(1, len(chosen) + 1)
    w = _initial(rng, len(chosen), sure[chosen])
    begins = beginnings(words, first)
    pairs = np.unique(doc_of * np.int64(len(distinct)) + ids)
    toxic, df = np.zeros(PREFIX_ROWS), np.zeros(PREFIX_ROWS, np.int64)
    for k in range(len(PREFIXES)):  # one length at a time, for the task's memory
        more = _counts(pairs // len(distinct), begins[pairs % len(distinct), k], PREFIX_ROWS, y)
        toxic, df = toxic + more[0], df + more[1]
    del pairs, doc_of
    w["prefix"] = np.where(df > 0, _log_odds(toxic, df, y), -0.5).astype(np.float32)
    w["prefix"][0] = -0.5
    sure = np.maximum(sure, w["prefix"][begins].max(1))
    ends, buckets = trigrams(words, first)
    start, live, doc = _windows(words)
    steps = np.arange(SPAN)
    # Words of a window; those beyond its end repeat the sample's last and count for nothing.
    words_of = lambda rows: ids[np.minimum(start[rows][:, None] + steps, len(ids) - 1)]
    score = np.full(len(start), -9.0, np.float32)
    for k in range(0, len(start), AT_ONCE):
        rows = np.arange(k, min(k + AT_ONCE, len(start)))
        score[rows] = np.where(steps < live[rows][:, None], sure[words_of(rows)], -9).max(1)
    mean, square = ({k: np.zeros_like(v) for k, v in w.items() if k != "prefix"} for _ in range(2))
    step = 0
    by_doc = np.searchsorted(doc, np.arange(len(y) + 1))
    for turn in range(ROUNDS):
        top, more, best = [], [], np.full(len(y), -9.0)
        for k in range(len(y)):
            a, b = by_doc[k], by_doc[k + 1]
            if a == b:
                continue
            top.append(a + int(np.argmax(score[a:b])))
            best[k] = score[top[-1]]
            if not y[k]:
                more.append(int(rng.integers(a, b)))
        # A toxic document in which nothing tells is taken for a wrong label, unless most are like that.
        telling = best > (CLEAR if turn == 0 else 0)
        if telling[y > 0].mean() < 0.3:
            telling[:] = True
        rows = np.unique(np.array(top + more))
        rows = rows[(y[doc[rows]] == 0) | telling[doc[rows]]]
        target = y[doc[rows]]
        for _ in range(PASSES):
            for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
                own = rows[part]
                index = words_of(own).T
                on = (steps < live[own][:, None]).T
                used, back = np.unique(index, return_inverse=True)
                back = back.reshape(index.shape)
                sizes = np.diff(np.r_[0, ends])[used]
                begin = (ends - np.diff(np.r_[0, ends]))[used]
                which = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                spelled = buckets[which]
                row_of = known[used]
                # Known words are hidden now and then, so that their characters learn too.
                row_of = np.where(rng.random(len(used)) < 0.2, 0, row_of)
                inputs = _inputs(w, row_of, np.cumsum(sizes), spelled, begins[used])
                g, dx = _backward(w, inputs[back], on, target[part])
                du = np.zeros_like(inputs)
                np.add.at(du, back.reshape(-1), dx.reshape(-1, dx.shape[2]))
                g["word"] = np.zeros_like(w["word"])
                np.add.at(g["word"], row_of, du[:, :WORD_DIM])
                g["word"][0] = 0
                g["char"] = np.zeros_like(w["char"])
                np.add.at(g["char"], spelled, np.repeat(du[:, WORD_DIM:-1] / sizes[:, None], sizes, axis=0))
                step += 1
                for k, v in g.items():
                    mean[k] = 0.9 * mean[k] + 0.1 * v
                    square[k] = 0.99 * square[k] + 0.01 * v * v
                    rate = 0.01 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                    w[k] = (w[k] - rate * mean[k] / (np.sqrt(square[k]) + 1e-7)).astype(np.float32)
        score = _score(w, _gates(w, _inputs(w, known, ends, buckets, begins)), ids, start, live)
    return Model(distinct[chosen], w, None)


def score_texts(model: Model, column: pa.Array) -> np.ndarray:
    """Scores of whole texts; a text without words scores ``EMPTY``."""
    words = split(*text_bytes(column), IS_WORD)
    out = np.full(len(column), EMPTY)
    if model.constant is not None:
        return np.full(len(column), model.constant)
    h = hashes(words)
    if not len(h):
        return out
    distinct, first, ids = np.unique(h, return_index=True, return_inverse=True)
    row = np.minimum(np.searchsorted(model.vocab, distinct), max(0, len(model.vocab) - 1))
    known = np.where(model.vocab[row] == distinct, row + 1, 0) if len(model.vocab) else np.zeros(len(distinct), np.int64)
    inputs = _inputs(model.w, known, *trigrams(words, first), beginnings(words, first))
    start, live, doc = _windows(words)
    logits = _score(model.w, _gates(model.w, inputs), ids, start, live)
    begins = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    out[doc[begins]] = _sigmoid(np.maximum.reduceat(logits, begins).astype(np.float64))
    return out


def in_pieces(text: F.Column, chars: int, pieces: int = PIECES) -> F.Column:
    """A text of up to ``chars`` characters as it is; of a longer one so many in all, in pieces from its beginning to its end."""
    size, n = chars // pieces, F.length(text)
    at = lambda i: (i * (n - size) / (pieces - 1)).cast("int") + 1
    cut = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: F.regexp_replace(F.substr(text, at(i), F.lit(size)), r"^\S*\s|\s\S*$", ""))
    return F.when(n > chars, F.array_join(cut, "\n")).otherwise(text)


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    """Train on at most ``rows`` labelled documents whose fold is not held out; of a text over ``chars`` characters on pieces.

    The sample is that of the least hashes of doc_id among labelled documents that ``docs`` has. Null labels, ids and texts
    are left out; of repeated labels, tied in doc_id, the highest holds, and of repeated documents the text whose hash is
    least. Empty tables, or labels of one kind only, give a model that scores all texts alike. Columns other than doc_id,
    text and toxic are not looked at. One task trains, as the sample is bounded; what comes to the driver is the model.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    marked = labels.where("doc_id is not null and toxic is not null").where(fold != 1).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kept = marked.join(texts.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    one = texts.join(F.broadcast(kept), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by(in_pieces(F.col("text"), chars), F.xxhash64("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = sorted((r["doc_id"], r["text"], r["toxic"]) for batch in batches for r in batch.to_pylist())
        model = train([text for _, text, _ in sample], [toxic for *_, toxic in sample])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(tuple(model))], pa.binary())], ["model"])

    got = one.repartition(1).mapInArrow(run, "model binary").collect()
    return Model(*pickle.loads(got[0].model)) if got else train([], [])


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """One row (doc_id, held_out, score, predicted) for each row of ``docs``, by a narrow pass over whole texts.

    Null, empty and wordless texts score 0. A very long text is scored whole, window by window; memory follows the longest
    one. Rows repeated or tied in doc_id score by their texts. A null doc_id is not held out. An empty table gives no
    rows. Columns other than doc_id and text are not looked at, so others may have any names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = np.concatenate([score_texts(held.value, part) for part in byte_slices(batch.column("text"))])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    slim = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    return slim.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; columns, of any names, stay as they are.

    Null, empty and very long texts, repeated rows and empty tables as in ``scores``: each row goes by its text alone.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = np.concatenate([score_texts(held.value, part) for part in byte_slices(batch.column("text"))])
                yield batch.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)
