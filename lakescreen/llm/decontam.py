"""Benchmark decontamination by suffix arrays over the training words.

Each batch of documents is a shard. Its suffix array holds the word suffixes inside stretches that windows of the
benchmark cover; hashes of windows tell the stretches, and every word that is hit is spelled out, so no hash decides.
Every benchmark suffix of such a window is binary-searched among them: the suffixes that share its window are one interval
of the array, which is marked as a whole, never listed pair by pair. The longest verbatim match of a place, and where in
the benchmark it lies, comes from its neighbours in order. Documents stay whole in their row, so nothing is shuffled; the
benchmark goes to the executors in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import small_batches, spread, staged
from .wordarray import Words, byte_slices, hashes, split, text_bytes

WINDOW = 13
#: A document is contaminated if hit words are at least one in so many.
SHARE = 20
#: Characters of benchmark text that go to the executors at once.
BLOCK_CHARS = 16_000_000

#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]
IS_WORD = np.array([chr(b).isdigit() or chr(b).islower() or b > 127 for b in range(128)] + [True] * 128)

MATCHES = "array<struct<doc_word:int,n_words:int,item_id:string,item_word:int>>"
FOUND = f"n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, matches {MATCHES}"


class Index(NamedTuple):
    """A block of the benchmark."""

    seed: int
    vocab: np.ndarray  # sorted hashes
    spelled: list[bytes]
    pairs: np.ndarray  # sorted: neighbouring words, as one number
    sizes: list[int]  # of windows
    grams: list[np.ndarray]  # for each size: the sorted hashes of its windows
    places: list[tuple[np.ndarray, np.ndarray]]  # for each size: ends of each hash's places, the places
    ids: np.ndarray  # of each benchmark word
    item_of: np.ndarray
    word_of: np.ndarray  # its number in the item
    names: list[str]


def _grams(ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` words from each place."""
    h = np.full(len(at), size, np.uint64)
    for k in range(size):
        h = (h ^ ids[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def build_index(items: list[tuple[str, str | None]], window: int = WINDOW) -> Index:
    texts = pa.array([t for _, t in items], pa.string())
    words = split(*text_bytes(texts), IS_WORD)
    spelled = [words.data[s : s + n].tobytes() for s, n in zip(words.start, words.size, strict=True)]
    seed = 1
    while len(np.unique(hashes(words, seed))) != len(set(spelled)):
        seed += 1
    h = hashes(words, seed)
    vocab, first, ids = np.unique(h, return_index=True, return_inverse=True)
    counts = np.diff(words.first)
    item_of = np.repeat(np.arange(len(items)), counts)
    word_of = np.arange(len(ids)) - np.repeat(words.first[:-1], counts)
    same = item_of[1:] == item_of[:-1]
    pairs = np.unique((ids[:-1] * len(vocab) + ids[1:])[same])
    size_of = np.minimum(counts, window)
    sizes, grams, places = sorted(set(size_of[size_of > 0].tolist())), [], []
    for size in sizes:
        at = np.flatnonzero((size_of[item_of] == size) & (word_of + size <= counts[item_of]))
        hashed = _grams(ids, at, size)
        order = np.argsort(hashed, kind="stable")
        distinct, begins = np.unique(hashed[order], return_index=True)
        grams.append(distinct)
        places.append((np.r_[begins, len(at)], at[order]))
    return Index(seed, vocab, [spelled[k] for k in first], pairs, sizes, grams, places, ids, item_of, word_of, [n for n, _ in items])


def _in_sorted(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The place in ``of`` of each ``x`` that is there, else -1."""
    if not len(of):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(of, x), len(of) - 1)
    return np.where(of[at] == x, at, -1)


def _covered(n: int, spans: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """The numbers below n that lie in some span (beginnings, size), sorted."""
    turn = np.zeros(n + 1, np.int64)
    for begin, size in spans:
        np.add.at(turn, begin, 1)
        np.add.at(turn, begin + size, -1)
    return np.flatnonzero(np.cumsum(turn[:-1]) > 0)


class Suffixes:
    """The order of all suffixes of some words, by ranks of their first 1, 2, 4, ... words."""

    def __init__(self, words: np.ndarray, longest: int):
        self.n = len(words)
        self.ranks = [np.unique(words, return_inverse=True)[1]]
        while 1 << (len(self.ranks) - 1) < longest:
            self.ranks.append(self._joined(self.ranks[-1], self.ranks[-1], 1 << (len(self.ranks) - 1)))

    def _joined(self, rank: np.ndarray, then: np.ndarray, after: int) -> np.ndarray:
        later = np.zeros(self.n, np.int64)
        later[: max(0, self.n - after)] = then[after:] + 1
        return np.unique(rank * (self.n + 1) + later, return_inverse=True)[1]

    def first(self, size: int) -> np.ndarray:
        """Ranks by the first ``size`` words; they agree with the whole order."""
        rank, done = np.zeros(self.n, np.int64), 0
        for k in range(len(self.ranks) - 1, -1, -1):
            if size - done >= 1 << k:
                rank = self._joined(rank, self.ranks[k], done)
                done += 1 << k
        return rank

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many first words the suffixes a and b share, pair by pair."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            x, y = a + out, b + out
            inside = np.maximum(x, y) < self.n
            same = inside & (self.ranks[k][np.where(inside, x, 0)] == self.ranks[k][np.where(inside, y, 0)])
            out += np.where(same, 1 << k, 0)
        return out


class Hits(NamedTuple):
    words: np.ndarray  # numbers of the hit words
    items: dict[int, np.ndarray]  # of each text with hits: its items
    runs: list[tuple[int, int, int]]  # longest matches: first word, length, first word in the benchmark


def _windows(ids: np.ndarray, follows: np.ndarray, index: Index) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the size, beginnings, numbers of their hashes) of this shard's words that hash as windows do."""
    run = np.r_[0, np.cumsum(follows)]
    out = []
    for k, (size, grams) in enumerate(zip(index.sizes, index.grams, strict=True)):
        if len(ids) >= size:
            begin = np.flatnonzero((run[size - 1 :][: len(ids) - size + 1] - run[: len(ids) - size + 1] == size - 1) & (ids[: len(ids) - size + 1] >= 0))
            gram = _in_sorted(_grams(ids, begin, size), grams)
            if (gram >= 0).any():
                out.append((k, begin[gram >= 0], gram[gram >= 0]))
    return out


def search(words: Words, index: Index, maybe: np.ndarray) -> Hits:
    """Binary-search the benchmark's suffixes in this shard's suffix array. maybe: flags by a hash's low bits."""
    none = Hits(np.empty(0, np.int64), {}, [])
    h = hashes(words, index.seed)
    if not len(h) or not len(index.vocab):
        return none
    ids = np.full(len(h), -1)
    some = np.flatnonzero(maybe[h & np.uint64(len(maybe) - 1)])
    ids[some] = _in_sorted(h[some], index.vocab)
    texts = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    follows = np.zeros(len(h), bool)
    both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0) & (texts[:-1] == texts[1:]))
    follows[both[_in_sorted(ids[both] * len(index.vocab) + ids[both + 1], index.pairs) >= 0]] = True
    while True:
        found = _windows(ids, follows, index)
        if not found:
            return none
        live = _covered(len(h), [(begin, index.sizes[k]) for k, begin, _ in found])
        wrong = [k for k in live if words.data[words.start[k] : words.start[k] + words.size[k]].tobytes() != index.spelled[ids[k]]]
        if not wrong:
            break
        ids[wrong] = -1  # another word with an equal hash
        follows[wrong] = False
        follows[np.maximum(np.array(wrong) - 1, 0)] = False
    asked = []  # benchmark suffixes that begin with such windows
    for k, _, gram in found:
        ends, places = index.places[k]
        asked.append((index.sizes[k], np.concatenate([places[ends[g] : ends[g + 1]] for g in np.unique(gram)])))
    known = _covered(len(index.ids), [(q, size) for size, q in asked])

    # Both as one sequence of words, with a mark of its own behind each stretch.
    def stretch(of: np.ndarray, group: np.ndarray) -> np.ndarray:
        return np.r_[(np.diff(of) != 1) | (group[of[1:]] != group[of[:-1]]), True] if len(of) else np.empty(0, bool)

    ends = np.r_[stretch(live, texts), stretch(known, index.item_of)]
    at = np.arange(len(ends)) + np.r_[0, np.cumsum(ends)[:-1]]
    sequence = np.empty(len(ends) + int(ends.sum()), np.int64)
    sequence[at] = np.r_[ids[live], index.ids[known]]
    sequence[at[ends] + 1] = len(index.vocab) + np.arange(int(ends.sum()))
    longest = int(np.diff(np.r_[-1, np.flatnonzero(ends)]).max()) + 1
    suffixes = Suffixes(sequence, longest)
    here, there = at[: len(live)], at[len(live) :]
    rank = suffixes.ranks[-1]
    array = here[np.argsort(rank[here])]  # the shard's suffix array
    begun = np.zeros(len(sequence), bool)
    spans, values = [], []
    for size, q in asked:
        first = suffixes.first(size)
        ordered, mine = first[array], there[np.searchsorted(known, q)]
        low, high = np.searchsorted(ordered, first[mine], "left"), np.searchsorted(ordered, first[mine], "right")
        turn = np.zeros(len(array) + 1, np.int64)
        np.add.at(turn, low, 1)
        np.add.at(turn, high, -1)
        begins = array[np.cumsum(turn[:-1]) > 0]
        begun[begins] = True
        place = live[np.searchsorted(here, begins)]
        spans.append((place, size))
        values.append((texts[place], first[begins], first[mine], index.item_of[q]))
    hit = _covered(len(h), spans)
    return Hits(hit, _items(values), _longest(suffixes, here[begun[here]], here, live, there, known, texts))


def _items(values: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> dict[int, np.ndarray]:
    """Each text's items, from (texts, their windows; windows, their items): a window is looked up once for a text."""
    out: dict[int, np.ndarray] = {}
    for text, window, known, item in values:
        pairs = np.unique(np.stack([known, item]), axis=1)
        own = np.unique(np.stack([text, window]), axis=1)
        for t in np.unique(own[0]).tolist():
            mine = own[1][own[0] == t]
            found = np.unique(pairs[1][_in_sorted(pairs[0], mine) >= 0])
            out[t] = np.union1d(out[t], found) if t in out else found
    return out


def _longest(suffixes: Suffixes, begun: np.ndarray, here: np.ndarray, live: np.ndarray, there: np.ndarray, known: np.ndarray, texts: np.ndarray) -> list[tuple[int, int, int]]:
    """The longest match of each place that begins a window, but of those inside another's; by neighbours in order."""
    rank = suffixes.ranks[-1]
    order = there[np.argsort(rank[there])]
    k = np.searchsorted(rank[order], rank[begun])
    below, above = order[np.maximum(k - 1, 0)], order[np.minimum(k, len(order) - 1)]
    a, b = suffixes.common(begun, below), suffixes.common(begun, above)
    size, where = np.maximum(a, b), np.where(a >= b, below, above)
    place, source = live[np.searchsorted(here, begun)], known[np.searchsorted(there, where)]
    inner = np.r_[False, (np.diff(place) == 1) & (texts[place[1:]] == texts[place[:-1]]) & (size[:-1] - 1 >= size[1:])] if len(place) else np.empty(0, bool)
    return list(zip(place[~inner].tolist(), size[~inner].tolist(), source[~inner].tolist(), strict=True))


def digest(n_words: int, hit: int, items: list[str]) -> tuple[int, int, int, str, bool]:
    sha = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    return n_words, hit, len(items), sha, hit > 0 and SHARE * hit >= n_words


def _shards(batch: pa.RecordBatch, index: Index, maybe: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[str], list[dict]]]:
    """For each text: its number of words, its hit words, its items, its matches."""
    for texts in byte_slices(batch.column("text")):
        words = split(*text_bytes(texts), IS_WORD)
        hits = search(words, index, maybe)
        cut = np.searchsorted(hits.words, words.first)
        matches: dict[int, list[dict]] = {}
        if hits.runs:
            for t, (at, size, source) in zip((np.searchsorted(words.first, [r[0] for r in hits.runs], "right") - 1).tolist(), hits.runs, strict=True):
                told = {"doc_word": at - int(words.first[t]), "n_words": size, "item_id": index.names[index.item_of[source]], "item_word": int(index.word_of[source])}
                matches.setdefault(t, []).append(told)
        for t, n in enumerate(np.diff(words.first).tolist()):
            items = sorted({index.names[k] for k in hits.items[t]}) if t in hits.items else []
            yield n, hits.words[cut[t] : cut[t + 1]] - words.first[t], items, matches.get(t, [])


def _maybe(index: Index) -> np.ndarray:
    flags = np.zeros(1 << 18, bool)
    flags[index.vocab & np.uint64(len(flags) - 1)] = True
    return flags


def _dealt(bench: DataFrame, block_chars: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """The benchmark's distinct items with their block (part, block), and all blocks: ``block_chars`` and one item at most.

    Parts are dealt by a hash; a running sum of lengths cuts each into blocks. Items without text have no windows.
    """
    rows = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.length("text") > 0).distinct()
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if total <= block_chars:
        return rows.select("item_id", "text", F.lit(0).alias("part"), F.lit(0).alias("block")), [(0, 0)]
    hashed = rows.withColumn("hash", F.xxhash64("item_id", "text"))
    parted = hashed.withColumn("part", F.pmod("hash", F.lit(-(-total // block_chars))).cast("int"))
    before = F.sum(F.length("text")).over(Window.partitionBy("part").orderBy("hash", "item_id", "text").rowsBetween(Window.unboundedPreceding, -1))
    block = F.floor(F.coalesce(before, F.lit(0)) / block_chars).cast("int")
    dealt = staged(parted.withColumn("block", block).drop("hash"), "benchmark")
    return dealt, sorted(tuple(r) for r in dealt.select("part", "block").distinct().collect())


def _block(dealt: DataFrame, of: tuple[int, int]) -> list[tuple[str, str | None]]:
    """The items of one block, brought to the driver."""
    mine = (F.col("part") == of[0]) & (F.col("block") == of[1])
    return [tuple(r) for r in dealt.where(mine).select("item_id", "text").collect()]


def _mapper(index: Index, schema: pa.Schema, fill: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = _maybe(index_of())
        for batch in batches:
            if batch.num_rows:
                yield fill(batch, index_of(), maybe, schema)

    held = index

    def index_of() -> Index:
        return held.value if hasattr(held, "value") else held

    return run


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row (doc_id, n_words, n_hit, n_items, items_sha256, contaminated, matches) for each row of ``docs``.

    matches: the longest verbatim match that begins at each word, but those inside another, each with its first word
    and length here and one place where the benchmark has it; n_items and items_sha256 tell all items.
    A null or wordless text has no words and is never contaminated; a null or wordless item has no windows. Repeated
    items count once by item_id. Rows repeated in ``docs``, tied in doc_id or without one are judged by their texts alone.
    A very long text is searched whole; memory follows its length, however often its words repeat. An empty table gives no
    rows, an empty benchmark leaves all clean. Columns other than doc_id and text are not looked at. One block of the
    benchmark at a time is brought to the driver and broadcast: ``block_chars`` and at most one more item; blocks change
    nothing but where a match that lies in several items is told.
    """
    spark = docs.sparkSession
    small_batches(spark)
    slim = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    dealt, blocks = _dealt(bench, block_chars)
    if len(blocks) == 1:
        held = spark.sparkContext.broadcast(build_index(_block(dealt, blocks[0]), window))

        def fill(batch: pa.RecordBatch, index: Index, maybe: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
            rows = [(*digest(n, len(hit), items), matches) for n, hit, items, matches in _shards(batch, index, maybe)]
            told = [pa.array(c, schema.field(k + 1).type) for k, c in enumerate(zip(*rows, strict=True))]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *told], schema=schema)

        return slim.mapInArrow(_mapper(held, _arrow(spark, f"doc_id bigint, {FOUND}"), fill), f"doc_id bigint, {FOUND}")
    return _keyed(docs, dealt, blocks, window).drop("_key")


def _keyed(docs: DataFrame, dealt: DataFrame, blocks: list[tuple[int, int]], window: int) -> DataFrame:
    """The rows of ``contamination`` by blocks, each with its text's hash as _key."""
    spark = docs.sparkSession
    small_batches(spark)
    slim = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    keyed = slim.withColumn("_key", F.xxhash64("text"))
    parts = parts_first = None
    for one in blocks:
        held = spark.sparkContext.broadcast(build_index(_block(dealt, one), window))
        kind = f"doc_id bigint, _key bigint, n_words bigint, hit array<int>, items array<string>, matches {MATCHES}"

        def fill(batch: pa.RecordBatch, index: Index, maybe: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
            told = [pa.array(c, schema.field(k + 2).type) for k, c in enumerate(zip(*_shards(batch, index, maybe), strict=True))]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_key"), *told], schema=schema)

        got = staged(keyed.mapInArrow(_mapper(held, _arrow(spark, kind), fill), kind), "block")
        held.destroy()
        parts_first = got if parts is None else parts_first
        parts = got if parts is None else parts.unionByName(got)
    # Repeated rows give equal lists; each block is told once for them, and the rows come back from the first block.
    one = parts.where("size(hit) > 0").select("doc_id", "_key", "hit", "items", "matches").distinct()
    merged = one.groupBy("doc_id", "_key").agg(*(F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("hit", "items", "matches")))
    first = parts_first.select("doc_id", "_key", "n_words")
    names = F.array_sort("items")
    n_hit = F.coalesce(F.size("hit"), F.lit(0)).cast("long")
    on = first.doc_id.eqNullSafe(merged.doc_id) & first._key.eqNullSafe(merged._key)
    return first.join(merged, on, "left").select(
        first.doc_id,
        first._key,
        "n_words",
        F.when(F.col("hit").isNull(), 0).otherwise(n_hit).cast("long").alias("n_hit"),
        F.when(F.col("hit").isNull(), 0).otherwise(F.size(names)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join(names, ","), F.lit("")), 256).alias("items_sha256"),
        F.coalesce((n_hit > 0) & (SHARE * n_hit >= F.col("n_words")) & F.col("hit").isNotNull(), F.lit(False)).alias("contaminated"),
        F.coalesce("matches", F.from_json(F.lit("[]"), MATCHES)).alias("matches"),
    )


def _arrow(spark, ddl: str | StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(ddl if isinstance(ddl, StructType) else StructType.fromDDL(ddl))


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the contaminated rows; columns, of any names, stay as they are. With one block, a narrow pass.

    Nulls, empty and very long texts, repeated rows and empty tables as in ``contamination``: each row is judged by its text.
    """
    spark = docs.sparkSession
    dealt, blocks = _dealt(bench, block_chars)
    if len(blocks) > 1:
        # A row is judged by its text, so it is known again by its text's hash: doc_ids may be null or repeated.
        key = F.xxhash64(F.col("text").cast("string"))
        bad = _keyed(docs, dealt, blocks, window).where("contaminated").select(F.col("doc_id").alias("_doc"), "_key").distinct()
        on = F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")) & (key == F.col("_key"))
        return docs.join(bad, on, "left_anti").select(*docs.columns)
    small_batches(spark)
    held = spark.sparkContext.broadcast(build_index(_block(dealt, blocks[0]), window))

    def fill(batch: pa.RecordBatch, index: Index, maybe: np.ndarray, _schema: pa.Schema) -> pa.RecordBatch:
        clean = [not digest(n, len(hit), [])[4] for n, hit, _, _ in _shards(batch, index, maybe)]
        return batch.filter(pa.array(clean))

    return docs.mapInArrow(_mapper(held, None, fill), docs.schema)


def op9_digest(docs: DataFrame, bench: DataFrame) -> DataFrame:
    return contamination(docs, bench).drop("matches")


OP9_SQL = r"""
with said as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w
  from documents),
items as (
  select item_id::varchar as item_id, w, least(13, len(w)) as size from (
    select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w from benchmark)
  where len(w) > 0),
windows as (select distinct item_id, size, array_to_string(w[k : k + size - 1], ' ') as gram from (select *, unnest(range(1, len(w) - size + 2)) as k from items)),
places as (
  select r, k, size, array_to_string(w[k : k + size - 1], ' ') as gram from (
    select r, w, size, unnest(range(1, len(w) - size + 2)) as k from said, (select distinct size from items))),
met as (select r, k, p.size, item_id from places p join windows using (size, gram)),
words as (select r, count(distinct n) as n_hit from (select r, unnest(range(k, k + size)) as n from met) group by r),
named as (select r, count(*) as n_items, sha256(string_agg(item_id, ',' order by encode(item_id))) as sha from (select distinct r, item_id from met) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  coalesce(sha, sha256('')) as items_sha256, coalesce(n_hit > 0 and 20 * n_hit >= len(w), false) as contaminated
from said left join words using (r) left join named using (r)
"""
