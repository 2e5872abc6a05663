"""SimHash near-duplicates by an inverted index over positional bytes with count filtering.

A 64-bit fingerprint has 8 positional bytes. Two fingerprints that differ in at most 3 bits share at least 5 of them, the
guaranteed minimum. A posting list for each single (position, byte) would hold n / 256 of all rows, so a list is kept for
three positional bytes at once, of one half of the fingerprint: of 5 shared bytes at least 3 lie in one half, so 8 lists a
fingerprint are enough. In a list the shared positional bytes of each pair are tallied, pairs that reach the minimum are
retained, and their bits are compared. Equal fingerprints are one node. A crowded list is split by two further bytes, of
which a pair that reaches the minimum shares two as well; a group that is crowded still returns edges that connect
what its links connect, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, free_names, small_batches, spread, staged

SHINGLE = 3
MOST_BITS = 3
LEAST_SHARED = 8 - MOST_BITS
#: Bytes of a list's key, and the keys: any ``LEAST_SHARED`` bytes hold one of them.
KEY_BYTES = 3
COMBOS = [c for half in (range(4), range(4, 8)) for c in combinations(half, KEY_BYTES)]
#: Shingles hashed at a time, so that a very long text needs no more memory.
BLOCK = 1 << 18
#: A list of up to this number and one is compared pair by pair; a longer one is split.
NEAR = 64
#: Of a split list, groups up to this number go to ``forest``, which is quadratic; larger ones to ``stars``.
CROWD = 4096


def _first_combo() -> np.ndarray:
    """For each set of shared bytes (as 8 bits), the first list in which a pair with them meets, or -1."""
    out = np.full(256, -1, np.int64)
    for shared in range(256):
        for k, c in enumerate(COMBOS):
            if all(shared >> b & 1 for b in c):
                out[shared] = k
                break
    return out


FIRST_COMBO = _first_combo()
SHARED = np.bitwise_count(np.arange(256, dtype=np.uint8))
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of a whole UTF-8 text: A-Z lowered, words between ASCII white space, XXH64 (seed 42) of each shingle."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    n = len(words) - size + 1
    ones = np.zeros((8, 8), np.int64)
    for at in range(0, n, BLOCK):
        part = words[at : at + BLOCK + size - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(size)), strict=False))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, min(BLOCK, n - at))
        octets = hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        for k in range(8):
            ones[k] += np.bincount(octets[:, k], minlength=256) @ BYTE_BITS
    return int.from_bytes(np.packbits((2 * ones > n).reshape(-1), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        prints = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(prints)], ["doc_id", "t", "fp"])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        octets = [fp >> np.uint64(8 * k) & np.uint64(255) for k in range(8)]
        for k, combo in enumerate(COMBOS):
            key = np.full(len(fp), k, np.uint64)
            for b in combo:
                key = key << np.uint64(8) | octets[b]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64))], ["key", "fp"])


def _shared(x: np.ndarray) -> np.ndarray:
    """Tally: which of the 8 bytes are zero in each XOR, as 8 bits."""
    octets = x.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    return np.packbits(octets == 0, axis=1, bitorder="little")[:, 0]


def forest(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (at most 3 bits) among distinct values: at most len(v) - 1 pairs."""
    left, right, rest = [], [], v
    while rest.size:
        todo, rest = [rest[0]], rest[1:]
        while todo and rest.size:
            u = todo.pop()
            near = np.bitwise_count(rest ^ u) <= MOST_BITS
            if near.any():
                found = rest[near]
                left.append(np.full(found.size, u))
                right.append(found)
                todo.extend(found)
                rest = rest[~near]
    none = np.empty(0, v.dtype)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def stars(v: np.ndarray, free: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Edges to one value of each component of sorted distinct values that differ in the bytes ``free`` only.

    Each value looks up those that differ from it in up to 3 of the free bits, so the work is linear in their number.
    """
    bits = [np.uint64(1 << (8 * b + k)) for b in free for k in range(8)]
    masks = [sum(c[1:], c[0]) for size in range(1, MOST_BITS + 1) for c in combinations(bits, size)]
    label = np.arange(len(v))
    while True:
        before = label.copy()
        for mask in masks:
            other = v ^ mask
            at = np.minimum(np.searchsorted(v, other), len(v) - 1)
            here = np.flatnonzero((v[at] == other) & (other < v))
            least = np.minimum(label[here], label[at[here]])
            label[here] = np.minimum(label[here], least)
            label[at[here]] = np.minimum(label[at[here]], least)
        while (label != label[label]).any():
            label = label[label]
        if np.array_equal(before, label):
            return v[label != np.arange(len(v))], v[label[label != np.arange(len(v))]]


def _octet(v: np.ndarray, b: int) -> np.ndarray:
    return v >> np.uint64(8 * b) & np.uint64(255)


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    return starts, np.diff(np.r_[starts, len(key)])


def _pairs(key: np.ndarray, fp: np.ndarray, first: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links within equal keys, but for crowded ones; a pair is told in the ``first`` list in which it meets, or in all."""
    sizes = _groups(key)[1]
    crowded, left, right = np.repeat(sizes > NEAR + 1, sizes), [], []
    for d in range(1, min(NEAR, int(sizes[sizes <= NEAR + 1].max(initial=1)) - 1) + 1):
        at = np.flatnonzero((key[d:] == key[:-d]) & ~crowded[d:])
        x = fp[at + d] ^ fp[at]
        shared = _shared(x)
        ok = SHARED[shared] >= LEAST_SHARED  # the count filter
        at, x, shared = at[ok], x[ok], shared[ok]
        ok = np.bitwise_count(x) <= MOST_BITS
        if first:
            ok &= FIRST_COMBO[shared] == (key[at] >> np.uint64(8 * KEY_BYTES)).astype(np.int64)
        left.append(fp[at[ok]])
        right.append(fp[at[ok] + d])
    return left, right


def _split(v: np.ndarray, held: tuple[int, ...]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges of a crowded list of sorted distinct values that share the bytes ``held``."""
    left, right = [], []
    others = [b for b in range(8) if b not in held]
    for two in combinations(others, LEAST_SHARED - len(held)):
        key = np.zeros(len(v), np.uint64)
        for b in two:
            key = key << np.uint64(8) | _octet(v, b)
        order = np.argsort(key, kind="stable")
        key, own = key[order], v[order]
        pairs = _pairs(key, own, first=False)
        starts, sizes = _groups(key)
        more = [
            (forest if n <= CROWD else lambda g: stars(g, tuple(b for b in others if b not in two)))(own[s : s + n])  # noqa: B023
            for s, n in zip(starts[sizes > NEAR + 1], sizes[sizes > NEAR + 1], strict=True)
        ]
        left += pairs[0] + [a for a, _ in more]
        right += pairs[1] + [b for _, b in more]
    return left, right


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within the lists of a partition that is sorted by (key, fp)."""
    empty = np.empty(0, np.uint64)

    def of(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = _pairs(key, fp, first=True)
        starts, sizes = _groups(key)
        for s, n in zip(starts[sizes > NEAR + 1], sizes[sizes > NEAR + 1], strict=True):
            # Postings of uint64 sort as signed numbers do; a list is sorted again as unsigned ones.
            a, b = _split(np.sort(fp[s : s + n]), COMBOS[int(key[s] >> np.uint64(8 * KEY_BYTES))])
            left += a
            right += b
        return np.concatenate([empty, *left]), np.concatenate([empty, *right])

    def out(pair: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in pair], ["a", "b"])

    held_key, held = empty, [empty]
    for batch in batches:
        key = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(key):
            continue
        if len(held_key) and key[0] == key[-1] == held_key[0]:
            held.append(fp)  # a long list goes on
            continue
        whole = np.concatenate([*held, fp])
        keys = np.concatenate([np.repeat(held_key, sum(map(len, held))), key])
        last = int(np.searchsorted(keys == keys[-1], True)) if keys[0] != keys[-1] else 0
        if last:
            yield out(of(keys[:last], whole[:last]))
        held_key, held = keys[-1:], [whole[last:]]
    if len(held_key):
        whole = np.concatenate(held)
        yield out(of(np.repeat(held_key, len(whole)), whole))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, t, fp) of every row, by a narrow pass over the texts; t: a hash of the text as it is."""
    small_batches(docs.sparkSession)
    slim = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return slim.withColumn("t", F.xxhash64("text")).mapInArrow(_fingerprints, "doc_id long, t long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` within 3 bits; a spanning set of them in crowds."""
    spark = fps.sparkSession
    rows = fps.select("fp").mapInArrow(_postings, "key long, fp long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "key").sortWithinPartitions("key", "fp").mapInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row (doc_id, t, fp, fingerprint, component_id, root) for each row of ``docs``.

    fingerprint: 16 hex digits; component_id: the least doc_id reachable over links of at most 3 differing bits; root:
    the component's least fingerprint; t: a hash of the text.
    Null, empty and blank texts have fingerprint zero and link like any other. Repeated rows and tied fingerprints fall
    into one component. A null doc_id stays null and takes the component of its fingerprint, null if no other doc_id is
    in it. An empty table gives no rows; further columns are not looked at.
    """
    prints = staged(fingerprints(docs), "fingerprints")
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes))
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    # Written first, so that a root of very many fingerprints can be split in the join.
    least = staged(placed.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    of = placed.join(least, "root").select("fp", "component_id", "root")
    return prints.join(of, "fp", "left").select(
        "doc_id", "t", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "root"
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that with the least doc_id. Columns stay as they are.

    Of several texts tied in that doc_id the one of the least hash stays, and of equal rows one. Rows without a doc_id stay
    only where their component has no other. Null and empty texts are one component with all whose fingerprint is near
    zero. Columns may have any names. A very long text is read in blocks of shingles. An empty table gives no rows.
    """
    found = staged(near_duplicates(docs.select("doc_id", "text")).select("doc_id", "t", "component_id", "root"), "components")
    leaders = found.where("doc_id <=> component_id").groupBy("root", "doc_id", "t").agg(F.count("*").alias("n"))
    key, doc, text, n = free_names(docs, "key", "doc", "text", "n")
    chosen = leaders.groupBy("root").agg(F.min(F.struct("t", "doc_id", "n")).alias("c")).select(
        F.col("c.doc_id").alias(doc), F.col("c.t").alias(text), F.col("c.n").alias(n)
    )
    chosen = staged(chosen, "chosen")

    def rows(of: DataFrame) -> DataFrame:
        keyed = docs.withColumn(key, F.xxhash64("text"))
        return keyed.join(of, keyed["doc_id"].eqNullSafe(of[doc]) & (keyed[key] == of[text]), "left_semi")

    kept = rows(chosen.where(F.col(n) == 1)).select(*docs.columns)
    if not chosen.where(F.col(n) > 1).isEmpty():
        equal = rows(chosen.where(F.col(n) > 1)).groupBy("doc_id", key)
        kept = kept.unionByName(equal.agg(F.first(F.struct(*docs.columns)).alias("row")).select("row.*"))
    return kept


def op2_digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "fingerprint", "component_id")
