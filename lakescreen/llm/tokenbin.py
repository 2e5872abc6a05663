"""Token ids in training order: fixed-stride binary shards, their sequences placed by a keyed Feistel permutation.

Documents have an order of their own, by a hash's bucket, doc_id and text hash, whatever the cluster or the files. A first
pass counts tokens; running sums of the counts, over narrow rows, give every document its first token's place among all.
The ids of all documents, an end mark after each, are cut into sequences of ``LENGTH``, and the permutation sends a
sequence's number to its slot, one to one: the order needs no state beyond (key, N), and any slot can be found again on
resuming. A second pass makes the ids and sends each document's parts to the shards of their slots, in one exchange; a
shard's parts, sorted by slot and place, are the shard's bytes.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import math
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyarrow import fs as filesystems
from pyarrow import parquet
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import is_scan, open_folder, remove_at_exit, shared_dir, small_batches, spread, staged
from .wordarray import Words, byte_slices, hashes, text_bytes

LENGTH = 1024
SHARD_ROWS = 8192
KEY = 0x5EED
ROUNDS = 4
#: Ids are two bytes, low byte first.
ID = np.dtype("<u2")
#: Pieces of text whose ids a worker remembers, and the longest of them; it forgets all when it has that many.
REMEMBERED, LONGEST = 200_000, 40
#: GPT-2's end of text, which the vocabulary file leaves free.
END = 50256
#: Buckets of the documents' order: a bound on what one task adds up, and on what is sent to all.
BUCKETS = 1 << 16
#: Tasks that write shards, at most; one writes several shards if there are more.
MOST_TASKS = 16384
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenisation pattern that the vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 32]] = True
#: White space and control characters that Unicode or Python take for such.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces of texts begin, and each text's first piece: at its start, and at a blank behind what is none.

    A run of white space is read from its beginning whatever goes before, so pieces encode apart as they do together.
    """
    if not len(data):
        return np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    flags = np.zeros(len(data) + 1, bool)
    flags[1:-1] = BLANK[data[1:]] & ~SPACE[data[:-1]]
    wide = np.flatnonzero(flags[1:-1] & (data[:-1] > 127)) + 1  # behind a character of several bytes, white space or not
    a, b, c = (data[np.maximum(wide - k, 0)] for k in (3, 2, 1))
    two = (b == 0xC2) & ((c == 0x85) | (c == 0xA0))
    en = (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    three = (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    flags[wide[two | en | three]] = False
    flags[offsets[:-1][np.diff(offsets) > 0]] = True
    start = np.flatnonzero(flags)
    return start, np.searchsorted(start, offsets)


class Tokenizer:
    """Byte-pair encoding. Texts are cut where pre-tokens never join; what a piece encodes to is remembered."""

    def __init__(self, vocabulary: bytes, remembered: int = REMEMBERED):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for said, k in ranks.items():
            self.bytes[k] = len(said)
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}  # a piece's hash, and its number here
        self.check = np.empty(0, np.uint64)  # a second hash
        self.begin, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool = np.empty(0, ID)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text."""
        return np.array(self.encoding.encode_ordinary(text), ID).tobytes()

    def count(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))

    def encode_all(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, one after another, and how many each has. Null counts as empty."""
        data, offsets = text_bytes(column)
        start, first = cuts(data, offsets)
        if not len(start):
            return np.empty(0, ID), np.zeros(len(column), np.int64)
        if len(self.known) > self.remembered:
            self._forget()
        size = np.diff(np.r_[start, len(data)])
        words = Words(np.concatenate([data, np.zeros(8, np.uint8)]), start, size, first)
        h, check = hashes(words, 1), hashes(words, 2)
        distinct, at, which, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        apart = np.zeros(len(start) + 1, bool)  # pieces at the ends of texts, which may begin or end otherwise than others
        apart[first] = apart[np.maximum(first, 1) - 1] = True
        number = np.array(list(map(self.known.get, distinct.tolist(), repeat(-1))))
        new = number < 0
        kept = np.flatnonzero(new & (times > 1) & (size[at] <= LONGEST))
        number[kept] = self._add(words, at[kept], apart, check)
        self.known.update(zip(distinct[kept].tolist(), number[kept].tolist(), strict=True))
        held = len(self.size), len(self.pool)
        once = np.flatnonzero(new & ((times == 1) | (size[at] > LONGEST)))
        number[once] = self._add(words, at[once], apart, check)
        number = number[which]
        odd = np.flatnonzero(self.check[number] != check)  # two pieces of one hash
        number[odd] = self._add(words, odd, apart, check)
        many = self.size[number]
        ends = np.cumsum(many)
        ids = self.pool[np.repeat(self.begin[number] - (ends - many), many) + np.arange(ends[-1])]
        self.check, self.begin, self.size, self.pool = self.check[: held[0]], self.begin[: held[0]], self.size[: held[0]], self.pool[: held[1]]
        return ids, np.diff(np.r_[0, ends][first])

    def _add(self, words: Words, rows: np.ndarray, apart: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Encode pieces; their numbers. Those between others are encoded as one text, of which each has its stretch."""
        if not len(rows):
            return rows
        one, alone = rows[~apart[rows]], rows[apart[rows]]
        ids, size = [], np.zeros(len(rows), np.int64)
        if len(one):
            ends = np.cumsum(words.size[one])
            said = words.data[np.repeat(words.start[one] - (ends - words.size[one]), words.size[one]) + np.arange(ends[-1])]
            ids.append(np.array(self.encoding.encode_ordinary(said.tobytes().decode()), ID))
            reached = np.searchsorted(np.cumsum(self.bytes[ids[0]]), ends) + 1
            size[~apart[rows]] = np.diff(np.r_[0, reached])
        each = [np.array(self.encoding.encode_ordinary(words.data[s : s + n].tobytes().decode()), ID) for s, n in zip(words.start[alone], words.size[alone], strict=True)]
        size[apart[rows]] = list(map(len, each))
        order = np.r_[np.flatnonzero(~apart[rows]), np.flatnonzero(apart[rows])]
        begin = np.empty(len(rows), np.int64)
        begin[order] = len(self.pool) + np.cumsum(size[order]) - size[order]
        self.pool = np.concatenate([self.pool, *ids, *each])
        number = len(self.size) + np.arange(len(rows))
        self.begin, self.size, self.check = np.r_[self.begin, begin], np.r_[self.size, size], np.r_[self.check, check[rows]]
        return number

    def decode(self, ids: bytes) -> str:
        return self.encoding.decode_bytes([k for k in np.frombuffer(ids, ID).tolist() if k != END]).decode("utf-8", "replace")


def vocabulary(path: str = VOCABULARY) -> bytes:
    """The vocabulary file, read on the driver and sent to the workers; a few hundred KB."""
    with open(path, "rb") as file:
        return file.read()


def feistel(number: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """A permutation of range(n), keyed; walks its cycles on the next power of four until a value lies in the range."""
    half = max(1, math.ceil(math.log2(max(2, n)) / 2))
    mask = np.uint64((1 << half) - 1)
    x = np.asarray(number, np.uint64).copy()
    todo = np.arange(len(x))
    rounds = range(ROUNDS)[::-1] if inverse else range(ROUNDS)
    while len(todo):
        a, b = x[todo] >> np.uint64(half), x[todo] & mask
        for k in rounds:
            if inverse:
                a, b = b ^ _mix(a, key, k) & mask, a
            else:
                a, b = b, a ^ _mix(b, key, k) & mask
        x[todo] = a << np.uint64(half) | b
        todo = todo[x[todo] >= np.uint64(n)]
    return x.astype(np.int64)


def _mix(x: np.ndarray, key: int, k: int) -> np.ndarray:
    y = x + np.uint64((key * 0x9E3779B97F4A7C15 + k * 0xD6E8FEB86659FD93 + 1) % (1 << 64))
    y = (y ^ y >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    y = (y ^ y >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return y ^ y >> np.uint64(31)


SLIM = "part int, at bigint, doc_id bigint, t bigint, n bigint"
PARTS = "slot bigint, place int, doc_id bigint, n int, ids binary"


def _slim(docs: DataFrame) -> DataFrame:
    """What is read of documents. Both passes must see the same partitions, so what is no plain scan is written first."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return spread(named if is_scan(named) else staged(named, "texts")).withColumn("t", F.xxhash64("text"))


def _counted(slim: DataFrame, held) -> DataFrame:
    """``SLIM`` rows: the tokens n of each document, and its place in the pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, at = Tokenizer(held.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            n = [tokenizer.encode_all(piece)[1] for piece in byte_slices(batch.column("text"))]
            where = [pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(at + np.arange(batch.num_rows))]
            at += batch.num_rows
            counts = pa.array(np.concatenate([*n, np.empty(0, np.int64)]))
            yield pa.RecordBatch.from_arrays([*where, batch.column("doc_id"), batch.column("t"), counts], ["part", "at", "doc_id", "t", "n"])

    return slim.mapInArrow(run, SLIM)


def _places(counted: DataFrame) -> tuple[DataFrame, int]:
    """(part, at, t, first): the place of each document's first id among all; and the number of all ids."""
    of = counted.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "t"), F.lit(BUCKETS))).withColumn("ids", F.col("n") + 1)
    before = Window.partitionBy("bucket").orderBy("doc_id", "t", "part", "at").rowsBetween(Window.unboundedPreceding, -1)
    inner = of.withColumn("inner", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    sums = of.groupBy("bucket").agg(F.sum("ids").alias("sum"))  # at most ``BUCKETS`` rows
    total = sums.agg(F.coalesce(F.sum("sum"), F.lit(0))).first()[0]
    base = sums.select("bucket", (F.sum("sum").over(Window.orderBy("bucket")) - F.col("sum")).alias("base"))
    placed = inner.join(F.broadcast(base), "bucket")
    return placed.select("part", "at", "t", (F.col("base") + F.col("inner")).cast("long").alias("first")), int(total)


def _first_ids(folder: str, part: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and text hashes of the documents of a partition, in its order."""
    system, path = open_folder(f"{folder}/part={part}")
    if system.get_file_info(path).type == filesystems.FileType.NotFound:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    names = [f.path for f in system.get_file_info(filesystems.FileSelector(path)) if f.path.endswith(".parquet")]
    rows = pa.concat_tables(parquet.ParquetFile(system.open_input_file(n)).read() for n in names).sort_by("at")
    return rows.column("first").to_numpy(), rows.column("t").to_numpy()


def parts(docs: DataFrame, length: int = LENGTH, key: int = KEY, path: str = VOCABULARY) -> tuple[DataFrame, int]:
    """``PARTS`` rows, each the ids of a document that lie in one sequence, with the sequence's slot; the number of slots.

    place: of the first id in its sequence. The last sequence is filled up with end marks, by a row whose n is 0.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(vocabulary(path))
    slim = _slim(docs)
    places, total = _places(staged(_counted(slim, held), "counts"))
    folder = f"{shared_dir(spark).rstrip('/')}/staged/places-{uuid.uuid4().hex}"
    remove_at_exit(spark, folder)
    places.repartition("part").sortWithinPartitions("part", "at").write.partitionBy("part").parquet(folder)
    slots = -(-total // length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(held.value)
        first, hashed = _first_ids(folder, TaskContext.get().partitionId())
        at = 0
        for batch in batches:
            end = at + batch.num_rows
            if not np.array_equal(hashed[at:end], batch.column("t").to_numpy()):
                raise RuntimeError("the documents are not those that were counted")
            done = at
            for piece in byte_slices(batch.column("text")):
                ids, n = tokenizer.encode_all(piece)
                ids = np.insert(ids, np.cumsum(n), np.array(END, ID))
                yield _cut(ids, n + 1, first[done : done + len(piece)], batch.column("doc_id").slice(done - at, len(piece)))
                done += len(piece)
            at = end

    def _cut(ids: np.ndarray, n: np.ndarray, first: np.ndarray, doc_ids: pa.Array) -> pa.RecordBatch:
        sequence = first // length
        many = (first + n - 1) // length - sequence + 1
        doc = np.repeat(np.arange(len(n)), many)
        number = sequence[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
        begin = np.maximum(first[doc], number * length)
        size = np.minimum((first + n)[doc], (number + 1) * length) - begin
        last = np.flatnonzero(first + n == total) if total % length else []
        if len(last):  # the end of all ids
            k = int(np.cumsum(many)[last[0]])
            more = length - total % length
            ids = np.insert(ids, int(np.cumsum(n)[last[0]]), np.full(more, END, ID))
            doc, number = np.insert(doc, k, last[0]), np.insert(number, k, slots - 1)
            begin, size = np.insert(begin, k, total), np.insert(size, k, more)
        ends = np.r_[0, np.cumsum(size)].astype(np.int32) * ID.itemsize
        bytes_ = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids))])
        told = [pa.array(feistel(number, slots, key)), pa.array((begin - number * length).astype(np.int32)), doc_ids.take(pa.array(doc)), pa.array(np.where(begin < total, size, 0).astype(np.int32)), bytes_]
        return pa.RecordBatch.from_arrays(told, ["slot", "place", "doc_id", "n", "ids"])

    return slim.mapInArrow(run, PARTS), slots


ROWS = "slot bigint, shard int, byte_offset bigint, n_tokens int, doc_ids array<bigint>"


def _materialised(docs: DataFrame, length: int, shard_rows: int, key: int, path: str, folder: str | None) -> DataFrame:
    """``ROWS`` and the ids of each sequence, by slot within a shard; with a folder, shards there and the ids' MD5 instead."""
    found, slots = parts(docs, length, key, path)
    shards = max(1, -(-slots // shard_rows))
    tasks = min(shards, MOST_TASKS)
    task = F.floor(F.floor(F.col("slot") / shard_rows) * tasks / shards).cast("int")
    dealt = found.repartitionById(tasks, task).sortWithinPartitions("slot", "place")
    stride = length * ID.itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with contextlib.ExitStack() as stack:
            writer = stack.enter_context(ShardWriter(folder)) if folder else None
            held = None
            for batch in batches:
                rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
                slot = rows.column("slot").to_numpy()
                cut = int(np.searchsorted(slot, slot[-1])) if len(slot) else 0  # the last slot may go on
                held = rows.slice(cut)
                if cut:
                    yield _told(rows.slice(0, cut).combine_chunks().to_batches()[0], writer)
            if held is not None and held.num_rows:
                yield _told(held.combine_chunks().to_batches()[0], writer)

    def _told(rows: pa.RecordBatch, writer: ShardWriter | None) -> pa.RecordBatch:
        slot = rows.column("slot").to_numpy()
        begin = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        slot, ends = slot[begin], np.r_[begin, len(slot)]
        n, real = rows.column("n").to_numpy(), np.flatnonzero(rows.column("n").to_numpy() > 0)
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(real, ends), pa.int32()), rows.column("doc_id").take(pa.array(real)))
        data, _ = text_bytes(rows.column("ids"))  # whole sequences, one after another
        shard = slot // shard_rows
        if writer:
            for k in np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]):
                end = int(np.searchsorted(shard, shard[k], "right"))
                writer.write(int(shard[k]), data[k * stride : end * stride])
        each = [data[k * stride : (k + 1) * stride].tobytes() for k in range(len(slot))]
        ids = pa.array([hashlib.md5(x).hexdigest() for x in each]) if folder else pa.array(each, pa.binary())
        told = [pa.array(slot), pa.array(shard.astype(np.int32)), pa.array(slot % shard_rows * stride), pa.array(np.add.reduceat(n, begin).astype(np.int32)), lists, ids]
        return pa.RecordBatch.from_arrays(told, ["slot", "shard", "byte_offset", "n_tokens", "doc_ids", "ids_md5" if folder else "ids"])

    return dealt.mapInArrow(run, f"{ROWS}, ids_md5 string" if folder else f"{ROWS}, ids binary")


class ShardWriter:
    """Writes shards one after another, each beside its name and then renamed, so a task that runs again replaces it whole."""

    def __init__(self, folder: str):
        self.system, self.path = open_folder(folder)
        self.shard, self.file, self.name = None, None, ""

    def __enter__(self) -> ShardWriter:
        self.system.create_dir(self.path, recursive=True)
        return self

    def write(self, shard: int, data: np.ndarray) -> None:
        if shard != self.shard:
            self._close()
            self.shard, self.name = shard, f"{self.path}/.shard-{shard:08d}.{TaskContext.get().taskAttemptId()}"
            self.file = self.system.open_output_stream(self.name)
        self.file.write(data)

    def _close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.system.move(self.name, shard_name(self.path, self.shard))
            self.file = None

    def __exit__(self, kind, _value, _trace) -> None:
        if kind is None:
            self._close()
        elif self.file is not None:
            self.file.close()


def shard_name(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:08d}.bin"


def training_order(docs: DataFrame, length: int = LENGTH, shard_rows: int = SHARD_ROWS, key: int = KEY, path: str = VOCABULARY) -> DataFrame:
    """One row (slot, shard, byte_offset, n_tokens, doc_ids, ids) for each sequence, sorted by slot within its shard.

    Slots are 0 to N - 1, each once, and the same however the documents are split into files and partitions. Shard k holds
    the slots from k * shard_rows; byte_offset is the slot's place in its shard at a fixed stride of 2 * length bytes.
    Every document is followed by one end mark; a null or empty text is that mark alone. The last sequence is filled up
    with end marks, which n_tokens does not count. doc_ids: of the documents with ids in it, in order; null for a null
    doc_id. Repeated rows are packed as often as they occur, one after another; rows tied in doc_id are ordered by a hash
    of their texts. A text of any length is tokenised as one row and runs on over as many sequences as it needs. An empty
    table gives no rows. Columns other than doc_id and text are not looked at, so further ones may have any name.
    """
    return _materialised(docs, length, shard_rows, key, path, None)


def sharded(docs: DataFrame, folder: str | None = None, length: int = LENGTH, shard_rows: int = SHARD_ROWS, key: int = KEY, path: str = VOCABULARY) -> DataFrame:
    """Rows of ``training_order`` with the MD5 of their ids instead of the ids, which are in the shards.

    The shards are written by this call, as ``shard-<k>.bin`` in a folder that all executors share: without one, in a folder
    of its own under the shared one, so no shard of another run is found among them. The rows are a manifest that the same
    pass has written; reading some of them, or all again, leaves the shards alone.
    """
    folder = folder or f"{shared_dir(docs.sparkSession).rstrip('/')}/shards-{uuid.uuid4().hex}"
    return staged(_materialised(docs, length, shard_rows, key, path, folder), "manifest")


def write_shards(docs: DataFrame, folder: str | None = None, length: int = LENGTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Write the shards of ``docs`` and return their manifest: (shard, n_sequences, n_tokens, n_bytes)."""
    rows = sharded(docs, folder, length, shard_rows).groupBy("shard")
    return rows.agg(F.count("*").alias("n_sequences"), F.sum("n_tokens").alias("n_tokens"), (F.count("*") * length * ID.itemsize).alias("n_bytes"))


def read_from(folder: str, slot: int, shard_rows: int = SHARD_ROWS, length: int = LENGTH) -> Iterator[np.ndarray]:
    """Sequences from ``slot`` on, in order: what a trainer that resumes reads."""
    stride = length * ID.itemsize
    system, path = open_folder(folder)
    shard, skip = divmod(slot, shard_rows)
    while system.get_file_info(name := shard_name(path, shard)).type == filesystems.FileType.File:
        with system.open_input_file(name) as file:
            file.seek(skip * stride)
            while piece := file.read(stride):
                yield np.frombuffer(piece, ID)
        shard, skip = shard + 1, 0
