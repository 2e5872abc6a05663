"""Prefix trie of conversations: a double-array trie for each range of turn sequences, open nodes merged over all ranges.

A turn is its MD5 (of role and text) and its text's length, 20 bytes, so texts are not shuffled. A rebuilt conversation is the
string of its turns; equal ones are one row with their number and their least conv_id. Those rows are dealt out by ranges of
the sequence, so that a first turn that a third of all conversations have is shared by many tasks. In a range turns get
dense ids, and BASE and CHECK arrays are packed: a child of the node in slot ``s`` by turn ``t`` is in slot
``BASE[s] + t``, and is there if ``CHECK`` of it is ``s``. Walking each sequence gives its nodes; all aggregates of a node
are sums, or a least number, over the sequences below it.

A range knows the last sequence before it and the first one after it. Only nodes on those two have members elsewhere. Such
open nodes go on by a digest of their path, and are summed over ranges; each node is counted by the range where it first
comes up, and each leaf by the range that holds it, so nothing counts twice. All other nodes are final in their range.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import spread, staged

#: A base conversation stands for itself and those after it up to the next; prefixes of up to ``LONGEST`` turns are shared.
GROUP, LONGEST = 5, 9
#: Bytes of a turn: its MD5 and the length of its text.
TURN = 20
#: Turns of a shard, about; conv_ids of a row of ends.
SHARD_TURNS, CHUNK = 1 << 17, 4096
EMPTY = hashlib.sha256(b"").hexdigest()
#: Slots that are looked through for a node with several children before it goes to the end.
LOOKS = 64

NODE = T.StructType(
    [
        T.StructField("path", T.BinaryType()),
        T.StructField("parent_path", T.BinaryType()),
        *(T.StructField(n, T.LongType()) for n in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_at")),
    ]
)


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, key): a turn's key in 40 hex digits. Null role and text are empty."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    key = F.concat(F.md5(said), F.lpad(F.hex(F.octet_length(text).cast("long")), 8, "0"))
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), key.alias("key"))


def rebuilt(turn_rows: DataFrame, group: int = GROUP, longest: int = LONGEST) -> DataFrame:
    """(conv_id, seq): the first h turns of the base conversation, then a conversation's own after its first h."""
    digits = 2 * TURN
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("turn", "key"))), lambda x: x["key"])
    own = staged(turn_rows.groupBy("conv_id").agg(F.array_join(ordered, "").alias("own")), "own")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % longest
    each = own.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), (h * digits).cast("int").alias("upto"))
    bases = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.substring("own", 1, (longest - 1) * digits).alias("first"))
    seq = F.concat(F.substring(F.coalesce("first", F.lit("")), F.lit(1), F.col("upto")), F.substring(F.col("own"), F.col("upto") + 1, F.length("own")))
    return each.join(bases, "base", "left").select("conv_id", F.unhex(seq).alias("seq"))


# ---- ends -------------------------------------------------------------------------------------------------------------


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each sequence's conv_ids, from rows in order: a row at a time, so any number of rows may be of one sequence."""
    key, first, state = None, None, None
    for batch in batches:
        out = []
        for seq, start, ids in zip(batch.column("seq").to_pylist(), batch.column("start").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if state is not None and seq == key:
                state.update(b",")
            else:
                if state is not None:
                    out.append((first, state.hexdigest()))
                key, first, state = seq, start, hashlib.sha256()
            state.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["ends_at", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([state.hexdigest()])], ["ends_at", "ends_sha256"])


def chunks(rows: DataFrame) -> DataFrame:
    """(seq, start, ids, n): conv_ids of equal sequences, joined, those of one range of ``CHUNK`` numbers in a row."""
    ids = F.sort_array(F.collect_list("conv_id"))
    by = rows.groupBy("seq", F.floor(F.col("conv_id") / CHUNK).alias("range")).agg(ids.alias("ids"))
    return by.select("seq", F.col("ids")[0].alias("start"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), F.size("ids").cast("long").alias("n"))


# ---- a shard ----------------------------------------------------------------------------------------------------------


class DoubleArray:
    """A trie over sequences of dense ids, added in order, packed in BASE and CHECK. The root is in slot 0."""

    def __init__(self, sequences: list[np.ndarray]):
        self.base, self.check = array("q", [0]), array("q", [-2])
        self._free = 1  # no slot below is free
        # Children by node, nodes by number in the order in which sequences first come to them.
        children: list[list[int]] = [[]]
        node_of: list[list[int]] = [[]]
        path, before = [0], np.zeros(0, np.int64)
        for seq in sequences:
            shared = common_length(before, seq)
            del path[shared + 1 :]
            for turn in seq[shared:].tolist():
                children[path[-1]].append(turn)
                node_of[path[-1]].append(len(children))
                path.append(len(children))
                children.append([])
                node_of.append([])
            before = seq
        slots = [0] * len(children)
        for node, own in enumerate(children):  # a parent has a smaller number, so its slot is known
            if own:
                order = sorted(range(len(own)), key=own.__getitem__)
                base = self._fit([own[k] for k in order])
                self.base[slots[node]] = base
                for k in order:
                    slots[node_of[node][k]] = base + own[k]
                    self.check[base + own[k]] = slots[node]
        self.nodes = len(children)

    def _fit(self, own: list[int]) -> int:
        """A base from which the slots of all these turns, rising, are free."""
        check = self.check
        while self._free < len(check) and check[self._free] != -1:
            self._free += 1
        at, base = self._free, None
        for _ in range(LOOKS):
            if at >= len(check):
                break
            if check[at] == -1 and all(at + t - own[0] >= len(check) or check[at + t - own[0]] == -1 for t in own):
                base = at - own[0]
                break
            at += 1
        if base is None:
            base = len(check) - own[0]
        missing = base + own[-1] + 1 - len(check)
        if missing > 0:
            check.extend(array("q", [-1]) * missing)
            self.base.extend(array("q", [0]) * missing)
        return base

    def walk(self, seq: list[int]) -> list[int]:
        """Slots of the nodes along a sequence from the root on, as far as it is in the trie."""
        base, check, at, out = self.base, self.check, 0, [0]
        for turn in seq:
            to = base[at] + turn
            if not 0 <= to < len(check) or check[to] != at:
                break
            out.append(to)
            at = to
        return out


def common_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def _turns_of(seq: bytes) -> np.ndarray:
    return np.frombuffer(seq, f"V{TURN}")


def _shared(a: bytes | None, b: bytes) -> int:
    """Depth to which two sequences share nodes; -1 where there is no other."""
    return -1 if a is None else common_length(_turns_of(a), _turns_of(b))


def shard_nodes(seqs: list[bytes], counts: list[int], firsts: list[int], before: bytes | None, after: bytes | None) -> list[tuple]:
    """Rows of ``NODE`` for a range of distinct sequences, in order; ``before`` and ``after`` are the neighbours of the range.

    A final node has no ``path``; a node whose parent is open has ``parent_path`` in place of ``parent_conv_id``.
    """
    known, ids = np.unique(np.concatenate([_turns_of(s) for s in seqs]), return_inverse=True)
    cuts = np.cumsum([len(s) // TURN for s in seqs])[:-1]
    # Dense ids in the order of their first place, so that siblings are often neighbours.
    first_place = np.full(len(known), len(ids))
    np.minimum.at(first_place, ids, np.arange(len(ids)))
    dense = np.empty(len(known), np.int64)
    dense[np.argsort(first_place)] = np.arange(len(known))
    size = np.empty(len(known), np.int64)
    size[dense] = [int.from_bytes(k.tobytes()[16:], "big") for k in known]
    size = size.tolist()
    sequences = np.split(dense[ids], cuts)
    trie = DoubleArray(sequences)
    n = len(trie.check)
    convs, least, below, leaves, weight, own_size, ends, depth_of = (array("q", [0]) * n for _ in range(8))
    least, ends = array("q", [2**63 - 1]) * n, array("q", [-1]) * n
    children, seen = array("q", [0]) * n, bytearray(n)
    low, high = _shared(before, seqs[0]), _shared(after, seqs[-1])
    upper: dict[int, tuple[bytes, bytes | None]] = {}  # open slots: digests of path and parent's path
    order: list[int] = []
    for k, (seq, count, first) in enumerate(zip(sequences, counts, firsts, strict=True)):
        path = trie.walk(seq.tolist())
        lengths = [0, *(size[t] for t in seq.tolist())]
        open_to = max(low if k == 0 else -1, high if k == len(seqs) - 1 else -1)
        digest = b""
        for d, at in enumerate(path):
            if not seen[at]:
                seen[at], depth_of[at], own_size[at] = 1, d, lengths[d]
                order.append(at)
                # Nodes shared with an earlier range are counted there.
                if d and not (k == 0 and d <= low):
                    children[path[d - 1]] += 1
                    weight[at] -= lengths[d]
            convs[at] += count
            weight[at] += count * lengths[d]
            least[at] = min(least[at], first)
            if d <= open_to and at not in upper:
                parent = digest if d else None
                digest = hashlib.blake2b(digest + seqs[k][(d - 1) * TURN : d * TURN] if d else b"", digest_size=16).digest()
                upper[at] = digest, parent
            elif d <= open_to:
                digest = upper[at][0]
        ends[path[-1]] = k
        following = seqs[k + 1] if k + 1 < len(seqs) else after
        if following is None or not following.startswith(seqs[k]):
            leaves[path[-1]] += 1
    # Children come after their parents, so sums go up in one pass.
    for at in reversed(order):
        if at:
            parent = trie.check[at]
            leaves[parent] += leaves[at]
            weight[parent] += weight[at]
    out = []
    for at in order:
        path, parent_path = upper.get(at, (None, None))
        parent = trie.check[at] if at else None
        if parent is not None and path is None and parent in upper:
            parent_path = upper[parent][0]
        known_parent = None if parent is None or parent in upper else least[parent]
        out.append((path, parent_path, least[at], depth_of[at], known_parent, convs[at], children[at], leaves[at], weight[at], firsts[ends[at]] if ends[at] >= 0 else None))
    return out


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of each shard; rows come in order of shard and sequence."""
    schema = pa.schema([("path", pa.binary()), ("parent_path", pa.binary()), *((f.name, pa.int64()) for f in NODE.fields[2:])])

    def emit(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        found = shard_nodes([r["seq"] for r in rows], [r["n"] for r in rows], [r["first"] for r in rows], rows[0]["before"], rows[-1]["after"])
        for at in range(0, len(found), 1 << 14):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found[at : at + (1 << 14)], strict=True), schema, strict=True)], schema=schema)

    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["shard"] != row["shard"]:
                yield from emit(held)
                held = []
            held.append(row)
    if held:
        yield from emit(held)


# ---- the operator -----------------------------------------------------------------------------------------------------


def in_shards(distinct: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """(shard, seq, n, first, before, after): ranges of the sequences; a range's first and last row know their neighbour outside.

    Rows of a shard lie together, in order.
    """
    total = distinct.agg(F.sum(F.octet_length("seq"))).first()[0] or 0
    shards = max(distinct.sparkSession.sparkContext.defaultParallelism, -(-total // (TURN * shard_turns)))
    dealt = staged(distinct.repartitionByRange(shards, "seq").select(F.spark_partition_id().alias("shard"), "seq", "n", "first"), "shards")
    along = Window.orderBy("shard")  # a row for each shard
    ends = (
        dealt.groupBy("shard")
        .agg(F.min("seq").alias("least"), F.max("seq").alias("most"))
        .select("shard", "least", "most", F.lag("most").over(along).alias("before"), F.lead("least").over(along).alias("after"))
    )
    known = dealt.join(ends, "shard").select(
        "shard", "seq", "n", "first", F.when(F.col("seq") == F.col("least"), F.col("before")).alias("before"), F.when(F.col("seq") == F.col("most"), F.col("after")).alias("after")
    )
    return known.repartition(shards, "shard").sortWithinPartitions("shard", "seq")


def nodes(rows: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The trie's nodes from rows (conv_id, seq), a sequence being ``TURN`` bytes a turn: see ``op11_digest``."""
    pieces = staged(chunks(rows), "ends")
    distinct = staged(pieces.groupBy("seq").agg(F.sum("n").alias("n"), F.min("start").alias("first")), "distinct")
    found = staged(in_shards(distinct, shard_turns).mapInArrow(_shards, NODE), "nodes")
    summed = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    opened = (
        found.where("path is not null")
        .groupBy("path")
        .agg(F.first("parent_path").alias("parent_path"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_conv_id").alias("parent_conv_id"), *(F.sum(c).alias(c) for c in summed), F.max("ends_at").alias("ends_at"))
    )
    parents = opened.select(F.col("path").alias("parent_path"), F.col("conv_id").alias("upper"))
    every = found.where("path is null").unionByName(opened).join(parents, "parent_path", "left")
    digests = pieces.repartition("seq").sortWithinPartitions("seq", "start").select("seq", "start", "ids").mapInArrow(_digests, "ends_at long, ends_sha256 string")
    return every.join(digests, "ends_at", "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "upper").alias("parent_conv_id"), *summed, F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")
    )


def op11_digest(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node of the rebuilt conversations.

    Rows without conv_id belong to no conversation and are left out. Null turns come first; turns tied in number go by the
    MD5 of role and text, and repeated rows stay, one after the other. Null role and text are empty. A conversation whose
    base is absent starts with nothing, so it may have no turns; it still is a member of the root and ends there. Very long
    texts are only hashed; a conversation must fit a task with 20 bytes a turn. An empty table gives no rows, not even a
    root. Columns other than conv_id, turn, role and text are not looked at. Remainders of negative conv_ids are negative.
    The list of a node's ends is hashed in one task, as SHA-256 has it, but never held there.
    """
    return nodes(staged(rebuilt(turns(spread(conversations))), "rebuilt"))


OP11_SQL = """
with recursive crc_table as (
  select list(list_reduce(list_prepend(i::bigint, range(8)), lambda c, _ : case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as entries
  from range(256) t(i)),
said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
keyed as (
  select conv_id, turn, octet_length(encode(text)) as size,
    md5(octet_length(encode(role))::varchar || ':' || role || text) as key from said),
placed as (select conv_id, size, key, row_number() over (partition by conv_id order by turn nulls first, key) as pos from keyed),
convs as (
  select conv_id as c, conv_id - conv_id % 5 as base, xor(list_reduce(list_prepend(4294967295::bigint,
    list_transform(range(1, length(conv_id::varchar) + 1), lambda i : ascii(substr(conv_id::varchar, i::int, 1))::bigint)),
    lambda c, b : xor(c >> 8, entries[xor(c, b) % 256 + 1])), 4294967295::bigint) % 9 as h
  from (select distinct conv_id from placed), crc_table),
taken as (
  select c, pos, size, key from convs join placed on placed.conv_id = base where pos <= h
  union all
  select c, least(h, coalesce(n, 0)) + pos - h, size, key
  from convs join placed on placed.conv_id = c left join (select conv_id, count(*) as n from placed group by conv_id) b on b.conv_id = base
  where pos > h),
walked as (
  select c, pos as depth, size, md5(string_agg(key, '') over (partition by c order by pos rows unbounded preceding)) as path,
    md5(coalesce(string_agg(key, '') over (partition by c order by pos rows between unbounded preceding and 1 preceding), '')) as up from taken
  union all select c, 0, 0, md5(''), null from convs),
node as (select depth, path, any_value(up) as up, any_value(size) as size, min(c) as conv_id, count(*) as n_convs from walked group by depth, path),
kids as (select depth - 1 as depth, up as path, count(*) as n from node where depth > 0 group by 1, 2),
told as (select node.*, coalesce(kids.n, 0) as n_children from node left join kids using (depth, path)),
below as (
  select w.depth, w.path, sum(case when t.n_children = 0 then 1 else 0 end) as n_leaves, sum((t.n_convs - 1) * t.size) as saved_tokens
  from told t join walked w on w.c = t.conv_id and w.depth <= t.depth group by 1, 2),
ended as (
  select depth, path, string_agg(c::varchar, ',' order by c) as ids
  from (select c, arg_max(depth, depth) as depth, arg_max(path, depth) as path from walked group by c) group by 1, 2)
select t.conv_id, t.depth::bigint as depth, p.conv_id as parent_conv_id, t.n_convs::bigint as n_convs, t.n_children::bigint as n_children,
  b.n_leaves::bigint as n_leaves, b.saved_tokens::bigint as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from told t join below b using (depth, path) left join told p on p.depth = t.depth - 1 and p.path = t.up
left join ended e on e.depth = t.depth and e.path = t.path
"""
