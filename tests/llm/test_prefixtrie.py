"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from lakescreen.llm import prefixtrie, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Nodes as the contract tells them, from a dictionary of all prefixes."""
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            by.setdefault(c, []).append(((turn is not None, turn or 0, key), (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in by.items()}
    members, ends = {}, {}
    for c in own:
        base = int(np.fix(c / 5)) * 5
        h = zlib.crc32(str(c).encode()) % 9
        seq = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
        ends.setdefault(seq, []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) if p in kids else 1
        saved[p] = sum(saved[k] for k in kids.get(p, [])) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())
        for p, m in members.items()
    )


def told(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def cases():
    rng = random.Random(3)
    rows = []
    for c in range(120):
        first = rng.choice(["hi", "hi", "hello", "é€", ""])
        for t in range(rng.randrange(1, 12)):
            rows.append((c, t, rng.choice(["user", "bot"]) if t else "user", first if t == 0 else rng.choice(["a", "b", None])))
    rows += [(c, t, "user", f"copy {t}") for c in range(1000, 1200) for t in range(11)]  # mostly equal conversations
    rows += [(2000, t, "user", f"long {t}") for t in range(3000)] + [(2001, 0, "user", "x" * 200_000)]
    rows += [(2500, 1, None, None), (2500, None, "user", "first"), (2500, 1, "user", "tied"), (2500, 1, "bot", "tied"), (2500, 1, "bot", "tied")]
    rows += [(3003, 0, "user", "own"), (3004, 1, "user", "no base")]  # 3000 is absent
    rows += [(-7, 0, "user", "minus"), (-5, 0, "user", "hi"), (-5, 1, "user", "there"), (None, 0, "user", "nobody"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_turns", [40, 1 << 17])
def test_nodes_equal_brute_force(spark, shard_turns):
    rows = cases()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    sequences = prefixtrie.rebuilt(prefixtrie.turns(df))
    assert told(prefixtrie.nodes(sequences, shard_turns)) == brute(rows)


def test_long_lists_of_ends_are_hashed_over_several_rows(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "CHUNK", 7)
    rows = [(c, 0, "user", "same") for c in [*range(0, 300, 3), 10**15]]
    assert told(prefixtrie.op11_digest(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_the_query_with_clashing_columns_and_an_empty_table(spark, tmp_path):
    rows = [r for r in cases() if (r[0] or 0) < 60]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA + ", depth int, key string, seq int")
    df.write.parquet(str(tmp_path / "full" / "conversations.parquet"))
    df.limit(0).write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    assert told(queries.QUERIES["op11_prefix_trie"](spark, str(tmp_path / "full"))) == brute(rows)
    assert queries.QUERIES["op11_prefix_trie"](spark, str(tmp_path / "none")).count() == 0


def test_the_sql_says_the_same(tmp_path):
    import duckdb

    rows = cases()
    con = duckdb.connect()
    con.sql("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", [r for r in rows if (r[0] or 0) != 2000])
    got = con.sql(prefixtrie.OP11_SQL).fetchall()
    assert sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in got) == brute([r for r in rows if r[0] != 2000])


def test_double_array_holds_its_sequences_and_no_others():
    rng = random.Random(9)
    for width in (2, 5, 400):
        sequences = sorted({tuple(rng.randrange(width) for _ in range(rng.randrange(6))) for _ in range(500)})
        trie = prefixtrie.DoubleArray([np.array(s, np.int64) for s in sequences])
        prefixes = {s[:d] for s in sequences for d in range(len(s) + 1)}
        assert trie.nodes == len(prefixes) and sum(c >= 0 for c in trie.check) == len(prefixes) - 1
        slots = {p: trie.walk(list(p)) for p in prefixes}
        assert all(len(v) == len(p) + 1 for p, v in slots.items()) and len({v[-1] for v in slots.values()}) == len(prefixes)
        for _ in range(300):
            p = tuple(rng.randrange(width + 1) for _ in range(4))
            known = max(d for d in range(5) if p[:d] in prefixes)
            assert len(trie.walk(list(p))) == known + 1
