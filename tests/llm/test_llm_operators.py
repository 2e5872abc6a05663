"""The training-data operators against brute force on small tables: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lakescreen.llm import linededup, mixing, simhash, topk, toxicity, urlrules
from lakescreen.llm.common import components

RNG = random.Random(11)
WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "Zeta", "ÆTA", "x"]


def say(n):
    return " ".join(RNG.choice(WORDS) + str(RNG.randrange(50)) for _ in range(n))


# ---- components and SimHash -------------------------------------------------------------------------------------------


def union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    pairs = [(RNG.randrange(60), RNG.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(40)] + [(200, 201 + k) for k in range(40)] + [(5, 5)]
    edges = spark.createDataFrame([*pairs, (None, 3)], "a long, b long")
    want = union(300, pairs)
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {x: want[x] for p in pairs if p[0] != p[1] for x in p}
    assert components(edges.limit(0)).count() == 0


def print_of(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + n]), 42) for k in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_cases():
    base = [say(RNG.choice([1, 2, 3, 40, 200])) for _ in range(25)]
    texts = [*base, None, "", " \n\t", *base[:5], *(b.replace("1", "7", 1) for b in base), *(b + "\x0bend" for b in base[10:]), "é " * 3000, say(4000)]
    return [(k * 3 % 101 if k != 7 else None, t, k) for k, t in enumerate(texts)]


def close(values):
    return [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 3]


def test_any_five_shared_bytes_meet_in_a_list():
    assert (simhash.FIRST_COMBO[simhash.SHARED >= 5] >= 0).all()
    assert len(simhash.COMBOS) == 8


@pytest.mark.parametrize(("near", "crowd"), [(64, 4096), (2, 4096), (2, 3)])
def test_links_of_crowded_lists_connect_as_all_links(monkeypatch, near, crowd):
    """All pairs compared, split lists, and stars give the same components."""
    monkeypatch.setattr(simhash, "NEAR", near)
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(near + crowd)
    values = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(60):
            values.add(base)
            base ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])))
        values |= {base ^ sum(1 << b for b in rng.sample(range(24), rng.choice([1, 2, 3, 4, 5]))) for _ in range(40)}
    values = sorted(values)
    table = pa.RecordBatch.from_arrays([pa.array(np.array(values, np.uint64).view(np.int64))], ["fp"])
    posted = pa.Table.from_batches(list(simhash._postings(iter([table])))).sort_by([("key", "ascending"), ("fp", "ascending")])
    place = {v: k for k, v in enumerate(values)}
    told = [b for b in simhash._links(iter(posted.to_batches(max_chunksize=97)))]
    pairs = [(place[a & (1 << 64) - 1], place[b & (1 << 64) - 1]) for r in told for a, b in zip(r.column("a").to_pylist(), r.column("b").to_pylist(), strict=True)]
    assert union(len(values), pairs) == union(len(values), close(values))


def test_simhash_equals_brute_force(spark):
    rows = near_cases() + near_cases()[:3]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int").withColumn("component_id", F.lit("x")).withColumn("_key", F.lit("k"))
    prints = [print_of(t) for _, t, _ in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    comp = union(len(rows), pairs)
    least = {c: min((rows[i][0] for i in range(len(rows)) if comp[i] == c and rows[i][0] is not None), default=None) for c in set(comp)}
    want = sorted(((rows[i][0], f"{prints[i]:016x}", least[comp[i]]) for i in range(len(rows))), key=repr)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert got == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r._key for r in kept.select("_key").distinct().collect()} == {"k"}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=repr) == sorted(least.values(), key=repr)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_crowded_lists_lose_no_link():
    rng = np.random.default_rng(4)
    low = np.unique(rng.integers(0, 1 << 12, 700, dtype=np.uint64))
    v = low | np.uint64(0xABCDEF << 24)
    near = np.bitwise_count(v[:, None] ^ v[None]) <= 3
    a, b = simhash.forest(v)
    place = {int(x): k for k, x in enumerate(v)}
    assert len(a) < len(v)
    mine = union(len(v), [(place[int(x)], place[int(y)]) for x, y in zip(a, b, strict=True)])
    assert mine == union(len(v), list(zip(*(x.tolist() for x in np.nonzero(near)), strict=True)))


def test_lists_are_bridged_over_batches():
    sizes = [1, 30, 2, 1, 90]
    of = np.repeat(np.arange(5, dtype=np.uint64), sizes)
    key = of << np.uint64(16)
    fp = np.concatenate([np.arange(n, dtype=np.uint64) << np.uint64(56) for n in sizes]) | of
    whole = pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64))], ["key", "fp"])
    parts = [whole.slice(k, 7) for k in range(0, len(key), 7)]
    told = lambda batches: {frozenset(p) for x in simhash._links(iter(batches)) for p in zip(*(c.to_pylist() for c in x.columns), strict=True)}
    place = {v: k for k, v in enumerate(fp.view(np.int64).tolist())}
    linked = lambda pairs: union(len(fp), [tuple(place[x] for x in p) for p in pairs])
    assert linked(told(parts)) == linked(told([whole])) == union(len(fp), [(i, j) for i, j in close(fp.tolist()) if of[i] == of[j]])


# ---- mixing -----------------------------------------------------------------------------------------------------------


def level(sizes, weights, most=3):
    """Targets by filling up sources again and again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        full = {s for s in open_ if left * w[s] / total >= most * sizes[s]}
        if not full:
            return target | {s: left * w[s] / total for s in open_}
        for s in full:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1, "c": 2, None: 40}, {"a": 5, "B": 5, "é": 900}, {"x": 0, "y": 0}, {"x": 0, "y": 7, None: 1}, {"only": 12}])
def test_targets_are_the_water_level(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    assert got == pytest.approx(level(sizes, mixing.WEIGHTS))


def test_mix(spark):
    rows = [(k, say(k % 40), f"s{k % 3}" if k % 10 else None, "z") for k in range(300)] + [(None, None, None, "z"), (5, None, "s1", "z"), (5, None, "s1", "z"), (301, "", "s1", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    plan = mixing.plan(docs).collect()
    assert len(plan) == len(rows)
    assert sum(r.size for r in plan) == sum(len((t or "").split()) for _, t, *_ in rows)
    assert all(r.taken <= 3 * r.size and r.taken == r.size * r.copies for r in plan)
    for s in ("s0", "s1", "s2", None):
        of = [r for r in plan if r.source == s]
        assert sum(r.taken for r in of) == pytest.approx(of[0].target, rel=0.25)
    again = sorted(map(repr, mixing.plan(docs.repartition(7)).collect()))
    assert again == sorted(map(repr, plan))
    same = [(k % 2 or None, say(k % 40 + 1), "one" if k % 3 else "two") for k in range(600)]  # no doc_id, or one for many
    told = mixing.plan(spark.createDataFrame(same, "doc_id long, text string, source string")).collect()
    for s in ("one", "two"):
        of = [r for r in told if r.source == s]
        assert sum(r.taken for r in of) == pytest.approx(of[0].target, rel=0.15)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in plan)
    assert mixing.plan(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


# ---- line dedup -------------------------------------------------------------------------------------------------------


def removed(rows, least):
    """Lines in a run of ``least`` words that begins earlier somewhere; by comparing every run with every other."""
    docs = sorted({(d, t) for d, t in rows if t is not None}, key=lambda x: x[0])
    lines = [[(k, " ".join(x.split())) for k, x in enumerate(t.split("\n")) if x.split()] for _, t in docs]
    runs = {}
    out = {d: set() for d, _ in docs}
    for i, own in enumerate(lines):
        for a in range(len(own)):
            words = 0
            for b in range(a, len(own)):
                words += len(own[b][1].split())
                if words >= least:
                    content = tuple(x for _, x in own[a : b + 1])
                    first = runs.setdefault(content, (i, own[a][0]))
                    if first < (i, own[a][0]):
                        out[docs[i][0]] |= set(range(own[a][0], own[b][0] + 1))
    return out


def line_cases():
    pool = [say(n) for n in (3, 5, 8, 12, 20, 30)] + ["", "  ", "dup dup", say(60)]
    block = [say(9), say(4), say(7)]
    rows = []
    for k in range(40):
        own = [RNG.choice(pool) if RNG.random() < 0.6 else say(RNG.randrange(1, 15)) for _ in range(RNG.randrange(1, 14))]
        at = RNG.randrange(len(own) + 1)
        own[at:at] = block if k % 3 == 0 else []
        rows.append((k, "\n".join(own)))
    return [*rows, rows[3], (50, None), (51, ""), (52, "\n".join(["same words here"] * 30)), (53, rows[5][1].replace(" ", "\t "))]


@pytest.mark.parametrize("least", [1, 10, 20, 50])
def test_line_dedup_equals_brute_force(spark, least):
    rows = line_cases()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash"))
    want = removed(rows, least)
    docs = docs.withColumn("_key", F.lit("k")).withColumn("_d", F.lit(1)).withColumn("_t", F.lit(2))
    cleaned = linededup.dedup_lines(docs, least)
    assert cleaned.select("_key", "_d", "_t").distinct().count() == 1
    for r in cleaned.collect():
        text = dict(rows)[r.doc_id]
        gone = want.get(r.doc_id, set())
        lines = (text or "").split("\n")
        told = {k for run in filter(None, r.runs.split(",")) for k in range(int(run.split("-")[0]), int(run.split("-")[1]) + 1)}
        # Runs of several windows may hold blank lines that no window does.
        assert {k for k in told if lines[k].split()} == {k for k in gone if lines[k].split()}, (r.doc_id, r.runs, sorted(gone))
        assert told <= gone and r.n_removed == len(told)
        gone = told
        assert r.text == (None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone))
        assert r.n_lines == (0 if text is None else text.count("\n") + 1)
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


# ---- exact top-k ------------------------------------------------------------------------------------------------------


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = [(k, rng.normal(size=16).round(2 if k % 2 else 5).tolist()) for k in range(300)]
    vectors += [(0, vectors[7][1]), (301, vectors[9][1]), (302, vectors[9][1]), (303, None), (304, [1.0, None]), (350, [float("nan")] * 16), (305, [float("inf")] * 16), (None, [1.0] * 16), (400, []), (450, [1.0, 2.0]), (451, [3.0, 2.0])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).repartition(5)
    whole = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    asked = {}
    for i, v in whole:
        if i % 50 == 0:
            asked.setdefault(i, []).append(v)
    for i, options in asked.items():
        if len(options) == 1:
            scores = sorted((-sum(a * b for a, b in zip(options[0], v, strict=True)), j) for j, v in whole if j != i and len(v) == len(options[0]))
            want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:5])}
    for rows in (4096, 2):
        got = {tuple(r) for r in topk.search(frame, query_rows=rows).collect()}
        assert {g for g in got if len(asked[g[0]]) == 1} == want
    assert topk.search(frame.limit(0)).count() == 0


def isotropic(n):
    v = np.random.default_rng(6).normal(size=(n, 64))
    return np.floor(256 * v / np.sqrt((v * v).sum(1))[:, None])


@pytest.mark.parametrize(("make", "share"), [(lambda n: np.floor(np.random.default_rng(5).normal(size=(n, 64)).cumsum(1) * 50), 0.2), (isotropic, 0.2)])
@pytest.mark.parametrize("seeded", [True, False])
def test_bounds_spare_exact_scores(make, share, seeded):
    v = make(8000)
    ids, q = np.arange(4), v[:4]
    best = topk.Best(ids, q, 5, topk.bars(ids, q, np.arange(1000, 3000), v[1000:3000], 5) if seeded else None)
    best.see(np.arange(len(v)), v)
    assert best.exact < 4 * len(v) * (share if seeded else share + 1024 / 8000)
    scores = v[:4] @ v.T
    for k in range(4):
        order = sorted((-scores[k, n], n) for n in range(len(v)) if n != k)[:5]
        assert [(-s, n) for s, n in order] == list(zip(best.score[k].tolist(), best.vec[k].tolist(), strict=True))


def test_scores_beyond_double_are_whole():
    assert topk._exact(np.array([[2.0**40 + 1, 1.0]]), np.array([[2.0**20 + 1, 3.0]])).tolist() == [[(2**40 + 1) * (2**20 + 1) + 3]]


# ---- toxicity ---------------------------------------------------------------------------------------------------------


def labelled(n):
    bad = ["idiot", "moron", "scum"]
    rows = []
    for k in range(n):
        words = say(RNG.randrange(1, 120)).split()
        toxic = k % 4 == 0
        if toxic:
            words.insert(RNG.randrange(len(words) + 1), RNG.choice(bad).upper() if k % 8 else RNG.choice(bad))
        rows.append((k, " ".join(words), int(toxic)))
    return rows


def test_toxicity_is_learnt_and_held_out(spark):
    rows = labelled(900)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(2000, None, "x"), (2001, "", "x"), (None, "idiot", "x"), (2002, say(6000) + " idiot " + say(6000), "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None), (99999, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, rows=500)
    got = {r.doc_id: r for r in toxicity.scores(docs, model).collect()}
    out = [(y, got[i].predicted) for i, _, y in rows if got[i].held_out]
    assert len(out) > 200 and np.mean([a == b for a, b in out]) > 0.95
    assert all(got[i].held_out == toxicity.held_out(i) for i, *_ in rows)
    assert got[2000].score == got[2001].score == toxicity.EMPTY and got[2002].predicted == 1 and got[None].predicted == 1
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(i for i, r in got.items() if i is not None and r.predicted == 0)
    assert toxicity.scores(docs.limit(0), model).count() == 0
    alone = toxicity.learn(docs, labels.where("toxic = 0"))
    assert {r.score for r in toxicity.scores(docs, alone).collect()} == {0.0}


def test_gradients():
    rng = np.random.default_rng(1)
    w = {k: v.astype(np.float64) for k, v in toxicity._initial(rng, 3, np.zeros(3)).items()}
    x = rng.normal(size=(5, 4, toxicity.WORD_DIM + toxicity.CHAR_DIM + 1))
    live = np.arange(5)[:, None] < np.array([5, 3, 1, 4])
    y = np.array([1.0, 0, 1, 0])

    def loss():
        s = np.concatenate([toxicity._read(w, way, x @ w[f"x{way}"] + w[f"c{way}"], live)[0] for way in "fb"], axis=2)
        p = toxicity._sigmoid(toxicity._pool(w, s, live)[0])
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grads, dx = toxicity._backward(w, x, live, y)
    for name in ("xf", "hf", "cb", "hb", "att", "out"):
        at = tuple(rng.integers(0, n) for n in w[name].shape)
        w[name][at] += 1e-3
        up = loss()
        w[name][at] -= 2e-3
        down = loss()
        w[name][at] += 1e-3
        assert grads[name][at] == pytest.approx((up - down) / 2e-3, abs=2e-4), name
    x[0, 0, 0] += 1e-3
    up = loss()
    x[0, 0, 0] -= 2e-3
    assert dx[0, 0, 0] == pytest.approx((up - loss()) / 2e-3, abs=2e-4)


def test_windows_cover_every_word():
    for n in (1, 5, 24, 25, 36, 37, 100, 1001):
        words = toxicity.split(*toxicity.text_bytes(pa.array(["w " * n])), toxicity.IS_WORD)
        start, live, _ = toxicity._windows(words)
        assert set(range(n)) == {k for s, m in zip(start, live, strict=True) for k in range(s, s + m)}


# ---- URL rules --------------------------------------------------------------------------------------------------------


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    cut = min([path.index(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if c.isascii() else c for c in rest[:end]), path[:cut]


def rule(host, path):
    fits = [r for r in urlrules.RULES if (own := r.name.split("/", 1)) and (host == own[0] or host.endswith("." + own[0])) and path.startswith("/" + own[1])]
    return max(fits, key=lambda r: len(r.name), default=None)


def test_url_rules_equal_brute_force(spark):
    hosts = ["a.example.com", "WWW.example.com", "www.example.com", "b.net", "net", "com", "xcom", "c.example.org", "bad-site.org", "bad-site.com", "example.com.org"]
    urls = [f"{RNG.choice(['http', 'https'])}://{RNG.choice(hosts)}{RNG.choice(['', '/', '/en/1', '/en/2?x=/fr/', '/es/3#a', '/fr/4', '/de/5.html', '?q=1', '/EN/7'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "://", "http://", "ftp://ÜX.Net/es/", "a://b://c.net/es/", "http://x.com\n/en/"]
    pages = spark.createDataFrame([(k % 390, u, "x") for k, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = urlrules.judge(pages).collect()
    assert len(got) == len(urls)
    want = sorted(((k % 390, *parts(u), r.name if (r := rule(*parts(u))) else None) for k, u in enumerate(urls)), key=repr)
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in got), key=repr) == want
    for r in got:
        if listed := rule(r.host, r.path):
            assert r.verdict == listed.verdict
        assert r.verdict in ("allow", "block")
    assert urlrules.judge(pages.limit(0)).count() == 0
    assert {r.verdict for r in urlrules.judge(pages.where("url is null or url = ''")).collect()} == {"allow"}


def test_mined_rules_equal_counting(spark):
    labelled = [(k, ["t:org", f"p:{k % 3}", f"h:{k % 5}"], "block" if k % 3 == 0 else "allow") for k in range(300)]
    frame = spark.createDataFrame(labelled, "row long, tokens array<string>, verdict string")
    mined = {(tuple(r.left), r.verdict): (r.confidence, r.n) for r in urlrules.mine(frame, 0.05, 0.9).collect()}
    assert mined == {(("p:0",), "block"): (1.0, 100), (("p:1",), "allow"): (1.0, 100), (("p:2",), "allow"): (1.0, 100)}
    pages = spark.createDataFrame([("a", ["p:0", "x"]), ("b", ["p:1"]), ("c", ["q"])], "key string, tokens array<string>")
    fired = {r.key: r.mined_verdict for r in urlrules.fire(pages, urlrules.mine(frame, 0.05, 0.9)).collect()}
    assert fired == {"a": "block", "b": "allow"}
