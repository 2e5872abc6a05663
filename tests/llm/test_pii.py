import hashlib
import random
import re

from lakescreen.llm import pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(d[::2] + [x * 2 if x < 5 else x * 2 - 9 for x in d[1::2]]) % 10 == 0


def brute(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) < 256 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


TEXTS = [
    "mail a.b@c.de or x@y, z@-.q. @@a@b.c.d@e.f", "10.0.0.1.2.3.4.5 1.2.3 256.1.1.1 001.02.3.255 00000000001.1.1.1", "4111 1111 1111 1111, 4111-1111-1111-1112",
    "4111  1111 1111 1111 4111111111111111 5", "+47 22 33 44 55 +1(415)555-0199. +1 2 + 123", "ü@ä.de ümail@x.io ١٢.٣.٤.٥ card 5500 0000 0000 0004\n", "", None, "a" * 5000 + "@" + "1" * 5000,
    "john.doe [at] example [dot] com and call (415) 555-0199 or 192[.]168[.]0[.]1",
]


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(3)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice("a1@.+- (5)4b%") for _ in range(200)) for _ in range(400)]
    texts += ["".join(rng.choice(["4111", " ", "-", "1111", "+", "1", ".", "10", "@", "a.b"]) for _ in range(60)) for _ in range(400)]
    for t in texts:
        assert P.base_spans(t) == brute(t), t


def test_long_runs_stay_linear():
    for t in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1" * 150_000, "a@" * 100_000, "1 " * 150_000):
        P.candidates(t)


def test_query_rows(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)] + [(None, TEXTS[0], "x")] * 2, "doc_id long, text string, spans string")
    rows = P.op5_digest(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        base = brute(TEXTS[r.doc_id or 0] or "")
        told = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in base) for kind in P.KINDS]
        assert set(told) <= set(r.spans.split(",")) | {""}
    assert P.op5_digest(docs.limit(0)).count() == 0


def test_labelers_learn_who_is_reliable():
    counts = {("phone", "2222022"): 500, ("phone", "0222020"): 80, ("phone", "0111111"): 300, ("phone", "0121101"): 200}
    judge = P.Judge(counts)
    assert judge.chances["phone", "0222020"] > 0.9 > 0.1 > judge.chances["phone", "0111111"]
    assert judge.probability("card", [0]) < 0.01


def planted(n, seed):
    """Texts with spans that no base pattern accepts, some of them personal: (doc_id, text), {(doc_id, kind, start, end)}, decoys."""
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    filler = lambda: " ".join(rng.choice(["the", "river", "under", "stone", "quiet", "market", "every", "seven"]) for _ in range(rng.randrange(3, 12)))
    true = [
        ("email", lambda: f"{rng.choice(['write to', 'e-mail', 'contact'])} ", lambda: f"{rng.choice(['ann', 'bob', 'eve'])}.{num(2)} [at] mail{num(1)} [dot] {rng.choice(['com', 'org', 'de'])}"),
        ("phone", lambda: f"{rng.choice(['call', 'phone', 'tel'])} ", lambda: f"({rng.choice('2345')}{num(2)}) {rng.choice('678')}{num(2)}-{num(4)}"),
    ]
    false = [
        ("phone", lambda: f"{rng.choice(['invoice', 'order', 'build'])} ", lambda: f"000-{num(3)}-{num(4)}"),
        ("card", lambda: f"{rng.choice(['order', 'section', 'invoice'])} ", lambda: "9" + num(14)),
        ("ip", lambda: f"{rng.choice(['version', 'build', 'section'])} ", lambda: f"{rng.randrange(300, 999)}.{num(2)}.{num(3)}.{num(1)}"),
    ]
    docs, real, decoys = [], set(), set()
    for k in range(n):
        text = filler() + " "
        for _ in range(rng.randrange(3)):
            kind, before, say = rng.choice(true + false)
            said = (before(), say())
            at = len(text) + len(said[0])
            (real if (kind, before, say) in true else decoys).add((k, kind, at, at + len(said[1])))
            text += said[0] + said[1] + " " + filler() + " "
        if rng.random() < 0.5:
            text += f"mail {rng.choice('abc')}{num(2)}@x{num(1)}.com or call +1 (2{num(2)}) 555-{num(4)} now"
        docs.append((k, text))
    return docs, real, decoys


def test_planted_spans_are_told_from_decoys(spark):
    docs, real, decoys = planted(1500, 1)
    rows = P.spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    told = {(r.doc_id, s.kind, s.start, s.end) for r in rows for s in r.spans if not s.base}
    assert len(real) > 300 and len(decoys) > 300
    assert len(told & real) / len(real) > 0.9
    assert len(told & real) / len(told) > 0.95
    for r in rows[:200]:  # base spans stay whatever the classifier says
        assert {(s.kind, s.start, s.end) for s in r.spans if s.base} == set(brute(docs[r.doc_id][1]))


def test_the_classifier_reads_the_text_not_the_votes():
    docs, real, _ = planted(1500, 2)
    rows = [(d, *c) for d, t in docs for c in P.candidates(t)]
    counts = {}
    for r in rows:
        counts[r[1], r[5]] = counts.get((r[1], r[5]), 0) + 1
    judge = P.Judge(counts).learn([(r[1], r[5], r[6]) for r in rows if r[0] < 1000])
    loose = [r for r in rows if r[0] >= 1000 and not r[4]]
    right = sum((judge.probability(r[1], r[6]) >= P.ACCEPT) == ((r[0], r[1], r[2], r[3]) in real) for r in loose)
    assert right / len(loose) > 0.95


def test_redaction():
    assert P.redact("mail a@b.de now", [("email", 5, 11)]) == "mail [email] now"
