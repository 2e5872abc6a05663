"""Mined URL rules against counting of every set of tokens."""

import itertools
import random
import re

import pytest

from lakescreen.llm import urlrules


def brute(rows, support, confidence):
    least = max(2, int(support * len(rows)))
    counts = {}
    for tokens, verdict in rows:
        for size in range(1, len(tokens) + 1):
            for left in itertools.combinations(sorted(tokens), size):
                by = counts.setdefault(left, {})
                by[verdict] = by.get(verdict, 0) + 1
    sure = {(left, v): (n / sum(by.values()), n) for left, by in counts.items() for v, n in by.items() if n >= least}
    rules = {k: x for k, x in sure.items() if x[0] >= confidence}
    parts = lambda left: (p for size in range(1, len(left)) for p in itertools.combinations(left, size))
    return {(left, v): (round(c, 9), n) for (left, v), (c, n) in rules.items() if not any(sure.get((p, v), (0,))[0] >= c for p in parts(left))}


def mined(spark, rows, support, confidence, basket=urlrules.BASKET):
    frame = spark.createDataFrame([(k, list(t), v) for k, (t, v) in enumerate(rows)], "row long, tokens array<string>, verdict string")
    return {(tuple(r.left), r.verdict): (r.confidence, r.n) for r in urlrules.mine(frame, support, confidence, basket).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_counting_every_set(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(300):
        tokens = {f"p:{k}" for k in range(8) if rng.random() < 0.6}
        sure = {"p:0", "p:1", "p:2"} <= tokens or {"p:4", "p:7"} <= tokens
        rows.append((tokens, "block" if sure != (rng.random() < 0.04) else "allow"))
    want = brute(rows, 0.02, 0.8)
    assert max(len(left) for left, _ in want) > 2
    assert mined(spark, rows, 0.02, 0.8) == want  # by FP-growth
    assert mined(spark, rows, 0.02, 0.8, 0) == want  # by levels


def test_rules_of_five_tokens(spark):
    five = [f"p:{k}" for k in range(5)]
    rows = [(five, "block")] * 50 + [(five[:k] + five[k + 1 :], "allow") for k in range(5)] * 20
    assert mined(spark, rows, 0.005, 0.9)[(tuple(five), "block")] == (1.0, 50)
    assert mined(spark, rows, 0.005, 0.9) == mined(spark, rows, 0.005, 0.9, 0) == brute(rows, 0.005, 0.9)


def test_rare_tokens_of_long_urls(spark):
    common = [f"p:{k:02}" for k in range(30)]
    rows = [(common, "allow")] * 90 + [([*common, "p:rare"], "block")] * 10
    assert mined(spark, rows, 0.005, 0.9) == {(("p:rare",), "block"): (1.0, 10), **{((c,), "allow"): (0.9, 90) for c in common}}


def tokens_of(url):
    """Host, path and tokens of a URL, plainly."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", "", []
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    zero = lambda x: re.sub("[0-9]+", "0", x)
    labels = [x for x in host.split(".") if x]
    out = {f"h:{w}" for w in re.split("[.-]", zero(host)) if w}
    out |= {f"t:{labels[-1]}", f"f:{zero(labels[0])}"} if labels else set()
    return host, path, sorted(out | {f"p:{w}" for w in zero(path.lower()).split("/") if w})


def verdicts(urls, support, confidence):
    known = []
    for url in urls:
        host, path, tokens = tokens_of(url)
        fits = [r for r in urlrules.RULES for own, _, p in [r.name.partition("/")] if (host == own or host.endswith("." + own)) and path.startswith("/" + p)]
        known.append((host, path, tokens, max(fits, key=lambda r: len(r.name), default=None)))
    rules = brute([(t, r.verdict) for _, _, t, r in known if r], support, confidence)
    out = []
    for host, path, tokens, rule in known:
        fired = [(c, n, -len(left), v, list(left)) for (left, v), (c, n) in rules.items() if set(left) <= set(tokens)]
        verdict = rule.verdict if rule else max(fired)[3] if fired else "allow"
        out.append((host, path, rule.name if rule else None, verdict))
    return out


def test_verdicts_equal_brute_force(spark):
    rng = random.Random(8)
    hosts = ["www.example.com", "shop.example.com", "example.com", "a-1.site.net", "b.net", "news.org", "WWW.Other.ORG", "net", "mail.site.io"]
    urls = [f"https://{rng.choice(hosts)}/{rng.choice(['en', 'es', 'fr', 'de'])}/{rng.choice(['shop', 'casino', 'news', 'p12', ''])}{rng.choice(['', '?q=1', '#x', '/deep/7'])}" for _ in range(260)]
    urls += [None, "", "no scheme", "ftp://", "http://?x", "x://y://z/en/", "https://casino.bet/fr/casino", "https://q.org/es/" + "/".join(f"s{k}" for k in "abcdefgh")] + urls[:3]
    pages = spark.createDataFrame([(k, u, "z") for k, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in urlrules.judge(pages, support=0.02).orderBy("page_id").collect()]
    want = verdicts(urls, 0.02, urlrules.CONFIDENCE)
    assert got == want
    assert {"block", "allow"} == {v for _, _, r, v in want if r is None}
    assert urlrules.judge(pages.limit(0)).count() == 0
