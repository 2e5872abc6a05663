"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them.

Base spans are what the contract's patterns and checks accept; they always stay. Looser patterns give further candidates
of the same kinds: written-out addresses, bracketed or overflowing quads, long numbers that fail a check, local numbers.
Three families of labelers vote on every candidate, yes, no or nothing: patterns (shape and checks), gazetteers (known
endings, prefixes, placeholders) and context (words before the span). Votes of all candidates of the corpus are counted by
pattern of votes, and expectation-maximisation on those counts estimates each labeler's reliability. The probabilities that
follow teach a logistic classifier that does not see the votes but the text: the span's shape and the words around it,
hashed. It judges the spans that no base pattern accepts.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, spread, staged

KINDS = ("email", "ip", "card", "phone")
#: A candidate's probability from which it is a span.
ACCEPT = 0.9
ROUNDS = 50
#: Candidates of a kind that teach the classifier, at most; those of the least hashes.
SAMPLE = 20_000
#: Features of a candidate: the number of them for each kind, and buckets of hashed words before and after the span.
FEATURES, BEFORE, AFTER_ = 160, 64, 32

# The contract's patterns. A digit before a run of digits never begins another match, so looking back keeps
# long runs linear.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Looser candidates.
OBFUSCATED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(] ?(?:at|AT) ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(] ?(?:dot|DOT) ?[\])]) ?[A-Za-z0-9-]{1,63}){1,8}")
DASHED_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9.])")
DOTTED_CARD = re.compile(r"(?<![0-9.])[0-9]{4}(?:[.– ][0-9]{4}){3}(?![0-9.])")
LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])")
#: With what a text must hold for the pattern to match.
LOOSE = (("email", OBFUSCATED, re.compile(r"[\[(] ?(?:at|AT) ?[\])]")), ("ip", DASHED_IP, re.compile(r"\[\.\]")), ("card", DOTTED_CARD, None), ("phone", LOCAL_PHONE, None))
WORDS = re.compile(r"[^\W_]+")

# Gazetteers.
TOP_LABELS = frozenset("com org net edu gov int info biz io de fr es uk no se dk fi it nl be ch at pl eu us ca au jp cn br in ru".split())
PLACEHOLDERS = re.compile(r"(?i)^(?:noreply|no-reply|example|test|foo)$|^(?:0+|1234.*|(\d)\1+)$")
CONTEXT = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|kontakt|correo|courriel|write to|reach)\b[^\n]{0,20}$"),
    "ip": re.compile(r"(?i)\b(?:ip|host|server|address|addr|from|login)\b[^\n]{0,20}$"),
    "card": re.compile(r"(?i)\b(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta|payment)\b[^\n]{0,20}$"),
    "phone": re.compile(r"(?i)\b(?:tel|telephone|phone|call|fax|mobile|telefon|teléfono|sms)\b[^\n]{0,20}$"),
}
AGAINST = re.compile(r"(?i)\b(?:version|isbn|doi|invoice|order|build|section|figure|table|page)\b[^\n]{0,12}$")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain, found from each @, so that long words stay linear."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


#: The labelers, in the order of the digits of a vote: 0 nothing, 1 no, 2 yes.
LABELERS = ("exact pattern", "shape", "checks", "gazetteer", "placeholder", "context", "counter-context")


def votes(text: str, kind: str, start: int, end: int, base: bool) -> str:
    """One digit for each labeler."""
    said, before = text[start:end], text[max(0, start - 40) : start]
    digits = "".join(c for c in said if "0" <= c <= "9")
    shape = checks = gazetteer = 0
    if kind == "email":
        parts = re.split(r"@|[\[(] ?(?:at|AT) ?[\])]", said)
        labels = re.split(r" ?(?:\.|[\[(] ?(?:dot|DOT) ?[\])]) ?", parts[-1].strip())
        shape = 2 if 2 <= len(labels) <= 5 and len(said) <= 100 else 1
        checks = 1 if any(x.startswith("-") or x.endswith("-") or not x for x in labels) or labels[-1].isdigit() else 2
        gazetteer = 2 if labels[-1].lower() in TOP_LABELS else 1
        plain = parts[0].strip()
    elif kind == "ip":
        octets = [int(x.lstrip("0")[:4] or 0) for x in re.findall("[0-9]+", said)]
        shape = 1 if any(len(x) > 1 and x[0] == "0" for x in re.findall("[0-9]+", said)) else 2
        checks = 2 if max(octets) < 256 else 1
        gazetteer = 2 if octets[0] in (10, 172, 192, 8, 127) else 1 if octets[0] == 0 else 0
        plain = ""
    elif kind == "card":
        shape = 2 if len(digits) in (16, 19) else 0
        checks = 2 if luhn(digits) else 1
        gazetteer = 2 if digits[:1] in "3456" else 1
        plain = digits
    else:
        shape = 2 if 8 <= len(digits) <= 15 else 1
        checks = 1 if re.search(r"[().-]{3}", said) or len(set(digits)) < 3 else 2
        gazetteer = 2 if said[0] == "+" and digits[:1] in "123456789" else 1 if digits[:3] in ("000", "123", "555") else 0
        plain = digits
    placeholder = 1 if PLACEHOLDERS.match(plain) else 0
    context = 2 if CONTEXT[kind].search(before) else 0
    counter = 1 if AGAINST.search(before) else 0
    return "".join(map(str, (2 if base else 0, shape, checks, gazetteer, placeholder, context, counter)))


def _failed(text: str) -> Iterator[tuple[str, int, int]]:
    """What matches a base pattern, or nearly, and fails its check."""
    for m in IP.finditer(text):
        if any(len(p.lstrip("0")) > 3 or int(p.lstrip("0") or 0) > 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            n = sum(c.isdigit() for c in m[0])
            if 13 <= n <= 19 and not (n >= 16 and luhn("".join(c for c in m[0] if c.isdigit()))):
                yield "card", m.start(), m.end()


def features(text: str, start: int, end: int) -> list[int]:
    """Numbers of the features that a span has: its shape, its neighbours, the words around it."""
    said, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 24]
    digits, letters = sum(c.isdigit() for c in said), sum(c.isalpha() for c in said)
    out = [0, 1 + min(len(said) // 4, 9), 11 + min(digits, 19), 31 + min(letters // 4, 4)]
    out += [36 + k for k, c in enumerate(" -.()+@[#/") if c in said]
    out += [46 + (0 if not c else 1 if c.isalnum() else 2 if c.isspace() else 3) for c in (before[-1:],)]
    out += [50 + (0 if not c else 1 if c.isalnum() else 2 if c.isspace() else 3) for c in (after[:1],)]
    out += [54 + min(len({c for c in said if c.isdigit()}), 5)]
    out += sorted({60 + zlib.crc32(w.lower().encode()) % BEFORE for w in WORDS.findall(before)[-4:]})
    out += sorted({60 + BEFORE + zlib.crc32(w.lower().encode()) % AFTER_ for w in WORDS.findall(after)[:2]})
    return out


def candidates(text: str) -> list[tuple[str, int, int, bool, str, list[int]]]:
    """(kind, start, end, base, votes, features) of base spans and of looser ones that overlap none of them."""
    base = base_spans(text)
    taken = []  # stretches of base spans of any kind, in order, joined where they overlap
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    starts = [a for a, _ in taken]
    loose: set[tuple[str, int, int]] = set()
    found = chain(_failed(text), ((kind, m.start(), m.end()) for kind, pattern, needs in LOOSE if not needs or needs.search(text) for m in pattern.finditer(text)))
    for kind, a, b in found:
        k = bisect_left(starts, b) - 1
        if k < 0 or taken[k][1] <= a:
            loose.add((kind, a, b))
    rows = [(*s, True) for s in base] + [(*s, False) for s in loose]
    rows.sort(key=lambda c: (KINDS.index(c[0]), *c[1:3]))
    return [(k, a, b, held, votes(text, k, a, b, held), features(text, a, b)) for k, a, b, held in rows]


class Judge:
    """Reliabilities of the labelers of each kind, from counts of votes; and the classifiers that they teach."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        self.reliability, self.chances = {}, {}
        self.weights = np.zeros((len(KINDS), FEATURES))
        self.weights[:, 0] = -20  # a kind that nothing has taught accepts nothing
        for kind in KINDS:
            rows = sorted((v, n) for (k, v), n in counts.items() if k == kind)
            if rows:
                self._weigh(kind, rows)

    def _weigh(self, kind: str, rows: list[tuple[str, int]]) -> None:
        seen = np.array([[int(c) for c in v] for v, _ in rows])
        n = np.array([m for _, m in rows], float)
        # p[class, labeler, vote], begun with labelers that are right three times in four.
        p = np.full((2, seen.shape[1], 3), 1 / 3)
        p[1, :, 1:], p[0, :, 1:] = (1 / 6, 1 / 2), (1 / 2, 1 / 6)
        prior = 0.5
        which = np.arange(seen.shape[1])
        for _ in range(ROUNDS):
            log = np.log([1 - prior, prior]) + np.log(p[:, which, seen]).sum(2).T
            q = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
            prior = np.clip((q @ n + 1) / (n.sum() + 2), 0.05, 0.95)
            for c, weight in ((0, (1 - q) * n), (1, q * n)):
                for vote in range(3):
                    p[c, :, vote] = ((seen == vote) * weight[:, None]).sum(0) + (0.75 if vote == c + 1 else 0.25 if vote else 0.5)
                p[c] /= p[c].sum(1, keepdims=True)
        self.reliability[kind] = p
        self.chances |= {(kind, v): float(x) for (v, _), x in zip(rows, q, strict=True)}

    def learn(self, rows: list[tuple[str, str, list[int]]]) -> Judge:
        """Teach the classifier of each kind from (kind, votes, features) of candidates."""
        for k, kind in enumerate(KINDS):
            mine = [(self.chances[kind, v], f) for c, v, f in rows if c == kind]
            if not mine:
                continue
            q = np.array([p for p, _ in mine])
            x = np.zeros((len(mine), FEATURES))
            for row, (_, on) in zip(x, mine, strict=True):
                row[on] = 1
            w = np.zeros(FEATURES)
            for _ in range(100):  # Newton's steps on the mean log loss
                y = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
                grad = x.T @ (y - q) / len(q) + 1e-3 * w
                hess = (x * (y * (1 - y) / len(q))[:, None]).T @ x + 1e-3 * np.eye(FEATURES)
                step = np.linalg.solve(hess, grad)
                w -= step
                if np.abs(step).max() < 1e-6:
                    break
            self.weights[k] = w
        return self

    def probability(self, kind: str, on: list[int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[KINDS.index(kind), on].sum(), -50, 50))))


FOUND = "array<struct<kind:string,start:int,end:int,base:boolean,votes:string,features:array<int>>>"


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, found) of every row: its candidates, from one narrow pass over whole texts."""
    small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("kind", "start", "end", "base", "votes", "features")
        for batch in batches:
            rows = [[dict(zip(names, c, strict=True)) for c in candidates(t.as_py() or "")] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "found"])

    slim = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return slim.mapInArrow(run, f"doc_id long, found {FOUND}")


def judge(found: DataFrame, sample: int = SAMPLE) -> Judge:
    """Weigh the votes of all candidates, and teach the classifiers from ``sample`` of them for each kind.

    Votes are counted by kind and pattern: at most 4 * 3**7 rows, whatever the corpus.
    """
    each = found.select("doc_id", F.explode("found").alias("c")).select("doc_id", "c.kind", "c.votes", "c.features", "c.start")
    counts = each.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()
    order = F.xxhash64("doc_id", "start", "features")
    some = [r for kind in KINDS for r in each.where(F.col("kind") == kind).orderBy(order).limit(sample).select("kind", "votes", "features").collect()]
    return Judge({(r.kind, r.votes): r.n for r in counts}).learn([(r.kind, r.votes, r.features) for r in some])


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every row; spans: array of (kind, start, end, base, probability), by kind, then start.

    Offsets count code points; the end is exclusive. Null and empty texts have none; a very long one is read whole.
    Repeated rows get equal spans; spans of one kind that begin together are ordered by their ends. An empty table gives
    no rows. Columns other than doc_id and text are not looked at.
    """
    found = staged(find(docs), "candidates")
    learnt = judge(found)
    weights = F.array(*(F.lit(float(w)) for w in learnt.weights.reshape(-1)))
    kinds = F.array(*map(F.lit, KINDS))

    def chance(c: F.Column, w: F.Column) -> F.Column:
        at = (F.array_position(kinds, c["kind"]) - 1) * FEATURES
        total = F.aggregate(c["features"], F.lit(0.0), lambda acc, f: acc + F.get(w, (at + f).cast("int")))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def row(c: F.Column) -> F.Column:
        return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"), chance(c, F.col("w")).alias("probability"))

    each = F.transform("found", row)
    held = found.withColumn("w", F.when(F.size("found") > 0, weights))
    return held.select("doc_id", F.filter(each, lambda s: s["base"] | (s["probability"] >= ACCEPT)).alias("spans"))


def op5_digest(docs: DataFrame) -> DataFrame:
    told = spans(docs)
    base = F.filter("spans", lambda s: s["base"])
    text = lambda of: F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return told.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping spans merge under the first kind."""
    out, at = [], 0
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def digest(found: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()
