"""Terms of long lists against a plain search, both ways of meeting the texts."""

import random
import re

import pytest

from lakescreen.operators import post, terms

SCHEMA = "doc_id long, text string"


def plain(docs, listed, whole_words):
    out = set()
    for doc, text in docs:
        for k, term in enumerate(dict.fromkeys(listed)):
            if term and text:
                own = re.escape(term)
                for m in re.finditer(rf"(?<!\w){own}(?!\w)" if whole_words else own, text, re.IGNORECASE):
                    out.add((doc, k, m.start(), m.end(), m[0], text[max(0, m.start() - 140) : m.start()], text[m.end() : m.end() + 140], len(text)))
    return out


def cases():
    rng = random.Random(4)
    syllables = ["an", "na", "ban", "Å", "øst", "aa", "😀", "ß", " ", ".", "x_y", "É"]
    say = lambda n: "".join(rng.choice(syllables) for _ in range(n))
    docs = [(k, say(rng.randrange(60))) for k in range(40)] + [(50, None), (51, ""), (52, "aaaaaaa AAAA aa"), (53, say(8000)), (3, "same id banana"), (3, "same id banana"), (None, "banana")]
    docs += [(60, "ΣΊΣΥΦΟΣ σίσυφος ſtraße Straẞe ıstanbul İSTANBUL µm μM"), (61, "acme acmex xacme (Acme) ACME_ AcMe's")]
    listed = [say(n) for n in range(1, 6) for _ in range(12)] + ["a", "aa", "aaa", "ana", "BANANA", "banana", "acme", "σίσυφος", "istanbul", "μm", "strasse", "straße", "", ".", "same id"]
    return docs, listed


@pytest.mark.parametrize("whole_words", [False, True])
@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_all_terms_are_found(spark, whole_words, broadcast_bytes):
    docs, listed = cases()
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    rows = terms.find(df, listed, whole_words, broadcast_bytes).collect()
    got = [(r.doc_id, r.k, r.start, r.end, r.m, r.pre, r.post, r.n) for r in rows]
    assert set(got) == plain(docs, listed, whole_words)
    assert len(got) == len(set(got)) + len([r for r in set(got) if r[0] == 3 and r[7] == 14])  # two equal rows
    assert {terms.folded(t) for t in ("STRASSE", "strasse")} == {"strasse"} and len(terms.folded("İẞŉ")) == 3


def test_terms_that_begin_alike_are_filed_apart(spark):
    names = spark.range(3000).selectExpr("0 as k", "concat('Customer#', lpad(cast(id as string), 9, '0')) as term")
    filed = terms.index(terms.listed(spark, names), spark.createDataFrame([("no name",)], "text string"), [16]).groupBy("gram").count()
    assert filed.agg({"count": "max"}).first()[0] <= 10
    docs = spark.createDataFrame([(1, "customer#000000007, Customer#000002999x"), (2, "Customer#000003000")], SCHEMA)
    for most in (1 << 26, 30_000, 0):
        assert {(r.doc_id, r.start, r.m) for r in terms.find(docs, names, broadcast_bytes=most).collect()} == {(1, 0, "customer#000000007"), (1, 20, "Customer#000002999")}


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 700, 0])
def test_terms_of_every_width(spark, broadcast_bytes):
    rng = random.Random(5)
    docs = [(k, "".join(rng.choice("abÅ😀") for _ in range(200))) for k in range(30)]
    listed = [docs[k % 30][1][3 : 3 + n] for k, n in enumerate([1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33, 64, 70])] + ["ab" * 20, "b" * 9]
    rows = terms.find(spark.createDataFrame(docs, SCHEMA), listed, False, broadcast_bytes).collect()
    assert sorted((r.doc_id, r.k, r.start, r.end, r.m, r.pre, r.post, r.n) for r in rows) == sorted(plain(docs, listed, False))


def test_many_hits_are_told_in_parts(spark, monkeypatch):
    monkeypatch.setattr(terms, "TOLD_AT_ONCE", 10)
    batch = terms.pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3]})
    got = list(terms._told(batch, lambda i: [(0, k, k + 1, 99, "a", "", "") for k in range((25, 0, 4)[i])]))
    assert max(b.num_rows for b in got) < 20 and [r for b in got for r in b.column("doc_id").to_pylist()] == [1] * 25 + [3] * 4


def test_a_list_as_a_table_and_lists_without_terms(spark):
    docs = spark.createDataFrame([(1, "Term5 and term77"), (2, None)], SCHEMA)
    table = spark.range(5000).selectExpr("concat('term', id) as term")
    got = {(r.doc_id, r.text, r.start) for r in post.blacklist(docs, table).collect()}
    assert got == {(1, "Term5", 0), (1, "term7", 10), (1, "term77", 10)}
    assert {(r.text, r.context) for r in post.clients(docs, table).collect()} == {("Term5", "Term5 and term77"), ("term77", "Term5 and term77")}
    assert terms.find(docs, []).count() == 0 and terms.find(docs, table.limit(0)).count() == 0 and terms.find(docs.limit(0), table).count() == 0


def test_more_patterns_than_one_reading_tries(spark, monkeypatch):
    monkeypatch.setattr(post, "AT_A_TIME", 7)
    docs = spark.createDataFrame([(1, "p3 p19 P19 p20")], SCHEMA)
    patterns = [{"name": str(k), "regex": rf"p{k}\b", "severity": "gul", "ignore_case": True} for k in range(20)]
    got = {(r.category, r.text, r.severity, r.sub_ord) for r in post.custom(docs, patterns).collect()}
    assert got == {("Egendefinert: 3", "p3", "gul", 3), ("Egendefinert: 19", "p19", "gul", 19), ("Egendefinert: 19", "P19", "gul", 19)}
    assert post.custom(docs, []).count() == 0
