"""The learnt language model against a plain one, and how it does on documents that it has not seen."""

import math
import re
import unicodedata
from collections import Counter

from pyspark.sql import functions as F

from lakescreen import engine
from lakescreen.operators import langmodel

SCHEMA = "doc_id long, text string, lang string"
SAID = {
    "nb": "Jeg vet ikke hva som skjer når været blir så dårlig, men vi går ut likevel. ",
    "de": "Ich weiß nicht, was geschieht, wenn das Wetter so schlecht wird, aber wir gehen trotzdem. ",
    "fr": "Je ne sais pas ce qui se passe quand le temps devient si mauvais, mais nous sortons quand même. ",
}


def grams(text):
    return [f" {w} "[k : k + 3] for w in re.findall(r"[^\W\d_]+", text.lower()) for k in range(len(w))]


def plain(rows):
    own = {}
    for _, text, lang in rows:
        if lang and text:
            own.setdefault(lang, Counter()).update(grams(text))
    known = {g for c in own.values() for g in c}
    return {(g, lang): (c[g], math.log((c[g] + 0.5) / (c.total() + 0.5 * len(known)))) for lang, c in own.items() for g in known}


def test_model_and_decisions_equal_plain_ones(spark):
    rows = [(k, SAID[lang] * (1 + k % 3), lang) for k, lang in enumerate(["nb", "de", "fr", "de"])] + [(9, None, "de"), (10, "unknown", None), (11, "", "fr")]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langmodel.train(docs).cache()
    want = plain(rows)
    got = {(r.gram, r.language): (r.n, r.weight) for r in model.collect()}
    assert set(got) == set(want) and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)
    asked = [(1, "Wir wissen nicht, ob das Wetter schlecht wird, und gehen nicht hinaus, aber morgen sind wir wieder da."), (2, "kort"), (3, None), (4, "1234567890 " * 20), (5, "Nous ne savons pas si le temps devient mauvais, " * 90 + SAID["nb"] * 900)]
    told = {r.doc_id: (r.language, r.margin) for r in langmodel.detect(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert {k: v[0] for k, v in told.items()} == {1: "de", 2: "en", 3: "en", 4: "en", 5: "fr"}
    score = {lang: sum(want[g, lang][1] for g in grams(asked[0][1]) if (g, lang) in want) for lang in SAID}
    first, second = sorted(score.values(), reverse=True)[:2]
    assert abs(told[1][1] - (first - second) / sum((g, "de") in want for g in grams(asked[0][1]))) < 1e-9 and told[2][1] is None
    found, _ = engine.scan(spark.createDataFrame(asked[:1], "doc_id long, text string"), engine.Options(language_model=model, only=("email",)))
    assert found.count() == 0 and engine.prepare(spark.createDataFrame(asked, "doc_id long, text string"), engine.Options(language_model=model)).where("language = 'de'").count() == 1
    assert langmodel.train(docs.limit(0)).count() == 0


def test_documents_that_it_has_not_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    told = langmodel.detect(docs, langmodel.train(docs.where("doc_id % 2 = 0"))).join(docs, "doc_id").where("doc_id % 2 = 1")
    long_enough = told.where(F.length("text") > 200)
    assert long_enough.where("language = lang").count() > 0.95 * long_enough.count()


def test_texts_are_read_once_to_learn_and_words_are_not_shuffled_to_tell(spark):
    read = spark.sparkContext.accumulator(0)
    tap = F.udf(lambda t: (read.add(1), t)[1], "string").asNondeterministic()
    docs = spark.createDataFrame([(k, 2 * SAID[lang], lang) for k, lang in enumerate(["nb", "de", "fr", "de"])], SCHEMA)
    model = langmodel.train(docs.withColumn("text", tap("text")))
    told = langmodel.detect(docs, model)
    assert "(word#" not in told._jdf.queryExecution().executedPlan().toString()
    assert model.count() > 0 and {r.doc_id: r.language for r in told.collect()} == {0: "nb", 1: "de", 2: "fr", 3: "de"}
    assert read.value == 4


def letters(text):
    spaced = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in f" {text[:3000].lower()} ")
    return [spaced[k - 1 : k + 2] for k in range(len(spaced)) if spaced[k] != " "]


def test_odd_texts_and_models_that_lack_trigrams(spark):
    odd = "\U0001d4b3\U0001d4b4 a\U00010400b İß x1y2z \u00a0 don't—naïve\tÅ\n\n"
    said = [odd * 4 + SAID["de"], SAID["fr"] + odd, "\u00a0\u2003 " + "ab " * 26 + "ab" + " \u00a0\n", "\n" + "ab " * 26 + "a" + "\u2003" * 90, "\u3000" * 3500 + SAID["nb"] * 2, "q" * 5000, "a " * 3000, SAID["nb"] + "ikke", odd * 400, " " * 200, "9 " * 90]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*said, SAID["fr"], SAID["fr"] + SAID["de"]])], "doc_id long, text string").withColumn("doc_id", F.least("doc_id", F.lit(len(said))))
    rows = [(g, lang, math.log((k % 7 + 1) / (50 + len(lang) * j))) for j, lang in enumerate(SAID) for k, g in enumerate(sorted(set(letters(SAID[lang] + odd + "ab q" + "qqq")))) if k % 5 != j]
    rows += [(g, "tie", w) for g, lang, w in rows if lang == "de"]
    weight = {(g, lang): w for g, lang, w in rows}
    want = {}
    for k, t in [*enumerate(said), (len(said), SAID["fr"]), (len(said), SAID["fr"] + SAID["de"])]:
        scores = want.setdefault(k, {})
        for g in letters(t) if len(t.strip()) >= 80 else ():
            for lang in [*SAID, "tie"]:
                if (g, lang) in weight:
                    down, n = scores.get(lang, (0, 0))
                    scores[lang] = down - weight[g, lang], n + 1
    model = spark.createDataFrame(rows, "gram string, language string, weight double")
    for most in (langmodel.BROADCAST_BYTES, 0):
        got = {r.doc_id: r for r in langmodel.detect(docs, model, most).collect()}
        assert set(got) == set(want)
        for k, scores in want.items():
            ranked = sorted((down, lang, n) for lang, (down, n) in scores.items())
            assert got[k].language == (ranked[0][1] if ranked else "en"), (most, k)
            assert (got[k].margin is None) if len(ranked) < 2 else abs(got[k].margin - (ranked[1][0] - ranked[0][0]) / ranked[0][2]) < 1e-9, (most, k)
    assert {k for k, scores in want.items() if not scores} == {3, 4, 6, 9, 10}
