import numpy as np
from corpus import AWKWARD, awkward, held, none, prose

from tallybook.llm import langid, quality
from tallybook.llm.common import held_out

GERMAN = "der die und nicht mit zeit haus straße grün über schön heute morgen arbeit"
FRENCH = "le la et avec pas temps maison rue très où aujourd'hui demain travail été"


def test_held_out_is_crc32_of_the_id(spark):
    got = spark.range(0, 60).select("id", held_out("id").alias("h")).collect()
    assert all(r.h == held(r.id) for r in got)


def test_language_of_awkward_texts(spark):
    docs = awkward(spark)
    model = langid.model_of(langid.profiles(docs))
    got = langid.identify(docs, model).collect()
    assert len(got) == len(AWKWARD)
    by_id = {r.doc_id: r for r in got}
    for i in (1, 2, 3, 8):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert by_id[11].lang_pred in ("en", "fr") and all(0 <= r.score <= 1 for r in got)
    assert langid.identify(none(spark), model).count() == 0
    assert langid.model_of(langid.profiles(none(spark))) == {}
    assert {r.lang_pred for r in langid.identify(docs, {}).collect()} == {"und"}


def test_languages_are_told_apart(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice((GERMAN if i % 2 else FRENCH).split(), 40)), "de" if i % 2 else "fr")
            for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.model_of(langid.profiles(docs.where("doc_id < 30")))
    got = langid.identify(docs, model, ["doc_id", "lang"]).collect()
    assert all(r.lang_pred == r.lang for r in got)


def test_ngrams_equal_a_plain_count():
    text = "Ab, ab-c é"
    words = [" ab ", " ab ", " c ", " é "]
    plain = {}
    for k in (1, 2, 3):
        for w in words:
            for i in range(len(w) - k + 1):
                g = w[i:i + k]
                if (k == 1 and g == " ") or (k == 3 and g[1] == " "):
                    continue
                plain[g] = plain.get(g, 0) + 1
    grams, n = langid.ngram_counts(text)
    unpack = lambda c: "".join(chr(c >> s & 0xFFFF) for s in (32, 16, 0) if c >> s)
    got = {unpack(int(g)): int(c) for g, c in zip(grams, n)}
    # blanks between words are shared by both words
    assert got["ab"] == plain["ab"] and got["a"] == plain["a"] and got[" ab"] == plain[" ab"] and got["é"] == 1


def test_letters_beyond_the_basic_plane_count():
    grams, _ = langid.ngram_counts("\U00020000")
    assert len(grams)


def test_quality_on_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 0), (5, 0, 0), (8, 0, 1), (10, None, 0), (77, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    forest = quality.train(docs, labels)
    got = quality.score(docs, forest).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    assert quality.score(none(spark), forest).count() == 0
    untaught = quality.train(docs, labels.where("false"))
    assert {round(r.score, 6) for r in quality.score(docs, untaught).collect()} == {0.5}
    assert quality.train(none(spark), labels).base == 0.0


def test_quality_learns_and_flat_trees_equal_a_walk(spark):
    rows = [(i, prose(i, 80) if i % 2 else " ".join(w + "$$$" for w in prose(i, 80).split()), i % 2)
            for i in range(120)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 80], "doc_id long, quality int")
    forest = quality.train(docs, labels)
    score = {r.doc_id: r.score for r in quality.score(docs, forest).collect()}
    assert all((score[i] >= quality.KEEP_AT) == bool(y) for i, _, y in rows)
    x = np.array([quality.statistics(t) for _, t, _ in rows])
    for row in x[:20]:
        raw = forest.base
        for t in range(len(forest.feature)):
            k = 0
            while forest.left[t, k] >= 0:
                k = forest.left[t, k] + (row[forest.feature[t, k]] > forest.cut[t, k])
            raw += forest.value[t, k]
        assert np.isclose(forest.score(row[None])[0], 1 / (1 + np.exp(-raw)))
    small = quality.train(docs, labels, max_rows=30)
    assert np.isfinite(small.value).all()
