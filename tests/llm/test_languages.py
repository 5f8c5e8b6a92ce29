import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenefold.llm import languages


def test_forward_backward_equals_the_sum_over_all_paths():
    rng = np.random.default_rng(3)
    field = languages.Field(["a", "b", "c"], np.zeros((languages.BUCKETS, 3)), {}, np.zeros(3), rng.normal(size=(3, 3)), rng.normal(size=3))
    scores = rng.normal(size=(1, 5, 3))
    total = np.zeros((5, 3))
    for path in itertools.product(range(3), repeat=5):
        weight = np.exp(field.first[path[0]] + sum(scores[0, t, x] for t, x in enumerate(path)) + sum(field.switch[a, b] for a, b in zip(path, path[1:], strict=False)))
        for t, x in enumerate(path):
            total[t, x] += weight
    assert field.posteriors(scores, np.array([5]))[0] == pytest.approx(total / total.sum(axis=1, keepdims=True))
    padded = np.concatenate([scores, scores[:, :2]], axis=1)
    assert field.posteriors(padded, np.array([5]))[0, :5] == pytest.approx(total / total.sum(axis=1, keepdims=True))


def test_the_transition_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(4)
    scores, labels, n = rng.normal(size=(1, 4, 2)), [0, 1, 1, 0], np.array([4])
    field = languages.Field(["a", "b"], np.zeros((languages.BUCKETS, 2)), {}, np.zeros(2), rng.normal(size=(2, 2)), np.zeros(2))

    def loss(switch):
        weigh = lambda p: sum(scores[0, t, x] for t, x in enumerate(p)) + sum(switch[a, b] for a, b in zip(p, p[1:], strict=False))
        return np.log(sum(np.exp(weigh(p)) for p in itertools.product(range(2), repeat=4))) - weigh(labels)

    found = languages._transition_gradient(field, scores, n, np.eye(2)[labels][None], np.ones((1, 4), dtype=bool))
    for i, j in itertools.product(range(2), repeat=2):
        step = np.zeros((2, 2))
        step[i, j] = 1e-5
        assert found[i, j] == pytest.approx((loss(field.switch + step) - loss(field.switch - step)) / 2e-5, abs=1e-5)


ENGLISH = "the quick brown fox jumps over the lazy dog and then it was the end of that story with you".split()
GERMAN = "der schnelle braune fuchs springt über den faulen hund und dann war das das ende der geschichte mit euch".split()


def texts(n):
    rng = np.random.default_rng(5)
    return [(i, " ".join(rng.choice(ENGLISH if i % 2 else GERMAN, 40)), "en" if i % 2 else "de") for i in range(n)]


def test_learning_reads_only_rows_that_are_not_held_out(documents):
    rows = texts(60)
    held = {r.doc_id for r in documents(rows).where(languages.is_held_out(F.col("doc_id"))).collect()}
    wrong = [(d, t, "fr" if d in held else lang) for d, t, lang in rows]
    docs = documents([*wrong, (900, None, "en"), (901, "", "en"), (902, "123 !?", "en"), (903, "the " * 40_000, None), (None, "und der hund", "de")])
    got = {r.doc_id: r for r in languages.language_report(docs).collect()}
    assert len(held) > 5 and all(got[d].held_out == (d in held) for d, _, _ in rows)
    assert all(got[d].lang_pred == lang for d, _, lang in rows)
    assert all((got[d].lang_pred, got[d].score) == ("und", 0.0) for d in (900, 901, 902))
    assert got[903].lang_pred == "en" and got[None].lang_pred == "de" and got[None].held_out is False
    assert all(0 <= r.score <= 1 for r in got.values())


def test_code_switched_words_are_followed(documents):
    field = languages.train(documents(texts(80)))
    words = ENGLISH + GERMAN
    scores = field.emissions(words)[None]
    best = field.posteriors(scores, np.array([len(words)]))[0].argmax(axis=1)
    assert [field.languages[b] for b in best] == ["en"] * len(ENGLISH) + ["de"] * len(GERMAN)


def test_nothing_to_learn_and_kept_columns(documents):
    docs = documents([(i, t, None) for i, t, _ in texts(4)]).drop("lang").selectExpr("*", "cast(null as string) as lang")
    assert {r.lang_pred for r in languages.language_report(docs).collect()} == {"und"}
    assert languages.language_report(documents([])).count() == 0
    docs = documents([*texts(40), (90, "12 34", "en"), (91, None, "en")]).selectExpr("*", "7 as score")
    kept = languages.keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(40)) and kept.first().score == 7


def test_texts_of_several_languages_and_of_one_word_are_kept(documents):
    french = "le renard brun rapide saute par dessus chien paresseux puis ce fut la fin de cette histoire avec vous".split()
    rng = np.random.default_rng(9)
    lists = {"en": ENGLISH, "de": GERMAN, "fr": french}
    rows = [(i, " ".join(rng.choice(lists[lang], 40)), lang) for i, lang in enumerate(list(lists) * 30)]
    mixed = [(200, " ".join(ENGLISH[:15] + GERMAN[:15] + french[:15]), "en"), (201, " ".join(ENGLISH[:15] + GERMAN[:15]), "en"), (202, "xylo", "en"), (203, "chien und", "fr")]
    docs = documents([*rows, *mixed, (204, "12 !", "en")])
    # The best language of the even text is sure of its words, but has a third of them.
    assert languages.predict(docs, languages.train(docs)).where("doc_id = 200 and score < 0.5").count() == 1
    assert {r.doc_id for r in languages.keep_identified(docs).where("doc_id >= 200").collect()} == {200, 201, 202, 203}
