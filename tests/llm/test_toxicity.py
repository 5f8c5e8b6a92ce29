import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenefold.llm import toxicity

MEAN = ("grumpf", "snarl", "blargh")


def corpus(n=900, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8)))
    pool = [word() for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(pool) for _ in range(rng.randrange(10, 120))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(rng.randrange(3, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(MEAN) + rng.choice(["", "ing", "ed", "er", word()]))
        docs.append((i, " ".join(words), rng.choice(["en", "de"])))
        labels.append((i, 1, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def learned():
    docs, labels = corpus(1500)
    sample = [(t, lang, y, i % 4 == 3) for (i, t, lang), (_, _, y) in zip(docs, labels, strict=True)]
    return toxicity.fit(sample)


def held_out(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 4 == 2


def test_held_out_documents(spark, documents):
    docs, labels = corpus()
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in toxicity.toxicity_report(documents(docs), table).collect()}
    unseen = [d for d, _, _ in docs if held_out(d)]
    assert {d for d, r in rows.items() if r.held_out} == set(unseen)
    truth = {d: y for d, _, y in labels}
    right = np.mean([rows[d].predicted == truth[d] for d in unseen])
    assert right >= 0.95 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())
    # Labels, languages and sources of held-out rows are not looked at, and a score is that of the text alone.
    other = spark.createDataFrame([(d, q, 1 - y if held_out(d) else y) for d, q, y in labels], "doc_id long, quality int, toxic int")
    moved = documents(docs).withColumn("source", F.lit("z")).withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, "xx").otherwise(F.col("lang")))
    again = {r.doc_id: r.score for r in toxicity.toxicity_report(moved, other).collect()}
    assert all(again[d] == pytest.approx(rows[d].score, abs=1e-9) for d in rows)


def test_odd_texts_and_thresholds(documents, learned):
    long = " ".join(["abc def"] * 60_000 + ["grumpf snarling blargher"] * 3)
    texts = [(1, None), (2, ""), (3, "...!"), (4, long), (5, "grumpf " * 10), (6, "Grumpf " * 10), (5, "abc"), (7, "x" * 100_000)]
    docs = documents(texts).withColumn("score", F.lit("theirs"))
    out = toxicity.flag(docs, learned)
    assert set(docs.columns) <= set(out.columns) and {"score", "threshold", "toxic"} <= set(out.columns)
    rows = {(r.doc_id, r.text): r for r in out.collect()}
    assert len(rows) == 8 and rows[1, None].score == rows[2, ""].score == rows[3, "...!"].score
    assert rows[4, long].score > 0.5 > rows[5, "abc"].score and rows[5, "grumpf " * 10].score == rows[6, "Grumpf " * 10].score
    assert set(learned.thresholds) == {"en", "de"} and rows[5, "abc"].threshold == learned.thresholds["en"]
    assert toxicity.flag(documents([]), learned).count() == 0


def test_thresholds_come_from_all_labelled_rows(spark, documents, monkeypatch):
    """The network sees a sample; the rows that choose the thresholds are all that calibrate, long ones too."""
    docs, labels = corpus(1200)
    docs.append((5005, " ".join(["abc"] * 6000), "en"))
    labels.append((5005, 1, 0))
    seen = []
    real = toxicity.fit_thresholds
    monkeypatch.setattr(toxicity, "fit_thresholds", lambda net, rows: seen.append((net.threshold, rows)) or real(net, rows))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    net = toxicity.train(documents(docs), table, 60)
    parts = {d for d, _, _ in docs if zlib.crc32(str(d).encode()) % 4 == 3}
    rows = seen[0][1].collect()
    assert sorted(r.text for r in rows) == sorted(t for d, t, _ in docs if d in parts)
    # The best F1 of any cut between slots, by plain counting.
    scores = toxicity.probabilities(net, toxicity.raw_scores(net, [toxicity.text_words(r.text) for r in rows]))
    y = np.array([r.y for r in rows])
    f1 = lambda cut: 2 * y[scores >= cut].sum() / ((scores >= cut).sum() + y.sum())
    assert f1(net.threshold) == pytest.approx(max(map(f1, scores)), abs=0.01) and f1(net.threshold) >= f1(seen[0][0]) - 0.01
    assert set(net.thresholds) == {"en", "de"}


def test_blocks_do_not_change_scores(learned, monkeypatch):
    docs, _ = corpus(60, seed=9)
    listed = [toxicity.text_words(t) for _, t, _ in docs] + [[], ["grumpf"]]
    whole = toxicity.raw_scores(learned, listed)
    monkeypatch.setattr(toxicity, "BLOCK", 64)
    assert np.allclose(toxicity.raw_scores(learned, listed), whole, atol=1e-5)
    # Plain pooling, text by text: the largest responses of each filter over the regions of the text.
    for words, score in zip(listed, whole, strict=True):
        x = np.array([learned.table[toxicity.buckets_of([w])[0]].sum(axis=0) for w in words]).reshape(-1, toxicity.WIDE)
        total = learned.bias
        for f, (width, kernel, bias) in enumerate(zip(toxicity.WIDTHS, learned.filters, learned.biases, strict=True)):
            padded = np.concatenate([x, np.zeros((width, toxicity.WIDE))])
            seen = np.maximum([padded[i : i + width].ravel() @ kernel + bias for i in range(len(x))], 0).reshape(-1, toxicity.FILTERS)
            regions = sorted((seen[i : i + toxicity.REGION].max(axis=0).tolist() for i in range(0, len(x), toxicity.REGION)), key=str)
            held = -np.sort(-np.array(regions).reshape(-1, toxicity.FILTERS), axis=0)[: toxicity.HELD]
            total += (held * learned.weights[: len(held), f * toxicity.FILTERS : (f + 1) * toxicity.FILTERS]).sum()
        assert score == pytest.approx(total, abs=1e-3)


def test_without_labels_scores_are_zero(spark, documents):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 1, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity_report(documents([(1, "a b"), (2, "c"), (None, "d")]), labels).collect()
    assert [(r.score, r.predicted) for r in rows] == [(0.0, 0)] * 3
    assert toxicity.toxicity_report(documents([]), labels.limit(0)).count() == 0
