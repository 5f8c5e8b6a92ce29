import random

import pytest
from pyspark.sql import functions as F

from scenefold.llm import lattice, pieces

sentencepiece = pytest.importorskip("sentencepiece")
TEXTS = [
    None, "", " ", "   ", "a", " a  b ", "tab\tand\x0b form", "line\n\n line\r\n", "naïve 漢字 𝔘 é", "\0zero", "<s> <0x0A> ▁ mark", "x" * 900 + " end",
    "Internationalisation of unbelievably long words, isn't it?", "https://example.org/a_b?c=d#e", "word " * 3000,
]


def test_ids_equal_the_library_and_come_back(spark, documents):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    docs = documents(list(enumerate(TEXTS)) + [(4, "a"), (None, "no id")])
    coded = pieces.encode(docs, block_bytes=200)
    assert coded.columns == [*docs.columns, "ids"]
    rows = pieces.decode(coded).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        assert r.decoded == r.text
        if r.text is not None and "▁" not in r.text:  # the library takes the mark itself for a space
            assert list(r.ids) == library.encode(r.text), r.text[:40]
    assert pieces.encode(documents([])).count() == 0


def test_merges_equal_the_library_on_many_words(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.explode(F.split("text", "[ \n]+")).alias("word")).where("word <> ''")
    words = rows.select(F.concat(F.lit(" "), "word").alias("word")).distinct()
    for r in pieces.word_ids(words, pieces.load_pieces()).collect():
        assert list(r.ids) == library.encode(r.word[1:]), r.word


def unspaced():
    rng = random.Random(12)
    draw = lambda signs, n: "".join(rng.choice(signs) for _ in range(n))
    words = [draw(["the", "ing", "station", "a", "er", "qu", "Z", "é"], 1500), draw("abcdefghijklmnopqrstuvwxyz", 5000), draw("ABCDEFabcdef0123456789+/", 4000)]
    return [*words, draw([chr(c) for c in range(0x4E00, 0x4E80)] + list("的是一"), 3000), " " * 3001 + "x", "ab" + " " * 700 + "\n" + " " * 900, "word " + draw("aeiou漢\0", 2000) + " word", "=" * 4001]


def test_long_unspaced_words_equal_the_library(documents):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = unspaced()
    rows = pieces.decode(pieces.encode(documents([*enumerate(texts), (99, texts[0])]), block_bytes=6000)).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert list(r.ids) == library.encode(r.text) and r.decoded == r.text, r.text[:40]


def test_long_words_are_segmented_like_short_ones(spark):
    table, rng = pieces.load_pieces(), random.Random(13)
    words = {" " + "".join(rng.choice(["the", "on", "s", "a", "漢", "é", " "]) for _ in range(n)) for n in range(1, 25)}
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    for method in ("merge", "viterbi"):
        one = pieces.long_word_ids(table, method)
        assert all(list(r.ids) == one(r.word) for r in pieces.word_ids(frame, table, method).collect())


def test_viterbi_equals_every_segmentation(spark):
    table = [("a", -3.0, 0), ("b", -3.5, 1), ("ab", -5.0, 2), ("ba", -4.0, 3), ("aba", -7.9, 4), ("bb", -7.0, 5)]
    score = {p: s for p, s, _ in table}

    def best(word):
        if not word:
            return 0.0
        options = [score.get(word[:k], -12.0 if k == 1 else None) for k in range(1, 4)]
        return max(o + best(word[k + 1 :]) for k, o in enumerate(options) if o is not None and k < len(word))

    words = ["a", "abab", "bbab", "axb", "ababbabab", "é", "xxxx"]
    frame = spark.createDataFrame([(w,) for w in [*words, ""]], "word string")
    found = lattice.best_paths(frame, spark.createDataFrame(table, "piece string, score double, id int"), 3, -12.0).collect()
    assert {r.word for r in found} == set(words)
    for r in found:
        spelled = [r.word[p.start - 1 : p.start - 1 + p.l] for p in r.path]
        assert "".join(spelled) == r.word
        assert sum(score.get(p, -12.0) for p in spelled) == pytest.approx(best(r.word))


def test_a_missing_model_is_named():
    with pytest.raises(FileNotFoundError):
        pieces.load_pieces("/nowhere.model")
