import corpus_pipeline
from brute import near_components

from scenefold.llm import languages

ENGLISH = "the and with that from this have they been were said each which their time will about many then them".split()


def test_every_stage_takes_effect_and_keeps_clean_documents(spark, documents, tmp_path):
    import random

    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(ENGLISH) + rng.choice(["", "ing", "ed", "s", "er", "ly"]) for _ in range(n))
    leak = text(14)
    clean = [(i, text(60), "en") for i in range(30)]
    common = [(d, t + ("\nAll rights are reserved here" if d < 12 else ""), lang) for d, t, lang in clean]
    near = [(100 + d, common[d][1].rsplit(" ", 1)[0] + " changed", "en") for d in (20, 21)]
    rows = [*common, *near, (200, "12 34 56", "en"), (201, text(20) + " " + leak + " " + text(20), "en"), (202, common[25][1], "en")]
    docs = documents(rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id: r for r in out}
    groups = near_components([(r[0], r[1]) for r in rows if r[0] < 200], 5, 80)
    assert set(kept) == {d for d, (_, _, keep) in groups.items() if keep} == set(range(30))
    assert kept[3].text == clean[3][1] and kept[3].n_chars == len(clean[3][1])
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    assert all(list(r.ids) == library.encode(r.text) for r in out)
    assert languages.CHAIN and [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "sentencepiece"]
