import random
import re
from collections import Counter
from hashlib import sha256

from brute import lower

from scenefold.llm import leaks

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(rows, items, size=10):
    windows = []
    for item, text in items:
        words = WORD.findall(lower(text or ""))
        if words and item is not None:
            windows += [(str(item), tuple(words[i : i + size])) for i in range(max(1, len(words) - size + 1))]
    out = []
    for doc, text in rows:
        words = WORD.findall(lower(text or ""))
        hit, found = set(), set()
        for item, window in windows:
            for i in range(len(words) - len(window) + 1):
                if tuple(words[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    found.add(item)
        out.append((doc, len(words), len(hit), len(found), sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def case(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "é", "the", "The"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 9, 10, 11, 25])))) for i in range(12)]
    items += [(50, None), (51, "..."), (None, "the the the"), (3, "repeated id " * 5), (52, items[4][1])]
    rows = []
    for i in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        if i % 3 == 0:
            words[5:5] = [w.upper() if rng.random() < 0.3 and w.isascii() else w for w in (items[rng.randrange(12)][1] or "").split()]
        rows.append((i, ", ".join(words)))
    return rows + [(90, None), (91, ""), (5, rows[5][1]), (92, ("the " * 3000) + items[7][1] + " end")], items


def test_contamination_equals_brute_force_in_one_and_many_blocks(spark, documents, monkeypatch):
    for seed in range(3):
        rows, items = case(seed)
        bench = spark.createDataFrame(items, "item_id long, text string")
        docs = documents(rows)
        assert Counter(tuple(r) for r in leaks.contamination(docs, bench).collect()) == brute(rows, items)
    monkeypatch.setattr(leaks.occurrences, "__defaults__", (10, 7))
    assert Counter(tuple(r) for r in leaks.contamination(docs, bench).collect()) == brute(rows, items)


def test_clean_documents_stay_whole(spark, documents):
    passage = " ".join(f"p{i}" for i in range(15))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    docs = documents([(1, "clean text"), (2, "before " + passage + " after"), (3, passage.rsplit(" ", 6)[0]), (4, None)])
    kept = leaks.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
    assert leaks.decontaminate(docs, bench.limit(0)).count() == 4
    assert leaks.decontaminate(documents([]), bench).count() == 0
