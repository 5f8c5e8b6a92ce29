import random
import re
from collections import Counter, defaultdict

from brute import lower

from scenefold.llm import phrases


def pieces(text):
    return [w for w in ([x for x in re.split(r"[ \t]+", p) if x] for p in re.split(r"[.,;:!?\n\x0b\x0c\r]", lower(text or ""))) if w]


def brute(rows, longest=5, least=100, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for words in pieces(text):
            totals[lang] += len(words)
            for m in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in often.items():
            if any(b >= a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in often.items()):
                continue
            cuts = [(1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def corpus(rng, n=60):
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(120)):
            words += rng.choice([["of", "the"], ["New", "York", "City"], ["a"], ["a", "a", "a"], [f"w{rng.randrange(30)}"], ["é", "É"], ["in", "the", "middle", "of", "a"], ["x."], [","], ["\n"]])
        rows.append((i, rng.choice([" ", "\t", "  "]).join(words), rng.choice(["en", "de", None])))
    shared = " ".join(f"s{i % 7}" for i in range(400))
    return [*rows, (100, None, "en"), (101, "", "fr"), (102, "only", "xx"), (103, shared, "en"), (104, "start " + shared, "en"), (105, "a " * 3000, "en"), (7, rows[7][1], rows[7][2])]


def test_collocations_equal_brute_force(documents):
    rows = corpus(random.Random(6))
    for least, top in ((5, 2000), (20, 7), (1, 40)):
        got = sorted(tuple(r) for r in phrases.collocations(documents(rows), 5, least, top).collect())
        assert got == brute(rows, 5, least, top)
    got = sorted(tuple(r) for r in phrases.collocations(documents(rows), 3, 10, 50).collect())
    assert got == brute(rows, 3, 10, 50)


def test_chunks_hold_the_text_once(documents):
    rows = corpus(random.Random(8))
    chunks = phrases.dictionary(documents(rows), 5).collect()
    words = Counter()
    for lang, text in ((r[2] or "und", r[1]) for r in rows):
        for p in pieces(text):
            words[lang] += len(p)
    owned = Counter()
    for c in chunks:
        owned[c.lang] += c.owned * c.n
        assert c.owned == len(c.chunk.split(" ")) - (0 if c.final else 4)
    assert +owned == words
    # Equal stretches are cut alike: the second copy of the long passage adds few chunks.
    assert len({c.chunk for c in chunks if "s3" in c.chunk.split(" ")}) < 60


def test_products_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, n, l, r = 3 * 10**12 + 7, 7 * 10**15 + 3, 4 * 10**12 + 1, 5 * 10**12 + 9
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in zip("anlr", (a, n, l, r))])
    wide = "decimal(19,0)"
    got = row.select(F.expr(f"(cast(a as {wide}) * cast(n as {wide}) * 1000) div (cast(l as {wide}) * cast(r as {wide}))")).first()[0]
    assert got == 1000 * a * n // (l * r)


def test_empty_tables_have_no_phrases(documents):
    assert phrases.collocations(documents([])).count() == 0
    assert phrases.collocations(documents([(1, None), (2, " . ")])).count() == 0
