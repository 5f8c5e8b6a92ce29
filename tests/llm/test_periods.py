import random
import zlib
from hashlib import sha256

import numpy as np

from scenefold.llm import periods


def brute(words, least=6, exponent=4):
    """(start, length, period) by comparing every place with the one a period on."""
    n, found = len(words), set()
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, exponent * q) and not any(all(words[x] == words[x + d] for x in range(i, i + length - d)) for d in range(1, q)):
                found.add((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def changed(doc, words):
    if doc is None:
        return words
    h, n = zlib.crc32(str(doc).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc, text, repeat=True):
    words = (text or "").encode().split()
    words = changed(doc, words) if repeat else words
    runs = brute(words)
    gone = {x for s, n, q in runs for x in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    milli = 1000 * best[1] // best[2] if runs else None
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc, len(runs), *best, milli, sha256(lines.encode()).hexdigest(), sha256(kept).hexdigest())


def texts(rng):
    out = ["", None, "one", " \t\n", "a b a b a b a b", "x " * 5, "x " * 6, "é É é É é É é É", "a\x0bb\x0ca b a b a b"]
    for _ in range(150):
        k, parts = rng.choice([1, 2, 3, 50]), []
        for _ in range(rng.randrange(1, 6)):
            root = [f"w{rng.randrange(k)}" for _ in range(rng.randrange(1, 7))]
            parts += (root * rng.randrange(1, 9))[: rng.randrange(1, 50)]
        out.append(rng.choice([" ", "\n", "  "]).join(parts))
    return out


def test_report_equals_brute_force(documents):
    rng = random.Random(2)
    rows = [(i, t) for i, t in enumerate(texts(rng))]
    rows += [(3, "again a b a b a b a b"), (None, "a a a a a a a"), (5, rows[5][1]), (5, rows[5][1])]
    got = [tuple(r) for r in periods.run_report(documents(rows)).collect()]
    order = lambda r: tuple(str(v) for v in r)
    assert sorted(got, key=order) == sorted((expected(d, t) for d, t in rows), key=order)
    plain = [tuple(r) for r in periods.run_report(documents(rows), repeat_tails=False).collect()]
    assert sorted(plain, key=order) == sorted((expected(d, t, False) for d, t in rows), key=order)
    assert sum(r[1] for r in got) > 50


def test_two_repeats_are_runs_if_asked():
    rng = random.Random(4)
    for _ in range(300):
        words = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(40))]
        assert [tuple(r) for r in periods.find_runs(np.array(words, dtype=np.int64), 2, 2).tolist()] == brute(words, 2, 2)


def test_a_long_text_of_one_word_and_of_long_periods():
    assert periods.find_runs(np.zeros(30_000, dtype=np.int64)).tolist() == [[0, 30_000, 1]]
    root = list(range(5_000))
    assert periods.find_runs(np.array(root * 4 + root[:7])).tolist() == [[0, 20_007, 5_000]]


def test_runs_and_collapsed_texts(documents):
    docs = documents([(1, "go  a b a b a b a b end"), (2, "as it\nis"), (3, None)])
    assert [tuple(r) for r in periods.runs(docs).collect()] == [(1, 1, 8, 2, "a b")]
    out = periods.collapse(docs)
    assert out.columns == [*docs.columns, "n_runs", "collapsed"]
    assert {r.doc_id: r.collapsed for r in out.collect()} == {1: "go a b end", 2: "as it\nis", 3: None}
    assert periods.run_report(documents([])).count() == periods.runs(documents([])).count() == 0
    assert periods.collapse(out).columns == out.columns
