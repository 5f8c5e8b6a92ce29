import random
from collections import Counter, defaultdict
from hashlib import sha256

from brute import lower
from xxhash import xxh64_intdigest

from scenefold.llm import lines


def brute(rows, least):
    key = lambda x: lower(x.strip(" \t\n\x0b\f\r"))
    owners = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            owners[key(line)].add(doc)
    out = []
    for doc, text in rows:
        all_ = (text or "").split("\n")
        kept = [x for x in all_ if not key(x) or len(owners[key(x)]) < least]
        out.append((doc, len(all_), len(all_) - len(kept), sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def test_line_report_equals_brute_force(spark, documents):
    rng = random.Random(1)
    pool = ["Common LINE", " common line\t", "é line", "É line", "", "  ", "rare", "x" * 50, "\x85nbsp\xa0"]
    rows = [(i, "\n".join(rng.choice(pool + [f"own {i}"]) for _ in range(rng.randrange(9)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n"), (103, "rare\r\nrare"), (7, rows[7][1]), (8, "another text of the same id\ncommon line"), (None, "common line"), (None, "own")]
    rows += [(104, "\n".join(f"common line{' ' * (i % 3)}" if i % 2 else f"line {i}" for i in range(20_000)))]
    for least in (2, 10, 61):
        got = Counter(tuple(r) for r in lines.line_report(documents(rows), least).collect())
        assert got == brute(rows, least)


def test_all_columns_stay_and_an_empty_table_is_fine(documents):
    docs = documents([(i, f"same\nown {i}") for i in range(10)])
    out = lines.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert {r.text for r in out.collect()} == {f"own {i}" for i in range(10)}
    assert lines.dedup_lines(documents([])).count() == 0
    assert lines.dedup_lines(out).columns == out.columns


def colliding_lines():
    """Two lines of 16 bytes with one XXH64 at Spark's seed: the second half undoes what the first made unequal."""
    p1, p2, p4, p5, low = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 2**64 - 1
    turn = lambda x, k: (x << k | x >> 64 - k) & low
    mix = lambda half: turn(int.from_bytes(half, "little") * p2 & low, 31) * p1 & low
    state = lambda half: (turn((42 + p5 + 16) & low ^ mix(half), 27) * p1 + p4) & low
    rng, first = random.Random(2), (b"a common", b" phrase.")
    signs = set(range(33, 127)) - set(range(65, 91))
    while True:
        head = bytes(rng.choices(range(97, 123), k=8))
        wanted = state(first[0]) ^ mix(first[1]) ^ state(head)
        tail = (turn(wanted * pow(p1, -1, 2**64) & low, 33) * pow(p2, -1, 2**64) & low).to_bytes(8, "little")
        if set(tail) <= signs:
            return b"".join(first).decode(), (head + tail).decode()


def test_lines_of_one_hash_do_not_pool_their_documents(documents):
    a, b = colliding_lines()
    assert a != b and xxh64_intdigest(a, 42) == xxh64_intdigest(b, 42)
    rows = [(i, f"own {i}\n{a if i % 2 else b}") for i in range(12)]
    assert {r.doc_id: r.text for r in lines.dedup_lines(documents(rows)).collect()} == dict(rows)
