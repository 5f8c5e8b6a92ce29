import random

import numpy as np
import pytest

from scenefold.llm import chunks


def test_gear_hash_equals_the_rolling_recurrence():
    data = np.frombuffer(bytes(random.Random(1).randrange(256) for _ in range(500)), dtype=np.uint8)
    rolled, now = [], 0
    for b in data.tolist():
        now = ((now << 1) + int(chunks.GEAR[b])) & 0xFFFFFFFF
        rolled.append(now)
    assert chunks.gear_hashes(data).tolist() == rolled


def test_cuts_move_with_an_insertion_and_respect_characters():
    text = " ".join(random.Random(2).choice(["naïve", "漢字", "word", "longer", "été"]) for _ in range(2000)).encode()
    ends = lambda t: np.array([0, len(t)])
    before = {text[a:b] for _, a, b in zip(*chunks.spans(text, ends(text)), strict=True)}
    longer = text[:5000].decode("utf-8", "ignore").encode() + b" inserted " + text[5000:].decode("utf-8", "ignore").encode()
    after = {longer[a:b] for _, a, b in zip(*chunks.spans(longer, ends(longer)), strict=True)}
    assert len(before - after) <= 20
    cuts = chunks.cuts(np.frombuffer(text, dtype=np.uint8), ends(text))
    assert np.diff(cuts).max() <= chunks.MAX_BYTES + 3 and all(text[: int(c)].decode() is not None for c in cuts)
    periodic = b"ab cd ef " * 3000
    assert np.diff(chunks.cuts(np.frombuffer(periodic, dtype=np.uint8), ends(periodic))).max() <= chunks.MAX_BYTES


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def brute_repeats(rows, size):
    owners = {}
    for doc, text in rows:
        listed = (text or "").split()
        for i in range(len(listed) - size + 1):
            owners.setdefault(tuple(listed[i : i + size]), set()).add(doc)
    return {d for s in owners.values() if len(s) > 1 for d in s}


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_passages_are_found_and_clean_documents_left(documents, seed):
    passages = [words(1000 + seed * 10 + i, 60) for i in range(3)]
    rows = [(i, words(seed * 100 + i, 150)) for i in range(40)]
    for i in range(0, 24):
        head, tail = words(i + 7000, i), words(i + 8000, 30)
        rows.append((100 + i, f"{head} {passages[i % 3]} {tail}"))
    rows += [(200, rows[3][1]), (201, None), (202, ""), (203, "short"), (None, rows[3][1]), (200, rows[3][1]), (204, words(1, 30_000))]
    report = {r.doc_id: r for r in chunks.repeat_report(documents(rows)).collect()}
    assert set(report) == brute_repeats([r for r in rows if r[0] is not None], 50)
    for first in (100, 101, 102, 3):
        assert report[first].removed_bytes == 0
    assert all(report[d].removed_bytes > 150 for d in range(103, 124)) and report[200].removed_bytes > 500


def test_all_rows_and_columns_stay(documents):
    passage = words(5, 70)
    docs = documents([(1, "x " + passage), (2, "y " + passage + " end"), (3, "clean"), (None, passage), (4, None)])
    out = chunks.dedup_substrings(docs)
    assert out.columns == [*docs.columns, "repeats"]
    rows = {r.doc_id: r for r in out.collect() if r.doc_id}
    assert rows[1].text == "x " + passage and rows[3].text == "clean" and rows[4].text is None
    assert len(rows[2].text) < 0.5 * len(passage) and rows[2].text.startswith("y") and rows[2].text.endswith("end")
    assert chunks.dedup_substrings(documents([])).count() == 0
