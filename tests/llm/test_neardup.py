import random

import pytest
from brute import near_components

from scenefold.llm import components, neardup


def corpus(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for g in range(6):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(80)]
        for _ in range(n // 6):
            words = list(base)
            for _ in range(rng.randrange(7)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(words))
    rows += ["Same Text here", "same text HERE", "same\ttext\nhere", "one", "ONE", "two", "", None, "  \n ", "É a", "é a"]
    rows += ["long " * 4 + " ".join(f"l{i}" for i in range(30_000))] * 2
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("size", [2, 5])
def test_components_equal_brute_force(documents, size):
    rows = corpus(size)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(documents(rows), size, 80).collect()}
    assert got == near_components(rows, size, 80)


def test_links_beyond_a_pivot_are_found(documents):
    # Each neighbour pair is similar, the ends are not: the group hangs together by its chain only.
    words = [f"c{i}" for i in range(120)]
    rows = [(i, " ".join(words[i * 3 : i * 3 + 60])) for i in range(21)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(documents(rows), 2, 80).collect()}
    assert got == {i: near_components(rows, 2, 80)[i][1] for i in got} and set(got.values()) == {0}


def test_repeated_rows_null_ids_and_keeping_one(documents):
    rows = [(2, "a b c d e f"), (2, "a b c d e f"), (1, "A b c d e f"), (None, "a b c d e f"), (None, None), (5, "other words entirely here now")]
    docs = documents(rows)
    judged = neardup.near_duplicates(docs)
    assert judged.where("doc_id = 2").select("component_id").distinct().collect()[0][0] == 1
    assert judged.where("doc_id is null and kept").count() == 2
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 1, 5]
    assert neardup.near_duplicates(documents([])).count() == 0


def test_star_components_equal_a_search(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 70)] + [(200, 200 + i) for i in range(1, 90)] + [(rng.randrange(400, 480), rng.randrange(400, 480)) for _ in range(50)]
    edges += [(5, 5), (None, 3), (9, None), (71, 70), (0, 1)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
