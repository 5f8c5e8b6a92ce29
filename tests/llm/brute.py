"""Plain Python versions of the operators, quadratic and in memory."""

from __future__ import annotations

from collections import defaultdict


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text: str | None, size: int) -> set[tuple[str, ...]]:
    words, now = [], ""
    for c in lower(text or ""):
        if c in " \t\n\x0b\f\r":
            words += [now] if now else []
            now = ""
        else:
            now += c
    words += [now] if now else []
    if not words:
        return set()
    if len(words) < size:
        return {tuple(words)}
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def near_components(rows: list[tuple[int, str | None]], size: int, percent: int) -> dict[int, tuple[int, int, bool]]:
    """doc_id -> (set size, component, kept); every pair that shares a shingle is compared."""
    sets = {d: shingles(t, size) for d, t in rows}
    root = {d: d for d in sets}

    def find(d: int) -> int:
        while root[d] != d:
            root[d] = root[root[d]]
            d = root[d]
        return d

    groups: dict[frozenset, list[int]] = defaultdict(list)
    for d in sorted(sets):
        if sets[d]:
            groups[frozenset(sets[d])].append(d)
    index: dict[tuple, list[frozenset]] = defaultdict(list)
    for one, docs in groups.items():
        for d in docs:
            root[find(d)] = root[find(docs[0])] = min(find(d), find(docs[0]))
        shared: dict[frozenset, int] = defaultdict(int)
        for s in one:
            for other in index[s]:
                shared[other] += 1
            index[s].append(one)
        for other, n in shared.items():
            if 100 * n >= percent * (len(one) + len(other) - n):
                a, b = find(docs[0]), find(groups[other][0])
                root[a] = root[b] = min(a, b)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}
