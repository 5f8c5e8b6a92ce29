"""Segmentation of words over a lattice of pieces, as DataFrame operations.

Substrings of bounded length are exploded, joined with the piece table by
equality and grouped by word. A higher-order ``aggregate`` folds the edges: into
the Viterbi table of the best path (``best_paths``), or into the cuts that remain
after merging pairs by rank (``merged_paths``, what a BPE piece table means).
``best_pieces`` and ``merged_pieces`` do the same to one long word at a time, whose
edges and cuts would be copied too often as columns.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

from pyspark.sql import Column, DataFrame, functions as F

#: Words of more bytes are long: they are segmented one at a time.
WORD_BYTES = 256
#: Bits of the number of different scores of a table whose pairs are merged.
_TURN = 29


def edges(words: DataFrame, pieces: DataFrame, longest: int, shortest: int = 1) -> DataFrame:
    """(word, e, l, score, id): the pieces found in each word and one edge for each character.

    A character that is no piece has id and score null. Of edges below ``shortest``
    characters there is only a word's first character.
    """
    # A flat counter over (start, length): generator, substring and join stay in one generated stage.
    sized = words.select("word", F.char_length("word").alias("n")).where("n > 0")
    counted = sized.select("word", "n", F.explode(F.sequence(F.lit(0), F.col("n") * longest - 1)).alias("k"))
    spread = counted.select("word", "n", F.expr(f"cast(k div {longest} as int)").alias("b"), (F.col("k") % longest + 1).alias("l")).where(f"b + l <= n and (l >= {shortest} or b + l = 1)")
    named = spread.select("word", (F.col("b") + F.col("l")).alias("e"), "l", F.substr("word", F.col("b") + 1, F.col("l")).alias("piece"))
    # The key is a long, which joins faster than a string; the pieces themselves decide, so that no hash takes another's place.
    known = pieces.select(F.xxhash64("piece").alias("h"), "score", "id", F.col("piece").alias("same"))
    found = named.withColumn("h", F.xxhash64("piece")).join(known, "h", "left").withColumn("met", F.coalesce(F.col("same") == F.col("piece"), F.lit(False)))
    held = found.where("met or l = 1")
    return held.select("word", "e", "l", *[F.when(F.col("met"), F.col(c)).alias(c) for c in ("score", "id")])


def best_paths(words: DataFrame, pieces: DataFrame, longest: int, unknown: float) -> DataFrame:
    """(word, path): per distinct non-empty word the pieces (start, length, id) of its best path.

    ``words`` has a column word, ``pieces`` piece, score and id, each piece once.
    The best path has the largest sum of scores; characters that are no piece cost
    ``unknown``. Of equal sums the longer last piece is taken.
    """
    grouped = edges(words, pieces, longest).groupBy("word").agg(
        F.sort_array(F.collect_list(F.struct("e", (-F.col("l")).alias("nl"), F.coalesce("score", F.lit(unknown)).alias("s"), F.coalesce("id", F.lit(-1)).alias("id")))).alias("edges")
    )
    state = "array<struct<s:double,l:int,id:int>>"
    start = F.array(F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("l"), F.lit(-1).alias("id"))).cast(state)

    def step(table: Column, edge: Column) -> Column:
        total = F.element_at(table, edge["e"] + edge["nl"] + 1)["s"] + edge["s"]
        entry = F.array(F.struct(total.alias("s"), (-edge["nl"]).alias("l"), edge["id"].alias("id"))).cast(state)
        return (
            F.when(F.size(table) == edge["e"], F.concat(table, entry))
            .when(total > F.element_at(table, -1)["s"], F.concat(F.slice(table, F.lit(1), edge["e"]), entry))
            .otherwise(table)
        )

    table = grouped.select("word", F.aggregate("edges", start, step).alias("best"))
    path = "array<struct<start:int,l:int,id:int>>"
    begin = F.struct((F.size("best") - 1).alias("at"), F.array().cast(path).alias("path"))

    def back(walk: Column, _: Column) -> Column:
        entry = F.element_at(F.col("best"), walk["at"] + 1)
        start = walk["at"] - entry["l"]
        piece = F.array(F.struct((start + 1).alias("start"), entry["l"].alias("l"), entry["id"].alias("id"))).cast(path)
        return F.when(walk["at"] <= 0, walk).otherwise(F.struct(start.alias("at"), F.concat(piece, walk["path"]).alias("path")))

    walked = F.aggregate(F.sequence(F.lit(1), F.size("best")), begin, back)
    return table.select("word", walked["path"].alias("path"))


def ranked(pieces: dict[str, tuple[float, int]]) -> list[tuple[str, int, int]]:
    """(piece, score, id) for ``merged_paths``, of a dict of (score, id).

    The score is a whole number that orders like the old one, doubled, and odd for a
    late piece: one that two pieces make of which one has no better score.
    """
    turn = {s: i for i, s in enumerate(sorted({s for s, _ in pieces.values()}))}
    if len(turn) > 1 << _TURN:
        raise ValueError(f"a table of more than {1 << _TURN} scores is not supported")

    def late(piece: str, score: float) -> bool:
        # A single character needs no merge and is always in time.
        parts = ([x for x in (piece[:k], piece[k:]) if len(x) > 1] for k in range(1, len(piece)))
        return any(some and all(x in pieces for x in some) and min(pieces[x][0] for x in some) <= score for some in parts)

    return [(p, 2 * turn[s] + late(p, s), i) for p, (s, i) in pieces.items()]


def single_ids(pieces: dict[str, tuple[float, int]]) -> Column:
    """The ids of single characters by code point, -1 where there is none: one literal."""
    known = {ord(p): i for p, (_, i) in pieces.items() if len(p) == 1}
    return F.split(F.lit(",".join(str(known.get(c, -1)) for c in range(max(known, default=0) + 1))), ",").cast("array<int>")


def merged_paths(words: DataFrame, pieces: DataFrame, longest: int, singles: Column) -> DataFrame:
    """(word, path): per distinct non-empty word the symbols (start, length, id) after all merges.

    Beginning with single characters, the two neighbours whose concatenation is
    the piece with the largest score are merged, the leftmost of equals first,
    until none are left. A character that is no piece has id -1. ``pieces`` has
    the scores of ``ranked``, ``singles`` the ids of ``single_ids``; a word has fewer
    than 65,536 characters.
    """
    start, span = F.col("e") - F.col("l"), lambda b, e: F.shiftleft(b.cast("long"), 16).bitwiseOR(e.cast("long"))
    place = span(start, F.col("e"))
    # A join is one long that sorts by turn, then start, then end; the last bit tells late pieces.
    turn = F.lit(1 << _TURN) - F.shiftright("score", 1)
    join = F.shiftleft(turn.cast("long"), 33).bitwiseOR(F.shiftleft(place, 1)).bitwiseOR(F.col("score").bitwiseAND(F.lit(1)))
    several = lambda c: F.collect_list(F.when(F.col("l") > 1, c))
    grouped = edges(words, pieces, longest, shortest=2).groupBy("word").agg(
        F.sort_array(several(join)).alias("joins"), several(place).alias("places"), several(F.col("id")).alias("ids")
    )

    def begin(x: Column) -> Column:
        return F.shiftright(x, 17).bitwiseAND(F.lit(0xFFFF)).cast("int")

    def end(x: Column) -> Column:
        return F.shiftright(x, 1).bitwiseAND(F.lit(0xFFFF)).cast("int")

    def at(cuts: Column, b: Column) -> Column:
        return F.array_position(cuts, b).cast("int")

    def adjoining(cuts: Column, x: Column) -> Column:
        # An edge is two neighbouring symbols if one cut lies between its ends.
        return F.array_contains(cuts, begin(x)) & (F.get(cuts, at(cuts, begin(x)) + 1) == end(x))

    def joined(cuts: Column, b: Column) -> Column:
        return F.array_remove(cuts, F.get(cuts, at(cuts, b)))

    def once(cuts: Column, x: Column) -> Column:
        return F.when(adjoining(cuts, x), joined(cuts, begin(x))).otherwise(cuts)

    def again(cuts: Column, _: Column) -> Column:
        first = begin(F.get(F.filter("joins", lambda x: adjoining(cuts, x)), F.lit(0)))
        # A one-element transform binds the best join once; lambdas share no subexpressions.
        return F.get(F.transform(F.array(first), lambda b: F.when(b.isNull(), cuts).otherwise(joined(cuts, b))), F.lit(0))

    # Where the parts of a piece have better turns, one pass does its merges in their
    # time. Only late pieces can be left over; then what is left is merged step by step.
    n = F.char_length("word")
    passed = grouped.select("word", "joins", "places", "ids", F.aggregate("joins", F.sequence(F.lit(0), n), once).alias("cuts"))
    is_late = lambda x: x.bitwiseAND(F.lit(1)) == 1
    left = F.exists("joins", lambda x: is_late(x) & adjoining(F.col("cuts"), x))
    steps = F.when(left, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    cut = passed.select("word", "joins", "places", "ids", F.aggregate(steps, F.col("cuts"), again).alias("cuts"))

    def symbol(i: Column) -> Column:
        b, e = F.get(F.col("cuts"), i - 1), F.get(F.col("cuts"), i)
        merged = F.get(F.col("ids"), F.array_position("places", span(b, e)).cast("int") - 1)
        single = F.coalesce(F.get(singles, F.ascii(F.substr(F.col("word"), b + 1, F.lit(1)))), F.lit(-1))
        return F.struct((b + 1).alias("start"), (e - b).alias("l"), F.when(e - b == 1, single).otherwise(merged).alias("id"))

    return cut.select("word", F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), symbol).alias("path"))


def merged_pieces(word: str, pieces: dict[str, tuple[float, int]]) -> list[str]:
    """The symbols of ``word`` after all merges of ``merged_paths``, in O(n log n) for n characters.

    ``pieces`` has (score, id) of each piece. Symbols are a linked list of their
    ends; the best join comes from a heap, in which joins that no longer stand are
    passed over.
    """
    n = len(word)
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def join(b: int, middle: int) -> tuple[float, int, int, int] | None:
        found = pieces.get(word[b : ends[middle]])
        return (-found[0], b, middle, ends[middle]) if found is not None else None

    heap = [x for b in range(n - 1) if (x := join(b, b + 1)) is not None]
    heapify(heap)
    while heap:
        _, b, middle, e = heappop(heap)
        # A symbol that was merged into its left neighbour has end 0.
        if ends[b] != middle or ends[middle] != e:
            continue
        ends[b], ends[middle] = e, 0
        if e < n:
            before[e] = b
            if (x := join(b, e)) is not None:
                heappush(heap, x)
        if b and (x := join(before[b], b)) is not None:
            heappush(heap, x)
    out, at = [], 0
    while at < n:
        out.append(word[at : ends[at]])
        at = ends[at]
    return out


def best_pieces(word: str, pieces: dict[str, tuple[float, int]], longest: int, unknown: float) -> list[str]:
    """The pieces of the best path of ``best_paths`` through ``word``."""
    best, lengths = [0.0], [0]
    for e in range(1, len(word) + 1):
        total, length = None, 0
        for l in range(min(longest, e), 0, -1):
            found = pieces.get(word[e - l : e])
            if found is None and l > 1:
                continue
            here = best[e - l] + (found[0] if found is not None else unknown)
            if total is None or here > total:
                total, length = here, l
        best.append(total)
        lengths.append(length)
    out, at = [], len(word)
    while at:
        out.append(word[at - lengths[at] : at])
        at -= lengths[at]
    return out[::-1]
