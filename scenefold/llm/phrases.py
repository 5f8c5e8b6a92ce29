"""Phrases whose words belong together, counted by prefix-free parsing.

Texts are split into pieces and pieces into words. A window of ``longest`` - 1 words
whose hash falls into a fixed class triggers a cut: one chunk ends with the window and
the next begins with it. The ends of a piece cut as well. Equal stretches of text are
thus cut alike, and the distinct chunks with their frequencies (the dictionary and its
parse counts) hold all of the corpus. Phrases are counted inside distinct chunks,
weighted by frequency. Two chunks share ``longest`` - 1 words; a phrase belongs to the
chunk in which it starts before that overlap, so it is counted once.

Counting goes in three steps over the dictionary: words, pairs, longer phrases. A
phrase of ``least`` occurrences has only words and pairs of as many, so each step
leaves out phrases with a part that the step before found rarer. What is known of the
step before is a bitmap of hashes of bounded size: a false bit costs work, never a
count. All counts are over all documents.

Everything is by language; null languages are ``und``. Null and empty texts have no
words; a table without phrases gives no rows. Repeated rows count as often as they stand.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F
from xxhash import xxh64_intdigest

from .common import slices, stored, utf8, with_workers
from .words import STEP, hashed, mixed, shingle_hashes

#: One window in so many triggers a cut.
TRIGGER = 16
#: Bits of a bitmap: 16 for each frequent phrase, within these bounds (8 MB at most).
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26
#: The word of a two-part phrase that many phrases share is dealt to so many places.
SALTS = 16
#: Chunks are counted in blocks of about this many bytes.
BLOCK_BYTES = 8 << 20
_ENDS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b"." * 9)


def _chunks(longest: int):
    shared = longest - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found: Counter[tuple[str, bytes, bool]] = Counter()
                for lang, text in zip(part.column("lang").to_pylist(), utf8(part.column("text")), strict=True):
                    words: list[bytes] = []
                    ends: list[int] = []
                    for piece in text.lower().translate(_ENDS).split(b"."):
                        some = piece.split()
                        if some:
                            words += some
                            ends.append(len(words))
                    if not words:
                        continue
                    # Cuts at triggers that lie inside a piece, not at its first word.
                    last = np.array(ends)
                    trigger = np.flatnonzero(shingle_hashes(hashed(words), shared) % np.uint64(TRIGGER) == 0)
                    piece_of = np.searchsorted(last, trigger, side="right")
                    head = np.r_[0, last[:-1]]
                    inside = (trigger > head[piece_of]) & (trigger + shared <= last[piece_of])
                    cuts = trigger[inside]
                    begins = np.sort(np.concatenate([head, cuts]))
                    stops = np.r_[begins[1:], len(words)]
                    final = np.isin(stops, last)
                    for a, b, end in zip(begins.tolist(), stops.tolist(), final.tolist(), strict=True):
                        found[lang, b" ".join(words[a : b if end else b + shared]), end] += 1
                keys = list(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k[0] for k in keys], pa.string()),
                        pa.array([k[1] for k in keys], pa.binary()).cast(pa.string()),
                        pa.array([k[2] for k in keys], pa.bool_()),
                        pa.array([k[1].count(b" ") + (1 if k[2] else 1 - shared) for k in keys], pa.int64()),
                        pa.array(list(found.values()), pa.int64()),
                    ],
                    ["lang", "chunk", "final", "owned", "n"],
                )

    return run


def dictionary(docs: DataFrame, longest: int = 5) -> DataFrame:
    """Distinct chunks: lang, chunk (words joined by a space), final, owned and n.

    ``final`` marks the last chunk of a piece; of the others the last ``longest`` - 1
    words start no phrase. ``owned`` is the number of words that do, ``n`` the frequency.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").where(F.col("text").isNotNull())
    parsed = with_workers(rows).mapInArrow(_chunks(longest), "lang string, chunk string, final boolean, owned long, n long")
    return parsed.groupBy("lang", "chunk", "final", "owned").agg(F.sum("n").alias("n"))


def _fold(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(before * STEP + word)


class Bitmap:
    """Which hashes were seen; may say yes of others, never no of these."""

    def __init__(self, cells: dict[int, int], bits: int) -> None:
        self.mask = np.uint64(bits - 1)
        self.cells = np.zeros(bits >> 6, dtype=np.uint64)
        if cells:
            self.cells[np.fromiter(cells.keys(), np.int64)] = np.fromiter(cells.values(), np.int64).view(np.uint64)

    def seen(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.cells[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _cells(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folded = np.empty(batch.num_rows, dtype=np.uint64)
            langs = utf8(batch.column("lang"))
            for i, (lang, phrase) in enumerate(zip(langs, utf8(batch.column("phrase")), strict=True)):
                one = np.array([xxh64_intdigest(lang)], dtype=np.uint64)
                for word in hashed(phrase.split(b" ")):
                    one = _fold(one, word)
                folded[i] = one[0]
            at = folded & np.uint64(bits - 1)
            flag = np.left_shift(np.uint64(1), at & np.uint64(63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(flag)], ["cell", "flag"])

    return run


def _bitmap(phrases: DataFrame) -> Broadcast:
    """A bitmap of the phrases, folded from word to word; at most MOST_BITS / 64 rows reach the driver."""
    bits = LEAST_BITS
    while bits < MOST_BITS and bits < 16 * phrases.count():
        bits *= 2
    cells = with_workers(phrases.select("lang", "phrase")).mapInArrow(_cells(bits), "cell long, flag long")
    rows = cells.groupBy("cell").agg(F.bit_or("flag").alias("flag")).collect()
    return phrases.sparkSession.sparkContext.broadcast(Bitmap({r["cell"]: r["flag"] for r in rows}, bits))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part in slices(batch, "chunk", BLOCK_BYTES):
            held.append(part)
            size += part.nbytes
            if size >= BLOCK_BYTES:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _counted(sizes: tuple[int, ...], shared: int, words_seen: Broadcast | None, pairs_seen: Broadcast | None):
    """Counts of the phrases of some sizes in a block of chunks; a phrase is its place in the block until then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            # Words stay in Arrow arrays; a number stands for each until its text is given out.
            lists = pc.split_pattern(table.column("chunk").combine_chunks(), " ")
            lengths = pc.list_value_length(lists).to_numpy().astype(np.int64)
            flat = lists.flatten()
            coded, tagged = flat.dictionary_encode(), table.column("lang").combine_chunks().dictionary_encode()
            codes, distinct = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
            owner = np.repeat(np.arange(len(lengths)), lengths)
            to_end = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))
            weight = np.repeat(table.column("n").to_numpy(), lengths)
            starts = table.column("final").to_numpy()[owner] | (to_end > shared)
            own_lang = tagged.indices.to_numpy()[owner].astype(np.int64)
            ids = own_lang * distinct + codes
            at = np.arange(len(codes))
            if words_seen is not None:
                inverse, known = pd.factorize(ids)
                word_hash = hashed(utf8(coded.dictionary))
                alone = _fold(hashed(utf8(tagged.dictionary))[known // distinct], word_hash[known % distinct])
                good = words_seen.value.seen(alone)[inverse]
                # A place goes on while the phrase from it may be frequent.
                at = np.flatnonzero(good[:-1] & good[1:] & (to_end[:-1] > 1))
                if pairs_seen is not None:
                    at = at[pairs_seen.value.seen(_fold(alone[inverse[at]], word_hash[codes[at + 1]]))]
            linked = np.zeros(len(codes) + 1, dtype=bool)
            linked[at] = True
            size = 1
            for wanted in sizes:
                while size < wanted:
                    # The phrase from each place grows by a word; all of its pairs must be linked.
                    at = at[linked[at + size - 1]]
                    ids[at] = pd.factorize(ids[at])[0].astype(np.int64) * distinct + codes[at + size]
                    size += 1
                own = at[starts[at]]
                numbers, phrases = pd.factorize(ids[own])
                first = np.empty(len(phrases), dtype=np.int64)
                first[numbers[::-1]] = own[::-1]
                counts = np.bincount(numbers, weight[own], len(phrases)).astype(np.int64)
                parts = [flat.take(pa.array(first + k)) for k in range(size)]
                yield pa.RecordBatch.from_arrays(
                    [
                        tagged.dictionary.take(pa.array(own_lang[first])).cast(pa.string()),
                        (pc.binary_join_element_wise(*parts, " ") if size > 1 else parts[0]).cast(pa.string()),
                        pa.array(np.full(len(first), size), pa.int32()),
                        pa.array(counts, pa.int64()),
                    ],
                    ["lang", "phrase", "size", "f"],
                )

    return run


def frequent_phrases(chunks: DataFrame, longest: int = 5, least: int = 100) -> DataFrame:
    """(lang, phrase, size, f) of all words and phrases that stand at least ``least`` times."""
    spark = chunks.sparkSession

    def step(sizes: tuple[int, ...], words: Broadcast | None, pairs: Broadcast | None) -> DataFrame:
        counted = with_workers(chunks.select("lang", "chunk", "final", "n")).mapInArrow(
            _counted(sizes, longest - 1, words, pairs), "lang string, phrase string, size int, f long"
        )
        summed = counted.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f"))
        return stored(summed.where(F.col("f") >= least), f"phrases-{sizes[0]}")

    words = step((1,), None, None)
    words_seen = _bitmap(words)
    pairs = step((2,), words_seen, None)
    found = words.unionByName(pairs)
    if longest > 2:
        found = found.unionByName(step(tuple(range(3, longest + 1)), words_seen, _bitmap(pairs)))
    return found


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, top: int = 2000) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n and score.

    ``a`` is the phrase's count, ``l`` and ``r`` those of the two parts at the cut with
    the lowest floor(1000 a n / (l r)), which is ``score``; ``n`` counts all words.
    Phrases that stand as often inside a longer one are left out.
    """
    chunks = stored(dictionary(docs, longest), "chunks")
    found = frequent_phrases(chunks, longest, least)
    totals = chunks.groupBy("lang").agg(F.sum(F.col("owned") * F.col("n")).alias("n"))
    candidates = found.where(F.col("size") >= 2).select("lang", "phrase", "size", F.col("f").alias("a"))
    words = F.split("phrase", " ")
    # A word may begin or end very many phrases: its count is laid out SALTS times.
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")

    def side(name: str) -> DataFrame:
        every = F.when(F.col("size") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        return found.select("lang", F.col("phrase").alias(f"{name}_part"), F.col("f").alias(name), F.explode(every).alias(f"{name}_salt"))

    cut = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select(
        "lang", "phrase", "size", "a", "k",
        F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("l_part"),
        F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("r_part"),
        F.when(F.col("k") == 1, salt).otherwise(F.lit(0)).alias("l_salt"),
        F.when(F.col("size") - F.col("k") == 1, salt).otherwise(F.lit(0)).alias("r_salt"),
    )
    cut = cut.join(side("l"), ["lang", "l_part", "l_salt"]).join(side("r"), ["lang", "r_part", "r_salt"])
    # One row per language: bounded by the number of languages, so it travels with the tasks.
    cut = cut.join(F.broadcast(totals), "lang")
    wide = "decimal(19,0)"
    over, under = f"(cast(a as {wide}) * cast(n as {wide}) * 1000)", f"(cast(l as {wide}) * cast(r as {wide}))"
    scored = cut.withColumn("score", F.expr(f"{over} div {under}"))
    lowest = scored.groupBy("lang", "phrase", "size", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # A longer phrase that stands as often contains one longer by a word that does.
    sub = candidates.where(F.col("size") > 2).select(
        "lang", "a", F.explode(F.array(F.array_join(F.slice(words, 1, F.col("size") - 1), " "), F.array_join(F.slice(words, 2, F.col("size") - 1), " "))).alias("phrase")
    )
    longer = sub.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    return ranked.select("lang", F.col("place").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


COLLOCATION_SQL = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), pieces AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts
), listed AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS words, count(*) AS n
  FROM pieces GROUP BY 1, 2
), starts AS (
  SELECT lang, words, n, unnest(range(1, len(words) + 1)) AS i FROM listed WHERE len(words) > 0
), grams AS (
  SELECT lang, n, m, array_to_string(words[i : i + m - 1], ' ') AS phrase
  FROM starts, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE i + m - 1 <= len(words)
), f AS (
  SELECT lang, m, phrase, sum(n)::BIGINT AS f FROM grams GROUP BY 1, 2, 3
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY 1
), often AS (
  SELECT * FROM f WHERE f >= 100
), cuts AS (
  SELECT c.lang, c.phrase, c.m, c.f AS a, k, l.f AS l, r.f AS r, t.n,
    ((1000::HUGEINT * c.f * t.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, m)) AS k, string_split(phrase, ' ') AS w FROM often WHERE m >= 2) c
  JOIN often l ON l.lang = c.lang AND l.m = k AND l.phrase = array_to_string(w[1 : k], ' ')
  JOIN often r ON r.lang = c.lang AND r.m = c.m - k AND r.phrase = array_to_string(w[k + 1 : c.m], ' ')
  JOIN totals t ON t.lang = c.lang
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_parts AS (
  SELECT lang, f, array_to_string(string_split(phrase, ' ')[i : j], ' ') AS part
  FROM often, (SELECT unnest([1, 2, 3, 4]) AS i), (SELECT unnest([2, 3, 4, 5]) AS j)
  WHERE m > 2 AND i < j AND j <= m AND j - i + 1 < m
), held AS (
  SELECT lang, part AS phrase, max(f) AS longer FROM inner_parts GROUP BY 1, 2
), kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN held USING (lang, phrase)
  WHERE held.longer IS NULL OR 100 * held.longer < 100 * a
)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
WHERE rank <= 2000
"""
