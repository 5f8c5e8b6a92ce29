"""Near-duplicate documents by MinHash: universal minima, banding, exact verification, components.

* A document's set is its distinct word shingles, hashed to 64 bits. Equal sets
  are one node, named by their smallest document.
* ``BANDS`` x ``ROWS`` minima of multiply-shift hashes are folded into one key per
  band; nodes that share a band's key are candidates.
* Groups of a band are linked to a pivot first (no pairs within a group) and each
  link is confirmed on the full sets. Two rounds with different pivots join dense
  groups; then the pairs that still lie in different components of a group, and
  that sizes, odd sketches and signature bits allow, are confirmed as well. So every candidate
  pair is decided, while a large group of copies costs one link per copy.
* Components by alternating large-star and small-star.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh3_128_digest

from . import words as W
from .common import slices, stored, utf8, with_workers
from .components import connected_components

#: At similarity 0.8 a pair shares no band with probability (1 - 0.8 ** 4) ** 32, about 5e-8.
BANDS, ROWS = 32, 4

#: Places of the odd sketch that bounds the difference of two sets.
ODD_BITS = 1024

_random = np.random.default_rng(20_240_229)
MULTIPLIERS = _random.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _random.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each universal hash over a set; bounded memory for any set size."""
    least = np.full(len(MULTIPLIERS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(shingles), 1024):
        values = MULTIPLIERS[:, None] * shingles[None, start : start + 1024]
        values += OFFSETS[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return least >> np.uint64(32)


def band_keys(least: np.ndarray) -> np.ndarray:
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = W.mixed(keys * W.STEP + row)
    return keys.view(np.int64)


def signature_bits(least: np.ndarray) -> tuple[int, int]:
    """One bit of each minimum, as two longs."""
    bits = np.packbits((W.mixed(least) & np.uint64(1)).astype(np.uint8)).view(np.int64)
    return int(bits[0]), int(bits[1])


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                counts, keys, bands, low, high = [], [], [], [], []
                for text in utf8(part.column("text")):
                    found = W.shingle_set(W.hashed(W.spaced_words(text or b"")), size)
                    counts.append(len(found))
                    if len(found):
                        least = minima(found)
                        first, second = signature_bits(least)
                        keys.append(xxh3_128_digest(found.tobytes()))
                        bands.append(band_keys(least))
                    else:
                        first = second = None
                        keys.append(None)
                        bands.append(None)
                    low.append(first)
                    high.append(second)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
                     pa.array(low, pa.int64()), pa.array(high, pa.int64())],
                    ["doc_id", "n_shingles", "set_key", "bands", "low", "high"],
                )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [W.shingle_set(W.hashed(W.spaced_words(t or b"")), size) for t in utf8(part.column("text"))]
                keys = [xxh3_128_digest(x.tobytes()) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(keys, pa.binary()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64())),
                     pa.array([odd_sketch(x) for x in found], pa.list_(pa.int64()))],
                    ["doc_id", "set_key", "shingles", "odd"],
                )

    return run


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of a set's hashes over ODD_BITS places; two sketches differ in at most as
    many places as their sets have unequal elements."""
    return np.packbits((np.bincount((shingles % np.uint64(ODD_BITS)).astype(np.int64), minlength=ODD_BITS) & 1).astype(np.uint8)).view(np.int64)


def _similar_enough(a: str, b: str, percent: int) -> Column:
    """What sizes, odd sketches and signature bits say of a pair.

    Sizes and odd sketches never speak against a similar pair; for large sets,
    which the sketch cannot tell apart, the signature bits do at six deviations.
    """
    total, small, large = F.col(f"{a}n") + F.col(f"{b}n"), F.least(F.col(f"{a}n"), F.col(f"{b}n")), F.greatest(F.col(f"{a}n"), F.col(f"{b}n"))
    apart = F.bit_count(F.col(f"{a}low").bitwiseXOR(F.col(f"{b}low"))) + F.bit_count(F.col(f"{a}high").bitwiseXOR(F.col(f"{b}high")))
    unequal = F.lit(0)
    for i in range(ODD_BITS // 64):
        unequal = unequal + F.bit_count(F.get(F.col(f"{a}odd"), F.lit(i)).bitwiseXOR(F.get(F.col(f"{b}odd"), F.lit(i))))
    # With d unequal elements of t in all, similarity is (t - d) / (t + d).
    return (small * 100 >= large * percent) & (apart <= bit_limit(percent)) & (unequal * (100 + percent) <= total * (100 - percent))


def bit_limit(percent: int) -> int:
    """Signature bits that may differ at a similarity of ``percent``: mean plus six deviations."""
    rate = (1 - percent / 100) / 2
    return int(np.ceil(128 * rate + 6 * np.sqrt(128 * rate * (1 - rate)))) if rate else 0


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    union = F.size("sa").cast("long") + F.size("sb") - shared
    return both.where(shared * 100 >= union * percent).select("a", "b")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, ``component_id`` and ``kept``.

    Words are runs without ASCII white space with A-Z lower-cased; a document of
    fewer words than ``shingle`` is one shingle. A document without words (null or
    empty text) is linked with nothing and is its own component. ``doc_id`` is an
    integer; rows with a null id have no component, are linked with nothing and
    are kept. Repeated rows of one id share its component; of two different texts
    with one id each is judged by its own text. Other columns are not read.
    """
    rows = with_workers(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    prints = stored(
        rows.mapInArrow(_fingerprints(shingle), "doc_id long, n_shingles long, set_key binary, bands array<long>, low long, high long"),
        "fingerprints",
    )
    named = prints.where("doc_id is not null and n_shingles > 0")
    owner = stored(named.groupBy("set_key").agg(F.min("doc_id").alias("node")), "owners")
    nodes = stored(
        named.withColumnRenamed("doc_id", "node").join(owner, ["set_key", "node"], "left_semi").select("node", F.col("n_shingles").alias("n"), "low", "high", "bands", "set_key").dropDuplicates(["set_key"]),
        "nodes",
    )
    banded = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    crowded = banded.groupBy("band", "key").agg(F.count("*").alias("c"), F.min("node").alias("p0"), F.min_by("node", F.xxhash64("node", "band")).alias("p1")).where("c > 1")
    # Members of the groups of two or more; everything after this reads only these.
    members = stored(banded.join(crowded, ["band", "key"]), "members")
    in_groups = members.select("node").distinct()
    facts = stored(nodes.select("node", "n", "low", "high", "set_key").join(in_groups, "node", "left_semi"), "facts")
    wanted = facts.select(F.col("node").alias("doc_id"), "set_key")
    sets = stored(
        rows.join(wanted.select("doc_id"), "doc_id", "left_semi").mapInArrow(_sets(shingle), "doc_id long, set_key binary, shingles array<long>, odd array<long>")
        .join(wanted, ["doc_id", "set_key"], "left_semi").dropDuplicates(["set_key"]).select(F.col("doc_id").alias("node"), "shingles", "odd"),
        "sets",
    )
    light = stored(facts.select("node", "n", "low", "high").join(sets.select("node", "odd"), "node"), "light")

    def described(pairs: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(light.withColumnsRenamed({"node": side, **{c: side + c for c in ("n", "odd", "low", "high")}}), side)
        return pairs

    links, labels = None, None
    for pivot in ("p0", "p1"):
        pairs = members.where(F.col("node") != F.col(pivot)).select(F.col(pivot).alias("a"), F.col("node").alias("b")).distinct()
        if labels is not None:
            pairs = _apart(pairs, labels)
        found = confirmed(described(pairs).where(_similar_enough("a", "b", percent)), sets, percent)
        links = stored(found if links is None else links.unionByName(found), "links")
        labels = connected_components(links)
    labelled = (
        members.select("node", "band", "key").join(labels, "node", "left")
        .select("node", "band", "key", F.coalesce("component", "node").alias("label"))
    )
    mixed = labelled.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("band", "key")
    open_members = stored(labelled.join(mixed, ["band", "key"]).join(light, "node"), "open")
    left = open_members.withColumnsRenamed({"node": "a", "label": "la", "n": "an", "odd": "aodd", "low": "alow", "high": "ahigh"})
    right = open_members.withColumnsRenamed({"node": "b", "label": "lb", "n": "bn", "odd": "bodd", "low": "blow", "high": "bhigh"})
    rest = left.join(
        right,
        (left.band == right.band) & (left.key == right.key) & (F.col("la") < F.col("lb")) & _similar_enough("a", "b", percent),
    ).select("a", "b").distinct()
    final = stored(links.unionByName(confirmed(rest, sets, percent)), "links")
    component = connected_components(final)
    placed = (
        prints.select("doc_id", "n_shingles", "set_key").join(owner, "set_key", "left").join(component, "node", "left")
    )
    placed = placed.select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id")).alias("component_id")
    )
    return placed.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are not known to be connected yet."""
    for side in ("a", "b"):
        pairs = pairs.join(labels.withColumnsRenamed({"node": side, "component": "l" + side}), side, "left")
    return pairs.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, all columns, with one document (the smallest id) of each component.

    Repeated rows of a kept id are one document: one of them stays.
    """
    judged = near_duplicates(docs, shingle, percent)
    gone = judged.where(~F.col("kept")).select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti").select(*docs.columns)
    return named.dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null"))
