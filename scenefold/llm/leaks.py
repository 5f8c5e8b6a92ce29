"""Benchmark decontamination: exact containment of benchmark windows, by prefix filter.

Each window's word shingles are ordered by their count in the corpus; only the
rarest one, its prefix, is joined with the shingles of the documents. A match is
kept when the window fits between the document's ends at the prefix's offset
(length and positional bound) and all its words are equal there.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .common import slices, utf8, with_workers

#: Windows joined in one pass over the documents; a larger benchmark takes more passes.
BLOCK_WINDOWS = 100_000
#: Words of a prefix shingle; a shorter window is one shingle.
PREFIX_WORDS = 3


def _item_windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, windows = [], []
            for item, text in zip(batch.column("item_id").to_pylist(), utf8(batch.column("text")), strict=True):
                found = W.plain_words(text or b"")
                for i in range(max(1, len(found) - size + 1) if found else 0):
                    ids.append(item)
                    windows.append(b" ".join(found[i : i + size]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(windows, pa.binary())], ["item_id", "window"])

    return run


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """Distinct windows of each item as (item_id string, window words joined by a space)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null")
    return with_workers(items).mapInArrow(_item_windows(size), "item_id string, window binary").distinct()


def _shingles(window: bytes) -> np.ndarray:
    hashes = W.hashed(window.split())
    return W.shingle_hashes(hashes, min(PREFIX_WORDS, len(hashes)))


def _slice_shingles(batch: pa.RecordBatch, sizes: list[int]):
    """Words, document ends and, per shingle size, the hash at each position of a slice."""
    listed = [W.plain_words(text or b"") for text in utf8(batch.column("text"))]
    ends = np.cumsum([0] + [len(x) for x in listed])
    flat = [w for one in listed for w in one]
    hashes = W.hashed(flat)
    return listed, flat, ends, {s: W.shingle_hashes(hashes, s) for s in sizes}


def _counter(wanted: dict[int, np.ndarray]):
    """Counts of the wanted shingles in the documents, added up within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                _, _, ends, found = _slice_shingles(part, sorted(wanted))
                for size, hashes in found.items():
                    keys = wanted[size]
                    at = np.searchsorted(keys, hashes)
                    hit = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == hashes)
                    document = np.searchsorted(ends, hit, side="right")
                    hit = hit[hit + size <= ends[document]]
                    total.update((size, int(h)) for h in hashes[hit])
        sizes, keys = [k[0] for k in total], np.array([k[1] for k in total], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(sizes, pa.int32()), pa.array(keys, pa.int64()), pa.array(list(total.values()), pa.int64())], ["size", "shingle", "n"]
        )

    return run


def _scanner(windows: dict[bytes, list[str]], prefixes: dict[int, dict[int, list[tuple[int, bytes]]]]):
    """Append the occurrences (start, length, item ids) of a block's windows to ``_llm_spans``."""
    keys = {s: np.array(sorted(found), dtype=np.uint64) for s, found in prefixes.items()}
    split = {w: w.split() for w in windows}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                _, flat, ends, found = _slice_shingles(part, sorted(prefixes))
                spans = [list(x or ()) for x in part.column("_llm_spans").to_pylist()]
                for size, hashes in found.items():
                    at = np.searchsorted(keys[size], hashes)
                    hits = np.flatnonzero(keys[size][np.minimum(at, len(keys[size]) - 1)] == hashes)
                    documents = np.searchsorted(ends, hits, side="right") - 1
                    for position, document in zip(hits.tolist(), documents.tolist(), strict=True):
                        for offset, window in prefixes[size][int(hashes[position])]:
                            start, expected = position - offset, split[window]
                            if start < ends[document] or start + len(expected) > ends[document + 1]:
                                continue
                            if flat[start : start + len(expected)] == expected:
                                spans[document].append(
                                    {"start": start - int(ends[document]), "length": len(expected), "items": windows[window]}
                                )
                names = [n for n in part.schema.names if n != "_llm_spans"]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(n) for n in names], pa.array(spans, SPANS)], [*names, "_llm_spans"]
                )

    return run


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("items", pa.list_(pa.string()))]))


def occurrences(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` with ``_llm_spans``: each place where a whole benchmark window stands.

    Items are read as ``item_id`` (any type, compared as string; null items are
    left out) and ``text``. An item of fewer words than ``size`` is one window, an
    item without words none. The benchmark's windows are taken in blocks of at
    most ``block_windows``; each block is one pass over the documents, so what a
    task holds of the benchmark is bounded and every window is looked for.
    """
    grouped = (
        item_windows(benchmark, size).groupBy("window").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    )
    out = with_workers(docs).withColumn("_llm_spans", F.lit(None).cast("array<struct<start:int,length:int,items:array<string>>>"))
    schema = out.schema
    total = grouped.count()
    n_blocks = -(-total // block_windows)
    for block in range(n_blocks):
        share = grouped.where(F.pmod(F.xxhash64("window"), F.lit(n_blocks)) == block)
        windows = {bytes(r["window"]): list(r["items"]) for r in share.toLocalIterator()}
        if not windows:
            continue
        shingles = {w: _shingles(w) for w in windows}
        wanted: dict[int, set[int]] = defaultdict(set)
        for window, hashes in shingles.items():
            wanted[min(PREFIX_WORDS, len(window.split()))].update(int(h) for h in hashes)
        counted = (
            docs.select("text").mapInArrow(_counter({s: np.array(sorted(x), dtype=np.uint64) for s, x in wanted.items()}), "size int, shingle long, n long")
            .groupBy("size", "shingle").agg(F.sum("n").alias("n"))
        )
        count = {(r["size"], r["shingle"] & (2**64 - 1)): r["n"] for r in counted.toLocalIterator()}
        prefixes: dict[int, dict[int, list[tuple[int, bytes]]]] = defaultdict(lambda: defaultdict(list))
        for window, hashes in shingles.items():
            s = min(PREFIX_WORDS, len(window.split()))
            seen = [count.get((s, int(h)), 0) for h in hashes]
            if min(seen):  # a window with an absent shingle is nowhere
                offset = int(np.argmin(seen))
                prefixes[s][int(hashes[offset])].append((offset, window))
        if prefixes:
            out = out.mapInArrow(_scanner(windows, {s: dict(x) for s, x in prefixes.items()}), schema)
    return out


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            n_words, n_hit, n_items, digests = [], [], [], []
            for text, spans in zip(utf8(part.column("text")), part.column("_llm_spans").to_pylist(), strict=True):
                n = len(W.plain_words(text or b""))
                hit, items = np.zeros(n, dtype=bool), set()
                for span in spans or ():
                    hit[span["start"] : span["start"] + span["length"]] = True
                    items.update(span["items"])
                n_words.append(n)
                n_hit.append(int(hit.sum()))
                n_items.append(len(items))
                digests.append(sha256(",".join(sorted(items)).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digests, pa.string())],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"],
            )


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """Per document row: words, words inside a benchmark window, and the items found.

    A null or empty text has no words and is clean; repeated rows are judged each
    for itself; columns other than ``doc_id`` and ``text`` are not read.
    """
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = occurrences(rows, benchmark, size).mapInArrow(
        _summary, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string"
    )
    return found.withColumn("contaminated", F.col("n_hit") > 0)


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The rows of ``docs``, all columns, in whose text no benchmark window stands."""
    found = occurrences(docs, benchmark, size)
    return found.where(F.coalesce(F.size("_llm_spans"), F.lit(0)) <= 0).drop("_llm_spans")


LEAK_SQL = r"""
WITH plain AS (
  SELECT doc_id, row_number() OVER () AS rid, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
starts AS (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS win FROM starts),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM plain, sizes WHERE len(w) >= n),
hits AS (SELECT p.rid, p.s, p.n, x.item_id FROM
  (SELECT rid, n, s, array_to_string(w[s : s + n - 1], ' ') AS win FROM places) p JOIN windows x ON x.n = p.n AND x.win = p.win),
words AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS pos FROM hits) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT p.doc_id, CAST(len(p.w) AS BIGINT) AS n_words, coalesce(w.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
       sha256(coalesce(n.ids, '')) AS items_sha256, coalesce(w.n_hit, 0) > 0 AS contaminated
FROM plain p LEFT JOIN words w USING (rid) LEFT JOIN named n USING (rid)
"""
