"""Substring dedup by content-defined chunking with a gear rolling hash.

A chunk ends where the gear hash of the last 32 bytes meets a mask, so its ends
move with the text and an insertion changes only the chunks it touches. A digest
covers a chunk and as many following ones as make ``MIN_BYTES``. Digests met in
several documents are repeats; the smallest document keeps the text, the others
lose it. Repeats that touch are one passage, and passages of fewer than
``MIN_WORDS`` words (boilerplate, common phrases) are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_64_intdigest

from .common import slices, utf8, with_workers

#: Mean bytes between cuts is 2 ** CUT_BITS; no chunk is longer than MAX_BYTES.
CUT_BITS, MAX_BYTES = 5, 128
#: Bytes that a digest covers at least, and words of a passage that counts as repeated.
MIN_BYTES, MIN_WORDS = 64, 16

GEAR = np.random.default_rng(1_009).integers(0, 2**32, 256, dtype=np.uint32)
_DEPTH = 32


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The 32-bit gear hash after each byte: sum of GEAR[byte k back] << k.

    h(i) = 2 h(i - 1) + GEAR[i] in 32 bits forgets bytes more than 31 back, so it
    can be built by doubling windows instead of byte by byte.
    """
    hashes = GEAR[data]
    reach = 1
    while reach < _DEPTH:
        longer = hashes.copy()
        longer[reach:] += hashes[:-reach] << np.uint32(reach)
        hashes, reach = longer, reach * 2
    return hashes


def _forced(hashes: np.ndarray, start: int, end: int) -> list[int]:
    """Cuts of a stretch without any: after the smallest hash of the last bytes allowed.

    That place moves with the text too, so periodic text is cut at one phase.
    """
    out = []
    while end - start > MAX_BYTES:
        reach = hashes[start + MIN_BYTES : start + MAX_BYTES]
        start += MIN_BYTES + len(reach) - int(np.argmin(reach[::-1]))
        out.append(start)
    return out


def cuts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Chunk starts, and the end, of the texts that ``ends`` (first 0) delimits in ``data``.

    A text's first and last byte are cuts. Cuts lie between UTF-8 characters.
    """
    hashes = gear_hashes(data)
    hit = np.flatnonzero(hashes >> np.uint32(32 - CUT_BITS) == 0) + 1
    text = np.searchsorted(ends, hit, side="right") - 1
    hit = hit[(hit - ends[text] >= _DEPTH) & (hit < len(data))]  # a window within one text
    found = np.unique(np.concatenate([ends, hit]))
    gaps = np.flatnonzero(np.diff(found) > MAX_BYTES)
    more = [cut for g in gaps.tolist() for cut in _forced(hashes, int(found[g]), int(found[g + 1]))]
    found = np.concatenate([found, np.array(more, dtype=found.dtype)])
    for _ in range(3):
        found = np.where((found < len(data)) & (data[np.minimum(found, len(data) - 1)] & 0xC0 == 0x80), found + 1, found)
    return np.unique(found)


def spans(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start, end) of each run of chunks that has MIN_BYTES, from every cut on."""
    found = cuts(np.frombuffer(data, dtype=np.uint8), ends)
    text = np.searchsorted(ends, found, side="right") - 1
    to = np.searchsorted(found, found + MIN_BYTES)
    inside = (to < len(found)) & (text < len(ends) - 1)
    text, start, to = text[inside], found[inside], found[np.minimum(to, len(found) - 1)][inside]
    whole = to <= ends[text + 1]
    return text[whole], start[whole], to[whole]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            texts = [t or b"" for t in utf8(part.column("text"))]
            ends = np.cumsum([0] + [len(t) for t in texts])
            if not ends[-1]:
                continue
            data = b"".join(texts)
            text, start, to = spans(data, ends)
            digests = np.fromiter((xxh3_64_intdigest(data[a:b]) for a, b in zip(start.tolist(), to.tolist(), strict=True)), np.uint64, len(text))
            here = start - ends[text]
            # Where the run is, in one long: 31 bits start, 12 bits length, 20 bits of the text's hash.
            tags = part.column("tag").to_numpy()[text]
            packed = here << 32 | (to - start) << 20 | tags
            ids = part.column("doc_id").to_numpy()[text]
            yield pa.RecordBatch.from_arrays([pa.array(digests.view(np.int64)), pa.array(ids, pa.int64()), pa.array(packed, pa.int64())], ["digest", "doc_id", "place"])


def _tagged(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_llm_tag", F.pmod(F.xxhash64("text"), F.lit(1 << 20)))


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, found): per text the runs (start, length, first) that other documents hold too.

    ``first`` is the smallest document that holds the run. Rows with a null id take
    no part; the tag tells different texts of one id apart.
    """
    rows = with_workers(_tagged(docs.where("doc_id is not null and text is not null"))).select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("_llm_tag").alias("tag")
    )
    runs = rows.mapInArrow(_digests, "digest long, doc_id long, place long")
    shared = runs.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
    met = runs.join(shared, "digest")
    place = F.col("place")
    return met.groupBy("doc_id", place.bitwiseAND(F.lit((1 << 20) - 1)).alias("tag")).agg(
        F.collect_list(
            F.struct(F.shiftrightunsigned(place, 32).cast("int").alias("start"), F.shiftrightunsigned(place, 20).bitwiseAND(F.lit(4095)).cast("int").alias("length"), "first")
        ).alias("found")
    )


def passages(text: bytes, found: list[tuple[int, int, bool]], min_words: int = MIN_WORDS) -> list[tuple[int, int, bool]]:
    """(start, end, own) of the repeated passages; own parts are kept, the others go.

    Overlapping or touching runs are one passage, whose words decide whether it
    counts; within it the parts that this document holds first stay.
    """
    out: list[tuple[int, int, bool]] = []
    runs = sorted((start, start + length, own) for start, length, own in found)
    i = 0
    while i < len(runs):
        j, end = i, runs[i][1]
        while j < len(runs) and runs[j][0] <= end:
            end = max(end, runs[j][1])
            j += 1
        begin = runs[i][0]
        if len(text[begin:end].split()) >= min_words:
            gone = np.zeros(end - begin, dtype=bool)
            for a, b, own in runs[i:j]:
                if not own:
                    gone[a - begin : b - begin] = True
            edges = np.flatnonzero(np.diff(np.concatenate([[not gone[0]], gone, [not gone[-1]]])))
            out += [(begin + int(a), begin + int(b), not bool(gone[a])) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        i = j
    return out


REPEATS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("own", pa.bool_())]))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            texts, lists = [], []
            ids = part.column("doc_id").to_pylist()
            for doc, text, found in zip(ids, utf8(part.column("text")), part.column("_llm_found").to_pylist(), strict=True):
                # A tag may meet another text of the same id once in a million: runs past its end are not its own.
                runs = [(x["start"], x["length"], x["first"] == doc) for x in found or () if x["start"] + x["length"] <= len(text or b"")]
                listed = passages(text, runs) if runs else []
                for a, b, own in reversed(listed):
                    if not own:
                        text = text[:a] + text[b:]
                texts.append(text.decode("utf-8", "replace") if text is not None else None)
                lists.append([{"start": a, "end": b, "own": own} for a, b, own in listed])
            names = [n for n in part.schema.names if n not in ("text", "_llm_found")]
            yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(texts, pa.string()), pa.array(lists, REPEATS)], [*names, "text", "repeats"])


def dedup_substrings(docs: DataFrame, only_repeats: bool = False) -> DataFrame:
    """``docs``, all columns, without the passages that a document with a smaller id holds.

    ``repeats`` (a column of that name is replaced) lists the repeated passages by
    byte offset in the former text; ``own`` ones are kept, since this document has
    the smallest id. Null and empty texts, and rows with a null id, stay as they
    are. Rows of one id are one document: what they share with each other is no
    repeat. ``only_repeats`` leaves out the documents without repeats.
    """
    docs = docs.drop("repeats")
    found = repeats(docs).withColumnsRenamed({"doc_id": "_llm_id", "tag": "_llm_of", "found": "_llm_found"})
    joined = _tagged(docs).join(
        found, (F.col("doc_id") == F.col("_llm_id")) & (F.col("_llm_tag") == F.col("_llm_of")), "inner" if only_repeats else "left"
    ).drop("_llm_id", "_llm_of", "_llm_tag")
    names = [f for f in joined.schema.fields if f.name not in ("text", "_llm_found")]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names)
    out = joined.mapInArrow(_cut, f"{shape}, text string, repeats array<struct<start:int,end:int,own:boolean>>")
    if only_repeats:
        out = out.where(F.size("repeats") > 0)
    return out.select(*docs.columns, "repeats")


def repeat_report(docs: DataFrame) -> DataFrame:
    """Per document with repeated passages: their number and bytes, the bytes removed, the digest of what is kept."""
    found = dedup_substrings(docs.select("doc_id", "text"), only_repeats=True)
    size = lambda x: (x["end"] - x["start"]).cast("long")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + size(x))
    return found.select(
        "doc_id", F.size("repeats").alias("n_repeats"), total(F.col("repeats")).alias("repeated_bytes"),
        total(F.filter("repeats", lambda x: ~x["own"])).alias("removed_bytes"), F.sha2("text", 256).alias("kept_sha256"),
    )
