"""SentencePiece encoding and decoding over a piece table.

The distinct words of blocks of documents meet the piece table in the lattice of
``lattice``; each word is segmented once, whatever number of documents hold it.
Blocks (a bounded run of documents of one scan task) then get the ids of their own
words back and put their documents together. Texts, and a block's words of each
hash bucket, travel compressed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from .common import partitions_for, slices, utf8, with_workers
from .lattice import WORD_BYTES, best_paths, best_pieces, merged_paths, merged_pieces, ranked, single_ids

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text of one block, about; bounds what a task of the last step holds.
BLOCK_BYTES = 16 << 20
#: Bytes of the input, as files have them, for each partition of the words and of the blocks.
PARTITION_BYTES = 64 << 20
#: A vocabulary is a fixed file; only one of at most this many pieces is broadcast.
BROADCAST_PIECES = 300_000

#: A word is a run of spaces with what follows up to the next space, or a line feed:
#: no piece of the table goes on after either (checked by ``load_pieces``).
_WORD = re.compile(rb" *[^ \n]+|\n| +")


#: Spark's xxhash64 of a string is XXH64 of its bytes with seed 42.
_SEED = 42
_BUCKET = "cast(pmod(xxhash64(word), {}) as int)"


def buckets_of(words: list[bytes], buckets: int) -> list[int]:
    digests = np.fromiter((xxh64_intdigest(w, _SEED) for w in words), np.uint64, len(words))
    return (digests.view(np.int64) % buckets).tolist()


def load_pieces(path: str = MODEL) -> list[tuple[str, float, int]]:
    """(piece, score, id) of the ordinary pieces of a model file; byte pieces as (<0xNN>, score, id)."""
    from sentencepiece import SentencePieceProcessor

    if not Path(path).is_file():
        raise FileNotFoundError(f"no piece model at {path}")
    model = SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i))]
    table = [(model.id_to_piece(i), float(model.get_score(i)), i) for i in ids]
    ordinary = [p for p, _, _ in table if not re.fullmatch("<0x[0-9A-F]{2}>", p)]
    if any("▁" in p.lstrip("▁") or "\n" in p for p in ordinary):
        raise ValueError("pieces that go on after a space or a line feed are not supported")
    return table


def byte_ids(table: list[tuple[str, float, int]]) -> list[int]:
    """The id of each byte's piece, for characters that are no piece."""
    known = {p: i for p, _, i in table}
    return [known[f"<0x{b:02X}>"] for b in range(256)]


def split_words(text: bytes) -> list[bytes]:
    """Words of a text with a space put before it; none of an empty text."""
    if not text:
        return []
    text = b" " + text
    if b"  " in text or b"\0" in text:
        return _WORD.findall(text)
    # The same without a run of spaces: a zero byte before each space and around line feeds.
    return list(filter(None, text.replace(b"\n", b"\0\n\0").replace(b" ", b"\0 ").split(b"\0")))


def _numbered(batches: Iterator[pa.RecordBatch], column: str, block_bytes: int) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """(block, last of it, rows): a task's rows in blocks of about ``block_bytes`` of text."""
    task, number, size, held = TaskContext.get().partitionId(), 0, 0, None
    for batch in batches:
        for part in slices(batch, column):
            if held is not None:
                yield task << 32 | number, size >= block_bytes, held
                number, size = (number + 1, 0) if size >= block_bytes else (number, size)
            held = part
            size += pc.sum(pc.binary_length(part.column(column))).as_py() or 0
    if held is not None:
        yield task << 32 | number, True, held


def _dealt(words: set[bytes], buckets: int) -> list[list[bytes]]:
    """The distinct words of a block by bucket, sorted; a line feed and long words are in no bucket."""
    listed = sorted(w for w in words if len(w) <= WORD_BYTES and w != b"\n")
    out: list[list[bytes]] = [[] for _ in range(buckets)]
    for word, bucket in zip(listed, buckets_of(listed, buckets), strict=True):
        out[bucket].append(word)
    return out


def _vocabulary(column: str, block_bytes: int, buckets: int):
    """(bucket, block, words): what a block has of each bucket, in one compressed value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, words = zstandard.ZstdCompressor(level=9), set()
        for block, last, part in _numbered(batches, column, block_bytes):
            for text in utf8(part.column(column)):
                words.update(split_words(text or b""))
            if last:
                rows = [(i, packer.compress(b"\n".join(some))) for i, some in enumerate(_dealt(words, buckets)) if some]
                words = set()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _ in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([x for _, x in rows], pa.binary())],
                    ["bucket", "block", "words"],
                )

    return run


def _unpacked(packed: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(packed).split(b"\n")


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, bucket): each word once; a bucket's rows follow one another."""
    met: set[bytes] = set()
    now = None

    def told() -> Iterator[pa.RecordBatch]:
        listed = list(met)
        for start in range(0, len(listed), 20_000):
            some = listed[start : start + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()).cast(pa.string()), pa.array([now] * len(some), pa.int32())], ["word", "bucket"])

    for batch in batches:
        for bucket, packed in zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist(), strict=True):
            if bucket != now:
                yield from told()
                met.clear()
                now = bucket
            met.update(_unpacked(packed))
    yield from told()


def _answered(left: pa.Table, right: pa.Table) -> pa.Table:
    """(block, bucket, ids): lengths and ids of a block's words of one bucket, in their order."""
    known = _word_table(right)
    packer, rows = zstandard.ZstdCompressor(level=9), []
    for packed in left.column("words").to_pylist():
        ids = [known[w] for w in _unpacked(packed)]
        lengths = np.fromiter((len(x) // 4 for x in ids), np.uint16, len(ids))
        flat = np.frombuffer(b"".join(ids), np.int32)
        rows.append(packer.compress(lengths.tobytes() + (flat.astype(np.uint16) if flat.max(initial=0) < 1 << 16 else flat).tobytes()))
    return pa.table({"block": left.column("block"), "bucket": left.column("bucket"), "ids": pa.array(rows, pa.binary())})


def _word_table(table: pa.Table) -> dict[bytes, bytes]:
    known: dict[bytes, bytes] = {}
    for batch in table.to_batches():
        ids = batch.column("ids")
        flat, ends = ids.values.to_numpy(zero_copy_only=False).astype(np.int32).tobytes(), (ids.offsets.to_numpy() * 4).tolist()
        known.update(zip(utf8(batch.column("word")), [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], strict=True))
    return known


def _packed(column: str, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=6)
        for block, _, part in _numbered(batches, column, block_bytes):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as out:
                out.write_batch(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([packer.compress(sink.getvalue())], pa.binary())], ["block", "rows"]
            )

    return run


def _assembled(column: str, names: list[str], buckets: int, line_feed: int, long_ids: Callable[[str], list[int]]):
    """Put a block's documents together from the ids of its words; ``long_ids`` gives those of long words."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        packed_rows = left.column("rows").to_pylist()

        def parts() -> Iterator[pa.RecordBatch]:
            for packed in packed_rows:
                yield from pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(packed))

        words: set[bytes] = set()
        for batch in parts():
            for text in utf8(batch.column(column)):
                words.update(split_words(text or b""))
        known = {b"\n": np.int32(line_feed).tobytes()}
        known.update((w, np.array(long_ids(w.decode()), np.int32).tobytes()) for w in words if len(w) > WORD_BYTES)
        dealt = _dealt(words, buckets)
        del words
        for bucket, packed in zip(right.column("bucket").to_pylist(), right.column("ids").to_pylist(), strict=True):
            here, raw = dealt[bucket], zstandard.ZstdDecompressor().decompress(packed)
            lengths = np.frombuffer(raw[: 2 * len(here)], np.uint16).astype(np.int64)
            total = int(lengths.sum())
            wide = len(raw) - 2 * len(here) == 4 * total
            flat = np.frombuffer(raw[2 * len(here) :], np.int32 if wide else np.uint16).astype(np.int32)
            if len(flat) != total:
                raise ValueError("the documents changed between two reads")
            ends = np.concatenate([[0], np.cumsum(lengths)]) * 4
            data = flat.tobytes()
            known.update(zip(here, [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], strict=True))
        tables = []
        for batch in parts():
            flat, ends, absent = [], [0], []
            for text in utf8(batch.column(column)):
                flat.append(b"".join(map(known.__getitem__, split_words(text or b""))))
                ends.append(ends[-1] + len(flat[-1]) // 4)
                absent.append(text is None)
            values = pa.array(np.frombuffer(b"".join(flat), dtype=np.int32))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array(absent, pa.bool_()))
            tables.append(pa.Table.from_arrays([*[batch.column(n) for n in names], lists], [*names, "ids"]))
        return pa.concat_tables(tables)

    return run


def long_word_ids(table: list[tuple[str, float, int]], method: str = "merge") -> Callable[[str], list[int]]:
    """The ids of one word of any length, the same as ``word_ids`` gives."""
    known = {p.replace("▁", " "): (s, i) for p, s, i in table if not re.fullmatch("<0x[0-9A-F]{2}>", p)}
    spare = byte_ids(table)
    longest, unknown = max(map(len, known)), min(s for s, _ in known.values()) - 10.0

    def run(word: str) -> list[int]:
        parts = merged_pieces(word, known) if method == "merge" else best_pieces(word, known, longest, unknown)
        return [i for p in parts for i in ([known[p][1]] if p in known else [spare[b] for b in p.encode()])]

    return run


def word_ids(words: DataFrame, table: list[tuple[str, float, int]], method: str = "merge") -> DataFrame:
    """(word, ids): the ids of each distinct word; spaces stand for the table's word mark.

    ``method`` is merge for a BPE table (scores are ranks) or viterbi for a unigram
    table (scores are log probabilities). A character that is no piece becomes the
    pieces of its UTF-8 bytes.
    """
    spark = words.sparkSession
    ordinary = [(p.replace("▁", " "), s, i) for p, s, i in table if not re.fullmatch("<0x[0-9A-F]{2}>", p)]
    known = {p: (s, i) for p, s, i in ordinary}
    if method == "merge":
        pieces = spark.createDataFrame(ranked(known), "piece string, score long, id int")
    else:
        pieces = spark.createDataFrame(ordinary, "piece string, score double, id int")
    if len(ordinary) <= BROADCAST_PIECES:
        pieces = F.broadcast(pieces)
    longest = max(len(p) for p, _, _ in ordinary)
    if method == "merge":
        paths = merged_paths(words, pieces, longest, single_ids(known))
    else:
        paths = best_paths(words, pieces, longest, min(s for _, s, _ in ordinary) - 10.0)
    spare = F.array(*[F.lit(i) for i in byte_ids(table)])

    def ids(symbol):
        shown = F.hex(F.encode(F.substr(F.col("word"), symbol["start"], symbol["l"]), "UTF-8"))
        bytes_ = F.transform(
            F.sequence(F.lit(1), F.length(shown), F.lit(2)), lambda k: F.element_at(spare, F.conv(F.substr(shown, k, F.lit(2)), 16, 10).cast("int") + 1)
        )
        return F.when(symbol["id"] >= 0, F.array(symbol["id"])).otherwise(bytes_)

    return paths.select("word", F.flatten(F.transform("path", ids)).alias("ids"))


def encode(docs: DataFrame, text: str = "text", model: str = MODEL, method: str = "merge", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``ids``, the piece ids of each text (a column of that name is replaced).

    A null text has null ids, an empty one none. ``docs`` must give the same rows
    in the same order whenever it is computed, as files do: it is read twice. A
    difference fails the job.
    """
    docs = with_workers(docs.drop("ids"))
    table = load_pieces(model)
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    # The partitions grow with the input, so that a bucket and a task keep their size.
    tasks = partitions_for(docs, PARTITION_BYTES)
    buckets = 2 * tasks
    met = docs.select(text).mapInArrow(_vocabulary(text, block_bytes, buckets), "bucket int, block long, words binary").repartition(tasks, "bucket")
    words = met.sortWithinPartitions("bucket").mapInArrow(_distinct, "word string, bucket int")
    # More and smaller partitions for the lattice, so that grouping its edges fits in memory.
    spread = words.repartition(4 * tasks, "word")
    coded = word_ids(spread.select("word"), table, method).withColumn("bucket", F.expr(_BUCKET.format(buckets))).repartition(tasks, "bucket")
    found = met.groupBy("bucket").cogroup(coded.groupBy("bucket")).applyInArrow(_answered, "block long, bucket int, ids binary")
    packed = docs.mapInArrow(_packed(text, block_bytes), "block long, rows binary").repartition(tasks, "block")
    found = found.repartition(tasks, "block")
    assembled = _assembled(text, docs.columns, buckets, byte_ids(table)[10], long_word_ids(table, method))
    return packed.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(assembled, f"{shape}, ids array<int>")


def spelled(ids: Column, table: list[tuple[str, float, int]]) -> Column:
    """The text of a column of ids; bytes that form no character become U+FFFD.

    Null ids have no text, ids outside the table spell nothing.
    """
    shown = {i: p.replace("▁", " ").encode().hex() for p, _, i in table} | {i: f"{b:02x}" for b, i in enumerate(byte_ids(table))}
    # One literal, which the optimiser folds into an array.
    spelling = F.split(F.lit(",".join(shown.get(i, "") for i in range(max(shown) + 1))), ",")
    whole = F.array_join(F.transform(ids, lambda i: F.get(spelling, i)), "")
    text = F.make_valid_utf8(F.unhex(whole).cast("string"))
    return F.when(text.startswith(" "), F.substr(text, F.lit(2))).otherwise(text)


def decode(rows: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """``rows`` with ``decoded``, the text of their ids (see ``spelled``)."""
    return rows.withColumn("decoded", spelled(F.col(ids), load_pieces(model)))


def round_trip(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Per document: number and hash of its piece ids, and whether decoding gives its text."""
    coded = encode(docs.select("doc_id", "text"), model=model)
    back = decode(coded, model=model)
    return back.select(
        "doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("same_text"),
    )
