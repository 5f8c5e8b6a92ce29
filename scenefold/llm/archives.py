"""WARC archives of pages, and the merge of their capture runs into one ordered history.

Writing: equal payloads are found by digest, the smallest page keeps the payload
and the others become revisit records. Each task writes gzip members, one for
each record, into archives of the shared folder; the names that count are those
that successful tasks report.

Reading: each archive is parsed back into capture rows, which are sorted where
they are read: one sorted run for each task. The runs are merged by URL key, time
and page with a loser tree. At most ``FAN_IN`` runs meet in one merge; more are
merged in rounds. The last round is cut into key ranges, one task each, which
read only the row groups of the runs that reach into their range.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from hashlib import sha256
from urllib.parse import quote
from uuid import NAMESPACE_URL, uuid5

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import LOWER, UPPER, scratch_path, slices, utf8, with_workers

#: Payloads of fewer bytes are written again rather than referred to.
MIN_REVISIT_BYTES = 100
#: A task starts a new archive when the last one has this many bytes.
ARCHIVE_BYTES = 128 << 20
#: Sorted runs that one merge reads at a time.
FAN_IN = 64
#: Captures of one range of the last merge, about.
RANGE_ROWS = 100_000
FIRST_CAPTURE = 1_704_067_200

CAPTURE_SCHEMA = "url_key string, captured_at long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, offset long, length long"
_CAPTURES = pa.schema(
    [("captured_at", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
     ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
)
_READ_SCHEMA = CAPTURE_SCHEMA.removeprefix("url_key string, ")
_RUNS = pa.schema([("url_key", pa.string()), *_CAPTURES])
_MERGED = pa.schema([*_RUNS, ("range_no", pa.int32()), ("row_no", pa.int64())])


def url_key(url: Column) -> Column:
    """Host labels from the right, a bracket, then path and query; A-Z lower-cased, no fragment."""
    low = F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER)
    bare = F.regexp_replace(F.regexp_replace(low, "#[\\s\\S]*$", ""), "^[^:/?#]*://", "")
    host = F.regexp_extract(bare, "^[^/?]*", 0)
    return F.concat(
        F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), F.substr(bare, F.length(host) + 1)
    )


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file:///"):
        path = "file://" + path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid5(NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, captured_at: int, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit carries the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page_id)}"]
    head.append(f"WARC-Date: {datetime.fromtimestamp(captured_at, UTC):%Y-%m-%dT%H:%M:%SZ}")
    if url is not None:  # control characters cannot stand in a header
        head.append("WARC-Target-URI: " + "".join(quote(c) if c < " " or c == "\x7f" else c for c in url))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}",
        ]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _store(folder)
        fs.create_dir(base, recursive=True)
        task, names, counts, out, size = TaskContext.get().taskAttemptId(), [], [], None, 0
        for batch in batches:
            for part in slices(batch, "payload"):
                columns = [part.column(c).to_pylist() for c in ("page_id", "url", "captured_at", "digest", "record_type", "refers_to")]
                for payload, page, url, at, digest, kind, refers in zip(utf8(part.column("payload")), *columns, strict=True):
                    if out is None or size >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        names.append(f"archive-{task:08d}-{len(names):04d}.warc.gz")
                        counts.append(0)
                        out, size = fs.open_output_stream(f"{base}/{names[-1]}", compression=None), 0
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    member = packer.compress(record(page, url, at, payload or b"", digest, kind, refers)) + packer.flush()
                    out.write(member)
                    size += len(member)
                    counts[-1] += 1
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n in names], pa.string()), pa.array(counts, pa.int64())], ["archive", "records"])

    return run


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a record for each row of ``pages``; returns (archive, records), already stored.

    Reads ``page_id``, ``url``, ``html`` and no other column. A null html is an
    empty payload. Of equal payloads of at least ``MIN_REVISIT_BYTES`` the row
    with the smallest page_id is the response (rows that repeat that id too); a
    null page_id is larger than any other, and a group of null ids is all
    responses. The table has no capture time, so seconds are counted from page_id.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "archives")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    size = F.octet_length("payload")
    firsts = (
        rows.where(size >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 and first is not null").select("digest", "first")
    )
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    typed = with_workers(rows).join(firsts, "digest", "left").select(
        "page_id", "url", "payload", "digest", refers.alias("refers_to"),
        F.when(refers.isNull(), "response").otherwise("revisit").alias("record_type"),
        (F.lit(FIRST_CAPTURE) + F.coalesce(F.pmod("page_id", F.lit(1_000_000_000)), F.lit(0))).alias("captured_at"),
    )
    manifest = scratch_path(spark, "manifest")
    typed.mapInArrow(_writer(folder), "archive string, records long").write.parquet(manifest)
    return spark.read.schema("archive string, records long").parquet(manifest)


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member of a file object, one at a time."""
    offset, data, pieces, unpacker, used = 0, b"", [], zlib.decompressobj(31), 0
    while True:
        if not data:
            data = stream.read(1 << 20)
            if not data:
                if used:
                    raise ValueError("truncated archive")
                return
        pieces.append(unpacker.decompress(data))
        if unpacker.eof:
            rest = unpacker.unused_data
            used += len(data) - len(rest)
            yield offset, used, b"".join(pieces)
            offset, data, pieces, unpacker, used = offset + used, rest, [], zlib.decompressobj(31), 0
        else:
            used += len(data)
            data = b""


def parse(content: bytes) -> dict:
    """Headers and payload facts of one record; a damaged record is an error."""
    head, _, rest = content.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if not first.startswith("WARC/") or len(rest) != len(block) + 4:
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x.split(b": ")[1] for x in http.split(b"\r\n") if x.startswith(b"Content-Length: ")))
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != size or sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "captured_at": int(datetime.strptime(fields["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC).timestamp()),
        "page_id": number("X-Page-Id"), "url": fields.get("WARC-Target-URI"), "record_type": kind, "payload_bytes": size,
        "payload_digest": digest, "refers_to": number("X-Refers-To-Page"),
    }


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive in batch.column("archive").to_pylist():
            fs, path = _store(archive)
            rows: list[dict] = []
            with fs.open_input_stream(path, compression=None) as stream:
                for offset, length, content in members(stream):
                    rows.append(parse(content) | {"archive": archive.rsplit("/", 1)[-1], "offset": offset, "length": length})
                    if len(rows) == 2048:
                        yield pa.RecordBatch.from_pylist(rows, _CAPTURES)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _CAPTURES)


def read_archives(manifest: DataFrame) -> DataFrame:
    """The captures of the archives named by ``manifest``, one task for each archive."""
    tasks = max(1, manifest.count())
    rows = with_workers(manifest.select("archive")).repartition(tasks).mapInArrow(_reader, _READ_SCHEMA)
    return rows.select(url_key(F.col("url")).alias("url_key"), *_CAPTURES.names)


class LoserTree:
    """k-way merge: each inner node holds the loser of its match, the winner is on top.

    Taking the winner replays one path to the top, so a row costs log2(k)
    comparisons. Of equal keys the source with the smaller number goes first.
    """

    def __init__(self, sources: Iterable[Iterator[tuple[tuple, tuple]]]):
        self.sources = [iter(s) for s in sources]
        self.heads = [next(s, None) for s in self.sources]
        self.nodes = [-1] * max(1, len(self.sources))
        for leaf in range(len(self.sources)):
            self._replay(leaf)

    def _beats(self, a: int, b: int) -> bool:
        if a < 0 or b < 0:  # an empty place goes up until the tree is full
            return a < 0
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return x is not None
        return (x[0], a) < (y[0], b)

    def _replay(self, leaf: int) -> None:
        winner, node = leaf, (leaf + len(self.sources)) // 2
        while node:
            if self._beats(self.nodes[node], winner):
                winner, self.nodes[node] = self.nodes[node], winner
            node //= 2
        self.nodes[0] = winner

    def __iter__(self) -> Iterator[tuple[tuple, tuple]]:
        while self.sources and (head := self.heads[winner := self.nodes[0]]) is not None:
            yield head
            self.heads[winner] = next(self.sources[winner], None)
            self._replay(winner)


LEAST = -(2**63)


def _key(key: str | None, at: int | None, page: int | None) -> tuple:
    """Nulls first, strings by code point: the order in which Spark sorts a run."""
    return (key or "", LEAST if at is None else at, LEAST if page is None else page)


def _run_rows(path: str, low: tuple | None, high: tuple | None) -> Iterator[tuple[tuple, tuple]]:
    """The rows of one sorted run with low <= key < high; other row groups are not read."""
    fs, name = _store(path)
    with pq.ParquetFile(fs.open_input_file(name)) as run:
        at = run.schema_arrow.names.index("url_key")
        for group in range(run.num_row_groups):
            facts = run.metadata.row_group(group).column(at).statistics
            if facts is not None and facts.has_min_max:
                if low is not None and facts.max < low[0]:
                    continue
                if high is not None and facts.min > high[0]:
                    return
            for batch in run.iter_batches(batch_size=2048, row_groups=[group], columns=_RUNS.names):
                for row in zip(*[batch.column(c).to_pylist() for c in _RUNS.names], strict=True):
                    key = _key(*row[:3])
                    if high is not None and key >= high:
                        return
                    if low is None or key >= low:
                        yield key, row


def _merger(groups: list[list[str]], bounds: list[tuple]):
    """Merge group i (rounds), or, of a single group, the i-th key range (last round)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column("id").to_pylist():
                low = bounds[i - 1] if bounds and i else None
                high = bounds[i] if i < len(bounds) else None
                runs, rows, done = groups[i] if len(groups) > 1 else groups[0], [], 0
                for _, row in LoserTree(_run_rows(path, low, high) for path in runs):
                    rows.append((*row, i, done + len(rows)))
                    if len(rows) == 4096:
                        yield _columns(rows)
                        rows, done = [], done + 4096
                if rows:
                    yield _columns(rows)

    return run


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _MERGED, strict=True)], schema=_MERGED)


def _write_runs(spark: SparkSession, rows: DataFrame) -> list[str]:
    path = scratch_path(spark, "runs")
    rows.write.option("parquet.block.size", 1 << 20).parquet(path)
    return sorted(spark.read.schema(CAPTURE_SCHEMA).parquet(path).inputFiles())


def merge_runs(captures: DataFrame, fan_in: int = FAN_IN, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``captures`` in global order of URL key, time and page.

    Returns the captures with ``range_no`` (ascending key ranges) and ``row_no``
    (order within a range). Runs are sorted where they lie; each written part is
    one run. A URL with very many captures may span ranges, since these are cut by
    the whole key.
    """
    spark = captures.sparkSession
    order = ["url_key", "captured_at", "page_id"]
    runs = _write_runs(spark, captures.select(*_RUNS.names).sortWithinPartitions(*order))
    merged = CAPTURE_SCHEMA + ", range_no int, row_no long"
    while len(runs) > fan_in:
        groups = [runs[i : i + fan_in] for i in range(0, len(runs), fan_in)]
        longer = with_workers(spark.range(0, len(groups), 1, len(groups))).mapInArrow(_merger(groups, []), merged)
        runs = _write_runs(spark, longer.select(*_RUNS.names))
    if not runs:
        return spark.createDataFrame([], merged)
    keys = spark.read.schema(CAPTURE_SCHEMA).parquet(*runs).select(*order)
    ranges = max(1, -(-keys.count() // range_rows))
    # A bounded sample sets the cuts between ranges; it decides where work is done, not the result.
    sample = keys.orderBy(F.xxhash64(*order)).limit(32 * ranges).collect() if ranges > 1 else []
    spread = sorted(_key(*row) for row in sample)
    bounds = sorted({spread[len(spread) * i // ranges] for i in range(1, ranges)}) if spread else []
    tasks = len(bounds) + 1
    return with_workers(spark.range(0, tasks, 1, tasks)).mapInArrow(_merger([runs], bounds), merged)


def capture_history(pages: DataFrame) -> DataFrame:
    """Pages written to archives, read back and merged into one ordered history."""
    return merge_runs(read_archives(write_archives(pages)))


CAPTURE_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha256(coalesce(html, '')) AS d,
  regexp_replace(regexp_replace(translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '#[\s\S]*$', ''), '^[^:/?#]*://', '') AS bare FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE strlen(payload) >= 100 GROUP BY d HAVING count(*) > 1),
t AS (SELECT p.*, f.first, regexp_extract(bare, '^[^/?]*', 0) AS host FROM p LEFT JOIN f USING (d))
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to,
  array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || substr(bare, length(host) + 1) AS url_key,
  1704067200 + coalesce(((page_id % 1000000000) + 1000000000) % 1000000000, 0) AS captured_at
FROM t
"""
