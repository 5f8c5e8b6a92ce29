import io
import random
import zlib

import pytest
from pyspark.sql import functions as F

from scenefold.llm import archives


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree_merges_any_number_of_runs(k):
    rng = random.Random(k)
    runs = [sorted(((rng.randrange(20), i), (i, j)) for j in range(rng.randrange(30))) for i in range(k)]
    got = [key for key, _ in archives.LoserTree(iter(r) for r in runs)]
    assert got == sorted(key for r in runs for key, _ in r)


def test_members_finds_each_gzip_member():
    parts = [b"a" * 10, b"", b"xyz" * 900_000, b"end"]
    packed = []
    for p in parts:
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        packed.append(z.compress(p) + z.flush())
    found = list(archives.members(io.BytesIO(b"".join(packed))))
    assert [c for _, _, c in found] == parts
    assert [n for _, n, _ in found] == [len(p) for p in packed]
    with pytest.raises(ValueError):
        list(archives.members(io.BytesIO(packed[2][:-9])))


PAGES = [
    (5, "http://B.org/x#top", "<p>" + "long " * 40), (2, "http://a.b.org/x?q=1\r\nX: y", "<p>" + "long " * 40), (9, None, "<p>" + "long " * 40),
    (1, "no scheme", "short"), (3, "http://b.org/x", "short"), (4, "http://b.org/é", None), (6, "", ""), (None, "http://n.org/", "<p>" + "long " * 40),
    (2, "http://a.b.org/x", "<p>" + "long " * 40), (7, "http://c.org/", "line\r\n\r\nline " * 20 + "ü"), (8, "http://c.org/", "line\r\n\r\nline " * 20 + "ü"),
    (None, "u", "only nulls " * 20), (None, "u", "only nulls " * 20), (10, "http://d.org/", "x" * 3_000_000),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit("clash"), "first": F.lit(1)})


def test_records_come_back_as_written(spark):
    got = rows_of(archives.capture_history(pages(spark).repartition(3)).select("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest"))
    from hashlib import sha256

    expected = []
    for page, _, html in PAGES:
        payload = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        first = min(same) if len(payload) >= 100 and same and sum((h or "") == (html or "") for _, _, h in PAGES) > 1 else None
        again = first is not None and page != first
        expected.append((page, "revisit" if again else "response", first if again else None, len(payload), sha256(payload).hexdigest()))
    assert got == sorted(expected, key=repr)


def test_rounds_and_ranges_keep_the_whole_order(spark):
    rng = random.Random(3)
    rows = [(i, f"http://h{rng.randrange(4)}.org/{rng.randrange(3)}", f"body {rng.randrange(90)} " * 20) for i in range(900)]
    captures = archives.read_archives(archives.write_archives(pages(spark, rows).repartition(11)))
    merged = archives.merge_runs(captures, fan_in=3, range_rows=100)
    assert merged.rdd.getNumPartitions() > 3
    listed = merged.orderBy("range_no", "row_no").select("url_key", "captured_at", "page_id").collect()
    assert len(listed) == 900 and [r.page_id for r in sorted(listed)] == [r.page_id for r in listed]
    assert {r.page_id for r in listed} == set(range(900))


def test_an_empty_table_gives_no_rows(spark):
    assert archives.capture_history(pages(spark, [])).count() == 0
