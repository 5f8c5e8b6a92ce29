"""Line dedup: drop every line whose normalised form occurs in many documents.

DataFrame functions only. Lines are exploded as two 64-bit hashes of their
normalised form, distinct documents are counted per hash, the positions of
frequent lines come back by an equi-join and each text is put together again
from the runs between dropped positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import WHITE, ascii_lower

_IN = "_llm_"


def line_key(line: Column) -> Column:
    """A line without ASCII white space at its ends and with A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def _hashes(lines: Column) -> Column:
    """Per line (h1, h2), a 128-bit fingerprint of its key; null for an empty key."""

    # Two steps, so that the key is computed once: lambdas share no subexpressions.
    # xxhash64 goes on from the hash of its first argument: the key comes last in h2, so
    # that keys of one h1 do not agree in h2 as well.
    keys = F.transform(lines, line_key)
    return F.transform(
        keys,
        lambda key: F.when(key != "", F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"))),
    )


def _runs(lines: Column, dropped: Column) -> Column:
    """The lines outside the sorted positions ``dropped``, as slices between them."""
    fences = F.concat(F.array(F.lit(-1)), dropped, F.array(F.size(lines)))
    pieces = F.transform(
        F.sequence(F.lit(1), F.size(fences) - 1),
        lambda i: F.slice(
            lines, F.element_at(fences, i) + 2, F.element_at(fences, i + 1) - F.element_at(fences, i) - 1
        ),
    )
    return F.flatten(pieces)


def dedup_lines(docs: DataFrame, min_docs: int = 10, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the lines found in at least ``min_docs`` documents.

    All columns stay; ``text`` is replaced, ``n_lines`` (before) and ``n_dropped``
    are added, columns of these two names are replaced. A null or empty text is
    one empty line and becomes an empty text. Lines without a visible character
    are never dropped. Documents are counted by ``doc_id``: repeated rows count
    once, all null ids together count as one document.
    """
    keep = [c for c in docs.columns if c not in (text, "n_lines", "n_dropped")]
    order = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    split = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    # A row is known by its id and a hash of its text: rows equal in both fare alike.
    row = [F.col(doc_id).alias(_IN + "id"), F.xxhash64(F.col(text)).alias(_IN + "text")]
    hashed = docs.select(*row, _hashes(split).alias("h"))

    seen = hashed.select(_IN + "id", F.explode(F.array_distinct("h")).alias("h")).where("h is not null")
    frequent = (
        seen.select(_IN + "id", "h.h1", "h.h2").distinct()
        .groupBy("h1", "h2").count().where(F.col("count") >= min_docs).select("h1", "h2")
    )
    spots = hashed.select(_IN + "id", _IN + "text", F.posexplode("h").alias("pos", "h")).where("h is not null")
    dropped = (
        spots.select(_IN + "id", _IN + "text", "pos", "h.h1", "h.h2")
        .join(frequent, ["h1", "h2"])
        .groupBy(_IN + "id", _IN + "text").agg(F.sort_array(F.collect_set("pos")).alias(_IN + "dropped"))
        .withColumnsRenamed({_IN + "id": _IN + "id2", _IN + "text": _IN + "text2"})
    )
    joined = docs.select(*[F.col(c) for c in keep], F.col(text), F.xxhash64(F.col(text)).alias(_IN + "text")).join(
        dropped,
        F.col(doc_id).eqNullSafe(F.col(_IN + "id2")) & (F.col(_IN + "text") == F.col(_IN + "text2")),
        "left",
    )
    whole = F.coalesce(F.col(text), F.lit(""))
    lines, out = F.split(whole, "\n", -1), F.col(_IN + "dropped")
    return joined.select(
        *[
            F.when(out.isNull(), whole).otherwise(F.array_join(_runs(lines, out), "\n")).alias(text) if c == text else F.col(c)
            for c in order
        ],
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size(out), F.lit(0)).cast("long").alias("n_dropped"),
    )


def line_report(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """Per document: lines, dropped lines and the digest of what is kept."""
    kept = dedup_lines(docs.select("doc_id", "text"), min_docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


LINE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
frequent AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT rid, doc_id, pos, line, k IN (SELECT k FROM frequent) AS gone FROM keyed)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid
"""
