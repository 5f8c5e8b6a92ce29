"""Secret scan: broad candidates, false positives removed by a random forest.

DataFrame functions and the JVM's random forest only. A candidate is a long run of
key characters in a text. Its features are length, the transitions between
character classes, how much of it dictionary words cover, where it stands (path
marks, quotes, assignment) and its neighbouring words. The forest is trained on
labelled findings, a bounded sample of the table's own candidates.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import FeatureHasher
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

#: Shortest candidate, and characters of text looked at on either side.
MIN_LENGTH, AROUND = 16, 48
#: Findings of each label that train the forest; a documented bound.
TRAIN_ROWS = 5_000
TREES, DEPTH, HASHED = 24, 6, 128
#: A dictionary word has at least this many letters and occurs in at least so many documents.
WORD_LETTERS, WORD_DOCS, LONGEST_WORD = 3, 20, 12
#: Parts of a long candidate whose coverage is taken one by one.
PART = 128

_KEY = r"A-Za-z0-9+/_\-"
_BEGIN = rf"(?<![\p{{L}}\p{{N}}+/_\-])(?=[{_KEY}]{{{MIN_LENGTH},}})"

#: How findings are labelled when the table has no label of its own: an assignment to
#: a name that says key, with a value of mixed classes, is a secret.
_ASSIGNED = r"(?i)(token|secret|passw(or)?d|pwd|api[_-]?key|private[_-]?key|access[_-]?key|credential|auth)[\"']?\s*[:=]\s*[\"']?$"


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, place, candidate, before, after) of each long run of key characters, in text order.

    ``place`` counts from 1 within a text. ``before`` and ``after`` are at most
    AROUND characters. A run that goes on with another letter is part of a word
    and is left out.
    """
    parts = docs.where("text is not null").select("doc_id", F.split("text", _BEGIN).alias("parts"))
    # A part after the first begins with a candidate; so may the first.
    listed = parts.select(
        "doc_id",
        F.filter(
            F.transform(
                "parts",
                lambda x, i: F.struct(
                    F.regexp_extract(x, rf"^[{_KEY}]{{{MIN_LENGTH},}}", 0).alias("candidate"),
                    F.right(F.coalesce(F.get(F.col("parts"), i - 1), F.lit("")), F.lit(AROUND)).alias("before"), x.alias("part"),
                ),
            ),
            lambda s: s["candidate"] != "",
        ).alias("found"),
    )
    rows = listed.select("doc_id", F.posexplode("found").alias("place", "x"))
    after = F.substr("x.part", F.length("x.candidate") + 1, F.lit(AROUND))
    return rows.select("doc_id", (F.col("place") + 1).alias("place"), "x.candidate", "x.before", after.alias("after")).where(~F.col("after").rlike(r"^[\p{L}\p{N}]"))


def dictionary(docs: DataFrame) -> DataFrame:
    """The lower-case words a-z of the texts that many documents hold."""
    words = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+"))
    spread = docs.select(F.explode(words).alias("word"))
    sized = spread.where(F.length("word").between(WORD_LETTERS, LONGEST_WORD))
    return sized.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= WORD_DOCS).select("word")


def coverage(found: DataFrame, words: DataFrame) -> DataFrame:
    """(candidate, covered): the share of characters inside a dictionary word.

    Substrings are joined with the dictionary by equality; long candidates are
    taken in parts of PART characters, so that no row lists more than a part's.
    """
    low = F.lower("candidate")
    starts = F.sequence(F.lit(0), F.floor((F.length("candidate") - 1) / PART).cast("int"))
    parts = found.select("candidate").distinct().select("candidate", F.explode(F.transform(starts, lambda i: F.struct(i.alias("i"), F.substr(low, i * PART + 1, F.lit(PART)).alias("part")))).alias("p"))
    width = LONGEST_WORD - WORD_LETTERS + 1
    spread = parts.select("candidate", "p.i", "p.part", F.explode(F.sequence(F.lit(0), F.length("p.part") * width - 1)).alias("k"))
    shaped = spread.select("candidate", "i", "part", F.expr(f"cast(k div {width} as int)").alias("b"), (F.col("k") % width + WORD_LETTERS).alias("l")).where("b + l <= length(part)")
    hit = shaped.select("candidate", "i", "b", "l", F.substr("part", F.col("b") + 1, F.col("l")).alias("word")).join(words, "word")
    spots = hit.select("candidate", "i", F.explode(F.sequence(F.col("b"), F.col("b") + F.col("l") - 1)).alias("spot")).distinct()
    return spots.groupBy("candidate").agg(F.count("*").alias("n")).select("candidate", (F.col("n") / F.length("candidate")).alias("covered"))


def _last_word(text: Column) -> Column:
    return F.lower(F.regexp_extract(text, r"(\p{L}+)[^\p{L}]*$", 1))


def _first_word(text: Column) -> Column:
    return F.lower(F.regexp_extract(text, r"^[^\p{L}]*(\p{L}+)", 1))


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with the forest's features in numbers, and a hashed vector of all of them."""
    c = F.col("candidate")
    classes = F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", "A" * 26 + "a" * 26 + "0" * 10 + "-" * 4)
    runs = F.length(F.regexp_replace(classes, r"(.)\1+", "$1"))
    n = F.length(c)
    share = lambda pattern: F.length(F.regexp_replace(c, pattern, "")) / n
    rows = found.join(coverage(found, words), "candidate", "left").select(
        *found.columns,
        F.log(n).alias("length"), ((runs - 1) / n).alias("transitions"),
        F.size(F.array_distinct(F.split(c, ""))).cast("double").alias("kinds"),
        share("[^0-9]").alias("digits"), share("[^A-Z]").alias("capitals"), share("[^0-9A-Fa-f]").alias("hex_share"),
        F.length(F.regexp_extract(c, "([bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ]+)", 1)).cast("double").alias("consonants"),
        F.coalesce("covered", F.lit(0.0)).alias("covered"),
        (F.col("before").rlike("[/.\\\\~]$") | c.contains("/")).cast("double").alias("path"),
        F.col("before").rlike("[\"']$").cast("double").alias("quoted"), F.col("before").rlike("[:=]\\s*[\"']?$").cast("double").alias("assigned"),
        F.col("before").rlike("://\\S*$|@\\S*$").cast("double").alias("address"),
        _last_word(F.col("before")).alias("previous_word"), _first_word(F.col("after")).alias("next_word"),
    )
    names = [x for x in rows.columns if x not in found.columns]
    hasher = FeatureHasher(inputCols=names, outputCol="features", numFeatures=HASHED, categoricalCols=["previous_word", "next_word"])
    return hasher.transform(rows)


def label(found: DataFrame) -> DataFrame:
    """``found`` with ``label`` 1.0 for findings that are secrets by their assignment and 0.0 for others."""
    said = F.col("before").rlike(_ASSIGNED) & F.col("candidate").rlike("[0-9]") & F.col("candidate").rlike("[A-Za-z]")
    return found.withColumn("label", said.cast("double"))


def train(labelled: DataFrame, rows: int = TRAIN_ROWS):
    """A forest from at most ``rows`` findings of each label, chosen by a hash; None if a label is missing."""
    order = F.xxhash64("candidate", "before", "after")
    some = [labelled.where(F.col("label") == y).select("features", "label", "candidate", "before", "after").orderBy(order).limit(rows) for y in (0.0, 1.0)]
    sample = stored(some[0].unionByName(some[1]).select("features", "label"), "labelled")
    if sample.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=11, featuresCol="features", labelCol="label").fit(sample)


def scan(docs: DataFrame, train_on: Column | None = None) -> DataFrame:
    """(doc_id, place, length, candidate, probability, is_secret) of every candidate of ``docs``.

    Reads ``doc_id`` and ``text`` only; null and empty texts have no candidates,
    repeated rows are found again. Findings in rows where ``train_on`` holds are
    labelled and train the forest (all rows by default). If all of them have one
    label there is nothing to learn: every candidate gets that label.
    """
    rows = docs.select("doc_id", "text")
    found = stored(candidates(rows), "candidates")
    described = stored(label(features(found, stored(dictionary(rows), "dictionary"))), "features")
    model = train(described if train_on is None else described.where(train_on))
    if model is None:
        one = described.agg(F.coalesce(F.max("label"), F.lit(0.0)).alias("y")).first()["y"]
        scored = described.withColumn("probability", F.lit(one))
    else:
        drop = [c for c in ("rawPrediction", "prediction")]
        scored = model.transform(described).drop(*drop).withColumn("probability", F.element_at(vector_to_array("probability"), 2))
    return scored.select("doc_id", "place", F.length("candidate").alias("length"), "candidate", F.round("probability", 6).alias("probability"), (F.col("probability") >= 0.5).alias("is_secret"), "label")


def secret_report(docs: DataFrame) -> DataFrame:
    """Every candidate with its digest, probability and verdict; a quarter of the documents trains nothing."""
    held_in = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 != 2, F.lit(False))
    return scan(docs, held_in).select("doc_id", "place", "length", F.sha2("candidate", 256).alias("candidate_sha256"), "probability", "is_secret")
