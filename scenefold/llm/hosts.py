"""URL filters: listed rules, then naive Bayes over segmented host and path tokens.

Concatenated names in hosts are split by the unigram Viterbi of ``lattice``, with
word counts taken from all pages. A multinomial naive Bayes learns block and
allow from the URLs that a rule decides, and judges the others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, stored
from .lattice import best_paths

#: (verdict, host, path prefix); fixed by the contract of the query.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Longest word of the segmentation.
LONGEST = 20
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """From the first :// to /, ?, # or the end, A-Z lower-cased; empty if null or without ://."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, name, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule = F.when(fits, name + prefix).otherwise(rule)
        verdict = F.when(fits, said).otherwise(verdict)
    return rule, verdict


def word_counts(texts: DataFrame) -> DataFrame:
    """(piece, n): counts of the words a-z of at most LONGEST letters in a column ``text``, markup left out."""
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), "<[^>]*>", " ")
    words = texts.select(F.explode(F.split(F.lower(bare), "[^a-z]+")).alias("piece"))
    return words.where((F.col("piece") != "") & (F.length("piece") <= LONGEST)).groupBy("piece").agg(F.count("*").alias("n"))


def segmented(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(word, words): each distinct name of a-z split into its likeliest words.

    A word has the probability of its share of all words; a letter that is no word
    counts as a tenth of one occurrence.
    """
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] + 1
    pieces = counts.select("piece", F.log(F.col("n") / total).alias("score"), F.lit(0).alias("id"))
    paths = best_paths(names, pieces, LONGEST, math.log(0.1 / total))
    return paths.select("word", F.transform("path", lambda p: F.substr(F.col("word"), p["start"], p["l"])).alias("words"))


def url_tokens(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """(url, token): host words as h:word, path tokens as p:token, numbers as p:0."""
    names = urls.select("url", F.explode(F.split("host", "[^a-z]+")).alias("name")).where("name <> ''")
    # A name is cut at a fixed length before the lattice; no host name is longer than that.
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length("name") - 1) / 256).cast("int")), lambda i: F.substr(F.col("name"), i * 256 + 1, F.lit(256)))
    parts = names.select("url", F.explode(cut).alias("word"))
    split = segmented(parts.select("word").distinct(), counts)
    host = parts.join(split, "word").select("url", F.explode("words").alias("token")).select("url", F.concat(F.lit("h:"), "token").alias("token"))
    path = urls.select("url", F.explode(F.split(F.lower("path"), "[^a-z0-9]+")).alias("token")).where("token <> ''")
    shaped = F.when(F.col("token").rlike("^[0-9]+$"), F.lit("0")).otherwise(F.col("token"))
    return host.unionByName(path.select("url", F.concat(F.lit("p:"), shaped).alias("token")))


def bayes(tokens: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """((token, weight), prior): log ratios block : allow from labelled URLs (url, verdict), add-one smoothed."""
    seen = tokens.join(labels, "url").groupBy("token").agg(
        F.count_if(F.col("verdict") == "block").alias("b"), F.count_if(F.col("verdict") == "allow").alias("a")
    )
    sums = seen.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.count("*").alias("v")).first()
    n = labels.agg(F.count_if(F.col("verdict") == "block").alias("b"), F.count_if(F.col("verdict") == "allow").alias("a")).first()
    weight = F.log((F.col("b") + 1) / (sums["b"] + sums["v"] + 1)) - F.log((F.col("a") + 1) / (sums["a"] + sums["v"] + 1))
    return seen.select("token", weight.alias("weight")), math.log((n["b"] + 1) / (n["a"] + 1))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule and verdict.

    Reads ``page_id``, ``url`` and ``html`` only. A null url, or one without
    ``://``, has empty host and path and no rule: the prior decides. URLs are
    judged once each, so repeated rows agree. Tokens never seen with a rule do not
    count; a sum of zero is allowed.
    """
    rows = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"))
    urls = rows.select("url").distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    urls = urls.withColumns({"rule": rule, "listed": verdict})
    counts = stored(word_counts(pages.select(F.col("html").cast("string").alias("text"))), "counts")
    tokens = stored(url_tokens(urls, counts), "tokens")
    weights, prior = bayes(tokens, urls.where("listed is not null").select("url", F.col("listed").alias("verdict")))
    open_tokens = tokens.join(urls.where("listed is null").select("url"), "url", "left_semi")
    # Sorted before adding, so that the sum does not depend on the order of arrival.
    summed = open_tokens.join(weights, "token").groupBy("url").agg(
        F.aggregate(F.array_sort(F.collect_list("weight")), F.lit(prior), lambda x, y: x + y).alias("total")
    )
    said = urls.join(summed, "url", "left").select(
        "url", "host", "path", "rule",
        F.coalesce("listed", F.when(F.coalesce("total", F.lit(prior)) > 0, "block").otherwise("allow")).alias("verdict"),
    )
    return rows.join(said, "url").select("page_id", "host", "path", "rule", "verdict")
