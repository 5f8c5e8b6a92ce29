"""Toxicity by a convolutional text classifier, trained in numpy.

A word's embedding is the sum of hashed rows: of the word itself and of its first and
last characters, so that unseen forms of a seen stem are known. Filters of several
widths slide over the words; a filter's responses are max-pooled over regions of
REGION words, and the HELD largest regions of the whole text, however long, feed a
logistic layer. A word that stands once by chance and words that stand again and
again therefore differ.

The model is fitted on a bounded sample of labelled documents. Its scores are made
probabilities on a part of the sample it was not fitted on. A threshold is chosen for
each language on all labelled documents of that part, not on a sample of them.

Scoring is one pass over the texts without a shuffle and looks at the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import slices, stored, with_workers
from .languages import is_held_out
from .words import STEP, mixed

#: The fitted sample: documents of each label, and the longest text among them in characters.
TRAIN_DOCS, TRAIN_CHARS = 3000, 20_000
BUCKETS, WIDE = 1 << 18, 8
WIDTHS, FILTERS = (1, 2, 3), 8
REGION, HELD = 8, 4
EPOCHS, RATE = 4, 0.01
#: An embedding's first column starts as evidence of its label divided by this, within 3.
EVIDENCE = 8.0
#: Rows of both labels that a language needs for a threshold of its own.
OWN_THRESHOLD = 25
#: Scores are counted in so many slots where all rows choose the thresholds.
SLOTS = 10_000
#: Words are scored in blocks of about so many.
BLOCK = 200_000
_WORDS = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def text_words(text: str) -> list[str]:
    """Runs of letters, marks and digits, lower-cased."""
    return _WORDS.findall(text.lower())


def buckets_of(words: list[str]) -> np.ndarray:
    """Embedding rows of each word: itself, its first 2 to 7 and its last 3 and 4 characters."""
    out = np.zeros((len(words), 9), dtype=np.int32)
    if not words:
        return out
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    # A word of any length; 32 characters tell its two ends, and its hash the whole.
    tops = np.array([w[:7] for w in words], dtype="U7").view(np.uint32).reshape(len(words), 7).astype(np.uint64)
    tails = np.array([w[-4:][::-1] for w in words], dtype="U4").view(np.uint32).reshape(len(words), 4).astype(np.uint64)
    whole = pd.util.hash_array(np.array(words, dtype=object), categorize=False).astype(np.uint64)
    out[:, 0] = _bucket(whole, 0)
    folded = np.zeros(len(words), dtype=np.uint64)
    for k in range(7):
        folded = mixed(folded * STEP + tops[:, k])
        if k:
            out[:, k] = np.where(lengths > k, _bucket(folded, k), out[:, 0])
    folded = np.zeros(len(words), dtype=np.uint64)
    for k in range(4):
        folded = mixed(folded * STEP + tails[:, k])
        if k > 1:
            out[:, 5 + k] = np.where(lengths > k, _bucket(folded, 5 + k), out[:, 0])
    return out


def _bucket(hashes: np.ndarray, kind: int) -> np.ndarray:
    return (mixed(hashes + np.uint64(kind)) % np.uint64(BUCKETS)).astype(np.int32)


@dataclass
class Network:
    """Embeddings, filters and the logistic layer; ``slope`` and ``shift`` make its output a probability."""

    table: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5
    thresholds: dict[str, float] = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int = 7) -> Network:
        random = np.random.default_rng(seed)
        table = random.normal(0, 0.02, (BUCKETS, WIDE)).astype(np.float32)
        filters = [random.normal(0, 0.2, (w * WIDE, FILTERS)).astype(np.float32) for w in WIDTHS]
        weights = np.zeros((HELD, len(WIDTHS) * FILTERS), dtype=np.float32)
        weights[:] = random.normal(0, 0.1, weights.shape[1])
        return Network(table, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], weights, 0.0)

    def learn_evidence(self, texts: list[np.ndarray], buckets: np.ndarray, labels: np.ndarray) -> None:
        """Start the first column at the signed root of each row's log-likelihood ratio with the label."""
        seen = np.zeros((2, BUCKETS))
        for words, label in zip(texts, labels.astype(int).tolist(), strict=True):
            seen[label, np.unique(buckets[np.unique(words)])] += 1
        total = np.array([np.sum(labels == 0), np.sum(labels == 1)], dtype=np.float64)
        share, both = total / total.sum(), seen.sum(axis=0)
        ratio = np.zeros(BUCKETS)
        for y in (0, 1):
            for part, whole in ((seen[y], both), (total[y] - seen[y], total.sum() - both)):
                ratio += 2 * part * np.log(np.maximum(part, 1e-9) / np.maximum(whole * share[y], 1e-9))
        sign = np.where(seen[1] * total[0] > seen[0] * total[1], 1, -1)
        self.table[:, 0] = np.clip(sign * np.sqrt(np.maximum(ratio, 0)) / EVIDENCE, -3, 3)

    def responses(self, x: np.ndarray, left: np.ndarray) -> Iterator[np.ndarray]:
        """Each width's filters at each word; ``left`` words of the text begin there, what is beyond counts as zero."""
        for width, kernel, bias in zip(WIDTHS, self.filters, self.biases, strict=True):
            out = x @ kernel[:WIDE]
            for k in range(1, width):
                moved = x[k:] @ kernel[k * WIDE : (k + 1) * WIDE]
                moved[left[: len(moved)] <= k] = 0
                out[: len(moved)] += moved
            yield np.maximum(out + bias, 0)


def _regions(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each region, regions of each text, words left in the text from each word on)."""
    counts = -(-sizes // REGION)
    text = np.repeat(np.arange(len(sizes)), counts)
    place = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    begins = (np.cumsum(sizes) - sizes)[text] + place * REGION
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(int(sizes.sum()))
    return begins, counts, left


def _largest(pooled: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The HELD largest rows of each text for each column, largest first: values (0 if there are no more) and row numbers (-1)."""
    left = pooled.copy()
    head = np.cumsum(counts) - counts
    text = np.repeat(np.arange(len(counts)), counts)
    rows = np.arange(len(pooled))[:, None]
    for _ in range(HELD):
        best = np.maximum.reduceat(left, head, axis=0)
        at = np.where(left == best[text], rows, len(pooled))
        first = np.minimum.reduceat(at, head, axis=0)
        real = best >= 0
        yield np.where(real, best, 0), np.where(real, first, -1)
        left[first, np.arange(left.shape[1])[None, :]] = -1


def _forward(net: Network, x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list]:
    """Held values (texts, HELD, filters) and, for training, the words they come from."""
    begins, counts, left = _regions(sizes)
    wide = np.concatenate(list(net.responses(x, left)), axis=1)
    pooled = np.maximum.reduceat(wide, begins, axis=0)
    kept = list(_largest(pooled, counts))
    return np.stack([v for v, _ in kept], axis=1), [wide, pooled, begins, left, np.stack([r for _, r in kept], axis=1)]


def _train(net: Network, texts: list[np.ndarray], buckets: np.ndarray, labels: np.ndarray, seed: int = 7) -> None:
    """Adam over small batches of texts of one or more words; ``texts`` are rows of ``buckets``."""
    random = np.random.default_rng(seed)
    parts = [net.table, *net.filters, *net.biases, net.weights]
    first = [np.zeros_like(p) for p in parts]
    second = [np.zeros_like(p) for p in parts]
    bias = np.zeros(2)
    step = 0
    for epoch in range(EPOCHS):
        order = random.permutation(len(texts))
        rate = RATE * (1 - epoch / EPOCHS)
        for begin in range(0, len(order), 48):
            some = order[begin : begin + 48]
            sizes = np.array([len(texts[i]) for i in some])
            flat = np.concatenate([texts[i] for i in some])
            used, inverse = np.unique(flat, return_inverse=True)
            rows = buckets[used]
            x = net.table[rows].sum(axis=1)[inverse]
            held, (wide, pooled, begins, left, regions) = _forward(net, x, sizes)
            score = np.einsum("thf,hf->t", held, net.weights) + net.bias
            error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels[some]) / len(some)
            grads = [np.zeros_like(p) for p in parts]
            grads[-1] = np.einsum("t,thf->hf", error, held) + 1e-4 * net.weights
            # Only the words whose responses are held pass anything back.
            flow = error[:, None, None] * net.weights[None] * (held > 0)
            t, _, f = np.nonzero(flow)
            gain, region = flow[np.nonzero(flow)], regions[np.nonzero(flow)]
            stop = np.minimum(begins[region] + REGION, (np.cumsum(sizes))[t])
            word = begins[region].copy()
            for k in range(REGION - 1, -1, -1):
                at = begins[region] + k
                there = at < stop
                hit = there & (wide[np.minimum(at, len(wide) - 1), f] == pooled[region, f])
                word = np.where(hit, at, word)
            back = np.zeros_like(x)
            for i, width in enumerate(WIDTHS):
                mine = (f // FILTERS) == i
                own, g, column = word[mine], gain[mine], f[mine] % FILTERS
                grads[1 + len(WIDTHS) + i] += np.bincount(column, g, FILTERS).astype(np.float32)
                for k in range(width):
                    on = left[own] > k
                    place, col, value = own[on] + k, column[on], g[on].astype(np.float32)
                    kernel = net.filters[i][k * WIDE : (k + 1) * WIDE]
                    np.add.at(back, place, value[:, None] * kernel[:, col].T)
                    np.add.at(grads[1 + i].T, (col[:, None], np.arange(k * WIDE, (k + 1) * WIDE)[None, :]), value[:, None] * x[place])
            touched = np.flatnonzero(np.any(back != 0, axis=1))
            words, where = np.unique(inverse[touched], return_inverse=True)
            summed = np.zeros((len(words), WIDE), np.float32)
            np.add.at(summed, where, back[touched])
            slots, at = np.unique(rows[words], return_inverse=True)
            moved = np.zeros((len(slots), WIDE), np.float32)
            np.add.at(moved, at.reshape(-1), np.repeat(summed, rows.shape[1], axis=0))
            step += 1
            scale = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            # Embeddings move where they were used only.
            m, v = first[0], second[0]
            m[slots] = 0.9 * m[slots] + 0.1 * moved
            v[slots] = 0.999 * v[slots] + 0.001 * moved**2
            net.table[slots] -= scale * m[slots] / (np.sqrt(v[slots]) + 1e-8)
            for p, g, m, v in zip(parts[1:], grads[1:], first[1:], second[1:], strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g**2
                p -= scale * m / (np.sqrt(v) + 1e-8)
            total = float(error.sum())
            bias[0] = 0.9 * bias[0] + 0.1 * total
            bias[1] = 0.999 * bias[1] + 0.001 * total**2
            net.bias -= scale * bias[0] / (np.sqrt(bias[1]) + 1e-8)


def raw_scores(net: Network, listed: list[list[str]]) -> np.ndarray:
    """The logistic layer's input for each list of words; the bias alone for an empty one."""
    sizes = np.fromiter(map(len, listed), np.int64, len(listed))
    out = np.full(len(listed), net.bias, dtype=np.float64)
    if not sizes.sum():
        return out
    flat = np.empty(int(sizes.sum()), dtype=object)
    flat[:] = [w for words in listed for w in words]
    codes, distinct = pd.factorize(flat)
    buckets = buckets_of(list(distinct))
    vectors = np.zeros((len(distinct), WIDE), dtype=np.float32)
    for k in range(buckets.shape[1]):
        vectors += net.table[buckets[:, k]]
    begins, counts, left = _regions(sizes)
    pooled = np.empty((len(begins), net.weights.shape[1]), dtype=np.float32)
    overlap = max(WIDTHS) - 1
    for one in range(0, len(begins), BLOCK // REGION):
        some = begins[one : one + BLOCK // REGION]
        low = some[0]
        stop = begins[one + len(some)] if one + len(some) < len(begins) else len(codes)
        high = min(stop + overlap, len(codes))
        x = vectors[codes[low:high]]
        wide = np.concatenate([r[: stop - low] for r in net.responses(x, left[low:high])], axis=1)
        pooled[one : one + len(some)] = np.maximum.reduceat(wide, some - low, axis=0)
    full = np.flatnonzero(sizes)
    total = np.zeros(len(full))
    for (value, _), weight in zip(_largest(pooled, counts[full]), net.weights, strict=True):
        total += value.astype(np.float64) @ weight
    out[full] += total
    return out


def probabilities(net: Network, raw: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(net.slope * raw + net.shift, -30, 30)))


def _calibrate(net: Network, raw: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
    """Logistic regression of the label on the raw score by Newton steps; a small prior keeps it finite."""
    scale = raw.std() or 1.0
    x = np.stack([(raw - raw.mean()) / scale, np.ones_like(raw)], axis=1)
    theta = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (weights * (p - labels)) + 0.05 * theta
        hessian = (x * (weights * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2)
        theta -= np.linalg.solve(hessian, gradient)
    if theta[0] > 0:
        net.slope = float(theta[0] / scale)
        net.shift = float(theta[1] - theta[0] * raw.mean() / scale)


def _best_threshold(slots: pd.DataFrame) -> float:
    """The middle between the two neighbouring slots that give the largest F1 above it.

    A slot of scores has ``low`` and ``high``, and the weights of its rows (``n``) and of those of label 1 (``hits``).
    """
    slots = slots.sort_values("low", ascending=False)
    hits, taken = slots["hits"].cumsum().to_numpy(), slots["n"].cumsum().to_numpy()
    at = int(np.argmax(2 * hits / (taken + hits[-1])))
    below = slots["high"].iloc[at + 1] if at + 1 < len(slots) else 0.0
    return float((slots["low"].iloc[at] + below) / 2)


def _choose_thresholds(net: Network, slots: pd.DataFrame) -> None:
    """The common threshold and those of the languages; ``slots`` has a row per ``lang`` and ``slot``, and counts rows of label 1 in ``ones`` and all in ``rows``."""
    merge = {"low": "min", "high": "max", "hits": "sum", "n": "sum"}
    net.threshold, net.thresholds = _best_threshold(slots.groupby("slot").agg(merge)), {}
    for lang, own in slots.groupby("lang"):
        if lang and min(own["ones"].sum(), (own["rows"] - own["ones"]).sum()) >= OWN_THRESHOLD:
            net.thresholds[lang] = _best_threshold(own)


def fit_thresholds(net: Network, rows: DataFrame) -> None:
    """Choose the thresholds on all ``rows`` of (text, lang, y); equal rows count once.

    The rows are scored and counted by slots of the score in Spark; at most SLOTS + 1
    counts of each language come to the driver.
    """
    scored = predict(rows, net).select(F.sha2("text", 256).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"), "y", "score").distinct()
    counted = scored.groupBy("lang", F.floor(F.col("score") * SLOTS).alias("slot")).agg(
        F.min("score").alias("low"), F.max("score").alias("high"), F.sum("y").alias("ones"), F.count(F.lit(1)).alias("rows")).toPandas()
    if len(counted):
        _choose_thresholds(net, counted.assign(hits=counted["ones"], n=counted["rows"]))


def fit(sample: list[tuple[str, str | None, int, bool]], shares: tuple[float, float] = (1.0, 1.0)) -> Network | None:
    """Fit on (text, language, label, calibrates) rows; None without both labels.

    ``shares`` are the parts of the table's rows of label 0 and 1 that the sample holds;
    calibration weighs the labels by them. Rows that calibrate are not fitted on, unless
    there are too few of them.
    """
    rows = sorted({(text, lang or "", label, part) for text, lang, label, part in sample if text_words(text)})
    labels = np.array([r[2] for r in rows], dtype=np.float64)
    if not len(rows) or labels.min() == labels.max():
        return None
    part = np.array([r[3] for r in rows])
    if min(np.sum(part & (labels == y)) for y in (0, 1)) < 10 or min(np.sum(~part & (labels == y)) for y in (0, 1)) < 10:
        fitted, held = np.arange(len(rows)), np.arange(len(rows))
    else:
        fitted, held = np.flatnonzero(~part), np.flatnonzero(part)
    listed = [text_words(r[0]) for r in rows]
    flat = np.empty(sum(map(len, listed)), dtype=object)
    flat[:] = [w for words in listed for w in words]
    codes, distinct = pd.factorize(flat)
    ends = np.cumsum([len(x) for x in listed])
    texts = np.split(codes, ends[:-1])
    net = Network.fresh()
    net.bias = float(np.log((labels[fitted].mean() + 1e-3) / (1 - labels[fitted].mean() + 1e-3)))
    buckets = buckets_of(list(distinct))
    net.learn_evidence([texts[i] for i in fitted], buckets, labels[fitted])
    _train(net, [texts[i] for i in fitted], buckets, labels[fitted])
    raw = raw_scores(net, [listed[i] for i in held])
    weights = 1 / np.where(labels[held] == 1, shares[1], shares[0])
    weights *= len(held) / weights.sum()
    _calibrate(net, raw, labels[held], weights)
    scores = probabilities(net, raw)
    langs = [rows[i][1] for i in held]
    seen = pd.DataFrame({"lang": langs, "slot": scores, "low": scores, "high": scores, "hits": weights * labels[held], "n": weights, "ones": labels[held], "rows": 1})
    _choose_thresholds(net, seen.groupby(["lang", "slot"], as_index=False).agg({"low": "min", "high": "max", "hits": "sum", "n": "sum", "ones": "sum", "rows": "sum"}))
    return net


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Network | None:
    """Fit on about ``train_docs`` documents of each label, chosen by a hash of their id.

    Read are rows with a text of at most TRAIN_CHARS characters, an id that is not held
    out, and one label (ids that are labelled both ways are left out; repeated labels
    count once). Twice ``train_docs`` of a label is the most that the driver receives.
    The thresholds are then chosen on all such rows that calibrate, with texts of any length.
    """
    own = labels.select(F.col("doc_id").cast("string").alias("id"), F.col("toxic").cast("int").alias("y"))
    own = own.where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~is_held_out(F.col("id")))
    single = own.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where(F.col("y") == F.col("z")).select("id", "y")
    texts = docs.select(F.col("doc_id").cast("string").alias("id"), "text", F.col("lang").cast("string").alias("lang"))
    whole = texts.where(F.col("id").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("id")))
    texts = whole.where(F.length("text") <= TRAIN_CHARS)
    part = F.crc32("id") % 4 == 3
    known = stored(texts.select("id").join(single, "id").distinct(), "labelled")
    found = known.groupBy("y").agg(F.count("*").alias("n"), F.count_if(part).alias("part")).collect()
    counts = {r["y"]: r["n"] for r in found}
    if len(counts) < 2:
        return None
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 40)).cast("double") / float(1 << 40)
    share = {y: min(1.0, 1.2 * train_docs / n) for y, n in counts.items()}
    chosen = known.where(place < F.when(F.col("y") == 1, F.lit(share[1])).otherwise(F.lit(share[0])))
    # A share of the ids: 1.2 train_docs of each label, within a few standard deviations; the limit holds in any case.
    chosen = chosen.limit(4 * train_docs)
    rows = texts.join(F.broadcast(chosen), "id").select("text", "lang", "y", part.alias("part")).distinct()
    net = fit([(r["text"], r["lang"], r["y"], r["part"]) for r in rows.collect()], (share[0], share[1]))
    if net is not None:
        apart = min(min(r["part"], r["n"] - r["part"]) for r in found) >= 10
        fit_thresholds(net, (whole.where(part) if apart else whole).join(single, "id").select("text", "lang", "y"))
    return net


def _predict(net: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                if net is None:
                    scores = np.zeros(part.num_rows)
                else:
                    listed = [text_words(t) if t is not None else [] for t in part.column("text").to_pylist()]
                    scores = probabilities(net, raw_scores(net, listed))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], [*part.schema.names, "score"])

    return run


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """``docs`` with ``score``, the probability that the text is toxic (a column of this name is replaced).

    Only ``text`` is looked at. A null or empty text, or one without words, has the
    score of an empty one; all scores are 0 if nothing could be learned.
    """
    rows = with_workers(docs.drop("score"))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_predict(net), f"{shape}, score double")


def flag(docs: DataFrame, net: Network | None) -> DataFrame:
    """``docs`` with ``score``, ``threshold`` (of the row's ``lang``, else the common one) and ``toxic``."""
    scored = predict(docs.drop("threshold", "toxic"), net)
    common = F.lit(net.threshold if net else 1.0)
    known = [x for lang, t in (net.thresholds if net else {}).items() for x in (F.lit(lang), F.lit(t))]
    own = F.coalesce(F.create_map(*known)[F.col("lang")], common) if known else common
    return scored.withColumn("threshold", own).withColumn("toxic", F.col("score") >= F.col("threshold"))


def toxicity_report(docs: DataFrame, labels: DataFrame, limit: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 from ``limit`` on), and the language's own threshold and verdict."""
    net = train(docs.select("doc_id", "text", "lang"), labels)
    found = flag(docs.select("doc_id", "text", "lang"), net)
    predicted = (F.col("score") >= F.lit(limit)).cast("int")
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"), "threshold", F.col("toxic").alias("flagged"))
