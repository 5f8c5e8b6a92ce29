"""Language identification by a linear-chain conditional random field.

Words are labelled, not documents, so code-switched text is followed from word to
word. A word's features are its affixes, character n-grams, itself and the
languages in whose lexicon it is; transitions between languages are learned.
Forward-backward gives each word's posterior; a document's language is the one
with the largest mean posterior, which is its score.

The model is fitted on a bounded sample of labelled documents. Prediction is one
pass over the texts without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F, Window
from xxhash import xxh64_intdigest

from .common import slices, stored, with_workers
from .words import STEP, mixed

#: Words of one chain; a longer text is several chains.
CHAIN = 64
#: The fitted sample: documents of each language, and chains of each document.
TRAIN_DOCS, TRAIN_CHAINS = 300, 6
#: Frequent words of each language that make its lexicon.
LEXICON = 500
BUCKETS = 1 << 15
EPOCHS, RATE, DECAY = 4, 0.3, 1e-6
_LETTERS = regex.compile(r"\p{L}+")


def letter_words(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    return _LETTERS.findall(text.lower())


def _grams(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, feature ids) of affixes, n-grams and whole words, by word length."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    width = 1 << np.maximum(3, np.ceil(np.log2(np.maximum(lengths, 1))).astype(int))
    for wide in np.unique(width):
        rows = np.flatnonzero(width == wide)
        size = lengths[rows]
        points = np.array([words[i] for i in rows], dtype=f"U{wide}").view(np.uint32).reshape(len(rows), wide).astype(np.uint64)
        # Marked by a start and an end sign, so that an n-gram at an end is an affix of its own.
        marked = np.zeros((len(rows), wide + 2), dtype=np.uint64)
        marked[:, 1:-1] = points
        marked[:, 0] = 1
        marked[np.arange(len(rows)), size + 1] = 2
        whole = np.zeros(len(rows), dtype=np.uint64)
        for k in range(int(size.max(initial=0))):
            whole = np.where(k < size, mixed(whole * STEP + points[:, k]), whole)
        yield rows, _bucket(whole, 0)
        folded = marked
        for n in (2, 3, 4):
            folded = mixed(folded[:, :-1] * STEP + marked[:, n - 1 :])
            at, start = np.nonzero(np.arange(folded.shape[1])[None, :] <= (size + 2 - n)[:, None])
            yield rows[at], _bucket(folded[at, start], n)


def _bucket(hashes: np.ndarray, kind: int) -> np.ndarray:
    return (mixed(hashes + np.uint64(kind)) % np.uint64(BUCKETS)).astype(np.int64)


@dataclass
class Field:
    """A fitted chain: languages, feature weights, lexicon, transitions, first labels."""

    languages: list[str]
    weights: np.ndarray
    lexicon: dict[str, np.ndarray]
    known: np.ndarray
    switch: np.ndarray
    first: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """Score of each distinct word in each language."""
        out = np.zeros((len(words), len(self.languages)), dtype=np.float64)
        for rows, features in _grams(words):
            order = np.argsort(rows, kind="stable")
            rows, scores = rows[order], self.weights[features[order]]
            heads = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else rows
            if len(heads):
                out[rows[heads]] += np.add.reduceat(scores, heads, axis=0)
        for i, word in enumerate(words):
            if word in self.lexicon:
                out[i] += self.lexicon[word] * self.known
        return out

    def posteriors(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Forward-backward over chains packed as (chains, CHAIN, languages), all in step."""
        gain = np.exp(scores - scores.max(axis=2, keepdims=True))
        move, first = np.exp(self.switch - self.switch.max()), np.exp(self.first - self.first.max())
        n, longest, _ = gain.shape
        forward, backward = np.empty_like(gain), np.ones_like(gain)
        now = first * gain[:, 0]
        forward[:, 0] = now / now.sum(axis=1, keepdims=True)
        for t in range(1, longest):
            now = (forward[:, t - 1] @ move) * gain[:, t]
            forward[:, t] = now / now.sum(axis=1, keepdims=True)
        for t in range(longest - 2, -1, -1):
            now = (backward[:, t + 1] * gain[:, t + 1]) @ move.T
            now /= now.sum(axis=1, keepdims=True)
            backward[:, t] = np.where((t + 1 < lengths)[:, None], now, 1.0)
        both = forward * backward
        return both / both.sum(axis=2, keepdims=True)


def _pack(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows of a flat array as (chains, longest, ...), padded with the chain's first row."""
    longest = int(lengths.max(initial=1))
    step = np.arange(longest)[None, :]
    return values[starts[:, None] + np.where(step < lengths[:, None], step, 0)]


def _chains(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the chains of consecutive texts of so many words each."""
    ends = np.cumsum(sizes)
    counts = -(-sizes // CHAIN)
    text = np.repeat(np.arange(len(sizes)), counts)
    place = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = (ends - sizes)[text] + place * CHAIN
    return starts, np.minimum(CHAIN, ends[text] - starts)


def fit(samples: list[tuple[str, list[str]]]) -> Field | None:
    """Fit on labelled chains of words by stochastic gradient (Adagrad); None without samples.

    Every second chain goes over into a chain of another sample at a random word,
    so that switching between languages is learned from words, not only staying.
    """
    samples = sorted((lang, words) for lang, words in samples if words)
    if not samples:
        return None
    languages = sorted({lang for lang, _ in samples})
    k, random = len(languages), np.random.default_rng(7)
    counts = [Counter(w for lang, words in samples if lang == one for w in words) for one in languages]
    lexicon: dict[str, np.ndarray] = {}
    for i, count in enumerate(counts):
        for word, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon.setdefault(word, np.zeros(k))[i] = 1.0
    numbers, chains = [languages.index(lang) for lang, _ in samples], []
    for i, (_, words) in enumerate(samples):
        labels, other = [numbers[i]] * len(words), int(random.integers(len(samples)))
        if i % 2 and len(words) > 1:
            cut = int(random.integers(1, len(words)))
            tail = samples[other][1][: len(words) - cut]
            words, labels = words[:cut] + tail, labels[:cut] + [numbers[other]] * len(tail)
        chains.append((words, labels))
    codes, distinct = pd.factorize(np.array([w for words, _ in chains for w in words], dtype=object))
    distinct = list(distinct)
    gold = np.array([x for _, labels in chains for x in labels])
    lengths = np.array([len(words) for words, _ in chains])
    starts = np.cumsum(lengths) - lengths
    pairs = list(_grams(distinct))
    rows, features = np.concatenate([r for r, _ in pairs]), np.concatenate([f for _, f in pairs])
    order = np.argsort(rows, kind="stable")
    rows, features = rows[order], features[order]
    at = np.searchsorted(rows, np.arange(len(distinct) + 1))
    listed = np.zeros((len(distinct), k))
    for i, word in enumerate(distinct):
        if word in lexicon:
            listed[i] = lexicon[word]
    field = Field(languages, np.zeros((BUCKETS, k)), lexicon, np.zeros(k), np.zeros((k, k)), np.zeros(k))
    squares = [np.full_like(x, 1e-6) for x in (field.weights, field.known, field.switch, field.first)]

    def move(which: int, values: np.ndarray, gradient: np.ndarray) -> None:
        squares[which] += gradient * gradient
        values -= RATE * gradient / np.sqrt(squares[which])

    for _ in range(EPOCHS):
        shuffled = random.permutation(len(chains))
        for begin in range(0, len(chains), 64):
            some = shuffled[begin : begin + 64]
            here = np.concatenate([np.arange(starts[c], starts[c] + lengths[c]) for c in some])
            used, inner = np.unique(codes[here], return_inverse=True)
            spans = np.concatenate([np.arange(at[w], at[w + 1]) for w in used])
            owner = np.repeat(np.arange(len(used)), at[used + 1] - at[used])
            scores = np.zeros((len(used), k))
            for label in range(k):
                scores[:, label] = np.bincount(owner, field.weights[features[spans], label], len(used))
            scores += listed[used] * field.known
            own_starts, sizes = np.cumsum(lengths[some]) - lengths[some], lengths[some]
            packed = _pack(scores[inner], own_starts, sizes)
            after = field.posteriors(packed, sizes)
            truth = np.eye(k)[_pack(gold[here], own_starts, sizes)]
            valid = np.arange(packed.shape[1])[None, :] < sizes[:, None]
            error = (after - truth) * valid[:, :, None] / len(some)
            flat = error[valid]
            per_word = np.stack([np.bincount(inner, flat[:, label], len(used)) for label in range(k)], axis=1)
            gradient = np.stack([np.bincount(features[spans], per_word[owner, label], BUCKETS) for label in range(k)], axis=1)
            move(0, field.weights, gradient + DECAY * field.weights)
            move(1, field.known, (per_word * listed[used]).sum(axis=0))
            # Expected minus seen transitions; the pair posterior is taken as the product of its ends'
            # messages, which forward-backward gives exactly.
            move(2, field.switch, _transition_gradient(field, packed, sizes, truth, valid) / len(some))
            move(3, field.first, error[:, 0].sum(axis=0))
    return field


def _transition_gradient(field: Field, scores: np.ndarray, lengths: np.ndarray, truth: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Expected minus observed counts of neighbouring labels."""
    k = scores.shape[2]
    if scores.shape[1] < 2:
        return np.zeros((k, k))
    gain = np.exp(scores - scores.max(axis=2, keepdims=True))
    move, first = np.exp(field.switch - field.switch.max()), np.exp(field.first - field.first.max())
    forward, backward = [], [np.ones((len(scores), k))]
    now = first * gain[:, 0]
    forward.append(now / now.sum(axis=1, keepdims=True))
    for t in range(1, scores.shape[1]):
        now = (forward[-1] @ move) * gain[:, t]
        forward.append(now / now.sum(axis=1, keepdims=True))
    for t in range(scores.shape[1] - 2, -1, -1):
        now = (backward[-1] * gain[:, t + 1]) @ move.T
        now /= now.sum(axis=1, keepdims=True)
        backward.append(np.where((t + 1 < lengths)[:, None], now, 1.0))
    backward = backward[::-1]
    expected = np.zeros((k, k))
    for t in range(1, scores.shape[1]):
        pair = forward[t - 1][:, :, None] * move[None] * (gain[:, t] * backward[t])[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        expected += pair[valid[:, t]].sum(axis=0)
    seen = np.einsum("ntj,ntk,nt->jk", truth[:, :-1], truth[:, 1:], valid[:, 1:].astype(float))
    return expected - seen


def _sample_chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, chains = [], []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = letter_words(text)
            starts = list(range(0, len(words), CHAIN))
            random = np.random.default_rng(xxh64_intdigest(text))
            for i in sorted(random.permutation(len(starts))[:TRAIN_CHAINS].tolist()):
                langs.append(lang)
                chains.append(words[starts[i] : starts[i] + CHAIN])
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(chains, pa.list_(pa.string()))], ["lang", "words"])


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Field | None:
    """Fit on at most ``train_docs`` documents of each language, chosen by a hash of their text.

    Only rows with a language and an id that is not held out are read; from each
    chosen document TRAIN_CHAINS chains of CHAIN words at most. The sample is what
    the driver receives; its size does not depend on the table's.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    # Copies of a text count once. A bound on the hash leaves about twice the wanted
    # number in each language, so that the rank sees few rows however large the table is.
    texts = stored(labelled.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.min("doc_id").alias("doc_id")), "texts")
    counts = texts.groupBy("lang").agg(F.count("*").alias("n"))
    place = F.pmod("h", F.lit(1 << 40))
    few = texts.join(counts, "lang").where(place.cast("double") * F.col("n") < F.lit(float(2 * train_docs + 100) * (1 << 40)))
    order = Window.partitionBy("lang").orderBy(place, "h")
    chosen = few.withColumn("r", F.row_number().over(order)).where(F.col("r") <= train_docs).select("lang", "doc_id", "h")
    rows = labelled.select("lang", "doc_id", "text", F.xxhash64("text").alias("h")).join(F.broadcast(chosen), ["lang", "doc_id", "h"], "left_semi")
    sample = with_workers(rows.select("lang", "text").distinct()).mapInArrow(_sample_chains, "lang string, words array<string>")
    return fit([(r["lang"], list(r["words"])) for r in sample.collect()])


def _predict(field: Field | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                listed = [letter_words(t) if t is not None else [] for t in part.column("text").to_pylist()]
                said: list[str] = ["und"] * len(listed)
                scores = np.zeros(len(listed))
                sizes = np.array([len(x) for x in listed], dtype=np.int64)
                if field is not None and sizes.sum():
                    codes, distinct = pd.factorize(np.array([w for x in listed for w in x], dtype=object))
                    emitted = field.emissions(list(distinct))
                    starts, lengths = _chains(sizes)
                    after = np.empty((len(codes), len(field.languages)))
                    for begin in range(0, len(starts), 1024):
                        s, n = starts[begin : begin + 1024], lengths[begin : begin + 1024]
                        packed = field.posteriors(emitted[_pack(codes, s, n)], n)
                        step = np.arange(packed.shape[1])[None, :]
                        valid = step < n[:, None]
                        after[(s[:, None] + step)[valid]] = packed[valid]
                    full = np.flatnonzero(sizes)
                    sums = np.add.reduceat(after, (np.cumsum(sizes) - sizes)[full], axis=0) / sizes[full, None]
                    best = sums.argmax(axis=1)
                    scores[full] = np.clip(sums[np.arange(len(full)), best], 0, 1)
                    for i, b in zip(full.tolist(), best.tolist(), strict=True):
                        said[i] = field.languages[b]
                names = part.schema.names
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(said, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"]
                )

    return run


def predict(docs: DataFrame, field: Field | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (columns of these names are replaced).

    Only ``text`` is looked at. A null text, one without letters, and every text if
    nothing could be learned, are ``und`` with score 0.
    """
    rows = with_workers(docs.drop("lang_pred", "score"))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_predict(field), f"{shape}, lang_pred string, score double")


def language_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred and score."""
    found = predict(docs.select("doc_id", "text"), train(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that have a language, be it one of several in the text.

    ``score`` does not decide: it is the share of the best language, which is small in
    a code-switched text however certain each word is.
    """
    names = docs.columns
    found = predict(docs.withColumnsRenamed({c: f"_llm_{c}" for c in names if c in ("lang_pred", "score")}), train(docs.select("doc_id", "text", "lang")))
    kept = found.where(F.col("lang_pred") != "und").drop("lang_pred", "score")
    return kept.withColumnsRenamed({f"_llm_{c}": c for c in ("lang_pred", "score")}).select(*names)
