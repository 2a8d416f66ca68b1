"""Toxicity from subword-bag embeddings averaged into a linear softmax.

A word's vector is the sum of the embeddings of its character n-grams and itself,
hashed into a fixed number of rows; a segment of ``SEGMENT`` words is the mean over all
of them, and a linear softmax gives its probability. A text scores as its most toxic
segment, so a few words count as much in a long text as in a short one. Embeddings
and softmax are trained together in numpy, so an unseen misspelling shares the
vectors of the n-grams it keeps. In the first pass a random segment stands for a
text, then the one that leads.

Training uses a bounded sample (``per_label`` texts of each label of at most
``max_words`` words, chosen by a hash of the id), collected to the driver. Scoring
reads whole texts of all documents. As the softmax is linear, a word's part of the
score is one number, which each worker remembers for up to ``WORDS`` words.

Defined results: texts without words get the score of a mean of zero; without
labels of both kinds every score is 0 or 1 like the only label (0 without any);
a document labelled more than once counts as its largest label; repeated rows are
scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

PER_LABEL, MAX_WORDS = 2_000, 2_000
ROWS_BITS, DIM = 17, 8
SHORTEST, LONGEST = 3, 5
EPOCHS, LEAST_STEPS, WARM, BATCH, RATE = 6, 300, 1, 64, 0.3
SEGMENT = 16
SLOW = 1e-3
SHARED = 3
WORDS = 300_000
# Words longer than this are read in pieces of this length.
WORD_CHARS = 64
SEED = 4

_WORD = re.compile(r"[^\W\d_]{1,%d}" % WORD_CHARS)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def subwords(word: str) -> list[int]:
    """Rows of a word's n-grams, its ends marked, and of the word itself."""
    marked, mask = f"<{word}>", (1 << ROWS_BITS) - 1
    grams = [marked[i : i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(marked) - n + 1)]
    return [zlib.crc32(g.encode()) & mask for g in (*grams, f"={word}")]


@dataclass
class Model:
    """The trained classifier, folded into one weight per row."""

    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.known: dict[str, tuple[float, int]] = {}

    def score(self, text: str) -> float:
        known, parts = self.known, []
        for word in words_of(text):
            part = known.get(word)
            if part is None:
                rows = subwords(word)
                part = (float(self.weights[rows].sum()), len(rows))
                if len(known) >= WORDS:
                    known.clear()
                known[word] = part
            parts.append(part)
        best = 0.0
        if parts:
            sums = np.add.reduceat(np.array(parts), np.arange(0, len(parts), SEGMENT))
            best = (sums[:, 0] / sums[:, 1]).max()
        logit = self.bias + best
        return float(1 / (1 + np.exp(-np.clip(logit, -50, 50))))


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Fit embeddings and softmax to labelled texts by minibatches with adaptive steps."""
    positive = float(np.mean(labels)) if labels else 0.0
    if positive in (0.0, 1.0):
        return Model(np.zeros(1 << ROWS_BITS, dtype=np.float32), 50.0 if positive else -50.0)
    rng = np.random.default_rng(seed)
    table = ((rng.random((1 << ROWS_BITS, DIM)) - 0.5) / DIM).astype(np.float32)
    softmax, bias = np.zeros((DIM, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    softmax[:, 1] = rng.standard_normal(DIM) * 0.1
    # Squared gradients so far. Rows start with some, so that rare ones move little.
    seen_table = np.full(1 << ROWS_BITS, SLOW, dtype=np.float32)
    seen_softmax, seen_bias = np.full((DIM, 2), 1e-3, dtype=np.float32), np.full(2, 1e-3, dtype=np.float32)
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], dtype=np.int64) for t in texts]
    rows = [np.array(subwords(w), dtype=np.int64) for w in vocabulary]
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    # Rows that too few texts share can only be learned by heart; they stay zero.
    shared = np.zeros(1 << ROWS_BITS, dtype=np.int64)
    for words in docs:
        if len(words):
            shared[np.unique(np.concatenate([rows[w] for w in np.unique(words)]))] += 1
    table[shared < SHARED] = 0
    wanted = np.eye(2, dtype=np.float32)[np.array(labels)]
    weight = np.where(np.array(labels) == 1, 0.5 / positive, 0.5 / (1 - positive)).astype(np.float32)
    order = np.array([i for i, d in enumerate(docs) if len(d)])
    rounds = max(EPOCHS, -(-LEAST_STEPS * BATCH // len(order)))
    for turn in range(rounds):
        rng.shuffle(order)
        rate = RATE * (1 - turn / rounds)
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            tokens = np.concatenate([docs[i] for i in batch])
            words, token = np.unique(tokens, return_inverse=True)
            flat = np.concatenate([rows[w] for w in words])
            heads = np.concatenate([[0], np.cumsum(sizes[words])[:-1]])
            vectors = np.add.reduceat(table[flat], heads, axis=0)
            # Segments of each text, their means and their odds.
            cuts, first = [], [0]
            start = 0
            for i in batch:
                cuts.append(np.arange(start, start + len(docs[i]), SEGMENT))
                first.append(first[-1] + len(cuts[-1]))
                start += len(docs[i])
            cuts = np.concatenate(cuts)
            count = np.add.reduceat(sizes[words][token], cuts)
            means = np.add.reduceat(vectors[token], cuts, axis=0) / count[:, None]
            lead = means @ (softmax[:, 1] - softmax[:, 0])
            if turn < WARM:
                chosen = np.array([rng.integers(a, b) for a, b in zip(first[:-1], first[1:])])
            else:
                chosen = np.array([a + int(lead[a:b].argmax()) for a, b in zip(first[:-1], first[1:])])
            logits = means[chosen] @ softmax + bias
            odds = np.exp(logits - logits.max(axis=1, keepdims=True))
            error = (odds / odds.sum(axis=1, keepdims=True) - wanted[batch]) * weight[batch][:, None]
            by_softmax, by_bias = means[chosen].T @ error, error.sum(axis=0)
            by_segment = (error @ softmax.T) / count[chosen][:, None]
            ends = np.append(cuts[1:], len(tokens))
            used = np.concatenate([token[cuts[c] : ends[c]] for c in chosen])
            owner = np.repeat(np.arange(len(chosen)), ends[chosen] - cuts[chosen])
            grams = np.concatenate([rows[words[w]] for w in used])
            by_gram = np.repeat(by_segment[owner], sizes[words[used]], axis=0)
            learned = shared[grams] >= SHARED
            unique, inverse = np.unique(grams[learned], return_inverse=True)
            by_gram = by_gram[learned]
            by_row = np.stack([np.bincount(inverse, by_gram[:, d], len(unique)) for d in range(DIM)], axis=1)
            seen_table[unique] += (by_row**2).mean(axis=1)
            table[unique] -= rate * by_row / np.sqrt(seen_table[unique])[:, None]
            seen_softmax += by_softmax**2
            softmax -= rate * by_softmax / np.sqrt(seen_softmax)
            seen_bias += by_bias**2
            bias -= rate * by_bias / np.sqrt(seen_bias)
    return Model(table @ (softmax[:, 1] - softmax[:, 0]), float(bias[1] - bias[0]))


def training_sample(docs: DataFrame, labels: DataFrame, usable: Column, per_label: int,
                    max_words: int) -> tuple[list[str], list[int]]:
    """At most ``per_label`` labelled texts of each label."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(usable)
    ids = [r for label in (0, 1) for r in known.where(F.col("toxic") == label).orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(per_label).select("doc_id", F.col("toxic").cast("int").alias("toxic")).collect()]
    chosen = docs.sparkSession.createDataFrame([(r.doc_id, r.toxic) for r in ids], "chosen long, label int")
    texts = docs.select(F.col("doc_id").alias("id"), "text").where(
        F.size(F.split("text", " ")) <= max_words).join(F.broadcast(chosen), F.col("id") == F.col("chosen"))
    # The order of rows decides the batches, so it is fixed.
    got = sorted(texts.select("id", "text", "label").limit(4 * per_label).collect())
    return [r.text for r in got], [r.label for r in got]


def score_texts(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``row`` (all columns of ``df`` but the text) and the ``score`` of its whole text."""
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    mark = int(np.random.default_rng().integers(2**62))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _models.get(mark)
        if model is None:
            _models.clear()
            model = _models[mark] = Model(*shared.value)
        for batch in batches:
            scores = [model.score(t.as_py() or "") for t in batch.column("body")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(scores, pa.float64())], names=["row", "score"])

    rest = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text])
    rows = df.select(rest.alias("row"), F.col(text).alias("body"))
    return rows.mapInArrow(run, StructType([rows.schema["row"]]).add("score", "double"))


_models: dict[int, Model] = {}


def toxicity(docs: DataFrame, labels: DataFrame, usable: Column, per_label: int = PER_LABEL,
             max_words: int = MAX_WORDS) -> DataFrame:
    """Train on labelled documents where ``usable`` (a test of ``doc_id``) and score all ``docs``."""
    return score_texts(docs, train(*training_sample(docs, labels, usable, per_label, max_words)))
