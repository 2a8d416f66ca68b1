"""Language of texts from a bidirectional gated recurrent network over bytes.

A text's bytes are cut into windows of ``STEPS``; the network reads each window in both
directions and labels every byte, and a text's probabilities are the mean over all
its bytes. Windows of many texts run side by side. The network is trained in numpy by
backpropagation through time.

Training uses a bounded sample: ``per_language`` excerpts of at most ``EXCERPT``
characters of each language, chosen by a hash of the id and collected to the driver.
Every language that a document names is learned. Prediction reads whole texts.

Defined results: null texts and texts without a letter are ``und`` with score 0, as
is every text if nothing could be learned; documents with a null ``lang`` teach nothing;
of equally likely languages the first by name wins; repeated rows are labelled alike; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

UNKNOWN = "und"
STEPS, HIDDEN, EMBEDDED = 64, 8, 8
PER_LANGUAGE, EXCERPT = 400, 256
ROUNDS, BATCH, RATE = 160, 128, 0.02
# Windows that run side by side, and bytes of text handled at once.
SIDE_BY_SIDE, GROUP_BYTES = 4096, 1 << 21
SEED = 6

_LETTER = re.compile(r"[^\W\d_]")


def windows(data: bytes) -> np.ndarray:
    """Bytes as rows of ``STEPS``, padded with zeros."""
    rows = -(-len(data) // STEPS)
    out = np.zeros(rows * STEPS, dtype=np.uint8)
    out[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return out.reshape(rows, STEPS)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Parameters of both directions: embedding, gates (update, reset, new) and labels."""

    languages: list[str]
    values: dict[str, np.ndarray]

    @staticmethod
    def new(languages: list[str], seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)

        def drawn(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        values = {"embedding": drawn(256, EMBEDDED, scale=0.5)}
        for way in "fb":
            values |= {
                f"{way}_in": drawn(EMBEDDED, 3 * HIDDEN, scale=EMBEDDED**-0.5),
                f"{way}_gates": drawn(HIDDEN, 2 * HIDDEN, scale=HIDDEN**-0.5),
                f"{way}_new": drawn(HIDDEN, HIDDEN, scale=HIDDEN**-0.5),
                f"{way}_bias": np.zeros(3 * HIDDEN, dtype=np.float32),
            }
        values |= {"out": drawn(2 * HIDDEN, len(languages), scale=0.3),
                   "out_bias": np.zeros(len(languages), dtype=np.float32)}
        return Network(languages, values)

    def _way(self, way: str, rows: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States of one direction at every step; what training needs of each step if ``keep``."""
        v = self.values
        table = v["embedding"] @ v[f"{way}_in"] + v[f"{way}_bias"]
        gates, new = v[f"{way}_gates"], v[f"{way}_new"]
        state = np.zeros((len(rows), HIDDEN), dtype=np.float32)
        states = np.empty((STEPS, len(rows), HIDDEN), dtype=np.float32)
        held = []
        steps = range(STEPS) if way == "f" else range(STEPS - 1, -1, -1)
        for t in steps:
            given = table[rows[:, t]]
            gate = _sigmoid(given[:, : 2 * HIDDEN] + state @ gates)
            update, reset = gate[:, :HIDDEN], gate[:, HIDDEN:]
            inner = state @ new
            fresh = np.tanh(given[:, 2 * HIDDEN :] + reset * inner)
            after = fresh + update * (state - fresh)
            if keep:
                held.append((t, state, update, reset, inner, fresh))
            states[t] = state = after
        return states, held

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        """Of every language at every byte: windows by steps by languages."""
        both = np.concatenate([self._way("f", rows, False)[0], self._way("b", rows, False)[0]], axis=2)
        logits = both @ self.values["out"] + self.values["out_bias"]
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits.transpose(1, 0, 2)

    def gradients(self, rows: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all bytes and its gradients, by backpropagation through time."""
        v = self.values
        ways = {way: self._way(way, rows, True) for way in "fb"}
        both = np.concatenate([ways["f"][0], ways["b"][0]], axis=2)
        logits = both @ v["out"] + v["out_bias"]
        logits -= logits.max(axis=2, keepdims=True)
        odds = np.exp(logits)
        odds /= odds.sum(axis=2, keepdims=True)
        real = (rows.T > 0).astype(np.float32)
        weight = real / max(1.0, float(real.sum()))
        picked = odds[:, np.arange(len(rows)), labels]
        loss = float(-(np.log(np.maximum(picked, 1e-9)) * weight).sum())
        error = odds.copy()
        error[:, np.arange(len(rows)), labels] -= 1
        error *= weight[:, :, None]
        out = {k: np.zeros_like(x) for k, x in v.items()}
        out["out"] = np.einsum("tbh,tbl->hl", both, error)
        out["out_bias"] = error.sum(axis=(0, 1))
        back = error @ v["out"].T
        for way, part in (("f", back[:, :, :HIDDEN]), ("b", back[:, :, HIDDEN:])):
            gates, new, into = v[f"{way}_gates"], v[f"{way}_new"], v[f"{way}_in"]
            carry = np.zeros((len(rows), HIDDEN), dtype=np.float32)
            for t, state, update, reset, inner, fresh in reversed(ways[way][1]):
                grad = part[t] + carry
                by_fresh = grad * (1 - update) * (1 - fresh * fresh)
                by_update = grad * (state - fresh) * update * (1 - update)
                by_reset = by_fresh * inner * reset * (1 - reset)
                by_gate = np.concatenate([by_update, by_reset], axis=1)
                by_inner = by_fresh * reset
                carry = grad * update + by_gate @ gates.T + by_inner @ new.T
                out[f"{way}_gates"] += state.T @ by_gate
                out[f"{way}_new"] += state.T @ by_inner
                by_given = np.concatenate([by_gate, by_fresh], axis=1)
                out[f"{way}_bias"] += by_given.sum(axis=0)
                out[f"{way}_in"] += v["embedding"][rows[:, t]].T @ by_given
                np.add.at(out["embedding"], rows[:, t], by_given @ into.T)
        return loss, out


def train(excerpts: list[str], labels: list[str], rounds: int = ROUNDS, seed: int = SEED) -> Network | None:
    """Fit a network to labelled excerpts; every language weighs the same."""
    cut = [(windows(x.encode()), y) for x, y in zip(excerpts, labels)]
    cut = [(w, y) for w, y in cut if len(w)]
    languages = sorted({y for _, y in cut})
    if not languages:
        return None
    rows = [np.concatenate([w for w, y in cut if y == x]) for x in languages]
    network, rng = Network.new(languages, seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(x) for k, x in network.values.items()}
    second = {k: np.zeros_like(x) for k, x in network.values.items()}
    for turn in range(1, rounds + 1):
        chosen = rng.integers(len(languages), size=BATCH)
        batch = np.stack([rows[c][rng.integers(len(rows[c]))] for c in chosen])
        _, by = network.gradients(batch, chosen)
        norm = float(np.sqrt(sum((g**2).sum() for g in by.values())))
        rate = RATE * (1 - (turn - 1) / rounds)
        for k, g in by.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            network.values[k] -= (rate * (first[k] / (1 - 0.9**turn))
                                  / (np.sqrt(second[k] / (1 - 0.99**turn)) + 1e-8)).astype(np.float32)
    return network


def predict(network: Network | None, texts: list[str | None]) -> list[tuple[str, float]]:
    """Language and probability of each text."""
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    if network is None:
        return out
    at = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
    start = 0
    while start < len(at):
        group, size = [], 0
        while start < len(at) and size < GROUP_BYTES:
            group.append((at[start], texts[at[start]].encode()))
            size += len(group[-1][1])
            start += 1
        cut = [windows(data) for _, data in group]
        rows = np.concatenate(cut)
        sums = np.empty((len(rows), len(network.languages)), dtype=np.float64)
        for i in range(0, len(rows), SIDE_BY_SIDE):
            part = rows[i : i + SIDE_BY_SIDE]
            odds = network.probabilities(part)
            sums[i : i + len(part)] = np.einsum("btl,bt->bl", odds, (part > 0).astype(np.float32))
        heads = np.cumsum([0] + [len(w) for w in cut[:-1]])
        totals = np.add.reduceat(sums, heads, axis=0)
        totals /= totals.sum(axis=1, keepdims=True)
        for (i, _), odds in zip(group, totals):
            best = int(odds.argmax())
            out[i] = (network.languages[best], float(min(1.0, odds[best])))
    return out


def training_sample(docs: DataFrame, usable: Column, per_language: int) -> tuple[list[str], list[str]]:
    """At most ``per_language`` excerpts of each language from the documents that are ``usable``."""
    known = docs.select("doc_id", "lang", "text").where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return [], []
    scale = 1 << 30
    # Twice the share that would do, so that chance leaves none short.
    shares = [F.lit(v) for r in counts for v in (r.lang, min(scale, -(-2 * per_language * scale // r["count"])))]
    share = F.create_map(*shares)[F.col("lang")]
    draw = F.xxhash64("doc_id", "lang")
    start = F.pmod(F.xxhash64("lang", "doc_id"), F.greatest(F.length("text") - EXCERPT, F.lit(1))).cast("int") + 1
    picked = known.where(F.pmod(draw, F.lit(scale)) < share).select(
        "lang", draw.alias("draw"), F.substring(F.col("text"), start, F.lit(EXCERPT)).alias("excerpt"))
    got = sorted(picked.limit(4 * per_language * len(counts)).collect())
    excerpts, labels, taken = [], [], {}
    for r in got:
        taken[r.lang] = taken.get(r.lang, 0) + 1
        if taken[r.lang] <= per_language:
            excerpts.append(r.excerpt)
            labels.append(r.lang)
    return excerpts, labels


def label_texts(df: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """``row`` (all columns of ``df`` but the text), its ``language`` and ``score``."""
    shared = df.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = predict(shared.value, batch.column("body").to_pylist())
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), pa.array([x for x, _ in found], pa.string()),
                pa.array([x for _, x in found], pa.float64())], names=["row", "language", "score"])

    rest = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text])
    rows = df.select(rest.alias("row"), F.col(text).alias("body"))
    schema = StructType([rows.schema["row"]]).add("language", "string").add("score", "double")
    return rows.mapInArrow(run, schema)


def identify_languages(docs: DataFrame, usable: Column, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Train on documents where ``usable`` (a test of ``doc_id``) and label all ``docs``."""
    return label_texts(docs, train(*training_sample(docs, usable, per_language)))
