"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each document. Expectation
maximisation estimates, without any true label, how often each labeller votes
each way on good and on bad documents, and from that each document's posterior
of being good. The posteriors of a bounded sample train a linear scorer over
hashed words and word shapes, which scores every document.

Only the counts of vote patterns go to the driver (at most 3 to the power of
the number of labellers, at any corpus size), and the sample. Votes and scores
are maps over the documents without a shuffle of texts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, ragged, slices, stored

NOTHING, GOOD, BAD = 0, 1, 2
#: Distinct texts that train the scorer at most, those with the smallest hashes.
MAX_SAMPLE = 6000
#: Weights of the scorer.
DIMENSIONS = 1 << 17
#: Rounds of the estimation and of the training.
EM_ROUNDS, EPOCHS = 200, 200
#: Score from which a document is good.
THRESHOLD = 0.6
#: Words whose weights a task keeps at a time.
_KEEP = 300_000

_SYMBOLS = b"#*$%&|<>"
_RUNS = (re.compile(r"[a-z]+"), re.compile(r"[A-Z]+"), re.compile(r"\d+"))


def votes(text: str | None) -> str:
    """A digit for each labeller: 0 no vote, 1 good, 2 bad."""
    text = text or ""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n = len(words)

    def vote(value: float, good_below: float, bad_above: float) -> int:
        return GOOD if value <= good_below else BAD if value >= bad_above else NOTHING
    if not n:
        return str(BAD) * len(LABELLERS)
    raw = text.encode()
    symbols = (len(raw) - len(raw.translate(None, _SYMBOLS))) / n
    upper = sum(w.isupper() for w in words) / n
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    ends = sum(x.rstrip()[-1] in ".!?:;\"')" for x in lines) / len(lines)
    return "".join(map(str, (
        vote(symbols, 0.05, 0.5),
        vote(upper, 0.1, 0.4),
        vote(again, 0.02, 0.2),
        vote(1 - ends, 0.3, 0.8),
        vote(text.count("|") / n, 0.01, 0.2),
        vote(text.count("!") / n, 0.05, 0.3),
        vote(1 - len(set(lines)) / len(lines), 0.1, 0.5),
        vote(abs(len(text) / n - 6), 3, 8),
        GOOD if n >= 60 else BAD if n < 20 else NOTHING,
    )))


#: Names of the labellers, in the order of their digits.
LABELLERS = ("symbols", "capitals", "stuttered words", "line ends", "table bars", "exclamations", "repeated lines",
             "word length", "length")


@dataclass
class LabelModel:
    """``rates[k, y, v]``: how often labeller k votes v on documents of class y (0 bad, 1 good); ``prior`` of good."""

    rates: np.ndarray
    prior: float

    def posterior(self, patterns: list[str]) -> np.ndarray:
        v = np.array([[int(d) for d in p] for p in patterns], np.int64).reshape(len(patterns), len(self.rates))
        k = np.arange(len(self.rates))
        logs = [np.log(p) + np.log(self.rates[k, y, v]).sum(axis=1) for y, p in ((0, 1 - self.prior), (1, self.prior))]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def estimate(patterns: dict[str, int], rounds: int = EM_ROUNDS) -> LabelModel:
    """Accuracies of the labellers from counts of vote patterns.

    Begins with the share of good among the votes of a pattern, so that the
    class called good is the one that most labellers vote good on."""
    names, counts = list(patterns), np.array(list(patterns.values()), float)
    v = np.array([[int(d) for d in p] for p in names], np.int64).reshape(len(names), len(LABELLERS))
    good, bad = (v == GOOD).sum(axis=1), (v == BAD).sum(axis=1)
    belief = (good + 1) / (good + bad + 2)
    model = LabelModel(np.full((len(LABELLERS), 2, 3), 1 / 3), 0.5)
    for _ in range(rounds if names else 0):
        weight = np.stack([counts * (1 - belief), counts * belief])
        rates = np.stack([[np.bincount(v[:, k], weight[y], 3) + 1 for y in (0, 1)] for k in range(len(LABELLERS))])
        total = weight.sum(axis=1) + 1
        model = LabelModel(rates / rates.sum(axis=2, keepdims=True), total[1] / total.sum())
        before, belief = belief, model.posterior(names)
        if np.abs(before - belief).max() < 1e-9:
            break
    return model


def places(word: str) -> tuple[int, int]:
    """Hashed places of a word and of its shape (runs of letters and digits made one)."""
    shape = word
    for run, mark in zip(_RUNS, "aA0", strict=True):
        shape = run.sub(mark, shape)
    return (xxhash.xxh3_64_intdigest(word.lower()) % DIMENSIONS,
            xxhash.xxh3_64_intdigest(shape, seed=1) % DIMENSIONS)


@dataclass
class Scorer:
    """``weights`` of the hashed places; a document's score is the sigmoid of the bias and its words' mean weight."""

    weights: np.ndarray
    bias: float

    def score(self, text: str | None, cache: dict[str, float]) -> float:
        words = (text or "").split()
        if not words:
            return 0.0
        total = 0.0
        for w in words:
            if (own := cache.get(w)) is None:
                a, b = places(w)
                own = cache[w] = float(self.weights[a] + self.weights[b])
            total += own
        return float(1 / (1 + np.exp(-np.clip(self.bias + total / len(words), -500, 500))))


def train(rows: list[tuple[float, np.ndarray, np.ndarray]], epochs: int = EPOCHS, step: float = 10.0,
          ridge: float = 1e-5) -> Scorer:
    """Logistic regression on (posterior, places, shares of the words) by steps scaled to past gradients."""
    if not rows:
        return Scorer(np.zeros(DIMENSIONS), 0.0)
    y = np.array([r[0] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    place, share = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows])
    used, place = np.unique(place, return_inverse=True)
    w, past, bias, past_b = np.zeros(len(used)), np.full(len(used), 1e-12), 0.0, 1e-12
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(owner, w[place] * share, len(rows)), -500, 500)))
        off = p - y
        g = np.bincount(place, off[owner] * share, len(used)) / len(rows) + ridge * w
        g_b = off.mean()
        past, past_b = past + g * g, past_b + g_b * g_b
        w, bias = w - step * g / np.sqrt(past), bias - step / 10 * g_b / np.sqrt(past_b)
    weights = np.zeros(DIMENSIONS)
    weights[used] = w
    return Scorer(weights, float(bias))


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([pa.array(list(map(votes, batch["text"].to_pylist())), pa.string())], names=["pattern"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        patterns, at, share = [], [], []
        for text in batch["text"].to_pylist():
            words = text.split()
            found: Counter = Counter()
            for w, c in Counter(words).items():
                for p in places(w):
                    found[p] += c
            patterns.append(votes(text))
            at.append(np.fromiter(found, np.int32, len(found)))
            share.append(np.fromiter(found.values(), np.float32, len(found)) / max(1, len(words)))
        yield pa.RecordBatch.from_arrays([pa.array(patterns, pa.string()), ragged(at, pa.int32()), ragged(share, pa.float32())],
                                         names=["pattern", "at", "share"])


def fit(docs: DataFrame, text_col: str = "text", max_sample: int = MAX_SAMPLE) -> tuple[LabelModel, Scorer]:
    """Estimate the labellers over all documents and train the scorer on the sample."""
    texts = docs.select(F.col(text_col).alias("text")).where("text IS NOT NULL")
    counted = texts.mapInArrow(_vote, "pattern string").groupBy("pattern").count().collect()
    model = estimate({r[0]: r[1] for r in counted})
    sample = stored(bounded_sample(texts, "text", max_sample).mapInArrow(_hashed, "pattern string, at array<int>, share array<float>"), "weak-sample").toArrow()
    order = sample.combine_chunks()
    rows = [(float(p), np.asarray(a, np.int64), np.asarray(s, float)) for p, a, s in zip(
        model.posterior(order["pattern"].to_pylist()), order["at"].to_pylist(), order["share"].to_pylist(), strict=True)]
    rows.sort(key=lambda r: (r[0], len(r[1]), r[1].tolist()[:8]))  # sums in the same order in each run
    return model, train(rows)


def score(docs: DataFrame, label_model: LabelModel, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``votes``, ``weak_label``
    (posterior of good from the votes), ``score`` (of the scorer) and ``kept``.

    A null or empty text has votes against it throughout, score 0 and is not
    kept. Rows are independent; other columns are not read."""
    given = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    held = docs.sparkSession.sparkContext.broadcast((label_model, scorer))

    def run(batches):
        cache: dict[str, float] = {}
        model, linear = held.value
        for batch in slices(batches):
            texts = batch["text"].to_pylist()
            got = [linear.score(t, cache) for t in texts]
            if len(cache) > _KEEP:
                cache.clear()
            patterns = list(map(votes, texts))
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(patterns, pa.string()), pa.array(model.posterior(patterns)), pa.array(got, pa.float64()),
                 pa.array([s >= threshold and bool((t or "").split()) for s, t in zip(got, texts, strict=True)], pa.bool_())],
                names=["id", "votes", "weak_label", "score", "kept"])
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, votes string, weak_label double, score double, kept boolean"
    return given.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``fit`` on the documents, then ``score`` all of them."""
    return score(docs, *fit(docs, text_col), id_col, text_col)
