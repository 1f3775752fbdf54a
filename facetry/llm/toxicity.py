"""Toxicity by a chain of linear classifiers over hashed words and word beginnings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.llm.common import row_key, stored
from facetry.llm.shingles import text_batches

BITS = 18
#: Lengths in bytes of the word beginnings that are features beside the word.
BEGINNINGS = (4, 5, 6, 7)
#: Categories in the order of the chain: each sees the probabilities of those before it.
CATEGORIES = ("low_quality", "toxic")
#: At most this many labelled rows, the least by a hash of their id, are learned from.
SAMPLE = 12_000
FOLDS = 3
#: Words whose numbers a task keeps.
KEPT_WORDS = 1 << 18
#: Entries of the sample that are counted at once.
SLICE = 1 << 20
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Words(dict):
    """Feature numbers of every word met: the word itself and its beginnings."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= KEPT_WORDS:
            self.clear()
        value = self[word] = numbers(word)
        return value


def numbers(word: bytes) -> tuple[int, ...]:
    whole = xxhash.xxh3_64_intdigest(word) & ((1 << BITS) - 1)
    return whole, *(xxhash.xxh3_64_intdigest(word[:n], seed=n) & ((1 << BITS) - 1) for n in BEGINNINGS if len(word) >= n)


def distinct_words(text: str | None) -> set[bytes]:
    """Distinct words of the whole text: runs of letters, digits and bytes beyond ASCII, A-Z in lower case."""
    return set(text.encode().translate(_FOLD).split()) if text else set()


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = Words()
    for piece in text_batches(batches):
        found = [np.sort(np.array([f for w in distinct_words(t) for f in cache[w]], np.int32)).tobytes() for t in piece.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([piece.column(c) for c in ("doc_id", *CATEGORIES)] + [pa.array(found, pa.binary())], ["doc_id", *CATEGORIES, "features"])


@dataclass
class Linear:
    """Weights of hashed features, of the probabilities of earlier categories, and the intercept."""

    weights: np.ndarray
    chain: np.ndarray
    bias: float

    def margin(self, row_of: np.ndarray, feature: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return np.bincount(row_of, self.weights[feature], len(earlier)) + earlier @ self.chain + self.bias


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(row_of: np.ndarray, feature: np.ndarray, earlier: np.ndarray, y: np.ndarray, sure: float = 3.0, penalty: float = 1e-4, steps: int = 100) -> Linear:
    """Logistic regression on the features whose log odds are ``sure`` standard errors from even, by accelerated gradient steps.

    ``feature`` ascends within each row.  Features are scaled by their log odds; rows of both kinds weigh the same in total.
    """
    n, size = len(y), 1 << BITS
    if n == 0 or y.min() == y.max():
        rate = (y.sum() + 0.5) / (n + 1)
        return Linear(np.zeros(size), np.zeros(earlier.shape[1]), float(np.log(rate / (1 - rate))))
    once = np.ones(len(feature), bool)  # features are sorted within a row
    once[1:] = (feature[1:] != feature[:-1]) | (row_of[1:] != row_of[:-1])
    at, what = row_of[once], feature[once]
    yes, no = np.zeros(size), np.zeros(size)
    for i in range(0, len(what), SLICE):
        positive = y[at[i:i + SLICE]]
        yes += np.bincount(what[i:i + SLICE], positive, size)
        no += np.bincount(what[i:i + SLICE], 1 - positive, size)
    del once, at, what
    odds = np.log((yes + 0.5) / (y.sum() + 1)) - np.log((no + 0.5) / (n - y.sum() + 1))
    errors = np.abs(odds) / np.sqrt(1 / (yes + 0.5) + 1 / (no + 0.5))
    errors[yes + no < 2] = 0.0
    used = np.nonzero(errors >= sure)[0]
    place = np.full(size, -1, np.int32)
    place[used] = np.arange(len(used))
    keep = (place >= 0)[feature]
    r, f = row_of[keep].astype(np.int64), place[feature[keep]].astype(np.int64)
    k, m = len(used), earlier.shape[1]
    x = odds[used][f]
    # columns: sum of a row's scaled features each, earlier probabilities, intercept
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    norm = 0.25 * (weight * (np.bincount(r, np.abs(x), n) * np.abs(x).max(initial=0) + (earlier ** 2).sum(axis=1) + 1)).sum()
    rate = 1 / max(norm, 1e-9)
    w = np.zeros(k + m + 1)
    ahead = w
    for t in range(steps):
        margin = np.bincount(r, x * ahead[f], n) + earlier @ ahead[k:k + m] + ahead[-1]
        d = weight * (sigmoid(margin) - y)
        gradient = np.concatenate((np.bincount(f, x * d[r], k), earlier.T @ d, [d.sum()]))
        gradient[:-1] += penalty * ahead[:-1]
        new = ahead - rate * gradient
        ahead, w = new + t / (t + 3) * (new - w), new
    weights = np.zeros(size)
    weights[used] = odds[used] * w[:k]
    return Linear(weights, w[k:k + m], float(w[-1]))


def fit_chain(row_of: np.ndarray, feature: np.ndarray, labels: np.ndarray, fold: np.ndarray) -> tuple[list[Linear], list[float]]:
    """Models of the chain and a threshold for each category.

    A later model must not see probabilities that an earlier one gave to its own training
    rows, so each row's come from a model that was fitted without its fold.  The same
    out-of-fold probabilities set the threshold with the best F1.
    """
    n = len(labels)
    earlier = np.zeros((n, 0))
    models, cuts = [], []
    for c in range(labels.shape[1]):
        y = labels[:, c]
        outside = np.zeros(n)
        for k in range(FOLDS):
            learn = fold != k
            number = np.cumsum(learn, dtype=np.int32) - 1
            mine = learn[row_of]
            model = fit(number[row_of[mine]], feature[mine], earlier[learn], y[learn])
            test = ~learn
            number = np.cumsum(test, dtype=np.int32) - 1
            theirs = test[row_of]
            outside[test] = sigmoid(model.margin(number[row_of[theirs]], feature[theirs], earlier[test]))
        models.append(fit(row_of, feature, earlier, y))
        order = np.argsort(-outside, kind="stable")
        hits = np.cumsum(y[order])
        f1 = 2 * hits / (np.arange(1, n + 1) + max(1, y.sum())) if n else np.zeros(0)
        if n and y.sum():
            best = int(np.argmax(f1))
            below = outside[order[best + 1]] if best + 1 < n else 0.0
            cuts.append(float((outside[order[best]] + below) / 2))
        else:
            cuts.append(1.0)
        earlier = np.column_stack((earlier, outside))
    return models, cuts


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[Linear], list[float]]:
    """The chain from a bounded sample of the labelled ids, one row each; a label row without text or with null labels is left out."""
    marked = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(
        F.max(1 - F.col("quality")).cast("double").alias(CATEGORIES[0]), F.max("toxic").cast("double").alias(CATEGORIES[1]))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded, and so is its broadcast
    # of several rows with an id the one with the least key, so a repeated id neither fills the sample nor outweighs others
    texts = docs.select("doc_id", "text", row_key().alias("key")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", *CATEGORIES).agg(F.min_by("text", "key").alias("text"))
    rows = stored(texts.mapInArrow(_features, f"doc_id long, {CATEGORIES[0]} double, {CATEGORIES[1]} double, features binary"), "toxicity-sample")

    def learn(batches):
        held = [b for b in batches if b.num_rows]
        table = pa.Table.from_batches(held) if held else None
        if table is not None:
            table = table.sort_by("doc_id")
        parts = [np.frombuffer(x.as_buffer(), np.int32) for x in table.column("features")] if table is not None else []
        feature = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        row_of = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts]) if parts else np.zeros(0, np.int32)
        y = np.column_stack([table.column(c).to_numpy() for c in CATEGORIES]) if parts else np.zeros((0, len(CATEGORIES)))
        fold = np.array([xxhash.xxh3_64_intdigest(str(d)) % FOLDS for d in table.column("doc_id").to_pylist()]) if parts else np.zeros(0, np.int64)
        del held, table, parts  # the arrays hold all there is to learn from
        models, cuts = fit_chain(row_of, feature, y, fold)
        for c, (model, cut) in enumerate(zip(models, cuts, strict=True)):
            used = np.nonzero(model.weights)[0]
            yield pa.RecordBatch.from_pydict({
                "category": pa.array([c], pa.int32()), "used": pa.array([used.astype(np.int32).tobytes()], pa.binary()), "weights": pa.array([model.weights[used].tobytes()], pa.binary()),
                "chain": pa.array([model.chain.tobytes()], pa.binary()), "bias": pa.array([model.bias]), "cut": pa.array([cut])})

    # one task: the sample is bounded
    got = rows.coalesce(1).mapInArrow(learn, "category int, used binary, weights binary, chain binary, bias double, cut double").orderBy("category").toArrow().to_pylist()
    models = []
    for g in got:
        weights = np.zeros(1 << BITS)
        weights[np.frombuffer(g["used"], np.int32)] = np.frombuffer(g["weights"], float)
        models.append(Linear(weights, np.frombuffer(g["chain"], float), g["bias"]))
    return models, [g["cut"] for g in got]


class Margins(dict):
    """Sum of a word's feature weights in every model."""

    def __init__(self, models: list[Linear]):
        super().__init__()
        self.models = models

    def __missing__(self, word: bytes) -> tuple[float, ...]:
        if len(self) >= KEPT_WORDS:
            self.clear()
        f = list(numbers(word))
        value = self[word] = tuple(float(m.weights[f].sum()) for m in self.models)
        return value


def _scored(shared):
    def run(batches):
        raw, cuts = shared.value
        models = [Linear(*m) for m in raw]
        cache = Margins(models)
        for piece in text_batches(batches):
            texts = piece.column("text").to_pylist()
            sums = np.zeros((len(texts), len(models)))
            for i, t in enumerate(texts):
                found = distinct_words(t)
                if found:
                    sums[i] = np.sum([cache[w] for w in sorted(found)], axis=0)
            earlier = np.zeros((len(texts), 0))
            for c, model in enumerate(models):
                p = sigmoid(sums[:, c] + earlier @ model.chain + model.bias)
                earlier = np.column_stack((earlier, p))
            yield pa.RecordBatch.from_arrays([piece.column("row_key"), piece.column("doc_id"), *(pa.array(earlier[:, c]) for c in range(len(models))),
                                              pa.array(earlier[:, -1] >= cuts[-1])], ["row_key", "doc_id", *(f"p_{c}" for c in CATEGORIES), "is_toxic"])
    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """row_key, doc_id, p_low_quality, p_toxic, is_toxic of every row of ``docs``.

    A chain: the first linear model gives the probability of low quality, the second sees
    it beside the text's features and gives that of toxicity.  Later models are fitted on
    out-of-fold probabilities of earlier ones.  Texts are read whole.

    Null and empty texts have no features and get the chain's bias alone; equal texts get
    equal scores; repeated labels count once, the worst one; without labels nothing is
    toxic; an empty table gives no rows.
    """
    models, cuts = train(docs, labels, sample)
    # plain arrays: a broadcast is read before a worker can import this package
    shared = docs.sparkSession.sparkContext.broadcast(([(m.weights, m.chain, m.bias) for m in models], cuts))
    rows = docs.select(row_key().alias("row_key"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(_scored(shared), "row_key long, doc_id long, " + ", ".join(f"p_{c} double" for c in CATEGORIES) + ", is_toxic boolean")
