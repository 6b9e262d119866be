"""Quality classifier: random-indexing word vectors pooled per document, and a small network."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The word table has a fixed size: words share BUCKETS rows by hash, each of DIMS numbers.
BUCKETS = 1 << 14
DIMS = 64
MARKS = 4
REACH = 2
SMOOTH = 1e-3
# Labelled rows the network is fitted on, at most: those of the smallest hash of their id.
SAMPLE = 20_000
HIDDEN = 32
EPOCHS = 40
_TOKENS = 100_000
_KNOWN = 200_000

_TOKEN = re.compile(r"\w+|[^\w\s]")


class Vocabulary(dict):
    """Bucket of each token; forgets all it knows when it has grown too large."""

    def __missing__(self, token: str) -> int:
        if len(self) >= _KNOWN:
            self.clear()
        bucket = self[token] = zlib.crc32(token.encode("utf-8", "surrogatepass")) % BUCKETS
        return bucket


def index_marks() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the few marks in each bucket's index vector, drawn once by seed."""
    rng = np.random.default_rng(12345)
    places = rng.permuted(np.tile(np.arange(DIMS), (BUCKETS, 1)), axis=1)[:, :MARKS]
    signs = np.tile(np.array([1.0, -1.0] * (MARKS // 2)), (BUCKETS, 1))
    return places, signs


def _token_blocks(texts: Iterator[str | None], known: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and running document numbers of many tokens at a time, in order."""
    words: list[int] = []
    owners: list[np.ndarray] = []
    for number, text in enumerate(texts):
        own = [known[t] for t in _TOKEN.findall(text or "")]
        words += own
        owners.append(np.full(len(own), number))
        if len(words) >= _TOKENS:
            yield np.array(words), np.concatenate(owners)
            words, owners = [], []
    if words:
        yield np.array(words), np.concatenate(owners)


def _accumulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of the index vectors of each bucket's neighbours, over all texts of a task."""
    places, signs = index_marks()
    known = Vocabulary()
    total = np.zeros(BUCKETS * DIMS)
    seen = np.zeros(BUCKETS, np.int64)
    texts = (text for batch in batches for text in batch["text"])
    for words, owners in _token_blocks(texts, known):
        seen += np.bincount(words, minlength=BUCKETS)
        for step in range(1, REACH + 1):
            same = owners[step:] == owners[:-step]
            left, right = words[:-step][same], words[step:][same]
            for center, context in ((left, right), (right, left)):
                cells = center[:, None] * DIMS + places[context]
                total += np.bincount(cells.ravel(), signs[context].ravel(), BUCKETS * DIMS)
    rows = np.flatnonzero(seen)
    table = total.astype(np.int64).reshape(BUCKETS, DIMS)[rows]
    out = pd.DataFrame(table, columns=[f"v{k}" for k in range(DIMS)])
    out.insert(0, "seen", seen[rows])
    out.insert(0, "bucket", rows)
    yield out


@dataclass
class Words:
    """Unit vectors of the buckets and their weights in a pool, less for frequent words."""

    vectors: np.ndarray
    weights: np.ndarray


def learn_words(docs: DataFrame, text_col: str = "text") -> Words:
    """Word vectors from all documents: what stands within two tokens of a word, in index vectors.

    Every task adds up whole numbers in a table of fixed size, and the sums of these tables do
    not depend on their order. The table (16,384 by 64 numbers) comes to the driver.
    """
    columns = [f"v{k}" for k in range(DIMS)]
    schema = ", ".join(f"{c} long" for c in ["bucket", "seen", *columns])
    parts = docs.select(F.col(text_col).alias("text")).mapInPandas(_accumulate, schema)
    sums = parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ["seen", *columns]]).toPandas()
    vectors = np.zeros((BUCKETS, DIMS), np.float32)
    weights = np.zeros(BUCKETS, np.float32)
    if len(sums):
        rows = sums["bucket"].to_numpy()
        found = sums[columns].to_numpy(np.float64)
        vectors[rows] = found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)
        share = sums["seen"].to_numpy() / max(sums["seen"].sum(), 1)
        weights[rows] = SMOOTH / (SMOOTH + share)
    return Words(vectors, weights)


FEATURES = DIMS + 5


def pooled(texts: list[str | None], words: Words, known: Vocabulary) -> np.ndarray:
    """Per text: weighted mean of its word vectors, and how far it agrees with itself.

    The added figures are the mean's length, the mean weight, the mean likeness of words one
    and two apart, and the logarithm of the number of tokens. An empty text is all zeros.
    """
    out = np.zeros((len(texts), FEATURES), np.float32)
    totals = np.zeros((len(texts), DIMS))
    counts, weighed, pairs = (np.zeros(len(texts)) for _ in range(3))
    likeness = np.zeros((2, len(texts)))
    for tokens, owners in _token_blocks(iter(texts), known):
        vectors = words.vectors[tokens]
        weights = words.weights[tokens]
        starts = np.flatnonzero(np.diff(owners, prepend=-1))
        own = owners[starts]
        totals[own] += np.add.reduceat(vectors * weights[:, None], starts, axis=0)
        counts[own] += np.add.reduceat(np.ones(len(tokens)), starts)
        weighed[own] += np.add.reduceat(weights, starts)
        for step in (1, 2):
            same = owners[step:] == owners[:-step]
            alike = np.einsum("ij,ij->i", vectors[step:], vectors[:-step])[same]
            likeness[step - 1] += np.bincount(owners[step:][same], alike, len(texts))
    some = counts > 0
    means = totals[some] / np.maximum(weighed[some], 1e-9)[:, None]
    out[some, :DIMS] = means
    out[some, DIMS] = np.linalg.norm(means, axis=1)
    out[some, DIMS + 1] = weighed[some] / counts[some]
    out[some, DIMS + 2] = likeness[0][some] / counts[some]
    out[some, DIMS + 3] = likeness[1][some] / counts[some]
    out[some, DIMS + 4] = np.log1p(counts[some]) / 10
    return out


@dataclass
class Network:
    """Two layers; the output is divided by a temperature before it becomes a probability."""

    center: np.ndarray
    scale: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    outer: np.ndarray
    outer_bias: float
    temperature: float = 1.0

    def logits(self, features: np.ndarray) -> np.ndarray:
        hidden = np.maximum((features - self.center) / self.scale @ self.inner + self.inner_bias, 0)
        return hidden @ self.outer + self.outer_bias

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(features) / self.temperature, -30, 30)))


def _log_loss(logits: np.ndarray, labels: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - labels * logits))


def _calibrated(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss on rows that were not fitted."""
    candidates = np.exp(np.linspace(np.log(0.25), np.log(8), 200))
    return float(min(candidates, key=lambda t: _log_loss(logits / t, labels)))


def fit_network(features: np.ndarray, labels: np.ndarray, seed: int = 7) -> Network:
    """Adam on the log loss over four fifths of the rows, the temperature from the rest.

    Without rows of both labels the score is the smoothed share of label 1.
    """
    center, scale = features.mean(axis=0) if len(features) else np.zeros(FEATURES), np.ones(FEATURES)
    share = (labels.sum() + 1) / (len(labels) + 2)
    if len(set(labels.tolist())) < 2:
        flat = np.zeros((FEATURES, 1))
        return Network(center, scale, flat, np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    scale = np.maximum(features.std(axis=0), 1e-4)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(features))
    held = order[: len(order) // 5]
    own = order[len(order) // 5 :]
    x, y = (features[own] - center) / scale, labels[own]
    weights = [
        rng.normal(0, np.sqrt(2 / FEATURES), (FEATURES, HIDDEN)),
        np.zeros(HIDDEN),
        rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN),
        np.array(np.log(share / (1 - share))),
    ]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    steps = 0
    for _ in range(EPOCHS):
        for block in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
            a, b = x[block], y[block]
            hidden = np.maximum(a @ weights[0] + weights[1], 0)
            error = (1 / (1 + np.exp(-np.clip(hidden @ weights[2] + weights[3], -30, 30))) - b) / len(block)
            back = error[:, None] * weights[2] * (hidden > 0)
            slopes = [a.T @ back + 1e-4 * weights[0], back.sum(axis=0), hidden.T @ error, error.sum()]
            steps += 1
            for k, slope in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope**2
                move = first[k] / (1 - 0.9**steps) / (np.sqrt(second[k] / (1 - 0.999**steps)) + 1e-8)
                weights[k] = weights[k] - 2e-3 * move
    network = Network(center, scale, weights[0], weights[1], weights[2], float(weights[3]))
    if len(held):
        network.temperature = _calibrated(network.logits(features[held]), labels[held])
    return network


def held_out(id_col: str = "doc_id"):
    """Whether a document's label is kept from the fit: crc32 of its id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """(text, label) of at most ``limit`` labelled rows outside the held-out fifth.

    They are those of the smallest hash of their id. Null labels and ids are left out.
    """
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    chosen = (
        usable.select("doc_id", F.col("quality").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(limit)
    )
    # At most ``limit`` rows of two numbers.
    return docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")


@dataclass
class Classifier:
    words: Words
    network: Network

    def scores(self, texts: list[str | None], known: Vocabulary) -> np.ndarray:
        return self.network.scores(pooled(texts, self.words, known))


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Classifier:
    """Word vectors over all documents, then the network on a bounded sample of labelled ones."""
    words = learn_words(docs)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Vocabulary()
        for batch in batches:
            rows = pooled(list(batch["text"]), shared.value, known)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "features": list(rows), "label": batch["label"]})

    sample = labelled_sample(docs.select("doc_id", "text"), labels, limit)
    rows = sample.mapInPandas(features, "doc_id long, features array<float>, label int").toPandas()
    rows = rows.sort_values(["doc_id", "label"], kind="stable")
    matrix = np.array(rows["features"].tolist(), np.float64).reshape(len(rows), FEATURES)
    return Classifier(words, fit_network(matrix, rows["label"].to_numpy(np.float64)))


def score(docs: DataFrame, classifier: Classifier, cut: float = 0.3, text_col: str = "text") -> DataFrame:
    """The columns of ``docs``, ``score`` and ``predicted``; null and empty texts have a score too.

    Columns of those names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Vocabulary()
        for texts in batches:
            values = list(texts)
            parts = [shared.value.scores(values[k : k + 500], known) for k in range(0, len(values), 500)]
            yield pd.Series(np.concatenate(parts) if parts else np.empty(0))

    scored = docs.drop("score", "predicted").withColumn("score", of(F.col(text_col)))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))
