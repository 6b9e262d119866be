"""Networks fitted by passes over packed rows.

The rows are packed once into blocks of numbers, a few megabytes each at most, and kept by the
executors. Rows that come as arrays are packed as they are made and standardised in their blocks. A pass hands out the weights, every task takes the loss and its gradient over
its blocks by matrix products, and one gradient per task comes back; the driver holds weights only.
Products inside a tile are in single precision, sums over tiles in double.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import Estimator
from pyspark.ml.classification import (
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import StandardScaler, StandardScalerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TILE = 1024
# Steps that the optimiser keeps to estimate the curvature, and losses it looks back on to tell that it stands still.
_MEMORY = 10
_LOOK_BACK = 20


def start_weights(layers: Sequence[int], seed: int) -> np.ndarray:
    """Uniform weights, smaller where more units come in."""
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.uniform(-2.4, 2.4, (n + 1) * m) / n for n, m in zip(layers, layers[1:])])


def _layers_of(weights: np.ndarray, layers: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights (in, out) and biases (out, 1) of every layer, in the order Spark's networks hold them."""
    parts, at = [], 0
    for n, m in zip(layers, layers[1:]):
        w, b = weights[at : at + n * m].reshape(n, m), weights[at + n * m : at + (n + 1) * m].reshape(m, 1)
        parts.append((w, b))
        at += (n + 1) * m
    return parts


def _forward(x: np.ndarray, parts) -> tuple[list[np.ndarray], np.ndarray]:
    """The values that go into every layer, and the class scores less the largest; rows are columns."""
    values = [x]
    for w, b in parts[:-1]:
        z = w.T @ values[-1]
        z += b
        np.negative(z, out=z)
        np.exp(z, out=z)
        z += 1
        values.append(np.reciprocal(z, out=z))
    w, b = parts[-1]
    z = w.T @ values[-1]
    z += b
    z -= z.max(0)
    return values, z


def _tile(x: np.ndarray, y: np.ndarray, parts) -> tuple[float, list[np.ndarray]]:
    """Loss of rows and its gradient, layer by layer."""
    values, z = _forward(x, parts)
    own = (y, np.arange(len(y)))
    p = np.exp(z)
    total = p.sum(0)
    loss = (np.log(total) - z[own]).sum(dtype=np.float64)
    p /= total
    p[own] -= 1
    grads: list[np.ndarray] = []
    delta = p
    for depth in range(len(parts) - 1, -1, -1):
        a = values[depth]
        grads = [(a @ delta.T).ravel(), delta.sum(1), *grads]
        if depth:
            delta = parts[depth][0] @ delta
            delta *= a
            delta *= 1 - a
    return float(loss), grads


def _loss_and_gradient(weights: np.ndarray, layers: Sequence[int]):
    """Rows, summed loss and summed gradient of the blocks of a task."""

    def run(blocks: Iterator[tuple[np.ndarray, np.ndarray]]):
        parts = _layers_of(weights.astype(np.float32), layers)
        count, loss, gradient = 0, 0.0, np.zeros(len(weights))
        with np.errstate(over="ignore"):
            for x, y in blocks:
                for low in range(0, len(y), _TILE):
                    own, grads = _tile(x[:, low : low + _TILE].astype(np.float32), y[low : low + _TILE], parts)
                    loss += own
                    gradient += np.concatenate(grads)
                count += len(y)
        yield count, loss, gradient

    return run


def _measures(weights: np.ndarray, layers: Sequence[int]):
    """Rows, summed loss and number of right classes of the blocks of a task, in the precision they are kept in."""

    def run(blocks: Iterator[tuple[np.ndarray, np.ndarray]]):
        count, loss, right = 0, 0.0, 0
        with np.errstate(over="ignore"):
            for x, y in blocks:
                parts = _layers_of(weights.astype(x.dtype), layers)
                for low in range(0, len(y), _TILE):
                    labels = y[low : low + _TILE]
                    p = np.exp(_forward(np.ascontiguousarray(x[:, low : low + _TILE]), parts)[1])
                    p /= p.sum(0)
                    own = np.maximum(p[labels, np.arange(len(labels))], 1e-15)
                    loss -= float(np.log(own).sum(dtype=np.float64))
                    right += int((p.argmax(0) == labels).sum())
                count += len(y)
        yield count, loss, right

    return run


def loss_and_accuracy(blocks: RDD, layers: Sequence[int], weights: np.ndarray) -> tuple[float, float]:
    """The figures of ``classifier_metrics`` over packed rows, in one pass."""
    sums = blocks.mapPartitions(_measures(weights, layers)).collect()
    count = sum(n for n, _, _ in sums)
    return sum(loss for _, loss, _ in sums) / count, sum(right for _, _, right in sums) / count


def _pack(classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            if np.isnan(x).any():
                raise ValueError("a feature is NULL or not a number")
            y = batch.column(1).to_numpy(zero_copy_only=False)
            if not np.all((y >= 0) & (y < classes) & (y == np.floor(y))):
                raise ValueError(f"a label is not one of the classes 0..{classes - 1}")
            cells = [np.ascontiguousarray(x.T).tobytes()], [y.astype(np.int32).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in cells], ["x", "y"])

    return run


def _unpack(precision: str):
    def run(row) -> tuple[np.ndarray, np.ndarray]:
        y = np.frombuffer(row.y, np.int32)
        return np.frombuffer(row.x, precision).reshape(-1, len(y)), y

    return run


def packed(rows: DataFrame, label: str, classes: int, precision: str = "float32") -> RDD:
    """Blocks of the column ``features`` and the label, kept until ``unpersist``.

    Only what is measured as well needs to be kept as ``float64``.
    """
    cells = rows.select(vector_to_array("features", precision).alias("x"), F.col(label).cast("double").alias("y"))
    return _packed_cells(cells, classes, precision)


def _packed_cells(cells: DataFrame, classes: int, precision: str) -> RDD:
    blocks = cells.mapInArrow(_pack(classes), "x binary, y binary").rdd.map(_unpack(precision))
    return blocks.persist(StorageLevel.MEMORY_AND_DISK)


def _moments(blocks: Iterator[tuple[np.ndarray, np.ndarray]]):
    """Rows, mean and summed squares around it of every feature in the blocks of a task."""
    total = 0, 0.0, 0.0
    for x, y in blocks:
        mean = x.mean(1)
        total = _merged(total, (len(y), mean, ((x - mean[:, None]) ** 2).sum(1)))
    yield total


def _merged(a, b):
    count = a[0] + b[0]
    if not b[0]:
        return a
    off = b[1] - a[1]
    return count, a[1] + off * (b[0] / count), a[2] + b[2] + off * off * (a[0] * b[0] / count)


def scaler_of(spark: SparkSession, blocks: RDD) -> StandardScalerModel:
    """Spark's scaler of packed rows, from their means and deviations taken in one pass.

    It is fitted on two rows that have this mean and this deviation.
    """
    total = 0, 0.0, 0.0
    for part in blocks.mapPartitions(_moments).collect():  # one entry per task
        total = _merged(total, part)
    count, mean, squares = total
    if not count:
        raise ValueError("no rows to learn from")
    half = np.sqrt(squares / max(count - 1, 1) / 2)
    rows = spark.createDataFrame([(Vectors.dense(mean - half),), (Vectors.dense(mean + half),)], ["raw"])
    return StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(rows)


def _standardised(mean: np.ndarray, std: np.ndarray):
    factor = np.divide(1.0, std, out=np.zeros_like(std), where=std != 0)[:, None]

    def run(block: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return ((block[0] - mean[:, None]) * factor).astype(np.float32), block[1]

    return run


def mean_loss(blocks: RDD, layers: Sequence[int]) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """Mean loss and its gradient at given weights, one pass per call."""

    def at(weights: np.ndarray) -> tuple[float, np.ndarray]:
        # One entry per task, in their order, so that the sums are the same on every run.
        sums = blocks.mapPartitions(_loss_and_gradient(weights, layers)).collect()
        count = sum(n for n, _, _ in sums)
        if not count:
            raise ValueError("no rows to learn from")
        return sum(loss for _, loss, _ in sums) / count, np.sum([g for _, _, g in sums], axis=0) / count

    return at


def _step_length(phi, start: tuple[float, float], first: float):
    """A step that lowers the loss enough and flattens its slope (strong Wolfe rules); None if none is found."""
    value0, slope0 = start

    def between(a, b):
        (ta, fa, da), (tb, fb, db) = a[:3], b[:3]
        d1 = da + db - 3 * (fa - fb) / (ta - tb)
        root = d1 * d1 - da * db
        if root < 0:
            return (ta + tb) / 2
        d2 = np.sqrt(root)
        below = db - da + 2 * d2
        t = tb - (tb - ta) * (db + d2 - d1) / below if below else (ta + tb) / 2
        return min(max(t, ta + 0.1 * (tb - ta)), ta + 0.9 * (tb - ta))

    def zoom(low, high):
        for _ in range(10):
            c = phi(between(*sorted((low, high), key=lambda p: p[0])))
            if c[1] > value0 + 1e-4 * c[0] * slope0 or c[1] >= low[1]:
                high = c
            else:
                if abs(c[2]) <= 0.9 * abs(slope0):
                    return c
                if c[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        return None

    low, t = (0.0, value0, slope0), first
    for number in range(10):
        c = phi(t)
        if not np.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > value0 + 1e-4 * t * slope0 or (c[1] >= low[1] and number):
            return zoom(low, c)
        if abs(c[2]) <= 0.9 * abs(slope0):
            return c
        if c[2] >= 0:
            return zoom(c, low)
        low, t = c, t * 1.5
    return None


def minimise(
    loss: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, max_iter: int, tol: float = 1e-6
) -> tuple[np.ndarray, int]:
    """Limited-memory BFGS: the weights and the number of iterations.

    Ends after ``max_iter``, when the loss has fallen by less than ``tol`` of the first one over the
    last 20 iterations, when the gradient is as small beside the loss, or when no step lowers the loss.
    """
    value, gradient = loss(x)
    scale, losses, steps, done = abs(value), [value], [], 0
    while done < max_iter and np.linalg.norm(gradient) > max(tol * abs(value), 1e-8):
        direction, kept = gradient.copy(), []
        for s, g in reversed(steps):
            a = (s @ direction) / (s @ g)
            direction -= a * g
            kept.append(a)
        if steps:
            s, g = steps[-1]
            direction *= (s @ g) / (g @ g)
        for (s, g), a in zip(steps, reversed(kept)):
            direction += (a - (g @ direction) / (s @ g)) * s
        direction = -direction

        def phi(t: float):
            f, g = loss(x + t * direction)
            return t, f, float(g @ direction), g

        slope = float(gradient @ direction)
        first = 1.0 if done else 1.0 / np.linalg.norm(direction)
        found = _step_length(phi, (value, slope), first) if slope < 0 else None
        if found is None:
            if not steps:
                break
            steps = []
            continue
        t, value, _, after = found
        step, change = t * direction, after - gradient
        x, gradient, done = x + step, after, done + 1
        if step @ change > 0:
            steps = [*steps, (step, change)][-_MEMORY:]
        if max(losses[-_LOOK_BACK:]) - value <= tol * scale:
            break
        losses.append(value)
    return x, done


def network_model(
    spark: SparkSession, weights: np.ndarray, layers: Sequence[int], label: str
) -> MultilayerPerceptronClassificationModel:
    """Spark's network with these weights: fitted for no iteration from them, on one row."""
    row = spark.createDataFrame([(Vectors.dense([0.0] * layers[0]), 0.0)], ["features", label])
    shape = MultilayerPerceptronClassifier(layers=list(layers), labelCol=label, maxIter=0)
    return shape.setInitialWeights(Vectors.dense(weights)).fit(row)


class NetworkClassifier(Estimator):
    """Feed-forward network on the column ``features``, as a stage of a pipeline.

    Sigmoid units, class probabilities, log loss. Gives Spark's own network model.
    """

    def __init__(self, layers: Sequence[int], label: str, max_iter: int, seed: int):
        super().__init__()
        self.layers, self.label, self.max_iter, self.seed = list(layers), label, max_iter, seed

    def _fit(self, dataset: DataFrame) -> MultilayerPerceptronClassificationModel:
        blocks = packed(dataset, self.label, self.layers[-1])
        try:
            return self._fit_blocks(dataset.sparkSession, blocks)
        finally:
            blocks.unpersist()

    def _fit_blocks(self, spark: SparkSession, blocks: RDD) -> MultilayerPerceptronClassificationModel:
        start = start_weights(self.layers, self.seed)
        weights, _ = minimise(mean_loss(blocks, self.layers), start, self.max_iter)
        return network_model(spark, weights, self.layers, self.label)

    def fit_scaled(
        self, vectors: DataFrame, column: str = "vec"
    ) -> tuple[StandardScalerModel, MultilayerPerceptronClassificationModel]:
        """The scaler and the network of rows whose features are an array; the rows are made once."""
        spark = vectors.sparkSession
        cells = vectors.select(F.col(column).cast("array<double>"), F.col(self.label).cast("double"))
        raw = _packed_cells(cells, self.layers[-1], "float64")
        blocks = None
        try:
            scaler = scaler_of(spark, raw)
            scale = _standardised(scaler.mean.toArray(), scaler.std.toArray())
            # Every pass costs something per part, whatever its rows: no more parts than cores.
            blocks = raw.coalesce(spark.sparkContext.defaultParallelism).map(scale).persist(StorageLevel.MEMORY_AND_DISK)
            blocks.count()
            raw.unpersist()
            return scaler, self._fit_blocks(spark, blocks)
        finally:
            raw.unpersist()
            if blocks is not None:
                blocks.unpersist()
