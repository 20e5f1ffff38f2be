"""A nonlinear lag-window model: one hidden layer, trained by gradient sums over mini-batches.

The windows stay where they are. A step sends the weights to the tasks, each sums the
gradient of its windows of one mini-batch, the sums are added up by a tree of partial
aggregates, and one row comes to the driver. Its size is that of the model, whatever
the number of windows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ModelConfig
from ..session import stage_table

# Partial sums that one task of the tree adds up.
FAN = 32
# Fixed values of the optimizer and of the plateau rule.
BETA_1, BETA_2, EPSILON = 0.9, 0.999, 1e-7
LEAST_RATE, HALF, LEAST_GAIN = 1e-7, 0.5, 1e-4


@dataclass
class Network:
    """Weights of ``relu((x - mean) / scale · inner + inner_bias) · outer + outer_bias``."""

    mean: np.ndarray
    scale: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    outer: np.ndarray
    outer_bias: np.ndarray

    @property
    def weights(self) -> tuple[np.ndarray, ...]:
        return self.inner, self.inner_bias, self.outer, self.outer_bias

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights])

    def with_flat(self, values: np.ndarray) -> Network:
        parts, at = [], 0
        for w in self.weights:
            parts.append(values[at : at + w.size].reshape(w.shape))
            at += w.size
        return Network(self.mean, self.scale, *parts)

    @classmethod
    def fresh(cls, mean: np.ndarray, scale: np.ndarray, units: int, seed: int) -> Network:
        rng, size = np.random.default_rng(seed), len(mean)
        reach, last = math.sqrt(6 / (size + units)), math.sqrt(6 / (units + 1))
        inner, outer = rng.uniform(-reach, reach, (size, units)), rng.uniform(-last, last, units)
        return cls(mean, scale, inner, np.zeros(units), outer, np.zeros(1))

    def predict(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum(((x - self.mean) / self.scale) @ self.inner + self.inner_bias, 0.0)
        return hidden @ self.outer + self.outer_bias

    def gradient(self, x: np.ndarray, y: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
        """Gradient of the summed squared error by ``flat``, then the error itself and the number of windows.

        ``keep`` are factors of the hidden units, 0 for one that is dropped.
        """
        x = (x - self.mean) / self.scale
        before = x @ self.inner + self.inner_bias
        hidden = np.maximum(before, 0.0)
        hidden = hidden if keep is None else hidden * keep
        error = hidden @ self.outer + self.outer_bias - y
        back = 2 * error[:, None] * self.outer * (before > 0)
        back = back if keep is None else back * keep
        parts = [x.T @ back, back.sum(axis=0), 2 * hidden.T @ error, 2 * error.sum(keepdims=True), (error**2).sum(keepdims=True), [len(y)]]
        return np.concatenate([np.ravel(p) for p in parts])

    def transform(self, sequences: DataFrame) -> DataFrame:
        """``prediction`` next to the columns, out of the windows ``x``."""

        @F.arrow_udf("double")
        def predicted(x: pa.Array) -> pa.Array:
            return pa.array(self.predict(_matrix(x, len(self.mean))))

        return sequences.withColumn("prediction", predicted("x"))

    def save(self, spark: SparkSession, path: str) -> None:
        values = {k: np.asarray(v).tolist() for k, v in vars(self).items()}
        spark.createDataFrame([(json.dumps(values),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Network:
        return cls(**{k: np.array(v, float) for k, v in json.loads(spark.read.text(path).first()["value"]).items()})


@dataclass
class Adam:
    """The published step rule with running moments of the gradient."""

    rate: float
    steps: int = 0
    first: np.ndarray | float = 0.0
    second: np.ndarray | float = 0.0

    def moved(self, weights: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.steps += 1
        self.first = BETA_1 * self.first + (1 - BETA_1) * gradient
        self.second = BETA_2 * self.second + (1 - BETA_2) * gradient**2
        rate = self.rate * math.sqrt(1 - BETA_2**self.steps) / (1 - BETA_1**self.steps)
        return weights - rate * self.first / (np.sqrt(self.second) + EPSILON)


@dataclass
class Schedule:
    """Stops after ``patience`` epochs without a better loss; halves the rate after ``plateau`` without a clear gain."""

    patience: int
    plateau: int
    best: float = math.inf
    best_at: int = -1
    waited: int = 0
    level: float = math.inf
    flat_for: int = 0
    kept: object = field(default=None, repr=False)

    def seen(self, epoch: int, loss: float, rate: float, weights: object) -> tuple[float, bool]:
        """The rate of the next epoch, and whether there is one."""
        if loss < self.best:
            self.best, self.best_at, self.waited, self.kept = loss, epoch, 0, weights
        else:
            self.waited += 1
        if loss < self.level - LEAST_GAIN:
            self.level, self.flat_for = loss, 0
        else:
            self.flat_for += 1
            if self.flat_for >= self.plateau:
                rate, self.flat_for = max(LEAST_RATE, rate * HALF), 0
        return rate, self.waited < self.patience


def _matrix(x: pa.Array, size: int) -> np.ndarray:
    return np.asarray(x.flatten(), np.float64).reshape(len(x), size)


def _gradients(held, size: int, dropout: float, seed: int, step: int):
    """Task side: one row, the sums of this task's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network: Network = held.value
        part = TaskContext.get().partitionId()
        rng = np.random.default_rng([seed, step, part])
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _matrix(batch.column("x"), size), np.asarray(batch.column("yt"), np.float64)
            keep = (rng.random((len(y), len(network.outer))) >= dropout) / (1 - dropout) if dropout else None
            sums = network.gradient(x, y, keep)
            total = sums if total is None else total + sums
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part % FAN], pa.int32()), pa.array([total])], names=["part", "sums"])

    return run


def _losses(held, size: int):
    """Task side: summed squared error and number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _matrix(batch.column("x"), size), np.asarray(batch.column("yt"), np.float64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([float(((held.value.predict(x) - y) ** 2).sum())]), pa.array([len(y)], pa.int64())], names=["error", "n"]
            )

    return run


def _added(parts: DataFrame, parallel: int) -> np.ndarray | None:
    """The sums of all tasks, through partial aggregates of ``FAN`` groups where many tasks make them."""
    sums = parts.select("part", array_to_vector("sums").alias("sums"))
    if parallel > FAN:
        sums = sums.groupBy("part").agg(Summarizer.sum(F.col("sums")).alias("sums"))
    total = sums.agg(Summarizer.sum(F.col("sums")).alias("sums"), F.count("*").alias("n")).first()
    return total["sums"].toArray() if total["n"] else None


def fit_network(sequences: DataFrame, config: ModelConfig, size: int) -> tuple[Network, list[tuple[int, str, float]]]:
    """A network trained on windows labelled ``split`` train and val, and its history by epoch.

    An epoch takes ``sequence_batches`` steps; a window's mini-batch is a hash of its key
    and date, and the windows are written once by mini-batch, so a step reads its own
    only. The loss of the val windows, or without any the training loss, decides when the
    rate is halved and when training ends; the weights of the best epoch stay. A step
    lost with its executor is taken again on the same windows.
    """
    spark = sequences.sparkSession
    names = [c for c in ("group_id", "series_id", "ds", "step") if c in sequences.columns]
    batch = F.pmod(F.xxhash64(*names), F.lit(config.sequence_batches)).cast("int")
    kept = sequences.where(F.col("split").isin("train", "val") & F.col("yt").isNotNull())
    rows = stage_table(kept.select("x", F.col("yt").cast("double").alias("yt"), "split", batch.alias("batch")), "windows", by=("split", "batch"))
    train, val = (rows.where(F.col("split") == split) for split in ("train", "val"))
    if train.isEmpty():
        raise ValueError("No training windows")
    x = array_to_vector(F.col("x").cast("array<double>"))
    about = train.agg(Summarizer.metrics("mean", "std").summary(x).alias("x")).first()["x"]
    scale = about["std"].toArray()
    network = Network.fresh(about["mean"].toArray(), np.where(scale > 1e-12, scale, 1.0), config.sequence_units, config.random_state)
    has_val = not val.isEmpty()
    parallel = spark.sparkContext.defaultParallelism
    adam, schedule = Adam(config.sequence_learning_rate), Schedule(config.early_stopping_patience, config.reduce_lr_patience)
    history: list[tuple[int, str, float]] = []
    step = 0
    for epoch in range(config.sequence_epochs):
        error = count = 0.0
        for number in range(config.sequence_batches):
            held = spark.sparkContext.broadcast(network)
            task = _gradients(held, size, config.sequence_dropout, config.random_state, step)
            some = train.where(F.col("batch") == number).select("x", "yt")
            sums = _added(some.mapInArrow(task, "part int, sums array<double>"), parallel)
            held.destroy()
            step += 1
            if sums is None:
                continue
            error, count = error + sums[-2], count + sums[-1]
            network = network.with_flat(adam.moved(network.flat(), sums[:-2] / sums[-1]))
        loss = error / count
        history += [(epoch, "loss", float(loss)), (epoch, "learning_rate", adam.rate)]
        if has_val:
            held = spark.sparkContext.broadcast(network)
            seen = val.select("x", "yt").mapInArrow(_losses(held, size), "error double, n long").agg(F.sum("error"), F.sum("n")).first()
            held.destroy()
            loss = seen[0] / seen[1]
            history.append((epoch, "val_loss", float(loss)))
        adam.rate, more = schedule.seen(epoch, loss, adam.rate, network)
        if not more:
            break
    return schedule.kept, history


def rolled(network: Network, length: int, width: int, compat_roll: bool):
    """Task side: forecasts of many series at once, each fed back into its window.

    A row has a flat ``window`` and ``ahead``, its steps' dates and calendar inputs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            window = _matrix(batch.column("window"), length * width).reshape(-1, length, width).copy()
            ahead = batch.column("ahead")
            many = np.diff(ahead.offsets.to_numpy())
            cells = ahead.flatten()
            begin = np.cumsum(many) - many
            z = np.asarray(cells.field("z").flatten(), np.float64).reshape(len(cells), width - 1)
            made = np.empty(len(cells))
            for step in range(int(many.max(initial=0))):
                live = np.flatnonzero(many > step)
                # As the training windows had them: in single precision.
                value = network.predict(window[live].reshape(len(live), -1))
                made[begin[live] + step] = value
                fresh = window[live, 0].copy() if compat_roll else np.column_stack([value, z[begin[live] + step]])
                fresh[:, 0] = value.astype(np.float32)
                window[live] = np.concatenate([window[live, 1:], fresh[:, None]], axis=1)
            owner = pa.array(np.repeat(np.arange(batch.num_rows), many))
            keys = [batch.column(c).take(owner) for c in ("group_id", "series_id")]
            yield pa.RecordBatch.from_arrays([*keys, cells.field("ds"), pa.array(made)], names=["group_id", "series_id", "ds", "yhat"])

    return run
