"""The lag-window forecaster: one model over the windows of all series.

A regression from the flattened window to the next value, trained on the windows of
every series together. 'linear' is a ridge solved in one pass over the data; 'gbt' are
boosted trees that stop early on the val windows; 'network' has a hidden layer and is
trained in epochs, with early stopping and a falling rate (see ``network``).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..config import ModelConfig
from ..functions.arrays import dot, literal_array
from ..functions.calendar import calendar_columns, cycle_columns
from ..operators.metrics import MAPE_FLOOR
from ..operators.windows import with_step
from ..schema import CALENDAR_FEATURES, KEYS
from .network import Network, fit_network, rolled
from .trees import Ensemble, compile_trees

MODEL_NAME = "sequence"


@dataclass
class SequenceModel:
    """A fitted regression with the shape of its windows, and its ``training_history``."""

    model: LinearRegressionModel | GBTRegressionModel | Ensemble | Network
    kind: str
    length: int
    features: list[str]
    direct: bool = False
    history: DataFrame | None = None

    @property
    def size(self) -> int:
        """Numbers in a flattened window."""
        return (self.length + self.direct) * len(self.features)

    def coefficients(self) -> tuple[list[list[float]], float]:
        """Weights as rows of a window (oldest first), and the intercept."""
        if self.kind != "linear":
            raise ValueError("Only the linear model has coefficients")
        flat, width = list(self.model.coefficients), len(self.features)
        return [flat[i * width : (i + 1) * width] for i in range(self.length)], float(self.model.intercept)


def vectors(sequences: DataFrame, size: int) -> DataFrame:
    """Windows as ml vectors; ``yt`` as the double label.

    The size is stated as column metadata. Otherwise a fit looks it up in the
    first row, a job that shuffles the input once more.
    """
    sized = array_to_vector(F.col("x").cast("array<double>")).alias("features", metadata={"ml_attr": {"num_attrs": size}})
    return sequences.select("*", sized, F.col("yt").cast("double").alias("label"))


def fit_sequence(
    sequences: DataFrame, config: ModelConfig = ModelConfig(), features: list[str] | None = None
) -> SequenceModel:
    """Train on windows labelled ``split`` train and val (see ``split_sequences``).

    Without val windows the training loss decides. Windows that carry a ``step``
    make a direct model.
    """
    inputs = features or ["y", *CALENDAR_FEATURES]
    direct = "step" in sequences.columns
    size = (config.sequence_length + direct) * len(inputs)
    ready = vectors(sequences.where(F.col("split").isin("train", "val")), size).select("features", "label", "split")
    if config.sequence_kind == "linear":
        # Normal equations: one pass, and the state is features², not data.
        solver = LinearRegression(
            solver="normal", regParam=config.sequence_reg, elasticNetParam=0.0, aggregationDepth=3
        )
        model = solver.fit(ready.where(F.col("split") == "train"))
        return _with_history(SequenceModel(model, "linear", config.sequence_length, inputs, direct), sequences)
    if config.sequence_kind == "gbt":
        flagged = ready.withColumn("is_val", F.col("split") == "val")
        trees = GBTRegressor(
            maxIter=config.sequence_max_iter, maxDepth=5, stepSize=0.1, seed=config.random_state, cacheNodeIds=True
        )
        has_val = not flagged.where("is_val").select("is_val").isEmpty()
        model = (trees.setValidationIndicatorCol("is_val") if has_val else trees).fit(flagged)
        return _with_history(SequenceModel(model, "gbt", config.sequence_length, inputs, direct), sequences)
    if config.sequence_kind == "network":
        network, losses = fit_network(sequences, config, size)
        history = sequences.sparkSession.createDataFrame(losses, "iteration int, metric string, value double")
        return SequenceModel(network, "network", config.sequence_length, inputs, direct, history)
    raise ValueError(f"Unknown sequence model: {config.sequence_kind}. Known: ['linear', 'gbt', 'network']")


def _with_history(model: SequenceModel, sequences: DataFrame) -> SequenceModel:
    return replace(model, history=training_history(model, sequences))


def sequence_errors(split_df: DataFrame, sequences: DataFrame) -> DataFrame:
    """Series without a single training window."""
    trained = sequences.where(F.col("split") == "train").select(*KEYS).distinct()
    message = "Too short for a training window"
    return (
        split_df.select(*KEYS)
        .distinct()
        .join(trained, KEYS, "left_anti")
        .select(*KEYS, F.lit(MODEL_NAME).alias("model"), F.lit("fit").alias("stage"), F.lit(message).alias("error"))
    )


def predict_sequence_batch(model: SequenceModel | None, sequences: DataFrame) -> DataFrame:
    """One-step forecast of every window."""
    if model is None:
        raise ValueError("Model not trained")
    kept = [c for c in ("split", "length") if c in sequences.columns]
    if model.direct and "step" not in sequences.columns:
        sequences = sequences.withColumn("x", with_step(F.col("x"), F.lit(1), len(model.features)))
    scored = _scored(model, sequences)
    return scored.select(*KEYS, "ds", *kept, F.col("label").alias("y"), F.col("prediction").alias("yhat"))


def _scored(model: SequenceModel, sequences: DataFrame) -> DataFrame:
    """``prediction`` and ``label`` of every window."""
    if model.kind == "network":
        return model.model.transform(sequences.withColumn("label", F.col("yt").cast("double")))
    return model.model.transform(vectors(sequences, model.size))


def loss_metrics(scored: DataFrame) -> DataFrame:
    """The losses a trained network reports on a test set, per series.

    test_mape divides by at least a small constant instead of leaving zeros out.
    """
    error = F.col("y") - F.col("yhat")
    floor = F.greatest(F.abs("y"), F.lit(MAPE_FLOOR))
    return scored.groupBy(*KEYS).agg(
        F.avg(error * error).alias("test_loss"),
        F.avg(F.abs(error)).alias("test_mae"),
        (F.avg(F.abs(error) / floor) * 100).alias("test_mape"),
    )


def training_history(model: SequenceModel, sequences: DataFrame) -> DataFrame:
    """history(iteration, metric, value): loss by iteration, val_loss where there is one.

    A linear model is solved in one step, so it has a single iteration. That of a
    network is what its training saw, by epoch, with the rate.
    """
    if model.kind == "network":
        return model.history
    spark = sequences.sparkSession
    ready = vectors(sequences.where(F.col("split").isin("train", "val")), model.size)
    if model.kind == "linear":
        error = F.col("label") - F.col("prediction")
        losses = model.model.transform(ready).groupBy("split").agg(F.avg(error * error).alias("value"))
        metric = F.when(F.col("split") == "train", "loss").otherwise("val_loss")
        return losses.select(F.lit(0).alias("iteration"), metric.alias("metric"), "value")
    rows = []
    for split, metric in (("train", "loss"), ("val", "val_loss")):
        part = ready.where(F.col("split") == split)
        if not part.select("split").isEmpty():
            # One value per tree: as many as the settings allow iterations.
            losses = model.model.evaluateEachIteration(part, "squared")
            rows += [(i, metric, float(v)) for i, v in enumerate(losses)]
    return spark.createDataFrame(rows, "iteration int, metric string, value double")


def final_metrics(history: DataFrame) -> DataFrame:
    """Last value of each metric."""
    return history.groupBy("metric").agg(F.max_by("value", "iteration").alias("value"))


def recursive_path(window: Column, drift: Column, weights: Column, length: int) -> Column:
    """A linear autoregression run forward, as one expression.

    ``window`` are the last ``length`` values, oldest first; step i is
    ``drift[i]`` plus ``weights`` on the ``length`` values before it, forecasts
    included. Returns the forecasts.
    """
    return F.aggregate(
        drift,
        window,
        lambda path, constant: F.concat(path, F.array(constant + dot(F.slice(path, -length, length), weights))),
        lambda path: F.slice(path, F.lit(length + 1), F.size(drift)),
    )


def last_rows(df: DataFrame, length: int, fields: dict[str, Column], lengths: DataFrame | None) -> DataFrame:
    """The last rows of each series, oldest first, as an array of structs ``rows``.

    ``length`` of them, or as many as ``lengths`` says. Only those rows are
    gathered: the row limit is applied before the shuffle as well.
    """
    newest = Window.partitionBy(*KEYS).orderBy(F.col("ds").desc())
    kept = df.withColumn("__r", F.row_number().over(newest)).where(F.col("__r") <= length)
    cell = F.struct("ds", *[c.alias(name) for name, c in fields.items()])
    packed = kept.groupBy(*KEYS).agg(F.array_sort(F.collect_list(cell)).alias("rows"))
    if lengths is None:
        packed = packed.withColumn("length", F.lit(length))
    else:
        packed = packed.join(lengths.select(*KEYS, "length"), KEYS)
    full = packed.where((F.col("length") > 0) & (F.size("rows") >= F.col("length")))
    return full.withColumn("rows", F.slice("rows", F.size("rows") - F.col("length") + 1, F.col("length")))


def forecast_recursive(
    model: SequenceModel,
    df: DataFrame,
    future: DataFrame,
    lengths: DataFrame | None = None,
    compat_roll: bool = False,
) -> DataFrame:
    """Forecast the dates of ``future`` (…, step, ds), feeding forecasts back in.

    All series advance together in one stage: calendar inputs are known ahead, so
    their part of every step is a constant, and what recurs is a window of the
    target's own values. By default the new row has the calendar of its date;
    with ``compat_roll`` it takes over that of the row that left the window.
    ``lengths`` has the lookback per series where it is shorter than the model's;
    the missing front rows are zeros, as in training.

    Trees are compiled to an expression over the window (``trees``); a network rolls the
    windows of many series at once in the task that holds them.
    """
    if model.direct:
        raise ValueError("A model that was trained for each step ahead forecasts directly")
    if model.kind != "linear":
        return _forecast_fed_back(model, df, future, lengths, compat_roll)
    length, inputs = model.length, model.features
    weights, intercept = model.coefficients()
    own = literal_array(w[0] for w in weights)
    others = F.array(*[literal_array(w[1:]) for w in weights])
    names = inputs[1:]

    z = F.array(*[F.col(c).cast("double") for c in names]).cast("array<double>")
    blank = F.array(*[F.lit(0.0) for _ in names]).cast("array<double>")
    missing = F.lit(length) - F.col("length")
    packed = last_rows(df, length, {"y": F.col("y").cast("double"), "z": z}, lengths).select(
        *KEYS,
        F.concat(F.array_repeat(F.lit(0.0), missing), F.col("rows.y")).alias("window"),
        F.concat(F.array_repeat(blank, missing), F.col("rows.z")).alias("z"),
    )

    calendar = future.withColumns(calendar_columns()).withColumns(cycle_columns())
    ahead = calendar.groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(F.struct("step", "ds", z.alias("z")))).alias("ahead")
    )
    both = packed.join(ahead, KEYS)
    if compat_roll:
        row_of = lambda at: F.get("z", at % length)
    else:
        both = both.withColumn("timeline", F.concat("z", F.col("ahead.z")))
        row_of = lambda at: F.get("timeline", at)

    def constant(step: Column) -> Column:
        rows = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: row_of(i + step))
        parts = F.zip_with(rows, others, lambda row, w: dot(row, w))
        return F.lit(intercept) + F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v)

    steps = F.sequence(F.lit(0), F.size("ahead") - 1)
    drift = F.transform(steps, constant)
    path = both.withColumn("drift", drift).withColumn(
        "path", recursive_path(F.col("window"), F.col("drift"), own, length)
    )
    cells = F.arrays_zip(F.col("ahead.ds").alias("ds"), F.col("path").alias("yhat"))
    return path.select(*KEYS, F.explode(cells).alias("c")).select(*KEYS, "c.ds", "c.yhat")


def _single(column: str) -> Column:
    """A value as the training windows have it: in single precision."""
    return F.col(column).cast("float").cast("double")


def _forecast_fed_back(
    model: SequenceModel, df: DataFrame, future: DataFrame, lengths: DataFrame | None, compat_roll: bool
) -> DataFrame:
    """Recursion of a model that needs the whole window at each step."""
    length, width = model.length, len(model.features)
    row = F.array(*[_single(c) for c in model.features])
    blank = F.array_repeat(F.lit(0.0), (F.lit(length) - F.col("length")) * width)
    packed = last_rows(df, length, {"row": row}, lengths)
    packed = packed.select(*KEYS, F.concat(blank, F.flatten("rows.row")).alias("window"))
    z = F.array(*[_single(c) for c in model.features[1:]]).cast("array<double>")
    calendar = future.withColumns(calendar_columns()).withColumns(cycle_columns())
    cells = F.array_sort(F.collect_list(F.struct("step", "ds", z.alias("z"))))
    both = packed.join(calendar.groupBy(*KEYS).agg(cells.alias("ahead")), KEYS)
    if model.kind == "network":
        task = rolled(model.model, length, width, compat_roll)
        return both.select(*KEYS, "window", "ahead").mapInArrow(task, "group_id string, series_id string, ds date, yhat double")
    ensemble = model.model if isinstance(model.model, Ensemble) else compile_trees(model.model)

    def step(state: Column, cell: Column) -> Column:
        held = state["window"]
        known = F.slice(held, 2, width - 1) if compat_roll else cell["z"]

        def moved(value: Column) -> Column:
            fresh = F.concat(F.array(value.cast("float").cast("double")), known)
            window = F.concat(F.slice(held, width + 1, (length - 1) * width), fresh)
            return F.struct(window.alias("window"), F.concat(state["path"], F.array(value)).alias("path"))

        # A list of one holds the forecast, which is then made once for both its uses.
        return F.get(F.transform(F.array(ensemble.predict(held)), moved), F.lit(0))

    start = F.struct(F.col("window"), F.array().cast("array<double>").alias("path"))
    path = F.aggregate("ahead", start, step, lambda state: state["path"])
    done = F.arrays_zip(F.col("ahead.ds").alias("ds"), F.col("path").alias("yhat"))
    rows = both.withColumn("path", path).select(*KEYS, F.explode(done).alias("c"))
    return rows.select(*KEYS, "c.ds", "c.yhat")


def horizon_steps(periods: int) -> tuple[int, ...]:
    """Steps ahead a direct model is trained on: dense near the window, sparse further out."""
    steps, ahead = [1], 2
    while ahead < periods:
        steps.append(ahead)
        ahead += max(1, ahead // 2)
    return tuple(dict.fromkeys([*steps, periods]))


def forecast_direct(model: SequenceModel, df: DataFrame, future: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """Forecast each future step from the last window, with a model that knows the step.

    No step waits for the one before it.
    """
    row = F.array(*[F.col(c).cast("float") for c in model.features])
    width = len(model.features)
    blank = F.array_repeat(F.lit(0.0).cast("float"), (F.lit(model.length) - F.col("length")) * width)
    windows = last_rows(df, model.length, {"row": row}, lengths).select(
        *KEYS, F.concat(blank, F.flatten("rows.row")).alias("x")
    )
    ready = windows.join(future, KEYS).withColumn("yt", F.lit(0.0))
    ready = ready.withColumn("x", with_step(F.col("x"), F.col("step"), width))
    return _scored(model, ready).select(*KEYS, "ds", F.col("prediction").alias("yhat"))
