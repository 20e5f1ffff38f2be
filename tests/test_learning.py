"""Models trained in epochs, and trees whose forecasts are fed back."""

import math

import numpy as np
import pandas as pd
import pytest
from conftest import long_frame, series_of
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from seriesloom.config import ModelConfig
from seriesloom.models import network, sequence, store
from seriesloom.models.trees import compile_trees
from seriesloom.operators import horizon, windows
from seriesloom.operators.splitting import temporal_split
from seriesloom.plans import forecasting
from seriesloom.plans.preprocess import preprocess

SMALL = ModelConfig(
    sequence_kind="network", sequence_length=4, sequence_units=5, sequence_epochs=3, sequence_batches=2, sequence_dropout=0.0,
    sequence_learning_rate=0.01,
)


@pytest.fixture(scope="module")
def waves(spark, three_waves):
    done = preprocess(long_frame(spark, three_waves[["keyword1", "keyword2"]]), select=True)
    return done.data.cache(), temporal_split(done.data).cache()


def calendar_row(date):
    m, d = 2 * np.pi * date.month / 12, 2 * np.pi * date.day / 31
    return [0, date.year, date.month, date.day, date.dayofweek, date.isocalendar().week, np.sin(m), np.cos(m), np.sin(d), np.cos(d)]


def looped(predict, data, name, length, dates, features, compat):
    """Forecasts fed back by a plain loop over windows in single precision."""
    pdf = data.where(F.col("series_id") == name).orderBy("ds").toPandas()
    window = pdf[features].to_numpy(np.float32).astype(float)[-length:]
    out = []
    for date in dates:
        value = float(predict(window.ravel()))
        out.append(value)
        fresh = window[0].copy() if compat else np.array(calendar_row(date), np.float32).astype(float)
        fresh[0] = np.float32(value)
        window = np.vstack([window[1:], fresh])
    return out


@pytest.fixture(scope="module")
def trees(waves):
    config = ModelConfig(sequence_kind="gbt", sequence_max_iter=4, sequence_length=6)
    return sequence.fit_sequence(windows.split_sequences(waves[1], 6), config)


def test_compiled_trees_predict_as_the_model(spark, waves, trees):
    rows = windows.split_sequences(waves[1], 6).where("split = 'test'")
    expression = compile_trees(trees.model).predict(F.col("x").cast("array<double>"))
    both = trees.model.transform(sequence.vectors(rows, trees.size)).withColumn("compiled", expression).toPandas()
    assert len(both) > 100 and both["prediction"].nunique() > 20
    np.testing.assert_allclose(both["compiled"], both["prediction"], rtol=1e-12)


@pytest.mark.parametrize("compat", [False, True])
def test_trees_fed_back_equal_the_loop(waves, trees, compat):
    data = waves[0]
    future = horizon.future_dates(data, 9)
    got = sequence.forecast_recursive(trees, data, future, compat_roll=compat)
    for name in ("keyword1", "keyword2"):
        path = series_of(got, name, "yhat")
        want = looped(lambda x: trees.model.predict(Vectors.dense(x)), data, name, 6, path.index, trees.features, compat)
        np.testing.assert_allclose(path.to_numpy(), want, rtol=1e-12)
    assert "ArrowPython" not in got._jdf.queryExecution().executedPlan().toString()


def test_trees_fed_back_in_a_whole_run(waves):
    config = ModelConfig(sequence_kind="gbt", sequence_max_iter=2, sequence_direct=False)
    trained = forecasting.train_models(waves[1], ["sequence"], config, periods=4)
    assert not trained.sequence.direct
    ahead = forecasting.forecast(trained, waves[0], 4, config).toPandas()
    assert len(ahead) == 8 and ahead["yhat"].between(-0.5, 1.5).all()


def test_network_equals_numpy(spark, waves):
    """The same steps over the same mini-batches, in one process."""
    rows = windows.split_sequences(waves[1], 4, features=["y", "day"])
    model = sequence.fit_sequence(rows, SMALL, ["y", "day"])
    held = rows.where("split <> 'test'").withColumn("batch", F.pmod(F.xxhash64("group_id", "series_id", "ds"), F.lit(2))).toPandas()
    train, val = held[held["split"] == "train"], held[held["split"] == "val"]
    x, y = np.stack(train["x"]).astype(float), train["yt"].to_numpy(float)
    xv, yv = np.stack(val["x"]).astype(float), val["yt"].to_numpy(float)
    net = network.Network.fresh(x.mean(axis=0), x.std(axis=0, ddof=1), 5, 42)
    weights, first, second, steps, losses = net.flat(), 0.0, 0.0, 0, []
    for _ in range(3):
        error = 0.0
        for number in (0, 1):
            some = (train["batch"] == number).to_numpy()
            net = net.with_flat(weights)
            sums = net.gradient(x[some], y[some])
            gradient, steps = sums[:-2] / some.sum(), steps + 1
            error += sums[-2]
            first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
            rate = 0.01 * math.sqrt(1 - 0.999**steps) / (1 - 0.9**steps)
            weights = weights - rate * first / (np.sqrt(second) + 1e-7)
        net = net.with_flat(weights)
        losses.append((error / len(y), ((net.predict(xv) - yv) ** 2).mean(), weights))
    best = min(losses, key=lambda row: row[1])
    np.testing.assert_allclose(model.model.flat(), best[2], rtol=1e-7, atol=1e-9)
    table = model.history.toPandas().pivot(index="iteration", columns="metric", values="value")
    np.testing.assert_allclose(table["loss"], [row[0] for row in losses], rtol=1e-9)
    np.testing.assert_allclose(table["val_loss"], [row[1] for row in losses], rtol=1e-9)


def test_gradient_is_that_of_the_error():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(30, 6)), rng.normal(size=30)
    net = network.Network.fresh(x.mean(axis=0), x.std(axis=0), 4, 1)
    keep = (rng.random((30, 4)) >= 0.3) / 0.7
    for mask in (None, keep):
        sums, base, tiny = net.gradient(x, y, mask), net.flat(), 1e-6
        for i in range(0, len(base), 5):
            up, down = (net.with_flat(base + s * tiny * np.eye(len(base))[i]).gradient(x, y, mask)[-2] for s in (1, -1))
            assert abs((up - down) / (2 * tiny) - sums[i]) < 1e-4
        assert sums[-1] == 30


def test_schedule():
    schedule = network.Schedule(patience=4, plateau=2)
    rates, rate = [], 0.1
    for epoch, loss in enumerate([1.0, 0.5, 0.49995, 0.6, 0.7, 0.6, 0.6, 0.1]):
        rate, more = schedule.seen(epoch, loss, rate, epoch)
        rates.append(rate)
        if not more:
            break
    # A gain under a ten-thousandth doesn't keep the rate up, but it is the best loss.
    assert rates == [0.1, 0.1, 0.1, 0.05, 0.05, 0.025, 0.025] and epoch == 6 and schedule.kept == 2


def test_network_learns_stops_and_forecasts(spark, waves, tmp_path):
    data, split_df = waves
    config = ModelConfig(
        sequence_kind="network", sequence_length=6, sequence_units=8, sequence_epochs=14, sequence_batches=2, early_stopping_patience=3,
        sequence_learning_rate=0.01, sequence_dropout=0.1,
    )
    rows = windows.split_sequences(split_df, 6)
    model = sequence.fit_sequence(rows, config)
    table = model.history.toPandas().pivot(index="iteration", columns="metric", values="value")
    assert table["loss"].iloc[-1] < 0.5 * table["loss"].iloc[0] and len(table) <= 14
    kept = sequence.predict_sequence_batch(model, rows.where("split = 'val'")).toPandas()
    assert np.isclose(((kept["y"] - kept["yhat"]) ** 2).mean(), table["val_loss"].min(), rtol=1e-6)
    store.save_sequence(spark, model, str(tmp_path), config)
    again = store.load_sequence(spark, str(tmp_path))
    assert again.kind == "network" and (again.model.flat() == model.model.flat()).all()
    future = horizon.future_dates(data, 7)
    for compat in (False, True):
        got = sequence.forecast_recursive(again, data, future, compat_roll=compat)
        path = series_of(got, "keyword2", "yhat")
        want = looped(lambda x: model.model.predict(x[None])[0], data, "keyword2", 6, path.index, model.features, compat)
        np.testing.assert_allclose(path.to_numpy(), want, rtol=1e-9)
    assert pd.notna(path).all()
    with pytest.raises(ValueError, match="training windows"):
        sequence.fit_sequence(rows.where("split = 'val'"), config)
    alone = sequence.fit_sequence(rows.where("split = 'train'"), ModelConfig(**{**vars(config), "sequence_epochs": 2}))
    assert {r["metric"] for r in alone.history.collect()} == {"loss", "learning_rate"}
