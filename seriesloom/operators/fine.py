"""Series finer than a day, whose length has no bound.

A series is cut into pieces of a fixed number of rows, so that however long it is, a
task holds a piece of it. An operator that looks at neighbouring rows gets them as a
halo: copies of the last rows of the piece before and of the first rows of the piece
behind, as many as its frame needs. What may lie any number of rows away (the nearest
known value, the level of a phase) goes through one row per piece or phase.

``cut_series`` numbers and writes a table once; the operators take what it returns, and
their results are those of the operators for dates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.calendar import known
from ..schema import KEYS, check_fine
from ..session import numbered, stage_table
from .decomposition import running_mean

PIECE = 16_384


def cut_series(df: DataFrame, size: int = PIECE) -> DataFrame:
    """``df`` with each row's number ``at`` in its series, from 0 in order of time, and its ``piece`` of ``size`` rows.

    Rows are unique by series and time; NaN becomes null. Numbers come from ranges of
    series and time, so that one long series is ranged over many tasks.
    """
    rows = check_fine(df).withColumn("y", known("y"))
    placed = numbered(rows, ["ds"], KEYS).withColumnRenamed("number", "at")
    return stage_table(placed.withColumns({"piece": F.floor(F.col("at") / size), "piece_size": F.lit(size)}), "pieces")


def uncut(df: DataFrame) -> DataFrame:
    return df.drop("at", "piece", "piece_size")


def in_piece(piece: str = "piece") -> WindowSpec:
    return Window.partitionBy(*KEYS, piece).orderBy("at")


def with_halo(cut: DataFrame, back: int, ahead: int) -> DataFrame:
    """Rows by the piece ``home`` that sees them: its ``own``, ``back`` rows before and ``ahead`` rows behind them."""
    size = cut.select("piece_size").first()
    if size is not None and max(back, ahead) > size["piece_size"]:
        raise ValueError(f"Pieces of {size['piece_size']} rows are shorter than a frame of {back} rows back and {ahead} ahead")
    inside = F.col("at") % F.col("piece_size")
    homes = F.array(
        F.col("piece"),
        F.when(inside >= F.col("piece_size") - back, F.col("piece") + 1),
        F.when((inside < ahead) & (F.col("piece") > 0), F.col("piece") - 1),
    )
    return cut.withColumn("home", F.explode(F.array_compact(homes))).withColumn("own", F.col("home") == F.col("piece"))


def _own(df: DataFrame) -> DataFrame:
    return df.where("own").drop("home", "own")


def fill_time(cut: DataFrame) -> DataFrame:
    """Fill nulls linearly in elapsed time; edges take the nearest known value.

    The known neighbours are those of the piece, or else of the nearest piece that has
    one: a row per piece tells its first and last.
    """
    over = "over (partition by group_id, series_id, piece order by at"
    edges = cut.groupBy(*KEYS, "piece").agg(
        F.expr("min_by(struct(ds, y), at) filter (where y is not null)").alias("first"),
        F.expr("max_by(struct(ds, y), at) filter (where y is not null)").alias("last"),
    )
    pieces = "over (partition by group_id, series_id order by piece"
    edges = edges.select(
        *KEYS,
        "piece",
        F.expr(f"last(last, true) {pieces} rows between unbounded preceding and 1 preceding)").alias("earlier"),
        F.expr(f"lead(first, 1) ignore nulls {pieces})").alias("later"),
    )
    seen = cut.withColumn("seen", F.when(F.col("y").isNotNull(), F.struct("ds", "y")))
    walked = seen.withColumn("before", F.expr(f"last(seen, true) {over} rows between unbounded preceding and current row)"))
    walked = walked.withColumn("after", F.expr(f"lead(seen, 1) ignore nulls {over})")).join(edges, [*KEYS, "piece"])
    walked = walked.withColumns({"before": F.coalesce("before", "earlier"), "after": F.coalesce("after", "later")})
    elapsed = F.timestamp_diff("MICROSECOND", F.col("before.ds"), F.col("ds")).cast("double")
    span = F.timestamp_diff("MICROSECOND", F.col("before.ds"), F.col("after.ds")).cast("double")
    between = F.col("before.y") + (F.col("after.y") - F.col("before.y")) * elapsed / span
    return walked.withColumn("y", F.coalesce("y", between, "before.y", "after.y")).select(*cut.columns)


def smooth(cut: DataFrame, window: int = 7, causal: bool = False) -> DataFrame:
    """Moving mean over ``window`` rows, shorter at the ends of the series; keeps ``y_original``."""
    if window <= 1:
        return cut
    ahead = 0 if causal else (window - 1) // 2
    back = window - 1 - ahead
    rows = with_halo(cut, back, ahead).withColumn("y_original", F.col("y"))
    return _own(rows.withColumn("y", F.avg("y").over(in_piece("home").rowsBetween(-back, ahead))))


def make_sequences(
    cut: DataFrame, length: int = 30, steps: int = 1, target: str = "y", features: list[str] | None = None
) -> DataFrame:
    """Windows of the ``length`` rows before each row, and the values from it on; see ``windows.make_sequences``."""
    if target not in cut.columns:
        raise ValueError(f"No column {target!r} to predict")
    cell = F.struct(
        "at",
        "ds",
        F.col(target).cast("float").alias("v"),
        F.array(*[F.col(c).cast("float") for c in features or [target]]).alias("f"),
    )
    rows = with_halo(cut, length, steps - 1)
    own = F.when(F.col("own"), F.col("at"))
    packed = rows.groupBy(*KEYS, "home").agg(
        F.sort_array(F.collect_list(cell)).alias("rows"), F.min("at").alias("low"), F.min(own).alias("first"), F.max(own).alias("last")
    )
    # The arrays are taken apart below the explode, once for a piece and not for each row.
    packed = packed.where("first is not null").select(*KEYS, "rows.ds", "rows.v", "rows.f", F.size("rows").alias("n"), "low", "first", "last")
    begin = F.greatest(F.lit(length), (F.col("first") - F.col("low")).cast("int"))
    end = F.least(F.col("n") - steps, (F.col("last") - F.col("low")).cast("int"))
    places = F.when(begin <= end, F.sequence(begin, end)).otherwise(F.array().cast("array<int>"))
    at = packed.withColumn("positions", places).select(*KEYS, "ds", "v", "f", F.explode("positions").alias("i"))
    values = F.get("v", F.col("i")) if steps == 1 else F.slice("v", F.col("i") + 1, F.lit(steps))
    return at.select(
        *KEYS, F.get("ds", F.col("i")).alias("ds"), F.slice("f", F.col("i") - length + 1, F.lit(length)).alias("x"), values.alias("yt")
    )


def seasonal_decompose(cut: DataFrame, period: int) -> DataFrame:
    """Add ``trend``, ``seasonal``, ``resid`` and ``status`` for a period of ``period`` rows; see ``decomposition``.

    The trend comes from running totals of a piece and its halo. A phase of a series is
    averaged over all pieces, with partial sums in each task.
    """
    half = period // 2
    whole = Window.partitionBy(*KEYS, "home")
    rows = with_halo(cut, half + 1, half).withColumn("__mean", F.avg("y").over(whole))
    total = F.sum(F.col("y") - F.col("__mean")).over(in_piece("home").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__total", total).withColumn("trend", running_mean(period, in_piece("home")))
    sizes = cut.groupBy(*KEYS).agg(F.count("*").alias("n"), F.count_if(F.col("y").isNull()).alias("nulls"))
    rows = _own(rows).drop("__mean", "__total").join(sizes, KEYS)
    status = F.when(F.col("nulls") > 0, "missing values").when(F.col("n") < 2 * period, "too short").otherwise("ok")
    inside = (F.col("status") == "ok") & (F.col("at") >= half) & (F.col("at") + half < F.col("n"))
    rows = rows.withColumn("status", status).withColumn("trend", F.when(inside, F.col("trend"))).withColumn("phase", F.col("at") % period)
    # Read twice, for the levels and for the result.
    rows = stage_table(rows.drop("n", "nulls"), "trends")
    levels = rows.groupBy(*KEYS, "phase").agg(F.avg(F.col("y") - F.col("trend")).alias("level"))
    centre = F.sum("level").over(Window.partitionBy(*KEYS)) / period
    levels = levels.select(*KEYS, "phase", (F.col("level") - centre).alias("seasonal"))
    done = rows.join(levels, [*KEYS, "phase"])
    done = done.withColumn("seasonal", F.when(F.col("status") == "ok", F.col("seasonal")))
    resid: Column = F.col("y") - F.col("trend") - F.col("seasonal")
    return done.select(*cut.columns, F.lit(period).alias("period"), "status", "trend", "seasonal", resid.alias("resid"))
