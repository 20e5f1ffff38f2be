"""The same results in plain SQL over the given tables."""

from __future__ import annotations

ORACLES = {}

_DAILY = """daily AS (
  SELECT o_orderstatus AS group_id, o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS ds,
         CAST(sum(CAST(floor(o_totalprice + 0.5) AS BIGINT)) AS DOUBLE) AS y
  FROM orders GROUP BY 1, 2, 3)"""

_WEEKLY = _DAILY.replace("daily AS", "weekly AS").replace(
    "CAST(o_orderdate AS DATE) AS ds", "CAST(date_trunc('week', o_orderdate) AS DATE) AS ds"
)
_MONTHLY = _WEEKLY.replace("weekly AS", "monthly AS").replace("'week'", "'month'")

_EVENTS = """events_daily AS (
  SELECT 'events' AS group_id, event_type AS series_id, CAST(ts AS DATE) AS ds, CAST(count(*) AS DOUBLE) AS y
  FROM events GROUP BY 2, 3)"""

_NATION = """nation_weekly AS (
  SELECT CAST(n_nationkey // 5 AS VARCHAR) AS group_id, n_name AS series_id,
         CAST(date_trunc('week', o_orderdate) AS DATE) AS ds,
         CAST(sum(CAST(floor(l_extendedprice + 0.5) AS BIGINT)) AS DOUBLE) AS y
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)"""


_SUPPLIER = """supplier_weekly AS (
  SELECT CAST(s_nationkey AS VARCHAR) AS group_id, CAST(s_suppkey AS VARCHAR) AS series_id,
         CAST(date_trunc('week', l_shipdate) AS DATE) AS ds,
         CAST(sum(CAST(floor(l_extendedprice + 0.5) AS BIGINT)) AS DOUBLE) AS y
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3)"""


def _grid(source: str, name: str = "grid") -> str:
    return f"""{name} AS (
  SELECT d.group_id, s.series_id, d.ds, o.y
  FROM (SELECT DISTINCT group_id, ds FROM {source}) d
  JOIN (SELECT DISTINCT group_id, series_id FROM {source}) s USING (group_id)
  LEFT JOIN {source} o USING (group_id, series_id, ds))"""


def _filled(source: str = "grid", name: str = "filled") -> str:
    return f"""{name}_near AS (
  SELECT *, last_value(CASE WHEN y IS NOT NULL THEN ds END IGNORE NULLS) OVER past AS d0,
         last_value(y IGNORE NULLS) OVER past AS y0,
         first_value(CASE WHEN y IS NOT NULL THEN ds END IGNORE NULLS) OVER ahead AS d1,
         first_value(y IGNORE NULLS) OVER ahead AS y1
  FROM {source}
  WINDOW past AS (PARTITION BY group_id, series_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         ahead AS (PARTITION BY group_id, series_id ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{name} AS (
  SELECT group_id, series_id, ds,
         coalesce(y, y0 + (y1 - y0) * CAST(ds - d0 AS DOUBLE) / CAST(d1 - d0 AS DOUBLE), y0, y1) AS y
  FROM {name}_near)"""


_SMOOTH = """smoothed AS (
  SELECT group_id, series_id, ds, y AS y_original,
         avg(y) OVER (PARTITION BY group_id, series_id ORDER BY ds ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS y
  FROM filled)"""

_SCALED = """ranged AS (
  SELECT group_id, series_id, min(y) AS lo, max(y) - min(y) AS span,
         min(y_original) AS lo_o, max(y_original) - min(y_original) AS span_o FROM smoothed GROUP BY 1, 2),
scaled AS (
  SELECT group_id, series_id, ds, (y - lo) / CASE WHEN span = 0 THEN 1 ELSE span END AS y,
         (y_original - lo_o) / CASE WHEN span_o = 0 THEN 1 ELSE span_o END AS y_original
  FROM smoothed JOIN ranged USING (group_id, series_id))"""

_SPLIT = """placed AS (
  SELECT *, row_number() OVER (PARTITION BY group_id, series_id ORDER BY ds) - 1 AS pos,
         count(*) OVER (PARTITION BY group_id, series_id) AS n FROM {source}),
edges AS (
  SELECT *, floor(n * (1 - 0.2::DOUBLE)) AS test_from,
         floor(floor(n * (1 - 0.2::DOUBLE)) * (1 - 0.1::DOUBLE)) AS val_from FROM placed),
split AS (
  SELECT group_id, series_id, ds, y,
         CASE WHEN pos < val_from THEN 'train' WHEN pos < test_from THEN 'val' ELSE 'test' END AS split FROM edges)"""

_LAGGED = """lagged AS (
  SELECT group_id, series_id, ds, y, lag(y, 1) OVER w AS lag1, lag(y, 7) OVER w AS lag7 FROM filled
  WINDOW w AS (PARTITION BY group_id, series_id ORDER BY ds)),
forecasts AS (
  SELECT group_id, series_id, ds, y, 'lag1' AS model, lag1 AS yhat FROM lagged WHERE lag1 IS NOT NULL
  UNION ALL SELECT group_id, series_id, ds, y, 'lag7', lag7 FROM lagged WHERE lag7 IS NOT NULL)"""

_METRICS = """metrics AS (
  SELECT group_id, series_id, model, avg(abs(y - yhat)) AS mae, avg((y - yhat) * (y - yhat)) AS mse,
         sqrt(avg((y - yhat) * (y - yhat))) AS rmse,
         avg(CASE WHEN y <> 0 THEN abs((y - yhat) / y) END) * 100 AS mape,
         1 - avg((y - yhat) * (y - yhat)) / var_pop(y) AS r2
  FROM forecasts GROUP BY 1, 2, 3)"""

_PLAIN = """ends AS (
  SELECT group_id, series_id, max(ds) AS last_ds, arg_max(y, ds) AS y1, arg_min(y, ds) AS y0, count(*) AS n
  FROM filled GROUP BY 1, 2),
plain AS (
  SELECT group_id, series_id, 'hold' AS model, last_ds + CAST(step AS INTEGER) AS ds, y1 AS yhat
  FROM ends, range(1, 15) t(step)
  UNION ALL
  SELECT group_id, series_id, 'drift', last_ds + CAST(step AS INTEGER), y1 + (y1 - y0) / (n - 1) * step
  FROM ends, range(1, 15) t(step))"""

_GRID = ", ".join([_DAILY, _grid("daily")])
_FILLED = ", ".join([_GRID, _filled()])
_PREPARED = ", ".join([_FILLED, _SMOOTH, _SCALED])
_SCORED = ", ".join([_FILLED, _LAGGED, _METRICS])
_FORECAST = ", ".join([_FILLED, _PLAIN])
_NAMED = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_KEYS = "group_id, series_id"
_BY_NATION = """located AS (
  SELECT n_name AS geo, o_orderpriority AS query, o_orderdate AS ts
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def oracle(name: str, ctes: str, body: str) -> None:
    ORACLES[name] = f"WITH {ctes} {body}"


_pivot = ", ".join(f"max(CASE WHEN series_id = '{k}' THEN y END) AS \"{k}\"" for k in _NAMED)
_PIVOTED = f"""wide AS (SELECT group_id, ds, {_pivot} FROM daily GROUP BY 1, 2),
names AS (SELECT DISTINCT o_orderpriority AS series_id FROM orders),
unpivoted AS (SELECT w.group_id, n.series_id, w.ds, d.y FROM wide w CROSS JOIN names n
  LEFT JOIN daily d ON d.group_id = w.group_id AND d.series_id = n.series_id AND d.ds = w.ds)"""

oracle("read_trends", f"{_DAILY}, {_PIVOTED}", "SELECT group_id, series_id, ds, y FROM unpivoted")
oracle("to_wide", f"{_DAILY}, {_PIVOTED}", "SELECT * FROM wide")
oracle("to_long", f"{_DAILY}, {_PIVOTED}", "SELECT group_id, series_id, ds, y FROM unpivoted")
oracle(
    "clean",
    _GRID,
    "SELECT group_id, series_id, ds, CASE WHEN y < 100000 THEN 0 ELSE coalesce(y, 0) END AS y FROM grid",
)
oracle(
    "drop_partial",
    _GRID,
    """SELECT group_id, series_id, ds, CASE WHEN y < 100000 THEN '<1'
       ELSE CAST(CAST(y AS BIGINT) AS VARCHAR) END AS y FROM grid""",
)
oracle(
    "filter_timeframe",
    _DAILY,
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS ds, o_totalprice FROM orders
       WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '2001-08-01' - 360 AND DATE '2001-08-01'""",
)
oracle(
    "filter_timeframe_dates", _DAILY, "SELECT * FROM daily WHERE ds BETWEEN DATE '1996-03-01' AND DATE '1997-02-28'"
)
oracle("filter_geo", _BY_NATION, "SELECT geo, query, count(*) AS n FROM located WHERE geo = 'NATION_7' GROUP BY 1, 2")
oracle(
    "merge_periods",
    _DAILY,
    "SELECT group_id, series_id, ds, CASE WHEN ds <= DATE '1998-12-31' THEN y ELSE y * 2 END AS y FROM daily",
)
oracle("merge_batches", _GRID, "SELECT * FROM grid")
_first = ", ".join(f"sum(CASE WHEN series_id = '{k}' THEN y END) AS \"{k}\"" for k in _NAMED[:3])
_later = ", ".join(f"sum(CASE WHEN series_id = '{k}' THEN y END) AS \"{k}{'_2' * (k == _NAMED[2])}\"" for k in _NAMED[2:])
oracle(
    "merge_wide",
    _DAILY,
    f"""SELECT * FROM (SELECT ds, {_first} FROM daily GROUP BY ds)
       FULL JOIN (SELECT ds, {_later} FROM daily WHERE ds >= DATE '1996-01-01' GROUP BY ds) USING (ds)""",
)
oracle("complete_grid", _GRID, "SELECT * FROM grid")
oracle(
    "batch_keywords",
    _DAILY,
    "SELECT s_name AS keyword, s_suppkey AS ordinal, CAST(s_suppkey // 7 AS INTEGER) AS batch FROM supplier",
)
oracle("write_raw", _DAILY, "SELECT group_id, series_id, ds, y, 'Worldwide' AS geo FROM daily")
oracle(
    "extract_metadata",
    _DAILY,
    """SELECT count(DISTINCT ds) AS n_dates, count(DISTINCT series_id) AS n_keywords, min(ds) AS first_date, max(ds) AS last_date,
       'today 5-y' AS timeframe, 'Worldwide' AS geo FROM daily""",
)
oracle("extract_keywords", _DAILY, "SELECT DISTINCT group_id, series_id FROM daily")
oracle(
    "write_processed",
    _PREPARED,
    """SELECT group_id, series_id, ds, round(y, 6) AS y, CAST(year(ds) AS INTEGER) AS year,
       CAST(weekofyear(ds) AS INTEGER) AS week_of_year FROM scaled""",
)
oracle(
    "sequences_of_buckets",
    _FILLED,
    """SELECT group_id, series_id, ds, CAST(CAST(oldest AS FLOAT) AS DOUBLE) AS oldest, CAST(CAST(newest AS FLOAT) AS DOUBLE) AS newest, yt
       FROM (SELECT group_id, series_id, ds, lag(y, 7) OVER w AS oldest, lag(y, 1) OVER w AS newest, CAST(CAST(y AS FLOAT) AS DOUBLE) AS yt FROM filled
        WINDOW w AS (PARTITION BY group_id, series_id ORDER BY ds)) WHERE oldest IS NOT NULL""",
)
oracle(
    "read_processed_scalers",
    _PREPARED,
    """SELECT group_id, series_id, 'y' AS "column", 'minmax' AS method, round(lo, 2) AS shift,
       round(span, 2) AS scale FROM ranged""",
)
oracle(
    "interest_over_time",
    """counts AS (SELECT event_type AS series_id, CAST(ts AS DATE) AS ds, count(*) AS n FROM events GROUP BY 1, 2)""",
    """SELECT '0' AS group_id, series_id, ds, round(n * 100 / (SELECT max(n) FROM counts)) AS y FROM counts""",
)
oracle(
    "interest_over_time_batched",
    """counts AS (SELECT CAST(user_id AS VARCHAR) AS series_id, CAST(date_trunc('week', ts) AS DATE) AS ds,
        count(*) AS n FROM events GROUP BY 1, 2),
       names AS (SELECT series_id, CAST((row_number() OVER (ORDER BY series_id) - 1) // 5 AS VARCHAR) AS group_id
        FROM (SELECT DISTINCT series_id FROM counts))""",
    """SELECT group_id, series_id, ds, round(n * 100 / max(n) OVER (PARTITION BY group_id)) AS y
       FROM counts JOIN names USING (series_id)""",
)
ORACLES["interest_over_time_sevens"] = (
    ORACLES["interest_over_time_batched"].replace("// 5", "// 7").replace("date_trunc('week'", "date_trunc('month'")
)
oracle(
    "related_queries",
    """middle AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS m FROM events),
       searches AS (SELECT user_id, event_type AS query, count(*) AS n, count(*) FILTER (ts > m) AS n_late
        FROM events, middle GROUP BY 1, 2),
       related AS (SELECT a.query AS series_id, b.query, sum(b.n) AS n, sum(b.n_late) AS n_late
        FROM searches a JOIN searches b ON a.user_id = b.user_id AND a.query <> b.query GROUP BY 1, 2),
       listed AS (SELECT series_id, 'top' AS kind, query, CAST(n AS BIGINT) AS value FROM related UNION ALL
        SELECT series_id, 'rising', query,
         CAST(round((n_late - (n - n_late)) * 100.0 / greatest(n - n_late, 1)) AS BIGINT) FROM related)""",
    """SELECT series_id, kind, query, value FROM listed
       QUALIFY row_number() OVER (PARTITION BY series_id, kind ORDER BY value DESC, query) <= 3""",
)
oracle(
    "trending",
    f"""{_BY_NATION}, here AS (SELECT * FROM located WHERE geo = 'NATION_7'),
       counted AS (SELECT geo, query, count(*) AS n FROM here
        WHERE date_trunc('month', ts) = (SELECT date_trunc('month', max(ts)) FROM here) GROUP BY 1, 2)""",
    """SELECT geo, query, n, CAST(row_number() OVER (ORDER BY n DESC, query) AS INTEGER) AS rank FROM counted
       QUALIFY rank <= 3""",
)
oracle(
    "predictions_wide",
    _FORECAST,
    """SELECT group_id, series_id, ds, round(max(CASE WHEN model = 'hold' THEN yhat END), 2) AS hold,
       round(max(CASE WHEN model = 'drift' THEN yhat END), 2) AS drift FROM plain GROUP BY 1, 2, 3""",
)
oracle(
    "results_summary",
    _SCORED,
    """, inputs AS (SELECT group_id, series_id, count(*) AS n_rows, min(ds) AS first_date, max(ds) AS last_date
        FROM daily GROUP BY 1, 2)
       SELECT group_id, series_id, n_rows, first_date, last_date, 'lag1,lag7' AS models,
        (SELECT round(mape, 4) FROM metrics m WHERE m.model = 'lag1' AND m.group_id = i.group_id
          AND m.series_id = i.series_id) AS lag1_mape,
        (SELECT round(r2, 6) FROM metrics m WHERE m.model = 'lag7' AND m.group_id = i.group_id
          AND m.series_id = i.series_id) AS lag7_r2,
        CAST(14 AS BIGINT) AS prediction_periods FROM inputs i""",
)

oracle("missing_count", _GRID, "SELECT group_id, count(*) FILTER (y IS NULL) AS missing FROM grid GROUP BY 1")
oracle("fill_time", _FILLED, "SELECT group_id, series_id, ds, round(y, 4) AS y FROM filled")
oracle(
    "drop_missing",
    _GRID,
    """SELECT * FROM grid WHERE (group_id, ds) NOT IN (SELECT group_id, ds FROM grid WHERE y IS NULL)""",
)
oracle(
    "smooth",
    f"{_FILLED}, {_SMOOTH}",
    "SELECT group_id, series_id, ds, round(y, 4) AS y, round(y_original, 4) AS y_original FROM smoothed",
)
oracle(
    "smooth_even",
    _WEEKLY,
    """SELECT group_id, series_id, ds, round(avg(y) OVER (PARTITION BY group_id, series_id ORDER BY ds
       ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS y, round(y, 2) AS y_original FROM weekly""",
)
oracle(
    "fit_scaler_minmax",
    _DAILY,
    """SELECT group_id, series_id, 'y' AS "column", 'minmax' AS method, min(y) AS shift,
       CASE WHEN max(y) = min(y) THEN 1 ELSE max(y) - min(y) END AS scale FROM daily GROUP BY 1, 2""",
)
oracle(
    "scale_minmax",
    _DAILY,
    """SELECT group_id, series_id, ds, round((y - min(y) OVER w) / (max(y) OVER w - min(y) OVER w), 9) AS y
       FROM daily WINDOW w AS (PARTITION BY group_id, series_id)""",
)
oracle(
    "scale_standard",
    _WEEKLY,
    """SELECT group_id, series_id, ds, round((y - avg(y) OVER w) / stddev_pop(y) OVER w, 6) AS y
       FROM weekly WINDOW w AS (PARTITION BY group_id, series_id)""",
)
oracle(
    "apply_scaler",
    f"{_DAILY}, {_WEEKLY}",
    """, ranges AS (SELECT group_id, series_id, min(y) AS lo, max(y) - min(y) AS span FROM weekly GROUP BY 1, 2)
       SELECT group_id, series_id, ds, round((y - lo) / span, 9) AS y FROM daily JOIN ranges USING (group_id, series_id)""",
)
oracle("inverse_scale", _DAILY, "SELECT group_id, series_id, ds, round(y, 2) AS y FROM daily")
_CALENDAR = """CAST(year(ds) AS INTEGER) AS year, CAST(month(ds) AS INTEGER) AS month, CAST(day(ds) AS INTEGER) AS day,
       CAST(isodow(ds) - 1 AS INTEGER) AS day_of_week, CAST(weekofyear(ds) AS INTEGER) AS week_of_year"""


def _waves(*names: str) -> str:
    cycle = {"month": "month(ds) / 12", "day": "day(ds) / 31", "dow": "(isodow(ds) - 1) / 7"}
    return ", ".join(
        f"round({f}(2 * pi() * {cycle[n]}), {{digits}}) AS {n}_{f}" for n in names for f in ("sin", "cos")
    )


oracle("calendar_features", _DAILY, f"SELECT group_id, series_id, ds, y, {_CALENDAR} FROM daily")
oracle(
    "cyclical_features",
    _DAILY,
    f"SELECT group_id, series_id, ds, {_waves('month', 'day', 'dow').format(digits=9)} FROM daily",
)
oracle(
    "select_target",
    _PREPARED,
    f"""SELECT group_id, series_id, ds, round(y, 6) AS y, {_CALENDAR}, {_waves('month', 'day').format(digits=6)}
       FROM scaled WHERE series_id = '1-URGENT'""",
)
oracle(
    "preprocess_all",
    _PREPARED,
    """SELECT group_id, series_id, ds, round(y, 6) AS y, round(y_original, 6) AS y_original,
       CAST(year(ds) AS INTEGER) AS year, CAST(isodow(ds) - 1 AS INTEGER) AS day_of_week,
       CAST(weekofyear(ds) AS INTEGER) AS week_of_year FROM scaled""",
)
oracle(
    "preprocess_drop",
    _GRID,
    """, kept AS (SELECT * FROM grid WHERE (group_id, ds) NOT IN (SELECT group_id, ds FROM grid WHERE y IS NULL))
       SELECT group_id, series_id, ds, round((y - min(y) OVER w) /
        CASE WHEN max(y) OVER w = min(y) OVER w THEN 1 ELSE max(y) OVER w - min(y) OVER w END, 6) AS y,
        CAST(day(ds) AS INTEGER) AS day FROM kept WINDOW w AS (PARTITION BY group_id, series_id)""",
)
oracle(
    "make_sequences",
    _PREPARED,
    """, rows AS (SELECT group_id, series_id, ds, CAST(y AS FLOAT) AS y, day(ds) AS day,
        row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY group_id, series_id) AS n,
        lag(CAST(y AS FLOAT), 30) OVER w AS oldest, lag(CAST(y AS FLOAT), 1) OVER w AS newest,
        lag(day(ds), 1) OVER w AS newest_day, lead(CAST(y AS FLOAT), 1) OVER w AS second_step
        FROM scaled WINDOW w AS (PARTITION BY group_id, series_id ORDER BY ds))
       SELECT group_id, series_id, ds, 30 AS x_rows, 10 AS x_columns, round(CAST(oldest AS DOUBLE), 5) AS oldest,
        round(CAST(newest AS DOUBLE), 5) AS newest, CAST(newest_day AS INTEGER) AS newest_day,
        round(CAST(second_step AS DOUBLE), 5) AS second_step FROM rows WHERE pos >= 30 AND pos + 2 <= n""",
)
oracle("temporal_split", f"{_WEEKLY}, {_SPLIT.format(source='weekly')}", "SELECT * FROM split")
_EVENT_SPLIT = f"{_EVENTS}, {_SPLIT.format(source='events_daily')}"
oracle(
    "adaptive_length",
    _EVENT_SPLIT,
    """SELECT group_id, series_id, count(*) FILTER (split = 'train') AS n_train,
       CAST(least(30, count(*) FILTER (split = 'train') // 4) AS INTEGER) AS length FROM split GROUP BY 1, 2""",
)
oracle(
    "split_sequences",
    _EVENT_SPLIT,
    """, sized AS (SELECT *, least(30, count(*) FILTER (split = 'train') OVER s // 4) AS length,
        count(*) FILTER (split = 'val') OVER s AS n_val,
        row_number() OVER (PARTITION BY group_id, series_id, split ORDER BY ds) - 1 AS pos
        FROM split WINDOW s AS (PARTITION BY group_id, series_id)),
       windows AS (SELECT *, (SELECT sum(p.y) FROM sized p WHERE p.group_id = c.group_id
          AND p.series_id = c.series_id AND p.split = c.split AND p.pos BETWEEN c.pos - c.length AND c.pos - 1) AS x_sum,
        row_number() OVER (PARTITION BY group_id, series_id, split ORDER BY ds) - 1 AS nth,
        count(*) OVER (PARTITION BY group_id, series_id, split) AS n_windows
        FROM sized c WHERE length > 0 AND pos >= length)
       SELECT group_id, series_id, ds, CASE WHEN split = 'train' AND n_val <= length
         AND nth >= floor(n_windows * 0.8::DOUBLE) THEN 'val' ELSE split END AS split,
        CAST(length AS INTEGER) AS length, 60 AS x_size, x_sum, y AS yt FROM windows""",
)

_RANK = "row_number() OVER (PARTITION BY group_id, series_id ORDER BY ds)"
oracle(
    "fit_additive",
    _DAILY,
    """SELECT group_id, series_id, min(ds) AS t0, max(ds) AS last_ds, count(*) AS n_obs, 25 AS n_changepoints,
       max(abs(y)) AS y_scale, 0.05::DOUBLE AS changepoint_prior_scale FROM daily GROUP BY 1, 2""",
)
oracle(
    "custom_seasonalities",
    _DAILY,
    """SELECT group_id, series_id, name, period, n_coef
       FROM (SELECT DISTINCT group_id, series_id FROM daily), (VALUES ('yearly', 365.25::DOUBLE, 20),
        ('weekly', 7::DOUBLE, 6), ('quarterly', 91.3125::DOUBLE, 8)) t(name, period, n_coef)""",
)
oracle(
    "predict_interval",
    _DAILY,
    """SELECT group_id, series_id, max(ds) + CAST(step AS INTEGER) AS ds, true AS inside
       FROM daily, range(1, 31) t(step) GROUP BY group_id, series_id, step""",
)
_CUTOFFS = """span AS (SELECT group_id, series_id, min(ds) AS first, max(ds) AS last FROM daily GROUP BY 1, 2),
cutoffs AS (SELECT group_id, series_id, last - CAST(90 + back * 180 AS INTEGER) AS cutoff
  FROM span, range(0, 100) t(back) WHERE last - CAST(90 + back * 180 AS INTEGER) >= first + 730)"""
oracle("cv_cutoffs", f"{_DAILY}, {_CUTOFFS}", "SELECT * FROM cutoffs")
oracle(
    "cross_validate",
    f"{_DAILY}, {_CUTOFFS}",
    """SELECT c.group_id, c.series_id, cutoff, count(*) AS n, min(ds) AS first_ds, max(ds) AS last_ds, sum(y) AS y_sum, true AS good
       FROM cutoffs c JOIN daily d ON c.group_id = d.group_id AND c.series_id = d.series_id
        AND d.ds > cutoff AND d.ds <= cutoff + 90 GROUP BY 1, 2, 3""",
)
oracle(
    "component_importance",
    _DAILY,
    "SELECT group_id, series_id, CAST(3 AS BIGINT) AS n_components, 100::DOUBLE AS total FROM daily GROUP BY 1, 2",
)
oracle(
    "forecast_recursive",
    ", ".join(
        [
            "RECURSIVE " + _FILLED,
            """ends AS (SELECT group_id, series_id, ds, y AS y3, lag(y, 1) OVER w AS y2, lag(y, 2) OVER w AS y1
              FROM filled WINDOW w AS (PARTITION BY group_id, series_id ORDER BY ds)
              QUALIFY row_number() OVER (PARTITION BY group_id, series_id ORDER BY ds DESC) = 1)""",
            """steps AS (SELECT group_id, series_id, ds, 0 AS i, y1, y2, y3 FROM ends UNION ALL
              SELECT group_id, series_id, ds + 1, i + 1, y2, y3,
               (i + 1) * 1000.0::DOUBLE + (0.2::DOUBLE * y1 + 0.3::DOUBLE * y2 + 0.5::DOUBLE * y3)
              FROM steps WHERE i < 5)""",
        ]
    ),
    "SELECT group_id, series_id, ds, round(y3, 6) AS yhat FROM steps WHERE i > 0",
)
_SINGLE = "CAST(CAST({} AS FLOAT) AS DOUBLE)"
_LAST_THREE = f"""ends AS (SELECT group_id, series_id, ds, {_SINGLE.format("y")} AS y3,
    {_SINGLE.format("lag(y, 1) OVER w")} AS y2, {_SINGLE.format("lag(y, 2) OVER w")} AS y1
    FROM filled WINDOW w AS (PARTITION BY group_id, series_id ORDER BY ds)
    QUALIFY row_number() OVER (PARTITION BY group_id, series_id ORDER BY ds DESC) = 1)"""


def _recursion(value: str) -> str:
    """Six days ahead; a forecast goes back into the window in single precision."""
    return f"""steps AS (SELECT group_id, series_id, ds, 0 AS i, y1, y2, y3, NULL::DOUBLE AS yhat FROM ends UNION ALL
        SELECT group_id, series_id, ds + 1, i + 1, y2, y3, {_SINGLE.format("v")}, v
        FROM (SELECT *, {value} AS v FROM steps WHERE i < 6))"""


_TREES = """CASE WHEN y3 > 700000 THEN 350000::DOUBLE WHEN y1 <= 400000 THEN 750000::DOUBLE ELSE 650000.25::DOUBLE END
  + 0.5::DOUBLE * CASE WHEN y2 <= 800000 THEN 40000.5::DOUBLE ELSE -20000.25::DOUBLE END"""
for _name, _value in (
    (
        "forecast_recursive_trees_given",
        _TREES,
    ),
    (
        "forecast_recursive_network_given",
        """greatest(0, (y2 - 500000) / 250000 * 0.5::DOUBLE + (y3 - 400000) / 200000 * 0.75::DOUBLE + 0.1::DOUBLE) * 300000
           - greatest(0, (y2 - 500000) / 250000 * -0.25::DOUBLE + (y3 - 400000) / 200000 * 0.5::DOUBLE + 0.2::DOUBLE) * 100000
           + 250000""",
    ),
):
    oracle(
        _name,
        ", ".join(["RECURSIVE " + _FILLED, _LAST_THREE, _recursion(_value)]),
        "SELECT group_id, series_id, ds, round(yhat, 2) AS yhat FROM steps WHERE i > 0",
    )
oracle(
    "regression_metrics",
    _SCORED,
    """SELECT group_id, series_id, model, round(mae, 1) AS mae, round(rmse, 1) AS rmse, round(mse / 1e9, 4) AS mse,
       round(mape, 6) AS mape, round(r2, 6) AS r2 FROM metrics""",
)
oracle(
    "evaluate",
    _DAILY,
    """SELECT group_id, series_id, model, metric, true AS scored FROM (SELECT DISTINCT group_id, series_id FROM daily),
        (SELECT 'additive' AS model, unnest(['mae', 'mse', 'rmse', 'mape', 'r2', 'changepoint_prior_scale']) AS metric
         UNION ALL SELECT 'sequence', unnest(['mae', 'mse', 'rmse', 'mape', 'r2', 'test_loss', 'test_mae', 'test_mape']))""",
)
oracle(
    "fit_additive_line",
    _WEEKLY,
    """SELECT group_id, series_id, round(regr_slope(y, ds - t0), 0) AS slope, round(regr_intercept(y, ds - t0) / 1000, 0) AS level
       FROM weekly JOIN (SELECT group_id, series_id, min(ds) AS t0 FROM weekly GROUP BY 1, 2) USING (group_id, series_id)
       GROUP BY 1, 2""",
)
# Normal equations of a line and a wave about the means, solved by determinants.
oracle(
    "custom_seasonality_fit",
    _WEEKLY,
    """, inputs AS (SELECT group_id, series_id, y, (ds - DATE '1995-01-01') / 1000.0::DOUBLE AS t,
        sin(2 * pi() * (ds - DATE '1970-01-01') / 91.3125::DOUBLE) AS s, cos(2 * pi() * (ds - DATE '1970-01-01') / 91.3125::DOUBLE) AS c
        FROM weekly),
       moments AS (SELECT group_id, series_id, var_pop(t) AS tt, var_pop(s) AS ss, var_pop(c) AS cc, covar_pop(t, s) AS ts,
        covar_pop(t, c) AS tc, covar_pop(s, c) AS sc, covar_pop(t, y) AS ty, covar_pop(s, y) AS sy, covar_pop(c, y) AS cy
        FROM inputs GROUP BY 1, 2),
       solved AS (SELECT *, tt * (ss * cc - sc * sc) - ts * (ts * cc - sc * tc) + tc * (ts * sc - ss * tc) AS whole FROM moments)
       SELECT group_id, series_id,
        round((tt * (sy * cc - cy * sc) - ty * (ts * cc - sc * tc) + tc * (ts * cy - sy * tc)) / whole / 100, 0) + 0.0::DOUBLE AS sine,
        round((tt * (ss * cy - sc * sy) - ts * (ts * cy - sy * tc) + ty * (ts * sc - ss * tc)) / whole / 100, 0) + 0.0::DOUBLE AS cosine
       FROM solved""",
)
_BENDS = " + 0.1::DOUBLE * greatest(t - 0.25::DOUBLE, 0) - 0.2::DOUBLE * greatest(t - 0.5::DOUBLE, 0)"


def _given(source: str, bends: str = _BENDS) -> str:
    """The parts of the given models on the dates of a table."""
    return f"""timed AS (SELECT *, (ds - DATE '1995-01-01') / 1000.0::DOUBLE AS t, ds - DATE '1970-01-01' AS n,
    length(series_id) * 100.0::DOUBLE AS unit FROM {source}),
  parts AS (SELECT *,
    (1.25::DOUBLE + 0.5::DOUBLE * t{bends}) * unit AS trend,
    0.1::DOUBLE * sin(2 * pi() * n / 365.25) + 0.05::DOUBLE * cos(2 * pi() * n / 365.25)
     + 0.01::DOUBLE * sin(4 * pi() * n / 365.25) + 0.02::DOUBLE * cos(4 * pi() * n / 365.25) AS yearly,
    (0.02::DOUBLE * sin(2 * pi() * n / 7) - 0.03::DOUBLE * cos(2 * pi() * n / 7)) * unit AS weekly FROM timed)"""


_GIVEN = f"{_DAILY}, {_given('daily')}"
oracle("predict_dates_given", _GIVEN, "SELECT group_id, series_id, ds, round(trend * (1 + yearly) + weekly, 5) AS yhat FROM parts")
oracle(
    "components_given",
    _GIVEN,
    """SELECT group_id, series_id, ds, round(trend, 5) AS trend, round(yearly, 5) AS yearly, round(weekly, 5) AS weekly
       FROM parts""",
)


def _coming(days: int, source: str = "daily") -> str:
    return f"""coming AS (SELECT group_id, series_id, max(ds) + CAST(step AS INTEGER) AS ds
      FROM {source}, range(1, {days + 1}) t(step) GROUP BY group_id, series_id, step)"""


oracle(
    "predict_horizon_given",
    f"{_DAILY}, {_coming(30)}, {_given('coming')}",
    "SELECT group_id, series_id, ds, round(trend * (1 + yearly) + weekly, 5) AS yhat FROM parts",
)
oracle(
    "predict_interval_given",
    f"{_DAILY}, {_coming(30)}, {_given('coming', '')}",
    """SELECT group_id, series_id, ds, round(trend * (1 + yearly) + weekly, 5) AS yhat, yhat AS yhat_lower, yhat AS yhat_upper
       FROM parts""",
)
# 1.28155 is the value that a tenth of a standard normal distribution exceeds.
oracle(
    "predict_interval_noise_given",
    f"{_DAILY}, {_coming(400)}",
    """SELECT group_id, series_id, count(*) AS n, round(1.28155::DOUBLE, 1) AS below, round(1.28155::DOUBLE, 1) AS above
       FROM coming GROUP BY 1, 2""",
)
oracle(
    "evaluate_given",
    f"{_GIVEN}, {_SPLIT.format(source='daily')}",
    """, scored AS (SELECT group_id, series_id, s.y, trend * (1 + yearly) + weekly AS yhat
        FROM split s JOIN parts USING (group_id, series_id, ds) WHERE split = 'test'),
       measured AS (SELECT group_id, series_id, avg(abs(y - yhat)) AS mae, avg((y - yhat) * (y - yhat)) AS mse,
        avg(CASE WHEN y <> 0 THEN abs((y - yhat) / y) END) * 100 AS mape, var_pop(y) AS spread FROM scored GROUP BY 1, 2)
       SELECT group_id, series_id, 'additive' AS model,
        unnest(['mae', 'mse', 'rmse', 'mape', 'r2', 'changepoint_prior_scale']) AS metric,
        round(unnest([mae, mse / 1e9, sqrt(mse), mape, 1 - mse / spread, 0.05::DOUBLE]), 4) AS value FROM measured""",
)
oracle(
    "component_importance_given",
    _GIVEN,
    """, spread AS (SELECT group_id, series_id, stddev_pop(trend) AS a, stddev_pop(yearly) AS b, stddev_pop(weekly) AS c
        FROM parts GROUP BY 1, 2)
       SELECT group_id, series_id, unnest(['trend', 'yearly', 'weekly']) AS component,
        round(unnest([a, b, c]) / (a + b + c) * 100, 6) AS importance FROM spread""",
)
oracle(
    "cross_validation_errors",
    _EVENTS,
    """SELECT DISTINCT group_id, series_id, CAST(NULL AS DATE) AS cutoff, 'Too short for a cutoff' AS error
       FROM events_daily""",
)
oracle(
    "cv_metrics",
    _DAILY,
    """SELECT DISTINCT group_id, series_id, true AS cv_rmse, true AS cv_mae, true AS cv_mape, true AS cv_coverage
       FROM daily""",
)
oracle(
    "cv_metrics_lagged",
    f"{_FILLED}, {_LAGGED}, {_CUTOFFS.replace('FROM daily', 'FROM filled')}",
    """, scored AS (SELECT f.group_id, f.series_id, ds - cutoff AS h, y, yhat FROM forecasts f JOIN cutoffs c
         ON c.group_id = f.group_id AND c.series_id = f.series_id AND ds > cutoff AND ds <= cutoff + 90 WHERE model = 'lag7'),
       by_day AS (SELECT group_id, series_id, h, sqrt(avg((y - yhat) * (y - yhat))) AS rmse, avg(abs(y - yhat)) AS mae,
         avg(CASE WHEN y <> 0 THEN abs((y - yhat) / y) END) AS mape,
         avg(CASE WHEN y >= yhat * 0.5::DOUBLE AND y <= yhat * 1.5::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) AS coverage FROM scored GROUP BY 1, 2, 3)
       SELECT group_id, series_id, round(avg(rmse), 1) AS cv_rmse, round(avg(mae), 1) AS cv_mae,
        round(avg(mape), 6) AS cv_mape, round(avg(coverage), 9) AS cv_coverage FROM by_day GROUP BY 1, 2""",
)
# Each row by itself: the window's rows are the last tenth of them up to the end of a horizon, a horizon's rows alike.
oracle(
    "cv_metrics_rolling",
    f"{_FILLED}, {_LAGGED}, {_CUTOFFS.replace('FROM daily', 'FROM filled')}",
    """, scored AS (SELECT f.group_id, f.series_id, ds - cutoff AS h, y, yhat FROM forecasts f JOIN cutoffs c
         ON c.group_id = f.group_id AND c.series_id = f.series_id AND ds > cutoff AND ds <= cutoff + 90 WHERE model = 'lag7'),
       rows AS (SELECT group_id, series_id, h, row_number() OVER (PARTITION BY group_id, series_id ORDER BY h) AS i,
         count(*) OVER (PARTITION BY group_id, series_id) AS total,
         avg((y - yhat) * (y - yhat)) OVER d AS mse, avg(abs(y - yhat)) OVER d AS mae, avg(abs((y - yhat) / y)) OVER d AS mape,
         avg(CASE WHEN y >= yhat * 0.5::DOUBLE AND y <= yhat * 1.5::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) OVER d AS coverage
         FROM scored WINDOW d AS (PARTITION BY group_id, series_id, h)),
       ends AS (SELECT group_id, series_id, h, max(i) AS last, greatest(1, floor(any_value(total) * 0.1::DOUBLE)) AS width
         FROM rows GROUP BY 1, 2, 3),
       windows AS (SELECT e.group_id, e.series_id, e.h, sqrt(avg(mse)) AS rmse, avg(mae) AS mae, avg(mape) AS mape,
         avg(coverage) AS coverage FROM ends e JOIN rows r ON r.group_id = e.group_id AND r.series_id = e.series_id
         AND r.i > last - width AND r.i <= last WHERE last >= width GROUP BY 1, 2, 3)
       SELECT group_id, series_id, round(avg(rmse), 1) AS cv_rmse, round(avg(mae), 1) AS cv_mae,
        round(avg(mape), 6) AS cv_mape, round(avg(coverage), 9) AS cv_coverage FROM windows GROUP BY 1, 2""",
)
oracle(
    "metrics_table_all",
    _SCORED,
    "SELECT group_id, series_id, model, round(mape, 4) AS mape, round(r2, 4) AS r2 FROM metrics WHERE model = 'lag1'",
)
_GRID_SPLIT = f"{_GRID}, {_SPLIT.format(source='grid')}"
oracle("predict_dates", _GRID_SPLIT, "SELECT group_id, series_id, ds, true AS forecast FROM split WHERE split = 'test'")
oracle("components", _GRID, "SELECT group_id, series_id, ds, true AS trend, true AS yearly, true AS weekly FROM grid")
_WINDOWED = f"""{_GRID_SPLIT}, sized AS (SELECT group_id, series_id, split, count(*) AS n FROM split GROUP BY 1, 2, 3),
  lengths AS (SELECT group_id, series_id, least(30, n // 4) AS length FROM sized WHERE split = 'train')"""
oracle(
    "predict_sequence_batch",
    _WINDOWED,
    """SELECT group_id, series_id, n - length AS n, true AS all_finite, true AS beats_mean
       FROM sized JOIN lengths USING (group_id, series_id) WHERE split = 'test' AND n > length""",
)
oracle(
    "save_load_sequence",
    _WINDOWED,
    """SELECT group_id, series_id, split, n - length AS n, true AS same
       FROM sized JOIN lengths USING (group_id, series_id) WHERE n > length""",
)
oracle(
    "fit_sequence",
    _DAILY,
    """SELECT CAST(i AS INTEGER) AS lag_row, input, true AS fitted FROM range(0, 30) t(i),
        (SELECT unnest(['y', 'year', 'month', 'day', 'day_of_week', 'week_of_year', 'month_sin', 'month_cos', 'day_sin',
         'day_cos']) AS input) UNION ALL SELECT 30, 'intercept', true""",
)
oracle("fit_sequence_trees", _DAILY, "SELECT unnest(['loss', 'val_loss']) AS metric, true AS beats_mean")
oracle("fit_sequence_network", _DAILY, "SELECT unnest(['loss', 'val_loss']) AS metric, true AS beats_mean")
oracle("training_history", _DAILY, "SELECT 0 AS iteration, unnest(['loss', 'val_loss']) AS metric, true AS small")
_ONE_LAG = f"""{_WEEKLY}, {_SPLIT.format(source='(SELECT group_id, series_id, ds, y / 1e6 AS y FROM weekly)')},
  lagged AS (SELECT group_id, series_id, ds, split, CAST(CAST(y AS FLOAT) AS DOUBLE) AS y,
    CAST(CAST(lag(y) OVER (PARTITION BY group_id, series_id, split ORDER BY ds) AS FLOAT) AS DOUBLE) AS x FROM split),
  line AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM lagged WHERE split = 'train' AND x IS NOT NULL)"""
oracle("fit_sequence_one_lag", _ONE_LAG, "SELECT round(a, 6) AS slope, round(b, 6) AS intercept FROM line")
for _name, _part in (("predict_sequence_one_lag", "test"), ("save_load_sequence_one_lag", "val")):
    oracle(
        _name,
        _ONE_LAG,
        f"""SELECT group_id, series_id, ds, split, round(y, 5) AS y, round(a * x + b, 5) AS yhat FROM lagged, line
           WHERE split = '{_part}' AND x IS NOT NULL""",
    )
oracle(
    "training_history_one_lag",
    _ONE_LAG,
    """SELECT 0 AS iteration, CASE split WHEN 'train' THEN 'loss' ELSE 'val_loss' END AS metric,
       round(avg((y - a * x - b) * (y - a * x - b)), 6) AS value FROM lagged, line
       WHERE split IN ('train', 'val') AND x IS NOT NULL GROUP BY split""",
)
oracle(
    "train_models",
    _DAILY,
    """SELECT group_id, count(DISTINCT series_id) AS n_models, 'additive,sequence' AS types FROM daily GROUP BY 1""",
)


_SUPPLIED = ", ".join([_SUPPLIER, _grid("supplier_weekly")])
oracle(
    "preprocess_suppliers",
    ", ".join([_SUPPLIED, _filled(), _SMOOTH, _SCALED]),
    "SELECT group_id, series_id, ds, round(y, 6) AS y, round(y_original, 6) AS y_original FROM scaled",
)
oracle(
    "split_suppliers",
    f"{_SUPPLIED}, {_SPLIT.format(source='grid')}",
    "SELECT group_id, series_id, split, count(*) AS n FROM split GROUP BY 1, 2, 3",
)
oracle(
    "fit_additive_suppliers",
    _SUPPLIER,
    """SELECT group_id, series_id, min(ds) AS t0, max(ds) AS last_ds, count(*) AS n_obs, max(abs(y)) AS y_scale
       FROM supplier_weekly GROUP BY 1, 2""",
)
oracle(
    "forecast_suppliers",
    _SUPPLIER,
    """SELECT group_id, series_id, max(ds) + CAST(7 * s AS INTEGER) AS ds, true AS forecast
       FROM supplier_weekly, range(1, 13) t(s) GROUP BY group_id, series_id, s""",
)


def _freq(source: str) -> str:
    return f"""gaps AS (SELECT group_id, series_id, ds - lag(ds) OVER (PARTITION BY group_id, series_id ORDER BY ds)
         AS gap FROM {source}),
       common AS (SELECT group_id, series_id, gap FROM gaps WHERE gap IS NOT NULL GROUP BY 1, 2, 3
        QUALIFY row_number() OVER (PARTITION BY group_id, series_id ORDER BY count(*) DESC, gap) = 1)"""


_CLASS = """CASE WHEN gap = 7 THEN 'W' WHEN gap BETWEEN 28 AND 31 THEN 'M' WHEN gap BETWEEN 89 AND 92 THEN 'Q'
       WHEN gap BETWEEN 365 AND 366 THEN 'Y' ELSE 'D' END AS freq"""
for _name, _cte, _source in (("daily", _DAILY, "daily"), ("weekly", _WEEKLY, "weekly")):
    oracle(
        f"infer_freq_{_name}",
        f"{_cte}, {_freq(_source)}",
        f"SELECT group_id, series_id, CAST(gap AS INTEGER) AS gap_days, {_CLASS} FROM common",
    )
oracle(
    "save_load_additive",
    _WEEKLY,
    """SELECT group_id, series_id, min(ds) AS t0, max(ds) AS last_ds, count(*) AS n_obs, max(abs(y)) AS y_scale
       FROM weekly GROUP BY 1, 2""",
)


def _ahead(source: str, periods: int) -> str:
    """The dates after the last of each series, by its most common gap."""
    return f"""{_freq(source)},
       lasts AS (SELECT group_id, series_id, max(ds) AS last FROM {source} GROUP BY 1, 2),
       ahead AS (SELECT l.group_id, l.series_id, CAST(s AS INTEGER) AS step,
         CASE WHEN gap = 7 THEN last + CAST(7 * s AS INTEGER)
              WHEN gap BETWEEN 28 AND 31 THEN CAST(last + to_months(CAST(s AS INTEGER)) AS DATE)
              WHEN gap BETWEEN 89 AND 92 THEN CAST(last + to_months(CAST(3 * s AS INTEGER)) AS DATE)
              WHEN gap BETWEEN 365 AND 366 THEN CAST(last + to_years(CAST(s AS INTEGER)) AS DATE)
              ELSE last + CAST(coalesce(gap, 1) * s AS INTEGER) END AS ds
         FROM lasts l LEFT JOIN common c ON c.group_id = l.group_id AND c.series_id = l.series_id,
          range(1, {periods + 1}) t(s))"""


oracle("future_dates_weekly", f"{_WEEKLY}, {_ahead('weekly', 6)}", "SELECT * FROM ahead")
oracle("future_dates_monthly", f"{_MONTHLY}, {_ahead('monthly', 6)}", "SELECT * FROM ahead")
# The first day of the next period is found from the period itself, not by stepping from the last date.
_MONTH_ENDS = f"""{_MONTHLY}, ends AS (SELECT group_id, series_id, last_day(ds) AS ds, y FROM monthly),
  {_freq('ends')}"""
oracle(
    "infer_freq_month_end",
    _MONTH_ENDS,
    """SELECT group_id, series_id, CAST(gap AS INTEGER) AS gap_days,
       CASE WHEN gap BETWEEN 28 AND 31 THEN 'ME' WHEN gap BETWEEN 89 AND 92 THEN 'QE' ELSE 'D' END AS freq FROM common""",
)
oracle(
    "future_dates_month_end",
    _MONTHLY,
    """SELECT group_id, series_id, CAST(s AS INTEGER) AS step,
       CAST(date_trunc('month', max(ds)) + to_months(CAST(s + 1 AS INTEGER)) AS DATE) - 1 AS ds
       FROM monthly, range(1, 15) t(s) GROUP BY group_id, series_id, s""",
)
for _unit, _months in (("quarter", 3), ("year", 12)):
    oracle(
        f"future_dates_{_unit}ly",
        _WEEKLY.replace("weekly AS", "periods AS").replace("'week'", f"'{_unit}'"),
        f"""SELECT group_id, series_id, CAST(s AS INTEGER) AS step,
       make_date(CAST((year(max(ds)) * 12 + month(max(ds)) - 1 + {_months} * s) // 12 AS BIGINT),
        CAST((year(max(ds)) * 12 + month(max(ds)) - 1 + {_months} * s) % 12 + 1 AS BIGINT), 1) AS ds
       FROM periods, range(1, 7) t(s) GROUP BY group_id, series_id, s""",
    )
oracle(
    "predict_horizon",
    f"{_WEEKLY}, {_ahead('weekly', 8)}",
    "SELECT group_id, series_id, ds, true AS forecast FROM ahead",
)
oracle(
    "forecast",
    f"{_GRID}, {_ahead('grid', 7)}",
    """SELECT group_id, series_id, model, ds, true AS forecast
       FROM ahead, (VALUES ('additive'), ('sequence')) m(model)""",
)
oracle(
    "run_all_nations",
    f"{_NATION}, {_grid('nation_weekly')}, {_ahead('grid', 4)}",
    """SELECT group_id, series_id, model, ds, true AS forecast
       FROM ahead, (VALUES ('additive'), ('sequence')) m(model)""",
)


for _name, _cte, _source, _digits, _which in (
    ("correlation_suppliers", _SUPPLIER, "supplier_weekly", 6, ""),
    ("correlation_matrix", _DAILY, "daily", 6, ""),
    ("correlation_lower", _NATION, "nation_weekly", 2, "AND l.series_id > r.series_id"),
    # Asked for from the last priority to the first.
    ("correlation_lower_requested", _DAILY, "daily", 6, "AND l.series_id < r.series_id"),
):
    oracle(
        _name,
        _cte,
        f"""SELECT l.group_id, l.series_id AS a, r.series_id AS b, round(corr(l.y, r.y), {_digits}) AS corr
           FROM {_source} l JOIN {_source} r ON l.group_id = r.group_id AND l.ds = r.ds {_which} GROUP BY 1, 2, 3""",
    )
oracle(
    "correlation_strongest",
    _SUPPLIER,
    """, pairs AS (SELECT l.group_id, l.series_id AS a, r.series_id AS b, corr(l.y, r.y) AS c
        FROM supplier_weekly l JOIN supplier_weekly r ON l.group_id = r.group_id AND l.ds = r.ds
        AND l.series_id <> r.series_id GROUP BY 1, 2, 3)
       SELECT group_id, a, least(count(*), 3) AS n, round(max(abs(c)) FILTER (NOT isnan(c)), 6) AS strongest
       FROM pairs GROUP BY 1, 2""",
)
oracle(
    "strongest_partners",
    _SUPPLIER,
    """, pairs AS (SELECT l.group_id, l.series_id AS a, r.series_id AS b, corr(l.y, r.y) AS c
        FROM supplier_weekly l JOIN supplier_weekly r ON l.group_id = r.group_id AND l.ds = r.ds
        AND l.series_id <> r.series_id GROUP BY 1, 2, 3)
       SELECT group_id, a, round(max(abs(c)), 6) AS strongest FROM pairs WHERE NOT isnan(c) GROUP BY 1, 2""",
)


def _decomposed(source: str, period: int) -> str:
    half = period // 2
    if period % 2:
        mean = f"avg(y) OVER (s ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    else:
        mean = f"""(avg(y) OVER (s ROWS BETWEEN {half} PRECEDING AND {half - 1} FOLLOWING)
          + avg(y) OVER (s ROWS BETWEEN {half - 1} PRECEDING AND {half} FOLLOWING)) / 2"""
    return f"""numbered AS (SELECT *, row_number() OVER s - 1 AS pos,
          count(*) OVER (PARTITION BY group_id, series_id) AS n, {mean} AS mean
          FROM {source} WINDOW s AS (PARTITION BY group_id, series_id ORDER BY ds)),
        trended AS (SELECT *, CASE WHEN pos >= {half} AND pos + {half} < n THEN mean END AS trend FROM numbered),
        phases AS (SELECT group_id, series_id, pos % {period} AS phase, avg(y - trend) AS level
          FROM trended GROUP BY 1, 2, 3),
        centered AS (SELECT *, level - avg(level) OVER (PARTITION BY group_id, series_id) AS seasonal FROM phases),
        decomposed AS (SELECT t.*, seasonal, y - trend - seasonal AS resid FROM trended t JOIN centered c
          ON t.group_id = c.group_id AND t.series_id = c.series_id AND pos % {period} = phase)"""


_WEEKLY_FILLED = ", ".join([_WEEKLY, _grid("weekly"), _filled()])
oracle(
    "seasonal_decompose_weekly",
    f"{_WEEKLY_FILLED}, {_decomposed('filled', 52)}",
    """SELECT group_id, series_id, ds, round(y, 4) AS y, 52 AS period, 'ok' AS status, round(trend, 4) AS trend,
       round(seasonal, 4) AS seasonal, round(resid, 4) AS resid FROM decomposed""",
)
oracle(
    "seasonal_decompose_default",
    f"{_FILLED}, {_decomposed('filled', 365)}",
    """SELECT group_id, series_id, ds, 365 AS period, 'ok' AS status, round(trend, 3) AS trend,
       round(seasonal, 3) AS seasonal FROM decomposed""",
)
oracle(
    "overview",
    _GRID,
    """SELECT group_id, count(DISTINCT series_id) AS keywords, count(DISTINCT ds) AS data_points,
       min(ds) AS first_date, max(ds) AS last_date, count(*) FILTER (y IS NULL) AS missing FROM grid GROUP BY 1""",
)
oracle(
    "last_n",
    _DAILY,
    """SELECT * FROM daily
       QUALIFY row_number() OVER (PARTITION BY group_id, series_id ORDER BY ds DESC) <= 10""",
)
oracle(
    "distribution",
    _DAILY,
    """, stats AS (SELECT group_id, series_id, min(y) AS lo, max(y) AS hi, avg(y) AS mean, median(y) AS med
        FROM daily GROUP BY 1, 2),
       counts AS (SELECT group_id, series_id, least(29, floor((y - lo) * 30 / (hi - lo))) AS bin, count(*) AS n
        FROM daily JOIN stats USING (group_id, series_id) GROUP BY 1, 2, 3)
       SELECT s.group_id, s.series_id, CAST(b AS INTEGER) AS bin, round(lo + b * ((hi - lo) / 30), 2) AS bin_from,
        round(lo + (b + 1) * ((hi - lo) / 30), 2) AS bin_to, coalesce(n, 0) AS n, round(mean, 2) AS mean,
        round(med, 2) AS median
       FROM stats s CROSS JOIN range(0, 30) t(b) LEFT JOIN counts c
        ON c.group_id = s.group_id AND c.series_id = s.series_id AND c.bin = b""",
)
oracle(
    "metrics_table",
    _SCORED,
    "SELECT group_id, series_id, model, round(mape, 4) AS mape, round(r2, 4) AS r2 FROM metrics",
)
oracle(
    "rank_models",
    _SCORED,
    """, long AS (UNPIVOT metrics ON mae, mse, rmse, mape, r2 INTO NAME metric VALUE value)
       SELECT group_id, series_id, model, metric, CAST(rank() OVER (PARTITION BY group_id, series_id, metric
        ORDER BY CASE WHEN metric = 'r2' THEN -value ELSE value END) AS INTEGER) AS rank FROM long""",
)
oracle(
    "forecast_summary",
    _FORECAST,
    """SELECT group_id, series_id, model, round(avg(yhat), 1) AS average,
       round(arg_max(yhat, ds) - arg_min(yhat, ds), 1) AS change,
       CASE WHEN arg_max(yhat, ds) - arg_min(yhat, ds) > 0 THEN 'up' ELSE 'down' END AS direction
       FROM plain GROUP BY 1, 2, 3""",
)
oracle(
    "forecast_context",
    _FORECAST,
    """, context AS (SELECT group_id, series_id, 'actual' AS kind, ds, y AS value FROM filled
        QUALIFY row_number() OVER (PARTITION BY group_id, series_id ORDER BY ds DESC) <= 100
        UNION ALL SELECT group_id, series_id, model, ds, yhat FROM plain)
       SELECT c.group_id, c.series_id, kind, ds, round(value, 2) AS value, CAST(NULL AS DOUBLE) AS lower,
        CAST(NULL AS DOUBLE) AS upper, e.last_ds + 1 AS forecast_start FROM context c JOIN ends e
        ON c.group_id = e.group_id AND c.series_id = e.series_id""",
)
oracle(
    "backtest_table",
    f"{_FILLED}, {_LAGGED}, {_SPLIT.format(source='filled')}",
    """SELECT s.group_id, s.series_id, model, s.ds, round(s.y, 2) AS actual, round(yhat, 2) AS predicted
       FROM split s JOIN forecasts f ON s.group_id = f.group_id AND s.series_id = f.series_id AND s.ds = f.ds
       WHERE split = 'test'""",
)
oracle(
    "report_tables",
    _FORECAST,
    """SELECT 'history' AS name, count(*) AS n FROM filled UNION ALL
       SELECT 'correlation', sum(k * k)::BIGINT FROM (SELECT count(*) AS k FROM ends GROUP BY group_id) UNION ALL
       SELECT 'forecast', (SELECT count(*) * 100 FROM ends) + (SELECT count(*) FROM plain) UNION ALL
       SELECT 'rmse', 2 * count(*) FROM ends""",
)

oracle(
    "forecast_given",
    ", ".join(["RECURSIVE " + _FILLED, _LAST_THREE, _recursion(_TREES), _coming(6, "filled"), _given("coming", "")]),
    """, ranged AS (SELECT group_id, series_id, min(y) AS lo, max(y) - min(y) AS span FROM filled GROUP BY 1, 2),
       ahead AS (SELECT group_id, series_id, 'sequence' AS model, ds, yhat, NULL::DOUBLE AS bound FROM steps WHERE i > 0
        UNION ALL SELECT group_id, series_id, 'additive', ds, trend * (1 + yearly) + weekly AS v, v FROM parts)
       SELECT group_id, series_id, model, ds, round((yhat * span + lo) / 1e6, 3) AS yhat,
        round((bound * span + lo) / 1e6, 3) AS yhat_lower, yhat_lower AS yhat_upper
       FROM ahead JOIN ranged USING (group_id, series_id)""",
)
oracle(
    "report_values",
    ", ".join([_FORECAST, _LAGGED, _METRICS]),
    """SELECT 'history' AS name, group_id, series_id, CAST(ds AS VARCHAR) AS item, round(y, 6) AS value FROM filled
       UNION ALL SELECT 'correlation', l.group_id, l.series_id, r.series_id, round(corr(l.y, r.y), 6)
        FROM filled l JOIN filled r ON l.group_id = r.group_id AND l.ds = r.ds GROUP BY 2, 3, 4
       UNION ALL SELECT 'forecast', group_id, series_id, 'actual ' || CAST(ds AS VARCHAR), round(y, 6)
        FROM (SELECT * FROM filled QUALIFY row_number() OVER (PARTITION BY group_id, series_id ORDER BY ds DESC) <= 100)
       UNION ALL SELECT 'forecast', group_id, series_id, model || ' ' || CAST(ds AS VARCHAR), round(yhat, 6) FROM plain
       UNION ALL SELECT 'rmse', group_id, series_id, model, round(rmse, 1) FROM metrics""",
)

_HOURLY = """counted AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ds, count(*)::DOUBLE AS y FROM events GROUP BY 1, 2),
hourly AS (SELECT 'events' AS group_id, h.series_id, h.ds, y FROM (
    SELECT series_id, unnest(generate_series(min(ds), max(ds), INTERVAL 1 HOUR)) AS ds FROM counted GROUP BY 1) h
  LEFT JOIN counted c ON c.series_id = h.series_id AND c.ds = h.ds)"""
_HOURLY_FILLED = f"""{_HOURLY}, walked AS (SELECT *,
    last_value(CASE WHEN y IS NOT NULL THEN ds END IGNORE NULLS) OVER back AS d0, last_value(y IGNORE NULLS) OVER back AS y0,
    first_value(CASE WHEN y IS NOT NULL THEN ds END IGNORE NULLS) OVER fore AS d1, first_value(y IGNORE NULLS) OVER fore AS y1
  FROM hourly WINDOW back AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    fore AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT group_id, series_id, ds, coalesce(y, y0 + (y1 - y0) * (epoch(ds) - epoch(d0)) / (epoch(d1) - epoch(d0)), y0, y1) AS y
  FROM walked)"""
oracle("hourly_fill_time", _HOURLY_FILLED, "SELECT group_id, series_id, ds, round(y, 6) AS y FROM filled")
oracle(
    "hourly_smooth",
    _HOURLY_FILLED,
    """SELECT group_id, series_id, ds, round(avg(y) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING), 6)
       AS y, round(y, 6) AS y_original FROM filled""",
)
oracle(
    "hourly_sequences",
    _HOURLY_FILLED,
    """, single AS (SELECT group_id, series_id, ds, y::FLOAT::DOUBLE AS v FROM filled)
       SELECT group_id, series_id, ds, 48 AS n, round(lag(v, 48) OVER w, 4) AS first,
        round(sum(v) OVER (w ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING), 3) AS total,
        round(sum(v) OVER (w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), 4) AS ahead
       FROM single WINDOW w AS (PARTITION BY series_id ORDER BY ds)
       QUALIFY lag(v, 48) OVER w IS NOT NULL AND lead(v, 2) OVER w IS NOT NULL""",
)
oracle(
    "hourly_decompose",
    f"{_HOURLY_FILLED}, {_decomposed('filled', 24)}",
    """SELECT group_id, series_id, ds, 24 AS period, 'ok' AS status, round(trend, 5) AS trend, round(seasonal, 5) AS seasonal,
       round(resid, 5) AS resid FROM decomposed""",
)
_HOURLY_GIVEN = f"""{_HOURLY}, clock AS (SELECT group_id, series_id, ds, epoch(ds) / 86400.0::DOUBLE AS d,
    (epoch(ds) / 86400.0::DOUBLE - 19723) / 29 AS t FROM hourly),
parts AS (SELECT group_id, series_id, ds, (0.25::DOUBLE + 0.5::DOUBLE * t - 0.3::DOUBLE * greatest(t - 0.4::DOUBLE, 0)) * 4 AS trend,
    (0.05::DOUBLE * sin(2 * pi() * d / 7) - 0.02::DOUBLE * cos(2 * pi() * d / 7)) * 4 AS weekly,
    (0.2::DOUBLE * sin(2 * pi() * d) + 0.1::DOUBLE * cos(2 * pi() * d) - 0.05::DOUBLE * sin(4 * pi() * d)
     + 0.03::DOUBLE * cos(4 * pi() * d)) * 4 AS daily FROM clock)"""
oracle(
    "hourly_components_given",
    _HOURLY_GIVEN,
    """SELECT group_id, series_id, ds, round(trend, 6) AS trend, round(weekly, 6) AS weekly, round(daily, 6) AS daily,
       round(trend + weekly + daily, 6) AS yhat FROM parts""",
)
oracle(
    "hourly_component_importance_given",
    _HOURLY_GIVEN,
    """, spread AS (SELECT group_id, series_id, stddev_pop(trend) AS a, stddev_pop(weekly) AS b, stddev_pop(daily) AS c
        FROM parts GROUP BY 1, 2)
       SELECT group_id, series_id, unnest(['trend', 'weekly', 'daily']) AS component,
        round(unnest([a, b, c]) / (a + b + c) * 100, 6) AS importance FROM spread""",
)
oracle(
    "hourly_fit",
    _HOURLY,
    """SELECT group_id, series_id, last + INTERVAL 1 HOUR * i AS ds, true AS near
       FROM (SELECT group_id, series_id, max(ds) AS last, unnest(range(1, 25)) AS i FROM hourly GROUP BY 1, 2)""",
)
