"""MAP fit of one additive series, in NumPy.

The model is the public one of Taylor and Letham, "Forecasting at Scale" (2018):
a piecewise linear trend with a Laplace prior on rate changes, Fourier seasonal
terms with normal priors, and normal noise. The fit works on the Gram matrix of
the design, so an iteration costs a solve of about 50 unknowns whatever the
length of the series. It approximates, and is not bit-equal to, the optimum a
quasi-Newton solver reports.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Fixed values of the published model.
GROWTH_PRIOR = 5.0  # standard deviation of k and m
NOISE_PRIOR = 0.5  # scale of the half-normal prior of sigma
ORDERS = {"yearly": (365.25, 10), "weekly": (7.0, 3), "daily": (1.0, 4)}


@dataclass
class Term:
    name: str
    period: float
    order: int
    mode: str
    prior: float


def terms_of(config) -> list[Term]:
    """Seasonal terms the settings ask for, custom ones last."""
    asked = {"yearly": config.yearly_seasonality, "weekly": config.weekly_seasonality, "daily": config.daily_seasonality}
    mode, prior = config.seasonality_mode, config.seasonality_prior_scale
    terms = [Term(n, *ORDERS[n], mode, prior) for n, wanted in asked.items() if wanted]
    for extra in config.custom_seasonalities:
        terms.append(
            Term(
                extra["name"],
                float(extra["period"]),
                int(extra["fourier_order"]),
                extra.get("mode") or mode,
                float(extra.get("prior_scale") or prior),
            )
        )
    return terms


def fourier(days: np.ndarray, period: float, order: int) -> np.ndarray:
    angle = 2 * np.pi * np.outer(days / period, np.arange(1, order + 1))
    out = np.empty((len(days), 2 * order))
    out[:, 0::2], out[:, 1::2] = np.sin(angle), np.cos(angle)
    return out


def place_changepoints(t: np.ndarray, count: int, share: float) -> np.ndarray:
    """Times spread evenly over the rows of the first ``share`` of the history."""
    reach = int(np.floor(len(t) * share))
    count = min(count, reach - 1)
    if count <= 0:
        return np.empty(0)
    at = np.linspace(0, reach - 1, count + 1).round().astype(int)
    return t[at[1:]]


def _noise(sse: float, n: float) -> float:
    """Noise level that maximises the posterior for a given squared error."""
    a = 1.0 / NOISE_PRIOR**2
    return float(np.sqrt(max((-n + np.sqrt(n * n + 4 * a * sse)) / (2 * a), 1e-12)))


@dataclass
class Ridge:
    """Weighted least squares with a diagonal penalty, from the Gram matrix; those of parts of the rows add up."""

    gram: np.ndarray
    moment: np.ndarray
    total: float

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Ridge:
        xw = x * w[:, None]
        return cls(xw.T @ x, xw.T @ y, float(w @ (y * y)))

    def solve(self, penalty: np.ndarray) -> np.ndarray:
        return np.linalg.solve(self.gram + np.diag(penalty), self.moment)

    def error(self, beta: np.ndarray) -> float:
        return max(self.total - 2 * float(beta @ self.moment) + float(beta @ self.gram @ beta), 0.0)


def _fit_linear(ridge: Ridge, n, within, laplace: np.ndarray, normal: np.ndarray, tau: float, sigma: float, rounds: int):
    """Coefficients with Laplace(tau) priors on some columns, normal ones on the rest.

    The absolute value is bounded by a quadratic at the last estimate, which
    turns each round into a ridge; the noise level is re-estimated in between.
    """
    size = np.full(len(ridge.moment), tau)
    beta = np.zeros(len(ridge.moment))
    floor = 1e-3
    settled = False
    for _ in range(rounds):
        penalty = np.where(laplace, sigma**2 / (tau * np.maximum(size, floor)), sigma**2 / normal**2)
        new = ridge.solve(penalty + 1e-10)
        sigma = _noise(ridge.error(new) + within, n)
        moved = np.max(np.abs(new - beta)) if len(new) else 0.0
        beta, size = new, np.abs(new)
        floor = max(floor * 0.6, 1e-9)
        if moved < 1e-7 and floor <= 1e-6:
            settled = True
            break
    return beta, sigma, settled


def fit_map(days: np.ndarray, mean: np.ndarray, weight: np.ndarray, within: float, config) -> dict:
    """Fit one series.

    ``days`` are ascending days since the epoch, ``mean`` the values, ``weight``
    how many observations a value stands for and ``within`` the squared spread of
    those around it, so that repeated dates count as separate observations.
    """
    if len(days) < 2:
        raise ValueError("A series needs two dates with a value")
    if not np.isfinite(mean).all():
        raise ValueError("A series needs finite values")
    n = float(weight.sum())
    t0, t_days = int(days[0]), float(days[-1] - days[0])
    t = (days - t0) / t_days
    y_scale = float(np.max(np.abs(mean))) or 1.0
    y, within = mean / y_scale, within / y_scale**2

    bends = place_changepoints(t, config.n_changepoints, config.changepoint_range)
    tau = config.changepoint_prior_scale
    terms = terms_of(config)
    hinges = np.maximum(t[:, None] - bends[None, :], 0.0)
    base = np.column_stack([t, np.ones_like(t), hinges])
    laplace = np.r_[False, False, np.ones(len(bends), bool)]
    growth = np.full(base.shape[1], GROWTH_PRIOR)

    waves = {mode: [s for s in terms if s.mode == mode] for mode in ("additive", "multiplicative")}
    matrix, prior = {}, {}
    for mode, members in waves.items():
        parts = [fourier(days, s.period, s.order) for s in members]
        matrix[mode] = np.hstack(parts) if parts else np.empty((len(days), 0))
        prior[mode] = np.concatenate([np.full(2 * s.order, s.prior) for s in members]) if members else np.empty(0)

    share = np.zeros(matrix["multiplicative"].shape[1])
    sigma, settled = 0.1, False
    width = base.shape[1]
    passes = config.fit_passes if len(share) else 1
    for done_passes in range(1, passes + 1):
        # Given the multiplicative share the model is linear, and given the trend
        # the share is; alternate between the two.
        factor = 1 + matrix["multiplicative"] @ share
        design = np.hstack([base * factor[:, None], matrix["additive"]])
        kind = np.r_[laplace, np.zeros(matrix["additive"].shape[1], bool)]
        beta, sigma, settled = _fit_linear(
            Ridge.of(design, y, weight), n, within, kind, np.r_[growth, prior["additive"]], tau, sigma, config.fit_rounds
        )
        if not len(share):
            break
        level = base @ beta[:width]
        rest = y - level - matrix["additive"] @ beta[width:]
        new, sigma, _ = _fit_linear(
            Ridge.of(matrix["multiplicative"] * level[:, None], rest, weight),
            n,
            within,
            np.zeros(len(share), bool),
            prior["multiplicative"],
            tau,
            sigma,
            10,
        )
        steady = np.max(np.abs(new - share)) < 1e-6
        share = new
        if steady:
            break
        settled = False

    coefs = {"additive": beta[width:], "multiplicative": share}
    out = {"t0": t0, "t_days": t_days, "y_scale": y_scale, "n_obs": int(n), "last_day": int(days[-1])}
    return out | _described(beta[:width], sigma, bends, terms, coefs) | {"passes": done_passes, "converged": bool(settled)}


def _described(trend: np.ndarray, sigma: float, bends: np.ndarray, terms: list[Term], coefs: dict[str, np.ndarray]) -> dict:
    fitted, at = [], {"additive": 0, "multiplicative": 0}
    for s in terms:
        take = coefs[s.mode][at[s.mode] : at[s.mode] + 2 * s.order]
        at[s.mode] += 2 * s.order
        fitted.append({"name": s.name, "period": s.period, "mode": s.mode, "coef": [float(c) for c in take]})
    return {
        "k": float(trend[0]),
        "m": float(trend[1]),
        "sigma": float(sigma),
        "changepoints": [float(c) for c in bends],
        "deltas": [float(d) for d in trend[2:]],
        "terms": fitted,
    }


def additive_design(days: np.ndarray, t: np.ndarray, bends: np.ndarray, terms: list[Term]) -> np.ndarray:
    """Columns of a model without multiplicative terms: trend, level, bends, waves."""
    hinges = np.maximum(t[:, None] - bends[None, :], 0.0)
    return np.column_stack([t, np.ones_like(t), hinges, *[fourier(days, s.period, s.order) for s in terms]])


def fit_summed(ridge: Ridge, n: float, within: float, bends: np.ndarray, terms: list[Term], config) -> dict:
    """Fit one series whose rows were summed elsewhere, out of the sums over ``additive_design``.

    ``n`` counts the observations, and ``within`` is the squared spread around their
    means in scaled units.
    """
    width = 2 + len(bends)
    laplace = np.zeros(len(ridge.moment), bool)
    laplace[2:width] = True
    normal = np.concatenate([np.full(width, GROWTH_PRIOR), *[np.full(2 * s.order, s.prior) for s in terms]])
    beta, sigma, settled = _fit_linear(ridge, n, within, laplace, normal, config.changepoint_prior_scale, 0.1, config.fit_rounds)
    coefs = {"additive": beta[width:], "multiplicative": np.empty(0)}
    return _described(beta[:width], sigma, bends, terms, coefs) | {"n_obs": int(n), "passes": 1, "converged": bool(settled)}


def evaluate(params: dict, days: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trend, multiplicative sum, additive sum) in scaled units."""
    t = (days - params["t0"]) / params["t_days"]
    bends, deltas = np.asarray(params["changepoints"], float), np.asarray(params["deltas"], float)
    level = params["m"] + params["k"] * t + np.maximum(t[:, None] - bends[None, :], 0.0) @ deltas
    sums = {"additive": np.zeros(len(days)), "multiplicative": np.zeros(len(days))}
    for s in params["terms"]:
        coef = np.asarray(s["coef"], float)
        sums[s["mode"]] += fourier(days, s["period"], len(coef) // 2) @ coef
    return level, sums["multiplicative"], sums["additive"]


DATES_AT_ONCE = 512


def simulate(params: dict, days: np.ndarray, samples: int, width: float, seed: int):
    """(yhat, lower, upper) in data units.

    After the training span rate changes go on at the pace and mean size seen in
    it; every sample adds observation noise. ``seed`` makes it repeatable. The
    futures are drawn once and followed through the dates piece by piece, so the
    memory in use does not grow with their number.
    """
    rng = np.random.default_rng(seed)
    futures = _draw_futures(params, days, samples, rng)
    tail = 100 * (1 - width) / 2
    parts = []
    for first in range(0, len(days), DATES_AT_ONCE):
        some = days[first : first + DATES_AT_ONCE]
        t = (some - params["t0"]) / params["t_days"]
        level, share, extra = evaluate(params, some)
        paths = np.repeat(level[None, :], samples, axis=0)
        for i, when, bend in futures:
            paths[i] += np.maximum(t[:, None] - when[None, :], 0.0) @ bend
        values = paths * (1 + share) + extra + rng.normal(0.0, params["sigma"], paths.shape)
        lower, upper = np.percentile(values, [tail, 100 - tail], axis=0)
        parts.append((level * (1 + share) + extra, lower, upper))
    if not parts:
        return (np.empty(0),) * 3
    return tuple(np.concatenate(column) * params["y_scale"] for column in zip(*parts))


def _draw_futures(params: dict, days: np.ndarray, samples: int, rng) -> list:
    """(sample, times, rate changes) of the samples whose trend bends after training."""
    reach = ((days - params["t0"]) / params["t_days"]).max(initial=0.0)
    deltas = np.asarray(params["deltas"], float)
    if reach <= 1 or not len(deltas):
        return []
    size = np.mean(np.abs(deltas)) + 1e-8
    counts = rng.poisson(len(deltas) * (reach - 1), samples)
    return [
        (i, 1 + rng.random(counts[i]) * (reach - 1), rng.laplace(0.0, size, counts[i])) for i in np.flatnonzero(counts)
    ]
