"""Autoregressive moving-average models with regressors, per series and candidate.

A model is a regression whose errors follow a product of ordinary and seasonal polynomials. It is
estimated by conditional least squares: two-stage least squares (Hannan-Rissanen) give a start, and
damped Gauss-Newton steps on the product form end at the minimum. Periods without a value keep
their place: the model's own prediction stands in for them, and their error does not count. Spark
distributes the series and the candidate orders; one (series, order) is one group, and a group is
as long as the series' calendar.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.session import task_count

# Fixed value: asymptotic 5 % point of the unit-root test with a constant (MacKinnon 2010).
UNIT_ROOT_5PCT = -2.86154


def _ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    resid = y - x @ beta
    return beta, resid, float(resid @ resid)


def _lagged(v: np.ndarray, lags: list[int], start: int) -> list[np.ndarray]:
    return [v[start - k : len(v) - k] for k in lags]


def unit_root_statistic(y: np.ndarray, lags: int | None = None) -> float:
    """t ratio of the level in the augmented regression; number of lags by AIC, up to ``lags``."""
    n = len(y)
    most = min(int(np.ceil(12 * (n / 100) ** 0.25)) if lags is None else lags, n // 2 - 2)
    if most < 0 or np.ptp(y) == 0:
        return -np.inf
    dy, best = np.diff(y), (np.inf, 0)
    for k, start in ((k, most) for k in range(most + 1)):
        x = np.column_stack([y[start:-1], np.ones(len(dy) - start), *_lagged(dy, list(range(1, k + 1)), start)])
        _, _, sse = _ols(x, dy[start:])
        m = len(dy) - start
        aic = m * np.log(max(sse / m, 1e-300)) + 2 * x.shape[1]
        best = min(best, (aic, k))
    k = best[1]
    x = np.column_stack([y[k:-1], np.ones(len(dy) - k), *_lagged(dy, list(range(1, k + 1)), k)])
    beta, _, sse = _ols(x, dy[k:])
    dof = max(len(dy) - k - x.shape[1], 1)
    cov = np.linalg.pinv(x.T @ x)[0, 0] * sse / dof
    return float(beta[0] / np.sqrt(cov)) if cov > 0 else -np.inf


def difference_order(y: np.ndarray, most: int = 2, lags: int | None = None) -> int:
    for d in range(most):
        if unit_root_statistic(np.diff(y, d), lags) < UNIT_ROOT_5PCT:
            return d
    return most


def _seasonal_lags(k: int, seasonal: int, s: int) -> list[int]:
    """Lags of a multiplied ordinary and seasonal polynomial, with free coefficients."""
    lags = {i + s * j for i in range(k + 1) for j in range(seasonal + 1)}
    return sorted(lags - {0})


def first_used(n: int, order, seasonal=(0, 0, 0, 0)) -> int:
    """The first observation whose error counts for an order, on a series of ``n``.

    Differencing takes d + s D observations, lags the longest of them, and moving-average terms
    first a long autoregression of max(longest + 2, ln(n) squared) lags for the residuals.
    """
    (p, d, q), (sp, sd, sq, s) = order, seasonal
    gone = d + s * sd
    ar, ma = _seasonal_lags(p, sp, s), _seasonal_lags(q, sq, s)
    longest = max(ar + ma + [1])
    return gone + longest + (_long_order(n - gone, longest) if ma else 0)


def _long_order(n: int, longest: int) -> int:
    return max(longest + 2, int(np.log(max(n, 2)) ** 2))


#: Gauss-Newton steps at most, the relative gain below which they end, and the dampings tried at once.
STEPS, GAIN, DAMPING = 30, 1e-6, 10.0 ** np.arange(-6, 5, 2)


def _product(first: np.ndarray, second: np.ndarray, s: int) -> np.ndarray:
    """Coefficients by lag of (1 + first(B)) (1 + second(B^s)); a column is one set of parameters."""
    cols = max(first.shape[1], second.shape[1])
    out = np.zeros((1 + len(first) + s * len(second), cols))
    one = np.ones((1, 1))
    for j, outer in enumerate(np.vstack([np.broadcast_to(one, (1, cols)), np.broadcast_to(second, (len(second), cols))])):
        out[s * j] += outer
        for i, inner in enumerate(first):
            out[s * j + i + 1] += outer * inner
    return out[1:]


def _recursion(theta: np.ndarray, y, x, absent, shape) -> tuple[np.ndarray, np.ndarray]:
    """Errors and regression residuals for each column of parameters.

    Parameters are the constant, regressors, then p, P, q and Q coefficients. A period in ``absent``
    takes its prediction and has no error, which also makes forecasts.
    """
    (p, d, q), (sp, sd, sq, s) = shape
    cuts = np.cumsum([1, x.shape[1], p, sp, q])
    c, beta, phi, sphi, th, sth = np.split(theta, cuts)
    ar = _product(-phi, -sphi, s)
    unit = -np.ones((1, 1))
    for gap in [1] * d + [s] * sd:
        ar = _product(ar, unit, gap) if gap == 1 else _product(ar, np.vstack([np.zeros((gap - 1, 1)), unit]), 1)
    ar, ma = -ar, _product(th, sth, s)[::-1]
    z, first = y[:, None] - x @ beta, len(ar)
    e = np.zeros_like(z)
    with np.errstate(over="ignore", invalid="ignore"):
        # What lags of z predict, at once; a prediction that stands in for a value is passed on to its lags.
        lagged = np.zeros((len(z) - first, z.shape[1])) + c
        for k, weight in enumerate(ar, 1):
            lagged += weight * z[first - k : len(z) - k]
        e[first:] = z[first:] - lagged
        for t in range(first, len(z)) if len(ma) else first + np.flatnonzero(absent[first:]):
            back = min(t, len(ma))
            pushed = (ma[len(ma) - back :] * e[t - back : t]).sum(axis=0) if back else 0.0
            if not absent[t]:
                e[t] -= pushed
                continue
            moved = lagged[t - first] + pushed - z[t]
            z[t], e[t] = z[t] + moved, 0.0
            after = ar[: len(z) - t - 1] * moved
            lagged[t + 1 - first : t + 1 - first + len(after)] += after
            e[t + 1 : t + 1 + len(after)] -= after
    return e, z


def _squares(e: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        sse = (e * e).sum(axis=0)
    return np.where(np.isfinite(sse), sse, np.inf)


def _two_stage(w, xw, shape, start: int) -> np.ndarray:
    """Parameters from least squares on lags and on residuals of a long autoregression."""
    (p, _, q), (sp, _, sq, s) = shape
    ar, ma = _seasonal_lags(p, sp, s), _seasonal_lags(q, sq, s)
    n, m = len(w), _long_order(len(w), max(ar + ma + [1]))
    e = np.zeros(n)
    if ma:
        first = np.column_stack([np.ones(n - m), *_lagged(w, list(range(1, m + 1)), m), xw[m:]])
        e[m:] = _ols(first, w[m:])[1]
    second = np.column_stack(
        [np.ones(n - start), *_lagged(w, ar, start), *_lagged(e, ma, start), xw[start:]]
    )
    beta = _ols(second, w[start:])[0]
    lags = dict(zip([("ar", k) for k in ar] + [("ma", k) for k in ma], beta[1 : 1 + len(ar) + len(ma)]))
    own = [("ar", k) for k in range(1, p + 1)] + [("ar", s * k) for k in range(1, sp + 1)]
    own += [("ma", k) for k in range(1, q + 1)] + [("ma", s * k) for k in range(1, sq + 1)]
    return np.concatenate([beta[:1], beta[len(beta) - xw.shape[1] :], [lags[o] for o in own]])


def _least_squares(theta: np.ndarray, errors) -> np.ndarray:
    """Damped Gauss-Newton from the best column of ``theta``; ``errors`` maps columns to columns."""
    sse = _squares(errors(theta))
    if not np.isfinite(sse).any():
        raise ValueError("no start has finite errors")
    now, best = theta[:, sse.argmin()], sse.min()
    for _ in range(STEPS):
        h = 1e-6 * np.maximum(1.0, np.abs(now))
        e = errors(np.column_stack([now, now[:, None] + np.diag(h)]))
        slopes = (e[:, 1:] - e[:, :1]) / h
        if not np.isfinite(slopes).all():
            break
        square, down = slopes.T @ slopes, slopes.T @ e[:, 0]
        size = np.diag(np.maximum(np.diag(square), 1e-12))
        tried = np.column_stack([now - np.linalg.lstsq(square + lam * size, down, rcond=None)[0] for lam in DAMPING])
        sse = _squares(errors(tried))
        if not sse.min() < best * (1 - GAIN):
            break
        now, best = tried[:, sse.argmin()], sse.min()
    return now


def fit_and_forecast(y, x, x_next, order, seasonal=(0, 0, 0, 0), start: int | None = None) -> tuple[float, np.ndarray]:
    """AIC and forecasts of one order. ``x`` and ``x_next`` are regressors or have no columns.

    ``y`` may hold NaN for periods without a value. ``start`` is the first observation whose error
    counts; orders of one series are comparable when they share it. A series without at least two
    more such observations than coefficients is too short.
    """
    shape = (p, d, q), (sp, sd, sq, s) = tuple(order), tuple(seasonal)
    start = first_used(len(y), order, seasonal) if start is None else start
    n, steps, absent = len(y), len(x_next), np.isnan(y)
    ar, ma = _seasonal_lags(p, sp, s), _seasonal_lags(q, sq, s)
    used = int((~absent[start:]).sum())
    if used < len(ar) + len(ma) + x.shape[1] + 3:
        raise ValueError("series too short for this order")
    whole = np.interp(np.arange(n), np.flatnonzero(~absent), y[~absent]).astype(float)
    every = np.vstack([x, x_next]).astype(float)
    w, xw = whole, every[:n]
    for gap in [1] * d + [s] * sd:
        w, xw = w[gap:] - w[:-gap], xw[gap:] - xw[:-gap]
    # Units of one spread each, so that the steps do not depend on the unit of the series.
    spread, mid = w.std() or 1.0, whole.mean()
    x_spread = np.where(every[:n].std(axis=0) > 0, every[:n].std(axis=0), 1.0)
    every = (every - every[:n].mean(axis=0)) / x_spread
    blind = np.isnan(every[n:]).any(axis=1)
    every[n:][blind] = 0.0
    whole, w, xw = (whole - mid) / spread, (w - (0 if d or sd else mid)) / spread, xw / x_spread
    if not (d or sd):
        xw = every[:n]
    theta = _two_stage(w, xw, shape, start - d - s * sd)

    def errors(params):
        return _recursion(params, whole, every[:n], absent, shape)[0][start:]

    if ma or (p and sp) or (ar and x.shape[1]) or absent.any():
        # Further starts, for a first estimate whose errors explode: no moving average, nothing but a mean.
        plain, flat = theta.copy(), theta.copy()
        plain[1 + x.shape[1] + p + sp :] = 0.0
        flat[1 + x.shape[1] :] = 0.0
        flat[0] = w.mean()
        theta = _least_squares(np.column_stack([theta, plain, flat]), errors)
    sse = _squares(errors(theta[:, None]))[0] * spread**2
    aic = used * np.log(max(sse / used, 1e-300)) + 2 * (len(theta) + 1)
    _, z = _recursion(
        theta[:, None], np.concatenate([whole, np.zeros(steps)]), every, np.concatenate([absent, np.ones(steps, bool)]), shape
    )
    ahead = z[n:, 0] + every[n:] @ theta[1 : 1 + x.shape[1]]
    return float(aic), np.where(blind, np.nan, ahead * spread + mid)


def _series_schema(df: DataFrame, keys: list[str], extra: str) -> T.StructType:
    head = T.StructType([df.schema[k] for k in keys])
    return T.StructType(head.fields + T._parse_datatype_string(f"struct<{extra}>").fields)


def difference_orders(
    df: DataFrame, keys: list[str], time: str, y: str, most: int = 2, lags: int | None = None
) -> DataFrame:
    """``d`` per series: differences needed before a unit root is rejected at 5 %."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(time)[y].dropna().to_numpy(dtype=float)
        return pd.DataFrame([(*key, difference_order(v, most, lags), len(v))], columns=[*keys, "d", "n"])

    rows = df.select(*keys, time, F.col(y).cast("double").alias(y)).repartition(task_count(df.sparkSession), *keys)
    return rows.groupBy(*keys).applyInPandas(one, _series_schema(df, keys, "d int, n int"))


def _placed(pdf: pd.DataFrame, time: str, exog: list[str], horizon: int, step: int | None):
    """Values, regressors and regressors ahead of one series, each period in its place, NaN for none."""
    now, later = pdf[~pdf["_ahead"]], pdf[pdf["_ahead"]]
    now = now[now["_y"].notna().cummax().astype(bool)]
    if not len(now):
        return np.zeros(0), np.zeros((0, len(exog))), np.zeros((min(len(later), horizon) if exog else horizon, len(exog)))
    last = now[time].iloc[-1]
    if len(later) > horizon or (len(later) and later[time].iloc[0] <= last):
        raise ValueError("the horizon is too long or not after the training periods")

    def places(at: pd.Series) -> np.ndarray:
        if step is None:
            return np.arange(len(at))
        units = at if pd.api.types.is_numeric_dtype(at) else (pd.to_datetime(at) - pd.Timestamp(0)).dt.days
        first = now[time].iloc[0] if units is at else (pd.Timestamp(now[time].iloc[0]) - pd.Timestamp(0)).days
        place = (units - first).to_numpy(dtype=np.int64)
        if (place % step).any() or (np.diff(place) <= 0).any():
            raise ValueError("a period lies between the steps")
        return place // step

    at, ahead_at = places(now[time]), places(later[time])
    if step is None:
        ahead_at = ahead_at + len(now)
    steps = (int(ahead_at[-1] - at[-1]) if len(later) else 0) if exog else horizon
    if steps > horizon:
        raise ValueError("the horizon is too long")
    v, x = np.full(at[-1] + 1, np.nan), np.zeros((at[-1] + 1, len(exog)))
    v[at], x[at] = now["_y"].to_numpy(dtype=float), now[exog].to_numpy(dtype=float)
    v[np.isnan(x).any(axis=1)] = np.nan
    x[np.isnan(x).any(axis=1)] = 0.0
    ahead = np.full((steps, len(exog)), np.nan)
    if exog and len(later):
        ahead[ahead_at - at[-1] - 1] = later[exog].to_numpy(dtype=float)
    return v, x, ahead


def fit_orders(
    train: DataFrame,
    future: DataFrame | None,
    keys: list[str],
    time: str,
    y: str,
    orders: list[tuple],
    horizon: int,
    exog: list[str] = (),
    d: DataFrame | None = None,
    step: int | None = None,
) -> DataFrame:
    """Fit each candidate to each series: keys, order columns, aic, forecasts, status.

    ``orders`` holds (p, d, q, P, D, Q, s); a ``d`` table replaces the given d per series.
    ``future`` holds the regressors of the horizon, at most ``horizon`` periods after the last
    training period; forecasts are for those periods. A training period without a value, or without
    one of its regressors, keeps its place and is not scored; those before the first value are left
    out. With ``step``, the periods lie that many units of ``time`` (whole numbers, or days of a date)
    apart, and periods that have no row at all keep their place too; a step ahead without regressors
    gets no forecast. All candidates of a series are scored on the same observations. ``status`` is
    ``fitted``; ``failed`` where the order does not fit the series, which then repeats its last value;
    or ``unusable`` where the rows ahead are more than ``horizon``, not after the training periods, or
    between the steps: such a series has an empty path and does not stop the others. Candidates are
    spread over tasks when there are fewer series than tasks, and stay beside their series otherwise,
    so that rows are not copied through a shuffle.
    """
    exog = list(exog)
    names = ["p", "d", "q", "sp", "sd", "sq", "s"]
    ahead_ = F.lit(False).alias("_ahead")
    rows = train.select(*keys, time, F.col(y).cast("double").alias("_y"), ahead_, *exog)
    if exog:
        later = future.select(*keys, time, F.lit(None).cast("double").alias("_y"), F.lit(True).alias("_ahead"), *exog)
        rows = rows.unionByName(later)
    if d is not None:
        rows = rows.join(d.select(*keys, F.col("d").alias("_d")), keys)
    parts = task_count(train.sparkSession)
    own_d = d is not None
    few = train.select(*keys).distinct().limit(parts + 1).count() <= parts
    if few:
        rows = rows.withColumn("_cid", F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1))))
    by = [*keys, "_cid"] if few else keys

    def group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time)
        all_ = [list(o) for o in orders]
        if own_d:
            all_ = [[o[0], int(pdf["_d"].iloc[0]), *o[2:]] for o in all_]
        asked = [all_[int(pdf["_cid"].iloc[0])]] if few else all_
        names_ = [*keys, *names, "aic", "path", "status"]
        try:
            v, x, ahead = _placed(pdf, time, exog, horizon, step)
        except ValueError:
            return pd.DataFrame([(*key[: len(keys)], *o, None, [], "unusable") for o in asked], columns=names_)
        known = np.isfinite(ahead).all(axis=1)
        # Orders that fit the series at all; the common start is the latest among those.
        starts = [first_used(len(v), tuple(o[:3]), tuple(o[3:])) for o in all_]
        least = [3 + x.shape[1] + sum(map(len, (_seasonal_lags(o[0], o[3], o[6]), _seasonal_lags(o[2], o[5], o[6])))) for o in all_]
        start = max((n for n, k in zip(starts, least) if np.isfinite(v[n:]).sum() >= k), default=0)
        out = []
        for o in asked:
            try:
                own = first_used(len(v), tuple(o[:3]), tuple(o[3:]))
                aic, path = fit_and_forecast(v, x, ahead, tuple(o[:3]), tuple(o[3:]), max(own, start))
                status = "fitted" if np.isfinite(path[known]).all() and np.isfinite(aic) else "failed"
            except (ValueError, np.linalg.LinAlgError):
                status = "failed"
            if status == "failed":
                seen = v[np.isfinite(v)]
                aic, path = None, np.full(len(ahead), seen[-1] if len(seen) else np.nan)
            path = [float(f) if np.isfinite(f) else None for f in path]
            out.append((*key[: len(keys)], *o, aic, path, status))
        return pd.DataFrame(out, columns=names_)

    schema = _series_schema(
        train, keys, ", ".join(f"{n} int" for n in names) + ", aic double, path array<double>, status string"
    )
    return rows.repartition(parts, *by).groupBy(*by).applyInPandas(group, schema)


def search_grid(most_p: int = 3, most_q: int = 3, d: int = 1) -> list[tuple]:
    """All (p, q) up to the limits except (0, 0)."""
    return [
        (p, d, q, 0, 0, 0, 1)
        for p, q in itertools.product(range(most_p + 1), range(most_q + 1))
        if p or q
    ]


def seasonal_grid(season: int, most: int = 2, most_seasonal: int = 1) -> list[tuple]:
    """p, q up to 2 and P, Q up to 1 around one ordinary and one seasonal difference."""
    sides = itertools.product(
        range(most + 1), range(most + 1), range(most_seasonal + 1), range(most_seasonal + 1)
    )
    return [(p, 1, q, sp, 1, sq, season) for p, q, sp, sq in sides if p or q or sp or sq]


def best_order(fits: DataFrame, keys: list[str]) -> DataFrame:
    """Lowest AIC per series. A series on which every order failed keeps its fallback path."""
    rest = [c for c in fits.columns if c not in keys]
    rank = F.struct(
        F.coalesce("aic", F.lit(float("inf"))).alias("aic"), "p", "q", "sp", "sq"
    )
    best = fits.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_b"))
    return best.select(*keys, "_b.*")


def order_forecast(best: DataFrame, keys: list[str]) -> DataFrame:
    """Forecast steps; a series without any keeps one row with its status and no step."""
    return best.select(*keys, "status", F.posexplode_outer("path").alias("_i", "y_pred")).select(
        *keys, (F.col("_i") + 1).alias("step"), "y_pred", "status"
    )
