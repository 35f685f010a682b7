import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidecast.models import arima, forecast
from tidecast.operators import aggregate as agg
from tidecast.operators import windows as win


def series_frame(spark, data):
    rows = [(k, i, float(v)) for k, vals in data.items() for i, v in enumerate(vals)]
    return spark.createDataFrame(rows, "k string, t int, y double").repartition(5)


RNG = np.random.default_rng(1)
DATA = {"a": RNG.normal(50, 9, 60).tolist(), "b": RNG.normal(5, 1, 13).tolist(), "one": [3.0]}


@pytest.fixture(scope="module")
def frame(spark):
    return series_frame(spark, DATA)


def to_pandas(df):
    return df.toPandas().sort_values(["k", "t"]).reset_index(drop=True)


def test_lags_and_rolling_never_see_the_current_row(frame):
    w = win.series(["k"], "t")
    got = to_pandas(frame.withColumns({**win.lag_columns("y", [1, 7], w), **win.rolling_columns("y", [7], w)}))
    for _, g in got.groupby("k"):
        y = pd.Series(g["y"].to_numpy())
        np.testing.assert_allclose(g["lag_7"], y.shift(7))
        past = y.shift(1).rolling(7, min_periods=1)
        np.testing.assert_allclose(g["rolling_mean_7"], past.mean(), rtol=1e-9)
        np.testing.assert_allclose(g["rolling_std_7"], past.std(), rtol=1e-7)


def test_change_handles_zero_and_first_rows(spark):
    df = series_frame(spark, {"a": [0.0, 4.0, 2.0]})
    got = to_pandas(df.withColumns(win.change_columns("y", win.series(["k"], "t"))))
    assert got["price_change_yn"].tolist() == [0, 1, 0]
    assert got["price_change_pct"].tolist() == [0.0, 0.0, -0.5]


def test_ties_and_missing_keys_raise(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1)], "k string, t int")
    with pytest.raises(ValueError):
        win.require_unique(df, ["k", "t"])
    with pytest.raises(ValueError):
        win.series([], "t")


def test_differences_match_numpy(frame):
    got = to_pandas(win.difference(frame.where("k = 'a'"), "y", ["k"], "t", 2, season=7))
    y = np.diff(np.array(DATA["a"]), 2)
    np.testing.assert_allclose(got["diff"].dropna(), y[7:] - y[:-7], rtol=1e-6, atol=1e-9)


@pytest.mark.parametrize("period", [4, 7])
def test_decomposition(frame, period):
    got = to_pandas(win.decompose(frame.where("k = 'a'"), "y", ["k"], "t", period))
    y = np.array(DATA["a"])
    half = period // 2
    weights = np.ones(period) if period % 2 else np.r_[0.5, np.ones(period - 1), 0.5]
    trend = np.convolve(y, weights / period, "valid")
    np.testing.assert_allclose(got["trend"].dropna(), trend, rtol=1e-9)
    assert got["trend"].isna().sum() == 2 * half
    assert got["seasonal"][:period].sum() == pytest.approx(0, abs=1e-9)
    whole = got.dropna()
    np.testing.assert_allclose(whole["trend"] + whole["seasonal"] + whole["residual"], whole["y"])


def test_calendar_fill_makes_calendar_lags(spark):
    df = spark.createDataFrame([("a", "2020-01-01", 1.0), ("a", "2020-01-04", 2.0)], "k string, d string, y double")
    full = win.calendar_fill(df.withColumn("d", F.to_date("d")), ["k"], "d")
    lagged = full.withColumn("lag", F.lag("y", 3).over(win.series(["k"], "d"))).orderBy("d").collect()
    assert len(lagged) == 4 and lagged[3]["lag"] == 1.0 and lagged[1]["y"] is None


def test_ranks_share_ties(spark):
    df = spark.createDataFrame(
        [("c", "a", 1.0, 0.9), ("c", "b", 1.0, 0.2), ("c", "d", 2.0, 0.5)], "case_id string, model string, rmse double, r2 double"
    )
    assert {r["model"]: r["rank"] for r in win.rank_models(df, "rmse").collect()} == {"a": 1, "b": 1, "d": 3}
    assert {r["model"]: r["rank"] for r in win.rank_models(df, "r2").collect()} == {"a": 1, "d": 2, "b": 3}
    assert agg.best_model(df, "r2").first()["best_model"] == "a"


def test_naive_forecasts(frame):
    last = forecast.last_value_forecast(frame, ["k"], "t", "y", 3).toPandas()
    assert set(last[last["k"] == "a"]["y_pred"]) == {DATA["a"][-1]}
    tiled = forecast.seasonal_forecast(frame, ["k"], "t", "y", 4, 10).orderBy("k", "step").toPandas()
    for k, vals in DATA.items():
        tail = vals[-4:]
        assert tiled[tiled["k"] == k]["y_pred"].tolist() == [tail[i % len(tail)] for i in range(10)]


def smooth_by_hand(y, trend, seasonal, s, a, b, g, phi):
    level, season = np.mean(y[:s]), [v - np.mean(y[:s]) for v in y[:s]] if seasonal else [0.0]
    slope, sse = ((np.mean(y[s : 2 * s]) - level) / s if trend else 0.0), 0.0
    for v in y[s:]:
        base, head = level + phi * slope, season.pop(0)
        sse += (v - base - head) ** 2
        new = a * (v - head) + (1 - a) * base
        slope = b * (new - level) + (1 - b) * phi * slope
        season.append(g * (v - base) + (1 - g) * head)
        level = new
    return level, slope, season, sse


@pytest.mark.parametrize(
    "trend,seasonal,damped,s", [(None, None, False, 1), ("add", None, True, 1), ("add", "add", False, 4), (None, "add", False, 7)]
)
def test_smoothing_fold_matches_a_loop(spark, frame, trend, seasonal, damped, s):
    grid = forecast.smoothing_grid(trend, seasonal, damped, s)
    arrays = forecast.series_arrays(frame.where("k = 'a'"), ["k"], "t", "y")
    got = forecast.smooth(arrays, ["k"], grid).toPandas()
    assert len(got) == len(grid)
    for r in got.sample(min(6, len(got)), random_state=0).itertuples():
        level, slope, season, sse = smooth_by_hand(DATA["a"], trend, seasonal, s, r.alpha, r.beta, r.gamma, r.phi)
        assert (r.level, r.slope, r.sse) == pytest.approx((level, slope, sse))
        np.testing.assert_allclose(r.queue, season, atol=1e-9)


def test_smoothing_recovers_trend_and_season(spark):
    t = np.arange(84)
    wave = np.tile([5, -3, 0, 8, -6, -2, -2], 12)
    df = series_frame(spark, {"up": 100 + 2 * t + wave, "short": [1.0, 2.0]})
    got = forecast.smoothing_auto(df, ["k"], "t", "y", 7, 14).toPandas()
    up = got[got["k"] == "up"].sort_values("step")
    np.testing.assert_allclose(up["y_pred"], 100 + 2 * np.arange(84, 98) + np.tile([5, -3, 0, 8, -6, -2, -2], 2), atol=1.5)
    short = got[got["k"] == "short"]
    assert set(short["status"]) == {"fallback"} and set(short["y_pred"]) == {2.0}


def test_multiplicative_forecast_is_shifted_back(spark):
    y = (10 + 0.5 * np.arange(48)) * np.tile([1.2, 0.8, 1.1, 0.9], 12)
    df = series_frame(spark, {"m": y, "low": y - 60})
    grid = forecast.smoothing_grid("add", "mul", False, 4)
    best = forecast.pick_best(forecast.smooth(forecast.series_arrays(df, ["k"], "t", "y"), ["k"], grid), ["k"])
    got = forecast.smoothing_forecast(best, ["k"], 8).toPandas()
    want = (10 + 0.5 * np.arange(48, 56)) * np.tile([1.2, 0.8, 1.1, 0.9], 2)
    np.testing.assert_allclose(got[got["k"] == "m"].sort_values("step")["y_pred"], want, rtol=0.08)
    assert got[got["k"] == "low"]["y_pred"].max() < 5


def test_spread_and_local_candidates_agree(frame, monkeypatch):
    arrays = forecast.series_arrays(frame, ["k"], "t", "y")
    grid = forecast.all_variants(4)
    cols = ["k", "alpha", "beta", "gamma", "phi", "trend", "seasonal", "aic"]
    spread = forecast.pick_best(forecast.smooth(arrays, ["k"], grid), ["k"]).select(*cols).toPandas()
    monkeypatch.setattr(forecast, "task_count", lambda _: 1)
    local = forecast.pick_best(forecast.smooth(arrays, ["k"], grid), ["k"]).select(*cols).toPandas()
    pd.testing.assert_frame_equal(spread.sort_values("k", ignore_index=True), local.sort_values("k", ignore_index=True))


def test_too_long_a_series_is_an_error(frame, monkeypatch):
    monkeypatch.setattr(forecast, "MAX_POINTS", 20)
    with pytest.raises(Exception, match="roll up to a coarser period"):
        forecast.series_arrays(frame, ["k"], "t", "y").collect()


def arma(n, ar, ma, seed=0):
    rng = np.random.default_rng(seed)
    e, y = rng.normal(size=n + 200), np.zeros(n + 200)
    for t in range(1, n + 200):
        y[t] = ar * y[t - 1] + e[t] + ma * e[t - 1]
    return y[200:]


def test_unit_root_orders(spark):
    walk = np.cumsum(np.random.default_rng(5).normal(size=400))
    df = series_frame(spark, {"flat": arma(400, 0.3, 0), "walk": walk, "twice": np.cumsum(walk)})
    got = {r["k"]: r["d"] for r in arima.difference_orders(df, ["k"], "t", "y").collect()}
    assert got == {"flat": 0, "walk": 1, "twice": 2}


def test_arma_recovers_its_parameters():
    y = arma(4000, 0.7, 0.4) + 10
    aic, path = arima.fit_and_forecast(y, np.zeros((4000, 0)), np.zeros((300, 0)), (1, 0, 1))
    assert path[-1] == pytest.approx(y.mean(), abs=0.3)
    assert (path[1] - path[-1]) / (path[0] - path[-1]) == pytest.approx(0.7, abs=0.05)
    worse, _ = arima.fit_and_forecast(y, np.zeros((4000, 0)), np.zeros((1, 0)), (0, 0, 1))
    assert aic < worse


def test_differenced_forecast_follows_trend_season_and_regressor():
    t = np.arange(130.0)
    x = (t % 5 == 0).astype(float)[:, None]
    noise = np.random.default_rng(2).normal(0, 0.01, 130)
    y = 3 + 0.5 * t + np.tile([2, -1, 0, -1], 33)[:130] + 4 * x[:, 0] + noise
    _, path = arima.fit_and_forecast(y[:120], x[:120], x[120:], (1, 1, 1), (1, 1, 1, 4))
    np.testing.assert_allclose(path, y[120:], atol=0.5)


def test_order_search_flags_short_series(spark):
    df = series_frame(spark, {"ar": arma(600, 0.8, 0.0), "tiny": [1.0, 2.0, 4.0]})
    fits = arima.fit_orders(df, None, ["k"], "t", "y", arima.search_grid(2, 1, d=0), 3)
    assert fits.count() == 2 * 5
    best = {r["k"]: r for r in arima.best_order(fits, ["k"]).collect()}
    assert best["ar"]["status"] == "fitted" and best["ar"]["p"] >= 1
    assert best["tiny"]["status"] == "failed" and best["tiny"]["path"] == [4.0, 4.0, 4.0]
    steps = arima.order_forecast(arima.best_order(fits, ["k"]), ["k"])
    assert sorted(r["step"] for r in steps.where("k = 'tiny'").collect()) == [1, 2, 3]


def test_grids():
    assert len(arima.search_grid()) == 15
    assert len(arima.seasonal_grid(4)) == 35
    assert all(o[6] == 4 for o in arima.seasonal_grid(4))


def seasonal_product(n, phi, sphi, th, sth, s, seed=3):
    """(1 - phi B)(1 - sphi B^s)(1 - B)(1 - B^s) y = (1 + th B)(1 + sth B^s) e, by plain loops."""
    e = np.random.default_rng(seed).normal(size=n + 200)
    w = np.zeros(n + 200)
    for t in range(s + 1, n + 200):
        ar = phi * w[t - 1] + sphi * w[t - s] - phi * sphi * w[t - s - 1]
        w[t] = ar + e[t] + th * e[t - 1] + sth * e[t - s] + th * sth * e[t - s - 1]
    w, y = w[200:], np.zeros(n)
    for t in range(n):
        y[t] = w[t] if t <= s else w[t] + y[t - 1] + y[t - s] - y[t - s - 1]
    return y


def parameters(monkeypatch):
    kept, plain = [], arima._least_squares
    monkeypatch.setattr(arima, "_least_squares", lambda theta, errors: kept.append(plain(theta, errors)) or kept[-1])
    return kept


def test_product_of_polynomials_recovers_its_parameters(monkeypatch):
    kept = parameters(monkeypatch)
    y = seasonal_product(3000, 0.5, 0.3, 0.4, -0.6, 4)
    none = np.zeros((3000, 0))
    _, path = arima.fit_and_forecast(y, none, np.zeros((4, 0)), (1, 1, 1), (1, 1, 1, 4))
    np.testing.assert_allclose(kept[0][1:], [0.5, 0.3, 0.4, -0.6], atol=0.08)
    # Another unit gives the same parameters and the same forecasts in it.
    _, other = arima.fit_and_forecast(y * 1e6 + 5, none, np.zeros((4, 0)), (1, 1, 1), (1, 1, 1, 4))
    np.testing.assert_allclose(kept[1][1:], kept[0][1:], atol=1e-4)
    np.testing.assert_allclose(other, path * 1e6 + 5, rtol=1e-4)


def test_a_gap_moves_no_lag(monkeypatch):
    kept = parameters(monkeypatch)
    y = seasonal_product(3000, 0.5, 0.3, 0.4, -0.6, 4)
    holes = y.copy()
    holes[np.random.default_rng(0).choice(np.arange(50, 2900), 60, replace=False)] = np.nan
    none = np.zeros((3000, 0))
    _, whole = arima.fit_and_forecast(y, none, np.zeros((6, 0)), (1, 1, 1), (1, 1, 1, 4))
    _, path = arima.fit_and_forecast(holes, none, np.zeros((6, 0)), (1, 1, 1), (1, 1, 1, 4))
    np.testing.assert_allclose(kept[1][1:], kept[0][1:], atol=0.08)
    np.testing.assert_allclose(path, whole, atol=1.0)


def test_errors_follow_the_definition():
    rng = np.random.default_rng(4)
    y, x, theta = rng.normal(size=40), rng.normal(size=(40, 1)), np.array([0.2, 1.5, 0.4, 0.3, -0.5, 0.2])
    shape = (1, 1, 1), (1, 1, 1, 4)
    e, _ = arima._recursion(theta[:, None], y, x, np.zeros(40, bool), shape)
    z = y - 1.5 * x[:, 0]
    w = np.diff(z)[4:] - np.diff(z)[:-4]
    want = np.zeros(40)
    for t in range(10, 40):
        v = lambda k: w[t - k - 5]
        want[t] = v(0) - 0.4 * v(1) - 0.3 * v(4) + 0.12 * v(5) - 0.2
        want[t] -= -0.5 * want[t - 1] + 0.2 * want[t - 4] - 0.1 * want[t - 5]
    np.testing.assert_allclose(e[:, 0], want, atol=1e-12)


def test_rows_missing_from_the_calendar_keep_their_place(spark):
    y = np.tile([10.0, 20.0, 30.0, 40.0], 30) + 0.25 * np.arange(120) + np.random.default_rng(1).normal(0, 0.01, 120)
    rows = [("a", i * 7, float(v)) for i, v in enumerate(y) if i not in (50, 51, 90)]
    rows += [("b", i * 7, float(v)) for i, v in enumerate(y)] + [("odd", 0, 1.0), ("odd", 3, 2.0)]
    df = spark.createDataFrame(rows, "k string, t int, y double")
    fits = arima.fit_orders(df, None, ["k"], "t", "y", [(1, 1, 1, 0, 1, 1, 4)], 4, step=7)
    got = {r["k"]: r for r in fits.collect()}
    want = np.array([10.0, 20.0, 30.0, 40.0]) + 0.25 * np.arange(120, 124)
    np.testing.assert_allclose(got["a"]["path"], want, atol=0.1)
    np.testing.assert_allclose(got["b"]["path"], want, atol=0.1)
    assert got["odd"]["status"] == "unusable" and got["odd"]["path"] == []


def test_one_unusable_horizon_does_not_stop_the_others(spark):
    rows = [(k, i, float(v), float(i % 3)) for k in ("a", "b") for i, v in enumerate(arma(80, 0.5, 0.2))]
    later = [("a", 80, 0.0), ("a", 81, 1.0), *[("b", i, 0.0) for i in range(80, 90)]]
    train = spark.createDataFrame(rows, "k string, t int, y double, x double")
    fits = arima.fit_orders(train, spark.createDataFrame(later, "k string, t int, x double"), ["k"], "t", "y", [(1, 0, 1, 0, 0, 0, 1)], 3, ["x"])
    got = {r["k"]: r for r in fits.collect()}
    assert got["a"]["status"] == "fitted" and len(got["a"]["path"]) == 2
    assert got["b"]["status"] == "unusable" and got["b"]["aic"] is None


def test_searched_weights_reach_the_minimum_of_a_fine_grid(spark):
    rng = np.random.default_rng(11)
    data = {}
    for i in range(100):
        drift = np.cumsum(rng.normal(0, [0.05, 1, 3][i % 3], 50))
        data[f"s{i}"] = ((100 + drift + rng.normal(0, 2, 50)) * 10.0 ** (i % 7 - 3)).tolist()
    arrays = forecast.series_arrays(series_frame(spark, data), ["k"], "t", "y").cache()
    fine = np.linspace(0, 1, 41)
    for trend in (None, "add"):
        got = forecast.smooth(arrays, ["k"], forecast.smoothing_grid(trend, None, False, 1), search=True).toPandas()
        assert len(got) == 100
        a, b = (m.ravel() for m in np.meshgrid(fine, fine if trend else [0.0]))
        for r in got.itertuples():
            y = np.array(data[r.k])
            level, slope, sse = np.full(len(a), y[0]), np.full(len(a), (y[1] - y[0]) if trend else 0.0), np.zeros(len(a))
            for v in y[1:]:
                base = level + slope
                sse += (v - base) ** 2
                new = a * v + (1 - a) * base
                level, slope = new, b * (new - level) + (1 - b) * slope
            assert r.sse <= sse.min() * (1 + 1e-4), (r.k, trend, r.alpha, r.beta)


def test_searched_weights_never_lose_to_their_starts(spark, frame):
    arrays = forecast.series_arrays(frame, ["k"], "t", "y")
    for variant in [("add", "add", True, 4), (None, "add", False, 4), ("add", "mul", False, 4), ("mul", None, True, 1)]:
        grid = forecast.smoothing_grid(*variant)
        cols = ["k", "sse", "phi"]
        plain = forecast.pick_best(forecast.smooth(arrays, ["k"], grid), ["k"], "sse").select(*cols).toPandas().set_index("k")
        got = forecast.smooth(arrays, ["k"], grid, search=True).select(*cols).toPandas().set_index("k")
        both = plain.join(got, rsuffix="_got").dropna()
        assert len(both) == 2 and (both["sse_got"] <= both["sse"] * (1 + 1e-12)).all()
        assert both["phi_got"].between(0.8, 1.0).all()
