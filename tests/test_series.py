"""Values, scalar cross-checks and look-ahead of the series operators."""

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tapewright.operators import series as S
from tapewright.plans import battery_queries as B
from tapewright.plans import event_queries as E


def frame(spark, closes, volumes=None, symbol="A"):
    day = dt.date(2020, 1, 1)
    rows = [(symbol, day + dt.timedelta(days=k), c, c * 1.01, c * 0.99, c, float((volumes or [100.0] * len(closes))[k])) for k, c in enumerate(closes)]
    df = spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")
    return S.indexed(df).withColumn("d", F.col("close") - F.lag("close").over(S.W)).withColumn("r", S.log_return())


def values(df, col):
    return [r[col] for r in df.orderBy("date").select("date", col).collect()]


def walk(n, seed, sd=0.02):
    rng, out = random.Random(seed), [100.0]
    for _ in range(n - 1):
        out.append(out[-1] * math.exp(rng.gauss(0, sd)))
    return out


def scalar_ema(x, alpha, n, seed=statistics.mean):
    out, y = [None] * len(x), None
    for k, v in enumerate(x):
        if k == n - 1:
            y = seed(x[:n])
        elif k >= n:
            y = alpha * v + (1 - alpha) * y
        out[k] = y if k >= n - 1 else None
    return out


@pytest.mark.parametrize("n", [3, 20])
def test_sma_equals_a_loop(spark, n):
    x = walk(90, 11)
    got = values(frame(spark, x).withColumn("x", S.sma(n)), "x")
    for k, v in enumerate(got):
        assert v is None if k < n - 1 else abs(v - sum(x[k - n + 1 : k + 1]) / n) < 1e-9


@pytest.mark.parametrize("block", [1000, 7])
def test_ema_equals_the_recursion(spark, block):
    x = walk(300, 7)
    got = values(S.recursive(frame(spark, x), "close", "y", 2 / 13, 12, block=block), "y")
    for a, b in zip(got, scalar_ema(x, 2 / 13, 12)):
        assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-12))


def test_rsi_bounds_and_flat_series(spark):
    assert values(S.rsi(frame(spark, [5.0] * 30)), "rsi")[-1] == 100.0
    up = values(S.rsi(frame(spark, [float(k) for k in range(1, 60)])), "rsi")
    assert up[13] is None and up[14] == 100.0 and up[-1] == 100.0
    assert all(0 <= v <= 100 for v in values(S.rsi(frame(spark, walk(300, 7))), "rsi") if v is not None)


def test_macd_histogram_and_signal_start(spark):
    rows = S.macd(frame(spark, walk(120, 3))).orderBy("date").select("macd", "macd_signal", "macd_hist").collect()
    assert rows[24].macd is None and rows[25].macd is not None and rows[32].macd_signal is None and rows[33].macd_signal is not None
    assert all(math.isclose(r.macd_hist, r.macd - r.macd_signal, abs_tol=1e-12) for r in rows[33:])


def test_volume_rules(spark):
    spike = frame(spark, [10.0] * 30, [100.0] * 29 + [300.0])
    assert values(spike.withColumn("x", S.rvol()), "x")[-1] == 3.0
    assert values(spike.withColumn("x", S.rvol()), "x")[19] is None
    o = frame(spark, [10.0, 11.0, 12.0, 11.0], [100.0, 200.0, 300.0, 400.0]).withColumn("o", S.obv())
    assert values(o.withColumn("x", S.running("o")), "x") == [0.0, 200.0, 500.0, 100.0]
    flat = frame(spark, [float(k) for k in range(1, 70)]).withColumn("x", S.up_down_ratio())
    assert values(flat, "x")[-1] is None


def test_momentum_skips_the_last_month(spark):
    closes = [math.exp(0.001 * k) for k in range(300)]
    got = values(frame(spark, closes).withColumn("x", S.momentum(12)), "x")
    assert got[251] is None and math.isclose(got[-1], math.exp(0.001 * 231) - 1, rel_tol=1e-9)


def test_ewma_vol_seed_and_recursion(spark):
    x = walk(200, 13)
    r = [math.log(b / a) for a, b in zip(x, x[1:])]
    var = statistics.variance(r[:60])
    for v in r[60:]:
        var = 0.94 * var + 0.06 * v * v
    got = values(S.ewma_vol(frame(spark, x)), "vol")
    assert got[59] is None and math.isclose(got[60], statistics.stdev(r[:60]), rel_tol=1e-9) and math.isclose(got[-1], math.sqrt(var), rel_tol=1e-9)


def test_nothing_looks_ahead(spark):
    x, v = walk(330, 5), [float(100 + k % 37) for k in range(330)]

    def all_columns(closes, volumes):
        df = S.ewma_vol(S.atr(S.macd(S.rsi(frame(spark, closes, volumes)))))
        df = df.withColumns({"m": S.momentum(12), "rv": S.rvol(), "sd": S.annualised_vol(), "p": S.own_percentile("vol", 252), "vt": S.volume_trend()})
        return [tuple(round(y, 9) if isinstance(y, float) else y for y in row) for row in df.orderBy("date").select("rsi", "macd_hist", "atr", "vol", "m", "rv", "sd", "p", "vt").collect()]

    assert all_columns(x[:300], v[:300]) == all_columns(x, v)[:300]


def universe(spark, names=25, days=100, seed=3):
    """Residuals of some names, and a filing of either side of each name, so that every leg is the whole universe."""
    rng = random.Random(seed)
    rows = [(f"S{k}", i, dt.date(2020, 1, 1) + dt.timedelta(days=i), rng.gauss(0, 0.02)) for i in range(days) for k in range(names)]
    rng.shuffle(rows)
    ev = [(f"S{k}", i, side, False, side == "P") for i in range(days) for k in range(names) for side in "PS"]
    return spark.createDataFrame(ev, "symbol string, i int, side string, plan boolean, cluster boolean").repartition(7), spark.createDataFrame(rows, "symbol string, i int, date date, e double").repartition(5)


def test_leg_of_the_whole_universe_has_no_excess(spark):
    ev, res = universe(spark)
    assert sorted(tuple(r) for r in E.leg_alpha(ev, res, 21, 10).select("side", "n", "mean", "se", "t", "breadth", "car").collect()) == [(s, 99, 0.0, 0.0, 0.0, 25.0, 0.0) for s in "PS"]
    some = E.leg_alpha(ev.where("symbol <> 'S3'"), res, 21, 10).collect()
    assert len(some) == 2 and all(r["se"] > 1e-6 and r["breadth"] == 24 for r in some)


def test_gap_of_the_whole_universe_has_no_excess(spark):
    ev, res = universe(spark)
    rng = random.Random(4)
    rows = [(r.symbol, r.i, r.date, 100 * math.exp(rng.gauss(0, 0.02)), 100 * math.exp(rng.gauss(0, 0.02))) for r in res.collect()]
    bars = spark.createDataFrame(rows, "symbol string, i int, date date, open double, close double").repartition(5)
    assert sorted(tuple(r) for r in E.gap_split(ev, bars).select("side", "gap", "gap_t", "intraday", "intraday_t", "dates").collect()) == [(s, 0.0, None, 0.0, None, 99) for s in "PS"]
    some = E.gap_split(ev.where("symbol <> 'S3'"), bars).collect()
    assert len(some) == 2 and all(abs(r["gap"]) > 1e-7 and r["gap_t"] is not None for r in some)


def test_cells_of_the_whole_universe_have_no_excess(spark):
    ev, res = universe(spark)
    got = {r["cell"]: (r["n"], r["mean"], r["se"], r["t"], r["breadth"]) for r in B.insider_cells(ev, res, 21, 10).collect()}
    assert got == {c: (99, 0.0, 0.0, 0.0, 25.0) for c in ("purchases", "discretionary", "clustered", "sales")}


def test_windows_of_the_whole_universe_have_no_excess(spark):
    ev, res = universe(spark)
    got = {(r["side"], r["span"]): (r["n"], r["mean"], r["se"], r["t"], r["breadth"]) for r in B.insider_split(ev, res, 10).collect()}
    first = {"day 0": 0, "day 1": 1, "days 2-21": 2, "days 2-63": 2}
    assert got == {(side, span): (100 - at, 0.0, 0.0, 0.0, 25.0) for side in "PS" for span, at in first.items()}
