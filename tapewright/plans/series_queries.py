"""Queries of the per-symbol series operators, each with independent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright import constants as C
from tapewright.functions import scalars as X
from tapewright.operators import series as S
from tapewright.plans import oracle as O
from tapewright.sources import tables as T

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def rounded(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), p) for c, p in places.items()})


def prepared(spark, sf_dir: str) -> DataFrame:
    """Bars with i, the close's change d and log return r.

    Persisted (to disk where memory is short): bars are small beside the lines they sum up, and stay partitioned by symbol
    and sorted by date, so that the windows of all that builds on them need no exchange.
    """
    df = S.indexed(T.bars(spark, sf_dir))
    return df.withColumn("d", F.col("close") - F.lag("close").over(S.W)).withColumn("r", S.log_return()).persist()


def last_row(df: DataFrame) -> DataFrame:
    return df.withColumn("_last", F.row_number().over(S.Window.partitionBy("symbol").orderBy(F.desc("date")))).where("_last = 1").drop("_last")


@query("bars_daily", O.sql(O.BARS, body="SELECT symbol, date, open, high, low, close, volume FROM bars"))
def bars_daily(spark, sf):
    return T.bars(spark, sf)


@query("bar_coercion", O.sql(O.BARS, body="""
SELECT symbol, date, CASE WHEN i % 9 = 3 THEN close WHEN i % 9 = 5 THEN close ELSE open END AS open, close, CASE WHEN i % 11 = 2 THEN 0 ELSE volume END AS volume
FROM s WHERE i % 13 <> 7"""))
def bar_coercion(spark, sf):
    """Scan rules: an open of null or 0 becomes the close, a null volume 0, a null close drops the row."""
    i = F.col("i")
    raw = S.indexed(T.bars(spark, sf)).select("symbol", "date", F.when(i % 9 == 3, 0.0).when(i % 9 == 5, F.lit("NaN").cast("double")).otherwise(F.col("open")).alias("open"), F.when(i % 13 != 7, F.col("close")).alias("close"), F.when(i % 11 != 2, F.col("volume")).alias("volume"))
    ok = raw.where(X.clean(F.col("close")).isNotNull())
    return ok.select("symbol", "date", X.or_else(X.clean(F.col("open")), F.col("close")).alias("open"), "close", F.coalesce("volume", F.lit(0.0)).alias("volume"))


@query("sma", O.sql(O.BARS, body="SELECT symbol, date, " + ", ".join(f"CASE WHEN i >= {n - 1} THEN round(avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING), 4) END AS sma{n}" for n in (20, 50, 200)) + " FROM s"))
def sma(spark, sf):
    return prepared(spark, sf).select("symbol", "date", *(F.round(S.sma(n), 4).alias(f"sma{n}") for n in (20, 50, 200)))


@query("bollinger", O.sql(O.BARS, body="""
SELECT symbol, date, CASE WHEN i >= 19 THEN round(m - 2 * sd, 3) END AS lower, CASE WHEN i >= 19 THEN round(m, 3) END AS middle, CASE WHEN i >= 19 THEN round(m + 2 * sd, 3) END AS upper
FROM (SELECT *, avg(close) OVER w AS m, stddev_pop(close) OVER w AS sd FROM s WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING))"""))
def bollinger(spark, sf):
    low, mid, up = S.bollinger()
    return prepared(spark, sf).select("symbol", "date", F.round(low, 3).alias("lower"), F.round(mid, 3).alias("middle"), F.round(up, 3).alias("upper"))


@query("volume_analytics", O.sql(O.BARS, body="""
SELECT symbol, date, CASE WHEN i >= 20 THEN round(volume / nullif(avg(volume) OVER b, 0), 6) END AS rvol,
  CASE WHEN i >= 19 THEN round(sum((high + low + close) / 3 * volume) OVER v / nullif(sum(volume) OVER v, 0), 3) END AS vwap,
  close * volume AS dollar_volume, coalesce(sum(sign(d) * volume) OVER a, 0) AS obv,
  round(sum(CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) * volume ELSE 0 END) OVER a, 4) AS ad_line,
  CASE WHEN i >= 50 THEN round(coalesce(sum(CASE WHEN d > 0 THEN volume END) OVER f, 0) / nullif(sum(CASE WHEN d < 0 THEN volume END) OVER f, 0), 6) END AS up_down
FROM s WINDOW b AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), v AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING),
  a AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING)"""))
def volume_analytics(spark, sf):
    df = prepared(spark, sf).withColumn("_o", S.obv()).withColumn("_a", S.ad_step())
    return df.select("symbol", "date", F.round(S.rvol(), 6).alias("rvol"), F.round(S.vwap(), 3).alias("vwap"), (F.col("close") * F.col("volume")).alias("dollar_volume"), S.running("_o").alias("obv"), F.round(S.running("_a"), 4).alias("ad_line"), F.round(S.up_down_ratio(), 6).alias("up_down"))


@query("divergence", O.sql(O.BARS, body="""
SELECT symbol, date, round(t, 6) AS volume_trend, CASE WHEN c IS NULL OR t IS NULL THEN NULL WHEN c > 0.02 AND t > 1.15 THEN 'confirmed' WHEN c > 0.02 AND t < 0.85 THEN 'weak'
  WHEN c < -0.02 AND t > 1.15 THEN 'washout' WHEN c < -0.02 AND t < 0.85 THEN 'quiet' ELSE 'mixed' END AS label
FROM (SELECT symbol, date, CASE WHEN i >= 60 THEN close / lag(close, 20) OVER (PARTITION BY symbol ORDER BY date) - 1 END AS c,
  CASE WHEN i >= 59 THEN avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING) / nullif(avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS 59 PRECEDING), 0) END AS t FROM s)"""))
def divergence(spark, sf):
    df = prepared(spark, sf).withColumn("c", S.gated(S.change(20), 60)).withColumn("t", S.volume_trend())
    return df.select("symbol", "date", F.round("t", 6).alias("volume_trend"), S.divergence(F.col("c"), F.col("t")).alias("label"))


@query("returns", O.sql(O.BARS, body="SELECT symbol, date, round(r, 8) AS log_return, round(abs(close / nullif(lag(close) OVER w, 0) - 1), 6) AS abs_move, round(ln(open / lag(close) OVER w), 8) AS gap, round(ln(close / open), 8) AS intraday, "
    + ", ".join(f"round(close / nullif(lag(close, {k}) OVER w, 0) - 1, 6) AS change_{n}" for n, k in C.CHANGES.items()) + " FROM s WINDOW w AS (PARTITION BY symbol ORDER BY date)"))
def returns(spark, sf):
    before = F.lag("close").over(S.W)
    return prepared(spark, sf).select("symbol", "date", F.round("r", 8).alias("log_return"), F.round(F.abs(S.change(1)), 6).alias("abs_move"), F.round(F.ln(X.over(F.col("open"), before)), 8).alias("gap"), F.round(F.ln(X.over(F.col("close"), F.col("open"))), 8).alias("intraday"), *(F.round(S.change(k), 6).alias(f"change_{n}") for n, k in C.CHANGES.items()))


@query("volatility_drawdown", O.sql(O.BARS, body="""
SELECT symbol, date, CASE WHEN i >= 60 THEN round(stddev_samp(r) OVER (PARTITION BY symbol ORDER BY date ROWS 59 PRECEDING) * sqrt(252), 6) END AS annual_vol,
  round(close / peak - 1, 6) AS drawdown, round(least(0, min(close / peak - 1) OVER (PARTITION BY symbol ORDER BY date)), 6) AS max_drawdown
FROM (SELECT *, max(close) OVER (PARTITION BY symbol ORDER BY date) AS peak FROM s)"""))
def volatility_drawdown(spark, sf):
    df = prepared(spark, sf).withColumn("dd", S.drawdown())
    worst = F.least(F.lit(0.0), F.min("dd").over(S.W.rowsBetween(S.Window.unboundedPreceding, 0)))
    return df.select("symbol", "date", F.round(S.annualised_vol(), 6).alias("annual_vol"), F.round("dd", 6).alias("drawdown"), F.round(worst, 6).alias("max_drawdown"))


def with_momentum(df: DataFrame) -> DataFrame:
    return df.withColumn("mom_12_1", S.momentum(12)).withColumn("mom_6_1", S.momentum(6)).withColumn("mom_3_1", S.momentum(3)).withColumn("ret_1m", S.change(C.MONTH))


@query("momentum", O.sql(O.BARS, O.MOMENTUM, body="SELECT symbol, date, round(mom_12_1, 6) AS mom_12_1, round(mom_6_1, 6) AS mom_6_1, round(mom_3_1, 6) AS mom_3_1, round(ret_1m, 6) AS ret_1m FROM mom"))
def momentum(spark, sf):
    return rounded(with_momentum(prepared(spark, sf)).select("symbol", "date", "mom_12_1", "mom_6_1", "mom_3_1", "ret_1m"), mom_12_1=6, mom_6_1=6, mom_3_1=6, ret_1m=6)


@query("nearness", O.sql(O.BARS, body="""
SELECT symbol, date, round(near, 6) AS nearness, round(lag(near, 21) OVER (PARTITION BY symbol ORDER BY date), 6) AS nearness_skip, round(fwd, 6) AS forward_21, round(pos, 6) AS range_position FROM (
SELECT symbol, date, CASE WHEN i >= 252 THEN close / max(high) OVER w END AS near, lead(close, 21) OVER (PARTITION BY symbol ORDER BY date) / close - 1 AS fwd,
  CASE WHEN max(high) OVER w > min(low) OVER w THEN least(1, greatest(0, (close - min(low) OVER w) / (max(high) OVER w - min(low) OVER w))) END AS pos
FROM s WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 251 PRECEDING))"""))
def nearness(spark, sf):
    df = prepared(spark, sf).withColumn("year_high", F.max("high").over(S.back(251))).withColumn("year_low", F.min("low").over(S.back(251))).withColumn("near", S.nearness())
    return df.select("symbol", "date", F.round("near", 6).alias("nearness"), F.round(S.nearness(21), 6).alias("nearness_skip"), F.round(S.forward(21), 6).alias("forward_21"), F.round(X.range_position(F.col("close"), F.col("year_low"), F.col("year_high")), 6).alias("range_position"))


for _unit in ("week", "month"):

    def _resample(spark, sf, unit=_unit):
        return S.resample(T.bars(spark, sf), unit)

    query(f"resample_{_unit}", O.sql(O.BARS, body=f"SELECT symbol, max(date) AS date, first(open ORDER BY date) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY date) AS close, sum(volume) AS volume FROM bars GROUP BY symbol, date_trunc('{_unit}', date)"))(_resample)


@query("monthly_fold", O.sql(O.BARS, body="SELECT symbol, date_trunc('month', date)::DATE AS month, arg_max(close, date) AS close, sum(volume) AS volume FROM bars GROUP BY ALL"))
def monthly_fold(spark, sf):
    return S.monthly_fold(T.bars(spark, sf))


def _step_sql(name: str, x: str, n: int, alpha: float, seed: str = "avg", first: int = 0) -> str:
    """A recursive CTE that walks a series row by row from its seed at row first + n - 1."""
    return f"""{name} AS MATERIALIZED (WITH RECURSIVE go(symbol, i, y) AS (
      SELECT symbol, {first + n - 1}, {seed}({x}) FROM s WHERE i BETWEEN {first} AND {first + n - 1} GROUP BY symbol HAVING count(*) = {n}
      UNION ALL SELECT s.symbol, s.i::INT, {alpha!r}::DOUBLE * ({x}) + (1 - {alpha!r}::DOUBLE) * go.y FROM go JOIN s ON s.symbol = go.symbol AND s.i = go.i + 1) SELECT * FROM go)"""


@query("ema", O.sql(O.BARS, _step_sql("e12", "close", 12, 2 / 13), _step_sql("e26", "close", 26, 2 / 27), body="SELECT symbol, date, round(e12.y, 4) AS ema12, round(e26.y, 4) AS ema26 FROM s LEFT JOIN e12 USING (symbol, i) LEFT JOIN e26 USING (symbol, i)"))
def ema(spark, sf):
    return rounded(S.ema(S.ema(prepared(spark, sf), 12), 26).select("symbol", "date", "ema12", "ema26"), ema12=4, ema26=4)


@query("rsi", O.sql(O.BARS, _step_sql("up", "greatest(d, 0)", 14, 1 / 14, first=1), _step_sql("dn", "greatest(-d, 0)", 14, 1 / 14, first=1), body="SELECT symbol, date, round(CASE WHEN dn.y IS NULL THEN NULL WHEN dn.y = 0 THEN 100 ELSE 100 - 100 / (1 + up.y / dn.y) END, 6) AS rsi FROM s LEFT JOIN up USING (symbol, i) LEFT JOIN dn USING (symbol, i)"))
def rsi(spark, sf):
    return rounded(S.rsi(prepared(spark, sf)).select("symbol", "date", "rsi"), rsi=6)


_MACD = [_step_sql("e12", "close", 12, 2 / 13), _step_sql("e26", "close", 26, 2 / 27), "line AS MATERIALIZED (SELECT symbol, i, e12.y - e26.y AS m FROM e12 JOIN e26 USING (symbol, i))",
    f"""sig AS MATERIALIZED (WITH RECURSIVE go(symbol, i, y) AS (SELECT symbol, 33, avg(m) FROM line WHERE i BETWEEN 25 AND 33 GROUP BY symbol HAVING count(*) = 9
      UNION ALL SELECT l.symbol, l.i::INT, {0.2!r}::DOUBLE * m + (1 - {0.2!r}::DOUBLE) * go.y FROM go JOIN line l ON l.symbol = go.symbol AND l.i = go.i + 1) SELECT * FROM go)"""]  # fmt: skip


@query("macd", O.sql(O.BARS, *_MACD, body="SELECT symbol, date, round(m, 4) AS macd, round(sig.y, 4) AS macd_signal, round(m - sig.y, 4) AS macd_hist FROM s LEFT JOIN line USING (symbol, i) LEFT JOIN sig USING (symbol, i)"))
def macd(spark, sf):
    return rounded(S.macd(prepared(spark, sf)).select("symbol", "date", "macd", "macd_signal", "macd_hist"), macd=4, macd_signal=4, macd_hist=4)


_TR = "t AS MATERIALIZED (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS pc FROM s))"


@query("atr", O.sql(O.BARS, _TR, _step_sql("a", "tr", 14, 1 / 14, first=1).replace("FROM s ", "FROM t ").replace("JOIN s ON s.", "JOIN t ON t.").replace("s.symbol, s.i", "t.symbol, t.i").replace("AND s.i", "AND t.i"), body="SELECT symbol, date, round(a.y, 4) AS atr FROM s LEFT JOIN a USING (symbol, i)"))
def atr(spark, sf):
    return rounded(S.atr(prepared(spark, sf)).select("symbol", "date", "atr"), atr=4)


@query("ewma_vol", O.sql(O.BARS, O.VOL, body="SELECT symbol, date, round(vol, 8) AS vol FROM vol"))
def ewma_vol(spark, sf):
    return rounded(S.ewma_vol(prepared(spark, sf)).select("symbol", "date", "vol"), vol=8)


@query("kdj", None)
def kdj(spark, sf):
    """The public 9-3-3 stochastic: K and D start at 50 and move a third of the way; J = 3K - 2D."""
    low, high = F.min("low").over(S.back(8)), F.max("high").over(S.back(8))
    df = prepared(spark, sf).withColumn("rsv", S.gated(F.when(high > low, X.over(F.col("close") - low, high - low) * 100).otherwise(50.0), 8))
    df = S.recursive(df.withColumn("_s", F.when(F.col("i") == 8, 50.0 + (F.col("rsv") - 50.0) / 3).otherwise(F.col("rsv"))), "_s", "k", 1 / 3, 1)
    df = S.recursive(df.withColumn("_s", F.when(F.col("i") == 8, 50.0 + (F.col("k") - 50.0) / 3).otherwise(F.col("k"))), "_s", "dd", 1 / 3, 1)
    return df.select("symbol", "date", F.round("k", 6).alias("k"), F.round("dd", 6).alias("d"), F.round(3 * F.col("k") - 2 * F.col("dd"), 6).alias("j"))


_KDJ = """
x AS MATERIALIZED (SELECT symbol, date, i, CASE WHEN hi > lo THEN (close - lo) / (hi - lo) * 100 ELSE 50 END AS rsv FROM (SELECT *, min(low) OVER w AS lo, max(high) OVER w AS hi FROM s WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 8 PRECEDING)) WHERE i >= 8),
kd AS MATERIALIZED (WITH RECURSIVE go(symbol, i, k, d) AS (SELECT symbol, 8, 50 + (rsv - 50) / 3, 50 + (50 + (rsv - 50) / 3 - 50) / 3 FROM x WHERE i = 8
  UNION ALL SELECT x.symbol, x.i::INT, k + (rsv - k) / 3, d + (k + (rsv - k) / 3 - d) / 3 FROM go JOIN x ON x.symbol = go.symbol AND x.i = go.i + 1) SELECT * FROM go)"""
SQL["kdj"] = O.sql(O.BARS, _KDJ, body="SELECT symbol, date, round(k, 6) AS k, round(kd.d, 6) AS d, round(3 * k - 2 * kd.d, 6) AS j FROM s LEFT JOIN kd USING (symbol, i)")


@query("calendar_parts", O.sql(O.BARS, body="""
SELECT DISTINCT date, strftime(date, '%Y-%m') AS month, year(date) || 'Q' || quarter(date) AS quarter, isoyear(date)::INT AS iso_year, week(date)::INT AS iso_week,
  (date_trunc('month', date)::DATE + ((12 - isodow(date_trunc('month', date))) % 7)::INT) AS first_friday, (isodow(date) - 1)::INT AS weekday,
  CASE WHEN isodow(date) = 5 THEN date + 3 WHEN isodow(date) = 6 THEN date + 2 ELSE date + 1 END AS next_weekday, (date_trunc('month', date) + INTERVAL 3 MONTH)::DATE AS month_later FROM bars"""))
def calendar_parts(spark, sf):
    d = F.col("date")
    return T.bars(spark, sf).select("date").distinct().select("date", X.month_key(d).alias("month"), X.quarter_key(d).alias("quarter"), F.extract(F.lit("YEAROFWEEK"), d).cast("int").alias("iso_year"), F.weekofyear(d).alias("iso_week"), X.first_friday(d).alias("first_friday"), F.weekday(d).alias("weekday"), F.element_at(X.future_weekdays(d, 10), 1).alias("next_weekday"), F.add_months(F.trunc(d, "MM"), 3).alias("month_later"))


@query("turn_of_month", O.sql(O.BARS, body="""
SELECT symbol, date, pos, pos <= 3 OR coalesce(last_of_month, false) AS tom, pos BETWEEN 9 AND 12 AS placebo FROM (
 SELECT symbol, date, row_number() OVER (PARTITION BY symbol, date_trunc('month', date) ORDER BY date)::INT AS pos, date_trunc('month', lead(date) OVER (PARTITION BY symbol ORDER BY date)) <> date_trunc('month', date) AS last_of_month,
  date_trunc('month', date) AS m, min(date_trunc('month', date)) OVER (PARTITION BY symbol) AS m0, max(date_trunc('month', date)) OVER (PARTITION BY symbol) AS m1 FROM bars) WHERE m > m0 AND m < m1"""))
def turn_of_month(spark, sf):
    df = with_month_position(T.bars(spark, sf))
    return df.select("symbol", "date", "pos", "tom", "placebo")


def with_month_position(df: DataFrame) -> DataFrame:
    """Position within the month, turn-of-month and placebo flags; the first and last month of a symbol are left out."""
    m = F.trunc("date", "MM")
    sym = S.Window.partitionBy("symbol")
    df = df.withColumn("m", m).withColumn("pos", F.row_number().over(S.Window.partitionBy("symbol", "m").orderBy("date"))).withColumn("_next", F.lead("m").over(S.W))
    df = df.withColumn("_m0", F.min("m").over(sym)).withColumn("_m1", F.max("m").over(sym)).where("m > _m0 AND m < _m1")
    return df.withColumn("tom", (F.col("pos") <= 3) | F.coalesce(F.col("_next") != F.col("m"), F.lit(False))).withColumn("placebo", F.col("pos").between(9, 12))
