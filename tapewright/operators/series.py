"""Per-symbol time series operators: windows over sessions, and first-order recursions in closed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewright import constants as C
from tapewright.functions.scalars import over

def sessions():
    """The window of a symbol's sessions; made on use, as windows need a running session."""
    return Window.partitionBy("symbol").orderBy("date")


def __getattr__(name: str):
    if name == "W":
        return sessions()
    raise AttributeError(name)


def back(n: int, end: int = 0):
    """The frame of rows -n .. end."""
    return sessions().rowsBetween(-n, end)


def indexed(df: DataFrame) -> DataFrame:
    """``df`` with i, the 0-based session number of each symbol."""
    return df.withColumn("i", F.row_number().over(sessions()) - 1)


def gated(x: Column, from_i: int) -> Column:
    """``x`` from session ``from_i`` on, null before."""
    return F.when(F.col("i") >= from_i, x)


def change(k: int, x: str = "close") -> Column:
    return over(F.col(x), F.lag(x, k).over(sessions())) - 1


def log_return(x: str = "close") -> Column:
    before = F.lag(x).over(sessions())
    return F.when((F.col(x) > 0) & (before > 0), F.ln(F.when(F.col(x) > 0, F.col(x)) / F.when(before > 0, before)))


def sma(n: int, x: str = "close") -> Column:
    return gated(F.avg(x).over(back(n - 1)), n - 1)


def bollinger(n: int = 20, width: float = 2.0) -> tuple[Column, Column, Column]:
    """Lower, middle and upper band around the mean, by the population deviation."""
    mid, sd = F.avg("close").over(back(n - 1)), F.stddev_pop("close").over(back(n - 1))
    return gated(mid - width * sd, n - 1), gated(mid, n - 1), gated(mid + width * sd, n - 1)


def rvol(n: int = 20) -> Column:
    """Volume over the mean of the n sessions before."""
    base = F.avg("volume").over(sessions().rowsBetween(-n, -1))
    return gated(F.when(base > 0, over(F.col("volume"), base)), n)


def vwap(n: int = 20) -> Column:
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    total = F.sum("volume").over(back(n - 1))
    return gated(F.when(total > 0, over(F.sum(typical * F.col("volume")).over(back(n - 1)), total)), n - 1)


def obv() -> Column:
    step = F.signum(F.col("close") - F.lag("close").over(sessions())) * F.col("volume")
    return step  # summed by with_running


def ad_step() -> Column:
    c, h, low = F.col("close"), F.col("high"), F.col("low")
    return F.when(h > low, over((c - low) - (h - c), h - low) * F.col("volume")).otherwise(0.0)


def running(step: str) -> Column:
    return F.coalesce(F.sum(step).over(sessions().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))


def up_down_ratio(n: int = 50) -> Column:
    """Volume of rising over that of falling sessions among the last n; needs ``d``, the change of the close."""
    frame = back(n - 1)
    up, down = F.sum(F.when(F.col("d") > 0, F.col("volume"))).over(frame), F.sum(F.when(F.col("d") < 0, F.col("volume"))).over(frame)
    return gated(F.when(down > 0, over(F.coalesce(up, F.lit(0.0)), down)), n)


def volume_trend(short: int = 20, long: int = 60) -> Column:
    slow = F.avg("volume").over(back(long - 1))
    return gated(F.when(slow > 0, over(F.avg("volume").over(back(short - 1)), slow)), long - 1)


def divergence(change20: Column, trend: Column) -> Column:
    rising, falling, heavy, light = change20 > 0.02, change20 < -0.02, trend > 1.15, trend < 0.85
    return F.when(change20.isNull() | trend.isNull(), None).when(rising & heavy, "confirmed").when(rising & light, "weak").when(falling & heavy, "washout").when(falling & light, "quiet").otherwise("mixed")


def annualised_vol(n: int = 60) -> Column:
    """Sample deviation of the last n log returns (column ``r``), by year."""
    return gated(F.when(F.count("r").over(back(n - 1)) >= 2, F.stddev_samp("r").over(back(n - 1)) * (252.0**0.5)), n)


def drawdown() -> Column:
    peak = F.max("close").over(sessions().rowsBetween(Window.unboundedPreceding, 0))
    return over(F.col("close"), peak) - 1


def momentum(months: int) -> Column:
    """Return over ``months`` that ends a month ago; only the start price is checked."""
    start = F.lag("close", months * C.MONTH).over(sessions())
    return F.when(start > 0, over(F.lag("close", C.MONTH).over(sessions()), start) - 1)


def nearness(skip: int = 0) -> Column:
    """Close over the highest high of the trailing year (column ``year_high``), as of ``skip`` sessions ago."""
    x = gated(over(F.col("close"), F.col("year_high")), C.YEAR)
    return x if not skip else F.lag("near", skip).over(sessions())


def forward(h: int) -> Column:
    return F.when(F.col("close") > 0, over(F.lead("close", h).over(sessions()), F.col("close")) - 1)


def forward_abs_log(h: int) -> Column:
    ahead = F.lead("close", h).over(sessions())
    return F.when((F.col("close") > 0) & (ahead > 0), F.abs(F.ln(over(ahead, F.col("close")))))


def recursive(df: DataFrame, x: str, out: str, alpha: float, n: int, first: str = "mean", keys: tuple[str, ...] = ("symbol",), order: str = "i", block: int = C.RECURSION_BLOCK) -> DataFrame:
    """y = alpha * x + (1 - alpha) * y before, from a seed over the first ``n`` values that are not null.

    ``first``: "mean" or "variance" (sample) of column ``seed_of`` = x or its root. Values count by their own order;
    where x is null so is y. In closed form, y is a cumulative sum of x times powers of 1 - alpha; sums start anew every
    ``block`` values, and the ends of blocks (few) are folded, so that no power overflows on long series.
    """
    d = 1.0 - alpha
    by = Window.partitionBy(*keys).orderBy(order)
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    k = F.when(F.col(x).isNotNull(), F.count(x).over(upto) - 1)
    df = df.withColumn("_k", k)
    early = F.when(F.col("_k") < n, F.col(x if first == "mean" else first))
    seed = (F.avg(early) if first == "mean" else F.var_samp(early)).over(upto)
    df = df.withColumn("_z", F.when(F.col("_k") == n - 1, seed).when(F.col("_k") >= n, alpha * F.col(x)))
    step = F.col("_k") - (n - 1)
    df = df.withColumn("_b", F.when(F.col("_k") >= n - 1, F.floor(step / block))).withColumn("_p", F.when(F.col("_k") >= n - 1, step % block).cast("double"))
    within = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_l", F.pow(F.lit(d), F.col("_p")) * F.sum(F.col("_z") * F.pow(F.lit(d), -F.col("_p"))).over(within))
    ends = F.collect_list(F.when(F.col("_p") == block - 1, F.col("_l"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_e", ends)
    before = F.aggregate("_e", F.lit(0.0), lambda acc, e: acc * d**block + e)
    return df.withColumn(out, F.when(F.col("_k") >= n - 1, F.col("_l") + F.pow(F.lit(d), F.col("_p") + 1) * before)).drop("_k", "_z", "_b", "_p", "_l", "_e")


def ema(df: DataFrame, n: int, x: str = "close", out: str | None = None) -> DataFrame:
    return recursive(df, x, out or f"ema{n}", 2.0 / (n + 1), n)


def rsi(df: DataFrame, n: int = 14, out: str = "rsi") -> DataFrame:
    """Wilder's index of the close (needs ``d``, its change); 100 where no loss is averaged."""
    df = df.withColumn("_up", F.when(F.col("d").isNotNull(), F.greatest("d", F.lit(0.0)))).withColumn("_down", F.when(F.col("d").isNotNull(), F.greatest(-F.col("d"), F.lit(0.0))))
    df = recursive(recursive(df, "_up", "_au", 1.0 / n, n), "_down", "_ad", 1.0 / n, n)
    ratio = over(F.col("_au"), F.col("_ad"))
    return df.withColumn(out, F.when(F.col("_ad").isNull(), None).when(F.col("_ad") == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + ratio))).drop("_up", "_down", "_au", "_ad")


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    df = ema(ema(df, fast, out="_f"), slow, out="_s").withColumn("macd", F.col("_f") - F.col("_s"))
    df = recursive(df, "macd", "macd_signal", 2.0 / (signal + 1), signal)
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("_f", "_s")


def atr(df: DataFrame, n: int = 14) -> DataFrame:
    """Wilder's mean true range; the first session has none."""
    before = F.lag("close").over(sessions())
    df = df.withColumn("_tr", F.when(before.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))))
    return recursive(df, "_tr", "atr", 1.0 / n, n).drop("_tr")


def ewma_vol(df: DataFrame, r: str = "r", out: str = "vol") -> DataFrame:
    """Daily volatility by exponential weights, seeded with the sample variance of the first returns."""
    df = recursive(df.withColumn("_r2", F.col(r) * F.col(r)), "_r2", "_var", 1.0 - C.LAMBDA, C.SEED_OBS, first=r)
    return df.withColumn(out, F.sqrt("_var")).drop("_r2", "_var")


def own_percentile(x: str, rows: int, least: int = 20) -> Column:
    """Share of the last ``rows`` values of a series that are at most the current one; null under ``least`` values."""
    seen = F.collect_list(x).over(back(rows - 1))
    return F.when(F.col(x).isNotNull() & (F.size(seen) >= least), F.size(F.filter(seen, lambda v: v <= F.col(x))) / F.size(seen))


def resample(df: DataFrame, unit: str) -> DataFrame:
    """Bars by week (from Monday) or month, stamped with their last session."""
    return df.groupBy("symbol", F.date_trunc(unit, "date").alias("_u")).agg(
        F.max("date").alias("date"), F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume")
    ).drop("_u")


def monthly_fold(df: DataFrame) -> DataFrame:
    return df.groupBy("symbol", F.trunc("date", "MM").alias("month")).agg(F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"))
