"""Summary statistics of small series: t-tests, clustered means, Newey-West errors, spanning regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewright.functions.scalars import over


def t_summary(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """n, mean, sd, t, smallest effect at t = 2, observations needed for t = 2, positive count."""
    g = df.where(F.col(x).isNotNull()).groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.sum((F.col(x) > 0).cast("int")).cast("long").alias("positive"))
    se = F.col("sd") / F.sqrt("n")
    return g.select(*by, "n", "mean", "sd", F.coalesce(over(F.col("mean"), se), F.lit(0.0)).alias("t"), (2 * se).alias("mde"), F.ceil(F.pow(over(2 * F.col("sd"), F.abs("mean")), 2)).cast("long").alias("needed"), "positive")


def welch(df: DataFrame, x: str, group: Column, by: list[str]) -> DataFrame:
    """Difference of means of rows where ``group`` holds and the others, and its t by separate variances."""
    df = df.withColumn("_g", group)
    yes, no = F.when(F.col("_g"), F.col(x)), F.when(~F.col("_g"), F.col(x))
    g = df.groupBy(*by).agg(F.count(yes).alias("n1"), F.count(no).alias("n0"), (F.avg(yes) - F.avg(no)).alias("diff"), F.var_samp(yes).alias("v1"), F.var_samp(no).alias("v0"))
    se = F.sqrt(over(F.col("v1"), F.col("n1").cast("double")) + over(F.col("v0"), F.col("n0").cast("double")))
    return g.select(*by, "n1", "n0", "diff", F.coalesce(over(F.col("diff"), se), F.lit(0.0)).alias("t"))


def clustered(df: DataFrame, x: str, by: list[str], date: str = "date") -> DataFrame:
    """Means within dates, then a t-test across them; under three dates no error and t = 0."""
    daily = df.where(F.col(x).isNotNull()).groupBy(*by, date).agg(F.avg(x).alias("m"))
    g = daily.groupBy(*by).agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"), F.count("*").alias("dates"))
    se = F.when(F.col("dates") >= 3, F.col("sd") / F.sqrt("dates")).otherwise(0.0)
    return g.select(*by, "mean", se.alias("se"), F.coalesce(over(F.col("mean"), se), F.lit(0.0)).alias("t"), "dates")


def newey_west(df: DataFrame, x: str, lags: int | Column, by: list[str], order: str = "date") -> DataFrame:
    """n, mean, se, t of an autocorrelated series, Bartlett kernel, autocovariances over n.

    Deviations meet their ``lags`` predecessors by exploded positions and one equi-join, as a window would need a
    column for each lag. ``lags`` may be one of the columns ``by``. Under three values or without variance, se and t are 0.
    """
    part = Window.partitionBy(*by)
    s = df.where(F.col(x).isNotNull()).select(*by, (F.row_number().over(part.orderBy(order)) - 1).alias("k"), (F.col(x) - F.avg(x).over(part)).alias("d"), F.avg(x).over(part).alias("mean"), F.count(x).over(part).alias("n"))
    later = s.select(*by, "n", "mean", "d", F.col("k").alias("_k"), F.explode(F.sequence(F.lit(0), F.least(F.lit(lags).cast("int"), F.col("n").cast("int") - 1))).alias("_lag")).withColumn("k", F.col("_k") - F.col("_lag"))
    pairs = later.join(s.select(*by, "k", F.col("d").alias("d0")), [*by, "k"])
    weight = F.when(F.col("_lag") == 0, 1.0).otherwise(2.0 * (1.0 - F.col("_lag") / (lags + 1.0)))
    g = pairs.groupBy(*by).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), (F.sum(weight * F.col("d") * F.col("d0")) / F.first("n")).alias("var"))
    ok = (F.col("var") > 0) & (F.col("n") >= 3)
    se = F.when(ok, F.sqrt(F.col("var") / F.col("n"))).otherwise(0.0)
    return g.select(*by, "n", "mean", se.alias("se"), F.coalesce(over(F.col("mean"), se), F.lit(0.0)).alias("t"))


def spanning(df: DataFrame, y: str, x: str, lags: int, per_year: int, by: list[str], order: str = "date") -> DataFrame:
    """Alpha of y on x by year with Newey-West errors, and beta; null under 24 values or without variance of x."""
    part = Window.partitionBy(*by)
    beta = over(F.covar_pop(y, x).over(part), F.var_pop(x).over(part))
    s = df.withColumn("_beta", beta).withColumn("_z", F.col(y) - F.col("_beta") * F.col(x))
    fit = newey_west(s, "_z", lags, by, order)
    betas = s.groupBy(*by).agg(F.first("_beta").alias("beta"))
    ok = (F.col("n") >= 24) & F.col("beta").isNotNull()
    return fit.join(betas, by).select(*by, "n", F.when(ok, F.col("beta")).alias("beta"), F.when(ok, F.col("mean") * per_year).alias("alpha"), F.when(ok, F.col("t")).alias("t"))
