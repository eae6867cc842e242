"""Damped-drift forecast of monthly closes: P * exp(mu * sum of phi^k), with a band of the recent monthly volatility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewright.functions.scalars import over

PHI, LAMBDA, LEAST, HORIZONS, Z = 0.92, 0.97, 24, (3, 6, 12), 1.6449


def forecast(monthly: DataFrame) -> DataFrame:
    """symbol, horizon, last_month, point, low, high for symbols with at least 24 months, the last one left out as partial."""
    w = Window.partitionBy("symbol").orderBy("month")
    m = monthly.withColumn("_left", F.count("*").over(Window.partitionBy("symbol")) - F.row_number().over(w)).where("_left > 0")
    r = m.withColumn("r", F.ln(over(F.col("close"), F.lag("close").over(w)))).withColumn("age", F.col("_left") - 1)
    weight = F.pow(F.lit(LAMBDA), F.col("age"))
    g = r.groupBy("symbol").agg(F.count("*").alias("n"), F.max("month").alias("last_month"), F.max_by("close", "month").alias("last"), F.avg("r").alias("mu"), F.sqrt(F.sum(weight * F.col("r") * F.col("r")) / F.sum(F.when(F.col("r").isNotNull(), weight))).alias("vol")).where(F.col("n") >= LEAST)
    g = g.withColumn("horizon", F.explode(F.array(*map(F.lit, HORIZONS))))
    drift = F.col("mu") * PHI * (1 - F.pow(F.lit(PHI), F.col("horizon"))) / (1 - PHI)
    half = Z * F.col("vol") * F.sqrt("horizon")
    return g.select("symbol", "horizon", "last_month", F.round(F.col("last") * F.exp(drift), 4).alias("point"), F.round(F.col("last") * F.exp(drift - half), 4).alias("low"), F.round(F.col("last") * F.exp(drift + half), 4).alias("high"))
