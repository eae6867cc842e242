"""Cross-sectional ranks. All leave null values out of the population and give them null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewright import constants as C
from tapewright.functions.scalars import over


def pct_rank(x: str, *by: str) -> Column:
    """(below + half of the other ties) / (n - 1) among non-null members; null with fewer than two.

    The population is cut by ``x is null`` too, so that null rows don't count.
    """
    part = Window.partitionBy(*by, F.col(x).isNull())
    n = F.count(x).over(part)
    ties = F.count(x).over(Window.partitionBy(*by, x))
    below = F.rank().over(part.orderBy(x)) - 1
    return F.when(F.col(x).isNotNull() & (n >= 2), (below + 0.5 * (ties - 1)) / F.nullif(n - 1, F.lit(0)))


def at_or_below(x: str, *by: str) -> Column:
    """Share of the population at or below x."""
    return F.when(F.col(x).isNotNull(), F.cume_dist().over(Window.partitionBy(*by, F.col(x).isNull()).orderBy(x)))


def floor_quantile(values: Column, q: float) -> Column:
    """The element at floor(q * n), at most the last, of the sorted values of an array."""
    n = F.size(values)
    return F.when(n > 0, F.element_at(F.array_sort(values), F.least(F.floor(F.lit(q) * n), n - 1).cast("int") + 1))


def deciles(members: DataFrame, columns: list[str]) -> DataFrame:
    """attr, decile 1..9, value: floor quantiles of each column with at least MIN_DECILE values, rounded to 6 places."""
    long = members.unpivot(["symbol"], columns, "attr", "v").where("v is not null")
    arrays = long.groupBy("attr").agg(F.array_sort(F.collect_list("v")).alias("s")).where(F.size("s") >= C.MIN_DECILE)
    cut = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda q: F.struct(q.alias("decile"), F.element_at("s", F.least(F.floor(q / 10.0 * F.size("s")), F.size("s") - 1).cast("int") + 1).alias("v")))
    return arrays.select("attr", F.explode(cut).alias("x")).select("attr", F.col("x.decile").alias("decile"), F.round("x.v", 6).alias("value"))


def foreign_rank(probes: DataFrame, members: DataFrame, by: list[str]) -> DataFrame:
    """Where foreign values fall in a population: probes (symbol, attr, v and ``by``) against members (attr, m and ``by``).

    The rule is that of members, self included in neither ties nor n, so a value above all ranks n / (n - 1). The
    population is a snapshot of a few hundred members an attribute; it is aggregated to a sorted array and searched.
    """
    pop = members.where("m is not null").groupBy("attr", *by).agg(F.array_sort(F.collect_list("m")).alias("pop"))
    j = probes.join(pop, ["attr", *by], "left")
    below, same, n = F.size(F.filter("pop", lambda m: m < F.col("v"))), F.size(F.filter("pop", lambda m: m == F.col("v"))), F.size("pop")
    rank = F.when(F.col("v").isNotNull() & (n >= 2), (below + 0.5 * F.greatest(same - 1, F.lit(0))) / F.nullif(n - 1, F.lit(0)))
    return j.select(*probes.columns, rank.alias("rank"), F.when(F.col("pop").isNull(), 0).otherwise(n).alias("n"))


def ordinal(x: str, *by: str) -> Column:
    """k / (n - 1) in the order of x, ties by symbol."""
    part = Window.partitionBy(*by)
    return over((F.row_number().over(part.orderBy(x, "symbol")) - 1).cast("double"), (F.count("*").over(part) - 1).cast("double"))


def legs(df: DataFrame, signal: str, by: list[str], k: Column) -> DataFrame:
    """``df`` with n, k and leg: "low" for the first k rows by signal, "high" for the last k, else null; ties by symbol."""
    part = Window.partitionBy(*by)
    df = df.withColumn("rn", F.row_number().over(part.orderBy(signal, "symbol"))).withColumn("n", F.count("*").over(part)).withColumn("k", k)
    return df.withColumn("leg", F.when(F.col("rn") > F.col("n") - F.col("k"), "high").when(F.col("rn") <= F.col("k"), "low"))
