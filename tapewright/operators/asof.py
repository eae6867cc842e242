"""As-of and interval joins: sorted unions with one window, and holding windows as exploded sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof(left: DataFrame, right: DataFrame, at: Column, stamp: str, values: list[str], by: list[str], forward: bool = False, strict: Column | None = None) -> DataFrame:
    """``left`` with ``values`` of the last row of ``right`` before ``at`` (or the first after it).

    Equal stamps match unless ``strict`` holds for the left row. ``at`` and ``stamp`` are dates. Both sides are sorted
    together by key, so the plan is one exchange and one sort, with no range join.
    """
    strict = F.lit(False) if strict is None else strict
    mark = F.struct(*(F.col(v) for v in values))
    one = left.select(*[F.col(c) for c in left.columns], at.alias("_at"), strict.alias("_strict"))
    # a tie sorts before or after the right rows of its day, as strictness asks
    side = F.when(F.col("_strict"), F.lit(-1 if not forward else 1)).otherwise(F.lit(1 if not forward else -1))
    one = one.withColumn("_side", side).withColumn("_v", F.lit(None).cast(right.select(mark.alias("m")).schema[0].dataType))
    nothing = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in by]
    two = right.select(*by, *nothing, F.col(stamp).alias("_at"), F.lit(False).alias("_strict"), F.lit(0).alias("_side"), mark.alias("_v"))
    both = one.withColumn("_left", F.lit(True)).unionByName(two.withColumn("_left", F.lit(False)))
    w = Window.partitionBy(*by).orderBy("_at", "_side")
    found = F.first("_v", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)) if forward else F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    got = both.withColumn("_v", found).where("_left")
    return got.select(*left.columns, *(F.col("_v").getField(v).alias(v if v not in left.columns else f"{v}_asof") for v in values))


def holding(events: DataFrame, lag: int, h: int) -> DataFrame:
    """A row for each event and session of its window: column j = i + lag .. i + lag + h - 1."""
    return events.withColumn("j", F.explode(F.sequence(F.col("i") + lag, F.col("i") + (lag + h - 1))))


def cooled(df: DataFrame, cooldown: int, keys: tuple[str, ...] = ("symbol",), order: str = "i") -> DataFrame:
    """Events accepted greedily in order: each at least ``cooldown`` sessions after the last accepted one.

    Candidates of a key are few; they are folded as an array, and the accepted ones are exploded again.
    """
    start = F.struct(F.lit(-1_000_000_000).cast("long").alias("last"), F.array().cast("array<bigint>").alias("kept"))

    def step(acc, i):
        take = i - acc["last"] >= cooldown
        return F.struct(F.when(take, i).otherwise(acc["last"]).alias("last"), F.when(take, F.concat(acc["kept"], F.array(i))).otherwise(acc["kept"]).alias("kept"))

    kept = df.groupBy(*keys).agg(F.array_sort(F.collect_set(F.col(order).cast("long"))).alias("c")).select(*keys, F.explode(F.aggregate("c", start, step, lambda a: a["kept"])).alias(order))
    return df.withColumn(order, F.col(order).cast("long")).join(kept, [*keys, order], "left_semi")
