"""Connected components of an edge table by alternating stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import materialize, release


def _stats(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component: the smallest id that each id is joined to, for ids with an edge; ids without are left out.

    A round links every vertex's larger neighbours to its smallest one (large star), then its smaller neighbours and
    itself to the smallest of them (small star). Only minima are gathered by vertex, with partial aggregation, and rows of a
    vertex with many edges can be split in the joins. Null ends and loops are ignored.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = materialize(e.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges")
    before = _stats(e)
    while True:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        linked = large.join(small, "hi")
        e2 = linked.select(F.explode(F.array(F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("x")).select("x.*").where("hi <> lo").distinct()
        e2 = materialize(e2, "edges")
        release(e)
        e, after = e2, _stats(e2)
        if after == before:
            return e.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(e.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())
        before = after
