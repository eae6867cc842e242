"""Reading the base tables, and the domain views made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each brand: symbol, date, open, high, low, close, volume.

    The first and last price of a day are those of the least and greatest line in a total order. One partially
    aggregated pass over lineitem; the price and keys are the only columns read.
    """
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    px = F.col("l_extendedprice") / F.nullif("l_quantity", F.lit(0.0))
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return (
        line.join(part, line.l_partkey == part.p_partkey)
        .groupBy("symbol", F.to_date("l_shipdate").alias("date"))
        .agg(F.min_by(px, order).alias("open"), F.max(px).alias("high"), F.min(px).alias("low"), F.max_by(px, order).alias("close"), F.sum("l_quantity").alias("volume"))
    )


def _measures(lines: DataFrame, key: str, number) -> DataFrame:
    """Deterministic snapshot ratios of a group of lines, some of them null or negative."""
    g = lines.groupBy(key).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("e"), F.sum("l_quantity").alias("q"), F.round(F.avg("l_discount"), 8).alias("d"), F.round(F.avg("l_tax"), 8).alias("t")
    ).withColumn("k", number)
    k, e, d, t = (F.col(c) for c in ("k", "e", "d", "t"))
    pe = F.when(k % 7 == 0, None).when(k % 11 == 3, -5.0).otherwise(5.0 + (k * 29 % 31) * 0.7 + d * 20.0)
    return g.select(
        key,
        "k",
        F.when(k % 12 == 0, "ETF").otherwise("EQUITY").alias("quote_type"),
        e.alias("market_cap"),
        pe.alias("trailing_pe"),
        (pe * (0.8 + 0.05 * (k % 9))).alias("forward_pe"),
        (1.0 + (k % 13) * 0.37).alias("price_to_book"),
        F.when(k % 19 != 0, 0.5 + (k % 17) * 0.21).alias("price_to_sales"),
        F.when(k % 6 != 0, F.when(k % 10 == 7, -1.0).otherwise(4.0 + (k * 37 % 23) * 0.9 + d * 10.0)).alias("ev_ebitda"),
        (e * (t - 0.01 * (k % 5))).alias("free_cashflow"),
        F.when(k % 8 != 1, e * (t - 0.01)).alias("operating_cashflow"),
        ((k * 41 % 29) * 0.01 + d - 0.1).alias("return_on_equity"),
        F.when(k % 14 != 2, (k * 17 % 19) * 0.005 + t - 0.05).alias("return_on_assets"),
        F.when(k % 9 != 4, (k * 13 % 27) * 0.11 + d).alias("debt_to_equity"),
        ((k * 7 % 37) * 0.01 + t - 0.08).alias("operating_margin"),
        (0.01 * (k % 6)).alias("dividend_yield"),
        (0.6 + 0.05 * (k % 15)).alias("beta"),
    )


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot for each brand, persisted; its sector is the region of its first digit."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    region = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("sector"))
    got = _measures(line.join(part, line.l_partkey == part.p_partkey), "symbol", F.substring("symbol", 7, 2).cast("int"))
    return got.join(region, F.floor(F.col("k") / 10) - 1 == F.col("r_regionkey"), "left").drop("r_regionkey").persist()


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark: a member for each supplier with its region as sector, and eight factor inputs."""
    supp = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", F.col("r_name").alias("sector"))
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    m = _measures(line.withColumnRenamed("l_suppkey", "suppkey"), "suppkey", F.col("suppkey").cast("int"))
    from tapewright.functions.scalars import ebitda_yield, earnings_yield, fcf_yield

    return m.join(supp, m.suppkey == supp.s_suppkey).select(
        F.concat(F.lit("S"), "suppkey").alias("symbol"), "sector",
        F.when(F.col("k") % 16 != 5, (F.col("k") * 53 % 97) * 0.01 - 0.4).alias("momentum"),
        ebitda_yield(F.col("ev_ebitda")).alias("ebitda_yield"), fcf_yield(F.col("free_cashflow"), F.col("operating_cashflow"), F.col("market_cap")).alias("fcf_yield"),
        earnings_yield(F.col("trailing_pe")).alias("earnings_yield"), F.col("return_on_equity").alias("roe"), F.col("return_on_assets").alias("roa"),
        F.col("operating_margin"), (-F.col("debt_to_equity")).alias("low_leverage"),
    )


def announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, stamp: the first urgent order of each brand and quarter, persisted; odd orders are after the close."""
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    first = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("symbol", F.trunc("day", "quarter").alias("quarter")).agg(F.min(F.struct("day", "o_orderkey")).alias("x"))
    hour = F.when(F.col("x.o_orderkey") % 2 == 1, "T16:30:00-05:00").otherwise("T06:00:00-05:00")
    return first.select("symbol", F.concat(F.col("x.day").cast("string"), hour).alias("stamp")).persist()


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, filed, owner, side (P or S), dollars, plan: one row for each order and brand."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.to_date("o_orderdate").alias("filed"))
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    side = F.when(F.col("o_orderstatus") == "O", "P").otherwise("S")
    return (
        line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("symbol", "filed", F.col("o_custkey").alias("owner"), side.alias("side"), F.col("o_orderkey").alias("accession"))
        .agg(F.sum("l_extendedprice").alias("dollars"))
        .withColumn("plan", F.col("accession") % 3 == 0)
    )


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, exposure, kind: every third brand, and cash."""
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol")).distinct()
    k = F.substring("symbol", 7, 2).cast("int")
    held = part.where(k % 3 == 0).select("symbol", (k / 400.0).alias("exposure"), F.lit("position").alias("kind"))
    return held.unionByName(spark.createDataFrame([("CASH", 0.15, "cash")], "symbol string, exposure double, kind string"))
