"""Cross-sections: factor views, valuation ranks, benchmark ranks, portfolio, screening row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewright import constants as C
from tapewright.functions import scalars as X
from tapewright.operators import ranks as R
from tapewright.operators import series as S
from tapewright.plans import oracle as O
from tapewright.plans.series_queries import last_row, prepared, with_momentum
from tapewright.sources import tables as T

QUERIES: dict = {}
SQL: dict[str, str] = {}
VALUE = ("ebitda_yield", "fcf_yield", "earnings_yield")
QUALITY = ("roe", "roa", "operating_margin", "low_leverage")


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def factor_inputs(f: DataFrame) -> DataFrame:
    """The seven ratios of a snapshot, higher always better, and fund."""
    return f.select(
        "symbol", "sector", "quote_type", X.is_fund(F.col("quote_type")).alias("fund"),
        X.ebitda_yield(F.col("ev_ebitda")).alias("ebitda_yield"), X.fcf_yield(F.col("free_cashflow"), F.col("operating_cashflow"), F.col("market_cap")).alias("fcf_yield"), X.earnings_yield(F.col("trailing_pe")).alias("earnings_yield"),
        F.col("return_on_equity").alias("roe"), F.col("return_on_assets").alias("roa"), "operating_margin", (-F.col("debt_to_equity")).alias("low_leverage"),
    )


def mean_of(columns) -> F.Column:
    """Mean of the columns that are not null."""
    got = F.array_compact(F.array(*columns))
    return F.when(F.size(got) > 0, F.aggregate(got, F.lit(0.0), lambda a, x: a + x) / F.size(got))


def used(names, ranks) -> F.Column:
    return F.array_compact(F.array(*(F.when(r.isNotNull(), F.lit(n)) for n, r in zip(names, ranks))))


def factor_views(bars: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """Momentum rank, value and quality scores with the metrics behind them, trap and reversal flags, notes.

    A symbol without a snapshot counts as a fund; funds have raw momentum only. Under MIN_COMPANIES companies all scores
    are withheld.
    """
    mom = last_row(with_momentum(bars)).select("symbol", "mom_12_1", "ret_1m")
    inputs = factor_inputs(fundamentals)
    n = inputs.where("NOT fund").agg(F.count("*").alias("universe_n"))
    df = mom.join(inputs, "symbol", "left").withColumn("fund", F.coalesce("fund", F.lit(True))).crossJoin(F.broadcast(n))  # one row
    df = df.withColumn("ranked", ~F.col("fund") & (F.col("universe_n") >= C.MIN_COMPANIES))
    company = inputs.where("NOT fund").join(mom.select("symbol", "mom_12_1"), "symbol", "left")
    metrics = ["mom_12_1", *VALUE, *QUALITY]
    long = company.unpivot(["symbol"], metrics, "metric", "v").select("symbol", "metric", R.pct_rank("v", "metric").alias("r"))
    ranks = long.groupBy("symbol").agg(*(F.max(F.when(F.col("metric") == c, F.col("r"))).alias(f"rank_{c}") for c in metrics))
    df = df.join(ranks, "symbol", "left")
    rank = lambda c: F.when(F.col("ranked"), F.col(f"rank_{c}"))
    df = df.withColumn("mom_rank", rank("mom_12_1"))
    for name, columns in (("value", VALUE), ("quality", QUALITY)):
        r = [rank(c) for c in columns]
        df = df.withColumn(f"{name}_score", mean_of(r)).withColumn(f"{name}_used", used(columns, r))
    df = df.withColumn("value_trap", F.coalesce((F.col("value_score") >= 2 / 3) & (F.col("quality_score") <= 1 / 3) & (F.size("value_used") >= 2), F.lit(False)))
    tension = (F.abs("ret_1m") > 0.05) & ((F.col("ret_1m") > 0) != (F.col("mom_12_1") > 0))
    df = df.withColumn("reversal_tension", F.coalesce(F.col("ranked") & tension, F.lit(False)))
    notes = F.array_compact(F.array(
        F.when(F.col("universe_n") < C.MIN_COMPANIES, F.lit("thin")), F.when(F.col("fund"), F.lit("fund")), F.when(F.col("value_trap"), F.lit("trap")), F.when(F.col("reversal_tension"), F.lit("reversal")),
        F.when(F.col("ranked") & (F.size("value_used") == 0), F.lit("no valuation")), F.when(F.col("ranked") & (F.size("value_used") == 1), F.lit("single metric")),
    ))
    return df.withColumn("value_low_confidence", F.col("ranked") & (F.size("value_used") < 2)).withColumn("notes", notes)


_INPUTS = """
inp AS MATERIALIZED (SELECT symbol, sector, upper(coalesce(quote_type, '')) IN ('ETF', 'MUTUALFUND', 'INDEX') AS fund, CASE WHEN ev_ebitda > 0 THEN 1 / ev_ebitda END AS ebitda_yield,
  CASE WHEN operating_cashflow IS NULL OR free_cashflow <= operating_cashflow THEN free_cashflow / nullif(market_cap, 0) END AS fcf_yield, CASE WHEN trailing_pe > 0 THEN 1 / trailing_pe END AS earnings_yield,
  return_on_equity AS roe, return_on_assets AS roa, operating_margin, -debt_to_equity AS low_leverage FROM f),
lastm AS MATERIALIZED (SELECT * FROM mom QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1),
n AS (SELECT count(*) AS universe_n FROM inp WHERE NOT fund),
co AS MATERIALIZED (SELECT inp.*, mom_12_1 FROM inp LEFT JOIN lastm USING (symbol) WHERE NOT fund)"""


def _rank_sql(c: str) -> str:
    others = f"(SELECT count({c}) FROM co)"
    return f"CASE WHEN co.{c} IS NOT NULL AND {others} >= 2 THEN ((SELECT count(*) FROM co o WHERE o.{c} < co.{c}) + 0.5::DOUBLE * ((SELECT count(*) FROM co o WHERE o.{c} = co.{c}) - 1)) / ({others} - 1) END AS r_{c}"


_FACTORS = _INPUTS + ",\nrk AS MATERIALIZED (SELECT symbol, " + ", ".join(_rank_sql(c) for c in ("mom_12_1", *VALUE, *QUALITY)) + """ FROM co),
fv AS MATERIALIZED (SELECT lastm.symbol, coalesce(fund, true) AS fund, universe_n, lastm.mom_12_1, ret_1m, CASE WHEN universe_n >= 5 THEN r_mom_12_1 END AS mom_rank,
  CASE WHEN universe_n >= 5 THEN list_avg([r_ebitda_yield, r_fcf_yield, r_earnings_yield]) END AS value_score, CASE WHEN universe_n >= 5 THEN list_avg([r_roe, r_roa, r_operating_margin, r_low_leverage]) END AS quality_score,
  (r_ebitda_yield IS NOT NULL)::INT + (r_fcf_yield IS NOT NULL)::INT + (r_earnings_yield IS NOT NULL)::INT AS value_n
  FROM lastm LEFT JOIN inp USING (symbol) LEFT JOIN rk USING (symbol), n)"""


@query("factor_views", O.sql(O.BARS, O.FUNDAMENTALS, O.MOMENTUM, _FACTORS, body="""
SELECT symbol, fund, universe_n, round(mom_12_1, 6) AS mom_12_1, round(mom_rank, 6) AS mom_rank, round(value_score, 6) AS value_score, round(quality_score, 6) AS quality_score, value_n,
  coalesce(value_score >= 2 / 3::DOUBLE AND quality_score <= 1 / 3::DOUBLE AND value_n >= 2, false) AS value_trap,
  coalesce(NOT fund AND universe_n >= 5 AND abs(ret_1m) > 0.05 AND (ret_1m > 0) <> (mom_12_1 > 0), false) AS reversal_tension FROM fv"""))
def q_factor_views(spark, sf):
    v = factor_views(prepared(spark, sf), T.fundamentals(spark, sf))
    return v.select("symbol", "fund", "universe_n", F.round("mom_12_1", 6).alias("mom_12_1"), F.round("mom_rank", 6).alias("mom_rank"), F.round("value_score", 6).alias("value_score"), F.round("quality_score", 6).alias("quality_score"), F.size("value_used").alias("value_n"), "value_trap", "reversal_tension")


def valuations(f: DataFrame) -> DataFrame:
    """Peer group, at-or-below percentile, group median and count for four ratios, yields and a forward note.

    Peers are the sector with at least MIN_SECTOR_PEERS companies, else all companies; a ratio needs two values.
    """
    f = f.withColumn("fund", X.is_fund(F.col("quote_type")))
    co = f.where("NOT fund").withColumn("in_sector", F.when(F.col("sector").isNotNull(), F.count("*").over(Window.partitionBy("sector"))).otherwise(0)).withColumn("by_sector", F.col("in_sector") >= C.MIN_SECTOR_PEERS).withColumn("all", F.lit(1))
    metrics = ["trailing_pe", "forward_pe", "price_to_book", "price_to_sales"]
    long = co.withColumns({m: X.positive(F.col(m)) for m in metrics}).unpivot(["symbol", "sector", "by_sector", "all"], metrics, "metric", "v").where("v is not null")
    s, a = Window.partitionBy("sector", "metric"), Window.partitionBy("all", "metric")
    pick = lambda x, y: F.when(F.col("by_sector"), x).otherwise(y)
    at = long.withColumn("n", pick(F.count("v").over(s), F.count("v").over(a))).withColumn("p", pick(F.cume_dist().over(s.orderBy("v")), F.cume_dist().over(a.orderBy("v")))).withColumn("med", pick(F.median("v").over(s), F.median("v").over(a)))
    wide = at.where("n >= 2").groupBy("symbol").pivot("metric", metrics).agg(F.first("p").alias("percentile"), F.first("n").alias("count"), F.first("med").alias("median"))
    group = F.when(F.col("fund"), "fund").when(F.col("by_sector"), F.col("sector")).otherwise("tracked universe")
    out = f.join(co.select("symbol", "by_sector"), "symbol", "left").join(wide, "symbol", "left").withColumn("peer_group", group)
    ratio = X.over(F.col("forward_pe"), F.col("trailing_pe"))
    note = F.when((F.col("trailing_pe") > 0) & (F.col("forward_pe") > 0), F.when(ratio < 0.9, "growing").when(ratio > 1.1, "shrinking"))
    return out.withColumn("earnings_yield", F.when(~F.col("fund"), X.earnings_yield(F.col("trailing_pe")))).withColumn("note", F.when(~F.col("fund"), note))


_METRICS = ("trailing_pe", "forward_pe", "price_to_book", "price_to_sales")


def _val_sql() -> str:
    cols = []
    for m in _METRICS:
        peers = f"list_filter(list_transform(list_filter(allc, lambda o: NOT by_sector OR o.sector = x.sector), lambda o: CASE WHEN o.{m} > 0 THEN o.{m} END), lambda v: v IS NOT NULL)"
        cols.append(f"CASE WHEN NOT fund AND {m} > 0 AND len({peers}) >= 2 THEN round(len(list_filter({peers}, lambda v: v <= x.{m})) / len({peers}), 6) END AS {m}_percentile, CASE WHEN NOT fund AND {m} > 0 AND len({peers}) >= 2 THEN len({peers}) END AS {m}_count, CASE WHEN NOT fund AND {m} > 0 AND len({peers}) >= 2 THEN round(list_median({peers}), 6) END AS {m}_median")
    return ", ".join(cols)


@query("valuation_ranks", O.sql(O.FUNDAMENTALS, body=f"""
SELECT symbol, CASE WHEN fund THEN 'fund' WHEN by_sector THEN sector ELSE 'tracked universe' END AS peer_group, {_val_sql()},
  CASE WHEN NOT fund AND trailing_pe > 0 THEN round(1 / trailing_pe, 6) END AS earnings_yield,
  CASE WHEN NOT fund AND trailing_pe > 0 AND forward_pe > 0 THEN CASE WHEN forward_pe / trailing_pe < 0.9::DOUBLE THEN 'growing' WHEN forward_pe / trailing_pe > 1.1::DOUBLE THEN 'shrinking' END END AS note
FROM (SELECT *, quote_type = 'ETF' AS fund, (SELECT count(*) FROM f o WHERE o.quote_type <> 'ETF' AND o.sector = f.sector) >= 4 AS by_sector,
  (SELECT list(struct_pack(sector := o.sector, trailing_pe := o.trailing_pe, forward_pe := o.forward_pe, price_to_book := o.price_to_book, price_to_sales := o.price_to_sales)) FROM f o WHERE o.quote_type <> 'ETF') AS allc FROM f) x"""))
def valuation_ranks(spark, sf):
    v = valuations(T.fundamentals(spark, sf))
    cols = [F.round(f"{m}_{p}", 6).alias(f"{m}_{p}") if p != "count" else F.col(f"{m}_{p}") for m in _METRICS for p in ("percentile", "count", "median")]
    return v.select("symbol", "peer_group", *cols, F.round("earnings_yield", 6).alias("earnings_yield"), "note")


ATTRS = ["momentum", *VALUE, *QUALITY]


@query("deciles", O.sql(O.POPULATION, body="""
SELECT attr, decile, round(s[least(floor(decile / 10.0::DOUBLE * len(s)), len(s) - 1)::INT + 1], 6) AS value FROM (SELECT attr, list(v ORDER BY v) AS s FROM (UNPIVOT (SELECT * EXCLUDE sector FROM pop) ON * EXCLUDE symbol INTO NAME attr VALUE v) GROUP BY attr HAVING count(*) >= 20), range(1, 10) q(decile)""".replace("decile, round", "decile::INT AS decile, round")))
def deciles(spark, sf):
    return R.deciles(T.population(spark, sf), ATTRS)


def benchmark_ranks(views: DataFrame, members: DataFrame) -> DataFrame:
    """Index-wide momentum rank; value and quality within sector, or the index where the sector is thin; trap flag.

    A sector counts with at least MIN_SECTOR_MEMBERS members and two values of the metric; label and size are those of
    the last metric used. Without MIN_POPULATION members nothing is ranked.
    """
    big = members.agg(F.count("*").alias("members")).where(F.col("members") >= C.MIN_POPULATION)
    m = members.crossJoin(F.broadcast(big))
    long = m.unpivot(["symbol", "sector"], ATTRS, "attr", "m")
    sizes = members.groupBy("sector").agg(F.count("*").alias("size")).where(F.col("size") >= C.MIN_SECTOR_MEMBERS)
    in_sector = long.join(sizes, "sector", "left_semi")
    probes = views.where("NOT fund").withColumnRenamed("mom_12_1", "momentum").unpivot(["symbol", "sector"], ATTRS, "attr", "v")
    by_sector = R.foreign_rank(probes, in_sector, ["sector"]).withColumnsRenamed({"rank": "rs", "n": "ns"})
    whole = R.foreign_rank(probes, long.drop("sector"), []).withColumnsRenamed({"rank": "ru", "n": "nu"})
    both = whole.join(by_sector.select("symbol", "attr", "rs", "ns"), ["symbol", "attr"])
    pos = F.array_position(F.array(*map(F.lit, ATTRS)), F.col("attr"))
    sector_ok = F.col("rs").isNotNull()
    both = both.withColumn("r", F.when(F.col("attr") == "momentum", F.col("ru")).otherwise(F.coalesce("rs", "ru"))).withColumn("label", F.when(sector_ok, F.col("sector")).otherwise("index")).withColumn("n", F.when(sector_ok, F.col("ns")).otherwise(F.col("nu")))
    got = F.col("r").isNotNull()
    family = lambda names: got & F.col("attr").isin(*names)
    agg = [F.max(F.when(F.col("attr") == "momentum", F.col("r"))).alias("bench_momentum_rank")]
    for name, names in (("value", VALUE), ("quality", QUALITY)):
        agg += [F.avg(F.when(family(names), F.col("r"))).alias(f"bench_{name}_score"), F.max_by(F.when(family(names), F.col("label")), F.when(family(names), pos)).alias(f"bench_{name}_population"), F.max_by(F.when(family(names), F.col("n")), F.when(family(names), pos)).alias(f"bench_{name}_n"), F.count(F.when(family(names), 1)).alias(f"{name}_used")]
    out = both.groupBy("symbol").agg(*agg)
    return out.withColumn("bench_value_trap", F.coalesce((F.col("bench_value_score") >= 2 / 3) & (F.col("bench_quality_score") <= 1 / 3) & (F.col("value_used") >= 2), F.lit(False)))


def _bench_sql() -> str:
    long = "probe0 AS (SELECT symbol, sector, lm.mom_12_1 AS momentum, ebitda_yield, fcf_yield, earnings_yield, roe, roa, operating_margin, low_leverage FROM inp JOIN lastm lm USING (symbol) WHERE NOT fund),\nprobe AS (SELECT * FROM probe0 UNPIVOT INCLUDE NULLS (v FOR attr IN (momentum, ebitda_yield, fcf_yield, earnings_yield, roe, roa, operating_margin, low_leverage))),\nml AS MATERIALIZED (UNPIVOT pop ON * EXCLUDE (symbol, sector) INTO NAME attr VALUE m)"
    rank = "CASE WHEN v IS NOT NULL AND count(m) >= 2 THEN (count(*) FILTER (m < v) + 0.5::DOUBLE * greatest(count(*) FILTER (m = v) - 1, 0)) / (count(m) - 1) END"
    return f"""{long},
us AS (SELECT p.symbol, p.attr, any_value(p.sector) AS sector, v, {rank} AS ru, count(m) AS nu FROM probe p LEFT JOIN ml ON ml.attr = p.attr GROUP BY p.symbol, p.attr, v),
ss AS (SELECT p.symbol, p.attr, v, {rank} AS rs, count(m) AS ns FROM probe p LEFT JOIN ml ON ml.attr = p.attr AND ml.sector = p.sector AND ml.sector IN (SELECT sector FROM pop GROUP BY sector HAVING count(*) >= 15) GROUP BY p.symbol, p.attr, v),
b AS (SELECT us.symbol, us.attr, CASE WHEN us.attr = 'momentum' THEN ru ELSE coalesce(rs, ru) END AS r, CASE WHEN rs IS NOT NULL THEN sector ELSE 'index' END AS label, CASE WHEN rs IS NOT NULL THEN ns ELSE nu END AS n,
  list_position(['momentum','ebitda_yield','fcf_yield','earnings_yield','roe','roa','operating_margin','low_leverage'], us.attr) AS pos FROM us JOIN ss ON us.symbol = ss.symbol AND us.attr = ss.attr WHERE (SELECT count(*) FROM pop) >= 100),
g AS (SELECT symbol, max(r) FILTER (pos = 1) AS bm, avg(r) FILTER (pos BETWEEN 2 AND 4) AS bv, arg_max(label, pos) FILTER (r IS NOT NULL AND pos BETWEEN 2 AND 4) AS lv, arg_max(n, pos) FILTER (r IS NOT NULL AND pos BETWEEN 2 AND 4) AS nv, count(r) FILTER (pos BETWEEN 2 AND 4) AS uv,
  avg(r) FILTER (pos > 4) AS bq, arg_max(label, pos) FILTER (r IS NOT NULL AND pos > 4) AS lq, arg_max(n, pos) FILTER (r IS NOT NULL AND pos > 4) AS nq FROM b GROUP BY symbol)"""


@query("benchmark_ranks", O.sql(O.BARS, O.FUNDAMENTALS, O.MOMENTUM, _INPUTS, O.POPULATION, _bench_sql(), body="SELECT symbol, round(bm, 6) AS bench_momentum_rank, round(bv, 6) AS bench_value_score, lv AS bench_value_population, nv AS bench_value_n, round(bq, 6) AS bench_quality_score, lq AS bench_quality_population, nq AS bench_quality_n, coalesce(bv >= 2 / 3::DOUBLE AND bq <= 1 / 3::DOUBLE AND uv >= 2, false) AS bench_value_trap FROM g"))
def q_benchmark_ranks(spark, sf):
    mom = last_row(with_momentum(prepared(spark, sf))).select("symbol", "mom_12_1")
    r = benchmark_ranks(mom.join(factor_inputs(T.fundamentals(spark, sf)), "symbol"), T.population(spark, sf))
    return r.select("symbol", *(F.round(f"bench_{c}", 6).alias(f"bench_{c}") for c in ("momentum_rank", "value_score", "quality_score")), "bench_value_population", F.col("bench_value_n").cast("long").alias("bench_value_n"), "bench_quality_population", F.col("bench_quality_n").cast("long").alias("bench_quality_n"), "bench_value_trap")


def portfolio_tilts(holdings: DataFrame, views: DataFrame) -> DataFrame:
    """One row: equity sleeve, concentration, weighted and equal tilts by metric, weights of flags.

    Weights are renormalised on the equity sleeve (1 if it is 0); a tilt divides by the weight that has a score.
    """
    pos = holdings.where("kind <> 'cash'").join(views, "symbol", "left")
    sums = holdings.agg(F.sum(F.when(F.col("kind") != "cash", F.col("exposure"))).alias("sleeve"), F.sum(F.when(F.col("kind") == "cash", F.col("exposure"))).alias("cash"))
    p = pos.crossJoin(F.broadcast(sums)).withColumn("w", F.col("exposure") / X.or_else(F.col("sleeve"), F.lit(1.0)))
    agg = [F.max("cash").alias("cash"), F.sum(F.col("w") * F.col("w")).alias("hhi"), F.max("w").alias("top_weight"), F.count("*").alias("positions")]
    for c in ("mom_rank", "value_score", "quality_score"):
        agg += [X.over(F.sum(F.col("w") * F.col(c)), F.sum(F.when(F.col(c).isNotNull(), F.col("w")))).alias(f"{c}_tilt"), F.avg(c).alias(f"{c}_equal")]
    agg += [F.coalesce(F.sum(F.when(F.col(c), F.col("w"))), F.lit(0.0)).alias(f"{c}_weight") for c in ("value_trap", "reversal_tension")]
    agg.append(F.coalesce(F.sum(F.when(F.col("mom_rank").isNull() & F.col("value_score").isNull() & F.col("quality_score").isNull(), F.col("w"))), F.lit(0.0)).alias("unscored_weight"))
    return p.agg(*agg).withColumn("effective_n", X.over(F.lit(1.0), F.col("hhi")))


_TILT = ", ".join(f"round(sum(w * {c}) / nullif(sum(w) FILTER ({c} IS NOT NULL), 0), 6) AS {c}_tilt, round(avg({c}), 6) AS {c}_equal" for c in ("mom_rank", "value_score", "quality_score"))


@query("portfolio_tilts", O.sql(O.BARS, O.FUNDAMENTALS, O.MOMENTUM, _FACTORS, O.HOLDINGS, body=f"""
SELECT round(max(cash), 6) AS cash, round(sum(w * w), 6) AS hhi, round(1 / sum(w * w), 6) AS effective_n, round(max(w), 6) AS top_weight, count(*) AS positions, {_TILT},
  round(coalesce(sum(w) FILTER (value_score >= 2 / 3::DOUBLE AND quality_score <= 1 / 3::DOUBLE AND value_n >= 2), 0), 6) AS value_trap_weight,
  round(coalesce(sum(w) FILTER (NOT fund AND universe_n >= 5 AND abs(ret_1m) > 0.05 AND (ret_1m > 0) <> (mom_12_1 > 0)), 0), 6) AS reversal_tension_weight,
  round(coalesce(sum(w) FILTER (mom_rank IS NULL AND value_score IS NULL AND quality_score IS NULL), 0), 6) AS unscored_weight
FROM (SELECT h.symbol, exposure / (SELECT sum(exposure) FROM h WHERE kind <> 'cash') AS w, (SELECT sum(exposure) FROM h WHERE kind = 'cash') AS cash, fv.* EXCLUDE symbol FROM h LEFT JOIN fv ON h.symbol = fv.symbol WHERE kind <> 'cash')"""))
def q_portfolio_tilts(spark, sf):
    t = portfolio_tilts(T.holdings(spark, sf), factor_views(prepared(spark, sf), T.fundamentals(spark, sf)))
    return t.select(*(F.round(c, 6).alias(c) if c != "positions" else F.col(c) for c in t.columns))


@query("sector_weights", O.sql(O.FUNDAMENTALS, O.HOLDINGS, body="SELECT coalesce(sector, 'Unclassified') AS sector, round(sum(exposure), 6) AS weight, count(*) AS positions FROM h LEFT JOIN f USING (symbol) WHERE kind <> 'cash' GROUP BY 1"))
def sector_weights(spark, sf):
    j = T.holdings(spark, sf).where("kind <> 'cash'").join(T.fundamentals(spark, sf).select("symbol", "sector"), "symbol", "left")
    return j.groupBy(F.coalesce("sector", F.lit("Unclassified")).alias("sector")).agg(F.round(F.sum("exposure"), 6).alias("weight"), F.count("*").alias("positions"))


@query("momentum_backfill", O.sql(O.BARS, O.MOMENTUM, body="""
, cal AS (SELECT date FROM s WHERE symbol = (SELECT symbol FROM bars GROUP BY symbol ORDER BY count(*) DESC, symbol LIMIT 1) AND i >= 273 AND (i - 273) % 21 = 0)
SELECT symbol, date, round(mom_12_1, 5) AS mom_12_1, round(CASE WHEN n >= 2 THEN (b + 0.5::DOUBLE * (t - 1)) / (n - 1) END, 3) AS mom_rank FROM (
 SELECT *, rank() OVER (PARTITION BY date ORDER BY mom_12_1) - 1 AS b, count(*) OVER (PARTITION BY date, mom_12_1) AS t, count(*) OVER (PARTITION BY date) AS n
 FROM mom JOIN cal USING (date) WHERE i >= 273 AND mom_12_1 IS NOT NULL)""").replace("\n\n, cal", ",\ncal").replace("\n, cal", ",\ncal"))
def momentum_backfill(spark, sf):
    """Momentum and its rank at every 21st session of the longest calendar, from its 273rd."""
    return history(prepared(spark, sf))


def history(bars: DataFrame) -> DataFrame:
    longest = bars.groupBy("symbol").count().orderBy(F.desc("count"), "symbol").limit(1).select("symbol")
    dates = bars.join(longest, "symbol", "left_semi").where((F.col("i") >= 273) & ((F.col("i") - 273) % 21 == 0)).select("date")
    at = with_momentum(bars).join(dates, "date", "left_semi").where((F.col("i") >= 273) & F.col("mom_12_1").isNotNull())
    return at.select("symbol", "date", F.round("mom_12_1", 5).alias("mom_12_1"), F.round(R.pct_rank("mom_12_1", "date"), 3).alias("mom_rank"))
