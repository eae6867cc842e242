"""Screening row, payloads, prediction registry, history, set operations, top-n; each query with independent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewright import constants as C
from tapewright.functions import scalars as X
from tapewright.operators import asof as A
from tapewright.operators import series as S
from tapewright.plans import cross_queries as Q
from tapewright.plans import event_queries as E
from tapewright.plans import oracle as O
from tapewright.plans.series_queries import SQL as S_SQL
from tapewright.plans.series_queries import last_row, prepared
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


# --- the screening row ---------------------------------------------------------------------------


def screen(bars: DataFrame) -> DataFrame:
    """One row a symbol at its last session: price, changes, volume, volatility, trend. All windows share one sort."""
    frame20 = S.back(19)
    df = bars.withColumn("dd", S.drawdown()).withColumn("_t", S.volume_trend()).withColumn("_c20", S.gated(S.change(20), 60)).withColumn("year_high", F.max("high").over(S.back(251))).withColumn("year_low", F.min("low").over(S.back(251)))
    cols = [S.change(k).alias(f"change_{n}") for n, k in C.CHANGES.items()]
    cols += [
        F.avg("volume").over(frame20).alias("avg_volume_20d"), S.rvol().alias("rvol"), (F.col("close") * F.col("volume")).alias("dollar_volume"), F.col("_t").alias("volume_trend"), S.up_down_ratio().alias("up_down_ratio"),
        S.divergence(F.col("_c20"), F.col("_t")).alias("divergence"), S.annualised_vol().alias("annualized_vol"), F.least(F.lit(0.0), F.min("dd").over(S.W)).alias("max_drawdown"),
        (F.col("close") > S.sma(50)).alias("above_sma50"), (F.col("close") > S.sma(200)).alias("above_sma200"), X.range_position(F.col("close"), F.col("year_low"), F.col("year_high")).alias("range_52w_position"),
    ]
    return last_row(df.select("symbol", "date", "close", "volume", *cols)).withColumnsRenamed({"date": "last_date", "close": "last"})


_SCREEN = """
sc0 AS (SELECT symbol, date, close, volume, i, close / max(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS dd, r, d, high, low FROM s),
sc AS MATERIALIZED (SELECT symbol, date AS last_date, close AS last, volume, {changes}, avg(volume) OVER f20 AS avg_volume_20d,
  CASE WHEN i >= 20 THEN volume / nullif(avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0) END AS rvol, close * volume AS dollar_volume,
  CASE WHEN i >= 59 THEN avg(volume) OVER f20 / nullif(avg(volume) OVER f60, 0) END AS volume_trend,
  CASE WHEN i >= 50 THEN coalesce(sum(CASE WHEN d > 0 THEN volume END) OVER f50, 0) / nullif(sum(CASE WHEN d < 0 THEN volume END) OVER f50, 0) END AS up_down_ratio,
  CASE WHEN i >= 60 THEN close / lag(close, 20) OVER w - 1 END AS c20, CASE WHEN i >= 60 THEN stddev_samp(r) OVER f60 * sqrt(252) END AS annualized_vol, least(0, min(dd) OVER w) AS max_drawdown,
  CASE WHEN i >= 49 THEN close > avg(close) OVER f50 END AS above_sma50, CASE WHEN i >= 199 THEN close > avg(close) OVER f200 END AS above_sma200,
  CASE WHEN max(high) OVER y > min(low) OVER y THEN least(1, greatest(0, (close - min(low) OVER y) / (max(high) OVER y - min(low) OVER y))) END AS range_52w_position
  FROM sc0 WINDOW w AS (PARTITION BY symbol ORDER BY date), f20 AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING), f50 AS (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING), f60 AS (PARTITION BY symbol ORDER BY date ROWS 59 PRECEDING), f200 AS (PARTITION BY symbol ORDER BY date ROWS 199 PRECEDING), y AS (PARTITION BY symbol ORDER BY date ROWS 251 PRECEDING)
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)""".format(changes=", ".join(f"close / nullif(lag(close, {k}) OVER w, 0) - 1 AS change_{n}" for n, k in C.CHANGES.items()))

_PLACES = {**{f"change_{n}": 5 for n in C.CHANGES}, "avg_volume_20d": 4, "rvol": 3, "volume_trend": 3, "up_down_ratio": 3, "annualized_vol": 4, "max_drawdown": 4, "range_52w_position": 3}
_SC_OUT = ", ".join(f"round({c}, {p}) AS {c}" for c, p in _PLACES.items())
_DIV = "CASE WHEN c20 IS NULL OR volume_trend IS NULL THEN NULL WHEN c20 > 0.02 AND volume_trend > 1.15 THEN 'confirmed' WHEN c20 > 0.02 AND volume_trend < 0.85 THEN 'weak' WHEN c20 < -0.02 AND volume_trend > 1.15 THEN 'washout' WHEN c20 < -0.02 AND volume_trend < 0.85 THEN 'quiet' ELSE 'mixed' END AS divergence"


@query("screen_basic", O.sql(O.BARS, _SCREEN, body=f"SELECT symbol, last_date, last, volume, dollar_volume, above_sma50, above_sma200, {_DIV}, {_SC_OUT} FROM sc"))
def screen_basic(spark, sf):
    s = screen(prepared(spark, sf))
    return s.withColumns({c: F.round(c, p) for c, p in _PLACES.items()})


def index_row(bars: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """The screening row with snapshot, factor scores, valuation, regime and the expected week, one row a symbol.

    Bars with volatility feed six branches; they are persisted (to disk where memory is short), so lineitem is read once.
    """
    bars = vol = S.ewma_vol(bars).persist()
    views = Q.factor_views(bars, fundamentals).select("symbol", "sector", "quote_type", "mom_12_1", "mom_rank", "value_score", "quality_score", "value_trap", "reversal_tension")
    val = Q.valuations(fundamentals).select("symbol", "peer_group", F.col("trailing_pe_percentile").alias("pe_percentile"), "earnings_yield")
    reg = E.regimes(vol).select("symbol", "regime", F.col("percentile").alias("regime_percentile"), F.col("annual_vol").alias("regime_ann_vol"))
    ver = E.regime_validation(vol).select("symbol", F.col("verdict").alias("regime_verdict"), F.col("separation").alias("regime_separation"))
    week = E.expected_ranges(vol, (C.WEEK,)).select("symbol", F.col("pct").alias("expected_week_pct"))
    rsi = last_row(S.rsi(bars)).select("symbol", F.col("rsi").alias("rsi14"))
    out = screen(bars)
    for side in (views, val, reg, ver, week, rsi, fundamentals.select("symbol", "market_cap", "trailing_pe", "price_to_book", "dividend_yield", "beta", "ev_ebitda")):
        out = out.join(side, "symbol", "left")
    return out


_IDX = {**_PLACES, "rsi14": 2, "market_cap": 0, "trailing_pe": 3, "price_to_book": 3, "dividend_yield": 5, "beta": 3, "ev_ebitda": 3, "mom_12_1": 5, "mom_rank": 3, "value_score": 3, "quality_score": 3, "pe_percentile": 3, "earnings_yield": 5, "regime_percentile": 3, "regime_ann_vol": 4, "expected_week_pct": 5, "regime_separation": 3}


@query("index_row")
def q_index_row(spark, sf):
    """The flagship: all columns rounded for the wire. Its parts have SQL of their own under their own names."""
    r = index_row(prepared(spark, sf), T.fundamentals(spark, sf))
    return r.withColumns({c: F.round(c, p) for c, p in _IDX.items()})


def _sub(sql: str, name: str) -> str:
    return f"({sql}) {name}"


SQL["index_row"] = f"""
SELECT sc.*, sector, quote_type, round(fv.mom_12_1, 5) AS mom_12_1, round(mom_rank, 3) AS mom_rank, round(value_score, 3) AS value_score, round(quality_score, 3) AS quality_score, value_trap, reversal_tension,
  peer_group, round(trailing_pe_percentile, 3) AS pe_percentile, round(va.earnings_yield, 5) AS earnings_yield, regime, round(rg.percentile, 3) AS regime_percentile, round(rg.annual_vol, 4) AS regime_ann_vol,
  verdict AS regime_verdict, round(separation, 3) AS regime_separation, ra.week AS expected_week_pct, round(rsi, 2) AS rsi14,
  round(market_cap, 0) AS market_cap, round(trailing_pe, 3) AS trailing_pe, round(price_to_book, 3) AS price_to_book, round(dividend_yield, 5) AS dividend_yield, round(beta, 3) AS beta, round(ev_ebitda, 3) AS ev_ebitda
FROM {_sub(SQL["screen_basic"], "sc")} LEFT JOIN {_sub(Q.SQL["factor_views"], "fv")} USING (symbol) LEFT JOIN {_sub(Q.SQL["valuation_ranks"], "va")} USING (symbol) LEFT JOIN {_sub(E.SQL["regime"], "rg")} USING (symbol) LEFT JOIN {_sub(E.SQL["regime_validation"], "rv")} USING (symbol)
LEFT JOIN {_sub(O.sql(O.BARS, O.VOL, E._RANGES, body="SELECT symbol, round(exp(multiplier * vol * sqrt(5)) - 1, 5) AS week FROM mult JOIN lastv USING (symbol) WHERE horizon = 5"), "ra")} USING (symbol)
LEFT JOIN (SELECT symbol, arg_max(rsi, date) AS rsi FROM {_sub(S_SQL["rsi"], "r0")} GROUP BY symbol) r1 USING (symbol) LEFT JOIN {_sub(O.sql(O.FUNDAMENTALS, body="SELECT * FROM f"), "fu")} USING (symbol)"""


@query("index_sorted", O.sql(O.BARS, O.FUNDAMENTALS, O.MOMENTUM, Q._FACTORS, body="""
SELECT symbol, fund, round(value_score, 6) AS value_score, round(mom_12_1, 6) AS mom_12_1, row_number() OVER (ORDER BY fund, CASE WHEN fund THEN NULL ELSE round(value_score, 6) END DESC NULLS LAST, CASE WHEN fund THEN round(mom_12_1, 6) END DESC NULLS LAST, symbol) AS place FROM fv"""))
def index_sorted(spark, sf):
    """Two sections: companies by value, then funds by momentum; nulls last either way. A bounded table, a row a symbol."""
    v = Q.factor_views(prepared(spark, sf), T.fundamentals(spark, sf)).select("symbol", "fund", F.round("value_score", 6).alias("value_score"), F.round("mom_12_1", 6).alias("mom_12_1"))
    order = Window.partitionBy(F.lit(1)).orderBy("fund", F.when(~F.col("fund"), F.col("value_score")).desc_nulls_last(), F.when(F.col("fund"), F.col("mom_12_1")).desc_nulls_last(), "symbol")
    return v.withColumn("place", F.row_number().over(order).cast("long"))


@query("symbol_payload")
def symbol_payload(spark, sf):
    """The series of each symbol as arrays in date order, the last 60 sessions apart."""
    df = prepared(spark, sf).select("symbol", F.struct("date", F.round("close", 4).alias("close"), "volume", F.round(S.sma(50), 4).alias("sma50"), F.round(S.rvol(), 3).alias("rvol")).alias("x"))
    g = df.groupBy("symbol").agg(F.array_sort(F.collect_list("x")).alias("bars"))
    return g.select("symbol", "bars", F.slice("bars", F.greatest(F.lit(1), F.size("bars") - 59), F.lit(60)).alias("tail"))


@query("payload_tail", O.sql(O.BARS, body="SELECT symbol, count(*) AS n, round(sum(close), 3) AS closes, sum(volume) AS volumes, min(date) AS first_date FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 60) GROUP BY symbol"))
def payload_tail(spark, sf):
    p = prepared(spark, sf).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("date", "close", "volume"))).alias("b")).select("symbol", F.slice("b", F.greatest(F.lit(1), F.size("b") - 59), F.lit(60)).alias("t"))
    add = lambda c: F.aggregate(F.col(f"t.{c}"), F.lit(0.0), lambda a, x: a + x)
    return p.select("symbol", F.size("t").cast("long").alias("n"), F.round(add("close"), 3).alias("closes"), add("volume").alias("volumes"), F.col("t")[0]["date"].alias("first_date"))


# --- registry -------------------------------------------------------------------------------------


def claims(vol: DataFrame, h: int = C.WEEK, back: int = 0, least: int = 320) -> DataFrame:
    """Range and regime claims of symbols with at least ``least`` sessions, as of ``back`` sessions before their last.

    Only sessions up to the claim's are used. The id is kind:symbol:as_of:horizon.
    """
    n = F.count("*").over(Window.partitionBy("symbol"))
    past = vol.withColumn("_n", n).where((F.col("_n") >= least + back) & (F.col("i") < F.col("_n") - back))
    at = last_row(past).select("symbol", F.col("date").alias("as_of"), "close")
    r = E.expected_ranges(past, (h,)).join(at, "symbol").select("symbol", "as_of", F.lit("range").alias("kind"), F.lit(h).alias("horizon"), "low", "high", F.lit(C.COVERAGE).alias("coverage"), "calibrated", F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("separation"))
    lab = E.regimes(past).join(at, "symbol").join(E.regime_validation(past, h).select("symbol", "separation"), "symbol", "left")
    g = lab.select("symbol", "as_of", F.lit("regime").alias("kind"), F.lit(h).alias("horizon"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(None).cast("double").alias("coverage"), F.lit(None).cast("boolean").alias("calibrated"), F.col("regime").alias("label"), "separation")
    both = r.unionByName(g)
    return both.withColumn("id", F.concat_ws(":", "kind", "symbol", F.col("as_of").cast("string"), F.col("horizon").cast("string")))


_CLAIM = (
    "s0 AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM s)",
    O.VOL.replace("FROM s LEFT JOIN", "FROM (SELECT * EXCLUDE n FROM s0 WHERE n >= 340 AND i < n - 20) s LEFT JOIN"),
    E._RANGES.replace("JOIN s b ON", "JOIN vol b ON"),
)


@query("claims_range", O.sql(O.BARS, *_CLAIM, body="SELECT 'range:' || symbol || ':' || d || ':5' AS id, round(last * exp(-multiplier * v * sqrt(5)), 4) AS low, calibrated FROM mult JOIN (SELECT symbol, arg_max(close, i) AS last, arg_max(vol, i) AS v, max(date) AS d FROM vol GROUP BY symbol) USING (symbol) WHERE horizon = 5"))
def claims_range(spark, sf):
    c = claims(S.ewma_vol(prepared(spark, sf)), back=20).where("kind = 'range'")
    return c.select("id", F.round("low", 4).alias("low"), "calibrated")


def grade_ranges(c: DataFrame, bars: DataFrame) -> DataFrame:
    """The close ``horizon`` sessions after as_of, and whether it stayed inside; claims not matured are left out."""
    base = c.where("kind = 'range'").join(bars.select("symbol", F.col("date").alias("as_of"), F.col("i").alias("_i")), ["symbol", "as_of"])
    later = bars.select("symbol", (F.col("i")).alias("_j"), F.col("close").alias("realized"))
    j = base.withColumn("_j", F.col("_i") + F.col("horizon")).join(later, ["symbol", "_j"])
    return j.select("id", "kind", "symbol", "realized", F.col("realized").between(F.col("low"), F.col("high")).alias("hit"))


@query("grades", O.sql(O.BARS, *_CLAIM, "cl AS (SELECT symbol, 'range:' || symbol || ':' || d || ':5' AS id, last * exp(-multiplier * v * sqrt(5)) AS low, last * exp(multiplier * v * sqrt(5)) AS high, mi FROM mult JOIN (SELECT symbol, arg_max(close, i) AS last, arg_max(vol, i) AS v, max(date) AS d, max(i) AS mi FROM vol GROUP BY symbol) USING (symbol) WHERE horizon = 5)", body="SELECT id, s.close AS realized, s.close BETWEEN cl.low AND cl.high AS hit FROM cl JOIN s ON s.symbol = cl.symbol AND s.i = mi + 5"))
def grades(spark, sf):
    b = prepared(spark, sf)
    return grade_ranges(claims(S.ewma_vol(b), back=20), b).select("id", "realized", "hit")


def scoreboard(claimed: DataFrame, graded: DataFrame) -> DataFrame:
    """kind, graded, pending, hit_rate: a function of the two tables alone."""
    g = graded.groupBy("kind").agg(F.count("*").alias("graded"), F.avg(F.col("hit").cast("double")).alias("hit_rate"))
    p = claimed.join(graded.select("id"), "id", "left_anti").groupBy("kind").agg(F.count("*").alias("pending"))
    return claimed.select("kind").distinct().join(g, "kind", "left").join(p, "kind", "left").fillna(0, ["graded", "pending"])


@query("scoreboard", O.sql(O.BARS, *_CLAIM, "cl AS (SELECT symbol, last * exp(-multiplier * v * sqrt(5)) AS low, last * exp(multiplier * v * sqrt(5)) AS high, mi FROM mult JOIN (SELECT symbol, arg_max(close, i) AS last, arg_max(vol, i) AS v, max(i) AS mi FROM vol GROUP BY symbol) USING (symbol) WHERE horizon = 5), gr AS (SELECT s.close BETWEEN cl.low AND cl.high AS hit FROM cl JOIN s ON s.symbol = cl.symbol AND s.i = mi + 5)", body="SELECT 'range' AS kind, (SELECT count(*) FROM gr) AS graded, (SELECT count(*) FROM cl) - (SELECT count(*) FROM gr) AS pending, (SELECT round(avg(hit::INT), 6) FROM gr) AS hit_rate UNION ALL SELECT 'regime', 0, (SELECT count(DISTINCT symbol) FROM vol), NULL"))
def q_scoreboard(spark, sf):
    b = prepared(spark, sf)
    c = claims(S.ewma_vol(b), back=20)
    return scoreboard(c, grade_ranges(c, b)).withColumn("hit_rate", F.round("hit_rate", 6))


def append_new(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` whose key is not in ``old``: appending them twice adds nothing."""
    return new.join(old.select(key).distinct(), key, "left_anti")


@query("registry_append", "SELECT o_orderkey AS id, o_custkey FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0)")
def registry_append(spark, sf):
    o = T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    return append_new(o.where("id % 2 = 0"), o.where("id % 3 = 0"))


def dedupe_history(rows: DataFrame) -> DataFrame:
    """One row a date and symbol: the first one, unless it is a backfill and a live one follows (the first of those)."""
    w = Window.partitionBy("date", "symbol").orderBy(F.when(F.col("source") == "live", 0).otherwise(1), "pos")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


@query("history_dedupe", "SELECT date, symbol, source, pos FROM (SELECT o_orderdate::DATE AS date, o_orderpriority AS symbol, CASE WHEN o_orderstatus = 'O' THEN 'live' ELSE 'backfill' END AS source, o_orderkey AS pos FROM orders) QUALIFY row_number() OVER (PARTITION BY date, symbol ORDER BY source = 'live' DESC, pos) = 1")
def history_dedupe(spark, sf):
    o = T.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("symbol"), F.when(F.col("o_orderstatus") == "O", "live").otherwise("backfill").alias("source"), F.col("o_orderkey").alias("pos"))
    return dedupe_history(o)


def drift(history: DataFrame, x: str, points: int = 6) -> DataFrame:
    """Change of ``x`` over each symbol's last points that are not null."""
    w = Window.partitionBy("symbol").orderBy(F.desc("date"))
    tail = history.where(F.col(x).isNotNull()).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= points)
    return tail.groupBy("symbol").agg((F.max_by(x, "date") - F.min_by(x, "date")).alias("drift"), F.count("*").alias("points"))


@query("drift", Q.SQL["momentum_backfill"].replace("SELECT symbol, date, round(mom_12_1, 5)", ", hh AS (SELECT symbol, date, round(mom_12_1, 5)", 1).replace("\n, hh", ",\nhh").replace(")\n, hh", "),\nhh") + "), tl AS (SELECT * FROM hh QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 6) SELECT symbol, round(arg_max(mom_rank, date) - arg_min(mom_rank, date), 6) AS drift, count(*) AS points FROM tl GROUP BY symbol")
def q_drift(spark, sf):
    return drift(Q.history(prepared(spark, sf)), "mom_rank").withColumn("drift", F.round("drift", 6))


# --- joins of filings, weeks, sets, top-n ----------------------------------------------------------


@query("form4_merge", "SELECT o_orderkey AS accession, o_orderdate::DATE AS filed, coalesce(p, 0) AS p, coalesce(s, 0) AS s, owners FROM orders LEFT JOIN (SELECT l_orderkey, round(sum(l_quantity * l_extendedprice) FILTER (l_returnflag = 'R'), 2) AS p, round(sum(l_quantity * l_extendedprice) FILTER (l_returnflag = 'A'), 2) AS s FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1) ON l_orderkey = o_orderkey LEFT JOIN (SELECT o_orderkey AS k, count(DISTINCT o_custkey) AS owners FROM orders GROUP BY 1) ON k = o_orderkey WHERE o_orderpriority <> '5-LOW'")
def form4_merge(spark, sf):
    """Submissions with purchase and sale dollars of their transactions and their distinct owners: a three-way merge by accession."""
    o = T.table(spark, sf, "orders")
    sub = o.where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("accession"), F.to_date("o_orderdate").alias("filed"))
    line = T.table(spark, sf, "lineitem").where("l_returnflag in ('R', 'A')").select(F.col("l_orderkey").alias("accession"), "l_returnflag", (F.col("l_quantity") * F.col("l_extendedprice")).alias("usd"))
    trans = line.groupBy("accession").agg(F.round(F.sum(F.when(F.col("l_returnflag") == "R", F.col("usd"))), 2).alias("p"), F.round(F.sum(F.when(F.col("l_returnflag") == "A", F.col("usd"))), 2).alias("s"))
    owners = o.groupBy(F.col("o_orderkey").alias("accession")).agg(F.size(F.collect_set("o_custkey")).cast("long").alias("owners"))
    return sub.join(trans, "accession", "left").join(owners, "accession", "left").fillna(0.0, ["p", "s"])


@query("cluster_weeks", O.sql(O.ANNOUNCEMENTS, O.HOLDINGS, body="SELECT isoyear(day)::INT AS y, week(day)::INT AS w, count(*) AS n, round(sum(coalesce(exposure, 0)), 6) AS weight, string_agg(DISTINCT ann.symbol, ',' ORDER BY ann.symbol) AS symbols, sum(coalesce(exposure, 0)) >= 0.25 - 1e-9::DOUBLE AS flagged FROM ann LEFT JOIN h ON h.symbol = ann.symbol GROUP BY 1, 2"))
def cluster_weeks(spark, sf):
    a = T.announcements(spark, sf).withColumn("day", X.stamp_day(F.col("stamp"))).join(T.holdings(spark, sf).select("symbol", "exposure"), "symbol", "left")
    g = a.groupBy(F.extract(F.lit("YEAROFWEEK"), "day").cast("int").alias("y"), F.weekofyear("day").alias("w")).agg(F.count("*").alias("n"), F.sum(F.coalesce("exposure", F.lit(0.0))).alias("weight"), F.array_join(F.array_sort(F.collect_set("symbol")), ",").alias("symbols"))
    return g.withColumn("flagged", F.col("weight") >= 0.25 - 1e-9).withColumn("weight", F.round("weight", 6))


@query("set_operations", O.sql("a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000)", body="SELECT 'union' AS op, k FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'added', k FROM (SELECT k FROM b EXCEPT SELECT k FROM a) UNION ALL SELECT 'removed', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'bag', k FROM (SELECT k FROM a UNION ALL SELECT k FROM b)"))
def set_operations(spark, sf):
    a = T.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")).distinct()
    b = T.table(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("k"))
    tag = lambda name, df: df.select(F.lit(name).alias("op"), "k")
    return tag("union", a.union(b).distinct()).unionByName(tag("intersect", a.intersect(b))).unionByName(tag("added", b.join(a, "k", "left_anti"))).unionByName(tag("removed", a.exceptAll(b))).unionByName(tag("bag", a.unionAll(b)))


def first_of_each(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Ordered de-duplication: the row of each key that comes first."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


@query("first_tier", "SELECT c_nationkey AS symbol, c_mktsegment AS tier, c_custkey AS pos FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_custkey) = 1")
def first_tier(spark, sf):
    c = T.table(spark, sf, "customer").select(F.col("c_nationkey").alias("symbol"), F.col("c_mktsegment").alias("tier"), F.col("c_custkey").alias("pos"))
    return first_of_each(c, "symbol", "tier", "pos")


@query("signals_top3", "SELECT ticker, target, p, robust FROM (SELECT * FROM (SELECT o_custkey % 50 AS ticker, o_orderpriority AS target, o_totalprice AS p, o_orderstatus = 'F' AS robust, o_orderkey AS k FROM orders) QUALIFY row_number() OVER (PARTITION BY ticker, target ORDER BY robust DESC, p, k) = 1) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY robust DESC, p, target) <= 3")
def signals_top3(spark, sf):
    """Of each ticker the best row of each target, robust first and then by p; at most three."""
    o = T.table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("ticker"), F.col("o_orderpriority").alias("target"), F.col("o_totalprice").alias("p"), (F.col("o_orderstatus") == "F").alias("robust"), "o_orderkey")
    best = o.withColumn("_r", F.row_number().over(Window.partitionBy("ticker", "target").orderBy(F.desc("robust"), "p", "o_orderkey"))).where("_r = 1")
    return best.withColumn("_r", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("robust"), "p", "target"))).where("_r <= 3").select("ticker", "target", "p", "robust")


@query("top_movers", O.sql(O.BARS, O.ANNOUNCEMENTS, E._REACT, E._MOVES, body="SELECT symbol, round(median(move) FILTER (event) / median(move) FILTER (NOT event), 6) AS amplification FROM mv WHERE move IS NOT NULL GROUP BY symbol ORDER BY 2 DESC, symbol LIMIT 10"))
def top_movers(spark, sf):
    """The ten symbols with the largest reactions: a report whose limit is its feature."""
    r = E.reaction_sizes(T.announcements(spark, sf), prepared(spark, sf)).select("symbol", F.round("amplification", 6).alias("amplification"))
    return r.orderBy(F.desc("amplification"), "symbol").limit(10)


@query("group_counts", "SELECT r_name AS sector, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def group_counts(spark, sf):
    return T.population(spark, sf).groupBy("sector").agg(F.count("*").alias("n"))


@query("walkforward_amplification", O.sql(O.BARS, O.ANNOUNCEMENTS, E._REACT, E._MOVES, body="""
SELECT a.symbol, a.date, round(median(b.move) FILTER (b.event) / median(b.move) FILTER (NOT b.event), 6) AS amplification FROM mv a JOIN mv b ON a.symbol = b.symbol AND b.i < a.i AND b.move IS NOT NULL WHERE a.event GROUP BY ALL HAVING count(*) FILTER (b.event) >= 4 AND count(*) FILTER (NOT b.event) >= 60"""))
def walkforward_amplification(spark, sf):
    """At each reaction, the size of earlier reactions over earlier ordinary sessions."""
    b = prepared(spark, sf)
    ev = E.reactions(T.announcements(spark, sf), b).select("symbol", "date").distinct().withColumn("event", F.lit(True))
    m = b.withColumn("move", F.abs(S.change(1))).join(ev, ["symbol", "date"], "left").withColumn("event", F.coalesce("event", F.lit(False)))
    past = S.W.rowsBetween(Window.unboundedPreceding, -1)
    e, o = F.when(F.col("event"), F.col("move")), F.when(~F.col("event"), F.col("move"))
    m = m.withColumn("ne", F.count(e).over(past)).withColumn("no", F.count(o).over(past)).withColumn("amp", X.over(F.percentile(e, 0.5).over(past), F.percentile(o, 0.5).over(past)))
    return m.where("event AND ne >= 4 AND no >= 60").select("symbol", "date", F.round("amp", 6).alias("amplification"))


@query("upcoming", O.sql(O.BARS, O.ANNOUNCEMENTS, body="SELECT a.symbol, (SELECT min(day) FROM ann b WHERE b.symbol = a.symbol AND day > a.last) AS next_earnings, date_diff('day', DATE '1998-06-30', (SELECT min(day) FROM ann b WHERE b.symbol = a.symbol AND day > a.last)) AS days_until, (SELECT count(*) FROM ann b WHERE b.symbol = a.symbol AND day <= a.last) AS past FROM (SELECT symbol, max(date) AS last FROM bars WHERE date <= DATE '1998-06-30' GROUP BY symbol) a"))
def upcoming(spark, sf, as_of: str = "1998-06-30"):
    """Next announcement after the last bar held on a given day, days until it, and how many have passed."""
    last = T.bars(spark, sf).where(F.col("date") <= F.lit(as_of).cast("date")).groupBy("symbol").agg(F.max("date").alias("last"))
    a = E.stamped(T.announcements(spark, sf)).join(last, "symbol", "right")
    g = a.groupBy("symbol").agg(F.min(F.when(F.col("day") > F.col("last"), F.col("day"))).alias("next_earnings"), F.count(F.when(F.col("day") <= F.col("last"), 1)).alias("past"))
    return g.withColumn("days_until", F.datediff("next_earnings", F.lit(as_of).cast("date")).cast("long"))


@query("hourly_bars", "SELECT event_type AS symbol, date_trunc('hour', ts) AS hour, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def hourly_bars(spark, sf):
    """Bars of the event stream, by the code that also runs as a stream."""
    from tapewright.streaming.hourly import hourly

    return hourly(T.table(spark, sf, "events")).select("symbol", "hour", "open", "high", "low", "close", "n")


@query("damped_forecast", O.sql(O.BARS, """
mo AS (SELECT symbol, date_trunc('month', date)::DATE AS month, arg_max(close, date) AS close FROM bars GROUP BY 1, 2),
ml AS (SELECT symbol, month, close, row_number() OVER (PARTITION BY symbol ORDER BY month DESC) - 2 AS age, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY month)) AS r FROM mo),
mf AS (SELECT symbol, max(month) AS last_month, arg_max(close, month) AS last, avg(r) AS mu, sqrt(sum(pow(0.97::DOUBLE, age) * r * r) / sum(pow(0.97::DOUBLE, age)) FILTER (r IS NOT NULL)) AS vol FROM ml WHERE age >= 0 GROUP BY symbol HAVING count(*) >= 24),
mh AS (SELECT *, mu * list_sum(list_transform(range(1, horizon + 1), lambda k: pow(0.92::DOUBLE, k))) AS drift, 1.6449::DOUBLE * vol * sqrt(horizon) AS half FROM mf, (VALUES (3), (6), (12)) t(horizon))""", body="""
SELECT symbol, horizon, last_month, round(last * exp(drift), 4) AS point, round(last * exp(drift - half), 4) AS low, round(last * exp(drift + half), 4) AS high FROM mh"""))
def damped_forecast(spark, sf):
    """Textbook damped drift of monthly closes at 3, 6 and 12 months; no published formula to match."""
    from tapewright.plans.forecast import forecast

    return forecast(S.monthly_fold(T.bars(spark, sf)))


@query("scalar_rules", """
SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 1 / c_acctbal END AS inverse, c_acctbal > 0 AS positive, upper(replace(trim(' ' || c_name || '.a '), '.', '-')) AS symbol,
  CASE WHEN c_custkey % 3 = 0 THEN DATE '1998-03-05' WHEN c_custkey % 3 = 1 THEN DATE '1999-12-31' END AS parsed, regexp_full_match(c_mktsegment, '[A-Z][A-Z0-9.-]{0,9}') AS valid FROM customer""")
def scalar_rules(spark, sf):
    c = T.table(spark, sf, "customer")
    raw = F.when(F.col("c_custkey") % 3 == 0, "05-MAR-1998").when(F.col("c_custkey") % 3 == 1, "1999-12-31").otherwise("soon")
    return c.select("c_custkey", X.inverse_if_positive(F.col("c_acctbal")).alias("inverse"), X.positive(F.col("c_acctbal")).isNotNull().alias("positive"), X.normalise_symbol(F.concat(F.lit(" "), "c_name", F.lit(".a "))).alias("symbol"), X.parse_date(raw).alias("parsed"), X.valid_symbol(F.col("c_mktsegment")).alias("valid"))
