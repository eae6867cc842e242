"""Regimes, ranges, as-of joins, event studies, crash state; each query with independent SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewright import constants as C
from tapewright.functions import scalars as X
from tapewright.operators import asof as A
from tapewright.operators import ranks as R
from tapewright.operators import series as S
from tapewright.operators import stats as ST
from tapewright.plans import oracle as O
from tapewright.plans.cross_queries import history
from tapewright.plans.series_queries import last_row, prepared, with_momentum, with_month_position
from tapewright.sources import tables as T

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: The window that set a multiplier lies on the band's edge; it counts as inside whatever the last bit says.
EDGE = 1e-12


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def places(df: DataFrame, n: int, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in names})


# --- regimes and ranges -------------------------------------------------------------------------


def label_of(p: F.Column) -> F.Column:
    return F.when(p <= C.QUIET, "quiet").when(p >= C.TURBULENT, "turbulent").otherwise("normal")


def regimes(vol: DataFrame) -> DataFrame:
    """Volatility state of each symbol at its last session, in its own trailing year."""
    last = last_row(vol.withColumn("percentile", S.own_percentile("vol", C.REGIME_WINDOW)).withColumn("current", F.last("vol", ignorenulls=True).over(S.W)))
    annual = F.col("current") * (252.0**0.5)
    label = F.when(F.col("percentile").isNull(), "unknown").when(annual < C.CASH_LIKE, "quiet").otherwise(label_of(F.col("percentile")))
    return last.select("symbol", label.alias("regime"), "percentile", F.col("current").alias("daily_vol"), annual.alias("annual_vol"))


_LABEL = "CASE WHEN p <= 0.33 THEN 'quiet' WHEN p >= 0.67 THEN 'turbulent' ELSE 'normal' END"
_PCTL = "SELECT a.symbol, a.date, a.i, a.close, a.vol, count(*) FILTER (b.vol <= a.vol) / count(b.vol) AS p, count(b.vol) AS np FROM vol a JOIN vol b ON a.symbol = b.symbol AND b.i BETWEEN a.i - {back} AND a.i AND b.vol IS NOT NULL WHERE a.vol IS NOT NULL {where} GROUP BY ALL"


@query("regime", O.sql(O.BARS, O.VOL, body=f"SELECT symbol, CASE WHEN np < 20 THEN 'unknown' WHEN vol * sqrt(252) < 0.03 THEN 'quiet' ELSE {_LABEL} END AS regime, round(p, 6) AS percentile, round(vol, 8) AS daily_vol, round(vol * sqrt(252), 6) AS annual_vol FROM ({_PCTL.format(back=251, where='AND a.i = (SELECT max(i) FROM vol c WHERE c.symbol = a.symbol)')})"))
def q_regime(spark, sf):
    return places(places(regimes(S.ewma_vol(prepared(spark, sf))), 6, "percentile", "annual_vol"), 8, "daily_vol")


def regime_validation(vol: DataFrame, h: int = 5, first: int = 150) -> DataFrame:
    """Whether the label precedes larger moves: mean move by label, separation, verdict. Labels see the past only."""
    n = F.count("*").over(Window.partitionBy("symbol"))
    df = vol.withColumn("n", n).withColumn("p", S.own_percentile("vol", C.REGIME_WINDOW + 1)).withColumn("move", S.forward_abs_log(h))
    df = df.where((F.col("n") >= first + h + 10) & (F.col("i") >= first) & F.col("p").isNotNull() & F.col("move").isNotNull()).withColumn("label", label_of(F.col("p")))
    g = df.groupBy("symbol").agg(*(f(F.when(F.col("label") == x, F.col("move"))).alias(f"{x}_{y}") for x in ("quiet", "normal", "turbulent") for y, f in (("n", F.count), ("move", F.avg))))
    enough = F.least("quiet_n", "normal_n", "turbulent_n") >= 20
    q, m, t = (F.when(enough, F.col(f"{x}_move")) for x in ("quiet", "normal", "turbulent"))
    sep = X.over(t, q)
    mono = F.coalesce((t > m) & (m > q), F.lit(False))
    verdict = F.when(~enough, "insufficient history").when(mono & (sep >= 1.3), "confirmed").when(sep >= 1.1, "weak").otherwise("no separation")
    return g.select("symbol", "quiet_n", "normal_n", "turbulent_n", sep.alias("separation"), mono.alias("monotonic"), verdict.alias("verdict"))


@query("regime_validation", O.sql(O.BARS, O.VOL, f"pp AS MATERIALIZED ({_PCTL.format(back=252, where='AND a.i >= 150')})", body=f"""
SELECT symbol, count(*) FILTER (l = 'quiet') AS quiet_n, count(*) FILTER (l = 'normal') AS normal_n, count(*) FILTER (l = 'turbulent') AS turbulent_n,
  round(CASE WHEN ok THEN avg(m) FILTER (l = 'turbulent') / avg(m) FILTER (l = 'quiet') END, 6) AS separation, ok AND avg(m) FILTER (l = 'turbulent') > avg(m) FILTER (l = 'normal') AND avg(m) FILTER (l = 'normal') > avg(m) FILTER (l = 'quiet') AS monotonic,
  CASE WHEN NOT ok THEN 'insufficient history' WHEN avg(m) FILTER (l = 'turbulent') > avg(m) FILTER (l = 'normal') AND avg(m) FILTER (l = 'normal') > avg(m) FILTER (l = 'quiet') AND avg(m) FILTER (l = 'turbulent') / avg(m) FILTER (l = 'quiet') >= 1.3 THEN 'confirmed'
    WHEN avg(m) FILTER (l = 'turbulent') / avg(m) FILTER (l = 'quiet') >= 1.1 THEN 'weak' ELSE 'no separation' END AS verdict
FROM (SELECT *, least(count(*) FILTER (l = 'quiet') OVER w, count(*) FILTER (l = 'normal') OVER w, count(*) FILTER (l = 'turbulent') OVER w) >= 20 AS ok
  FROM (SELECT pp.symbol, {_LABEL} AS l, abs(ln(z.close / pp.close)) AS m FROM pp JOIN s z ON z.symbol = pp.symbol AND z.i = pp.i + 5 WHERE np >= 20) WINDOW w AS (PARTITION BY symbol)) GROUP BY symbol, ok"""))
def q_regime_validation(spark, sf):
    return places(regime_validation(S.ewma_vol(prepared(spark, sf))), 6, "separation")


def expected_ranges(vol: DataFrame, horizons=(1, 5, 21), coverage: float = C.COVERAGE) -> DataFrame:
    """Band of each symbol's last close by horizon, with a multiplier that would have covered that share of past moves."""
    df = vol
    for h in horizons:
        ratio = X.over(S.forward_abs_log(h), F.col("vol") * (h**0.5))
        df = df.withColumn(f"q{h}", F.when((F.col("i") >= C.MIN_TRAIN) & (F.col("vol") > 0), ratio))
    g = df.groupBy("symbol").agg(F.max_by("close", "date").alias("last"), F.max_by("vol", F.when(F.col("vol").isNotNull(), F.col("date"))).alias("vol"), *(F.collect_list(f"q{h}").alias(f"q{h}") for h in horizons))
    long = g.select("symbol", "last", "vol", F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"q{h}").alias("q")) for h in horizons))).alias("x")).select("symbol", "last", "vol", "x.*").where("vol > 0")
    fit = F.when(F.size("q") >= C.MIN_RATIOS, R.floor_quantile(F.col("q"), coverage))
    long = long.withColumn("multiplier", F.coalesce(fit, F.lit(C.GAUSSIAN_80))).withColumn("calibrated", fit.isNotNull())
    half = F.col("multiplier") * F.col("vol") * F.sqrt("horizon")
    return long.select("symbol", "horizon", "multiplier", "calibrated", (F.col("last") * F.exp(-half)).alias("low"), (F.col("last") * F.exp(half)).alias("high"), F.expm1(half).alias("pct"))


_RANGES = """
ratios AS (SELECT a.symbol, h AS horizon, list(abs(ln(b.close / a.close)) / (a.vol * sqrt(h)) ORDER BY abs(ln(b.close / a.close)) / (a.vol * sqrt(h))) AS q FROM vol a, (VALUES (1), (5), (21)) t(h) JOIN s b ON b.symbol = a.symbol AND b.i = a.i + h WHERE a.i >= 120 AND a.vol > 0 GROUP BY ALL),
mult AS (SELECT symbol, horizon, CASE WHEN len(q) >= 30 THEN q[least(floor(0.8::DOUBLE * len(q)), len(q) - 1)::INT + 1] ELSE 1.2816::DOUBLE END AS multiplier, len(q) >= 30 AS calibrated FROM ratios),
lastv AS (SELECT symbol, arg_max(close, i) AS last, arg_max(vol, i) AS vol FROM vol GROUP BY symbol)"""


@query("expected_range", O.sql(O.BARS, O.VOL, _RANGES, body="SELECT symbol, horizon, round(multiplier, 6) AS multiplier, calibrated, round(last * exp(-multiplier * vol * sqrt(horizon)), 4) AS low, round((exp(multiplier * vol * sqrt(horizon)) - 1), 4) AS pct FROM mult JOIN lastv USING (symbol)"))
def q_expected_range(spark, sf):
    r = expected_ranges(S.ewma_vol(prepared(spark, sf)))
    return r.select("symbol", "horizon", F.round("multiplier", 6).alias("multiplier"), "calibrated", F.round("low", 4).alias("low"), F.round("pct", 4).alias("pct"))


# --- as-of and interval joins -------------------------------------------------------------------


def bill_levels(spark, sf) -> DataFrame:
    o = T.table(spark, sf, "orders").select(F.trunc("o_orderdate", "MM").alias("day"), "o_totalprice")
    return o.groupBy("day").agg(F.round(F.avg("o_totalprice") / 1e5, 6).alias("level"))


_BILL = "bill AS MATERIALIZED (SELECT date_trunc('month', o_orderdate)::DATE AS day, round(avg(o_totalprice) / 1e5, 6) AS level FROM orders GROUP BY 1)"


@query("asof_strict", O.sql(O.BARS, _BILL, body="SELECT DISTINCT b.date, level FROM (SELECT DISTINCT date FROM bars) b ASOF LEFT JOIN bill ON bill.day < b.date"))
def asof_strict(spark, sf):
    """The last level known before each session."""
    dates = T.bars(spark, sf).select("date").distinct().withColumn("k", F.lit(1))
    return A.asof(dates, bill_levels(spark, sf).withColumn("k", F.lit(1)), F.col("date"), "day", ["level"], ["k"], strict=F.lit(True)).select("date", "level")


@query("asof_inclusive", O.sql(O.BARS, O.FILINGS, body="SELECT fil.symbol, filed, accession, owner, s.date AS session, s.i AS i FROM fil ASOF JOIN s ON fil.symbol = s.symbol AND fil.filed >= s.date"))
def asof_inclusive(spark, sf):
    """The session that a filing is anchored to: the last one on or before its day."""
    f = T.filings(spark, sf).select("symbol", "filed", "accession", "owner")
    got = A.asof(f, S.indexed(T.bars(spark, sf)).select("symbol", "date", "i"), F.col("filed"), "date", ["date", "i"], ["symbol"])
    return got.where("date is not null").select("symbol", "filed", "accession", "owner", F.col("date").alias("session"), "i")


def stamped(ann: DataFrame) -> DataFrame:
    return ann.select("symbol", "stamp", X.stamp_day(F.col("stamp")).alias("day"), X.stamp_after_close(F.col("stamp")).alias("late"))


def reactions(ann: DataFrame, bars: DataFrame) -> DataFrame:
    """symbol, stamp, date, i: the session that reacts to each stamp, the first with a move on its day or, after the close, after it."""
    moves = bars.where("i >= 1").select("symbol", "date", "i")
    return A.asof(stamped(ann), moves, F.col("day"), "date", ["date", "i"], ["symbol"], forward=True, strict=F.col("late")).where("date is not null").select("symbol", "stamp", "day", "date", "i")


_REACT = "re AS MATERIALIZED (SELECT symbol, stamp, day, CASE WHEN late THEN (SELECT min(date) FROM s WHERE s.symbol = ann.symbol AND i >= 1 AND date > day) ELSE (SELECT min(date) FROM s WHERE s.symbol = ann.symbol AND i >= 1 AND date >= day) END AS date FROM ann)"


@query("reaction_sessions", O.sql(O.BARS, O.ANNOUNCEMENTS, _REACT, body="SELECT symbol, stamp, date FROM re WHERE date IS NOT NULL"))
def reaction_sessions(spark, sf):
    return reactions(T.announcements(spark, sf), prepared(spark, sf)).select("symbol", "stamp", "date")


def reaction_sizes(ann: DataFrame, bars: DataFrame) -> DataFrame:
    """Median move of announcement sessions over that of others; at least 3 and 30 of them, stamps up to the last session."""
    last = bars.groupBy("symbol").agg(F.max("date").alias("_last"))
    days = reactions(ann, bars).join(last, "symbol").where("day <= _last").select("symbol", "date").distinct().withColumn("event", F.lit(True))
    moves = bars.withColumn("move", F.abs(S.change(1))).where("move is not null").join(days, ["symbol", "date"], "left").withColumn("event", F.coalesce("event", F.lit(False)))
    g = moves.groupBy("symbol").agg(F.count(F.when(F.col("event"), 1)).alias("n_events"), F.count(F.when(~F.col("event"), 1)).alias("n_other"), F.median(F.when(F.col("event"), F.col("move"))).alias("median_move"), F.median(F.when(~F.col("event"), F.col("move"))).alias("baseline"), F.max(F.when(F.col("event"), F.col("move"))).alias("largest"))
    g = g.where("n_events >= 3 AND n_other >= 30 AND baseline > 0").withColumn("amplification", X.over(F.col("median_move"), F.col("baseline")))
    return g.withColumn("meaningful", (F.col("n_events") >= 4) & (F.col("amplification") >= 1.25)).drop("n_other")


_MOVES = "mv AS MATERIALIZED (SELECT s.symbol, s.date, s.i, abs(s.close / lag(s.close) OVER (PARTITION BY s.symbol ORDER BY s.date) - 1) AS move, (s.symbol, s.date) IN (SELECT (symbol, date) FROM re WHERE date IS NOT NULL) AS event FROM s)"


@query("event_amplification", O.sql(O.BARS, O.ANNOUNCEMENTS, _REACT, _MOVES, body="""
SELECT symbol, n_events, round(m, 6) AS median_move, round(b, 6) AS baseline, round(largest, 6) AS largest, round(m / b, 6) AS amplification, n_events >= 4 AND m / b >= 1.25 AS meaningful FROM (
SELECT symbol, count(*) FILTER (event) AS n_events, count(*) FILTER (NOT event) AS o, median(move) FILTER (event) AS m, median(move) FILTER (NOT event) AS b, max(move) FILTER (event) AS largest FROM mv WHERE move IS NOT NULL GROUP BY symbol) WHERE n_events >= 3 AND o >= 30 AND b > 0"""))
def event_amplification(spark, sf):
    return places(reaction_sizes(T.announcements(spark, sf), prepared(spark, sf)), 6, "median_move", "baseline", "largest", "amplification")


def blackout(ann: DataFrame, bars: DataFrame, pad: int = C.EARNINGS_PAD) -> DataFrame:
    """symbol, i: sessions within ``pad`` of a reaction; a day without trading counts as the next session, whatever the hour."""
    at = A.asof(stamped(ann), bars.select("symbol", "date", "i"), F.col("day"), "date", ["date", "i"], ["symbol"], forward=True).where("i is not null")
    idx = F.col("i") + F.when((F.col("date") == F.col("day")) & F.col("late"), 1).otherwise(0)
    n = bars.groupBy("symbol").agg(F.max("i").alias("_n"))
    return at.select("symbol", F.explode(F.sequence(idx - pad, idx + pad)).alias("i")).join(n, "symbol").where("i between 0 and _n").select("symbol", "i").distinct()


_BLACK = "bl AS MATERIALIZED (SELECT DISTINCT symbol, x AS i FROM (SELECT ann.symbol, unnest(range(b.i + (CASE WHEN b.date = ann.day AND late THEN 1 ELSE 0 END) - 2, b.i + (CASE WHEN b.date = ann.day AND late THEN 1 ELSE 0 END) + 3)) AS x FROM ann ASOF JOIN s b ON ann.symbol = b.symbol AND ann.day <= b.date) WHERE x >= 0 AND x <= (SELECT max(i) FROM s z WHERE z.symbol = symbol))"
_BLACK = _BLACK.replace("(SELECT max(i) FROM s z WHERE z.symbol = symbol)", "(SELECT max(z.i) FROM s z WHERE z.symbol = u.symbol)").replace("+ 3)) AS x FROM ann ASOF JOIN s b ON ann.symbol = b.symbol AND ann.day <= b.date)", "+ 3)) AS x FROM ann ASOF JOIN s b ON ann.symbol = b.symbol AND ann.day <= b.date) u")


@query("blackout", O.sql(O.BARS, O.ANNOUNCEMENTS, _BLACK, body="SELECT symbol, i FROM bl"))
def q_blackout(spark, sf):
    return blackout(T.announcements(spark, sf), prepared(spark, sf)).select("symbol", F.col("i").cast("long").alias("i"))


def anchored(filings: DataFrame, bars: DataFrame, least: float = C.MIN_DOLLARS) -> DataFrame:
    """Filings merged by symbol, session and side: dollars, owners, plan only if all are, and cluster (purchases within
    five sessions back by two owners or more). The dollar floor is on each filing."""
    f = A.asof(filings.where(F.col("dollars") >= least), bars.select("symbol", "date", "i"), F.col("filed"), "date", ["date", "i"], ["symbol"]).where("i is not null")
    m = f.groupBy("symbol", "i", "side").agg(F.max("date").alias("date"), F.sum("dollars").alias("dollars"), F.array_sort(F.collect_set("owner")).alias("owners"), F.bool_and("plan").alias("plan"))
    recent = F.flatten(F.collect_list("owners").over(Window.partitionBy("symbol", "side").orderBy("i").rangeBetween(-C.CLUSTER_SESSIONS, 0)))
    return m.withColumn("cluster", (F.col("side") == "P") & (F.size(F.array_distinct(recent)) >= 2))


_ANCHOR = """
fa AS (SELECT fil.*, s.i, s.date FROM fil ASOF JOIN s ON fil.symbol = s.symbol AND fil.filed >= s.date WHERE dollars >= 10000),
an AS MATERIALIZED (SELECT symbol, i, side, max(date) AS date, sum(dollars) AS dollars, list_sort(list_distinct(list(owner))) AS owners, bool_and(plan) AS plan FROM fa GROUP BY ALL),
ev AS MATERIALIZED (SELECT an.*, side = 'P' AND (SELECT count(DISTINCT o) FROM (SELECT unnest(b.owners) AS o FROM an b WHERE b.symbol = an.symbol AND b.side = an.side AND b.i BETWEEN an.i - 5 AND an.i)) >= 2 AS cluster FROM an)"""
_ANCHOR = _ANCHOR.replace("ev AS MATERIALIZED (SELECT an.*, side = 'P' AND (SELECT count(DISTINCT o) FROM (SELECT unnest(b.owners) AS o FROM an b WHERE b.symbol = an.symbol AND b.side = an.side AND b.i BETWEEN an.i - 5 AND an.i)) >= 2 AS cluster FROM an)",
    "near AS (SELECT a.symbol, a.i, a.side, count(DISTINCT b.owner) AS n FROM an a JOIN fa b ON b.symbol = a.symbol AND b.side = a.side AND b.i BETWEEN a.i - 5 AND a.i GROUP BY ALL),\nev AS MATERIALIZED (SELECT an.*, an.side = 'P' AND n >= 2 AS cluster FROM an JOIN near USING (symbol, i, side))")


@query("cluster_buys", O.sql(O.BARS, O.FILINGS, _ANCHOR, body="SELECT symbol, i, side, date, round(dollars, 2) AS dollars, len(owners) AS owners, plan, cluster FROM ev"))
def cluster_buys(spark, sf):
    return places(anchored(T.filings(spark, sf), prepared(spark, sf)).withColumn("owners", F.size("owners")), 2, "dollars").select("symbol", "i", "side", "date", "dollars", "owners", "plan", "cluster")


# --- market model and shocks --------------------------------------------------------------------


def market(bars: DataFrame) -> DataFrame:
    """date, x: the equal-weighted mean log return."""
    return bars.where("r is not null").groupBy("date").agg(F.avg("r").alias("x"))


def residuals(bars: DataFrame, mkt: DataFrame) -> DataFrame:
    """Bars with e: the log return less beta times the market's, beta over the 252 pairs before. Null without a full window.

    The market has a row a session (about 250 a year, 16 bytes each), whatever the number of symbols; it is sent to every
    task, so that bars stay partitioned by symbol.
    """
    pairs = bars.where("r is not null").join(F.broadcast(mkt), "date")
    w = S.W.rowsBetween(-C.BETA_WINDOW, -1)
    beta = F.regr_slope("r", "x").over(w)
    return pairs.withColumn("_n", F.count("*").over(w)).withColumn("beta", beta).withColumn("e", F.when(F.col("_n") == C.BETA_WINDOW, F.col("r") - F.col("beta") * F.col("x"))).drop("_n")


_RES = """
mk AS MATERIALIZED (SELECT date, avg(r) AS x FROM s WHERE r IS NOT NULL GROUP BY date),
rs AS MATERIALIZED (SELECT symbol, date, i, r, x, close, open, volume, regr_slope(r, x) OVER w AS beta, CASE WHEN count(*) OVER w = 252 THEN r - regr_slope(r, x) OVER w * x END AS e
  FROM s JOIN mk USING (date) WHERE r IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING))"""
_RVOL = """
rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY i) - 1 AS k FROM rs WHERE e IS NOT NULL),
rv AS MATERIALIZED (WITH RECURSIVE go(symbol, k, var) AS (SELECT symbol, 59, var_samp(e) FROM rk WHERE k < 60 GROUP BY symbol HAVING count(*) = 60
  UNION ALL SELECT rk.symbol, rk.k::INT, 0.94::DOUBLE * var + (1 - 0.94::DOUBLE) * e * e FROM go JOIN rk ON rk.symbol = go.symbol AND rk.k = go.k + 1) SELECT rk.symbol, rk.i, sqrt(var) AS vol FROM go JOIN rk USING (symbol, k)),
vo AS MATERIALIZED (SELECT symbol, i, CASE WHEN i >= 20 THEN volume / nullif(avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0) END AS rvol FROM s)"""


@query("rolling_beta", O.sql(O.BARS, _RES, body="SELECT symbol, date, CASE WHEN e IS NOT NULL THEN round(beta, 6) END AS beta, round(e, 6) AS residual FROM rs"))
def rolling_beta(spark, sf):
    b = prepared(spark, sf)
    return residuals(b, market(b)).select("symbol", "date", F.round(F.when(F.col("e").isNotNull(), F.col("beta")), 6).alias("beta"), F.round("e", 6).alias("residual"))


@query("residual_vol", O.sql(O.BARS, _RES, _RVOL, body="SELECT symbol, i, round(vol, 8) AS vol FROM rv"))
def residual_vol(spark, sf):
    b = prepared(spark, sf)
    return S.ewma_vol(residuals(b, market(b)), "e").where("vol is not null").select("symbol", "i", F.round("vol", 8).alias("vol"))


def shocks(bars: DataFrame, ann: DataFrame, threshold: float, cooldown: int = C.COOLDOWN) -> tuple[DataFrame, DataFrame]:
    """Accepted shock events, and the residuals they came from."""
    res = S.ewma_vol(residuals(bars.withColumn("rvol", S.rvol()), market(bars)), "e").persist()
    before = F.when(F.lag("i").over(S.W) == F.col("i") - 1, F.lag("vol").over(S.W))
    cand = res.withColumn("z", X.over(F.col("e"), F.when(before > 0, before))).where((F.abs("z") >= threshold) & F.col("rvol").isNotNull())
    cand = cand.withColumn("i", F.col("i").cast("long")).join(blackout(ann, bars).select("symbol", F.col("i").cast("long").alias("i")), ["symbol", "i"], "left_anti")
    ev = A.cooled(cand, cooldown)
    bucket = F.when(F.col("rvol") >= 2.0, "confirmed").when(F.col("rvol") < 1.5, "unconfirmed")
    return ev.select("symbol", "i", "date", "z", (F.col("z") > 0).alias("up"), "rvol", bucket.alias("bucket")), res


_SHOCK = """
cand AS MATERIALIZED (SELECT rs.symbol, rs.i, rs.date, e / rv.vol AS z, rvol FROM rs JOIN rv ON rv.symbol = rs.symbol AND rv.i = rs.i - 1 JOIN vo ON vo.symbol = rs.symbol AND vo.i = rs.i
  WHERE e IS NOT NULL AND rv.vol > 0 AND abs(e / rv.vol) >= 2.0 AND rvol IS NOT NULL AND (rs.symbol, rs.i) NOT IN (SELECT (symbol, i) FROM bl)),
acc AS MATERIALIZED (WITH RECURSIVE go(symbol, i) AS (SELECT symbol, min(i) FROM cand GROUP BY symbol
  UNION ALL SELECT go.symbol, min(c.i) FROM go JOIN cand c ON c.symbol = go.symbol AND c.i >= go.i + 21 GROUP BY go.symbol, go.i) SELECT * FROM go),
sh AS MATERIALIZED (SELECT cand.*, z > 0 AS up, CASE WHEN rvol >= 2.0 THEN 'confirmed' WHEN rvol < 1.5 THEN 'unconfirmed' END AS bucket FROM cand JOIN acc USING (symbol, i))"""
_SHOCK_PARTS = (O.BARS, O.ANNOUNCEMENTS, _BLACK, _RES, _RVOL, _SHOCK)


@query("shock_events", O.sql(*_SHOCK_PARTS, body="SELECT symbol, i, date, round(z, 6) AS z, up, round(rvol, 6) AS rvol, bucket FROM sh"))
def shock_events(spark, sf):
    ev, _ = shocks(prepared(spark, sf), T.announcements(spark, sf), 2.0)
    return places(ev, 6, "z", "rvol")


def car(ev: DataFrame, res: DataFrame, h: int, lag: int = 1) -> DataFrame:
    """Events with car, the compounded residual of their window; windows with a missing residual are left out."""
    held = A.holding(ev, lag, h).join(res.where("e is not null").select("symbol", F.col("i").cast("long").alias("j"), "e"), ["symbol", "j"])
    return held.groupBy(*ev.columns).agg(F.count("e").alias("_n"), F.expm1(F.sum("e")).alias("car")).where(F.col("_n") == h).drop("_n")


@query("shock_car", O.sql(*_SHOCK_PARTS, body="""
, w AS (SELECT sh.symbol, sh.i, sh.date, up, exp(sum(e)) - 1 AS car FROM sh JOIN rs ON rs.symbol = sh.symbol AND rs.i BETWEEN sh.i + 1 AND sh.i + 5 AND e IS NOT NULL GROUP BY ALL HAVING count(e) = 5),
dd AS (SELECT up, date, avg(car) AS m FROM w GROUP BY ALL)
SELECT up, round(avg(m), 6) AS mean, round(stddev_samp(m) / sqrt(count(*)), 6) AS se, round(avg(m) / (stddev_samp(m) / sqrt(count(*))), 5) AS t, count(*) AS dates FROM dd GROUP BY up HAVING count(*) >= 3""").replace("\n\n, w", ",\nw"))
def shock_car(spark, sf):
    ev, res = shocks(prepared(spark, sf), T.announcements(spark, sf), 2.0)
    c = ST.clustered(car(ev, res, 5), "car", ["up"]).where("dates >= 3")
    return places(places(c, 6, "mean", "se"), 5, "t")


def calendar_time(ev: DataFrame, res: DataFrame, h: int | Column, lag: int | Column = 1, by: Sequence[str] = ()) -> DataFrame:
    """date, spread, breadth: mean residual of the up leg less the down leg; each name once a session; both legs present.

    With ``by``, each cell has its own series; ``h`` and ``lag`` may be columns of it.
    """
    held = A.holding(ev.select("symbol", "i", "up", *by), lag, h).select("symbol", "j", "up", *by).distinct()
    on = held.join(res.where("e is not null").select("symbol", F.col("i").cast("long").alias("j"), "date", "e"), ["symbol", "j"])
    g = on.groupBy(*by, "date").agg(F.avg(F.when(F.col("up"), F.col("e"))).alias("u"), F.avg(F.when(~F.col("up"), F.col("e"))).alias("d"), (F.count("*") / 2).alias("breadth"))
    return g.where("u is not null and d is not null").select(*by, "date", (F.col("u") - F.col("d")).alias("spread"), "breadth")


_CAL = """
hold AS (SELECT DISTINCT {ev}.symbol, up, rs.date, e FROM {ev} JOIN rs ON rs.symbol = {ev}.symbol AND rs.i BETWEEN {ev}.i + {lag} AND {ev}.i + {lag} + {h} - 1 AND e IS NOT NULL),
sp AS MATERIALIZED (SELECT date, avg(e) FILTER (up) - avg(e) FILTER (NOT up) AS spread, count(*) / 2 AS breadth FROM hold GROUP BY date HAVING count(*) FILTER (up) > 0 AND count(*) FILTER (NOT up) > 0)"""


def _nw_sql(src: str, x: str, lags: int, order: str = "date", by: str = "1", out: str = "nw") -> str:
    return f"""{out}d AS MATERIALIZED (SELECT {by} AS g, row_number() OVER w - 1 AS k, {x} - avg({x}) OVER v AS d, avg({x}) OVER v AS mean, count(*) OVER v AS n FROM {src} WHERE {x} IS NOT NULL WINDOW w AS (PARTITION BY {by} ORDER BY {order}), v AS (PARTITION BY {by})),
{out} AS (SELECT g, n, mean, CASE WHEN n >= 3 AND var > 0 THEN sqrt(var / n) ELSE 0 END AS se FROM (SELECT a.g, a.n, a.mean, sum(CASE WHEN a.k = b.k THEN 1 ELSE 2 * (1 - (a.k - b.k) / ({lags} + 1.0::DOUBLE)) END * a.d * b.d) / a.n AS var FROM {out}d a JOIN {out}d b ON a.g = b.g AND a.k - b.k BETWEEN 0 AND {lags} GROUP BY a.g, a.n, a.mean))"""


@query("calendar_time", O.sql(*_SHOCK_PARTS, _CAL.format(ev="sh", lag=1, h=10), _nw_sql("sp", "spread", 10), body="SELECT n, round(mean, 6) AS mean, round(se, 6) AS se, coalesce(round(mean / nullif(se, 0), 5), 0) AS t, (SELECT round(avg(breadth), 6) FROM sp) AS breadth FROM nw"))
def q_calendar_time(spark, sf):
    ev, res = shocks(prepared(spark, sf), T.announcements(spark, sf), 2.0)
    c = calendar_time(ev, res, 10).withColumn("g", F.lit(1))
    nw = ST.newey_west(c, "spread", 10, ["g"]).join(c.groupBy("g").agg(F.round(F.avg("breadth"), 6).alias("breadth")), "g").drop("g")
    return places(places(nw, 6, "mean", "se"), 5, "t")


# --- event studies ------------------------------------------------------------------------------


def excess(part: Column, n: Column, whole: Column, names: Column) -> Column:
    """Mean of ``n`` of a date's names less that of all ``names``; 0 where these are the same, as sums in another order
    would leave a rounding error, whose t is arbitrary."""
    return F.when(n == names, F.when(whole.isNotNull(), 0.0)).otherwise(part - whole)


def leg_alpha(ev: DataFrame, res: DataFrame, h: int | Column, least: int, lag: int | Column = 1, by: Sequence[str] = ("side",)) -> DataFrame:
    """Daily mean residual of names with a live window, less the mean of the whole universe, Newey-West at ``h``.

    Each cell of ``by`` has its own series; ``h`` and ``lag`` may be columns of it.
    """
    base = res.where("e is not null").groupBy("date").agg(F.avg("e").alias("all"), F.count("*").alias("names")).where(F.col("names") >= least)
    held = A.holding(ev.select("symbol", "i", *by), lag, h).select("symbol", "j", *by).distinct()
    leg = held.join(res.where("e is not null").select("symbol", F.col("i").cast("long").alias("j"), "date", "e"), ["symbol", "j"]).groupBy(*by, "date").agg(F.avg("e").alias("leg"), F.count("*").alias("breadth"))
    both = leg.join(base, "date").withColumn("x", excess(F.col("leg"), F.col("breadth"), F.col("all"), F.col("names")))
    fit = ST.newey_west(both, "x", h, list(by)).join(both.groupBy(*by).agg(F.avg("breadth").alias("breadth")), list(by))
    return fit.where("n >= 60").withColumn("car", F.col("mean") * h)


@query("insider_leg", O.sql(O.BARS, O.FILINGS, _ANCHOR, _RES, """
ho AS (SELECT DISTINCT ev.symbol, side, rs.date, e FROM ev JOIN rs ON rs.symbol = ev.symbol AND rs.i BETWEEN ev.i + 1 AND ev.i + 21 AND e IS NOT NULL),
base AS (SELECT date, avg(e) AS a FROM rs WHERE e IS NOT NULL GROUP BY date HAVING count(*) >= 10),
lx AS MATERIALIZED (SELECT side, date, leg - a AS x, breadth FROM (SELECT side, date, avg(e) AS leg, count(*) AS breadth FROM ho GROUP BY ALL) JOIN base USING (date))""", _nw_sql("lx", "x", 21, by="side"), body="SELECT g AS side, n, round(mean, 6) AS mean, round(se, 6) AS se, coalesce(round(mean / nullif(se, 0), 5), 0) AS t, round((SELECT avg(breadth) FROM lx WHERE side = g), 6) AS breadth, round(mean * 21, 6) AS car FROM nw WHERE n >= 60"))
def insider_leg(spark, sf):
    b = prepared(spark, sf)
    leg = leg_alpha(anchored(T.filings(spark, sf), b), residuals(b, market(b)), 21, 10)
    return places(places(leg, 6, "mean", "se", "breadth", "car"), 5, "t")


def gap_split(ev: DataFrame, bars: DataFrame) -> DataFrame:
    """Market-adjusted overnight and intraday return of the session after a filing, clustered by date. Without variance, t is null."""
    on, legs = Window.partitionBy("date"), ("gap", "intraday")
    g = bars.withColumn("gap", F.ln(X.over(F.col("open"), F.lag("close").over(S.W)))).withColumn("intraday", F.ln(X.over(F.col("close"), F.col("open")))).where("gap is not null")
    g = g.select("symbol", "i", "date", *legs, *(F.avg(x).over(on).alias(f"{x}_all") for x in legs), *(F.count(x).over(on).alias(f"{x}_names") for x in legs))
    after = ev.select("symbol", "side", (F.col("i") + 1).alias("i")).join(g, ["symbol", "i"])
    daily = after.groupBy("side", "date").agg(*(excess(F.avg(x), F.count(x), F.first(f"{x}_all"), F.first(f"{x}_names")).alias(x) for x in legs))
    t = lambda x: X.over(F.avg(x), F.stddev_samp(x) / F.sqrt(F.count("*"))).alias(f"{x}_t")
    return daily.groupBy("side").agg(F.avg("gap").alias("gap"), t("gap"), F.avg("intraday").alias("intraday"), t("intraday"), F.count("*").alias("dates"))


@query("gap_split", O.sql(O.BARS, O.FILINGS, _ANCHOR, """
gm AS MATERIALIZED (SELECT symbol, date, i, ln(open / lag(close) OVER (PARTITION BY symbol ORDER BY date)) AS gap, ln(close / open) AS intraday FROM s),
ga AS MATERIALIZED (SELECT gm.*, gap - avg(gap) OVER (PARTITION BY date) AS xg, intraday - avg(intraday) OVER (PARTITION BY date) AS xi FROM gm WHERE gap IS NOT NULL),
dm AS (SELECT side, ga.date, avg(xg) AS g, avg(xi) AS d FROM ev JOIN ga ON ga.symbol = ev.symbol AND ga.i = ev.i + 1 GROUP BY ALL)""", body="SELECT side, round(avg(g), 6) AS gap, round(avg(g) / nullif(stddev_samp(g) / sqrt(count(*)), 0), 4) AS gap_t, round(avg(d), 6) AS intraday, round(avg(d) / nullif(stddev_samp(d) / sqrt(count(*)), 0), 4) AS intraday_t, count(*) AS dates FROM dm GROUP BY side"))
def q_gap_split(spark, sf):
    b = prepared(spark, sf)
    return places(places(gap_split(anchored(T.filings(spark, sf), b), b), 6, "gap", "intraday"), 4, "gap_t", "intraday_t")


def sample_dates(bars: DataFrame, h: int, first: int = 273, step: int = 21) -> DataFrame:
    """Every ``step``-th session of the longest calendar, with ``h`` sessions ahead."""
    longest = bars.groupBy("symbol").agg(F.count("*").alias("_c")).orderBy(F.desc("_c"), "symbol").limit(1)
    return bars.join(longest, "symbol").where((F.col("i") >= first) & ((F.col("i") - first) % step == 0) & (F.col("i") < F.col("_c") - h)).select("date")


_SAMPLE = "cal AS MATERIALIZED (SELECT date FROM s, (SELECT symbol AS ls, count(*) AS c FROM bars GROUP BY symbol ORDER BY count(*) DESC, symbol LIMIT 1) WHERE symbol = ls AND i >= 273 AND (i - 273) % 21 = 0 AND i < c - 21)"
_SIGNAL = """
sg AS MATERIALIZED (SELECT * FROM (SELECT s.symbol, s.date, s.i, lag(close, 21) OVER w / nullif(lag(close, 252) OVER w, 0) - 1 AS mom, CASE WHEN s.i >= 252 THEN close / max(high) OVER (PARTITION BY symbol ORDER BY date ROWS 251 PRECEDING) END AS near, lead(close, 21) OVER w / close - 1 AS fwd
  FROM s WINDOW w AS (PARTITION BY symbol ORDER BY date)) JOIN cal USING (date) WHERE i >= 273 AND mom IS NOT NULL AND near IS NOT NULL AND fwd IS NOT NULL)"""


def signals(bars: DataFrame, h: int = 21) -> DataFrame:
    df = with_momentum(bars).withColumn("year_high", F.max("high").over(S.back(251))).withColumn("near", S.nearness()).withColumn("fwd", S.forward(h))
    df = df.join(sample_dates(bars, h), "date", "left_semi").where((F.col("i") >= 273) & F.col("mom_12_1").isNotNull() & F.col("near").isNotNull() & F.col("fwd").isNotNull())
    return df.select("symbol", "date", F.col("mom_12_1").alias("mom"), "near", "fwd")


def spread(df: DataFrame, signal: str, by: list[str], k: F.Column) -> DataFrame:
    """Mean forward return of the top k less that of the bottom k by signal; n and k as columns."""
    g = R.legs(df, signal, by, k).groupBy(*by).agg(F.avg(F.when(F.col("rn") > F.col("n") - F.col("k"), F.col("fwd"))).alias("winners"), F.avg(F.when(F.col("rn") <= F.col("k"), F.col("fwd"))).alias("losers"), F.max("n").alias("n"), F.max("k").alias("k"))
    return g.withColumn("spread", F.col("winners") - F.col("losers"))


def fraction(f: float) -> F.Column:
    return F.greatest(F.lit(1), F.floor(F.col("n") * f)).cast("long")


@query("momentum_study", O.sql(O.BARS, _SAMPLE, _SIGNAL, body="""
, o AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY mom, symbol) AS rn, count(*) OVER (PARTITION BY date) AS n FROM sg),
x AS (SELECT f, date, avg(fwd) FILTER (rn > n - greatest(1, floor(n * q))) - avg(fwd) FILTER (rn <= greatest(1, floor(n * q))) AS sp FROM o, (VALUES ('tercile', 1 / 3::DOUBLE), ('decile', 0.1::DOUBLE)) t(f, q) WHERE n >= 12 GROUP BY f, date)
SELECT f AS legs, count(*) AS n, round(avg(sp), 6) AS mean, round(stddev_samp(sp), 6) AS sd, coalesce(round(avg(sp) / nullif(stddev_samp(sp) / sqrt(count(*)), 0), 5), 0) AS t, round(2 * stddev_samp(sp) / sqrt(count(*)), 6) AS mde, ceil(pow(2 * stddev_samp(sp) / nullif(abs(avg(sp)), 0), 2))::BIGINT AS needed, count(*) FILTER (sp > 0) AS positive FROM x GROUP BY f""").replace("\n\n, o", ",\no"))
def momentum_study(spark, sf):
    s = signals(prepared(spark, sf))
    rows = [spread(s, "mom", ["date"], fraction(q)).where("n >= 12").withColumn("legs", F.lit(n)) for n, q in (("tercile", 1 / 3), ("decile", 0.1))]
    return places(places(ST.t_summary(rows[0].unionByName(rows[1]), "spread", ["legs"]), 6, "mean", "sd", "mde"), 5, "t")


@query("double_sort", O.sql(O.BARS, _SAMPLE, _SIGNAL, body="""
, o AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY near, symbol) AS rn, count(*) OVER (PARTITION BY date) AS nn FROM sg),
bk AS (SELECT *, CASE WHEN rn <= nn // 3 THEN 0 WHEN rn <= 2 * (nn // 3) THEN 1 ELSE 2 END AS b FROM o WHERE nn >= 12),
p AS (SELECT *, row_number() OVER (PARTITION BY date, b ORDER BY mom, symbol) AS r2, count(*) OVER (PARTITION BY date, b) AS n2 FROM bk),
x AS (SELECT date, b, avg(fwd) FILTER (r2 > n2 - greatest(1, floor(n2 * (1 / 3::DOUBLE)))) - avg(fwd) FILTER (r2 <= greatest(1, floor(n2 * (1 / 3::DOUBLE)))) AS sp FROM p WHERE n2 >= 4 GROUP BY date, b)
SELECT date, round(avg(sp), 6) AS spread FROM x GROUP BY date HAVING count(*) = 3""").replace("\n\n, o", ",\no"))
def double_sort(spark, sf):
    """Momentum's spread within terciles of nearness, the remainder in the top one, averaged over all three."""
    on = Window.partitionBy("date")
    s = signals(prepared(spark, sf)).withColumn("rn", F.row_number().over(on.orderBy("near", "symbol"))).withColumn("nn", F.count("*").over(on)).where("nn >= 12")
    third = F.floor(F.col("nn") / 3)
    s = s.withColumn("b", F.when(F.col("rn") <= third, 0).when(F.col("rn") <= 2 * third, 1).otherwise(2)).select("symbol", "date", "b", "mom", "fwd")
    cells = spread(s, "mom", ["date", "b"], fraction(1 / 3)).where("n >= 4")
    return cells.groupBy("date").agg(F.count("*").alias("cells"), F.round(F.avg("spread"), 6).alias("spread")).where("cells = 3").select("date", "spread")


@query("spearman", O.sql(O.BARS, _SAMPLE, _SIGNAL, body="""
SELECT round(avg(c), 6) AS rho, count(*) AS dates FROM (SELECT date, corr(a, b) AS c FROM (SELECT date, row_number() OVER (PARTITION BY date ORDER BY mom, symbol) AS a, row_number() OVER (PARTITION BY date ORDER BY near, symbol) AS b FROM sg) GROUP BY date HAVING count(*) >= 12)"""))
def spearman(spark, sf):
    on = Window.partitionBy("date")
    s = signals(prepared(spark, sf)).select("date", F.row_number().over(on.orderBy("mom", "symbol")).cast("double").alias("a"), F.row_number().over(on.orderBy("near", "symbol")).cast("double").alias("b"))
    return s.groupBy("date").agg(F.corr("a", "b").alias("c"), F.count("*").alias("n")).where("n >= 12 and c is not null").agg(F.round(F.avg("c"), 6).alias("rho"), F.count("*").alias("dates"))


@query("tom_study", O.sql(O.BARS, SQLTOM := """
tp AS MATERIALIZED (SELECT symbol, date, r, row_number() OVER (PARTITION BY symbol, date_trunc('month', date) ORDER BY date) AS pos, date_trunc('month', lead(date) OVER (PARTITION BY symbol ORDER BY date)) <> date_trunc('month', date) AS lm, date_trunc('month', date) AS m,
  min(date_trunc('month', date)) OVER (PARTITION BY symbol) AS m0, max(date_trunc('month', date)) OVER (PARTITION BY symbol) AS m1 FROM s),
tt AS (SELECT symbol, m, avg(r) FILTER (pos <= 3 OR lm) AS a, count(r) FILTER (pos <= 3 OR lm) AS na, avg(r) FILTER (NOT (pos <= 3 OR coalesce(lm, false))) AS b, count(r) FILTER (NOT (pos <= 3 OR coalesce(lm, false))) AS nb FROM tp WHERE m > m0 AND m < m1 GROUP BY ALL)""", body="SELECT symbol, count(*) AS n, round(avg(a - b), 6) AS mean, coalesce(round(avg(a - b) / nullif(stddev_samp(a - b) / sqrt(count(*)), 0), 5), 0) AS t FROM tt WHERE na >= 2 AND nb >= 5 GROUP BY symbol"))
def tom_study(spark, sf):
    """Paired monthly differences of turn-of-month and other sessions."""
    df = with_month_position(prepared(spark, sf))
    t, o = F.when(F.col("tom"), F.col("r")), F.when(~F.col("tom"), F.col("r"))
    g = df.groupBy("symbol", "m").agg(F.avg(t).alias("a"), F.count(t).alias("na"), F.avg(o).alias("b"), F.count(o).alias("nb")).where("na >= 2 and nb >= 5").withColumn("x", F.col("a") - F.col("b"))
    return ST.t_summary(g, "x", ["symbol"]).select("symbol", "n", F.round("mean", 6).alias("mean"), F.round("t", 5).alias("t"))


@query("payroll_welch", O.sql(O.BARS, body="""
SELECT symbol, count(r) FILTER (p) AS n1, count(r) FILTER (NOT p) AS n0, round(avg(r) FILTER (p) - avg(r) FILTER (NOT p), 6) AS diff,
  round((avg(r) FILTER (p) - avg(r) FILTER (NOT p)) / sqrt(var_samp(r) FILTER (p) / count(r) FILTER (p) + var_samp(r) FILTER (NOT p) / count(r) FILTER (NOT p)), 5) AS t
FROM (SELECT *, date = date_trunc('month', date)::DATE + ((12 - isodow(date_trunc('month', date))) % 7)::INT AS p FROM s WHERE r IS NOT NULL) GROUP BY symbol"""))
def payroll_welch(spark, sf):
    """First Fridays against other sessions, by separate variances."""
    w = ST.welch(prepared(spark, sf).where("r is not null"), "r", F.col("date") == X.first_friday(F.col("date")), ["symbol"])
    return places(places(w, 6, "diff"), 5, "t")


# --- surprises, conditional amplification, range coverage, vol-managed ---------------------------


_SURPRISE = "sur AS MATERIALIZED (SELECT symbol, stamp, day, late, CASE WHEN day(day) % 10 <> 0 THEN ((day(day) * 37 + month(day) * 11 + year(day)) % 41) / 10.0::DOUBLE - 2 END AS spct FROM ann)"


def surprises(ann: DataFrame) -> DataFrame:
    d = X.stamp_day(F.col("stamp"))
    return ann.withColumn("spct", F.when(F.day(d) % 10 != 0, ((F.day(d) * 37 + F.month(d) * 11 + F.year(d)) % 41) / 10.0 - 2))


def pead_events(sur: DataFrame, bars: DataFrame, least: int) -> DataFrame:
    """One event a symbol and session from i = 260, ranked by surprise within the quarter of the reaction."""
    at = A.asof(stamped(sur).join(sur.select("symbol", "stamp", "spct"), ["symbol", "stamp"]).where("spct is not null"), bars.select("symbol", "date", "i"), F.col("day"), "date", ["date", "i"], ["symbol"], forward=True, strict=F.col("late"))
    first = Window.partitionBy("symbol", "i").orderBy("stamp")
    ev = at.where("i >= 260").withColumn("_f", F.row_number().over(first)).where("_f = 1").withColumn("quarter", X.quarter_key(F.col("date")))
    ev = ev.withColumn("_q", F.count("*").over(Window.partitionBy("quarter"))).where(F.col("_q") >= least)
    return ev.withColumn("srank", R.ordinal("spct", "quarter")).select("symbol", "i", "date", "spct", "quarter", "srank")


_PEAD = """
pe0 AS (SELECT symbol, spct, stamp, CASE WHEN late THEN (SELECT min(i) FROM s WHERE s.symbol = sur.symbol AND date > day) ELSE (SELECT min(i) FROM s WHERE s.symbol = sur.symbol AND date >= day) END AS i FROM sur WHERE spct IS NOT NULL),
pe1 AS (SELECT pe0.symbol, i, date, spct, year(date) || 'Q' || quarter(date) AS quarter FROM pe0 JOIN s USING (symbol, i) WHERE i >= 260 QUALIFY row_number() OVER (PARTITION BY symbol, i ORDER BY stamp) = 1),
pe AS MATERIALIZED (SELECT *, (row_number() OVER (PARTITION BY quarter ORDER BY spct, symbol) - 1) / (count(*) OVER (PARTITION BY quarter) - 1) AS srank FROM pe1 QUALIFY count(*) OVER (PARTITION BY quarter) >= 8)"""


@query("pead_events", O.sql(O.BARS, O.ANNOUNCEMENTS, _SURPRISE, _PEAD, body="SELECT symbol, i, date, spct, quarter, round(srank, 6) AS srank FROM pe"))
def q_pead_events(spark, sf):
    return places(pead_events(surprises(T.announcements(spark, sf)), prepared(spark, sf), 8), 6, "srank")


@query("pead", O.sql(O.BARS, O.ANNOUNCEMENTS, _SURPRISE, _PEAD, _RES, "pu AS (SELECT symbol, i, srank >= 2 / 3::DOUBLE AS up FROM pe WHERE srank >= 2 / 3::DOUBLE OR srank <= 1 / 3::DOUBLE)", _CAL.format(ev="pu", lag=1, h=21), _nw_sql("sp", "spread", 21), body="SELECT n, round(mean, 6) AS mean, round(se, 6) AS se, coalesce(round(mean / nullif(se, 0), 5), 0) AS t FROM nw"))
def pead(spark, sf):
    b = prepared(spark, sf)
    ev = pead_events(surprises(T.announcements(spark, sf)), b, 8)
    sides = ev.where(F.col("srank") >= 2 / 3).withColumn("up", F.lit(True)).unionByName(ev.where(F.col("srank") <= 1 / 3).withColumn("up", F.lit(False)))
    c = calendar_time(sides, residuals(b, market(b)), 21).withColumn("g", F.lit(1))
    return places(places(ST.newey_west(c, "spread", 21, ["g"]).drop("g"), 6, "mean", "se"), 5, "t")


def conditional_amplification(ann: DataFrame, vol: DataFrame, trail: int = 252) -> DataFrame:
    """Log of event move over the ordinary one, by the third of the trailing range that volatility stood in before."""
    ev = reactions(ann, vol).select("symbol", "date").distinct().withColumn("event", F.lit(True))
    m = vol.withColumn("move", F.abs(S.change(1))).withColumn("v", F.lag("vol").over(S.W)).withColumn("seen", F.collect_list("vol").over(S.W.rowsBetween(-trail - 1, -1)))
    m = m.join(ev, ["symbol", "date"], "left").withColumn("event", F.coalesce("event", F.lit(False)))
    part = Window.partitionBy("symbol")
    ordinary = F.when(~F.col("event"), F.col("move"))
    m = m.withColumn("base", F.percentile(ordinary, 0.5).over(part)).withColumn("no", F.count(ordinary).over(part)).where("event AND move > 0 AND no >= 250 AND base > 0").where((F.col("i") >= trail + 1) & F.col("v").isNotNull() & (F.size("seen") >= 100))
    p = F.size(F.filter("seen", lambda x: x <= F.col("v"))) / F.size("seen")
    return m.select("symbol", "date", F.ln(F.col("move") / F.col("base")).alias("logratio"), F.when(p < 1 / 3, "quiet").when(p < 2 / 3, "middle").otherwise("turbulent").alias("state"))


@query("conditional_amplification", O.sql(O.BARS, O.VOL, O.ANNOUNCEMENTS, _REACT, _MOVES, """
ba AS MATERIALIZED (SELECT symbol, median(move) AS base, count(*) AS no FROM mv WHERE NOT event AND move IS NOT NULL GROUP BY symbol),
ca AS MATERIALIZED (SELECT mv.symbol, mv.date, ln(move / base) AS lr, v.vol AS v, count(h.vol) AS n, count(*) FILTER (h.vol <= v.vol) / count(h.vol) AS p FROM mv JOIN ba USING (symbol) JOIN vol v ON v.symbol = mv.symbol AND v.i = mv.i - 1 JOIN vol h ON h.symbol = mv.symbol AND h.i BETWEEN mv.i - 253 AND mv.i - 1
  WHERE event AND move > 0 AND no >= 250 AND base > 0 AND mv.i >= 253 AND v.vol IS NOT NULL GROUP BY ALL HAVING count(h.vol) >= 100),
cs AS (SELECT CASE WHEN p < 1 / 3::DOUBLE THEN 'quiet' WHEN p < 2 / 3::DOUBLE THEN 'middle' ELSE 'turbulent' END AS state, date, avg(lr) AS m, count(*) AS c FROM ca GROUP BY ALL)""", body="SELECT state, round(avg(m), 6) AS mean, round(CASE WHEN count(*) >= 3 THEN stddev_samp(m) / sqrt(count(*)) ELSE 0 END, 6) AS se, count(*) AS dates FROM cs GROUP BY state"))
def q_conditional(spark, sf):
    c = conditional_amplification(T.announcements(spark, sf), S.ewma_vol(prepared(spark, sf)))
    return places(ST.clustered(c, "logratio", ["state"]).drop("t"), 6, "mean", "se")


def range_coverage(ann: DataFrame, vol: DataFrame, h: int = 5, first: int = 300) -> DataFrame:
    """Hit rates of flat and event-aware bands over windows that don't overlap, and of flat ones over quiet windows.

    The amplification of a window uses events and ordinary sessions strictly before it: at least 4 and 60.
    """
    ev = reactions(ann, vol).select("symbol", "date").distinct().withColumn("event", F.lit(True))
    n = F.count("*").over(Window.partitionBy("symbol"))
    m = vol.join(ev, ["symbol", "date"], "left").withColumn("event", F.coalesce("event", F.lit(False))).withColumn("move", F.abs(S.change(1))).withColumn("n", n)
    past = S.W.rowsBetween(Window.unboundedPreceding, -1)
    e, o = F.when(F.col("event"), F.col("move")), F.when(~F.col("event"), F.col("move"))
    m = m.withColumn("ne", F.count(e).over(past)).withColumn("no", F.count(o).over(past)).withColumn("me", F.percentile(e, 0.5).over(past)).withColumn("mo", F.percentile(o, 0.5).over(past))
    m = m.withColumn("amp", F.when((F.col("ne") >= 4) & (F.col("no") >= 60) & (F.col("mo") > 0), X.over(F.col("me"), F.col("mo"))))
    m = m.withColumn("k", F.sum(F.col("event").cast("int")).over(S.W.rowsBetween(1, h))).withColumn("real", S.forward_abs_log(h))
    mult = expected_ranges(vol, (h,)).select("symbol", "multiplier")
    m = m.where((F.col("i") >= first) & ((F.col("i") - first) % h == 0) & (F.col("i") < F.col("n") - h) & F.col("vol").isNotNull()).join(mult, "symbol")
    flat = F.col("multiplier") * F.col("vol") * (h**0.5)
    aware = F.col("multiplier") * F.col("vol") * F.sqrt(h - F.col("k") + F.col("k") * F.col("amp") * F.col("amp"))
    m = m.withColumn("flat", flat).withColumn("aware", aware).withColumn("hit_flat", (F.col("real") <= flat * (1 + EDGE)).cast("double")).withColumn("hit_aware", (F.col("real") <= aware * (1 + EDGE)).cast("double"))
    kind = F.when(F.col("k") == 0, "quiet").when(F.col("amp").isNotNull(), "event")
    return m.withColumn("kind", kind).where("kind is not null").groupBy("kind").agg(F.count("*").alias("n"), F.avg("hit_flat").alias("flat"), F.avg(F.when(F.col("kind") == "event", F.col("hit_aware"))).alias("aware"), F.avg(F.when(F.col("kind") == "event", X.over(F.col("aware"), F.col("flat")))).alias("wider"))


@query("event_range", O.sql(O.BARS, O.VOL, _RANGES, O.ANNOUNCEMENTS, _REACT, _MOVES, """
wi AS MATERIALIZED (SELECT v.symbol, v.i, v.vol, multiplier, abs(ln(z.close / v.close)) AS real, (SELECT count(*) FROM mv q WHERE q.symbol = v.symbol AND q.i BETWEEN v.i + 1 AND v.i + 5 AND event) AS k,
  (SELECT CASE WHEN count(*) FILTER (event) >= 4 AND count(*) FILTER (NOT event) >= 60 THEN median(move) FILTER (event) / nullif(median(move) FILTER (NOT event), 0) END FROM mv q WHERE q.symbol = v.symbol AND q.i < v.i AND move IS NOT NULL) AS amp
  FROM vol v JOIN s z ON z.symbol = v.symbol AND z.i = v.i + 5 JOIN mult ON mult.symbol = v.symbol AND horizon = 5 WHERE v.i >= 300 AND (v.i - 300) % 5 = 0 AND v.vol IS NOT NULL)""", body="""
SELECT CASE WHEN k = 0 THEN 'quiet' ELSE 'event' END AS kind, count(*) AS n, round(avg((real <= multiplier * vol * sqrt(5) * (1 + 1e-12::DOUBLE))::INT), 6) AS flat, round(avg(CASE WHEN k > 0 THEN (real <= multiplier * vol * sqrt(5 - k + k * amp * amp) * (1 + 1e-12::DOUBLE))::INT END), 6) AS aware,
  round(avg(CASE WHEN k > 0 THEN sqrt(5 - k + k * amp * amp) / sqrt(5) END), 6) AS wider FROM wi WHERE k = 0 OR amp IS NOT NULL GROUP BY 1"""))
def event_range(spark, sf):
    return places(range_coverage(T.announcements(spark, sf), S.ewma_vol(prepared(spark, sf))), 6, "flat", "aware", "wider")


def vol_managed(bars: DataFrame, bills: DataFrame, burn: int = 252) -> DataFrame:
    """date, r, rf, w: daily returns of one symbol's sessions and the no-leverage weight set at month starts.

    The signal is the mean squared return of the 21 sessions before; its scale is the median of earlier month starts' signals
    (at least 12), clamped to [0, 1] and held to the month's end.
    """
    ret = bars.withColumn("ret", S.change(1)).where("ret is not null").withColumn("k", F.row_number().over(S.W) - 1)
    ret = ret.withColumn("rv", F.when(F.col("k") >= 21, F.avg(F.col("ret") * F.col("ret")).over(S.W.rowsBetween(-21, -1)))).withColumn("m", F.trunc("date", "MM"))
    month = Window.partitionBy("symbol", "m").orderBy("date")
    starts = ret.withColumn("_s", F.row_number().over(month)).where("_s = 1")
    past = S.W.rowsBetween(Window.unboundedPreceding, -1)
    med, seen = F.percentile("rv", 0.5).over(past), F.count("rv").over(past)
    w = F.when(F.col("rv").isNotNull() & (seen >= 12), F.greatest(F.lit(0.0), F.least(F.lit(1.0), X.over(med, F.col("rv"))))).otherwise(1.0)
    held = ret.join(starts.select("symbol", "m", w.alias("w"), F.col("rv").alias("rv0")), ["symbol", "m"]).where((F.col("k") >= burn) & F.col("rv0").isNotNull())
    cash = A.asof(held.select("symbol", "date", "ret", "w", "m").withColumn("one", F.lit(1)), bills.withColumn("one", F.lit(1)), F.col("date"), "day", ["level"], ["one"], strict=F.lit(True))
    return cash.select("symbol", "date", "m", "ret", "w", F.coalesce(F.greatest(F.col("level"), F.lit(0.0)) / 100 / 252, F.lit(0.0)).alias("rf"))


_MANAGED = """
q0 AS (SELECT symbol, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret, date_trunc('month', date)::DATE AS m FROM s),
q1 AS (SELECT *, row_number() OVER w - 1 AS k, CASE WHEN row_number() OVER w > 21 THEN avg(ret * ret) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING) END AS rv FROM q0 WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY date)),
q2 AS (SELECT * FROM q1 QUALIFY row_number() OVER (PARTITION BY symbol, m ORDER BY date) = 1),
q3 AS (SELECT symbol, m, rv, CASE WHEN rv IS NOT NULL AND count(rv) OVER p >= 12 THEN greatest(0, least(1, median(rv) OVER p / rv)) ELSE 1 END AS w FROM q2 WINDOW p AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
mg AS MATERIALIZED (SELECT q1.symbol, q1.date, q1.m, ret, w, coalesce(greatest(level, 0) / 100 / 252, 0) AS rf FROM q1 JOIN q3 ON q3.symbol = q1.symbol AND q3.m = q1.m AND q3.rv IS NOT NULL ASOF LEFT JOIN bill ON bill.day < q1.date WHERE k >= 252),
mm AS MATERIALIZED (SELECT symbol, m, product(1 + w * ret + (1 - w) * rf) - product(1 + rf) AS y, product(1 + ret) - product(1 + rf) AS x FROM mg GROUP BY ALL),
bb AS (SELECT symbol, covar_pop(y, x) / nullif(var_pop(x), 0) AS beta FROM mm GROUP BY symbol),
zz AS MATERIALIZED (SELECT mm.symbol, m, y - beta * x AS z FROM mm JOIN bb USING (symbol))"""


@query("vol_managed", O.sql(O.BARS, _BILL, _MANAGED, _nw_sql("zz", "z", 3, order="m", by="symbol"), body="""
SELECT g AS symbol, n, CASE WHEN n >= 24 THEN round(beta, 5) END AS beta, CASE WHEN n >= 24 THEN round(mean * 12, 5) END AS alpha, CASE WHEN n >= 24 THEN round(mean / nullif(se, 0), 4) END AS t, round(turn / (days / 252.0), 5) AS turnover, round(avg_w, 6) AS avg_weight
FROM nw JOIN bb ON g = bb.symbol JOIN (SELECT symbol, sum(abs(w - w0)) AS turn, count(*) AS days, avg(w) AS avg_w FROM (SELECT *, lag(w) OVER (PARTITION BY symbol ORDER BY date) AS w0 FROM mg) GROUP BY symbol) u ON g = u.symbol"""))
def q_vol_managed(spark, sf):
    d = vol_managed(prepared(spark, sf), bill_levels(spark, sf))
    grow = lambda x: F.product(F.lit(1.0) + x)
    mm = d.groupBy("symbol", "m").agg((grow(F.col("w") * F.col("ret") + (1 - F.col("w")) * F.col("rf")) - grow(F.col("rf"))).alias("y"), (grow(F.col("ret")) - grow(F.col("rf"))).alias("x"))
    turn = d.withColumn("_d", F.abs(F.col("w") - F.lag("w").over(S.W))).groupBy("symbol").agg((F.sum("_d") / (F.count("*") / 252.0)).alias("turnover"), F.avg("w").alias("avg_weight"))
    fit = ST.spanning(mm, "y", "x", 3, 12, ["symbol"], "m").join(turn, "symbol")
    return places(places(places(fit, 5, "beta", "alpha", "turnover"), 4, "t"), 6, "avg_weight")


# --- crash state ---------------------------------------------------------------------------------


def market_state(vol: DataFrame) -> DataFrame:
    """The state of each series at its last session, of those with at least 60: drawdown, long return, label."""
    n = F.count("*").over(Window.partitionBy("symbol"))
    x = vol.withColumn("n", n).withColumn("drawdown", S.drawdown()).withColumn("trailing", S.change(C.BEAR_LOOKBACK)).where("n >= 60")
    last = last_row(x).select("symbol", "date", "drawdown", "trailing").join(regimes(vol).select("symbol", "regime"), "symbol")
    bear, stressed, turbulent = F.coalesce(F.col("trailing") < 0, F.lit(False)), F.col("drawdown") <= C.STRESS, F.col("regime") == "turbulent"
    panic = (bear | stressed) & turbulent
    label = F.when(panic, "panic").when(stressed, "stressed").when(F.col("drawdown") <= C.CORRECTION, "correction").otherwise("calm")
    return last.select("*", bear.alias("bear"), stressed.alias("stressed"), panic.alias("panic"), label.alias("label"))


@query("market_state", O.sql(O.BARS, O.VOL, f"rg AS (SELECT symbol, CASE WHEN np < 20 THEN 'unknown' WHEN vol * sqrt(252) < 0.03 THEN 'quiet' ELSE {_LABEL} END AS regime FROM ({_PCTL.format(back=251, where='AND a.i = (SELECT max(i) FROM vol c WHERE c.symbol = a.symbol)')}))", body="""
SELECT *, (bear OR stressed) AND regime = 'turbulent' AS panic, CASE WHEN (bear OR stressed) AND regime = 'turbulent' THEN 'panic' WHEN stressed THEN 'stressed' WHEN drawdown <= -0.05 THEN 'correction' ELSE 'calm' END AS label FROM (
SELECT symbol, date, round(dd, 6) AS drawdown, round(tr, 6) AS trailing, regime, coalesce(tr < 0, false) AS bear, dd <= -0.15 AS stressed FROM (
SELECT symbol, date, close / max(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS dd, close / lag(close, 504) OVER (PARTITION BY symbol ORDER BY date) - 1 AS tr, i, count(*) OVER (PARTITION BY symbol) AS n FROM s) JOIN rg USING (symbol) WHERE i = n - 1 AND n >= 60)"""))
def q_market_state(spark, sf):
    return places(market_state(S.ewma_vol(prepared(spark, sf))), 6, "drawdown", "trailing")


def crash_evidence(bars: DataFrame, benchmark: str, h: int = 21) -> DataFrame:
    """Winners less losers by the benchmark's drawdown at the sample date, for all three buckets, empty ones too."""
    dd = bars.where(F.col("symbol") == benchmark).select("date", S.drawdown().alias("dd"))
    x = history(bars).select("symbol", "date", "mom_rank").where("mom_rank is not null").join(bars.select("symbol", "date", S.forward(h).alias("fwd")), ["symbol", "date"]).where("fwd is not null")
    k = F.greatest(F.lit(3), F.floor(F.col("n") / 3)).cast("long")
    s = spread(x, "mom_rank", ["date"], k).where("n >= 12").join(dd, "date", "left").withColumn("dd", F.coalesce("dd", F.lit(0.0)))
    bucket = F.when(F.col("dd") > C.CORRECTION, "near highs").when(F.col("dd") >= C.STRESS, "moderate").otherwise("deep")
    g = s.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg("spread").alias("mean"), F.median("spread").alias("median"), F.sum((F.col("spread") > 0).cast("int")).cast("long").alias("positive"))
    names = bars.sparkSession.createDataFrame([("near highs",), ("moderate",), ("deep",)], "bucket string")
    out = names.join(g, "bucket", "left").fillna(0, ["n", "positive"])
    return out.withColumn("conclusive", F.col("n") >= C.MIN_BUCKET)


@query("crash_buckets", O.sql(O.BARS, O.MOMENTUM, """
cal AS (SELECT date FROM s WHERE symbol = (SELECT symbol FROM bars GROUP BY symbol ORDER BY count(*) DESC, symbol LIMIT 1) AND i >= 273 AND (i - 273) % 21 = 0),
hi AS (SELECT symbol, date, round((b + 0.5::DOUBLE * (t - 1)) / (n - 1), 3) AS rk FROM (SELECT *, rank() OVER (PARTITION BY date ORDER BY mom_12_1) - 1 AS b, count(*) OVER (PARTITION BY date, mom_12_1) AS t, count(*) OVER (PARTITION BY date) AS n FROM mom JOIN cal USING (date) WHERE i >= 273 AND mom_12_1 IS NOT NULL) WHERE n >= 2),
fw AS (SELECT symbol, date, lead(close, 21) OVER (PARTITION BY symbol ORDER BY date) / close - 1 AS fwd, CASE WHEN symbol = 'Brand#11' THEN close / max(close) OVER (PARTITION BY symbol ORDER BY date) - 1 END AS dd FROM s),
o AS (SELECT hi.symbol, hi.date, fwd, row_number() OVER (PARTITION BY date ORDER BY rk, symbol) AS rn, count(*) OVER (PARTITION BY date) AS n FROM hi JOIN fw USING (symbol, date) WHERE fwd IS NOT NULL),
x AS (SELECT date, avg(fwd) FILTER (rn > n - greatest(3, n // 3)) - avg(fwd) FILTER (rn <= greatest(3, n // 3)) AS sp FROM o WHERE n >= 12 GROUP BY date),
y AS (SELECT sp, CASE WHEN coalesce(dd, 0) > -0.05 THEN 'near highs' WHEN coalesce(dd, 0) >= -0.15 THEN 'moderate' ELSE 'deep' END AS bucket FROM x LEFT JOIN (SELECT date, dd FROM fw WHERE dd IS NOT NULL) USING (date))""", body="""
SELECT t.bucket, count(sp) AS n, round(avg(sp), 6) AS mean, round(median(sp), 6) AS median, count(*) FILTER (sp > 0) AS positive, count(sp) >= 25 AS conclusive FROM (VALUES ('near highs'), ('moderate'), ('deep')) t(bucket) LEFT JOIN y USING (bucket) GROUP BY t.bucket"""))
def crash_buckets(spark, sf):
    return places(crash_evidence(prepared(spark, sf), "Brand#11"), 6, "mean", "median")


# --- covariance and the book ---------------------------------------------------------------------


def ewma_cov(bars: DataFrame, symbols: list[str]) -> DataFrame:
    """a, b, cov: exponentially weighted covariance of simple returns over the symbols' common sessions, seeded by the sample
    covariance of the first 60. Few symbols; pairs are rows joined by date."""
    ret = bars.where(F.col("symbol").isin(symbols)).withColumn("ret", S.change(1)).where("ret is not null").select("symbol", "date", "ret")
    common = ret.withColumn("_n", F.count("*").over(Window.partitionBy("date"))).where(F.col("_n") == len(symbols)).drop("_n")
    pair = common.select(F.col("symbol").alias("a"), "date", F.col("ret").alias("x")).join(common.select(F.col("symbol").alias("b"), "date", F.col("ret").alias("y")), "date").where("a <= b")
    w = Window.partitionBy("a", "b").orderBy("date")
    pair = pair.withColumn("k", F.row_number().over(w) - 1).withColumn("xy", F.col("x") * F.col("y"))
    first = F.when(F.col("k") < C.SEED_OBS, F.col("x")), F.when(F.col("k") < C.SEED_OBS, F.col("y"))
    g = Window.partitionBy("a", "b")
    pair = pair.withColumn("seed", F.covar_samp(*first).over(g)).withColumn("n", F.count("*").over(g)).where(F.col("n") > C.SEED_OBS)
    age = F.col("n") - 1 - F.col("k")  # the last value of the recursion, each term with its final weight
    term = F.when(F.col("k") == C.SEED_OBS - 1, F.pow(F.lit(C.LAMBDA), age) * F.col("seed")).when(F.col("k") >= C.SEED_OBS, (1 - C.LAMBDA) * F.pow(F.lit(C.LAMBDA), age) * F.col("xy"))
    return pair.groupBy("a", "b").agg(F.sum(term).alias("cov"))


_COV = """
cr AS MATERIALIZED (SELECT symbol, date, ret FROM (SELECT symbol, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM s WHERE symbol IN ('Brand#11', 'Brand#12', 'Brand#13')) WHERE ret IS NOT NULL QUALIFY count(*) OVER (PARTITION BY date) = 3),
cp AS MATERIALIZED (SELECT x.symbol AS a, y.symbol AS b, row_number() OVER (PARTITION BY x.symbol, y.symbol ORDER BY date) - 1 AS k, x.ret AS x, y.ret AS y FROM cr x JOIN cr y USING (date) WHERE x.symbol <= y.symbol),
cg AS MATERIALIZED (WITH RECURSIVE go(a, b, k, c) AS (SELECT a, b, 59, covar_samp(x, y) FROM cp WHERE k < 60 GROUP BY a, b HAVING count(*) = 60 UNION ALL SELECT cp.a, cp.b, cp.k::INT, 0.94::DOUBLE * c + (1 - 0.94::DOUBLE) * x * y FROM go JOIN cp ON cp.a = go.a AND cp.b = go.b AND cp.k = go.k + 1) SELECT a, b, arg_max(c, k) AS cov, max(k) AS k FROM go GROUP BY ALL HAVING max(k) >= 60)"""


@query("ewma_cov", O.sql(O.BARS, _COV, body="SELECT a, b, round(cov, 6) AS cov FROM cg"))
def q_ewma_cov(spark, sf):
    return places(ewma_cov(prepared(spark, sf), ["Brand#11", "Brand#12", "Brand#13"]), 6, "cov")


def book_band(cov: DataFrame, weights: dict[str, float], h: int, amps: dict[str, float]) -> DataFrame:
    """Half-width of a book over ``h`` sessions; event sessions count with the square of their size, on the diagonal only."""
    w = cov.sparkSession.createDataFrame([(s, x, amps.get(s)) for s, x in weights.items()], "s string, w double, amp double")
    full = cov.unionByName(cov.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "cov"))
    j = full.join(F.broadcast(w.select(F.col("s").alias("a"), F.col("w").alias("wa"), "amp")), "a").join(F.broadcast(w.select(F.col("s").alias("b"), F.col("w").alias("wb"))), "b")
    sessions = F.when((F.col("a") == F.col("b")) & F.col("amp").isNotNull(), h - 1 + F.col("amp") * F.col("amp")).otherwise(float(h))
    return j.agg((C.GAUSSIAN_80 * F.sqrt(F.greatest(F.sum(F.col("wa") * F.col("wb") * F.col("cov") * sessions), F.lit(0.0)))).alias("band"))


@query("book_band", O.sql(O.BARS, _COV, body="""
SELECT round(1.2816::DOUBLE * sqrt(sum(wa * wb * cov * CASE WHEN x.a = 'Brand#12' AND x.b = 'Brand#12' THEN 4 + 9 ELSE 5 END)), 6) AS band FROM (SELECT a, b, cov FROM cg UNION ALL SELECT b, a, cov FROM cg WHERE a <> b) x
JOIN (VALUES ('Brand#11', 0.5::DOUBLE), ('Brand#12', 0.3::DOUBLE), ('Brand#13', 0.2::DOUBLE)) p(a, wa) ON p.a = x.a JOIN (VALUES ('Brand#11', 0.5::DOUBLE), ('Brand#12', 0.3::DOUBLE), ('Brand#13', 0.2::DOUBLE)) q(b, wb) ON q.b = x.b"""))
def q_book_band(spark, sf):
    cov = ewma_cov(prepared(spark, sf), ["Brand#11", "Brand#12", "Brand#13"])
    return places(book_band(cov, {"Brand#11": 0.5, "Brand#12": 0.3, "Brand#13": 0.2}, 5, {"Brand#12": 3.0}), 6, "band")
