"""Batteries of study cells, each run in one pass over exploded cells; crash assessment; days and movers of the macro calendar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright import constants as C
from tapewright.functions import scalars as X
from tapewright.operators import series as S
from tapewright.operators import stats as ST
from tapewright.plans import cross_queries as Q
from tapewright.plans import event_queries as E
from tapewright.plans import oracle as O
from tapewright.plans import study_queries as Y
from tapewright.plans.series_queries import prepared
from tapewright.sources import tables as T
from tapewright.sources.files import pinned_dates

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def in_cells(ev: DataFrame, rows: Sequence[tuple], names: Sequence[str]) -> DataFrame:
    """A row for each event and study cell, with the cell's values in columns ``names``."""
    return ev.withColumn("_cell", F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row))) for row in rows)))).select("*", "_cell.*").drop("_cell")


# --- surprises --------------------------------------------------------------------------------------

SORTS = (("terciles", 1 / 3, 2 / 3), ("deciles", 0.1, 0.9))
ENTRIES, HORIZONS = (1, 2), (5, 21, 63)
_CELL = ["sort", "entry", "horizon"]


def pead_battery(ev: DataFrame, res: DataFrame) -> DataFrame:
    """Every sort, entry lag and horizon: daily spread of the top over the bottom by surprise, its car, t, smallest effect at
    t = 2, sessions and events of both legs. Cells without a session in common have no row."""
    grid = [(name, lo, hi, e, h) for name, lo, hi in SORTS for e in ENTRIES for h in HORIZONS]
    sides = in_cells(ev, grid, ["sort", "lo", "hi", "entry", "horizon"]).where("srank >= hi or srank <= lo")
    sides = sides.withColumn("up", F.col("srank") >= F.col("hi"))
    spread = E.calendar_time(sides, res, F.col("horizon"), F.col("entry"), _CELL)
    legs = sides.groupBy(*_CELL).agg(F.count(F.when(F.col("up"), 1)).alias("n_top"), F.count(F.when(~F.col("up"), 1)).alias("n_bottom"))
    fit = ST.newey_west(spread, "spread", F.col("horizon"), _CELL).join(legs, _CELL)
    return fit.withColumn("car", F.col("mean") * F.col("horizon")).withColumn("mde", 2 * F.col("se"))


_BY_CELL = "struct_pack(sort := sort, entry := entry, horizon := horizon)"
_GRID = """
grid AS (SELECT * FROM (VALUES ('terciles', 1 / 3::DOUBLE, 2 / 3::DOUBLE), ('deciles', 0.1::DOUBLE, 0.9::DOUBLE)) a(sort, lo, hi), (VALUES (1), (2)) b(entry), (VALUES (5), (21), (63)) c(horizon)),
pu AS MATERIALIZED (SELECT symbol, i, sort, entry, horizon, srank >= hi AS up FROM pe JOIN grid ON srank >= hi OR srank <= lo),
hold AS (SELECT DISTINCT pu.symbol, sort, entry, horizon, up, rs.date, e FROM pu JOIN rs ON rs.symbol = pu.symbol AND rs.i BETWEEN pu.i + entry AND pu.i + entry + horizon - 1 AND e IS NOT NULL),
sp AS MATERIALIZED (SELECT sort, entry, horizon, date, avg(e) FILTER (up) - avg(e) FILTER (NOT up) AS spread FROM hold GROUP BY ALL HAVING count(*) FILTER (up) > 0 AND count(*) FILTER (NOT up) > 0)"""


@query("pead_battery", O.sql(O.BARS, O.ANNOUNCEMENTS, E._SURPRISE, E._PEAD, E._RES, _GRID, E._nw_sql("sp", "spread", "a.g.horizon", by=_BY_CELL), body="""
SELECT g.sort AS sort, g.entry AS entry, g.horizon AS horizon, n, round(mean, 6) AS mean, round(mean * g.horizon, 6) AS car, coalesce(round(mean / nullif(se, 0), 5), 0) AS t, round(2 * se, 6) AS mde,
  (SELECT count(*) FILTER (up) FROM pu WHERE sort = g.sort AND entry = g.entry AND horizon = g.horizon) AS n_top, (SELECT count(*) FILTER (NOT up) FROM pu WHERE sort = g.sort AND entry = g.entry AND horizon = g.horizon) AS n_bottom FROM nw"""))
def q_pead_battery(spark, sf):
    b = prepared(spark, sf)
    got = pead_battery(E.pead_events(E.surprises(T.announcements(spark, sf)), b, 8), E.residuals(b, E.market(b)))
    return E.places(E.places(got, 6, "mean", "car", "mde"), 5, "t").drop("se")


# --- filings ----------------------------------------------------------------------------------------

#: Sessions of a filing's effect: first session after the filing's, and how many.
WINDOWS = (("day 0", 0, 1), ("day 1", 1, 1), ("days 2-21", 2, 20), ("days 2-63", 2, 62))


def insider_split(ev: DataFrame, res: DataFrame, least: int) -> DataFrame:
    """Disclosure against drift: each window of each side, less the mean of the universe. Legs under 60 sessions have no row."""
    return E.leg_alpha(in_cells(ev, WINDOWS, ["span", "entry", "horizon"]), res, F.col("horizon"), least, F.col("entry"), ["side", "span", "entry", "horizon"])


def insider_cells(ev: DataFrame, res: DataFrame, h: int, least: int) -> DataFrame:
    """Purchases (all, not planned, clustered) and sales, less the mean of the universe."""
    member = {"purchases": F.col("side") == "P", "discretionary": (F.col("side") == "P") & ~F.col("plan"), "clustered": F.col("cluster"), "sales": F.col("side") == "S"}
    long = ev.withColumn("cell", F.explode(F.array_compact(F.array(*(F.when(c, n) for n, c in member.items())))))
    return E.leg_alpha(long, res, h, least, by=["cell"])


def _leg_sql(by: str, horizon: str, lags: str) -> str:
    """Excess of each leg over the universe by date (lx), its breadth (br) and its Newey-West fit (nw); legs come from ``lg``."""
    return f"""
ho AS (SELECT DISTINCT lg.symbol, c, rs.date, e FROM lg JOIN rs ON rs.symbol = lg.symbol AND rs.i BETWEEN lg.i + entry AND lg.i + entry + {horizon} - 1 AND e IS NOT NULL),
base AS (SELECT date, avg(e) AS a FROM rs WHERE e IS NOT NULL GROUP BY date HAVING count(*) >= 10),
lx AS MATERIALIZED (SELECT c, date, leg - a AS x, breadth FROM (SELECT c, date, avg(e) AS leg, count(*) AS breadth FROM ho GROUP BY ALL) JOIN base USING (date)),
br AS (SELECT c, avg(breadth) AS breadth FROM lx GROUP BY c),
""" + E._nw_sql("lx", "x", lags, by=by)


_FIT = "n, round(mean, 6) AS mean, round(se, 6) AS se, coalesce(round(mean / nullif(se, 0), 5), 0) AS t, round(breadth, 6) AS breadth, round(mean * {h}, 6) AS car FROM nw JOIN br ON br.c = g WHERE n >= 60"


@query("insider_split", O.sql(O.BARS, O.FILINGS, E._ANCHOR, E._RES, """
lg AS MATERIALIZED (SELECT ev.symbol, ev.i, struct_pack(side := side, span := span, entry := entry, horizon := horizon) AS c, entry, horizon FROM ev, (VALUES ('day 0', 0, 1), ('day 1', 1, 1), ('days 2-21', 2, 20), ('days 2-63', 2, 62)) t(span, entry, horizon))""",
    _leg_sql("c", "horizon", "a.g.horizon").strip(), body="SELECT g.side AS side, g.span AS span, g.entry AS entry, g.horizon AS horizon, " + _FIT.format(h="g.horizon")))
def q_insider_split(spark, sf):
    b = prepared(spark, sf)
    got = insider_split(E.anchored(T.filings(spark, sf), b), E.residuals(b, E.market(b)), 10)
    return E.places(E.places(got, 6, "mean", "se", "breadth", "car"), 5, "t")


@query("insider_cells", O.sql(O.BARS, O.FILINGS, E._ANCHOR, E._RES, """
lg AS MATERIALIZED (SELECT symbol, i, 'purchases' AS c, 1 AS entry FROM ev WHERE side = 'P' UNION ALL SELECT symbol, i, 'discretionary', 1 FROM ev WHERE side = 'P' AND NOT plan
  UNION ALL SELECT symbol, i, 'clustered', 1 FROM ev WHERE cluster UNION ALL SELECT symbol, i, 'sales', 1 FROM ev WHERE side = 'S')""", _leg_sql("c", "21", "21").strip(), body="SELECT g AS cell, " + _FIT.format(h="21")))
def q_insider_cells(spark, sf):
    b = prepared(spark, sf)
    got = insider_cells(E.anchored(T.filings(spark, sf), b), E.residuals(b, E.market(b)), 21, 10)
    return E.places(E.places(got, 6, "mean", "se", "breadth", "car"), 5, "t")


# --- crash assessment -------------------------------------------------------------------------------


def assess(state: DataFrame, tilt: DataFrame, buckets: DataFrame) -> DataFrame:
    """``state`` (a row a benchmark) with the book's momentum tilt, its exposure and the verdict on the local evidence.

    Elevated: panic and a tilt of at least 0.6; moderate: one of them; low: neither; unknown: no state. ``tilt`` and
    ``buckets`` are a row and three rows.
    """
    deep = buckets.agg(F.coalesce(F.max(F.when(F.col("bucket") == "deep", F.col("n"))), F.lit(0)).alias("deep_n"))
    x = state.crossJoin(F.broadcast(tilt)).crossJoin(F.broadcast(deep))
    tilted, against = F.coalesce(F.col("tilt") >= 0.6, F.lit(False)), F.coalesce(F.col("tilt") <= 0.4, F.lit(False))
    exposure = F.when(F.col("panic").isNull(), "unknown").when(F.col("panic") & tilted, "elevated").when(F.col("panic") | tilted, "moderate").otherwise("low")
    return x.select(
        *state.columns, "tilt", exposure.alias("exposure"), (F.coalesce("panic", F.lit(False)) & against).alias("rebound_note"), "deep_n",
        F.when(F.col("deep_n") >= C.MIN_BUCKET, "measured").otherwise("insufficient sample").alias("verdict"),
    )


@query("crash_assessment", f"""
SELECT b.symbol, label, panic, tilt, CASE WHEN panic IS NULL THEN 'unknown' WHEN panic AND coalesce(tilt >= 0.6, false) THEN 'elevated' WHEN panic OR coalesce(tilt >= 0.6, false) THEN 'moderate' ELSE 'low' END AS exposure,
  coalesce(panic, false) AND coalesce(tilt <= 0.4, false) AS rebound_note, deep_n, CASE WHEN deep_n >= 25 THEN 'measured' ELSE 'insufficient sample' END AS verdict
FROM (SELECT DISTINCT p_brand AS symbol FROM part) b LEFT JOIN ({E.SQL["market_state"]}) m ON m.symbol = b.symbol, (SELECT mom_rank_tilt AS tilt FROM ({Q.SQL["portfolio_tilts"]})), (SELECT n AS deep_n FROM ({E.SQL["crash_buckets"]}) WHERE bucket = 'deep')""")
def crash_assessment(spark, sf):
    """Every brand as the benchmark whose state is joined with the tilt of the book."""
    b = prepared(spark, sf)
    state = T.table(spark, sf, "part").select(F.col("p_brand").alias("symbol")).distinct().join(E.market_state(S.ewma_vol(b)).select("symbol", "label", "panic"), "symbol", "left")
    tilt = Q.portfolio_tilts(T.holdings(spark, sf), Q.factor_views(b, T.fundamentals(spark, sf))).select(F.round("mom_rank_tilt", 6).alias("tilt"))
    return assess(state, tilt, E.crash_evidence(b, "Brand#11"))


# --- macro calendar ---------------------------------------------------------------------------------


def upcoming_macro(spark, today: str, days: int) -> DataFrame:
    """date, kind, days_until of the pinned meetings and first Fridays from ``today`` over ``days`` days. ``complete`` is false
    where the pinned calendar ends before that, so that a missing meeting isn't taken for none."""
    first, last = F.lit(today).cast("date"), F.date_add(F.lit(today).cast("date"), days)
    meetings = pinned_dates(spark).select("date")
    months = spark.range(1).select(F.explode(F.sequence(F.trunc(first, "MM"), last, F.expr("interval 1 month"))).alias("m"))
    both = meetings.select("date", F.lit("meeting").alias("kind")).unionByName(months.select(X.first_friday(F.col("m")).alias("date"), F.lit("payroll").alias("kind")))
    complete = meetings.agg((F.max("date") >= last).alias("complete"))
    return both.where(F.col("date").between(first, last)).select("date", "kind", F.datediff("date", first).cast("long").alias("days_until")).crossJoin(F.broadcast(complete))


@query("upcoming_macro", "SELECT date, kind, date_diff('day', DATE '2027-11-20', date) AS days_until, (SELECT max(d) FROM (VALUES " + ", ".join(f"(DATE '{d}')" for d in C.MEETINGS) + ") v(d)) >= DATE '2028-02-18' AS complete FROM (SELECT d AS date, 'meeting' AS kind FROM (VALUES " + ", ".join(f"(DATE '{d}')" for d in C.MEETINGS) + ") v(d) UNION ALL SELECT DATE '2027-11-01' + k::INT, 'payroll' FROM range(0, 130) r(k) WHERE isodow(DATE '2027-11-01' + k::INT) = 5 AND day(DATE '2027-11-01' + k::INT) <= 7) WHERE date BETWEEN DATE '2027-11-20' AND DATE '2028-02-18'")
def q_upcoming_macro(spark, sf):
    return upcoming_macro(spark, "2027-11-20", 90)


def macro_movers(bars: DataFrame, meetings: DataFrame, ann: DataFrame) -> DataFrame:
    """symbol, kind, n, typical and ordinary move, their ratio, the largest, and whether the ratio is notable: sessions of
    meetings, payrolls and both against all others, announcement reactions left out. At least 6 events and 60 others."""
    skip = E.reactions(ann, bars).select("symbol", "date").where("date is not null").distinct()
    m = bars.withColumn("move", F.abs(S.change(1))).where("move is not null").select("symbol", "date", "move").join(skip, ["symbol", "date"], "left_anti")
    m = m.join(F.broadcast(meetings.select("date").distinct().withColumn("on", F.lit(True))), "date", "left").withColumn("on", F.coalesce("on", F.lit(False)))
    pay = F.col("date") == X.first_friday(F.col("date"))
    kinds = {"meeting": F.col("on"), "payroll": pay, "macro": F.col("on") | pay}
    long = m.select("symbol", "move", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("event")) for k, c in kinds.items()))).alias("x")).select("symbol", "move", "x.*")
    on, off = F.when(F.col("event"), F.col("move")), F.when(~F.col("event"), F.col("move"))
    g = long.groupBy("symbol", "kind").agg(F.count(on).alias("n"), F.count(off).alias("_others"), F.median(on).alias("typical"), F.median(off).alias("ordinary"), F.max(on).alias("largest"))
    g = g.where("n >= 6 and _others >= 60 and ordinary > 0").drop("_others").withColumn("amplification", F.col("typical") / F.col("ordinary"))
    return g.withColumn("notable", F.col("amplification") >= 1.15)


@query("macro_movers", O.sql(O.BARS, O.ANNOUNCEMENTS, E._REACT, Y._MEET.strip().split("\n")[0].rstrip(","), """
mw AS (SELECT symbol, date, abs(close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1) AS move FROM s),
mx AS MATERIALIZED (SELECT symbol, move, date IN (SELECT date FROM me) AS ev, isodow(date) = 5 AND day(date) <= 7 AS pay FROM mw WHERE move IS NOT NULL AND NOT EXISTS (SELECT 1 FROM re WHERE re.symbol = mw.symbol AND re.date = mw.date)),
mk AS (SELECT symbol, move, 'meeting' AS kind, ev AS e FROM mx UNION ALL SELECT symbol, move, 'payroll', pay FROM mx UNION ALL SELECT symbol, move, 'macro', ev OR pay FROM mx)""", body="""
SELECT symbol, kind, n, round(typical, 6) AS typical, round(ordinary, 6) AS ordinary, round(largest, 6) AS largest, round(typical / ordinary, 6) AS amplification, typical / ordinary >= 1.15 AS notable FROM (
SELECT symbol, kind, count(*) FILTER (e) AS n, count(*) FILTER (NOT e) AS o, median(move) FILTER (e) AS typical, median(move) FILTER (NOT e) AS ordinary, max(move) FILTER (e) AS largest FROM mk GROUP BY symbol, kind) WHERE n >= 6 AND o >= 60 AND ordinary > 0"""))
def q_macro_movers(spark, sf):
    b = prepared(spark, sf)
    return E.places(macro_movers(b, Y.third_wednesdays(b), T.announcements(spark, sf)), 6, "typical", "ordinary", "largest", "amplification")
