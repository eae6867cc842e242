"""Payload series, event, regime and book claims with their grades, performance, meeting days, labels and search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewright import constants as C
from tapewright.functions import scalars as X
from tapewright.operators import series as S
from tapewright.operators import stats as ST
from tapewright.plans import cross_queries as Q
from tapewright.plans import event_queries as E
from tapewright.plans import oracle as O
from tapewright.plans import registry_queries as G
from tapewright.plans.series_queries import SQL as S_SQL
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


# --- payload --------------------------------------------------------------------------------------

#: The series of a symbol's payload, with their decimals (None: as they are).
SERIES = {"close": None, "sma20": 4, "sma50": 4, "sma200": 4, "lower": 3, "middle": 3, "upper": 3, "ema12": 4, "ema26": 4, "rsi": 6, "macd": 4, "macd_signal": 4, "macd_hist": 4, "atr": 4, "rvol": 6, "vwap": 3, "dollar_volume": None, "obv": None, "ad_line": 4, "up_down": 6, "volume_trend": 6}


def with_series(bars: DataFrame) -> DataFrame:
    """Every indicator and volume series of each session; all windows by symbol share one sort."""
    df = S.atr(S.macd(S.rsi(bars)))
    for n in (12, 26):
        if f"ema{n}" not in df.columns:
            df = S.ema(df, n)
    low, mid, up = S.bollinger()
    df = df.withColumn("_o", S.obv()).withColumn("_a", S.ad_step())
    return df.withColumns({
        **{f"sma{n}": S.sma(n) for n in (20, 50, 200)}, "lower": low, "middle": mid, "upper": up, "rvol": S.rvol(), "vwap": S.vwap(), "dollar_volume": F.col("close") * F.col("volume"),
        "obv": S.running("_o"), "ad_line": S.running("_a"), "up_down": S.up_down_ratio(), "volume_trend": S.volume_trend(),
    })


def payload(bars: DataFrame) -> DataFrame:
    """symbol, bars: an array of one struct a session in date order, with all series rounded for the wire."""
    x = F.struct("date", *(F.col(c) if p is None else F.round(c, p).alias(c) for c, p in SERIES.items()))
    return with_series(bars).groupBy("symbol").agg(F.array_sort(F.collect_list(x)).alias("bars"))


_PARTS = {"sma": ["sma50", "sma200"], "bollinger": ["lower", "middle", "upper"], "ema": ["ema12", "ema26"], "rsi": ["rsi"], "macd": ["macd", "macd_signal", "macd_hist"], "atr": ["atr"], "volume_analytics": ["rvol", "vwap", "up_down"], "divergence": ["volume_trend"]}


@query("payload_series", "SELECT b.*, " + ", ".join(f"{k}.{c}" for k, cols in _PARTS.items() for c in cols) + ", volume_analytics.dollar_volume, volume_analytics.obv, volume_analytics.ad_line FROM ("
    + O.sql(O.BARS, body="SELECT symbol, date, row_number() OVER w AS session, close, CASE WHEN i >= 19 THEN round(avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING), 4) END AS sma20 FROM s WINDOW w AS (PARTITION BY symbol ORDER BY date)") + ") b "
    + " ".join(f"JOIN ({S_SQL[k]}) {k} USING (symbol, date)" for k in _PARTS))
def payload_series(spark, sf):
    """The payload's arrays, a row an element."""
    return payload(prepared(spark, sf)).select("symbol", F.posexplode("bars").alias("k", "x")).select("symbol", (F.col("k") + 1).cast("long").alias("session"), "x.*")


# --- claims of events, regimes and books, and their grades ------------------------------------------

LEAST_BARS = 320
LOOKAHEAD = 10


def eligible(bars: DataFrame, as_of: str, least: int = LEAST_BARS) -> DataFrame:
    """The sessions up to ``as_of`` of symbols that have at least ``least`` of them and a bar on that day."""
    past = bars.where(F.col("date") <= F.lit(as_of).cast("date"))
    by = Window.partitionBy("symbol")
    return past.withColumn("_n", F.count("*").over(by)).withColumn("_last", F.max("date").over(by)).where((F.col("_n") >= least) & (F.col("_last") == F.lit(as_of).cast("date"))).drop("_last")


def claim_id(kind: str, symbol: Column, as_of: str, horizon: int, *more: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), symbol, F.lit(as_of), F.lit(str(horizon)), *more)


def event_claims(ann: DataFrame, past: DataFrame, as_of: str, ahead: int = LOOKAHEAD, least: int = 4) -> DataFrame:
    """A claim on the size of each announced reaction within the next ``ahead`` weekdays, of symbols with enough past ones.

    The session is the first weekday at or, after the close, past the announced day.
    """
    sizes = E.reaction_sizes(ann, past).where(F.col("n_events") >= least)
    window = X.future_weekdays(F.lit(as_of).cast("date"), ahead)
    when = E.stamped(ann).join(sizes, "symbol").withColumn("session", F.try_element_at(F.filter(window, lambda d: F.when(F.col("late"), d > F.col("day")).otherwise(d >= F.col("day"))), F.lit(1)))
    when = when.where((F.col("session").isNotNull()) & (F.col("day") >= F.lit(as_of).cast("date")) & (F.col("late") | (F.col("day") > F.lit(as_of).cast("date"))))
    return when.select(claim_id("event", F.col("symbol"), as_of, 0, F.col("day").cast("string")).alias("id"), F.lit("event").alias("kind"), "symbol", "session", F.col("median_move").alias("typical_move"), "amplification", F.col("baseline").alias("baseline_move"), "n_events")


def grade_events(claims: DataFrame, bars: DataFrame) -> DataFrame:
    """The move of the first session at or after the one claimed, against the typical and the ordinary one."""
    moved = bars.select("symbol", "date", S.change(1).alias("ret")).where("ret is not null")
    at = claims.join(moved, "symbol").where(F.col("date") >= F.col("session")).groupBy("id", "kind", "typical_move", "baseline_move").agg(F.abs(F.min_by("ret", "date")).alias("realized"))
    return at.select("id", "kind", "realized", F.when(F.col("typical_move") > 0, F.col("realized") / F.col("typical_move")).alias("ratio"), (F.col("realized") > F.col("baseline_move")).alias("beat"))


def regime_claims(past: DataFrame, as_of: str, h: int = C.WEEK) -> DataFrame:
    """Quiet and turbulent symbols with the median move of their last year; issued only where validation confirms the label."""
    vol = S.ewma_vol(past.drop("_n"))
    n = F.count("*").over(Window.partitionBy("symbol"))
    moves = past.withColumn("n", n).withColumn("move", F.abs(S.forward(h))).where((F.col("i") >= F.col("n") - h - C.YEAR) & F.col("move").isNotNull()).groupBy("symbol").agg(F.median("move").alias("baseline_abs"))
    last = past.where(F.col("date") == F.lit(as_of).cast("date")).select("symbol", "i", "close")
    both = E.regimes(vol).where("regime in ('quiet', 'turbulent')").join(E.regime_validation(vol, h).select("symbol", "verdict", "separation"), "symbol", "left").join(moves, "symbol").join(last, "symbol")
    issued = F.coalesce(F.col("verdict") == "confirmed", F.lit(False))
    return both.select(claim_id("regime", F.col("symbol"), as_of, h).alias("id"), F.lit("regime").alias("kind"), "symbol", "i", "close", F.col("regime").alias("label"), F.coalesce("separation", F.lit(0.0)).alias("separation"), "baseline_abs", (F.col("regime") == "turbulent").alias("predict_exceed"), issued.alias("issued"))


def grade_regimes(claims: DataFrame, bars: DataFrame, h: int = C.WEEK) -> DataFrame:
    """Whether the move over the horizon exceeded the baseline, and whether that was claimed. Claims not matured are left out."""
    later = bars.select("symbol", (F.col("i") - h).alias("i"), F.col("close").alias("then"))
    j = claims.join(later, ["symbol", "i"]).withColumn("realized", F.abs(F.col("then") / F.nullif("close", F.lit(0.0)) - 1)).withColumn("exceeded", F.col("realized") > F.col("baseline_abs"))
    return j.where("realized is not null").select("id", "kind", "realized", "exceeded", (F.col("exceeded") == F.col("predict_exceed")).alias("correct"))


def book_claim(past: DataFrame, weights: dict[str, float], amps: dict[str, float], as_of: str, h: int = C.WEEK) -> DataFrame:
    """One claim: the band of a book over the horizon; of a few names given by the caller."""
    band = E.book_band(E.ewma_cov(past, sorted(weights)), weights, h, amps)
    return band.select(claim_id("book", F.lit("BOOK"), as_of, h).alias("id"), F.lit("book").alias("kind"), F.col("band").alias("pct"), F.lit(",".join(sorted(amps))).alias("event_names"))


def grade_book(claim: DataFrame, bars: DataFrame, weights: dict[str, float], as_of: str, h: int = C.WEEK) -> DataFrame:
    """Weighted simple returns over the horizon against the band; cash earns nothing; no grade until every name has its close."""
    base = bars.where((F.col("date") == F.lit(as_of).cast("date")) & F.col("symbol").isin(sorted(weights))).select("symbol", (F.col("i") + h).alias("i"), F.col("close").alias("then"))
    w = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    ret = base.join(bars.select("symbol", "i", "close"), ["symbol", "i"]).agg(F.sum(w[F.col("symbol")] * (F.col("close") / F.col("then") - 1)).alias("realized"), F.count("*").alias("n"))
    return claim.crossJoin(F.broadcast(ret)).where(F.col("n") == len(weights)).select("id", "kind", "realized", (F.abs("realized") <= F.col("pct")).alias("hit"))


AS_OF = "1997-06-30"
AHEAD = 65
BOOK = {"Brand#11": 0.5, "Brand#12": 0.3, "Brand#13": 0.2}
#: Sessions up to the day of the claims, of symbols that may claim.
_PAST = f"""
sp AS MATERIALIZED (SELECT * EXCLUDE (n, l) FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n, max(date) OVER (PARTITION BY symbol) AS l FROM s WHERE date <= DATE '{AS_OF}') WHERE n >= {LEAST_BARS} AND l = DATE '{AS_OF}')"""
_EVENTS = f"""
sz AS (SELECT symbol, count(*) FILTER (event) AS n_events, median(move) FILTER (event) AS typical, median(move) FILTER (NOT event) AS baseline, count(*) FILTER (NOT event) AS o FROM mv WHERE move IS NOT NULL GROUP BY symbol),
wd AS (SELECT DATE '{AS_OF}' + k::INT AS d, row_number() OVER (ORDER BY k) AS nth FROM range(1, 2 * {AHEAD} + 5) t(k) WHERE isodow(DATE '{AS_OF}' + k::INT) < 6),
ec AS MATERIALIZED (SELECT 'event:' || symbol || ':{AS_OF}:0:' || day AS id, symbol, typical, baseline, n_events, (SELECT min(d) FROM wd WHERE nth <= {AHEAD} AND CASE WHEN late THEN d > day ELSE d >= day END) AS session
  FROM ann JOIN sz USING (symbol) WHERE n_events >= 4 AND o >= 30 AND baseline > 0 AND (day > DATE '{AS_OF}' OR (day = DATE '{AS_OF}' AND late))),
ev AS MATERIALIZED (SELECT * FROM ec WHERE session IS NOT NULL)"""
_RE_PAST = "re AS MATERIALIZED (SELECT symbol, stamp, day, CASE WHEN late THEN (SELECT min(date) FROM sp WHERE sp.symbol = ann.symbol AND i >= 1 AND date > day) ELSE (SELECT min(date) FROM sp WHERE sp.symbol = ann.symbol AND i >= 1 AND date >= day) END AS date FROM ann)"
_MV_PAST = "mv AS MATERIALIZED (SELECT x.symbol, x.date, x.i, abs(x.close / lag(x.close) OVER (PARTITION BY x.symbol ORDER BY x.date) - 1) AS move, (x.symbol, x.date) IN (SELECT (symbol, date) FROM re WHERE date IS NOT NULL) AS event FROM sp x)"


@query("claims_event", O.sql(O.BARS, O.ANNOUNCEMENTS, _PAST, _RE_PAST, _MV_PAST, _EVENTS, body="SELECT id, symbol, session, round(typical, 6) AS typical_move, round(typical / baseline, 6) AS amplification, round(baseline, 6) AS baseline_move, n_events FROM ev"))
def claims_event(spark, sf):
    c = event_claims(T.announcements(spark, sf), eligible(prepared(spark, sf), AS_OF), AS_OF, AHEAD)
    return E.places(c.drop("kind"), 6, "typical_move", "amplification", "baseline_move")


_EVENT_GRADES = "eg AS (SELECT id, abs(arg_min(ret, date)) AS realized, typical, baseline FROM ev JOIN (SELECT symbol, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM s) x USING (symbol) WHERE ret IS NOT NULL AND x.date >= session GROUP BY id, typical, baseline)"


@query("grades_event", O.sql(O.BARS, O.ANNOUNCEMENTS, _PAST, _RE_PAST, _MV_PAST, _EVENTS, _EVENT_GRADES, body="SELECT id, round(realized, 6) AS realized, round(CASE WHEN typical > 0 THEN realized / typical END, 5) AS ratio, realized > baseline AS beat FROM eg"))
def grades_event(spark, sf):
    b = prepared(spark, sf)
    g = grade_events(event_claims(T.announcements(spark, sf), eligible(b, AS_OF), AS_OF, AHEAD), b)
    return E.places(E.places(g.drop("kind"), 6, "realized"), 5, "ratio")


_VOL_PAST = O.VOL.replace("vol AS MATERIALIZED", "volp AS MATERIALIZED").replace("FROM s WHERE", "FROM sp s WHERE").replace("FROM go JOIN s ON", "FROM go JOIN sp s ON").replace("FROM s LEFT JOIN", "FROM sp s LEFT JOIN")
_REGIME_CLAIMS = f"""
rl AS (SELECT symbol, CASE WHEN np < 20 THEN 'unknown' WHEN vol * sqrt(252) < 0.03 THEN 'quiet' ELSE {E._LABEL} END AS label FROM ({E._PCTL.format(back=251, where='AND a.i = (SELECT max(i) FROM volp c WHERE c.symbol = a.symbol)').replace('vol a JOIN vol b', 'volp a JOIN volp b')})),
rv AS ({{validation}}),
rb AS (SELECT symbol, median(move) AS baseline FROM (SELECT symbol, i, abs(lead(close, 5) OVER (PARTITION BY symbol ORDER BY date) / close - 1) AS move, count(*) OVER (PARTITION BY symbol) AS n FROM sp) WHERE i >= n - 257 AND move IS NOT NULL GROUP BY symbol),
rc AS MATERIALIZED (SELECT 'regime:' || symbol || ':{AS_OF}:5' AS id, symbol, i, close, label, coalesce(separation, 0) AS separation, baseline, coalesce(verdict = 'confirmed', false) AS issued FROM rl JOIN rb USING (symbol) JOIN sp USING (symbol) LEFT JOIN rv USING (symbol) WHERE date = DATE '{AS_OF}' AND label IN ('quiet', 'turbulent'))"""
_VALID = E.SQL["regime_validation"]
_VALID = "WITH pp AS" + _VALID.split("pp AS", 1)[1].replace("vol a JOIN vol b", "volp a JOIN volp b").replace("JOIN s z", "JOIN sp z")
_REGIME_CLAIMS = _REGIME_CLAIMS.replace("{validation}", _VALID)


@query("claims_regime", O.sql(O.BARS, _PAST, _VOL_PAST, _REGIME_CLAIMS, body="SELECT id, label, round(separation, 6) AS separation, round(baseline, 6) AS baseline_abs, label = 'turbulent' AS predict_exceed, issued FROM rc"))
def claims_regime(spark, sf):
    c = regime_claims(eligible(prepared(spark, sf), AS_OF), AS_OF)
    return E.places(c.drop("kind", "symbol", "i", "close"), 6, "separation", "baseline_abs")


_REGIME_GRADES = "rg AS (SELECT id, abs(z.close / rc.close - 1) AS realized, baseline, label FROM rc JOIN s z ON z.symbol = rc.symbol AND z.i = rc.i + 5)"


@query("grades_regime", O.sql(O.BARS, _PAST, _VOL_PAST, _REGIME_CLAIMS, _REGIME_GRADES, body="SELECT id, round(realized, 6) AS realized, realized > baseline AS exceeded, (realized > baseline) = (label = 'turbulent') AS correct FROM rg"))
def grades_regime(spark, sf):
    b = prepared(spark, sf)
    return E.places(grade_regimes(regime_claims(eligible(b, AS_OF), AS_OF), b).drop("kind"), 6, "realized")


_COV_PAST = E._COV.replace("FROM s WHERE symbol IN", f"FROM s WHERE date <= DATE '{AS_OF}' AND symbol IN")
_VALUES = ", ".join(f"('{s}', {w}::DOUBLE)" for s, w in BOOK.items())
_BOOK_CLAIM = f"bc AS (SELECT 'book:BOOK:{AS_OF}:5' AS id, 1.2816::DOUBLE * sqrt(greatest(sum(wa * wb * cov * CASE WHEN x.a = 'Brand#12' AND x.b = 'Brand#12' THEN 4 + 9 ELSE 5 END), 0)) AS pct FROM (SELECT a, b, cov FROM cg UNION ALL SELECT b, a, cov FROM cg WHERE a <> b) x JOIN (VALUES {_VALUES}) p(a, wa) ON p.a = x.a JOIN (VALUES {_VALUES}) q(b, wb) ON q.b = x.b)"
_BOOK_GRADE = f"bg AS (SELECT sum(wa * (z.close / x.close - 1)) AS realized, count(*) AS n FROM (VALUES {_VALUES}) p(a, wa) JOIN s x ON x.symbol = a AND x.date = (SELECT max(date) FROM s WHERE date <= DATE '{AS_OF}' AND symbol = a) JOIN s z ON z.symbol = a AND z.i = x.i + 5)"


@query("claims_book", O.sql(O.BARS, _COV_PAST, _BOOK_CLAIM, body="SELECT id, round(pct, 6) AS pct, 'Brand#12' AS event_names FROM bc"))
def claims_book(spark, sf):
    past = prepared(spark, sf).where(F.col("date") <= F.lit(AS_OF).cast("date"))
    return E.places(book_claim(past, BOOK, {"Brand#12": 3.0}, AS_OF).drop("kind"), 6, "pct")


def on_day(bars: DataFrame, as_of: str) -> DataFrame:
    """Bars with the last session up to ``as_of`` of each symbol dated on that day, as a book is valued by last closes."""
    d = F.lit(as_of).cast("date")
    last = F.max(F.when(F.col("date") <= d, F.col("date"))).over(Window.partitionBy("symbol"))
    return bars.withColumn("_l", last).withColumn("date", F.when(F.col("date") == F.col("_l"), d).otherwise(F.col("date"))).drop("_l")


@query("grades_book", O.sql(O.BARS, _COV_PAST, _BOOK_CLAIM, _BOOK_GRADE, body="SELECT id, round(realized, 6) AS realized, abs(realized) <= pct AS hit FROM bc, bg WHERE n = 3"))
def grades_book(spark, sf):
    b = prepared(spark, sf)
    claim = book_claim(b.where(F.col("date") <= F.lit(AS_OF).cast("date")), BOOK, {"Brand#12": 3.0}, AS_OF)
    return E.places(grade_book(claim, on_day(b, AS_OF), BOOK, AS_OF).drop("kind"), 6, "realized")


def scoreboard(claims: DataFrame, grades: DataFrame) -> DataFrame:
    """Of each kind: graded, pending, share of hits, median ratio, share over the baseline, share correct; a function of the two tables."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    g = grades.groupBy("kind").agg(F.count("*").alias("graded"), share("hit").alias("hit_rate"), F.median(F.when(F.col("ratio") != 0, F.col("ratio"))).alias("median_ratio"), share("beat").alias("beat_rate"), share("correct").alias("correct_rate"))
    p = claims.join(grades.select("id"), "id", "left_anti").groupBy("kind").agg(F.count("*").alias("pending"))
    return claims.select("kind").distinct().join(g, "kind", "left").join(p, "kind", "left").fillna(0, ["graded", "pending"])


@query("scoreboard_kinds", O.sql(O.BARS, O.ANNOUNCEMENTS, _PAST, _RE_PAST, _MV_PAST, _EVENTS, _EVENT_GRADES, _VOL_PAST, _REGIME_CLAIMS, _REGIME_GRADES, _COV_PAST, _BOOK_CLAIM, _BOOK_GRADE, body="""
SELECT 'event' AS kind, (SELECT count(*) FROM eg) AS graded, (SELECT count(*) FROM ev) - (SELECT count(*) FROM eg) AS pending, NULL::DOUBLE AS hit_rate, (SELECT round(median(realized / typical), 5) FROM eg WHERE realized > 0 AND typical > 0) AS median_ratio, (SELECT round(avg((realized > baseline)::INT), 6) FROM eg) AS beat_rate, NULL::DOUBLE AS correct_rate FROM ev""").replace("SELECT 'event' AS kind, (", "SELECT DISTINCT 'event' AS kind, (") + """
UNION ALL SELECT DISTINCT 'regime', (SELECT count(*) FROM rg), (SELECT count(*) FROM rc) - (SELECT count(*) FROM rg), NULL, NULL, NULL, (SELECT round(avg(((realized > baseline) = (label = 'turbulent'))::INT), 6) FROM rg) FROM rc
UNION ALL SELECT 'book', (SELECT count(*) FROM bg WHERE n = 3), 1 - (SELECT count(*) FROM bg WHERE n = 3), (SELECT (abs(realized) <= pct)::INT::DOUBLE FROM bc, bg WHERE n = 3), NULL, NULL, NULL""")
def scoreboard_kinds(spark, sf):
    b, ann = prepared(spark, sf), T.announcements(spark, sf)
    past = eligible(b, AS_OF)
    ev, rc, bc = event_claims(ann, past, AS_OF, AHEAD), regime_claims(past, AS_OF), book_claim(b.where(F.col("date") <= F.lit(AS_OF).cast("date")), BOOK, {"Brand#12": 3.0}, AS_OF)
    claims = ev.select("id", "kind").unionByName(rc.select("id", "kind")).unionByName(bc.select("id", "kind"))
    grades = grade_events(ev, b).unionByName(grade_regimes(rc, b), allowMissingColumns=True).unionByName(grade_book(bc, on_day(b, AS_OF), BOOK, AS_OF), allowMissingColumns=True)
    return E.places(E.places(scoreboard(claims, grades), 6, "hit_rate", "beat_rate", "correct_rate"), 5, "median_ratio")


def log_claims(old: DataFrame, fresh: DataFrame, wanted: int, fetched: int, least: float = 0.8) -> DataFrame:
    """The rows that a run appends to the registry: claims whose id it does not hold. A fetch that returned less than ``least``
    of the symbols asked for logs nothing and fails."""
    if fetched < least * wanted:
        raise ValueError(f"{fetched} of {wanted} symbols fetched; nothing is logged from a truncated fetch")
    return G.append_new(old, G.first_of_each(fresh, "id", "kind"))


@query("registry_log", O.sql(O.BARS, O.ANNOUNCEMENTS, _PAST, _RE_PAST, _MV_PAST, _EVENTS, _VOL_PAST, _REGIME_CLAIMS, body="SELECT id, 'event' AS kind FROM ev UNION ALL SELECT id, 'regime' FROM rc WHERE issued OR symbol < 'Brand#3'"))
def registry_log(spark, sf):
    """Claims of a second run, some of which the registry holds: those not issued of half of the symbols."""
    b = prepared(spark, sf)
    past = eligible(b, AS_OF)
    rc = regime_claims(past, AS_OF)
    fresh = event_claims(T.announcements(spark, sf), past, AS_OF, AHEAD).select("id", "kind").unionByName(rc.select("id", "kind"))
    return log_claims(rc.where("NOT issued AND symbol >= 'Brand#3'").select("id"), fresh, 25, 25)


# --- performance ------------------------------------------------------------------------------------


def performance(days: DataFrame, by: Sequence[str] = ("symbol",), per_year: int = 252) -> DataFrame:
    """Annual return and volatility, Sharpe ratio, worst drawdown of wealth, turnover by year, and mean weight, of daily returns
    ``ret``, cash ``rf`` and weight ``w``. Wealth that is all lost counts as a drawdown of 1."""
    w = Window.partitionBy(*by).orderBy("date")
    d = days.withColumn("total", F.col("w") * F.col("ret") + (1 - F.col("w")) * F.col("rf")).withColumn("excess", F.col("total") - F.col("rf"))
    d = d.withColumn("_l", F.product(1 + F.col("total")).over(w)).withColumn("_dd", F.col("_l") / F.max("_l").over(w) - 1).withColumn("_t", F.abs(F.col("w") - F.lag("w").over(w)))
    year = float(per_year) ** 0.5
    return d.groupBy(*by).agg(
        (F.avg("total") * per_year).alias("ann_return"), (F.stddev_samp("total") * year).alias("ann_vol"), F.coalesce(X.over(F.avg("excess"), F.stddev_samp("excess")) * year, F.lit(0.0)).alias("sharpe"),
        F.greatest(F.lit(-1.0), F.least(F.lit(0.0), F.min("_dd"))).alias("max_drawdown"), (F.sum("_t") / (F.count("*") / float(per_year))).alias("turnover"), F.avg("w").alias("avg_weight"), F.count("*").alias("sessions"),
    )


_PERF = """
SELECT symbol, round(avg(tot) * 252, 5) AS ann_return, round(stddev_samp(tot) * sqrt(252), 5) AS ann_vol, round(coalesce(avg(tot - rf) / nullif(stddev_samp(tot - rf), 0) * sqrt(252), 0), 4) AS sharpe,
  round(greatest(-1, least(0, min(wealth / peak - 1))), 5) AS max_drawdown, round(sum(abs(w - w0)) / (count(*) / 252.0), 5) AS turnover, round(avg(w), 5) AS avg_weight, count(*) AS sessions
FROM (SELECT *, max(wealth) OVER (PARTITION BY symbol ORDER BY date) AS peak FROM (SELECT *, product(1 + tot) OVER (PARTITION BY symbol ORDER BY date) AS wealth, lag(w) OVER (PARTITION BY symbol ORDER BY date) AS w0 FROM (SELECT *, w * ret + (1 - w) * rf AS tot FROM {days}))) GROUP BY symbol"""


def _wire(df: DataFrame) -> DataFrame:
    return E.places(E.places(df, 5, "ann_return", "ann_vol", "max_drawdown", "turnover", "avg_weight"), 4, "sharpe")


@query("performance", O.sql(O.BARS, E._BILL, E._MANAGED, body=_PERF.format(days="mg")))
def q_performance(spark, sf):
    """The monthly no-leverage construction."""
    return _wire(performance(E.vol_managed(prepared(spark, sf), E.bill_levels(spark, sf))))


@query("buy_and_hold", O.sql(O.BARS, E._BILL, E._MANAGED, body=_PERF.format(days="(SELECT * REPLACE (1.0::DOUBLE AS w) FROM mg)")))
def buy_and_hold(spark, sf):
    return _wire(performance(E.vol_managed(prepared(spark, sf), E.bill_levels(spark, sf)).withColumn("w", F.lit(1.0))))


def last_sessions(days: DataFrame, n: int) -> DataFrame:
    return days.withColumn("_r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).where(F.col("_r") <= n).drop("_r")


@query("performance_recent", O.sql(O.BARS, E._BILL, E._MANAGED, body=_PERF.format(days="(SELECT * FROM mg QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 500)")))
def performance_recent(spark, sf):
    """The last sessions of the same construction (500 here, as the series are short)."""
    return _wire(performance(last_sessions(E.vol_managed(prepared(spark, sf), E.bill_levels(spark, sf)), 500)))


def matched_vol(bars: DataFrame, bills: DataFrame) -> DataFrame:
    """Uncapped monthly weights c / rv, with the c that gives the managed series the volatility of the excess return itself."""
    d = E.vol_managed(bars, bills)
    ret = bars.withColumn("ret", S.change(1)).where("ret is not null").withColumn("k", F.row_number().over(S.W) - 1).withColumn("rv", F.when(F.col("k") >= 21, F.avg(F.col("ret") * F.col("ret")).over(S.W.rowsBetween(-21, -1)))).withColumn("m", F.trunc("date", "MM"))
    first = ret.groupBy("symbol", "m").agg(F.min_by(F.struct("rv"), "date")["rv"].alias("rv"))
    by = Window.partitionBy("symbol")
    x = F.col("ret") - F.col("rf")
    d = d.join(first, ["symbol", "m"]).where("rv > 0").withColumn("_w", 1 / F.col("rv"))
    return d.withColumn("w", F.col("_w") * X.over(F.stddev_samp(x).over(by), F.stddev_samp(F.col("_w") * x).over(by))).drop("_w", "rv")


@query("performance_matched", O.sql(O.BARS, E._BILL, E._MANAGED, """
mu AS MATERIALIZED (SELECT mg.symbol, mg.date, mg.ret, mg.rf, 1 / q2.rv AS u FROM mg JOIN q2 ON q2.symbol = mg.symbol AND q2.m = mg.m AND q2.rv > 0),
mw AS MATERIALIZED (SELECT symbol, date, ret, rf, u * stddev_samp(ret - rf) OVER (PARTITION BY symbol) / nullif(stddev_samp(u * (ret - rf)) OVER (PARTITION BY symbol), 0) AS w FROM mu)""", body=_PERF.format(days="mw")))
def performance_matched(spark, sf):
    return _wire(performance(matched_vol(prepared(spark, sf), E.bill_levels(spark, sf))))


def ewma_weights(bars: DataFrame, bills: DataFrame, burn: int = C.YEAR) -> DataFrame:
    """Daily weights in [0, 1]: the median of earlier daily variances (at least ``burn``) over yesterday's."""
    d = E.vol_managed(bars, bills).drop("w")
    past = S.W.rowsBetween(Window.unboundedPreceding, -1)
    v = S.ewma_vol(bars).withColumn("_v", F.lag(F.col("vol") * F.col("vol")).over(S.W))
    v = v.withColumn("_m", F.percentile("_v", 0.5).over(past)).withColumn("_n", F.count("_v").over(past))
    w = F.when(F.col("_n") >= burn, F.greatest(F.lit(0.0), F.least(F.lit(1.0), X.over(F.col("_m"), F.col("_v"))))).otherwise(1.0)
    return d.join(v.select("symbol", "date", F.coalesce(w, F.lit(1.0)).alias("w")), ["symbol", "date"])


@query("performance_ewma", O.sql(O.BARS, O.VOL, E._BILL, E._MANAGED, """
ev AS (SELECT symbol, date, lag(vol * vol) OVER (PARTITION BY symbol ORDER BY date) AS v FROM vol),
ew AS MATERIALIZED (SELECT symbol, date, CASE WHEN count(v) OVER p >= 252 THEN coalesce(greatest(0, least(1, median(v) OVER p / v)), 1) ELSE 1 END AS w FROM ev WINDOW p AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
me AS (SELECT mg.symbol, mg.date, mg.ret, mg.rf, ew.w FROM mg JOIN ew ON ew.symbol = mg.symbol AND ew.date = mg.date)""", body=_PERF.format(days="me")))
def performance_ewma(spark, sf):
    return _wire(performance(ewma_weights(prepared(spark, sf), E.bill_levels(spark, sf))))


@query("annual_compounding", O.sql(O.BARS, body="SELECT symbol, count(*) AS months, round(avg(r), 6) AS mean, round(pow(1 + avg(r), 12) - 1, 2) AS annual FROM (SELECT symbol, close / lag(close) OVER (PARTITION BY symbol ORDER BY m) - 1 AS r FROM (SELECT symbol, date_trunc('month', date) AS m, arg_max(close, date) AS close FROM bars GROUP BY ALL)) WHERE r IS NOT NULL GROUP BY symbol"))
def annual_compounding(spark, sf):
    m = S.monthly_fold(T.bars(spark, sf)).withColumn("r", X.over(F.col("close"), F.lag("close").over(Window.partitionBy("symbol").orderBy("month"))) - 1)
    g = m.where("r is not null").groupBy("symbol").agg(F.count("*").alias("months"), F.avg("r").alias("mean"))
    return g.select("symbol", "months", F.round("mean", 6).alias("mean"), F.round(X.compounded(F.col("mean"), 12), 2).alias("annual"))


# --- meeting days -----------------------------------------------------------------------------------


@query("pinned_meetings", "SELECT date, year(date) AS year, month(date) AS month FROM (VALUES " + ", ".join(f"(DATE '{d}')" for d in C.MEETINGS) + ") t(date)")
def pinned_meetings(spark, sf):
    """The calendar of announcement days, a literal table."""
    return pinned_dates(spark).select("date", F.year("date").cast("long").alias("year"), F.month("date").cast("long").alias("month"))


def meeting_cells(bars: DataFrame, meetings: DataFrame) -> DataFrame:
    """symbol, cell, and Welch statistics of the sessions before, on and after meetings, of payroll days since the first meeting,
    and of both together, against quiet ones: since the first meeting, no meeting within a session, no payroll day."""
    d = bars.withColumn("ret", S.change(1)).where("ret is not null").withColumn("k", F.row_number().over(S.W))
    d = d.join(F.broadcast(meetings.select("date").distinct().withColumn("on", F.lit(True))), "date", "left").withColumn("on", F.coalesce("on", F.lit(False)))
    d = d.withColumn("payroll", F.col("date") == X.first_friday(F.col("date"))).withColumn("era", F.min(F.when(F.col("on"), F.col("k"))).over(Window.partitionBy("symbol")))
    near = lambda n: F.coalesce(F.lag("on", n).over(S.W) if n > 0 else F.lead("on", -n).over(S.W), F.lit(False))
    d = d.withColumn("after", near(1)).withColumn("before", near(-1)).withColumn("quiet", (F.col("k") >= F.col("era")) & ~(F.col("on") | F.col("after") | F.col("before") | F.col("payroll")))
    recent = F.col("payroll") & (F.col("k") >= F.col("era"))
    cells = {"t-1": F.col("before"), "t": F.col("on"), "t+1": F.col("after"), "payroll": recent, "announcement": F.col("on") | recent}
    long = d.select("symbol", "ret", "quiet", F.explode(F.array(*(F.struct(F.lit(n).alias("cell"), c.alias("member")) for n, c in cells.items()))).alias("x")).select("symbol", "ret", "x.cell", "x.member", "quiet")
    return ST.welch(long.where("member OR quiet"), "ret", F.col("member"), ["symbol", "cell"])


def third_wednesdays(bars: DataFrame) -> DataFrame:
    """Stand-in meeting days over the months of the bars: third Wednesdays of eight months a year."""
    months = bars.select(F.trunc("date", "MM").alias("m")).distinct().where(F.month("m").isin(1, 3, 5, 6, 7, 9, 11, 12))
    return months.select(F.date_add(F.next_day(F.date_sub("m", 1), "WED"), 14).alias("date"))


_MEET = """
me AS (SELECT DISTINCT m + ((10 - isodow(m)) % 7 + 14)::INT AS date FROM (SELECT DISTINCT date_trunc('month', date)::DATE AS m FROM bars) WHERE month(m) IN (1, 3, 5, 6, 7, 9, 11, 12)),
d0 AS (SELECT symbol, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM s),
d1 AS (SELECT *, row_number() OVER w AS k, date IN (SELECT date FROM me) AS ev, date = date_trunc('month', date)::DATE + ((12 - isodow(date_trunc('month', date))) % 7)::INT AS pay FROM d0 WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY date)),
d2 AS (SELECT *, min(k) FILTER (ev) OVER (PARTITION BY symbol) AS era, coalesce(lag(ev) OVER w, false) AS af, coalesce(lead(ev) OVER w, false) AS be FROM d1 WINDOW w AS (PARTITION BY symbol ORDER BY date)),
d3 AS MATERIALIZED (SELECT *, coalesce(k >= era, false) AND NOT (ev OR af OR be OR pay) AS quiet, pay AND coalesce(k >= era, false) AS rp FROM d2)"""


@query("meeting_cells", O.sql(O.BARS, _MEET, body="""
SELECT symbol, cell, count(*) FILTER (m) AS n1, count(*) FILTER (NOT m) AS n0, round(avg(ret) FILTER (m) - avg(ret) FILTER (NOT m), 6) AS diff,
  round(coalesce((avg(ret) FILTER (m) - avg(ret) FILTER (NOT m)) / nullif(sqrt(var_samp(ret) FILTER (m) / count(*) FILTER (m) + var_samp(ret) FILTER (NOT m) / count(*) FILTER (NOT m)), 0), 0), 4) AS t
FROM (SELECT symbol, ret, quiet, unnest([struct_pack(cell := 't-1', m := be), struct_pack(cell := 't', m := ev), struct_pack(cell := 't+1', m := af), struct_pack(cell := 'payroll', m := rp), struct_pack(cell := 'announcement', m := ev OR rp)], recursive := true) FROM d3) WHERE m OR quiet GROUP BY symbol, cell"""))
def q_meeting_cells(spark, sf):
    """With meetings on third Wednesdays of eight months, as the pinned calendar begins after these bars."""
    b = prepared(spark, sf)
    return E.places(E.places(meeting_cells(b, third_wednesdays(b)), 6, "diff"), 4, "t")


# --- labels, sentences, search, order ---------------------------------------------------------------


@query("target_labels", "WITH t AS (SELECT DISTINCT (['HI_', 'US_', 'HONOLULU_', ''])[n_nationkey % 4 + 1] || replace(n_name, ' ', '_') AS target FROM nation UNION SELECT unnest(['HI_UNEMPLOYMENT', 'HONOLULU_CPI', 'HONOLULU_SF_MEDIAN'])) SELECT target, CASE target WHEN 'HI_UNEMPLOYMENT' THEN 'Hawaii unemployment rate' WHEN 'HONOLULU_CPI' THEN 'Honolulu CPI (all items)' WHEN 'HONOLULU_SF_MEDIAN' THEN 'Honolulu single-family median price' ELSE CASE WHEN starts_with(target, 'HI_') THEN 'Hawaii ' || lower(replace(substr(target, 4), '_', ' ')) WHEN starts_with(target, 'US_') THEN 'US ' || lower(replace(substr(target, 4), '_', ' ')) WHEN starts_with(target, 'HONOLULU_') THEN 'Honolulu ' || lower(replace(substr(target, 10), '_', ' ')) ELSE lower(replace(target, '_', ' ')) END END AS label FROM t")
def target_labels(spark, sf):
    n = T.table(spark, sf, "nation")
    prefix = F.array(*map(F.lit, ("HI_", "US_", "HONOLULU_", "")))[(F.col("n_nationkey") % 4).cast("int")]
    t = n.select(F.concat(prefix, F.replace("n_name", F.lit(" "), F.lit("_"))).alias("target")).union(spark.createDataFrame([("HI_UNEMPLOYMENT",), ("HONOLULU_CPI",), ("HONOLULU_SF_MEDIAN",)], "target string")).distinct()
    return t.select("target", X.target_label(F.col("target")).alias("label"))


@query("symbol_search", "SELECT s_suppkey AS symbol, s_name AS name FROM supplier WHERE contains(upper('S' || s_suppkey), 'S1') OR contains(upper(s_name), '#00000000' || 2)")
def symbol_search(spark, sf):
    s = T.table(spark, sf, "supplier").select("s_suppkey", "s_name")
    one = X.matches(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")), F.lit(None).cast("string"), "  s1 ")
    return s.where(one | X.matches(F.lit(""), F.col("s_name"), "#000000002")).select(F.col("s_suppkey").alias("symbol"), F.col("s_name").alias("name"))


@query("number_formats", "SELECT c_custkey, CASE WHEN x IS NULL THEN '-' ELSE printf('%.2f%%', x / 1e4) END AS percent, CASE WHEN x IS NULL THEN '-' ELSE printf('%.3f', x) END AS fixed, CASE WHEN x IS NULL THEN '-' WHEN abs(big) >= 1e12 THEN printf('%.2fT', big / 1e12) WHEN abs(big) >= 1e9 THEN printf('%.2fB', big / 1e9) WHEN abs(big) >= 1e6 THEN printf('%.1fM', big / 1e6) WHEN abs(big) >= 1e3 THEN printf('%.1fK', big / 1e3) ELSE printf('%.0f', big) END AS compact FROM (SELECT c_custkey, x, x * pow(10, c_custkey % 10) AS big FROM (SELECT c_custkey, CASE WHEN c_custkey % 17 <> 0 THEN c_acctbal + 0.00123::DOUBLE END AS x FROM customer))")
def number_formats(spark, sf):
    x = F.when(F.col("c_custkey") % 17 != 0, F.col("c_acctbal") + 0.00123)
    c = T.table(spark, sf, "customer").select("c_custkey", x.alias("x"))
    return c.select("c_custkey", X.percent_text(F.col("x") / 1e6).alias("percent"), X.fixed_text(F.col("x"), 3).alias("fixed"), X.compact_text(F.col("x") * F.pow(F.lit(10.0), F.col("c_custkey") % 10)).alias("compact"))


@query("rank_sentences", f"SELECT symbol, CASE WHEN trailing_pe_percentile IS NULL THEN 'No comparable P/E.' ELSE printf('P/E %.1f is %s its %s peer group (n=%d, median %.1f).', pe + 1e-7, CASE WHEN trailing_pe_percentile <= 0.25 THEN 'in the cheapest quartile of' WHEN trailing_pe_percentile <= 0.5 THEN 'below the median of' WHEN trailing_pe_percentile <= 0.75 THEN 'above the median of' ELSE 'in the most expensive quartile of' END, peer_group, trailing_pe_count, trailing_pe_median + 1e-7) END AS sentence FROM ({Q.SQL['valuation_ranks']}) v JOIN (" + O.sql(O.FUNDAMENTALS, body="SELECT symbol, trailing_pe AS pe FROM f") + ") f USING (symbol)")
def rank_sentences(spark, sf):
    v = Q.valuations(T.fundamentals(spark, sf))
    up = lambda c: F.col(c) + 1e-7  # noqa: E731  away from ties, which engines round differently
    return v.select("symbol", X.rank_sentence("P/E", up("trailing_pe"), F.col("trailing_pe_percentile"), F.col("peer_group"), F.col("trailing_pe_count"), up("trailing_pe_median")).alias("sentence"))


@query("verdict_sorted", f"SELECT symbol, verdict, separation, row_number() OVER (ORDER BY CASE verdict WHEN 'confirmed' THEN 0 WHEN 'weak' THEN 1 WHEN 'no separation' THEN 2 ELSE 3 END, coalesce(separation, 0) DESC, symbol) AS place FROM ({E.SQL['regime_validation']})")
def verdict_sorted(spark, sf):
    """Confirmed labels first, then by separation. A bounded table, a row a symbol."""
    v = E.places(E.regime_validation(S.ewma_vol(prepared(spark, sf))), 6, "separation").select("symbol", "verdict", "separation")
    rank = F.when(F.col("verdict") == "confirmed", 0).when(F.col("verdict") == "weak", 1).when(F.col("verdict") == "no separation", 2).otherwise(3)
    return v.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(rank, F.coalesce("separation", F.lit(0.0)).desc(), "symbol")).cast("long"))


# --- population and filing cache --------------------------------------------------------------------


def population_members(bars: DataFrame, f: DataFrame) -> DataFrame:
    """Members of a population from bars and fundamentals: companies with any attribute, momentum at their last session."""
    last = G.last_row(Q.with_momentum(bars)).select("symbol", F.col("mom_12_1").alias("momentum"))
    co = f.where(~X.is_fund(F.col("quote_type"))).join(last, "symbol", "left")
    out = co.select(
        "symbol", "sector", "momentum", X.ebitda_yield(F.col("ev_ebitda")).alias("ebitda_yield"), X.fcf_yield(F.col("free_cashflow"), F.col("operating_cashflow"), F.col("market_cap")).alias("fcf_yield"),
        X.earnings_yield(F.col("trailing_pe")).alias("earnings_yield"), F.col("return_on_equity").alias("roe"), F.col("return_on_assets").alias("roa"), "operating_margin", (-F.col("debt_to_equity")).alias("low_leverage"),
    )
    return out.where(F.coalesce(*(F.col(c) for c in out.columns[2:])).isNotNull())


@query("population_members", O.sql(O.BARS, O.FUNDAMENTALS, O.MOMENTUM, body="""
SELECT symbol, sector, round(mom_12_1, 6) AS momentum, round(CASE WHEN ev_ebitda > 0 THEN 1 / ev_ebitda END, 6) AS ebitda_yield, round(CASE WHEN operating_cashflow IS NULL OR free_cashflow <= operating_cashflow THEN free_cashflow / nullif(market_cap, 0) END, 6) AS fcf_yield,
  round(CASE WHEN trailing_pe > 0 THEN 1 / trailing_pe END, 6) AS earnings_yield, round(return_on_equity, 6) AS roe, round(return_on_assets, 6) AS roa, round(operating_margin, 6) AS operating_margin, round(-debt_to_equity, 6) AS low_leverage
FROM f LEFT JOIN (SELECT symbol, arg_max(struct_pack(v := mom_12_1), date).v AS mom_12_1 FROM mom GROUP BY symbol) USING (symbol) WHERE quote_type <> 'ETF'"""))
def q_population_members(spark, sf):
    m = population_members(prepared(spark, sf), T.fundamentals(spark, sf))
    return E.places(m, 6, *m.columns[2:])


def filing_cache(quarters: Sequence[DataFrame], path: str | None = None) -> DataFrame:
    """All quarters' filings as one table; with ``path`` written as Parquet once and read from there afterwards."""
    if path is None:
        out = quarters[0]
        for q in quarters[1:]:
            out = out.unionByName(q, allowMissingColumns=True)
        return out
    spark = quarters[0].sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        filing_cache(quarters).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@query("filing_cache", f"SELECT accession, filed, p, s, owners, quarter(filed) AS q FROM ({G.SQL['form4_merge']}) WHERE year(filed) = 1995")
def q_filing_cache(spark, sf):
    f = G.form4_merge(spark, sf).where("year(filed) = 1995").withColumn("q", F.quarter("filed").cast("long"))
    return filing_cache([f.where(F.col("q") == k) for k in (1, 2, 3, 4)])
