"""File sources and sinks: constituents, histories, claims, filings, notes, watchlists, snapshots, payloads."""

from __future__ import annotations

import json
import os
import re
import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewright import constants as C
from tapewright.functions import scalars as X

HISTORY = "date string, symbol string, source string, mom_12_1 double, mom_rank double, value_score double, quality_score double, value_trap boolean, reversal_tension boolean"
CLAIMS = "id string, kind string, as_of string, symbol string, horizon_sessions int, coverage double, low double, high double, pct double, calibrated boolean, n_events int, amps array<double>, method string, announce string, session string, typical_move double, amplification double, baseline_move double, label string, separation double, baseline_abs double, predict_exceed boolean, weights map<string,double>, event_names array<string>"
MEMBER = "symbol string, sector string, momentum double, ebitda_yield double, fcf_yield double, earnings_yield double, roe double, roa double, operating_margin double, low_leverage double"


def constituents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="symbol string, name string, gics_sector string")


def membership_change(old: DataFrame, new: DataFrame, least: int) -> DataFrame:
    """symbol, change (added or removed); fails where the new list has fewer than ``least`` rows."""
    n = new.count()
    if n < least:
        raise ValueError(f"{n} constituents; at least {least} are plausible")
    tag = lambda a, b, name: a.select("symbol").join(b.select("symbol"), "symbol", "left_anti").withColumn("change", F.lit(name))
    return tag(new, old, "added").unionByName(tag(old, new, "removed"))


def history(spark: SparkSession, path: str) -> DataFrame:
    """Factor history in JSON lines; torn lines are skipped."""
    return spark.read.schema(HISTORY).option("mode", "DROPMALFORMED").json(path)


def claims(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CLAIMS).option("mode", "DROPMALFORMED").json(path)


def write_history(df: DataFrame, path: str) -> None:
    """Sorted JSON lines with nulls left out, in one file as its readers expect; a row a symbol and sample date."""
    df.orderBy("date", "symbol").coalesce(1).write.mode("overwrite").json(path)


def save_population(members: DataFrame, as_of: str, path: str) -> None:
    members.withColumn("as_of", F.lit(as_of)).write.mode("overwrite").json(path)


def load_population(spark: SparkSession, path: str) -> DataFrame | None:
    """The snapshot, or None where it is absent or unreadable."""
    try:
        df = spark.read.schema(MEMBER + ", as_of string").json(path).where("symbol is not null and as_of is not null")
        return df if df.limit(1).count() else None
    except Exception as e:  # Spark says with one class of many that a path is missing
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def population_or_fallback(spark: SparkSession, session: str, path: str, fetch) -> DataFrame | None:
    """The snapshot of this session; else what ``fetch()`` gives, saved; else, if that fails in any way, the old snapshot."""
    old = load_population(spark, path)
    if old is not None and old.where(F.col("as_of") == session).limit(1).count():
        return old
    try:
        save_population(fetch(), session, path + ".new")
        return load_population(spark, path + ".new")
    except Exception as failed:  # the reader's, Spark's or the network's
        warnings.warn(f"population not fetched, the old snapshot stands: {failed}", stacklevel=2)
        return old


def available(members: DataFrame) -> bool:
    return members.count() >= C.MIN_POPULATION


def form4(spark: SparkSession, folder: str, symbols: DataFrame) -> DataFrame:
    """symbol, filed, plan, owners, P, S of type 4 filings of known symbols, from three extracted tab-separated tables."""
    tsv = lambda name: spark.read.csv(f"{folder}/{name}.tsv", sep="\t", header=True, quote="")
    sub = tsv("SUBMISSION").where("DOCUMENT_TYPE = '4'").withColumn("symbol", X.normalise_symbol(F.col("ISSUERTRADINGSYMBOL"))).join(F.broadcast(symbols.select("symbol").distinct()), "symbol", "left_semi")
    sub = sub.select("ACCESSION_NUMBER", "symbol", X.parse_date(F.col("FILING_DATE")).alias("filed"), F.lower("AFF10B5ONE").isin("1", "true").alias("plan"))
    usd = X.clean(F.col("TRANS_SHARES")) * X.clean(F.col("TRANS_PRICEPERSHARE"))
    side = lambda c: F.coalesce(F.sum(F.when(F.col("TRANS_CODE") == c, usd)), F.lit(0.0)).alias(c)
    trans = tsv("NONDERIV_TRANS").where("TRANS_CODE in ('P', 'S')").groupBy("ACCESSION_NUMBER").agg(side("P"), side("S"))
    own = tsv("REPORTINGOWNER").groupBy("ACCESSION_NUMBER").agg(F.array_sort(F.collect_set("RPTOWNERCIK")).alias("owners"))
    return sub.join(trans, "ACCESSION_NUMBER").join(own, "ACCESSION_NUMBER", "left").drop("ACCESSION_NUMBER")


def notes(spark: SparkSession, folder: str, most: int = 60) -> DataFrame:
    """date, text of the newest notes named YYYY-MM-DD.md; the limit is the list's length on the page."""
    df = spark.read.text(f"{folder}/*.md", wholetext=True).withColumn("date", F.regexp_extract(F.input_file_name(), r"(\d{4}-\d{2}-\d{2})\.md$", 1))
    return df.where("date <> ''").select("date", F.col("value").alias("text")).orderBy(F.desc("date")).limit(most)


def watchlist_csv(spark: SparkSession, path: str) -> DataFrame:
    """Valid symbols of a CSV's Symbol column in file order, the first of repeats."""
    raw = spark.read.csv(path, header=True)
    name = next(c for c in raw.columns if c.strip().lower() in ("symbol", "ticker"))
    s = raw.select(X.normalise_symbol(F.col(f"`{name}`")).alias("symbol"), F.monotonically_increasing_id().alias("pos")).where(X.valid_symbol(F.col("symbol")))
    return s.groupBy("symbol").agg(F.min("pos").alias("pos")).orderBy("pos")


def universe(spark: SparkSession, text: str) -> DataFrame:
    """tier, symbol, pos of a watchlist in the block YAML form ``tiers: / name: / symbols: [..] or - item``; first tier wins."""
    rows, tier, section, listing = [], None, None, False
    for line in text.splitlines():
        body = line.split("#", 1)[0].rstrip()
        if not body.strip():
            continue
        depth, word = len(body) - len(body.lstrip()), body.strip()
        if depth == 0:
            section, listing = word.rstrip(":"), False
        elif section == "tiers" and depth == 2 and word.endswith(":"):
            tier, listing = word[:-1], False
        elif section == "tiers" and word.startswith("symbols:"):
            listing = True
            rows += [(tier, s.strip(" \"'")) for s in word.removeprefix("symbols:").strip(" []").split(",") if s.strip()]
        elif listing and word.startswith("- "):
            rows.append((tier, word[2:].strip(" \"'")))
        else:
            listing = False
    if not rows:
        raise ValueError("a watchlist without symbols")
    df = spark.createDataFrame([(t, s, i) for i, (t, s) in enumerate(rows)], "tier string, symbol string, pos int").withColumn("symbol", X.normalise_symbol(F.col("symbol")))
    return df.withColumn("_r", F.row_number().over(Window.partitionBy("symbol").orderBy("pos"))).where("_r = 1").drop("_r")


def merge_holdings(public: DataFrame, local: DataFrame) -> DataFrame:
    """Public weights with the private overlay's fields by symbol. The result is private; sinks for the public read ``public``."""
    shared = [c for c in local.columns if c in public.columns and c != "symbol"]
    j = public.alias("p").join(local.alias("l"), "symbol", "left")
    return j.select("symbol", *(F.coalesce(f"l.{c}", f"p.{c}").alias(c) if c in shared else F.col(f"p.{c}") for c in public.columns if c != "symbol"), *(F.col(f"l.{c}") for c in local.columns if c not in public.columns))


#: The only columns of holdings that a public payload may have.
PUBLIC = ("symbol", "name", "exposure", "kind")


def public_holdings(df: DataFrame) -> DataFrame:
    return df.select(*(c for c in PUBLIC if c in df.columns))


def top_up(cached: DataFrame, wanted: DataFrame, fetch, key: str = "symbol") -> DataFrame:
    """``cached`` and what ``fetch`` gives for the wanted keys that it lacks."""
    return cached.unionByName(fetch(wanted.select(key).distinct().join(cached.select(key).distinct(), key, "left_anti")), allowMissingColumns=True)


def failures(wanted: DataFrame, bars: DataFrame) -> DataFrame:
    return wanted.select("symbol").distinct().join(bars.select("symbol").distinct(), "symbol", "left_anti").withColumn("reason", F.lit("no bars"))


def require_coverage(wanted: DataFrame, bars: DataFrame, share: float) -> float:
    """The share of wanted symbols with bars; fails under ``share``."""
    n = wanted.select("symbol").distinct().count()
    got = n - failures(wanted, bars).count()
    if n == 0 or got / n < share:
        raise ValueError(f"bars of {got} of {n} symbols; {share:.0%} are needed")
    return got / n


def pinned_dates(spark: SparkSession, days: Sequence[str] = C.MEETINGS) -> DataFrame:
    """A literal table of days, by default those of rate decisions."""
    return spark.createDataFrame([(d,) for d in days], "d string").select(X.parse_date(F.col("d")).alias("date"))


def macro_signals(spark: SparkSession, path: str, robust_only: bool = False) -> DataFrame:
    """One row a signal, robust first and then by p."""
    df = spark.read.option("multiLine", True).json(path).select(F.explode("signals").alias("s")).select("s.*")
    df = df.where("robust_to_2020_exclusion") if robust_only else df
    return df.orderBy("ticker", F.col("robust_to_2020_exclusion").desc(), F.coalesce("granger_p", F.lit(1.0)))


def write_payloads(df: DataFrame, path: str) -> None:
    """A JSON folder for each symbol."""
    df.write.mode("overwrite").partitionBy("symbol").json(path)


def replace_block(path: str, start: str, end: str, body: str) -> None:
    """Rewrite the part of a small text file between two markers."""
    text = open(path, encoding="utf-8").read() if os.path.exists(path) else f"{start}\n{end}\n"
    new = re.sub(re.escape(start) + ".*?" + re.escape(end), lambda _: f"{start}\n{body}\n{end}", text, flags=re.S)
    with open(path, "w", encoding="utf-8") as f:
        f.write(new)


def study_json(df: DataFrame) -> str:
    """A study's result rows as JSON; such tables have a few rows."""
    return json.dumps([json.loads(r) for r in df.toJSON().collect()])


GRADES = "id string, kind string, realized double, hit boolean, coverage double, ratio double, beat_baseline boolean, exceeded boolean, correct boolean"
#: Raw names of a fundamentals snapshot: those that are taken as they are, and those that only count if positive. Fixed values of the format.
SNAPSHOT = {
    "market_cap": "marketCap", "trailing_eps": "trailingEps", "forward_eps": "forwardEps", "profit_margin": "profitMargins", "revenue_growth": "revenueGrowth", "earnings_growth": "earningsGrowth", "beta": "beta", "enterprise_value": "enterpriseValue",
    "free_cashflow": "freeCashflow", "operating_cashflow": "operatingCashflow", "return_on_equity": "returnOnEquity", "return_on_assets": "returnOnAssets", "operating_margin": "operatingMargins", "gross_margin": "grossMargins", "total_debt": "totalDebt",
    "total_cash": "totalCash", "avg_volume_3m": "averageVolume", "shares_outstanding": "sharesOutstanding", "fifty_two_week_high": "fiftyTwoWeekHigh", "fifty_two_week_low": "fiftyTwoWeekLow",
}
POSITIVE = {"trailing_pe": "trailingPE", "forward_pe": "forwardPE", "price_to_book": "priceToBook", "price_to_sales": "priceToSalesTrailing12Months", "ev_ebitda": "enterpriseToEbitda"}


def read_bars(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """symbol, date, open, high, low, close, volume of a Parquet or CSV table of those columns, in any case.

    Rows without a close are dropped; an open, high or low that is missing or 0 becomes the close, a missing volume 0.
    """
    raw = spark.read.csv(path, header=True) if kind == "csv" else spark.read.format(kind).load(path)
    have = {c.strip().lower(): F.col(f"`{c}`") for c in raw.columns}
    close = X.clean(have["close"])
    price = lambda c: X.or_else(X.clean(have[c]), close).alias(c) if c in have else close.alias(c)
    volume = F.coalesce(X.clean(have["volume"]), F.lit(0.0)) if "volume" in have else F.lit(0.0)
    return raw.select(X.normalise_symbol(have["symbol"]).alias("symbol"), have["date"].cast("date").alias("date"), price("open"), price("high"), price("low"), close.alias("close"), volume.alias("volume")).where("close is not null and date is not null")


def read_fundamentals(spark: SparkSession, path: str) -> DataFrame:
    """A row a symbol of a JSON-lines snapshot in its source's names. Debt to equity comes in percent; so does the dividend
    yield where the trailing one is missing. What is absent is null."""
    names = ["symbol", "shortName", "longName", "sector", "industry", "quoteType", "trailingPegRatio", "pegRatio", "trailingAnnualDividendYield", "dividendYield", "debtToEquity", *SNAPSHOT.values(), *POSITIVE.values()]
    raw = spark.read.schema(", ".join(f"`{n}` string" for n in dict.fromkeys(names))).json(path)
    num = lambda c: X.clean(F.col(c))
    return raw.select(
        "symbol", F.coalesce(F.nullif("shortName", F.lit("")), "longName").alias("name"), "sector", "industry", F.col("quoteType").alias("quote_type"),
        *(num(c).alias(n) for n, c in SNAPSHOT.items()), *(X.positive(F.col(c)).alias(n) for n, c in POSITIVE.items()),
        X.or_else(num("trailingPegRatio"), num("pegRatio")).alias("peg_ratio"), F.coalesce(num("trailingAnnualDividendYield"), num("dividendYield") / 100).alias("dividend_yield"), (num("debtToEquity") / 100).alias("debt_to_equity"),
    ).where("symbol is not null")


def read_announcements(spark: SparkSession, path: str) -> DataFrame:
    """symbol, stamp, ex_dividend of JSON lines with a list of stamps; one row a distinct stamp, one with a null stamp where none is listed."""
    raw = spark.read.schema("symbol string, earnings_dates array<string>, ex_dividend string").json(path).where("symbol is not null")
    return raw.select("symbol", F.explode_outer(F.array_sort(F.array_distinct("earnings_dates"))).alias("stamp"), X.parse_date(F.col("ex_dividend")).alias("ex_dividend"))


def read_all(spark: SparkSession, folder: str, wanted: DataFrame) -> dict[str, DataFrame]:
    """Bars, fundamentals and announcements of the wanted symbols, and which of them have no bars."""
    own = lambda df: df.join(wanted.select("symbol").distinct(), "symbol", "left_semi")
    bars = own(read_bars(spark, f"{folder}/bars"))
    return {"bars": bars, "fundamentals": own(read_fundamentals(spark, f"{folder}/fundamentals")), "announcements": own(read_announcements(spark, f"{folder}/announcements")), "failures": failures(wanted, bars)}


def grades(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GRADES).json(path)


def merge_tier(current: DataFrame, tier: str, symbols: DataFrame, replace: bool = False) -> DataFrame:
    """tier, symbol, pos with new symbols (symbol, pos) added to a tier behind those it has, or in their place. A symbol stays
    in the first tier that names it."""
    kept = current.where(~((F.col("tier") == tier) & F.lit(replace))).select("tier", "symbol", F.lit(0).alias("_new"), F.col("pos").cast("long").alias("pos"))
    both = kept.unionByName(symbols.select(F.lit(tier).alias("tier"), "symbol", F.lit(1).alias("_new"), F.col("pos").cast("long").alias("pos")))
    first = both.withColumn("_r", F.row_number().over(Window.partitionBy("symbol").orderBy("_new", "pos"))).where("_r = 1")
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("tier").orderBy("_new", "pos")) - 1).select("tier", "symbol", "pos")
