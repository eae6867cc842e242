"""Scalar rules, ranks, as-of joins, cooldown, statistics, files and the stream."""

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tapewright.functions import scalars as X
from tapewright.operators import asof as A
from tapewright.operators import ranks as R
from tapewright.operators import stats as ST
from tapewright.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalars(spark):
    assert one(spark, X.clean(F.lit("nan"))) is None and one(spark, X.clean(F.lit("1.5"))) == 1.5 and one(spark, X.clean(F.lit("x"))) is None
    assert one(spark, X.positive(F.lit(-1.0))) is None
    assert one(spark, X.normalise_symbol(F.lit(" brk.b "))) == "BRK-B"
    assert one(spark, X.parse_date(F.lit("05-MAR-2024"))) == dt.date(2024, 3, 5) and one(spark, X.parse_date(F.lit("soon"))) is None
    assert one(spark, X.fcf_yield(F.lit(250.0), F.lit(-161.0), F.lit(1000.0))) is None
    assert one(spark, X.fcf_yield(F.lit(5.0), F.lit(None).cast("double"), F.lit(100.0))) == 0.05
    assert one(spark, X.stamp_after_close(F.lit("2024-01-02T16:00:00-05:00"))) and not one(spark, X.stamp_after_close(F.lit("2024-01-02T06:00:00-05:00"))) and not one(spark, X.stamp_after_close(F.lit("2024-01-02")))
    assert one(spark, X.first_friday(F.lit("2024-03-20").cast("date"))) == dt.date(2024, 3, 1)
    assert one(spark, X.future_weekdays(F.lit("2024-03-01").cast("date"), 3)) == [dt.date(2024, 3, 4), dt.date(2024, 3, 5), dt.date(2024, 3, 6)]
    assert one(spark, X.compact_number(F.lit(2_500_000.0))) == "2.5M"


def test_pct_rank_ignores_nulls_and_splits_ties(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 2.0), (1, None), (1, 4.0)], "g int, v double").withColumn("x", R.pct_rank("v", "g"))
    assert sorted((r.v, round(r.x, 6)) for r in df.collect() if r.v is not None) == [(1.0, 0.0), (2.0, 0.5), (2.0, 0.5), (4.0, 1.0)]
    assert df.where("v is null").first().x is None


def test_foreign_rank_passes_one(spark):
    members = spark.createDataFrame([("m", float(k)) for k in range(5)], "attr string, m double")
    probes = spark.createDataFrame([("p", "m", 9.0)], "symbol string, attr string, v double")
    assert R.foreign_rank(probes, members, []).first().rank == 5 / 4


def test_asof_against_scan(spark):
    rng = random.Random(4)
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(days=k)
    right = sorted(rng.sample(range(200), 60))
    left = [(k, rng.randrange(210), rng.random() < 0.5) for k in range(120)]
    L = spark.createDataFrame([("A", k, day(d), s) for k, d, s in left], "symbol string, k int, at date, late boolean")
    Rt = spark.createDataFrame([("A", day(d), d) for d in right], "symbol string, date date, v int")
    fwd = {r.k: r.v for r in A.asof(L, Rt, F.col("at"), "date", ["v"], ["symbol"], forward=True, strict=F.col("late")).collect()}
    bwd = {r.k: r.v for r in A.asof(L, Rt, F.col("at"), "date", ["v"], ["symbol"], strict=F.col("late")).collect()}
    for k, d, s in left:
        assert fwd[k] == next((x for x in right if (x > d if s else x >= d)), None)
        assert bwd[k] == next((x for x in reversed(right) if (x < d if s else x <= d)), None)


def test_cooldown_is_greedy(spark):
    rng = random.Random(9)
    rows = [(f"S{s}", i) for s in range(5) for i in sorted(rng.sample(range(300), 40))]
    got = sorted(tuple(r) for r in A.cooled(spark.createDataFrame(rows, "symbol string, i long"), 21).select("symbol", "i").collect())
    want, last = [], {}
    for s, i in rows:
        if i - last.get(s, -10**9) >= 21:
            want.append((s, i))
            last[s] = i
    assert got == sorted(want)


def test_newey_west_against_loop(spark):
    rng, n, lags = random.Random(2), 120, 7
    x = [rng.gauss(0.1, 1) for _ in range(n)]
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(x)], "g int, date int, v double")
    r = ST.newey_west(df, "v", lags, ["g"]).first()
    m = statistics.mean(x)
    d = [v - m for v in x]
    var = sum(v * v for v in d) / n + sum(2 * (1 - k / (lags + 1)) * sum(d[i] * d[i - k] for i in range(k, n)) / n for k in range(1, lags + 1))
    assert math.isclose(r.mean, m) and math.isclose(r.se, math.sqrt(var / n)) and math.isclose(r.t, m / math.sqrt(var / n))


def test_files(spark, tmp_path):
    (tmp_path / "h.jsonl").write_text('{"date":"2024-01-02","symbol":"A","source":"live","mom_rank":0.5}\n{"date":"2024-01-\n')
    assert [r.symbol for r in files.history(spark, str(tmp_path / "h.jsonl")).collect()] == ["A"]
    (tmp_path / "w.csv").write_text("Symbol,Price\nbrk.b,1\nAAPL,2\n???,3\nAAPL,4\n")
    assert [r.symbol for r in files.watchlist_csv(spark, str(tmp_path / "w.csv")).collect()] == ["BRK-B", "AAPL"]
    u = files.universe(spark, "tiers:\n  core:\n    symbols: [brk.b, AAPL]\n  other:\n    symbols:\n      - AAPL\n      - MSFT\nsettings:\n  x: 1\n")
    assert sorted((r.tier, r.symbol) for r in u.collect()) == [("core", "AAPL"), ("core", "BRK-B"), ("other", "MSFT")]
    with pytest.raises(ValueError):
        files.universe(spark, "tiers:\n")
    assert files.load_population(spark, str(tmp_path / "absent")) is None
    private = spark.createDataFrame([("A", "a", 0.5, "position", 1e6)], "symbol string, name string, exposure double, kind string, market_value double")
    assert "market_value" not in files.public_holdings(private).columns
    for name, text in {"SUBMISSION": "ACCESSION_NUMBER\tDOCUMENT_TYPE\tISSUERTRADINGSYMBOL\tFILING_DATE\tAFF10B5ONE\n1\t4\tbrk.b\t05-MAR-2024\t1\n2\t3\tA\t05-MAR-2024\t0\n", "NONDERIV_TRANS": "ACCESSION_NUMBER\tTRANS_CODE\tTRANS_SHARES\tTRANS_PRICEPERSHARE\n1\tP\t10\t2.5\n1\tS\t1\t4\n1\tM\t9\t9\n", "REPORTINGOWNER": "ACCESSION_NUMBER\tRPTOWNERCIK\n1\t7\n1\t7\n1\t5\n"}.items():
        (tmp_path / f"{name}.tsv").write_text(text)
    f = files.form4(spark, str(tmp_path), spark.createDataFrame([("BRK-B",)], "symbol string")).first()
    assert (f.symbol, f.filed, f.plan, f.P, f.S, f.owners) == ("BRK-B", dt.date(2024, 3, 5), True, 25.0, 4.0, ["5", "7"])


def test_stream_equals_batch(spark, sf, tmp_path):
    from tapewright.streaming.hourly import hourly, start

    events = spark.read.parquet(f"{sf}/events.parquet")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "e"))
    q = start(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")), "hourly_test")
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("hourly_test").collect()}
    assert got and got <= {tuple(r) for r in hourly(events).collect()}
