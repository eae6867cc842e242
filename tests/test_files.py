"""Readers of bars, snapshots, announcements, grades and watchlists on small files."""

import datetime as dt
import json

from tapewright.sources import files


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return str(path)


def test_bars_of_csv_and_parquet(spark, tmp_path):
    (tmp_path / "bars.csv").write_text("Symbol,Date,Open,High,Low,Close,Volume\nbrk.b,2024-01-02,1,3,0,2,10\nAAA,2024-01-02,,nan,1,2,\nAAA,2024-01-03,1,1,1,,5\nAAA,2024-01-04,1,1,1,inf,5\n")
    got = files.read_bars(spark, str(tmp_path / "bars.csv"), "csv")
    want = {("BRK-B", dt.date(2024, 1, 2), 1.0, 3.0, 2.0, 2.0, 10.0), ("AAA", dt.date(2024, 1, 2), 2.0, 2.0, 1.0, 2.0, 0.0)}
    assert {tuple(r) for r in got.collect()} == want
    got.write.parquet(str(tmp_path / "bars"))
    assert {tuple(r) for r in files.read_bars(spark, str(tmp_path / "bars")).collect()} == want


def test_fundamentals_units(spark, tmp_path):
    path = lines(tmp_path / "f.json", [{"symbol": "A", "shortName": "", "longName": "Long", "debtToEquity": 25.8, "dividendYield": 2.5, "trailingPE": -3, "beta": "Infinity", "pegRatio": 1.5}, {"symbol": "B", "trailingAnnualDividendYield": 0.01, "dividendYield": 9, "trailingPE": 12}, {"sector": "x"}])
    a, b = files.read_fundamentals(spark, path).orderBy("symbol").collect()
    assert (a.name, a.debt_to_equity, a.dividend_yield, a.trailing_pe, a.beta, a.peg_ratio) == ("Long", 0.258, 0.025, None, None, 1.5)
    assert (b.dividend_yield, b.trailing_pe, b.debt_to_equity) == (0.01, 12.0, None)


def test_announcements_and_all(spark, tmp_path):
    for name in ("fundamentals", "announcements"):
        (tmp_path / name).mkdir()
    lines(tmp_path / "announcements" / "a.json", [{"symbol": "A", "earnings_dates": ["2024-02-01T16:30:00-05:00", "2024-01-01", "2024-01-01"], "ex_dividend": "2024-03-01"}, {"symbol": "B"}])
    lines(tmp_path / "fundamentals" / "f.json", [{"symbol": "A"}, {"symbol": "C"}])
    spark.createDataFrame([("A", "2024-01-02", 1.0)], "symbol string, date string, close double").write.parquet(str(tmp_path / "bars"))
    got = files.read_all(spark, str(tmp_path), spark.createDataFrame([("A",), ("B",)], "symbol string"))
    assert sorted((r.symbol, r.stamp or "") for r in got["announcements"].collect()) == [("A", "2024-01-01"), ("A", "2024-02-01T16:30:00-05:00"), ("B", "")]
    assert [r.symbol for r in got["fundamentals"].collect()] == ["A"] and got["bars"].count() == 1 and [r.symbol for r in got["failures"].collect()] == ["B"]


def test_grades_and_tiers(spark, tmp_path):
    path = lines(tmp_path / "g.jsonl", [{"id": "range:A:d:5", "kind": "range", "realized": 3.0, "hit": True}, {"id": "event:A:d:0:x", "kind": "event", "ratio": 1.5, "beat_baseline": False}])
    assert [(r.kind, r.hit, r.ratio) for r in files.grades(spark, path).orderBy("kind").collect()] == [("event", None, 1.5), ("range", True, None)]
    now = files.universe(spark, "tiers:\n  core:\n    symbols: [A, B]\n  watch:\n    symbols: [C, D]\n")
    new = spark.createDataFrame([("E", 0), ("B", 1), ("D", 2)], "symbol string, pos int")
    tiers = lambda df: {t: [r.symbol for r in df.where(f"tier = '{t}'").orderBy("pos").collect()] for t in ("core", "watch")}
    assert tiers(files.merge_tier(now, "watch", new)) == {"core": ["A", "B"], "watch": ["C", "D", "E"]}
    assert tiers(files.merge_tier(now, "watch", new, replace=True)) == {"core": ["A", "B"], "watch": ["E", "D"]}
    assert files.pinned_dates(spark).count() == 51
