"""Every query with SQL gives the SQL's rows on the smallest tables; the others give rows with a stable schema."""

import datetime as dt
import math

import duckdb
import pytest

from tapewright.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()
QUICK = ["bars_daily", "bar_coercion", "volume_analytics", "returns", "ema", "atr", "valuation_ranks", "deciles", "asof_strict", "reaction_sessions", "blackout", "tom_study", "history_dedupe", "form4_merge", "set_operations", "signals_top3", "hourly_bars", "scalar_rules", "screen_basic", "upcoming", "payload_series", "claims_event", "grades_event", "claims_regime", "grades_regime", "grades_book", "scoreboard_kinds", "registry_log", "performance_matched", "performance_ewma", "meeting_cells", "target_labels", "number_formats", "rank_sentences", "population_members", "filing_cache", "upcoming_macro", "damped_forecast", "macro_movers", "pead_battery", "insider_split", "crash_assessment"]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = catalog.queries()[name](spark, sf)
    got = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(r[names.index(c)]) for c in df.columns) for r in got.fetchall()), key=repr)
    assert sorted((tuple(plain(x) for x in r) for r in df.collect()), key=repr) == want


def test_each_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
