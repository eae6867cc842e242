"""The base views in DuckDB SQL, as prefixes of the queries' SQL."""

from __future__ import annotations

BARS = """
px AS (SELECT p_brand AS symbol, l_shipdate::DATE AS date, l_extendedprice / l_quantity AS px, l_quantity AS q,
              l_orderkey a, l_linenumber b, l_partkey c, l_suppkey d, l_extendedprice e FROM lineitem JOIN part ON l_partkey = p_partkey),
bars AS MATERIALIZED (SELECT symbol, date, first(px ORDER BY a, b, c, d, e, q) AS open, max(px) AS high, min(px) AS low, last(px ORDER BY a, b, c, d, e, q) AS close, sum(q) AS volume
         FROM px GROUP BY symbol, date),
s AS MATERIALIZED (SELECT *, row_number() OVER w - 1 AS i, close - lag(close) OVER w AS d, CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close / lag(close) OVER w) END AS r
      FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date))"""

_MEASURES = """
SELECT {key}, k, CASE WHEN k % 12 = 0 THEN 'ETF' ELSE 'EQUITY' END AS quote_type, e AS market_cap, pe AS trailing_pe,
  pe * (0.8::DOUBLE + 0.05::DOUBLE * (k % 9)) AS forward_pe, 1.0::DOUBLE + (k % 13) * 0.37::DOUBLE AS price_to_book,
  CASE WHEN k % 19 <> 0 THEN 0.5::DOUBLE + (k % 17) * 0.21::DOUBLE END AS price_to_sales,
  CASE WHEN k % 6 <> 0 THEN CASE WHEN k % 10 = 7 THEN -1.0::DOUBLE ELSE 4.0::DOUBLE + (k * 37 % 23) * 0.9::DOUBLE + d * 10.0::DOUBLE END END AS ev_ebitda,
  e * (t - 0.01::DOUBLE * (k % 5)) AS free_cashflow, CASE WHEN k % 8 <> 1 THEN e * (t - 0.01::DOUBLE) END AS operating_cashflow,
  (k * 41 % 29) * 0.01::DOUBLE + d - 0.1::DOUBLE AS return_on_equity,
  CASE WHEN k % 14 <> 2 THEN (k * 17 % 19) * 0.005::DOUBLE + t - 0.05::DOUBLE END AS return_on_assets,
  CASE WHEN k % 9 <> 4 THEN (k * 13 % 27) * 0.11::DOUBLE + d END AS debt_to_equity,
  (k * 7 % 37) * 0.01::DOUBLE + t - 0.08::DOUBLE AS operating_margin, 0.01::DOUBLE * (k % 6) AS dividend_yield, 0.6::DOUBLE + 0.05::DOUBLE * (k % 15) AS beta, sector
FROM (SELECT *, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 11 = 3 THEN -5.0::DOUBLE ELSE 5.0::DOUBLE + (k * 29 % 31) * 0.7::DOUBLE + d * 20.0::DOUBLE END AS pe
      FROM ({groups}))"""

FUNDAMENTALS = (
    "f AS MATERIALIZED ("
    + _MEASURES.format(
        key="symbol",
        groups="""SELECT g.*, r_name AS sector FROM (SELECT p_brand AS symbol, substr(p_brand, 7, 2)::INT AS k, round(sum(l_extendedprice), 2) AS e, round(avg(l_discount), 8) AS d, round(avg(l_tax), 8) AS t
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand) g LEFT JOIN region ON k // 10 - 1 = r_regionkey""",
    )
    + ")"
)

POPULATION = (
    "m0 AS MATERIALIZED ("
    + _MEASURES.format(
        key="suppkey",
        groups="""SELECT g.*, r_name AS sector FROM (SELECT l_suppkey AS suppkey, l_suppkey::INT AS k, round(sum(l_extendedprice), 2) AS e, round(avg(l_discount), 8) AS d, round(avg(l_tax), 8) AS t
        FROM lineitem GROUP BY l_suppkey) g JOIN supplier ON suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    )
    + """),
pop AS MATERIALIZED (SELECT 'S' || suppkey AS symbol, sector, CASE WHEN k % 16 <> 5 THEN (k * 53 % 97) * 0.01::DOUBLE - 0.4::DOUBLE END AS momentum,
  CASE WHEN ev_ebitda > 0 THEN 1 / ev_ebitda END AS ebitda_yield,
  CASE WHEN operating_cashflow IS NULL OR free_cashflow <= operating_cashflow THEN free_cashflow / nullif(market_cap, 0) END AS fcf_yield,
  CASE WHEN trailing_pe > 0 THEN 1 / trailing_pe END AS earnings_yield, return_on_equity AS roe, return_on_assets AS roa, operating_margin, -debt_to_equity AS low_leverage FROM m0)"""
)

ANNOUNCEMENTS = """
ann AS MATERIALIZED (SELECT symbol, strftime(day, '%Y-%m-%d') || CASE WHEN key % 2 = 1 THEN 'T16:30:00-05:00' ELSE 'T06:00:00-05:00' END AS stamp, day, key % 2 = 1 AS late
  FROM (SELECT p_brand AS symbol, date_trunc('quarter', o_orderdate) AS qt, min(o_orderdate::DATE) AS day, arg_min(o_orderkey, (o_orderdate::DATE, o_orderkey)) AS key
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2))"""

FILINGS = """
fil AS MATERIALIZED (SELECT p_brand AS symbol, o_orderdate::DATE AS filed, o_custkey AS owner, CASE WHEN o_orderstatus = 'O' THEN 'P' ELSE 'S' END AS side, o_orderkey AS accession,
  sum(l_extendedprice) AS dollars, o_orderkey % 3 = 0 AS plan FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""

HOLDINGS = """
h AS (SELECT DISTINCT p_brand AS symbol, substr(p_brand, 7, 2)::INT / 400.0::DOUBLE AS exposure, 'position' AS kind FROM part WHERE substr(p_brand, 7, 2)::INT % 3 = 0 UNION ALL SELECT 'CASH', 0.15::DOUBLE, 'cash')"""

#: Momentum on every bar.
MOMENTUM = """
mom AS (SELECT symbol, date, i, lag(close, 21) OVER w / nullif(lag(close, 252) OVER w, 0) - 1 AS mom_12_1, lag(close, 21) OVER w / nullif(lag(close, 126) OVER w, 0) - 1 AS mom_6_1,
  lag(close, 21) OVER w / nullif(lag(close, 63) OVER w, 0) - 1 AS mom_3_1, close / nullif(lag(close, 21) OVER w, 0) - 1 AS ret_1m, close FROM s WINDOW w AS (PARTITION BY symbol ORDER BY date))"""

#: Volatility by exponential weights: the seed, then one step a row.
VOL = """
vol AS MATERIALIZED (
  WITH RECURSIVE go(symbol, i, var) AS (
    SELECT symbol, 60, var_samp(r) FROM s WHERE i BETWEEN 1 AND 60 GROUP BY symbol HAVING count(r) = 60
    UNION ALL SELECT s.symbol, s.i::INT, 0.94::DOUBLE * var + (1 - 0.94::DOUBLE) * s.r * s.r FROM go JOIN s ON s.symbol = go.symbol AND s.i = go.i + 1)
  SELECT s.*, sqrt(go.var) AS vol FROM s LEFT JOIN go USING (symbol, i))"""


def sql(*parts: str, body: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" + body
