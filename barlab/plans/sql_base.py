"""SQL twins of the shared input tables, added to a query only where it names them."""

from __future__ import annotations

import re

from barlab.sources.fixtures import CORPORATE_ACTIONS, HOLIDAYS, IMPACT_PRICES

TABLES: dict[str, str] = {}


def table(name: str, sql: str) -> None:
    if name in TABLES:
        raise ValueError(f"table {name} is defined twice")
    TABLES[name] = sql


def with_tables(sql: str) -> str:
    """Prefix ``sql`` with the definitions it needs, in dependency order."""
    ordered: list[str] = []

    def visit(text: str, inside: tuple[str, ...]) -> None:
        for word in dict.fromkeys(re.findall(r"[a-z_][a-z0-9_]*", text)):
            if word in TABLES and word not in ordered and word not in inside:
                visit(TABLES[word], (*inside, word))
                if word not in ordered:
                    ordered.append(word)

    visit(sql, ())
    if not ordered:
        return sql
    recursive = {n for n in ordered if "/* recursive */" in TABLES[n]}
    ctes = ",\n".join(f"{n} AS {'' if n in recursive else 'MATERIALIZED '}({TABLES[n]})" for n in ordered)
    head = "WITH RECURSIVE" if recursive else "WITH"
    return f"{head} {ctes}\n{sql}"


def _rows(rows) -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else repr(v)

    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"

table("x_bars", f"""
  SELECT 'S' || CAST(l_suppkey % 8 AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date,
    first(l_extendedprice / l_quantity ORDER BY {_ORDER}) AS open,
    max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
    last(l_extendedprice / l_quantity ORDER BY {_ORDER}) AS close,
    CAST(sum(l_quantity) AS BIGINT) AS volume
  FROM lineitem GROUP BY 1, 2""")

table("x_ticks", """
  SELECT 'S' || CAST(user_id % 5 AS VARCHAR) AS symbol, date_trunc('hour', ts) AS bar, ts AS at_ts, event_id,
    event_type, value AS price FROM events""")

_BAR = """first(price ORDER BY at_ts, event_id) AS open, max(price) AS high, min(price) AS low,
    last(price ORDER BY at_ts, event_id) AS close, count(*) AS volume"""
_CLOCK = """bar AS ts, CAST(bar AS DATE) AS d, CAST(hour(bar) * 60 + minute(bar) AS INTEGER) AS t"""

table("x_hours", f"""
  SELECT symbol, {_CLOCK}, open, high, low, close, volume FROM (
    SELECT symbol, bar, {_BAR} FROM x_ticks GROUP BY symbol, bar)""")

table("x_bench", f"""
  SELECT benchmark_index, {_CLOCK}, open, high, low, close, volume FROM (
    SELECT benchmark_index, bar, {_BAR} FROM (
      SELECT event_type AS benchmark_index, * FROM x_ticks UNION ALL
      SELECT 'ALL' AS benchmark_index, * FROM x_ticks) GROUP BY benchmark_index, bar)""")

table("x_index_hours", "SELECT * FROM x_bench WHERE benchmark_index = 'ALL'")

table("x_session", f"""
  SELECT {_CLOCK}, open, high, low, close, volume FROM (
    SELECT date_trunc('day', o_orderdate) + to_minutes(60 * (9 + o_orderkey % 7) + 15) AS bar,
      arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
      arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume FROM orders GROUP BY 1)""")

table("x_index", """
  SELECT CAST(o_orderdate AS DATE) AS date, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
    min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume
  FROM orders GROUP BY 1""")

table("x_vix", """
  SELECT date, coalesce(lag(close) OVER (ORDER BY date), close) AS open,
    greatest(coalesce(lag(close) OVER (ORDER BY date), close), close) AS high,
    least(coalesce(lag(close) OVER (ORDER BY date), close), close) AS low, close
  FROM (SELECT CAST(o_orderdate AS DATE) AS date, stddev_samp(o_totalprice) / avg(o_totalprice) * 25 AS close
        FROM orders GROUP BY 1 HAVING count(*) >= 2)""")

table("x_lists", """
  SELECT benchmark_index, symbol FROM (
    SELECT benchmark_index, 'S' || CAST(i AS VARCHAR) AS symbol FROM x_sector_no
    UNION ALL SELECT benchmark_index, 'S' || CAST((i + 4) % 5 AS VARCHAR) FROM x_sector_no) WHERE symbol <> 'S4'""")

table("x_sector_no", """
  SELECT event_type AS benchmark_index, row_number() OVER (ORDER BY event_type) - 1 AS i
  FROM (SELECT DISTINCT event_type FROM events)""")

table("x_members", """
  SELECT symbol, benchmark_index, 'sector' AS membership_type
  FROM x_lists
  WHERE symbol IN (SELECT symbol FROM x_hours)
  UNION ALL SELECT DISTINCT symbol, 'ALL', 'broad' FROM x_hours""")

table("x_events", f"""
  SELECT CAST(o_orderdate AS DATE) AS date, o_orderstatus AS event_type,
    'order ' || CAST(o_orderkey AS VARCHAR) AS description,
    CASE WHEN o_totalprice >= {IMPACT_PRICES["high"]} THEN 'high' WHEN o_totalprice >= {IMPACT_PRICES["medium"]} THEN 'medium' ELSE 'low' END AS impact_level
  FROM orders WHERE o_orderpriority = '1-URGENT'""")

table("x_holidays", f"SELECT CAST(date AS DATE) AS date, holiday_name FROM (VALUES {_rows(HOLIDAYS)}) AS h(date, holiday_name)")

table("x_corp", f"""
  SELECT symbol, CAST(ex_date AS DATE) AS ex_date, action_type, ratio
  FROM (VALUES {_rows(CORPORATE_ACTIONS)}) AS c(symbol, ex_date, action_type, ratio)""")
