"""Building blocks of the comparison SQL (DuckDB dialect)."""

from __future__ import annotations

from barloom.sources.derived import ROLES

_LINE = """SELECT l_returnflag || l_linestatus AS flag, l_partkey, CAST(l_shipdate AS DATE) AS ts, l_quantity,
  100 + l_extendedprice / 10000 AS px,
  (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem"""

_OHLC = ("min_by(px, k) AS open, max(px) AS high, min(px) AS low, max_by(px, k) AS close, "
         "sum(l_quantity) AS volume")

FLAG = f"bars AS (SELECT flag AS symbol, ts, {_OHLC} FROM ({_LINE}) GROUP BY flag, ts)"

BRAND = (f"bars AS (SELECT p_brand AS symbol, ts, {_OHLC} FROM ({_LINE}) JOIN part ON l_partkey = p_partkey "
         "GROUP BY p_brand, ts)")

HOUR = ("bars AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, min_by(value, (ts, event_id)) AS open, "
        "max(value) AS high, min(value) AS low, max_by(value, (ts, event_id)) AS close, "
        "CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY event_type, date_trunc('hour', ts))")

_NAMES = "[" + ", ".join(f"'{r}'" for r in ROLES) + "]"


def _scaled(c: str) -> str:
    return f"CASE WHEN symbol = 'VIXY' THEN 12 + 2 * ({c} - 100) ELSE {c} END AS {c}"


MARKET = (BRAND.replace("bars AS", "brand_bars AS", 1) +
          f", named AS (SELECT {_NAMES}[CAST(regexp_extract(symbol, '([0-9]+)$', 1) AS INT)] AS symbol, ts, "
          "open, high, low, close, volume FROM brand_bars), "
          "bars AS (SELECT symbol, ts, " + ", ".join(_scaled(c) for c in ("open", "high", "low", "close")) +
          ", volume FROM named)")

BY = "PARTITION BY symbol ORDER BY ts"


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    """Rounded output column; the + 0.0 turns -0.0 into 0.0."""
    return f"round({expr}, {digits}) + 0.0 AS {name or expr}"


def roll(agg: str, x: str, n: int, by: str = BY) -> str:
    """Rolling aggregate over n rows, NULL until n non-null values are there."""
    over = f"OVER ({by} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {over} = {n} THEN {agg} {over} END"


def ema(name: str, src: str, cols: dict[str, tuple[str, int]], key: str = "symbol", order: str = "ts",
        keep: str = "", start: int = 0) -> str:
    """CTEs ``name``: recursive EMAs (name -> (column, span)) seeded at row ``start``."""
    seed = ", ".join(f"CAST({x} AS DOUBLE) AS {n}" for n, (x, _) in cols.items())
    step = ", ".join(
        f"{2.0 / (s + 1.0)!r}::DOUBLE * n.{x} + {1.0 - 2.0 / (s + 1.0)!r}::DOUBLE * p.{n}" for n, (x, s) in cols.items())
    kept = "".join(f", {c}" for c in keep.split(",") if c)
    nkept = "".join(f", n.{c.strip()}" for c in keep.split(",") if c)
    return (f"{name}_n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) - 1 AS i FROM {src}), "
            f"{name} AS (SELECT {key}, {order}, i{kept}, {seed} FROM {name}_n WHERE i = {start} "
            f"UNION ALL SELECT n.{key}, n.{order}, n.i{nkept}, {step} FROM {name} p "
            f"JOIN {name}_n n ON n.{key} = p.{key} AND n.i = p.i + 1)")


def with_(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(c for c in ctes if c) + " "


PANEL = """cal AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS d FROM (SELECT DISTINCT ts FROM bars)),
span AS (SELECT symbol, min(ts) AS first_ts FROM bars GROUP BY symbol),
grid AS (SELECT s.symbol, c.ts, c.d FROM cal c JOIN span s ON c.ts >= s.first_ts),
panel AS (SELECT g.symbol, g.ts, g.d,
  last_value(b.open IGNORE NULLS) OVER w AS open, last_value(b.close IGNORE NULLS) OVER w AS close,
  last_value(b.volume IGNORE NULLS) OVER w AS volume
  FROM grid g LEFT JOIN bars b ON b.symbol = g.symbol AND b.ts = g.ts
  WINDOW w AS (PARTITION BY g.symbol ORDER BY g.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
