"""SQL text of the stand-in views, for side-by-side checks."""

from __future__ import annotations

from faultspark.plans.fixtures import EVENT_TYPES

SIG = """sig0 AS (
  SELECT l_suppkey AS rec,
         CAST(row_number() OVER (PARTITION BY l_suppkey
              ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS INTEGER) AS n,
         l_quantity / 25.0::DOUBLE - 1 AS ia, l_extendedprice / 50000.0::DOUBLE - 1 AS ib,
         l_discount * 20.0::DOUBLE - 1 AS ic, l_tax * 25.0::DOUBLE - 1 AS va
  FROM lineitem),
sig AS (SELECT *, ia * ic AS vb, ib * va AS vc FROM sig0)"""

LINE_PARAMS = """lp AS (
  SELECT s_suppkey AS rec,
         (1.0::DOUBLE + (s_suppkey % 7) * 0.5::DOUBLE) AS length_km,
         0.05::DOUBLE + abs(s_acctbal) / 100000.0::DOUBLE AS r1_km, 0.25::DOUBLE + s_nationkey / 100.0::DOUBLE AS x1_km,
         0.15::DOUBLE + abs(s_acctbal) / 50000.0::DOUBLE AS r0_km, 0.8::DOUBLE + s_nationkey / 50.0::DOUBLE AS x0_km
  FROM supplier),
lpt AS (SELECT rec, length_km, r1_km * length_km AS z1r, x1_km * length_km AS z1x,
               r0_km * length_km AS z0r, x0_km * length_km AS z0x FROM lp)"""

_types = ", ".join(f"'{t}'" for t in EVENT_TYPES)
EPISODES = f"""eps AS (
  SELECT s_suppkey AS sim_idx,
         CASE WHEN s_suppkey % 17 = 16 THEN 'load_step' ELSE ([{_types}])[(s_suppkey % 9) + 1] END AS etype,
         1.0::DOUBLE + (200 + (s_suppkey % 50) * 4 + s_suppkey % 3) / 800.0::DOUBLE + 0.0001::DOUBLE AS event_start,
         CASE WHEN s_suppkey % 19 = 18 THEN 'MainBus3'
              ELSE 'MainLn' || (s_suppkey % 4 + 1) || '-' || (s_suppkey % 5 + 10) || (['', 'A', 'B'])[(s_suppkey % 3) + 1] END AS target,
         CASE WHEN s_suppkey % 23 != 22 THEN (s_suppkey % 99 + 1) * 1.0::DOUBLE END AS location,
         s_nationkey * 2.0::DOUBLE AS r_f,
         (['A', 'B', 'C'])[(s_suppkey % 3) + 1] AS ph1, (['AB', 'BC', 'CA'])[(s_suppkey % 3) + 1] AS ph2,
         CASE WHEN s_suppkey % 9 IN (5, 6) THEN 0.005::DOUBLE + (s_suppkey % 4) * 0.005::DOUBLE END AS duration
  FROM supplier)"""

PRED = """pred AS (
  SELECT l_linestatus AS grid, l_orderkey AS sim_idx, CAST(w AS INTEGER) AS win, w * 5.0::DOUBLE AS post_ms,
         CASE l_returnflag WHEN 'A' THEN 'flt_1phg_incipient' WHEN 'R' THEN 'flt_1phg_hif' ELSE 'flt_2ph_shc' END AS etype,
         l_suppkey AS line, l_quantity AS length_km, l_quantity - 1.0::DOUBLE AS r_f, l_extendedprice / 1000.0::DOUBLE - 1 AS rho,
         l_discount * 10.0::DOUBLE + 0.0 AS y,
         CASE WHEN l_partkey % 10 != 0 THEN (l_quantity - 1) / 49.0::DOUBLE END AS est,
         l_tax * 12.5::DOUBLE + 0.0 AS est2
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
               ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS w FROM lineitem))"""


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views)


def err(est: str, y: str = "y") -> str:
    return f"100 * abs(greatest(0, least(1, coalesce({est}, 0.5))) - {y})"


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"
