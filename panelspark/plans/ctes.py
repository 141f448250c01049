"""DuckDB building blocks of the oracle queries. ``sql(body, *names)`` prepends what a body needs."""

from __future__ import annotations

_LEVEL = (
    "30 * (date_diff('month', DATE '1975-01-01', bulletin_date) - k % 12) - CASE WHEN k % 97 = 0 THEN 3300 ELSE 0 END"
)
_KEYED = """
  SELECT CASE WHEN n_nationkey = 0 THEN 'all_chargeability' ELSE lower(n_name) END AS country,
         CASE WHEN c_mktsegment IN ('HOUSEHOLD','FURNITURE') THEN 'family' ELSE 'employment' END AS block,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'EB1' WHEN 'BUILDING' THEN 'EB2' WHEN 'MACHINERY' THEN 'EB4_RW'
              WHEN 'HOUSEHOLD' THEN 'F1' ELSE 'F2A' END AS category,
         CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'FAD' ELSE 'DFF' END AS "table",
         CAST(date_trunc('month', o_orderdate) AS DATE) AS bulletin_date,
         o_orderpriority, o_orderkey, o_orderstatus, replace(lower(r_name), ' ', '_') AS region
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
       JOIN region ON r_regionkey = n_regionkey"""
_STATUS = """CASE WHEN st <> 'P' THEN 'F' WHEN k % 7 = 0 THEN 'U' WHEN k % 13 = 5 THEN 'UNK' ELSE 'C' END"""
_RAW = """CASE WHEN st <> 'P' THEN upper(strftime(pdate, '%d%b%y')) WHEN k % 7 = 0 THEN 'U*'
          WHEN k % 13 = 5 THEN 'NA' ELSE 'C' END"""
_LABEL = """CASE category WHEN 'EB1' THEN CASE WHEN k % 2 = 1 THEN '1st*' ELSE ' 1st' END
       WHEN 'EB2' THEN CASE WHEN k % 2 = 1 THEN '2ND' ELSE '2nd' END
       WHEN 'EB4_RW' THEN CASE WHEN k % 2 = 1 THEN 'Certain Religiuos  Workers' ELSE 'Certain Religious Workers' END
       WHEN 'F1' THEN CASE WHEN k % 2 = 1 THEN 'F1*' ELSE '1st' END
       ELSE CASE WHEN k % 2 = 1 THEN '2nd-A' ELSE '2A*' END END"""


def _panel(cells: str, extra: str = "") -> str:
    return f"""
  SELECT country, block, category, "table", bulletin_date, {_STATUS} AS status,
         CASE WHEN st <> 'P' THEN pdate END AS priority_date,
         CASE WHEN st <> 'P' THEN y0 END AS days_since_base, {_RAW} AS raw_value, {_LABEL} AS raw_category, k{extra}
  FROM (SELECT *, CAST({_LEVEL} AS INTEGER) AS y0, DATE '1975-01-01' + CAST({_LEVEL} AS INTEGER) AS pdate FROM {cells})"""


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "cells": (
        (),
        f"SELECT country, block, category, \"table\", bulletin_date, min(o_orderkey) AS k, "
        f"arg_max(o_orderstatus, o_orderkey) AS st FROM ({_KEYED}) GROUP BY ALL",
    ),
    "panel": (("cells",), _panel("cells")),
    "fine_cells": (
        (),
        f"SELECT country, block, category, \"table\", bulletin_date, o_orderpriority, min(o_orderkey) AS k, "
        f"arg_max(o_orderstatus, o_orderkey) AS st FROM ({_KEYED}) GROUP BY ALL",
    ),
    "fine": (("fine_cells",), _panel("fine_cells", ", o_orderpriority")),
    "region_cells": (
        (),
        f"SELECT region AS country, block, category, \"table\", bulletin_date, min(o_orderkey) AS k, "
        f"arg_max(o_orderstatus, o_orderkey) AS st FROM ({_KEYED}) GROUP BY ALL",
    ),
    "rpanel": (("region_cells",), _panel("region_cells")),
    "fr": (
        ("rpanel",),
        """SELECT country, block, category, "table", bulletin_date AS m, CAST(days_since_base AS DOUBLE) AS y
           FROM rpanel WHERE status = 'F'""",
    ),
    "rank_cells": (
        (),
        """SELECT CASE r_name WHEN 'AMERICA' THEN 'north_america' WHEN 'MIDDLE EAST' THEN 'oceania' ELSE lower(r_name) END AS region,
                  CAST(date_trunc('month', o_orderdate) AS DATE) AS bulletin_date, min(o_orderkey) AS k
           FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
                JOIN region ON r_regionkey = n_regionkey GROUP BY ALL""",
    ),
    "ranks": (
        ("rank_cells",),
        """SELECT region, bulletin_date, CASE k % 9 WHEN 0 THEN 'C' WHEN 1 THEN 'U' WHEN 2 THEN 'UNK' ELSE 'F' END AS status,
                  CASE WHEN k % 9 > 2 THEN CAST(1000 + k % 90000 AS INTEGER) END AS rank_cutoff,
                  CASE k % 9 WHEN 0 THEN 'Current' WHEN 1 THEN 'Unavailable' WHEN 2 THEN ''
                       WHEN 3 THEN 'AF  ' || format('{:,}', 1000 + k % 90000) || '  Except: Egypt 30,000'
                       ELSE format('{:,}', 1000 + k % 90000) END AS raw_value,
                  CASE k % 4 WHEN 0 THEN 'Except: Egypt' WHEN 2 THEN 'Except: Nigeria' ELSE '' END AS exceptions FROM rank_cells""",
    ),
    "sup_cells": (
        (),
        """SELECT l_suppkey, l_returnflag, l_linestatus, CAST(date_trunc('month', l_shipdate) AS DATE) AS bulletin_date,
                  min(l_orderkey) AS k FROM lineitem GROUP BY ALL""",
    ),
    "sup": (
        ("sup_cells",),
        f"""SELECT CASE WHEN l_suppkey = 0 THEN 'all_chargeability' ELSE 's' || l_suppkey END AS country,
       CASE WHEN l_returnflag = 'N' THEN 'family' ELSE 'employment' END AS block,
       CASE l_returnflag WHEN 'N' THEN 'F1' WHEN 'A' THEN 'EB1' ELSE 'EB2' END AS category,
       CASE WHEN l_linestatus = 'F' THEN 'FAD' ELSE 'DFF' END AS "table", bulletin_date,
       CASE WHEN k % 35 = 0 THEN 'U' WHEN k % 5 = 0 THEN 'C' ELSE 'F' END AS status,
       CASE WHEN k % 5 <> 0 THEN DATE '1975-01-01' + CAST({_LEVEL} AS INTEGER) END AS priority_date,
       CASE WHEN k % 5 <> 0 THEN CAST({_LEVEL} AS INTEGER) END AS days_since_base
  FROM sup_cells""",
    ),
    # Observed rows (regime F) of either panel, with the target as a double.
    "f": (
        ("panel",),
        """SELECT country, block, category, "table", bulletin_date AS m, CAST(days_since_base AS DOUBLE) AS y
           FROM panel WHERE status = 'F'""",
    ),
    "fs": (
        ("sup",),
        """SELECT country, block, category, "table", bulletin_date AS m, CAST(days_since_base AS DOUBLE) AS y
           FROM sup WHERE status = 'F'""",
    ),
}


def _grid(name: str) -> str:
    return f"""SELECT g.country, g.block, g.category, g."table", g.m, o.y
  FROM (SELECT country, block, category, "table",
               CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS m
        FROM (SELECT country, block, category, "table", min(m) AS lo, max(m) AS hi FROM {name} GROUP BY ALL)) g
  LEFT JOIN {name} o USING (country, block, category, "table", m)"""


def _level(name: str) -> str:
    return f"""SELECT country, block, category, "table", m, y, last_value(y IGNORE NULLS) OVER w AS level,
       row_number() OVER w AS pos, count(*) OVER (PARTITION BY country, block, category, "table") AS n_grid
  FROM {name} WINDOW w AS (PARTITION BY country, block, category, "table" ORDER BY m
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


for _f, _g, _l in (("f", "grid", "lev"), ("fs", "sgrid", "slev")):
    CTES[_g] = ((_f,), _grid(_f))
    CTES[_l] = ((_g,), _level(_g))

W = 'PARTITION BY country, block, category, "table" ORDER BY m'
KEY = 'country, block, category, "table"'


def register(name: str, needs: tuple[str, ...], body: str) -> None:
    if name in CTES:
        raise ValueError(f"duplicate cte {name}")
    CTES[name] = (needs, body)


def _resolve(names: tuple[str, ...], seen: list[str]) -> list[str]:
    for name in names:
        needs, _ = CTES[name]
        _resolve(needs, seen)
        if name not in seen:
            seen.append(name)
    return seen


def sql(body: str, *names: str) -> str:
    """``body`` with the CTEs ``names`` (and whatever they need) in front."""
    order = _resolve(names, [])
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order]
    head = "WITH " + ",\n".join(parts) + "\n" if parts else ""
    text = body.strip()
    if parts and text[:5].upper() == "WITH ":
        return head.rstrip() + ",\n" + text[5:]
    return head + text


def normal_tail(z: str) -> str:
    """Upper tail of the normal law for z >= 0, by its series."""
    term = f"exp((2 * k + 1) * ln({z}) - (lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1)))"
    series = f"0.5 - exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 160), lambda k: {term}))"
    return f"CASE WHEN {z} <= 0 THEN 0.5 WHEN {z} > 8 THEN 0 ELSE {series} END"


def signed_rank(source: str, by: str) -> str:
    """Two-sided signed-rank p-value of the column d of ``source`` in each group that has a difference."""
    return f"""SELECT {by}, CASE WHEN v <= 0 THEN 1 ELSE 2 * ({normal_tail("z")}) END AS p FROM (
        SELECT *, abs((wp - n * (n + 1) / 4.0) / nullif(sqrt(greatest(v, 0)), 0)) AS z FROM (
          SELECT {by}, n, wp, n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0 AS v FROM (
            SELECT {by}, CAST(count(*) AS DOUBLE) AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS wp, CAST(sum(t * t - 1) AS DOUBLE) AS ties FROM (
              SELECT *, rank() OVER (PARTITION BY {by} ORDER BY a) + (count(*) OVER (PARTITION BY {by}, a) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY {by}, a) AS t
              FROM (SELECT *, abs(round(d, 12)) AS a FROM {source}) WHERE a > 0) GROUP BY {by})))"""


def holm_sql(source: str, by: str, order: str) -> str:
    """Rows of ``source`` with the step-down p-values of its column p within ``by``."""
    rank = f"row_number() OVER (PARTITION BY {by} ORDER BY p, {order})"
    return f"""SELECT * EXCLUDE (_raw, _i), max(_raw) OVER (PARTITION BY {by} ORDER BY _i) AS holm_p FROM (
        SELECT *, {rank} AS _i, least(1.0, (count(*) OVER (PARTITION BY {by}) - {rank} + 1) * p) AS _raw FROM {source})"""
