"""Smoothing states of every origin in DuckDB: a recursion over the months for each series and parameter row."""

from __future__ import annotations

from panelspark.operators.smoothing import FORM, FREE, LEAST_SSE, PARAMS
from panelspark.plans.ctes import KEY, W, register

MINTRAIN = "CASE \"table\" WHEN 'FAD' THEN 36 ELSE 24 END"


def _number(x: float) -> str:
    """A literal that DuckDB reads as a double, not as a decimal."""
    return f"{float(x):.17e}"


_ROWS = ", ".join(
    f"({i}, {form}, {', '.join(_number(x) for x in row)})" for i, (row, form) in enumerate(zip(PARAMS.tolist(), FORM.tolist(), strict=True))
)
register("params", (), f"SELECT * FROM (VALUES {_ROWS}) t(i, form, a, b, phi, trend)")
_FREE = f"[{', '.join(map(str, FREE.tolist()))}]"


def _paths(level: str) -> str:
    return f"""
    SELECT s, {KEY}, first, t, i, form, phi, level, slope, sse FROM (
      WITH RECURSIVE path AS (
        SELECT s, {KEY}, v, n, first, i, form, a, b, phi, 1 AS t, v[1] AS level, trend * coalesce(v[2] - v[1], 0) AS slope, CAST(0 AS DOUBLE) AS sse
        FROM (SELECT row_number() OVER () AS s, {KEY}, list(level ORDER BY pos) AS v, max(n_grid) AS n, {MINTRAIN} AS first FROM {level} GROUP BY {KEY}), params
        WHERE n >= first
        UNION ALL
        SELECT s, {KEY}, v, n, first, i, form, a, b, phi, t + 1, ahead + a * e, phi * slope + a * b * e, sse + CASE WHEN t >= 2 THEN e * e ELSE 0 END
        FROM (SELECT *, v[t + 1] - ahead AS e FROM (SELECT *, level + phi * slope AS ahead FROM path WHERE t < n)))
      SELECT * FROM path WHERE t >= first)"""


def _origins(level: str, paths: str) -> str:
    penalty = "2.0 * k + 2.0 * k * (k + 1) / greatest(m - k - 1, 1)"
    return f"""
    SELECT {KEY}, CAST(e.t AS BIGINT) AS pos, e.pick.level AS ets_level, e.pick.slope AS ets_slope, e.pick.phi AS ets_phi, p.level AS theta_level, q.half AS theta_slope
    FROM (SELECT s, any_value(country) AS country, any_value(block) AS block, any_value(category) AS category, any_value("table") AS "table", t,
            arg_min({{'level': level, 'slope': slope, 'phi': phi}}, (sse, i)) AS pick
          FROM {paths} JOIN (SELECT s, arg_min(form, (m * ln(least_sse / m) + {penalty}, form)) AS form FROM (
              SELECT s, form, greatest(min(sse), {_number(LEAST_SSE)}) AS least_sse, greatest(any_value(first) - 2, 1) AS m, {_FREE}[form + 1] AS k
              FROM {paths} WHERE t = first GROUP BY s, form) GROUP BY s) USING (s, form) GROUP BY s, t) e
    JOIN (SELECT s, t, arg_min(level, (sse, i)) AS level FROM {paths} WHERE form = 0 GROUP BY s, t) p USING (s, t)
    JOIN (SELECT {KEY}, pos, CASE WHEN det > 0 THEN 0.5 * (pos * sxy - sx * sy) / det ELSE 0 END AS half FROM (
        SELECT *, pos * sxx - sx * sx AS det FROM (
          SELECT {KEY}, pos, sum(CAST(pos - 1 AS DOUBLE)) OVER ({W}) AS sx, sum(CAST(pos - 1 AS DOUBLE) * (pos - 1)) OVER ({W}) AS sxx,
            sum(level) OVER ({W}) AS sy, sum((pos - 1) * level) OVER ({W}) AS sxy FROM {level}))) q
      USING ({KEY}) WHERE q.pos = e.t"""


for _level, _paths_name, _name in (("lev", "paths", "states"), ("slev", "spaths", "sstates")):
    register(_paths_name, (_level, "params"), _paths(_level))
    register(_name, (_level, _paths_name), _origins(_level, _paths_name))


def ahead(alias: str, h: str) -> dict[str, str]:
    """Both forecasts ``h`` months after the origin whose states ``alias`` has."""
    a = f"{alias}." if alias else ""
    growth = f"CASE WHEN {a}ets_phi = 1 THEN {h} WHEN {a}ets_phi = 0 THEN 0 ELSE {a}ets_phi * (1 - pow({a}ets_phi, {h})) / (1 - {a}ets_phi) END"
    return {"ets": f"{a}ets_level + {a}ets_slope * {growth}", "theta": f"{a}theta_level + {a}theta_slope * {h}"}
