"""Vintages, bands, coherence, ledger identity and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.config import ACI_MIN_HITS, QUANTILE_LEVELS, SERIES
from panelspark.operators import forecast as FC
from panelspark.operators import governance as G
from panelspark.operators import intervals as IV
from panelspark.operators import ledger as L
from panelspark.operators import metrics as ME
from panelspark.operators import smoothing as SM
from panelspark.operators import vintage as V
from panelspark.plans.challengers import challengers
from panelspark.plans.ctes import KEY, W, register, sql
from panelspark.plans.evaluation import MINTRAIN
from panelspark.plans.protocol import SHORT, obs, r6, settle, settle_sql
from panelspark.plans.registry import query
from panelspark.plans.states import ahead
from panelspark.session import stage

# The deployed recipe; the shadow follows the best challenger of each table.
CHAMPION = V.recipes(SM.CANDIDATES, "median")
CALIBRATION_END = "2001-01"


def monthly_origins(o):
    """Every panel month is a vintage; early months drop out for lack of history."""
    return o.select("bulletin_date").distinct()


def vintage_rows(o, recipe=CHAMPION, coherent=True, scales=None):
    return V.vintages(o, monthly_origins(o), recipe, SHORT, scales, coherent=coherent)


def stamped(rows, recipe=CHAMPION):
    return L.stamp(
        rows,
        F.concat(V.recipe_label(recipe), F.lit("@"), F.col("table")),
        F.col("origin"),
        "2001-12-01T00:00:00+00:00",
        backfill=F.col("origin") < CALIBRATION_END,
    )


def observed_once(spark, sf):
    """The observed panel, written: origins, grid, actuals and scales all read it."""
    return stage(obs(spark, sf), "observed")


def ledger_of(o, recipe=CHAMPION):
    return stamped(vintage_rows(o, recipe), recipe)


def ledger(spark, sf, recipe=CHAMPION):
    return ledger_of(observed_once(spark, sf), recipe)


def score_of(o, recipe=CHAMPION):
    return L.scorecard(ledger_of(o, recipe), o)


def shadow_recipes(spark, sf):
    return V.challenger_recipes(G.best_challenger(challengers(spark, sf), ["table"]))


def score(spark, sf, recipe=CHAMPION):
    return score_of(observed_once(spark, sf), recipe)


_AHEAD = ahead("", "h")
register(
    "ens",
    ("slev", "sstates", "best"),
    f"""SELECT *, CASE WHEN seasonal IS NOT NULL AND ets IS NOT NULL THEN abs(y - list_sort([naive1, seasonal, drift, ets, theta])[3]) END AS r,
               abs(y - CASE challenger WHEN 'naive1' THEN naive1 WHEN 'seasonal' THEN seasonal WHEN 'drift' THEN drift WHEN 'ets' THEN ets ELSE theta END) AS r2 FROM (
          SELECT {KEY}, m, y, level, pos, n_grid, first_value(level) OVER ({W}) AS fst, lag(level) OVER ({W}) AS naive1,
            lag(level, 12) OVER ({W}) AS seasonal, ets_level, ets_slope, ets_phi, theta_level, theta_slope,
            lag(level) OVER ({W}) + (lag(level) OVER ({W}) - first_value(level) OVER ({W})) / nullif(pos - 2, 0) AS drift,
            lag({_AHEAD["ets"]}) OVER ({W}) AS ets, lag({_AHEAD["theta"]}) OVER ({W}) AS theta
          FROM (SELECT *, 1 AS h FROM slev LEFT JOIN sstates USING ({KEY}, pos))) LEFT JOIN best USING ("table")""",
)


def _vint(resid: str, point: str, source: str = "ens", level: str = "0.95", origins: str = "TRUE") -> str:
    return f"""
    SELECT strftime(m, '%Y-%m') AS origin, {KEY}, h, CAST(m + to_months(h) AS DATE) AS date, {point} AS point,
           errs[CAST(ceil(round(least(1.0, ceil(round((len(errs) + 1) * {level}, 9)) / len(errs)) * (len(errs) - 1), 9)) AS BIGINT) + 1] AS half
    FROM (SELECT *, list_sort(list({resid}) FILTER ({resid} IS NOT NULL) OVER ({W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)) AS errs,
                 list(level) OVER ({W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS yr FROM {source}),
         (SELECT CAST(unnest(generate_series(1, 12)) AS INTEGER) AS h)
    WHERE pos >= {MINTRAIN} + 30 AND len(errs) > 0 AND {origins}"""


_DRIFT = "level + h * (level - fst) / (pos - 1)"
_MEDIAN = f"list_sort([level, yr[(h - 1) % 12 + 1], {_DRIFT}, {_AHEAD['ets']}, {_AHEAD['theta']}])[3]"
register("vpoint", ("ens",), _vint("r", _MEDIAN))
_SHADOW = f"""CASE challenger WHEN 'naive1' THEN level WHEN 'seasonal' THEN yr[(h - 1) % 12 + 1] WHEN 'drift' THEN {_DRIFT}
  WHEN 'ets' THEN {_AHEAD["ets"]} ELSE {_AHEAD["theta"]} END"""
register("vpoint2", ("ens",), _vint("r2", _SHADOW))

_INT = "CAST(round_even(round({}, 6), 0) AS INTEGER)"


def _banded(src: str, h80: str, h95: str, method: str) -> str:
    cols = {
        "days": "point", "lo80": f"point - {h80}", "hi80": f"point + {h80}", "lo95": f"point - {h95}", "hi95": f"point + {h95}",
    }
    return f"SELECT origin, {KEY}, h, date, {method} AS band_method, " + ", ".join(
        f"{_INT.format(v)} AS {k}" for k, v in cols.items()
    ) + f" FROM {src}"


def _cone(src: str) -> tuple[str, str]:
    shift = ", ".join(f"{c} + nd - days AS {c}" for c in IV.BANDS)
    capped = f"""SELECT * REPLACE (nd AS days, {", ".join(f"{c} + nd - days AS {c}" for c in IV.BANDS)}) FROM (
        SELECT a.*, coalesce(a.country <> 'all_chargeability' AND a.days > b.days, false) AS capped,
               CASE WHEN a.country <> 'all_chargeability' AND a.days > b.days THEN b.days ELSE a.days END AS nd
        FROM {src} a LEFT JOIN {src} b ON b.country = 'all_chargeability' AND b.origin = a.origin AND b.block = a.block
          AND b.category = a.category AND b."table" = a."table" AND b.date = a.date)"""
    capped = capped.replace("SELECT * REPLACE", "SELECT * EXCLUDE (nd) REPLACE")
    swapped = f"""SELECT * EXCLUDE (nd) REPLACE (nd AS days, {shift}) FROM (
        SELECT a.*, coalesce(CASE "table" WHEN 'FAD' THEN a.days > o.odays ELSE o.odays > a.days END, false) AS swapped,
               CASE WHEN (CASE "table" WHEN 'FAD' THEN a.days > o.odays ELSE o.odays > a.days END) THEN o.odays ELSE a.days END AS nd
        FROM {src}_cap a LEFT JOIN (SELECT origin, country, block, category, date, days AS odays,
              CASE "table" WHEN 'FAD' THEN 'DFF' ELSE 'FAD' END AS "table" FROM {src}_cap) o
          USING (origin, country, block, category, "table", date))"""
    return capped, swapped


_GROW80, _GROW95 = "half * 0.4744 * sqrt(h)", "half * sqrt(h)"
for _src, _name in (("vpoint", "vrows"), ("vpoint2", "vrows2")):
    register(_name, (_src,), _banded(_src, _GROW80, _GROW95, "'sqrt_h'"))
    _cap, _swap = _cone(_name)
    register(f"{_name}_cap", (_name,), _cap)
    register(f"{_name}_cone", (f"{_name}_cap",), _swap)


def _stamped(cone: str, label: str) -> str:
    key = "concat_ws('|', origin, country, category, \"table\", CAST(date AS VARCHAR), model_version)"
    return f"""SELECT *, substr(sha1({key}), 1, 12) AS forecast_id, substr(sha1(concat_ws('|', h, days, lo80, hi80, lo95, hi95)), 1, 12) AS row_hash
      FROM (SELECT *, {label} || '@' || "table" AS model_version,
              CASE WHEN origin >= '{CALIBRATION_END}' AND strftime(date, '%Y-%m') > origin THEN 'live' ELSE 'backfill' END AS evaluation_mode
            FROM {cone})"""


register("led", ("vrows_cone",), _stamped("vrows_cone", f"'{CHAMPION[0].label}'"))
register("led2", ("vrows2_cone", "best"), _stamped("vrows2_cone", '(SELECT challenger FROM best WHERE best."table" = vrows2_cone."table")'))


def _scored(led: str) -> str:
    return f"""SELECT l.origin, l.h, l.country, l.block, l.category, l."table", l.date AS target, CAST(l.days AS DOUBLE) AS pred, o.y AS actual,
          l.days - o.y AS error, abs(l.days - o.y) AS abs_err, abs(l.days - o.y) / s.scale AS scaled_err,
          CAST(o.y BETWEEN l.lo80 AND l.hi80 AS INTEGER) AS in80, CAST(o.y BETWEEN l.lo95 AND l.hi95 AS INTEGER) AS in95,
          l.evaluation_mode, l.model_version, l.lo95, l.hi95
        FROM {led} l JOIN fs o ON o.country = l.country AND o.block = l.block AND o.category = l.category AND o."table" = l."table" AND o.m = l.date
        LEFT JOIN oscale s ON s.country = l.country AND s.block = l.block AND s.category = l.category AND s."table" = l."table" AND s.origin = l.origin"""


register(
    "oscale",
    ("sdiffs", "led"),
    f"""SELECT c.country, c.block, c.category, c."table", c.origin, nullif(CASE WHEN count(d.m) > 12 THEN avg(dm) ELSE avg(d1) END, 0) AS scale
        FROM (SELECT DISTINCT {KEY}, origin FROM led) c JOIN sdiffs d ON d.country = c.country AND d.block = c.block
          AND d.category = c.category AND d."table" = c."table" AND strftime(d.m, '%Y-%m') <= c.origin GROUP BY ALL""",
)
register("score", ("led", "oscale", "fs"), _scored("led"))
register("score2", ("led2", "oscale", "fs"), _scored("led2"))

VCOLS = f"origin, {KEY}, h, date, band_method, days, lo80, hi80, lo95, hi95"
VNAMES = ["origin", *SERIES, "h", "date", "band_method", "days", "lo80", "hi80", "lo95", "hi95"]


@query("forecast_vintages", "E23 E19", sql(f"SELECT {VCOLS} FROM vrows", "vrows"))
def _vintages(spark, sf):
    return vintage_rows(observed_once(spark, sf), coherent=False).select(*VNAMES)


@query("coherent_vintages", "C1 E23", sql(f"SELECT {VCOLS}, capped, swapped FROM vrows_cone", "vrows_cone"))
def _coherent(spark, sf):
    return vintage_rows(observed_once(spark, sf)).select(*VNAMES, "capped", "swapped")


@query("shadow_vintages", "E24", sql(f"SELECT {VCOLS} FROM vrows2_cone", "vrows2_cone"))
def _shadow(spark, sf):
    return vintage_rows(observed_once(spark, sf), shadow_recipes(spark, sf)).select(*VNAMES)


@query(
    "cone_violations",
    "C1",
    sql(
        """SELECT 'area_le_world' AS "constraint", count(*) FILTER (capped) AS n FROM vrows_cap
           UNION ALL SELECT 'fad_le_dff', count(*) FROM vrows a JOIN vrows b USING (origin, country, block, category, date)
             WHERE a."table" = 'FAD' AND b."table" = 'DFF' AND a.days > b.days""",
        "vrows_cap",
    ),
)
def _violations(spark, sf):
    return IV.cone_violations(stage(vintage_rows(observed_once(spark, sf), coherent=False), "vintages"), ["origin"])


@query(
    "stamped_ledger",
    "G15",
    sql(f"SELECT {VCOLS}, model_version, evaluation_mode, forecast_id, row_hash FROM led", "led"),
)
def _stamp(spark, sf):
    return ledger(spark, sf).select(*VNAMES, "model_version", "evaluation_mode", "forecast_id", "row_hash")


@query(
    "ledger_append",
    "G16 K2",
    sql(
        """SELECT origin, country, category, "table", date, days, row_hash FROM led WHERE origin < '2001-03'
           UNION ALL SELECT origin, country, category, "table", date, days + 1, row_hash FROM led WHERE origin >= '2001-03'""",
        "led",
    ),
)
def _append(spark, sf):
    rows = ledger(spark, sf)
    frozen = rows.filter(F.col("origin") < "2001-03")
    retry = rows.withColumn("days", F.col("days") + 1)
    out = L.append_frozen(frozen, retry.unionByName(retry.withColumn("frozen_at", F.lit("2002-01-01"))))
    return out.select("origin", "country", "category", "table", "date", "days", "row_hash")


@query(
    "ledger_validation",
    "G17",
    sql(
        """SELECT rule, n FROM (VALUES ('null_forecast_id', 0), ('null_frozen_at', 0), ('null_freeze_panel_vintage', 0),
             ('null_panel_hash', 0), ('null_git_sha', 0), ('null_model_version', 0), ('null_evaluation_mode', 0), ('forecast_id_mismatch', 0),
             ('live_already_published', 0)) t(rule, n)
           UNION ALL SELECT 'null_row_hash', count(*) FILTER (h = 12) FROM led
           UNION ALL SELECT 'row_hash_mismatch', count(*) FILTER (h = 12 OR h = 3) FROM led
           UNION ALL SELECT 'duplicate_key', count(*) FROM led WHERE "table" = 'FAD' AND h = 1""",
        "led",
    ),
)
def _validation(spark, sf):
    rows = ledger(spark, sf)
    tampered = rows.withColumn("days", F.when(F.col("h") == 3, F.col("days") + 1).otherwise(F.col("days"))).withColumn(
        "row_hash", F.when(F.col("h") != 12, F.col("row_hash"))
    )
    twice = rows.filter((F.col("table") == "FAD") & (F.col("h") == 1))
    return L.validate_ledger(tampered.unionByName(twice))


@query(
    "ledger_births",
    "G18",
    sql(
        f"""WITH v AS (SELECT origin, country, category, "table", date, days + CASE WHEN c = 3 AND h = 6 THEN 5 ELSE 0 END AS days, c
                       FROM led, (SELECT unnest([1, 2, 3]) AS c) WHERE c <> 1 OR origin < '2001-01')
            SELECT *, 'commit-' || first_ts AS commit_id,
                   min(first_ts) OVER (PARTITION BY origin, country, category, "table", date) < first_ts AS rewritten
            FROM (SELECT origin, country, category, "table", date, days, CAST(min(c) AS INTEGER) AS first_ts FROM v GROUP BY ALL)""",
        "led",
    ),
)
def _births(spark, sf):
    rows = ledger(spark, sf).select("origin", "country", "category", "table", "date", "h", "days")
    versions = rows.withColumn("commit_ts", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    versions = versions.filter((F.col("commit_ts") != 1) | (F.col("origin") < "2001-01"))
    bump = F.when((F.col("commit_ts") == 3) & (F.col("h") == 6), 5).otherwise(0)
    versions = versions.withColumn("days", F.col("days") + bump).withColumn(
        "commit_id", F.concat(F.lit("commit-"), F.col("commit_ts").cast("string"))
    )
    return L.first_seen(versions, ["origin", "country", "category", "table", "date"], ["days"], ["commit_id"])


@query(
    "pending_forecasts",
    "J5",
    sql(
        """SELECT l.origin, count(*) AS n_rows, count(o.y) AS n_scored, count(*) - count(o.y) AS n_pending
           FROM led l LEFT JOIN fs o ON o.country = l.country AND o.block = l.block AND o.category = l.category AND o."table" = l."table" AND o.m = l.date
           GROUP BY ALL""",
        "led",
        "fs",
    ),
)
def _pending(spark, sf):
    o = observed_once(spark, sf)
    return L.pending_counts(L.attach_actuals(ledger_of(o), o))


@query(
    "forecast_scorecard",
    "E25 J5 J7",
    sql(
        f"""SELECT origin, h, {KEY}, target, pred, actual, error, abs_err, {settle_sql('scaled_err')} AS scaled_err, in80, in95,
              evaluation_mode, model_version FROM score""",
        "score",
    ),
)
def _score(spark, sf):
    return score(spark, sf).withColumns(settle("scaled_err"))


register(
    "pairs",
    ("score", "score2"),
    """SELECT a.origin, a.country, a.block, a.category, a."table", a.target, a.h, a.scaled_err AS se_c, b.scaled_err AS se_s,
         a.in95 AS in_c, b.in95 AS in_s, a.evaluation_mode AS mode_c, b.evaluation_mode AS mode_s, a.actual, a.pred AS pred_c, b.pred AS pred_s
       FROM score a JOIN score2 b USING (origin, country, block, category, "table", target, h)""",
)


def pairs_of(spark, sf):
    o = observed_once(spark, sf)
    return L.pair_scorecards(score_of(o), score_of(o, shadow_recipes(spark, sf)))


@query(
    "champion_shadow_pairs",
    "J9",
    sql(
        f"""SELECT origin, {KEY}, target, h, {settle_sql("se_c")} AS scaled_err_champ, {settle_sql("se_s")} AS scaled_err_shadow, in_c AS in95_champ,
              in_s AS in95_shadow, mode_c AS evaluation_mode_champ FROM pairs""",
        "pairs",
    ),
)
def _pairs(spark, sf):
    return pairs_of(spark, sf).select(
        "origin", *SERIES, "target", "h", "scaled_err_champ", "scaled_err_shadow", "in95_champ", "in95_shadow", "evaluation_mode_champ"
    ).withColumns(settle("scaled_err_champ", "scaled_err_shadow"))


@query(
    "head_to_head",
    "J9 E25",
    sql(
        """SELECT "table", mode_c AS mode, CAST(h AS DOUBLE) AS h, count(*) AS n, round(avg(se_c), 6) AS champion_mase, round(avg(se_s), 6) AS shadow_mase
           FROM pairs WHERE mode_c = mode_s GROUP BY GROUPING SETS (("table", mode_c, h), ("table", mode_c))
           UNION ALL SELECT NULL, 'mixed', NULL, count(*) FILTER (mode_c <> mode_s), NULL, NULL FROM pairs""",
        "pairs",
    ),
)
def _h2h(spark, sf):
    return L.head_to_head(pairs_of(spark, sf)).withColumn("h", F.col("h").cast("double"))


register(
    "stderr",
    ("score",),
    """SELECT origin, "table", h, abs(error) / ((hi95 - lo95) / 2.0 / sqrt(h)) AS std FROM score WHERE hi95 > lo95""",
)
register(
    "bscale",
    ("stderr",),
    f"""SELECT "table", level, h, n, round(max(CASE WHEN h = 1 THEN greatest(q, 1.0) ELSE q END)
               OVER (PARTITION BY "table", level ORDER BY h), 4) AS scale
        FROM (SELECT "table", h, n, CAST(lv AS INTEGER) AS level, srt[CAST(ceil(round(lv / 100.0 * (n - 1), 9)) AS BIGINT) + 1] AS q
              FROM (SELECT "table", h, count(*) AS n, list_sort(list(std)) AS srt FROM stderr WHERE origin < '{CALIBRATION_END}' GROUP BY ALL),
                   (SELECT unnest([80, 95]) AS lv) WHERE n >= CASE WHEN lv = 95 THEN 60 ELSE 30 END)""",
)


def std_errors(spark, sf):
    o = observed_once(spark, sf)
    scored = L.attach_actuals(ledger_of(o), o).withColumn("pred", F.col("days"))
    return IV.standardized_errors(scored)


def calibrated_scales(spark, sf):
    return IV.band_scales(std_errors(spark, sf).filter(F.col("origin") < CALIBRATION_END))


@query("band_scales", "W20", sql('SELECT "table", level, h, n, scale FROM bscale', "bscale"))
def _scales(spark, sf):
    return calibrated_scales(spark, sf)


@query("band_scale_validation", "E26 A25")
def _validate_scales(spark, sf):
    errors = stage(std_errors(spark, sf).select("origin", "table", "h", "std"), "std-errors")
    scales = IV.band_scales(errors.filter(F.col("origin") < CALIBRATION_END))
    return IV.validate_scales(errors.filter(F.col("origin") >= CALIBRATION_END), scales)


register(
    "vbands",
    ("vpoint", "bscale"),
    """SELECT v.*, CASE WHEN a.scale IS NOT NULL AND b.scale IS NOT NULL THEN half * a.scale ELSE half * 0.4744 * sqrt(v.h) END AS h80,
         CASE WHEN a.scale IS NOT NULL AND b.scale IS NOT NULL THEN half * b.scale ELSE half * sqrt(v.h) END AS h95,
         CASE WHEN a.scale IS NOT NULL AND b.scale IS NOT NULL THEN 'q_h' ELSE 'sqrt_h' END AS method
       FROM vpoint v LEFT JOIN bscale a ON a."table" = v."table" AND a.h = v.h AND a.level = 80
         LEFT JOIN bscale b ON b."table" = v."table" AND b.h = v.h AND b.level = 95""",
)


@query("calibrated_bands", "E19 W20", sql(_banded("vbands", "h80", "h95", "method"), "vbands"))
def _calibrated(spark, sf):
    rows = vintage_rows(observed_once(spark, sf), coherent=False, scales=calibrated_scales(spark, sf))
    return rows.select(*VNAMES)


@query(
    "adaptive_alpha",
    "E20",
    sql(
        f"""SELECT {KEY}, count(*) AS n_hits, round(CAST(CASE WHEN count(*) >= 8 THEN
              least(greatest(0.05 + 0.05 * sum(0.05 - CASE in95 WHEN 1 THEN 0.0 ELSE 1.0 END), 0.001), 0.999) ELSE 0.05 END AS DOUBLE), 6) AS alpha_eff
            FROM score GROUP BY ALL""",
        "score",
    ),
)
def _alpha(spark, sf):
    return IV.aci_alpha(score(spark, sf), SERIES, min_hits=8).withColumns(r6("alpha_eff"))


@query("adaptive_replay", "E20")
def _replay(spark, sf):
    """The step size of every baseline, by table."""
    long = FC.one_step_long(obs(spark, sf), SHORT).filter(F.col("region") == "selection")
    res = long.withColumn("resid", F.col("y") - F.col("forecast")).withColumn("date", F.col("bulletin_date"))
    return IV.select_gamma(IV.aci_replay(res, [*SERIES, "model"]), ["table", "model"]).withColumns(r6("coverage", "mean_width"))


register(
    "ens_alpha",
    ("ens", "score"),
    f"""SELECT * FROM ens LEFT JOIN (
          SELECT {KEY}, CASE WHEN count(*) >= {ACI_MIN_HITS} THEN least(greatest(0.05 + 0.05 * sum(0.05 - CASE in95 WHEN 1 THEN 0.0 ELSE 1.0 END), 0.001), 0.999) ELSE 0.05 END AS alpha
          FROM score GROUP BY ALL) USING ({KEY})""",
)
register("vlive", ("ens_alpha",), _vint("r", _MEDIAN, "ens_alpha", "(1 - coalesce(alpha, 0.05))", "pos = n_grid"))


@query("adaptive_vintages", "E20 E23", sql(_banded("vlive", _GROW80, _GROW95, "'sqrt_h'"), "vlive"))
def _adaptive_vintages(spark, sf):
    """The live vintage, each series with the level that its scored forecasts have led to."""
    o = observed_once(spark, sf)
    alphas = IV.aci_alpha(score_of(o), SERIES, min_hits=ACI_MIN_HITS)
    return V.vintages(o, None, CHAMPION, SHORT, alphas=stage(alphas, "alphas"), coherent=False).select(*VNAMES)


#: Part of the hold-out months of a series that corrects its quantile bands; the bands of the others are reported.
CALIBRATION_SHARE = 1 / 3
register(
    "qband",
    ("onelong", "rquant"),
    f"""SELECT {KEY}, model, m, y, forecast + rq[{QUANTILE_LEVELS.index(0.1) + 1}] AS lo80, forecast + rq[{QUANTILE_LEVELS.index(0.9) + 1}] AS hi80,
               forecast + rq[1] AS lo95, forecast + rq[9] AS hi95, row_number() OVER (PARTITION BY {KEY}, model ORDER BY m) AS rn,
               floor(count(*) OVER (PARTITION BY {KEY}, model) / 3.0) AS n_cal
        FROM onelong JOIN rquant USING ({KEY}, model) WHERE region = 'holdout' AND y IS NOT NULL""",
)
_CQR_SHIFT = """e{lv}[CAST(ceil(round(least(1.0, ceil(round((len(e{lv}) + 1) * {p}, 9)) / len(e{lv})) * (len(e{lv}) - 1), 9)) AS BIGINT) + 1]"""


@query(
    "quantile_band_correction",
    "E21",
    sql(
        f"""WITH c AS (SELECT {KEY}, model, list_sort(list(greatest(lo80 - y, y - hi80))) AS e80, list_sort(list(greatest(lo95 - y, y - hi95))) AS e95
                       FROM qband WHERE rn <= n_cal GROUP BY ALL),
                 s AS (SELECT {KEY}, model, {_CQR_SHIFT.format(lv=80, p=0.8)} AS s80, {_CQR_SHIFT.format(lv=95, p=0.95)} AS s95 FROM c)
            SELECT {KEY}, model, m AS date, round(lo80 - s80, 6) AS lo80, round(hi80 + s80, 6) AS hi80, round(lo95 - s95, 6) AS lo95,
                   round(hi95 + s95, 6) AS hi95 FROM qband LEFT JOIN s USING ({KEY}, model) WHERE rn > n_cal""",
        "qband",
    ),
)
def _cqr(spark, sf):
    """Bands of every baseline, corrected on the first third of its hold-out months."""
    long, group = FC.one_step_long(obs(spark, sf), SHORT), [*SERIES, "model"]
    rq = ME.residual_quantiles(
        long.filter(F.col("region") == "selection").withColumn("resid", F.col("y") - F.col("forecast")), group
    )
    at = {f"{side}{lv}": QUANTILE_LEVELS.index(q) for lv, lo, hi in ((80, 0.1, 0.9), (95, 0.025, 0.975)) for side, q in (("lo", lo), ("hi", hi))}
    rows = long.filter((F.col("region") == "holdout") & F.col("y").isNotNull()).join(rq, group)
    rows = rows.select(
        *group, F.col("bulletin_date").alias("date"), "y", *[(F.col("forecast") + F.col("rq")[i]).alias(n) for n, i in at.items()]
    )
    out = IV.cqr(rows, group, CALIBRATION_SHARE)
    return out.select(*group, "date", *[F.round(n, 6).alias(n) for n in at])
