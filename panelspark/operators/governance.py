"""Score blocks, seeds, drift, replicas, significance gates and promotion decisions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from panelspark.config import (
    COV95_FLOOR,
    COVERAGE_MIN_N,
    MATERIAL_MARGIN,
    PERF_RATIO,
    POLICY,
    RECAMPAIGN_STREAK,
    SERIES,
    SMALL_N,
    WORLD,
)
from panelspark.functions.hashing import table_fingerprint
from panelspark.functions.special import t_quantile
from panelspark.operators.intervals import with_coverage_ci
from panelspark.operators.significance import holm, wilcoxon
from panelspark.session import stage


def settled(x: Column) -> Column:
    """Six decimals, near-ties upward, for reported means."""
    return F.floor(x * 1e6 + 0.5001) / 1e6


def score_summary(scorecard: DataFrame) -> DataFrame:
    """Accuracy and coverage per mode: overall, by horizon, by table, by vintage.

    The evaluation mode is part of every grouping set, so modes are never pooled.
    """
    mode, h, table, origin = (F.col(c) for c in ("evaluation_mode", "h", "table", "origin"))
    sets = [[mode], [mode, h], [mode, table], [mode, origin]]
    out = scorecard.groupingSets(sets, mode, h, table, origin).agg(
        F.count(F.lit(1)).alias("n"),
        settled(F.avg("abs_err")).alias("mae_days"),
        settled(F.avg("scaled_err")).alias("mase"),
        F.sum("in80").alias("k80"),
        F.sum("in95").alias("k95"),
        F.round(F.avg("in80"), 6).alias("cov80"),
        F.round(F.avg("in95"), 6).alias("cov95"),
    )
    return out.withColumn("insufficient_n", F.col("n") < SMALL_N)


def score_summary_ci(scorecard: DataFrame) -> DataFrame:
    out = score_summary(scorecard)
    return with_coverage_ci(with_coverage_ci(out, "k80", "n", "cov80_ci"), "k95", "n", "cov95_ci")


class SeedError(RuntimeError):
    """Seeds are not comparable, so nothing is averaged."""


def seed_checks(runs: DataFrame, seeds: list[str], error: str = "hold_mase") -> DataFrame:
    """Per seed: rows, non-finite errors, and a fingerprint of the series it evaluated."""
    key = F.xxhash64(*SERIES)
    return runs.groupBy("variant").agg(
        F.count(F.lit(1)).alias("n_series"),
        F.count_if(F.col(error).isNull() | F.isnan(error) | (F.abs(error) == float("inf"))).alias("n_bad"),
        F.bit_xor(key).alias("universe"),
        F.sum(F.shiftright(key, 20)).alias("universe_sum"),
        F.lit(len(seeds)).alias("n_expected"),
    )


def aggregate_seeds(runs: DataFrame, seeds: list[str], error: str = "hold_mase", check: bool = True) -> DataFrame:
    """Mean over exactly ``seeds`` with its deviation and t interval; raises when seeds are not comparable."""
    if check:
        rows = seed_checks(runs, seeds, error).collect()
        got = sorted(r["variant"] for r in rows)
        if got != sorted(seeds):
            raise SeedError(f"seeds {got} != {sorted(seeds)}")
        if any(r["n_bad"] for r in rows):
            raise SeedError("non-finite errors")
        if len({(r["n_series"], r["universe"], r["universe_sum"]) for r in rows}) != 1:
            raise SeedError("seeds evaluate different series")
    t = t_quantile(0.975, len(seeds) - 1)
    per_seed = runs.filter(F.col("variant").isin(*seeds)).groupBy("variant").agg(F.avg(error).alias("_v"))
    return (
        per_seed.agg(
            F.count(F.lit(1)).alias("n_seeds"),
            F.avg("_v").alias("mean"),
            F.stddev_samp("_v").alias("sd"),
            F.min("_v").alias("min"),
            F.max("_v").alias("max"),
        )
        .withColumn("se", F.col("sd") / F.sqrt(F.col("n_seeds")))
        .withColumn("lo", F.col("mean") - F.lit(t) * F.col("se"))
        .withColumn("hi", F.col("mean") + F.lit(t) * F.col("se"))
    )


def performance_drift(scorecard: DataFrame, ratio: float = PERF_RATIO, floor: float = COV95_FLOOR, min_n: int = COVERAGE_MIN_N) -> DataFrame:
    """Latest vintage against older ones on the same horizons; one row with both flags."""
    # what the scorecard says of each vintage and horizon, a few hundred rows: it is scored once however often these are read
    cells = scorecard.groupBy("origin", "h").agg(
        F.count(F.lit(1)).alias("n"), *[a(c).alias(f"{c}_{n}") for c in ("scaled_err", "in95") for n, a in (("sum", F.sum), ("n", F.count))]
    )
    cells = stage(cells, "vintage-cells")
    newest = cells.agg(F.max("origin")).scalar()
    tagged = cells.withColumn("_latest", F.col("origin") == newest)
    horizons = F.broadcast(tagged.filter("_latest").select("h").distinct())  # at most one row per horizon
    matched = tagged.join(horizons, "h", "left_semi")
    latest, base = F.col("_latest"), ~F.col("_latest")
    count = lambda which: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0))
    mean = lambda which, c: F.sum(F.when(which, F.col(f"{c}_sum"))) / F.nullif(F.sum(F.when(which, F.col(f"{c}_n"))), F.lit(0))
    row = matched.agg(
        F.max("origin").alias("latest_vintage"),
        count(latest).alias("latest_n"),
        mean(latest, "scaled_err").alias("latest_mase"),
        mean(base, "scaled_err").alias("baseline_mase"),
        count(base).alias("baseline_n"),
        mean(latest, "in95").alias("latest_cov95"),
    )
    return row.withColumn("perf_ratio", F.col("latest_mase") / F.nullif(F.col("baseline_mase"), F.lit(0.0))).withColumns(
        {
            "performance_drift": F.coalesce(F.col("perf_ratio") > ratio, F.lit(False)),
            "coverage_drift": (F.col("latest_n") >= min_n) & (F.col("latest_cov95") < floor),
        }
    )


def vintage_flags(scorecard: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Does the mean scaled error of a vintage exceed that of all rows? A row for each ``by`` and vintage; the scorecard is read once."""
    keys = [*(by or []), "vintage"]
    cells = scorecard.withColumn("vintage", F.col("origin")).groupBy(*keys).agg(F.sum("scaled_err").alias("_sum"), F.count("scaled_err").alias("_n"))
    cells = stage(cells, "vintage-errors")
    mean = lambda total, n: total / F.nullif(n, F.lit(0))
    overall = cells.agg(mean(F.sum("_sum"), F.sum("_n"))).scalar()
    return cells.select(*keys, (mean(F.col("_sum"), F.col("_n")) > overall).alias("performance_drift"))


def drift_streak(history: DataFrame, needed: int = RECAMPAIGN_STREAK) -> DataFrame:
    """Length of the run of drifting vintages at the end of the history (one row per vintage)."""
    last_ok = F.max(F.when(~F.col("performance_drift"), F.col("vintage")))
    joined = history.agg(last_ok.alias("_ok"), F.sort_array(F.collect_set("vintage")).alias("_all"))
    streak = F.size(F.filter("_all", lambda v: F.col("_ok").isNull() | (v > F.col("_ok"))))
    return joined.select(streak.alias("consecutive_perf_drift"), (streak >= needed).alias("recampaign_due"))


def signatures(values: DataFrame, key: list[str], date: str = "date", value: str = "actual") -> DataFrame:
    """Series with their exact (date, value) vector; bounded by the calendar, equal only for equal vectors."""
    distinct = values.groupBy(*key, date).agg(F.max(value).alias("_v"))
    return distinct.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(date, "_v"))).alias("signature"))


def replica_representatives(values: DataFrame, key: list[str], within: list[str] | None = None) -> DataFrame:
    """One representative per class of series that share every value, with the class size.

    Classes group by a 128-bit digest first, so a class of copies shrinks before it is shuffled;
    the vector itself is part of the key only through that digest and its length.
    """
    sig = signatures(values, key)
    text = F.to_json(F.struct("signature"))
    digest = sig.select(*key, F.md5(text).alias("_md5"), F.xxhash64("signature").alias("_xx"))
    return digest.groupBy(*(within or []), "_md5", "_xx").agg(
        F.min(F.struct(*key)).alias("_rep"), F.count(F.lit(1)).alias("class_size")
    ).select(*([w for w in (within or []) if w not in key]), "_rep.*", "class_size")


def effective_counts(representatives: DataFrame) -> DataFrame:
    return representatives.agg(F.sum("class_size").alias("n_raw"), F.count(F.lit(1)).alias("n_effective"))


def dedup_pairs(pairs: DataFrame, world: str = WORLD) -> DataFrame:
    """Drops an area's pairs when they repeat the world series of the same category and table exactly.

    The world's pairs are calendar times horizon times code lists and go to every task. A pair is compared with the world's
    pair of its origin, target and horizon, and a series is a copy when all its pairs agree and the world has no others;
    so pairs are read once, and nothing is collected for a series.
    """
    key, at, values = ["category", "table"], ["target", "origin", "h"], ["actual_champ", "pred_champ", "pred_shadow"]
    there = pairs.filter(F.col("country") == world)
    there = there.select(F.col("block").alias("_block"), *key, *at, F.struct(*values).alias("_there"))
    sizes = there.groupBy("_block", *key).agg(F.count(F.lit(1)).alias("_size"))
    # as a rule a category has one block, and a pair meets one series of the world
    met = pairs.join(F.broadcast(sizes), key, "left").join(F.broadcast(there), ["_block", *key, *at], "left")
    series = ["country", "category", "block", "table"]
    with_one, with_all = Window.partitionBy(*series, "_block"), Window.partitionBy(*series)
    differs = F.when(F.struct(*values).eqNullSafe(F.col("_there")), 0).otherwise(1)
    copy = (F.sum(differs).over(with_one) == 0) & (F.count(F.lit(1)).over(with_one) == F.col("_size"))
    judged = met.withColumn("_copy", F.coalesce(copy, F.lit(False))).withColumns(
        {"_any": F.max("_copy").over(with_all), "_first": F.min("_block").over(with_all)}
    )
    own = (F.col("country") == world) | ~F.col("_any")
    return judged.filter(own & F.col("_block").eqNullSafe(F.col("_first"))).select(*pairs.columns)


def band_of(h: Column, bands: dict[str, tuple[int, int]]) -> Column:
    case = None
    for name, (lo, hi) in bands.items():
        hit = h.between(lo, hi)
        case = F.when(hit, name) if case is None else case.when(hit, name)
    return case


def band_medians(pairs: DataFrame, policy: dict = POLICY) -> DataFrame:
    """Median scaled error per series and horizon band, both sides."""
    banded = pairs.withColumn("band", band_of(F.col("h"), policy["horizon_bands"])).filter(F.col("band").isNotNull())
    return banded.groupBy("table", "band", "country", "block", "category").agg(
        F.median("scaled_err_champ").alias("champ"), F.median("scaled_err_shadow").alias("shadow"), F.count(F.lit(1)).alias("n_pairs")
    )


def decide(pairs: DataFrame, policy: dict = POLICY) -> DataFrame:
    """One decision per table: promote, retain, extend-shadow or reject, with its reason.

    Only pairs whose mode is allowed on both sides count. Too small a sample never promotes.
    """
    mode = F.col("evaluation_mode_champ")
    # Read several times below: written once so that the scoring behind it runs once, and only the pairs that count; of the
    # others the tables are wanted, of which there are a few.
    seen = Observation(f"promotion-{uuid.uuid4().hex[:8]}")
    counted = pairs.observe(seen, F.collect_set("table").alias("tables")).filter(mode.isin(*policy["modes_allowed"]) & (mode == F.col("evaluation_mode_shadow")))
    live = stage(counted.select(*SERIES, "origin", "target", "h", *[c for c in pairs.columns if c.endswith(("_champ", "_shadow")) and not c.startswith(("evaluation_mode", "model_version", "abs_err"))]), "promotion-pairs")
    tables = pairs.sparkSession.createDataFrame([(t,) for t in sorted(seen.get["tables"])], "table string")
    vintages = live.groupBy("table").agg(F.countDistinct("origin").alias("n_vintages"), F.count(F.lit(1)).alias("n_pairs_live"))
    kept = stage(dedup_pairs(live), "effective-pairs")
    banded = kept.withColumn("band", band_of(F.col("h"), policy["horizon_bands"]))
    coverage = banded.groupBy("table").agg(
        F.avg("in95_shadow").alias("cov95_shadow"),
        F.avg("in95_champ").alias("cov95_champ"),
        *[F.count_if(F.col("band") == b).alias(f"n_{b}") for b in policy["horizon_bands"]],
    )
    med = band_medians(kept, policy)
    diffs = med.withColumn("d", F.col("champ") - F.col("shadow"))
    tests = wilcoxon(diffs, ["table", "band"], "d", sides=("greater", "less"))
    stats = (
        med.groupBy("table", "band")
        .agg(F.count(F.lit(1)).alias("n_series"), (1 - F.avg("shadow") / F.nullif(F.avg("champ"), F.lit(0.0))).alias("margin"))
        .join(tests, ["table", "band"], "left")
    )
    enough = F.col("n_series") >= policy["min_series_for_test"]
    stats = stats.withColumns(
        {
            "margin": F.coalesce("margin", F.lit(0.0)),
            "p_better": F.when(enough, F.coalesce("p_greater", F.lit(1.0))).otherwise(1.0),
            "p_worse": F.when(enough, F.coalesce("p_less", F.lit(1.0))).otherwise(1.0),
        }
    )
    stats = holm(stats, ["table"], "p_better", "holm_better", ["band"])
    stats = holm(stats, ["table"], "p_worse", "holm_worse", ["band"])
    alpha = policy["alpha_holm"]
    verdict = stats.groupBy("table").agg(
        F.count(F.lit(1)).alias("_bands"),
        F.bool_or((F.col("margin") <= -policy["max_band_regression"]) & (F.col("holm_worse") < alpha)).alias("_worse"),
        F.bool_and((F.col("margin") >= policy["material_margin"]) & (F.col("holm_better") < alpha)).alias("_better"),
        F.min("margin").alias("min_margin"),
    )
    per_band = [F.col(f"n_{b}") >= policy["min_pairs_per_band"] for b in policy["horizon_bands"]]
    sampled = per_band[0]
    for cond in per_band[1:]:
        sampled = sampled & cond
    covered = (F.col("cov95_shadow") >= policy["min_cov95"]) & (
        F.col("cov95_shadow") >= F.col("cov95_champ") - policy["max_cov95_gap"]
    )
    few = F.coalesce(F.col("n_vintages"), F.lit(0)) < policy["min_live_vintages"]
    short = ~F.coalesce(sampled, F.lit(False))
    decision = (
        F.when(few | short, "extend-shadow")
        .when(F.col("_worse"), "reject")
        .when(F.col("_better") & covered, "promote")
        .otherwise("retain")
    )
    reason = (
        F.when(F.coalesce(F.col("n_pairs_live"), F.lit(0)) == 0, "no live pairs")
        .when(few, "too few live vintages")
        .when(short, "too few pairs in a horizon band")
        .when(F.col("_worse"), "significantly worse in a band")
        .when(F.col("_better") & covered, "material and significant in every band")
        .when(~covered, "coverage outside policy")
        .otherwise("not material or not significant in a band")
    )
    return (
        tables.join(vintages, "table", "left")
        .join(coverage, "table", "left")
        .join(verdict, "table", "left")
        .select(
            "table",
            decision.alias("decision"),
            reason.alias("reason"),
            F.coalesce("n_pairs_live", F.lit(0)).alias("n_pairs_live"),
            F.coalesce("n_vintages", F.lit(0)).alias("n_live_vintages"),
            "cov95_shadow",
            "cov95_champ",
            "min_margin",
        )
    )


def champion_challenger(
    errors: DataFrame, champion: str, by: list[str], representatives: DataFrame, margin: float = MATERIAL_MARGIN, alpha: float = 0.05
) -> DataFrame:
    """Each challenger against the champion on the series both were scored on.

    Copies of a series are no independent evidence: only ``representatives`` (a row for each class of equal
    series) enter the means and the test; ``n_series_raw`` counts the pairs before, ``n_series_effective`` after.

    ``errors`` has the series key, ``model`` and ``mase``. A challenger passes when it wins by a material
    mean margin and its paired test survives Holm within its family.
    """
    champ = errors.filter(F.col("model") == champion).select(*SERIES, F.col("mase").alias("_champ"))
    pairs = (
        errors.filter((F.col("model") != champion) & F.col("mase").isNotNull())
        .join(champ.filter(F.col("_champ").isNotNull()), SERIES)
        .withColumn("d", F.col("_champ") - F.col("mase"))
    )
    group = [*by, "model"]
    pairs = pairs.join(representatives.select(*SERIES, F.lit(True).alias("_single")), SERIES, "left")
    single = F.coalesce("_single", F.lit(False))
    means = pairs.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_series_raw"),
        F.count_if(single).alias("n_series_effective"),
        F.avg(F.when(single, F.col("mase"))).alias("mean"),
        F.avg(F.when(single, F.col("_champ"))).alias("champion_mean"),
    )
    tests = wilcoxon(pairs.filter(single), group, "d").select(*group, "p_two", "method")
    out = means.join(tests, group, "left").withColumn("p", F.coalesce("p_two", F.lit(1.0)))
    out = holm(out, by, "p", "holm_p", ["model"])
    gain = F.col("champion_mean") - F.col("mean")
    return out.withColumn("margin", gain).withColumn("holdout_pass", (F.col("holm_p") < alpha) & (gain >= margin)).select(
        *group, "n_series_raw", "n_series_effective", "mean", "champion_mean", "margin", "method", "p", "holm_p", "holdout_pass"
    )


def best_challenger(report: DataFrame, by: list[str]) -> DataFrame:
    """What to shadow: the passing challenger with the largest margin, else the lowest mean."""
    key = F.struct((~F.col("holdout_pass")).cast("int"), F.when(F.col("holdout_pass"), -F.col("margin")).otherwise(F.col("mean")), F.col("model"))
    return report.groupBy(*by).agg(F.min_by("model", key).alias("challenger"), F.bool_or("holdout_pass").alias("any_pass"))


def significance_by_horizon(per_series: DataFrame, baseline: str, min_pairs: int = 6, alpha: float = 0.05) -> DataFrame:
    """Is a model better than the baseline per (model, table, horizon)? Paired by series, Holm over horizons."""
    c = per_series.filter(F.col("model") != baseline).select("model", *SERIES, "h", F.col("mase").alias("champ"))
    b = per_series.filter(F.col("model") == baseline).select(*SERIES, "h", F.col("mase").alias("base"))
    pairs = c.join(b, [*SERIES, "h"]).withColumn("d", F.col("champ") - F.col("base"))
    group = ["model", "table", "h"]
    means = pairs.groupBy(*group).agg(
        F.avg("champ").alias("champion_mase"), F.avg("base").alias("baseline_mase"), F.count(F.lit(1)).alias("n")
    ).filter(F.col("n") >= min_pairs)
    tests = wilcoxon(pairs, group, "d").select(*group, "p_two")
    out = means.join(tests, group, "left").withColumn("p", F.coalesce("p_two", F.lit(1.0)))
    out = holm(out, ["model", "table"], "p", "holm_p", ["h"])
    delta = 100 * (F.col("baseline_mase") - F.col("champion_mase")) / F.col("baseline_mase")
    return out.select(
        *group, "champion_mase", "baseline_mase", delta.alias("delta_pct"), "n", "p", "holm_p",
        ((F.col("holm_p") < alpha) & (F.col("champion_mase") < F.col("baseline_mase"))).alias("significant"),
    )


def seed_coverage(out: DataFrame, models: tuple[str, ...]) -> DataFrame:
    """Per seed: order-independent hashes of grid, truth and each model's finite mask, with counts.

    Seeds are comparable when every hash but the mask counts agrees (count distinct = 1).
    """
    def fold(*cols: Column) -> Column:
        return F.bit_xor(F.xxhash64(*cols))

    aggs = [
        F.count(F.lit(1)).alias("n_rows"),
        fold(F.col("unique_id"), F.col("ds")).alias("grid_hash"),
        fold(F.col("unique_id"), F.col("ds"), F.col("y")).alias("truth_hash"),
    ]
    for m in models:
        finite = F.col(m).isNotNull() & ~F.isnan(m)
        aggs += [
            F.count_if(finite).alias(f"{m}_finite"),
            fold(F.col("unique_id"), F.col("ds"), finite).alias(f"{m}_mask"),
        ]
    return out.groupBy("seed").agg(*aggs)


def seed_problems(coverage: DataFrame, models: tuple[str, ...]) -> DataFrame:
    """One row per disagreement between seeds, or per model without full finite coverage."""
    one = coverage.agg(
        F.countDistinct("grid_hash").alias("grids"),
        F.countDistinct("truth_hash").alias("truths"),
        F.countDistinct("n_rows").alias("sizes"),
        *[F.sum(F.col("n_rows") - F.col(f"{m}_finite")).alias(f"gap_{m}") for m in models],
    )
    rows = [
        F.struct(F.lit("different grids").alias("problem"), (F.col("grids") - 1).cast("bigint").alias("n")),
        F.struct(F.lit("different truths").alias("problem"), (F.col("truths") - 1).cast("bigint").alias("n")),
        F.struct(F.lit("different sizes").alias("problem"), (F.col("sizes") - 1).cast("bigint").alias("n")),
    ] + [F.struct(F.lit(f"{m}: non-finite rows").alias("problem"), F.col(f"gap_{m}").cast("bigint").alias("n")) for m in models]
    return one.select(F.inline(F.array(*rows)))


def align_models(grid: DataFrame, forecasts: DataFrame, models: tuple[str, ...], key: list[str]) -> DataFrame:
    """Grid rows with one column per required model; an absent model is a NULL column, no row is dropped."""
    wide = forecasts.groupBy(*key).pivot("model", list(models)).agg(F.max("forecast"))
    return grid.join(wide, key, "left").select(*grid.columns, *[F.col(m) for m in models])


def best_k(errors: DataFrame, forecasts: DataFrame, k: int, key: list[str], error: str = "sel_mase") -> DataFrame:
    """Median of the ``k`` models with the lowest selection error of each series.

    Models per series are bounded by the catalogue; the list of picks is the join key.
    """
    rank = F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.col(error), F.col("model")))
    picks = errors.filter(F.col(error).isNotNull()).withColumn("_r", rank).filter(F.col("_r") <= k).select(*SERIES, "model")
    return (
        forecasts.join(picks, [*SERIES, "model"], "left_semi")
        .groupBy(*key)
        .agg(F.median("forecast").alias("forecast"), F.concat_ws("+", F.sort_array(F.collect_set("model"))).alias("models"))
    )


def strategies(errors: DataFrame) -> DataFrame:
    """Global best by selection error, per-series selection, and the hold-out oracle, on hold-out error."""
    rows = errors.filter(F.col("sel_mase").isNotNull() & F.col("hold_mase").isNotNull())
    means = rows.groupBy("model").agg(F.avg("sel_mase").alias("_s"), F.avg("hold_mase").alias("mase"), F.count(F.lit(1)).alias("n_series"))
    best = means.agg(F.min_by(F.struct("model", "mase", "n_series"), F.struct(F.round("_s", 9), F.col("model"))).alias("_b"))
    fixed = best.select(F.lit("global_best").alias("strategy"), F.col("_b.mase").alias("mase"), F.col("_b.n_series").alias("n_series"))
    per = rows.groupBy(*SERIES).agg(
        F.min_by("hold_mase", F.struct("sel_mase", "model")).alias("sel"), F.min("hold_mase").alias("orc")
    )
    both = per.agg(F.avg("sel").alias("s"), F.avg("orc").alias("o"), F.count(F.lit(1)).alias("n_series"))
    other = both.select(
        F.inline(
            F.array(
                F.struct(F.lit("per_series").alias("strategy"), F.col("s").alias("mase"), F.col("n_series")),
                F.struct(F.lit("oracle").alias("strategy"), F.col("o").alias("mase"), F.col("n_series")),
            )
        )
    )
    return fixed.unionByName(other)


def conservative_objective(errors: DataFrame, by: list[str], error: str = "mase") -> DataFrame:
    """Mean plus population deviation over the series of a group."""
    return errors.filter(F.col(error).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (F.avg(error) + F.stddev_pop(error)).alias("objective")
    )


def evidence_hash(scorecard: DataFrame, vintages: list[str]) -> DataFrame:
    """Fingerprint of the rows of the decision's own vintages; later vintages leave it unchanged."""
    return table_fingerprint(scorecard.filter(F.col("origin").isin(*vintages)))


