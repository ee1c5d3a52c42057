"""Goodness of fit over observed/predicted pairs (``obs``, ``pred``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions.nulls import div
from freshet.operators.order import exact_quantiles

METRICS = ["r", "r2", "mae", "rmse", "bias", "pbias", "nse", "nse_rel", "kge", "medae", "d", "d_rel", "rsr"]

# fixed values: band edges of each coverage level
COVERAGE = {"coverage50": ("p25", "p75"), "coverage90": ("p05", "p95"), "coverage100": ("min", "max")}
BAND_FRACTION = {"p05": 0.05, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p95": 0.95}


def _attach(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add one row of group values to every row of the group."""
    if keys:
        return df.join(other, list(keys), "left")
    row = other.select(F.struct(*other.columns)).scalar()  # one row: no grouping keys
    return df.withColumn("_row", row).select(*df.columns, "_row.*")


def core_metrics(pairs: DataFrame, keys: Sequence[str] = (), obs: str = "obs", pred: str = "pred", agreement: bool = True) -> DataFrame:
    """All moment-based metrics, one row per group.

    Only the index of agreement needs the mean of the observations beside each pair; without it one pass is enough.
    """
    y, m = F.col(obs), F.col(pred)
    p = pairs.where(y.isNotNull() & m.isNotNull())
    if not agreement:
        p = p.withColumn("_ybar", F.lit(None).cast("double"))
    elif keys:
        p = p.join(p.groupBy(*keys).agg(F.avg(y).alias("_ybar")), list(keys))
    else:
        p = p.withColumn("_ybar", p.agg(F.avg(y)).scalar())
    ybar = F.col("_ybar")
    s = p.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(y).alias("_my"), F.avg(m).alias("_mm"),
        F.stddev_pop(y).alias("_sy"), F.stddev_pop(m).alias("_sm"), F.covar_pop(y, m).alias("_cov"),
        F.sum((y - m) * (y - m)).alias("_sse"), (F.count(F.lit(1)) * F.var_pop(y)).alias("_sso"),
        F.sum(F.abs(y - m)).alias("_sad"), F.sum(y - m).alias("_sd"), F.sum(y).alias("_sumy"),
        F.sum(F.pow(F.abs(m - ybar) + F.abs(y - ybar), F.lit(2))).alias("_pe"), F.avg(F.abs(y)).alias("_absy"),
    )
    c = F.col
    r = F.when(c("n") >= 2, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), div(c("_cov"), c("_sy") * c("_sm")))))
    r = F.when((c("_sy") > 0) & (c("_sm") > 0), r)
    nse = 1 - div("_sse", "_sso")
    d = 1 - div("_sse", "_pe")
    kge = 1 - F.sqrt(F.pow(r - 1, F.lit(2)) + F.pow(div("_sm", "_sy") - 1, F.lit(2)) + F.pow(div("_mm", "_my") - 1, F.lit(2)))
    scaled = c("_absy") != 0
    return s.select(
        *keys, "n", r.alias("r"), (r * r).alias("r2"), div("_sad", "n").alias("mae"),
        F.sqrt(div("_sse", "n")).alias("rmse"), div("_sd", "n").alias("bias"),
        (100 * div("_sd", "_sumy")).alias("pbias"), nse.alias("nse"), F.when(scaled, nse).alias("nse_rel"),
        kge.alias("kge"), d.alias("d"), F.when(scaled, d).alias("d_rel"),
        div(F.sqrt("_sse"), F.sqrt("_sso")).alias("rsr"),
    )


def median_abs_error(pairs: DataFrame, keys: Sequence[str] = (), obs: str = "obs", pred: str = "pred") -> DataFrame:
    e = pairs.select(*keys, F.abs(F.col(obs) - F.col(pred)).alias("_e"))
    return exact_quantiles(e, keys, "_e", {"medae": 0.5})


def pairwise_metrics(pairs: DataFrame, keys: Sequence[str] = (), obs: str = "obs", pred: str = "pred") -> DataFrame:
    """The full metric set, one row per group."""
    core = core_metrics(pairs, keys, obs, pred)
    return _attach(core, median_abs_error(pairs, keys, obs, pred), keys)


def versus_series(pairs: DataFrame, name: str, keys: Sequence[str] = (), obs: str = "obs", pred: str = "pred") -> DataFrame:
    """Metrics against one named series; fewer than two pairs give NULLs."""
    core = core_metrics(pairs, keys, obs, pred)
    wanted = ["r", "rmse", "mae", "nse", "nse_rel", "d", "d_rel", "rsr", "bias"]
    return core.select(*keys, *[F.when(F.col("n") >= 2, F.col(c)).alias(f"vs_{name}_{c}") for c in wanted])


def log_metrics(pairs: DataFrame, keys: Sequence[str] = (), obs: str = "obs", pred: str = "pred") -> DataFrame:
    """Metrics of the base-10 logarithms of pairs with both values above zero."""
    logs = (pairs.where((F.col(obs) > 0) & (F.col(pred) > 0))
            .select(*keys, F.log10(obs).alias("obs"), F.log10(pred).alias("pred")))
    return core_metrics(logs, keys).select(
        *keys, F.col("n").alias("n_pos"), F.col("r").alias("r_log"), F.col("r2").alias("r2_log"),
        F.col("rmse").alias("rmse_log10"), F.col("mae").alias("mae_log10"), F.col("nse").alias("nse_log"),
        F.col("d").alias("d_log"))


def _inside(lo: Column, hi: Column, obs: Column) -> Column:
    ok = obs.isNotNull() & lo.isNotNull() & hi.isNotNull()
    return F.avg(F.when(ok, F.when((obs >= lo) & (obs <= hi), 1.0).otherwise(0.0)))


def coverage(pairs: DataFrame, keys: Sequence[str] = (), obs: str = "obs") -> DataFrame:
    """Share of observations inside the 50, 90 and 100 % bands of their day."""
    return pairs.groupBy(*keys).agg(*[
        _inside(F.col(lo), F.col(hi), F.col(obs)).alias(name) for name, (lo, hi) in COVERAGE.items()])


def band_coverage(matched: DataFrame, keys: Sequence[str], center: str = "mean", obs: str = "obs") -> DataFrame:
    """Coverage at the nearest day; a missing percentile is read off between min and max."""
    def edge(name: str) -> Column:
        if name in ("min", "max"):
            return F.col(name)
        return F.coalesce(F.col(name), F.col("min") + (F.col("max") - F.col("min")) * BAND_FRACTION[name])

    usable = matched.where(F.col(center).isNotNull() & F.col(obs).isNotNull())
    aggs = [_inside(edge(lo), edge(hi), F.col(obs)).alias(name) for name, (lo, hi) in COVERAGE.items()]
    return usable.groupBy(*keys).agg(*aggs, _inside(F.col("min"), F.col("max"), F.col(obs)).alias("coverage_minmax"))


def band_deviation(bands: DataFrame, keys: Sequence[str] = (), center: str = "mean", lo: str = "min", hi: str = "max",
                   prefix: str = "") -> DataFrame:
    """Width, relative width, asymmetry and edge error of a band around its centre."""
    c, a, b = F.col(center), F.col(lo), F.col(hi)
    width = b - a
    edges = F.sum(F.pow(a - c, F.lit(2)) + F.pow(b - c, F.lit(2)))
    return bands.where(c.isNotNull() & a.isNotNull() & b.isNotNull()).groupBy(*keys).agg(
        F.avg(width).alias(f"{prefix}band_width_mean"),
        F.avg(div(width, F.abs(c)) * 100).alias(f"{prefix}band_width_rel_pct"),
        F.avg(div(2 * (c - a), width) - 1).alias(f"{prefix}band_asymmetry"),
        F.sqrt(edges / (2 * F.count(F.lit(1)))).alias(f"{prefix}band_rmse_vs_mean"),
    )


def percentile_band_deviation(bands: DataFrame, keys: Sequence[str] = (), center: str = "mean") -> DataFrame:
    half = band_deviation(bands, keys, center, "p25", "p75", "p50_")
    wide = band_deviation(bands, keys, center, "p05", "p95", "p90_")
    return _attach(half, wide, keys)


def correlation_with(daily: DataFrame, extras: DataFrame, value: str = "value", name: str = "name", keys: Sequence[str] = ()) -> DataFrame:
    """r and number of pairs between all samples and each extra series of their keys."""
    pairs = daily.join(extras.select(*keys, name, "date", F.col(value).alias("pred")), [*keys, "date"])
    return core_metrics(pairs, [*keys, name], agreement=False).select(*keys, name, "r", "n")


def lagged_fit(daily: DataFrame, series: DataFrame, max_lag: int = 2, pred: str = "p50", keys: Sequence[str] = ()) -> DataFrame:
    """Metrics for every shift of the model series by -max_lag..max_lag days of the calendar, within the span of the series.

    ``keys`` tell several series apart, such as reaches; samples that carry a key meet their own series only. Days without a
    model value stay empty when shifted.
    """
    keys = list(keys)
    ends = series.groupBy(*keys).agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    lags = F.explode(F.array(*[F.lit(k) for k in range(-max_lag, max_lag + 1)]))
    moved = series.select(*keys, "date", F.col(pred).alias("pred"), lags.alias("lag"))
    moved = _attach(moved.withColumn("date", F.date_add("date", F.col("lag"))), ends, keys)
    moved = moved.where(F.col("date").between(F.col("_a"), F.col("_b"))).drop("_a", "_b")
    shared = [k for k in keys if k in daily.columns]
    pairs = daily.select(*shared, "date", "obs").join(moved, [*shared, "date"])
    return core_metrics(pairs, [*keys, "lag"], agreement=False).select(*keys, "lag", "n", "r", "r2", "rmse", "mae", "nse")


def best_lag(by_lag: DataFrame, choose_by: str = "r", keys: Sequence[str] = ()) -> DataFrame:
    """The shift with the highest r or NSE; the first one wins a tie, a missing score loses."""
    score = F.coalesce(F.col("nse" if choose_by.lower() == "nse" else "r"), F.lit(float("-inf")))
    best = F.max_by(F.struct("lag", "r", "r2", "rmse", "mae", "nse"), F.struct(score, -F.col("lag")))
    return by_lag.groupBy(*keys).agg(best.alias("b")).select(
        *keys, F.col("b.lag").alias("best_lag_days"), F.lit("NSE" if choose_by.lower() == "nse" else "r").alias("metric"),
        "b.r", "b.r2", "b.rmse", "b.mae", "b.nse")


def local_window_summary(matched: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Fit and lag spread of local-window matches."""
    core = core_metrics(matched, keys, agreement=False).select(*keys, "n", "rmse", "mae", "bias", "nse")
    lag = exact_quantiles(matched, keys, "k_days", {"median_lag_days": 0.5, "_q25": 0.25, "_q75": 0.75})
    lag = lag.select(*keys, "median_lag_days", (F.col("_q75") - F.col("_q25")).alias("iqr_lag_days"))
    zero = matched.groupBy(*keys).agg(F.avg(F.when(F.col("k_days") == 0, 1.0).otherwise(0.0)).alias("fraction_zero_lag"))
    return _attach(_attach(core, lag, keys), zero, keys)


def data_usage(q: DataFrame, daily: DataFrame, start: str | None = None, end: str | None = None,
               any_of: Sequence[str] = ("p05", "p50", "p95"), pred: str = "p50", keys: Sequence[str] = ()) -> DataFrame:
    """How many model, sample and paired days a view uses; samples count by the largest series. One row for each series with model days.

    Model days are those of the calendar from the first to the last, with a value or not.
    """
    def inside(c: Column) -> Column:
        ok = F.lit(True)
        if start is not None:
            ok = ok & (c >= F.lit(start).cast("date"))
        if end is not None:
            ok = ok & (c <= F.lit(end).cast("date"))
        return ok

    present = F.coalesce(*[F.col(c) for c in any_of]).isNotNull()
    n = lambda cond: F.count(F.when(cond, 1))
    a, b = F.min("date").cast("date"), F.max("date").cast("date")
    from_ = a if start is None else F.greatest(a, F.lit(start).cast("date"))
    upto = b if end is None else F.least(b, F.lit(end).cast("date"))
    span = lambda x, y: F.coalesce(F.greatest(F.date_diff(y, x) + 1, F.lit(0)), F.lit(0)).cast("long")
    sim = q.groupBy(*keys).agg(
        span(a, b).alias("sim_days_total"), n(present).alias("sim_days_finite"), span(from_, upto).alias("sim_days_windowed"),
        n(present & inside(F.col("date"))).alias("sim_days_windowed_finite"))
    ok = F.col("obs").isNotNull()
    per = daily.groupBy(*keys, "station", "analyte").agg(
        F.count(F.lit(1)).alias("t"), n(ok).alias("f"), n(inside(F.col("date"))).alias("w"),
        n(ok & inside(F.col("date"))).alias("wf"))
    obs = per.groupBy(*keys).agg(F.max("t").alias("measured_days_total"), F.max("f").alias("measured_days_finite"),
                  F.max("w").alias("measured_days_windowed"), F.max("wf").alias("measured_days_windowed_finite"))
    paired = (daily.where(ok & inside(F.col("date"))).join(q.where(F.col(pred).isNotNull()).select(*keys, "date"), [*keys, "date"])
              .groupBy(*keys).agg(F.count(F.lit(1)).alias("paired_days_used")))
    pct = lambda a, b: F.coalesce(100 * div(a, b), F.lit(0.0))
    return (_attach(_attach(sim, obs, keys), paired, keys)
            .fillna(0, ["measured_days_total", "measured_days_finite", "measured_days_windowed", "measured_days_windowed_finite", "paired_days_used"])
            .withColumn("sim_usage_percent", pct("sim_days_windowed_finite", "sim_days_total"))
            .withColumn("measured_usage_percent", pct("measured_days_windowed_finite", "measured_days_total"))
            .withColumn("paired_usage_percent",
                        pct("paired_days_used", F.greatest("sim_days_total", "measured_days_total"))))


def distribution_summary(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean, spread and percentiles of one column."""
    probs = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
    base = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"),
        F.var_pop(value).alias("var"), F.min(value).alias("min"), F.max(value).alias("max"))
    return _attach(base, exact_quantiles(df, keys, value, probs), keys)


def residual_moments(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, sd and population skew of obs - pred, and the least-squares line of obs on pred."""
    r = pairs.where(F.col("obs").isNotNull() & F.col("pred").isNotNull()).withColumn("_e", F.col("obs") - F.col("pred"))
    if keys:
        r = r.join(r.groupBy(*keys).agg(F.avg("_e").alias("_em")), list(keys))
    else:
        r = r.withColumn("_em", r.agg(F.avg("_e")).scalar())
    e = F.col("_e") - F.col("_em")
    s = r.groupBy(*keys).agg(
        F.avg("_e").alias("resid_mean"), F.stddev_pop("_e").alias("resid_sd"), F.avg(e * e * e).alias("_m3"),
        F.covar_pop("obs", "pred").alias("_cov"), F.var_pop("pred").alias("_vm"),
        F.avg("obs").alias("_my"), F.avg("pred").alias("_mm"))
    slope = div("_cov", "_vm")
    return s.select(*keys, "resid_mean", "resid_sd",
                    div("_m3", F.pow("resid_sd", F.lit(3))).alias("resid_skew"),
                    slope.alias("slope"), (F.col("_my") - slope * F.col("_mm")).alias("intercept"))


def residual_histogram(pairs: DataFrame, bins: int = 30, keys: Sequence[str] = ()) -> DataFrame:
    """Equal-width histogram of obs - pred of each series; the last bin includes its upper edge."""
    keys = list(keys)
    r = pairs.where(F.col("obs").isNotNull() & F.col("pred").isNotNull()).select(*keys, (F.col("obs") - F.col("pred")).alias("e"))
    r = _attach(r, r.groupBy(*keys).agg(F.min("e").alias("_lo"), F.max("e").alias("_hi")), keys)
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.least(F.floor(F.coalesce(div(F.col("e") - F.col("_lo"), width), F.lit(0.0))), F.lit(bins - 1))
    return (r.groupBy(*keys, b.cast("int").alias("bin"), "_lo", width.alias("_w")).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("bin_lo", F.col("_lo") + F.col("bin") * F.col("_w")).drop("_lo", "_w"))
