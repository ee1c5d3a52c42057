"""Queries on pairing, goodness of fit, events and scenario shifts."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.operators import ensemble, events, fit, pairing, select, shift
from freshet.plans import views
from freshet.plans.registry import Registry

KEYS = ["rch", "variable"]

# analytes that stand in for a model variable, by weight
PROXIES = [("load", 1, 100, "F"), ("load", 1, 90, "O"), ("tot_n", 2, 70, "P"), ("tot_n", 2, 10, "F")]


def model(s, d):
    """Loads of every run, reach and variable, in tonnes or kg a day."""
    wide = views.sim(s, d).select("run_id", "rch", "date", (F.col("load_kg") / 1000).alias("load"), "tot_n")
    return wide.unpivot(["run_id", "rch", "date"], ["load", "tot_n"], "variable", "v")


def reach_fan(s, d):
    """Daily fan of every reach and variable."""
    return ensemble.fan(model(s, d), KEYS, "v", (5, 25, 50, 75, 90, 95))


def daily(s, d):
    return pairing.measured_daily(select.clean_measured(views.measured(s, d), negative="zero"))


def sites(s, d):
    """Sampling points and analytes with the reach and variable they stand for."""
    mapping = s.createDataFrame(PROXIES, "entry string, pos int, weight int, analyte string")
    found = pairing.resolve_proxies(mapping, mapping.select(F.col("entry").alias("variable")))
    return views.stations(s, d).join(found, "analyte").select("station", "analyte", *KEYS)


def sited(s, d):
    """Daily samples of every sampling point, with their reach and variable."""
    return pairing.at_sites(pairing.measured_daily(select.clean_measured(views.samples(s, d), negative="zero")), sites(s, d))


def pairs(s, d):
    return pairing.pair_same_day(sited(s, d), reach_fan(s, d), by=KEYS)


def scenarios(s, d):
    """Every run read as a named scenario of its reach and variable."""
    return model(s, d).select(*KEYS, F.concat(F.lit("s"), "run_id").alias("scenario"), "date", F.col("v").alias("value"))


def scenario_pairs(s, d):
    return pairing.pair_scenarios(scenarios(s, d), reach_fan(s, d), by=KEYS)


def flow_day(s, d):
    return ensemble.external_daily_flow(views.flow(s, d))


def flow_events(s, d):
    return events.daily_events(flow_day(s, d), "p75", 2)


def event_table(s, d):
    return events.event_days(flow_events(s, d), 1)


views.SQL["pairs"] = """
    SELECT rch, variable, station, analyte, date, obs, p50 AS pred, min, p05, p25, p50, p75, p95, max
    FROM sited JOIN q3 USING (rch, variable, date) WHERE obs IS NOT NULL AND p50 IS NOT NULL"""
views.SQL["scen"] = """
    SELECT rch, variable, 's' || run_id AS scenario, date, v AS overlay FROM reach_load"""
views.SQL["spairs"] = """
    SELECT rch, variable, scenario, date, overlay, p50 AS base, p50 - overlay AS delta,
           abs(p50 - overlay) / nullif(abs(p50), 0) AS rel, 100 * (p50 - overlay) / nullif(abs(p50), 0) AS pct
    FROM scen JOIN q3 USING (rch, variable, date)"""
views.SQL["flag"] = """
    SELECT *, q >= (SELECT quantile_cont(q, 0.75) FROM fd) AS above FROM fd"""
views.SQL["fd"] = "SELECT date, flow_m3d AS q FROM flow_day"
views.SQL["flagrun"] = """
    SELECT *, row_number() OVER (ORDER BY date) - row_number() OVER (PARTITION BY above ORDER BY date) AS run FROM flag"""
views.SQL["ev"] = """
    SELECT date, q, above AND count(*) OVER (PARTITION BY above, run) >= ceil(2 / (
        SELECT quantile_cont(g, 0.5) FROM (SELECT date_diff('day', lag(date) OVER (ORDER BY date), date) AS g FROM fd))) AS is_event
    FROM flagrun"""
views.SQL["evdays"] = """
    SELECT date, is_event, date IN (SELECT CAST(unnest([date - 1, date, date + 1]) AS DATE) FROM ev WHERE is_event) AS is_buffered
    FROM ev"""

Q3 = "sim reach_load q3"
DAILY = "measured cleaned daily"
SITED = "samples stations sites sited"
PAIRS = f"{Q3} {SITED} pairs"
K = "rch, variable"
SPAIRS = f"{Q3} scen spairs"
EV = "flow flow_day fd flag flagrun ev evdays"


def metrics_sql(source: str, keys: str = "", y: str = "obs", m: str = "pred", extra: str = "") -> str:
    """Full metric set over pairs, in SQL."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""
      SELECT {k}n, r, r * r AS r2, sad / n AS mae, sqrt(sse / n) AS rmse, sd / n AS bias, 100 * sd / nullif(sumy, 0) AS pbias,
             1 - sse / nullif(sso, 0) AS nse, 1 - sse / nullif(sso, 0) AS nse_rel,
             1 - sqrt(pow(r - 1, 2) + pow(sm / nullif(sy, 0) - 1, 2) + pow(mm / nullif(my, 0) - 1, 2)) AS kge,
             medae, 1 - sse / nullif(pe, 0) AS d, 1 - sse / nullif(pe, 0) AS d_rel, sqrt(sse) / nullif(sqrt(sso), 0) AS rsr
      FROM (
        SELECT {k}count(*) AS n, CASE WHEN count(*) >= 2 AND stddev_pop(y) > 0 AND stddev_pop(m) > 0 THEN
                 covar_pop(y, m) / (stddev_pop(y) * stddev_pop(m)) END AS r,
               sum(abs(y - m)) AS sad, sum((y - m) * (y - m)) AS sse, sum(y - m) AS sd, sum(y) AS sumy, avg(y) AS my, avg(m) AS mm,
               stddev_pop(y) AS sy, stddev_pop(m) AS sm, sum(pow(y - ybar, 2)) AS sso,
               sum(pow(abs(m - ybar) + abs(y - ybar), 2)) AS pe, quantile_cont(abs(y - m), 0.5) AS medae
        FROM (SELECT {k}{y} AS y, {m} AS m, avg({y}) OVER ({part}) AS ybar FROM {source}
              WHERE {y} IS NOT NULL AND {m} IS NOT NULL {extra}) AS p {group})"""


FULL = "r r2 mae rmse bias pbias nse nse_rel kge medae d d_rel rsr"


def register(r: Registry) -> None:
    # pairing
    def loads(nonnum, negative):
        return lambda s, d: (pairing.samples_to_load(views.measured(s, d), views.flow(s, d), nonnum, negative)
                             .groupBy("station", "analyte", "date").agg(F.count(F.lit(1)).alias("n"), F.avg("kg_per_day").alias("kg_per_day")))

    for nonnum, negative in (("as_na", "zero"), ("drop", "drop"), ("half_MDL", "zero"), ("zero", "keep")):
        conc = "CASE WHEN v < 0 THEN 0.0 ELSE v END" if negative == "zero" else "v"
        conc = {"zero": f"coalesce({conc}, 0.0)", "half_MDL": f"coalesce({conc}, 0.1)"}.get(nonnum, conc)
        cond = ("WHERE v >= 0 " if negative == "drop" else "WHERE TRUE ") + ("AND v IS NOT NULL AND f.q IS NOT NULL" if nonnum == "drop" else "")
        r.add(f"j1_samples_to_load_{nonnum.lower()}_{negative}", loads(nonnum, negative), f"""
            SELECT station, analyte, c.date AS date, count(*) AS n, avg({conc} * f.q * 0.001) AS kg_per_day FROM cleaned c
            LEFT JOIN (SELECT CAST(date AS DATE) AS date, avg(flow_m3d) AS q FROM flow GROUP BY 1) f ON f.date = c.date
            {cond} GROUP BY 1, 2, 3""", "measured cleaned flow", "kg_per_day", "station analyte date n")

    r.add("a8_measured_daily",
          lambda s, d: pairing.measured_daily(select.clean_measured(views.measured(s, d)), analytes=["F", "O"],
                                              stations=["1-URGENT", "2-HIGH"], start="1996-01-01", end="1999-12-31", months=[4, 5, 6, 7, 8, 9]),
          """SELECT station, analyte, date, avg(v) AS obs FROM cleaned WHERE analyte IN ('F', 'O') AND station IN ('1-URGENT', '2-HIGH')
             AND date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND month(date) BETWEEN 4 AND 9 GROUP BY 1, 2, 3""",
          "measured cleaned", "obs", "station analyte date")
    r.add("a9_measured_period_total", lambda s, d: pairing.measured_period_total(daily(s, d), "M"), """
        WITH days AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS day FROM daily),
        n AS (SELECT last_day(day) AS date, CAST(count(*) AS DOUBLE) AS n_days FROM days GROUP BY 1),
        m AS (SELECT station, analyte, last_day(x.date) AS date, avg(obs) AS obs FROM daily x GROUP BY 1, 2, 3)
        SELECT station, analyte, m.date AS date, obs, n_days, obs * n_days AS obs_total FROM m JOIN n ON n.date = m.date""",
          DAILY, "obs n_days obs_total", "station analyte date")
    r.add("j3_same_day_pairs", pairs, "SELECT * FROM pairs", PAIRS, "obs pred p05 p95", "rch variable station analyte date")
    r.add("j4_scenario_baseline_pairs", scenario_pairs, "SELECT * FROM spairs", SPAIRS, "base overlay", "rch variable scenario date")

    def window_sql(k: int, mean: bool = False) -> str:
        near = f"FROM sited x JOIN q3 ON q3.rch = x.rch AND q3.variable = x.variable AND q3.date BETWEEN x.date - {k} AND x.date + {k} WHERE obs IS NOT NULL"
        if mean:
            return f"""SELECT x.rch AS rch, x.variable AS variable, station, analyte, x.date AS date, obs, avg(p50) AS pred, 0 AS k_days {near} GROUP BY 1, 2, 3, 4, 5, 6"""
        return f"""SELECT rch, variable, station, analyte, date, obs, pred, CAST(k_days AS INTEGER) AS k_days FROM (
            SELECT x.rch AS rch, x.variable AS variable, station, analyte, x.date AS date, obs, p50 AS pred, date_diff('day', x.date, q3.date) AS k_days,
                   row_number() OVER (PARTITION BY x.rch, x.variable, station, analyte, x.date ORDER BY abs(p50 - obs), q3.date) AS rn {near}) WHERE rn = 1"""

    keys = "rch variable station analyte date"
    for k in (1, 3):
        r.add(f"j5_local_window_nearest_{k}", lambda s, d, k=k: pairing.match_local_window(sited(s, d), reach_fan(s, d), k, by=KEYS),
              window_sql(k), f"{Q3} {SITED}", "obs pred", f"{keys} k_days")
    r.add("j5_local_window_mean_2", lambda s, d: pairing.match_local_window(sited(s, d), reach_fan(s, d), 2, "mean", by=KEYS),
          window_sql(2, True), f"{Q3} {SITED}", "obs pred", f"{keys} k_days")
    nearest = """
        SELECT * FROM (
          SELECT x.rch AS rch, x.variable AS variable, station, analyte, x.date AS date, obs, q3.date AS model_date, min, p05, p25, p50, p75, p95, max, mean,
                 row_number() OVER (PARTITION BY x.rch, x.variable, station, analyte, x.date
                                    ORDER BY abs(date_diff('day', x.date, q3.date)), q3.date DESC) AS rn
          FROM sited x JOIN q3 ON q3.rch = x.rch AND q3.variable = x.variable AND q3.date BETWEEN x.date - 1 AND x.date + 1 WHERE obs IS NOT NULL) WHERE rn = 1"""
    views.SQL["nearest"] = nearest
    cols = ["min", "p05", "p25", "p50", "p75", "p95", "max", "mean"]
    r.add("j6_nearest_day", lambda s, d: pairing.match_nearest_day(sited(s, d), reach_fan(s, d), cols, by=KEYS),
          "SELECT * FROM nearest", f"{Q3} {SITED} nearest", "obs min p50 max", f"{keys} model_date")

    proxy_map = [("TOT_N", 1, 100, "F"), ("TOT_N", 1, 90, "O"), ("TOT_N", 1, 90, "X"), ("TOT_N", 1, 70, "P"), ("TOT_N", 1, 10, "Z"),
                 ("TOT_P", 2, 1, "P"), ("TOT_P", 2, 2, "F")]
    r.add("j11_measured_proxies",
          lambda s, d: pairing.proxies(s.createDataFrame(proxy_map, "entry string, pos int, weight int, analyte string"),
                                       s.createDataFrame([(v,) for v in ("TOT_N", "tot_p", "TOT_Nkg", "none")], "variable string"), views.measured(s, d)), """
        SELECT variable, CAST(category AS INTEGER) AS category, m.analyte AS analyte, n_samples FROM (VALUES
          ('TOT_N', 1, 'F'), ('TOT_N', 2, 'O'), ('TOT_N', 3, 'P'), ('TOT_Nkg', 1, 'F'), ('TOT_Nkg', 2, 'O'), ('TOT_Nkg', 3, 'P'),
          ('tot_p', 1, 'P'), ('tot_p', 2, 'F')) AS t(variable, category, analyte)
        JOIN (SELECT analyte, count(*) AS n_samples FROM measured GROUP BY 1) m ON m.analyte = t.analyte""",
          "measured", "", "variable category analyte n_samples")
    r.add("j11_sites", sites, "SELECT * FROM sites", "stations sites", "", "rch variable station analyte")
    r.add("p18_deviation_flags",
          lambda s, d: pairing.flag_deviation(sited(s, d), reach_fan(s, d), event_table(s, d).where("is_buffered"), 3.0, KEYS),
          """SELECT d.rch AS rch, d.variable AS variable, station, analyte, d.date AS date, obs, abs(obs) / nullif(abs(p90), 0) AS ratio,
               CASE WHEN e.is_buffered THEN 'flow-outlier' WHEN abs(obs) / nullif(abs(p90), 0) >= 3
                      OR abs(obs) / nullif(abs(p90), 0) <= 1.0 / 3 THEN 'deviation' ELSE 'kept' END AS label
             FROM sited d LEFT JOIN q3 ON q3.rch = d.rch AND q3.variable = d.variable AND q3.date = d.date LEFT JOIN evdays e ON e.date = d.date AND e.is_buffered""",
          f"{Q3} {SITED} {EV}", "obs ratio", f"{keys} label")

    # metrics
    r.add("m11_pairwise_metrics", lambda s, d: fit.pairwise_metrics(pairs(s, d), KEYS), metrics_sql("pairs", K), PAIRS, FULL, f"{K} n".replace(",", ""))
    r.add("m1_to_m10_metrics_by_station", lambda s, d: fit.pairwise_metrics(pairs(s, d), [*KEYS, "station", "analyte"]),
          metrics_sql("pairs", f"{K}, station, analyte"), PAIRS, FULL, "rch variable station analyte n")
    vs = "r rmse mae nse nse_rel d d_rel rsr bias"
    r.add("m12_versus_series", lambda s, d: fit.versus_series(pairs(s, d), "p95", KEYS, pred="p95"),
          "SELECT rch, variable, " + ", ".join(f"{c} AS vs_p95_{c}" for c in vs.split()) + f" FROM ({metrics_sql('pairs', K, m='p95')})",
          PAIRS, " ".join(f"vs_p95_{c}" for c in vs.split()), "rch variable")
    r.add("m8_log_metrics", lambda s, d: fit.log_metrics(pairs(s, d), KEYS),
          "SELECT rch, variable, n AS n_pos, r AS r_log, r2 AS r2_log, rmse AS rmse_log10, mae AS mae_log10, nse AS nse_log, d AS d_log FROM ("
          + metrics_sql("(SELECT rch, variable, log10(obs) AS obs, log10(pred) AS pred FROM pairs WHERE obs > 0 AND pred > 0) lg", K) + ")",
          PAIRS, "r_log r2_log rmse_log10 mae_log10 nse_log d_log", "rch variable n_pos")
    cov = ", ".join(f"avg(CASE WHEN obs BETWEEN {lo} AND {hi} THEN 1.0 ELSE 0.0 END) AS {n}" for n, (lo, hi) in fit.COVERAGE.items())
    r.add("m13_coverage", lambda s, d: fit.coverage(pairs(s, d), KEYS),
          f"SELECT {K}, {cov} FROM pairs GROUP BY 1, 2", PAIRS, "coverage50 coverage90 coverage100", "rch variable")
    near_cov = (cov + ", avg(CASE WHEN obs BETWEEN min AND max THEN 1.0 ELSE 0.0 END) AS coverage_minmax")
    r.add("m14_band_coverage_nearest_day",
          lambda s, d: fit.band_coverage(pairing.match_nearest_day(sited(s, d), reach_fan(s, d), cols, by=KEYS), [*KEYS, "analyte"]),
          f"SELECT {K}, analyte, {near_cov} FROM nearest GROUP BY 1, 2, 3", f"{Q3} {SITED} nearest",
          "coverage50 coverage90 coverage100 coverage_minmax", "rch variable analyte")

    def moved_bands(s, d):
        series = ensemble.relative_bands(reach_fan(s, d), scenarios(s, d), [*KEYS, "date"], ["scenario"]).withColumnRenamed("mean", "center")
        names = ["min", "p05", "p25", "p75", "p95", "max", "center"]
        return fit.band_coverage(pairing.match_nearest_day(sited(s, d), series, names, by=[*KEYS, "scenario"]), [*KEYS, "scenario"], "center")

    moved_sql = """(SELECT * FROM (SELECT x.rch AS rch, x.variable AS variable, scenario, obs, overlay + (min - mean) AS min, overlay + (p05 - mean) AS p05, overlay + (p25 - mean) AS p25,
            overlay + (p75 - mean) AS p75, overlay + (p95 - mean) AS p95, overlay + (max - mean) AS max,
            row_number() OVER (PARTITION BY x.rch, x.variable, scenario, station, analyte, x.date ORDER BY abs(date_diff('day', x.date, scen.date)), scen.date DESC) AS rn
          FROM sited x JOIN scen ON scen.rch = x.rch AND scen.variable = x.variable AND scen.date BETWEEN x.date - 1 AND x.date + 1
          JOIN q3 ON q3.rch = x.rch AND q3.variable = x.variable AND q3.date = scen.date WHERE obs IS NOT NULL) WHERE rn = 1)"""
    r.add("m14_band_coverage_by_scenario", moved_bands, f"SELECT {K}, scenario, {near_cov} FROM {moved_sql} GROUP BY 1, 2, 3", f"{Q3} {SITED} scen",
          "coverage50 coverage90 coverage100 coverage_minmax", "rch variable scenario")

    def bare(s, d):  # bands with only min, max and mean: percentiles are read off between them
        q = reach_fan(s, d).withColumns({c: F.lit(None).cast("double") for c in ("p05", "p25", "p50", "p75", "p95")})
        return fit.band_coverage(pairing.match_nearest_day(sited(s, d), q, cols, by=KEYS), [*KEYS, "analyte"])

    r.add("m14_band_coverage_approximated", bare,
          f"SELECT {K}, analyte, " + ", ".join(
              f"avg(CASE WHEN obs BETWEEN min + (max - min) * {lo} AND min + (max - min) * {hi} THEN 1.0 ELSE 0.0 END) AS {n}"
              for n, lo, hi in (("coverage50", 0.25, 0.75), ("coverage90", 0.05, 0.95), ("coverage100", 0, 1)))
          + " FROM nearest GROUP BY 1, 2, 3", f"{Q3} {SITED} nearest", "coverage50 coverage90 coverage100", "rch variable analyte")

    def dev_sql(lo, hi, prefix=""):
        return f"""avg({hi} - {lo}) AS {prefix}band_width_mean, avg(100 * ({hi} - {lo}) / nullif(abs(mean), 0)) AS {prefix}band_width_rel_pct,
            avg(2 * (mean - {lo}) / nullif({hi} - {lo}, 0) - 1) AS {prefix}band_asymmetry,
            sqrt(sum(pow({lo} - mean, 2) + pow({hi} - mean, 2)) / (2 * count(*))) AS {prefix}band_rmse_vs_mean"""

    names = "band_width_mean band_width_rel_pct band_asymmetry band_rmse_vs_mean"
    r.add("m15_band_deviation", lambda s, d: fit.band_deviation(reach_fan(s, d), KEYS), f"SELECT {K}, {dev_sql('min', 'max')} FROM q3 GROUP BY 1, 2", Q3, names, "rch variable")
    r.add("m16_percentile_band_deviation", lambda s, d: fit.percentile_band_deviation(reach_fan(s, d), KEYS),
          f"SELECT {K}, {dev_sql('p25', 'p75', 'p50_')}, {dev_sql('p05', 'p95', 'p90_')} FROM q3 GROUP BY 1, 2", Q3,
          " ".join(f"p50_{n}" for n in names.split()) + " " + " ".join(f"p90_{n}" for n in names.split()), "rch variable")
    moved = "min p05 p25 p50 p75 p95 max"
    r.add("m17_relative_bands",
          lambda s, d: ensemble.relative_bands(reach_fan(s, d), scenarios(s, d), [*KEYS, "date"], ["scenario"]),
          f"SELECT {K}, scenario, date, overlay AS mean, " + ", ".join(f"overlay + (q3.{c} - q3.mean) AS {c}" for c in moved.split())
          + " FROM scen LEFT JOIN q3 USING (rch, variable, date)", f"{Q3} scen", f"mean {moved}", "rch variable scenario date")
    r.add("m18_extra_correlations",
          lambda s, d: fit.correlation_with(sited(s, d), scenarios(s, d), name="scenario", keys=KEYS),
          f"SELECT {K}, scenario, n, r FROM (" + metrics_sql("(SELECT rch, variable, scenario, obs, overlay AS pred FROM sited JOIN scen USING (rch, variable, date)) c", f"{K}, scenario") + ")",
          f"{Q3} {SITED} scen", "r", "rch variable scenario n")
    lag_src = """(SELECT rch, variable, lag, obs, pred FROM sited JOIN (
        SELECT rch, variable, CAST(date + lag AS DATE) AS date, lag, p50 AS pred FROM (SELECT *, min(date) OVER w AS a, max(date) OVER w AS b FROM q3 WINDOW w AS (PARTITION BY rch, variable)),
          (SELECT unnest([-2, -1, 0, 1, 2])::INTEGER AS lag) WHERE date + lag BETWEEN a AND b) z USING (rch, variable, date)) l"""
    lag_sql = f"SELECT {K}, CAST(lag AS INTEGER) AS lag, n, r, r2, rmse, mae, nse FROM (" + metrics_sql(lag_src, f"{K}, lag") + ")"
    lagged = lambda s, d: fit.lagged_fit(sited(s, d), reach_fan(s, d), keys=KEYS)
    r.add("m19_lagged_fit", lagged, lag_sql, f"{Q3} {SITED}", "r r2 rmse mae nse", "rch variable lag n")
    for by in ("r", "nse"):
        r.add(f"m19_best_lag_by_{by}", lambda s, d, by=by: fit.best_lag(lagged(s, d), by, KEYS),
              f"""SELECT {K}, lag AS best_lag_days, '{'NSE' if by == 'nse' else 'r'}' AS metric, r, r2, rmse, mae, nse FROM (
                  SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY coalesce({by}, '-inf'::DOUBLE) DESC, lag) AS k FROM ({lag_sql})) WHERE k = 1""",
              f"{Q3} {SITED}", "r r2 rmse mae nse", "rch variable best_lag_days metric")

    def every_fan(s, d):
        """Daily fans of all reaches."""
        load = views.sim(s, d).select("run_id", "rch", "date", (F.col("load_kg") / 1000).alias("v"))
        return ensemble.fan(load, ["rch"], "v", (50,))

    def at_reach(s, d):
        """Daily samples of every analyte, with the reach of their sampling point."""
        return pairing.measured_daily(select.clean_measured(views.samples(s, d), negative="zero")).join(views.stations(s, d), ["station", "analyte"])

    every = "(SELECT rch, date, quantile_cont(load_kg / 1000, 0.5) AS p50 FROM sim WHERE load_kg IS NOT NULL GROUP BY 1, 2)"
    every_lag = metrics_sql(f"""(SELECT rch, lag, obs, pred FROM (SELECT DISTINCT rch, station, analyte, date, obs FROM (
        SELECT station, analyte, CAST(date AS DATE) AS date, avg(CASE WHEN TRY_CAST(value AS DOUBLE) < 0 THEN 0.0 ELSE TRY_CAST(value AS DOUBLE) END) AS obs FROM samples GROUP BY 1, 2, 3) JOIN stations USING (station, analyte)) d JOIN (
        SELECT rch, CAST(date + lag AS DATE) AS date, lag, p50 AS pred FROM (SELECT *, min(date) OVER w AS a, max(date) OVER w AS b FROM {every} WINDOW w AS (PARTITION BY rch)),
          (SELECT unnest([-2, -1, 0, 1, 2])::INTEGER AS lag) WHERE date + lag BETWEEN a AND b) z USING (rch, date)) l""", "rch, lag")
    every_fit = lambda s, d: fit.lagged_fit(at_reach(s, d), every_fan(s, d), keys=["rch"])
    r.add("m19_lagged_fit_all_reaches", every_fit, f"SELECT rch, CAST(lag AS INTEGER) AS lag, n, r, r2, rmse, mae, nse FROM ({every_lag})", "sim samples stations", "r r2 rmse mae nse", "rch lag n")
    r.add("m19_best_lag_all_reaches", lambda s, d: fit.best_lag(every_fit(s, d), "r", ["rch"]), f"""
        SELECT rch, CAST(lag AS INTEGER) AS best_lag_days, 'r' AS metric, r, r2, rmse, mae, nse FROM (
          SELECT *, row_number() OVER (PARTITION BY rch ORDER BY coalesce(r, '-inf'::DOUBLE) DESC, lag) AS k FROM ({every_lag})) WHERE k = 1""",
          "sim samples stations", "r r2 rmse mae nse", "rch best_lag_days metric")
    for k in (1, 3):
        body = metrics_sql(f"({window_sql(k)}) lw", K)
        r.add(f"m20_local_window_summary_{k}",
              lambda s, d, k=k: fit.local_window_summary(pairing.match_local_window(sited(s, d), reach_fan(s, d), k, by=KEYS), KEYS),
              f"""SELECT {K}, n, rmse, mae, bias, nse, z.* EXCLUDE (rch, variable) FROM ({body}) JOIN (
                    SELECT {K}, quantile_cont(k_days, 0.5) AS median_lag_days, quantile_cont(k_days, 0.75) - quantile_cont(k_days, 0.25) AS iqr_lag_days,
                           avg(CASE WHEN k_days = 0 THEN 1.0 ELSE 0.0 END) AS fraction_zero_lag FROM ({window_sql(k)}) GROUP BY 1, 2) z USING (rch, variable)""",
              f"{Q3} {SITED}", "rmse mae bias nse median_lag_days iqr_lag_days fraction_zero_lag", "rch variable n")
    usage = ("sim_days_total sim_days_finite sim_days_windowed sim_days_windowed_finite measured_days_total measured_days_finite "
             "measured_days_windowed measured_days_windowed_finite paired_days_used")
    w = "date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'"
    r.add("m21_data_usage", lambda s, d: fit.data_usage(reach_fan(s, d), sited(s, d), "1996-01-01", "1999-12-31", keys=KEYS), f"""
        WITH a AS (SELECT {K}, date_diff('day', min(date)::DATE, max(date)::DATE) + 1 AS sim_days_total, count(p50) AS sim_days_finite,
                          greatest(0, date_diff('day', greatest(min(date)::DATE, DATE '1996-01-01'), least(max(date)::DATE, DATE '1999-12-31')) + 1) AS sim_days_windowed,
                          count(p50) FILTER (WHERE {w}) AS sim_days_windowed_finite FROM q3 GROUP BY 1, 2),
        b AS (SELECT {K}, max(t) AS measured_days_total, max(f) AS measured_days_finite, max(w) AS measured_days_windowed,
                     max(wf) AS measured_days_windowed_finite FROM (
                SELECT {K}, station, analyte, count(*) AS t, count(obs) AS f, count(*) FILTER (WHERE {w}) AS w,
                       count(obs) FILTER (WHERE {w}) AS wf FROM sited GROUP BY 1, 2, 3, 4) GROUP BY 1, 2),
        c AS (SELECT {K}, count(*) AS paired_days_used FROM pairs WHERE {w} GROUP BY 1, 2),
        u AS (SELECT a.*, coalesce(measured_days_total, 0) AS measured_days_total, coalesce(measured_days_finite, 0) AS measured_days_finite,
                     coalesce(measured_days_windowed, 0) AS measured_days_windowed, coalesce(measured_days_windowed_finite, 0) AS measured_days_windowed_finite,
                     coalesce(paired_days_used, 0) AS paired_days_used FROM a LEFT JOIN b USING (rch, variable) LEFT JOIN c USING (rch, variable))
        SELECT *, 100.0 * sim_days_windowed_finite / sim_days_total AS sim_usage_percent,
               coalesce(100.0 * measured_days_windowed_finite / nullif(measured_days_total, 0), 0) AS measured_usage_percent,
               100.0 * paired_days_used / greatest(sim_days_total, measured_days_total) AS paired_usage_percent FROM u""",
          PAIRS, "sim_usage_percent measured_usage_percent paired_usage_percent", f"rch variable {usage}")
    summary = "mean sd var min max p05 p25 median p75 p95"
    for name, src, v, by, ctes, fn in (
            ("observed", "daily", "obs", "station", DAILY, lambda s, d: fit.distribution_summary(daily(s, d), "obs", ["station"])),
            ("paired", "pairs", "pred", K, PAIRS, lambda s, d: fit.distribution_summary(pairs(s, d), "pred", KEYS))):
        r.add(f"a21_distribution_{name}", fn, f"""
            SELECT {by}, count({v}) AS n, avg({v}) AS mean, stddev_pop({v}) AS sd, var_pop({v}) AS var, min({v}) AS min, max({v}) AS max,
                   quantile_cont({v}, 0.05) AS p05, quantile_cont({v}, 0.25) AS p25, quantile_cont({v}, 0.5) AS median,
                   quantile_cont({v}, 0.75) AS p75, quantile_cont({v}, 0.95) AS p95 FROM {src} GROUP BY {by}""",
              ctes, summary, f"{by.replace(',', '')} n")
    r.add("a21_distribution_all_samples",
          lambda s, d: fit.distribution_summary(select.clean_measured(views.measured(s, d)), "value_num"),
          """SELECT count(v) AS n, avg(v) AS mean, stddev_pop(v) AS sd, var_pop(v) AS var, min(v) AS min, max(v) AS max,
                    quantile_cont(v, 0.05) AS p05, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS median,
                    quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.95) AS p95 FROM cleaned""",
          "measured cleaned", summary, "n")
    r.add("a22_residual_moments", lambda s, d: fit.residual_moments(pairs(s, d), KEYS), """
        SELECT rch, variable, avg(e) AS resid_mean, stddev_pop(e) AS resid_sd, avg(pow(e - em, 3)) / pow(stddev_pop(e), 3) AS resid_skew,
               regr_slope(obs, pred) AS slope, regr_intercept(obs, pred) AS intercept
        FROM (SELECT *, obs - pred AS e, avg(obs - pred) OVER (PARTITION BY rch, variable) AS em FROM pairs) GROUP BY 1, 2""",
          PAIRS, "resid_mean resid_sd resid_skew slope intercept", "rch variable")
    r.add("a22_residual_histogram", lambda s, d: fit.residual_histogram(pairs(s, d), keys=KEYS), """
        WITH e AS (SELECT rch, variable, obs - pred AS e FROM pairs), s AS (SELECT rch, variable, min(e) AS lo, (max(e) - min(e)) / 30 AS w FROM e GROUP BY 1, 2),
        b AS (SELECT rch, variable, CAST(least(floor(coalesce((e - lo) / nullif(w, 0), 0)), 29) AS INTEGER) AS bin, lo, w FROM e JOIN s USING (rch, variable))
        SELECT rch, variable, bin, count(*) AS n, any_value(lo) + bin * any_value(w) AS bin_lo FROM b GROUP BY 1, 2, 3""",
          PAIRS, "bin_lo", "rch variable bin n")

    # scenario shifts
    def med(x, cond=""):
        return f"quantile_cont({x}, 0.5){f' FILTER (WHERE {cond})' if cond else ''}"

    base_cols = "median_delta median_delta_pct relative_width baseline_min baseline_max baseline_mean baseline_p50 baseline_p90 " \
                "overlay_min overlay_max overlay_mean overlay_p50 overlay_p90 delta_min delta_max delta_mean delta_p50 delta_p90 " \
                "normalized_median_delta rmse r"
    by = f"{K}, scenario"
    cols_by = "rch variable scenario"
    sk = [*KEYS, "scenario"]
    for agg in ("median", "mean", "both"):
        c = "avg({0})" if agg == "mean" else "quantile_cont({0}, 0.5)"
        more = "" if agg == "median" else " mean_delta mean_delta_pct normalized_mean_delta"
        r.add(f"m22_shift_set_{agg}", lambda s, d, agg=agg: shift.shift_set(scenario_pairs(s, d), sk, agg), f"""
            SELECT *, baseline_min - overlay_min AS delta_min, baseline_max - overlay_max AS delta_max, baseline_mean - overlay_mean AS delta_mean,
                   baseline_p50 - overlay_p50 AS delta_p50, baseline_p90 - overlay_p90 AS delta_p90,
                   median_delta / nullif(baseline_p50, 0) AS normalized_median_delta, mean_delta / nullif(baseline_mean, 0) AS normalized_mean_delta
            FROM (SELECT {by}, count(*) AS n_pairs, {c.format('delta')} AS median_delta, {c.format('pct')} AS median_delta_pct,
                  avg(delta) AS mean_delta, avg(pct) AS mean_delta_pct, {med('rel')} AS relative_width,
                  min(base) AS baseline_min, max(base) AS baseline_max, avg(base) AS baseline_mean, {med('base')} AS baseline_p50,
                  quantile_cont(base, 0.9) AS baseline_p90, min(overlay) AS overlay_min, max(overlay) AS overlay_max, avg(overlay) AS overlay_mean,
                  {med('overlay')} AS overlay_p50, quantile_cont(overlay, 0.9) AS overlay_p90, sqrt(avg(delta * delta)) AS rmse,
                  CASE WHEN count(*) > 1 AND stddev_pop(base) > 0 AND stddev_pop(overlay) > 0 THEN covar_pop(base, overlay) / (stddev_pop(base) * stddev_pop(overlay)) END AS r
                  FROM spairs GROUP BY {by})""",
              SPAIRS, base_cols + more, f"{cols_by} n_pairs")
    r.add("m22_overlay_metrics", lambda s, d: shift.overlay_metrics(scenario_pairs(s, d), sk),
          f"SELECT {by}, n AS n_pairs, r, r2, mae, rmse, bias, medae FROM (" + metrics_sql("spairs", by, "overlay", "base") + ")",
          SPAIRS, "r r2 mae rmse bias medae", f"{cols_by} n_pairs")
    r.add("m23_stratified_widths", lambda s, d: shift.stratified_widths(scenario_pairs(s, d), reach_fan(s, d), keys=sk), f"""
        SELECT *, relative_width_high / nullif(relative_width_low, 0) AS relative_width_event_contrast FROM (
          SELECT {by}, {med('rel', 'base <= lo')} AS relative_width_low, {med('rel', 'base >= hi')} AS relative_width_high
          FROM spairs JOIN (SELECT {K}, quantile_cont(p50, 0.1) AS lo, quantile_cont(p50, 0.9) AS hi FROM q3 GROUP BY 1, 2) USING (rch, variable) GROUP BY {by})""",
          SPAIRS, "relative_width_low relative_width_high relative_width_event_contrast", cols_by)
    r.add("m24_event_shift", lambda s, d: shift.event_shift(scenario_pairs(s, d), event_table(s, d), sk), f"""
        SELECT *, relative_width_event / nullif(relative_width_nonevent, 0) AS event_ratio FROM (
          SELECT {by}, {med('rel', 'is_buffered')} AS relative_width_event, {med('rel', 'NOT is_buffered')} AS relative_width_nonevent,
                 count(rel) FILTER (WHERE is_buffered) AS event_pairs, count(rel) FILTER (WHERE NOT is_buffered) AS non_event_pairs,
                 {med('delta', 'is_buffered')} AS delta_event_pairs, {med('delta', 'NOT is_buffered')} AS delta_non_event_pairs,
                 avg(delta) FILTER (WHERE is_buffered) AS delta_event_pairs_mean, avg(delta) FILTER (WHERE NOT is_buffered) AS delta_non_event_pairs_mean
          FROM spairs LEFT JOIN evdays ON evdays.date = spairs.date GROUP BY {by})""",
          f"{SPAIRS} {EV}", "relative_width_event relative_width_nonevent event_ratio delta_event_pairs delta_non_event_pairs "
          "delta_event_pairs_mean delta_non_event_pairs_mean", f"{cols_by} event_pairs non_event_pairs")
    r.add("m25_envelope_widths", lambda s, d: shift.envelope_widths(scenario_pairs(s, d), reach_fan(s, d), keys=sk), f"""
        SELECT {by}, {med('abs(max - min)')} AS median_w, avg(abs(max - min)) AS mean_w, quantile_cont(abs(max - min), 0.9) AS p90_w,
               avg(CASE WHEN overlay BETWEEN least(min, max) AND greatest(min, max) THEN 1.0 ELSE 0.0 END) AS coverage_fraction
        FROM spairs JOIN q3 USING (rch, variable, date) GROUP BY {by}""", SPAIRS, "median_w mean_w p90_w coverage_fraction", cols_by)
    r.add("m26_baseline_summary", lambda s, d: shift.baseline_summary(reach_fan(s, d), keys=KEYS), f"""
        SELECT {K}, {med('p50')} AS median, avg(p50) AS mean, stddev_pop(p50) AS sd, {med('(p95 - p05) / nullif(abs(p50), 0)')} AS relative_width,
               avg((p95 - p05) / nullif(abs(p50), 0)) AS relative_width_mean FROM q3 GROUP BY 1, 2""", Q3, "median mean sd relative_width relative_width_mean", "rch variable")

    def matrix(s, d):
        load = views.sim(s, d)
        long = load.select(F.concat(F.lit("s"), "run_id").alias("scenario"), F.explode(F.array(*[
            F.struct(F.lit(v).alias("variable"), F.col(v).alias("x")) for v in ("sed_out", "tot_n", "tot_p")])).alias("e")) \
            .select("scenario", "e.*").where(~((F.col("scenario") == "s7") & (F.col("variable") == "tot_p")))
        m = long.groupBy("scenario", "variable").agg(F.avg("x").alias("mean"), F.max("x").alias("max"))
        metrics = m.select("scenario", "variable", F.explode(F.array(
            F.struct(F.lit("mean").alias("metric"), F.col("mean").alias("value")),
            F.struct(F.lit("max").alias("metric"), F.col("max").alias("value")))).alias("e")).select("scenario", "variable", "e.*")
        return shift.metric_matrix(metrics, m.select("scenario"), ["mean", "max"], ["sed_out", "tot_n", "tot_p"])

    r.add("m29_metric_matrix", matrix, """
        SELECT metric, scenario, sed_out, tot_n, tot_p, CASE WHEN tot_p IS NULL THEN 'tot_p' ELSE '' END AS missing FROM (
          SELECT 'mean' AS metric, 's' || run_id AS scenario, avg(sed_out) AS sed_out, avg(tot_n) AS tot_n,
                 avg(CASE WHEN run_id <> '7' THEN tot_p END) AS tot_p FROM sim GROUP BY 2
          UNION ALL SELECT 'max', 's' || run_id, max(sed_out), max(tot_n), max(CASE WHEN run_id <> '7' THEN tot_p END) FROM sim GROUP BY 2)""",
          "sim", "sed_out tot_n tot_p", "metric scenario missing")

    # events
    r.add("w2_sampling_interval", lambda s, d: events.sampling_interval_days(views.gauge(s, d)),
          """SELECT quantile_cont(epoch_us(ts) - epoch_us(p), 0.5) / 86400e6 AS dt_days FROM (
               SELECT ts, lag(ts) OVER (ORDER BY ts) AS p FROM gauge) WHERE p IS NOT NULL""", "gauge", "dt_days", "", 8)

    def flags_sql(dt: str) -> str:
        def one(name, q, days):
            return f"""SELECT event_id, '{name}' AS flag_name, above AND count(*) OVER (PARTITION BY above, run) >= ceil({days} / {dt}) AS flag FROM (
                SELECT *, row_number() OVER (ORDER BY ts, event_id) - row_number() OVER (PARTITION BY above ORDER BY ts, event_id) AS run FROM (
                  SELECT *, q >= {q} AS above FROM gauge))"""
        return one("high", "(SELECT quantile_cont(q, 0.75) FROM gauge)", 0.005) + " UNION ALL " + one("fixed", "20.0", 0.012)

    dt_sql = """(SELECT quantile_cont(epoch_us(ts) - epoch_us(p), 0.5) / 86400e6 FROM (
                 SELECT ts, lag(ts) OVER (ORDER BY ts) AS p FROM gauge) WHERE p IS NOT NULL)"""

    def flags(s, d):
        out = events.add_event_flags(views.gauge(s, d), {"high": "p75", "fixed": 20.0}, {"high": 0.005, "fixed": 0.012}, tiebreak=["event_id"])
        return out.select("event_id", F.explode(F.array(
            F.struct(F.lit("high").alias("flag_name"), F.col("high_event").alias("flag")),
            F.struct(F.lit("fixed").alias("flag_name"), F.col("fixed_event").alias("flag")))).alias("e")).select("event_id", "e.*")

    r.add("w4_event_flags_gauge", flags, flags_sql(dt_sql), "gauge", "", "event_id flag_name flag")
    each_dt = """SELECT station, quantile_cont(epoch_us(ts) - epoch_us(p), 0.5) / 86400e6 AS dt_days FROM (
               SELECT station, ts, lag(ts) OVER (PARTITION BY station ORDER BY ts) AS p FROM gauges) WHERE p IS NOT NULL GROUP BY 1"""
    r.add("w2_sampling_interval_by_gauge", lambda s, d: events.sampling_interval_days(views.gauges(s, d), keys=["station"]), each_dt, "gauges", "dt_days", "station", 8)

    def keyed_flags(s, d):
        out = events.add_event_flags(views.gauges(s, d), {"high": "p75", "fixed": 20.0}, {"high": 0.02, "fixed": 0.05}, tiebreak=["event_id"], keys=["station"])
        return out.select("event_id", "station", F.explode(F.array(
            F.struct(F.lit("high").alias("flag_name"), F.col("high_event").alias("flag")),
            F.struct(F.lit("fixed").alias("flag_name"), F.col("fixed_event").alias("flag")))).alias("e")).select("event_id", "station", "e.*")

    def keyed_sql(name, q, days):
        return f"""SELECT event_id, station, '{name}' AS flag_name, above AND count(*) OVER (PARTITION BY station, above, run) >= ceil({days} / dt_days) AS flag FROM (
            SELECT *, row_number() OVER (PARTITION BY station ORDER BY ts, event_id) - row_number() OVER (PARTITION BY station, above ORDER BY ts, event_id) AS run FROM (
              SELECT *, q >= {q} AS above FROM gauges JOIN (SELECT station, quantile_cont(q, 0.75) AS cut FROM gauges GROUP BY 1) USING (station))) JOIN ({each_dt}) USING (station)"""

    r.add("w4_event_flags_by_gauge", keyed_flags, keyed_sql("high", "cut", 0.02) + " UNION ALL " + keyed_sql("fixed", "20.0", 0.05), "gauges", "", "event_id station flag_name flag")
    r.add("w4_event_flags_daily", flow_events, "SELECT date, is_event FROM ev", EV, "", "date is_event")
    tokens = {"q1": "q1", "q50": "q50", "q3": "q3", "p90": "p90", "95pct": "95pct"}
    r.add("p17_threshold_tokens",
          lambda s, d: views.gauge(s, d).withColumn("cut", events.thresholds_of(views.gauge(s, d), "q", tokens)).select(F.explode(F.array(*[
              F.struct(F.lit(t).alias("token"), (F.col("q") >= F.col("cut")[t]).cast("int").alias("above")) for t in tokens]))
              .alias("e")).select("e.*").groupBy("token").agg(F.sum("above").alias("n")),
          " UNION ALL ".join(f"SELECT '{t}' AS token, CAST(sum(CAST(q >= (SELECT quantile_cont(q, {p}) FROM gauge) AS INTEGER)) AS BIGINT) AS n FROM gauge"
                             for t, p in (("q1", 0.25), ("q50", 0.5), ("q3", 0.75), ("p90", 0.9), ("95pct", 0.95))),
          "gauge", "", "token n")
    for view in ("all", "events", "non_events"):
        sel = {"all": "TRUE", "events": "is_buffered", "non_events": "NOT is_buffered"}[view]
        r.add(f"w5_event_days_{view}", lambda s, d, view=view: events.event_days(flow_events(s, d), 1, view),
              f"SELECT *, {sel} AS is_selected FROM evdays", EV, "", "date is_event is_buffered is_selected")
    r.add("w6_excluded_blocks", lambda s, d: events.excluded_blocks(event_table(s, d), F.col("is_buffered")), """
        WITH days AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM evdays),
        x AS (SELECT date FROM days WHERE date NOT IN (SELECT date FROM evdays WHERE is_buffered)),
        g AS (SELECT date, date - CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS i FROM x)
        SELECT min(date) AS start, max(date) AS "end", count(*) AS n_days FROM g GROUP BY i""".replace('"end"', "finish"), EV, "", "start finish n_days")
    r.add("u3_non_event_days",
          lambda s, d: events.non_event_days(event_table(s, d), event_table(s, d).where("is_buffered")),
          "SELECT date FROM evdays WHERE NOT is_buffered", EV, "", "date")
    day = "SELECT date, q FROM fd"
    q = lambda p: f"(SELECT quantile_cont(q, {p}) FROM fd)"
    lx = "(SELECT quantile_cont(ln(1 + q), 0.5) FROM fd)"
    mad = f"(SELECT quantile_cont(abs(ln(1 + q) - {lx}), 0.5) FROM fd)"
    iqr = f"({q(0.75)} - {q(0.25)})"
    rules = {
        "mad_log_upper": ({"method": "mad_log", "k": 1.5}, f"(ln(1 + q) - {lx}) / nullif(1.4826 * {mad}, 0) > 1.5"),
        "mad_log_both": ({"method": "mad_log", "sided": "both", "k": 1.5}, f"abs((ln(1 + q) - {lx}) / nullif(1.4826 * {mad}, 0)) > 1.5"),
        "iqr_both": ({"method": "iqr", "sided": "both", "iqr_k": 0.5}, f"q > {q(0.75)} + 0.5 * {iqr} OR q < {q(0.25)} - 0.5 * {iqr}"),
        "quantile_both": ({"method": "quantile", "sided": "both"}, f"q > {q(0.995)} OR q < {q(0.005)}"),
    }
    for name, (opts, cond) in rules.items():
        r.add(f"w19_outlier_days_{name}", lambda s, d, opts=opts: events.outlier_days(views.flow(s, d), **opts),
              f"SELECT date, q, coalesce({cond}, FALSE) AS is_outlier FROM ({day}) AS z", EV, "q", "date is_outlier")
    r.add("j13_outlier_tag_rows",
          lambda s, d: events.tag_flow_outliers(views.flow(s, d), method="quantile", upper_q=0.95).groupBy("is_outlier")
          .agg(F.count(F.lit(1)).alias("n"), F.sum("flow_m3d").alias("total")),
          f"""SELECT o.f AS is_outlier, count(*) AS n, sum(flow_m3d) AS total FROM flow
              JOIN (SELECT date, q > {q(0.95)} AS f FROM fd) o ON o.date = CAST(flow.date AS DATE) GROUP BY 1""",
          EV, "total", "is_outlier n")
