"""Queries on filters, resampling and ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.functions.calendar import bucket
from freshet.functions.nulls import div
from freshet.functions.calendar import bucket_origin
from freshet.operators import ensemble, pairing, resample, select
from freshet.plans import views
from freshet.plans.registry import Registry

FAN_SQL = """min(v) AS min, {q}, max(v) AS max, avg(v) AS mean, count(v) AS n_values"""


def _quantiles_sql(v: str, percentiles) -> str:
    return ", ".join(f"quantile_cont({v}, {p / 100}) AS p{p:02d}" for p in percentiles)


def register(r: Registry) -> None:
    key = "run_id rch date"

    r.add("p1_reach_filter", lambda s, d: select.reach(views.sim(s, d), 3, ["run_id", "rch", "date", "load_kg", "flow_cms"]),
          "SELECT * FROM sim WHERE rch = 3", "sim", "load_kg flow_cms", key)
    r.add("p2_time_slice",
          lambda s, d: select.time_slice(views.sim(s, d), "1996-03-01", "1998-06-30"),
          "SELECT * FROM sim WHERE date BETWEEN DATE '1996-03-01' AND DATE '1998-06-30'", "sim", "load_kg", key)
    r.add("p3_season_filter", lambda s, d: select.season(views.sim(s, d), [12, 1, 2]),
          "SELECT * FROM sim WHERE month(date) IN (12, 1, 2)", "sim", "load_kg", key)
    r.add("p4_view_window",
          lambda s, d: select.time_slice(views.measured(s, d), "1997-01-15", "1997-09-15")
          .groupBy("station", "analyte").agg(F.count(F.lit(1)).alias("n")),
          """SELECT station, analyte, count(*) AS n FROM measured
             WHERE date BETWEEN TIMESTAMP '1997-01-15' AND TIMESTAMP '1997-09-15' GROUP BY 1, 2""",
          "measured", "", "station analyte n")
    r.add("p5_drop_leap_day", lambda s, d: select.drop_feb29(views.sim(s, d)),
          "SELECT * FROM sim WHERE NOT (month(date) = 2 AND day(date) = 29)", "sim", "load_kg", key)
    r.add("p6_kjeldahl", lambda s, d: select.kjeldahl(views.sim(s, d), "orgn_out", "nh4_out"),
          "SELECT *, orgn_out + nh4_out AS kjeldahl FROM sim", "sim", "kjeldahl", key, 6)
    r.add("p7_net_sediment", lambda s, d: select.net_sediment(views.sim(s, d)),
          "SELECT *, sed_in - sed_out AS net_in_out, sed_out - sed_in AS net_out_in FROM sim",
          "sim", "net_in_out net_out_in", key, 6)
    r.add("p8_area_hectares", lambda s, d: select.area_hectares(views.sub(s, d)),
          "SELECT *, area_km2 * 100 AS area_ha FROM sub", "sub", "area_ha", "sub date")

    def policy(nonnum, negative):
        return lambda s, d: select.clean_measured(views.measured(s, d), "value", nonnum, negative).groupBy("station", "analyte").agg(
            F.count(F.lit(1)).alias("n"), F.count("value_num").alias("n_num"), F.sum("value_num").alias("total"))

    for nonnum, negative in (("as_na", "keep"), ("as_na", "drop"), ("drop", "drop"), ("zero", "zero"), ("half_MDL", "zero")):
        v = "CASE WHEN v < 0 THEN 0.0 ELSE v END" if negative == "zero" else "v"
        fill = {"zero": "0.0", "half_MDL": "0.1"}.get(nonnum)
        v = f"coalesce({v}, {fill})" if fill else v
        keep = ["TRUE"] + (["(v IS NULL OR v >= 0)"] if negative == "drop" else []) + (["v IS NOT NULL"] if nonnum == "drop" else [])
        r.add(f"p16_measured_{nonnum.lower()}_{negative}", policy(nonnum, negative),
              f"SELECT station, analyte, count(*) AS n, count({v}) AS n_num, sum({v}) AS total FROM cleaned WHERE {' AND '.join(keep)} GROUP BY 1, 2",
              "measured cleaned", "total", "station analyte n n_num")

    def how(s, d):
        names = views.sim(s, d).select(F.explode(F.array(*[F.lit(x) for x in (
            "FLOW_OUTcms", "SED_OUTtons", "SEDCONCmg/L", "TOT_Nkg", "BED_PSTmg", "SOLPST_INmg", "NO3ConcMg/l", "BACTP_OUTct")]))
            .alias("variable"), "load_kg")
        return (resample.with_how(names, "variable", resample.NAMED_HOW)
                .groupBy("variable", "how").agg(F.sum("load_kg").alias("total")))

    r.add("p19_default_aggregation", how, """
        SELECT variable, how, sum(load_kg) AS total FROM sim, (VALUES
          ('FLOW_OUTcms', 'mean'), ('SED_OUTtons', 'sum'), ('SEDCONCmg/L', 'flow_weighted_mean'), ('TOT_Nkg', 'sum'),
          ('BED_PSTmg', 'mean'), ('SOLPST_INmg', 'sum'), ('NO3ConcMg/l', 'flow_weighted_mean'), ('BACTP_OUTct', 'sum'))
          AS t(variable, how) GROUP BY 1, 2""", "sim", "total", "variable how", 2)
    r.add("p15_column_fill_counts",
          lambda s, d: select.filled_counts(
              views.sim(s, d).withColumn("flow_gap", F.when(F.col("flow_cms") > 20, F.col("flow_cms"))), ["flow_cms", "flow_gap"]),
          """SELECT 'flow_cms' AS name, count(flow_cms) AS filled FROM sim UNION ALL
             SELECT 'flow_gap', count(CASE WHEN flow_cms > 20 THEN flow_cms END) FROM sim""",
          "sim", "", "name filled")

    # resampling
    def rs(freq, n=1, how="sum", **kw):
        return lambda s, d: resample.resample(views.sim(s, d), ["run_id", "rch"], ["load_kg"], freq, n, how, **kw)

    first = "first_day"
    sunday = "CAST(date_trunc('week', {0}) + INTERVAL 6 DAY AS DATE)"
    months_apart = f"((year(date) - year({first})) * 12 + month(date) - month({first}))"
    labels = {
        ("D", 1): "date", ("W", 1): sunday.format("date"), ("M", 1): "last_day(date)",
        ("A", 1): "make_date(year(date), 12, 31)",
        ("D", 5): f"CAST({first} + CAST(floor(date_diff('day', {first}, date) / 5.0) * 5 AS INTEGER) AS DATE)",
        ("W", 2): f"CAST({sunday.format(first)} + CAST(ceil(date_diff('day', {sunday.format(first)}, {sunday.format('date')}) / 14.0) * 14 AS INTEGER) AS DATE)",
        ("M", 3): f"last_day(CAST(date_trunc('month', {first}) + to_months(CAST(ceil({months_apart} / 3.0) * 3 AS INTEGER)) AS DATE))",
        ("A", 2): f"make_date(CAST(year({first}) + ceil((year(date) - year({first})) / 2.0) * 2 AS INTEGER), 12, 31)",
    }
    for (freq, n), label in labels.items():
        name = {"D": "day", "W": "week", "M": "month", "A": "year"}[freq]
        r.add(f"a1_resample_sum_{n}{name}" if n > 1 else f"a1_resample_sum_{name}", rs(freq, n),
              f"SELECT run_id, rch, {label} AS bucket, sum(load_kg) AS load_kg FROM (SELECT *, min(date) OVER (PARTITION BY run_id, rch) AS first_day FROM sim) GROUP BY 1, 2, 3".replace("AS bucket", "AS date")
              .replace("GROUP BY 1, 2, 3", "GROUP BY run_id, rch, 3"), "sim", "load_kg", key)
    r.add("a1_resample_shared_origin", lambda s, d: resample.resample(views.sim(s, d), ["run_id", "rch"], ["load_kg"], "D", 5, "sum", origin=bucket_origin(views.sim(s, d))),
          f"SELECT run_id, rch, {labels['D', 5]} AS date, sum(load_kg) AS load_kg FROM (SELECT *, (SELECT min(date) FROM sim) AS first_day FROM sim) GROUP BY run_id, rch, 3", "sim", "load_kg", key)
    r.add("a1_resample_mean_month", rs("M", 1, "mean"),
          "SELECT run_id, rch, last_day(s.date) AS date, avg(load_kg) AS load_kg FROM sim s GROUP BY 1, 2, 3", "sim", "load_kg", key)
    r.add("a2_flow_weighted_mean", rs("M", 1, "flow_weighted_mean", flow="flow_cms"),
          """SELECT run_id, rch, last_day(s.date) AS date, sum(load_kg * flow_cms) / nullif(sum(flow_cms), 0) AS load_kg
             FROM sim s GROUP BY 1, 2, 3""", "sim", "load_kg", key)

    def spined(s, d):
        src = views.sim(s, d).select("run_id", "rch", "date", "load_kg")
        out = resample.resample(src, ["run_id", "rch"], ["load_kg"], "W", 1, "sum")
        return resample.with_empty_buckets(out, src, ["run_id", "rch"], "W")

    r.add("a1_resample_complete_weeks", spined, """
        WITH ends AS (SELECT run_id, rch, min(date) AS a, max(date) AS b FROM sim GROUP BY 1, 2),
        labels AS (SELECT DISTINCT run_id, rch, CAST(date_trunc('week', x) + INTERVAL 6 DAY AS DATE) AS date
                   FROM (SELECT run_id, rch, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS x FROM ends)),
        got AS (SELECT run_id, rch, CAST(date_trunc('week', s.date) + INTERVAL 6 DAY AS DATE) AS date, sum(load_kg) AS load_kg
                FROM sim s GROUP BY 1, 2, 3)
        SELECT labels.run_id, labels.rch, labels.date, load_kg FROM labels
        LEFT JOIN got ON got.run_id = labels.run_id AND got.rch = labels.rch AND got.date = labels.date""",
          "sim", "load_kg", key)
    r.add("a12_period_day_counts", lambda s, d: resample.period_day_counts(views.sim(s, d).select("date"), "M", [1, 2, 3, 4, 5, 6]), """
        WITH days AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS day FROM sim),
        kept AS (SELECT min(day) AS a, max(day) AS b FROM days WHERE month(day) <= 6)
        SELECT last_day(day) AS date, CAST(sum(CASE WHEN month(day) <= 6 THEN 1 ELSE 0 END) AS DOUBLE) AS n_days
        FROM days, kept WHERE day BETWEEN a AND b GROUP BY 1""", "sim", "n_days", "date")

    # ensembles
    def monthly(s, d):
        return resample.resample(views.sim(s, d), ["run_id", "rch"], ["load_kg"], "M", 1, "sum")

    month_sql = "SELECT run_id, rch, last_day(s.date) AS date, sum(load_kg) AS v FROM sim s GROUP BY 1, 2, 3"
    fan_cols = "min p05 p10 p25 p50 p60 p75 p90 p95 max mean"
    fan_sql = FAN_SQL.format(q=_quantiles_sql("v", ensemble.FAN_PERCENTILES))
    r.add("a3_fan_monthly", lambda s, d: ensemble.fan(monthly(s, d), ["rch"], "load_kg"),
          f"SELECT rch, date, {fan_sql} FROM ({month_sql}) AS m GROUP BY 1, 2", "sim", fan_cols, "rch date n_values")
    r.add("a3_fan_daily", lambda s, d: ensemble.fan(views.sim(s, d), ["rch"], "load_kg"),
          f"SELECT rch, date, {fan_sql} FROM (SELECT rch, date, load_kg AS v FROM sim) AS m GROUP BY 1, 2",
          "sim", fan_cols, "rch date n_values")
    def merged(s, d):
        """The first four runs as a stored state would hold them, then the fifth and the last two as they arrive."""
        x, no = views.sim(s, d), F.col("run_id").cast("int")
        states = [ensemble.fan_state(x.where(c), ["rch"], "load_kg") for c in (no <= 4, no == 5, no > 5)]
        return ensemble.fan_of(ensemble.merge_states([ensemble.merge_states(states[:2], ["rch"]), states[2]], ["rch"]), ["rch"])

    r.add("a3_fan_of_later_runs", merged,
          f"SELECT rch, date, {fan_sql} FROM (SELECT rch, date, load_kg AS v FROM sim) AS m GROUP BY 1, 2",
          "sim", fan_cols, "rch date n_values")
    band_cols = "min p05 p25 p50 p75 p95 max mean"
    band_sql = FAN_SQL.format(q=_quantiles_sql("v", ensemble.BAND_PERCENTILES))
    r.add("a4_bands_half_the_runs", lambda s, d: ensemble.bands(views.sim(s, d), ["rch"], "load_kg"),
          f"""SELECT rch, date, {band_sql} FROM (SELECT rch, date, load_kg AS v FROM sim) AS m GROUP BY 1, 2
              HAVING count(v) >= greatest(1, (SELECT count(DISTINCT run_id) // 2 FROM sim))""",
          "sim", band_cols, "rch date n_values")
    r.add("a4_bands_event_filter", lambda s, d: ensemble.bands(select.season(views.sim(s, d), [7, 8]), ["rch"], "load_kg", True),
          f"""SELECT rch, date, {band_sql} FROM (SELECT rch, date, load_kg AS v FROM sim WHERE month(date) IN (7, 8)) AS m
              GROUP BY 1, 2""", "sim", band_cols, "rch date n_values")
    r.add("a5_mean_daily_flow", lambda s, d: ensemble.mean_daily_flow(views.sim(s, d)), """
        SELECT rch, date, avg(q) AS flow_m3d FROM (SELECT rch, run_id, date, sum(flow_cms * 86400) AS q FROM sim GROUP BY 1, 2, 3)
        GROUP BY 1, 2""", "sim", "flow_m3d", "rch date", 3)
    r.add("a6_external_daily_flow", lambda s, d: ensemble.external_daily_flow(views.flow(s, d)),
          "SELECT * FROM flow_day", "flow flow_day", "flow_m3d", "date")
    r.add("a7_erosion_monthly", lambda s, d: ensemble.erosion(views.sim(s, d)), """
        SELECT rch, date, avg(net) AS erosion FROM (
          SELECT run_id, rch, last_day(s.date) AS date, sum(sed_in - sed_out) AS net FROM sim s GROUP BY 1, 2, 3) GROUP BY 1, 2""",
          "sim", "erosion", "rch date")
    r.add("a10_station_lookup",
          lambda s, d: select.station_lookup(views.measured(s, d)).select("analyte", F.concat_ws("|", "stations").alias("stations")),
          "SELECT analyte, string_agg(DISTINCT station, '|' ORDER BY station) AS stations FROM measured GROUP BY 1",
          "measured", "", "analyte stations")
    r.add("p15_series_labels",
          lambda s, d: views.table(s, d, "part").select("p_type", ensemble.sanitise(F.concat_ws(" - ", "p_brand", "p_type")).alias("label")).distinct(),
          "SELECT DISTINCT p_type, lower(trim(regexp_replace(p_brand || ' - ' || p_type, '[^0-9A-Za-z]+', '_', 'g'), '_')) AS label FROM part", "", "", "p_type label")
    r.add("a11_reach_list", lambda s, d: select.reach_list(views.sim(s, d)),
          "SELECT rch, count(DISTINCT run_id) AS n_runs FROM sim GROUP BY 1", "sim", "", "rch n_runs")

    sed = ["sed_in", "sed_out", "net_in_out", "net_out_in"]

    def sediment(freq, how):
        def run(s, d):
            return resample.resample(select.net_sediment(views.sim(s, d)), ["run_id", "rch"], sed, freq, 1, how)
        return run

    for freq, how in (("M", "sum"), ("M", "mean"), ("A", "sum"), ("A", "mean")):
        f = "sum" if how == "sum" else "avg"
        lab = "last_day(s.date)" if freq == "M" else "make_date(year(s.date), 12, 31)"
        r.add(f"a19_sediment_{'month' if freq == 'M' else 'year'}_{how}", sediment(freq, how), f"""
            SELECT run_id, rch, {lab} AS date, {f}(sed_in) AS sed_in, {f}(sed_out) AS sed_out,
                   {f}(sed_in - sed_out) AS net_in_out, {f}(sed_out - sed_in) AS net_out_in
            FROM sim s GROUP BY 1, 2, 3""", "sim", " ".join(sed), key)

    r.add("a23_scenario_series",
          lambda s, d: ensemble.scenario_series(
              select.season(views.sim(s, d), [3, 4, 5]).withColumn("scenario", F.concat(F.lit("run"), "run_id")), ["rch"], "load_kg", "M"),
          """SELECT 'run' || run_id AS scenario, rch, last_day(s.date) AS date, sum(load_kg) AS load_kg
             FROM sim s WHERE month(s.date) IN (3, 4, 5) GROUP BY 1, 2, 3""", "sim", "load_kg", "scenario rch date")
    r.add("w1_row_shift",
          lambda s, d: select.lag_rows(ensemble.fan(views.sim(s, d), ["rch"], "load_kg", [50]), ["rch"], "p50", -2),
          """SELECT rch, date, p50, lead(p50, 2) OVER (PARTITION BY rch ORDER BY date) AS lagged FROM (
               SELECT rch, date, quantile_cont(load_kg, 0.5) AS p50 FROM sim GROUP BY 1, 2)""",
          "sim", "p50 lagged", "rch date")
    r.add("j2_load_to_concentration_own_flow", lambda s, d: pairing.load_to_concentration(views.sim(s, d), "load_kg"),
          "SELECT *, load_kg / nullif(flow_cms * 86400, 0) / 0.001 AS conc_mgl FROM sim", "sim", "conc_mgl", key)
    r.add("j2_load_to_concentration_gauge_flow",
          lambda s, d: pairing.load_to_concentration(
              views.sim(s, d), "load_kg", ensemble.external_daily_flow(views.flow(s, d).where("flow_m3d >= 25000")), True),
          """SELECT s.*, load_kg / nullif(coalesce(f.q, flow_cms * 86400), 0) / 0.001 AS conc_mgl FROM sim s LEFT JOIN (
               SELECT CAST(date AS DATE) AS date, sum(flow_m3d) AS q FROM flow WHERE flow_m3d >= 25000 GROUP BY 1) f
             ON f.date = s.date""", "sim flow", "conc_mgl", key)
    r.add("j2_load_to_concentration_ensemble_flow",
          lambda s, d: pairing.load_to_concentration(views.sim(s, d), "load_kg", ensemble.mean_daily_flow(views.sim(s, d)), False),
          """SELECT s.*, load_kg / nullif(f.q, 0) / 0.001 AS conc_mgl FROM sim s LEFT JOIN (
               SELECT rch, date, avg(flow_cms * 86400) AS q FROM sim GROUP BY 1, 2) f ON f.rch = s.rch AND f.date = s.date""", "sim", "conc_mgl", key)
    r.add("j8_envelope_with_flow",
          lambda s, d: ensemble.fan(views.sim(s, d), ["rch"], "load_kg", [50])
          .join(ensemble.external_daily_flow(views.flow(s, d)), "date")
          .select("rch", "date", "min", "max", "flow_m3d", div(F.col("max") - F.col("min"), "flow_m3d").alias("width_per_flow")),
          """SELECT rch, m.date AS date, m.min, m.max, flow_m3d, (m.max - m.min) / nullif(flow_m3d, 0) AS width_per_flow FROM (
               SELECT rch, date, min(load_kg) AS min, max(load_kg) AS max FROM sim GROUP BY 1, 2) m
             JOIN flow_day f ON f.date = m.date""", "sim flow flow_day", "min max flow_m3d width_per_flow", "rch date")
    r.add("u1_date_union",
          lambda s, d: views.sim(s, d).select("date").distinct()
          .unionByName(views.measured(s, d).select(F.to_date("date").alias("date")).distinct()).distinct()
          .withColumn("month_end", bucket("date", "M")),
          """SELECT date, last_day(date) AS month_end FROM (
               SELECT date FROM sim UNION SELECT CAST(date AS DATE) FROM measured)""", "sim measured", "", "date month_end")
    r.add("t1_top_flow_days",
          lambda s, d: ensemble.external_daily_flow(views.flow(s, d)).orderBy(F.col("flow_m3d").desc(), "date").limit(20),
          "SELECT * FROM flow_day ORDER BY flow_m3d DESC, date LIMIT 20", "flow flow_day", "flow_m3d", "date")
