"""Queries on text parsing, run datasets, ledgers, comparisons and composed reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from freshet.operators import balance, compare, fit, ledger, order, resample, select
from freshet.plans import basin, bundles, views
from freshet.plans import fit as fitq
from freshet.plans.registry import Registry
from freshet.sources import sinks, tables, text
from freshet.sources.tables import clean_attributes

SQL = views.SQL
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()

SQL["ev_step"] = """
    SELECT event_id, user_id, event_type, value, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k,
           date_trunc('second', ts) AS t, CASE WHEN event_type = 'error' THEN -1 ELSE 1 END * (CAST(floor(value) AS INTEGER) + 1) AS secs FROM events"""
SQL["choice"] = """
    SELECT event_id AS id, user_id AS run_id, 1 AS pos, 'scale_variable' AS transform, 'a' AS "in", 'b' AS out, value - 1 AS lower, value + 1 AS upper, value, event_type AS source, NULL::BOOLEAN AS renorm FROM ev_step
    UNION ALL SELECT event_id, user_id, 2, 'op_mul', 'b', 'c', 0, 100, k, 'random', NULL FROM ev_step
    UNION ALL SELECT event_id, user_id, 2, 'op_set', 'b', 'd', NULL, NULL, NULL, NULL, NULL FROM ev_step
    UNION ALL SELECT event_id, user_id, 3, 'mgL_point', 'population', 'NO3YR', 1, 2, k * 0.5, 'standard', NULL FROM ev_step
    UNION ALL SELECT event_id, user_id, 5, 'split_with_bounds', 'c', 'e', k, k + 1, 0.25, 'override', TRUE FROM ev_step
    UNION ALL SELECT event_id, user_id, 6, 'perturb_relative', 'c', 'c', NULL, NULL, value / 1000, event_type, NULL FROM ev_step"""


def ledger_lines(s, d):
    """One JSON ledger line per event, with some blank and broken lines among them."""
    e = views.table(s, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    t = F.date_trunc("second", F.col("ts").cast("timestamp"))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    secs = F.when(F.col("event_type") == "error", -1).otherwise(1) * (F.floor("value").cast("int") + 1)
    end = iso(F.timestamp_seconds(F.unix_seconds(t) + secs))
    v, kind, user = F.col("value"), F.col("event_type"), F.col("user_id")
    S, L = F.struct, F.lit

    def step(name, args, timed=False):
        times = F.concat(L(',"started_at":"'), iso(t), L('","ended_at":"'), end, L('"')) if timed else L("")
        return F.concat(L(f'{{"name":"{name}","args":'), args, times, L("}"))

    obj = lambda *cols: F.to_json(S(*cols))
    src, out = L("a").alias("src"), L("b").alias("out")
    ops = F.array(S(L("mul").alias("op"), L("b").alias("src"), L("c").alias("out"), L(0).alias("lower"), L(100).alias("upper"),
                    L("random").alias("source"), k.cast("string").alias("value")),
                  S(L("set").alias("op"), L("b").alias("src"), L("d").alias("out"), L(None).cast("int").alias("lower"), L(None).cast("int").alias("upper"),
                    L(None).cast("string").alias("source"), L("from_src").alias("value")))
    mgl = F.create_map(L("NO3YR"), S(L(1).alias("lower"), L(2).alias("upper"), L("standard").alias("source"), (k * 0.5).alias("mgL")))
    steps = F.concat_ws(
        ",",
        step("transform_scale_variable", obj(src, out, (v - 1).alias("lower"), (v + 1).alias("upper")), True),
        step("scale_choices", obj(src, out, v.alias("factor"), kind.alias("source"))),
        step("ops_choices", obj(ops.alias("ops"))),
        step("point_mgL_choices", obj(mgl.alias("mgL_values"))),
        step("transform_split_with_bounds", obj(L("c").alias("src"), F.array(S(L("e").alias("name"), k.alias("lower"), (k + 1).alias("upper"))).alias("outputs"))),
        step("split_choices", L('{"src":"c","renormalize":true,"outputs":[{"name":"e","ratio":0.25,"source":"override"}]}')),
        step("perturbation_choices", obj(F.array(S(L("c").alias("name"), (v / 1000).alias("delta"), kind.alias("source"))).alias("targets"))))
    head = obj(
        F.col("event_id").alias("id"), F.when(kind != "error", user).alias("run_id"),
        F.concat(kind, L("_"), F.col("event_id").cast("string")).alias("name"), iso(t).alias("created_at"),
        S(L("m").alias("module"), kind.alias("version"), user.alias("run_id")).alias("engine"),
        F.array(S(F.concat(L("/in/"), kind, L(".tif")).alias("path")), S(F.concat(L("/in/"), user.cast("string"), L(".csv")).alias("path"))).alias("inputs"),
        L("success").alias("status"))
    line = F.concat(F.substr(head, L(1), F.length(head) - 1), L(',"steps":['), steps, L("]}"))
    # a generator computes the line once, however often it is used below
    lines = e.select("event_type", F.explode(F.array(line)).alias("line"))
    out_lines = F.when(kind == "error", F.array(F.col("line"), F.substring("line", 1, 40), L("  "))).otherwise(F.array("line"))
    return lines.select(F.explode(out_lines).alias("value"))


def parsed(s, d, typed_args=False):
    return ledger.parse_lines(ledger_lines(s, d), typed_args=typed_args)


def _lines(df, folder, line_no, value):
    return df.select(folder.alias("file_path"), line_no.alias("line_no"), value.alias("value"))


def run_folder(name):
    return F.concat(F.lit("/data/out_run"), name, F.lit("/"))


def controls(s, d):
    runs = views.table(s, d, "lineitem").select(F.col("l_linenumber").cast("string").alias("r")).distinct()
    texts = F.array(*[F.lit(x) for x in ("title", "  7    | NBYR : years", "1993   | IYR : first year", "1 | IDAF", "   2  | NYSKIP", "9 | NYSKIP again")])
    return runs.select(F.concat(run_folder(F.col("r")), F.lit("file.cio")).alias("file_path"), F.posexplode(texts).alias("i", "value")).select(
        "file_path", (F.col("i") + 1).alias("line_no"), "value")


# every reach owns a fixed line of its day, so the text of a run can be laid out without sorting it
def _line_no(reach):
    return F.lit(text.HEADER_LINES) + F.datediff("date", F.lit("1995-01-01").cast("date")) * 17 + F.col(reach)


def reach_lines(s, d):
    x = views.sim(s, d)
    num = lambda c: F.col(c).cast("string")
    known = {"AREAkm2": F.lit("12.5"), "FLOW_OUTcms": num("flow_cms"), "SED_INtons": num("sed_in"), "SED_OUTtons": num("sed_out"), "EVAPcms": F.lit("*****"),
             "EC": num("load_kg")}
    ids = [F.lit(" REACH"), num("rch"), F.lit("0"), F.month("date").cast("string")]
    value = F.concat_ws("  ", *ids, *[known.get(n, F.lit("0.0")) for n in text.REACH_FIELDS[4:]])
    body = _lines(x, F.concat(run_folder(F.col("run_id")), F.lit("output.rch")), _line_no("rch"), value)
    head = x.select("run_id").distinct().select(F.concat(run_folder(F.col("run_id")), F.lit("output.rch")).alias("file_path"), F.explode(F.sequence(F.lit(1), F.lit(9))).alias("line_no"), F.lit("heading").alias("value"))
    return body.unionByName(head)


def sub_lines(s, d):
    x = views.sub(s, d)
    pad = lambda c, n: F.lpad(F.format_string("%.3f", c), n, " ")
    fields = {"WYLD": F.col("wyld"), "NSURQ": F.col("nsurq"), "SOLP": F.col("solp"), "SEDP": F.col("sedp")}
    bad = {"PET": F.lit("   ******* "), "SW": F.lit(" " * 10)}
    cells = [pad(fields[n], 10) if n in fields else F.substring(bad.get(n, F.lit("     0.000")), 1, 10) for n in list(text.SUB_DOUBLES)[1:]]
    value = F.concat(F.lit("BIGSUB "), F.lpad(F.col("sub").cast("string"), 4, " "), F.lpad(F.lit("0"), 9, " "), F.lpad(F.lit("1.7"), 5, " "), F.lit(" "),
                     pad(F.col("area_km2"), 9), *cells)
    folder = run_folder((F.col("sub") % 7 + 1).cast("string"))
    return _lines(x, F.concat(folder, F.lit("output.sub")), _line_no("sub"), value)


def register(r: Registry) -> None:
    ctl = lambda s, d: text.control_values(controls(s, d))
    r.add("s3_control_start_dates", lambda s, d: ctl(s, d), """
        SELECT DISTINCT '/data/out_run' || CAST(l_linenumber AS VARCHAR) AS folder, CAST(1993 AS INTEGER) AS iyr, CAST(2 AS INTEGER) AS nyskip, CAST(7 AS INTEGER) AS nbyr,
               CAST(1 AS INTEGER) AS idaf, DATE '1995-01-01' AS start_date FROM lineitem""", "", "", "folder iyr nyskip nbyr idaf start_date")
    r.add("s4_simulated_period", lambda s, d: ctl(s, d),
          "SELECT DISTINCT '/data/out_run' || CAST(l_linenumber AS VARCHAR) AS folder, CAST(1995 AS INTEGER) AS start_year, CAST(2001 AS INTEGER) AS end_year FROM lineitem",
          "", "", "folder start_year end_year")
    r.add("s1_reach_lines", lambda s, d: text.parse_reach(reach_lines(s, d), ctl(s, d)), """
        SELECT 'rch_out_run' || run_id AS run_id, rch AS "RCH", date, flow_cms AS "FLOW_OUTcms", sed_in AS "SED_INtons", sed_out AS "SED_OUTtons", NULL::DOUBLE AS "EVAPcms",
               load_kg AS "EC", 1250.0::DOUBLE AS area_ha FROM sim""", "sim", "FLOW_OUTcms SED_INtons SED_OUTtons EVAPcms EC area_ha", "run_id RCH date")
    r.add("s2_sub_lines", lambda s, d: text.parse_sub(sub_lines(s, d), ctl(s, d)), """
        SELECT sub AS "SUB", date, CAST(1 AS INTEGER) AS "MON", area_km2 AS "AREA", wyld AS "WYLD", nsurq AS "NSURQ", solp AS "SOLP", sedp AS "SEDP", 0.0::DOUBLE AS "PET", 0.0::DOUBLE AS "SW",
               area_km2 * 100 AS area_ha FROM sub""", "sub", "AREA WYLD NSURQ SOLP SEDP PET SW area_ha", "SUB MON date", 3)
    r.add("s5_line_to_day", lambda s, d: text.with_dates(reach_lines(s, d), ctl(s, d)).groupBy("folder", "total_days", "date").agg(F.count(F.lit(1)).alias("n")),
          "SELECT '/data/out_run' || run_id AS folder, CAST(date_diff('day', DATE '1995-01-01', date) AS INTEGER) AS total_days, date, count(*) AS n FROM sim GROUP BY ALL",
          "sim", "", "folder total_days date n")
    r.add("s6_run_names",
          lambda s, d: reach_lines(s, d).groupBy(text.run_name().alias("by_folder"), text.run_name(name_from="parent", prefix="x_").alias("by_parent")).agg(F.count(F.lit(1)).alias("n")),
          "SELECT 'rch_out_run' || run_id AS by_folder, 'x_data' AS by_parent, count(*) + 9 AS n FROM sim GROUP BY 1", "sim", "", "by_folder by_parent n")

    def chosen_runs(s, d):
        name = F.concat(F.lit("run00000"), "run_id", F.lit("_real"))
        x = views.sim(s, d).withColumn("run_no", tables.run_number(name)).where(F.col("run_no").isin(2, 4, 5))
        return tables.latest_rows(x.select("run_no", F.lit("same").alias("run_id"), "rch", "date", "load_kg", "flow_cms"))

    r.add("s7_selected_runs_later_wins", chosen_runs, """
        SELECT CAST(run_id AS INTEGER) AS run_no, 'same' AS run_id, rch, date, load_kg, flow_cms FROM sim WHERE run_id IN ('2', '4', '5')
        QUALIFY row_number() OVER (PARTITION BY rch, date ORDER BY run_id DESC) = 1""", "sim", "load_kg flow_cms", "run_no run_id rch date")

    def stored_runs(s, d):
        """All runs stored, the fourth replaced, and three read back by a list of numbers."""
        path = views.scratch(s, "runs")
        no = F.col("run_id").cast("int")
        x = views.sim(s, d).select(no.alias("run_no"), F.when(no.isin(4, 5), "same").otherwise(F.col("run_id")).alias("run_id"), "rch", "date", "load_kg")
        tables.write_runs(x, path)
        tables.write_runs(x.where("run_no = 4").withColumn("load_kg", F.col("load_kg") * 2), path, only_these=True)
        return tables.read_runs(s, path, s.createDataFrame([(2,), (4,), (5,)], "run_no int"))

    r.add("k5_stored_runs", stored_runs, """
        SELECT CAST(run_id AS INTEGER) AS run_no, CASE WHEN run_id IN ('4', '5') THEN 'same' ELSE run_id END AS run_id, rch, date, CASE WHEN run_id = '4' THEN 2 ELSE 1 END * load_kg AS load_kg
        FROM sim s WHERE run_id IN ('2', '4', '5') QUALIFY row_number() OVER (PARTITION BY CASE WHEN s.run_id = '2' THEN 0 ELSE 1 END, rch, date ORDER BY s.run_id DESC) = 1""",
          "sim", "load_kg", "run_no run_id rch date")

    def attributes(s, d):
        c = views.table(s, d, "customer")
        raw = c.select(F.concat(F.col("c_custkey").cast("string"), F.lit(",0")).alias("HRU_GIS"), F.col("c_name").alias("label"),
                       F.replace(F.col("c_acctbal").cast("string"), F.lit("."), F.lit(",")).alias("n_pct"), F.col("c_mktsegment").alias("p_mg"))
        return clean_attributes(raw, "HRU_GIS", ["n_pct", "p_mg"], 2)

    r.add("s8_zone_attributes", attributes, "SELECT CAST(c_custkey AS INTEGER) AS HRU_GIS, c_name AS label, c_acctbal AS n_pct, NULL::DOUBLE AS p_mg FROM customer",
          "", "n_pct p_mg", "HRU_GIS label")
    r.add("s9_population_years", lambda s, d: clean_attributes(basin.zone_population(s, d), "zone_id"),
          "SELECT CAST(zone_id AS INTEGER) AS zone_id, y1970 AS popul_sum_1970, y2021 AS popul_sum_2021 FROM zone_pop", "zone_pop", "popul_sum_1970 popul_sum_2021", "zone_id")
    r.add("s11_samples_to_numbers",
          lambda s, d: select.clean_measured(views.measured(s, d)).groupBy("analyte").agg(F.count(F.lit(1)).alias("n"), F.count("value_num").alias("n_num"), F.min("value_num").alias("lo")),
          "SELECT analyte, count(*) AS n, count(v) AS n_num, min(v) AS lo FROM cleaned GROUP BY 1", "measured cleaned", "lo", "analyte n n_num")
    r.add("s12_input_fingerprints",
          lambda s, d: tables.fingerprints(s, [f"{d}/{t}.parquet" for t in TABLES], kind="parquet").select("size", "sha256", "kind"))

    # ledger
    iso = "strftime(t, '%Y-%m-%dT%H:%M:%SZ')"
    r.add("s10_ledger_lines", lambda s, d: parsed(s, d).select("id", "run_id", "name", "created_at", F.size("steps").alias("n_steps"), "status"),
          f"""SELECT event_id AS id, CASE WHEN event_type <> 'error' THEN user_id END AS run_id, event_type || '_' || CAST(event_id AS VARCHAR) AS name,
                 {iso} AS created_at, CAST(7 AS INTEGER) AS n_steps, 'success' AS status FROM ev_step""", "ev_step", "", "id run_id name created_at n_steps status")
    r.add("l1_ledger_summary",
          lambda s, d: ledger.summary(parsed(s, d)).withColumn("created_min", F.date_format("created_min", "yyyy-MM-dd HH:mm:ss")).withColumn("created_max", F.date_format("created_max", "yyyy-MM-dd HH:mm:ss")), """
        SELECT count(*) AS n_records, count(event_id) AS n_ids, count(DISTINCT (event_type, user_id)) AS engine_variants,
               count(DISTINCT CASE WHEN event_type <> 'error' THEN user_id END) AS n_runs, strftime(min(t), '%Y-%m-%d %H:%M:%S') AS created_min, strftime(max(t), '%Y-%m-%d %H:%M:%S') AS created_max,
               avg(CASE WHEN secs > 0 THEN secs END) AS duration_avg, CAST(min(CASE WHEN secs > 0 THEN secs END) AS DOUBLE) AS duration_min, CAST(max(CASE WHEN secs > 0 THEN secs END) AS DOUBLE) AS duration_max,
               count(DISTINCT event_type) + count(DISTINCT user_id) AS n_inputs FROM ev_step""", "ev_step", "duration_avg duration_min duration_max",
          "n_records n_ids engine_variants n_runs created_min created_max n_inputs")
    r.add("l1_run_ids", lambda s, d: ledger.run_ids(parsed(s, d)),
          "SELECT user_id AS run_id, count(*) AS n_records FROM ev_step WHERE event_type <> 'error' GROUP BY 1", "ev_step", "", "run_id n_records")
    r.add("l1_step_durations", lambda s, d: ledger.steps(parsed(s, d)),
          """SELECT event_id AS id, user_id AS run_id, step, CAST(CASE WHEN p = 0 AND secs >= 0 THEN secs END AS DOUBLE) AS seconds FROM ev_step, (VALUES (0, 'transform_scale_variable'),
             (1, 'scale_choices'), (2, 'ops_choices'), (3, 'point_mgL_choices'), (4, 'transform_split_with_bounds'), (5, 'split_choices'), (6, 'perturbation_choices')) z(p, step)""",
          "ev_step", "seconds", "id run_id step")
    cols = "id run_id pos transform in out source renorm"
    body = 'SELECT id, run_id, CAST(pos AS INTEGER) AS pos, transform, "in" AS src, out AS dst, source, renorm, lower, upper, value FROM choice'
    named = lambda df: df.withColumnRenamed("in", "src").withColumnRenamed("out", "dst")
    cols = "id run_id pos transform src dst source renorm"
    r.add("l2_parameter_choices", lambda s, d: named(ledger.choices(parsed(s, d, True))), body, "ev_step choice", "lower upper value", cols)
    r.add("l4_realization_choices", lambda s, d: named(ledger.realization(parsed(s, d, True), 17)), body + " WHERE id = 17", "ev_step choice", "lower upper value", cols)
    r.add("l3_run_targets", lambda s, d: ledger.run_targets(parsed(s, d, True)), """
        SELECT run_id, CASE WHEN transform LIKE 'op\\_%' ESCAPE '\\' THEN 'op' ELSE transform END AS kind, out AS target, arg_max(lower, id) AS lower0, CAST(count(*) AS BIGINT) AS n,
               coalesce(string_agg(DISTINCT source, ',' ORDER BY source), '') AS sources,
               max(struct_pack(id := id, lower := lower, upper := upper)).lower AS lower, max(struct_pack(id := id, lower := lower, upper := upper)).upper AS upper
        FROM choice GROUP BY 1, 2, 3""", "ev_step choice", "lower upper", "run_id kind target sources n")
    r.add("l3_run_summary", lambda s, d: ledger.run_summary(parsed(s, d)).withColumn("created_min", F.date_format("created_min", "yyyy-MM-dd HH:mm:ss")),
          "SELECT user_id AS run_id, count(*) AS n_realizations, strftime(min(t), '%Y-%m-%d %H:%M:%S') AS created_min FROM ev_step GROUP BY 1", "ev_step", "", "run_id n_realizations created_min")
    r.add("l3_run_transforms", lambda s, d: ledger.run_transforms(parsed(s, d)), """
        SELECT user_id AS run_id, step, min(event_id) AS first_id, CAST(p AS INTEGER) AS first_pos FROM ev_step, (VALUES (0, 'transform_scale_variable'), (1, 'scale_choices'),
          (2, 'ops_choices'), (3, 'point_mgL_choices'), (4, 'transform_split_with_bounds'), (5, 'split_choices'), (6, 'perturbation_choices')) z(p, step) GROUP BY ALL""",
          "ev_step", "", "run_id step first_id first_pos")
    r.add("l5_replay_plan", lambda s, d: ledger.replay_plan(parsed(s, d)).withColumn("lower", F.get_json_object("args", "$.outputs[0].lower").cast("int")),
          "SELECT event_id AS id, CAST(0 AS INTEGER) AS step_no, 'transform_split_with_bounds' AS step, k AS lower FROM ev_step", "ev_step", "", "id step_no step lower")
    r.add("u5_unique_inputs", lambda s, d: ledger.unique_inputs(parsed(s, d)),
          "SELECT DISTINCT '/in/' || event_type || '.tif' AS path FROM events UNION SELECT DISTINCT '/in/' || user_id || '.csv' FROM events", "", "", "path")
    r.add("l6_raster_inputs_by_run", lambda s, d: ledger.unique_inputs(parsed(s, d), True, True),
          "SELECT DISTINCT user_id AS run_id, '/in/' || event_type || '.tif' AS path FROM events", "", "", "run_id path")
    r.add("k3_ledger_records",
          lambda s, d: sinks.ledger_records(parsed(s, d).select("id", "run_id", "name", "error", "created_at").withColumn("error", F.when(F.col("run_id").isNull(), "stopped"))),
          f"""SELECT event_id AS id, '1' AS schema_version, {iso} AS created_at, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status FROM ev_step""",
          "ev_step", "", "id schema_version created_at status")

    # comparison
    def two(s, d):
        a = views.sub(s, d)
        b = a.withColumn("wyld", F.when(F.col("wyld") > 30, F.col("wyld") * 1.25).otherwise(F.col("wyld"))).withColumnRenamed("nsurq", "nsurq2")
        b = b.withColumn("solp", F.when(F.col("sub") == 4, F.lit(None).cast("double")).otherwise(F.col("solp")))
        return a, b

    r.add("a17_difference_counts", lambda s, d: compare.difference_counts(*two(s, d), ["sub", "date"], ["wyld", "solp", "sedp"]), """
        SELECT 'wyld' AS name, count(*) FILTER (WHERE wyld > 30) AS n_different FROM sub UNION ALL SELECT 'solp', count(*) FILTER (WHERE sub = 4) FROM sub
        UNION ALL SELECT 'sedp', 0 FROM sub GROUP BY 1""", "sub", "", "name n_different")
    r.add("a18_difference_metrics",
          lambda s, d: compare.difference_metrics(two(s, d)[0], two(s, d)[1].withColumn("nsurq2", F.col("nsurq2") + 0.5), ["sub", "date"], ["wyld", "sedp"], [("nsurq", "nsurq2")]), """
        SELECT 'wyld' AS name, count(*) FILTER (WHERE wyld > 30) AS n_different, avg(CASE WHEN wyld > 30 THEN wyld * 0.25 ELSE 0 END) AS mean_abs_diff,
               max(CASE WHEN wyld > 30 THEN wyld * 0.25 ELSE 0 END) AS max_abs_diff, avg(CASE WHEN wyld = 0 THEN NULL WHEN wyld > 30 THEN 0.25 ELSE 0 END) AS mean_rel_diff FROM sub
        UNION ALL SELECT 'nsurq vs nsurq2', count(*), 0.5, 0.5, avg(0.5 / nullif(nsurq, 0)) FROM sub""", "sub", "mean_abs_diff max_abs_diff mean_rel_diff", "name n_different")

    def files(s, d):
        c = views.table(s, d, "customer").select(F.col("c_custkey"), F.concat("c_mktsegment", F.lit("/"), F.col("c_custkey").cast("string"), F.lit(".txt")).alias("path"))
        o = views.table(s, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
        extra = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("extra/"), F.col("o_custkey").cast("string"), F.lit(".txt"))).otherwise(F.col("path"))
        return compare.reconcile_files(c.select("path"), o.select(F.col("o_orderpriority").alias("name"), extra.alias("path")), ["^BUILDING/", r"^extra/.*7\.txt$"])

    r.add("u4_reconciled_files", files, """
        WITH w AS (SELECT DISTINCT c_mktsegment || '/' || c_custkey || '.txt' AS path FROM customer WHERE c_mktsegment = 'BUILDING'),
        p AS (SELECT DISTINCT o_orderpriority AS name, CASE WHEN o_orderstatus = 'P' THEN 'extra/' || o_custkey || '.txt' ELSE c_mktsegment || '/' || c_custkey || '.txt' END AS path
              FROM orders JOIN customer ON c_custkey = o_custkey)
        SELECT name, count(w.path) AS linked, count(*) FILTER (WHERE w.path IS NULL AND (p.path LIKE 'BUILDING/%' OR (p.path LIKE 'extra/%' AND p.path LIKE '%7.txt'))) AS extra_in_realization,
               (SELECT count(*) FROM w) AS matched, (SELECT count(*) FROM w) - count(w.path) AS missing_in_realization
        FROM p LEFT JOIN w ON w.path = p.path GROUP BY 1""", "", "", "name linked extra_in_realization matched missing_in_realization")
    r.add("u2_common_band_days",
          lambda s, d: fitq.reach_fan(s, d).where("mean is not null and min is not null and max is not null").join(fitq.flow_day(s, d), "date", "left_semi").select(*fitq.KEYS, "date"),
          "SELECT rch, variable, date FROM q3 WHERE date IN (SELECT date FROM flow_day)", "sim reach_load q3 flow flow_day", "", "rch variable date")
    r.add("t2_top_months_per_reach",
          lambda s, d: _top(resample.resample(balance.join_sub(views.sim(s, d), views.sub(s, d)), ["rch"], ["sed_out"], "M", 1, "sum")),
          """SELECT rch, date, sed_out FROM (SELECT rch, last_day(s.date) AS date, sum(sed_out) AS sed_out FROM sim s GROUP BY 1, 2)
             QUALIFY row_number() OVER (PARTITION BY rch ORDER BY sed_out DESC, date) <= 3""", "sim", "sed_out", "rch date", 2)
    r.add("w7_rank_of_quantities",
          lambda s, d: order.exact_rank(views.table(s, d, "lineitem").select("l_linenumber", "l_quantity", "l_orderkey", "l_partkey"), ["l_linenumber"], "l_quantity",
                                        ["l_orderkey", "l_partkey"], True).groupBy("l_linenumber", "l_quantity").agg(
              F.sum("rank").alias("rank_sum"), F.min("rank").alias("rank_min"), F.count_distinct("rank").alias("ranks"), F.max("n").alias("n")),
          """SELECT l_linenumber, l_quantity, CAST(sum(rank) AS BIGINT) AS rank_sum, min(rank) AS rank_min, count(*) AS ranks, max(n) AS n FROM (
               SELECT l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_quantity DESC) AS rank, count(*) OVER (PARTITION BY l_linenumber) AS n
               FROM lineitem) GROUP BY 1, 2""", "", "l_quantity", "l_linenumber rank_sum rank_min ranks n")
    # composed reports: the same sections, each from the SQL of its own query
    r.add("m27_view_statistics",
          lambda s, d: bundles.view_statistics(fitq.reach_fan(s, d), fitq.sited(s, d), extras=fitq.scenarios(s, d), events=fitq.event_table(s, d), windows=(1, 3), keys=fitq.KEYS),
          report_sql(r, (1, 3), True), f"{fitq.PAIRS} nearest scen spairs {fitq.EV}", "value", "rch variable section name metric")
    SQL["sim_month"] = f"""
        SELECT run_id, rch, variable, last_day(date) AS date, sum(v) AS v FROM (
          SELECT run_id, rch, s.date AS date, unnest(['load', 'tot_n']) AS variable, unnest([load_kg / 1000, tot_n]) AS v FROM sim s WHERE {_VIEW.format('s.date')})
        GROUP BY 1, 2, 3, 4"""
    swap = {"reach_load": "sim_month", "sited": "sited_month"}
    SQL["sited_month"] = f"""
        SELECT rch, variable, d.station AS station, d.analyte AS analyte, date, obs FROM (
          SELECT station, analyte, last_day(date) AS date, avg(obs) AS obs FROM (
            SELECT station, analyte, CAST(date AS DATE) AS date, avg(CASE WHEN v < 0 THEN 0.0 ELSE v END) AS obs FROM (SELECT *, TRY_CAST(value AS DOUBLE) AS v FROM samples)
            WHERE {_VIEW.format('date::DATE')} AND date <= TIMESTAMP '2000-12-31' GROUP BY 1, 2, 3) GROUP BY 1, 2, last_day(date)) d
        JOIN sites ON sites.station = d.station AND sites.analyte = d.analyte"""
    chain = ["sim", "reach_load", "q3", *fitq.SITED.split(), "pairs", "nearest"]
    head = ", ".join(f"{n} AS ({SQL[swap.get(n, n)]})" for n in chain)
    r.add("m28_evaluate_fit",
          lambda s, d: bundles.evaluate_fit(views.sim(s, d).withColumn("load", F.col("load_kg") / 1000), views.samples(s, d), ["load", "tot_n"], None, "M", 1, "sum",
                                            "1996-01-01", "2000-12-31", [3, 4, 5, 6, 7, 8], sites=fitq.sites(s, d)),
          f"WITH {head} {report_sql(r, (1,), False)}", "", "value", "rch variable section name metric", 3)


_VIEW = "{0} BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AND month({0}) BETWEEN 3 AND 8"


def _section(section: str, metrics: str, body: str, name: str = "''", keys: str = "rch, variable") -> str:
    labels = ", ".join(f"'{m}'" for m in metrics.split())
    cells = ", ".join(f"CAST({m} AS DOUBLE)" for m in metrics.split())
    return f"SELECT {keys}, '{section}' AS section, {name} AS name, unnest([{labels}]) AS metric, unnest([{cells}]) AS value FROM ({body})"


def report_sql(r: Registry, windows, scenarios: bool) -> str:
    """SQL of a view report, put together from the bodies of the single queries."""
    b = r.body
    cov = ", ".join(f"avg(CASE WHEN obs BETWEEN {lo} AND {hi} THEN 1.0 ELSE 0.0 END) AS {n}" for n, (lo, hi) in fit.COVERAGE.items())
    usage = ("sim_days_total sim_days_finite sim_days_windowed sim_days_windowed_finite measured_days_total measured_days_finite measured_days_windowed "
             "measured_days_windowed_finite paired_days_used sim_usage_percent measured_usage_percent paired_usage_percent")
    whole = b["m21_data_usage"].replace("date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'", "TRUE")
    whole = whole.replace("DATE '1996-01-01'", "DATE '0001-01-01'").replace("DATE '1999-12-31'", "DATE '9999-12-31'")
    summary = "n mean sd var min max p05 p25 median p75 p95"

    def spread(v: str, source: str) -> str:
        return f"""SELECT rch, variable, count({v}) AS n, avg({v}) AS mean, stddev_pop({v}) AS sd, var_pop({v}) AS var, min({v}) AS min, max({v}) AS max,
            quantile_cont({v}, 0.05) AS p05, quantile_cont({v}, 0.25) AS p25, quantile_cont({v}, 0.5) AS median, quantile_cont({v}, 0.75) AS p75,
            quantile_cont({v}, 0.95) AS p95 FROM {source} GROUP BY 1, 2"""

    log = "SELECT rch, variable, n AS n_pos, r AS r_log, r2 AS r2_log, rmse AS rmse_log10, mae AS mae_log10, nse AS nse_log, d AS d_log FROM (" + fitq.metrics_sql(
        "(SELECT rch, variable, log10(obs) AS obs, log10(pred) AS pred FROM pairs WHERE obs > 0 AND pred > 0) lg", fitq.K) + ")"
    names = "band_width_mean band_width_rel_pct band_asymmetry band_rmse_vs_mean"
    both = " ".join(f"{p}_{n}" for p in ("p50", "p90") for n in names.split())
    local = "n rmse mae bias nse median_lag_days iqr_lag_days fraction_zero_lag"
    env = "median_w mean_w p90_w coverage_fraction"
    parts = [
        _section("data_usage", usage, whole),
        _section("same_day", f"n {fitq.FULL}", b["m11_pairwise_metrics"]),
        _section("same_day", " ".join(fit.COVERAGE), f"SELECT rch, variable, {cov} FROM pairs GROUP BY 1, 2"),
        _section("log_space", "n_pos r_log r2_log rmse_log10 mae_log10 nse_log d_log", log),
        _section("distribution_paired_observed", summary, spread("obs", "pairs")),
        _section("distribution_paired_predicted", summary, spread("pred", "pairs")),
        _section("distribution_observed", summary, spread("obs", "sited")),
        _section("distribution_predicted", summary, spread("p50", "q3")),
        _section("global_lag", "best_lag_days r r2 rmse mae nse", b["m19_best_lag_by_r"]),
        *[_section(f"local_window_K{k}", local, b[f"m20_local_window_summary_{k}"]) for k in windows],
        _section("band_deviation", names, b["m15_band_deviation"]),
        _section("band_deviation", both, b["m16_percentile_band_deviation"]),
        _section("measured_vs_series", "coverage50 coverage90 coverage100 coverage_minmax",
                 f"SELECT rch, variable, {cov}, avg(CASE WHEN obs BETWEEN min AND max THEN 1.0 ELSE 0.0 END) AS coverage_minmax FROM nearest GROUP BY 1, 2"),
        _section("baseline_summary", "median mean sd relative_width relative_width_mean", b["m26_baseline_summary"]),
        _section("baseline_envelope", env, """SELECT rch, variable, quantile_cont(abs(max - min), 0.5) AS median_w, avg(abs(max - min)) AS mean_w,
            quantile_cont(abs(max - min), 0.9) AS p90_w, avg(CASE WHEN p50 BETWEEN min AND max THEN 1.0 ELSE 0.0 END) AS coverage_fraction FROM q3 GROUP BY 1, 2""", "'baseline'"),
    ]
    if scenarios:
        shift = ("n_pairs median_delta median_delta_pct relative_width baseline_min baseline_max baseline_mean baseline_p50 baseline_p90 overlay_min overlay_max "
                 "overlay_mean overlay_p50 overlay_p90 delta_min delta_max delta_mean delta_p50 delta_p90 normalized_median_delta rmse r")
        parts += [
            _section("extras", "n r", b["m18_extra_correlations"], "scenario"),
            _section("overlay_comparison", shift, b["m22_shift_set_median"], "scenario"),
            _section("overlay_comparison", "relative_width_low relative_width_high relative_width_event_contrast", b["m23_stratified_widths"], "scenario"),
            _section("overlay_comparison", env, b["m25_envelope_widths"], "scenario"),
            _section("overlay_full_series", "n_pairs r r2 mae rmse bias medae", b["m22_overlay_metrics"], "scenario"),
            _section("overlay_comparison", "relative_width_event relative_width_nonevent event_pairs non_event_pairs delta_event_pairs delta_non_event_pairs "
                     "delta_event_pairs_mean delta_non_event_pairs_mean event_ratio", b["m24_event_shift"], "scenario"),
            _section("event_context", "event_days buffered_days non_event_days selected_days all_days", """
                SELECT count(*) FILTER (WHERE is_event) AS event_days, count(*) FILTER (WHERE is_buffered) AS buffered_days,
                       count(*) FILTER (WHERE NOT is_buffered) AS non_event_days, count(*) AS selected_days, count(*) AS all_days FROM evdays""", "''", "NULL::INTEGER AS rch, NULL::VARCHAR AS variable"),
        ]
    return " UNION ALL ".join(parts)


def _top(df):
    rank = F.row_number().over(Window.partitionBy("rch").orderBy(F.col("sed_out").desc(), "date"))
    return df.withColumn("rank", rank).where(F.col("rank") <= 3)
