"""Parameter scenarios and their application to zone tables.

A parameter table has one row per bounded or fixed parameter: step_no, name, src, op,
standard, lower, upper. It comes from a written specification and is small; what grows is
the number of runs and the zone table they apply to.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freshet.operators import zones
from freshet.sources import sinks

PARAM_SCHEMA = ("step_no int, pos int, type string, target string, src string, name string, op string, "
                "standard double, lower double, upper double, renormalize boolean")

# fixed values: layout of an experiment description
EXPERIMENT_SCHEMA = """name string, N int, seed int, inputs map<string,string>, workspace map<string,string>,
    run map<string,string>, provenance map<string,string>,
    variables array<struct<name:string, sources:array<string>, aggregation:map<string,string>,
        uncertainty:struct<kind:string, params:map<string,double>>, ratios:map<string,string>, writer:map<string,string>>>"""


def _num(v: Any) -> float | None:
    return None if v is None else float(v)


def spec_rows(spec: dict[str, Any]) -> list[tuple]:
    """Parameters of a nested specification, in order: operations, split ratios, concentrations."""
    rows = []
    for step, t in enumerate(spec.get("transforms", []), start=1):
        target = t.get("target", "chm")
        renorm = bool(t.get("renormalize", True))
        if t["type"] == "ops":
            for op in t.get("ops", []):
                kind = {"relative": "mul", "absolute": "add"}.get(op.get("op") or op.get("mode"), op.get("op"))
                given = {"mul": "factor", "add": "delta", "set": "value"}.get(kind)
                std = next((op[k] for k in (given, "standard", "mean") if op.get(k) is not None), None)
                rows.append((step, len(rows), "ops", target, op.get("src"), op.get("out") or op.get("src"), kind,
                             _num(std), _num(op.get("lower")), _num(op.get("upper")), None))
        elif t["type"] == "split":
            for o in t.get("outputs", []):
                rows.append((step, len(rows), "split", target, t["src"], o["name"], "split",
                             _num(o.get("standard", o.get("mean"))), _num(o.get("lower")), _num(o.get("upper")), renorm))
        elif t["type"] == "build_point":
            for var, m in t.get("mgL_values", {}).items():
                std = next((m[k] for k in ("mgL", "standard", "mean") if m.get(k) is not None), 0.0)
                rows.append((step, len(rows), "point", "point", "population", var, "mgL",
                             _num(std), _num(m.get("lower")), _num(m.get("upper")), None))
            litres = t.get("wastewater_lppd", 500.0)
            if not isinstance(litres, dict):
                litres = {"standard": litres}
            rows.append((step, len(rows), "point", "point", "population", "wastewater_lppd", "lppd",
                         _num(litres.get("standard", litres.get("mean"))), _num(litres.get("lower")), _num(litres.get("upper")), None))
    return rows


def params_from_spec(spark: SparkSession, spec: dict[str, Any]) -> DataFrame:
    return spark.createDataFrame(spec_rows(spec), PARAM_SCHEMA)


def experiment_variables(specs: DataFrame, column: str = "spec") -> DataFrame:
    """Typed experiment descriptions from JSON text, one row per variable."""
    typed = specs.withColumn("_s", F.from_json(column, EXPERIMENT_SCHEMA))
    return typed.select(
        F.col("_s.name").alias("experiment"), F.col("_s.N").alias("n_runs"), F.coalesce("_s.seed", F.lit(0)).alias("seed"),
        F.explode("_s.variables").alias("v")).select(
        "experiment", "n_runs", "seed", F.col("v.name").alias("variable"), F.coalesce("v.sources", F.array().cast("array<string>")).alias("sources"),
        F.col("v.uncertainty.kind").alias("kind"), F.col("v.uncertainty.params")["lower"].alias("lower"),
        F.col("v.uncertainty.params")["upper"].alias("upper"),
        F.coalesce(F.col("v.writer")["type"], F.lit("chm")).alias("writer"))


def is_bounded() -> Column:
    return F.col("lower").isNotNull() & F.col("upper").isNotNull() & (F.col("lower") != F.col("upper"))


def bounded(params: DataFrame) -> DataFrame:
    return params.where(is_bounded())


def _runs(params: DataFrame, spark: SparkSession, n: int) -> DataFrame:
    """Every parameter for each of n runs; the parameter list rides along as one array."""
    b = F.when(is_bounded(), 1).otherwise(0)

    order = Window.orderBy("step_no", "pos")  # the specification itself: a few dozen rows
    ranked = params.withColumn("is_bounded", b == 1).withColumn("bit", F.sum(b).over(order) - 1)
    cols = [*params.columns, "is_bounded", "bit"]
    listed = ranked.agg(F.collect_list(F.struct(*cols)).alias("p"))
    runs = spark.range(n).select((F.col("id") + 1).alias("run_no"))
    return runs.withColumn("p", F.explode(listed.scalar())).select("run_no", "p.*")


def _out(df: DataFrame, value: Column, source: Column) -> DataFrame:
    return df.select("run_no", "step_no", "pos", "name", "op", "src",
                     F.when(F.col("is_bounded"), value).otherwise(F.col("standard")).alias("value"),
                     F.when(F.col("is_bounded"), source).alias("source"))


def overrides_mean(params: DataFrame) -> DataFrame:
    """One run with every parameter at its standard value."""
    return params.select(F.lit(1).cast("long").alias("run_no"), "step_no", "pos", "name", "op", "src", F.col("standard").alias("value"),
                         F.lit("standard").alias("source"))


def overrides_minmax(params: DataFrame) -> DataFrame:
    """Two runs: every bounded parameter at its lower, then at its upper bound."""
    both = params.withColumn("is_bounded", is_bounded()).withColumn("run_no", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))))
    low = F.col("run_no") == 1
    return _out(both, F.when(low, F.col("lower")).otherwise(F.col("upper")),
                F.when(low, "all_lower").otherwise("all_upper"))


def overrides_extreme(params: DataFrame) -> DataFrame:
    """Every combination of bounds; the last parameter changes fastest."""
    k = bounded(params).count()  # rows of the specification
    if k > 62:
        raise ValueError(f"run numbers can't hold 2**{k} runs")
    spark = params.sparkSession
    df = _runs(params, spark, 1 << k)
    high = F.expr(f"shiftright(run_no - 1, {k - 1} - cast(bit as int)) & 1") == 1
    return _out(df, F.when(high, F.col("upper")).otherwise(F.col("lower")),
                F.when(high, "extreme_upper").otherwise("extreme_lower"))


def hash_uniform(*parts: Column) -> Column:
    """Uniform number in [0, 1) fixed by its inputs, so a lost task redraws the same value: 13 hex digits of their MD5."""
    digits = F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def overrides_random(params: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """Each bounded parameter drawn uniformly between its bounds, once per run."""
    df = _runs(params, params.sparkSession, draws)
    u = hash_uniform(F.lit(int(seed)), F.col("run_no"), F.col("step_no"), F.col("pos"), F.col("name"))
    return _out(df, F.col("lower") + u * (F.col("upper") - F.col("lower")), F.lit("random"))


def overrides(params: DataFrame, mode: str, draws: int = 1, seed: int = 0) -> DataFrame:
    mode = mode.strip().lower()
    if mode in ("minmax", "lower_upper"):
        return overrides_minmax(params)
    if mode == "extreme":
        return overrides_extreme(params)
    if mode == "random":
        return overrides_random(params, draws, seed)
    if mode == "mean":
        return overrides_mean(params)
    raise ValueError(f"unknown mode {mode!r}")


def corner_runs(spark: SparkSession, alphas: dict[str, float]) -> DataFrame:
    """Corner perturbations: every sign combination of +-alpha per element, as relative factors."""
    rows = [(1, i, "ops", "chm", name, name, "mul", 1.0, 1.0 - a, 1.0 + a, None) for i, (name, a) in enumerate(alphas.items())]
    return overrides_extreme(spark.createDataFrame(rows, PARAM_SCHEMA))


def per_run(over: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per run with a column per parameter."""
    return over.groupBy("run_no").pivot("name", list(names)).agg(F.first("value", True))


#: Runs whose parameters are sent to every task; those of more runs are spread by run number.
SENT_RUNS = 100_000


def meet_runs(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of many runs with the parameters of their run (one row per run).

    The rows are multiplied by run, which Spark's estimate of their size leaves out, so the side that travels is named here:
    the runs are counted first, and the rows are never collected to be sent.
    """
    few = runs.limit(SENT_RUNS + 1).count() <= SENT_RUNS
    return rows.join(F.broadcast(runs) if few else runs.hint("shuffle_hash"), "run_no")


def base_by_run(base: DataFrame, runs: DataFrame) -> DataFrame:
    """Every zone row once per run with the run's parameters.

    The zone rows are multiplied in place by run number, in two steps of about the root of the number of runs, and then meet
    the parameters in an equality join, so neither a row nor a task ever holds the product.
    """
    last = runs.agg(F.max("run_no").cast("long")).scalar()
    steps = base.withColumn("_last", last).withColumn("_w", F.ceil(F.sqrt("_last")).cast("long"))
    steps = steps.withColumn("_hi", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_last") - 1) / F.col("_w")).cast("long"))))
    lo = F.sequence(F.lit(1).cast("long"), F.least("_w", F.col("_last") - F.col("_hi") * F.col("_w")))
    steps = steps.withColumn("_lo", F.explode(lo)).withColumn("run_no", F.col("_hi") * F.col("_w") + F.col("_lo"))
    return meet_runs(steps.drop("_last", "_w", "_hi", "_lo"), runs)


def with_defaults(over: DataFrame, params: DataFrame) -> DataFrame:
    """Override values with the standard value and bounds of their parameter kept beside them."""
    meta = params.select("step_no", "pos", "name", "standard", "lower", "upper")
    return (over.join(meta, ["step_no", "pos", "name"], "left")
            .withColumn("value", F.coalesce("value", "standard")))


def apply_ops(df: DataFrame, ops: Sequence[dict[str, Any]], value_of: dict[str, str] | None = None) -> DataFrame:
    """Column operations in order: mul, add, set (relative and absolute are mul and add).

    A parameter comes from the per-run column named in ``value_of`` for its output, else from
    the operation (factor, delta or value, then mean, then standard). An operation left without one is
    skipped; set can also copy its source column.
    """
    for op in ops:
        kind = {"relative": "mul", "absolute": "add"}.get(op.get("op") or op.get("mode"), op.get("op"))
        out = op.get("out") or op.get("src")
        if kind not in ("mul", "add", "set"):
            raise ValueError(f"unknown operation {kind!r}")
        given = next((op[k] for k in ({"mul": "factor", "add": "delta", "set": "value"}[kind], "mean", "standard")
                      if op.get(k) is not None), None)
        if value_of and out in value_of:
            p = F.col(value_of[out])
        elif given is not None:
            p = F.lit(float(given))
        elif kind == "set" and op.get("src"):
            df = df.withColumn(out, F.col(op["src"]))
            continue
        else:
            continue
        df = df.withColumn(out, {"mul": lambda: F.col(op["src"]) * p, "add": lambda: F.col(op["src"]) + p, "set": lambda: p}[kind]())
    return df


def scale(df: DataFrame, src: str, out: str, factor: float = 1.0, mode: str = "relative") -> DataFrame:
    f = F.lit(float(factor))
    return df.withColumn(out, F.col(src) * f if mode == "relative" else F.col(src) + f)


def perturbations(runs: DataFrame, targets: Sequence[dict[str, Any]], seed: int = 0) -> DataFrame:
    """One delta per run and target: the given one, a uniform draw within +-bound, or 0."""
    parts = []
    for t in targets:
        bound = float(t.get("bound", 0.0))
        if t.get("delta") is not None:
            delta, source = F.lit(float(t["delta"])), "override"
        elif bound > 0:
            delta = (2 * hash_uniform(F.lit(int(seed)), F.col("run_no"), F.lit(t["name"])) - 1) * bound
            source = "random"
        else:
            delta, source = F.lit(0.0), "none"
        parts.append(F.struct(F.lit(t["name"]).alias("name"), F.lit(t.get("mode", "relative")).alias("mode"),
                              F.lit(bound).alias("bound"), delta.alias("delta"), F.lit(source).alias("source")))
    return runs.select("run_no", F.explode(F.array(*parts)).alias("t")).select("run_no", "t.*")


def perturb(df: DataFrame, deltas: DataFrame, targets: Sequence[dict[str, Any]]) -> DataFrame:
    """Apply the deltas of each row's run: x (1 + delta) when relative, + delta when absolute."""
    names = [t["name"] for t in targets]
    wide = deltas.groupBy("run_no").pivot("name", names).agg(F.first("delta"))
    wide = wide.select("run_no", *[F.col(n).alias(f"_d_{n}") for n in names])
    out = meet_runs(df, wide)
    for t in targets:
        c, d = F.col(t["name"]), F.col(f"_d_{t['name']}")
        out = out.withColumn(t["name"], c * (1 + d) if t.get("mode", "relative") == "relative" else c + d)
    return out.drop(*[f"_d_{n}" for n in names])


def split_fractions(ratios: DataFrame, renormalize: bool = True) -> DataFrame:
    """Attach ``fraction``: the ratio, divided by the total of its run and step unless that is 0."""
    if not renormalize:
        return ratios.withColumn("fraction", F.col("ratio"))
    total = ratios.groupBy("run_no", "step_no").agg(F.sum("ratio").alias("_t"))
    return (ratios.join(total, ["run_no", "step_no"])
            .withColumn("fraction", F.coalesce(F.try_divide("ratio", "_t"), F.col("ratio"))).drop("_t"))


def split_column(df: DataFrame, src: str, fractions: DataFrame, names: Sequence[str]) -> DataFrame:
    """Share a source column out over named outputs by the fractions of each row's run."""
    wide = fractions.groupBy("run_no").pivot("name", list(names)).agg(F.first("fraction"))
    wide = wide.select("run_no", *[F.col(n).alias(f"_f_{n}") for n in names])
    return meet_runs(df, wide).withColumns({n: F.col(src) * F.col(f"_f_{n}") for n in names}).drop(*[f"_f_{n}" for n in names])


def split_fixed(df: DataFrame, src: str, ratios: dict[str, float]) -> DataFrame:
    return df.withColumns({n: F.col(src) * float(r) for n, r in ratios.items()})


#: Step types of a specification, and the table that each works on where it names none.
STEP_TARGETS = {"ops": "chm", "split": "chm", "write_chm": "chm", "interpolate_years_wide": "point", "build_point": "point", "write_point_dat": "point"}


def run_from_spec(base: DataFrame, spec: dict[str, Any], mode: str | None = None, draws: int = 1, seed: int = 0, target: str = "chm",
                  soil_lines: DataFrame | None = None, areas: DataFrame | None = None) -> DataFrame:
    """Every run of the steps of a specification that work on ``target``, in their order; an unknown step type fails.

    ``chm``: zone rows after operations and splits; write_chm turns them into lines of the soil files ``soil_lines``. ``point``: a
    table of population by year, which is interpolated once for all runs; build_point makes the loads of each run, write_point_dat
    their lines.
    """
    for t in spec.get("transforms", []):
        if t["type"] not in STEP_TARGETS:
            raise ValueError(f"unknown step type {t['type']!r}")
    params = params_from_spec(base.sparkSession, spec)
    over = overrides(params, mode or spec.get("mode", "mean"), draws, seed).withColumn("_p", F.concat(F.lit("_p"), "pos"))
    rows = [r for r in spec_rows(spec) if r[3] == target]
    wide = over.groupBy("run_no").pivot("_p", [f"_p{r[1]}" for r in rows]).agg(F.first("value", True))
    drop = [f"_p{r[1]}" for r in rows]
    out = base_by_run(base, wide) if target == "chm" else base
    for step, t in enumerate(spec.get("transforms", []), start=1):
        kind, mine = t["type"], [r for r in rows if r[0] == step]
        if (t.get("target", "chm") if kind in ("ops", "split") else STEP_TARGETS[kind]) != target:
            continue
        if kind in ("ops", "split") and "run_no" not in out.columns:
            out = base_by_run(out, wide)
        if kind == "ops":
            for r in mine:
                has_value = r[7] is not None or (r[8] is not None and r[9] is not None and r[8] != r[9])
                out = apply_ops(out, [{"op": r[6], "src": r[4], "out": r[5]}], {r[5]: f"_p{r[1]}"} if has_value else None)
        elif kind == "split":
            total = sum((F.col(f"_p{r[1]}") for r in mine[1:]), F.col(f"_p{mine[0][1]}"))
            for r in mine:
                frac = F.col(f"_p{r[1]}")
                if r[10]:
                    frac = F.coalesce(F.try_divide(frac, total), frac)
                out = out.withColumn(r[5], F.col(r[4]) * frac)
        elif kind == "write_chm":
            if soil_lines is None:
                raise ValueError("write_chm needs the lines of the soil files")
            out = sinks.soil_file_lines(soil_lines, sinks.soil_replacements(out, t["label_map"], t["id_col"]))
        elif kind == "interpolate_years_wide":
            if "run_no" in out.columns:
                raise ValueError("interpolation comes before steps that differ by run")
            ident = t.get("id_col", "GRIDCODE")
            out = zones.interpolate_years(zones.normalise_years(out, ident), int(t["year_start"]), int(t["year_end"]), ident)
        elif kind == "build_point":
            ident = t.get("id_col", "GRIDCODE")
            by_run = out if "run_no" in out.columns else base_by_run(out, wide)
            value = {r[5]: F.col(f"_p{r[1]}") for r in mine}
            litres = value.pop("wastewater_lppd")
            columns = ["YEAR", "FLOYR", *[c for c in t.get("out_columns") or zones.POINT_COLUMNS if c not in ("YEAR", "FLOYR")]]
            out = zones.point_loads(by_run.withColumn("_litres", litres), value, columns=columns, id_col=ident, digits=int(t.get("round_to", 6)),
                                    litres_col="_litres", keys=["run_no"])
        else:
            ident = t.get("id_col", "GRIDCODE")
            out = sinks.point_file_lines(out, areas, t.get("start_year"), t.get("end_year"), t.get("columns_order") or zones.POINT_COLUMNS,
                                         ["run_no", ident], id_col=ident)
    return out.drop(*drop)
