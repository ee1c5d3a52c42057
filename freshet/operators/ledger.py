"""Analytics over the provenance ledger: one JSON record per realization."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILE = "struct<path:string, size:long, mtime:double, sha256:string, kind:string>"

# fixed values: record layout; free-form parts stay JSON text, step arguments too unless typed
LEDGER_SCHEMA = f"""schema_version string, id long, run_id long, name string, created_at string, base_txtinout string,
    realization_folder string, results_dir string, parameters map<string,string>,
    engine struct<module:string, version:string, seed:string, N:string, run_id:long>,
    inputs array<{FILE}>,
    steps array<struct<name:string, module:string, args:string, started_at:string, ended_at:string,
        inputs:array<{FILE}>, outputs:array<{FILE}>, notes:string, extra:string>>,
    status string, error string, outputs_summary string, returncode int, _corrupt_record string"""
VARIANT_LEDGER_SCHEMA = LEDGER_SCHEMA.replace("args:string", "args:variant")

# fixed values: steps that declare bounds, and steps that record choices
BOUND_STEPS = ["transform_scale_variable", "transform_split_with_bounds"]
CHOICE_STEPS = ["perturbation_choices", "scale_choices", "ops_choices", "point_mgL_choices", "split_choices"]

# fixed values: step names that stand for a transform
TRANSFORMS = ["transform_compute_base_soil_vars", "transform_perturb_relative", "transform_split_with_bounds",
              "transform_apply_ops", "transform_build_point_load_timeseries", "transform_write_point_dat_from_df",
              "transform_interpolate_years_wide", "transform_write_chm_from_df"]


def parse_lines(lines: DataFrame, column: str = "value", typed_args: bool = False) -> DataFrame:
    """JSON lines to records; blank and broken lines are left out.

    ``typed_args`` reads the step arguments as VARIANT in the same pass, from which ``choices`` takes
    the few paths it wants; otherwise they stay text, as a replay needs them.
    """
    record = F.from_json(column, VARIANT_LEDGER_SCHEMA if typed_args else LEDGER_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    # inline is a generator: each line is parsed once, however many fields are used
    rec = lines.where(F.length(F.trim(column)) > 0).select(F.inline(F.array(record)))
    # a broken line yields nothing at all; one odd argument leaves the rest of its record readable
    kept = F.col("_corrupt_record").isNull() | F.coalesce(F.col("id").cast("string"), F.col("name"), F.col("created_at")).isNotNull()
    return rec.where(kept).drop("_corrupt_record")


def timestamp(text: Column | str) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return t.try_cast("timestamp")


def steps(ledger: DataFrame) -> DataFrame:
    """One row per step with its position and duration in seconds (NULL when unknown or negative)."""
    s = ledger.select("id", _run_id().alias("run_id"), F.posexplode("steps").alias("pos", "s"))
    a, b = timestamp("s.started_at"), timestamp("s.ended_at")
    secs = (F.unix_micros(b) - F.unix_micros(a)) / 1e6
    return s.select("id", "run_id", "pos", F.col("s.name").alias("step"), F.col("s.args").alias("args"),
                    F.when(b >= a, secs).alias("seconds"))


def _run_id() -> Column:
    return F.coalesce(F.col("run_id"), F.col("engine.run_id"))


def summary(ledger: DataFrame) -> DataFrame:
    """One row on the whole ledger: counts, time span and step durations per record."""
    a = lambda s: F.unix_micros(timestamp(s["started_at"]))
    b = lambda s: F.unix_micros(timestamp(s["ended_at"]))
    timed = F.filter("steps", lambda s: a(s).isNotNull() & b(s).isNotNull() & (b(s) >= a(s)))
    secs = F.aggregate(timed, F.lit(0.0), lambda acc, s: acc + (b(s) - a(s)) / 1e6)
    # the record itself comes first, then one row per input path, so one pass serves both
    paths = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(F.transform("inputs", lambda i: i["path"]), F.array().cast("array<string>")))
    r = ledger.select("id", "run_id", F.coalesce(F.to_json("engine"), F.lit("{}")).alias("engine"), timestamp("created_at").alias("t"),
                      F.when(F.size(timed) > 0, secs).alias("secs"), F.posexplode(paths).alias("pos", "path"))
    own = lambda c: F.when(F.col("pos") == 0, F.col(c))
    return r.agg(
        F.count(own("pos")).alias("n_records"), F.count(own("id")).alias("n_ids"), F.count_distinct(own("engine")).alias("engine_variants"),
        F.count_distinct(own("run_id")).alias("n_runs"), F.min("t").alias("created_min"), F.max("t").alias("created_max"),
        F.avg(own("secs")).alias("duration_avg"), F.min("secs").alias("duration_min"), F.max("secs").alias("duration_max"),
        F.count_distinct(F.when(F.col("path") != "", F.col("path"))).alias("n_inputs"))


def unique_inputs(ledger: DataFrame, rasters_only: bool = False, by_run: bool = False) -> DataFrame:
    """Distinct input paths, of the whole ledger or per run."""
    keys = ["run_id"] if by_run else []
    p = ledger.select(*([_run_id().alias("run_id")] if by_run else []), F.explode("inputs").alias("i")).select(*keys, F.col("i.path").alias("path"))
    p = p.where(F.col("path").isNotNull() & (F.col("path") != ""))
    if rasters_only:
        low = F.lower("path")
        p = p.where(low.endswith(".tif") | low.endswith(".tiff") | low.endswith(".shp"))
    return p.distinct()


def run_ids(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("run_id").isNotNull()).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_records"))


def _choice(kind: Column, src: Column, out: Column, c: Column, value: Column, renorm: Column, bounds: tuple[Column, Column] | None = None) -> Column:
    lo, hi = bounds if bounds else (_get(c, "lower", "double"), _get(c, "upper", "double"))
    return F.struct(kind.alias("transform"), src.alias("in"), out.alias("out"), lo.alias("lower"), hi.alias("upper"),
                    value.cast("double").alias("value"), _get(c, "source").alias("source"), renorm.alias("renorm"))


def _get(v: Column, name: str, kind: str = "string") -> Column:
    """One field of a VARIANT object; NULL where it is absent or of another kind."""
    return F.try_variant_get(v, f"$.{name}", kind)


def choices(ledger: DataFrame) -> DataFrame:
    """Realised parameter choices: (transform, in, out, lower, upper, value, source, renorm) per record.

    Scale and split choices take their bounds from the sibling step that declared them, the
    last such step winning, else from themselves. A value copied from a source column is NULL. Step arguments are VARIANT, or text that
    is read as such; only the paths of a step's own kind are taken from them.
    """
    is_text = ledger.schema["steps"].dataType.elementType["args"].dataType.typeName() == "string"
    args = (lambda s: F.try_parse_json(s["args"])) if is_text else (lambda s: s["args"])
    typed = F.filter(F.transform("steps", lambda s, i: F.struct(i.alias("pos"), s["name"].alias("name"), args(s).alias("a"))), lambda s: s["name"].isin(*BOUND_STEPS, *CHOICE_STEPS))
    # explode of a one-element array keeps the parsed arguments from being parsed again per use
    r = ledger.select("id", _run_id().alias("run_id"), F.explode(F.array(typed)).alias("_s"))
    scale = F.transform(F.filter("_s", lambda s: s["name"] == BOUND_STEPS[0]), lambda s: F.struct(
        _get(s["a"], "out").alias("k"), _get(s["a"], "lower", "double").alias("lower"), _get(s["a"], "upper", "double").alias("upper")))
    split = F.flatten(F.transform(F.filter("_s", lambda s: s["name"] == BOUND_STEPS[1]), lambda s: F.transform(
        F.coalesce(_get(s["a"], "outputs", "array<variant>"), F.array().cast("array<variant>")),
        lambda o: F.struct(_get(o, "name").alias("k"), _get(o, "lower", "double").alias("lower"), _get(o, "upper", "double").alias("upper")))))
    r = r.withColumn("_scale", F.filter(scale, lambda k: k["lower"].isNotNull() | k["upper"].isNotNull())).withColumn("_split", split)
    r = r.select("id", "run_id", "_scale", "_split", F.explode(F.filter("_s", lambda s: s["name"].isin(*CHOICE_STEPS))).alias("_st"))
    a, name = F.col("_st.a"), F.col("_st.name")

    def sibling(where: str, key: Column, own: Column) -> tuple[Column, Column]:
        hit = F.try_element_at(F.filter(where, lambda k: k["k"] == key), F.lit(-1))
        return (F.when(hit.isNotNull(), hit["lower"]).otherwise(_get(own, "lower", "double")), F.when(hit.isNotNull(), hit["upper"]).otherwise(_get(own, "upper", "double")))

    none = F.lit(None).cast("boolean")
    each = lambda field, f: F.transform(_get(a, field, "array<variant>"), f)
    rows = (
        F.when(name == "perturbation_choices", each("targets", lambda t: _choice(
            F.lit("perturb_relative"), _get(t, "name"), _get(t, "name"), t, _get(t, "delta", "double"), none,
            (F.lit(None).cast("double"), F.lit(None).cast("double")))))
        .when(name == "scale_choices", F.array(_choice(
            F.lit("scale_variable"), _get(a, "src"), _get(a, "out"), a, _get(a, "factor", "double"), none, sibling("_scale", _get(a, "out"), a))))
        .when(name == "ops_choices", each("ops", lambda o: _choice(
            F.concat(F.lit("op_"), _get(o, "op")), _get(o, "src"), _get(o, "out"), o, _get(o, "value").try_cast("double"), none)))
        .when(name == "point_mgL_choices", F.transform(F.map_entries(_get(a, "mgL_values", "map<string, variant>")), lambda e: _choice(
            F.lit("mgL_point"), F.lit("population"), e["key"], e["value"], _get(e["value"], "mgL", "double"), none)))
        .when(name == "split_choices", each("outputs", lambda o: _choice(
            F.lit("split_with_bounds"), _get(a, "src"), _get(o, "name"), o, _get(o, "ratio", "double"), _get(a, "renormalize", "boolean"),
            sibling("_split", _get(o, "name"), o)))))
    return (r.select("id", "run_id", F.col("_st.pos").alias("pos"), F.posexplode(rows).alias("item", "c"))
            .select("id", "run_id", "pos", "item", "c.*"))


def run_targets(ledger: DataFrame) -> DataFrame:
    """Per run, transform and target: last bounds recorded and the sources used."""
    c = choices(ledger).where(F.col("out").isNotNull())
    kind = F.when(F.col("transform").startswith("op_"), "op").otherwise(F.col("transform"))
    last = F.max_by(F.struct("lower", "upper"), F.struct("id", "pos", "item"))
    return (c.groupBy("run_id", kind.alias("kind"), F.col("out").alias("target"))
            .agg(last.alias("b"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"), F.count(F.lit(1)).alias("n"))
            .select("run_id", "kind", "target", F.col("b.lower").alias("lower"), F.col("b.upper").alias("upper"), "sources", "n"))


def run_summary(ledger: DataFrame) -> DataFrame:
    """Per run: number of realizations and time span."""
    t = timestamp("created_at")
    return ledger.groupBy(_run_id().alias("run_id")).agg(
        F.count(F.lit(1)).alias("n_realizations"), F.min(t).alias("created_min"), F.max(t).alias("created_max"))


def run_transforms(ledger: DataFrame) -> DataFrame:
    """Step names of each run with where each was first seen."""
    s = ledger.select("id", _run_id().alias("run_id"), F.posexplode("steps").alias("pos", "s"))
    first = F.min(F.struct("id", "pos"))
    return (s.where(F.col("s.name").isNotNull()).groupBy("run_id", F.col("s.name").alias("step")).agg(first.alias("f"))
            .select("run_id", "step", F.col("f.id").alias("first_id"), F.col("f.pos").alias("first_pos")))


def realization(ledger: DataFrame, realization_id: int) -> DataFrame:
    """Choice rows of one realization."""
    return choices(ledger.where(F.col("id") == realization_id))


def replay_plan(ledger: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    """Steps that stand for a transform, in order, with their arguments."""
    r = ledger.where(F.col("id").isNotNull())
    if ids is not None:
        r = r.where(F.col("id").isin(list(ids)))
    mine = F.filter("steps", lambda s: s["name"].isin(TRANSFORMS))
    return (r.select("id", F.posexplode(mine).alias("step_no", "s"))
            .select("id", "step_no", F.col("s.name").alias("step"), F.col("s.args").alias("args")))
