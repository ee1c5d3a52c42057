"""Writers: model input text as rows of lines, CSV tables, ledger records and manifests.

Text outputs are DataFrames of (keys, line_no, line). ``write_lines`` stores them partitioned
by run; a file's lines carry their number, so order never depends on how tasks finish.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.operators.zones import POINT_COLUMNS

PPERCO_LABEL = "Phosphorus perc coef"


def soil_file_lines(lines: DataFrame, replacements: DataFrame, pperco: float | None = None) -> DataFrame:
    """Base soil files of every run with new values in the first field of labelled lines.

    ``lines``: (hru_id, line_no, value); ``replacements``: (run_no, hru_id, label, value). A new
    value is right-aligned in the field it replaces. Zones without a file or without
    replacements give no output.
    """
    per_zone = replacements.groupBy("run_no", "hru_id").agg(
        F.sort_array(F.collect_list(F.struct("label", F.col("value").alias("v")))).alias("_r"))  # a few labels per zone
    if pperco is not None:
        extra = F.array(F.struct(F.lit(PPERCO_LABEL).alias("label"), F.lit(float(pperco)).alias("v")))
        per_zone = per_zone.withColumn("_r", F.concat("_r", extra))
    out = lines.join(per_zone, "hru_id")
    text, strip = F.col("value"), F.trim("value")
    hit = F.try_element_at(F.filter("_r", lambda r: strip.startswith(r["label"])), F.lit(1))
    colon = F.instr(text, ":")
    field = F.regexp_extract(text, r"^[^:]*:(\s*\S+)", 1)
    new = F.format_string("%.2f", hit["v"])
    padded = F.lpad(new, F.greatest(F.length(field), F.length(new)), " ")
    changed = F.concat(F.substr(text, F.lit(1), colon), padded, F.substr(text, colon + F.length(field) + 1))
    line = F.when(hit.isNotNull() & (F.length(field) > 0), changed).otherwise(text)
    ident = F.col("hru_id").cast("string")
    name = F.concat(F.lpad(ident, F.greatest(F.lit(9), F.length(ident)), "0"), F.lit(".chm"))
    return out.select("run_no", name.alias("file_name"), "line_no", line.alias("line"))


def soil_replacements(zones: DataFrame, label_map: dict[str, str], id_col: str = "hru_id") -> DataFrame:
    """(run_no, hru_id, label, value) from zone columns, by label."""
    cells = F.array(*[F.struct(F.lit(label).alias("label"), F.col(c).cast("double").alias("value")) for label, c in label_map.items()])
    return (zones.select("run_no", F.col(id_col).alias("hru_id"), F.explode(cells).alias("c"))
            .select("run_no", "hru_id", "c.*").where(F.col("value").isNotNull()))


def scientific(v: Column, decimals: int) -> Column:
    """C's ``%.nE`` of a finite double: its exact value, halves to the even digit.

    ``format_string`` rounds the shortest text of a double, halves up. ``format_number`` rounds the double itself, but halves of whole
    numbers up. Below 1e-310, where a double holds fewer digits than are asked for, they are those of its shortest text.
    """
    # one digit more, a 5 near the middle of two results, and the whole number it stands for
    longer = F.format_string(f"%.{decimals + 1}E", v)
    middle, whole = F.abs(longer.try_cast("decimal(19,0)").try_cast("long")), F.abs(v.try_cast("long"))
    down = F.when((F.abs(v) > 10.0**decimals) & (F.abs(v) < 2.0**62) & (v == F.rint(v)),
                  longer.contains("5E") & ((whole < middle) | (whole == middle) & longer.rlike(r"[02468]\.?5E")))
    near = F.when(down, v * (1 - 4e-16)).otherwise(v)  # a little below the middle
    text = F.call_function("format_number", near, F.lit("0." + "0" * decimals + "E00" if decimals else "0E00"))
    return F.replace(F.replace(text, F.lit("E"), F.lit("E+")), F.lit("E+-"), F.lit("E-"))


def scientific16(v: Column, most: int = 10) -> Column:
    """Scientific form with ten (or ``most``) decimals, or as many as sixteen characters hold; right-aligned, never cut."""
    most = min(most, 10)  # more never fit
    forms = {n: scientific(v, n) for n in range(most, min(most, 8) - 1, -1)}  # eight fit beside a sign and an exponent of three digits
    fits = F.get(F.filter(F.array(*forms.values()), lambda f: F.length(f) <= 16), F.lit(0))
    odd = F.when(F.isnan(v), "NAN").when(v == float("inf"), "INF").when(v == float("-inf"), "-INF")
    # exponents that stay at two digits tell what fits without trying
    text = (F.when((v >= 1e-99) & (v < 9e99), forms[most]).when((v <= -1e-99) & (v > -9e99), forms[min(most, 9)])
            .otherwise(F.coalesce(odd, fits)))
    return F.lpad(text, 16, " ")


def point_file_lines(loads: DataFrame, areas: DataFrame | None = None, start: int | None = None, end: int | None = None,
                     columns: Sequence[str] = POINT_COLUMNS, keys: Sequence[str] = ("run_no", "zone_id"),
                     source: str = "model", id_col: str = "zone_id") -> DataFrame:
    """Yearly point-source table of each zone: five title lines, a header and a line per year.

    ``areas``: (zone_id, area_ha), written in km2; 0.000 where a zone has none.
    """
    keys = list(keys)
    present = [c for c in columns if c in loads.columns and c != "YEAR"]
    df = loads
    if start is not None:
        df = df.where(F.col("YEAR") >= start)
    if end is not None:
        df = df.where(F.col("YEAR") <= end)
    span = df.groupBy(*keys).agg(F.min("YEAR").alias("_y0"), F.max("YEAR").alias("_y1"))
    km2 = F.lit(0.0)
    if areas is not None:
        span = span.join(areas.select(id_col, F.col("area_ha").alias("_ha")), id_col, "left")
        km2 = F.coalesce(F.col("_ha") / 100.0, F.lit(0.0))
    period = F.format_string("%d-%d", "_y0", "_y1")
    head = [
        F.format_string(" TITLE LINE 1 - Subbasin ID %d | Simulation Years: %s | DRAINAGE_AREA (km²): %s",
                        F.col(id_col), period, F.format_string("%.3f", km2)),
        F.lit(f" TITLE LINE 2 - Source: {source}"), F.lit(" TITLE LINE 3 - Units: kg/day"),
        F.concat(F.lit(" TITLE LINE 4 - Period: "), period), F.lit(" TITLE LINE 5 - "),
        F.lit(" YEAR" + "".join(c.rjust(17) for c in present)),
    ]
    titles = span.select(*keys, F.posexplode(F.array(*head)).alias("_i", "line")).select(*keys, (F.col("_i") + 1).alias("line_no"), "line")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("YEAR"))  # years of one zone
    line = F.concat(F.format_string("%5d", "YEAR"), *[F.concat(F.lit(" "), scientific16(F.col(c).cast("double"))) for c in present])
    return titles.unionByName(df.select(*keys, (rank + len(head)).alias("line_no"), line.alias("line")))


def write_lines(lines: DataFrame, path: str, by: str = "run_no", mode: str = "overwrite") -> None:
    lines.hint("rebalance", by).write.mode(mode).partitionBy(by).parquet(path)


def write_text_files(lines: DataFrame, path: str, run: str = "run_no", file: str = "file_name", mode: str = "overwrite") -> None:
    """Model text as one file for each run and file name: path/run=.../file=.../part, its lines in their order.

    ``lines``: (run, file, line_no, line). The lines of a file, one zone's text, become one value, so that their order doesn't rest on how
    rows reach the writer. Null lines are empty lines.
    """
    each = F.array_sort(F.collect_list(F.struct("line_no", F.coalesce("line", F.lit("")).alias("line"))))
    texts = lines.groupBy(run, file).agg(F.array_join(F.transform(each, lambda x: x["line"]), "\n").alias("text"))
    texts.write.mode(mode).partitionBy(run, file).text(path)


def append_ledger(records: DataFrame, path: str, copies: str | None = None) -> None:
    """Append one JSON line per record, and with ``copies`` also store each under its own name."""
    records.write.mode("append").option("ignoreNullFields", "false").json(path)
    if copies is not None:
        records.withColumn("realization", F.col("name")).write.mode("append").partitionBy("realization").json(copies)


def ledger_records(runs: DataFrame, schema_version: str = "1") -> DataFrame:
    """Ledger records from a run table (id, run_id, name, ...): version and status filled in."""
    out = runs.withColumn("schema_version", F.lit(schema_version))
    if "status" not in runs.columns:
        done = F.col("error").isNull() if "error" in runs.columns else F.lit(True)
        out = out.withColumn("status", F.when(done, "success").otherwise("failed"))
    if "created_at" not in runs.columns:
        out = out.withColumn("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return out


def write_zone_csv(zones: DataFrame, path: str, sep: str = ";") -> None:
    zones.write.mode("overwrite").option("header", "true").option("sep", sep).csv(path)


def zonal_manifest(pixels: DataFrame, zones_name: str, stat: str, alias: str, zone_meaning: str, layer: str) -> DataFrame:
    """One-row description of a zonal job: its rasters, extent and settings."""
    return pixels.groupBy("raster_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")) \
        .agg(F.sort_array(F.collect_list("raster_id")).alias("rasters"), F.array(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).alias("bounds")) \
        .select("rasters", F.lit(zones_name).alias("zones"), "bounds", F.lit(stat).alias("stat_operation"),
                F.lit(alias).alias("raster_alias"), F.lit(zone_meaning).alias("zone_meaning"), F.lit(layer).alias("layer"))


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").json(path)
