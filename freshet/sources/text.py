"""Reach, sub-basin and control text files of many runs in one scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freshet.functions.nulls import finite

HEADER_LINES = 9

# fixed values: names of the 63 reach-output fields, in file order
REACH_FIELDS = [
    "object type", "RCH", "GIS", "MON", "AREAkm2", "FLOW_INcms", "FLOW_OUTcms", "EVAPcms", "TLOSScms",
    "SED_INtons", "SED_OUTtons", "SEDCONCmg/L",
    "ORGN_INkg", "ORGN_OUTkg", "ORGP_INkg", "ORGP_OUTkg", "NO3_INkg", "NO3_OUTkg", "NH4_INkg", "NH4_OUTkg",
    "NO2_INkg", "NO2_OUTkg", "MINP_INkg", "MINP_OUTkg", "CHLA_INkg", "CHLA_OUTkg", "CBOD_INkg", "CBOD_OUTkg",
    "DISOX_INkg", "DISOX_OUTkg", "SOLPST_INmg", "SOLPST_OUTmg", "SORPST_INmg", "SORPST_OUTmg", "REACTPSTmg", "VOLPSTmg",
    "SETTLPSTmg", "RESUSP_PSTmg", "DIFFUSEPSTmg", "REACBEDPSTmg", "BURYPSTmg", "BED_PSTmg", "BACTP_OUTct", "BACTLP_OUTct",
    "CMETAL#1kg", "CMETAL#2kg", "CMETAL#3kg", "TOT_Nkg", "TOT_Pkg", "NO3ConcMg/l", "WTMPdegc",
    "Salt1", "Salt2", "Salt3", "Salt4", "Salt5", "Salt6", "Salt7", "Salt8", "Salt9", "Salt10", "SAR", "EC",
]
# fixed values: columns that a parsed reach table leaves out
REACH_DROPPED = ["object type", "total_days", "GIS", "MON", "AREAkm2", "YEAR"]

# fixed values: character offsets of the sub-basin fields
SUB_INTS = {"SUB": (7, 11), "GIS": (11, 20), "MON": (20, 25)}
SUB_DOUBLES = {
    "AREA": (26, 35), "PRECIP": (35, 45), "SNOMELT": (45, 55), "PET": (55, 65), "ET": (65, 75), "SW": (75, 85), "PERC": (85, 95),
    "SURQ": (95, 105), "GW_Q": (105, 115), "WYLD": (115, 125), "SYLD": (125, 135), "ORGN": (135, 145), "ORGP": (145, 155),
    "NSURQ": (155, 165), "SOLP": (165, 175), "SEDP": (175, 185)}


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Text lines as (file_path, line_no, value) with line numbers from 1 per file.

    Spark reads a large file in blocks. A line's place inside its block follows from the row
    id, and a table of one row per block adds the lines of the blocks before it, so lines are
    numbered without sorting them. Spark picks the join with the block table by its size.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), "value")
    blocks = raw.groupBy("file_path", "block").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file_path").orderBy("block")) - F.col("n")
    blocks = blocks.select("file_path", "block", "first", before.alias("before"))
    return (raw.join(blocks, ["file_path", "block"])
            .select("file_path", (F.col("row") - F.col("first") + F.col("before") + 1).alias("line_no"), "value"))


def folder_of(path: Column | str = "file_path") -> Column:
    p = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(p, "/[^/]*$", "")


def run_name(path: Column | str = "file_path", prefix: str = "rch_", name_from: str = "folder") -> Column:
    """Run id from the output folder (its name must hold "out_") or from the folder above."""
    p = F.col(path) if isinstance(path, str) else path
    parts = F.split(p, "/")
    folder = F.element_at(parts, -2)
    name = F.element_at(parts, -3) if name_from == "parent" else folder
    return F.when(F.lower(folder).contains("out_"), F.concat(F.lit(prefix), name)).otherwise(
        F.raise_error(F.concat(F.lit("expected 'out_' in the folder name: "), folder)))


def control_values(lines: DataFrame, keys: Sequence[str] = ("IYR", "NYSKIP", "NBYR", "IDAF")) -> DataFrame:
    """First value of each key per control file, its start date and simulated years."""
    text = F.trim(F.split_part("value", F.lit("|"), F.lit(1)))
    got = lines.groupBy(folder_of().alias("folder")).agg(*[
        F.min_by(F.when(F.col("value").contains(k), text), F.when(F.col("value").contains(k), F.col("line_no")))
        .try_cast("int").alias(k.lower()) for k in keys])
    first_year = F.col("iyr") + F.col("nyskip")
    return (got.withColumn("start_date", F.date_add(F.make_date(first_year, F.lit(1), F.lit(1)), F.col("idaf") - 1))
            .withColumn("start_year", first_year).withColumn("end_year", first_year + F.col("nbyr") - 1))


def with_dates(lines: DataFrame, controls: DataFrame, group_size: int = 17, header: int = HEADER_LINES) -> DataFrame:
    """Data lines with the day they belong to: ``group_size`` lines make one day."""
    if group_size <= 0:
        raise ValueError("group_size must be > 0")
    body = lines.where((F.col("line_no") > header) & (F.trim("value") != "")).withColumn("folder", folder_of())
    days = F.floor((F.col("line_no") - header - 1) / group_size).cast("int")
    return (body.withColumn("total_days", days).join(controls.select("folder", "start_date"), "folder")
            .withColumn("date", F.date_add("start_date", F.col("total_days"))).withColumn("YEAR", F.year("date"))
            .drop("start_date"))


def parse_reach(lines: DataFrame, controls: DataFrame, group_size: int = 17, header: int = HEADER_LINES,
                hectare_per_km2: float = 100.0, drop: Sequence[str] = REACH_DROPPED, prefix: str = "rch_",
                name_from: str = "folder") -> DataFrame:
    """Reach output lines to typed columns; a cell that is not a number becomes NULL."""
    d = with_dates(lines, controls, group_size, header).withColumn("_f", F.split(F.trim("value"), r"\s+"))
    cols = []
    for i, name in enumerate(REACH_FIELDS, start=1):
        cell = F.try_element_at("_f", F.lit(i))
        if name == "object type":
            cols.append(cell.alias(name))
        elif name in ("RCH", "GIS", "MON"):
            cols.append(cell.try_cast("int").alias(name))
        else:
            cols.append(finite(cell.try_cast("double")).alias(name))
    out = d.select(run_name(prefix=prefix, name_from=name_from).alias("run_id"), "date", "YEAR", "total_days", *cols)
    out = out.withColumn("area_ha", F.col("AREAkm2") * hectare_per_km2)
    return out.drop(*drop)


def parse_sub(lines: DataFrame, controls: DataFrame, group_size: int = 17, header: int = HEADER_LINES,
              hectare_per_km2: float = 100.0) -> DataFrame:
    """Fixed-width sub-basin lines to typed columns; a blank or bad cell becomes 0."""
    def cell(span: tuple[int, int]) -> Column:
        text = F.trim(F.substring("value", span[0] + 1, span[1] - span[0]))
        return F.coalesce(finite(text.try_cast("double")), F.lit(0.0))

    d = with_dates(lines, controls, group_size, header)
    return d.select(
        "folder", "total_days", "date", "YEAR",
        *[cell(s).cast("int").alias(n) for n, s in SUB_INTS.items()],
        *[cell(s).alias(n) for n, s in SUB_DOUBLES.items()],
    ).withColumn("area_ha", F.col("AREA") * hectare_per_km2)


def read_reach_runs(spark: SparkSession, folders: str | Sequence[str], **options) -> DataFrame:
    """Reach output of all run folders (or a glob of them)."""
    folders = [folders] if isinstance(folders, str) else list(folders)
    lines = read_lines(spark, [f"{f}/output.rch" for f in folders])
    controls = control_values(read_lines(spark, [f"{f}/file.cio" for f in folders]))
    return parse_reach(lines, controls, **options)


def read_sub_runs(spark: SparkSession, folders: str | Sequence[str], **options) -> DataFrame:
    folders = [folders] if isinstance(folders, str) else list(folders)
    lines = read_lines(spark, [f"{f}/output.sub" for f in folders])
    controls = control_values(read_lines(spark, [f"{f}/file.cio" for f in folders]))
    return parse_sub(lines, controls, **options)
