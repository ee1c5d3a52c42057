"""Zonal statistics over pixels and the yearly point-source pipeline of zones."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions.nulls import number
from freshet.operators.order import exact_quantiles

EPS = 1e-12

# fixed values: column order of the yearly point-source table
POINT_COLUMNS = ["YEAR", "FLOYR", "SEDYR", "ORGNYR", "ORGPYR", "NO3YR", "NH3YR", "NO2YR", "MINPYR", "CBODYR", "DISOXYR",
                 "CHLAYR", "SOLPSTYR", "SRBPSTYR", "BACTPYR", "BACTLPYR", "CMTL1YR", "CMTL2YR", "CMTL3YR"]


# ---- pixels in polygons

def valid_zones(zones: DataFrame, field: str = "zone_id") -> DataFrame:
    text = F.col(field).cast("string")
    return zones.where(text.isNotNull() & (text != "") & (text != "NA"))


#: A cell of a cover is split until at most so many edges need a test in it.
MOST_EDGES = 6
#: Levels between a cell and its parts, so a cell has 4 ** STEP parts and a pixel one key for each STEP levels.
STEP = 2


def _edges(zones: DataFrame) -> Column:
    """All edges of a zone's rings: (i, j, x1, y1, x2, y2), i and j being the numbers of its two corners. Points without a coordinate are left out."""
    rings = F.col("rings") if "rings" in zones.columns else F.array("ring")
    known = lambda p: p["x"].isNotNull() & p["y"].isNotNull()
    rings = F.transform(F.filter(rings, lambda r: r.isNotNull()), lambda r: F.filter(r, known))
    flat = F.flatten(F.transform(rings, lambda r: F.transform(r, lambda p, k: F.struct(
        p["x"].alias("x1"), p["y"].alias("y1"),
        F.element_at(r, (k + 1) % F.size(r) + 1).alias("q"), F.when(k + 1 == F.size(r), -k).otherwise(1).alias("step")))))
    return F.transform(flat, lambda e, i: F.struct(i.alias("i"), (i + e["step"]).alias("j"), e["x1"].alias("x1"), e["y1"].alias("y1"),
                                                   e["q"]["x"].alias("x2"), e["q"]["y"].alias("y2")))


def _crosses(e: Column, x: Column, y: Column) -> Column:
    # even-odd rule; an edge owns its lower end only, so a shared edge counts for one zone
    spans = (e["y1"] > y) != (e["y2"] > y)
    return spans & (x < (e["x2"] - e["x1"]) * F.try_divide(y - e["y1"], e["y2"] - e["y1"]) + e["x1"])


def _clipped(edges: Column, odd: Column, cx: Column, cy: Column, level: Column, cell: float) -> Column:
    """(odd, edges) of a cell: the edges whose crossing depends on the place in the cell, and whether all others are crossed oddly.

    A ray runs to the right of a pixel. Edges left of the cell are never crossed. A chain of edges that pass the rows of the cell to the
    right of it, or don't reach them, is crossed as oddly as any line between its ends, so a far line takes its place. One that spans all
    rows always is crossed and only counted; one outside the rows, or closed, never. What is left are the edges in the cell and a few lines.
    """
    side = F.lit(float(cell)) * F.pow(F.lit(2.0), level)
    slack = 1e-6 * side
    x0, x1, y0, y1 = cx * side - slack, (cx + 1) * side + slack, cy * side - slack, (cy + 1) * side + slack
    low, high = lambda e: F.least(e["y1"], e["y2"]), lambda e: F.greatest(e["y1"], e["y2"])
    at = lambda e, y: e["x1"] + (e["x2"] - e["x1"]) * F.try_divide(y - e["y1"], e["y2"] - e["y1"])
    ends_at = lambda e: (at(e, F.greatest(low(e), y0)), at(e, F.least(high(e), y1)))
    in_rows = lambda e: (e["y1"] != e["y2"]) & (low(e) <= y1) & (high(e) > y0)
    spans = lambda e: (low(e) <= y0) & (high(e) > y1)
    passes = lambda e: F.coalesce(~in_rows(e) | (F.least(*ends_at(e)) > x1), F.lit(True))
    marked = F.transform(edges, lambda e: F.struct(passes(e).alias("far"), e.alias("e")))
    meet = lambda a, b: F.coalesce(a["far"] & b["far"] & (a["e"]["j"] == b["e"]["i"]), F.lit(False))
    far = F.lit(1e300)

    def parts(e: Column) -> Column:
        begins = F.filter(e, lambda x, k: x["far"] & ((k == 0) | ~meet(F.get(e, k - 1), x)))
        ends = F.filter(e, lambda x, k: x["far"] & ~meet(x, F.get(e, k + 1)))
        lines = F.zip_with(begins, ends, lambda a, b: F.struct(a["e"]["i"].alias("i"), b["e"]["j"].alias("j"), far.alias("x1"), a["e"]["y1"].alias("y1"), far.alias("x2"), b["e"]["y2"].alias("y2")))
        near = F.transform(F.filter(e, lambda x: ~x["far"] & (F.greatest(*ends_at(x["e"])) >= x0)), lambda x: x["e"])
        return F.struct(F.filter(lines, in_rows).alias("lines"), near.alias("near"))

    def result(p: Column) -> Column:
        rest = F.array_sort(F.concat(p["near"], F.filter(p["lines"], lambda e: ~spans(e))))
        return F.struct(((odd + F.size(F.filter(p["lines"], spans))) % 2).alias("odd"), rest.alias("edges"))

    return _let(_let(marked, parts), result)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """An expression on a value that is worked out once."""
    return F.transform(F.array(value), then)[0]


def zone_cover(zones: DataFrame, cell: float, field: str = "zone_id") -> tuple[DataFrame, int]:
    """Quadtree cells that cover each zone, (field, level, cx, cy, odd, edges), and the highest level.

    A cell of level l has the side cell * 2 ** l. It starts about as large as its zone and is split while more than MOST_EDGES edges
    need a test in it, down to ``cell``. Cells inside a zone carry no edges, cells outside are dropped: their number
    follows the edges of a zone and not its area, and every zone is covered in its own row, without a shuffle. A zone may have
    several parts and holes: a column ``rings`` of rings, or one ``ring``. Zones without three points hold nothing.
    """
    z = valid_zones(zones, field).select(field, _edges(zones).alias("e")).where(F.size("e") >= 3)
    x, y = F.col("e.x1"), F.col("e.y1")
    extent = F.greatest(F.array_max(x) - F.array_min(x), F.array_max(y) - F.array_min(y))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(extent, F.lit(cell)) / cell))).cast("int")
    level = (F.ceil(level / STEP) * STEP).cast("int")
    z = z.withColumn("level", level)
    top, most = (x or 0 for x in z.agg(F.max("level"), F.max(F.size("e"))).first())
    side = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("level"))
    span = lambda c: F.sequence(F.floor(F.array_min(c) / side), F.floor(F.array_max(c) / side))
    z = z.select(field, "e", "level", span(y).alias("ys"), F.explode(span(x)).alias("cx")).select(field, "e", "level", "cx", F.explode("ys").alias("cy"))
    z = z.select(field, "level", "cx", "cy", _clipped(F.col("e"), F.lit(0), F.col("cx"), F.col("cy"), F.col("level"), cell).alias("c"))
    n = 2**STEP
    for at in range(top if most > MOST_EDGES else 0, 0, -STEP):
        split = (F.col("level") == at) & (F.size("c.edges") > MOST_EDGES)
        parts = F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda k: F.struct(
            (F.col("level") - STEP).alias("level"), (F.col("cx") * n + k % n).alias("cx"), (F.col("cy") * n + F.floor(k / n)).alias("cy")))
        own = F.array(F.struct("level", "cx", "cy"))
        z = z.select(field, "c", split.alias("s"), F.explode(F.when(split, parts).otherwise(own)).alias("k"))
        deeper = _clipped(F.col("c.edges"), F.col("c.odd"), F.col("k.cx"), F.col("k.cy"), F.col("k.level"), cell)
        z = z.select(field, "k.level", "k.cx", "k.cy", F.when(F.col("s"), deeper).otherwise(F.col("c")).alias("c"))
        z = z.where((F.col("c.odd") == 1) | (F.size("c.edges") > 0))
    return z.where((F.col("c.odd") == 1) | (F.size("c.edges") > 0)).select(field, "level", "cx", "cy", "c.odd", "c.edges"), top


def pixels_in_zones(pixels: DataFrame, zones: DataFrame, cell: float, field: str = "zone_id") -> DataFrame:
    """Pixels with each zone holding their centre; all columns of the pixels and the zone.

    Pixels meet the quadtree cells of the zones by equality, under one key for each second level. In a cell inside a zone
    nothing is tested; in a border cell a pixel is tested against the few edges of the cell. ``cell`` is the smallest side of a cell, well
    below the smallest zone. Pixels without a place are in no zone.
    """
    cover, top = zone_cover(zones, cell, field)
    bx, by = F.floor(F.col("x") / cell), F.floor(F.col("y") / cell)
    keys = F.array(*[F.struct(F.lit(at).alias("level"), F.shiftright(F.col("_bx"), at).alias("cx"), F.shiftright(F.col("_by"), at).alias("cy")) for at in range(0, top + 1, STEP)])
    p = pixels.withColumns({"_bx": bx.cast("long"), "_by": by.cast("long")})
    p = p.select(*pixels.columns, F.explode(keys).alias("_k")).select(*pixels.columns, F.col("_k.level").alias("_level"), F.col("_k.cx").alias("_cx"), F.col("_k.cy").alias("_cy"))
    c = cover.select(field, *[F.col(n).alias("_" + n) for n in ("level", "cx", "cy", "odd", "edges")])
    hit = p.join(c, ["_level", "_cx", "_cy"])
    inside = (F.col("_odd") + F.size(F.filter("_edges", lambda e: _crosses(e, F.col("x"), F.col("y"))))) % 2 == 1
    return hit.where(inside).drop("_level", "_cx", "_cy", "_odd", "_edges")


def raster_alias(name: str | Column, mode: str = "year") -> str | Column:
    """Last underscore part of a raster name, or the whole name."""
    if isinstance(name, str):
        return name.split("_")[-1] if mode == "year" else name
    return F.element_at(F.split(name, "_"), -1) if mode == "year" else name


def zonal_long(pixels: DataFrame, zones: DataFrame, cell: float, stat: str = "sum", field: str = "zone_id",
               alias: str = "year") -> DataFrame:
    """Rounded sum or mean and pixel count per zone and raster; zero is no data."""
    inside = pixels_in_zones(pixels.where((F.col("value") != 0) & F.col("value").isNotNull()), zones, cell, field)
    f = F.sum("value") if stat == "sum" else F.avg("value")
    return (inside.groupBy(field, raster_alias(F.col("raster_id"), alias).alias("alias"))
            .agg(F.bround(f, 0).alias("stat"), F.count(F.lit(1)).cast("int").alias("pixels_included")))


def zonal_wide(pixels: DataFrame, zones: DataFrame, cell: float, rasters: Sequence[str], stat: str = "sum",
               field: str = "zone_id", alias: str = "year") -> DataFrame:
    """One row per zone with ``<stat>_<alias>`` and ``pixels_included_<alias>``; 0 where empty."""
    names = [raster_alias(r, alias) for r in rasters]
    wide = (zonal_long(pixels, zones, cell, stat, field, alias).groupBy(field).pivot("alias", names)
            .agg(F.first("stat").alias("s"), F.first("pixels_included").alias("n")))
    out = valid_zones(zones, field).select(field).join(wide, field, "left")
    cols = []
    for n in names:
        cols.append(F.coalesce(F.col(f"{n}_s"), F.lit(0.0)).alias(f"{stat}_{n}"))
        cols.append(F.coalesce(F.col(f"{n}_n"), F.lit(0)).alias(f"pixels_included_{n}"))
    return out.select(field, *cols)


def _usable(pixels: DataFrame, center: str) -> DataFrame:
    return (pixels.where(F.col("value").isNotNull() & F.col("se").isNotNull() & F.col(center).isNotNull())
            .withColumn("_c", F.col(center)))


def _factors(half: Column, clip: tuple[float, float]) -> list[Column]:
    h = F.greatest(F.least(half, F.lit(clip[1])), F.lit(clip[0]))
    return [h.alias("half_width_rel"), F.greatest(F.lit(0.0), 1 - h).alias("lower_factor"), (1 + h).alias("upper_factor")]


def grid_uncertainty(pixels: DataFrame, method: str = "p95_rel_se", center: str = "value", z: float = 1.96,
                     fixed_rel: float | None = None, clip: tuple[float, float] = (0.0, 2.0)) -> DataFrame:
    """One relative half width for a grid from its standard errors, with 1 - h and 1 + h."""
    p = _usable(pixels, center)
    if method == "p95_rel_se":
        rel = p.select(F.abs(F.col("se") / F.greatest(F.abs("_c"), F.lit(EPS))).alias("r"))
        one = exact_quantiles(rel, [], "r", {"h": 0.95})
    elif method == "rmse_rel_center":
        one = p.agg((F.sqrt(F.avg(F.col("se") * F.col("se"))) / F.greatest(F.avg(F.abs("_c")), F.lit(EPS))).alias("h"))
    elif method == "median_se_zscore":
        se = exact_quantiles(p.select(F.abs("se").alias("v")), [], "v", {"m": 0.5}).scalar()
        c = exact_quantiles(p.select(F.abs("_c").alias("v")), [], "v", {"m": 0.5}).scalar()
        one = p.agg(F.max(F.lit(1))).select((z * se / F.greatest(c, F.lit(EPS))).alias("h"))
    elif method == "fixed_rel":
        if fixed_rel is None:
            raise ValueError("fixed_rel needs a value")
        one = p.agg(F.max(F.lit(float(fixed_rel))).alias("h"))
    else:
        raise ValueError(f"unknown method {method!r}")
    return one.select(*_factors(F.col("h"), clip))


def zone_uncertainty(pixels: DataFrame, zones: DataFrame, cell: float, correlation_range: float, center: str = "value",
                     clip: tuple[float, float] = (0.0, 2.0), field: str = "zone_id") -> DataFrame:
    """Relative half width per zone from its effective number of independent pixels."""
    p = _usable(pixels, center)
    g = pixels_in_zones(p, zones, cell, field).groupBy(field).agg(
        F.count(F.lit(1)).alias("n_pixels"), F.avg(F.col("se") * F.col("se")).alias("mean_pixel_var"),
        F.avg("_c").alias("center_mean"))
    g = g.join(zones.select(field, "area_m2"), field)
    n_eff = F.greatest(F.lit(1.0), F.least(F.col("n_pixels").cast("double"), F.col("area_m2") / (F.pi() * correlation_range ** 2)))
    g = g.withColumn("n_eff", n_eff).withColumn("sd_zone", F.sqrt(F.col("mean_pixel_var") / F.col("n_eff")))
    g = g.withColumn("half_width_abs", 1.96 * F.col("sd_zone"))
    overall = exact_quantiles(p.select(F.abs("_c").alias("v")), [], "v", {"m": 0.5}).scalar()
    base = F.when(F.abs("center_mean") < EPS, F.greatest(overall, F.lit(EPS))).otherwise(F.abs("center_mean"))
    h = F.col("half_width_abs") / base
    return g.withColumn("half_width_rel", F.greatest(F.least(h, F.lit(clip[1])), F.lit(clip[0])))


def collapse_zone_uncertainty(per_zone: DataFrame, collapse: str | None = "p90", clip: tuple[float, float] = (0.0, 2.0)) -> DataFrame:
    """One half width over zones: median, p90 or max."""
    if collapse == "max":
        one = per_zone.agg(F.max("half_width_rel").alias("h"))
    elif collapse in (None, "median", "p90"):
        one = exact_quantiles(per_zone, [], "half_width_rel", {"h": 0.9 if collapse == "p90" else 0.5})
    else:
        raise ValueError(f"unknown collapse {collapse!r}")
    return one.select(*_factors(F.col("h"), clip))


# ---- zones by year

def year_columns(columns: Sequence[str]) -> dict[str, int]:
    """Population columns and their years: a trailing four-digit year, pixel counts left out."""
    found: dict[str, int] = {}
    for c in columns:
        m = re.search(r"(\d{4})$", str(c))
        if m and "pixel" not in c.lower() and int(m.group(1)) not in found.values():
            found[c] = int(m.group(1))
    return found


def normalise_years(df: DataFrame, id_col: str = "zone_id") -> DataFrame:
    """Wide table with the integer id and one numeric column per year, named by the year."""
    cols = year_columns([c for c in df.columns if c != id_col])
    num = lambda c: number(F.col(c).cast("string"))
    ident = F.split_part(F.col(id_col).cast("string"), F.lit(","), F.lit(1)).try_cast("int")
    return df.select(ident.alias(id_col), *[num(c).alias(str(y)) for c, y in cols.items()])


def years_long(df: DataFrame, id_col: str = "zone_id") -> DataFrame:
    """Normalised wide table to (zone, year, population)."""
    years = sorted(c for c in df.columns if c.isdigit())
    if not years:
        raise ValueError("No integer year columns found to interpolate")
    return (df.unpivot([id_col], years, "year", "population").withColumn("year", F.col("year").cast("int")))


def interpolate_years(df: DataFrame, y0: int, y1: int, id_col: str = "zone_id", legacy: bool = False) -> DataFrame:
    """Yearly population by linear interpolation, ends held; known years stay exact.

    The known points of a zone sit in its own row, so no shuffle is needed. The legacy form
    sees known years inside the range only and cuts results to whole numbers.
    """
    years = sorted(int(c) for c in df.columns if c.isdigit())
    if legacy:
        years = [y for y in years if y0 <= y <= y1]
    if not years:
        raise ValueError("No integer year columns found to interpolate")
    points = F.filter(F.array(*[F.struct(F.lit(y).alias("y"), F.col(str(y)).cast("double").alias("p")) for y in years]),
                      lambda k: k["p"].isNotNull())
    out = df.select(id_col, points.alias("_k"), F.explode(F.sequence(F.lit(y0), F.lit(y1))).alias("year"))
    prev = F.try_element_at(F.filter("_k", lambda k: k["y"] <= F.col("year")), F.lit(-1))
    nxt = F.try_element_at(F.filter("_k", lambda k: k["y"] >= F.col("year")), F.lit(1))
    out = out.withColumn("_a", prev).withColumn("_b", nxt)
    a, b = F.col("_a"), F.col("_b")
    slope = F.try_divide(b["p"] - a["p"], (b["y"] - a["y"]).cast("double"))
    value = F.coalesce(slope * (F.col("year") - a["y"]) + a["p"], a["p"], b["p"])
    if legacy:
        value = value.cast("long")
    return out.select(id_col, "year", value.alias("population"))


def extrapolate_years(df: DataFrame, last: int = 2025, id_col: str = "zone_id") -> DataFrame:
    """Years after the last known one, on the line through the last two, rounded to whole people."""
    years = sorted(int(c) for c in df.columns if c.isdigit())
    y1, y0 = years[-1], years[-2]
    whole = lambda y: F.col(str(y)).cast("long")
    slope = (F.col("year") - y1) / F.lit(float(y1 - y0))
    out = df.select(id_col, whole(y0).alias("_a"), whole(y1).alias("_b"),
                    F.explode(F.sequence(F.lit(y1 + 1), F.lit(last))).alias("year"))
    return out.select(id_col, "year", F.bround(F.col("_b") + slope * (F.col("_b") - F.col("_a")), 0).cast("long").alias("population"))


def year_totals(long: DataFrame) -> DataFrame:
    return long.groupBy("year").agg(F.sum("population").alias("population"))


def resolve_litres(spec: float | dict | None) -> float:
    """Litres per person and day: the value, else the standard, else 150."""
    if spec is None:
        return 150.0
    if isinstance(spec, dict):
        for k in ("value", "standard", "mean", "lppd", "val", "v"):
            if spec.get(k) is not None:
                return float(spec[k])
        return 150.0
    return float(spec)


def _half_even(v: Column, digits: int) -> Column:
    """Rounded as a double: a value a little below the middle of two goes down, also where its shortest text ends in 5."""
    scale = F.lit(float(10**digits))
    return F.rint(v * scale) / scale


def point_loads(long: DataFrame, concentrations: dict[str, float | dict | Column | None], litres: float | dict | None = None,
                columns: Sequence[str] = POINT_COLUMNS, id_col: str = "zone_id", digits: int = 6,
                fill_missing: bool = False, litres_col: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Waste water flow (m3/day) and pollutant loads (kg/day) per zone and year.

    A concentration is a number, a column or {mgL | mean | standard}; without one the load is 0. With
    ``fill_missing`` the columns that have no concentration are added as 0.
    """
    lpd = F.col(litres_col) if litres_col else F.lit(resolve_litres(litres))
    pop = F.col("population").cast("double")
    made = {"YEAR": F.col("year"), "FLOYR": _half_even(pop * lpd / 1000.0, digits)}
    for name, spec in concentrations.items():
        if isinstance(spec, dict):
            spec = next((spec[k] for k in ("mgL", "mean", "standard") if spec.get(k) is not None), None)
        made[name] = F.lit(0.0) if spec is None else _half_even((spec if isinstance(spec, Column) else F.lit(float(spec))) * lpd * pop / 1_000_000.0, digits)
    if fill_missing:
        for c in columns:
            made.setdefault(c, F.lit(0.0))
    return long.select(*keys, id_col, *[made[c].alias(c) for c in columns if c in made])


def soil_units(df: DataFrame, n_col: str, p_col: str) -> DataFrame:
    """Nitrogen percent and P2O5 mg/100 g to mg/kg of N and P."""
    return (df.withColumn("N_total_mg_kg", F.col(n_col) * 10_000.0)
            .withColumn("P_element_mg_kg", F.col(p_col) * (10.0 * 0.4364)))


def soil_pools(df: DataFrame, fractions: dict[str, tuple[str, float]], digits: int = 2) -> DataFrame:
    """Named pools as rounded fractions of total N or P."""
    return df.withColumns({name: F.bround(F.col(src) * frac, digits) for name, (src, frac) in fractions.items()})


