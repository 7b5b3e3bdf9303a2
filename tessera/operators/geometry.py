"""Placements, pages and sample grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import sizes


def image_dpis(placements: DataFrame, by: Sequence[str], least: bool = False) -> DataFrame:
    """by, dpi_x, dpi_y: of each image the highest resolution an axis has over its placements, or the lowest."""
    pick = F.min if least else F.max
    return placements.groupBy(*by).agg(pick("dpi_x").alias("dpi_x"), pick("dpi_y").alias("dpi_y"))


def scan_ratio(pages: DataFrame, by: Sequence[str], area_ratio: Column, visible_text: Column, largest_dpi: Column) -> DataFrame:
    """by, pages, scan_pages, scan_ratio: a page is a scan if an image covers 0.8 of it, it has 20 signs at most and over 450 dots an inch."""
    scan = (area_ratio >= 0.8) & (visible_text <= 20) & (largest_dpi > 450)
    return pages.groupBy(*by).agg(F.count("*").alias("pages"), F.count_if(scan).alias("scan_pages"), (F.count_if(scan) / F.count("*")).alias("scan_ratio"))


def largest_placement(placements: DataFrame, by: Sequence[str], area: Column, ordinal: str, page_area: Column) -> DataFrame:
    """by, the largest placement's ordinal (the first among equals), area and share of the page, at most 1."""
    best = F.max(F.struct(area.alias("area"), (-F.col(ordinal)).alias("o"), page_area.alias("page")))
    return placements.groupBy(*by).agg(best.alias("b")).select(*by, (-F.col("b.o")).alias(ordinal), F.col("b.area").alias("area"), F.least(F.col("b.area") / F.col("b.page"), F.lit(1.0)).alias("area_ratio"))


def visible_text_length(spans: Column) -> Column:
    """Signs of spans (array of struct(render_type, opacity, chars)) that are neither of type 3 nor transparent."""
    seen = F.filter(spans, lambda s: (s["render_type"] != 3) & (s["opacity"] > 0))
    return F.aggregate(seen, F.lit(0), lambda n, s: n + F.size(s["chars"]))


def required_pixels(placements: DataFrame, by: Sequence[str], need_x: Column, need_y: Column) -> DataFrame:
    return placements.groupBy(*by).agg(F.max(need_x).alias("need_x"), F.max(need_y).alias("need_y"))


def tile_differences(a: Column, b: Column, side: int, tile: int) -> Column:
    """struct(global, local): mean absolute difference of two square sample grids, and the largest of a tile's means."""
    diff = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    count, n = -(-side // tile), side * side
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / F.size(xs)
    tiles = F.transform(F.sequence(F.lit(0), F.lit(count * count - 1)), lambda t: mean(F.filter(diff, lambda _, i: (F.floor(F.floor(i / side) / tile) == F.floor(t / count)) & (F.floor((i % side) / tile) == t % count))))
    return F.when(F.size(diff) == n, F.struct(mean(diff).alias("global"), F.array_max(tiles).alias("local")))


def extent(cells: DataFrame, sizes_: DataFrame, start: str, end: str) -> DataFrame:
    """cells with extent: the sum of sizes_ (sheet, idx, emu) from start up to end, 0 for an empty range.

    Running sums of each sheet, taken at both ends: nothing is exploded, and repeated cells stay repeated.
    """
    ends = cells.select("sheet", F.explode(F.array(F.col(start).cast("bigint"), F.col(end).cast("bigint"))).alias("idx")).distinct()
    marks = ends.select("sheet", "idx", F.lit(None).alias("emu"), F.lit(True).alias("end")).unionByName(sizes_.select("sheet", F.col("idx").cast("bigint").alias("idx"), "emu", F.lit(False).alias("end")))
    before = F.sum("emu").over(Window.partitionBy("sheet").orderBy("idx").rangeBetween(Window.unboundedPreceding, -1))
    sums = marks.withColumn("before", F.coalesce(before, F.lit(0))).where("end").select("sheet", "idx", "before")
    side = lambda at, name: sums.select(F.col("sheet").alias(f"_{name}_sheet"), F.col("idx").alias(f"_{name}_idx"), F.col("before").alias(f"_{name}"))
    out = cells
    for at, name in ((start, "low"), (end, "high")):
        out = out.join(side(at, name), F.col("sheet").eqNullSafe(F.col(f"_{name}_sheet")) & (F.col(at) == F.col(f"_{name}_idx")), "left")
    return out.select(*cells.columns, F.greatest(F.coalesce(F.col("_high") - F.col("_low"), F.lit(0)), F.lit(0)).alias("extent"))


def placement_area(x0: str, y0: str, x1: str, y1: str) -> Column:
    return sizes.bbox_area(*(F.col(c) for c in (x0, y0, x1, y1)))


def bounded_views(regions: DataFrame, by: str, page: str, order: str, pages: int = 100, most: int = 500) -> DataFrame:
    """The first so many regions of the first so many pages of each document; both are what a preview may show."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(page, order))
    return regions.where(F.col(page) <= pages).withColumn("view", nth).where(F.col("view") <= most)
