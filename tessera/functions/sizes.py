"""Dimensions, resolutions and savings as column expressions; every function states how it rounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MIB = 1 << 20


def _at_least(low: int, c: Column) -> Column:
    return F.greatest(F.lit(low).cast("bigint"), c.cast("bigint"))


def bbox_area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Area of a rectangle; one turned inside out has none."""
    return F.greatest(x1 - x0, F.lit(0.0)) * F.greatest(y1 - y0, F.lit(0.0))


def effective_dpis(width: Column, height: Column, shown_w: Column, shown_h: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    """struct(x, y): pixels an inch along the image's own axes. (a, b) and (c, d) are the images of its unit vectors; without
    them the orientation is taken whose ratio is nearer the image's. Nothing shown or no pixels: 0."""
    x, y = F.hypot(a, b), F.hypot(c, d)
    moved = F.coalesce((x > 0) & (y > 0), F.lit(False))
    ratio = width / height
    swapped = F.abs(F.ln((shown_h / shown_w) / ratio)) < F.abs(F.ln((shown_w / shown_h) / ratio))
    dx = F.when(moved, x).when(swapped, shown_h).otherwise(shown_w)
    dy = F.when(moved, y).when(swapped, shown_w).otherwise(shown_h)
    fine = F.coalesce((shown_w > 0) & (shown_h > 0) & (width > 0) & (height > 0), F.lit(False))
    zero = F.lit(0.0)
    return F.struct(F.when(fine, width * 72 / dx).otherwise(zero).alias("x"), F.when(fine, height * 72 / dy).otherwise(zero).alias("y"))


def dimension_at_dpi(dimension: Column, dpi: Column, target: float) -> Column:
    """Rounds down, within 1 and the dimension."""
    return _at_least(1, F.least(dimension.cast("bigint"), F.floor(dimension * target / dpi)))


def photo_dimensions(width: Column, height: Column, dpi_x: Column, dpi_y: Column, target: float) -> Column:
    """struct(w, h) rounded up so that no axis falls below the target; null if nothing changes or a resolution isn't positive and finite."""

    def axis(n: Column, dpi: Column) -> Column:
        return F.when(dpi <= target, n.cast("bigint")).otherwise(_at_least(1, F.least(n.cast("bigint"), F.ceil(n * target / dpi))))

    w, h = axis(width, dpi_x), axis(height, dpi_y)
    fine = reduce(lambda p, q: p & q, [(x > 0) & (x < float("inf")) & ~F.isnan(x) for x in (dpi_x, dpi_y)])
    return F.when(fine & ((w != width) | (h != height)), F.struct(w.alias("w"), h.alias("h")))


def fit_box(width: Column, height: Column, max_long: int, max_short: int) -> Column:
    """struct(w, h) within a box for the longer and the shorter side, never larger; rounds half to even."""
    scale = F.least(F.lit(1.0), max_long / F.greatest(width, height), max_short / F.least(width, height))
    return F.struct(*(_at_least(1, F.rint(n * scale)).alias(x) for x, n in (("w", width), ("h", height))))


def cap_width(width: Column, height: Column, cap: int = 1400) -> Column:
    """struct(w, h) with a width of at most cap; the height rounds half up, in integers."""
    w, h = width.cast("bigint"), height.cast("bigint")
    new_h = F.call_function("div", h * (2 * cap) + w, w * 2)
    return F.struct(F.least(w, F.lit(cap).cast("bigint")).alias("w"), F.when(w <= cap, h).otherwise(_at_least(1, new_h)).alias("h"))


def cap_longest(width: Column, height: Column, cap: int) -> Column:
    """struct(w, h) whose longer side is at most cap; rounds half up, in integers."""
    w, h = width.cast("bigint"), height.cast("bigint")
    longest = F.greatest(w, h)
    scaled = lambda n: _at_least(1, F.call_function("div", n * cap + F.call_function("div", longest, F.lit(2)), longest))
    return F.struct(*(F.when(longest <= cap, n).otherwise(scaled(n)).alias(x) for x, n in (("w", w), ("h", h))))


def cap_required(width: Column, height: Column, need_w: tuple[Column, Column], need_h: tuple[Column, Column]) -> Column:
    """struct(w, h) scaled by the larger of the exact ratios (numerator, denominator) of needed to own pixels; rounds up, never larger."""
    big = lambda c: c.cast("decimal(38,0)")
    (a, b), (c, d) = ((big(n), big(m) * big(s)) for (n, m), s in ((need_w, width), (need_h, height)))
    num, den = F.when(a * d >= c * b, a).otherwise(c), F.when(a * d >= c * b, b).otherwise(d)
    up = lambda n: _at_least(1, F.least(n.cast("bigint"), F.call_function("div", big(n) * num + den - 1, den)))
    return F.struct(up(width).alias("w"), up(height).alias("h"))


def video_box(width: Column, height: Column, max_w: int = 1280, max_h: int = 720) -> Column:
    """struct(w, h) within the box, rounded down to even, at least 2."""
    scale = F.least(F.lit(1.0), max_w / width, max_h / height)
    return F.struct(*(_at_least(2, F.floor(F.floor(n * scale) / 2) * 2).alias(x) for x, n in (("w", width), ("h", height))))


def page_pixels(width_pt: Column, height_pt: Column, dpi: float) -> Column:
    """Pixels of a page; both sides round up."""
    return F.ceil(width_pt * dpi / 72) * F.ceil(height_pt * dpi / 72)


def column_pixels(width_256: Column, digit_px: int) -> Column:
    """Pixels of a sheet column whose width is in 256ths of a digit."""
    return F.call_function("div", (width_256 + F.lit(128 // digit_px)) * digit_px, F.lit(256))


def even_tile(length: Column, most: int) -> Column:
    """array<struct(start, size)>: as few tiles of at most so much as cover length; the first ones are one longer if needed."""
    count = F.ceil(length / most).cast("bigint")
    base, extra = F.call_function("div", length, count), length % count
    tile = lambda i: F.struct((i * base + F.least(i, extra)).alias("start"), (base + (i < extra).cast("bigint")).alias("size"))
    return F.when(length > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), count - 1), tile)).otherwise(F.array().cast("array<struct<start:bigint,size:bigint>>"))


def saved_ratio(before: Column, after: Column) -> Column:
    """Share saved, 0 to 1."""
    return F.when(before > 0, (before - after) / before).otherwise(F.lit(0.0))


def saved_percent(before: Column, after: Column) -> Column:
    """Share saved, 0 to 100."""
    return F.when(before > 0, (before - after) / before * 100).otherwise(F.lit(0.0))


def enough_saved(before: Column, after: Column, min_bytes: int | Column, min_ratio: float | Column) -> Column:
    """Smaller, by so many bytes at least and so large a share at least."""
    saved = before - after
    return (saved > 0) & (saved >= min_bytes) & (saved / before >= min_ratio)


def is_close(a: Column, b: Column, rel: float = 1e-9, absolute: float = 0.0) -> Column:
    return F.abs(a - b) <= F.greatest(rel * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two bigints, by Euclid's steps (at most 92 for 64 bits)."""
    start = F.struct(F.abs(a).cast("bigint").alias("x"), F.abs(b).cast("bigint").alias("y"))
    step = lambda s, _: F.when(s.y == 0, s).otherwise(F.struct(s.y.alias("x"), (s.x % s.y).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s.x)


def fraction(text: Column) -> Column:
    """struct(num, den) in lowest terms from 'n/d' or 'n'; null unless positive."""
    parts = F.split(text, "/")
    n, d = F.get(parts, F.lit(0)).try_cast("bigint"), F.coalesce(F.get(parts, F.lit(1)), F.lit("1")).try_cast("bigint")
    g = gcd(n, d)
    return F.when((F.size(parts) <= 2) & (n > 0) & (d > 0), F.struct(F.call_function("div", n, g).alias("num"), F.call_function("div", d, g).alias("den")))


def fraction_less(a: Column, b: Column) -> Column:
    """a < b, exactly."""
    big = lambda c: c.cast("decimal(38,0)")
    return big(a["num"]) * big(b["den"]) < big(b["num"]) * big(a["den"])


def fraction_text(a: Column) -> Column:
    return F.concat(a["num"].cast("string"), F.lit("/"), a["den"].cast("string"))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))
