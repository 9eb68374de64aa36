"""Boxes of scanned lines on pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafline.functions.text import compact


def _axis(box: Column, i: int) -> Column:
    return F.transform(box, lambda p: p[i])


def extent(box: Column) -> tuple[Column, Column]:
    return F.array_max(_axis(box, 0)), F.array_max(_axis(box, 1))


def page_size(max_x: Column, max_y: Column, page_width: Column, page_height: Column) -> tuple[Column, Column]:
    """The image's size from the farthest corners and the page's shape."""
    aspect = F.greatest(page_width, F.lit(1.0)) / F.greatest(page_height, F.lit(1.0))
    return F.greatest(max_x, max_y * aspect), F.greatest(max_y, max_x / aspect)


def page_rect(box: Column, image_width: Column, image_height: Column, width: float, height: float) -> Column:
    """struct(x0, y0, x1, y1): a box of the image on a page, within it and not empty."""

    def side(i: int, image: Column, size: float, least: float) -> tuple[Column, Column]:
        full = F.greatest(F.coalesce(image, F.lit(1.0)), F.array_max(_axis(box, i)), F.lit(1.0))
        a, b = (F.least(F.greatest(f(_axis(box, i)) / full * size, F.lit(0.0)), F.lit(float(size))) for f in (F.array_min, F.array_max))
        return a, F.when(b <= a, F.least(F.lit(float(size)), a + least)).otherwise(b)

    x0, x1 = side(0, image_width, width, 1.0)
    y0, y1 = side(1, image_height, height, 4.0)
    return F.when(box.isNotNull() & (F.size(box) > 0), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def query_rect(line: Column, text: Column, query: str) -> Column:
    """The part of a line's rectangle that a query takes, by its share of the characters."""
    t, q = compact(text), F.lit("".join(query.split()))
    at = F.instr(t, "".join(query.split())) - 1
    width = F.greatest(F.lit(1.0), line["x1"] - line["x0"])
    x0 = line["x0"] + width * at / F.length(t)
    x1 = line["x0"] + width * (at + F.length(q)) / F.length(t)
    return F.when((at >= 0) & (F.length(q) > 0), F.struct(x0.alias("x0"), line["y0"].alias("y0"), F.greatest(x1, x0 + 1.0).alias("x1"), line["y1"].alias("y1")))


def page_pixels(width: Column, height: Column, dpi: Column) -> Column:
    """Pixels of a page of so many points."""
    return F.ceil((width * dpi / 72) * (height * dpi / 72))


def page_dpi(width: Column, height: Column, pages: Column, most: int = 40_000_000, least: int = 96, wanted: int = 220, large: int = 160, many: int = 300) -> Column:
    """The resolution a page is scanned at: lower in large documents, and as low as `most` pixels ask; null if `least` is too high even so."""
    asked = F.when(pages >= many, F.lit(min(max(least, wanted), max(least, large)))).otherwise(F.lit(max(least, wanted)))
    fitting = F.floor(F.sqrt(F.lit(float(most)) / F.greatest(F.lit(1.0), width * height)) * 72)
    lowered = F.greatest(F.lit(least), F.least(asked, fitting)).cast("int")
    return F.when(page_pixels(width, height, asked) <= most, asked).when(page_pixels(width, height, lowered) <= most, lowered)


def highlight(line: Column, text: Column, query: str, exact: Column, by_text: Column) -> Column:
    """array of rectangles to mark: the query's part of the stored line, else the line, else where the page has the query, else where it has the line's text."""
    own = F.when(line.isNotNull(), F.coalesce(query_rect(line, text, query), line))
    found = F.when(F.size(exact) > 0, exact).when(F.size(by_text) > 0, by_text)
    return F.when(own.isNotNull(), F.array(own)).otherwise(F.coalesce(found, F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")))
