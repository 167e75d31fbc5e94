"""Colours, boxes and grid cells."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from glyphward.schema import DEFAULTS


def is_near_white(hexadecimal: Column, over: float = DEFAULTS.near_white_luma) -> Column:
    """False where the colour is missing, ``auto`` or no six hex digits."""
    h = F.trim(hexadecimal)
    channel = lambda i: F.conv(F.substring(h, i, 2), 16, 10).cast("double") / 255
    luma = channel(1) * 0.299 + channel(3) * 0.587 + channel(5) * 0.114
    return F.coalesce(F.when(h.rlike("^[0-9A-Fa-f]{6}$"), luma > over), F.lit(False))


def colours_close(a: Column, b: Column, eps: float = DEFAULTS.colour_eps) -> Column:
    """Of two arrays of three channels; null where either is unknown."""
    return (F.abs(a[0] - b[0]) < eps) & (F.abs(a[1] - b[1]) < eps) & (F.abs(a[2] - b[2]) < eps)


def run_background_shows(highlight: Column, shade: Column) -> Column:
    """A highlight or a dark shade makes near-white text readable."""
    lit = F.coalesce(highlight != "none", F.lit(False))
    shaded = F.coalesce((F.lower(shade) != "auto") & ~is_near_white(shade), F.lit(False))
    return lit | shaded


def contains(x0: Column, y0: Column, x1: Column, y1: Column, x: Column, y: Column) -> Column:
    return (x >= x0) & (x <= x1) & (y >= y0) & (y <= y1)


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(x1 - x0, F.lit(0.0)) * F.greatest(y1 - y0, F.lit(0.0))


def cell(value: Column, low: Column, high: Column, grid: int = DEFAULTS.grid) -> Column:
    """Grid cell of a coordinate; what lies outside counts for the border cell."""
    return F.greatest(F.lit(0), F.least(F.lit(grid - 1), F.floor((value - low) / (high - low) * grid).cast("int")))
