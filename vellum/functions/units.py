"""Lengths, angles and crops, all whole numbers cut towards zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMU_PER_INCH, EMU_PER_POINT, EMU_PER_TWIP = 914400, 12700, 635


def divide(x: Column, y: Column | int) -> Column:
    """x / y of whole numbers, cut towards zero."""
    y = F.lit(y) if isinstance(y, int) else y
    x, y = x.cast("long"), y.cast("long")
    # the remainder has the sign of x, so what is left divides without rest
    return ((x - x % y) / y).cast("long")


def from_master(units: Column) -> Column:
    """EMU of units of 1/576 inch."""
    return divide(units.cast("long") * EMU_PER_POINT, 8)


def from_pixels(pixels: Column, dots_per_inch: Column | int = 96) -> Column:
    return divide(pixels.cast("long") * EMU_PER_INCH, dots_per_inch)


def from_hundredth_mm(units: Column) -> Column:
    return units.cast("long") * 360


def from_twips(twips: Column) -> Column:
    return twips.cast("long") * EMU_PER_TWIP


def crop(fixed: Column) -> Column:
    """1/100000 of a 16.16 share."""
    return divide(fixed.cast("long") * 100000, 65536)


def rotation(fixed: Column) -> Column:
    """1/60000 degrees, 0 up to a full turn, of 16.16 degrees."""
    turned = divide(fixed.cast("long") * 60000, 65536) % 21600000
    return F.when(turned < 0, turned + 21600000).otherwise(turned)


def is_quarter_turn(angle: Column) -> Column:
    """Whether width and height change places: within 45 degrees of 90 or 270."""
    degrees = angle / 60000
    return degrees.between(45, 135) | degrees.between(225, 315)


def fit_width(width: Column, height: Column, most: int) -> tuple[Column, Column]:
    """Size scaled down to a greatest width."""
    return F.when(width > most, F.lit(most).cast("long")).otherwise(width), F.when(width > most, divide(height.cast("long") * most, width)).otherwise(height)
