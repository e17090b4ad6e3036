"""Colors: references, palettes, brightness, scheme lookup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The indexed palette.
PALETTE = ("000000", "000000", "0000FF", "00FFFF", "00FF00", "FF00FF", "FF0000", "FFFF00", "FFFFFF")
# End of fixed values.


def from_reference(ref: Column) -> Column:
    """RRGGBB of a reference whose lowest byte is red."""
    byte = lambda k: F.shiftright(ref, 8 * k).bitwiseAND(F.lit(255))
    return F.format_string("%02X%02X%02X", byte(0), byte(1), byte(2))


def from_palette(index: Column) -> Column:
    """RRGGBB of a palette index; black outside."""
    return F.coalesce(F.get(F.array(*[F.lit(c) for c in PALETTE]), index.cast("int")), F.lit("000000"))


def channel(color: Column, k: int) -> Column:
    """Red (0), green or blue of RRGGBB."""
    return F.conv(F.substring(color, 2 * k + 1, 2), 16, 10).cast("int")


def brightness(color: Column) -> Column:
    return channel(color, 0) * F.lit(0.299) + channel(color, 1) * F.lit(0.587) + channel(color, 2) * F.lit(0.114)


def _six(color: Column) -> Column:
    return F.coalesce(F.length(color) == 6, F.lit(False))


def is_dark(color: Column) -> Column:
    return _six(color) & (brightness(color) < 128)


def is_near_white(color: Column) -> Column:
    """Very bright, or bright and hardly colored."""
    rgb = [channel(color, k) for k in range(3)]
    spread = F.greatest(*rgb) - F.least(*rgb)
    light = brightness(color)
    return _six(color) & ((light > 230) | ((light > 180) & (spread < 80)))


def is_low_contrast(a: Column, b: Column) -> Column:
    """Nearer than the distance that tells two colors apart; so are colors
    that can't be read."""
    far = sum((channel(a, k) - channel(b, k)) * (channel(a, k) - channel(b, k)) for k in range(3))
    return ~(_six(a) & _six(b)) | (far < 15000)


def resolve(color: Column, raw: Column, scheme: Column) -> Column:
    """A color through its master's scheme of eight: the raw reference's high
    byte 1 to 7 names a color of the scheme, 8 leaves the choice to the low
    byte, 254 without color means the first."""
    high = F.shiftrightunsigned(raw.cast("long"), 24).bitwiseAND(F.lit(255))
    low = raw.bitwiseAND(F.lit(255))
    index = F.when(high.between(1, 7), high).when((high == 8) & (low < 8), low).when((high == 254) & (raw.bitwiseAND(F.lit(0xFFFFFF)) == 0), F.lit(0))
    known = (F.size(scheme) == 8) & (F.length(color) > 0) & index.isNotNull()
    return F.when(known, F.get(scheme, index.cast("int"))).otherwise(color)
