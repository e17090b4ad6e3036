"""Sizes of pictures from their first bytes."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from vellum.functions.units import EMU_PER_INCH

#: Pixels to a side that a header may name.
MOST = 19_999
DPI = 96
_SIZE = StructType([StructField("cx", LongType()), StructField("cy", LongType())])


def size_of(data: bytes | None) -> tuple[int, int] | None:
    """Width and height in EMU, or None where the header tells none: PNG by
    its resolution if it names one, JPEG and DIB at 96 dots to the inch, EMF by
    its frame in 0.01 mm."""
    if not data:
        return None
    data = bytes(data)
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            w, h = struct.unpack_from(">II", data, 16)
            x = y = DPI
            at = data.find(b"pHYs", 0, 4096)
            if at >= 0 and at + 13 <= len(data) and data[at + 12] == 1:
                x, y = (round(n * 0.0254) or DPI for n in struct.unpack_from(">II", data, at + 4))
            return _pixels(w, h, x, y)
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(data):
                if data[at] != 0xFF:
                    return None
                if data[at + 1] in (0xC0, 0xC1, 0xC2):
                    h, w = struct.unpack_from(">HH", data, at + 5)
                    return _pixels(w, h, DPI, DPI)
                at += 2 + struct.unpack_from(">H", data, at + 2)[0]
            return None
        if data[:4] == b"\1\0\0\0" and data[40:44] == b" EMF":
            l, t, r, b = struct.unpack_from("<iiii", data, 24)
            return ((r - l) * 360, (b - t) * 360) if r > l and b > t else None
        if struct.unpack_from("<I", data)[0] == 40:
            w, h = struct.unpack_from("<ii", data, 4)
            return _pixels(w, abs(h), DPI, DPI)
    except struct.error:
        pass
    return None


def _pixels(w: int, h: int, x: int, y: int) -> tuple[int, int] | None:
    return (w * EMU_PER_INCH // x, h * EMU_PER_INCH // y) if 0 < w <= MOST and 0 < h <= MOST else None


@F.pandas_udf(_SIZE)
def picture_size(pictures: pd.Series) -> pd.DataFrame:
    """Struct cx, cy in EMU of each picture; nulls where none is told."""
    rows = [size_of(p) or (None, None) for p in pictures]
    return pd.DataFrame(rows, columns=["cx", "cy"]).astype("Int64")
