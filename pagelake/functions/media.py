"""Media type from magic bytes, as one native CASE over byte prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _at(b: Column, pos: int, n: int) -> Column:
    """Hex of ``n`` bytes starting at 1-based ``pos``."""
    return F.hex(F.substring(b, pos, n))


# --- fixed values: magic numbers in hex, and the characters that may follow a P1..P6 mark
JPEG_MARKS, JPEG_START = ("4A464946", "45786966"), "FFD8FF"
PNG, GIF, TIFF = "89504E470D0A1A0A", ("474946383761", "474946383961"), ("4D4D", "4949")
RGB, RAST, XBM, BMP, EXR = "01DA", "59A66A95", "23646566696E6520", "424D", "762F3101"
PBM, PGM, PPM = ("5031", "5034"), ("5032", "5035"), ("5033", "5036")
AFTER_MARK = ("20", "09", "0A", "0D")
RIFF, WEBP = "52494646", "57454250"
# --- end of fixed values


def media_type(content) -> Column:
    """First matching rule wins; null when nothing matches."""
    b = _as_col(content)

    def starts(*marks: str) -> Column:
        return _at(b, 1, len(marks[0]) // 2).isin(*marks)

    def netpbm(marks: tuple[str, str]) -> Column:
        return starts(*marks) & _at(b, 3, 1).isin(*AFTER_MARK)

    rules = [
        ("jpeg", _at(b, 7, 4).isin(*JPEG_MARKS) | starts(JPEG_START)), ("png", starts(PNG)), ("gif", starts(*GIF)),
        ("tiff", starts(*TIFF)), ("rgb", starts(RGB)), ("pbm", netpbm(PBM)), ("pgm", netpbm(PGM)), ("ppm", netpbm(PPM)),
        ("rast", starts(RAST)), ("xbm", starts(XBM)), ("bmp", starts(BMP)),
        ("webp", starts(RIFF) & (_at(b, 9, 4) == WEBP)), ("exr", starts(EXR)),
    ]
    expr = None
    for name, cond in rules:
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr
