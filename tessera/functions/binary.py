"""Functions of raw bytes that Spark has no built-in for: Arrow-batched, standard library only."""

from __future__ import annotations

import struct
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, MapType, StringType, StructField, StructType


def image_header(data: bytes | None) -> tuple[str | None, int | None, int | None]:
    """Format, width and height of a PNG or a JPEG; nulls for anything else or broken."""
    none = (None, None, None)
    if not data:
        return none
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        if len(data) >= 33 and data[12:16] == b"IHDR" and struct.unpack(">I", data[8:12])[0] == 13:
            w, h = struct.unpack(">II", data[16:24])
            return ("png", w, h) if w and h else none
        return none
    if data[:2] != b"\xff\xd8":
        return none
    at, frames = 2, {0xC0, 0xC1, 0xC2}
    while at + 4 <= len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind in (0x01, *range(0xD0, 0xD8)):
            at += 2
            continue
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        if size < 2 or kind in (0xD9, 0xDA):
            return none
        if kind in frames:
            if at + 9 > len(data):
                return none
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return ("jpeg", w, h) if w and h else none
        at += 2 + size
    return none


@F.pandas_udf(StructType([StructField("format", StringType()), StructField("width", IntegerType()), StructField("height", IntegerType())]))
def image_dimensions(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([image_header(x) for x in data], columns=["format", "width", "height"]).astype({"width": "Int32", "height": "Int32"})


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode normal form C, which Spark has no function for."""
    return text.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def casefold(text: pd.Series) -> pd.Series:
    """Full case folding, where lower() isn't enough (one sign can become two)."""
    return text.map(lambda t: t if t is None else t.casefold())


@F.pandas_udf(BinaryType())
def bilevel(gray: pd.Series) -> pd.Series:
    """Samples of 220 and more are white; eight to a byte, the first in the highest bit."""
    import numpy as np

    return gray.map(lambda g: None if g is None else np.packbits(np.frombuffer(g, np.uint8) >= 220).tobytes())


def _map_entries(text: str) -> dict[int, int]:
    import re

    out: dict[int, int] = {}
    for kind, body in re.findall(r"beginbf(char|range)(.*?)endbf\1", text, re.S):
        if kind == "char":
            for a, b in re.findall(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]{4})>", body):
                out[int(a, 16)] = int(b, 16)
            continue
        for lo, hi, first, many in re.findall(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]{4})>|\[([^\]]*)\])", body):
            a, b = int(lo, 16), int(hi, 16)
            if b - a > 0xFFFF:
                raise ValueError("range too long")
            if first:
                out.update((a + i, int(first, 16) + i) for i in range(b - a + 1))
            else:
                out.update((a + i, int(x, 16)) for i, x in zip(range(b - a + 1), re.findall(r"<([0-9A-Fa-f]{4})>", many), strict=False))
    return out


@F.udf(MapType(IntegerType(), IntegerType()), useArrow=True)
def glyph_map(text: str) -> dict[int, int] | None:
    """Code to Unicode from a text map of single entries and ranges; broken maps give null."""
    try:
        return None if text is None else _map_entries(text)
    except ValueError:
        return None


def colour_profile_identity(data: Column) -> Column:
    """A colour profile without the bytes of its date and its own checksum, for comparisons."""
    zero = lambda n: F.unhex(F.lit("00" * n))
    part = lambda a, n=None: F.substring(data, a, n if n is not None else 1 << 30)
    return F.concat(part(1, 24), zero(12), part(37, 48), zero(16), part(101))
