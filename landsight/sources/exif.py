"""Capture times noted inside JPEG files: the original time, else the file's."""

from __future__ import annotations

import datetime as dt
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tags and types of the EXIF standard.
FILE_TIME, ORIGINAL_TIME, EXIF_FOLDER = 306, 36867, 34665
TEXT, LONG = 2, 4


def _tiff(content: bytes) -> bytes:
    """The TIFF structure in a JPEG's EXIF segment; empty without one."""
    at = 2
    while content[:2] == b"\xff\xd8" and at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] != 0xDA:
        size = int.from_bytes(content[at + 2 : at + 4], "big")
        if content[at + 1] == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
            return content[at + 10 : at + 2 + size]
        at += 2 + max(2, size)
    return b""


def _folder(tiff: bytes, order: str, at: int) -> dict[int, bytes | int]:
    """Texts and numbers of one directory of tags."""
    out: dict[int, bytes | int] = {}
    for k in range(struct.unpack_from(order + "H", tiff, at)[0]):
        tag, kind, n, value = struct.unpack_from(order + "HHII", tiff, at + 2 + 12 * k)
        if kind == TEXT:
            start = value if n > 4 else at + 10 + 12 * k
            out[tag] = tiff[start : start + n]
        elif kind == LONG:
            out[tag] = value
    return out


def taken_at(content: bytes | None) -> dt.datetime | None:
    """When a picture was taken; None if that is not noted or cannot be read."""
    try:
        tiff = _tiff(content or b"")
        order = {b"II": "<", b"MM": ">"}[tiff[:2]]
        first = _folder(tiff, order, struct.unpack_from(order + "I", tiff, 4)[0])
        inner = _folder(tiff, order, first[EXIF_FOLDER]) if EXIF_FOLDER in first else {}
        said = inner.get(ORIGINAL_TIME) or first.get(FILE_TIME) or b""
        return dt.datetime.strptime(said.rstrip(b"\0 ").decode("ascii"), "%Y:%m:%d %H:%M:%S")
    except (KeyError, ValueError, struct.error, AttributeError, TypeError):
        return None


@F.pandas_udf(T.StringType())
def _noted(contents: pd.Series) -> pd.Series:
    return contents.map(lambda x: t.isoformat(" ") if (t := taken_at(x)) else None)


def exif_time(content: Column) -> Column:
    """Capture time of a JPEG's bytes; NULL without one."""
    return F.try_to_timestamp(_noted(content), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
