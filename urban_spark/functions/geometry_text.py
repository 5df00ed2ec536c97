"""Geometry given as WKT, WKB, GeoJSON text or coordinate lists."""

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VERTEX = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
SHAPE = T.StructType([T.StructField("type", T.StringType()), T.StructField("rings", T.ArrayType(T.ArrayType(_VERTEX)))])
#: Numbers of the types in WKB; fixed values.
WKB_TYPES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}


def _rings_of(data: bytes) -> tuple[str, list] | None:
    """Type and rings of a WKB geometry of either byte order, with or without heights, measures and a reference system; null
    for what isn't one."""

    def read(at: int) -> tuple[str, list, int]:
        sign = "<" if data[at] else ">"
        (code,) = struct.unpack_from(f"{sign}I", data, at + 1)
        at += 9 if code & 0x20000000 else 5
        base = (code & 0xFFFF) % 1000
        dims = 2 + (((code & 0xFFFF) // 1000) in (1, 2) or bool(code & 0xC0000000)) + (((code & 0xFFFF) // 1000) == 3 or code >> 30 == 3)

        def count() -> int:
            nonlocal at
            (n,) = struct.unpack_from(f"{sign}I", data, at)
            at += 4
            return n

        def line(n: int) -> list:
            nonlocal at
            values = struct.unpack_from(f"{sign}{n * dims}d", data, at)
            at += 8 * n * dims
            return [{"x": values[i], "y": values[i + 1]} for i in range(0, len(values), dims)]

        if base == 1:
            return "Point", [line(1)], at
        if base == 2:
            return "LineString", [line(count())], at
        if base == 3:
            return "Polygon", [line(count()) for _ in range(count())], at
        rings = []
        for _ in range(count()):
            _, part, at = read(at)
            rings += part
        return WKB_TYPES[base], rings, at

    try:
        kind, rings, _ = read(0)
        return kind, rings
    except (struct.error, IndexError, KeyError, RecursionError):
        return None


@F.pandas_udf(SHAPE)
def decode_wkb(geometry: pd.Series) -> pd.DataFrame:
    """struct(type, rings) of WKB or EWKB bytes; null type and rings for null and for anything else."""
    found = [None if g is None else _rings_of(bytes(g)) for g in geometry]
    return pd.DataFrame({"type": [f and f[0] for f in found], "rings": [f and f[1] for f in found]})


@F.pandas_udf(T.BinaryType())
def point_wkb(lon: pd.Series, lat: pd.Series) -> pd.Series:
    return pd.Series([struct.pack("<BIdd", 1, 1, x, y) for x, y in zip(lon, lat, strict=True)])


def decode(text: Column) -> Column:
    """struct(type, rings) of WKT or GeoJSON geometry text or a bare list of [lon, lat]; null for anything else. Heights go."""
    kind = F.coalesce(
        F.nullif(F.regexp_extract(text, r'"type"\s*:\s*"(\w+)"', 1), F.lit("")),
        F.when(text.rlike(r"^\s*\["), "LineString"),
        F.element_at(F.create_map(*(x for n in ("Point", "LineString", "Polygon", "MultiPolygon", "MultiLineString") for x in (F.lit(n.upper()), F.lit(n)))), F.upper(F.regexp_extract(text, r"^\s*(?:SRID=\d+;)?\s*(\w+)", 1))),
    )
    number = r"-?[0-9.]+(?:[eE][-+]?[0-9]+)?"
    wkt = F.regexp_extract_all(text, F.lit(rf"\(([^()]*[0-9][^()]*)\)"), F.lit(1))
    from_wkt = F.transform(wkt, lambda r: F.transform(F.split(r, ","), lambda p: F.split(F.trim(p), r"\s+")))
    pairs = F.regexp_replace(text, rf"\[\s*({number})\s*,\s*({number})(?:\s*,\s*{number})*\s*\]", "$1 $2;")
    json = F.transform(F.regexp_extract_all(pairs, F.lit(rf"((?:{number} {number};[,\s]*)+)"), F.lit(1)), lambda r: F.transform(F.filter(F.split(r, ";"), lambda p: F.trim(F.regexp_replace(p, ",", "")) != ""), lambda p: F.split(F.trim(F.regexp_replace(p, ",", "")), r"\s+")))
    rings = F.when(text.rlike(r"^\s*[\[{]"), json).otherwise(from_wkt)
    vertex = lambda p: F.struct(F.get(p, F.lit(0)).try_cast("double").alias("x"), F.get(p, F.lit(1)).try_cast("double").alias("y"))
    return F.when(kind.isNotNull() & (F.size(rings) > 0), F.struct(kind.alias("type"), F.transform(rings, lambda r: F.transform(r, vertex)).alias("rings")))


def short_line(lon: Column, lat: Column, offset: float) -> Column:
    """A line of two vertices that stands for a point."""
    return F.array(F.struct(lon.alias("x"), lat.alias("y")), F.struct((lon + offset).alias("x"), lat.alias("y")))
