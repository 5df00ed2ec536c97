"""Tabular and geographic formats read and written by Spark, in any file system it knows."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urban_spark.operators.graph import checkpointed

SUFFIXES = {".parquet": "parquet", ".ndjson": "json", ".jsonl": "json", ".json": "json", ".csv": "csv", ".geojson": "geojson", ".kml": "kml"}
POINT_LINES = "array<array<double>>"


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All columns as text. A path without files gives an empty table with `columns`, if these are given."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    except AnalysisException:
        if columns is None:
            raise
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))


def read_table(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """By the suffix: Parquet, JSON lines, CSV as text, GeoJSON, KML placemarks."""
    kind = format or next((v for k, v in SUFFIXES.items() if path.rstrip("/").lower().endswith(k)), "parquet")
    if kind == "geojson":
        return read_geojson(spark, path)
    if kind == "kml":
        return read_kml(spark, path)
    return read_csv(spark, path) if kind == "csv" else spark.read.format(kind).load(path)


def _vertex(v: Column) -> Column:
    return F.struct(v[0].alias("x"), v[1].alias("y"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(type, rings, properties map, srid) for each feature: rings are arrays of vertices without heights; a point is one ring of
    one vertex, a line one ring, parts of multi-geometries are flattened to rings. Features without geometry have null rings."""
    schema = "features array<struct<geometry: struct<type: string, coordinates: string>, properties: map<string, string>>>"
    rows = spark.read.json(path, schema=schema, multiLine=True).select(F.explode("features").alias("f"))
    c, kind = F.col("f.geometry.coordinates"), F.col("f.geometry.type")
    rings = (
        F.when(kind == "Point", F.array(F.array(F.from_json(c, "array<double>"))))
        .when(kind.isin("LineString", "MultiPoint"), F.array(F.from_json(c, "array<array<double>>")))
        .when(kind.isin("Polygon", "MultiLineString"), F.from_json(c, "array<array<array<double>>>"))
        .when(kind == "MultiPolygon", F.flatten(F.from_json(c, "array<array<array<array<double>>>>")))
    )
    return rows.select(kind.alias("type"), F.transform(rings, lambda r: F.transform(r, _vertex)).alias("rings"), F.col("f.properties").alias("properties"), F.lit(4326).alias("srid"))


def placemarks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?is)<Placemark\b[^>]*>(.*?)</Placemark>"), F.lit(1))


def _tag(text: Column, tag: str) -> Column:
    raw = F.regexp_extract(text, rf"(?is)<{tag}\b[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{tag}>", 1)
    return F.nullif(F.trim(F.regexp_replace(raw, "<[^>]*>", "")), F.lit(""))


def _line(coordinates: Column) -> Column:
    """Vertices of `lon,lat[,z] ...`; what isn't a pair of numbers goes."""
    pairs = F.transform(F.split(F.trim(coordinates), r"\s+"), lambda p: F.split(p, ","))
    points = F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(0)).try_cast("double").alias("x"), F.get(p, F.lit(1)).try_cast("double").alias("y")))
    return F.filter(points, lambda v: v["x"].isNotNull() & v["y"].isNotNull())


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """(name, description, type, rings) for each placemark with coordinates; type is Point, LineString or Polygon, each line or
    ring of it an entry of rings. Placemarks without a usable coordinate go."""
    return parse_kml(spark.read.text(path, wholetext=True), "value")


def parse_kml(df: DataFrame, column: str) -> DataFrame:
    rows = df.select(F.explode(placemarks(F.col(column))).alias("p"))
    kind = F.when(F.col("p").rlike("(?i)<Polygon"), "Polygon").when(F.col("p").rlike("(?i)<LineString"), "LineString").otherwise("Point")
    lines = F.transform(F.regexp_extract_all("p", F.lit(r"(?is)<coordinates[^>]*>(.*?)</coordinates>"), F.lit(1)), _line)
    out = rows.select(_tag(F.col("p"), "name").alias("name"), _tag(F.col("p"), "description").alias("description"), kind.alias("type"), F.filter(lines, lambda x: F.size(x) > 0).alias("rings"))
    return out.where(F.size("rings") > 0)


def kml_points(df: DataFrame) -> DataFrame:
    first = F.col("rings")[0][0]
    return df.where("type = 'Point'").select("name", first["x"].alias("lon"), first["y"].alias("lat"))


def kml_lines(df: DataFrame) -> DataFrame:
    """A row for each line of two vertices or more."""
    return df.where("type = 'LineString'").select("name", "description", F.explode("rings").alias("line")).where(F.size("line") > 1)


def union_layers(layers: list[DataFrame]) -> DataFrame:
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), layers)


def write_table(df: DataFrame, path: str, mode: str = "error") -> None:
    if path.rstrip("/").lower().endswith(".csv"):
        df.write.mode(mode).csv(path, header=True, escape='"')
    else:
        df.write.mode(mode).parquet(path)


def append_chunks(df: DataFrame, path: str, rows: int = 50_000) -> None:
    df.write.option("maxRecordsPerFile", rows).mode("append").parquet(path)


def write_by_ward(df: DataFrame, path: str, key: str = "ward") -> None:
    df.write.partitionBy(key).mode("overwrite").parquet(path)


def feature_json(df: DataFrame, geometry: str, kind: str) -> DataFrame:
    """A line of GeoJSON for each row: one geometry, all other columns as properties, NaN as null."""
    other = [F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes if c != geometry]
    pair = lambda v: F.array(v["x"], v["y"])
    shape = {"Point": lambda g: pair(g[0][0]), "LineString": lambda g: F.transform(g[0], pair), "Polygon": lambda g: F.transform(g, lambda r: F.transform(F.concat(r, F.slice(r, 1, 1)), pair))}[kind]
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("type"), shape(F.col(geometry)).alias("coordinates")).alias("geometry"), F.struct(*other).alias("properties"))
    return df.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def write_geojson(df: DataFrame, path: str, geometry: str, kind: str) -> None:
    feature_json(df, geometry, kind).write.text(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(ward_id, target, model, mae, rmse, mape) of a folder of metric documents; a missing target is taken from the file's name."""
    schema = "ward_id string, target string, model string, backtest struct<metrics: struct<mae: double, rmse: double, mape: double>>"
    rows = spark.read.json(path, schema=schema, multiLine=True).withColumn("_file", F.input_file_name())
    named = F.nullif(F.regexp_extract("_file", r"([a-z0-9]+(?:_[a-z]+)?)_backtest_metrics\.json$", 1), F.lit(""))
    return rows.select("ward_id", F.coalesce("target", named).alias("target"), "model", "backtest.metrics.*")


def read_keyed_csvs(spark: SparkSession, pattern: str, key: str = "target") -> DataFrame:
    """All CSV files (or folders of parts) of a pattern, the name of each without its suffix as the column `key`."""
    return read_csv(spark, pattern).withColumn(key, F.regexp_extract(F.input_file_name(), r"([^/]+?)\.csv(?:/[^/]+)?$", 1))


def fingerprints(spark: SparkSession, path: str, *, block: int = 256 << 20) -> DataFrame:
    """(name, bytes, sha256) of each file; Spark lists no empty ones.

    A digest is one pass over the file in order, so files are read in rounds: a task reads `block` bytes at most, and OpenSSL's state of each
    unfinished digest goes on to the next round. In stores that only Spark reads, or without that state, a file is read whole, up to 2 GB.
    """
    import ctypes

    def openssl():
        import _hashlib

        lib = ctypes.CDLL(_hashlib.__file__)
        lib.SHA256_Update.argtypes = (ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t)
        return lib, lib.SHA256_Init, lib.SHA256_Final

    def opened(name: str):
        from pyarrow import fs

        if re.match("file:/|/", name):
            return fs.LocalFileSystem().open_input_file("/" + re.sub("^file:", "", name).lstrip("/"))
        store, inner = fs.FileSystem.from_uri(name)
        return store.open_input_file(inner)

    def read_on(batches):
        (lib, init, final), left = openssl(), block
        for batch in batches:
            out = []
            for name, size, at, state, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if digest is None and (left or at == size):
                    context = ctypes.create_string_buffer(state or b"", 128)  # SHA256_CTX has 112 bytes
                    if state is None:
                        init(context)
                    with opened(name) as file:
                        file.seek(at)
                        while left and at < size:
                            chunk = file.read(min(left, size - at, 4 << 20))
                            if not chunk:
                                raise OSError(f"{name} ends at {at} of {size} bytes")
                            lib.SHA256_Update(context, chunk, len(chunk))
                            at, left = at + len(chunk), left - len(chunk)
                    state = context.raw
                    if at == size:
                        found = ctypes.create_string_buffer(32)
                        final(found, context)
                        state, digest = None, found.raw.hex()
                out.append((name, size, at, state, digest))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), batch.schema.types, strict=True)], names=batch.schema.names) if out else batch

    files = spark.read.format("binaryFile").load(path)
    some = files.select("path").first()
    try:
        openssl()
        if some is not None:
            opened(some["path"]).close()
    except (pa.ArrowInvalid, NotImplementedError, OSError, ImportError, AttributeError):
        return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    read = files.select("path", "length", F.lit(0).cast("long").alias("at"), F.lit(None).cast("binary").alias("state"), F.lit(None).cast("string").alias("sha256"))
    read = read.repartitionByRange(min(20_000, max(1, read.count())), "path")
    while True:
        read = checkpointed(read.mapInArrow(read_on, read.schema))  # a file stays in a partition of its own
        if read.where("sha256 IS NULL").isEmpty():
            return read.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), "sha256")


def combined_fingerprint(files: DataFrame) -> DataFrame:
    """One digest that the order of the files doesn't change."""
    return files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ","), 256).alias("combined"), F.count(F.lit(1)).alias("files"))


def nested_documents(wards: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, document): a JSON document for each ward with its rows of each part as a list."""
    out = wards
    for name, df in parts.items():
        rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != key]))).alias(name))
        out = out.join(rows, key, "left")
    return out.select(key, F.to_json(F.struct(*out.columns)).alias("document"))
