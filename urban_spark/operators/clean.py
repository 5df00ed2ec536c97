"""Ingest and cleaning: columns found by name, coerced, filled and classified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urban_spark.functions.text import by_keywords, to_number
from urban_spark.operators.sizes import small


def resolve_columns(df: DataFrame, spec: dict[str, list[str]]) -> DataFrame:
    """Columns renamed by keywords, each taken once, in the order of `spec`; what isn't found is added as null."""
    left, found = list(df.columns), []
    for name, keywords in spec.items():
        column = by_keywords(left, keywords)
        if column is not None:
            left.remove(column)
        found.append((F.col(column) if column is not None else F.lit(None)).alias(name))
    return df.select(*found)


def ward_key(columns: list[str], candidates: tuple[str, ...] = ("ward_id", "ward_no", "ward_num", "ward")) -> str:
    lower = {c.lower().replace(" ", "_"): c for c in columns}
    return next((lower[c] for c in candidates if c in lower), columns[0])


def with_columns_in_order(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in schema.items()))


def point_table(df: DataFrame, lon: list[str], lat: list[str]) -> DataFrame:
    """lon and lat from the first columns whose names hold a keyword; rows without both go."""
    a, b = by_keywords(df.columns, lon), by_keywords(df.columns, lat)
    if a is None or b is None:
        raise ValueError("no coordinate columns")
    return df.withColumns({"lon": to_number(F.col(a)), "lat": to_number(F.col(b))}).dropna(subset=["lon", "lat"])


def fill_ids(df: DataFrame, column: str, prefix: str, *, order: str, group: str) -> DataFrame:
    """Null or blank ids become prefix_group_n, numbered within each group so that no task sees all rows."""
    blank = F.coalesce(F.trim(column) == "", F.lit(True))
    number = F.row_number().over(Window.partitionBy(group, blank).orderBy(order))
    return df.withColumn(column, F.when(blank, F.concat(F.lit(f"{prefix}_"), F.col(group).cast("string"), F.lit("_"), number.cast("string"))).otherwise(F.col(column)))


def building_type(tags: Column, keys: list[str], rules: list[tuple[str, str]], other: str = "other") -> Column:
    """Class of the first tag present, by the first pattern that it matches."""
    value = F.lower(F.coalesce(*(tags[k] for k in keys)))
    out = F.when(value.isNull(), other)
    for pattern, name in rules:
        out = out.when(value.rlike(pattern), name)
    return out.otherwise(other)


def map_by_rules(df: DataFrame, rules: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Attributes from a rule table, broadcast if it is small, with defaults for keys that it lacks."""
    joined = df.join(small(rules), key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def fill_with_mean(df: DataFrame, column: str) -> DataFrame:
    mean = df.agg(F.avg(column).alias("_mean")).withColumn("_one", F.lit(1))
    joined = df.withColumn("_one", F.lit(1)).join(F.broadcast(mean), "_one")
    return joined.withColumn(column, F.coalesce(column, "_mean")).drop("_one", "_mean")


def clipped(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def grown(value: Column, rate: float, years: int) -> Column:
    return F.round(value * (1 + rate) ** years)


def parse_date(value: Column) -> Column:
    """Month of a date given as text or as epoch milliseconds."""
    text = value.cast("string")
    moment = F.when(text.rlike("^-?[0-9]{9,}$"), F.timestamp_millis(text.try_cast("bigint"))).otherwise(text.try_cast("timestamp"))
    return F.to_date(F.trunc(moment, "MM"))


def above_quantile(df: DataFrame, value: str, q: float, out: str) -> DataFrame:
    from urban_spark.operators.panel import exact_quantiles

    cut = exact_quantiles(df, {"_cut": (value, q)}).withColumn("_one", F.lit(1))
    joined = df.withColumn("_one", F.lit(1)).join(F.broadcast(cut), "_one")
    return joined.withColumn(out, (F.col(value) >= F.col("_cut")).cast("int")).drop("_one", "_cut")


def logged(value: Column) -> Column:
    return F.log1p(F.greatest(F.lit(0.0), value))


def hashed_sample(df: DataFrame, key: str, rows: int, seed: int = 42) -> DataFrame:
    """A fixed sample: the rows whose keys have the least hashes."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(rows)
