"""Registration of queries, and the tables that stand in for wards, panels and facilities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Ward by customer key, month of the order, in whole cents so that sums are exact.
PANEL = """panel AS (
  SELECT o_custkey % 198 AS ward, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS demand, count(*) AS n
  FROM orders GROUP BY 1, 2)"""
#: Wards are nations, sectors are regions; places follow from the key.
WARDS = """wards AS (
  SELECT n_nationkey AS ward, n_name AS name, n_regionkey AS sector, 77.45 + ((n_nationkey * 37) % 100) / 333.0::DOUBLE AS lon, 12.80 + ((n_nationkey * 61) % 100) / 333.0::DOUBLE AS lat FROM nation)"""
SITES = """sites AS (
  SELECT s_suppkey AS site, s_nationkey AS ward, s_acctbal AS capacity, 77.45 + ((s_suppkey * 53) % 1000) / 3330.0::DOUBLE AS lon, 12.80 + ((s_suppkey * 29) % 1000) / 3330.0::DOUBLE AS lat FROM supplier)"""
HOMES = """homes AS (
  SELECT c_custkey AS home, c_nationkey AS ward, c_acctbal AS income, 77.45 + ((c_custkey * 71) % 3000) / 9990.0::DOUBLE AS lon, 12.80 + ((c_custkey * 43) % 3000) / 9990.0::DOUBLE AS lat FROM customer)"""
HOURLY = """hourly AS (
  SELECT user_id AS station, date_trunc('hour', ts) AS hour, CAST(sum(CAST(value AS DECIMAL(14,4))) AS DOUBLE) AS total, count(*) AS n FROM events GROUP BY 1, 2)"""


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


class Tables:
    """The driver's tables and the views made from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def panel(self) -> DataFrame:
        return (
            self.orders.groupBy((F.col("o_custkey") % 198).alias("ward"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("month"))
            .agg(F.sum(F.col("o_totalprice").cast("decimal(14,2)")).cast("double").alias("demand"), F.count(F.lit(1)).alias("n"))
        )

    @property
    def wards(self) -> DataFrame:
        k = F.col("n_nationkey")
        return self.nation.select(k.alias("ward"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("sector"), (77.45 + (k * 37 % 100) / 333.0).alias("lon"), (12.80 + (k * 61 % 100) / 333.0).alias("lat"))

    @property
    def sites(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.supplier.select(k.alias("site"), F.col("s_nationkey").alias("ward"), F.col("s_acctbal").alias("capacity"), (77.45 + (k * 53 % 1000) / 3330.0).alias("lon"), (12.80 + (k * 29 % 1000) / 3330.0).alias("lat"))

    @property
    def homes(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.customer.select(k.alias("home"), F.col("c_nationkey").alias("ward"), F.col("c_acctbal").alias("income"), (77.45 + (k * 71 % 3000) / 9990.0).alias("lon"), (12.80 + (k * 43 % 3000) / 9990.0).alias("lat"))

    @property
    def hourly(self) -> DataFrame:
        return (
            self.events.groupBy(F.col("user_id").alias("station"), F.date_trunc("hour", "ts").alias("hour"))
            .agg(F.sum(F.col("value").cast("decimal(14,4)")).cast("double").alias("total"), F.count(F.lit(1)).alias("n"))
        )


def tabled(f: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(Tables(spark, sf_dir))


def rounded(df: DataFrame, *columns: str, digits: int = 3) -> DataFrame:
    """Columns rounded, negative zero made zero."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})
