"""Registered queries: name -> query(spark, sf_dir), and the DuckDB SQL with the same rows."""

from urban_spark.plans import ingest, models, networks, panels, relational, spatial
from urban_spark.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "panels", "relational", "spatial", "models", "networks", "ingest"]
