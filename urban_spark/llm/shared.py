"""What the text operators share: the shared folder, cut lineage and sizes that decide on a broadcast."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of a few narrow columns is broadcast; past it the join is a shuffle.
BROADCAST_ROWS = 400_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; where that is unset and all runs on this
    machine, one inside the warehouse."""
    set_here = spark.conf.get("spark.checkpoint.dir", None)
    if not set_here and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return set_here or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the shared folder, so that later stages and lost executors don't compute it again.

    Spark removes the files when the result is no longer referenced and the cluster cleans its checkpoints.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, label: str, *folders: str) -> DataFrame:
    """As cut(), as a compressed Parquet table: for tables with many rows, read several times and by column, or by the
    values of the columns `folders`, each of which is a folder."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*folders).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """`df`, hinted for a broadcast if it has at most `rows` rows, or if `weight` sums up to that at most, where rows hold
    arrays; `df` must be cheap to count (cut or written)."""
    count = df.limit(rows + 1).count()
    if weight is not None and 0 < count <= rows:
        count = df.agg(F.sum(weight)).first()[0]
    return F.broadcast(df) if count <= rows else df


def free(taken: Iterable[str], *names: str) -> list[str]:
    """Names like `names` that no column of `taken` has, in upper or lower case."""
    used = {c.lower() for c in taken}
    out = []
    for name in names:
        name = f"_{name}"
        while name.lower() in used:
            name = f"_{name}"
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """body(value) with `value` computed once a row, also where body uses it inside a lambda."""
    return F.transform(F.array(value), body).getItem(0)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the folder. Python workers also look for this package where the driver has it; a cluster whose
    machines don't have it there is given it with --py-files."""
    here, known = str(Path(__file__).parents[2]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if here not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (known, here)))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
