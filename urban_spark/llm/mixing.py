"""Mixing of sources to target weights: whole epochs first, then a weighted sample of documents without replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urban_spark.llm.shared import cut, small, written

WORD = r"[^\x20\x09-\x0D]+"
#: Steps of the logarithm of a key by which the place of a source's budget is narrowed down, before its rows are sorted.
GRAINS = (16, 1 << 16)
LEAST_WEIGHT = 0.05


def quality_weight(text: Column, size: Column) -> Column:
    """Runs of two letters or more for each of the `size` words, within LEAST_WEIGHT and 1; LEAST_WEIGHT without words."""
    letters = F.regexp_count(text, F.lit(r"\p{L}{2,}")).cast("double")
    return F.coalesce(F.when(size > 0, F.least(F.greatest(letters / size, F.lit(LEAST_WEIGHT)), F.lit(1.0))), F.lit(LEAST_WEIGHT))


def _key(name: Column, text: Column, source: Column, weight: Column) -> Column:
    """Exponential variable at the rate `weight`, from a hash of the document; the smallest keys are a weighted sample."""
    part = lambda c: F.coalesce(c, F.lit(""))
    digest = F.md5(F.concat(part(name.cast("string")), F.lit(":"), part(F.md5(text)), F.lit(":"), part(source)))
    even = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.ln(even) / weight


def _ranked(sources: DataFrame) -> DataFrame:
    """`sources` (source, source_size) with their place `at` by code point, null last, from 0: within ranges, and over the ranges' counts."""
    order = [F.col("source").isNull(), F.col("source")]
    ranged = cut(sources.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    counts = ranged.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("at", inside).join(F.broadcast(counts), "_part").select("source", "source_size", (F.col("at") - 1 + F.col("_before")).alias("at"))


def targets(sources: DataFrame, weights: Sequence[int], *, share: float = 1.0, most_epochs: int = 3) -> DataFrame:
    """`sources` (source, source_size) with the `target` of each: `share` of all sizes by `weights`, which repeat along the sources in
    code-point order, null last. What passes `most_epochs` times a source's size goes to the others by weight, until none is above."""
    if not weights or min(weights) <= 0 or share < 0 or share > most_epochs:
        raise ValueError("weights must be positive, and the share at most the epochs")
    weight = F.element_at(F.array(*[F.lit(w).cast("double") for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    held = cut(_ranked(sources).withColumn("_w", weight).withColumn("_most", (F.col("source_size") * most_epochs).cast("double")))
    total = held.agg(F.sum("source_size")).first()[0] or 0
    left, rate, over = total * share, None, F.lit(False)
    while True:  # a one-row sum a round; each round holds back a source more at least
        full, free = held.agg(F.sum(F.when(over, F.col("_most"))), F.sum(F.when(~over, F.col("_w")))).first()
        left = total * share - (full or 0.0)
        now = F.col("_most") * F.lit(free or 1.0) < F.lit(left) * F.col("_w")
        if free is None or held.where(now & ~over).isEmpty():
            rate = F.lit(left) * F.col("_w") / F.lit(free or 1.0)
            return held.select("source", "source_size", F.when(over, F.col("_most")).otherwise(rate).alias("target"))
        over = over | now


def _place(grain: int) -> Column:
    """Number of the range of keys that a key falls into."""
    return F.floor(F.ln(F.greatest("key", F.lit(1e-300))) * grain)


def _last_taken(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(_source, range, last) for each source with a budget, when rows are taken in the order of their keys up to the row that brings the sum
    nearest to the budget: all rows of lower ranges (by the last of GRAINS) are, and of this one those up to `last` (key, row), none where
    that is null. The range is found by sums over ever finer ones, so that only the rows of a fine range are sorted."""
    around = budgets.where("budget > 0").select(F.col("source").alias("_source"), "budget", F.lit(0.0).alias("before"), F.lit(None).cast("long").alias("range"))
    grain = None
    upto = Window.partitionBy("_source").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    here = lambda: rows.join(small(around), F.col("source").eqNullSafe(F.col("_source")) & (F.lit(True) if grain is None else _place(grain) == F.col("range")))
    for finer in GRAINS:
        sums = here().groupBy("_source", "budget", "before", _place(finer).alias("at")).agg(F.sum("size").alias("_sum"))
        sums = sums.withColumn("_upto", F.col("before") + F.sum("_sum").over(upto)).where(F.col("_upto") >= F.col("budget"))
        first = sums.groupBy("_source", "budget").agg(F.min_by(F.struct("at", (F.col("_upto") - F.col("_sum")).alias("before")), "at").alias("x"))
        around, grain = cut(first.select("_source", "budget", "x.before", F.col("x.at").alias("range"))), finer
    order = Window.partitionBy("_source").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, -1)
    sorted_ = here().withColumn("_ahead", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    taken = sorted_.where(F.col("_ahead") + F.col("size") / 2 < F.col("budget")).groupBy(F.col("_source").alias("_taken")).agg(F.max(F.struct("key", "row")).alias("last"))
    return around.join(taken, F.col("_source").eqNullSafe(F.col("_taken")), "left").select("_source", "range", "last")


def mix_sources(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (5, 2, 1), share: float = 1.0,
    most_epochs: int = 3, quality: Column | None = None,
) -> DataFrame:
    """(id, size, source_size, target, taken) for each row of `docs`: sizes are words, taken the words that the mix takes of a row.

    Targets by targets(). A source gives whole epochs as long as they fit; the rest of its target is filled by documents in the
    order of exponential keys at the rate of their `quality` (a positive column of `docs`; quality_weight() of the text
    without one), up to the document that brings the sum nearest to the target. So documents are taken whole, and
    `most_epochs` times at most. Keys come from a hash of id, text and source: reruns agree.

    Null text: size 0, nothing taken. Null source: a source of its own, the last. Null or repeated ids, and repeated rows: a row
    each; of equal rows some can be taken once more than others. No rows: no rows. Extra columns are not read.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    text, source = F.col(text_col), F.col(source_col).cast("string")
    weight = quality_weight(text, size) if quality is None else quality.cast("double")
    sized = docs.select(F.col(id_col).alias("id"), source.alias("source"), size.alias("size"), _key(F.col(id_col), text, source, weight).alias("key"))
    rows = written(sized.withColumn("row", F.monotonically_increasing_id()), "mix-rows")
    if not rows.where("key IS NULL OR isnan(key) OR key < 0").isEmpty():
        raise ValueError("qualities must be positive")
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share=share, most_epochs=most_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = cut(goals.withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")))
    last = _last_taken(rows, goals)
    plan = goals.join(last, F.col("source").eqNullSafe(F.col("_source")), "left").select(F.col("source").alias("_of"), "source_size", "target", "epochs", "range", "last")
    place = _place(GRAINS[-1])
    once_more = F.coalesce((place < F.col("range")) | ((place == F.col("range")) & (F.struct("key", "row") <= F.col("last"))), F.lit(False)).cast("long")
    joined = rows.join(small(cut(plan)), F.col("source").eqNullSafe(F.col("_of")))
    return joined.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * (F.col("epochs") + once_more)).alias("taken"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, text, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST(coalesce(len(regexp_extract_all(text, '\p{L}{2,}')), 0) AS DOUBLE) AS letters,
    (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '') || ':' || coalesce(source, '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS even
  FROM documents
), keyed AS (
  SELECT *, -ln(even) / coalesce(CASE WHEN size > 0 THEN least(greatest(letters / size, 0.05::DOUBLE), 1.0::DOUBLE) END, 0.05::DOUBLE) AS key FROM sized
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM sources
), filled AS (
  SELECT *, coalesce(sum(3 * source_size) OVER s, 0) AS full_before, coalesce(sum(w) OVER s, 0) AS w_before, (SELECT sum(source_size) FROM sources) AS total, sum(w) OVER () AS all_w
  FROM weighed WINDOW s AS (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT min_by({'rest': total - full_before, 'free': all_w - w_before}, w_before) AS x FROM filled WHERE 3::HUGEINT * source_size * (all_w - w_before) >= (total - full_before) * w
), goals AS (
  SELECT source, source_size, CASE WHEN 3::HUGEINT * source_size * x.free < x.rest * w THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(x.rest AS DOUBLE) * w / x.free END AS target FROM weighed, level
), epochs AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM goals
), dealt AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + k.size / 2.0 < e.target - e.epochs * e.source_size AS more
  FROM keyed k JOIN epochs e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CAST(more AS BIGINT)) AS BIGINT) AS taken FROM dealt
"""
