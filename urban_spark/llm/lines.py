"""Removal of lines that many sites share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urban_spark.llm.shared import cut, free, let, small


def _kept(text: Column, gone: Column) -> Column:
    """`text` without the lines at the positions `gone`; whole where gone is null."""
    lines = F.split(text, "\n", -1)
    rest = let(lines, lambda line: F.transform(F.array_except(F.sequence(F.lit(0), F.size(line) - 1), gone), lambda i: F.get(line, i)))
    return F.when(gone.isNull(), text).otherwise(F.array_join(rest, "\n"))


def line_dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 10, min_words: int = 3, lg_k: int = 12,
    lines_col: str = "n_lines", removed_col: str = "n_removed",
) -> DataFrame:
    """`docs` without cross-site boilerplate, plus n_lines (lines before) and n_removed, named `lines_col` and `removed_col`.

    A line is boilerplate if, without outer blanks, it has `min_words` words and stands on `min_sites` sites or more;
    of all its places the first (smallest id, then position) stays. Sites are counted by a HyperLogLog sketch for each
    line hash, merged by partial aggregation; lines whose estimate is within five standard errors (one site at least)
    of the threshold are counted exactly.

    Null text: stays null, no lines. Empty text: one line, which stays. Null sites count for nothing; null ids come
    first. Rows that repeat an id and its text share one fate. No rows: no rows. Extra columns stay as they are,
    whatever their names; a column of the input that is named as one of the two added ones is replaced.
    """
    margin = max(5 * 1.04 / 2 ** (lg_k / 2), 1 / min_sites)
    words = r"[^ \t\r]+" + r"[ \t\r]+[^ \t\r]+" * (min_words - 1)
    text_hash, gone_id, gone_hash, at = free(docs.columns, "text_hash", "gone_id", "gone_hash", "gone")
    base = docs.withColumn(text_hash, F.xxhash64(text_col))
    places = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text_hash"), F.col(site_col).alias("_site"), F.posexplode(F.split(text_col, "\n", -1)).alias("_pos", "_line"))
    line = F.trim(F.col("_line"), F.lit(" \t\r"))
    keyed = places.where(F.col("_line").rlike(words)).select("_id", "_text_hash", "_site", "_pos", F.xxhash64(line).alias("_k1"), F.crc32(line.cast("binary")).alias("_k2"))

    spread = keyed.groupBy("_k1", "_k2").agg(
        F.hll_sketch_agg("_site", lg_k).alias("_sites"), F.count(F.lit(1)).alias("_places"), F.min(F.struct("_id", "_text_hash", "_pos")).alias("_first")
    )
    estimate = F.hll_sketch_estimate("_sites")
    likely = cut(
        spread.where(F.col("_places") >= min_sites)
        .where(estimate >= min_sites * (1 - margin))
        .select("_k1", "_k2", "_first", (estimate > min_sites * (1 + margin)).alias("_sure"))
    )
    found = cut(keyed.join(small(likely), ["_k1", "_k2"]))
    near = found.where(~F.col("_sure")).groupBy("_k1", "_k2").agg(F.count_distinct("_site").alias("_exact")).where(F.col("_exact") >= min_sites)
    common = found.where("_sure").unionByName(found.where(~F.col("_sure")).join(near.select("_k1", "_k2"), ["_k1", "_k2"], "left_semi"))
    here = F.struct("_id", "_text_hash", "_pos")
    gone = common.where(~here.eqNullSafe(F.col("_first"))).groupBy(F.col("_id").alias(gone_id), F.col("_text_hash").alias(gone_hash)).agg(F.collect_set("_pos").alias(at))
    # Few documents have such lines as a rule; then the others are not shuffled to meet them.
    gone = small(cut(gone), weight=F.size(at))
    joined = base.join(gone, F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.col(text_hash) == F.col(gone_hash)), "left")
    lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(F.split(text_col, "\n", -1))).cast("long")
    removed = F.when(F.col(at).isNull(), 0).otherwise(F.size(at)).cast("long")
    rest = [c for c in docs.columns if c.lower() not in (lines_col.lower(), removed_col.lower())]
    return joined.select(*(_kept(F.col(text_col), F.col(at)).alias(c) if c == text_col else F.col(f"`{c}`") for c in rest), lines.alias(lines_col), removed.alias(removed_col))


SQL = r"""
WITH places AS (
  SELECT doc_id, text, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS k FROM places WHERE regexp_matches(line, '[^ \t\r]+[ \t\r]+[^ \t\r]+[ \t\r]+[^ \t\r]+')
), common AS (
  SELECT k, min({'d': doc_id, 'p': pos}) AS first FROM keyed GROUP BY k HAVING count(DISTINCT source) >= 10
), gone AS (
  SELECT DISTINCT doc_id, pos FROM keyed JOIN common USING (k) WHERE {'d': doc_id, 'p': pos} <> first
), kept AS (
  SELECT p.doc_id, string_agg(line, chr(10) ORDER BY p.pos) AS text FROM places p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.pos = g.pos GROUP BY p.doc_id
)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, coalesce(g.n, 0) AS n_removed,
  CAST(length(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END) AS BIGINT) AS n_kept_chars,
  md5(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END) AS kept_md5
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)
"""
