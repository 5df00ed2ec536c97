"""A training corpus from raw documents: languages, boilerplate, near copies, benchmark passages, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urban_spark.llm import decontam, jaccard, langid, lines, packing
from urban_spark.llm.shared import free, load, written

#: Documents go whose chosen languages are less likely than this against the likeliest other one.
LEAST_CERTAINTY = 0.6


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in languages that the labelled ones have. Those without letters go (null and empty texts too), and those for
    which another language is nearly as likely as those found. A document in several languages stays: the largest share
    is no measure. Repeated rows: each. No rows, or none with a language: no rows. All columns stay, whatever their names."""
    pred, score, chosen = free(docs.columns, "lang_pred", "score", "lang_set")
    found = langid.identify(docs, langid.train(docs), pred_col=pred, score_col=score, set_col=chosen)
    certain = F.col(score) >= LEAST_CERTAINTY * F.element_at(chosen, F.col(pred))
    return found.where((F.col(pred) != "und") & certain).select(*(F.col(f"`{c}`") for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate, n_chars counted anew; those that were nothing else go. Null texts stay null;
    empty ones stay; long ones are taken whole. Rows that repeat an id and its text share one fate; null ids come first.
    No rows: no rows. All columns stay, whatever their names."""
    before, removed = free(docs.columns, "n_lines", "n_removed")
    cleaned = lines.line_dedup(docs, lines_col=before, removed_col=removed)
    emptied = (F.col(removed) > 0) & (F.trim(F.translate("text", "\n\t\r", "   ")) == "")
    kept = cleaned.where(~F.coalesce(emptied, F.lit(False)))
    return kept.select(*(F.length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that with the least id (none last); of rows that repeat an id and its text
    one. Null texts and those without a word stay. No rows: no rows. All columns stay, whatever their names."""
    return jaccard.without_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null texts and those without a word stay. Rows that share an id are
    judged each by its text. No rows: no rows. All columns stay, whatever their names."""
    return decontam.without_contaminated(docs, load(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The runs of tokens of the documents, and their places in sequences. Null and empty texts: one closing token. Long
    texts: several runs. Repeated rows and ids, null ids: runs of their own. No rows: no rows. Other columns go."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]
#: SQL has no form of the language model, the tokenizer or the hashing of the join.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn on `documents`, each but the last written to the shared folder and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
