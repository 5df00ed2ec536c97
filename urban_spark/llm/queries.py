"""The operators applied to the whole tables of a folder, by query name."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urban_spark.llm import decontam, jaccard, langid, lines, mixing, packing, phrases, pii, quality, rules, tokens, variants, warc
from urban_spark.llm.shared import load, shared_dir


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(load(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), segment=1 << 23, cache=200_000)  # alone in its workers, unlike in the pipeline


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data_digest(load(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(pages, path)
    kind = pages.schema["page_id"].dataType
    records = warc.read_warc(spark, path).where("kind = 'record'")
    return records.select(warc.page_id("record_id", kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_id("refers_to", kind).alias("refers_to"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.line_dedup(load(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_kept_chars"), F.md5("text").alias("kept_md5"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(load(spark, sf_dir, "documents")).drop("quality")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op5_benchmark_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.near_items(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").withColumn("held_out", langid.held_out("doc_id"))
    model = langid.train(docs.where(~F.col("held_out") & F.col("doc_id").isNotNull()))
    found = langid.identify(docs.select("doc_id", "held_out", "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", langid.held_out("doc_id"))
    labels = load(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~langid.held_out("doc_id")))
    return quality.score_quality(docs, model).select("doc_id", "held_out", "score", "predicted")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(load(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(load(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_groups(variants.word_counts(load(spark, sf_dir, "documents"), drop_every=199))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(load(spark, sf_dir, "documents"))


_ALL = (op1_line_dedup, op2_token_counts, op3_best_fit_packing, op4_quality_rules, op5_benchmark_decontamination, op5_benchmark_proximity, op6_language_id, op7_quality_classifier, op8_ngram_jaccard_join, op9_pii, op10_warc, op11_phrase_collocations, op12_spelling_variants, op13_source_mix)
QUERIES = {f.__name__: f for f in _ALL}
#: DuckDB SQL by query name, where SQL can express the query.
SQL: dict[str, str] = {"op1_line_dedup": lines.SQL, "op4_quality_rules": rules.sql(), "op5_benchmark_decontamination": decontam.SQL, "op11_phrase_collocations": phrases.SQL, "op13_source_mix": mixing.SQL}
