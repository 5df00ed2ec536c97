import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def table(spark, tmp_path):
    rnd = random.Random(8)
    say = lambda lang, n: " ".join("".join(rnd.choice(s) for _ in range(rnd.randint(1, 3))) + str() for s in [{"en": ["the", "ing", "and", "wh"], "fr": ["eau", "que", "é", "oi"]}[lang]] for _ in range(n))
    rows = [(i, say("en" if i % 2 else "fr", 60), "en" if i % 2 else "fr", f"s{i % 15}") for i in range(60)]
    boiler = "please read the cookie notice now"
    rows = [(i, f"{t}\n{boiler}", lang, s) for i, t, lang, s in rows]
    passage = say("en", 14)
    rows += [(100, rows[3][1].split("\n")[0] + " extra", "en", "s3"), (101, rows[3][1], "en", "s4"), (102, "123 456 !!", "en", "s1"), (103, None, "en", "s1"), (104, say("en", 20) + " " + passage, "en", "s2"), (105, boiler, "en", "s5")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_in_turn(spark, tmp_path):
    sf_dir = table(spark, tmp_path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{sf_dir}/{name}")
        docs = spark.read.parquet(f"{sf_dir}/{name}")
        if k < 4:
            assert docs.columns == columns
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    languages, lines, copies, clean, packed = ids
    assert languages == {*range(60), 100, 101, 104, 105}
    assert lines == languages - {105}
    assert copies == lines - {100, 101}
    assert clean == copies - {104} and packed == clean
    texts = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/line_dedup").collect()}
    assert "cookie" in texts[0].text and "cookie" not in texts[1].text and texts[1].n_chars == len(texts[1].text)
    run = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in run.collect()} == packed and [n for n, _ in corpus_pipeline.STAGES][0] == "language_id"


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


CLASHES = ("_hash", "_first", "_gone", "_bad", "_text_hash", "n_lines", "n_removed", "score", "lang_pred", "lang_set", "_row", "_id", "_lang_pred", "node", "a.b")


def test_columns_of_any_name_stay(spark, tmp_path):
    sf_dir = table(spark, tmp_path)
    plain = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = plain.select("*", *(F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in CLASHES))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want = {(r.doc_id, r.text) for r in stage(spark, plain, sf_dir).collect()}
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        rows = out.collect()
        assert {(r.doc_id, r.text) for r in rows} == want and len(rows) == len(want), name
        assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in CLASHES)
    assert corpus_pipeline.best_fit_packing(spark, docs, sf_dir).count() == docs.count()


def test_near_copies_with_null_and_shared_ids(spark):
    t, u, v = (" ".join(f"{w}{i}" for i in range(20)) for w in "tuv")
    kept = lambda rows: sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()), key=str)
    assert kept([(None, t), (5, t), (None, u)]) == sorted([(5, t), (None, u)], key=str)
    assert kept([(1, t), (1, u), (1, t), (2, u), (2, v)]) == sorted([(1, t), (1, u), (2, v)], key=str)
    assert kept([(None, t), (None, t), (7, None), (7, None), (8, "")]) == sorted([(None, t), (7, None), (7, None), (8, "")], key=str)


def test_shared_ids_in_decontamination(spark, tmp_path):
    spark.createDataFrame([(1, "one two three four five")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, "a one two three four five b"), (1, "clean"), (None, "one two three four five"), (None, None)], "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()} == {(1, "clean"), (None, None)}


def test_mixed_languages_stay(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    words = {"en": "the quick brown fox jumps over", "de": "der schnelle braune fuchs springt über", "fr": "le renard brun rapide saute par-dessus", "es": "el zorro marrón rápido salta sobre"}
    rows = [(i, f"{words[k]} " * 9, k) for i, k in enumerate([*words] * 3)] + [(50, " ".join(f"{w} " * 9 for w in words.values()), None)]
    out = corpus_pipeline.language_id(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), str(tmp_path))
    assert {r.doc_id for r in out.collect()} == {r[0] for r in rows}
