import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from urban_spark.llm import langid, queries

SYLLABLES = {"en": ["the", "ing", "and", "wh", "tion", "ed"], "fr": ["eau", "que", "ment", "é", "oi", "les"], "de": ["sch", "ung", "ein", "ü", "ch", "ver"]}


def say(lang, n, rnd):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def rows(count, seed):
    rnd = random.Random(seed)
    return [(i, say(lang, rnd.randint(3, 60), rnd), lang, 1) for i, lang in enumerate(rnd.choices([*SYLLABLES], k=count))]


SCHEMA = "doc_id long, text string, lang string, score int"


def test_held_out_accuracy_and_mixtures(spark):
    docs = spark.createDataFrame(rows(400, 1), SCHEMA).withColumn("held_out", langid.held_out("doc_id"))
    assert {(r.doc_id, r.held_out) for r in docs.collect()} == {(i, zlib.crc32(str(i).encode()) % 5 == 0) for i in range(400)}
    model = langid.train(docs.where("NOT held_out"))
    out = langid.identify(docs, model)
    assert sorted(out.columns) == sorted(["doc_id", "text", "lang", "held_out", "lang_pred", "score", "lang_set"])
    found = out.where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found) and all(0 <= r.score <= 1 for r in found)

    rnd = random.Random(9)
    mixed = [(1, say("en", 300, rnd) + " " + say("fr", 100, rnd)), (2, say("de", 300, rnd)), (3, (say("de", 20, rnd) + " ") * 800 + say("fr", 16_000, rnd))]
    sets = {r.doc_id: r.lang_set for r in langid.identify(spark.createDataFrame(mixed, "doc_id long, text string"), model).collect()}
    assert set(sets[1]) == {"en", "fr"} and abs(sets[1]["en"] - 0.7) < 0.15 and set(sets[2]) == {"de"} and set(sets[3]) == {"de", "fr"}


def test_nothing_to_read_or_learn(spark):
    odd = spark.createDataFrame([(1, None, "en", 0), (2, "", None, 0), (3, "12 34 !!", "en", 0), (None, "the ing", None, 0), (4, "the ing", "en", 0), (4, "the ing", "en", 0)], SCHEMA)
    model = langid.train(spark.createDataFrame(rows(50, 2), SCHEMA))
    out = sorted((r.doc_id or 0, r.lang_pred) for r in langid.identify(odd, model).collect())
    assert out == [(0, "en"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en")]
    none = langid.train(odd.where("lang IS NULL"))
    assert none[0] == [] and {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"}
    assert langid.identify(odd.limit(0), model).collect() == []
    assert odd.where(langid.held_out("doc_id") & F.col("doc_id").isNull()).count() == 0


def test_mixture_fits_what_it_was_given():
    random_ = np.random.default_rng(4)
    chances = random_.dirichlet(np.full(200, 0.1), 5)
    weights = random_.multinomial(20_000, 0.6 * chances[1] + 0.4 * chances[3]).astype(float)
    seen = weights > 0
    shares, alone = langid.mixture(weights[seen], np.maximum(chances[:, seen], 1e-9))
    assert set(shares) == {1, 3} and abs(shares[1] - 0.6) < 0.03 and len(alone) == 5


def plain_trigrams(text):
    """Buckets of a text's trigrams, one by one."""
    data = b" " + bytes(c if c > 127 or chr(c).isalpha() else 32 for c in text.lower().encode()) + b" "
    out = []
    for a, b, c in zip(data, data[1:], data[2:], strict=False):
        mixed = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % 2**32
        out.append(((mixed ^ (mixed >> 15)) * 0x27D4EB2F) % 2**32 >> 17)
    return out


def plain_answer(text, langs, chances):
    """Language and score of one text by the definition of the mixture, without arrays."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    grams = plain_trigrams(text)
    alone = [sum(math.log(chances[k][g]) for g in grams) for k in range(len(langs))]
    chosen, shares = [max(range(len(langs)), key=lambda k: (alone[k], -k))], [1.0]
    fit, price = max(alone), 4.0 * math.log(1 + len(grams))
    while len(chosen) < len(langs):
        best = None
        for new in range(len(langs)):
            if new in chosen or sum(chances[new][g] / sum(s * chances[c][g] for s, c in zip(shares, chosen, strict=True)) for g in grams) - len(grams) <= price:
                continue
            among, part = [*chosen, new], [*(0.7 * s for s in shares), 0.3]
            for _ in range(25):
                owed = [0.0] * len(among)
                for g in grams:
                    whole = sum(p * chances[c][g] for p, c in zip(part, among, strict=True))
                    owed = [o + p * chances[c][g] / whole for o, p, c in zip(owed, part, among, strict=True)]
                part = [o / len(grams) for o in owed]
            gained = sum(math.log(sum(p * chances[c][g] for p, c in zip(part, among, strict=True))) for g in grams)
            if best is None or gained > best[0]:
                best = gained, new, part
        if best is None or best[0] - fit <= price:
            break
        fit, shares, chosen = best[0], best[2], [*chosen, best[1]]
    top = max(range(len(chosen)), key=lambda i: (shares[i], -chosen[i]))
    others = [alone[k] for k in range(len(langs)) if k not in chosen]
    odds = math.exp(min(0.0, max(others) - max(alone[k] for k in chosen))) if others else 0.0
    return langs[chosen[top]], min(1.0, shares[top] / (1 + odds))


def test_query_against_plain_computation(spark, tmp_path):
    rnd = random.Random(5)
    table = [(i, text, lang) for i, text, lang, _ in rows(60, 7)] + [(60 + i, say("en", 20, rnd) + " " + say(k, 15, rnd), None) for i, k in enumerate(["fr", "de"] * 4)] + [(80, None, "en"), (81, "12 !", "en"), (82, "the", None), (None, "les eau", "fr")]
    spark.createDataFrame(table, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in queries.op6_language_id(spark, str(tmp_path)).collect()}
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i, *_ in table}
    langs, counts = ["de", "en", "fr"], {}
    for i, text, lang in table:
        if i is not None and not held[i] and text is not None and lang is not None:
            own = counts.setdefault(lang, [0.1] * langid.BUCKETS)
            if any(c.isalpha() for c in text):
                for g in plain_trigrams(text):
                    own[g] += 1
    chances = [[float(np.float32(c / sum(counts[k]))) for c in counts[k]] for k in langs]
    assert len(out) == len(table)
    for i, text, _ in table:
        lang, score = plain_answer(text, langs, chances)
        assert (out[i].lang_pred, out[i].held_out) == (lang, held[i]) and abs(out[i].score - score) < 1e-6, i


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGS", 2)
    with pytest.raises(ValueError):
        langid.train(spark.createDataFrame(rows(50, 2), SCHEMA))
