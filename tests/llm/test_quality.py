import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa

from urban_spark.llm import quality, queries


def rows(count, seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice(["the", "ing", "and", "tion"]) for _ in range(rnd.randint(1, 3))) for _ in range(200)]
    out = []
    for i in range(count):
        text, good = [rnd.choice(words) for _ in range(rnd.randint(5, 80))], rnd.random() < 0.8
        kind = rnd.randrange(3)
        bad = [w + "###" for w in text] if kind == 0 else [w.upper() + "!!" for w in text] if kind == 1 else [w for w in text[:5] for _ in range(12)]
        out.append((i, " ".join(text if good else bad), int(good)))
    return out


def auc(y, s):
    return np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])


def test_held_out_accuracy(spark):
    data = rows(900, 3)
    docs = spark.createDataFrame([(i, t, 9) for i, t, _ in data], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, q) for i, _, q in data if i % 3] + [(1, None), (None, 1), (99_999, 1), (4, data[4][2])], "doc_id long, quality int")
    model = quality.fit(docs, labels, sample=500)
    out = quality.score_quality(docs, model).collect()
    y, s = (np.array(v) for v in zip(*((data[r.doc_id][2], r.score) for r in out if r.doc_id % 3 == 0), strict=True))
    assert auc(y, s) > 0.97 and all(r.predicted == (r.score >= 0.3) for r in out) and sorted(out[0].asDict()) == ["doc_id", "predicted", "score", "text"]


def test_odd_texts(spark):
    model = quality.train(quality.examples(pa.array([t for _, t, _ in rows(60, 1)])), [q for *_, q in rows(60, 1)])
    odd = [None, "", " \n", "a", "é中 " * 3, "word " * 30_000, "z" * 50_000]
    found = quality.scores(model, pa.array(odd, pa.string()))
    alone = [quality.scores(model, pa.array([t], pa.string()))[0] for t in odd]
    assert np.allclose(found, alone) and ((found >= 0) & (found <= 1)).all() and len(set(found[:3])) == 1
    docs = spark.createDataFrame([(1, None), (None, "a"), (1, "a"), (1, "a")], "doc_id long, text string")
    assert quality.score_quality(docs, model).count() == 4 and quality.score_quality(docs.limit(0), model).count() == 0
    assert {r.score for r in quality.score_quality(docs, None).collect()} == {0.5}
    assert quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int")) is None


def test_word_features():
    names = np.array(["abc", "é", "x" * 10], dtype=object)
    buckets, word = quality.features(names)
    # Own bucket, and n-grams of 3, 4 and 5 bytes of the word with a mark at either end.
    assert np.bincount(word).tolist() == [1 + 3 + 2 + 1, 1 + 2 + 1 + 0, 1 + 10 + 9 + 8]
    assert buckets.max() < quality.SIZE - 2
    again, _ = quality.features(names[:1])
    assert set(again) == set(buckets[word == 0])


def plain_buckets(word):
    """Buckets of one word and of its n-grams, one by one."""
    data, out = b"<%b>" % word.encode(), [int(pd.util.hash_array(np.array([word], dtype=object), categorize=False)[0] % np.uint64(quality.WORDS))]
    for n in quality.ORDERS:
        for at in range(len(data) - n + 1):
            rolled = 0
            for b in data[at : at + n]:
                rolled = (rolled * 0x100000001B3 + b + 1) % 2**64
            out.append(((rolled + n - 1) * 0x9E3779B97F4A7C15 % 2**64 >> 47) + quality.WORDS)
    return out


def plain_counts(text):
    words = (text or "").split()
    counts = Counter({quality.SIZE - 1: 1})
    for word in words:
        counts.update(plain_buckets(word))
    counts[quality.SIZE - 2] += sum(a == b for a, b in zip(words, words[1:], strict=False))
    return counts


def plain_model(texts, labels, dims=12, epochs=6, rate=0.4, seed=7):
    """Stochastic gradient descent on the logistic loss, one number after the other."""
    random_ = np.random.default_rng(seed)
    table = ((random_.random((quality.SIZE, dims)) - 0.5) / dims).astype(np.float32).astype(float)
    out, bias, done = [[0.0] * dims, [0.0] * dims], [0.0, 0.0], 0
    rows = [plain_counts(t) for t in texts]
    for _ in range(epochs):
        for i in random_.permutation(len(rows)):
            total, ids = sum(rows[i].values()), list(rows[i])
            hidden = [sum(rows[i][b] / total * table[b][d] for b in ids) for d in range(dims)]
            logits = [sum(o * h for o, h in zip(out[c], hidden, strict=True)) + bias[c] for c in (0, 1)]
            chance = [math.exp(x - max(logits)) for x in logits]
            error = [x / sum(chance) - (c == labels[i]) for c, x in enumerate(chance)]
            step = rate * (1 - done / (epochs * len(rows)))
            done += 1
            back = [sum(error[c] * out[c][d] for c in (0, 1)) for d in range(dims)]
            for c in (0, 1):
                bias[c] -= step * 0.1 * error[c]
                for d in range(dims):
                    out[c][d] -= step * error[c] * hidden[d]
            for b in ids:
                table[b] -= step * len(ids) * min(rows[i][b] / total, 0.05) * np.array(back)

    def score(text):
        counts = plain_counts(text)
        logit = sum(n * float(table[b] @ (np.array(out[1]) - out[0])) for b, n in counts.items()) / sum(counts.values())
        return 1 / (1 + math.exp(-(logit + bias[1] - bias[0])))

    return score


def test_query_against_plain_computation(spark, tmp_path):
    table = [(i, t) for i, t, _ in rows(40, 5)] + [(90, None), (91, ""), (92, "one one one two"), (None, "the ing")]
    spark.createDataFrame(table, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q) for i, _, q in rows(40, 5)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    out = {r.doc_id: r for r in queries.op7_quality_classifier(spark, str(tmp_path)).collect()}
    known = [(t, q) for i, t, q in rows(40, 5) if zlib.crc32(str(i).encode()) % 5]
    known.sort(key=lambda r: pd.util.hash_array(np.array([r[0]], dtype=object))[0])
    score = plain_model([t for t, _ in known], [q for _, q in known])
    assert len(out) == len(table)
    for i, text in table:
        assert abs(out[i].score - score(text)) < 1e-3 and out[i].predicted == (out[i].score >= 0.3) and out[i].held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0), i
