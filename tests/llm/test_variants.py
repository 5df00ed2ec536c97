import random
import re
import zlib
from collections import Counter

import pytest

from urban_spark.llm.variants import near_words, signatures, spelling_groups, word_counts

SCHEMA = "doc_id long, text string, word string, n int, key string"


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_counts(rows, drop_every):
    seen = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if drop_every and h % drop_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                seen[run] += 1
    return {w: n for w, n in seen.items() if n >= 5}


def brute_groups(words, ratio=5):
    form, near = {}, {}
    for w, n in words.items():
        others = [x for x in words if one_edit(w, x)]
        near[w] = len(others)
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, near[w], words[form[w]] if form[w] is not None else None)
    return out


def of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_counts_as_brute_force(spark):
    deal = random.Random(4)
    base = ["Straße", "ÀéÿÖØö", "colour", "COLOUR", "colours", "abcdefg", "Ünïted", "neighbour", "short", "x" * 40]
    rows = [(i % 50, " ".join(deal.choices(base, k=30)) + "-tail×÷mark\n1colours2", "w", 1, "k") for i in range(60)] + [(None, "colours " * 7, None, None, None), (3, None, "", 0, ""), (4, "", "", 0, "")]
    for drop_every in (None, 2, 199):
        assert {r.word: r.n for r in word_counts(spark.createDataFrame(rows, SCHEMA), drop_every=drop_every).collect()} == brute_counts(rows, drop_every)


def test_groups_as_brute_force(spark):
    deal = random.Random(11)
    words = {"".join(deal.choice("abé") for _ in range(deal.randint(6, 8))): 0 for _ in range(300)}
    for w in list(words)[:60]:  # families: every kind of edit, several steps long
        for _ in range(3):
            at = deal.randrange(len(w))
            w = deal.choice([w[:at] + w[at + 1 :], w[:at] + deal.choice("abéz") + w[at:], w[:at] + deal.choice("abéz") + w[at + 1 :]])
            if len(w) >= 6:
                words[w] = 0
    words = {w: deal.choice([5, 6, 7, 25, 30, 31, 150, 155, 800]) for w in words}
    assert of(spelling_groups(spark.createDataFrame(list(words.items()), "word string, n long"))) == brute_groups(words)


def test_hot_family_and_long_chain(spark):
    hub, words = "abcdefghij", {}
    letters = [chr(c) for c in range(ord("a"), ord("z") + 1)] + [chr(c) for c in range(0xE0, 0xFF) if c != 0xF7]
    words = {hub[:i] + x + hub[i + 1 :]: 5 for i in range(10) for x in letters} | {hub: 10_000}
    got = of(spelling_groups(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == brute_groups(words) and got[hub][3] == len(words) - 1
    chain = {"a" * k + "b" * (26 - k): 5 * 5**k for k in range(26)}
    got = of(spelling_groups(spark.createDataFrame(list(chain.items()), "word string, n long")))
    assert {r[1] for r in got.values()} == {"a" * 25 + "b"} and got == brute_groups(chain)


def test_words_one_edit_apart_share_a_signature():
    deal = random.Random(2)
    for _ in range(3000):
        w = "".join(deal.choice("aabcé") for _ in range(deal.randint(6, 12)))
        at = deal.randrange(len(w))
        for v in (w[:at] + w[at + 1 :], w[:at] + "z" + w[at + 1 :], w[:at] + "a" + w[at:]):
            assert set(signatures(w)) & set(signatures(v))


def test_no_signatures_are_broadcast(spark, tmp_path):
    spark.createDataFrame([("window", 50), ("windov", 5)], "word string, n long").write.parquet(f"{tmp_path}/words")
    words = spark.read.parquet(f"{tmp_path}/words")  # a small file, as of many words that compress well
    for found in near_words(words), spelling_groups(words):
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.where("word = 'windov'").count() == 1


def test_empty_and_ratio(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert word_counts(empty).collect() == [] and spelling_groups(word_counts(empty)).collect() == []
    with pytest.raises(ValueError):
        spelling_groups(empty, ratio=1)


def test_query(spark, tmp_path):
    from urban_spark.llm.queries import op12_spelling_variants

    deal = random.Random(8)
    base = ["window", "windows", "morning", "evening", "kitchen"]
    rows = [(i, " ".join(deal.choices(base, k=40)), "w", 1, "k") for i in range(400)] + [(None, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = of(op12_spelling_variants(spark, str(tmp_path)))
    assert got == brute_groups(brute_counts(rows, 199)) and any(r[0] is not None for r in got.values())
