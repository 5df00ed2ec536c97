import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from urban_spark.llm import phrases
from urban_spark.llm.phrases import collocations, repeated_passages

SCHEMA = "doc_id long, text string, lang string, word string, n int"


def pieces(rows):
    for _, text, lang, *_ in rows:
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            yield lang or "und", re.findall("[^\x20\x09]+", piece)


def brute(rows, min_count, longest=5, share=100, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, words in pieces(rows):
        n[lang] += len(words)
        for k in range(1, longest + 1):
            f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        over = Counter()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    over[p[i : i + k]] = max(over[p[i : i + k]], a)
        rows_ = []
        for p, a in candidates.items():
            if 100 * over[p] >= share * a:
                continue
            score, _, l, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows_.append((lang, " ".join(p), a, l, r, n[lang], score))
        rows_.sort(key=lambda x: (-x[6], -x[2], x[1].encode()))
        out += [(x[0], i, *x[1:]) for i, x in enumerate(rows_[:top], 1)]
    return sorted(out)


def of(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


def made(seed, docs=120):
    deal = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "é", "naïve", "x\x1cy", "Ab"]
    weights = [40, 30, 20] + [4] * (len(vocabulary) - 3)
    fixed = "Please read the terms of this short notice before you go on"
    rows = []
    for i in range(docs):
        words = deal.choices(vocabulary, weights, k=deal.randint(0, 60))
        text = "".join(w + deal.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "!?", "\x0b", " : "]) for w in words)
        rows.append((i, text + deal.choice(["", fixed, f"and {fixed}", fixed + ".", f"{fixed} {fixed}"]), deal.choice(["en", "en", "fr", None]), "w", 1))
    return [*rows, rows[0], rows[0], (None, None, None, None, None), (1, "", "en", "", 0), (2, " .\t.", "de", "", 0)]


@pytest.mark.parametrize(("seed", "min_count", "share", "top"), [(1, 8, 100, 2000), (2, 5, 100, 7), (3, 5, 60, 2000), (4, 1000, 100, 10)])
def test_as_brute_force(spark, seed, min_count, share, top):
    rows = made(seed)
    got = of(collocations(spark.createDataFrame(rows, SCHEMA), min_count=min_count, share=share, top=top))
    assert got == brute(rows, min_count, share=share, top=top) and (bool(got) or min_count == 1000)


def test_shorter_windows(spark):
    rows = made(5)
    for longest in (2, 3):
        assert of(collocations(spark.createDataFrame(rows, SCHEMA), min_count=6, longest=longest)) == brute(rows, 6, longest)


def test_small_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(phrases, "STRETCH", 40)
    held = list(phrases._tokens(iter(spark.createDataFrame(made(6), SCHEMA).select(F.coalesce("lang", F.lit("und")), "text").toArrow().to_batches())))
    want = Counter((lang, tuple(words)) for lang, words in pieces(made(6)) if words)
    got = Counter()
    for lang, tokens in held:
        piece = []
        for t in tokens:
            if t == b"\n" and piece:
                got[lang, tuple(piece)] += 1
            piece = [] if t == b"\n" else [*piece, t.decode()]
    assert got == want and len(held) > 50


def test_passages_are_unary_paths(spark):
    deal = random.Random(9)
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(i, f"{deal.choice('abcdefgh')} {text} {deal.choice('rstuvw')}", "en", "w", 1) for i in range(50)]
    rows += [(100 + i, "five six seven eight nine ten eleven", "en", "w", 1) for i in range(10)]
    got = {(r.passage, r.n) for r in repeated_passages(spark.createDataFrame(rows, SCHEMA), min_count=40).collect()}
    want = {("one two three four five six seven eight", 50), ("five six seven eight nine ten eleven", 60), ("eight nine ten eleven twelve", 50)}
    assert got == want


def test_empty_and_codes(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert repeated_passages(spark.createDataFrame([], SCHEMA)).collect() == []
    one = spark.range(1).select(phrases._code(3, F.lit("fr"), F.lit("été")).alias("c")).collect()[0].c
    assert one % 2**64 == xxhash.xxh64_intdigest("été".encode(), xxhash.xxh64_intdigest(b"3:fr", 42))


def test_products_past_64_bits(spark):
    """Counts of a large corpus, given as such: the score is exact."""
    a, n, l, r = 3 * 10**12 + 7, 9 * 10**14 + 1, 5 * 10**12 + 3, 4 * 10**12 + 9
    row = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long").select(phrases.score_column().alias("s")).collect()[0].s
    assert row == 1000 * a * n // (l * r)


def test_pair_codes_are_short_and_never_none():
    codes = np.random.default_rng(0).integers(1, 1 << 63, 5000, np.uint64)
    codes[::7] = 0
    pairs, present = phrases._pairs(codes), (codes[:-1] > 0) & (codes[1:] > 0)
    assert ((pairs > 0) == present).all() and set((pairs[present] & np.uint64((1 << 32) - 1)).tolist()) == {1}
    assert len(set(pairs[present].tolist())) > 0.999 * len(set(zip(codes[:-1][present].tolist(), codes[1:][present].tolist(), strict=True)))
