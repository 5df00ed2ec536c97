import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from urban_spark.llm import packing

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "It's <|endoftext|> Élan 12", "a\x1cb\x85c\xa0d İx 中文字 3٣", "ΑΣ 1² x½ ª_ _a don't ẞ é", "\t\n ", "word " * 9_000, "z" * 30_000, "á ́b"]


@lru_cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def library(text):
    return np.array([*tokenizer().encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def check(rows, out, capacity):
    want = Counter()
    for i, text in rows:
        ids = library(text)
        want.update((i, k, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())) for k, s in enumerate(range(0, len(ids), capacity)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for runs in sequences.values():
        at = 0
        for offset, length in sorted(runs):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_whole_texts_null_ties_and_repeats(spark):
    rows = [*enumerate(ODD), (90, None), (90, None), (None, "no id"), *((100 + i, "same length here") for i in range(40))]
    out = packing.pack_documents(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, piece string, length int"), TOKENIZER).collect()
    check(rows, out, 4096)
    small = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), TOKENIZER, capacity=7).collect()
    check(rows, small, 7)
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER).collect() == []


ALPHABET = st.sampled_from(" \t\n\r\x0b\x0c\x1c\x85\xa0'<|>_-.,09aAsStTzßÉéİıǅΣςσ²½ªॐ\u0301中٣🙂") | st.characters(codec="utf-8")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.none() | st.text(ALPHABET, max_size=40) | st.sampled_from([*ODD, "don't <|endoftext|>x", "<|startoftext|"]), max_size=6))
def test_ids_are_the_library_s(texts):
    found = packing.token_ids(texts, TOKENIZER)
    assert len(found) == len(texts) and all((a == library(t)).all() and len(a) == len(library(t)) for a, t in zip(found, texts, strict=True))


def test_small_caches_and_segments(monkeypatch):
    monkeypatch.setattr(packing, "SEGMENT", 50)
    monkeypatch.setattr(packing, "_ids", {})
    texts = [" ".join(f"w{i * k % 37}é" for i in range(60)) for k in range(9)] + [None, "x" * 300]
    packing.token_ids(texts, TOKENIZER)
    for cache in (packing._ids[TOKENIZER].words, packing._ids[TOKENIZER].stems):
        cache.size = 5
    for _ in range(2):
        assert all(np.array_equal(a, library(t)) for a, t in zip(packing.token_ids(texts, TOKENIZER), texts, strict=True))


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60).flatmap(lambda cap: st.tuples(st.just(cap), st.dictionaries(st.integers(1, cap), st.integers(1, 30), max_size=12))))
def test_plan_places_all_within_capacity(case):
    capacity, histogram = case
    sequences = defaultdict(list)
    places = packing.plan(dict(histogram), capacity)
    starts = sorted((n, r) for n, r, *_ in places)
    for n, count in histogram.items():
        for rank in range(count):
            _, at = max(s for s in starts if s <= (n, rank))
            first, each, offset = next(p[2:] for p in places if p[:2] == (n, at))
            sequences[first + (rank - at) // each].append((offset + (rank - at) % each * n, n))
    for runs in sequences.values():
        at = 0
        for offset, n in sorted(runs):
            assert offset == at
            at += n
        assert at <= capacity
    total = sum(n * c for n, c in histogram.items())
    large = sum(c for n, c in histogram.items() if 2 * n > capacity)
    # Beyond the sequences that hold a large run, all but one are two thirds full at least.
    assert len(sequences) <= max(large, 0) + -(-3 * total // (2 * capacity)) + 1


def test_close_to_the_bound(spark):
    random = np.random.default_rng(5)
    lengths = np.minimum(4096, random.lognormal(6, 1.2, 3_000).astype(int) + 1)
    pieces = spark.createDataFrame([(i, 0, int(n)) for i, n in enumerate(lengths)], "_row long, piece int, length long")
    used = packing.best_fit_packing(pieces).select("sequence_id").distinct().count()
    assert used <= -(-int(lengths.sum()) // 4096) + 1


def test_segments_and_caches_do_not_change_ids():
    texts = ["some words and some more words " * 40, None, "a b c 123 \u00e9 \u4e2d", ""]
    want = packing.token_ids(texts, TOKENIZER)
    for segment, cache in ((1 << 22, 100_000), (64, 2)):
        assert all(np.array_equal(a, b) for a, b in zip(packing.token_ids(texts, TOKENIZER, segment, cache), want, strict=True))
