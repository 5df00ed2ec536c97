import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from urban_spark.llm.mixing import mix_sources, targets

SCHEMA = "doc_id long, text string, source string, size int, target string"


def goals(sizes, weights, share=1.0, most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values()) * share
    while True:
        free = sum(w[s] for s in sizes if s not in full)
        left = total - sum(most * sizes[s] for s in full)
        over = {s for s in sizes if s not in full and left * w[s] > most * sizes[s] * free}
        if not over:
            return {s: most * sizes[s] if s in full else left * w[s] / free if free else 0 for s in sizes}
        full |= over


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def brute(rows, weights=(5, 2, 1), share=1.0, most=3):
    found, sizes = [], {}
    for doc_id, text, source, *_ in rows:
        size = len(re.findall("[^\x20\x09-\x0d]+", text or ""))
        weight = min(max(len(re.findall(r"[A-Za-zé]{2,}", text)) / size, 0.05), 1.0) if size else 0.05
        even = (int(md5(f"{'' if doc_id is None else doc_id}:{'' if text is None else md5(text)}:{source or ''}")[:13], 16) + 0.5) / 2**52
        found.append((-math.log(even) / weight, doc_id, source, size))
        sizes[source] = sizes.get(source, 0) + size
    target, out = goals(sizes, weights, share, most), []
    for source, all_ in sizes.items():
        epochs, before = int(target[source] // all_) if all_ else 0, 0
        budget = target[source] - epochs * all_
        for _, doc_id, _, size in sorted((x for x in found if x[2] == source), key=lambda x: x[0]):
            out.append((doc_id, size, all_, target[source], size * (epochs + (before + size / 2 < budget))))
            before += size
    return out


def same(df, want):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = sorted((tuple(r) for r in df.collect()), key=key)
    want = sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert (a[0], a[1], a[2], a[4]) == (b[0], b[1], b[2], b[4]) and a[3] == pytest.approx(b[3], rel=1e-12)


def made(seed, sizes):
    deal, rows = random.Random(seed), []
    for source, n in sizes.items():
        for _ in range(n):
            words = deal.choices(["word", "été", "12", "a", "|", "x9y", "end."], [6, 2, 1, 1, 1, 1, 1], k=int(deal.paretovariate(1) * 5))
            rows.append((len(rows), deal.choice([" ", "\n", "\t "]).join(words), source, 1, "t"))
    return rows


@pytest.mark.parametrize("share", [1.0, 0.05, 2.5, 3.0])
def test_as_brute_force(spark, share):
    rows = made(3, {"a": 200, "b": 3, "c": 40, "é": 1, None: 30, "": 25, "B": 2, "hot": 600})
    rows += [(None, "one two", "c", 1, None), (None, None, "c", 1, None), (7, "", "zz", 1, None), (8, None, None, 1, None)]
    out = mix_sources(spark.createDataFrame(rows, SCHEMA), share=share)
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken"]
    same(out, brute(rows, share=share))


def test_sums_are_near_the_targets_and_reruns_agree(spark):
    rows = made(5, {f"s{i}": 1 + i * i * 3 for i in range(12)})
    docs = spark.createDataFrame(rows, SCHEMA)
    a, b = mix_sources(docs.repartition(7)), mix_sources(docs.repartition(3, "text"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    source = {r[0]: r[2] for r in rows}
    taken, target, longest = {}, {}, {}
    for r in a.collect():
        s = source[r.doc_id]
        taken[s], target[s], longest[s] = taken.get(s, 0) + r.taken, r.target, max(longest.get(s, 0), r["size"])
        assert 0 <= r.taken <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= longest[s] / 2 for s in taken)
    assert sum(target.values()) == pytest.approx(sum(r["size"] for r in a.collect()))


def test_equal_rows_share_what_is_left(spark):
    rows = [(1, "one two three four", "a", 1, "t")] * 300 + [(2, "five six", "b", 1, "t")]
    got = sorted(r.taken for r in mix_sources(spark.createDataFrame(rows, SCHEMA)).where("doc_id = 1").collect())
    target = goals({"a": 1200, "b": 2}, (5, 2, 1))["a"]
    assert len(got) == 300 and set(got) <= {0, 4} and abs(sum(got) - target) <= 2


def test_better_documents_are_taken_more_often(spark):
    rows = [(i, "word " * 9 + "word" if i % 2 else "1 " * 9 + "1", "a" if i < 2000 else "b", 1, "t") for i in range(2600)]
    out = mix_sources(spark.createDataFrame(rows, SCHEMA), weights=(1, 1), share=0.5).where("doc_id < 2000").groupBy(F.col("doc_id") % 2).agg(F.sum(F.signum("taken")).alias("n"))
    n = {r[0]: r.n for r in out.collect()}
    assert n[1] > 2.5 * n[0] > 0


def test_targets_go_round(spark):
    sizes = {f"s{i:02d}": n for i, n in enumerate([1000, 1, 5, 1, 300, 2, 40, 7, 11, 90, 1])}
    for weights in ((5, 2, 1), (1,), (100, 1)):
        df = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), weights)
        got = {r.source: r.target for r in df.collect()}
        assert got == pytest.approx(goals(sizes, weights)) and sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_empty_and_bad_input(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mix_sources(empty).collect() == []
    assert [tuple(r) for r in mix_sources(spark.createDataFrame([(1, None, None, 1, "")], SCHEMA)).collect()] == [(1, 0, 0, 0.0, 0)]
    for bad in ({"weights": ()}, {"weights": (1, 0)}, {"share": 3.5}):
        with pytest.raises(ValueError):
            mix_sources(empty, **bad)
    with pytest.raises(ValueError):
        mix_sources(spark.createDataFrame([(1, "a b", "s", 0, "")], SCHEMA), quality=F.lit(-1.0))
