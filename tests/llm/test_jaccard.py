import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from urban_spark.llm import jaccard


def grams(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows, threshold=0.8):
    sets = [grams(t) for _, t in rows]
    label, links = list(range(len(rows))), Counter()

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                label[root(i)] = root(j)
    ids = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        ids[root(i)] += [doc] if doc is not None else []
    return Counter((doc, doc if not sets[i] else min(ids[root(i)], default=None), links[i]) for i, (doc, _) in enumerate(rows))


def family(rnd, size, copies, edits, start):
    base = [f"w{rnd.randint(0, 400)}" for _ in range(size)]
    for k in range(copies):
        w = list(base)
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(size)] = f"e{rnd.randint(0, 10**6)}"
        yield start + k, " ".join(w)


@pytest.mark.parametrize("block", [256, 6])
def test_same_as_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", block)
    rnd = random.Random(block)
    rows = [*family(rnd, 120, 40, 3, 0), *family(rnd, 300, 12, 8, 100), *family(rnd, 12, 6, 1, 200)]
    rows += [(300 + i, " ".join(f"u{rnd.randint(0, 10**6)}" for _ in range(30))) for i in range(20)]
    rows += [(400, None), (401, ""), (402, " \n"), (403, "a b"), (404, "A  b"), (405, "b a"), (0, rows[0][1]), (None, rows[0][1]), (None, "only here, without any id at all"), (500, "x y " * 20_000), (501, "x y " * 20_000 + "z")]
    docs = spark.createDataFrame([(*r, "n", 3) for r in rows], "doc_id long, text string, node string, links int")
    out = jaccard.jaccard_classes(docs).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in out) == brute(rows)


def test_empty_table_and_no_pairs(spark):
    assert jaccard.jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    out = jaccard.jaccard_classes(spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l")], "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in out) == [(1, 1, 0), (2, 2, 0)]


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.9999), (0.6, 0.99), (0.9, 0.999)):
        bands, rows = jaccard.choose_bands(threshold, recall)
        assert bands * rows <= 128 and 1 - (1 - threshold**rows) ** bands >= recall
        assert rows == 1 or 1 - (1 - threshold ** (rows + 1)) ** (128 // (rows + 1)) < recall


def test_signatures_agree_as_sets_do():

    met = 0
    for k in range(300):
        (_, a), (_, b) = family(random.Random(k), 200, 2, 12, 0)
        g, s, _ = jaccard.n_grams(pa.array([a, b]), 5)
        sig = jaccard.signatures(g, s, 60, 1)
        j = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
        met += (sig[0] == sig[1]).mean() - j
    assert abs(met / 300) < 0.02


def test_components(spark):
    edges = [(bytes([i]), bytes([i + 1])) for i in range(40)] + [(bytes([60]), bytes([61])), (bytes([61]), bytes([60])), (bytes([70]), bytes([70]))]
    out = {r.node[0]: r.label[0] for r in jaccard.connected_components(spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in edges], "node binary, root binary")).collect()}
    assert out == {**{i: 0 for i in range(41)}, 60: 60, 61: 60}


def test_pairs_at_the_threshold_are_links(spark):
    rows = []
    for k in range(1, 41):  # 4k of 5k n-grams, then one of both fewer
        base = [f"t{k}w{i}" for i in range(5 * k + 4)]
        rows += [(10 * k, " ".join(base[: 4 * k + 4])), (10 * k + 1, " ".join(base))]
        below = [f"b{k}w{i}" for i in range(5 * k + 3)]
        rows += [(10 * k + 2, " ".join(below[: 4 * k + 3])), (10 * k + 3, " ".join(below))] if k > 1 else []
    out = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in out) == brute(rows)
    links = {r.doc_id: r.n_links for r in out}
    assert all(links[10 * k] == links[10 * k + 1] == 1 for k in range(1, 41)) and all(not links[10 * k + 2] for k in range(2, 41))
