import hashlib
import random
from collections import Counter

from urban_spark.llm import decontam


def words(text):
    out, now = [], ""
    for c in text or "":
        c = c.lower() if "A" <= c <= "Z" else c
        if c.isascii() and not c.isalnum():
            out += [now] if now else []
            now = ""
        else:
            now += c
    return out + ([now] if now else [])


def brute(rows, items, window=10):
    out = []
    for i, text in rows:
        w, hit, named = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(window, len(v))
            grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
            for k in range(len(w) - n + 1) if v else ():
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    named.add(item)
        names = ",".join(sorted(str(x) for x in named))
        out.append((i, len(w), len(hit), len(named), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out


def test_same_as_brute_force(spark):
    rnd = random.Random(3)
    vocabulary = ["the", "of", "und", "Éa", "été", "x1", "中文", "a", "b", "rare"]
    say = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(1, " ".join(say(25))), (2, "short Item, here"), (10, " ".join(say(12))), (3, None), (4, "..."), (5, "the the the the the the the the the the the the"), (2, "short item here"), (6, "nowhere at all in any of these texts stands this long item")]
    rows = [(0, None), (1, ""), (2, "--"), (3, "a SHORT-item... here it is short item"), (4, "the " * 40)]
    for i in range(60):
        w = say(rnd.randint(1, 60))
        if i % 3 == 0:
            v = words(items[rnd.choice([0, 2])][1])
            k = rnd.randint(0, 6)
            w[5:5] = v[k : k + rnd.randint(8, 14)]
        rows.append((100 + i, ("," if i % 2 else "") + rnd.choice([" ", "\n", "! "]).join(w).title()))
    rows += [(3, rows[3][1]), (None, rows[3][1]), (7, "pre " * 20_000 + "short item here")]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, term string, pos int, n_hit int")
    out = decontam.decontaminate(docs, spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, size int")).collect()
    got = Counter(tuple(r) for r in out)
    assert got == Counter(brute(rows, items))
    assert sum(r.contaminated for r in out) > 5


def test_empty_tables(spark):
    docs, items = "doc_id long, text string", "item_id long, text string"
    assert decontam.decontaminate(spark.createDataFrame([], docs), spark.createDataFrame([(1, "a b")], items)).collect() == []
    out = decontam.decontaminate(spark.createDataFrame([(1, "a b")], docs), spark.createDataFrame([], items)).collect()
    assert [tuple(r)[1:4] for r in out] == [(2, 0, 0)]


def test_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, item), (2, "alpha beta gamma XX delta epsilon zeta eta theta iota kappa"), (3, "kappa iota theta eta zeta epsilon delta gamma beta alpha"), (4, "alpha beta"), (5, "beta gamma delta epsilon zeta eta theta iota nothing kappa")]
    index = decontam.build_index(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    near = {r.doc for r in decontam.proximity_matches(index).collect()}
    assert {1, 2, 5} <= near and not near & {3, 4}
    assert {r.doc for r in decontam.phrase_matches(index).collect()} == {1}


def brute_near(text, item, window=10, slop=3, least=8):
    w, v = words(text), words(item)
    n = min(window, len(v))
    for shift in range(-len(v) - slop, len(w) + slop + 1):
        has = [any(0 <= p < len(w) and w[p] == t for p in range(shift + k - slop, shift + k + slop + 1)) for k, t in enumerate(v)]
        if n and any(sum(has[k : k + n]) >= min(least, n) for k in range(len(v) - n + 1)):
            return True
    return False


def test_proximity_same_as_brute_force(spark):
    rnd = random.Random(5)
    items = [(i, " ".join(f"v{rnd.randrange(40)}" for _ in range(n))) for i, n in enumerate((10, 25, 9, 4, 1, 14))]
    items.append((6, "never seen words stand in here as nowhere else at all"))
    items.append((7, "ab cd ef unseenword gh ij kl mn op qr"))
    rows = [(1, "x ab cd ef other gh ij kl mn op qr y"), (2, "seen words stand changed here as nowhere changed at all")]
    for k in range(80):
        v = words(items[k % 7][1])
        for _ in range(rnd.randint(0, 4)):
            at = rnd.randrange(len(v) + 1)
            v[at : at + rnd.randint(0, 1)] = [f"v{rnd.randrange(60)}"] * rnd.randint(0, 2)
        rows.append((100 + k, " ".join([f"v{rnd.randrange(40)}" for _ in range(rnd.randint(0, 9))] + v + ["tail"] * 3)))
    out = decontam.near_items(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {r.doc_id: (r.n_proximity, r.proximity_sha256) for r in out}
    for i, text in rows:
        near = sorted(str(k) for k, t in items if brute_near(text, t))
        assert got[i] == (len(near), hashlib.sha256(",".join(near).encode()).hexdigest()), (i, near)
    assert got[1][0] == 1 and sum(n for n, _ in got.values()) > 60


def test_stage_says_the_same_as_the_query(spark):
    rnd = random.Random(12)
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(rnd.choices(words, k=rnd.randint(0, 200)))) for i in range(60)] + [(60, "x " + " ".join(words[:12]))], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(words[i : i + 12])) for i in range(5)] + [(9, "w1 w2")], "item_id long, text string")
    bad = {r.doc_id for r in decontam.decontaminate(docs, items).collect() if r.contaminated}
    assert {r.doc_id for r in decontam.without_contaminated(docs, items).collect()} == set(range(61)) - bad and 60 in bad
