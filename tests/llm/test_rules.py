import random
from collections import Counter

from urban_spark.llm.rules import quality_rules

BLANK = " \t\n\x0b\x0c\r"


def words(text):
    out, now = [], ""
    for c in text:
        if c in BLANK:
            out += [now] if now else []
            now = ""
        else:
            now += c
    return out + ([now] if now else [])


def counts(text):
    text = text or ""
    w, seen, dup = words(text), set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {p for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(again)


GOOD = "The first words of this text say nothing new. They go on for a while, then stop. Another short sentence closes it here. " * 1
TEXTS = [
    None, "", " \t\n", "one", "a b c d e f g h", "a b c d e f g h a b c d e f g h i", "x " * 100, "same line\nsame line\nsame line\n\n\n", "# * $ é中 | <>\x0bü\x0c",
    GOOD + "Plain endings differ, as they should in prose.", "LOUD!! WORDS!! " * 3 + " ".join(f"W{i}!!" for i in range(40)), " ".join(f"w{i}### " for i in range(60)), "\n".join(f"line {i % 7} ends." for i in range(40)),
    " ".join(f"long{i}" for i in range(30_000)), "k " * 7,
]


def test_counts_and_verdicts(spark):
    rows = [(i, t, "n", 5) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "again", 5), (None, GOOD, None, None)]
    out = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, kept string, votes int")).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == Counter((i, *counts(t)) for i, t, *_ in rows)
    by_id = {r.doc_id: r for r in out}
    for i, t, *_ in rows:
        n, _, _, _, again = counts(t)
        assert by_id[i].base_failed == (n < 20 or 100 * again > 30 * n)
        assert not (by_id[i].kept and by_id[i].base_failed)
    assert by_id[9].kept and not any(by_id[i].kept for i in (0, 1, 3, 6, 10, 11, 12))


def test_one_pattern_and_empty_table(spark):
    schema = "doc_id long, text string"
    assert quality_rules(spark.createDataFrame([], schema)).collect() == []
    assert [r.kept for r in quality_rules(spark.createDataFrame([(1, TEXTS[9])] * 3, schema)).collect()] == [True] * 3


def test_accuracies_rise_with_agreement(spark):
    from urban_spark.llm.rules import accuracies

    rows = [([1, 1, 0],)] * 50 + [([1, 1, -1],)] * 10 + [([0, 0, -1],)] * 2 + [([0, 0, 0],)] * 5
    model = accuracies(spark.createDataFrame(rows, "votes array<int>"), 3).collect()[0]
    assert model.accuracy[0] > 0.95 and model.accuracy[2] < 0.5
    assert {tuple(p.votes): p.q > 0.5 for p in model.patterns}[1, 1, -1] and {tuple(p.votes): p.q for p in model.patterns}[0, 0, 0] == 0.5


def prose(i, n=12):
    deal = random.Random(i)
    words = ["with", "of", "stone", "river", "early", "they", "walk", "bright", "under", "quiet", "field", "carry"]
    return " ".join("Then " + " ".join(deal.choices(words, k=11)).replace("with with", "with").replace("of of", "of") + " ends." for _ in range(n))


def test_votes_that_meet_are_weighed(spark):
    """Good texts that a weak rule votes against are kept; junk of one kind is not, though most other rules speak for it."""
    from pyspark.sql import functions as F

    from urban_spark.llm.rules import FOR, KINDS, RULES, VOTES, WEAK, rule_features

    good = [(i, prose(i)) for i in range(300)] + [(1000 + i, prose(i, 3)) for i in range(40)] + [(2000 + i, prose(i) + "\nline\nline") for i in range(30)]
    junk = [(5000 + i, prose(i).replace(" w", " # w").replace(" t", " | t").replace(" of", " & of")) for i in range(40)] + [(6000 + i, prose(i).upper().replace(".", "!!")) for i in range(25)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in quality_rules(docs).collect()}
    assert all(kept[i] for i, _ in good) and not any(kept[i] for i, _ in junk)
    votes = rule_features(docs).select("_id", *(F.expr(VOTES[r]).alias(r) for r in RULES)).collect()
    against, for_ = {r["_id"] for r in votes if any(r[x] for x in (*KINDS, *WEAK))}, {r["_id"] for r in votes if any(r[x] for x in FOR)}
    assert len(against & for_ & {i for i, _ in good}) >= 70 and len(against & for_ & {i for i, _ in junk}) >= 60


def test_posterior_is_bayes_by_hand(spark):
    import math

    from pyspark.sql import functions as F

    from urban_spark.llm.rules import RULES, _start, posterior, vote_model

    rates, shares = _start()
    fires = [float(j in (1, 8, 12)) for j in range(len(RULES))]
    got = spark.range(1).select(posterior(F.lit(fires), rates, shares).alias("q")).first().q
    odds = [p * math.prod(t if f else 1 - t for f, t in zip(fires, r, strict=True)) for r, p in zip(rates, shares, strict=True)]
    assert all(abs(a - b / sum(odds)) < 1e-12 for a, b in zip(got, odds, strict=True))
    assert vote_model(spark.createDataFrame([], "votes array<int>")) == (rates, shares)
