import random

import pytest
from pyspark.sql import functions as F

from urban_spark.functions.text import token_set_ratio
from urban_spark.operators import linkage as l

NAMES = "k long, name string, extra string"


def pairs(a, b, least):
    return {(r.left, r.right): r.score for r in l.fuzzy_pairs(a, b, left_key="k", left_name="name", right_key="k", right_name="name", least=least).collect()}


def matrix(a, b, least):
    other = b.select(F.col("k").alias("j"), F.col("name").alias("other"))
    scores = a.crossJoin(other).where("trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ')) <> '' AND trim(regexp_replace(lower(other), '[^a-z0-9]+', ' ')) <> ''")
    return {(r.k, r.j): r.score for r in scores.withColumn("score", token_set_ratio(F.col("name"), F.col("other"))).where(F.col("score") >= least).collect()}


def misspelt(deal, name):
    for _ in range(deal.randint(0, 3)):
        at = deal.randrange(len(name) + 1)
        name = deal.choice([name[:at] + name[at + 1 :], name[:at] + deal.choice("aeiou x") + name[at:], name[:at] + deal.choice("nrst") + name[at + 1 :]])
    words = name.split(" ")
    if deal.random() < 0.3:
        deal.shuffle(words)
    if deal.random() < 0.3:
        words.insert(deal.randint(0, len(words)), deal.choice(["Ward", "ward", "East", "zeta extra", "No", "a"]))
    return deal.choice([" ", " ", "-", "  "]).join(words)


def table(spark, deal, n, base):
    return spark.createDataFrame([(i, misspelt(deal, deal.choice(base)), "x") for i in range(n)] + [(n, None, "x"), (n + 1, "", None), (n + 2, "--", None), (n + 3, "ward", None), (n + 4, "Ward", None)], NAMES)


@pytest.mark.parametrize(("n", "least"), [(2000, 80.0), (300, 88.0), (300, 75.0), (300, 100.0)])
def test_no_pair_of_the_full_matrix_is_lost(spark, n, least):
    deal = random.Random(n + int(least))
    syllables = ["na", "gar", "hal", "li", "pu", "ra", "ko", "te", "shi", "van", "dor"]
    word = lambda: "".join(deal.choices(syllables, k=deal.randint(1, 4)))
    base = [" ".join([*(word() for _ in range(deal.randint(1, 3))), *deal.choices(["ward", "north", "layout", "b"], k=deal.randint(0, 2))]) for _ in range(n // 2)] + ["a b", "x", "1 2 3", "i i"]
    a, b = table(spark, deal, n, base), table(spark, deal, n, base)
    got = pairs(a, b, least)
    assert got == matrix(a, b, least) and len(got) > n / 10


def test_extra_and_misspelt_words_are_found(spark):
    a = spark.createDataFrame([(1, "alpha beta gamma", ""), (2, "north hill ward", ""), (3, "ward", "")], NAMES)
    b = spark.createDataFrame([(10, "alpha beta gamma zeta extra", ""), (20, "nrth hil ward", ""), (30, "elsewhere", "")], NAMES)
    got = pairs(a, b, 80.0)
    assert got[1, 10] == 100.0 and got[2, 20] == pytest.approx(86.667, abs=1e-2) and got[3, 20] == 100.0 and len(got) == 3
    # The word that both have is taken by the nearer name.
    links = {r.left: (r.right, r.method) for r in l.link(a, b, left_key="k", left_name="name", right_key="k", right_name="name", least=80.0).collect()}
    assert links == {1: (10, "fuzzy"), 3: (20, "fuzzy")}


def test_empty_tables_and_bounds(spark):
    empty, one = spark.createDataFrame([], NAMES), spark.createDataFrame([(1, "a b", "")], NAMES)
    assert pairs(empty, one, 88.0) == pairs(one, empty, 88.0) == {}
    assert l.link(empty, one, left_key="k", left_name="name", right_key="k", right_name="name").collect() == []
    for least in (60.0, 101.0):
        with pytest.raises(ValueError):
            pairs(one, one, least)
