import random

from pyspark.sql import functions as F

from urban_spark.operators import access as q
from urban_spark.operators import cluster as c
from urban_spark.operators import linkage as l


def test_dbscan(spark):
    rnd = random.Random(3)
    points = [(i, x + rnd.random() * 0.3, y + rnd.random() * 0.3) for i, (x, y) in enumerate([(0, 0)] * 12 + [(5, 5)] * 12 + [(2.5, 2.5)] * 2)]
    near = {i: {j for j, u, v in points if (x - u) ** 2 + (y - v) ** 2 <= 0.25 and i != j} for i, x, y in points}
    core = {i for i, n in near.items() if len(n) + 1 >= 5}
    out = {r.k: r.label for r in c.dbscan(spark.createDataFrame(points, "k int, x double, y double"), ["x", "y"], key="k", eps=0.5, least=5).collect()}
    assert {i for i, v in out.items() if v is None} == {i for i in near if i not in core and not near[i] & core} and len({v for v in out.values() if v is not None}) == 2


def test_capped_assignment(spark):
    rows = spark.createDataFrame([(i, 1.0, i / 40, 0.0) for i in range(40)], "k int, size double, x double, y double")
    centers = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.1, 0.0)], "center int, cx double, cy double")
    out = c.capped_assignment(rows, centers, "size", key="k").collect()
    counts = [sum(r.center == k for r in out) for k in (0, 1)]
    assert len(out) == 40 and max(counts) <= 21


def test_links_are_one_to_one(spark):
    a = spark.createDataFrame([(1, "Ward 17"), (2, "North  Hill"), (3, "Old Harbour Road"), (4, "North Hill"), (5, "nothing like it")], "k int, name string")
    b = spark.createDataFrame([(17, "Elsewhere"), (20, "north hill"), (21, "Harbour Road Old E"), (22, "Far")], "id int, name string")
    out = {r.left: (r.right, r.method) for r in l.link(a, b, left_key="k", left_name="name", right_key="id", right_name="name", least=80.0).collect()}
    assert out[1] == (17, "number") and out[2] == (20, "name") and out[3] == (21, "fuzzy") and 5 not in out and 4 not in out
    report = {r.method: r.n for r in l.match_report(a, l.link(a, b, left_key="k", left_name="name", right_key="id", right_name="name", least=80.0), key="k").collect()}
    assert report == {"number": 1, "name": 1, "fuzzy": 1, "unmatched": 2}


def test_budget_and_spacing(spark):
    df = q.cost_benefit(spark.createDataFrame([(1, 10.0, 5.0), (2, 9.0, 3.0), (3, 0.0, 1.0), (4, 8.0, 8.0)], "p int, b double, c double"), F.col("b"), F.col("c"))
    assert [r.p for r in q.within_budget(df, 8.0, key="p").orderBy("spent").collect()] == [2, 1]
    sites = spark.createDataFrame([(1, 5), (2, 9), (3, 9), (4, 1)], "k int, size int")
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "src int, dst int")
    assert {r.k for r in q.suppress_close(sites, pairs, key="k", size="size").collect()} == {2, 4}
    bad = q.violations(sites, "k", {"big": F.col("size") > 4, "even": F.col("k") % 2 == 0})
    assert {tuple(r) for r in bad.collect()} == {(1, "even"), (3, "even"), (4, "big")}
