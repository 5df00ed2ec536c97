"""Matching of records by keys, numbers, names and order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urban_spark.functions.text import normalized, number_between, token_set, token_set_ratio
from urban_spark.operators.graph import _cut
from urban_spark.operators.panel import cumulative
from urban_spark.operators.sizes import small


def ordinal_join(left: DataFrame, right: DataFrame, *, group: str, left_order: str, right_order: str) -> DataFrame:
    """The n-th row of a group with the n-th of the other table's; numbering within groups."""
    number = lambda df, by: df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(by)))
    return number(left, left_order).join(number(right, right_order), [group, "_n"]).drop("_n")


def ordinal_band(df: DataFrame, *, group: str, key: str, reach: int) -> DataFrame:
    """(src, dst) for each row and the next `reach` of its group."""
    w = Window.partitionBy(group).orderBy(key)
    ahead = F.collect_list(key).over(w.rowsBetween(1, reach))
    return df.withColumn("_ahead", ahead).select(F.col(key).alias("src"), F.explode("_ahead").alias("dst"))


def _one_to_one(pairs: DataFrame, a: str, b: str, order: list) -> DataFrame:
    """Pairs as if taken one by one in the order of `order`, each row once: those that are each other's first, then those
    among what is left, until nothing is."""
    wa, wb = Window.partitionBy(a).orderBy(*order), Window.partitionBy(b).orderBy(*order)
    left, found = _cut(pairs), None
    while found is None or not left.isEmpty():
        one = left.withColumn("_ra", F.row_number().over(wa)).withColumn("_rb", F.row_number().over(wb)).where("_ra = 1 AND _rb = 1").drop("_ra", "_rb")
        one = _cut(one)
        found = one if found is None else found.unionByName(one)
        left = _cut(left.join(one.select(a), a, "left_anti").join(one.select(b), b, "left_anti"))
    return found


def _in_order(a: DataFrame, b: DataFrame) -> DataFrame:
    """(left, right): the n-th of a with the n-th of b, by their numeric keys; places are sums in two levels."""
    place = lambda df, c: cumulative(df.select(F.col(c)).withColumn("_v", F.col(c).cast("double")).withColumn("_k", F.lit(1)), "_v", "_k", "_at").select(c, "_at")
    return place(a, "left").join(place(b, "right"), "_at").select("left", "right")


def _ordered(rows: DataFrame, often: DataFrame) -> DataFrame:
    """(name, parts): the elements of each name, the rarest first."""
    joined = rows.join(small(often), "part")
    return joined.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("often", "part"))), lambda x: x["part"]).alias("parts"))


def _prefixes(own: DataFrame, other: DataFrame, cut_off) -> tuple[DataFrame, DataFrame]:
    """Both tables of (name, part) as (name, parts) in one order, rarest first over both, cut to cut_off(name, parts)."""
    often = _cut(own.unionByName(other).groupBy("part").agg(F.count(F.lit(1)).alias("often")))
    return tuple(_ordered(rows, often).select("name", "parts", cut_off(F.col("name"), F.col("parts")).alias("head")) for rows in (own, other))


def _sharing_words(own: DataFrame, other: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs of names of which the shared words can make up `least` percent of one. The rarest shared word is then among the first words of that
    name, rarest first: those from which on the rest of it is that long."""

    def head(name, parts):
        rest = lambda i: F.length(F.array_join(F.slice(parts, i + 1, F.size(parts) - i), " "))
        return F.filter(parts, lambda _, i: 100 * rest(i) >= least * F.length(name) - 1e-6)

    words = lambda df: df.select("name", F.explode(F.split("name", " ")).alias("part"))
    one, two = (_cut(x) for x in _prefixes(words(own), words(other), head))

    def meet(first: DataFrame, whole: DataFrame) -> DataFrame:
        heads, all_ = first.select(F.col("name").alias("x"), F.explode("head").alias("part")), whole.select(F.col("name").alias("y"), F.explode("parts").alias("part"))
        return heads.join(all_, "part").where(100 * F.length("y") >= least * F.length("x") - 1e-6).select("x", "y")

    return meet(one, two).select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(meet(two, one).select(F.col("y").alias("a"), F.col("x").alias("b")))


def _spelt_alike(own: DataFrame, other: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs of names that few enough edits can tell apart. An edit takes away two pairs of neighbouring letters at most, blanks at the ends of words
    included and wherever the words stand; so of the rarest pairs of a name, two for each edit and two more, any such name has two as well."""

    def head(name, parts):
        edits = F.floor((100 - least) / least * F.length(name) + 1e-6)
        return F.slice(parts, F.lit(1), F.least(F.size(parts), (2 * edits + 2).cast("int")))

    def neighbours(df: DataFrame) -> DataFrame:
        padded = lambda w: F.concat(F.lit(" "), w, F.lit(" "))
        of_word = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(padded(w), i, F.lit(2)))
        counted = df.select("name", F.explode(F.flatten(F.transform(F.split("name", " "), of_word))).alias("two")).groupBy("name", "two").count()
        return counted.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.col("count").cast("int")), lambda k: F.concat("two", k.cast("string")))).alias("part"))

    keyed = []
    for rows in _prefixes(neighbours(own), neighbours(other), head):
        h = F.col("head")
        pairs = F.flatten(F.transform(h, lambda e, i: F.transform(F.slice(h, i + 2, F.size(h)), lambda f: F.xxhash64(e, f))))  # noqa: B023
        keyed.append(rows.select("name", F.explode(pairs).alias("key")))
    one, two = keyed[0].withColumnRenamed("name", "a"), keyed[1].withColumnRenamed("name", "b")
    near = F.abs(F.length("a") - F.length("b")) * 100 <= (100 - least) * F.greatest(F.length("a"), F.length("b")) + 1e-6
    return one.join(two, "key").where(near).select("a", "b")


def fuzzy_pairs(left: DataFrame, right: DataFrame, *, left_key: str, left_name: str, right_key: str, right_name: str, least: float = 88.0) -> DataFrame:
    """(left, right, score): all pairs of rows whose names have a token_set_ratio() of `least` percent or more, at least 75.

    A score is reached where the words that both have make up that share of one name, or where few enough edits turn one into the other. Both
    kinds are found by joins on the rarest parts that such names must share (words, and neighbouring letters),
    then scored; no pair is lost. Names without letters and digits match nothing. A name that is one word which a third of the
    other table has matches that third: the result holds all these pairs.
    """
    if not 75 <= least <= 100:
        raise ValueError("the least score must be from 75 to 100")
    named = lambda df, key, name: df.select(F.col(key).alias("key"), F.array_join(token_set(F.col(name)), " ").alias("name")).where("name <> ''")
    a, b = _cut(named(left, left_key, left_name)), _cut(named(right, right_key, right_name))
    own, other = _cut(a.select("name").distinct()), _cut(b.select("name").distinct())
    near = _sharing_words(own, other, least).unionByName(_spelt_alike(own, other, least)).distinct()
    scored = _cut(near.withColumn("score", token_set_ratio(F.col("a"), F.col("b"))).where(F.col("score") >= least))
    return scored.join(a.select(F.col("name").alias("a"), F.col("key").alias("left")), "a").join(b.select(F.col("name").alias("b"), F.col("key").alias("right")), "b").select("left", "right", "score")


def link(left: DataFrame, right: DataFrame, *, left_key: str, left_name: str, right_key: str, right_name: str, least: float = 88.0, in_order: bool = False) -> DataFrame:
    """(left, right, method, score), one to one: the number in the text equals the right key; else equal normalised names; else
    token-set similarity of `least` or more, as fuzzy_pairs() finds it, the best first; each stage takes what the ones before left. With `in_order` what is left
    at last is paired by the order of the keys, which must be numeric."""
    a = left.select(F.col(left_key).alias("left"), F.col(left_name).alias("_a"))
    b = right.select(F.col(right_key).alias("right"), F.col(right_name).alias("_b"))
    found = None

    def stage(pairs: DataFrame, method: str) -> None:
        nonlocal a, b, found
        one = _one_to_one(pairs, "left", "right", [F.desc("score"), "left", "right"]).select("left", "right", F.lit(method).alias("method"), "score")
        a, b = a.join(one, "left", "left_anti"), b.join(one, "right", "left_anti")
        found = one if found is None else found.unionByName(one)

    low, high = b.agg(F.min(F.col("right").try_cast("int")), F.max(F.col("right").try_cast("int"))).collect()[0]
    number = a.withColumn("right", number_between(F.col("_a"), low or 0, high or 0).cast(b.schema["right"].dataType))
    stage(number.join(b.select("right"), "right").withColumn("score", F.lit(100.0)), "number")
    same = a.withColumn("_k", normalized(F.col("_a"))).join(b.withColumn("_k", normalized(F.col("_b"))), "_k").where("_k <> ''")
    stage(same.withColumn("score", F.lit(100.0)), "name")
    stage(fuzzy_pairs(a, b, left_key="left", left_name="_a", right_key="right", right_name="_b", least=least), "fuzzy")
    if in_order:
        found = found.unionByName(_in_order(a, b).select("left", "right", F.lit("order").alias("method"), F.lit(0.0).alias("score")))
    return found


def match_report(wards: DataFrame, links: DataFrame, *, key: str) -> DataFrame:
    """Number of rows by method, those without a link as `unmatched`."""
    return wards.select(F.col(key).alias("left")).join(links, "left", "left").groupBy(F.coalesce("method", F.lit("unmatched")).alias("method")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))
