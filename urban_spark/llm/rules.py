"""Quality rules that vote, and a model of how far each can be trusted."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urban_spark.llm.shared import cut, let, small

SPACE = r"\x20\x09-\x0D"
WINDOW = 8
ITERATIONS = 10

#: name -> SQL condition; a rule votes only where its condition holds: KINDS and WEAK against a text, FOR for it, each on its own evidence.
#: Each of KINDS stands for a kind of junk and is seldom wrong about a good text; those of WEAK often are.
KINDS = {
    "symbols": "10 * n_symbols > n_words",
    "capitals": "5 * n_upper > 2 * word_chars",
    "exclamations": "10 * n_marks > n_words",
    "repeated_words": "10 * n_repeat_words > 3 * n_words",
    "same_words": "5 * n_same > n_words",
    "repeated_lines": "n_dup_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars > 14 * n_words OR 2 * word_chars < 5 * n_words",
    "no_sentences": "n_words >= 60 AND n_stops = 0",
}
WEAK = {"short": "n_words < 60", "long_words": "2 * word_chars > 11 * n_words", "a_line_again": "n_dup_lines > 0"}
AGAINST = {**KINDS, **WEAK}
FOR = {
    "sentences": "60 * n_stops >= n_words AND 2 * n_stops <= n_words",
    "word_mix": "word_chars BETWEEN 4 * n_words AND 7 * n_words",
    "few_repeats": "n_repeat_words = 0 AND 10 * n_same <= n_words",
    "plain": "n_symbols = 0 AND n_marks = 0",
}
#: How often a rule is believed to vote before any vote is seen, with the weight of BELIEF documents: on good texts, on the kind of junk that it
#: stands for, and on other junk; and the share of good texts. A rule of KINDS finds at least OWN of its kind.
BELIEVED = {"kind": (0.002, 0.95, 0.03), "weak": (0.1, 0.2, 0.2), "for": (0.8, 0.6, 0.6)}
BELIEF, GOOD, OWN, ROUNDS = 20.0, 0.8, 0.9, 15
RULES = [*AGAINST, *FOR]
VOTES = {**{k: f"CASE WHEN {v} THEN -1 ELSE 0 END" for k, v in AGAINST.items()}, **{k: f"CASE WHEN {v} THEN 1 ELSE 0 END" for k, v in FOR.items()}}
BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"


def _repeated(words: Column) -> Column:
    """Words in windows of WINDOW words found twice or more among `words`, first places included."""

    def covered(windows: Column) -> Column:
        sorted_ = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda e, j: F.coalesce(F.get(s, j).getField("h") == e.getField("h"), F.lit(False))
            return F.filter(s, lambda e, j: same(e, j - 1) | same(e, j + 1))

        starts = F.sort_array(F.transform(let(sorted_, twice), lambda e: e.getField("i")))
        step = lambda a, p: F.struct((a["n"] + (p + WINDOW - F.greatest(p, a["end"]))).cast("long").alias("n"), (p + WINDOW).alias("end"))
        return F.aggregate(starts, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), step, lambda a: a["n"])

    def of_windows(g: Column) -> Column:
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g))

    def of_hashes(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))
        return let(windows, of_windows)

    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes))


def _same(words: Column) -> Column:
    """Words equal to the one before."""
    return F.size(F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1)))).cast("long")


def rule_features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts over each whole text, of any length, that the rules look at: a row for each row, repeated or not. Null text counts as
    an empty one, with 0 of everything. No rows: no rows. Extra columns are not read."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    words = let(F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), F.lit(0)), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated(w).alias("again"), _same(w).alias("same")))
    lines = let(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]")), lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("again")))
    found = docs.select(
        F.col(id_col).alias("_id"), words.alias("_words"), lines.alias("_lines"), (F.length(text) - count(f"[{SPACE}]")).cast("long").alias("word_chars"),
        count("[#*$%&|<>]").alias("n_symbols"), count(r"\p{Lu}").alias("n_upper"), count("!").alias("n_marks"), count(r"[.?!](?:\s|\z)").alias("n_stops"),
    )
    return found.select(
        "_id", F.col("_words.n").alias("n_words"), "word_chars", "n_symbols", F.col("_lines.again").alias("n_dup_lines"), F.col("_words.again").alias("n_repeat_words"), F.col("_words.same").alias("n_same"),
        F.col("_lines.n").alias("n_lines"), "n_upper", "n_marks", "n_stops",
    )


def accuracies(voted: DataFrame, rules: int, *by: str) -> DataFrame:
    """One row (accuracy array, patterns with their posterior q), or one for each value of the columns `by`, by
    expectation-maximisation over the patterns of the column `votes` (arrays of `rules` numbers: 1 for, -1 against, 0
    abstains).

    Rules are taken as independent given the truth, and a vote as right with the rule's accuracy. Both truths are
    equally likely beforehand: rules that vote one way only leave the balance open, and fitting it would let it
    outvote them. A rule that nothing contradicts keeps the accuracy 4/5 it starts with. There are at most 2 ** rules
    patterns, as each rule votes one way or abstains, and they are gathered into one row.
    """
    patterns = voted.groupBy(*by, "votes").agg(F.count(F.lit(1)).cast("double").alias("n"))
    one = patterns.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("p"))
    odds = "aggregate(zip_with(x.votes, m, (v, a) -> v * ln(a / (1D - a))), 0D, (s, y) -> s + y)"
    scored = f"transform(p, x -> named_struct('votes', x.votes, 'n', x.n, 'q', 1D / (1D + exp(-({odds})))))"
    total = lambda what: f"aggregate(s, 0D, (t, x) -> t + {what})"
    right = total("CASE x.votes[j] WHEN 1 THEN x.n * x.q WHEN -1 THEN x.n * (1D - x.q) ELSE 0D END")
    cast = total("CASE WHEN x.votes[j] <> 0 THEN x.n ELSE 0D END")
    fitted = f"transform(sequence(0, {rules - 1}), j -> greatest(0.05D, least(0.995D, ({right} + 4D) / ({cast} + 5D))))"
    step = f"transform(array({scored}), s -> {fitted})[0]"
    model = one.where("size(p) > 0").select(*by, "p", F.expr(f"aggregate(sequence(1, {ITERATIONS}), array_repeat(0.8D, {rules}), (m, i) -> {step})").alias("m"))
    return model.select(*by, F.col("m").alias("accuracy"), F.expr(scored).alias("patterns"))


def _start() -> tuple[list[list[float]], list[float]]:
    """Believed vote rates by class (good texts, then each kind of junk) and rule, and the classes' shares."""
    group = lambda rule: "kind" if rule in KINDS else "weak" if rule in WEAK else "for"
    rates = [[BELIEVED[group(r)][0] for r in RULES]] + [[BELIEVED[group(r)][1 if r == kind else 2] for r in RULES] for kind in KINDS]
    return rates, [GOOD] + [(1 - GOOD) / len(KINDS)] * len(KINDS)


def vote_model(voted: DataFrame, rounds: int = ROUNDS) -> tuple[list[list[float]], list[float]]:
    """(rates, shares) by expectation-maximisation over the patterns of `votes` (arrays of 1 for, -1 against, 0 abstains, by RULES): how often
    each rule votes in each class, and how large the classes are. Texts are good or of one of the kinds of junk; given that, rules
    are independent, and abstaining is as much evidence as voting. One class of all junk would not do: a text that is junk of
    one kind passes the rules for the others, which would speak for it.

    A round is one aggregate over the patterns, at most 2 ** len(RULES); the driver sees a row a class.
    """
    patterns = cut(voted.groupBy("votes").agg(F.count(F.lit(1)).cast("double").alias("n")).withColumn("cast", F.transform("votes", lambda v: F.abs(v).cast("double"))))
    believed, start = _start()
    rates, shares = [list(r) for r in believed], list(start)
    for _ in range(rounds):
        parts = patterns.select("n", "cast", F.posexplode(posterior(F.col("cast"), rates, shares)).alias("k", "q"))
        weight = F.col("n") * F.col("q")
        sums = parts.groupBy("k").agg(F.sum(weight).alias("w"), F.array(*(F.sum(weight * F.get("cast", F.lit(j))) for j in range(len(RULES)))).alias("cast")).collect()
        total = sum(r["w"] for r in sums)
        if not total:
            break
        for r in sums:
            k = r["k"]
            rates[k] = [(c + b * BELIEF) / (r["w"] + BELIEF) for c, b in zip(r["cast"], believed[k], strict=True)]
            if k:
                rates[k][k - 1] = max(rates[k][k - 1], OWN)
            shares[k] = (r["w"] + start[k] * BELIEF) / (total + BELIEF)
    return rates, shares


def posterior(cast: Column, rates: list[list[float]], shares: list[float]) -> Column:
    """Probabilities of the classes for an array of 1 for each rule that votes and 0 for each that abstains."""

    def log(rate: list[float], share: float) -> Column:
        step = F.zip_with(cast, F.lit([math.log(t) - math.log(1 - t) for t in rate]), lambda v, w: v * w)
        return F.aggregate(step, F.lit(math.log(share) + sum(math.log(1 - t) for t in rate)), lambda s, v: s + v)

    def even(logs: Column) -> Column:
        parts = lambda top: F.transform(logs, lambda v: F.exp(v - top))
        return let(parts(F.array_max(logs)), lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, x: s + x)))

    return let(F.array(*(log(r, p) for r, p in zip(rates, shares, strict=True))), even)


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_from: float = 0.5) -> DataFrame:
    """(id, counts, base_failed, quality, kept) for each row of `docs`.

    Rules vote on the counts or abstain, for a text or against it; the posterior probability that it is good, under a model fitted to all
    votes of the corpus (vote_model), replaces passing each. A rule that votes against many texts that others speak for is
    outvoted. `kept` needs the probability to be `keep_from` at least, and the base rule to be passed.

    Null or empty text: no words, fails the base rule. Texts below WINDOW words repeat none. Repeated rows and repeated or null ids:
    a row each. No rows: no rows. Extra columns are not read. Counts are of whole texts of any length.
    """
    counts = rule_features(docs, id_col=id_col, text_col=text_col)
    voted = cut(counts.withColumn("votes", F.array(*(F.expr(VOTES[r]) for r in RULES))))
    rates, shares = vote_model(voted)
    found = voted.select("votes").distinct().withColumn("quality", posterior(F.transform("votes", lambda v: F.abs(v).cast("double")), rates, shares)[0])
    failed = F.expr(BASE_FAILED)
    joined = voted.join(small(cut(found)), "votes")
    return joined.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("quality") >= keep_from)).alias("kept"), "quality"
    )


def sql() -> str:
    """DuckDB's form of the op4 query: the same counts and votes, and the fit unrolled over tables of rates by class and rule."""
    rates, shares = _start()
    rows = lambda values: ", ".join(f"({', '.join(map(repr, v))})" for v in values)
    believed = f"believed(k, j, t) AS (VALUES {rows((k, j, t) for k, r in enumerate(rates) for j, t in enumerate(r))}), start(k, p) AS (VALUES {rows(enumerate(shares))})"
    steps = ["t0 AS (SELECT k, j, t::DOUBLE AS t FROM believed), p0 AS (SELECT k, p::DOUBLE AS p FROM start)"]
    scored = """SELECT i, k, n, exp(l - max(l) OVER (PARTITION BY i)) / sum(exp(l - m)) OVER (PARTITION BY i) AS q FROM (
  SELECT *, max(l) OVER (PARTITION BY i) AS m FROM (SELECT c.i, t.k, any_value(c.n) AS n, ln(any_value(p.p)) + sum(CASE WHEN c.voted THEN ln(t.t) ELSE ln(1 - t.t) END) AS l FROM cast_ c JOIN t{0} t USING (j) JOIN p{0} p ON p.k = t.k GROUP BY c.i, t.k))"""
    for s in range(ROUNDS):
        steps.append(f"""q{s} AS MATERIALIZED ({scored.format(s)}),
t{s + 1} AS MATERIALIZED (SELECT b.k, b.j, greatest(CASE WHEN b.k = b.j + 1 THEN {OWN} ELSE 0.0 END::DOUBLE, (sum(CASE WHEN c.voted THEN q.n * q.q ELSE 0 END) + any_value(b.t) * {BELIEF}) / (sum(q.n * q.q) + {BELIEF})) AS t FROM q{s} q JOIN cast_ c USING (i) JOIN believed b ON b.k = q.k AND b.j = c.j GROUP BY b.k, b.j),
p{s + 1} AS MATERIALIZED (SELECT q.k, (sum(q.n * q.q) + any_value(s.p) * {BELIEF}) / ((SELECT sum(n) FROM patterns) + {BELIEF}) AS p FROM q{s} q JOIN start s USING (k) GROUP BY q.k)""")
    names = [f"v{i}" for i in range(len(RULES))]
    word, blank = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"
    return rf"""
WITH w AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents
), g AS (
  SELECT r, i, list_slice(ws, i, i + 7) AS win FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 6, 1))) AS i FROM w)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM g) WHERE n > 1
), again AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY r
), f AS MATERIALIZED (
  SELECT doc_id, len(ws)::BIGINT AS n_words, (length(t) - len(regexp_extract_all(t, '{blank}')))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(again.n, 0)::BIGINT AS n_repeat_words, len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_same, len(ls) AS n_lines, len(regexp_extract_all(t, '\p{{Lu}}')) AS n_upper,
    len(regexp_extract_all(t, '!')) AS n_marks, len(regexp_extract_all(t, '[.?!](?:[\x20\x09-\x0D]|$)')) AS n_stops FROM w LEFT JOIN again USING (r)
), votes AS MATERIALIZED (SELECT *, {", ".join(f"{VOTES[r]} AS {v}" for r, v in zip(RULES, names, strict=True))} FROM f
), patterns AS MATERIALIZED (SELECT *, row_number() OVER () AS i FROM (SELECT {", ".join(names)}, count(*)::DOUBLE AS n FROM votes GROUP BY ALL)
), cast_ AS MATERIALIZED ({" UNION ALL ".join(f"SELECT i, n, {j} AS j, {v} <> 0 AS voted FROM patterns" for j, v in enumerate(names))}
), {believed}, {", ".join(steps)}, last AS MATERIALIZED ({scored.format(ROUNDS)})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE_FAILED}) AS base_failed, NOT ({BASE_FAILED}) AND q >= 0.5 AS kept
FROM votes JOIN patterns USING ({", ".join(names)}) JOIN last ON last.i = patterns.i AND last.k = 0
"""
