from collections import defaultdict

from urban_spark.llm.lines import line_dedup

SCHEMA = "doc_id long, text string, source string, n_lines int, extra string"


def brute(rows, sites):
    places = defaultdict(set)
    for i, text, site, *_ in rows:
        for pos, line in enumerate((text or "").split("\n") if text is not None else []):
            if len(line.split()) >= 3:
                places[line.strip(" \t\r")].add((i is not None, i, text, pos, site))
    gone = set()
    for found in places.values():
        if len({p[-1] for p in found if p[-1] is not None}) >= sites:
            first = min(p[1:4] for p in found)
            gone |= {(p[1], p[2], p[3]) for p in found if p[1:4] != first}
    return {(i, text): None if text is None else "\n".join(x for p, x in enumerate(text.split("\n")) if (i, text, p) not in gone) for i, text, *_ in rows}


def test_same_as_brute_force(spark):
    common, rare = "read our cookie notice", "seen on two sites"
    rows = [(i, f"own line number {i}\n {common} \nx\n{rare if i < 2 else 'y'}", f"s{i % 6}", 7, "e") for i in range(12)]
    rows += [(50, common, "s0", 7, None), (51, common, None, 7, None), (52, "", "s1", 7, None), (53, None, "s2", 7, None), (54, "\n\n", None, None, None)]
    out = line_dedup(spark.createDataFrame(rows, SCHEMA), min_sites=4)
    assert sorted(out.columns) == sorted(["doc_id", "text", "source", "extra", "n_lines", "n_removed"])
    want = brute(rows, 4)
    got = {(r.doc_id, t): r.text for r, (_, t, *_rest) in zip(sorted(out.collect(), key=lambda r: r.doc_id), sorted(rows), strict=True)}
    assert got == want
    assert got[0, rows[0][1]] == rows[0][1] and common not in got[1, rows[1][1]] and rare in got[1, rows[1][1]]
    assert got[50, common] == ""


def test_threshold_is_exact_and_long_texts_are_whole(spark):
    for sites in range(9, 12):
        rows = [(i, "a b c\n" * 300 + f"tail {i}", f"s{i}", 0, None) for i in range(sites)]
        out = {r.doc_id: r for r in line_dedup(spark.createDataFrame(rows, SCHEMA), min_sites=10).collect()}
        assert all(r.n_lines == 301 for r in out.values())
        assert {i: r.n_removed for i, r in out.items()} == {i: 0 if sites < 10 else 299 if i == 0 else 300 for i in range(sites)}


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "one two three", f"s{i}", 0, None) for i in range(5)] + [(2, "one two three", "s9", 0, None), (None, "one two three", "s8", 0, None)]
    out = line_dedup(spark.createDataFrame(rows, SCHEMA), min_sites=4).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in out) == [(False, 1, 1)] * 5 + [(False, 2, 1), (True, 0, 0)]
    assert line_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
