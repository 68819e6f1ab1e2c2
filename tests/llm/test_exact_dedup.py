import re
from hashlib import sha256

from palimpsest.llm import exact_dedup

ROWS = [
    (1, "a b c"), (2, "abc"), (3, "a  b c"), (4, "A b c"), (5, None), (6, ""), (7, " \n\t"), (8, "é x"), (9, "éx"),
    (10, "long " * 50_000), (11, "long " * 50_000), (3, "a  b c"), (None, "a  b c"), (12, "solo"), (12, "solo"), (13, " q"),
]


def brute(rows):
    normal = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    out = []
    for (i, _), n in zip(rows, normal):
        same = [(-len(t or ""), k is None, k or 0, k) for (k, t), m in zip(rows, normal) if m == n]
        out.append((str(i), str(min(same)[3]), len(same), sha256(n.encode()).hexdigest()))
    return sorted(out)


def test_matches_brute_force(spark):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in ROWS], "doc_id long, text string, fp long, normal string").repartition(3)
    found = exact_dedup.assignments(df).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in found) == brute(ROWS)
    groups = {r.text_sha256 for r in found}
    assert sum(r.kept for r in found) == len(groups)
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_rows_that_stay(spark):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in ROWS], "doc_id long, text string, fp long, normal string").repartition(3)
    kept = exact_dedup.drop_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({x[1] for x in brute(ROWS)})


def test_filters_merge_losslessly(spark):
    fps = spark.createDataFrame([(x,) for x in [5, 5, -5, 1 << 62, -1, 5, -1, 6]], "fp long").repartition(3)
    merged = exact_dedup.merged_filters(exact_dedup.counting_filters(fps, 8))
    rows = {r.slot: (r.remainders, r.counts) for r in merged.collect()}
    assert rows[0] == ([5, 6], [3, 1]) and len(rows) == 3
    assert {r.fp: r.copies for r in exact_dedup.copies(merged, 8).collect()} == {5: 3, 6: 1, -5: 1, 1 << 62: 1, -1: 2}


def test_repeated_rows_with_other_columns(spark):
    rows = [(1, "a b", "x"), (1, "a b", "y"), (1, "ab", "z"), (None, "q", "x"), (None, "q", "y"), (2, None, None), (3, "", None)]
    kept = exact_dedup.drop_duplicates(spark.createDataFrame(rows, "doc_id long, text string, text_sha256 string")).collect()
    assert sorted(str((r.doc_id, r.text)) for r in kept) == ["(1, 'a b')", "(2, None)", "(None, 'q')"]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.assignments(df).collect() == [] and exact_dedup.drop_duplicates(df).collect() == []
