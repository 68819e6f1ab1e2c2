import difflib

import numpy as np

from palimpsest.operators import similarity
from palimpsest.plans.texts import twins


def brute(rows, floor=0.9):
    pools = {}
    for i, source, text in rows:
        key = (text, source)
        pools[key] = min(pools.get(key, i), i)
    pools = [(i, source, text) for (text, source), i in pools.items()]
    scored = {}
    for i, s, a in pools:
        for j, t, b in pools:
            if i < j and s != t:
                ratio = difflib.SequenceMatcher(None, a.split(), b.split(), autojunk=False).ratio()
                if ratio >= floor:
                    scored[i, j] = ratio
    best_right = {i: min((-r, j) for (x, j), r in scored.items() if x == i)[1] for i, _ in scored}
    best_left = {j: min((-r, i) for (i, x), r in scored.items() if x == j)[1] for _, j in scored}
    return {(i, j, round(r, 9)) for (i, j), r in scored.items() if best_right[i] == j and best_left[j] == i}


def corpus():
    rng = np.random.default_rng(5)
    rows = []
    for family, n in enumerate([5, 9, 10, 11, 19, 20, 21, 40, 80, 120]):
        base = [f"w{k}" for k in rng.integers(0, 40, n)]
        for _ in range(14):
            copy = list(base)
            for _ in range(int(rng.integers(0, 2 + n // 12))):
                at = int(rng.integers(0, len(copy)))
                kind = int(rng.integers(0, 3))
                copy[at : at + (kind != 0)] = [f"x{rng.integers(0, 9)}"] if kind != 1 else []
            rows.append(" ".join(copy))
    rows += ["same text in three sources"] * 4 + ["one", "one", "", ""]
    # a passage that more than two hundred texts share, and a family of as many
    passage = " ".join(f"p{k}" for k in range(40))
    rows += [f"{passage} z{k}" for k in range(230)]
    return [(i, f"s{i % 3}", text) for i, text in enumerate(rows)]


def test_every_twin_is_found(spark):
    rows = corpus()
    found = twins(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    want = brute(rows)
    assert {(r.left, r.right, round(r.ratio, 9)) for r in found} == want
    assert len(want) > 10


def test_no_rows_and_nulls(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, "b", "x y"), (3, "b", None), (None, "c", "x y")], "doc_id long, source string, text string")
    assert twins(docs.limit(0)).collect() == []
    assert twins(docs).collect() == []


def test_texts_move_by_blocks_and_word_pairs_packed(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_PAIRS", 16)
    rows = corpus()
    nodes = spark.createDataFrame([(i, s, " ".join(t.split())) for i, s, t in rows], "row long, source string, t string").coalesce(1)
    pairs = similarity.candidates(nodes, "row", "source", "t", 0.9)
    found = {(r.left, r.right): round(r.ratio, 9) for r in similarity.paired_ratios(pairs, nodes, "row", "t", 0.9).collect()}
    want = {}
    for i, s, a in rows:
        for j, t, b in rows:
            if i < j and s != t and (ratio := difflib.SequenceMatcher(None, a.split(), b.split(), autojunk=False).ratio()) >= 0.9 and a.split():
                want[i, j] = round(ratio, 9)
    different = {p: r for p, r in want.items() if rows[p[0]][2] != rows[p[1]][2]}
    assert different.items() <= found.items() <= want.items() and len(different) > 100
    packed = similarity.prefixes(nodes, "row", "source", "t", 0.9)
    assert packed.count() <= 4  # a row for each bucket of one batch, not for each word pair
