from collections import Counter

import numpy as np
import pyarrow as pa

import corpus_pipeline
from palimpsest.llm import jaccard, simhash
from palimpsest.llm.exact_dedup import quotient_bitmap


def brute_kept(rows, width=5, floor=0.8):
    sets = [set(simhash.shingles((t or "").encode(), width)) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            union = len(sets[i]) + len(sets[j]) - both
            if (both >= floor * union - 1e-9) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    least = {}
    for (i, _), x in zip(rows, label):
        least[x] = min(least.get(x, i), i)
    return sorted(i for (i, _), x in zip(rows, label) if least[x] == i)


def corpus():
    rng = np.random.default_rng(4)
    passage = [f"p{k}" for k in range(40)]
    rows = []
    for family in range(12):
        base = [f"w{k}" for k in rng.integers(0, 5000, int(rng.integers(60, 300)))]
        rows.append(base)
        for _ in range(6):
            copy = list(base)
            for at in rng.integers(0, len(base), int(rng.integers(1, 1 + len(base) // 30))):
                copy[at] = f"x{rng.integers(0, 5000)}"
            rows.append(copy)
    rows += [passage + [f"w{k}" for k in rng.integers(0, 5000, 30)] for _ in range(30)]
    rows += [passage + [f"z{i}"] for i in range(6)] + [["one"], ["One"], [], []]
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def test_every_pair_at_the_floor_links(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect())
    assert kept == brute_kept(rows)


def test_any_order_loses_nothing(spark, monkeypatch):
    # a full table of counts tells no shingle from another
    monkeypatch.setattr(jaccard, "shingle_levels", lambda texts, width: np.ones(jaccard.SLOTS, dtype=np.uint8))
    rows = corpus()
    kept = sorted(r.doc_id for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == brute_kept(rows)


def test_null_ids_clashing_names_and_repeats(spark):
    words = " ".join(f"w{k}" for k in range(40))
    rows = [(None, words), (7, words + " end"), (5, words), (5, words), (None, "alone"), (9, None), (8, "")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, node long, _drop_id long")
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(str((r.doc_id, len(r.text or ""))) for r in kept.collect()) == sorted(str(x) for x in [(5, len(words)), (5, len(words)), (None, 5), (8, 0)])
    assert simhash.near_dedup(docs.limit(0)).collect() == []


def test_a_full_table_ships_only_shared_shingles(spark):
    # a full table of levels tells nothing; the heads do
    rng = np.random.default_rng(5)
    rows = [" ".join(f"u{k}" for k in rng.integers(0, 1 << 40, 200)) for _ in range(60)]
    passage = " ".join(f"p{k}" for k in range(40))
    texts = spark.createDataFrame([(t,) for t in [*rows, *[f"{r[:60]} {passage}" for r in rows[:20]], passage]], "text string").repartition(3)
    context, full = spark.sparkContext, np.ones(jaccard.SLOTS, dtype=np.uint8)
    held = context.broadcast(full)
    heads = jaccard.repeated(texts, held, 5, 0.8)
    prefix = lambda t: jaccard._prefix(*[h for _, _, h in jaccard._sets(pa.array([t]), 5)], full, 0.8)[0].tolist()
    times = Counter(h for (t,) in texts.collect() for h in prefix(t))
    want = {h for h, n in times.items() if n > 1}
    assert want and {int(np.int64(r.fp).view(np.uint64)) >> 16 for r in heads.collect()} == {h >> 16 for h in want}
    shared = context.broadcast(quotient_bitmap(heads))
    sent = sum(len(r.shingle) for r in jaccard.shipped(texts, held, shared, 5, 0.8).collect())
    assert sum(times[h] for h in want) <= sent < sum(times.values()) / 4
    got = Counter(int(np.int64(r.shingle).view(np.uint64)) for r in jaccard.prefixes(texts, full, 5, 0.8).collect())
    assert got == {h: times[h] for h in want}


def test_a_round_without_new_links_runs_nothing_more(spark, monkeypatch):
    calls = Counter()
    for module, name in ((simhash, "components"), (jaccard, "verified")):
        monkeypatch.setattr(module, name, lambda *a, f=getattr(module, name), n=name: calls.update([n]) or f(*a))
    words = " ".join(f"w{k}" for k in range(60))
    rows = [(i, f"{words} end{i}") for i in range(4)] + [(9, " ".join(f"v{k}" for k in range(60)))]
    kept = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 9] and calls == {"components": 1, "verified": 1}


def met_pairs(monkeypatch):
    met = []
    monkeypatch.setattr(jaccard, "verified", lambda pairs, *a, f=jaccard.verified: met.append(pairs.count()) or f(pairs, *a))
    return met


def star_of_copies(n, changed=3, words=150):
    # each is similar enough to the first text, and to no other
    rng = np.random.default_rng(6)
    base = [f"w{k}" for k in range(words)]
    rows = [base]
    for i in range(n):
        copy = list(base)
        for k, at in enumerate(rng.choice(words // 10, changed, replace=False)):
            copy[10 * at + 5] = f"x{i}-{k}"
        rows.append(copy)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def test_a_family_around_one_text_meets_few_pairs(spark, monkeypatch):
    met, rows = met_pairs(monkeypatch), star_of_copies(120)
    kept = sorted(r.doc_id for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert kept == brute_kept(rows) == [0]
    assert sum(met) < 4 * len(rows)


def test_further_rounds_lose_nothing(spark, monkeypatch):
    # with no meeting allowed, rounds follow as long as they halve what is left; families without their centre meet in full
    turns = []
    monkeypatch.setattr(jaccard, "MEETINGS", 0)
    monkeypatch.setattr(jaccard, "starred", lambda *a, f=jaccard.starred: turns.append(a[2]) or f(*a))
    rows = corpus() + [(i + 1000, t) for i, t in star_of_copies(30, 2)[1:]]
    kept = sorted(r.doc_id for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert kept == brute_kept(rows)
    assert turns[:2] == [0, 1] and turns == list(range(len(turns)))


def test_rows_that_no_size_lets_pair_go(spark):
    rng = np.random.default_rng(7)
    rows = [(s, 1000 * s + k, int(n), int(rng.integers(0, jaccard.prefix_length(int(n), 0.8)))) for s in range(40) for k, n in enumerate(rng.choice([20, 25, 40, 50, 64, 80, 100, 125, 146], int(rng.integers(1, 8))))]
    all_rows = spark.createDataFrame(rows, "shingle long, node long, n int, place int")
    left = {(r.shingle, r.node) for r in jaccard.reaching(all_rows, 0.8).collect()}
    assert jaccard.reaching(all_rows, 0.8).columns == all_rows.columns
    can = lambda m, i, n, j: 1.8 * min(m - i, n - j) >= 0.8 * (m + n) - 1e-9
    needed = {(s, a) for s, a, m, i in rows if any(s == t and a != b and can(m, i, n, j) for t, b, n, j in rows)}
    assert needed and needed <= left and len(left) < len(rows)
