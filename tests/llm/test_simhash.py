import numpy as np
import xxhash

from palimpsest.llm import simhash


def brute(rows, width=3, radius=2):
    def fp(text):
        words = (text or "").encode().lower().split()
        parts = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
        hs = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = [fp(t) for _, t in rows]
    comp = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(fps[i] ^ fps[j]).count("1") <= radius:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    least = {}
    for c, (i, _) in zip(comp, rows):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return sorted((str(i), f, str(least.get(c))) for (i, _), f, c in zip(rows, fps, comp))


def got(df):
    return sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in df.collect())


def test_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in rng.integers(0, 50, 400)]
    rows = [(i, " ".join(base[: 390 + i % 10])) for i in range(12)]
    rows += [(20, None), (21, ""), (22, " \t\n"), (23, "One"), (24, "one"), (25, "a b"), (26, "x" * 100_000), (27, "É é"), (28, "é é"), (23, "One"), (None, "alone here now")]
    rows += [(100 + i, " ".join(f"v{k}" for k in rng.integers(0, 4, 6))) for i in range(40)]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, fp string")
    assert got(simhash.groups(df)) == brute(rows)
    assert simhash.groups(df.limit(0)).collect() == []


def test_tree_finds_all_links():
    rng = np.random.default_rng(2)
    near = np.uint64(7) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    values = np.unique(np.concatenate([near, rng.integers(0, 1 << 63, 300).astype(np.uint64)]))
    a, b = simhash.bk_links(values, 2)
    want = {(i, j) for i in range(len(values)) for j in range(i) if bin(int(values[i] ^ values[j])).count("1") <= 2}
    assert {(max(x, y), min(x, y)) for x, y in zip(a.tolist(), b.tolist())} == want


def test_shards_meet_and_are_cut_on(spark, monkeypatch):
    rng = np.random.default_rng(3)
    values = np.unique(np.uint64(5) ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)))
    fps = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    monkeypatch.setattr(simhash, "SHARD_ROWS", 4)
    edges = [(r.a, r.b) for r in simhash.links(fps, 2).collect()]
    parent = {int(v): int(v) for v in values.view(np.int64)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    left, right = simhash.bk_links(values, 2)
    label = simhash._stars(len(values), left, right)
    signed = values.view(np.int64)
    for i in range(len(values)):
        assert root(int(signed[i])) == root(int(signed[label[i]]))
    assert len({root(int(v)) for v in signed}) == len(set(label.tolist()))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (200, 200)], "a long, b long")
    found = {r.node: r.label for r in simhash.components(edges).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_trees_prune():
    rng = np.random.default_rng(7)
    values = np.unique(rng.integers(0, 1 << 63, simhash.SHARD_AIM).astype(np.uint64))
    work: list[int] = []
    simhash.bk_links(values, 2, work)
    assert sum(work) < 0.6 * len(values) ** 2
    assert len(work) > 10  # nodes were walked


def test_first_masks_keep_pairs_together():
    rng = np.random.default_rng(8)
    for rows in (1, 10_000, 1 << 40):
        masks = simhash.first_masks(2, rows)
        for _ in range(200):
            a = int(rng.integers(0, 1 << 62))
            b = a ^ (1 << int(rng.integers(0, 64))) ^ (1 << int(rng.integers(0, 64)))
            assert any(a & m == b & m for m in masks)
