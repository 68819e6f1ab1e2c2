import difflib
import random

from pyspark.sql import functions as F

from palimpsest.operators import twins

SCHEMA = "tree string, location string, parent string, kind string, pos int, heading string, text string"


def ratio(a, b):
    return difflib.SequenceMatcher(None, a.split(), b.split(), autojunk=False).ratio()


def brute(children, up_a, up_b, a_tree, b_tree, floor, depth=0):
    """The recursive version: (pairs, unpaired) below a pair of nodes."""
    left, right = children.get((a_tree, up_a), []), children.get((b_tree, up_b), [])
    if depth and not (left and right):
        return [], []
    scores = {(x[1], y[1]): r for x in left for y in right if x[3] == y[3] and (r := ratio(x[6] or "", y[6] or "")) >= floor}
    best_a = {a: min((-r, y) for (x, y), r in scores.items() if x == a) for a, _ in scores}
    best_b = {b: min((-r, x) for (x, y), r in scores.items() if y == b) for _, b in scores}
    pairs = [(depth, a, b, round(-r, 9)) for a, (r, b) in best_a.items() if best_b[b][1] == a]
    done_a, done_b = {p[1] for p in pairs}, {p[2] for p in pairs}
    alone = [(depth, "a", x[1], *((best_a[x[1]][1], round(-best_a[x[1]][0], 9)) if x[1] in best_a else (None, None))) for x in left if x[1] not in done_a]
    alone += [(depth, "b", y[1], *((best_b[y[1]][1], round(-best_b[y[1]][0], 9)) if y[1] in best_b else (None, None))) for y in right if y[1] not in done_b]
    for _, a, b, _ in list(pairs):
        more, rest = brute(children, a, b, a_tree, b_tree, floor, depth + 1)
        pairs += more
        alone += rest
    return pairs, alone


def made(rnd, tree, texts, twist):
    """A tree of three levels, whose nodes repeat, drop or change words of ``texts``."""
    rows, pos = [], 0

    def changed(t):
        w = t.split()
        for _ in range(rnd.choice([0, 0, 0, 1, 1, 2]) if twist else 0):
            if w:
                w[rnd.randrange(len(w))] = rnd.choice(["x", "y", "the"])
        return " ".join(w)

    order = list(range(len(texts)))
    if twist:
        rnd.shuffle(order)
    for n, i in enumerate(order):
        top = f"{rnd.choice(['AR', 'AR', 'AN']) if not twist else 'AR'} {n}"
        kids = [[changed(s) for s in p] for p in texts[i]]
        rows.append((tree, top, None, top[:2], pos, f" Head {i}. ", " ".join(s for p in kids for s in p)))
        for j, p in enumerate(kids):
            par = f"{top} PA {j}"
            rows.append((tree, par, top, "PA", pos + j + 1, None, "  ".join(p)))
            rows += [(tree, f"{par} ALN {k}", par, "ALN" if k else "TXT", pos + j + k + 2, None, s) for k, s in enumerate(p)]
        pos += 50
    return rows


def test_against_the_recursive_version(spark):
    rnd = random.Random(11)
    pool = [f"w{i}" for i in range(60)]
    texts = [[[" ".join(rnd.choices(pool, k=rnd.choice([1, 3, 12, 25]))) for _ in range(rnd.choice([1, 2, 4]))] for _ in range(rnd.choice([0, 1, 3]))] for _ in range(12)]
    texts += texts[:3] + [[["same line here"] * 5, ["same line here", ""]]]
    rows = made(rnd, "A", texts, False) + made(rnd, "B", texts, True) + made(rnd, "C", texts[:4], True)
    nodes = spark.createDataFrame(rows, SCHEMA)
    trees = spark.createDataFrame([("A", "B"), ("A", "C"), ("A", "nowhere")], "a_tree string, b_tree string")
    pairs, unpaired = twins.aligned(nodes, trees)
    children = {}
    for r in rows:
        children.setdefault((r[0], r[2]), []).append(r)
    got_pairs, got_alone = pairs.collect(), unpaired.collect()
    for b_tree in ("B", "C"):
        want_pairs, want_alone = brute(children, None, None, "A", b_tree, 0.9)
        assert sorted((r.depth, r.a, r.b, round(r.ratio, 9)) for r in got_pairs if r.b_tree == b_tree) == sorted(want_pairs)
        mine = [(r.depth, r.side, r.location, r.best, None if r.ratio is None else round(r.ratio, 9)) for r in got_alone if r.b_tree == b_tree]
        assert sorted(mine, key=str) == sorted(want_alone, key=str)
    assert {r.depth for r in got_pairs} == {0, 1, 2} and any(r.best for r in got_alone)


def test_ties_and_descriptions(spark):
    t = " ".join(f"w{i}" for i in range(20))
    rows = [("A", "AR 1", None, "AR", 0, "Scope.", t + " Article 5"), ("A", "AN I", None, "AN", 1, None, t)]
    rows += [("B", "AR 5", None, "AR", 0, "scope", t + " Article 6"), ("B", "AR 10", None, "AR", 1, "Scope:", t + "  Article 6"), ("B", "AR 10", None, "AR", 2, "late", "other")]
    nodes = spark.createDataFrame(rows, SCHEMA)
    trees = spark.createDataFrame([("A", "B")] * 2, "a_tree string, b_tree string")
    pairs, unpaired = twins.aligned(nodes, trees)
    got = twins.described(pairs, nodes).select("a", "b", "ratio", "identical", "numbering_only", "headings_equal").collect()
    assert [tuple(r) for r in got] == [("AR 1", "AR 10", 0.955, False, True, True)]
    assert {(r.side, r.location, r.best) for r in unpaired.collect()} == {("a", "AN I", None), ("b", "AR 5", "AR 1")}


def test_no_rows(spark):
    nodes = spark.createDataFrame([], SCHEMA)
    pairs, unpaired = twins.aligned(nodes, nodes.select(F.col("tree").alias("a_tree"), F.col("tree").alias("b_tree")))
    assert pairs.count() == 0 and unpaired.count() == 0
