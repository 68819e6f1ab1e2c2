import re

import numpy as np
import pytest

from palimpsest.llm import mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    target, capped, total = {}, set(), 1.5 * sum(sizes.values())
    while True:
        free = total - sum(2 * sizes[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        over = {s for s in open_ if free * weight[s] / sum(weight[o] for o in open_) > 2 * sizes[s]}
        if not over:
            target = {s: 2.0 * sizes[s] if s in capped else free * weight[s] / sum(weight[o] for o in open_) for s in order}
            return target
        capped |= over


def test_targets_and_takes(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        source = ["a", "b", "Z", "é", None, "hot"][min(5, int(rng.integers(0, 12)))]
        rows.append((i, " ".join(["w"] * int(rng.integers(0, 300))), source))
    rows += [(600, None, "a"), (601, "x " * 60_000, "hot"), (5, rows[5][1], rows[5][2]), (None, "one two", "b"), (602, "", "empty")]
    df = spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], "doc_id long, text string, source string, size int").repartition(4)
    found = mixing.takes(df).collect()
    again = mixing.takes(df.repartition(2)).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.taken)
    assert sorted(map(key, found)) == sorted(map(key, again)) and len(found) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = brute_targets(sizes)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
    for s in sizes:
        assert abs(sum(r.taken for r in found if r.source == s) - want[s]) <= 2 * mixing.BLOCK_WORDS


def test_mix_keeps_columns(spark):
    df = spark.createDataFrame([(i, "a b c", f"s{i % 2}", i) for i in range(50)], "doc_id long, text string, source string, n_chars long")
    df = df.selectExpr("*", "1 AS _copies", "2 AS _copy", "3 AS slot")
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and 0 < mixed.count() <= 100
    assert mixing.takes(df.limit(0)).collect() == [] and mixing.mix(df.limit(0)).collect() == []


def test_points_are_spread(spark):
    u = np.sort(np.array([r.u for r in spark.range(4096).select(mixing.point(__import__("pyspark").sql.functions.col("id")).alias("u")).collect()]))
    assert np.abs(u - (np.arange(4096) + 0.5) / 4096).max() < 4 / 4096


def test_small_sources_get_their_target(spark):
    rows = [(i, "w " * 5000, "hot") for i in range(100)]
    rows += [(1000 + i, "w " * (3 + 7 * i), f"small{i:02}") for i in range(30)]
    found = mixing.takes(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in {s for _, _, s in rows}:
        mine = [r for r in found if r.source == s]
        assert sum(r.taken for r in mine) == pytest.approx(mine[0].target, abs=1), s


def test_the_schedule_decides(spark):
    rows = [(i, "w " * 640, "abc"[i % 3]) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = brute_targets({s: 30 * 640 for s in "abc"})
    need = {k: -(-int(want[s] + 1e-6) // mixing.BLOCK_WORDS) for k, s in enumerate("abc")}
    total, points, slot = sum(need.values()), {k: [] for k in need}, 0
    bounds = np.cumsum([need[k] for k in need]) / total
    while any(len(points[k]) < need[k] for k in need):  # brute force: points through the cumulative needs, ranked by source
        points[int(np.searchsorted(bounds, slot * 0.6180339887498949 % 1, side="right"))].append(slot)
        slot += 1
    found = mixing.scheduled(df).collect()
    assert {(r.sid, r.block, r.slot) for r in found} == {(k, b, s) for k in need for b, s in enumerate(points[k][: need[k]])}
    # any stretch of the mix has the sources near their weights
    order = [r.sid for r in sorted(found, key=lambda r: r.slot)]
    for end in range(50, len(order), 25):
        for k in need:
            assert abs(order[:end].count(k) / end - need[k] / total) < 0.08
    firsts = {r.doc_id: r.first_slot for r in mixing.takes(df).collect() if r.first_slot is not None}
    assert firsts == {i: min(r.slot for r in found if r.doc_id == i and r.turn == 0) for i in firsts}
    mixed = [r.doc_id for r in mixing.mix(df).coalesce(1).collect()]
    seen = list(dict.fromkeys(mixed))
    assert seen == sorted(seen, key=firsts.get) and len({i % 3 for i in seen[:6]}) > 1


def test_blocks_are_never_broadcast(spark):
    # few and long rows: what they are cut into is far larger than they are
    df = spark.createDataFrame([(i, "w " * 5000, "ab"[i % 2]) for i in range(20)], "doc_id long, text string, source string")
    streamed, wanted, _ = mixing._streams(df, "doc_id", "text", "source")
    plan = mixing._blocks(streamed, wanted)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin[^\n]*\[sid#\d+L?, block#", plan) and not re.search(r"BroadcastHashJoin[^\n]*\[sid#\d+L?, block#", plan)
