import random

from palimpsest.operators import maintenance


def test_rate_limit_carries_state_over_batches(spark):
    rng = random.Random(1)
    hits = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(2000), i) for i in range(900)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r.i: r.accepted for r in maintenance.accepted(spark.createDataFrame(hits, "who string, second int, i int"), "who", "second", 3, 60).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, kept = {}, {}
    for who, t, i in sorted(hits, key=lambda h: (h[1], h[2])):
        recent = [x for x in kept.get(who, []) if x > t - 60]
        want[i] = len(recent) < 3
        kept[who] = [*recent, t] if want[i] else recent
    assert got == want and {True, False} == set(want.values())


def test_interleaved(spark):
    rng = random.Random(2)
    base = [(act, k, n) for act in "xy" for n, k in enumerate(sorted(rng.sample(range(100), 30)), 1)]
    extra = [(act, rng.randrange(110)) for act in "xyz" for _ in range(40)]
    got = {(r.act, r.k): r.place for r in maintenance.interleaved(spark.createDataFrame(base, "act string, k int, o int"), spark.createDataFrame(extra, "act string, k int"), "act", "k", "o").collect()}
    for act, k in extra:
        mine = [(n, q) for a, q, n in base if a == act]
        later = [n for n, q in mine if q > k]
        assert got[act, k] == (min(later) if later else max((n for n, _ in mine), default=0) + 1)
    assert len(got) == len(set(extra))
