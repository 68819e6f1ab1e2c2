import pytest
from pyspark.sql import functions as F

from palimpsest.operators import memo, similarity
from palimpsest.sources import snapshots


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def table(spark, *values):
    return spark.createDataFrame([(v, f"t{v}") for v in values], "k int, v string")


def test_tables_switch_together(spark, tmp_path):
    base = f"file://{tmp_path}/s"
    assert snapshots.current(spark, base) == (0, {})
    assert snapshots.publish(spark, base, {"acts": table(spark, 1, 2), "root": table(spark, 9)}) == 1
    assert snapshots.publish(spark, base, {"root": table(spark, 8)}, {"acts": table(spark, 3)}) == 2
    assert rows(snapshots.read(spark, base, "acts")) == [(1, "t1"), (2, "t2"), (3, "t3")] and rows(snapshots.read(spark, base, "root")) == [(8, "t8")]
    assert rows(snapshots.read(spark, base, "root", 1)) == [(9, "t9")]
    with pytest.raises(KeyError):
        snapshots.read(spark, base, "none")


def test_a_stopped_run_leaves_the_old_state(spark, tmp_path):
    base = f"file://{tmp_path}/s"
    snapshots.publish(spark, base, {"acts": table(spark, 1), "root": table(spark, 1)})
    broken = table(spark, 2).withColumn("v", F.raise_error(F.lit("stop")))
    with pytest.raises(Exception, match="stop"):
        snapshots.publish(spark, base, {"acts": table(spark, 2), "root": broken})
    assert snapshots.current(spark, base)[0] == 1 and rows(snapshots.read(spark, base, "acts")) == [(1, "t1")]
    assert len(snapshots.swept(spark, base)) == 2  # the parts of the run that stopped
    assert rows(snapshots.read(spark, base, "root")) == [(1, "t1")]


def test_of_two_writers_one_wins(spark, tmp_path, monkeypatch):
    base = f"file://{tmp_path}/s"
    snapshots.publish(spark, base, {"a": table(spark, 1)})
    with pytest.raises(snapshots.Conflict):
        snapshots.publish(spark, base, {"a": table(spark, 2)}, after=0)
    seen = snapshots.current(spark, base)
    snapshots.publish(spark, base, {"a": table(spark, 3)})
    monkeypatch.setattr(snapshots, "current", lambda *_: seen)  # read before the other published
    with pytest.raises(snapshots.Conflict):
        snapshots.publish(spark, base, {"a": table(spark, 4)})
    monkeypatch.undo()
    assert rows(snapshots.read(spark, base, "a")) == [(3, "t3")]
    assert snapshots.swept(spark, base, keep=1) and rows(snapshots.read(spark, base, "a")) == [(3, "t3")]


def test_a_pair_is_compared_once(spark, tmp_path):
    base, asked = f"file://{tmp_path}/m", []

    def compute(missing):
        asked.append(missing.count())
        return missing.select("key", similarity.word_ratio("before", "after").alias("ratio"))

    pairs = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("ab", "c"), ("x y", "x z"), ("", "a")], "before string, after string")
    store, computed, reused = memo.refreshed(spark, base, pairs, "1", compute)
    assert (computed, reused, store.count(), asked) == (4, 0, 4, [4])
    store, computed, reused = memo.refreshed(spark, base, pairs.unionByName(spark.createDataFrame([("n", "n")], pairs.schema)), "1", compute)
    assert (computed, reused, store.count(), asked) == (1, 4, 5, [4, 1])
    assert memo.refreshed(spark, base, pairs, "1", compute)[1:] == (0, 4) and asked == [4, 1]
    assert memo.refreshed(spark, base, pairs, "2", compute)[1:] == (4, 0)
    assert snapshots.current(spark, base)[0] == 3
    assert memo.refreshed(spark, f"{base}x", pairs.limit(0), "1", compute)[1:] == (0, 0)
