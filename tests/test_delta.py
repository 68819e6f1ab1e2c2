from palimpsest.operators import pairing, signals, versions


def nodes(spark, rows):
    return spark.createDataFrame([("x", loc, pos, text) for pos, (loc, text) in enumerate(rows)], "act string, location string, pos int, text string")


def test_toy_versions(spark):
    before = nodes(spark, [("AR 1", "same"), ("AR 2", "old"), ("AR 3", "goes"), ("AN I", "table"), ("AN II", None)])
    after = nodes(spark, [("AR 1", " same "), ("AR 2", "new"), ("AR 4", "comes"), ("AN I", "table x"), ("AN II", "")])
    delta = versions.with_renumbered(versions.diff_units(before, after))
    kinds = {r.location: r.change_type for r in delta.collect()}
    assert kinds == {"AR 1": "unchanged", "AR 2": "modified", "AR 3": "deleted", "AR 4": "inserted", "AN I": "modified", "AN II": "modified"}
    order = [r.location for r in versions.emission_order(delta).orderBy("ord").collect()]
    assert order == ["AR 1", "AR 2", "AR 3", "AR 4", "AN I", "AN II"]


def test_white_space_and_repeats(spark):
    before = nodes(spark, [("A", "x\u001cy"), ("B", "1"), ("B", "2")])
    after = nodes(spark, [("A", "x y"), ("B", "2")])
    found = {r.location: (r.change_type, r.whitespace_only) for r in versions.diff_units(before, after).collect()}
    assert found == {"A": ("unchanged", True), "B": ("unchanged", False)}


def test_renumbering_pairs_kth_with_kth(spark):
    before = nodes(spark, [("A 1", "t"), ("A 2", "t"), ("A 3", "u")])
    after = nodes(spark, [("B 1", "t"), ("B 2", "t"), ("B 3", "v")])
    pairs = {(r.old_location, r.new_location) for r in versions.renumberings(versions.diff_units(before, after)).collect()}
    assert pairs == {("A 1", "B 1"), ("A 2", "B 2")}


def test_signals_silence_is_not_unavailable(spark):
    diff = spark.createDataFrame([("x", 1, "modified"), ("x", 2, "modified"), ("y", 3, "deleted")], "act string, unit int, diff_kind string")
    claims = spark.createDataFrame([("x", 1, "inserted"), ("x", 9, "modified")], "act string, unit int, claimed_kind string")
    rows = signals.disputed(signals.merged(diff, claims, claims))
    found = {r.unit: (r.claim_status, r.disputed, r.reason) for r in rows.collect()}
    assert found == {1: ("observed", True, "kind"), 2: ("absent", True, "silent"), 9: ("observed", True, "textless"), 3: ("unavailable", False, None)}
    figures = {r.act: r for r in signals.agreement(rows, "act").collect()}
    assert figures["y"].recall == 1.0 and figures["x"].n_kind_mismatch == 1 and figures["x"].precision == 0.5


def test_consecutive_and_sample(spark):
    v = spark.createDataFrame([("x", i, i != 3) for i in range(1, 6)], "act string, v int, readable boolean")
    pairs = {(r.from_version, r.to_version, r.bridged) for r in pairing.consecutive(v, "act", "v", ["v"], v.readable).collect()}
    assert pairs == {(1, 2, 0), (2, 4, 1), (4, 5, 0)}
    rows = spark.createDataFrame([("x", i) for i in range(10)] + [("y", 0)], "g string, i int")
    found = {(r.g, r.i) for r in pairing.evenly_spaced(rows, "g", ["i"], 4).collect()}
    assert found == {("x", 0), ("x", 3), ("x", 6), ("x", 9), ("y", 0)}
