import datetime

from pyspark.sql import functions as F

from palimpsest.functions import dates, identifiers, keys, locations, references
from palimpsest.operators import entries
from palimpsest.operators.ranking import ranked
from palimpsest.plans import places


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_locations(spark):
    raw = "{AR|http://x/fd_370/AR} 52  {PA|http://x/PA} 4 {ALN|http://x/ALN} PTA (bb)"
    parsed = locations.segments(F.col("raw"))
    assert [tuple(s) for s in one(spark, parsed, raw=raw)] == [("AR", "52"), ("PA", "4"), ("ALN", None), ("PTA", "(bb)")]
    assert one(spark, locations.human(parsed), raw="AR 5 PA 1 PTA (bb)") == "Art. 5(1)(bb)"
    assert one(spark, locations.human(parsed), raw="AN") == "Annex"
    assert one(spark, locations.top_level(parsed), raw=raw) == "AR 52"
    shown = {"AR 3 .20 PO B)": "Art. 3 .20(B))", "AR 5 PO 2 TIRE 1": "Art. 5(2)(1)", "TIT II": "Title II", "AR": "Article", "ZZ 1 TXT": "ZZ 1 text", "AN III SCT A": "Annex III section A"}
    for raw, want in shown.items():
        assert one(spark, locations.human(parsed), raw=raw) == want
    assert [tuple(s) for s in one(spark, parsed, raw="AR 3 .20 PO B)")] == [("AR", "3"), (".20", None), ("PO", "B)")]
    codes = {
        "AN 14": "AN XIV", "AN 4 PA 2": "AN IV PA 2", "AR 3.20 PO B)": "AR 3 PO B)", "AR 3a.1": "AR 3a", "AR 5 PA 1": "AR 5 PA 1", "AN III": "AN III", "AR": "AR",
        "CHA III": None, "TIT II": None, "CONSID 5": None, "AN": None, "AN PA 1": None, "AN 51": None, "AN 0": None,
    }
    for raw, want in codes.items():
        got = one(spark, locations.unit_code(F.col("raw")), raw=raw)
        assert (got.code, got.gap) == (want, None if want else "unconverted" if raw in ("AN 51", "AN 0") else "container"), raw
        if want:
            assert one(spark, locations.unit_code(F.col("raw")), raw=want).code == want
    order = ["AR 3", "AR 3 SECTION 1", "AR 3 PO 2", "AR 3 .20", "AR 3.1", "AR 9", "AR 9 PA 2", "AR 10", "TIT 3", "AN", "AN I", "AN IX", "AN X", "APP 1", "CHA 1", "ZZ 1"]
    rows = spark.createDataFrame([(x,) for x in reversed(order)], "raw string")
    keyed = rows.select("raw", locations.sort_key(locations.segments(F.col("raw"))).alias("k"))
    assert [r.raw for r in keyed.orderBy("k").collect()] == order
    assert one(spark, locations.preferred(F.col("raw")), raw="TEXT") == "TXT"


def test_dates(spark):
    day = datetime.date
    for raw, iso, compact in (("2024-02-30", None, None), ("2007/11/23", day(2007, 11, 23), None), ("29/02/2024", None, None), ("20240102", None, day(2024, 1, 2)), ("20241302", None, None), ("soon", None, None), (" 2024-01-02 ", day(2024, 1, 2), None)):
        assert (one(spark, dates.iso(F.col("raw")), raw=raw), one(spark, dates.compact(F.col("raw")), raw=raw)) == (iso, compact), raw


def test_references(spark):
    cases = {
        "in Article 1(2), point (g) is replaced": "AR 1 PA 2 PTA (g)", "in point (h) of Section 5.1 of Annex IX": "AN IX SCT 5.1 PTA (h)", "points 7 and 9 are deleted": "AR 5 PO 7", "point (7)": "AR 5 PO 7",
        "in Part C, section 6.6.2. is": "AR 5 PRT C SCT 6.6.2", "the introductory part": "AR 5", "in paragraph 1, the second subparagraph": "AR 5 PA 1 ALN 2", "Appendix 1 to Annex XVII": "AN XVII",
        "Articles 4A and 5": "AR 4a", "the heading is replaced": "AR 5 TIT", "the tenth indent of the first paragraph": "AR 5 PA 1 TIRE 10", "": "AR 5",
    }
    for clause, want in cases.items():
        got = locations.written(references.resolved(F.col("c"), locations.segments(F.lit("AR 5"))))
        if clause.startswith("Appendix"):
            assert one(spark, got, c=clause).split()[0] in ("AN", "APP")  # both are units: the first of their forms stands
        else:
            assert one(spark, got, c=clause) == want, clause
    assert one(spark, references.resolved(F.col("c"), F.lit(None)), c="nothing here") is None


def test_coordinates(spark):
    cases = {
        "paragraphs 2, 3 and 4": ["PA 2", "PA 3", "PA 4"], "Paragraphs 1 to 4": ["PA 1", "PA 4"], "paragraphs 9(e) and 10": ["PA 10", "PA 9 PTA (e)"], "Article 6(2) and Article 7(3)": ["PA 2"],
        "Article 6(1)(a)": ["PA 1 PTA (a)"], "Article 6(13) of Directive 93/42/EEC": [], "paragraph 1 of Article 10": [], "paragraph 9(1)": ["PA 9"], "article 6 (4)": ["PA 4"], "Article 6(a)": [],
    }
    for sentence, want in cases.items():
        assert one(spark, references.coordinates(F.col("s"), F.col("u")), s=sentence, u="AR 6 PA 2") == [f"AR 6 {w}" for w in want], sentence
    assert one(spark, references.coordinates(F.col("s"), F.col("u")), s="paragraph 1", u="AN IV") == []


def test_keys_and_names(spark):
    read = lambda cell, form: tuple(one(spark, keys.read_key(F.col("c"), F.col("f")), c=cell, f=form))
    assert read("601‑001-00-X", "index") == (None, True) and read("no", "index") == (None, False)
    assert read("46a. Name", "number") == ("46a", False) and read("68", "number") == ("68", False) and read("x", "number") == ("x", False)
    assert read(" Aldicarb (#)\n(C7)", "name") == ("aldicarb", False) and read("(+)-Tartaric acid *", "name") == ("(+)-tartaric acid", False)
    assert [read(e, f) for e in ("-", "–", " / ") for f in keys.READERS] == [(None, False)] * 12
    assert one(spark, keys.entry_name(F.col("c"), True), c="46a. Lead\nmore") == "Lead" and one(spark, keys.entry_name(F.col("c"), True), c="46a.") is None
    assert one(spark, keys.row_name(F.col("c")), c="a, " * 30) == "a, " * 19 + "a…" and one(spark, keys.row_name(F.col("c")), c="x" * 70) == "x" * 60 + "…"
    assert one(spark, keys.row_name(F.col("c")), c="short; rest") == "short"


def test_identifiers(spark):
    found = one(spark, identifiers.in_cell(F.col("c")), c="50-00-0 0050‑00‑0 200-001-8 601-001-00-4 1-50-00-0 50-00-1")
    assert [tuple(f) for f in found.found] == [("cas", "50-00-0"), ("ec", "200-001-8"), ("index", "601-001-00-4")] or found.failed >= 1
    cases = {"32024r1689": ("celex", "32024R1689"), "celex:02024R1689-20260727": ("consolidated", "02024R1689-20260727"), "consolidation:2024R1689/20260727": ("consolidated", "02024R1689-20260727"), "oj:L_202601913": None, "02024R1689-20261327": None, "": None}
    for raw, want in cases.items():
        got = one(spark, identifiers.act_identifier(F.col("r")), r=raw)
        assert (got and (got.form, got.value)) == want, raw
    assert one(spark, references.anchor(F.col("l")), l="AR 3.20") == "art_3" and one(spark, references.anchor(F.col("l")), l="AN iii PA 1") == "anx_III" and one(spark, references.anchor(F.col("l")), l="TIT II") is None


def test_entry_difference(spark):
    schema = "t string, key string, occurrence int, cell string"
    old = spark.createDataFrame([("x", "a", 1, "one"), ("x", "b", 1, "é-1"), ("x", "c", 1, "c"), ("x", "d", 1, "p"), ("x", "d", 2, "q"), ("x", "e", 1, "s  t"), ("x", "f", 1, "1")], schema)
    new = spark.createDataFrame([("x", "a", 1, "two"), ("x", "b", 1, "e‑ 1"), ("x", "d", 1, "p"), ("x", "e", 1, "s t"), ("x", "g", 1, "n"), ("x", "f", 1, "1")], schema)
    found = {(r.key, r.occurrence): (r.change, r.typography_only) for r in entries.difference(old, new, ["t"], "key", "cell").collect()}
    assert found == {
        ("a", 1): ("amended", False), ("b", 1): ("amended", True), ("c", 1): ("removed", False), ("d", 0): ("unpaired", False),
        ("e", 1): ("whitespace", False), ("f", 1): ("unchanged", False), ("g", 1): ("added", False),
    }


def test_entries_continue_and_repeat(spark):
    rows = spark.createDataFrame([("x", 1, "k", "a"), ("x", 2, "k", "b"), ("x", 3, "m", "c"), ("x", 4, "k", "d")], "t string, pos int, key string, cell string")
    found = {(r.key, r.occurrence): [c.cell for c in r.rows] for r in entries.grouped(rows, ["t"], "key", ["pos"], ["cell"]).collect()}
    assert found == {("k", 1): ["a", "b"], ("m", 1): ["c"], ("k", 2): ["d"]}


def test_ranks_over_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert all(r["rank"] == r.v + 1 for r in ranked(rows, ["v"]).collect())


def test_ranks_with_other_columns_above_the_sample(spark):
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        rows = spark.range(300_000).select((F.col("id") * 7919 % 300_000).alias("v"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("other"))
        found = ranked(rows, ["v"]).agg(F.count_if(F.col("rank") != F.col("v") + 1).alias("wrong"), F.count("*").alias("n")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert (found.wrong, found.n) == (0, 300_000)


def test_annex_subject_keeps_its_last_character(spark, tmp_path):
    texts = ["0\n1 point 11\nx", "a\n \u2003 b c\u00a0 \nd", "a\n   \n\u00a0\nb\r ", "a\n 1st", "a", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = dict(map(tuple, places.annex_subject(spark, str(tmp_path)).collect()))
    assert found == {0: None, 1: "b c", 2: "b\r", 3: None, 4: None, 5: None, 6: None}
    spark.createDataFrame([(0, "x\nends in 171\ny")], "doc_id int, text string").coalesce(1).write.parquet(f"{tmp_path}/two/documents.parquet")
    assert [r.subject for r in places.annex_subject(spark, f"{tmp_path}/two").collect()] == ["ends in 171"]


def test_entries_are_dealt_once_for_a_difference(spark):
    rows = spark.createDataFrame([("t", "1", 1, "a"), (None, "1", 1, "a"), ("t", "2", 1, "x"), ("t", "2", 2, "y"), ("t", "4", 1, None)], "t string, key string, occurrence int, cell string")
    new = spark.createDataFrame([("t", "1", 1, "a "), ("t", None, 1, "a"), ("t", "2", 1, "x"), ("t", "3", 1, "z"), ("t", "4", 1, "q")], rows.schema)
    told = entries.difference(rows, new, ["t"], "key", "cell")
    assert {(r.t, r.key, r.occurrence, r.change) for r in told.collect()} == {("t", "1", 1, "whitespace"), ("t", "2", 0, "unpaired"), ("t", "3", 1, "added"), ("t", "4", 1, "amended")}
    assert told._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") <= 1
    schema = "t string, row int, header boolean, cells array<string>, marks array<string>"
    own = ["", ""]
    lines = [("t", 1, True, ["K", "V"], own), ("t", 2, False, ["1", "a"], own), ("t", 3, False, [" K", "V "], own), ("t", 4, False, ["1", "b"], ["R", ""]), ("u", 1, False, ["K", "V"], own)]
    held = {(r.t, r.key, r.occurrence): [x[1] for x in r.rows] for r in entries.of_lines(spark.createDataFrame(lines, schema), ["t"]).collect()}
    assert held == {("t", "1", 1): ["a", "b"], ("u", "K", 1): ["V"]}
    assert entries.of_lines(spark.createDataFrame(lines, schema), ["t"])._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
