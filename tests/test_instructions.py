from pyspark.sql import functions as F

from palimpsest.sources import instructions

ACT = """<ACT><ENACTING.TERMS>
<ARTICLE IDENTIFIER="001"><TI.ART>Article 1</TI.ART><STI.ART>Amendments to Regulation (EU) 2024/1689</STI.ART><ALINEA>Regulation (EU) 2024/1689 is amended as follows:<LIST>
<ITEM><NP><NO.P>(1)</NO.P><TXT>in Article 1(2), point (g) is replaced by the following:</TXT><QUOT.S><PARAG IDENTIFIER="099.001"><ALINEA>quoted Article 77 is deleted</ALINEA></PARAG></QUOT.S></NP></ITEM>
<ITEM><NP><NO.P>(2)</NO.P><TXT>Article 5 is amended as follows:</TXT><P><LIST><ITEM><NP><NO.P>(a)</NO.P><TXT>paragraph 1 is replaced</TXT></NP></ITEM><ITEM><NP><NO.P>(b)</NO.P><TXT>points 7 and 9 are deleted;</TXT></NP></ITEM><ITEM><NP><NO.P>(c)</NO.P><TXT>paragraph 3 is amended as follows:</TXT><P><LIST><ITEM><NP><NO.P>(i)</NO.P><TXT>the second subparagraph is deleted</TXT></NP></ITEM></LIST></P></NP></ITEM></LIST></P></NP></ITEM>
<ITEM><NP><NO.P>(3)</NO.P><TXT>the following Articles are inserted:</TXT><QUOT.S><ARTICLE IDENTIFIER="004A"><PARAG IDENTIFIER="004A.001"><ALINEA>x</ALINEA></PARAG></ARTICLE><ARTICLE><TI.ART>Article 60 b</TI.ART></ARTICLE></QUOT.S></NP></ITEM>
<ITEM><NP><NO.P>(4)</NO.P><TXT>the following Annex is added:</TXT><QUOT.S><INCL.ELEMENT FILEREF="annex.xml"/></QUOT.S></NP></ITEM>
<ITEM><NP><NO.P>(5)</NO.P><TXT>in Article 9, the following is added: nothing quoted</TXT></NP></ITEM>
<ITEM><NP><NO.P>(6)</NO.P><TXT>the date is replaced by another</TXT></NP></ITEM>
<ITEM><NP><NO.P>(7)</NO.P><TXT>Article 8 is renumbered</TXT></NP></ITEM>
<ITEM><NP><NO.P>(8)</NO.P><TXT>a remark</TXT></NP></ITEM></LIST></ALINEA></ARTICLE>
<ARTICLE IDENTIFIER="002"><TI.ART>Article 2</TI.ART><ALINEA>Annex I to Regulation (EC) No 1907/2006 is amended as follows:<LIST><ITEM><NP><NO.P>–</NO.P><TXT>in Section 10.4.1, point (b) is replaced</TXT></NP></ITEM></LIST></ALINEA></ARTICLE>
<ARTICLE IDENTIFIER="003"><TI.ART>Article 3</TI.ART><ALINEA>In Regulation (EU) 2018/1139, Article 4 is deleted.</ALINEA></ARTICLE>
<ARTICLE IDENTIFIER="004"><TI.ART>Article 4</TI.ART><ALINEA>Article 1 is deleted in Regulation (EEC) No 2913/92.</ALINEA></ARTICLE></ENACTING.TERMS></ACT>"""


def docs(spark, **files):
    return spark.createDataFrame([("p", n, bytearray(x.encode())) for n, x in files.items()], "package string, name string, data binary")


def test_records(spark):
    files = docs(spark, a=ACT).unionByName(docs(spark, **{"annex.xml": "<ANNEX><TITLE><TI>ANNEX XIV</TI></TITLE></ANNEX>"}))
    got = instructions.read(files, "package")
    ai, reach, air = "32024R1689", "32006R1907", "32018R1139"
    assert {(r.source, r.location, r.change, r.act, r.from_quotation) for r in got["records"].collect()} == {
        ("AR 001 (1)", "AR 1 PA 2 PTA (g)", "modified", ai, False), ("AR 001 (2) (a)", "AR 5 PA 1", "modified", ai, False), ("AR 001 (2) (b)", "AR 5 PO 7", "deleted", ai, False),
        ("AR 001 (2) (c) (i)", "AR 5 PA 3 ALN 2", "deleted", ai, False), ("AR 001 (3)", "AR 4a", "inserted", ai, True), ("AR 001 (3)", "AR 60b", "inserted", ai, True), ("AR 001 (4)", "AN XIV", "inserted", ai, True),
        ("AR 001 (5)", "AR 9", "modified", ai, False), ("AR 002 –", "AN I SCT 10.4.1 PTA (b)", "modified", reach, False), ("AR 003", "AR 4", "deleted", air, False),
    }
    assert {(r.source, r.clause, r.reason) for r in got["unread"].collect()} == {("AR 001 (6)", "the date is replaced by another", "no provision reference"), ("AR 001 (7)", "Article 8 is renumbered", "no instruction verb")}
    told = {(r.act, r.unit): r.claimed_kind for r in instructions.claims(got["records"], "package").collect()}
    assert told[ai, "AR 5"] == "modified" and told[ai, "AR 4a"] == "inserted" and told[air, "AR 4"] == "deleted" and told[reach, "AN I"] == "modified"


def test_an_act_that_names_no_other(spark):
    got = instructions.read(docs(spark, a='<ACT><ENACTING.TERMS><ARTICLE IDENTIFIER="001"><LIST><ITEM><NP><NO.P>1.</NO.P><TXT>Article 3 is deleted</TXT></NP><NP><TXT>Article 4 is deleted</TXT></NP></ITEM></LIST></ARTICLE></ENACTING.TERMS></ACT>'), "package")
    assert [(r.source, r.location, r.act) for r in got["records"].collect()] == [("AR 001 1.", "AR 3", None)]
    assert instructions.read(docs(spark, a="<ACT").limit(0), "package")["records"].count() == 0


def test_named_acts(spark):
    cases = {"Regulation (EU) 2024/1689": "32024R1689", "REGULATION (EC) No 1907/2006 and": "32006R1907", "Regulation (EU, Euratom) 2018/1046": "32018R1046", "Regulation (EEC) No 2913/92": None, "Directive 93/42/EEC": None, "": None, "x" * 400 + " Regulation (EU) 2024/1689": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.a for r in rows.select("t", instructions.named_act(F.col("t")).alias("a")).collect()} == cases


def test_packages_are_read_whole_by_one_plan(spark):
    point = "<ITEM><NP><NO.P>({})</NO.P><TXT>Article {} is deleted</TXT></NP></ITEM>"
    act = '<ACT><ENACTING.TERMS><ARTICLE IDENTIFIER="001"><ALINEA>Regulation (EU) 2024/{} is amended as follows:<LIST>{}</LIST></ALINEA></ARTICLE><ARTICLE IDENTIFIER="002"><ALINEA>Article 9 is deleted</ALINEA></ARTICLE></ENACTING.TERMS></ACT>'
    rows = [(p, n, bytearray(x.encode())) for p in range(30) for n, x in (("a.xml", act.format(p + 10, "".join(point.format(k, p + k) for k in range(50)))), ("b.xml", "<broken"))]
    files = spark.createDataFrame([*rows, (None, "a.xml", rows[0][2]), (7, None, rows[0][2])], "package int, name string, data binary")
    records = instructions.read(files, "package")["records"]
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan  # the driver holds no more than this plan, whatever is read
    found = sorted((r.package, r.source, r.location, r.act) for r in records.collect())
    assert found == sorted((p, f"AR 001 ({k})", f"AR {p + k}", f"32024R{p + 10:04d}") for p in range(30) for k in range(50))
