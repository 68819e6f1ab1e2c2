import datetime

from palimpsest.sources import notices

LINK = notices.AMENDED
NOTICE = f"""<NOTICE><WORK><ID_CELEX><VALUE>32024R1689</VALUE></ID_CELEX><WORK_DATE_DOCUMENT><VALUE>2024-06-13</VALUE></WORK_DATE_DOCUMENT>
<{LINK}><SAMEAS><URI><TYPE>oj</TYPE><IDENTIFIER>L_1</IDENTIFIER></URI></SAMEAS><SAMEAS><URI><TYPE>celex</TYPE><IDENTIFIER>32026R1744</IDENTIFIER></URI></SAMEAS>
<ANNOTATION><REFERENCE_TO_MODIFIED_LOCATION>{{AR|http://x/AR}} 5 {{PA|http://x/PA}} 1</REFERENCE_TO_MODIFIED_LOCATION><ROLE2>{{J|http://x/J}}</ROLE2><START_OF_VALIDITY>2026-07-27</START_OF_VALIDITY></ANNOTATION>
<ANNOTATION><REFERENCE_TO_MODIFIED_LOCATION>AN 4</REFERENCE_TO_MODIFIED_LOCATION><ROLE2>XX</ROLE2><START_OF_VALIDITY>soon</START_OF_VALIDITY></ANNOTATION>
<ANNOTATION><REFERENCE_TO_MODIFIED_LOCATION> </REFERENCE_TO_MODIFIED_LOCATION><ROLE2>R</ROLE2></ANNOTATION></{LINK}>
<{LINK}><ANNOTATION><REFERENCE_TO_MODIFIED_LOCATION>CHA III</REFERENCE_TO_MODIFIED_LOCATION></ANNOTATION><ANNOTATION><REFERENCE_TO_MODIFIED_LOCATION>AN 60</REFERENCE_TO_MODIFIED_LOCATION><ROLE2>DEL</ROLE2><START_OF_VALIDITY>2007/11/23</START_OF_VALIDITY></ANNOTATION></{LINK}>
%s</WORK></NOTICE>"""


def version(relation, celex):
    return f"<{relation}><EMBEDDED_NOTICE><WORK><ID_CELEX><VALUE>{celex}</VALUE></ID_CELEX></WORK></EMBEDDED_NOTICE></{relation}>"


def docs(spark, *xml):
    return spark.createDataFrame([(i, bytearray(x.encode())) for i, x in enumerate(xml)], "k int, data binary")


def test_annotations_and_gaps(spark):
    records, gaps = notices.annotations(docs(spark, NOTICE % "", "<NOTICE><WORK/></NOTICE>", "<broken"), ["k"])
    day = datetime.date
    assert {(r.act, r.amending, r.location, r.unit, r.gap, r.role, r.change, r.day) for r in records.collect()} == {
        ("32024R1689", "32026R1744", "AR 5 PA 1", "AR 5", None, "J", "inserted", day(2026, 7, 27)), ("32024R1689", "32026R1744", "AN IV", "AN IV", None, "XX", None, None),
        ("32024R1689", None, "CHA III", "CHA III", "container", None, None, None), ("32024R1689", None, "AN 60", "AN 60", "unconverted", "DEL", "deleted", day(2007, 11, 23)),
    }
    assert {tuple(r) for r in gaps.collect()} == {(0, 4, 1, 1, 1, 1, 1, 1), (1, 0, 0, 0, 0, 0, 0, 0)}
    assert [r.unit for r in notices.touched_units(records, ["k"]).orderBy("key").collect()] == ["AR 5", "AN IV"]


def test_versions(spark):
    first, second = notices.CONSOLIDATED
    held = version(first, "02024R1689-20260727") + version(second, "02024R1689-20260727") + version(second, "02024R1689-20250101") + version(first, "02023R0001-20250101") + version(first, "junk")
    day = datetime.date
    got = {(r.version, r.kind, r.day, r.n_relations) for r in notices.versions(docs(spark, NOTICE % held), ["k"]).collect()}
    assert got == {("32024R1689", "original", day(2024, 6, 13), 0), ("02024R1689-20260727", "consolidated", day(2026, 7, 27), 2), ("02024R1689-20250101", "consolidated", day(2025, 1, 1), 1)}
