import io
import zipfile

from pyspark.sql import functions as F

from palimpsest.sources import packages, provisions


def archive(files, **options):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", **options) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return held.getvalue()


ACT = """<ACT><TITLE><TI>Act</TI></TITLE><ENACTING.TERMS><DIVISION><TITLE><TI>CHAPTER I</TI></TITLE>
<ARTICLE IDENTIFIER="004A"><TI.ART>Article 4a</TI.ART><STI.ART>Scope <HT>now</HT></STI.ART><PARAG IDENTIFIER="004.001"><NO.PARAG>1.</NO.PARAG><ALINEA>First<NOTE><P>Foot</P></NOTE>.</ALINEA><ALINEA><P>Second:</P><LIST TYPE="alpha"><ITEM><NP><NO.P>(a)</NO.P><TXT>one</TXT></NP></ITEM><ITEM><NP><NO.P>(b)</NO.P><TXT>two</TXT><LIST TYPE="roman"><ITEM><NP><NO.P>(ii)</NO.P><TXT>deep</TXT></NP></ITEM></LIST></NP></ITEM><ITEM><NP><NO.P>(b)</NO.P><TXT>again</TXT><ALINEA>below</ALINEA></NP></ITEM></LIST></ALINEA></PARAG><PARAG><NO.PARAG>2A.</NO.PARAG><ALINEA><QUOT.S><ARTICLE IDENTIFIER="099"><ALINEA>quoted</ALINEA></ARTICLE></QUOT.S></ALINEA></PARAG><ODD>text</ODD></ARTICLE>
<ARTICLE><TI.ART>ARTICLE 14 b</TI.ART><ALINEA>x</ALINEA></ARTICLE><ARTICLE><TI.ART>no number</TI.ART><WEIRD/></ARTICLE></DIVISION></ENACTING.TERMS></ACT>"""
ANNEX = """<ANNEX><BIB.INSTANCE><ALINEA>pages</ALINEA></BIB.INSTANCE><TITLE><TI>ANNEX III</TI></TITLE><CONTENTS><GR.SEQ><TITLE><TI>General rules</TI></TITLE>
<GR.SEQ><NO.GR.SEQ>A.</NO.GR.SEQ><NP><NO.P>–</NO.P><TXT>dash</TXT></NP><NP><NO.P>—</NO.P><TXT>dash</TXT></NP><NP><NO.P>12.</NO.P><TXT>num</TXT></NP></GR.SEQ>
<GR.SEQ><TITLE><TI>6.6.2. Some words</TI></TITLE><P>inner</P></GR.SEQ><GR.SEQ><TITLE><TI>Section B.1. more</TI></TITLE>
<TBL COLS="3"><CORPUS><ROW TYPE="HEADER"><CELL COL="1">Key</CELL><CELL COL="2">A</CELL><CELL COL="3">B</CELL></ROW><BLK><TI.BLK>Group</TI.BLK><ROW><CELL COL="1" ROWSPAN="2">k1</CELL><CELL COL="2" COLSPAN="2">wide</CELL></ROW><ROW><CELL COL="2">l</CELL></ROW></BLK><ROW><CELL>free</CELL><CELL COL="3"><P>p1</P><P>p2</P></CELL></ROW></CORPUS></TBL></GR.SEQ></GR.SEQ></CONTENTS></ANNEX>"""


def docs(spark, *xml):
    return spark.createDataFrame([("k", i, bytearray(x.encode())) for i, x in enumerate(xml)], "key string, doc int, data binary")


def test_members_and_states(spark):
    good = archive({"b.xml": "<DOC/>", "dir/a.txt": "hi"})
    flipped = bytearray(archive({"a.xml": "<ACT>" + "x" * 500 + "</ACT>"}, compression=zipfile.ZIP_DEFLATED))
    flipped[38] ^= 255
    rows = [("good", good), ("none", None), ("junk", b"no zip"), ("empty", archive({})), ("big", archive({"x": "0" * 5000})), ("flip", bytes(flipped))]
    found = packages.members(spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in rows], "key string, content binary"), "key", most=4000).collect()
    assert {(r.key, r.state, r.name) for r in found} == {
        ("good", "read", "b.xml"), ("good", "read", "dir/a.txt"), ("none", "damaged", None), ("junk", "damaged", None), ("empty", "empty", None), ("big", "too_large", None), ("flip", "damaged", "a.xml"),
    }
    assert {bytes(r.data) for r in found if r.key == "good"} == {b"<DOC/>", b"hi"}


def test_files_are_read_by_spark(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "one.zip").write_bytes(archive({"a.xml": "<ACT/>"}))
    (tmp_path / "two.txt").write_text("no package")
    rows = packages.read_packages(spark, f"file://{tmp_path}").collect()
    assert [(r.path.rsplit("/", 1)[-1], r.state, r.name) for r in rows] == [("one.zip", "read", "a.xml")]


def test_document_selection(spark):
    def chosen(files):
        rows = packages.members(spark.createDataFrame([("p", bytearray(archive(files)))], "key string, content binary"), "key")
        return {(r.name, r.role) for r in packages.documents(rows, "key").collect()}

    act, terms = "<ACT/>", "<CONS.ACT><ENACTING.TERMS/></CONS.ACT>"
    assert chosen({"1.xml": act, "2.XML": terms, "3.xml": "<ANNEX/>", "4.xml": "<DOC/>", "5.txt": "<ACT/>", "6.xml": "<ACT>"}) == {("1.xml", "other"), ("2.XML", "act"), ("3.xml", "annex"), ("6.xml", "unreadable")}
    assert chosen({"b.xml": "<X/>", "a.xml": "<Y/>"}) == {("a.xml", "act"), ("b.xml", "other")}
    bomb = '<!DOCTYPE a [<!ENTITY b "cc">]><ACT>&b;</ACT>'
    assert chosen({"a.xml": bomb, "z.xml": "<ANNEX/>"}) == {("a.xml", "unreadable"), ("z.xml", "annex")}


def test_nodes_of_an_act(spark):
    made = provisions.tree(docs(spark, ACT), ["key", "doc"])
    nodes = {r.location: r for r in made["nodes"].collect()}
    assert set(nodes) == {
        "AR 4a", "AR 4a PA 1", "AR 4a PA 1 ALN 1", "AR 4a PA 1 ALN 2", "AR 4a PA 1 ALN 2 PTA (a)", "AR 4a PA 1 ALN 2 PTA (b)", "AR 4a PA 1 ALN 2 PTA (b) PTI (ii)",
        "AR 4a PA 1 ALN 2 ALN 1", "AR 4a PA 2a", "AR 4a PA 2a ALN 1", "AR 14b", "AR 14b ALN 1",
    }
    unit = nodes["AR 4a"]
    assert (unit.heading, unit.parent, unit.kind) == ("Scope now", None, "AR")
    assert unit.text == "Article 4a\nScope now\n1. First\nFoot.\nSecond:\n(a) one\n(b) two\n(ii) deep\n(b) again\nbelow\n2A. quotedtext"
    assert unit.comparison_text == "Article 4a Scope now 1. First Foot . Second: (a) one (b) two (ii) deep (b) again below 2A. quoted text"
    assert nodes["AR 4a PA 1 ALN 2 PTA (b) PTI (ii)"].text == "(ii) deep" and nodes["AR 4a PA 1 ALN 2 PTA (b)"].parent == "AR 4a PA 1 ALN 2"
    assert all(n.text in unit.text for n in nodes.values() if n.location.startswith("AR 4a"))
    assert {(r.tag, r.n) for r in made["unknown"].collect()} == {("ODD", 1)}


def test_annex_and_its_table(spark):
    made = provisions.tree(docs(spark, ANNEX, ACT, "<broken"), ["key", "doc"])
    nodes = {r.location: r for r in made["nodes"].where("doc = 0").collect()}
    assert set(nodes) == {"AN III", "AN III SCT A", "AN III SCT A TIRE 1", "AN III SCT A TIRE 2", "AN III SCT A PO 12", "AN III SCT 6.6.2", "AN III SCT B.1"}
    assert nodes["AN III"].heading == "General rules" and nodes["AN III SCT 6.6.2"].heading == "6.6.2. Some words"
    assert "pages" not in nodes["AN III"].text
    lines = provisions.tables(made, ["key", "doc"]).orderBy("row").collect()
    assert [(r.container, r.table, r.row, r.header, r.heading) for r in lines] == [("AN III SCT B.1", 1, 1, True, None), ("AN III SCT B.1", 1, 2, False, "Group"), ("AN III SCT B.1", 1, 3, False, "Group"), ("AN III SCT B.1", 1, 4, False, None)]
    assert [r.cells for r in lines] == [["Key", "A", "B"], ["k1", "wide", ""], ["k1", "l", ""], ["free", "", "p1\np2"]]
    assert [r.marks for r in lines] == [["", "", ""], ["", "", "C"], ["R", "", "-"], ["", "-", ""]]


def test_decoders(spark):
    def value(column, **named):
        return spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in named.items()]).select(column.alias("x")).first().x

    assert [value(provisions.identifier(F.col("v")), v=v) for v in ("004A", "0014", "005.001A", "000", "A1", "", None)] == ["4a", "14", "1a", "0", None, None, None]
    assert [tuple(x) if (x := value(provisions.point(F.col("v")), v=v)) else None for v in ("(bb)", "14.", "(1a)", "-", "", "(a)(b)", "A")] == [("PTA", "(bb)"), ("PO", "14"), ("PO", "1a"), ("TIRE", None), None, None, ("PTA", "(a)")]
    assert [value(provisions.annex_number(F.col("v"), "ANNEX"), v=v) for v in ("Annex iv", "ANNEX 4a to", "LIST OF ANNEXES", "ANNEX TO ANNEX II", "ANNEX")] == ["IV", "4A", None, "II", None]
    assert [value(provisions.section_number(F.col("v")), v=v) for v in ("Section A. x", "SECTION 1.2", "6.6.2. a", "6.", "Sections A", "6 a")] == ["A", "1.2", "6.6.2", None, None, None]


def test_no_documents(spark):
    made = provisions.tree(docs(spark, "<a/>").limit(0), ["key", "doc"])
    assert made["nodes"].count() == 0 and provisions.tables(made, ["key", "doc"]).count() == 0


def test_archives_are_read_once_and_in_batches(spark):
    files = {"1.xml": "<ACT/>", "2.XML": "<CONS.ACT><ENACTING.TERMS/></CONS.ACT>", "3.xml": "<ANNEX/>", "4.xml": "<DOC/>", "5.txt": "<ACT/>", "6.xml": "<ACT>"}
    rows = [(f"k{i}", bytearray(archive(files))) for i in range(40)] + [("junk", bytearray(b"no zip")), ("none", None), ("empty", bytearray(archive({})))]
    archives = spark.createDataFrame(rows, "key string, content binary").coalesce(1)
    read = packages.read_documents(archives, "key")
    assert "Exchange" not in read._jdf.queryExecution().executedPlan().toString()
    parted = packages.documents(packages.members(archives, "key"), "key")
    assert sorted(map(repr, read.collect())) == sorted(map(repr, parted.select(*read.columns).collect())) and read.count() == 160
    sizes = packages.members(archives, "key").drop("data").mapInArrow(lambda batches: (b.slice(0, 1) for b in batches), "key string, state string, place int, name string")
    assert sizes.count() < 43  # members of many archives leave a task together


def test_lines_of_tables_need_no_shuffle(spark):
    made = provisions.tree(docs(spark, ANNEX, ACT, "<broken"), ["key", "doc"])
    assert "Exchange" not in provisions.tables(made, ["key", "doc"])._jdf.queryExecution().executedPlan().toString()


def test_places_of_tables_are_those_of_the_tree(spark):
    table = '<TBL COLS="1"><CORPUS><ROW><CELL>x<P>y</P><P>z</P></CELL></ROW></CORPUS></TBL>'
    inner = table.replace("x<P>", table + "<P>")
    xml = f"""<ACT><TITLE><ARTICLE IDENTIFIER="9">{table}</ARTICLE></TITLE><ARTICLE><TI.ART>none</TI.ART>{table}</ARTICLE><ARTICLE IDENTIFIER="007A"><PARAG IDENTIFIER="007.001">{table}
<ALINEA><NOTE>{table}</NOTE><LIST TYPE="roman"><ITEM><NP><NO.P>(iv).</NO.P><TXT>{inner}</TXT></NP><NP><NO.P>–</NO.P>{table}</NP></ITEM></LIST></ALINEA></PARAG><PARAG><NO.PARAG>2A.</NO.PARAG>{table}</PARAG></ARTICLE>
<ANNEX><TITLE><TI>x</TI><TI>y</TI></TITLE>{table}</ANNEX><ANNEX><TITLE><TI>APPENDIX 3b</TI></TITLE>{table}<GR.SEQ><NO.GR.SEQ>B.</NO.GR.SEQ><BIB.INSTANCE>{table}</BIB.INSTANCE>{table}{table}</GR.SEQ></ANNEX></ACT>"""
    made = provisions.tree(docs(spark, xml), ["key", "doc"])
    units = {(r.unit, r.location) for r in made["nodes"].collect()}
    found = {(r.unit, r.container, r.table): (r.cells, r.marks) for r in provisions.tables(made, ["key", "doc"]).collect()}
    assert {k[:2] for k in found} <= units
    assert {k[1:] for k in found} == {
        ("AR 7a PA 1", 1), ("AR 7a PA 1 ALN 1", 1), ("AR 7a PA 1 ALN 1 PTI (iv)", 1), ("AR 7a PA 1 ALN 1 TIRE 1", 1), ("AR 7a PA 2a", 1), ("APP 3B", 1), ("APP 3B SCT B", 1), ("APP 3B SCT B", 2),
    }
    assert next(v for k, v in found.items() if k[1] == "AR 7a PA 2a") == (["x\ny\nz"], [""])
