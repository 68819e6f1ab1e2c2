import difflib
import random
import time

from palimpsest.functions import identifiers, text
from palimpsest.operators import similarity, texts
from palimpsest.sources.markup import expand_grid, xml_nodes
from pyspark.sql import functions as F


def values(spark, rows, expression, types="v string"):
    return [r[0] for r in spark.createDataFrame([(x,) if not isinstance(x, tuple) else x for x in rows], types).select(expression).collect()]


def test_comparison_text(spark):
    assert values(spark, ["a \tb\r\nc", " \u001c ", None], text.comparison_text(F.col("v"))) == ["a b c", "", None]


def test_roman_and_natural(spark):
    assert values(spark, ["XIV", "iv", "L", "MM", "IIX", "12", ""], text.roman_value(F.col("v"))) == [14, None, None, 2000, None, None, None]
    keys = values(spark, ["10", "9", "IX", "b", "2a", ""], text.natural_text(F.col("v")))
    order = [x for _, x in sorted(zip(keys, ["10", "9", "IX", "b", "2a", ""]))]
    assert order == ["", "2a", "9", "IX", "10", "b"]


def test_paths(spark):
    rows = [("AR 6", "AR 60"), ("AR 6", "AR 6 PA 1"), ("AR 6", "AR 6")]
    assert values(spark, rows, text.contains_path(F.col("o"), F.col("i")), "o string, i string") == [False, True, True]


def test_check_digits(spark):
    assert values(spark, [("0050", "00", "0"), ("7732", "18", "5"), ("7732", "18", "6")], identifiers.cas_valid(F.col("a"), F.col("b"), F.col("c")), "a string, b string, c string")[1:] == [True, False]
    assert values(spark, ["200001"], identifiers.ec_check(F.col("v"))) == [8]


def test_ratio_and_bounds(spark):
    nodes = spark.createDataFrame([(1, "a b c d e"), (2, "a b x d e"), (3, ""), (4, " ")], "k int, text string")
    pairs = spark.createDataFrame([(1, 2), (3, 4), (1, 3)], "left int, right int")
    found = {(r.left, r.right): (r.real_quick, r.quick) for r in similarity.bounds(pairs, nodes, "k").collect()}
    assert found == {(1, 2): (1.0, 0.8), (3, 4): (1.0, 1.0), (1, 3): (0.0, 0.0)}
    df = spark.createDataFrame([("a b c d", "a c d e")], "a string, b string")
    assert df.select(similarity.word_ratio("a", "b")).first()[0] == difflib.SequenceMatcher(None, "abcd", "acde", autojunk=False).ratio()


def test_mutual_best(spark):
    scored = spark.createDataFrame([("a", "x", 0.95), ("a", "y", 0.95), ("b", "x", 0.99), ("c", "z", 0.5)], "left string, right string, ratio double")
    assert {(r.left, r.right) for r in similarity.mutual_best(scored, 0.9).collect()} == {("b", "x")}


def test_dates(spark):
    rows = [("from 2024-01-01", "from 2025-01-01"), ("from 2024-01-01", "as from 2025-01-01"), ("x", "y"), (None, "x 1.2.2024"), ("1.2.2024  to 2024-01-01", "1.2.2024 to 2024-01-02")]
    assert [v.verdict for v in values(spark, rows, texts.date_verdict("a", "b"), "a string, b string")] == ["deferred", "unknown", "unchanged", "unknown", "deferred"]


def test_numbering_mask(spark):
    rows = {
        "see Article 5(1)(a) and Annex IV": "see Article # and Annex #",
        "Articles 5, 6 and 7a or 8": "Articles #, # and # or #",
        "26 May 2021 and 2021, 30 pieces": "26 May 2021 and 2021, 30 pieces",
        "(a) first (12) second device(s)": "(#) first (#) second device(s)",
        "articles 5x6 stay": "articles 5x6 stay",
        "Part A and points 1.2.3 to 4, 9 days": "Part # and points # to #, # days",
        "ANNEXES I,II and iv": "ANNEXES #,# and iv",
        "(Section 4a(b)(iv)) of title X or Y": "(Section #) of title # or #",
        "paragraph 5/6, point 7(aaaaa) (2021) (30)": "paragraph 5/6, point #(aaaaa) (2021) (#)",
        "Articles": "Articles",
        "": "",
    }
    assert values(spark, list(rows), texts.numbering_masked(F.col("v"))) == list(rows.values())


def test_fuzzy_matches_greedy_and_tells_what_it_passes_over(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away from the hounds of the old manor house again "
    rows = [("x", f"o{i}", "deleted", base * 2 + f" tail {i}") for i in range(3)] + [("x", f"n{i}", "inserted", base * 2 + f"  tail {i}{'!' * i}") for i in range(4)]
    rows += [("y", f"o{i}", "deleted", base) for i in range(51)] + [("y", "n", "inserted", base), ("x", "short", "deleted", "short")]
    units = spark.createDataFrame(rows, "act string, location string, change_type string, text string")
    texts_ = {r[1]: " ".join(r[3].split()) for r in rows if r[0] == "x"}
    scored = sorted((-difflib.SequenceMatcher(None, texts_[f"o{i}"], texts_[f"n{j}"], autojunk=False).ratio(), f"o{i}", f"n{j}") for i in range(3) for j in range(4))
    want, used = set(), set()
    for r, a, b in scored:
        if -r >= texts.FUZZY_RATIO and not {a, b} & used:
            want.add((a, b))
            used |= {a, b}
    assert {(r.old_location, r.new_location) for r in texts.fuzzy_renumberings(units).collect()} == want
    assert [tuple(r) for r in texts.fuzzy_units(units)[1].collect()] == [("y", 51, 1)]


def test_quotes(spark):
    quotes = spark.createDataFrame([(1, "two three"), (2, "one  two three four five six"), (3, ""), (4, "hree")], "q int, text string")
    docs = spark.createDataFrame([(1, "one two three four five six seven"), (2, "two\nthree"), (3, None)], "d int, text string")
    assert {(r.q, r.d) for r in texts.quoted(quotes, docs, "q", "d").collect()} == {(1, 1), (1, 2), (2, 1)}


def test_grid():
    cells = [[{"text": "a", "rowspan": 2}, {"text": "b", "colspan": 2}], [{"text": "c"}, {"text": "d"}]]
    assert expand_grid(cells) == [["a", "b", None], ["a", "c", "d"]]


def test_xml(spark):
    docs = spark.createDataFrame([(1, "<a><b>x</b><b>y</b></a>"), (2, "<a>"), (3, None)], "k int, xml string")
    rows = xml_nodes(docs, "k").collect()
    assert [(r.pos, r.location, r.text) for r in rows if r.k == 1] == [(0, "a", "xy"), (1, "a b", "x"), (2, "a b#2", "y")]
    assert {r.k for r in rows if r.state == "unreadable"} == {2, 3}


def rebuilt(x, y, found):
    left = [w for _, i, j, _, _ in found for w in x[i:j]]
    right = [w for kind, i, j, k, n in found for w in (x[i:j] if kind == "equal" else y[k:n])]
    return left == x and right == y and all(a[2] == b[1] and a[4] == b[3] for a, b in zip(found, found[1:]))


def test_differences_of_short_and_very_long_texts():
    rng = random.Random(2)
    x = [f"w{rng.randrange(60)}" for _ in range(300)]
    y = x[:40] + ["new"] + x[60:200] + x[210:]
    assert similarity.opcodes(x, y) == difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes()
    long = [f"w{rng.randrange(5000)}" for _ in range(266_000)]
    other = long[:1000] + ["added"] * 5 + long[1000:90_000] + long[90_100:200_000] + [f"v{i}" for i in range(300)] + long[200_050:]
    began = time.time()
    found = similarity.opcodes(long, other)
    assert time.time() - began < 20 and rebuilt(long, other, found)
    changed = sum(max(j - i, n - k) for kind, i, j, k, n in found if kind != "equal")
    assert 400 <= changed <= 1000
    blank = ["same"] * 6000
    assert rebuilt(blank, blank[:5900], similarity.opcodes(blank, blank[:5900]))


def test_excerpts():
    words_ = [f"w{i}" for i in range(300)]
    other = words_[:100] + ["x"] + words_[101:250] + words_[251:]
    withheld, omitted, passages = texts.excerpts(" ".join(words_), "  ".join(other))
    assert (withheld, omitted) == (False, 0) and passages[0] == {"before": " ".join(words_[94:107]), "after": " ".join([*words_[94:100], "x", *words_[101:107]])}
    assert passages[1] == {"before": " ".join(words_[244:257]), "after": " ".join([*words_[244:250], *words_[251:257]])}
    assert texts.excerpts("a b c", "a x c") == (True, 0, []) and texts.excerpts("a  b", "a b") == (False, 0, [])
    many = [w if i % 40 else "y" for i, w in enumerate([f"w{i}" for i in range(2000)])]
    assert texts.excerpts(" ".join(f"w{i}" for i in range(2000)), " ".join(many))[1] == 50 - texts.EXCERPTS
    long = " ".join(["z" * 90] * 40)
    assert texts.excerpts(long + " a " + long, long + " b " + long)[2][0]["before"].endswith(texts.CUT)
