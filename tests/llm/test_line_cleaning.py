import re
from collections import Counter

from palimpsest.llm import line_cleaning as lc

SP = r"[\x20\x09-\x0D]"


def brute_rule(line):
    low = "".join(c.lower() if c in lc.UPPER else c for c in line)
    words = [w for w in re.split(SP + "+", line) if w]
    if any(n in low for n in lc.NOTICES):
        return "boilerplate"
    cells = sum(len(w) == 1 and w in lc.SEPARATORS for w in words)
    if cells >= 2 and len(words) - cells <= lc.CELL_WORDS * (cells + 1):
        return "navigation"
    if len(line) <= lc.MENU_CHARS and all(x in lc.MENU for x in re.split(SP + "|[,;:.|/>]", low) if x):
        return "navigation"
    tail = line.rstrip(" \t\n\x0b\x0c\r\"')]”’»")
    return None if tail and tail[-1] in ".!?…。！？؟।" else "punctuation"


def brute(text):
    text = text or ""
    words = [w for w in re.split(SP + "+", text) if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.sub(SP, "", x)]
    chars = lambda s: len(re.sub(SP, "", s))
    stay = [x for x in lines if brute_rule(x) is None]
    left = sum(map(chars, stay))
    failed = len(words) < lc.LEAST_WORDS or 100 * len(covered) > lc.MOST_REPEATED * len(words)
    kept = not failed and 100 * (chars(text) - left) <= lc.MOST_LOST * chars(text)
    return (len(words), chars(text), sum(text.count(c) for c in lc.SYMBOLS), len(lines) - len(set(lines)), len(covered), failed, kept, len(lines), len(lines) - len(stay), left)


PROSE = "The fox{0} ran over{0} lazy dogs{0} at dawn{0} and came{0} home late{0} in rain."
CASES = [
    None, "", " \t\n ", "one", "word " * 60, "\n".join(PROSE.format(i) for i in range(9)),
    "\n".join(PROSE.format(i) for i in range(9)) + "\nHome | About | Contact |\nAll rights reserved.\nhome menu search\n\nA loose line",
    "\n".join(PROSE.format(i) for i in range(4)) + "\n" + "\n".join(f"a{i} line that{i} has no{i} end and{i} is rather{i} long really{i}" for i in range(9)),
    "\n".join(PROSE.format(i) for i in (1, 2, 3, 1, 2, 4, 5)), "a b c a b c a b c d e f g", "x y z w x y z",
    "»Ende.« (so.) ‚quoted!’ “yes?” no;\nTail \"ok.\"  \nε τέλος…", "Home > Products > Lamps > Desk\nwhat a > b means is c > d here, as far as the many words of this line tell it to us all.",
    "# $ % & * | < > @\r\nline two.\r", " ".join(f"w{i % 977}" for i in range(50_000)), "y" * 300_000, ("ab " * 70_000) + "end.",
]


def test_report_against_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(CASES)] + [(None, CASES[6]), (6, CASES[6])]
    docs = spark.createDataFrame([(i, t, "en", 1, "k") for i, t in rows], "doc_id long, text string, _words string, kept int, rule string")
    got = sorted((tuple(r) for r in lc.report(docs).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    want = sorted(((i, *brute(t)) for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0))
    assert got == want
    assert {(r[6], r[7]) for r in got} == {(True, False), (False, True), (False, False)}


def test_rules(spark):
    lines = ["It is so.", "no end", "A | B | C |", "Home", "home, contact; rss", "See our Privacy Policy.", "a | b.", "Fin. »", "| | |", "next >", "He went home."]
    text = spark.createDataFrame([("\n".join(lines),)], "text string")
    got = text.select(lc.line_verdicts(text["text"]).alias("v")).first().v
    want = [None, "punctuation", "navigation", "navigation", "navigation", "boilerplate", None, None, "navigation", "navigation", None]
    assert [(v.line, v.rule) for v in got] == list(zip(lines, want)) and [brute_rule(x) for x in lines] == want


def test_cleaned_keeps_columns_and_drops_lines(spark):
    text = CASES[6]
    docs = spark.createDataFrame([(1, text, "a", 2.0), (2, CASES[7], "b", 3.0), (3, None, None, None)], "doc_id long, text string, `_m` string, `left.chars` double")
    got = lc.cleaned(docs).collect()
    assert lc.cleaned(docs).columns == docs.columns and len(got) == 1
    assert (got[0].doc_id, got[0]._m, got[0]["left.chars"]) == (1, "a", 2.0)
    assert got[0].text == "\n".join(PROSE.format(i) for i in range(9)) + "\n"


def test_empty_table(spark):
    assert lc.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
