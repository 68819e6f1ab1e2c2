import random
import re
from itertools import permutations

from palimpsest.llm import filter_audit as fa


def fails(rows, at):
    i, part, text = rows[at][:3]
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    return {
        "A": len(words) < fa.LEAST_WORDS,
        "B": 100 * len(set(words)) < fa.LEAST_DISTINCT * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > fa.MOST_CAPITALS * len(text),
        "D": bool(re.search(fa.SYMBOLS, text)),
        "E": any(i is not None and j is not None and j < i and (t or "") == text for j, _, t, *_ in rows),
    }


def brute(rows, labels):
    """Every order run over the documents of every part."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    flags = [fails(rows, at) for at in range(len(rows))]
    out, shapley = {}, {}
    for part in {r[1] or "" for r in rows}:
        mine = [at for at, r in enumerate(rows) if (r[1] or "") == part]
        for order in permutations("ABCDE"):
            alive = set(mine)
            for k, f in enumerate(order, 1):
                failing = {at for at in mine if flags[at][f]}
                gone = failing & alive
                alone = sum(flags[at][f] and not any(flags[at][g] for g in "ABCDE" if g != f) for at in mine)
                out[part, "".join(order), k] = [len(alive - gone), len(gone), len(failing - alive), alone, *(sum(rows[at][0] in s for at in gone) for s in (good, toxic)), f]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                alive -= gone
    return {(*key, *v[:6], shapley[key[0], v[6]]) for key, v in out.items()}


def test_every_order_against_brute_force(spark):
    rnd = random.Random(5)
    pool = [f"word{i}" for i in range(400)]
    rows = []
    for i in range(160):
        text = " ".join(rnd.choices(pool[: rnd.choice([3, 90, 400])], k=rnd.choice([5, 199, 200, 260])))
        if rnd.random() < 0.3:
            text = text.upper()
        if rnd.random() < 0.3:
            text += " 5$"
        rows.append((i if i % 9 else None, rnd.choice(["en", "de", None, ""]), rnd.choice([text, rnd.choice(rows)[2] if rows else None]), 1))
    rows += [(7, "en", None, 1), (300, "fr", "", 1), (301, "fr", None, 1), (7, "en", None, 1)]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(0, 200, 2)] + [(None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, n int").withColumnRenamed("n", "E")
    got = fa.audit(fa.with_labels(fa.flagged(docs), spark.createDataFrame(labels + [(4, 0, 0)], "doc_id long, quality int, toxic int")))
    assert {tuple(r) for r in got.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()} == brute(rows, labels)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.audit(fa.with_labels(fa.flagged(docs), labels)).count() == 0
    one = spark.createDataFrame([(1, "en", "A")], docs.schema)
    rows = fa.audit(fa.with_labels(fa.flagged(one), labels)).collect()
    assert len(rows) == 600 and {(r.kept, r.good_lost) for r in rows} <= {(0, 0), (1, 0)}
