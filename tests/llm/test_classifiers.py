import zlib

import numpy as np
import pytest

from palimpsest.llm import language_id, quality, toxicity

DATA = "/root/testdata/sf0.01"


def held(i, folds, fold):
    return zlib.crc32(str(i).encode()) % folds == fold


def corpus(spark, label):
    rng = np.random.default_rng(6)
    docs, labels = [], []
    for i in range(600):
        words = [f"w{int(x)}" for x in rng.integers(0, 200, int(rng.integers(20, 120)))]
        bad = bool(rng.random() < 0.3)
        if bad:
            words[len(words) // 2 : len(words) // 2] = ["vile", "rot!!"] if label == "toxic" else ["###", "###"]
        docs.append((i, ". ".join(" ".join(words[k : k + 8]) for k in range(0, len(words), 8))))
        labels.append((i, int(bad) if label == "toxic" else int(not bad)))
    docs += [(600, None), (601, ""), (602, " \n"), (603, "w " * 60_000), (603, "w " * 60_000), (None, "w1 w2")]
    return (
        spark.createDataFrame([(i, t, "s") for i, t in docs], "doc_id long, text string, score string").repartition(3),
        spark.createDataFrame([*labels, (1, None), (None, 1)], f"doc_id long, {label} int"),
        dict(labels),
    )


@pytest.mark.parametrize("module, run, label, folds, fold", [(toxicity, toxicity.toxicity, "toxic", 5, 0), (quality, quality.quality, "quality", 3, 1)])
def test_held_out_accuracy_and_edges(spark, module, run, label, folds, fold):
    docs, labels, truth = corpus(spark, label)
    found = run(docs, labels).collect()
    assert len(found) == docs.count()
    right = [r.predicted == truth[r.doc_id] for r in found if r.doc_id in truth and r.held_out]
    assert np.mean(right) > 0.9
    assert all(r.held_out == held(r.doc_id, folds, fold) for r in found if r.doc_id is not None)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    assert run(docs.limit(0), labels).collect() == []
    assert all(0 <= r.score <= 1 for r in run(docs.limit(5), labels.limit(0)).collect())


def test_toxic_sentences_are_located(spark):
    docs, labels, truth = corpus(spark, "toxic")
    from palimpsest.llm._common import labelled_sample, texts_of

    model = toxicity.train(labelled_sample(docs, labels, "toxic", 5, 0, 8000))
    found = toxicity.sentences(texts_of(docs), model).collect()
    assert found and np.mean(["vile" in r.sentence or "rot" in r.sentence for r in found]) > 0.95
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    left = {r.doc_id for r in kept.collect()}
    assert np.mean([(i in left) == (not t) for i, t in truth.items()]) > 0.9


def test_languages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(-1, None, None), (-2, "12 !", "en"), (-3, "Αβγ δεζ", None), (None, "the of and", None)], "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in language_id.identify(docs.unionByName(extra)).collect()}
    assert found[-1].lang_pred == found[-2].lang_pred == "und" and found[-1].score == 0
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert np.mean([found[i].lang_pred == lang for i, lang in truth.items() if found[i].held_out]) > 0.98
    assert all(found[i].held_out == held(i, 3, 1) for i in truth)
    model = language_id.train(docs)
    one = {lang: docs.where(f"lang = '{lang}' AND length(text) BETWEEN 1500 AND 4000").orderBy("doc_id").first().text for lang in ("en", "fr")}
    mixed = spark.createDataFrame([(1, one["en"] + " " + one["fr"])], "doc_id long, text string")
    labelled = language_id.spans(mixed, model).collect()
    letters = {lang: sum(r.end - r.start for r in labelled if r.lang == lang and (r.start < len(one["en"])) == (lang == "en")) for lang in one}
    assert all(letters[lang] > 0.9 * len(one[lang]) - 20 for lang in one)


def test_viterbi_matches_brute_force():
    rng = np.random.default_rng(7)
    rows = np.sort(rng.integers(0, 6, 40))
    scores = rng.normal(0, 5, (40, 3)).astype(np.float32)
    path = language_id.viterbi(scores, rows, 7, 4.0)
    for r in range(6):
        s = scores[rows == r].astype(float)
        if not len(s):
            continue
        best, back = s[0].copy(), []
        for t in range(1, len(s)):
            cost = best[:, None] - 4.0 * (1 - np.eye(3))
            back.append(cost.argmax(0))
            best = cost.max(0) + s[t]
        want = [int(best.argmax())]
        for b in back[::-1]:
            want.append(int(b[want[-1]]))
        got = path[rows == r]
        value = lambda p: sum(s[i, k] for i, k in enumerate(p)) - 4.0 * sum(a != b for a, b in zip(p, p[1:]))
        assert value(got) == pytest.approx(value(want[::-1]), abs=1e-3)


def test_scripts_narrow_before_scoring():
    rng = np.random.default_rng(3)
    table = rng.normal(size=(language_id.BUCKETS, 3)).astype(np.float32)
    candidates = np.ones((len(language_id.SCRIPTS), 3), dtype=bool)
    candidates[language_id.SCRIPTS.index("Cyrillic")] = [False, False, True]
    texts = ["one " + "x" * 70_000 + " два три", "", "слово end", "12 !"]
    folded, starts, ends, _, _ = language_id._words(texts)
    got = language_id.word_scores(folded, starts, ends, table, candidates)
    grams = language_id._trigrams(folded)
    for k, (s, e) in enumerate(zip(starts, ends)):
        want = table[grams[s : e + 1]].sum(axis=0, dtype=np.float64)
        if language_id._script(folded[[s]])[0] == language_id.SCRIPTS.index("Cyrillic"):
            assert np.isneginf(got[k, :2]).all() and np.isclose(got[k, 2], want[2], rtol=1e-5)
        else:
            assert np.allclose(got[k], want, rtol=1e-4, atol=1e-3)
    row, (start, end), path = language_id._label(texts, (["a", "b", "c"], table, candidates))
    assert len(path) == 6 and (path[[2, 3, 4]] == 2).all()
