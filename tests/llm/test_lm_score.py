import math
from collections import Counter

import numpy as np
import pytest

from palimpsest.llm import lm_score


def brute(texts):
    docs = [(t or "").encode().lower().split() for t in texts]
    c1 = Counter(w for d in docs for w in d)
    c2 = Counter(p for d in docs for p in zip(d, d[1:]))
    total = sum(c1.values())
    out = []
    for d in docs:
        s = math.log(c1[d[0]] / total) if d else 0.0
        for v, w in zip(d, d[1:]):
            s += math.log(c2[v, w] / c1[v]) if c2[v, w] >= lm_score.LEAST else math.log(lm_score.BACKOFF * c1[w] / total)
        out.append((len(d), s))
    return out


@pytest.mark.parametrize("share", [1e-5, 0.02, 2.0])
def test_matches_brute_force(spark, share):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, n)) for n in rng.integers(0, 120, 60)]
    texts += [None, "", " \n", "One", "one", "é É", "same same same same", *[texts[0]] * 3, "x " * 5000]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, row int").repartition(3)
    found = {r.doc_id: r for r in lm_score.score(df, share=share).collect()}
    assert len(found) == len(texts)
    for i, (n, s) in enumerate(brute(texts)):
        assert found[i].n_words == n and found[i].log_prob == pytest.approx(s, rel=1e-9, abs=1e-9)
        assert (found[i].score is None) == (n == 0)


def test_empty(spark):
    assert lm_score.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
