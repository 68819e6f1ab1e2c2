import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from palimpsest.llm import packing

TEXTS = ["a", None, "", "Hello world, hello.", "é ñ ü ç — “x” 漢字    \U0001f600", "x" * 3000, "word " * 3000, "1 22 333\t\n\n  4", "don't we'll I'm", "<|endoftext|>?", "a <|endoftext|> b<|endoftext|><|endoftext|>\n<|endoftext|", "<|endoftext|>"]


def ids(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")


def test_pieces_and_places(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(0, "a"), (None, "b")]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, length int").repartition(3)
    found = packing.pack(df).collect()
    for i, text in enumerate(TEXTS[1:], 1):
        whole, mine = ids(text), sorted((r for r in found if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and sum(r.length for r in mine) == len(whole)
        assert len(mine) == -(-len(whole) // 1024)
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(whole[r.start : r.start + r.length].tobytes())
    assert sum(r.doc_id == 0 for r in found) == 2
    by = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(df.limit(0)).collect() == []


def brute_best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [(g, k) for k, g in enumerate(gaps) if g >= n]
        if fits:
            gaps[min(fits)[1]] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_as_few_as_sequential_best_fit():
    rng = np.random.default_rng(1)
    for capacity in (10, 64, 1024):
        for _ in range(5):
            lengths = rng.integers(1, capacity + 1, 300)
            counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
            plan, used = packing.best_fit(counts, capacity), {}
            for n, many in counts.items():
                mine = plan[plan[:, 0] == n]
                for rank in range(many):
                    _, first_rank, first, each, offset = mine[np.searchsorted(mine[:, 1], rank, side="right") - 1]
                    at = rank - first_rank
                    used.setdefault(int(first + at // each), []).append((int(offset + n * (at % each)), n))
            for places in used.values():
                at = 0
                for offset, n in sorted(places):
                    assert offset == at
                    at += n
                assert at <= capacity
            assert len(used) == brute_best_fit(lengths.tolist(), capacity)
