import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import media


def test_chunks_join_to_the_file():
    rng = np.random.default_rng(1)
    for n in (0, 1, 191, 192, 193, 5000, 200_000):
        text = rng.integers(32, 127, n).astype(np.uint8).tobytes()
        whole, chunks = media._chunks(text)
        assert b"".join(chunks) == whole and all(chunks)
        assert all(len(c) <= media.MOST for c in chunks) and all(len(c) >= media.LEAST for c in chunks[:-1])
        assert media.samples_of(whole) == media.payload_of(text)


def test_cuts_follow_the_content():
    rng = np.random.default_rng(2)
    text = rng.integers(32, 127, 100_000).astype(np.uint8).tobytes()
    a, b = set(media._chunks(text)[1]), set(media._chunks(b"ahead " + text)[1])
    assert len(a & b) > 0.9 * len(a)


def test_rows_read_back(spark):
    rng = np.random.default_rng(3)
    long = "".join(chr(c) for c in rng.integers(97, 123, 60_000))
    rows = [(1, "a"), (2, None), (3, ""), (4, long), (5, "x" + long), (6, long), (6, long), (None, "é" * 300), (7, " " * 192), (8, "b" * 50_000)]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, row int, digest string").repartition(3)
    found = media.media(df).collect()
    assert len(found) == len(rows)
    want = {}
    for i, t in rows:
        raw = (t or "").encode()
        padded = raw + b" " * (-len(raw) % 192) if raw else b" " * 192
        want[i] = (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
    for r in found:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == want[r.doc_id]
    assert len({(r.media_sha256, r.feature) for r in found if r.doc_id in (4, 6)}) == 1
    assert media.media(df.limit(0)).collect() == []


def test_every_row_is_stored_and_verified(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, "".join(chr(c) for c in rng.integers(97, 123, 3000 + i))) for i in range(6)]  # no chunk is repeated
    df = spark.createDataFrame(rows, "doc_id long, text string")
    written, real = [], media.staged

    def spy(frame):
        out = real(frame)
        written.append(out)
        return out

    monkeypatch.setattr(media, "staged", spy)
    assert media.media(df).count() == 6
    stored = next(t for t in written if "list" in t.columns)
    assert {r.doc_id: b"".join(bytes(c.own) for c in r.list) for r in stored.collect()} == {i: media.wave_file(media.payload_of(t.encode())) for i, t in rows}
    # a byte that changes in the table is found when it is read
    broken = stored.withColumn("list", F.transform("list", lambda c: c.withField("own", F.concat(F.lit(b"x"), F.substring(c["own"], 2, 1 << 20)))))
    store = spark.createDataFrame([], "digest binary, chunk binary")
    with pytest.raises(Exception, match="not what its list says"):
        media.read_back(broken, store).collect()
