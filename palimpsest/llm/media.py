"""Media columns: content-defined payload chunking (operator 9).

A payload (UTF-8 text, padded) is stored as 8-bit samples in a WAVE file. The file is cut where a
rolling gear hash of its last ``WINDOW`` bytes has ``MASK_BITS`` zero bits, so equal passages make
equal chunks wherever they stand. Chunk digests are counted by a Spark group-by; a chunk whose digest
occurs once stays in its row, the others go to a chunk store with one row for each digest. The
stored form of every payload is its ordered chunk list, written with the bytes or the digest of each
chunk; all results come from reading it again: the list is joined with the store, each chunk's digest
and the whole are verified, and the samples are taken out of the file.

Which digests occur more than once is told to the readers as a bitmap sized by their number
(2**MOST_BITS bits, 32 MB, at most). A false hit costs a trip to the store and nothing else, so any input is
handled alike; payloads are never shuffled for their unique chunks.

Defined results: null text is an empty payload of 192 blanks; equal texts give equal values; repeated
rows are separate rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import mix64, staged, table, text_blocks, texts_of

UNIT = 192
RATE = 8000
WINDOW = 16
MASK_BITS = 11
LEAST, MOST = 512, 16384
#: Bits of the bitmap for each repeated digest, and the most of it, as a power of two.
BITS_EACH, MOST_BITS = 16, 28

#: One pseudo-random number for each byte value.
_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)

SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks int"


def payload_of(text: bytes) -> bytes:
    return text + b" " * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def wave_file(samples: bytes) -> bytes:
    """A mono WAVE file of 8-bit samples."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples


def samples_of(media: bytes) -> bytes:
    """The samples of a file by :func:`wave_file`; its header is checked."""
    riff, size, wave, _, _, coding, channels, _, _, _, bits, data, n = struct.unpack_from("<4sI4s4sIHHIIHH4sI", media)
    if (riff, wave, data, coding, channels, bits) != (b"RIFF", b"WAVE", b"data", 1, 1, 8) or n != len(media) - 44 or size != n + 36:
        raise ValueError("not an 8-bit mono WAVE file")
    return media[44:]


def chunk_ends(media: bytes) -> list[int]:
    """Ends of the chunks: where the gear hash of the window has zero low bits, between LEAST and MOST bytes apart."""
    gear = _GEAR[np.frombuffer(media, dtype=np.uint8)]
    width = 1
    while width < WINDOW:  # gear(i) + 2 gear(i-1) + 4 gear(i-2) + ... over the window, by doubling
        if len(gear) > width:
            gear = np.concatenate([gear[:width], gear[width:] + (gear[:-width] << np.uint32(width))])
        width *= 2
    cuts = np.flatnonzero(gear >> np.uint32(WINDOW - MASK_BITS) & np.uint32((1 << MASK_BITS) - 1) == 0) + 1
    ends, last, n, at = [], 0, len(media), 0
    while n - last > LEAST:
        at = int(np.searchsorted(cuts, last + LEAST))
        end = int(cuts[at]) if at < len(cuts) else n
        last = min(end, last + MOST, n)
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def feature_of(samples: bytes) -> str:
    """Mean, root mean square, crossings of the middle, and a histogram over eight ranges."""
    x = np.frombuffer(samples, dtype=np.uint8)
    centred = x.astype(np.int64) - 128
    crossings = int(np.count_nonzero(np.diff(centred >= 0)))
    histogram = np.bincount(x >> 5, minlength=8)
    return f"mean={centred.mean():.6f};rms={np.sqrt((centred * centred).mean()):.6f};crossings={crossings};histogram={','.join(map(str, histogram.tolist()))}"


def _described(doc_id, n_bytes: int, media: bytes, chunks: int) -> tuple:
    samples = samples_of(media)
    return (
        doc_id, n_bytes, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]),
        len(media), hashlib.sha256(media).hexdigest(), feature_of(samples), chunks,
    )


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _chunks(text: bytes) -> tuple[bytes, list[bytes]]:
    media = wave_file(payload_of(text))
    ends = chunk_ends(media)
    return media, [media[s:e] for s, e in zip([0, *ends], ends)]


def _digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()


def digests(texts: DataFrame) -> DataFrame:
    """(digest) of every chunk of every text's file."""
    schema = pa.schema([("digest", pa.binary())])

    def run(batches):
        for batch in batches:
            for _, _, raw, offs in text_blocks(batch.column("text")):
                data = raw.tobytes()
                yield _batch([(_digest(c),) for s, e in zip(offs[:-1].tolist(), offs[1:].tolist()) for c in _chunks(data[s:e])[1]], schema)

    return texts.mapInArrow(run, "digest binary")


def repeated_bitmap(found: DataFrame) -> np.ndarray:
    """The places of digests that occur more than once, as 64-bit words: a bounded size for any input."""
    repeated = staged(found.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"))
    size = 1 << min(MOST_BITS, max(16, (repeated.count() * BITS_EACH).bit_length()))
    # the first four bytes, little end first, as in _shared
    octet = [F.conv(F.hex(F.substring("digest", k, 1)), 16, 10).cast("long") for k in (1, 2, 3, 4)]
    place = (octet[0] + octet[1] * 256 + octet[2] * 65536 + octet[3] * 16777216).bitwiseAND(F.lit(size - 1))
    words = (
        repeated.select(place.alias("place"))
        .groupBy(F.shiftright("place", 6).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits"))
        .toArrow()
    )
    out = np.zeros(size >> 6, dtype=np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _shared(bitmap: np.ndarray, digest: bytes) -> bool:
    place = int.from_bytes(digest[:4], "little") & (64 * len(bitmap) - 1)
    return bool(bitmap[place >> 6] >> np.uint64(place & 63) & np.uint64(1))


#: A stored file: its chunks in order. ``own`` is null where the digest may be repeated: that chunk is in the
#: store, and its bytes in ``far`` of this row only until the store is made.
LISTED = "row long, doc_id long, n_bytes long, media_sha256 string, n_far int, list array<struct<seq:int,digest:binary,own:binary,far:binary>>"


def listed(texts: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """The stored form of every file, see ``LISTED``: one row a file."""
    held = texts.sparkSession.sparkContext.broadcast(bitmap)
    chunk_type = pa.struct([("seq", pa.int32()), ("digest", pa.binary()), ("own", pa.binary()), ("far", pa.binary())])
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media_sha256", pa.string()), ("n_far", pa.int32()), ("list", pa.list_(chunk_type))])

    def run(batches):
        for batch in batches:
            ids, numbers = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
            for lo, _, raw, offs in text_blocks(batch.column("text")):
                data, rows = raw.tobytes(), []
                for i, (s, e) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
                    media, chunks = _chunks(data[s:e])
                    named = [(_digest(c), c) for c in chunks]
                    shared = [_shared(held.value, d) for d, _ in named]
                    chunk_list = [{"seq": k, "digest": d, "own": None if far else c, "far": c if far else None} for k, ((d, c), far) in enumerate(zip(named, shared))]
                    rows.append((numbers[lo + i], ids[lo + i], e - s, hashlib.sha256(media).hexdigest(), sum(shared), chunk_list))
                yield _batch(rows, schema)

    return texts.mapInArrow(run, LISTED)


def read_back(lists: DataFrame, store: DataFrame) -> DataFrame:
    """The results of stored files, each chunk and file verified; only files with a chunk in the store are shuffled."""
    head = ["row", "doc_id", "n_bytes", "media_sha256"]
    whole = lists.where("n_far = 0").select(*head, F.transform("list", lambda c: F.struct(c["seq"].alias("seq"), c["digest"].alias("digest"), c["own"].alias("chunk"))).alias("list"))
    apart = lists.where("n_far > 0").select(*head, F.explode("list").alias("c")).select(*head, "c.seq", "c.digest", "c.own")
    near = apart.where("own IS NOT NULL").withColumnRenamed("own", "chunk")
    far = apart.where("own IS NULL").drop("own").join(store, "digest").select(*head, "seq", "digest", "chunk")
    ordered = near.unionByName(far).groupBy(*head).agg(F.array_sort(F.collect_list(F.struct("seq", "digest", "chunk"))).alias("list"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_chunks", pa.int32())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = []
                for r in batch.slice(at, 200).to_pylist():
                    chunks = [c["chunk"] for c in r["list"]]
                    if [c["seq"] for c in r["list"]] != list(range(len(chunks))) or any(_digest(c["chunk"]) != c["digest"] for c in r["list"]):
                        raise ValueError(f"a chunk of row {r['row']} is not what its list says")
                    media = b"".join(chunks)
                    row = _described(r["doc_id"], r["n_bytes"], media, len(chunks))
                    if row[6] != r["media_sha256"]:
                        raise ValueError(f"row {r['row']} doesn't read back")
                    rows.append(row)
                yield _batch(rows, schema)

    return whole.unionByName(ordered).mapInArrow(run, SCHEMA)


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row, see ``SCHEMA``."""
    texts = texts_of(docs, id_col, text_col)
    bitmap = repeated_bitmap(digests(texts))
    lists = staged(listed(texts.withColumn("row", F.monotonically_increasing_id()), bitmap))
    # one row for each digest, whichever copy comes first; copies in one task meet before the shuffle
    far = lists.where("n_far > 0").select(F.explode(F.filter("list", lambda c: c["own"].isNull())).alias("c"))
    store = staged(far.groupBy("c.digest").agg(F.first("c.far").alias("chunk")))
    return read_back(lists, store)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media(table(spark, sf_dir, "documents"))
