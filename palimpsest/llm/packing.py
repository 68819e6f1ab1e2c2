"""Best-fit packing (operator 5).

Documents become token ids with an end token; one longer than the capacity is cut into full pieces,
the first of which may be shorter. Full pieces fill a sequence each. The others are packed by
bulk-synchronous best fit, longest first: pieces are range-sorted by length and open sequences by
their gap, each round matches all pieces of one length to their successor gaps (the smallest that
hold them), pieces that want the same gap are told apart by rank, the gaps are updated, pieces that
fit nowhere open sequences, and the next length follows.

Lengths and gaps are whole numbers up to the capacity, and pieces of one length (or sequences of one
gap) can stand for each other. So the rounds run on run lengths: how many pieces there are of each
length, and which intervals of sequences have each gap. That is at most ``capacity`` counts, whatever
the corpus; the pieces themselves stay distributed, take a rank within their length (hot lengths in
buckets, see ``rank_in_class``) and look their place up by length and rank.

Ids: the vocabulary file is read as ranks by tiktoken, which gives the ids of the tokenizers file of
the same name (tested) at about five times its speed.

Defined results: null text is empty and becomes the end token alone; repeated rows are packed each;
the string of the added token in a text becomes its id, as with tokenizers; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import rank_in_class, staged, table, text_blocks, texts_of

CAPACITY = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k"
#: Fixed value: the added token of the tokenizers file, which its string in a text becomes.
ADDED = {"<|endoftext|>": 50256}


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY):
    """The byte-level BPE of a public vocabulary file."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)


def token_ids(text: str, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> np.ndarray:
    ids = encoder(vocabulary).encode_to_numpy(text, allowed_special="all")
    return np.append(ids, end_id).astype("<u4")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(texts: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every text."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for lo, hi, raw, offs in text_blocks(batch.column("text")):
                data, rows = raw.tobytes(), []
                for i in range(hi - lo):
                    tokens = token_ids(data[offs[i] : offs[i + 1]].decode("utf-8", "replace"), vocabulary, end_id)
                    rows += [(ids[lo + i], k, s, n, zlib.crc32(tokens[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(tokens), capacity))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return texts.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces in each sequence, offset), sorted.

    ``counts`` has the number of pieces of each length. A row covers the ranks up to the next row of
    its length: of those, each next group of ``pieces in each sequence`` goes to the next sequence.
    """
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # intervals (first sequence, how many)
    plan: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def fill(length: int, rank: int, left: int, first: int, many: int, gap: int) -> int:
        """Puts up to ``left`` pieces into the interval; returns how many. What is filled moves to its new gap."""
        each = gap // length
        whole = min(many, left // each)
        if whole:
            plan.append((length, rank, first, each, capacity - gap))
            gaps[gap - each * length].append((first, whole))
        placed = whole * each
        if whole < many and (rest := min(left - placed, each - 1)):
            plan.append((length, rank + placed, first + whole, rest, capacity - gap))
            gaps[gap - rest * length].append((first + whole, 1))
            placed, whole = placed + rest, whole + 1
        if whole < many:
            gaps[gap].append((first + whole, many - whole))
        return placed

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        for gap in range(length, capacity + 1):  # the successor sweep
            waiting, gaps[gap] = gaps[gap], []
            for k, (first, many) in enumerate(waiting):
                if not left:
                    gaps[gap] += waiting[k:]
                    break
                placed = fill(length, rank, left, first, many, gap)
                rank, left = rank + placed, left - placed
            if not left:
                break
        if left:
            each = capacity // length
            new = -(-left // each)
            fill(length, rank, left, opened, new, capacity)
            opened += new
    return np.array(sorted(plan), dtype=np.int64).reshape(-1, 5)


def placed(ranked_pieces: DataFrame, plan: np.ndarray) -> DataFrame:
    """Adds sequence_id and offset to pieces with a rank within their length."""
    shared = ranked_pieces.sparkSession.sparkContext.broadcast(plan)

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(length, rank):
        import pandas as pd

        plan = shared.value
        # lengths are few: one search within each
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        row = np.zeros(len(ranks), dtype=np.int64)
        for n in np.unique(lengths):
            lo, hi = np.searchsorted(plan[:, 0], [n, n + 1])
            here = lengths == n
            row[here] = lo + np.searchsorted(plan[lo:hi, 1], ranks[here], side="right") - 1
        _, first_rank, first, each, offset = plan[row].T
        at = ranks - first_rank
        return pd.DataFrame({"sequence_id": first + at // each, "offset": offset + lengths * (at % each)})

    out = ranked_pieces.withColumn("_place", place("length", "rank"))
    return out.select(*[c for c in ranked_pieces.columns if c != "rank"], "_place.sequence_id", "_place.offset")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut_up = staged(pieces(texts_of(docs, id_col, text_col), capacity, vocabulary, end_id))
    counts = {r.length: r.n for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    ranks = rank_in_class(cut_up, "length", ["doc_id", "piece", "start", "ids_crc32"], sum(counts.values()))
    return placed(ranks, best_fit(counts, capacity))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
