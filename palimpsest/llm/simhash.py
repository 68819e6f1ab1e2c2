"""SimHash near-dedup with BK-trees (operator 6).

A text is lower-cased (A-Z), cut into words and shingles; a fingerprint bit is set when it is set in
over half of the shingles' XXH64 values (seed 42), repeats included. Distinct fingerprints link at
``radius`` or fewer differing bits; documents of one connected component are one group.

The fingerprints are dealt into shards such that any two within the radius share one: the 64 bits
are cut into radius + 1 parts, one of which must agree; as many bits of each part name a shard as keep
shards near ``SHARD_AIM`` fingerprints. A shard with more than ``SHARD_ROWS`` of them is cut on, by the
whole part and then by the other bits in the same way, so no hot shard lands in one task, and no link
is lost. Each shard becomes a BK-tree: children are keyed
by their Hamming distance to the parent, and a query follows only edges within the radius of its own
distance. A tree of all fingerprints would grow with the corpus and can't be broadcast; the shard's
tree and its queries meet by shuffle instead. A shard reports a star of links for each component it
sees, at most one a fingerprint, and label propagation with pointer jumping joins the stars.

Defined results: null or blank text has fingerprint zero and links like any other; fewer words than
a shingle make one shingle; repeated rows share a group; a null id never is a component's id unless
the whole component has null ids; other columns are ignored or, in :func:`near_dedup`, carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import jaccard
from ._common import staged, table, text_blocks, texts_of
from .exact_dedup import split_by_keys

SEED = 42
#: Fingerprints that a shard should have, and in one shard before it is cut on.
SHARD_AIM = 2048
SHARD_ROWS = 20_000
#: Members of a subtree that are compared as one block.
LEAF = 48


def shingles(text: bytes, width: int) -> list[bytes]:
    words = text.lower().split()  # bytes: only A-Z and ASCII white space
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*[words[i:] for i in range(width)])))


def fingerprint(text: bytes, width: int) -> int:
    parts = shingles(text, width)
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(x, SEED) for x in parts], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65536):
        octets = h[at : at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(texts: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp long) of every text."""

    def run(batches):
        for batch in batches:
            fps = []
            for _, _, raw, offs in text_blocks(batch.column("text")):
                data = raw.tobytes()
                fps += [fingerprint(data[s:e], width) for s, e in zip(offs[:-1].tolist(), offs[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return texts.mapInArrow(run, "doc_id long, fp long")


def _parts(bits: list[int], pieces: int) -> list[list[int]]:
    return [x.tolist() for x in np.array_split(np.array(bits, dtype=int), pieces) if len(x)]


def first_masks(radius: int, rows: int) -> list[int]:
    """Masks of the first bits of each part, as many as make shards of about ``SHARD_AIM`` of ``rows`` values."""
    wanted = (max(rows, 1) // SHARD_AIM).bit_length()
    return sorted({sum(1 << b for b in part[:wanted]) for part in _parts(list(range(64)), radius + 1)})


def shard_masks(radius: int, levels: int, bits: list[int] | None = None, taken: int = 0) -> list[int]:
    """Masks of the bits that name a shard: two values within the radius agree under one of them."""
    bits = list(range(64)) if bits is None else bits
    if not levels or len(bits) <= radius:
        return [taken]
    out = []
    for part in _parts(bits, radius + 1):
        rest = [b for b in bits if b not in part]
        out += shard_masks(radius, levels - 1, rest, taken | sum(1 << b for b in part))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _dealt(fps: DataFrame, masks: list[int]) -> DataFrame:
    """(mask int, shard long, fp): every fingerprint once for each mask."""
    masks = F.lit([_signed(m) for m in masks])
    return fps.select("fp", F.posexplode(F.transform(masks, lambda m: m.bitwiseAND(F.col("fp")))).alias("mask", "shard")).select("mask", "shard", "fp")


def bk_links(values: np.ndarray, radius: int, work: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions of ``values`` within the radius, found by walking a BK-tree of them.

    The tree is built as it is walked: the first member is the node, the others fall to its children
    by distance, and of the queries only those within the radius of an edge go along it. The queries
    of a node are the members themselves, so a pair is found once or twice. ``work`` gets the number of
    comparisons of each node.
    """
    work = [] if work is None else work
    left, right = [], []
    todo = [(np.arange(len(values)), np.arange(len(values)))]
    while todo:
        members, queries = todo.pop()
        if len(members) <= LEAF:
            work.append(len(members) * len(queries))
            for at in range(0, len(queries), 65536):
                part = queries[at : at + 65536]
                near = np.bitwise_count(values[members][:, None] ^ values[part][None, :]) <= radius
                a, b = np.nonzero(near)
                a, b = members[a], part[b]
                left.append(a[a < b])
                right.append(b[a < b])
            continue
        node, rest = members[0], members[1:]
        work.append(len(queries) + len(rest))
        to_query = np.bitwise_count(values[queries] ^ values[node]).astype(np.int64)
        found = queries[to_query <= radius]
        found = found[found != node]
        left.append(np.full(len(found), node))
        right.append(found)
        to_child = np.bitwise_count(values[rest] ^ values[node]).astype(np.int64)
        order = np.argsort(to_child, kind="stable")
        edges, first = np.unique(to_child[order], return_index=True)
        for edge, child in zip(edges.tolist(), np.split(rest[order], first[1:])):
            along = queries[np.abs(to_query - edge) <= radius]
            if len(along):
                todo.append((child, along))
    return np.concatenate(left or [np.zeros(0, int)]), np.concatenate(right or [np.zeros(0, int)])


def _stars(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest position that each position reaches."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def shard_stars(dealt: DataFrame, radius: int, partitions: int | None = None) -> DataFrame:
    """(a, b) fingerprints that one shard found linked, b the first of its component there."""

    def run(batches):
        held: list[tuple] = []

        def close(rows):
            fps = np.unique(np.concatenate([r for _, r in rows])).view(np.uint64)
            if len(fps) < 2:
                return None
            label = _stars(len(fps), *bk_links(fps, radius))
            moved = np.flatnonzero(label != np.arange(len(fps)))
            return pa.RecordBatch.from_arrays([pa.array(fps[moved].view(np.int64)), pa.array(fps[label[moved]].view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            mask, shard, fp = (batch.column(c).to_numpy() for c in ("mask", "shard", "fp"))
            cuts = np.flatnonzero((np.diff(mask) != 0) | (np.diff(shard) != 0)) + 1
            bounds = np.concatenate([[0], cuts, [len(fp)]])
            sizes = np.diff(bounds)
            # most shards are small and lie within a batch: compare each row with those up to LEAF places on
            inner = (sizes <= LEAF) & (sizes > 1)
            inner[[0, -1]] = False
            if inner.any():
                rows = np.flatnonzero(np.repeat(inner, sizes))
                shard_of, values = np.repeat(np.arange(len(sizes)), sizes)[rows], fp[rows].view(np.uint64)
                a, b = [], []
                for step in range(1, int(sizes[inner].max())):
                    near = (shard_of[step:] == shard_of[:-step]) & (np.bitwise_count(values[step:] ^ values[:-step]) <= radius)
                    at = np.flatnonzero(near)
                    a.append(at + step)
                    b.append(at)
                label = _stars(len(values), np.concatenate(a), np.concatenate(b))
                moved = np.flatnonzero(values[label] != values)
                if len(moved):
                    yield pa.RecordBatch.from_arrays([pa.array(values[moved].view(np.int64)), pa.array(values[label[moved]].view(np.int64))], names=["a", "b"])
            for i in np.flatnonzero(~inner & ((sizes > 1) | (np.arange(len(sizes)) % max(1, len(sizes) - 1) == 0))).tolist():
                lo, hi = bounds[i], bounds[i + 1]
                key = (mask[lo], shard[lo])
                if held and held[0][0] != key:
                    if sum(len(r) for _, r in held) > 1 and (out := close(held)) is not None:
                        yield out
                    held = []
                held.append((key, fp[lo:hi]))
        if held and (out := close(held)) is not None:
            yield out

    parts = partitions or int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = dealt.repartition(parts, "mask", "shard").sortWithinPartitions("mask", "shard", "fp")
    return grouped.mapInArrow(run, "a long, b long")


def links(fps: DataFrame, radius: int) -> DataFrame:
    """(a, b): stars of links whose components are those of all links between ``fps`` (fp long, distinct)."""
    found = None
    masks, levels = first_masks(radius, fps.count()), 0
    while True:
        finer = shard_masks(radius, levels + 1)
        dealt = _dealt(fps, masks)
        large = staged(dealt.groupBy("mask", "shard").agg(F.count("*").alias("n")).where(F.col("n") > SHARD_ROWS).select("mask", "shard"))
        done = large.isEmpty() or finer == masks
        stars = shard_stars(dealt if done else dealt.join(large, ["mask", "shard"], "left_anti"), radius)
        found = stars if found is None else found.unionByName(stars)
        if done:
            return found
        fps = staged(dealt.join(large, ["mask", "shard"], "left_semi").select("fp").distinct())
        masks, levels = finer, levels + 1


def contracted(edges: DataFrame) -> DataFrame:
    """Stars instead of ``edges`` (a, b), as connected, at most one edge for each node and run of a million edges."""

    def star(held):
        left, right = (np.concatenate(x) for x in zip(*held))
        nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
        label = _stars(len(nodes), at[: len(left)], at[len(left) :])
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], names=["a", "b"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            size += batch.num_rows
            if size > 1_000_000:
                yield star(held)
                held, size = [], 0
        if size:
            yield star(held)

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes of ``edges`` (a, b): label is the least node reachable.

    Each round takes the least label among neighbours, then the label's own label, so a path halves.
    """
    pairs = staged(contracted(edges).distinct())
    # a node's neighbours and itself hang on the least of them: as connected, with about one edge a node
    hung = pairs.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    pairs = hung.select("a", F.col("m").alias("b")).unionByName(hung.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
    both = staged(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        to = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        jumped = staged(stepped.join(to, "next").select("node", F.col("label").alias("old"), F.least("next", "far").alias("label")))
        labels = jumped.select("node", "label")
        if jumped.where("label < old").isEmpty():
            return labels


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of every row: the smallest id that links reach, its own included."""
    small = staged(fingerprints(texts_of(docs, id_col, text_col), width))
    distinct = staged(small.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(staged(links(distinct.select("fp"), radius)))
    linked = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    ids = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    of_fp = linked.join(ids, "label").select("fp", "component_id")
    return small.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, radius: int = 6, floor: float = 0.8) -> DataFrame:
    """The rows of ``docs``, with every column, without those that link to a smaller id.

    A null id comes after all others; equal rows (same id and text) stay or go together; empty texts
    have no shingle and are each other's copies only if equal.

    Texts link when the Jaccard similarity of their shingles is ``floor`` or more. Fingerprints within
    ``radius`` propose pairs, each with its least neighbour; an exact prefix filter proposes the others,
    see :mod:`.jaccard`.
    """
    texts = texts_of(docs, id_col, text_col).withColumn("tid", F.xxhash64("text"))

    def run(batches):
        for batch in batches:
            ids, tids = batch.column("doc_id"), batch.column("tid")
            for lo, hi, raw, offs in text_blocks(batch.column("text")):
                data = raw.tobytes()
                parts = [data[s:e] for s, e in zip(offs[:-1].tolist(), offs[1:].tolist())]
                fp = pa.array(np.array([fingerprint(x, width) for x in parts], dtype=np.uint64).view(np.int64))
                nodes = pa.array([jaccard.node_of(x) for x in parts], pa.int64())
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), tids.slice(lo, hi - lo), fp, nodes], names=["doc_id", "tid", "fp", "node"])

    small = staged(texts.mapInArrow(run, "doc_id long, tid long, fp long, node long"))
    linked = staged(links(small.select("fp").distinct(), radius))
    both = linked.select(F.col("a").alias("fp"), F.col("b").alias("other")).unionByName(linked.select(F.col("b").alias("fp"), F.col("a").alias("other")))
    near = both.groupBy("fp").agg(F.min("other").alias("other")).select("fp", F.least("fp", "other").alias("label"))
    alike = small.select("fp", "node").distinct().join(near, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    firsts = alike.groupBy("label").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1")
    proposed = alike.join(firsts, "label").select("a", F.col("node").alias("b"))
    found = jaccard.labels(texts.select("tid", "text"), small.select("tid", "node").distinct(), proposed, width, floor)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tid")
    labelled = small.join(found, "node", "left").select("doc_id", "tid", F.coalesce("label", "node").alias("label")).withColumn("place", place)
    least = labelled.groupBy("label").agg(F.min("place").alias("least"))
    drop = staged(labelled.join(least, "label").where("place <> least").select(F.col("doc_id").alias("_id"), F.col("tid").alias("_tid")).distinct())
    mark = "_" * (1 + max(len(c) for c in docs.columns))  # no column has such a name
    drop = drop.withColumnsRenamed({"_id": f"_id{mark}", "_tid": f"_tid{mark}"})
    # only rows whose text may be one that goes move to meet the list of those
    docs, others = split_by_keys(docs, F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))), drop.select(F.col(f"_tid{mark}").alias("fp")))
    same_text = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))) == drop[f"_tid{mark}"]
    return docs.join(drop.hint("merge"), docs[id_col].cast("long").eqNullSafe(drop[f"_id{mark}"]) & same_text, "left_anti").unionByName(others)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
