"""Near copies by the exact Jaccard similarity of their shingle sets (near-duplicate stage of the pipeline).

Texts are nodes: the XXH3 of the folded words names one. Any fixed order of shingles makes a prefix
filter exact: of two sets with a similarity of ``floor`` or more, the first n - ceil(floor n) + 1
shingles of each have one in common. The order here is rarest first, by counts in a table of fixed size
(``SLOTS``); a collision there costs rows, never a pair, and a passage that many texts share comes last.

First texts meet a hub of their size under the shingles of their prefix, so a family of copies costs a few
rows a text; further rounds with other hubs follow while what is left has many meetings and a round halves
them. What these links leave apart meets in full, bounded by sizes and places; every pair is verified on
the shingles themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import staged, text_blocks
from .exact_dedup import hit, quotient_bitmap, split_by_keys

SLOTS = 1 << 24
#: Slots of one row of a partition's table.
BLOCK = 1 << 16


def _sets(texts, width):
    """(row, node, sorted distinct shingle hashes) of each text."""
    from .simhash import SEED, shingles

    digest = xxhash.xxh64_intdigest
    for lo, _, raw, offs in text_blocks(texts):
        data = raw.tobytes()
        for i, (s, e) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
            text = data[s:e]
            hashes = np.unique(np.array([digest(x, SEED) for x in shingles(text, width)], dtype=np.uint64))
            yield lo + i, node_of(text), hashes


def node_of(text: bytes) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(b" ".join(text.lower().split()))).view(np.int64))


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SLOTS - 1)).astype(np.int64)


def shingle_levels(texts: DataFrame, width: int) -> np.ndarray:
    """About four times the binary logarithm of each slot's count of texts; 0 where one text at most has it."""

    def run(batches):
        counts, held, n = np.zeros(SLOTS, dtype=np.uint16), [], 0

        def add():
            slots, times = np.unique(np.concatenate(held), return_counts=True)
            counts[slots] = np.minimum(counts[slots] + times, 65535)

        for batch in batches:
            for _, _, hashes in _sets(batch.column("text"), width):
                held.append(_slot(hashes))
                n += len(hashes)
                if n > 1 << 20:
                    add()
                    held, n = [], 0
        if held:
            add()
        blocks = counts.astype("<u2", copy=False).reshape(-1, BLOCK)
        for i in np.flatnonzero(blocks.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([blocks[i].tobytes()], pa.binary())], names=["block", "counts"])

    def added(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column("block").to_pylist(), batch.column("counts")):
                totals.setdefault(block, np.zeros(BLOCK, dtype=np.int64))[:] += np.frombuffer(part.as_buffer(), dtype="<u2")
        for block, total in totals.items():
            levels = np.where(total > 1, 4 * np.log2(np.maximum(total, 1)), 0).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([levels.tobytes()], pa.binary())], names=["block", "levels"])

    out = np.zeros((SLOTS // BLOCK, BLOCK), dtype=np.uint8)
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = texts.select("text").mapInArrow(run, "block int, counts binary").repartition(parts, "block")
    for r in counted.mapInArrow(added, "block int, levels binary").collect():  # SLOTS bytes
        out[r.block] = np.frombuffer(r.levels, dtype=np.uint8)
    return out.ravel()


def prefix_length(n: int, floor: float) -> int:
    return n - int(np.ceil(floor * n - 1e-9)) + 1


#: Shingles that a kernel holds before it ships them, labels of parts for each partition, and bytes of a shingle's head.
SHIPPED = 500_000
LABELS = 4
HEAD = 6


def _prefix(hashes: np.ndarray, levels: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, their places) of a text's prefix that more than one text may have, as far as ``levels`` tell."""
    rank = levels[_slot(hashes)]
    first = np.lexsort((hashes, rank))[: prefix_length(len(hashes), floor)]
    place = np.flatnonzero(rank[first] > 0)
    return hashes[first[place]], place


def repeated(texts: DataFrame, held: Broadcast, width: int, floor: float) -> DataFrame:
    """(fp long): heads (the first ``HEAD`` bytes, then zeros) of all shingles that two texts or more have in their prefixes.

    Once the table of levels is full it tells nothing of rare shingles. Heads tell it at any size: one
    shingle travels as six bytes, not as a row. Two shingles of one head, or one text in two tasks, cost rows.
    """
    parts = np.uint64(LABELS * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def by_part(found: list[np.ndarray]) -> pa.RecordBatch:
        heads, times = np.unique(np.concatenate(found) >> np.uint64(64 - 8 * HEAD), return_counts=True)
        heads = np.repeat(heads, np.minimum(times, 2))
        part = (heads % parts).astype(np.int32)
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
        octets = heads[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HEAD]
        pieces = [octets[lo:hi].tobytes() for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)])]
        return pa.RecordBatch.from_arrays([pa.array(part[order][cuts]), pa.array(pieces, pa.binary())], names=["part", "heads"])

    def ship(batches):
        found: list[np.ndarray] = []
        size, seen = 0, set()
        for batch in batches:
            for _, node, hashes in _sets(batch.column("text"), width):
                if len(hashes) and node not in seen:
                    seen.add(node)
                    found.append(_prefix(hashes, held.value, floor)[0])
                    size += len(found[-1])
                if size > SHIPPED:
                    yield by_part(found)
                    found, size = [], 0
        if size:
            yield by_part(found)

    def meet(batches):
        pieces = [x.as_buffer() for batch in batches for x in batch.column("heads")]
        if not pieces:
            return
        octets = np.zeros((sum(len(x) for x in pieces) // HEAD, 8), dtype=np.uint8)
        octets[:, :HEAD] = np.frombuffer(b"".join(pieces), dtype=np.uint8).reshape(-1, HEAD)
        heads, times = np.unique(octets.view("<u8").ravel(), return_counts=True)
        shared = (heads[times > 1] << np.uint64(64 - 8 * HEAD)).view(np.int64)
        for at in range(0, len(shared), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(shared[at : at + 100_000])], names=["fp"])

    shipped = texts.select("text").mapInArrow(ship, "part int, heads binary")
    return shipped.repartition(int(parts) // LABELS, "part").mapInArrow(meet, "fp long")


NAMES = ["shingle", "node", "n", "place"]


def shipped(texts: DataFrame, held: Broadcast, shared: Broadcast, width: int, floor: float) -> DataFrame:
    """(part, shingle, node, n, place as arrays): the shingles of texts' prefixes that the bitmap of repeated heads lets by."""
    parts = np.uint64(LABELS * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def by_part(found: list[tuple]) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*found)]
        part = (columns[0].view(np.uint64) % parts).astype(np.int32)
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
        ends = pa.array(np.append(cuts, len(part)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(c[order])) for c in columns]
        return pa.RecordBatch.from_arrays([pa.array(part[order][cuts]), *lists], names=["part", *NAMES])

    def ship(batches):
        found: list[tuple] = []
        size, seen = 0, set()
        for batch in batches:
            for _, node, hashes in _sets(batch.column("text"), width):
                n = len(hashes)
                if not n or node in seen:
                    continue
                seen.add(node)
                first, place = _prefix(hashes, held.value, floor)
                use = hit(shared.value, first)
                if use.any():
                    first, place = first[use], place[use]
                    found.append((first.view(np.int64), np.full(len(place), node), np.full(len(place), n, dtype=np.int32), place.astype(np.int32)))
                    size += len(place)
                if size > SHIPPED:
                    yield by_part(found)
                    found, size = [], 0
        if found:
            yield by_part(found)

    return texts.select("text").mapInArrow(ship, "part int, shingle array<long>, node array<long>, n array<int>, place array<int>")


def prefixes(texts: DataFrame, levels: np.ndarray, width: int, floor: float) -> DataFrame:
    """(shingle, node, n, place): the shingles of texts' prefixes that two nodes or more have there.

    Most shingles are in one text only. Those that :func:`repeated` names travel as arrays by part of
    their hash; a part meets whole and lets go only what is shared.
    """
    context = texts.sparkSession.sparkContext
    held = context.broadcast(levels)
    shared = context.broadcast(quotient_bitmap(staged(repeated(texts, held, width, floor))))
    types = {"shingle": pa.int64(), "node": pa.int64(), "n": pa.int32(), "place": pa.int32()}

    def meet(batches):
        pieces: list[list[np.ndarray]] = [[] for _ in NAMES]
        for batch in batches:
            for piece, name in zip(pieces, NAMES):
                piece.append(batch.column(name).flatten().to_numpy())
        if not pieces[0]:
            return
        shingle, node, n, place = (np.concatenate(x) for x in pieces)
        order = np.lexsort((node, shingle))
        same = shingle[order][1:] == shingle[order][:-1]
        again = same & (node[order][1:] == node[order][:-1])  # one node in two tasks
        order = order[np.concatenate([[True], ~again])]
        same = shingle[order][1:] == shingle[order][:-1]
        order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        for at in range(0, len(order), 100_000):
            use = order[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(c[use], types[k]) for k, c in zip(NAMES, (shingle, node, n, place))], names=NAMES)

    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = shipped(texts, held, shared, width, floor).repartition(partitions, "part")
    out = staged(parts.mapInArrow(meet, "shingle long, node long, n int, place int"))
    for sent in (held, shared):  # both have been used up
        sent.destroy()
    return out


def verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, width: int, floor: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose shingle sets have a Jaccard similarity of ``floor`` or more.

    ``nodes`` (tid, node) tells one text of each node, ``texts`` (tid, text) holds it.
    """
    sides = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    one = staged(nodes.join(sides, "node", "left_semi").groupBy("node").agg(F.min("tid").alias("tid")))
    named, _ = split_by_keys(texts, F.col("tid"), one.select(F.col("tid").alias("fp")))  # texts that no pair names stay where they are
    # copies of a text are one row before they move, and once: a text has one node
    used = staged(named.groupBy("tid").agg(F.first("text").alias("text")).join(one.hint("merge"), "tid").select("node", "text"))
    # texts grow with the input, so they are merged at every size, also where a small table would be broadcast
    sided = pairs.join(used.withColumnsRenamed({"node": "a", "text": "x"}).hint("merge"), "a").join(used.withColumnsRenamed({"node": "b", "text": "y"}).hint("merge"), "b")

    def run(batches):
        from .simhash import shingles

        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = (set(shingles(t.as_py().encode(), width)) for t in (x, y))
                both = len(p & q)
                keep.append(both >= floor * (len(p) + len(q) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return sided.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


#: The hubs that a shingle's texts of one size may get by hash in each round after the first, and the meetings a
#: row of what is left up to which it meets in full without a further round.
HUBS, MEETINGS = 16, 32


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def can_reach(m, i, n, j, floor: float):
    """Whether sets of ``m`` and ``n`` shingles that first meet at places ``i`` and ``j`` can be similar enough."""
    most = F.least(m - i, n - j)
    return (1 + floor) * most >= floor * (m + n) - 1e-9


def size_class(floor: float, shift: float = 0):
    """A number of each size ``n`` such that sizes of one number are within a factor of ``floor``, and similar sets differ by one at most."""
    return F.floor(F.log(F.col("n").cast("double")) / np.log(1 / floor) + shift).cast("int")


def reaching(rows: DataFrame, floor: float) -> DataFrame:
    """Those of ``rows`` (shingle, node, n, place) that some size under their shingle lets pair.

    A text whose shingle stands late in its prefix pairs there only with smaller ones: it needs one. This is
    :func:`can_reach` without the other's place, which the least size not below ``floor`` times its own meets best;
    where a class holds smaller ones too, a row may stay in vain.
    """
    sized = rows.withColumn("size", size_class(floor))
    least = sized.groupBy("shingle", "size").agg(F.min("n").alias("least"))
    # the class below, and one more for what a logarithm rounds across a bound
    least = least.withColumn("size", F.explode(F.array("size", F.col("size") + 1, F.col("size") + 2)))
    least = least.groupBy("shingle", "size").agg(F.min("least").alias("least"))
    enough = (1 + floor) * (F.col("n") - F.col("place")) >= floor * (F.col("n") + F.col("least")) - 1e-9
    return sized.join(least, ["shingle", "size"]).where(enough).select(rows.columns)


def starred(labelled: DataFrame, floor: float, turn: int) -> DataFrame:
    """(a, b): under each shingle of ``labelled`` (shingle, node, n, place, l), texts meet a hub of their size and of another label.

    The hub is the text with the fewest rarer shingles, so of a family of copies the one that changed least, to which
    most others are nearer than to each other. After the first round a second one is drawn by a hash of node, round and
    a few bits of the shingle, so a family has few hubs, and a text several. Rounds cut sizes into classes at other places.
    """
    sized = labelled.withColumn("size", size_class(floor, turn / 2))
    text, drawn = F.struct("node", "n", "place", "l"), F.xxhash64("node", F.lit(turn), F.pmod("shingle", F.lit(HUBS)))
    orders = [F.struct("place", drawn), drawn][: 1 + min(turn, 1)]
    hubs = sized.groupBy("shingle", "size").agg(F.array(*[F.min_by(text, o) for o in orders]).alias("hubs"), F.count("*").alias("k")).where("k > 1")
    enough = can_reach(F.col("n"), F.col("place"), F.col("hub.n"), F.col("hub.place"), floor)
    met = sized.join(hubs, ["shingle", "size"]).withColumn("hub", F.explode("hubs")).where((F.col("l") != F.col("hub.l")) & enough)
    return ordered(met.select(F.col("hub.node").alias("a"), F.col("node").alias("b"))).distinct()


def apart(labelled: DataFrame) -> tuple[DataFrame, int, int]:
    """The rows of ``labelled`` (shingle, l, ...) whose shingle has several labels, their number, and the pairs of them with one shingle and two labels."""
    mixed = labelled.groupBy("shingle").agg(F.count("*").alias("k"), F.min("l").alias("lo"), F.max("l").alias("hi")).where("k > 1 AND lo < hi")
    rows = staged(labelled.join(mixed.select("shingle"), "shingle", "left_semi"))
    each = rows.groupBy("shingle", "l").agg(F.count("*").alias("k")).groupBy("shingle").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("inside"))
    n, pairs = each.agg(F.sum("k"), F.sum((F.col("k") * F.col("k") - F.col("inside")) / 2)).first()
    return rows, n or 0, int(pairs or 0)


def labels(texts: DataFrame, nodes: DataFrame, proposed: DataFrame, width: int, floor: float) -> DataFrame:
    """(node, label) of linked nodes of ``texts`` (tid, text) and ``nodes`` (tid, node): the least node that pairs at ``floor`` or more reach.

    ``proposed`` (a, b) pairs of nodes are verified with the first round. A round that meets or links no
    new pair leaves the labels as they are, and what would follow from it is not run. Further rounds follow while
    what is left has more than ``MEETINGS`` a row and the last round halved them.
    """
    from .simhash import components

    held = staged(reaching(prefixes(texts, shingle_levels(texts, width), width, floor), floor))

    def labelled(found: DataFrame) -> DataFrame:
        return held.join(found.withColumnRenamed("label", "l"), "node", "left").withColumn("l", F.coalesce("l", "node"))

    def grown(found: DataFrame, met: DataFrame) -> DataFrame:
        if met.isEmpty():
            return found
        more = staged(verified(met, texts, nodes, width, floor))
        stars = found.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
        return found if more.isEmpty() else components(staged(stars.unionByName(more)))

    tried = staged(ordered(proposed).unionByName(starred(held.withColumn("l", F.col("node")), floor, 0)).distinct())
    found = components(staged(verified(tried, texts, nodes, width, floor)))
    rows, n, pairs = apart(labelled(found))
    turn, before = 1, 2 * pairs
    while MEETINGS * n < pairs <= before / 2:
        met = staged(starred(rows, floor, turn).join(tried, ["a", "b"], "left_anti"))
        found = grown(found, met)
        tried = tried.unionByName(met)
        before, turn = pairs, turn + 1
        rows, n, pairs = apart(labelled(found))
    if not n:
        return found
    x, y = rows.alias("x"), rows.alias("y")
    enough = can_reach(F.col("x.n"), F.col("x.place"), F.col("y.n"), F.col("y.place"), floor)
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.l") != F.col("y.l")) & (F.col("x.node") < F.col("y.node")) & enough)
    # the shingles that two prefixes share, and what can follow the last of them
    shared = met.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.n").alias("m"), F.col("y.n").alias("n")).agg(
        F.count("*").alias("both"), F.max("x.place").alias("i"), F.max("y.place").alias("j")
    )
    reach = F.col("both") + F.least(F.col("m") - F.col("i"), F.col("n") - F.col("j")) - 1
    others = shared.where((1 + floor) * reach >= floor * (F.col("m") + F.col("n")) - 1e-9).select("a", "b")
    return grown(found, staged(others.join(tried, ["a", "b"], "left_anti")))
