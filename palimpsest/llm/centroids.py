"""Centroid clustering by exponion search (operator 13).

Lloyd rounds over integer vectors, exact to the last unit. Each vector carries its centroid, an upper bound of its distance
to it and a lower bound of its distance to any other. Where the upper bound is below the lower one, or below half the way to
the centroid's nearest neighbour, nothing is computed. Otherwise the upper bound is made exact, and if that doesn't settle it,
the vector looks only at centroids inside a ball around its own one, of radius twice its distance and the way to the nearest
neighbour: a prefix of that centroid's list of the others, sorted by distance. A centroid that isn't farther than a
vector's own lies in that ball, borders included, so ties are seen and go to the smaller number. Distances are compared as
whole numbers; bounds are floats, moved outward by more than their rounding, and never decide a tie.

Vectors stay in their partitions: a round is one narrow pass that reads the state, writes the next and is read again (a lost
executor costs a read); only sums by centroid meet, one row for each centroid and task. Collected are the centroids
and their sums, k rows. A vector held by a third of all rows is like any other.

Defined results: vectors of another length, and with a null, NaN or infinite component, are dropped, a null vector too;
with fewer than k vectors there are as many centroids as vectors; a null id is kept and starts no centroid before all others
have; rows that share an id are vectors of their own, and among starts of equal id the smaller components come first;
a component beyond 2**27 after scaling raises an error, as its squared distance needn't fit a long; other columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import staged, table

#: Production parameters: components of a vector, units of one, centroids, rounds, and the salt of the first choice.
DIMENSIONS = 64
SCALE = 256
CENTROIDS = 40
ROUNDS = 5
SALT = "2:"
#: The largest component: 64 squares of twice this fit a long.
MOST = 1 << 27
#: Bounds are moved outward by this share, far above the rounding of a square root and a sum, and less than any use.
OUTWARD = 1e-9

STATE = "vec_id long, x array<int>, cluster int, upper double, lower double, scanned int"


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): the vectors that count, in whole units."""
    values = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vec_col].cast("array<double>").alias("v"))
    finite = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    unit = F.transform("v", lambda c: F.floor(c * scale))
    fits = F.forall("v", lambda c: F.abs(c * scale) < MOST)
    checked = F.when(fits, unit.cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component reaches {MOST} units")))
    return values.where((F.size("v") == dims) & F.coalesce(finite, F.lit(False))).select("vec_id", checked.alias("x"))


def first_centroids(rows: DataFrame, k: int = CENTROIDS, salt: str = SALT) -> list[list[int]]:
    """The k vectors of smallest hash, in its order; bounded by k."""
    order = [F.col("vec_id").isNull(), F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256), "x"]
    return [r.x for r in rows.orderBy(*order).limit(k).collect()]


def distances(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Squared distances, row by row, as whole numbers; ``centroid`` is one row or one for each of ``x``."""
    d = x - centroid
    return np.einsum("ij,ij->i", d, d)


class Ball:
    """What a search needs of one set of centroids: the others of each, sorted by distance."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        d = centroids[:, None, :] - centroids[None, :, :]
        between = np.sqrt((d * d).sum(axis=2).astype(np.float64))
        self.order = np.argsort(between, axis=1, kind="stable")
        self.between = np.take_along_axis(between, self.order, axis=1)
        # the centroid itself comes first in its list, at 0; an equal one with a smaller number may stand before it
        others = between + np.where(np.eye(len(centroids), dtype=bool), np.inf, 0)
        self.nearest = others.min(axis=1) if len(centroids) > 1 else np.full(1, np.inf)

    def search(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(centroid, squared distance, lower bound of all others, centroids looked at) for vectors near ``own`` by ``upper``."""
        n = len(x)
        radius = (2 * upper + self.nearest[own]) * (1 + OUTWARD)
        inside = np.empty(n, dtype=np.int64)
        for c in np.unique(own):
            rows = own == c
            inside[rows] = np.searchsorted(self.between[c], radius[rows], side="right")
        best = np.full(n, np.iinfo(np.int64).max)
        which = np.full(n, len(self.centroids), dtype=np.int64)
        second = np.full(n, np.inf)
        rows = np.arange(n)
        for at in range(int(inside.max(initial=0))):
            rows = rows[inside[rows] > at]
            candidate = self.order[own[rows], at]
            d = distances(x[rows], self.centroids[candidate])
            better = (d < best[rows]) | ((d == best[rows]) & (candidate < which[rows]))
            second[rows] = np.minimum(second[rows], np.sqrt(np.where(better, best[rows], d).astype(np.float64)))
            best[rows] = np.where(better, d, best[rows])
            which[rows] = np.where(better, candidate, which[rows])
        # a centroid outside the ball is farther from the own one than the radius, so from the vector than radius - upper
        second = np.where(inside < len(self.centroids), np.minimum(second, radius - upper), second)
        return which, best, second * (1 - OUTWARD), inside


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.int64) if len(column) else np.zeros((0, 0), np.int64)


def assigned(rows: DataFrame, centroids: list[list[int]], moved: list[float] | None) -> DataFrame:
    """``rows`` assigned to ``centroids``, as ``STATE``.

    ``moved`` is how far each centroid is from where it was when ``rows`` was last assigned; without it, ``rows`` is (vec_id, x)
    and each vector begins at the first centroid, with no bounds.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((np.array(centroids, dtype=np.int64), None if moved is None else np.array(moved)))

    def run(batches):
        where, far = shared.value
        ball = Ball(where)
        for batch in batches:
            x = _vectors(batch.column("x"))
            n = len(x)
            if not n:
                continue
            if far is None:
                own, upper, lower = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n)
            else:
                own = batch.column("cluster").to_numpy().astype(np.int64)
                upper = batch.column("upper").to_numpy() + far[own]
                lower = batch.column("lower").to_numpy() - far.max()
            safe = np.maximum(lower, ball.nearest[own] / 2)
            upper, scanned = upper.copy(), np.zeros(n, np.int32)
            open_ = np.flatnonzero(upper >= safe * (1 - OUTWARD))
            upper[open_] = np.sqrt(distances(x[open_], where[own[open_]]).astype(np.float64)) * (1 + OUTWARD)
            scanned[open_] = 1
            open_ = open_[upper[open_] >= safe[open_] * (1 - OUTWARD)]
            which, squared, second, inside = ball.search(x[open_], own[open_], upper[open_])
            own[open_], lower[open_] = which, second
            upper[open_] = np.sqrt(squared.astype(np.float64)) * (1 + OUTWARD)
            scanned[open_] = inside
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("x"), pa.array(own.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(scanned)],
                names=["vec_id", "x", "cluster", "upper", "lower", "scanned"],
            )

    return rows.mapInArrow(run, STATE)


def moved_centroids(state: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The floor of each cluster's mean, component by component; an empty cluster's centroid stays."""
    dims = len(centroids[0]) if centroids else 0
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("x")[i].cast("long")).alias(f"s{i}") for i in range(dims)])
    out = [list(c) for c in centroids]
    for r in sums.collect():  # a row for each centroid
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
    return out


def _moves(before: list[list[int]], after: list[list[int]]) -> list[float]:
    d = np.array(before, dtype=np.int64) - np.array(after, dtype=np.int64)
    return (np.sqrt((d * d).sum(axis=1).astype(np.float64)) * (1 + OUTWARD)).tolist()


def clustered(rows: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, salt: str = SALT) -> tuple[DataFrame, list[list[int]]]:
    """(the state after ``rounds`` moves of the centroids and one more assignment, those centroids) for whole vectors."""
    rows = staged(rows)
    centroids = first_centroids(rows, k, salt)
    if not centroids:
        return rows.sparkSession.createDataFrame([], STATE), []
    state, moved = rows, None
    for _ in range(rounds):
        state = staged(assigned(state, centroids, moved))
        after = moved_centroids(state, centroids)
        moved, centroids = _moves(centroids, after), after
    return assigned(state, centroids, moved), centroids


def report(state: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """One row a vector: its cluster, its squared distance, the sums of these, and its centroid's digest."""
    spark = state.sparkSession
    shown = [(i, c, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    known = spark.createDataFrame(shown, "cluster int, centre array<bigint>, centroid_sha256 string")
    squares = F.zip_with("x", "centre", lambda a, b: (a.cast("long") - b) * (a.cast("long") - b))
    far = F.aggregate(squares, F.lit(0).cast("long"), lambda acc, v: acc + v)
    rows = staged(state.join(F.broadcast(known), "cluster").select("vec_id", "cluster", far.alias("distance"), "scanned"))
    sums = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    totals = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    small = sums.crossJoin(F.broadcast(totals)).join(known.drop("centre"), "cluster")  # the totals are one row
    return rows.join(F.broadcast(small), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(*clustered(whole_vectors(table(spark, sf_dir, "embeddings"))))


def _oracle() -> str:
    """DuckDB: every vector against every centroid, round after round."""
    parts = [
        f"""v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('{SALT}' || vec_id)) - 1 AS c, x AS y FROM v
  ORDER BY sha256('{SALT}' || vec_id) LIMIT {CENTROIDS}
)"""
    ]
    far = "list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    for i in range(ROUNDS + 1):
        parts.append(f"a{i} AS (SELECT vec_id, r, any_value(x) AS x, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.*, c, {far} AS d FROM v, c{i}) GROUP BY vec_id, r)")
        if i < ROUNDS:
            parts.append(
                f"""s{i} AS (
  SELECT c, list(CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END ORDER BY k) AS y
  FROM (SELECT c, k, sum(x[k])::BIGINT AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, {DIMENSIONS + 1})) AS k) GROUP BY c, k) GROUP BY c
), c{i + 1} AS (SELECT c, coalesce(s.y, o.y) AS y FROM c{i} o LEFT JOIN s{i} s USING (c))"""
            )
    last = ROUNDS
    return (
        "WITH "
        + ", ".join(parts)
        + f"""
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(y, ',')) AS centroid_sha256
FROM a{last} JOIN c{last} USING (c)"""
    )


ORACLE = _oracle()
