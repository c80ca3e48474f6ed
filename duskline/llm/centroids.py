"""Centroid clustering of quantised vectors: Lloyd's rounds on distinct vectors, weighted by how often each occurs.

Vectors become integers, so equal ones can be grouped: a count for each distinct
one is made before the shuffle, whatever its share of the rows. Rounds work on
distinct vectors alone; a task sums weight times vector for each centroid, and
Spark adds up what the tasks found, exactly. Assignments go back to the rows by
the vectors, frequent ones by broadcast (see common.joined_spread).

Kept are vectors of exactly `dims` components, none null, NaN or infinite.
A component beyond 2**27 after scaling counts as 2**27, so that squared distances
fit in a long; an inertia beyond a long is its largest value. Vectors without an id
are clustered, but none begins a centroid; ids that repeat, even with equal
vectors, count as often as they occur. Fewer vectors with an id than centroids
give fewer centroids, none (and an empty table) no rows. Further columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, joined_spread, written

#: The largest component; squared distances of so many dimensions must fit in a long.
MOST, MOST_DIMS = 1 << 27, 64
#: Components up to this are multiplied as doubles, which is exact for them.
AS_DOUBLES = 1 << 20
#: Distinct vectors a numpy step works on.
ROWS = 4096


def quantised(vector: Column, dims: int, scale: int) -> Column:
    """floor(scale * x) of each component as integers; null for a vector that isn't kept."""
    whole = F.transform(vector, lambda x: F.least(F.greatest(F.floor(F.when(F.abs(x.cast("double")) < MOST, x.cast("double") * scale).otherwise(F.signum(x.cast("double")) * MOST)), F.lit(-MOST)), F.lit(MOST)).cast("int"))
    known = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return F.when((F.size(vector) == dims) & known, whole)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, the first of equally near ones, and the squared distance."""
    if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) <= AS_DOUBLES:
        x, c = vectors.astype(float), centroids.astype(float)
        distances = ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    else:
        distances = np.stack([((vectors - c) ** 2).sum(1) for c in centroids], 1)
    best = distances.argmin(1)
    return best, distances[np.arange(len(best)), best]


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """Vectors and weights in blocks of ROWS."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part.column("q").flatten().to_numpy().astype(np.int64).reshape(-1, dims), part.column("weight").to_numpy(), part


def _weighted_sums(dims: int, centroids: np.ndarray):
    """For mapInArrow: of each centroid the weight and the weighted sum of its vectors in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, sums = [0] * len(centroids), [[0] * dims for _ in centroids]
        for vectors, weight, _ in _blocks(batches, dims):
            best, _ = nearest(vectors, centroids)
            for k in np.unique(best):
                mine, w = vectors[best == k], weight[best == k]
                small = float(np.abs(mine).max()) * float(w.sum()) < 2.0**62
                total = w @ mine if small else w.astype(object) @ mine.astype(object)
                weights[k] += int(w.sum())
                sums[k] = [a + int(b) for a, b in zip(sums[k], total, strict=True)]
        used = [k for k, w in enumerate(weights) if w]
        exact = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([Decimal(weights[k]) for k in used], exact), pa.array([[Decimal(x) for x in sums[k]] for k in used], pa.list_(exact))], names=["cluster", "weight", "sums"])

    return run


def _assigned(dims: int, centroids: np.ndarray):
    """For mapInArrow: cluster and distance of each distinct vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for vectors, _, part in _blocks(batches, dims):
            best, distance = nearest(vectors, centroids)
            yield pa.RecordBatch.from_arrays([part.column("q"), part.column("weight"), pa.array(best.astype(np.int32)), pa.array(distance)], names=["q", "weight", "cluster", "distance"])

    return run


def centroid_clusters(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 64, clusters: int = 16, rounds: int = 3, seed: int = 1) -> DataFrame:
    """id_col, cluster (int), distance (squared), cluster_inertia, inertia (long) and centroid_sha256 of each kept vector.

    Centroids start as the vectors whose id has the smallest sha256 of
    `seed:id`; one that loses its vectors stays where it is.
    """
    if dims > MOST_DIMS:
        raise ValueError(f"at most {MOST_DIMS} dimensions keep squared distances in a long")
    kept = df.select(F.col(id_col).alias("id"), quantised(F.col(vector_col), dims, scale).alias("q")).where("q IS NOT NULL")
    drawn = kept.where("id IS NOT NULL").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "q").orderBy("h", "q").limit(clusters)
    centroids = np.array([r.q for r in drawn.collect()], np.int64).reshape(-1, dims)
    if not len(centroids):
        kept = kept.where(F.lit(False))
    distinct = written(kept.groupBy("q").agg(F.count(F.lit(1)).alias("weight")), "distinct-vectors")
    for _ in range(rounds if len(centroids) else 0):
        found = distinct.mapInArrow(_weighted_sums(dims, centroids), "cluster int, weight decimal(38,0), sums array<decimal(38,0)>")
        totals = found.groupBy("cluster").agg(F.sum("weight").alias("weight"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims)))
        for r in totals.collect():  # a row for each centroid
            centroids[r.cluster] = [int(r[f"s{i}"]) // int(r.weight) for i in range(dims)]
    assigned = written(distinct.mapInArrow(_assigned(dims, centroids), "q array<int>, weight long, cluster int, distance long"), "assigned-vectors")
    discard(distinct)
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("weight").cast("decimal(20,0)") * F.col("distance").cast("decimal(18,0)")).alias("d")).collect()
    longest = 2**63 - 1
    inertia = {r.cluster: int(r.d) for r in sums}
    rows = [(k, min(d, longest), min(sum(inertia.values()), longest), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for k, d in inertia.items()]
    about = df.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = joined_spread(kept, assigned, "q", "weight").join(F.broadcast(about), "cluster")
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(dims: int = 64, scale: int = 64, clusters: int = 16, rounds: int = 3, seed: int = 1) -> str:
    """DuckDB SQL for the query over embeddings, on all rows."""
    steps = ""
    for i in range(rounds + 1):
        steps += f"""
a{i} AS (SELECT r, q, arg_min(c, struct_pack(d := d, c := c)) AS c, min(d) AS d FROM (SELECT v.r, v.q, k.c, CAST(list_sum(list_transform(v.q, lambda x, i: (x - k.q[i]) * (x - k.q[i]))) AS BIGINT) AS d FROM v, k{i} k) GROUP BY r, q),"""
        if i < rounds:
            steps += f"""
m{i} AS (SELECT c, list(CAST((s - (((s % n) + n) % n)) // n AS BIGINT) ORDER BY i) AS q FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(q) AS x, unnest(range({dims})) AS i FROM a{i}) GROUP BY c, i) GROUP BY c),
k{i + 1} AS (SELECT k{i}.c, coalesce(m{i}.q, k{i}.q) AS q FROM k{i} LEFT JOIN m{i} USING (c)),"""
    return f"""
WITH kept AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM kept),
k0 AS (SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q FROM (SELECT sha256('{seed}:' || CAST(vec_id AS VARCHAR)) AS h, q FROM v WHERE vec_id IS NOT NULL ORDER BY h, q LIMIT {clusters})),{steps}
i AS (SELECT c, CAST(sum(d) AS BIGINT) AS ci FROM a{rounds} GROUP BY c)
SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, i.ci AS cluster_inertia, CAST((SELECT sum(ci) FROM i) AS BIGINT) AS inertia, sha256(array_to_string(k{rounds}.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN k{rounds} USING (c) JOIN i USING (c)
"""
