"""Centroid clustering of integer vectors with JVM expressions only.

A round reads the vectors, finds the nearest centroid with ``zip_with`` and ``aggregate``
against literal arrays, and sums components per cluster on the map side.  Only centroids
(``k`` rows) reach the driver; vectors are never shuffled.

Higher-order functions are evaluated element by element, so one literal number carries the
components of several centroids, each in a lane of bits.  A lane is as wide as its centroid's
largest possible dot product (Cauchy-Schwarz over the measured norms), so lanes never touch
and the distances are exact whatever the width.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspan.session import cut_lineage

DIMENSION, CLUSTERS, ROUNDS, SEED, SCALE = 64, 40, 5, 2, 256
#: Components beyond this could make a squared distance that no 64-bit integer holds.
LARGEST = 2**27


def _component(e: Column, scale: int) -> Column:
    beyond = F.raise_error(F.lit(f"a component beyond {LARGEST} in size: its distances do not fit a long"))
    return F.when(F.abs(e * scale) < LARGEST, F.floor(e * scale)).otherwise(beyond)


def integer_vectors(vectors: DataFrame, dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """``vec_id, x, xx``: ids, integer components and squared length of the vectors that are kept."""
    whole = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    fine = (F.size("v") == dimension) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    scaled = whole.filter(fine).select("vec_id", F.transform("v", lambda e: _component(e, scale)).alias("x"))
    size = F.aggregate("x", F.lit(0).cast("long"), lambda s, e: s + e * e)
    return scaled.select("vec_id", "x", size.alias("xx"))


def _literal(numbers: list[int]) -> str:
    return "array(" + ",".join(f"{n}L" for n in numbers) + ")"


def lanes(longest: int, centroids: list[list[int]]) -> list[list[tuple[int, int, int]]]:
    """Groups of (centroid, first bit, bits): signed lanes of one 64-bit number.

    A lane holds any dot product with a vector of squared length up to ``longest``.
    """
    bits = [(math.isqrt(longest * sum(c * c for c in row)) + 1).bit_length() + 1 for row in centroids]
    groups: list[list[tuple[int, int, int]]] = []
    for number in sorted(range(len(centroids)), key=lambda i: -bits[i]):
        room = (g for g in groups if sum(lane[2] for lane in g) + bits[number] <= 64)
        group = next(room, None)
        if group is None:
            groups.append(group := [])
        group.append((number, sum(lane[2] for lane in group), bits[number]))
    return groups


def nearest(vectors: DataFrame, centroids: list[list[int]], longest: int) -> DataFrame:
    """``vectors`` with ``cluster`` and ``distance``; of equally near centroids the smallest number."""
    groups = lanes(longest, centroids)
    packed = [[sum(centroids[number][j] << at for number, at, _ in group) for j in range(len(centroids[0]))] for group in groups]
    near = []
    for i, group in enumerate(groups):
        for number, at, bits in group:
            # What lower lanes borrow from this one comes back before it is cut out.
            value = f"shiftright(dots[{i}] + {1 << (at - 1)}L, {at})" if at else f"dots[{i}]"
            value = f"shiftright(shiftleft({value}, {64 - bits}), {64 - bits})"
            near.append(f"struct(xx + {sum(c * c for c in centroids[number])}L - 2L * {value} AS distance, {number} AS cluster)")
    # The outer transforms hand the components over as one plain array for all groups.
    dots = f"""transform(array(transform(x, e -> e)), x -> transform(array({",".join(map(_literal, packed))}),
        c -> aggregate(zip_with(x, c, (a, b) -> a * b), 0L, (s, p) -> s + p)))[0]"""
    return (vectors.selectExpr("*", f"{dots} AS dots").selectExpr("vec_id", "x", f"array_min(array({','.join(near)})) AS nearest")
            .select("vec_id", "x", "nearest.cluster", "nearest.distance"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest hashes of seed and id; null ids last, ties by components."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r["x"]) for r in vectors.select("x", name.alias("name")).orderBy(F.col("name").asc_nulls_last(), "x").limit(k).collect()]


def moved(assigned: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Floors of the means of the clusters; an empty cluster keeps its centroid."""
    sums = [F.sum(F.element_at("x", j + 1)).alias(f"s{j}") for j in range(len(centroids[0]))]
    after = list(centroids)
    for row in assigned.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        after[row["cluster"]] = [row[f"s{j}"] // row["n"] for j in range(len(centroids[0]))]
    return after


def centroid_clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector.

    Kept are vectors of ``dimension`` components, none null or not finite; the others give no
    row.  Components become ``floor(scale * x)``.  The first centroids are the vectors with
    the smallest hashes of their ids; fewer than ``k`` kept vectors make fewer clusters, none
    an empty result.  Repeated rows and ids each count and each give a row; null ids are
    clustered too and become first centroids last.  Ties go to the smaller cluster number.
    Distances are exact; a component whose distances would not fit a long is an error, not
    a wrong number.  Other columns of ``vectors`` are not read.
    """
    whole = cut_lineage(integer_vectors(vectors, dimension, scale))
    longest = whole.agg(F.max("xx")).first()[0]
    if longest is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = first_centroids(whole, k, seed)
    for _ in range(rounds):
        centroids = moved(nearest(whole, centroids, longest), centroids)
    final = cut_lineage(nearest(whole, centroids, longest).select("vec_id", "cluster", "distance"))
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    totals = final.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    inertia = totals.agg(F.sum("cluster_inertia").alias("inertia"))
    # One row per cluster: at most k rows are joined back.
    facts = totals.select("cluster", "cluster_inertia", inertia.scalar().alias("inertia"),
                          F.element_at(F.array(*map(F.lit, names)), F.col("cluster") + 1).alias("centroid_sha256"))
    return final.join(F.broadcast(facts), "cluster").select(F.col("vec_id").cast("long").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dimension: int = DIMENSION, scale: int = SCALE) -> str:
    """The same in SQL: every round is a pair of common table expressions over (vector, centroid) rows."""
    parts = [
        f"""kept AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding::DOUBLE[], lambda e: floor(e * {scale})) AS x FROM embeddings
            WHERE len(embedding) = {dimension} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dimension})""",
        f"c0 AS (SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, x) - 1)::INT AS cluster, x FROM kept QUALIFY cluster < {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := (list_dot_product(k.x, k.x) + list_dot_product(c.x, c.x) - 2 * list_dot_product(k.x, c.x))::BIGINT,
            n := c.cluster)) AS near FROM kept k, c{i} c GROUP BY r)""")
        if i < rounds:
            parts.append(f"""m{i} AS (SELECT cluster, list(v ORDER BY j) AS x FROM (SELECT near.n AS cluster, j, floor(sum(x[j]::HUGEINT) / count(*)) AS v
                FROM a{i} JOIN kept USING (r), range(1, {dimension + 1}) t(j) GROUP BY ALL) GROUP BY cluster)""")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m USING (cluster))")
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, near.n AS cluster, near.d AS distance, sum(near.d) OVER (PARTITION BY near.n)::BIGINT AS cluster_inertia, sum(near.d) OVER ()::BIGINT AS inertia,
            sha256(array_to_string(list_transform(c.x, lambda e: e::BIGINT), ',')) AS centroid_sha256
        FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} c ON c.cluster = near.n"""


ORACLE = oracle()
