"""Clustering by nearest centroids in whole numbers, with JVM expressions only.

Components become integers, so distances, sums and means are exact and every run gives the same
clusters. A vector's distance to a centroid is ``zip_with`` and ``aggregate`` over a literal array;
the least of the structs of distance and number is its cluster; a round is one hash aggregate of
column sums, whose k rows are all that reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable

CLUSTERS = 8
ROUNDS = 10
SIZE = 64
SCALE = 1024
SEED = 3
# Components from here on have squares beyond a long.
_MOST = 2.0**31


def _long_array(numbers: list[int]) -> str:
    return "array(" + ", ".join(f"{number}L" for number in numbers) + ")"


def usable(vector: Column, size: int) -> Column:
    """True for a vector of ``size`` components, none of them null, infinite or not a number."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == size) & whole, F.lit(False))


def _whole_numbers(vector: Column, scale: int) -> Column:
    def whole(x: Column) -> Column:
        scaled = x.cast("double") * F.lit(float(scale))
        too_large = F.raise_error(F.lit("a component is too large for exact distances"))
        return F.when(F.abs(scaled) < _MOST, F.floor(scaled)).otherwise(too_large.cast("long"))

    return F.transform(vector, whole)


def _distance(x: str, centroid: list[int]) -> str:
    return f"aggregate(zip_with({x}, {_long_array(centroid)}, (a, b) -> (a - b) * (a - b)), 0L, (total, square) -> total + square)"


def nearest(x: str, centroids: list[list[int]]) -> Column:
    """Struct of ``distance`` and ``cluster``: the centroid nearest to column ``x``, of equally near ones the first."""
    choices = [
        f"named_struct('distance', {_distance(x, centroid)}, 'cluster', {number})"
        for number, centroid in enumerate(centroids)
    ]
    return F.expr(f"array_min(array({', '.join(choices)}))")


def _starts(vectors: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors whose seeded ids have the smallest hashes; equal ids in the order of their vectors."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.select(drawn.alias("drawn"), "x").orderBy(F.col("drawn").asc_nulls_last(), "x").limit(clusters)
    return [list(row.x) for row in rows.collect()]


def _moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Floors of the means of the vectors nearest to each centroid; those without any stay."""
    sums = [F.expr(f"sum(x[{axis}]) AS sum_{axis}") for axis in range(len(centroids[0]))]
    found = vectors.select(nearest("x", centroids)["cluster"].alias("cluster"), "x")
    moved = list(centroids)
    for row in found.groupBy("cluster").agg(F.count(F.lit(1)).alias("count"), *sums).collect():
        moved[row.cluster] = [total // row["count"] for total in row[2:]]
    return moved


def cluster_vectors(
    table: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    size: int = SIZE,
    scale: int = SCALE,
    seed: int = SEED,
) -> DataFrame:
    """``kept_columns`` (a struct of all columns of ``table``), ``cluster``, ``distance`` (squared),
    ``cluster_inertia``, ``inertia`` and the final ``centroid`` of each usable row.

    Only vectors of exactly ``size`` components, none null or not finite, are usable; each component
    x counts as floor(scale * x). Rounds end early once no centroid moves, as later ones would move
    none either. Fewer usable rows than ``clusters`` make as many clusters as there are rows; without
    any, and for an empty table, the result is empty. Repeated rows are vectors of their own, and can
    both be first centroids; a null id comes last in the draw. Ties in distance go to the smaller
    number. Columns may have any name. Scaled components of 2**31 or more, whose distances do not fit
    a long, fail the job, and so does a sum beyond a long.
    """
    columns = [table[f"`{name}`"] for name in table.columns]
    given = table[f"`{vector}`"]
    vectors = durable(
        table.where(usable(given, size)).select(
            F.struct(F.lit(0).alias("_"), *columns).alias("kept_columns"),
            table[f"`{vec_id}`"].alias("id"),
            _whole_numbers(given, scale).alias("x"),
        )
    )
    centroids = _starts(vectors, clusters, seed)
    for _ in range(rounds if centroids else 0):
        before, centroids = centroids, _moved(vectors, centroids)
        if centroids == before:
            break
    centroids = centroids or [[0] * size]  # for an empty result only
    assigned = durable(vectors.select("kept_columns", nearest("x", centroids).alias("nearest")))
    found = {
        row.cluster: row.inertia
        for row in assigned.groupBy("nearest.cluster").agg(F.sum("nearest.distance").alias("inertia")).collect()
    }
    inertias = [found.get(number, 0) for number in range(len(centroids))]
    cluster = F.col("nearest.cluster")
    return assigned.select(
        "kept_columns",
        cluster.alias("cluster"),
        F.col("nearest.distance").alias("distance"),
        F.element_at(F.expr(_long_array(inertias)), cluster + 1).alias("cluster_inertia"),
        F.lit(sum(inertias)).cast("long").alias("inertia"),
        F.element_at(F.expr(f"array({', '.join(map(_long_array, centroids))})"), cluster + 1).alias("centroid"),
    )


def clustering_report(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and the hash of the centroid of each usable row."""
    found = cluster_vectors(table.select(f"`{vec_id}`", f"`{vector}`"), vec_id, vector)
    listed = F.concat_ws(",", F.transform("centroid", lambda number: number.cast("string")))
    return found.select(
        F.col(f"kept_columns.`{vec_id}`").alias("vec_id"),
        "cluster",
        "distance",
        "cluster_inertia",
        "inertia",
        F.sha2(listed, 256).alias("centroid_sha256"),
    )
