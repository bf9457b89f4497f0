"""Centroid clustering by ball k-means: a cluster is a ball, and a member is compared only with the neighbours that its place in the ball leaves."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, written
from .vectors import SCALE, integer_vectors, matrix

STATE = "id long, x array<int>, cluster int, distance long"


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row and its squared distance, by comparing all; ties to the smaller number."""
    best, at = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int32)
    for j, c in enumerate(centroids):
        d = ((x - c) ** 2).sum(axis=1)
        nearer = d < best
        best[nearer], at[nearer] = d[nearer], j
    return at, best


def within_balls(x: np.ndarray, cluster: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As nearest(), for rows that are members of clusters.

    The members of a cluster here are a ball about its centroid, whose radius is their largest distance. Another centroid is a
    neighbour if it lies within twice the radius. With neighbours in order of distance, half the first one's distance bounds the
    stable core, whose members stay, and half those of the next ones bound annuli: a member in the m-th annulus is compared
    with the first m neighbours. All bounds are compared as squared integers and hold where they are met exactly, so that ties count.
    """
    own = ((x - centroids[cluster]) ** 2).sum(axis=1)
    best, at = own.copy(), cluster.copy()
    apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    for i in np.unique(cluster):
        members = np.flatnonzero(cluster == i)
        members = members[np.argsort(-own[members], kind="stable")]
        reach = 4 * own[members]
        others = np.flatnonzero((apart[i] <= reach[0]) & (np.arange(len(centroids)) != i))
        others = others[np.argsort(apart[i][others], kind="stable")]
        annulus = np.searchsorted(apart[i][others], reach, side="right")
        for m, j in enumerate(others):
            rows = members[: np.searchsorted(-annulus, -m, side="left")]  # those in an annulus beyond m come first
            d = ((x[rows] - centroids[j]) ** 2).sum(axis=1)
            nearer = (d < best[rows]) | ((d == best[rows]) & (j < at[rows]))
            best[rows[nearer]], at[rows[nearer]] = d[nearer], j
    return at, best


def _assigned(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of STATE from rows id, x and, if they have one, the cluster of before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("x"))
            at, d = within_balls(x, b.column("cluster").to_numpy(), centroids) if "cluster" in b.schema.names else nearest(x, centroids)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("x"), pa.array(at, pa.int32()), pa.array(d, pa.int64())], names=["id", "x", "cluster", "distance"])

    return run


def _sums(k: int, dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each cluster of a task: its members and the sums of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for b in batches:
            if b.num_rows:
                at = b.column("cluster").to_numpy()
                n += np.bincount(at, minlength=k)
                np.add.at(sums, at, matrix(b.column("x")))
        met = np.flatnonzero(n)
        if len(met):
            yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(n[met]), pa.array(list(sums[met]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return run


def _moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after each with members has become their exact mean, rounded down. Tasks add up before the shuffle; k rows come back."""
    k, dim = centroids.shape
    parts = state.select("x", "cluster").mapInArrow(_sums(k, dim), "cluster int, n long, sums array<long>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(dim))).alias("sums"))
    out = centroids.copy()
    for row in total.collect():
        out[row["cluster"]] = [s // row["n"] for s in row["sums"]]
    return out


def ball_kmeans(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, seed: str = "2", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row for each vector of dim finite components.

    Components count as integers (vectors.py), and all arithmetic is exact. The first centroids are the k vectors with the least SHA-256 of
    "<seed>:<id>", of equal ids the least vector; with fewer vectors there are fewer clusters. A vector with a null identifier is
    clustered, but never a first centroid. Repeated rows count as often as they come. Other columns aren't read. An empty table gives no rows.
    The first assignment compares all centroids, those after it go by balls, formed anew in each batch of rows. The state is written after
    every assignment, with the table before it deleted, so a lost executor costs no more than its tasks.
    """
    spark = vectors.sparkSession
    kept = written(integer_vectors(vectors, id_col, vec_col, dim), "vectors", 20_000)
    first = kept.where("id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "x").orderBy("h", "x").limit(k).collect()
    out = f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], out)
    centroids = np.array([r["x"] for r in first], np.int64)
    state = written(kept.mapInArrow(_assigned(centroids), STATE), "assigned", 20_000)
    dropped(kept)
    for _ in range(rounds):
        centroids = _moved(state, centroids)
        before, state = state, written(state.mapInArrow(_assigned(centroids), STATE), "assigned", 20_000)
        dropped(before)
    inertia = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of_cluster = spark.createDataFrame([(j, s, sum(inertia.values()), sha[j]) for j, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select(F.col("id").alias(id_col), "cluster", "distance").join(F.broadcast(of_cluster), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def kmeans_sql(k: int = 40, rounds: int = 5, dim: int = 64, seed: str = "2") -> str:
    """The same by comparing all centroids in every round."""
    floor = lambda s, n: f"CAST(({s} - ((({s}) % {n}) + {n}) % {n}) / {n} AS BIGINT)"
    parts = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) - 1 AS c, x FROM v WHERE vec_id IS NOT NULL QUALIFY c < {k})"""]
    for i in range(rounds + 1):
        if i:
            parts.append(f"""s{i} AS (SELECT c, p, {floor("sum(x[p])", "count(*)")} AS m FROM a{i - 1} JOIN v USING (r), range(1, {dim + 1}) AS t(p) GROUP BY c, p),
c{i} AS MATERIALIZED (SELECT c, coalesce(n.x, o.x) AS x FROM c{i - 1} o LEFT JOIN (SELECT c, list(m ORDER BY p) AS x FROM s{i} GROUP BY c) n USING (c))""")
        parts.append(f"""a{i} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM
(SELECT r, c, list_sum(list_transform(list_zip(v.x, q.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, c{i} q) GROUP BY r)""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(q.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} q ON q.c = a.c"""


OP11_SQL = kmeans_sql()
