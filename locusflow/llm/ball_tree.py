"""Exact top-k by inner product: a ball tree for each shard of the vectors, searched by branch and bound for packs of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, written
from .vectors import SCALE, integer_vectors, lists, matrix

#: Vectors of a shard, queries of a pack and vectors of a leaf; most pivots by whose nearness shards are made.
SHARD, PACK, LEAF, PIVOTS = 4096, 1024, 64, 256
#: Stands for a null identifier, which comes after all others, and for no score.
NO_ID, NO_SCORE = np.iinfo(np.int64).max, -np.iinfo(np.int64).max

KEY = "dim int, pivot int, part int"
TREE = f"{KEY}, shard string, n int, ids array<long>, x array<int>, lo array<int>, hi array<int>, left array<int>, right array<int>, centres array<int>, radii array<double>, centre array<double>, radius double"
ASKED = f"{KEY}, shard string, place int, id long, x array<int>, scores array<long>, ids array<long>"
PACKED = "dim int, pack string, shards array<string>, places array<int>, ids array<long>, x array<int>, scores array<long>, top array<long>, centre array<double>, radius double, least double"
FOUND = "shard string, place int, id long, scores array<long>, ids array<long>"


class BallTree:
    """Nodes are balls about rows lo to hi of x, which lie in the order of the tree; a leaf has left = -1."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> None:
        order, nodes, todo = np.arange(len(x)), [], [(0, len(x), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            rows = x[order[lo:hi]]
            centre = np.rint(rows.mean(axis=0)).astype(np.int64)
            d = ((rows - centre) ** 2).sum(axis=1)
            if parent >= 0:
                nodes[parent][side] = len(nodes)
            nodes.append([lo, hi, -1, -1, centre, float(np.sqrt(d.max()))])
            if hi - lo > leaf and d.max() > 0:
                a = rows[d.argmax()]
                b = rows[((rows - a) ** 2).sum(axis=1).argmax()]
                half = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(rows @ (a - b), half)]
                todo += [(lo, lo + half, len(nodes) - 1, 2), (lo + half, hi, len(nodes) - 1, 3)]
        self.x, self.ids = x[order], ids[order]
        self.lo, self.hi, self.left, self.right = (np.array([n[k] for n in nodes], np.int32) for k in range(4))
        self.centres, self.radii = np.array([n[4] for n in nodes]), np.array([n[5] for n in nodes])

    @classmethod
    def read(cls, row: dict[str, np.ndarray], dim: int) -> BallTree:
        """From the columns of a row of TREE."""
        out = cls.__new__(cls)
        for name in ("ids", "lo", "hi", "left", "right", "radii"):
            setattr(out, name, row[name])
        out.x, out.centres = row["x"].astype(np.int64).reshape(-1, dim), row["centres"].astype(np.int64).reshape(-1, dim)
        return out


class Search:
    """Queries q, each with its k best so far: scores and ids, best first, and whether they were found here."""

    def __init__(self, tree: BallTree, q: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray | None = None) -> None:
        """own: the row of the tree that is the query itself and so no candidate of its own."""
        self.tree, self.q, self.scores, self.ids, self.own = tree, q, scores.copy(), ids.copy(), own
        self.here = np.zeros(scores.shape, bool)
        # doubles hold all products exactly while they are below 2^53, and are much faster
        most = int(max(np.abs(q).max(initial=0), np.abs(tree.x).max(initial=0), np.abs(tree.centres).max(initial=0)))
        kind = np.float64 if q.shape[1] * most * most < 1 << 53 else np.int64
        self.qk, self.xk, self.ck = q.astype(kind), tree.x.astype(kind), tree.centres.astype(kind)
        self.length = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        self.far = np.sqrt((tree.centres.astype(np.float64) ** 2).sum(axis=1)) + tree.radii

    def bound(self, node: int, rows: np.ndarray) -> np.ndarray:
        """At least the inner product of each query with any vector of the node; with room for the rounding of doubles."""
        return self.qk[rows] @ self.ck[node] + self.length[rows] * (self.tree.radii[node] + 1e-9 * self.far[node]) + 1

    def run(self) -> Search:
        everyone = np.arange(len(self.q))
        self.visit(0, everyone, self.bound(0, everyone))
        return self

    def visit(self, node: int, rows: np.ndarray, bound: np.ndarray) -> None:
        """Depth first; each query goes to the child of the larger bound first. A node is left alone by queries whose bound lies below their kth score."""
        rows = rows[bound >= self.scores[rows, -1]]
        if not len(rows):
            return
        if self.tree.left[node] < 0:
            return self.leaf(node, rows)
        left, right = self.tree.left[node], self.tree.right[node]
        at_left, at_right = self.bound(left, rows), self.bound(right, rows)
        first = at_left >= at_right
        self.visit(left, rows[first], at_left[first])
        self.visit(right, rows, at_right)
        self.visit(left, rows[~first], at_left[~first])

    def leaf(self, node: int, rows: np.ndarray) -> None:
        lo, hi = self.tree.lo[node], self.tree.hi[node]
        got = (self.qk[rows] @ self.xk[lo:hi].T).astype(np.int64)
        hit = got >= self.scores[rows, -1][:, None]
        if self.own is not None:
            inside = np.flatnonzero((self.own[rows] >= lo) & (self.own[rows] < hi))
            hit[inside, self.own[rows[inside]] - lo] = False
        k = self.scores.shape[1]
        for i in np.flatnonzero(hit.any(axis=1)):
            r, at = rows[i], np.flatnonzero(hit[i])
            scores, ids = np.append(self.scores[r], got[i, at]), np.append(self.ids[r], self.tree.ids[lo + at])
            here = np.append(self.here[r], np.ones(len(at), bool))
            best = np.lexsort((ids, -scores))[:k]
            self.scores[r], self.ids[r], self.here[r] = scores[best], ids[best], here[best]


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _one(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return lists(np.asarray(values).reshape(1, -1), kind)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    kinds |= {f"array<{k}>": pa.list_(v) for k, v in kinds.items()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in ddl.split(", ")])


def _placed(pivots: list[tuple[int, np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """id, x, dim, the number of the nearest pivot of its length, -1 without one, and the row's number in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for b in batches:
            size = b.column("x").value_lengths()
            for dim in pc.unique(size).to_pylist():
                part = b.filter(pc.equal(size, dim))
                x, at = matrix(part.column("x")), np.full(part.num_rows, -1, np.int32)
                best = np.full(len(x), np.iinfo(np.int64).max)
                for j, p in pivots:
                    if len(p) == dim:
                        d = ((x - p) ** 2).sum(axis=1)
                        at[d < best] = j
                        best = np.minimum(best, d)
                numbers = np.arange(seen, seen + len(x))
                seen += len(x)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("x"), pa.array(np.full(len(x), dim, np.int32)), pa.array(at), pa.array(numbers)], names=["id", "x", "dim", "pivot", "number"])

    return run


def _grown(group: pa.Table) -> pa.Table:
    """One row of TREE from the vectors of a shard."""
    key = [group.column(k)[0].as_py() for k in ("dim", "pivot", "part")]
    group = group.combine_chunks()
    tree = BallTree(matrix(group.column("x").chunk(0)), _ids(group.column("id").chunk(0)))
    row = [pa.array([k], pa.int32()) for k in key] + [pa.array(["/".join(map(str, key))]), pa.array([len(tree.x)], pa.int32()), _one(tree.ids, pa.int64()), _one(tree.x, pa.int32())]
    row += [_one(getattr(tree, k), pa.int32()) for k in ("lo", "hi", "left", "right", "centres")]
    row += [_one(tree.radii, pa.float64()), _one(tree.centres[0], pa.float64()), pa.array([tree.radii[0]])]
    return pa.table(row, schema=_schema(TREE))


def _arrays(b: pa.RecordBatch, i: int, names: list[str]) -> dict[str, np.ndarray]:
    return {k: b.column(b.schema.get_field_index(k))[i].values.to_numpy(zero_copy_only=False) for k in names}


TREE_ARRAYS = ["ids", "x", "lo", "hi", "left", "right", "centres", "radii"]


def _at_home(every: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of ASKED: the queries of each shard with the k best of their own shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                dim, pivot, part, shard = (b.column(j)[i].as_py() for j in range(4))
                tree = BallTree.read(_arrays(b, i, TREE_ARRAYS), dim)
                own = np.flatnonzero((tree.ids != NO_ID) & (tree.ids % every == 0))
                m = len(own)
                if m:
                    s = Search(tree, tree.x[own], np.full((m, k), NO_SCORE), np.full((m, k), NO_ID), own).run()
                    same = [pa.array(np.full(m, v, np.int32)) for v in (dim, pivot, part)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array([shard] * m), pa.array(own, pa.int32()), pa.array(tree.ids[own]), lists(tree.x[own], pa.int32()), lists(s.scores, pa.int64()), lists(s.ids, pa.int64())], schema=_schema(ASKED))

    return run


def _packed(group: pa.Table) -> pa.Table:
    """One row of PACKED from queries, with the ball about them and the least of their kth scores."""
    group = group.combine_chunks()
    col = lambda k: group.column(k).chunk(0)
    x, scores = matrix(col("x")), matrix(col("scores"))
    centre = x.mean(axis=0)
    radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1).max()))
    key = [group.column(k)[0].as_py() for k in ("dim", "pivot", "part")]
    return pa.table(
        [
            pa.array(key[:1], pa.int32()), pa.array(["/".join(map(str, key))]), pa.array([col("shard").to_pylist()]), _one(col("place").to_numpy(), pa.int32()), _one(col("id").to_numpy(), pa.int64()),
            _one(x, pa.int32()), _one(scores, pa.int64()), _one(matrix(col("ids")), pa.int64()), _one(centre, pa.float64()), pa.array([radius]), pa.array([float(scores[:, -1].min())]),
        ],
        schema=_schema(PACKED),
    )


def _searched(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of FOUND: what a shard has for the queries of a pack that are of other shards and better than what they have.

    Scores found in a cell are shared with the next cell of that pack in the same task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, pack, shards, places, ids, q, scores, top = None, *[None] * 7
        for b in batches:
            for i in range(b.num_rows):
                at = lambda c: b.column(b.schema.get_field_index(c))[i].as_py()  # noqa: B023, E731
                dim = at("dim")
                if (name := at("pack")) != pack:
                    pack, shards = name, np.array(at("shards"))
                    a = _arrays(b, i, ["places", "asked", "qx", "scores", "top"])
                    places, ids, q, scores, top = a["places"], a["asked"], a["qx"].astype(np.int64).reshape(-1, dim), a["scores"].reshape(-1, k), a["top"].reshape(-1, k)
                away = np.flatnonzero(shards != at("shard"))
                if not len(away):
                    continue
                s = Search(BallTree.read(_arrays(b, i, TREE_ARRAYS), dim), q[away], scores[away], top[away]).run()
                scores, top = scores.copy(), top.copy()
                scores[away], top[away] = s.scores, s.ids
                met = np.flatnonzero(s.here.any(axis=1))
                kept = s.here[met]
                offsets = pa.array(np.append(0, np.cumsum(kept.sum(axis=1))).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shards[away[met]].tolist(), pa.string()), pa.array(places[away[met]]), pa.array(ids[away[met]]), pa.ListArray.from_arrays(offsets, pa.array(s.scores[met][kept])), pa.ListArray.from_arrays(offsets, pa.array(s.ids[met][kept]))],
                    schema=_schema(FOUND),
                )

    return run


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _dealt(rows: DataFrame, size: int, seed: Column) -> DataFrame:
    """rows with part: those of one dim and pivot dealt out by a hash over as many parts as hold about `size` each."""
    parts = rows.groupBy("dim", "pivot").agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))
    return rows.join(parts, ["dim", "pivot"]).withColumn("part", F.pmod(F.xxhash64(seed), F.col("parts")).cast("int")).drop("parts")


def top_products(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each vector whose id is divisible by `every` with all other rows.

    Components count as integers (vectors.py) and products are exact; ties go to the smaller id, null ids last. A query meets vectors of its
    own length only; null and empty vectors and those with a null or non-finite component take no part. A repeated row is a candidate
    for its copies, and each copy of a query has rows of its own. An empty table gives no rows. Other columns aren't read.

    Vectors are dealt into shards of about 4096 by the nearest of at most 256 pivots; near a crowded pivot there are more
    shards. A shard's tree is built once and written. Queries are searched in their own shard first; then packs of about 1024 that lie near each
    other, with their kth scores, meet the shards whose ball may hold more than the least of those.
    """
    spark = vectors.sparkSession
    kept = written(integer_vectors(vectors, id_col, vec_col), "vectors", 20_000)
    n = kept.count()
    few = kept.select(F.xxhash64("id", "x").alias("h"), "x").orderBy("h", "x").limit(min(PIVOTS, n // SHARD)).collect() if n >= 2 * SHARD else []
    pivots = [(j, np.array(r["x"], np.int64)) for j, r in enumerate(few)]
    placed = written(kept.mapInArrow(_placed(pivots), "id long, x array<int>, dim int, pivot int, number long"), "placed", 20_000)
    dropped(kept)
    shards = _dealt(placed, SHARD, F.struct("id", "number"))
    trees = written(shards.groupBy("dim", "pivot", "part").applyInArrow(_grown, TREE), "trees")
    dropped(placed)
    asked = written(trees.mapInArrow(_at_home(every, k), ASKED), "asked", 8)
    packs = written(_dealt(asked.drop("part"), PACK, F.struct("shard", "place")).groupBy("dim", "pivot", "part").applyInArrow(_packed, PACKED), "packs")

    p, t = packs.select("dim", "pack", F.col("centre").alias("pc"), F.col("radius").alias("pr"), "least"), trees.select("dim", "shard", "centre", "radius")
    long = lambda v: F.sqrt(_dot(v, v))
    bound = _dot(F.col("pc"), F.col("centre")) + long(F.col("pc")) * F.col("radius") + (long(F.col("centre")) + F.col("radius")) * F.col("pr")
    slack = 1 + 1e-9 * (long(F.col("pc")) + F.col("pr")) * (long(F.col("centre")) + F.col("radius"))
    cells = written(p.join(t, "dim").where(bound + slack >= F.col("least")).select("pack", "shard"), "cells")
    asking = packs.select("pack", "shards", "places", F.col("ids").alias("asked"), F.col("x").alias("qx"), "scores", "top")
    met = cells.join(trees.select("shard", "dim", *TREE_ARRAYS), "shard").join(asking, "pack")
    found = written(met.mapInArrow(_searched(k), FOUND), "found", 4)
    dropped(trees, packs, cells)

    each = asked.select("shard", "place", "id", "scores", "ids").unionByName(found)
    each = each.select("shard", "place", F.col("id").alias("query_id"), F.explode(F.arrays_zip("scores", "ids")).alias("hit")).where(F.col("hit.scores") > NO_SCORE)
    best = F.row_number().over(Window.partitionBy("shard", "place").orderBy(F.desc("hit.scores"), F.asc("hit.ids")))
    ranked = each.withColumn("rank", best).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("hit.ids") < NO_ID, F.col("hit.ids")).alias("vec_id"), F.col("hit.scores").alias("score"))


def op13_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP13_SQL = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.x) = len(c.x))
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score
FROM s WINDOW w AS (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) QUALIFY rank <= 5
"""
