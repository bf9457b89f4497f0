"""Connected components of a table of links, by large-star and small-star rounds on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one task as stars: (id, smallest id it reaches within the task). Flushed when large."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = up[x]
        return x

    def out():
        rows = [(x, root(x)) for x in list(up)]
        rows = [r for r in rows if r[0] != r[1]]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["u", "v"])

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = root(x), root(y)
            up.setdefault(x, x)
            up.setdefault(y, y)
            if x != y:
                up[max(x, y)] = min(x, y)
        if len(up) > 1_000_000:
            yield out()
            up = {}
    yield out()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component: for each id in links, the smallest id that links lead to.

    Links of a task become stars first. Rounds are then logarithmic in the length of paths. A hub's neighbours are
    pre-aggregated to their minimum before the shuffle and joined by the hub; no group of neighbours is collected. It ends
    when every id has one parent and no parent has another.
    """
    given = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    edges = written(given.mapInArrow(_forest, "u long, v long").distinct(), "edges")
    while True:
        up = edges.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("u").alias("u")).first()
        if up["n"] == up["u"] and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "large-star")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(moved.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
