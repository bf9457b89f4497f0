"""Operators on intervals and positions: pile-up, band joins, as-of pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coverage(df: DataFrame, keys: list[str], start: str, end: str, weights: dict[str, Column] | None = None, width: int = 1 << 16, at: DataFrame | None = None) -> DataFrame:
    """keys, pos and a running depth for each weight wherever it may change; intervals are half open.

    Intervals become +w at start and -w at end, are summed by position before the shuffle, and added up along the key;
    they are never spread over their bases. A crowded key is split into bins of `width` positions. at: keys and pos of places for which there is a
    row in any case; they go along as changes of nothing.
    """
    weights = weights or {"depth": F.lit(1)}
    return running_sums(changes(df, keys, start, end, weights, at), keys, "pos", list(weights), width)


def changes(df: DataFrame, keys: list[str], start: str, end: str, weights: dict[str, Column], at: DataFrame | None = None) -> DataFrame:
    """keys, pos and by how much each weight's depth changes there, for coverage()."""
    named = df.select(*keys, F.col(start).alias("__s"), F.col(end).alias("__e"), *(w.cast("long").alias(n) for n, w in weights.items())).where("__s < __e")
    ends = F.explode(F.array(F.struct(F.col("__s").alias("pos"), F.lit(1).alias("sign")), F.struct(F.col("__e").alias("pos"), F.lit(-1).alias("sign"))))
    deltas = named.withColumn("__x", ends).groupBy(*keys, F.col("__x.pos").alias("pos")).agg(*(F.sum(F.col(n) * F.col("__x.sign")).alias(n) for n in weights))
    if at is not None:
        still = at.select(*keys, "pos", *(F.lit(0).cast("long").alias(n) for n in weights))
        deltas = deltas.unionByName(still).groupBy(*keys, "pos").agg(*(F.sum(n).alias(n) for n in weights))
    return deltas


def running_sums(df: DataFrame, keys: list[str], pos: str, names: list[str], width: int = 1 << 16) -> DataFrame:
    """keys, pos and the running sums of the named columns along pos, one row a position.

    Positions are cut into bins: sums run within a bin, and the few bins' totals are added up before. So one key's rows are
    many tasks' work, and both steps read one shuffle.
    """
    bins = [*keys, "__bin"]
    binned = df.withColumn("__bin", F.floor(F.col(pos) / width)).repartition(*bins)
    ahead = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = binned.groupBy(*bins).agg(*(F.sum(n).alias(f"__t_{n}") for n in names))
    before = totals.select(*bins, *(F.coalesce(F.sum(f"__t_{n}").over(ahead), F.lit(0)).alias(f"__b_{n}") for n in names))
    along = Window.partitionBy(*bins).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    own = binned.select(*bins, pos, *(F.sum(n).over(along).alias(n) for n in names))
    return own.join(before, bins).select(*keys, pos, *((F.col(n) + F.col(f"__b_{n}")).alias(n) for n in names))


def carried(binned: DataFrame, keys: list[str], summary: dict[str, Column], state: dict[str, Column]) -> DataFrame:
    """binned, rows with __bin, with what the bins before a row's own leave for it.

    Each bin is summed up to one row (summary), those few rows are gone through in order of bins (state, window expressions on the
    summaries) and joined to the bin's rows. So what depends on all rows before one needs no task that sees all rows of a key.
    """
    bins = [*keys, "__bin"]
    left = binned.groupBy(*bins).agg(*(v.alias(k) for k, v in summary.items())).select(*(F.col(k).alias(f"__s_{i}") for i, k in enumerate(bins)), *(v.alias(k) for k, v in state.items()))
    on = F.lit(True)
    for i, k in enumerate(bins):
        on = on & binned[k].eqNullSafe(left[f"__s_{i}"])
    return binned.join(left, on).drop(*(f"__s_{i}" for i in range(len(bins))))


def _bins_before(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("__bin")


def neighbour_depth(profile: DataFrame, keys: list[str], depth: str = "depth", width: int = 1 << 16) -> DataFrame:
    """Depth just left of each position of a profile, and at it. The first of a bin of `width` positions gets what the bins before it leave."""
    binned = profile.select(*keys, "pos", F.col(depth).alias("__d")).withColumn("__bin", F.floor(F.col("pos") / width)).repartition(*keys, "__bin")
    met = carried(binned, keys, {"__last": F.max_by("__d", "pos")}, {"__before": F.lag("__last").over(_bins_before(keys))})
    own = F.lag("__d").over(Window.partitionBy(*keys, "__bin").orderBy("pos"))
    return met.select(*keys, "pos", F.coalesce(own, "__before", F.lit(0)).alias("left_depth"), F.col("__d").alias("right_depth"))


def band_join(a: DataFrame, b: DataFrame, keys: list[str], a_pos: str, b_pos: str, within: int, how: str = "inner", b_keys: list[str] | None = None) -> DataFrame:
    """Pairs of equal keys whose positions differ by at most `within`.

    Positions are cut into bins of that width; a row of a meets b in three bins. So the join is on equal keys and bins,
    and a crowded contig is split among its bins. Column names of a and b must differ but for the keys.
    """
    width = max(1, within)
    bin_of = lambda c: F.floor(c / F.lit(width)).cast("long")
    left = a.withColumn("__bin", F.explode(F.array(*(bin_of(F.col(a_pos)) + k for k in (-1, 0, 1)))))
    b_keys = b_keys or keys
    right = b.withColumn("__b", bin_of(F.col(b_pos)))
    for k in b_keys:
        right = right.withColumnRenamed(k, f"__k_{k}")
    on = [left[x] == right[f"__k_{y}"] for x, y in zip(keys, b_keys)] + [left["__bin"] == right["__b"], F.abs(F.col(a_pos) - F.col(b_pos)) <= within]
    joined = left.join(right, on, "inner").drop("__bin", "__b", *(f"__k_{k}" for k in b_keys))
    if how == "inner":
        return joined
    if how != "left_semi" and how != "left_anti":
        raise ValueError(how)
    met = joined.select(*a.columns).distinct()
    return a.join(met, [a[c].eqNullSafe(met[c]) for c in a.columns], how)


def best_within(at: DataFrame, marks: DataFrame, keys: list[str], ranges: dict[str, tuple[int, int, Column]]) -> DataFrame:
    """keys, pos and a column for each range: for the different positions of `at` the largest value of the marks from pos - back to pos + ahead, null if none.

    at: keys, pos. marks: keys, pos and what the values are made of. ranges: back, ahead and value by name. A key is cut into blocks as long as the
    range, which so lies in two at most: the largest from its start to the one block's end and from the other's start to its end are running maxima. So
    work and rows follow positions and marks, not the pairs of them within reach.
    """
    probes = at.select(*keys, F.col("pos").alias("__for")).where(F.col("__for").isNotNull()).distinct()
    found = None
    for name, (back, ahead, value) in ranges.items():
        ends = F.explode(F.array(F.struct((F.col("__for") - back).alias("pos"), F.lit(False).alias("last")), F.struct((F.col("__for") + ahead).alias("pos"), F.lit(True).alias("last"))))
        asked = probes.select(*keys, "__for", ends.alias("e")).select(*keys, "__for", "e.pos", "e.last")
        rows = marks.where(F.col("pos").isNotNull()).select(*keys, "pos", value.alias("__v")).unionByName(asked, allowMissingColumns=True)
        rows = rows.withColumn("__bin", F.floor(F.col("pos") / (back + ahead + 1)))
        block = Window.partitionBy(*keys, "__bin")
        along = lambda order: F.max("__v").over(block.orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
        seen = rows.withColumn("__to", along(F.asc("pos"))).withColumn("__from", along(F.desc("pos"))).where(F.col("__for").isNotNull())
        seen = seen.select(*keys, F.col("__for").alias("pos"), F.when(F.col("last"), F.col("__to")).otherwise(F.col("__from")).alias(name))
        found = seen if found is None else found.unionByName(seen, allowMissingColumns=True)
    return found.groupBy(*keys, "pos").agg(*(F.max(name).alias(name) for name in ranges))


def watermark_pool(df: DataFrame, key: str, pos: str, left: int, right: int, width: int = 1 << 16) -> DataFrame:
    """For each position: the last start not beyond pos + right, and how many starts lie from that less (left + right) to it.

    Both look no farther than left + right. So positions go to bins of `width`, and those that near a border to the next bin as well, and each bin is by itself.
    """
    halo = left + right
    per = df.groupBy(key, pos).agg(F.count(F.lit(1)).alias("n"))
    bin_of = lambda x: F.floor(x / width)
    spread = per.withColumn("__bin", F.explode(F.array_distinct(F.array(bin_of(F.col(pos) - halo), bin_of(F.col(pos)), bin_of(F.col(pos) + halo)))))
    ordered = Window.partitionBy(key, "__bin").orderBy(pos)
    marked = spread.withColumn("watermark", F.max(pos).over(ordered.rangeBetween(0, right))).withColumn("__pool", F.sum("n").over(ordered.rangeBetween(-halo, 0)))
    pools = marked.select(F.col(key).alias("__k"), F.col("__bin").alias("__b"), F.col(pos).alias("__w"), F.col("__pool").alias("pool"))
    own = marked.where(F.col("__bin") == bin_of(F.col(pos)))
    return own.join(pools, (F.col(key) == F.col("__k")) & (F.col("__bin") == F.col("__b")) & (F.col("watermark") == F.col("__w"))).select(key, pos, "watermark", "pool")


def gap_sessions(df: DataFrame, keys: list[str], pos: str, gap: int, width: int | None = None) -> DataFrame:
    """df with a session number within its keys; a gap larger than `gap` begins a new one.

    width: keys with many rows, such as contigs, are cut into bins of so many positions. A bin counts its own beginnings, and what the bins before it
    leave is how many there were and where the last row lay.
    """
    fresh = lambda w: F.when(F.col(pos) - F.lag(pos).over(w) > gap, 1).otherwise(0)
    if width is None:
        w = Window.partitionBy(*keys).orderBy(pos)
        return df.withColumn("__new", fresh(w)).withColumn("session", F.sum("__new").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("__new")
    binned = df.withColumn("__bin", F.floor(F.col(pos) / width)).repartition(*keys, "__bin")
    w = Window.partitionBy(*keys, "__bin").orderBy(pos)
    marked = binned.withColumn("__new", fresh(w))
    before = _bins_before(keys)
    sums = {"__first": F.min(pos), "__last": F.max(pos), "__inner": F.sum("__new")}
    # where the bin before ends, and how many sessions have begun inside of all bins before; then one more at each border with a gap
    met = carried(marked, keys, sums, {"__left": F.lag("__last").over(before), "__head": F.col("__first"), "__done": F.coalesce(F.sum("__inner").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    border = F.max(F.when(F.col("__head") - F.col("__left") > gap, 1).otherwise(0))
    met = carried(met, keys, {"__border": border}, {"__at": F.sum("__border").over(before.rowsBetween(Window.unboundedPreceding, 0))})
    session = F.sum("__new").over(w.rangeBetween(Window.unboundedPreceding, 0)) + F.col("__done") + F.col("__at")
    return met.withColumn("session", session).select(*df.columns, "session")


def session_evidence(sessions: DataFrame, keys: list[str], pos: str, source: str, support: int) -> DataFrame:
    """Sessions with size and evidence: 3 if any source is 2, 2 if both 0 and 1 occur, else 1; weak small ones go."""
    has = lambda k: F.max(F.when(F.col(source) == k, 1).otherwise(0))
    out = sessions.groupBy(*keys, "session").agg(F.min(pos).alias("first_pos"), F.max(pos).alias("last_pos"), F.count(F.lit(1)).alias("power"), F.when(has(2) == 1, 3).when((has(0) == 1) & (has(1) == 1), 2).otherwise(1).alias("evidence"))
    return out.where((F.col("evidence") > 1) | (F.col("power") >= support))


def first_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each key. Spark drops rows beyond the limit in each task before it shuffles; limits larger than the session's threshold for that raise it."""
    threshold = "spark.sql.optimizer.windowGroupLimitThreshold"
    if int(df.sparkSession.conf.get(threshold)) < n:
        df.sparkSession.conf.set(threshold, n)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def cleared_beyond(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Rows of keys that have at most n."""
    few = df.groupBy(*keys).count().where(F.col("count") <= n).select(*keys)
    return df.join(few, keys, "left_semi")
