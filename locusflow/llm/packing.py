"""Best-fit packing of token sequences into bins of one capacity, by large-item matching.

Pieces are counted by length, and the plan is made on those counts alone (never more than capacity numbers, whatever the
number of documents). Pieces above a third of the capacity come first: the longest is matched with the longest that still
fits beside it, so a bin has two of them at most. Then shorter pieces, longest first, go to the tightest gaps they fit.
The plan says where the r-th piece of each length goes; pieces are numbered within their length by counting per part.

Null and empty texts are one piece of the end token alone. Rows that repeat are packed as often as they occur. Only the
identifier and the text are read. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import library_encoder, slices, vocabulary
from .common import documents, released, written

PIECES = "id long, piece int, start long, length long, ids_crc32 long, part int, within long"


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first bin, pieces a bin, offset) rows that place every counted piece."""
    left = {n: c for n, c in counts.items() if c}
    placed: dict[int, int] = defaultdict(int)
    rows: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: (first bin, bins)
    bins = 0

    def put(n: int, many: int, first: int, each: int, offset: int) -> None:
        rows.append((n, placed[n], placed[n] + many, first, each, offset))
        placed[n] += many
        left[n] -= many
        if not left[n]:
            del left[n]

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        i = bisect.bisect_right(large, capacity - n) - 1
        mate = large[i] if i >= 0 else 0
        if mate == n and left[n] == 1:
            mate = large[i - 1] if i else 0
        many = left[n] // 2 if mate == n else min(left[n], left[mate]) if mate else left[n]
        put(n, many, bins, 1, 0)
        if mate:
            put(mate, many, bins, 1, n)
        gaps[capacity - n - mate].append((bins, many))
        bins += many
        large = [x for x in large if x in left]
    open_gaps = sorted(g for g in gaps if g)
    for n in sorted(left, reverse=True):
        while n in left:
            i = bisect.bisect_left(open_gaps, n)
            if i == len(open_gaps):
                gap, (first, many) = capacity, (bins, -(-left[n] // (capacity // n)))
                bins += many
            else:
                gap = open_gaps[i]
                first, many = gaps[gap].pop()
                if not gaps[gap]:
                    open_gaps.pop(i)
            each = gap // n
            full, rest = min(many, left[n] // each), 0
            if full:
                put(n, full * each, first, each, capacity - gap)
            if full < many and n in left:
                rest = left[n]
                put(n, rest, first + full, rest, capacity - gap)
            for g, (a, k) in ((gap - n * each, (first, full)), (gap - n * rest, (first + full, 1 if rest else 0)), (gap, (first + full + bool(rest), many - full - bool(rest)))):
                if g and k:
                    if not gaps[g]:
                        bisect.insort(open_gaps, g)
                    gaps[g].append((a, k))
    return rows


def _cut(path: str, capacity: int, end: int | None):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = library_encoder(path, False), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        tail = b"" if end is None else np.array([end], "<u4").tobytes()
        for batch in batches:
            for own in slices(batch):
                rows = []
                for id_, ids in zip(own.column(0).to_pylist(), encoder.encode(own.column(1))):
                    ids += tail
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        n = len(piece) // 4
                        rows.append((id_, k, at // 4, n, zlib.crc32(piece), part, seen[n]))
                        seen[n] += 1
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, types)], names=["id", "piece", "start", "length", "ids_crc32", "part", "within"])

    return run


def pack(docs: DataFrame, path: str, capacity: int = 4096, end: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: id_col, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = written(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_cut(path, capacity, end), PIECES), "pieces")
    counts = pieces.groupBy("part", "length").count()
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # one row a length: capacity rows at most
    rows = plan(total, capacity)
    spots = spark.createDataFrame(rows, "length long, lo long, hi long, bin long, each long, off long") if rows else spark.createDataFrame([], "length long, lo long, hi long, bin long, each long, off long")
    ahead = counts.select("part", "length", F.expr("sum(count) over (partition by length order by part rows between unbounded preceding and 1 preceding)").alias("before"))
    # rows of the plan are at most a few for each length and gap; both are bounded by the capacity
    ranked = pieces.join(ahead, ["part", "length"]).withColumn("rank", F.coalesce("before", F.lit(0)) + F.col("within"))
    per = F.broadcast(spots.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "bin", "each", "off"))).alias("spots")))
    at = ranked.join(per, "length").withColumn("s", F.expr("filter(spots, s -> s.lo <= rank and rank < s.hi)[0]"))
    return at.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", F.expr("s.bin + (rank - s.lo) div s.each").alias("sequence_id"), F.expr("s.off + ((rank - s.lo) % s.each) * length").alias("offset"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))
