"""A stream of reads gives the same coverage as a table of them."""

import pandas as pd

from locusflow.operators.intervals import coverage
from locusflow.streaming.depth import stream_coverage


def test_stream_is_batch(spark, tmp_path):
    import random

    rng = random.Random(5)
    reads = sorted((c, s, s + rng.randint(0, 60)) for c in (1, 2, 3) for s in (rng.randint(0, 500) for _ in range(120)))
    (tmp_path / "in").mkdir()
    step = 90
    for k in range(0, len(reads), step):  # reads of one start stay in order over files
        pd.DataFrame(reads[k : k + step], columns=["contig", "start", "end"]).astype("int64").to_parquet(tmp_path / f"in/{k:05d}.parquet", index=False)
        import os

        os.utime(tmp_path / f"in/{k:05d}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    late = pd.DataFrame({"contig": [1, 1, 2, 3], "start": [0, 600, 600, 600], "end": pd.array([50, None, None, None], "Int64")})
    late.to_parquet(tmp_path / "in/99999.parquet", index=False)
    stream = spark.readStream.schema("contig long, start long, end long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_coverage(stream).writeStream.format("memory").queryName("depths").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = sorted(map(tuple, spark.table("depths").collect()))
    want = coverage(spark.createDataFrame(reads, "contig long, start long, end long"), ["contig"], "start", "end").collect()
    assert got == sorted((r.contig, r.pos, r.depth) for r in want)


def test_stream_of_positions_is_batch(spark, tmp_path):
    import os

    from pyspark.sql import functions as F

    from locusflow.operators.support import mate_pools
    from locusflow.plans import calling
    from locusflow.plans.cuts import cut
    from locusflow.sources.alignments import read_alignments
    from locusflow.streaming.positions import POOLS, PROVIDER, stream_positions
    from tests.test_calling import stream

    (tmp_path / "a.sam").write_text("\n".join(stream(1)) + "\n")
    reads = cut(read_alignments(spark, str(tmp_path / "a.sam")))
    (tmp_path / "in").mkdir()
    rows = reads.orderBy("chr_idx", "start", "name")
    n, step = rows.count(), 150
    numbered = rows.toPandas()
    late = numbered.iloc[[0, 3]]  # reads that come again at the end
    ends = numbered.drop_duplicates("chr_idx").assign(start=None)
    parts = [numbered.iloc[k : k + step].sample(frac=1, random_state=k) for k in range(0, n, step)]
    for k, part in enumerate([*parts, late, ends]):
        spark.createDataFrame(part.to_dict("records"), reads.schema).coalesce(1).write.parquet(str(tmp_path / f"made{k}"))
        (file,) = (tmp_path / f"made{k}").glob("*.parquet")
        os.rename(file, tmp_path / f"in/{k:03d}.parquet")
        os.utime(tmp_path / f"in/{k:03d}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    spark.conf.set(key, PROVIDER)
    try:
        source = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = stream_positions(source).writeStream.format("memory").queryName("positions").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert q.awaitTermination(300)
    finally:
        spark.conf.set(key, was)
    got = spark.table("positions")
    assert sorted(r.late for r in got.where("late is not null").collect()) == sorted(int(x) for x in late["start"])
    counts = calling.breakpoint_counters(reads)
    mates = reads.where("read_type = 4 and not null_mapq and mate_chr_idx <= 1001").select(F.col("chr_idx").alias("contig"), "start", "end")
    pools = mate_pools(counts.select(F.col("chr_idx").alias("contig"), "pos"), mates, 303, 254).withColumnRenamed("contig", "chr_idx")
    want = counts.join(pools, ["chr_idx", "pos"]).select("chr_idx", "pos", *POOLS)
    tidy = lambda df: sorted(tuple(map(int, r)) for r in df.collect())
    assert tidy(got.where("late is null").select("chr_idx", "pos", *POOLS)) == tidy(want)
