"""Alignment text as reads, and the parameter file of insert sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cigar, contigs, reads


def insert_limit(median: float | None = None, deviation: float | None = None, sigma: float = 5, most: int = 4000, default: int = 2000) -> float:
    """Largest insert of a proper pair."""
    if median is None:
        return default
    return min(most, median + sigma * deviation)


def read_insert_sizes(spark: SparkSession, path: str) -> tuple[float, float]:
    """Median and deviation: lines 1 and 3 of a short text file."""
    rows = spark.read.text(path, wholetext=True).first()[0].splitlines()
    return float(rows[0]), float(rows[2])


def read_alignments(spark: SparkSession, path: str | list[str], isize_max: float = 2000, clip: int = 10, quality: int = 23, low_quality: int = 12, low_clip: int = 5) -> DataFrame:
    """A row for each alignment on a contig that is called, decoded and classified; '@' lines are skipped.

    The contig is tested on the raw line before anything else is decoded, and the decoding is JVM expressions throughout.
    """
    line = spark.read.text(path).where(~F.col("value").startswith("@"))
    f = F.split("value", "\t")
    first = line.select("value", f.alias("f")).withColumn("chr_idx", contigs.contig_index(F.get("f", F.lit(2)))).where(F.col("chr_idx") <= contigs.LAST_CALLED)
    c = F.col
    base = first.select(
        "chr_idx", F.get("f", F.lit(0)).alias("name"), F.get("f", F.lit(1)).cast("int").alias("flag"), F.get("f", F.lit(3)).cast("int").alias("start"), F.get("f", F.lit(4)).cast("int").alias("mapq"), F.get("f", F.lit(5)).alias("cigar"), F.get("f", F.lit(6)).alias("rnext"),
        F.get("f", F.lit(7)).cast("int").alias("mate_pos"), F.get("f", F.lit(8)).cast("int").alias("tlen"), F.get("f", F.lit(9)).alias("seq"), F.get("f", F.lit(10)).alias("qual"), F.regexp_extract("value", "\tSA:Z:([^\t]+);", 1).alias("sa_tag"),
    )
    n = F.length("seq")
    decoded = base.withColumn("dec", F.when(cigar.is_candidate(c("cigar")), cigar.decode(c("start"), c("cigar"), n)).otherwise(F.struct((c("start") + n).cast("int").alias("end"), F.array().cast("array<struct<op:string,right:boolean,off:int,n:int,adj:int>>").alias("chunks"))))
    decoded = decoded.withColumns({"breaks": cigar.breaks(c("start"), c("dec")), "overhangs": cigar.overhangs(c("start"), c("dec"))})
    held = lambda text: F.when(reads.median_from(text, quality, low_quality), quality).otherwise(quality - 1)  # noqa: E731 - stands for the median, of which no more is asked
    decoded = decoded.withColumn("medians", F.transform("overhangs", lambda o: held(F.substring("qual", o["off"] + 1, o["n"]))))
    distant = reads.distant_mate(c("rnext"), c("tlen"), isize_max)
    kind = reads.read_class(reads.supplementary(c("flag")), c("mapq"), c("dec.chunks"), c("medians"), held(c("qual")), n, distant, clip, quality, low_clip, unique_support(c("sa_tag"), c("dec.chunks")))
    mate_idx = F.when(c("rnext") == "=", c("chr_idx")).otherwise(contigs.contig_index(c("rnext")))
    return decoded.select(
        "name", "flag", "chr_idx", "start", c("dec.end").alias("end"), kind.alias("read_type"), (reads.mapq_class(c("mapq")) > 0).alias("low_mapq"), (c("mapq") == 0).alias("null_mapq"),
        reads.supplementary(c("flag")).alias("supplementary"), reads.forward(c("flag")).alias("fwd"), reads.inverted_mate(c("flag")).alias("inverted_mate"), distant.alias("distant_mate"),
        mate_idx.alias("mate_chr_idx"), "mate_pos", (c("sa_tag") != "").alias("has_sa"), "sa_tag", "seq", "qual", "breaks", "overhangs",
    )


def unique_support(tag, chunks):
    """Whether supplementary loci speak for a unique place: one of quality over 20, or fewer of low quality than 2 (one clip)
    or 4 (two soft clips). The last locus of the tag is not counted."""
    parts = F.filter(F.split(tag, ";"), lambda x: x != "")
    counted = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    qualities = F.transform(counted, lambda x: F.get(F.split(x, ","), F.lit(4)).try_cast("int"))
    first = F.struct(F.lit(False).alias("good"), F.lit(0).alias("low"), F.lit(True).alias("ok"))
    soft = F.size(F.filter(chunks, lambda x: x["op"] == "S"))
    most = F.when(soft > 1, 4).otherwise(2)

    def step(s, q):
        good, low = s["good"] | (q > 20), s["low"] + F.when(q < 13, 1).otherwise(0)
        return F.struct(good.alias("good"), low.alias("low"), (s["ok"] & (good | (low < most))).alias("ok"))

    return F.when(tag == "", True).otherwise(F.aggregate(qualities, first, step)["ok"])
