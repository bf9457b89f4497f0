"""What reads and mates around a position add to it: pools of mates, pairing of loci, merged lists, transferred and expected counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import partners
from ..functions.numeric import holds, ratio
from .intervals import band_join


def mate_pools(positions: DataFrame, mates: DataFrame, before: int, after: int) -> DataFrame:
    """contig, pos, left_pool, right_pool: mates that start from pos - before to pos + after, by whether they start left of the position
    or not; one that spans it is in both.

    positions: contig, pos. mates: contig, start, end. Positions without mates have zeros.
    """
    m = mates.select("contig", "start", "end")
    met = band_join(positions.select("contig", "pos"), m, ["contig"], "pos", "start", max(before, after))
    left = F.col("start") < F.col("pos")
    met = met.where((F.col("start") >= F.col("pos") - before) & (F.col("start") <= F.col("pos") + after))
    got = met.groupBy("contig", "pos").agg(F.count_if(left).alias("l"), F.count_if(~left | (F.col("pos") < F.col("end"))).alias("r"))
    return positions.select("contig", "pos").join(got, ["contig", "pos"], "left").select("contig", "pos", F.coalesce("l", F.lit(0)).alias("left_pool"), F.coalesce("r", F.lit(0)).alias("right_pool"))


def split_pairs(x: Column, others: Column, apart: int) -> Column:
    """struct(lo, hi, fuzzy, used): a locus after it has taken in, in order, those of a list that lie within `apart` on its contig, side and strand.

    An exact one makes a vague one exact, two vague ones make one range; used has the numbers of those taken.
    """
    numbered = F.transform(others, lambda y, i: F.struct(y.alias("y"), i.alias("i")))
    start = F.struct(x["pos"].cast("int").alias("lo"), x["ext_pos"].cast("int").alias("hi"), x["fuzzy"].alias("fuzzy"), F.array().cast("array<int>").alias("used"))

    def step(s: Column, p: Column) -> Column:
        y = p["y"]
        met = (x["contig_idx"] == y["contig_idx"]) & (x["right_side"] == y["right_side"]) & (x["inverted"] == y["inverted"]) & (F.greatest(F.lit(0), y["pos"] - s["hi"], s["lo"] - y["ext_pos"]) <= apart)
        sharp, grown = met & s["fuzzy"] & ~y["fuzzy"], met & s["fuzzy"] & y["fuzzy"]
        return F.struct(
            F.when(sharp, y["pos"]).when(grown, F.least(s["lo"], y["pos"])).otherwise(s["lo"]).cast("int").alias("lo"), F.when(sharp, y["pos"]).when(grown, F.greatest(s["hi"], y["ext_pos"])).otherwise(s["hi"]).cast("int").alias("hi"),
            (s["fuzzy"] & ~sharp).alias("fuzzy"), F.when(met, F.concat(s["used"], F.array(p["i"].cast("int")))).otherwise(s["used"]).alias("used"),
        )

    return F.aggregate(numbered, start, step)


def merged_list(loci: Column, within: int = 100, read_length: int = partners.READ_LENGTH, ids: bool = False) -> Column:
    """A list of loci in which each is merged into the first before it that is close; its range grows, or becomes exact, by what it takes in.

    Left out are suspicious loci and those with a tenth or less of the mates they expect. Lists of a position, in order of their samples.
    ids: loci have besides an array of that name, the samples they are from, and get the union.
    """

    def step(done: Column, x: Column) -> Column:
        bad = x["suspicious"] | ((x["expected"] > 0) & ~holds(ratio(x["mates"], x["expected"]) > 0.1))
        first = F.array_min(F.transform(F.filter(F.transform(done, lambda y, i: F.struct(y.alias("y"), i.alias("i"))), lambda p: partners.close(p["y"], x, within, read_length)), lambda p: p["i"]))

        def taken(y: Column) -> Column:
            one = partners.merged(y, x)
            lo = F.when(y["fuzzy"] & ~x["fuzzy"], x["pos"]).when(y["fuzzy"], F.least(y["pos"], x["pos"])).otherwise(y["pos"])
            hi = F.when(y["fuzzy"] & ~x["fuzzy"], x["pos"]).when(y["fuzzy"], F.greatest(y["ext_pos"], x["ext_pos"])).otherwise(y["ext_pos"])
            one = one.withField("ids", F.array_union(y["ids"], x["ids"])) if ids else one
            return one.withField("pos", lo).withField("ext_pos", hi).withField("fuzzy", y["fuzzy"] & x["fuzzy"])

        return F.when(bad, done).when(first.isNull(), F.concat(done, F.array(x))).otherwise(F.transform(done, lambda y, i: F.when(i == first, taken(y)).otherwise(y)))

    return F.aggregate(loci, F.filter(loci, lambda x: F.lit(False)), step)


def transferred(primary: Column, secondary: Column) -> dict[str, Column]:
    """Counts after reads that support a locus from both sides are paired: primary and secondary are how many different ones there are."""
    c = F.col
    return {"paired_soft": c("paired_soft") + primary, "unpaired_soft": c("unpaired_soft") - primary, "paired_hard": c("paired_hard") + secondary, "unpaired_hard": c("unpaired_hard") - secondary}


def expected_mates(total: Column, candidates: Column, proper_ratio: float) -> Column:
    """struct(expected, errors): discordant mates to expect beside a position, less those that come by error where pairs are seldom proper."""
    errors = candidates * F.lit(0.9 - proper_ratio)
    return F.struct(F.greatest(F.lit(0), F.round(total - errors).cast("int")).alias("expected"), (errors / 2).alias("errors"))


def running_index(df: DataFrame, keys: list[str], pos: str, width: int = 1 << 16) -> DataFrame:
    """df with running_index: place of each row, from 1, in order of keys and pos; rows of one place are in any order.

    Rows are counted by bin, the few bins are added up, and rows numbered within their bin; so no task sees all rows.
    """
    bins = [*keys, "__bin"]
    binned = df.withColumn("__bin", F.floor(F.col(pos) / width)).repartition(*bins)
    ahead = Window.orderBy(*bins).rowsBetween(Window.unboundedPreceding, -1)
    before = binned.groupBy(*bins).agg(F.count(F.lit(1)).alias("__n")).select(*bins, F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy(*bins).orderBy(pos))
    return binned.withColumn("__own", own).join(before, bins).select(*df.columns, (F.col("__before") + F.col("__own")).alias("running_index"))
