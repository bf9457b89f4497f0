"""Rules that let positions and loci pass: emission of a position, control positions, panel admission, overhang candidates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.loci import range_distance
from ..functions.numeric import holds, ratio

#: Most clipped reads that are kept of a position (fixed value).
SOFT_CAP = 2000


def _total(*names: str) -> Column:
    out = F.col(names[0])
    for n in names[1:]:
        out = out + F.col(n)
    return out


def swamped() -> Column:
    """Positions whose evidence is nearly all of low quality, or that have more reads than are looked at. Columns: COUNTS and soft_reads."""
    event, poor = _total("unpaired_soft", "unpaired_hard", "short_indel"), _total("low_breaks_soft", "low_spans_soft", "low_spans_hard")
    return holds(((event + poor > 50) & (ratio(poor, event + poor) > 0.85)) | ((F.col("soft_reads") == SOFT_CAP) & (event + F.col("normal_spans") + poor > 20 * SOFT_CAP)))


def emission(support: int = 5) -> Column:
    """'full', 'bare' (a position given out without loci and overhangs) or 'none'.

    Columns: the counts before and, prefixed with 'final_', after loci were paired; soft_reads; largest_pool (reads in the largest of
    the four mate pools); loci (how many); overhang_chars.
    """
    c = F.col
    event, poor = _total("unpaired_soft", "unpaired_hard", "short_indel"), _total("low_breaks_soft", "low_spans_soft", "low_spans_hard")
    thin = ~swamped() & (event < support) & (c("largest_pool") < support)
    bare = swamped() | thin
    mates, loci = F.when(bare, 0).otherwise(c("mate_support")), F.when(bare, 0).otherwise(c("loci"))
    weak = (event + mates + poor < support) | ((event + poor < support) & (loci == 0))
    f = lambda *names: _total(*(f"final_{n}" for n in names))
    poor2 = f("low_breaks_soft", "low_spans_hard", "low_spans_soft", "repetitive")
    event2 = f("paired_soft", "paired_hard", "unpaired_soft", "unpaired_hard", "short_indel")
    strict = f("paired_soft", "unpaired_soft", "paired_hard", "low_breaks_soft", "low_spans_soft", "repetitive")
    silent = bare | ((loci == 0) & (c("overhang_chars") < 2))
    gone = (thin & (poor < c("normal_spans"))) | weak | (silent & ~((event2 + poor2 > 10) & (strict > 0)))
    return F.when(gone, "none").when(bare, "bare").otherwise("full")


def overhang_accepted(all_distant: Column, masked_ratio: Column) -> Column:
    """Overhangs of low complexity count as repetitive unless all loci of the position are distant; an undefined ratio is not accepted."""
    return all_distant | holds(masked_ratio <= 0.5)


def best_locus(loci: Column) -> Column:
    """The locus by which a control position is judged: the first that isn't suspicious, then any with more support than the last one
    chosen after it (the first counts as having none)."""
    kind = "struct<x:struct<pos:int,ext_pos:int,contig_idx:int,inverted:boolean,support:int,secondary:int,mates:int>,n:int>"
    small = lambda x: F.struct(*(x[k].cast("boolean" if k == "inverted" else "int").alias(k) for k in ("pos", "ext_pos", "contig_idx", "inverted", "support", "secondary", "mates")))

    def step(s: Column, x: Column) -> Column:
        n = (x["support"] + x["secondary"] + x["mates"]).cast("int")
        none = s["x"].isNull()
        take = ~x["suspicious"] & (none | (n > s["n"]))
        return F.struct(F.when(take, small(x)).otherwise(s["x"]).alias("x"), F.when(take & ~none, n).otherwise(s["n"]).alias("n")).cast(kind)

    return F.aggregate(loci, F.expr(f"CAST(named_struct('x', null, 'n', 0) AS {kind})"), step)["x"]


def control_kept(loci: Column, overhang_ratio: Column, level: int, pathogen: bool) -> Column:
    """Whether a position of a control sample is used. Columns: contig_idx, pos and the counts; overhang_ratio is null without overhangs."""
    c = F.col
    soft, hard = _total("paired_soft", "unpaired_soft"), _total("paired_hard", "unpaired_hard")
    foreign = F.lit(pathogen) & (soft > 19) & (hard < 3) & holds(overhang_ratio > 0.7)
    x = best_locus(loci)
    far = range_distance(c("contig_idx"), c("pos"), x["contig_idx"], x["pos"], x["ext_pos"])
    thin1, thin2 = x["support"] < 5, x["secondary"] < 5
    turned = x["inverted"] & (far > 0) & F.when(far < 10_000, F.lit(level == 2) | thin1 | thin2).otherwise(thin1 & thin2)
    poor = F.lit(level > 0) & F.when(x.isNull(), soft + hard < 10).otherwise(turned)
    return ~(foreign | poor)


def admitted(x: Column) -> Column:
    """Loci that a panel takes in."""
    splits = x["support"] + x["secondary"]
    far = (x["expected"] > 0) & (2 * x["mates"] >= x["expected"]) & (((splits > 4) & (x["mates"] > 2)) | (x["mates"] > 4))
    near = (splits > 4) | ((splits > 2) & (x["support"] > 0) & (x["secondary"] > 0))
    return ~x["suspicious"] & (x["contig_idx"] <= 1001) & F.when(x["distant"], far).otherwise(near)


def breaks() -> Column:
    return _total("paired_soft", "paired_hard", "unpaired_soft", "unpaired_hard", "short_indel")


def covered(has_overhang: Column) -> Column:
    """Positions that a panel counts for themselves."""
    n = breaks()
    share = ratio(n, n + F.col("normal_spans"))
    return (F.col("short_indel") > 2) | (n > 9) | ((n > 4) & holds((share > 0.3) | ((share > 0.1) & has_overhang)))


def panel_validity(loci: Column, has_overhang: Column) -> Column:
    """1 counted for itself, 0 only as the place of loci, -1 left out."""
    some = (breaks() < 200) & F.exists(loci, admitted)
    return F.when(covered(has_overhang), 1).when(some, 0).otherwise(-1)


def overhang_only(least: int = 5, clonality: float = 0.2, artifacts: float = 0.5) -> Column:
    """Positions without partner that only their overhangs tell of."""
    c = F.col
    poor = _total("low_spans_soft", "low_breaks_soft", "repetitive")
    solid = ~holds(ratio(c("unpaired_soft"), c("normal_spans")) < clonality) & ~holds(ratio(poor, c("unpaired_soft") + poor) > artifacts)
    return (c("paired_soft") <= 0) & (c("short_indel") <= 0) & (c("unpaired_soft") >= least) & solid
