"""Partner loci as structs: closeness, gates, loci of reads, stand-ins and rescues.

A locus has contig_idx, pos, ext_pos, right_side, inverted, support, secondary, mates, expected, suspicious, semi_suspicious,
error_prone, fuzzy, strict_fuzzy and distant; what loci.parse_locus() gives. Lists are arrays of them. Everything here is an
expression; lists of a position are short, so that folds over them stay small.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .contigs import LAST_PARTNER, contig_index
from .numeric import holds, ratio

READ_LENGTH = 101


def locus(contig: Column, pos: Column, ext_pos: Column, right_side: Column, inverted: Column, support: Column, secondary: Column, mates: Column, expected: Column, suspicious: Column, semi_suspicious: Column, error_prone: Column) -> Column:
    """A locus from its stored fields; the others follow from them."""
    fuzzy = (pos != ext_pos) | (support + secondary == 0)
    return F.struct(
        contig.alias("contig_idx"), pos.alias("pos"), ext_pos.alias("ext_pos"), right_side.alias("right_side"), inverted.alias("inverted"), support.alias("support"), secondary.alias("secondary"), mates.alias("mates"),
        expected.alias("expected"), suspicious.alias("suspicious"), semi_suspicious.alias("semi_suspicious"), error_prone.alias("error_prone"), fuzzy.alias("fuzzy"), (fuzzy | (support + secondary < 3)).alias("strict_fuzzy"),
        (suspicious | (expected > 0)).alias("distant"),
    )


def few_splits(x: Column) -> Column:
    """A locus that only few split reads tell of is a candidate for being vague."""
    return x["support"] + x["secondary"] < 3


def wide(read_length: int = READ_LENGTH) -> int:
    """How far vague loci may lie apart."""
    return int(2.5 * read_length)


def gap(a: Column, b: Column) -> Column:
    """How far two ranges lie apart, 0 where they meet."""
    return F.greatest(F.lit(0), b["pos"] - a["ext_pos"], a["pos"] - b["ext_pos"])


def _near(a: Column, b: Column, vague: Column, apart: int | Column, within: int) -> Column:
    return F.when(vague, gap(a, b) <= apart).otherwise(F.abs(a["pos"] - b["pos"]) <= within)


def close(a: Column, b: Column, within: int, read_length: int = READ_LENGTH, same_side: bool = False) -> Column:
    """Whether loci of one contig are near each other; strand doesn't matter, the side only if asked for."""
    out = (a["contig_idx"] == b["contig_idx"]) & _near(a, b, a["strict_fuzzy"] | b["strict_fuzzy"], wide(read_length), within)
    return out & (a["right_side"] == b["right_side"]) if same_side else out


def close_directed(a: Column, b: Column, within: int, read_length: int = READ_LENGTH) -> Column:
    """As close(), on one side and strand; both ranges are widened."""
    near = _near(a, b, a["strict_fuzzy"] | b["strict_fuzzy"], 2 * wide(read_length), within)
    return (a["inverted"] == b["inverted"]) & (a["contig_idx"] == b["contig_idx"]) & (a["right_side"] == b["right_side"]) & near


def close_homologous(a: Column, b: Column, within: int) -> Column:
    """Distant loci of one contig and side that may be places of one sequence."""
    near = _near(a, b, a["strict_fuzzy"] | b["strict_fuzzy"], 2 * within, within)
    return a["distant"] & b["distant"] & (a["contig_idx"] == b["contig_idx"]) & (a["right_side"] == b["right_side"]) & near


def position_close(contig: Column, pos: Column, x: Column, within: int, read_length: int = READ_LENGTH) -> Column:
    here = F.greatest(F.lit(0), x["pos"] - pos, pos - x["ext_pos"])
    return (contig == x["contig_idx"]) & F.when(x["fuzzy"], here <= 2 * wide(read_length)).otherwise(F.abs(pos - x["pos"]) <= within)


def slack(contig: Column, pos: Column, x: Column, read_length: int = READ_LENGTH) -> Column:
    """How far a mate may lie from a locus that a position names: five reads, or less where the locus itself is nearer."""
    far = F.lit(5 * read_length)
    return F.when(contig == x["contig_idx"], F.least(F.abs(pos - x["pos"]), far)).otherwise(far)


def mate_close(contig: Column, start: Column, end: Column, x: Column, slack: Column | int) -> Column:
    """Whether a cluster of mates lies at a locus."""
    last = F.when(x["fuzzy"], x["ext_pos"]).otherwise(x["pos"])
    return (contig == x["contig_idx"]) & (last >= start - slack) & (x["pos"] <= end + slack)


def first_close(loci: Column, probe: Column, within: int, read_length: int = READ_LENGTH) -> Column:
    """The first locus of a list that is close to the probe on its side; null if none is."""
    return F.get(F.filter(loci, lambda x: close(x, probe, within, read_length, same_side=True)), F.lit(0))


def searched(x: Column) -> Column:
    """Loci for which a partner is looked for."""
    return ~x["suspicious"] & (x["support"] + x["secondary"] + x["mates"] >= 3)


def double_support(x: Column) -> Column:
    return (x["secondary"] > 0) | ((x["support"] > 0) & (x["mates"] > 0))


def may_stand_alone(x: Column) -> Column:
    """Loci that are reported though no position is found at them."""
    return ~x["semi_suspicious"] & (double_support(x) | (~x["fuzzy"] & (x["support"] + x["secondary"] > 0)))


def stand_in(contig: Column, pos: Column, x: Column, read_length: int = READ_LENGTH) -> Column:
    """The locus that a partner position without a link back would have: around the position that names it."""
    reach = 1.5 * read_length
    lo = F.when(x["distant"], F.greatest(F.lit(1), F.round(pos - F.lit(reach)).cast("int"))).otherwise(pos)
    hi = F.when(x["distant"], (pos + F.lit(reach)).cast("int")).otherwise(pos)
    zero, yes = F.lit(0), F.lit(True)
    return F.struct(
        contig.alias("contig_idx"), lo.cast("int").alias("pos"), hi.cast("int").alias("ext_pos"), yes.alias("right_side"), x["inverted"].alias("inverted"), *(zero.alias(k) for k in ("support", "secondary", "mates", "expected")),
        *(x[k].alias(k) for k in ("suspicious", "semi_suspicious", "error_prone")), x["distant"].alias("fuzzy"), x["distant"].alias("strict_fuzzy"), x["distant"].alias("distant"),
    )


def chosen_break(breaks: Column, pos: Column) -> Column:
    """The first break of a read at a position."""
    return F.get(F.filter(breaks, lambda b: b["pos"] == pos), F.lit(0))


def aligned_shift(cigar: Column) -> Column:
    """How far from a supplementary alignment's start its break lies: the offset of its largest clip, the first of equals, if a match comes before it."""
    ops = F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+)([A-Z=])"), 0), lambda x: F.struct(F.regexp_extract(x, r"^(\d+)", 1).cast("int").alias("n"), F.right(x, F.lit(1)).alias("op")))
    # what a clip after a match lies behind: matches and inserted bases read so far, less or more the indels, and not the first clip
    step = lambda s, x: F.struct(
        (s["at"] + F.when(x["op"].isin("M", "D"), x["n"]).when((x["op"] == "S") & s["seen"], x["n"]).otherwise(0)).alias("at"),
        (s["seen"] | (x["op"] == "M")).alias("seen"),
        F.when(x["op"].isin("S", "H"), F.greatest(s["most"], x["n"])).otherwise(s["most"]).alias("most"),
        F.when(x["op"].isin("S", "H") & (x["n"] > s["most"]), F.when(s["seen"], s["at"]).otherwise(0)).otherwise(s["shift"]).alias("shift"),
    )
    zero = lambda name: F.lit(0).alias(name)
    return F.aggregate(ops, F.struct(zero("at"), F.lit(False).alias("seen"), zero("most"), zero("shift")), step)["shift"]


def _read_locus(contig_idx: Column, pos: Column, ext_pos: Column, mapq: Column, right: Column, inverted: Column, distant: Column, slack: Column) -> Column:
    return F.struct(
        contig_idx.alias("contig_idx"), pos.cast("int").alias("pos"), ext_pos.cast("int").alias("ext_pos"), right.alias("right_side"), mapq.alias("mapq"), inverted.alias("inverted"), (pos != ext_pos).alias("fuzzy"), distant.alias("distant"), slack.cast("int").alias("slack"),
    )


def alternative(element: Column, forward: Column, right: Column, contig: Column, pos: Column, isize_max: int = 2000, read_length: int = READ_LENGTH) -> Column:
    """One element of a read's tag, 'contig,pos,strand,cigar,mapq,mismatches', as a locus seen from a break at contig and pos."""
    most = F.lit(5 * read_length)

    def of(g: Column) -> Column:
        idx, at = g["idx"], g["at"]
        far = F.abs(pos - at)
        return _read_locus(idx, at, at, g["mapq"], right, g["plus"] != forward, (idx != contig) | (far > isize_max), F.when(idx == contig, F.least(far, most)).otherwise(most))

    # fields first, so that each is found once
    fields = F.transform(F.array(F.split(element, ",")), lambda f: F.struct(
        contig_index(F.get(f, F.lit(0))).alias("idx"), (F.get(f, F.lit(1)).cast("int") + aligned_shift(F.get(f, F.lit(3)))).alias("at"), (F.get(f, F.lit(2)) == "+").alias("plus"), F.get(f, F.lit(4)).cast("int").alias("mapq"),
    ))
    return F.transform(fields, of)[0]


def read_loci(tag: Column, forward: Column, right: Column, contig: Column, pos: Column, distant_mate: Column, mate_contig: Column, mate_pos: Column, inverted_mate: Column, isize_max: int = 2000, read_length: int = READ_LENGTH) -> Column:
    """Loci that a read tells of at a break: those of its tag, and the place of a distant mate unless one of them is there."""
    own = F.filter(F.transform(F.filter(F.split(F.coalesce(tag, F.lit("")), ";"), lambda x: x != ""), lambda x: alternative(x, forward, right, contig, pos, isize_max, read_length)), lambda x: x["contig_idx"] <= LAST_PARTNER)
    mate = _read_locus(mate_contig, mate_pos, mate_pos + 1, F.lit(0), right, inverted_mate, F.lit(True), F.lit(5 * read_length))
    wanted = distant_mate & (mate_contig <= LAST_PARTNER)
    return F.transform(F.array(own), lambda xs: F.when(wanted & ~F.exists(xs, lambda x: mate_close(mate_contig, mate_pos, mate_pos, x, x["slack"])), F.concat(xs, F.array(mate))).otherwise(xs))[0]


def merged(a: Column, b: Column) -> Column:
    """Two loci of one place: the larger supports, mates and expected ones of the better ratio, in doubt only if both are."""
    better = (b["expected"] > 0) & ((a["expected"] <= 0) | holds(ratio(b["mates"], b["expected"]) > ratio(a["mates"], a["expected"])))
    pick = lambda k: F.when(better, b[k]).otherwise(a[k])
    out = a
    for name, value in (("support", F.greatest(a["support"], b["support"])), ("secondary", F.greatest(a["secondary"], b["secondary"])), ("mates", pick("mates")), ("expected", pick("expected")), ("semi_suspicious", a["semi_suspicious"] & b["semi_suspicious"])):
        out = out.withField(name, value)
    return out


def rescued_pairs(loci: Column) -> Column:
    """Where just two distant loci of a side share the mates there are, each is taken to have all it may expect."""

    def side(xs: Column, right: bool) -> Column:
        fit = lambda x: x["distant"] & (x["right_side"] == right) & ~x["suspicious"] & (x["mates"] > 4)
        two = F.filter(xs, fit)
        total = F.aggregate(two, F.lit(0).cast("long"), lambda s, x: s + x["mates"])
        enough = (F.size(two) == 2) & holds(ratio(total, F.array_max(F.transform(two, lambda x: x["expected"]))) > 0.7)
        return F.transform(xs, lambda x: F.when(enough & fit(x), x.withField("expected", x["mates"])).otherwise(x))

    return F.transform(F.array(loci), lambda xs: side(side(xs, True), False))[0]


def rescued_homologues(double: Column, single: Column, within_double: int = 200_000, within_single: int = 100_000) -> tuple[Column, Column]:
    """Distant loci with mates that have a homologous one beside them expect no more mates than they have; one in doubt is
    cleared if the first such locus, of its own list before the other, isn't. The lists are gone through in order, and what is cleared counts at once."""

    def swept(own: Column, other: Column, within: int) -> Column:
        def step(xs: Column, i: Column) -> Column:
            x = F.get(xs, i)
            here = F.filter(F.transform(xs, lambda y, j: F.struct(y.alias("y"), j.alias("j"))), lambda p: (p["j"] != i) & close_homologous(x, p["y"], within))
            first = F.coalesce(F.get(here, F.lit(0))["y"], F.get(F.filter(other, lambda y: close_homologous(x, y, within)), F.lit(0)))
            hit = x["distant"] & (x["mates"] > 0) & first.isNotNull()
            clear = hit & x["semi_suspicious"] & ~first["semi_suspicious"]
            new = x.withField("expected", F.when(hit, x["mates"]).otherwise(x["expected"])).withField("semi_suspicious", x["semi_suspicious"] & ~F.coalesce(clear, F.lit(False)))
            return F.transform(xs, lambda y, j: F.when(j == i, new).otherwise(y))

        order = F.when(F.size(own) > 0, F.sequence(F.lit(0), F.size(own) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(order, own, step)

    first = swept(double, single, within_double)
    return first, swept(single, first, within_single)


def mate_support(x: Column, clusters: Column, slack: Column | int) -> Column:
    """struct(mates, evidence, used, lo, hi): what an ordered list of mate clusters (contig, start, end, power, evidence) adds to a locus.

    A vague locus grows by each cluster that lies at it; the next is held against the grown range. used: numbers of the clusters.
    """
    numbered = F.transform(clusters, lambda m, i: F.struct(m.alias("m"), i.alias("i")))
    empty = F.struct(F.lit(0).cast("long").alias("mates"), F.lit(0).alias("evidence"), F.array().cast("array<int>").alias("used"), x["pos"].cast("int").alias("lo"), x["ext_pos"].cast("int").alias("hi"))

    def step(s: Column, p: Column) -> Column:
        m = p["m"]
        last = F.when(x["fuzzy"], s["hi"]).otherwise(s["lo"])
        met = (m["contig"] == x["contig_idx"]) & (last >= m["start"] - slack) & (s["lo"] <= m["end"] + slack)
        grown = met & x["fuzzy"]
        return F.struct(
            (s["mates"] + F.when(met, m["power"]).otherwise(0)).cast("long").alias("mates"), F.when(met, F.greatest(s["evidence"], m["evidence"])).otherwise(s["evidence"]).cast("int").alias("evidence"),
            F.when(met, F.concat(s["used"], F.array(p["i"].cast("int")))).otherwise(s["used"]).alias("used"),
            F.when(grown, F.least(s["lo"], m["start"])).otherwise(s["lo"]).cast("int").alias("lo"), F.when(grown, F.greatest(s["hi"], m["end"])).otherwise(s["hi"]).cast("int").alias("hi"),
        )

    return F.aggregate(numbered, empty, step)
