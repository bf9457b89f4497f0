"""From breakpoint tables and a panel to events: partners of loci, panel and control around them, reasons, scores and rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import contigs, partners, sequence
from ..operators import builders, consensus, events, lookups, pairs, screens, verdicts
from ..operators.intervals import band_join
from ..sources.breakpoints import COUNTS
from .cuts import cut

READ_LENGTH = partners.READ_LENGTH
c = F.col


def positions(bps: DataFrame) -> DataFrame:
    """What annotation needs of read_breakpoints(line_index=True): id, contig, at (contig number), pos, counts, loci, coverages, overhangs."""
    loci = partners.rescued_pairs(F.filter(F.concat("double_loci", "single_loci"), lambda x: x["contig_idx"] <= contigs.LAST_PARTNER))
    return bps.select(c("line_index").cast("long").alias("id"), "contig", c("chr_idx").alias("at"), "pos", F.struct(*COUNTS).alias("b"), loci.alias("loci"), "left_coverage", "right_coverage", c("overhangs").alias("text"))


def control_positions(bps: DataFrame, level: int = 0, foreign: bool = False) -> DataFrame:
    """positions() of a control sample, without those that its own run put in doubt: level is how hard its inversions had to be filtered, foreign
    whether it holds foreign sequence."""
    ratio = F.when(c("overhangs").isNotNull(), sequence.longest_overhang(c("overhangs")) / F.lit(float(READ_LENGTH)))
    loci = partners.rescued_pairs(F.filter(F.concat("double_loci", "single_loci"), lambda x: x["contig_idx"] <= contigs.LAST_PARTNER))
    kept = bps.withColumns({"__loci": F.coalesce(loci, F.array().cast(bps.schema["double_loci"].dataType)), "__ratio": ratio, "contig_idx": c("chr_idx")})
    return positions(kept.where(screens.control_kept(c("__loci"), c("__ratio"), level, foreign)))


def settled(bps: DataFrame) -> DataFrame:
    """positions() in which loci of neighbouring positions that vaguely tell of one partner are reduced to one, see consensus.defuzz(); by contig, and by
    the partner's contig, side and strand. Keys without a vague locus are left as they are."""
    keys = ["at", "contig_idx", "right_side", "inverted"]
    each = bps.select("id", "at", c("pos"), F.posexplode("loci").alias("k", "x")).select("id", "k", "at", "pos", *(c(f"x.{k}").alias(k) for k in keys[1:]), c("x.pos").alias("lo"), c("x.ext_pos").alias("hi"), (c("x.support") + c("x.secondary")).alias("support"), "x.mates", "x.expected")
    each = each.select("id", "k", *keys, *(c(k).cast("long").alias(k) for k in ("pos", "lo", "hi", "support", "mates", "expected")))
    vague = each.where("lo <> hi").select(*keys).distinct()
    swept = consensus.defuzz(each.join(vague, keys, "left_semi"), keys, 6 * READ_LENGTH, 2 * partners.wide())
    left = swept.unionByName(each.join(vague, keys, "left_anti"))
    lists = left.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", *(c(k).cast("int").alias(k) for k in ("lo", "hi", "mates", "expected"))))).alias("__kept"))
    new = lambda p: F.get("loci", p["k"]).withField("pos", p["lo"]).withField("ext_pos", p["hi"]).withField("mates", p["mates"]).withField("expected", p["expected"])
    out = bps.join(lists, "id", "left")
    return out.withColumn("loci", F.coalesce(F.transform("__kept", new), F.array().cast(bps.schema["loci"].dataType))).select(bps.columns)


def _in_order(lists: str) -> Column:
    """The lists of the places nearby as one, by position."""
    return F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("p_pos", lists))), lambda x: x[lists]))


def informed(places: DataFrame, panel: DataFrame, control: DataFrame | None, close: int) -> DataFrame:
    """id, hc, ha, panel, gc, control of places (id, at, pos): hits and loci of the panel, clonality and loci of the control around them.

    panel: at, pos, hits, loci. control: positions() of the control sample.
    """
    reach = 6 * READ_LENGTH
    rows = places.select("id", c("at").alias("contig"), "pos")
    out = lookups.nearby_hits(rows, panel.select(c("at").alias("contig"), "pos", "hits"), "id", reach, close).select("id", c("close_hits").alias("hc"), c("hits").alias("ha"))
    near = band_join(rows, panel.select(c("at").alias("contig"), c("pos").alias("p_pos"), c("loci").alias("p_loci")), ["contig"], "pos", "p_pos", reach - 1)
    out = out.join(near.groupBy("id").agg(_in_order("p_loci").alias("panel")), "id", "left")
    if control is None:
        return out.withColumns({"gc": F.lit(1.0), "control": F.array()})
    b = c("b")
    soft, hard = b["paired_soft"] + b["unpaired_soft"], b["paired_hard"] + b["unpaired_hard"]
    mates = F.greatest(b["mate_support"], F.coalesce(F.array_max(F.transform("loci", lambda x: x["mates"])), F.lit(0)))
    share = lambda x: (F.greatest(x["support"], soft) + F.greatest(x["secondary"], hard) + x["mates"]).cast("double")
    known = F.transform("loci", lambda x: F.struct(x.alias("locus"), F.when(share(x) > 0, share(x) / (share(x) + b["normal_spans"])).otherwise(0.0).alias("clonality")))
    marks = control.select(c("at").alias("contig"), c("pos").alias("p_pos"), (soft + hard + b["short_indel"] + mates).alias("support"), b["normal_spans"].alias("spans"), known.alias("known"))
    best = lookups.control_clonality(rows, marks.select("contig", c("p_pos").alias("pos"), "support", "spans"), "id", close).withColumnRenamed("clonality", "gc")
    beside = band_join(rows, marks.select("contig", "p_pos", "known"), ["contig"], "pos", "p_pos", reach - 1).groupBy("id").agg(_in_order("known").alias("control"))
    return out.join(best, "id").join(beside, "id", "left")


def partnered(bps: DataFrame, within: int = 3 * READ_LENGTH, widened: int = 3, bins: int = 2048) -> DataFrame:
    """Rows for each searched locus: id, k (its place), x, other (id of a position at it, null without one), y (a locus of that position that names the
    first back, null without one), and gap and j, by which a locus's rows are ordered.

    All positions within `within` that name the first back count, each with all loci that do. Without any, it is the nearest position, the left one of
    equals, with its first locus that names the first back within `widened` times as far, if there is one. Loci on contigs that no panel has are
    left out, but for one on which partners are never looked for. A locus looks into the bins that its range touches, wide ranges into coarser ones;
    so the join is on equal contigs, sizes and bins.
    """
    known = (contigs.panel_index(c("x.contig_idx")) >= 0) | (c("x.contig_idx") == contigs.MITO)
    link = bps.select("id", c("at").alias("src"), c("pos").alias("src_pos"), F.posexplode("loci").alias("k", "x")).where(partners.searched(c("x")) & known)
    span = c("x.ext_pos") - c("x.pos") + 2 * within
    size = F.when(span <= 8 * bins, bins).otherwise(1024 * bins)  # a range of any width meets few bins
    looks = link.withColumn("__size", size).withColumn("__bin", F.explode(F.sequence(F.floor((c("x.pos") - within) / c("__size")), F.floor((c("x.ext_pos") + within) / c("__size")))))
    nodes = bps.select(c("id").alias("other"), c("at").alias("n_at"), c("pos").alias("n_pos"), c("loci").alias("n_loci"), F.explode(F.array(F.lit(bins), F.lit(1024 * bins))).alias("n_size"))
    nodes = nodes.withColumn("n_bin", F.floor(c("n_pos") / c("n_size")))
    gap = F.greatest(F.lit(0), c("x.pos") - c("n_pos"), c("n_pos") - c("x.ext_pos"))
    met = looks.join(nodes, (c("x.contig_idx") == c("n_at")) & (c("__size") == c("n_size")) & (c("__bin") == c("n_bin")) & (gap <= within) & (c("id") != c("other")))
    back = lambda far: F.filter("n_loci", lambda y: ~y["suspicious"] & partners.position_close(c("src"), c("src_pos"), y, far))
    met = met.select("id", "k", "x", "other", "n_pos", gap.alias("gap"), back(within).alias("backs"), F.get(back(widened * within), F.lit(0)).alias("wide"))
    double = met.select("id", "k", "x", "other", "gap", "n_pos", F.posexplode("backs").alias("j", "y"))
    best = met.groupBy("id", "k").agg(F.min_by(F.struct("other", "wide", "gap", "n_pos"), F.struct("gap", "n_pos", "other")).alias("m"), F.max(F.size("backs")).alias("__n"))
    rest = link.select("id", "k", "x").join(best, ["id", "k"], "left").where(F.coalesce("__n", F.lit(0)) == 0)
    rest = rest.select("id", "k", "x", c("m.other").alias("other"), c("m.gap").alias("gap"), c("m.n_pos").alias("n_pos"), F.lit(0).alias("j"), c("m.wide").alias("y"))
    return double.unionByName(rest)


def _side(i: int, info: DataFrame, bps: DataFrame) -> DataFrame:
    names = {"contig": f"contig{i}", "at": f"ctg{i}", "pos": f"pos{i}", "b": f"b{i}", "text": f"text{i}", "left_coverage": f"left{i}", "right_coverage": f"right{i}", "hc": f"hc{i}", "ha": f"ha{i}", "panel": f"panel{i}", "gc": f"gc{i}", "control": f"control{i}"}
    return bps.drop("loci").join(info, "id").select(c("id").alias(f"id{i}"), *(c(k).alias(v) for k, v in names.items()))


#: What the cascades over all events look at.
JUDGED = ["e1", "e2", "sup1", "sup2", "sec1", "sec2", "mate1", "mate2", "prone1", "prone2", "sui1", "sui2", "semi", "ev1", "ev2", "cand1", "cand2", "m1", "m2", "comp1", "over1", "over2"]


@dataclass
class Annotation:
    """A sample's events with their lines, what stands before them, and positions that only overhangs tell of (line_index, line)."""

    events: DataFrame
    overhangs: DataFrame | None
    level: int = 0
    foreign: bool = False
    preamble: list[str] = field(default_factory=list)

    def lines(self) -> DataFrame:
        """value: all lines in the order of a file: overhangs, then the lines that say how the sample was filtered, then events."""
        spark = self.events.sparkSession
        said = spark.createDataFrame([(1, 0, i, 0, x) for i, x in enumerate(self.preamble)], "part int, a long, b long, d long, value string")
        events_ = self.events.select(F.lit(2).alias("part"), c("seq.at").cast("long").alias("a"), c("seq.id").cast("long").alias("b"), c("seq.k").cast("long").alias("d"), c("line").alias("value"))
        out = said.unionByName(events_)
        if self.overhangs is not None:
            out = out.unionByName(self.overhangs.select(F.lit(0).alias("part"), c("line_index").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("d"), c("line").alias("value")))
        return out.orderBy("part", "a", "b", "d", "value").select("value")

    def write(self, path: str) -> None:
        self.lines().write.text(path)


def annotated(bps: DataFrame, panel: DataFrame, control: DataFrame | None, n_samples: int, offset: int = 5) -> DataFrame:
    """Events of positions(): what the builders make, category (2, 1 or 0) and line, one row a canonical key; events with a reason or without score go."""
    return _first_of_keys(_every(bps, panel, control, n_samples, offset))


def annotate(bps: DataFrame, panel: DataFrame, control: DataFrame | None, n_samples: int, offset: int = 5, control_level: int = 0, control_foreign: bool = False, checked: bool = False) -> Annotation:
    """annotated(), then the two cascades over all events of the sample, and its overhangs.

    control: control_positions(), as its own run with checked=True found it: control_level and control_foreign are that run's. Overhangs are reported
    of positions that no event has visited, unless the sample was filtered or holds foreign sequence.
    """
    every = _every(bps, panel, control, n_samples, offset)
    found = _first_of_keys(every).withColumn("grade", verdicts.contamination(c("type"), c("score"), c("reason"), c("grade1"), c("grade2")))
    kept, level = verdicts.drop_inversions(found, least=200 if checked else 300)
    marked, foreign = verdicts.mark_contamination(kept)
    text = F.split("line", "\t")
    told = F.transform(text, lambda x, i: F.when(i == 8, c("type")).when(i == 9, c("score").cast("string")).otherwise(x))
    marked = marked.withColumn("line", F.array_join(told, "\t"))
    report = None
    if not checked and not foreign and level == 0:
        left = bps.where(c("text").isNotNull()).select("id", "contig", "at", "pos", "text", "b.*").where(screens.overhang_only())
        info = informed(left, panel, control, offset)
        places = left.join(info, "id").select(c("id").alias("line_index"), "contig", "pos", c("ha").alias("hits"), c("gc").alias("clonality"))
        visited = every.select(F.explode(F.array("id1", "id2")).alias("line_index")).where("line_index is not null").distinct()
        report = lookups.overhang_report(places, left.select(c("id").alias("line_index"), c("text").alias("overhang")), visited, builders.LIMIT, n_samples)
    return Annotation(marked, report, level, foreign, builders.preamble(control_level, level, control_foreign, foreign))


def _first_of_keys(every: DataFrame) -> DataFrame:
    """The first event of each canonical key, in the order in which loci are looked at: contig, position, place of the locus, then the nearer partner."""
    passed = every.where((c("reason") == 0) & (c("score") > 0)).withColumn("key", pairs.canonical_key(c("ctg1"), c("pos1"), c("ctg2"), c("pos2"), c("score")))
    w = Window.partitionBy("key").orderBy("seq", F.desc("category"))
    return passed.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "key")


def _every(bps: DataFrame, panel: DataFrame, control: DataFrame | None, n_samples: int, offset: int) -> DataFrame:
    """All events, also those that don't pass."""
    bps = cut(settled(bps.withColumn("loci", F.coalesce("loci", F.array().cast(bps.schema["loci"].dataType)))))
    control = control if control is None else cut(settled(control))
    listed = lambda k, kind: F.coalesce(c(k).cast(kind), F.array().cast(kind))
    of_panel = panel.schema["loci"].dataType.simpleString()
    of_control = "array<struct<locus:" + bps.schema["loci"].dataType.elementType.simpleString() + ",clonality:double>>"
    full = lambda df: df.withColumns({"panel": listed("panel", of_panel), "control": listed("control", of_control)})
    found = cut(partnered(bps))
    info = full(informed(bps, panel, control, offset))
    one, two = _side(1, info, bps), _side(2, info, bps)
    # tables between are written, so that the long rules are planned by themselves
    links = cut(found.join(one, found["id"] == one["id1"]).withColumnsRenamed({"x": "x1"}))
    seq = lambda first: F.struct(contigs.panel_index(c("ctg1" if first else "ctg2")).alias("at"), "id", "k", "gap", "n_pos", "j", F.lit(first).alias("as_found"))
    keep = ["category", "seq", "ctg1", "pos1", "ctg2", "pos2", "type", "size", "inv", "distant", "reason", "score", "line", "id1", "id2", "grade1", "grade2", *JUDGED]

    def shown(df: DataFrame, category: int) -> DataFrame:
        grade = lambda i: F.when(c(f"text{i}").isNotNull(), events.contamination_grade(c(f"over{i}"), c(f"sec{i}"), F.lit(category < 2))).otherwise(0)
        over = {f"over{i}": F.when(c(f"text{i}").isNotNull(), c(f"over{i}")).otherwise(0.0) if i == 1 or category == 2 else F.lit(0.0) for i in (1, 2)}
        made = df.withColumns({"category": F.lit(category), "line": builders.rows(df, category, n_samples), "grade1": grade(1), "grade2": grade(2) if category == 2 else F.lit(0)}).withColumns(over)
        return made.select(*keep)

    paired = cut(links.where(c("other").isNotNull()).join(two, c("other") == c("id2")).withColumn("seq", seq(True)))
    named = paired.where(c("y").isNotNull()).withColumnRenamed("y", "x2")
    # where the other position comes first, the event as seen from there is looked at before this one
    turn = {f"{k}{i}": f"{k}{3 - i}" for k in ("id", "contig", "ctg", "pos", "b", "text", "left", "right", "hc", "ha", "panel", "gc", "control", "x") for i in (1, 2)}
    turned = named.where(F.struct("ctg2", "pos2") < F.struct("ctg1", "pos1")).withColumn("seq", c("seq").withField("as_found", F.lit(False)))
    turned = turned.withColumnsRenamed({k: f"__{v}" for k, v in turn.items()}).withColumnsRenamed({f"__{v}": v for v in turn.values()})
    both = builders.two_sided(cut(named.unionByName(turned)))
    single = builders.one_sided(paired.where(c("y").isNull()).drop("y"))

    lone = links.where(c("other").isNull() & partners.may_stand_alone(c("x1"))).withColumn("seq", seq(True))
    ends = F.explode(F.when(c("x1.fuzzy") & (c("x1.ext_pos") - c("x1.pos") > 3 * offset), F.array("x1.pos", "x1.ext_pos")).otherwise(F.array("x1.pos")))
    places = lone.select(F.struct("id", "k").alias("of"), c("x1.contig_idx").alias("at"), ends.alias("pos")).withColumn("id", F.struct("of", "pos"))
    there = informed(places, panel, control, 3 * offset)
    # a vague locus is taken where the panel has more close hits; the low end of equals
    there = there.groupBy(c("id.of").alias("place")).agg(F.max_by(F.struct("hc", "ha", "panel", "gc", "control"), F.struct("hc", -c("id.pos"))).alias("m")).select("place", "m.*")
    there = full(there).select("place", *(c(k).alias(f"{k}2") for k in ("hc", "ha", "panel", "gc", "control")))
    lone = lone.join(there, F.struct("id", "k") == c("place")).withColumns({"contig2": contigs.contig_name(c("x1.contig_idx")), "text2": F.lit(None).cast("string"), "b2": c("b1"), "id2": F.lit(None).cast("long")})
    alone = builders.unknown(cut(lone.drop("y", "place")))
    return cut(shown(both, 2)).unionByName(cut(shown(single, 1))).unionByName(cut(shown(alone, 0)))
