"""From reads to breakpoint counters, and from breakpoint tables to a panel."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contigs, partners, reads as rd
from ..functions.contigs import LAST_PARTNER
from ..functions.numeric import ratio
from ..operators import consensus, evidence, screens
from ..operators import support as support_ops
from ..operators.intervals import changes, running_sums
from ..sources.breakpoints import COUNTS
from .cuts import cut, deleted, tabled

#: Where mates are not counted: contig, first base, end (fixed values).
EXCLUDED = [(2, 33_140_000, 33_150_000)]
#: Counts that pairing changes.
CHANGED = ("paired_soft", "paired_hard", "unpaired_soft", "unpaired_hard", "mate_support", "low_breaks_hard", "low_breaks_soft", "repetitive")


def depth_profile(reads: DataFrame, at: DataFrame | None = None) -> DataFrame:
    """chr_idx, pos: coverage, normal_spans and low-quality spans where they change.

    Reads add along their interval; a break that begins at a read's start, and the gap of a deletion, take spans away again. at: positions (chr_idx, pos)
    that have a row besides. Reads are gone through once; the changes of depth are written before they are added up.
    """
    c = F.col
    kind, poor = c("read_type"), c("low_mapq") | c("null_mapq")
    good = kind.isin(0, 1, 3, 4)
    whole = reads.select("chr_idx", "start", "end", F.when(good, 1).otherwise(0).alias("coverage"), F.when(good, 1).otherwise(0).alias("normal_spans"), F.when(kind == 5, 1).otherwise(0).alias("low_spans_soft"), F.when((kind == 2) & poor, 1).otherwise(0).alias("low_spans_hard"))
    b = reads.select("chr_idx", "start", kind.alias("kind"), poor.alias("poor"), F.explode("breaks").alias("b"))
    clipped = (c("b.type") == "S") | ((c("b.type") == "H") & c("kind").isin(2, 5))
    lost = F.when(clipped & (c("b.pos") == c("start")), 1).when(c("b.type") == "D", c("b.size"))
    less = b.where(lost > 0).select("chr_idx", c("b.pos").alias("start"), (c("b.pos") + lost).alias("end"), F.lit(0).alias("coverage"), *(F.when(w, -1).otherwise(0).alias(n) for n, w in (("normal_spans", c("kind").isin(1, 3)), ("low_spans_soft", c("kind") == 5), ("low_spans_hard", (c("kind") == 2) & c("poor")))))
    names = ["coverage", "normal_spans", "low_spans_soft", "low_spans_hard"]
    return running_sums(cut(changes(whole.unionByName(less), ["chr_idx"], "start", "end", {n: c(n) for n in names}, at)), ["chr_idx"], "pos", names)


def break_counts(reads: DataFrame) -> DataFrame:
    """chr_idx, pos: breaks by class of read, and the last start of a read that the position is assigned to."""
    c = F.col
    kind, poor = c("read_type"), c("low_mapq") | c("null_mapq")
    b = reads.select("chr_idx", "start", kind.alias("k"), poor.alias("poor"), F.explode("breaks").alias("b"))
    is_ = lambda *t: c("b.type").isin(*t)
    n = lambda x, name: F.count_if(x).alias(name)
    return b.groupBy("chr_idx", c("b.pos").alias("pos")).agg(
        n((c("k") == 1) & is_("S"), "unpaired_soft"), n((c("k") == 2) & ~c("poor") & is_("H"), "unpaired_hard"), n(c("k").isin(1, 3) & is_("I", "D"), "short_indel"),
        n((c("k") == 5) & is_("S", "H", "I", "D"), "low_breaks_soft"), n((c("k") == 2) & c("poor") & is_("S", "H", "I", "D"), "low_breaks_hard"),
        n(((c("k") == 1) & is_("S")) | ((c("k") == 2) & is_("H")), "assigned"), F.max(F.when(((c("k") == 1) & is_("S")) | ((c("k") == 2) & is_("H")), c("start"))).alias("last_start"),
    )


def breakpoint_counters(reads: DataFrame) -> DataFrame:
    """Positions where clipped reads break, with their counts and the depth left of and at them; before loci are paired."""
    c = F.col
    breaks = cut(break_counts(reads).where("assigned > 0"))
    wanted = breaks.select("chr_idx", c("pos").alias("of"), F.explode(F.array(c("pos") - 1, c("pos"))).alias("pos"))
    met = depth_profile(reads, wanted.select("chr_idx", "pos")).join(wanted, ["chr_idx", "pos"])
    there = lambda k: F.max(F.when(c("pos") == c("of"), c(k)))
    at = met.groupBy("chr_idx", c("of").alias("pos")).agg(
        F.max(F.when(c("pos") < c("of"), c("coverage"))).alias("left_coverage"), there("coverage").alias("right_coverage"), *(there(n).alias(n) for n in ("normal_spans", "low_spans_soft", "low_spans_hard")),
    )
    out = breaks.join(at, ["chr_idx", "pos"])
    zero = [n for n in COUNTS if n not in out.columns]
    return out.withColumns({n: F.lit(0).cast("long") for n in zero}).select("chr_idx", "pos", *COUNTS, "left_coverage", "right_coverage", "last_start")


def mates_of(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """Mates that may tell of a distant partner: of reads of the class for them, and, as poor ones, of those without mapping quality and of
    low-quality reads; on contigs that may be partners and outside `regions` (contig, lo, hi)."""
    c = F.col
    low = (c("read_type") == rd.LOW) & ~c("supplementary") & c("distant_mate")
    some = reads.where(((c("read_type") == rd.DISTANT) | low) & (c("mate_chr_idx") <= LAST_PARTNER))
    spots = F.when(low, F.transform("breaks", lambda b: b["pos"])).otherwise(F.array().cast("array<int>"))
    rows = some.select("chr_idx", "start", "end", (low | c("null_mapq")).alias("poor"), spots.alias("spots"), "mate_chr_idx", "mate_pos", "inverted_mate")
    return evidence.excluded(regions, rows)


def called_breakpoints(reads: DataFrame, support: int = 5, read_length: int = 101, isize_max: int = 2000, proper_ratio: float | None = None, regions: DataFrame | None = None, decoded: Callable[[], object] | None = None) -> DataFrame:
    """Breakpoints of position-sorted reads, as read_breakpoints() has them: counts, coverages, loci that reads tell of from both sides and from one, overhangs.

    reads: read_alignments(), which are decoded once and written as columns, since they are gone through several times, and deleted after the last; counts, depths and pools
    are made once and written, too. decoded: called when `reads` is not read any more, so that text which was only made for it can go. proper_ratio: share of proper pairs; if
    it is given, mates that come by error are taken off. regions: where mates are not counted, EXCLUDED if not given. Positions swamped by low quality, or with too
    little around them, are given out without loci or not at all; only the others get pools and lists.
    """
    spark, c = reads.sparkSession, F.col
    place = evidence.PLACE
    if regions is None:
        regions = spark.createDataFrame(EXCLUDED, "contig int, lo int, hi int")
    # of a read's bases only clipped ones are looked at, and only reads that break somewhere are told apart by name
    broken = F.size("breaks") > 0
    reads = tabled(reads.drop("qual", "has_sa").withColumns({"seq": F.when(F.size("overhangs") > 0, c("seq"))} | {k: F.when(broken, c(k)) for k in ("name", "sa_tag")}))
    if decoded:
        decoded()
    counted = breakpoint_counters(reads)
    attached = cut(evidence.attached_reads(reads, ["start", "name", "flag"], isize_max, read_length))
    soft_reads = attached.where("kind = 'soft'").groupBy(*place).agg(F.count(F.lit(1)).alias("soft_reads"))
    counted = cut(counted.join(soft_reads, place, "left").withColumn("soft_reads", F.coalesce("soft_reads", F.lit(0))).withColumn("swamped", screens.swamped()))

    left, right = round(3 * read_length), round(2.51 * read_length)
    near = cut(evidence.around(counted.where("not swamped").select(*place, "last_start"), reads, left, right))
    pool = cut(evidence.pooled(near, mates_of(reads, regions), round(1.11 * read_length), round(0.51 * read_length)))
    sized = counted.join(evidence.pool_sizes(pool), place, "left").withColumn("largest_pool", F.coalesce("largest_pool", F.lit(0)))
    event = c("unpaired_soft") + c("unpaired_hard") + c("short_indel")
    sized = cut(sized.withColumn("listed", ~c("swamped") & ((event >= support) | (c("largest_pool") >= support))))
    full = sized.where("listed")
    lists = _lists(full, attached, pool, support, read_length)
    if proper_ratio is not None:
        lists = lists.join(_candidates(near, reads), place, "left")
    lists = _paired(lists, full, support, read_length, proper_ratio)
    deleted(spark, reads.written_at)

    out = sized.join(lists, place, "left")
    missing = [n for n in COUNTS if n in CHANGED]
    out = out.withColumns({f"final_{n}": F.coalesce(f"final_{n}", n) if n in CHANGED else c(n) for n in COUNTS}).withColumn("mate_support", c("final_mate_support"))
    empty = lambda k: F.coalesce(k, F.array().cast(lists.schema[k].dataType))
    out = out.withColumns({"double_loci": empty("double_loci"), "single_loci": empty("single_loci"), "shown": F.coalesce("shown", F.array().cast("array<string>"))})
    # overhangs carry the running number of their position among those that get this far
    poor = c("low_breaks_soft") + c("low_spans_soft") + c("low_spans_hard")
    seen = out.where(c("swamped") | c("listed") | (poor >= c("normal_spans")))
    seen = support_ops.running_index(seen, ["chr_idx"], "pos")
    text = F.array_join(F.transform("shown", lambda x, i: F.concat(F.lit(">"), c("running_index"), F.lit("_"), i + 1, F.lit(":"), x)), ";")
    seen = seen.withColumns({"overhangs": F.when(F.size("shown") > 0, text), "loci": F.size("double_loci") + F.size("single_loci")}).withColumn("overhang_chars", F.coalesce(F.length("overhangs"), F.lit(0)))
    made = emitted(seen, support)
    bare = c("missing_info")
    final = {n: F.when(bare, c(n)).otherwise(c(f"final_{n}")).cast("int") for n in missing}
    return made.withColumns({k: F.when(~bare, c(k)).otherwise(F.array().cast(made.schema[k].dataType)) for k in ("double_loci", "single_loci")} | final).withColumn("contig", contigs.contig_name(c("chr_idx"))).select(
        "contig", "chr_idx", "pos", *(c(n).cast("int").alias(n) for n in COUNTS), c("left_coverage").cast("int").alias("left_coverage"), c("right_coverage").cast("int").alias("right_coverage"), "missing_info", "double_loci", "single_loci", F.when(~bare, c("overhangs")).alias("overhangs"),
    )


def _candidates(near: DataFrame, reads: DataFrame) -> DataFrame:
    """chr_idx, pos, left_candidates, right_candidates: reads around a position that might be discordant."""
    c = F.col
    some = reads.where(c("read_type").isin(rd.NORMAL, rd.INDEL) | ((c("read_type") == rd.DISTANT) & (c("mate_chr_idx") <= LAST_PARTNER))).select("chr_idx", "start", "end")
    met = evidence.range_join(near.select(*evidence.PLACE, "lo", "hi"), some, "chr_idx", "lo", "hi", "start")
    left = c("start") < c("pos")
    return met.groupBy(*evidence.PLACE).agg(F.count_if(left).alias("left_candidates"), F.count_if(~left | (c("end") > c("pos"))).alias("right_candidates"))


def _lists(full: DataFrame, attached: DataFrame, pool: DataFrame, support: int, read_length: int) -> DataFrame:
    """A row for each listed position: its reads as arrays by kind, overhang groups, and pools of mates with those of its own reads."""
    c = F.col
    place = evidence.PLACE
    own = attached.join(full.select(*place), place, "left_semi")
    of = lambda kind, *cols: F.transform(F.array_sort(F.collect_list(F.when(c("kind") == kind, F.struct("number", F.struct(*cols).alias("r"))))), lambda x: x["r"])
    far = (F.size("loci") > 0) & F.forall("loci", lambda x: x["distant"])
    reads = own.withColumn("solid", far).groupBy(*place).agg(of("soft", "overhang", "right", "solid", "loci").alias("soft"), of("hard", "loci").alias("hard"), of("poor", "loci").alias("poor"))
    part = lambda k: F.transform("soft", lambda r: r[k])
    reads = reads.withColumn("grouped", consensus.overhang_groups(part("overhang"), part("right"), part("solid")))
    mates = pool.join(full.select(*place), place, "left_semi").withColumn("source", F.lit(2)).unionByName(evidence.own_mates(own))
    pools = evidence.mate_clusters(mates, support, read_length)
    out = full.select(*place).join(reads, place, "left").join(pools, place, "left")
    empty = {k: F.coalesce(k, F.array().cast(out.schema[k].dataType)) for k in ("soft", "hard", "poor", "left_clusters", "right_clusters", "left_poor", "right_poor")}
    return cut(out.withColumns(empty))


def _paired(lists: DataFrame, full: DataFrame, support: int, read_length: int, proper_ratio: float | None) -> DataFrame:
    """Loci and final counts of the listed positions, in the order in which evidence is weighed."""
    c = F.col
    total = lambda k: F.aggregate(k, F.lit(0), lambda s, m: s + m["power"])
    pulled = {"left": total("left_clusters"), "right": total("right_clusters")}
    if proper_ratio is not None:
        fair = {k: support_ops.expected_mates(v, F.coalesce(f"{k}_candidates", F.lit(0)), proper_ratio) for k, v in pulled.items()}
        lists = lists.withColumns({f"{k}_fair": v for k, v in fair.items()}).withColumns({f"{k}_errors": c(f"{k}_fair")["errors"] for k in pulled})
        pulled = {k: c(f"{k}_fair")["expected"] for k in pulled}
    x = lists.withColumns({f"{k}_total": v for k, v in pulled.items()})

    children = F.coalesce("grouped.children", F.array().cast("array<array<int>>"))
    first = lambda n: F.get(c("soft"), F.get(n, F.lit(0)))
    given = F.filter(children, lambda n: F.size(n) >= support)
    text = lambda n: F.concat(F.when(first(n)["right"], F.concat(F.lit("|"), first(n)["overhang"])).otherwise(F.concat(first(n)["overhang"], F.lit("|"))), F.lit("("), F.size(n), F.lit(")"))
    x = x.withColumns({"shown": F.transform(given, text), "parents": F.transform(children, lambda n: F.struct(n.alias("children")))})
    loci = lambda k: evidence.not_itself(F.flatten(F.transform(k, lambda r: r["loci"])))
    short = F.coalesce("grouped.short", F.array().cast("array<int>"))
    x = cut(x.withColumns({"primary": evidence.primary_loci(c("soft"), c("parents"), short, F.size("shown") > 0, read_length), "hard_loci": loci("hard"), "poor_loci": loci("poor")}))

    x = x.withColumn("met", evidence.doubled(c("primary"), c("hard_loci"), c("poor_loci"), read_length))
    hit = F.filter("met", lambda m: F.size(m["hard"]) + F.size(m["poor"]) > 0)
    lone = F.filter("met", lambda m: F.size(m["hard"]) + F.size(m["poor"]) == 0)
    used = lambda k: F.array_distinct(F.flatten(F.transform("met", lambda m: m[k])))
    rest = lambda ys, k: F.transform(F.array_except(F.transform(ys, lambda y, i: i), used(k)), lambda i: F.get(ys, i))
    plain = lambda ms: F.transform(ms, lambda m: m["x"])
    x = x.withColumns({"double": plain(hit), "lone": plain(lone), "left_over": F.concat(rest("hard_loci", "hard"), rest("poor_loci", "poor")), "listed_poor": F.size(F.array_distinct(F.flatten(F.transform(used("poor"), lambda i: F.get("poor_loci", i)["ids2"]))))})
    best = F.coalesce(F.array_max(F.transform(F.concat("double", "lone"), lambda y: y["mapq"])), F.lit(0))
    ids = lambda k: F.size(F.array_distinct(F.flatten(F.transform("double", lambda y: y[k]))))
    x = x.withColumn("best", best).withColumns({"lone": F.filter("lone", lambda y: ~((y["mapq"] > 0) & (y["mapq"] < 13) & (y["mapq"] < c("best")))), "moved_soft": ids("ids"), "moved_hard": ids("ids2"), "second": evidence.merged_secondary(c("left_over"), read_length)})

    x = cut(x.select(*evidence.PLACE, "shown", "grouped", "moved_soft", "moved_hard", "listed_poor", "left_clusters", "right_clusters", "left_poor", "right_poor", "left_total", "right_total", *(k for k in ("left_errors", "right_errors") if k in x.columns), evidence.with_mates(c("double"), support).alias("double"), evidence.with_mates(c("lone"), support).alias("lone"), evidence.with_mates(F.filter("second", lambda y: y["distant"]), support).alias("second")))
    seen = F.concat("double", "lone", "second")
    thin = lambda y: y["weak"] | (~y["distant"] & (y["support"] < support)) | ((y["mapq"] == 0) & (y["mates"] == 0) & (y["distinct"] < 2 * support))
    doubtful = F.filter("second", lambda y: (y["mates"] == 0) & (y["low"] | y["nul"] | (y["mapq"] < 13)))
    vague = lambda y: y["fuzzy"] & (y["mates"] == 0)
    x = x.withColumns({
        "mates": evidence.mate_total(seen), "alone": evidence.mates_alone(seen, read_length), "doubtful": F.size(F.array_distinct(F.flatten(F.transform(doubtful, lambda y: y["ids2"])))),
        "double": F.filter(F.concat("double", F.filter("second", lambda y: y["mates"] > 0)), lambda y: ~y["weak"] & ~vague(y)), "lone": F.filter("lone", lambda y: ~thin(y) & ~vague(y)),
    })
    single = F.concat("lone", "alone")
    x = x.withColumn("single", single).withColumns({"double": evidence.overlaid(c("double"), c("single"), read_length), "single": F.filter("single", lambda y: ~F.exists("double", lambda d: evidence.same_place(d, y, read_length)))})
    shown = lambda ys: F.transform(evidence.supported(ys, support, proper_ratio is not None), stored)
    x = x.select(*evidence.PLACE, "shown", "mates", "doubtful", "moved_soft", "moved_hard", "listed_poor", F.coalesce("grouped.repetitive", F.lit(0)).alias("rep"), shown(c("double")).alias("double_loci"), shown(c("single")).alias("single_loci"))
    x = x.join(full.select(*evidence.PLACE, *COUNTS), evidence.PLACE)
    poor_hard = c("low_breaks_hard") - c("listed_poor")
    turned = F.greatest(F.lit(0), F.least(poor_hard, c("doubtful")))
    new = support_ops.transferred(c("moved_soft"), c("moved_hard"))
    final = {
        "paired_soft": new["paired_soft"], "paired_hard": new["paired_hard"], "unpaired_soft": new["unpaired_soft"] - c("rep"), "unpaired_hard": new["unpaired_hard"] + c("listed_poor"),
        "mate_support": c("mates"), "low_breaks_hard": poor_hard - turned, "low_breaks_soft": c("low_breaks_soft") + turned, "repetitive": c("repetitive") + c("rep"),
    }
    return cut(x.select(*evidence.PLACE, "shown", "double_loci", "single_loci", *(v.alias(f"final_{k}") for k, v in final.items())))


def stored(x: Column) -> Column:
    """A locus of reads as a table has it; one that only reads without mapping quality tell of counts as in doubt."""
    made = partners.locus(x["contig_idx"], x["pos"], x["ext_pos"], x["right_side"], x["inverted"], x["support"], x["secondary"], x["mates"], x["expected"], x["suspicious"], x["semi_suspicious"] | x["nul"], x["error_prone"])
    return made.withField("contig", contigs.contig_name(x["contig_idx"])).withField("fuzzy", x["fuzzy"])


def emitted(bps: DataFrame, support: int = 5) -> DataFrame:
    """Positions that are given out, with missing_info where it is without detail. Columns as screens.emission() has them."""
    made = bps.withColumn("__as", screens.emission(support))
    return made.where(F.col("__as") != "none").withColumn("missing_info", F.col("__as") == "bare").select(*bps.columns, "missing_info")


def build_panel(bps: DataFrame, n_samples: int, read_length: int = partners.READ_LENGTH) -> DataFrame:
    """Population frequency of breakpoints: contig, panel_idx, pos, file_ids, ratios, loci. bps: read_breakpoints() with file_id.

    One aggregation by contig and position over all files; no table with a slot for each base.
    """
    c = F.col
    total, covered = screens.breaks(), screens.covered(c("overhangs").isNotNull())
    art = c("low_breaks_soft") + c("low_spans_soft") + c("repetitive")
    known = F.concat("double_loci", "single_loci")

    rows = bps.select("contig", "panel_idx", "pos", "file_id", covered.alias("covered"), F.when(covered, ratio(art, art + total)).alias("ratio"), F.when(total < 200, F.filter(known, screens.admitted)).otherwise(F.array().cast(bps.schema["single_loci"].dataType)).alias("loci"))
    rows = rows.where(c("covered") | (F.size("loci") > 0))
    # a locus of a panel has the samples it is from in place of its reads
    own = F.transform("loci", lambda x: x.withField("ids", F.array("file_id")).withField("support", F.lit(0)).withField("secondary", F.lit(0)))
    of_file = F.array_sort(F.collect_list(F.struct("file_id", own.alias("loci"))), lambda a, b: F.when(a["file_id"] < b["file_id"], -1).when(a["file_id"] > b["file_id"], 1).otherwise(0))
    made = rows.groupBy("contig", "panel_idx", "pos").agg(F.collect_set("file_id").alias("files"), F.collect_list("ratio").alias("ratios"), of_file.alias("of_file"))
    made = made.withColumn("merged", support_ops.merged_list(F.flatten(F.transform("of_file", lambda x: x["loci"])), ids=True))
    made = _swept(cut(made.drop("of_file")), read_length)
    counted = F.transform("merged", lambda x: x.withField("support", F.size(x["ids"])).dropFields("ids"))
    # a position that only loci spoke for goes with the last of them
    return made.where((F.size("ratios") > 0) | (F.size("merged") > 0)).select("contig", "panel_idx", "pos", F.array_sort(F.array_union("files", F.flatten(F.transform("merged", lambda x: x["ids"])))).alias("file_ids"), "ratios", counted.alias("loci"))


def _swept(made: DataFrame, read_length: int) -> DataFrame:
    """Panel positions whose loci are reduced to one where neighbours tell of one partner: that of most samples stays, with the samples of all."""
    c = F.col
    keys = ["panel_idx", "contig_idx", "right_side", "inverted"]
    long = lambda x: x.cast("long")
    each = made.select("panel_idx", long(c("pos")).alias("pos"), F.posexplode("merged").alias("k", "x"))
    each = each.select("pos", "k", "panel_idx", *(c(f"x.{k}").alias(k) for k in keys[1:]), long(c("x.pos")).alias("lo"), long(c("x.ext_pos")).alias("hi"), long(c("x.support")).alias("support"), long(c("x.mates")).alias("mates"), long(c("x.expected")).alias("expected"), c("x.ids").alias("ids"))
    kept = consensus.defuzz(each, keys, 3 * read_length, 2 * partners.wide(read_length), samples="ids")
    lists = kept.groupBy("panel_idx", "pos").agg(F.array_sort(F.collect_list(F.struct("k", *(c(k).cast("int").alias(k) for k in ("lo", "hi", "mates", "expected")), "ids"))).alias("__kept"))
    x = lambda p: F.get("merged", p["k"])
    kind = made.schema["merged"].dataType.elementType

    def new(p: Column) -> Column:
        out = x(p)
        for name, value in {"pos": "lo", "ext_pos": "hi", "mates": "mates", "expected": "expected", "ids": "ids"}.items():
            out = out.withField(name, p[value].cast(kind[name].dataType))
        return out

    none = F.filter("merged", lambda y: F.lit(False))
    return made.join(lists, ["panel_idx", "pos"], "left").withColumn("merged", F.when(c("__kept").isNull(), none).otherwise(F.transform("__kept", new))).drop("__kept")
