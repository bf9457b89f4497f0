"""Evidence of a position: reads attached to it, pools of mates around it, and the loci that both tell of.

Rows of a position are arrays of bounded length: of its clipped reads the first 2001 of each kind are kept. What depends on order is a
fold over such an array, so that all of it runs as expressions; only the comparison of overhangs is a function of its own (consensus.py).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import partners, reads as rd
from ..functions.contigs import LAST_PARTNER
from ..functions.numeric import holds, ratio
from .intervals import first_n, gap_sessions

#: Clipped reads kept of a position, and hard-clipped ones of low mapping quality, of which more clear the list (fixed values).
FIRST, POOR = 2001, 50
#: Loci as a position's reads tell of them: ids and ids2 are the numbers of its soft- and hard-clipped reads.
SEEN = "struct<contig_idx:int,pos:int,ext_pos:int,right_side:boolean,mapq:int,inverted:boolean,fuzzy:boolean,distant:boolean,slack:int,low:boolean,nul:boolean,distinct:int,ids:array<int>,ids2:array<int>>"
PLACE = ["chr_idx", "pos"]


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is evaluated once."""
    return F.transform(F.array(value), f)[0]


def none_of(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def attached_reads(reads: DataFrame, order: list[str], isize_max: int = 2000, read_length: int = partners.READ_LENGTH, kinds: tuple[str, ...] = ("soft", "hard", "poor")) -> DataFrame:
    """chr_idx, pos, kind, number, right, overhang, loci and the read's mate: the reads that break at each position, by kind.

    'soft': the first FIRST of the class with soft clips; 'hard': the first FIRST supplementary ones; 'poor': those of low or no mapping
    quality, none where there are more than POOR. Numbers follow `order`, which must tell all rows apart; those of poor reads go on after the hard ones'. A
    task passes on no more than FIRST reads of a position and kind, with the clipped bases only, and reads are gone through once. kinds: which are wanted; 'poor' needs 'hard'.
    """
    c = F.col
    at = reads.withColumn("b", F.explode("breaks"))
    soft = (c("read_type") == rd.SOFT) & (c("b.type") == "S") & ~c("supplementary")
    hard = (c("read_type") == rd.HARD) & (c("b.type") == "H") & c("supplementary")
    poor = c("low_mapq") | c("null_mapq")
    kind = F.when(soft, "soft").when(hard & ~poor, "hard").when(hard, "poor")
    right = partners.chosen_break(c("breaks"), c("b.pos"))["right"]
    own = F.get(F.filter("overhangs", lambda o: o["pos"] == c("b.pos")), F.lit(0))
    kept = [k for k in ("start", "end", "low_mapq", "null_mapq", "distant_mate", "mate_chr_idx", "mate_pos", "inverted_mate", "fwd", "sa_tag") if k not in order]
    named = at.select("chr_idx", c("b.pos").alias("pos"), kind.alias("kind"), *order, *kept, right.alias("right"), F.substring("seq", own["off"] + 1, own["n"]).alias("overhang")).where(c("kind").isin(*kinds))
    all_ = first_n(named, [*PLACE, "kind"], order, FIRST).drop(*(k for k in order if k != "start"))
    if "poor" in kinds:
        of = lambda k: F.count_if(c("kind") == k).over(Window.partitionBy(*PLACE))
        all_ = all_.withColumns({"__hard": of("hard"), "__poor": of("poor")}).where((c("kind") != "poor") | (c("__poor") <= POOR))
        all_ = all_.withColumn("rank", c("rank") + F.when(c("kind") == "poor", c("__hard")).otherwise(0))
    number = (c("rank") - 1).cast("int")
    found = partners.read_loci(c("sa_tag"), c("fwd"), c("right"), c("chr_idx"), c("pos"), c("distant_mate"), c("mate_chr_idx"), c("mate_pos"), c("inverted_mate"), isize_max, read_length)
    loci = F.transform(found, lambda x: F.struct(
        *(x[k].alias(k) for k in ("contig_idx", "pos", "ext_pos", "right_side", "mapq", "inverted", "fuzzy", "distant", "slack")), c("low_mapq").alias("low"), c("null_mapq").alias("nul"), F.lit(1).alias("distinct"),
        F.when(c("kind") == "soft", F.array("number")).otherwise(none_of("int")).alias("ids"), F.when(c("kind") == "soft", none_of("int")).otherwise(F.array("number")).alias("ids2"),
    ).cast(SEEN))
    return all_.withColumn("number", number).select(
        *PLACE, "kind", "number", "right", "overhang", loci.alias("loci"), "start", "end", "low_mapq", "null_mapq", "distant_mate", "mate_chr_idx", "mate_pos", "inverted_mate",
    )


def excluded(regions: DataFrame, mates: DataFrame, width: int = 10_000) -> DataFrame:
    """mates without those that start in one of the regions (contig, lo, hi; half open). mates: mate_chr_idx, mate_pos.

    Regions are cut into bins; Spark chooses by their size whether they are broadcast.
    """
    cut = regions.select("contig", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("bin"))
    on = (mates["mate_chr_idx"] == cut["contig"]) & (F.floor(mates["mate_pos"] / width) == cut["bin"]) & (mates["mate_pos"] >= cut["lo"]) & (mates["mate_pos"] < cut["hi"])
    return mates.join(cut, on, "left_anti")


def range_join(a: DataFrame, b: DataFrame, key: str, lo: str, hi: str, pos: str, width: int = 1024) -> DataFrame:
    """Rows of a with the rows of b of the same key whose pos lies from lo to hi; by bins, so a crowded key is split."""
    left = a.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    right = b.withColumn("__bin", F.floor(F.col(pos) / width))
    return left.join(right, [key, "__bin"]).where((F.col(pos) >= F.col(lo)) & (F.col(pos) <= F.col(hi))).drop("__bin")


def around(positions: DataFrame, reads: DataFrame, left: int, right: int) -> DataFrame:
    """positions with lo and hi: where reads of its pools start. hi is pos + right, and lo follows the last read up to there: what starts `left` + `right` or
    more before that one is forgotten. positions: chr_idx, pos, last_start (of the reads that break there)."""
    starts = reads.select("chr_idx", F.col("start").alias("__start")).distinct()
    wide = positions.withColumn("hi", F.col("pos") + right)
    mark = range_join(wide.select(*PLACE, "last_start", "hi"), starts, "chr_idx", "last_start", "hi", "__start").groupBy(*PLACE).agg(F.max("__start").alias("__mark"))
    return wide.join(mark, PLACE).withColumn("lo", F.col("__mark") - (left + right) + 1).drop("__mark")


def pooled(positions: DataFrame, mates: DataFrame, low_left: int, low_right: int) -> DataFrame:
    """A row for each mate around a position and side it counts for: chr_idx, pos, right_side (of the breaks it may explain: true for mates left of the
    position), poor, own, and the mate's start, end, mate_chr_idx, mate_pos, inverted_mate, and n, how many mates have all of these in common.

    positions: chr_idx, pos, lo, hi. mates: chr_idx, start, end, poor, spots (breaks of the read itself) and where the mate lies. Poor ones count in a
    narrower range. A read that begins left of a position and ends beyond it counts for both sides. Equal mates are counted before they meet the positions, so deep
    places make no more rows than there are different mates.
    """
    c = F.col
    mates = mates.groupBy("chr_idx", "start", "end", "poor", "spots", "mate_chr_idx", "mate_pos", "inverted_mate").agg(F.count(F.lit(1)).alias("n"))
    met = range_join(positions.select(*PLACE, "lo", "hi"), mates, "chr_idx", "lo", "hi", "start")
    met = met.where(~c("poor") | c("start").between(c("pos") - low_left, c("pos") + low_right))
    before = c("start") < c("pos")
    sides = F.when(before & (c("end") > c("pos")), F.array(F.lit(True), F.lit(False))).otherwise(F.array(before))
    return met.select(*PLACE, F.explode(sides).alias("right_side"), "poor", F.array_contains("spots", c("pos")).alias("own"), "start", "end", "mate_chr_idx", "mate_pos", "inverted_mate", "n")


def pool_sizes(pool: DataFrame) -> DataFrame:
    """chr_idx, pos, largest_pool: the largest of the four pools of a position."""
    return pool.groupBy(*PLACE, "right_side", "poor").agg(F.sum("n").alias("n")).groupBy(*PLACE).agg(F.max("n").alias("largest_pool"))


def own_mates(attached: DataFrame) -> DataFrame:
    """Rows of pools from a position's own reads, with source: 0 for soft-clipped reads whose mate is distant, 1 for each distant locus of a hard-clipped one."""
    c = F.col
    soft = attached.where((c("kind") == "soft") & c("distant_mate") & (c("mate_chr_idx") <= LAST_PARTNER)).withColumn("right_side", c("right")).withColumn("source", F.lit(0))
    hard = attached.where("kind <> 'soft'").withColumn("x", F.explode(F.filter(not_itself(c("loci")), lambda x: x["distant"]))).withColumn("right_side", c("x.right_side")).withColumn("source", F.lit(1)).drop("x")
    return soft.unionByName(hard).select(*PLACE, "right_side", (c("low_mapq") | c("null_mapq")).alias("poor"), F.lit(False).alias("own"), "start", "end", "mate_chr_idx", "mate_pos", "inverted_mate", "source", F.lit(1).cast("long").alias("n"))


def not_itself(loci: Column) -> Column:
    """Loci but for those that name, inverted, the position itself."""
    return F.filter(loci, lambda x: ~(x["inverted"] & (x["pos"] == F.col("pos")) & (x["contig_idx"] == F.col("chr_idx"))))


def mate_clusters(pool: DataFrame, support: int = 5, read_length: int = partners.READ_LENGTH) -> DataFrame:
    """chr_idx, pos, left_clusters, right_clusters, left_poor, right_poor: a position's pools, of rows that stand for n mates; 'left' holds what speaks for breaks on the right side of a read.

    Good mates of a contig whose starts lie within three and a half reads of the one before are a cluster, with its power, evidence (3 with a source 2, 2 with
    both others), how many are inverted, and the read that stands for it: of reads that begin nearer to the position than they end, the one whose
    end is nearest takes over, of the others the one whose start is. Weak clusters with evidence 1 are left out.
    """
    c = F.col
    good = gap_sessions(pool.where("not poor"), [*PLACE, "right_side", "mate_chr_idx"], "mate_pos", int(3.5 * read_length))
    has = lambda k: F.max((c("source") == k).cast("int")) == 1
    members = F.array_sort(F.collect_set(F.struct("mate_pos", "start", "end")))  # an equal one never takes over

    def nearer(s: Column, x: Column) -> Column:
        off = lambda v: F.abs(c("pos") - v)
        take = F.when(off(x["start"]) <= off(x["end"]), off(s["end"]) > off(x["end"])).otherwise(off(s["start"]) > off(x["start"]))
        return F.struct(F.when(take, x["start"]).otherwise(s["start"]).alias("start"), F.when(take, x["end"]).otherwise(s["end"]).alias("end"))

    sums = good.groupBy(*PLACE, "right_side", "mate_chr_idx", "session").agg(
        F.min("mate_pos").alias("first"), F.max("mate_pos").alias("last"), F.sum("n").cast("int").alias("power"), F.when(has(2), 3).when(has(0) & has(1), 2).otherwise(1).alias("evidence"), F.sum(F.when(c("inverted_mate"), c("n")).otherwise(0)).alias("turned"), members.alias("members"),
    ).where((c("evidence") > 1) | (c("power") >= support))
    stands = F.aggregate("members", F.struct(c("members")[0]["start"].alias("start"), c("members")[0]["end"].alias("end")), nearer)
    cluster = F.struct(c("mate_chr_idx").alias("contig"), c("first").alias("start"), c("last").alias("end"), "power", "evidence", (2 * c("turned") > c("power")).alias("inverted"), stands.alias("read"))
    side = lambda x, right: F.array_sort(F.collect_list(F.when(c("right_side") == right, x)))
    clusters = sums.select(*PLACE, "right_side", cluster.alias("x")).groupBy(*PLACE).agg(side(c("x"), True).alias("left_clusters"), side(c("x"), False).alias("right_clusters"))
    told = [*PLACE, "right_side", c("mate_chr_idx").alias("contig"), c("mate_pos").alias("start"), F.when(c("source") == 2, 3).otherwise(1).alias("evidence"), "own"]
    one = F.struct("contig", "start", "evidence", "own", "n")
    poor = pool.where("poor").groupBy(*told).agg(F.sum("n").cast("int").alias("n")).groupBy(*PLACE).agg(side(one, True).alias("left_poor"), side(one, False).alias("right_poor"))
    return clusters.join(poor, PLACE, "full")


def same_place(a: Column, b: Column, read_length: int) -> Column:
    """Whether loci of reads are taken for one: by side, strand and contig, with ranges within twice the reach of vague ones, since none of them has counts yet."""
    return (a["inverted"] == b["inverted"]) & (a["contig_idx"] == b["contig_idx"]) & (a["right_side"] == b["right_side"]) & (partners.gap(a, b) <= 2 * partners.wide(read_length))


def narrowed(a: Column, x: Column) -> Column:
    """a after it has taken in x: an exact one makes a vague one exact, two vague ones make one range."""
    sharp, grown = a["fuzzy"] & ~x["fuzzy"], a["fuzzy"] & x["fuzzy"]
    lo = F.when(sharp, x["pos"]).when(grown, F.least(a["pos"], x["pos"])).otherwise(a["pos"])
    hi = F.when(sharp, x["pos"]).when(grown, F.greatest(a["ext_pos"], x["ext_pos"])).otherwise(a["ext_pos"])
    return _with(a, pos=lo, ext_pos=hi, fuzzy=a["fuzzy"] & ~sharp, distant=a["distant"] | (sharp & x["distant"]))


def _with(a: Column, **fields: Column) -> Column:
    for k, v in fields.items():
        a = a.withField(k, v)
    return a


def absorbed(done: Column, offers: Column, read_length: int, merge: Callable[[Column, Column, Column], Column], new: Callable[[Column], Column] = lambda x: x) -> Column:
    """A list that takes in offers in order: each is merged into the first of its place, or becomes a new one."""

    def step(xs: Column, x: Column) -> Column:
        at = F.array_position(F.transform(xs, lambda a: same_place(a, x, read_length)), True)
        return let(at, lambda k: F.when(k == 0, F.concat(xs, F.array(new(x)))).otherwise(F.transform(xs, lambda a, i: F.when(i == k - 1, merge(a, x, xs)).otherwise(a))))

    return F.aggregate(offers, done, step)


def primary_loci(soft: Column, parents: Column, short: Column, shown: Column, read_length: int = partners.READ_LENGTH) -> Column:
    """Loci that a position's soft-clipped reads tell of, with the numbers of the reads that support each.

    soft: array of structs with loci and nul, by number. parents: array of structs with children (numbers, its own first, in the order they
    came). short: numbers of reads too short for parents, in order. shown: whether any parent is given out; without, short reads' loci are lost.
    A parent gathers the loci of its children; all its children then support each of them.
    """
    of = lambda n: F.get(soft, n)["loci"]
    union = lambda a, b: F.array_union(a, b)

    def gathered(p: Column) -> Column:
        best = lambda a, x, xs: _with(narrowed(a, x), mapq=F.greatest(a["mapq"], x["mapq"]), distinct=a["distinct"] + 1)
        got = absorbed(none_of(SEEN), F.flatten(F.transform(p["children"], of)), read_length, best)
        return F.transform(got, lambda x: x.withField("ids", union(x["ids"], p["children"])))

    def taken(a: Column, x: Column, xs: Column) -> Column:
        return _with(narrowed(a, x), ids=union(a["ids"], x["ids"]), nul=a["nul"] & F.element_at(xs, -1)["nul"])

    kept = lambda a, x, xs: _with(narrowed(a, x), ids=union(a["ids"], x["ids"]), nul=a["nul"] & x["nul"])
    long = absorbed(none_of(SEEN), F.flatten(F.transform(parents, gathered)), read_length, taken)
    few = absorbed(none_of(SEEN), F.flatten(F.transform(short, of)), read_length, kept)
    return F.when(shown, absorbed(long, few, read_length, kept)).otherwise(long)


def doubled(primary: Column, secondary: Column, poor: Column, read_length: int = partners.READ_LENGTH) -> Column:
    """struct(x, hard, poor) for each primary locus: the locus after it has taken in all loci of hard-clipped reads at its place, and their places in both lists."""

    def step(s: Column, p: Column, is_poor: bool) -> Column:
        y, hit = p["y"], same_place(s["x"], p["y"], read_length)
        x = narrowed(s["x"], y).withField("ids2", F.concat(s["x"]["ids2"], y["ids2"]))
        add = lambda k, mine: F.when(hit, F.concat(s[k], F.array(p["i"]))).otherwise(s[k]).alias(k) if mine else s[k].alias(k)
        return F.struct(F.when(hit, x).otherwise(s["x"]).alias("x"), add("hard", not is_poor), add("poor", is_poor))

    numbered = lambda ys: F.transform(ys, lambda y, i: F.struct(y.alias("y"), i.alias("i")))
    zero = lambda x: F.struct(x.alias("x"), none_of("int").alias("hard"), none_of("int").alias("poor"))
    # numbers are joined as they come and repeats leave at the end, for a union at each step would go through all of them
    done = lambda s: s.withField("x", s["x"].withField("ids2", F.array_distinct(s["x"]["ids2"])))
    return F.transform(primary, lambda x: F.aggregate(numbered(poor), F.aggregate(numbered(secondary), zero(x), lambda s, p: step(s, p, False)), lambda s, p: step(s, p, True), done))


def merged_secondary(loci: Column, read_length: int = partners.READ_LENGTH) -> Column:
    """Loci of hard-clipped reads that no primary one has taken, merged, the best mapping quality first, of equals the last one."""
    ranked = F.transform(F.array_sort(F.transform(loci, lambda x, i: F.struct((-x["mapq"]).alias("q"), (-i).alias("i"), x.alias("x")))), lambda p: p["x"])
    merge = lambda a, x, xs: _with(narrowed(a, x), mapq=F.greatest(a["mapq"], x["mapq"]), nul=a["nul"] & x["nul"], ids2=F.concat(a["ids2"], x["ids2"]))
    return F.transform(absorbed(none_of(SEEN), ranked, read_length, merge), lambda x: x.withField("ids2", F.array_distinct(x["ids2"])))


def with_mates(loci: Column, support: int = 5) -> Column:
    """Loci with support, secondary, mates, expected, suspicious, semi_suspicious, weak (to be left out), and used and used_poor: places in the pools of its side.

    Columns left_clusters, right_clusters, left_poor, right_poor, left_total, right_total of the position are read. Distant loci only; others have no
    mates. All loci of a position see the same pools: a cluster adds to each locus at which it lies, and it is for mate_total() to count it once.
    """
    side = lambda x, what: F.when(x["right_side"], F.col(f"left_{what}")).otherwise(F.col(f"right_{what}"))

    def of(x: Column) -> Column:
        n1, n2 = F.size(x["ids"]), F.size(x["ids2"])

        def at(m: Column) -> Column:
            poor = side(x, "poor")
            last = F.when(x["fuzzy"], m["hi"]).otherwise(m["lo"])
            near = lambda p: (p["contig"] == x["contig_idx"]) & (last >= p["start"] - x["slack"]) & (m["lo"] <= p["start"] + x["slack"])
            hits = F.filter(F.transform(poor, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda q: near(q["p"]))
            return let(hits, lambda h: counted(m, h, _many(poor, lambda p: p["n"])))

        def counted(m: Column, h: Column, n: Column) -> Column:
            k = _many(h, lambda q: q["p"]["n"])
            mates = (m["mates"] + k).cast("int")
            level = F.greatest(m["evidence"], F.coalesce(F.array_max(F.transform(h, lambda q: F.when(q["p"]["own"], 0).otherwise(q["p"]["evidence"]))), F.lit(0)))
            expected = (side(x, "total") + k + F.least(k, n - k)).cast("int")
            thin = (n2 == 0) & (n1 < support)
            vague = (mates > 0) & (level < 3)
            weak = thin & ((mates == 0) | (vague & ~holds(ratio(mates, expected) > 0.33)))
            return _row(x, m["lo"], m["hi"], n1, n2, mates, expected, (mates == 0) & ~thin, vague, weak, m["used"], F.transform(h, lambda q: q["i"]))

        far = let(partners.mate_support(x, side(x, "clusters"), x["slack"]), at)
        no = F.lit(False)
        return F.when(x["distant"], far).otherwise(_row(x, x["pos"], x["ext_pos"], n1, n2, F.lit(0), F.lit(0), no, no, no, none_of("int"), none_of("int")))

    return F.transform(loci, of)


def _row(x, lo, hi, n1, n2, mates, expected, suspicious, semi, weak, used, used_poor) -> Column:
    keep = ("contig_idx", "right_side", "inverted", "mapq", "fuzzy", "distant", "low", "nul", "distinct", "ids2")
    return F.struct(
        lo.cast("int").alias("pos"), hi.cast("int").alias("ext_pos"), *(x[k].alias(k) for k in keep), n1.alias("support"), n2.alias("secondary"), mates.cast("int").alias("mates"), expected.cast("int").alias("expected"),
        suspicious.alias("suspicious"), semi.alias("semi_suspicious"), weak.alias("weak"), F.lit(False).alias("error_prone"), used.cast("array<int>").alias("used"), used_poor.cast("array<int>").alias("used_poor"),
    )


def _many(xs: Column, n: Callable[[Column], Column]) -> Column:
    return F.aggregate(xs, F.lit(0), lambda s, x: s + n(x))


def mate_total(loci: Column) -> Column:
    """Mates that lie at any locus of the position, each cluster and each poor mate once."""

    def side(right: bool, name: str) -> Column:
        own = F.filter(loci, lambda x: x["right_side"] == right)
        used = lambda k: F.array_distinct(F.flatten(F.transform(own, lambda x: x[k])))
        return _many(used("used"), lambda i: F.get(F.col(f"{name}_clusters"), i)["power"]) + _many(used("used_poor"), lambda i: F.get(F.col(f"{name}_poor"), i)["n"])

    return side(True, "left") + side(False, "right")


def mates_alone(loci: Column, read_length: int = partners.READ_LENGTH) -> Column:
    """Loci of clusters that no other locus of the position uses: with evidence 3, a third of the side's mates and a read within half a read of the position."""

    def side(right: bool) -> Column:
        name = "left" if right else "right"
        used = F.flatten(F.transform(F.filter(loci, lambda x: x["right_side"] == right), lambda x: x["used"]))
        numbered = F.transform(F.col(f"{name}_clusters"), lambda m, i: F.struct(m.alias("m"), i.alias("i")))
        off = (lambda m: F.col("pos") - m["read"]["end"]) if right else (lambda m: m["read"]["start"] - F.col("pos"))
        total = F.col(f"{name}_total")
        good = lambda p: ~F.array_contains(used, p["i"]) & (p["m"]["evidence"] == 3) & holds(ratio(p["m"]["power"], total) >= 0.33) & (off(p["m"]) < read_length // 2)
        no, zero = F.lit(False), F.lit(0)

        def locus(p: Column) -> Column:
            m = p["m"]
            x = F.struct(m["contig"].alias("contig_idx"), F.lit(right).alias("right_side"), m["inverted"].alias("inverted"), zero.alias("mapq"), (m["start"] != m["end"]).alias("fuzzy"), F.lit(True).alias("distant"), no.alias("low"), no.alias("nul"), zero.alias("distinct"), none_of("int").alias("ids2"))
            return _row(x, m["start"], m["end"], zero, zero, m["power"], total, no, no, no, none_of("int"), none_of("int"))

        return F.transform(F.filter(numbered, good), locus)

    return F.concat(side(True), side(False))


def overlaid(double: Column, primary: Column, read_length: int = partners.READ_LENGTH) -> Column:
    """Double-sided loci that take over supports and the better share of mates of primary ones at their place."""

    def better(a: Column, y: Column) -> Column:
        take = (y["expected"] > 0) & ((a["expected"] <= 0) | holds(ratio(y["mates"], y["expected"]) > ratio(a["mates"], a["expected"])))
        return _with(a, support=F.greatest(a["support"], y["support"]), secondary=F.greatest(a["secondary"], y["secondary"]), mates=F.when(take, y["mates"]).otherwise(a["mates"]), expected=F.when(take, y["expected"]).otherwise(a["expected"]))

    return F.transform(double, lambda d: F.aggregate(primary, d, lambda a, y: F.when(same_place(a, y, read_length), better(a, y)).otherwise(a)))


def supported(loci: Column, support: int, compensated: bool) -> Column:
    """Loci with reads on both sides or enough of reads and mates in all. compensated: error_prone marks fewer mates than come by error; no locus expects fewer than it has.
    Columns left_errors and right_errors are read."""
    out = F.filter(loci, lambda x: ((x["support"] > 0) & (x["secondary"] > 0)) | (x["support"] + x["secondary"] + x["mates"] >= support))
    if not compensated:
        return out
    few = lambda x: x["mates"] < F.when(x["right_side"], F.col("left_errors")).otherwise(F.col("right_errors"))
    return F.transform(out, lambda x: _with(x, error_prone=x["distant"] & few(x), expected=F.when(x["distant"], F.greatest(x["expected"], x["mates"])).otherwise(x["expected"])))
