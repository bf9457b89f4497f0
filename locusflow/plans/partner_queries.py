"""Queries on partner loci, reads and positions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cigar as cg
from ..functions import partners
from ..functions import reads as rd
from ..functions import contigs
from ..operators import lookups, screens, support
from .adapters import LO, table
from .adapters import loci as events_view
from .locus_view import LV, RV, locus, positions, reads

QUERIES: dict = {}
SQL: dict[str, str] = {}
c, lit = F.col, F.lit


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _rows(spark, d):
    return positions(spark, d).withColumns({f"x{i}": locus(i) for i in (1, 2, 3)})


def _gap(a: str, b: str) -> str:
    return f"greatest(0, pos{b} - ext{a}, pos{a} - ext{b})"


@query(f"""WITH {LV} SELECT o_orderkey,
 ctg1 = ctg2 AND CASE WHEN vague1 OR vague2 THEN (pos1 <= ext2 AND pos2 <= ext1) OR (pos2 >= ext1 AND pos2 - ext1 <= 252) OR (pos2 < ext1 AND pos1 - ext2 <= 252) ELSE abs(pos1 - pos2) <= 50 END AS near,
 ctg1 = ctg2 AND right1 = right2 AND CASE WHEN vague1 OR vague2 THEN (pos1 <= ext2 AND pos2 <= ext1) OR (pos2 >= ext1 AND pos2 - ext1 <= 252) OR (pos2 < ext1 AND pos1 - ext2 <= 252) ELSE abs(pos1 - pos2) <= 50 END AS near_side,
 inv1 = inv2 AND ctg1 = ctg2 AND right1 = right2 AND CASE WHEN vague1 OR vague2 THEN pos2 - 252 <= ext1 + 252 AND pos1 - 252 <= ext2 + 252 ELSE abs(pos1 - pos2) <= 100 END AS directed,
 far1 AND far2 AND ctg1 = ctg2 AND right1 = right2 AND CASE WHEN vague1 OR vague2 THEN pos2 - 300 <= ext1 + 300 AND pos1 - 300 <= ext2 + 300 ELSE abs(pos1 - pos2) <= 300 END AS homologous,
 bctg = ctg1 AND CASE WHEN fuzzy1 THEN bpos - 252 <= ext1 + 252 AND pos1 - 252 <= bpos + 252 ELSE abs(bpos - pos1) <= 60 END AS at_position,
 ctg2 = ctg1 AND CASE WHEN fuzzy1 THEN pos2 - s <= ext1 AND pos1 <= ext2 + s ELSE pos1 >= pos2 - s AND pos1 <= ext2 + s END AS at_mates
 FROM (SELECT *, CASE WHEN bctg = ctg1 THEN least(abs(bpos - pos1), 505) ELSE 505 END AS s FROM lv)""")
def locus_closeness(spark, d):
    a, b = c("x1"), c("x2")
    return _rows(spark, d).select(
        "o_orderkey", partners.close(a, b, 50).alias("near"), partners.close(a, b, 50, same_side=True).alias("near_side"), partners.close_directed(a, b, 100).alias("directed"), partners.close_homologous(a, b, 300).alias("homologous"),
        partners.position_close(c("bctg"), c("bpos"), a, 60).alias("at_position"), partners.mate_close(c("ctg2"), c("pos2"), c("pos2") + c("len2"), a, partners.slack(c("bctg"), c("bpos"), a)).alias("at_mates"),
    )


@query(f"""WITH {LV}, m AS (SELECT o_orderkey, pos1, ext1, pos2, ext2, pos3, ext3, right1, right2, right3, ctg1, ctg2, ctg3, vague1, vague2, vague3, {_gap('1', '3')} AS g1, {_gap('2', '3')} AS g2 FROM lv)
 SELECT o_orderkey, CASE WHEN ctg1 = ctg3 AND right1 = right3 AND CASE WHEN vague1 OR vague3 THEN g1 <= 252 ELSE abs(pos1 - pos3) <= 20 END THEN pos1
 WHEN ctg2 = ctg3 AND right2 = right3 AND CASE WHEN vague2 OR vague3 THEN g2 <= 252 ELSE abs(pos2 - pos3) <= 20 END THEN pos2 ELSE -1 END AS first_pos FROM m""")
def first_close_locus(spark, d):
    return _rows(spark, d).select("o_orderkey", F.coalesce(partners.first_close(F.array("x1", "x2"), c("x3"), 20)["pos"], lit(-1)).alias("first_pos"))


@query(f"""WITH {LV} SELECT o_orderkey, CAST(CASE WHEN far1 THEN greatest(1, round(bpos - 151.5)) ELSE bpos END AS INT) AS pos, CAST(CASE WHEN far1 THEN floor(bpos + 151.5) ELSE bpos END AS INT) AS ext_pos, far1 AS fuzzy, inv1 AS inverted, semi1 AS semi,
 fuzzy2 AS own_fuzzy, vague2 AS own_strict, sup2 + sec2 < 3 AS own_few, far2 AS own_distant FROM lv""")
def stand_in_loci(spark, d):
    s, x = partners.stand_in(c("bctg"), c("bpos"), c("x1")), c("x2")
    return _rows(spark, d).select("o_orderkey", s["pos"].cast("int").alias("pos"), s["ext_pos"].cast("int").alias("ext_pos"), s["fuzzy"].alias("fuzzy"), s["inverted"].alias("inverted"), s["semi_suspicious"].alias("semi"), x["fuzzy"].alias("own_fuzzy"), x["strict_fuzzy"].alias("own_strict"), partners.few_splits(x).alias("own_few"), x["distant"].alias("own_distant"))


@query(f"""WITH {LV} SELECT o_orderkey, NOT susp1 AND sup1 + sec1 + mate1 >= 3 AS searched, sec1 > 0 OR (sup1 > 0 AND mate1 > 0) AS double, NOT semi1 AND (sec1 > 0 OR (sup1 > 0 AND mate1 > 0) OR (len1 = 0 AND sup1 + sec1 > 0)) AS alone, NOT susp2 AS pairs,
 paired_soft = 0 AND short_indel = 0 AND unpaired_soft >= 5 AND (normal_spans = 0 OR unpaired_soft >= 0.2 * normal_spans) AND 2 * (low_spans_soft + low_breaks_soft + repetitive) <= unpaired_soft + low_spans_soft + low_breaks_soft + repetitive AS overhang_only FROM lv""")
def search_gates(spark, d):
    x = c("x1")
    return _rows(spark, d).select("o_orderkey", partners.searched(x).alias("searched"), partners.double_support(x).alias("double"), partners.may_stand_alone(x).alias("alone"), (~c("x2")["suspicious"]).alias("pairs"), screens.overhang_only().alias("overhang_only"))


BETTER = "(exp2 > 0 AND (exp1 = 0 OR mate2 * exp1 > mate1 * exp2))"


@query(f"""WITH {LV} SELECT o_orderkey, greatest(sup1, sup2) AS support, greatest(sec1, sec2) AS secondary, CASE WHEN {BETTER} THEN mate2 ELSE mate1 END AS mates, CASE WHEN {BETTER} THEN exp2 ELSE exp1 END AS expected, semi1 AND semi2 AS semi FROM lv""")
def locus_merge(spark, d):
    m = partners.merged(c("x1"), c("x2"))
    return _rows(spark, d).select("o_orderkey", *(m[k].alias(k) for k in ("support", "secondary", "mates", "expected")), m["semi_suspicious"].alias("semi"))


def _fit(i: int, right: bool) -> str:
    return f"(far{i} AND {'' if right else 'NOT '}right{i} AND NOT susp{i} AND mate{i} > 4)"


def _pair_sql() -> str:
    cols = []
    for side, name in ((True, "r"), (False, "l")):
        n = " + ".join(f"CAST({_fit(i, side)} AS INT)" for i in (1, 2, 3))
        total = " + ".join(f"CASE WHEN {_fit(i, side)} THEN mate{i} ELSE 0 END" for i in (1, 2, 3))
        most = ", ".join(f"CASE WHEN {_fit(i, side)} THEN exp{i} ELSE 0 END" for i in (1, 2, 3))
        cols.append(f"({n}) = 2 AND (greatest({most}) = 0 OR 10 * ({total}) > 7 * greatest({most})) AS {name}")
    out = ", ',', ".join(f"CASE WHEN (r AND {_fit(i, True)}) OR (l AND {_fit(i, False)}) THEN mate{i} ELSE exp{i} END" for i in (1, 2, 3))
    return f"WITH {LV}, k AS (SELECT *, {', '.join(cols)} FROM lv) SELECT o_orderkey, concat({out}) AS expected FROM k"


@query(_pair_sql())
def pair_rescue(spark, d):
    got = partners.rescued_pairs(F.array("x1", "x2", "x3"))
    return _rows(spark, d).select("o_orderkey", F.array_join(F.transform(got, lambda x: x["expected"].cast("string")), ",").alias("expected"))


def _hom(a: int, b: int, w: int) -> str:
    return f"(far{a} AND far{b} AND ctg{a} = ctg{b} AND right{a} = right{b} AND CASE WHEN vague{a} OR vague{b} THEN {_gap(str(a), str(b))} <= {2 * w} ELSE abs(pos{a} - pos{b}) <= {w} END)"


@query(f"""WITH {LV}, p AS (SELECT *, {_hom(1, 2, 300)} AS h12, {_hom(1, 3, 300)} AS h13, {_hom(2, 3, 300)} AS h23, {_hom(3, 1, 100)} AS k31, {_hom(3, 2, 100)} AS k32 FROM lv),
 q AS (SELECT *, mate1 > 0 AND (h12 OR h13) AS hit1, semi1 AND NOT (mate1 > 0 AND (h12 OR h13) AND NOT CASE WHEN h12 THEN semi2 ELSE semi3 END) AS t1 FROM p),
 r AS (SELECT *, mate2 > 0 AND (h12 OR h23) AS hit2, semi2 AND NOT (mate2 > 0 AND (h12 OR h23) AND NOT CASE WHEN h12 THEN t1 ELSE semi3 END) AS t2 FROM q),
 s AS (SELECT *, mate3 > 0 AND (k31 OR k32) AS hit3, semi3 AND NOT (mate3 > 0 AND (k31 OR k32) AND NOT CASE WHEN k31 THEN t1 ELSE t2 END) AS t3 FROM r)
 SELECT o_orderkey, CASE WHEN hit1 THEN mate1 ELSE exp1 END AS expected1, t1 AS semi1, CASE WHEN hit2 THEN mate2 ELSE exp2 END AS expected2, t2 AS semi2, CASE WHEN hit3 THEN mate3 ELSE exp3 END AS expected3, t3 AS semi3 FROM s""")
def homology_rescue(spark, d):
    two, one = partners.rescued_homologues(F.array("x1", "x2"), F.array("x3"), 300, 100)
    rows = _rows(spark, d).select("o_orderkey", F.concat(two, one).alias("xs"))
    return rows.select("o_orderkey", *(F.get("xs", lit(i))[k].alias(f"{n}{i + 1}") for i in range(3) for k, n in (("expected", "expected"), ("semi_suspicious", "semi"))))


def _grow(k: int, old: str, new: str) -> str:
    met = f"(ctg{k} = c AND CASE WHEN vf THEN hi ELSE lo END >= pos{k} - 40 AND lo <= ext{k} + 40)"
    return f"{new} AS (SELECT * EXCLUDE (lo, hi, mates, evidence), mates + CASE WHEN {met} THEN sup{k} ELSE 0 END AS mates, CASE WHEN {met} THEN greatest(evidence, CASE WHEN semi{k} THEN 3 ELSE 1 END) ELSE evidence END AS evidence, CASE WHEN {met} AND vf THEN least(lo, pos{k}) ELSE lo END AS lo, CASE WHEN {met} AND vf THEN greatest(hi, ext{k}) ELSE hi END AS hi FROM {old})"


@query(f"""WITH {LV}, s0 AS (SELECT *, bctg AS c, bpos AS lo, CASE WHEN many THEN bpos + 200 ELSE bpos END AS hi, many AS vf, 0 AS mates, 0 AS evidence FROM lv), {_grow(1, 's0', 's1')}, {_grow(2, 's1', 's2')}, {_grow(3, 's2', 's3')}
 SELECT o_orderkey, CAST(mates AS BIGINT) AS mates, CAST(evidence AS INT) AS evidence, CAST(lo AS INT) AS lo, CAST(hi AS INT) AS hi FROM s3""")
def mate_support(spark, d):
    x = F.struct(c("bctg").alias("contig_idx"), c("bpos").alias("pos"), F.when(c("many"), c("bpos") + 200).otherwise(c("bpos")).alias("ext_pos"), c("many").alias("fuzzy"))
    clusters = F.array(*(F.struct(c(f"ctg{i}").alias("contig"), c(f"pos{i}").alias("start"), (c(f"pos{i}") + c(f"len{i}")).alias("end"), c(f"sup{i}").alias("power"), F.when(c(f"semi{i}"), 3).otherwise(1).alias("evidence")) for i in (1, 2, 3)))
    rows = positions(spark, d).withColumns({"x": x, "m": clusters}).select("o_orderkey", partners.mate_support(c("x"), c("m"), 40).alias("s"))
    return rows.select("o_orderkey", "s.mates", "s.evidence", "s.lo", "s.hi")


@query(f"""WITH {LV}, t AS (SELECT *, unpaired_soft + unpaired_hard + short_indel AS ev, low_breaks_soft + low_spans_soft + low_spans_hard AS art FROM lv),
 u AS (SELECT *, (ev + art > 50 AND art > 0.85 * (ev + art)) OR (soft_reads = 2000 AND ev + normal_spans + art > 40000) AS swamped FROM t), w AS (SELECT *, NOT swamped AND ev < 5 AND largest_pool < 5 AS thin FROM u),
 x AS (SELECT *, CASE WHEN swamped OR thin THEN 0 ELSE mate_support END AS m, CASE WHEN swamped OR thin THEN 0 ELSE loci END AS k FROM w)
 SELECT o_orderkey, CASE WHEN thin AND art < normal_spans THEN 'none' WHEN ev + m + art < 5 OR (ev + art < 5 AND k = 0) THEN 'none' WHEN (swamped OR thin OR (k = 0 AND overhang_chars < 2)) AND NOT (paired_soft + paired_hard + ev + low_breaks_soft + low_spans_hard + low_spans_soft + repetitive > 10
 AND paired_soft + unpaired_soft + paired_hard + low_breaks_soft + low_spans_soft + repetitive > 0) THEN 'none' WHEN swamped OR thin THEN 'bare' ELSE 'full' END AS emitted,
 (far1 AND far2 AND far3) OR (over16 > 0 AND over16 <= 8) AS overhang_ok FROM x""")
def emission_rule(spark, d):
    from ..sources.breakpoints import COUNTS

    rows = _rows(spark, d).withColumns({f"final_{n}": c(n) for n in COUNTS})
    masked = F.when(c("over16") > 0, c("over16") / lit(16.0))  # an empty overhang has no ratio
    return rows.select("o_orderkey", screens.emission().alias("emitted"), screens.overhang_accepted(c("x1.distant") & c("x2.distant") & c("x3.distant"), masked).alias("overhang_ok"))


def _control(level: int) -> str:
    near = "CASE WHEN bctg <> bx THEN 1000000 ELSE greatest(0, px - bpos, bpos - ex) END"
    return f"NOT ((paired_soft + unpaired_soft > 19 AND paired_hard + unpaired_hard < 3 AND has_over AND over16 / 16.0 > 0.7) OR CASE WHEN px IS NULL THEN paired_soft + unpaired_soft + paired_hard + unpaired_hard < 10 ELSE ix AND {near} > 0 AND CASE WHEN {near} < 10000 THEN {'true' if level == 2 else 'ux < 5 OR vx < 5'} ELSE ux < 5 AND vx < 5 END END)"


def _chosen(name: str, k: str) -> str:
    return f"CASE best WHEN 1 THEN {name}1 WHEN 2 THEN {name}2 WHEN 3 THEN {name}3 END AS {k}"


@query(f"""WITH {LV}, n AS (SELECT *, CASE WHEN susp1 THEN CASE WHEN susp2 THEN 0 ELSE 2 END ELSE 1 END AS b2, CASE WHEN NOT susp1 AND NOT susp2 AND sup2 + sec2 + mate2 > 0 THEN sup2 + sec2 + mate2 ELSE 0 END AS s2 FROM lv),
 o AS (SELECT *, CASE WHEN s2 > 0 THEN 2 ELSE b2 END AS b FROM n), p AS (SELECT *, CASE WHEN susp3 THEN b WHEN b = 0 THEN 3 WHEN sup3 + sec3 + mate3 > s2 THEN 3 ELSE b END AS best FROM o),
 q AS (SELECT *, {_chosen('ctg', 'bx')}, {_chosen('pos', 'px')}, {_chosen('ext', 'ex')}, {_chosen('inv', 'ix')}, {_chosen('sup', 'ux')}, {_chosen('sec', 'vx')} FROM p) SELECT o_orderkey, {_control(1)} AS kept_low, {_control(2)} AS kept_lowest FROM q""")
def control_prefilter(spark, d):
    rows, over = _rows(spark, d).withColumnsRenamed({"bctg": "contig_idx", "bpos": "pos"}), F.when(c("has_over"), c("over16") / lit(16.0))
    return rows.select("o_orderkey", *(screens.control_kept(F.array("x1", "x2", "x3"), over, level, True).alias(n) for level, n in ((1, "kept_low"), (2, "kept_lowest"))))


def _admit(i: int) -> str:
    return f"(NOT susp{i} AND CASE WHEN far{i} THEN exp{i} > 0 AND 2 * mate{i} >= exp{i} AND ((sup{i} + sec{i} > 4 AND mate{i} > 2) OR mate{i} > 4) ELSE sup{i} + sec{i} > 4 OR (sup{i} + sec{i} > 2 AND sup{i} > 0 AND sec{i} > 0) END)"


@query(f"""WITH {LV}, t AS (SELECT *, paired_soft + paired_hard + unpaired_soft + unpaired_hard + short_indel AS n FROM lv)
 SELECT o_orderkey, {_admit(1)} AS admitted, CASE WHEN short_indel > 2 OR n > 9 OR (n > 4 AND (n > 0.3 * (n + normal_spans) OR (n > 0.1 * (n + normal_spans) AND has_over))) THEN 1 WHEN n < 200 AND ({_admit(1)} OR {_admit(2)}) THEN 0 ELSE -1 END AS validity FROM t""")
def panel_admission(spark, d):
    return _rows(spark, d).select("o_orderkey", screens.admitted(c("x1")).alias("admitted"), screens.panel_validity(F.array("x1", "x2"), c("has_over")).alias("validity"))


@query(f"""WITH {RV} SELECT o_orderkey, cigar, CAST(CASE shape WHEN 5 THEN start + 2 * b + d WHEN 6 THEN start + 2 * b ELSE start + b END AS INT) AS end, CASE shape WHEN 0 THEN concat(start, ':S:', a) WHEN 1 THEN concat(start + b, ':S:', a) WHEN 2 THEN concat(start, ':S:', a, ';', start + b, ':S:', cc) WHEN 3 THEN concat(start, ':H:', a)
 WHEN 4 THEN concat(start + b, ':H:', a) WHEN 5 THEN concat(start + b, ':D:', d, ';', start + b + d, ':#:-1;', start + 2 * b + d, ':S:', a) ELSE concat(start + b, ':I:', d) END AS breaks,
 CASE WHEN shape IN (0, 2) THEN concat('S', a) WHEN shape = 3 THEN concat('H', a) ELSE 'none' END AS at_start FROM rv""")
def cigar_shapes(spark, d):
    rows = reads(spark, d).withColumn("start", c("start").cast("int")).withColumn("dec", cg.decode(c("start"), c("cigar"), c("n").cast("int"))).withColumn("bs", cg.breaks(c("start"), c("dec")))
    own = partners.chosen_break(c("bs"), c("start"))
    return rows.select("o_orderkey", "cigar", c("dec.end").alias("end"), F.array_join(F.transform("bs", lambda x: F.concat_ws(":", x["pos"], x["type"], x["size"])), ";").alias("breaks"), F.coalesce(F.concat(own["type"], own["size"]), lit("none")).alias("at_start"))


@query(f"""WITH {RV}, k AS (SELECT *, shape IN (0, 1, 2, 5) AS soft, shape IN (3, 4) AS hard, CASE WHEN mapq = 0 THEN 2 WHEN mapq < 13 THEN 1 ELSE 0 END AS cls FROM rv),
 e AS (SELECT *, CASE WHEN supp THEN CASE WHEN full_q >= 23 THEN 2 ELSE 5 END
 WHEN cls = 1 THEN CASE WHEN soft AND ((2 * a > n AND clip_q >= 23) OR (shape = 2 AND 2 * cc > n AND clip2_q >= 23)) AND NOT (a > 5 AND clip_q < 23) AND NOT (shape = 2 AND cc > 5 AND clip2_q < 23) THEN 1 ELSE 5 END
 WHEN cls = 2 AND shape = 2 THEN 5 WHEN NOT "unique" THEN 5 WHEN soft AND a >= 5 AND clip_q < 23 THEN 5 WHEN shape = 2 AND cc >= 5 AND clip2_q < 23 THEN 5
 WHEN (soft AND a >= 10) OR (shape = 2 AND cc >= 10) THEN 1 WHEN hard AND a >= 10 THEN 2 WHEN shape IN (5, 6) THEN 3 ELSE 0 END AS t FROM k) SELECT o_orderkey, CASE WHEN t IN (0, 3) AND mate_far THEN 4 ELSE t END AS read_type FROM e""")
def read_type(spark, d):
    rows = reads(spark, d).withColumn("dec", cg.decode(c("start").cast("int"), c("cigar"), c("n").cast("int")))
    medians = F.when(c("shape") == 2, F.array("clip_q", "clip2_q")).when(c("shape").isin(0, 1, 5), F.array("clip_q")).otherwise(F.array().cast("array<bigint>"))
    return rows.select("o_orderkey", rd.read_class(c("supp"), c("mapq"), c("dec.chunks"), medians, c("full_q"), c("n"), c("mate_far"), unique_ok=c("unique")).alias("read_type"))


SHIFT = "CASE shape WHEN 1 THEN b WHEN 2 THEN CASE WHEN cc > a THEN b ELSE 0 END WHEN 4 THEN b WHEN 5 THEN 2 * b + d ELSE 0 END"


@query(f"""WITH {RV}, p AS (SELECT *, mapq + 1 AS sa_ctg, start + {SHIFT} AS p FROM rv), f AS (SELECT *, sa_ctg <> here_ctg OR abs(here - p) > 2000 AS far, CASE WHEN sa_ctg = here_ctg THEN least(abs(here - p), 505) ELSE 505 END AS s FROM p)
 SELECT o_orderkey, CAST(p AS INT) AS pos, plus <> fwd AS inverted, far, CAST(s AS INT) AS slack, CAST(CASE WHEN mate_far AND NOT (mctg = sa_ctg AND p >= mpos - s AND p <= mpos + s) THEN 2 ELSE 1 END AS INT) AS n_loci FROM f""")
def loci_of_reads(spark, d):
    element = F.concat_ws(",", c("mapq") + 1, "start", F.when(c("plus"), "+").otherwise("-"), "cigar", "clip_q", lit(0))
    got = partners.read_loci(element, c("fwd"), c("right"), c("here_ctg"), c("here"), c("mate_far"), c("mctg"), c("mpos"), c("plus"))
    rows = reads(spark, d).select("o_orderkey", got.alias("xs")).withColumn("x", F.get("xs", lit(0)))
    return rows.select("o_orderkey", "x.pos", "x.inverted", c("x.distant").alias("far"), "x.slack", F.size("xs").alias("n_loci"))


@query(f"""WITH {LO}, b AS (SELECT DISTINCT contig, pos FROM lo WHERE kind < 'm'), m AS (SELECT contig, pos AS s, pos + 30 AS e FROM lo WHERE kind >= 'm'),
 j AS (SELECT b.contig, b.pos, count(*) FILTER (m.s < b.pos) AS l, count(*) FILTER (m.s >= b.pos OR b.pos < m.e) AS r FROM b JOIN m ON m.contig = b.contig AND m.s BETWEEN b.pos - 90 AND b.pos + 40 GROUP BY ALL)
 SELECT contig, pos, coalesce(l, 0) AS left_pool, coalesce(r, 0) AS right_pool FROM b LEFT JOIN j USING (contig, pos)""")
def mate_pools(spark, d):
    rows = events_view(spark, d)
    mates = rows.where("kind >= 'm'").select("contig", c("pos").alias("start"), (c("pos") + 30).alias("end"))
    return support.mate_pools(rows.where("kind < 'm'").select("contig", "pos").distinct(), mates, 90, 40)


@query(f"WITH {LO}, b AS (SELECT DISTINCT contig, pos FROM lo) SELECT contig, pos, row_number() OVER (ORDER BY contig, pos) AS running_index FROM b")
def running_index(spark, d):
    return support.running_index(events_view(spark, d).select("contig", "pos").distinct(), ["contig"], "pos", 1024)


_CLOSE_PANEL = "pa AS (SELECT contig, pos, count(*) AS hits, max(ord) % 3 AS n_loci, max(ord) % 7 AS locus_support FROM lo WHERE kind >= 'm' GROUP BY ALL)"


@query(f"""WITH {LO}, {_CLOSE_PANEL}, a AS (SELECT ord, contig, pos FROM lo WHERE kind < 'm'),
 h AS (SELECT a.ord, max(pa.hits) AS hits FROM a JOIN pa ON a.contig = pa.contig AND abs(a.pos - pa.pos) <= 20 AND NOT (pa.hits < 5 AND pa.n_loci = 1 AND pa.locus_support > 0.8 * pa.hits) GROUP BY a.ord) SELECT a.ord, coalesce(h.hits, 0) AS hits FROM a LEFT JOIN h USING (ord)""")
def conservative_hits(spark, d):
    rows = events_view(spark, d)
    panel = rows.where("kind >= 'm'").groupBy("contig", "pos").agg(F.count(lit(1)).alias("hits"), (F.max("ord") % 3).alias("n_loci"), (F.max("ord") % 7).alias("locus_support"))
    return lookups.conservative_hits(rows.where("kind < 'm'").select("ord", "contig", "pos"), panel, "ord", 20, 5)


_CONTROL = "co AS (SELECT contig, pos, count(*) * 3 + max(ord) % 5 AS support, max(ord) % 11 AS spans FROM lo WHERE kind >= 'm' GROUP BY ALL)"


@query(f"""WITH {LO}, {_CONTROL}, a AS (SELECT ord, contig, pos FROM lo WHERE kind < 'm'), j AS (SELECT a.ord, co.support, co.spans FROM a JOIN co ON a.contig = co.contig AND abs(a.pos - co.pos) <= 30 QUALIFY row_number() OVER (PARTITION BY a.ord ORDER BY co.support DESC, co.spans DESC) = 1)
 SELECT a.ord, round(coalesce(support / (support + spans), 0), 6) AS clonality FROM a LEFT JOIN j USING (ord)""")
def control_clonality(spark, d):
    rows = events_view(spark, d)
    control = rows.where("kind >= 'm'").groupBy("contig", "pos").agg((F.count(lit(1)) * 3 + F.max("ord") % 5).alias("support"), (F.max("ord") % 11).alias("spans"))
    return lookups.control_clonality(rows.where("kind < 'm'").select("ord", "contig", "pos"), control, "ord", 30).select("ord", F.round("clonality", 6).alias("clonality"))


@query("""WITH p AS (SELECT p_partkey AS line_index, p_partkey % 22 + 1 AS contig, 1000 + p_size * 7 AS pos, p_size % 9 AS hits, (p_partkey % 33) / 32.0 AS clonality FROM part), v AS (SELECT DISTINCT l_partkey AS line_index FROM lineitem WHERE l_linenumber > 6)
 SELECT line_index, concat_ws(chr(9), concat('##', contig), pos - 1, pos, concat(CASE WHEN clonality > 0.1 THEN 'GERMLINE(' ELSE 'SOMATIC(' END, hits, '/50):', printf('%.3f', CAST(clonality AS DOUBLE))), p_brand) AS line
 FROM p JOIN part ON p_partkey = line_index WHERE hits < 5 AND p_partkey % 3 > 0 AND line_index NOT IN (SELECT line_index FROM v)""")
def overhang_report(spark, d):
    part = table(spark, d, "part")
    at = part.select(c("p_partkey").alias("line_index"), (c("p_partkey") % 22 + 1).alias("contig"), (1000 + c("p_size") * 7).alias("pos"), (c("p_size") % 9).alias("hits"), ((c("p_partkey") % 33) / 32.0).alias("clonality"))
    over = part.select(c("p_partkey").alias("line_index"), F.when(c("p_partkey") % 3 > 0, c("p_brand")).otherwise("").alias("overhang"))
    return lookups.overhang_report(at, over, table(spark, d, "lineitem").where("l_linenumber > 6").select(c("l_partkey").alias("line_index")), 5, 50)


@query("""WITH g AS (SELECT l_partkey, count(DISTINCT l_orderkey % 7) AS p, count(DISTINCT l_suppkey % 5) AS s, count(*) AS soft, sum(l_linenumber) AS hard FROM lineitem GROUP BY l_partkey)
 SELECT l_partkey, p AS paired_soft, soft - p AS unpaired_soft, s AS paired_hard, CAST(hard - s AS BIGINT) AS unpaired_hard FROM g""")
def support_transfer(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count_distinct(c("l_orderkey") % 7).alias("p"), F.count_distinct(c("l_suppkey") % 5).alias("s"), F.count(lit(1)).alias("unpaired_soft"), F.sum("l_linenumber").alias("unpaired_hard"))
    g = g.withColumns({"paired_soft": lit(0).cast("long"), "paired_hard": lit(0).cast("long")})
    return g.select("l_partkey", *(x.alias(k) for k, x in support.transferred(c("p"), c("s")).items()))


@query(f"""WITH {LV} SELECT o_orderkey, CAST(greatest(0, round(normal_spans - (unpaired_soft * 0.25))) AS INT) AS expected, mate1 < unpaired_soft * 0.125 AS prone FROM lv""")
def expected_mates(spark, d):
    e = support.expected_mates(c("normal_spans"), c("unpaired_soft"), 0.65)
    return positions(spark, d).select("o_orderkey", e["expected"].alias("expected"), (c("mate1") < F.round(e["errors"], 6)).alias("prone"))


def _take(k: int, old: str, new: str) -> str:
    met = f"(ctg{k} = ctg1 AND right{k} = right1 AND inv{k} = inv1 AND greatest(0, pos{k} - hi, lo - ext{k}) <= 504)"
    return f"""{new} AS (SELECT * EXCLUDE (lo, hi, fz, used), CASE WHEN {met} AND fz AND NOT fuzzy{k} THEN pos{k} WHEN {met} AND fz THEN least(lo, pos{k}) ELSE lo END AS lo, CASE WHEN {met} AND fz AND NOT fuzzy{k} THEN pos{k} WHEN {met} AND fz THEN greatest(hi, ext{k}) ELSE hi END AS hi,
 fz AND NOT ({met} AND NOT fuzzy{k}) AS fz, concat(used, CASE WHEN {met} THEN '{k - 2},' ELSE '' END) AS used FROM {old})"""


@query(f"""WITH {LV}, s1 AS (SELECT *, pos1 AS lo, ext1 AS hi, fuzzy1 AS fz, '' AS used FROM lv), {_take(2, 's1', 's2')}, {_take(3, 's2', 's3')} SELECT o_orderkey, CAST(lo AS INT) AS lo, CAST(hi AS INT) AS hi, fz AS fuzzy, rtrim(used, ',') AS used FROM s3""")
def split_pairing(spark, d):
    s = support.split_pairs(c("x1"), F.array("x2", "x3"), 2 * partners.wide())
    return _rows(spark, d).select("o_orderkey", s.alias("s")).select("o_orderkey", "s.lo", "s.hi", "s.fuzzy", F.array_join("s.used", ",").alias("used"))


@query(f"""WITH {LV}, k AS (SELECT *, susp2 OR (exp2 > 0 AND 10 * mate2 <= exp2) AS bad2, susp1 OR (exp1 > 0 AND 10 * mate1 <= exp1) AS bad1, ctg1 = ctg2 AND CASE WHEN vague1 OR vague2 THEN {_gap('1', '2')} <= 252 ELSE abs(pos1 - pos2) <= 100 END AS near FROM lv)
 SELECT o_orderkey, CAST(CASE WHEN bad1 AND bad2 THEN 0 WHEN bad1 OR bad2 OR near THEN 1 ELSE 2 END AS INT) AS n, CASE WHEN bad1 AND bad2 THEN -1 WHEN bad1 THEN sup2 WHEN bad2 OR NOT near THEN sup1 ELSE greatest(sup1, sup2) END AS support,
 CASE WHEN bad1 AND bad2 THEN -1 WHEN bad1 THEN pos2 WHEN bad2 OR NOT near OR NOT fuzzy1 THEN pos1 WHEN NOT fuzzy2 THEN pos2 ELSE least(pos1, pos2) END AS pos FROM k""")
def panel_locus_merge(spark, d):
    rows = _rows(spark, d).select("o_orderkey", support.merged_list(F.array("x1", "x2")).alias("xs"))
    return rows.select("o_orderkey", F.size("xs").alias("n"), *(F.coalesce(F.get("xs", lit(0))[k], lit(-1)).alias(k) for k in ("support", "pos")))


@query("""SELECT p_partkey, CASE WHEN i BETWEEN 1 AND 22 THEN CAST(i AS VARCHAR) WHEN i = 40 THEN 'X' WHEN i = 41 THEN 'Y' WHEN i BETWEEN 191 AND 249 THEN 'GL000' || i || '.1' WHEN i = 999 THEN 'hs37d5' WHEN i = 1000 THEN 'NC_007605' WHEN i = 1001 THEN 'MT' WHEN i = 1002 THEN 'phiX174' ELSE 'none' END AS name
 FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 260 ELSE 990 + p_partkey % 15 END AS i FROM part)""")
def contig_names(spark, d):
    i = F.when(c("p_partkey") % 2 == 0, c("p_partkey") % 260).otherwise(990 + c("p_partkey") % 15)
    return table(spark, d, "part").select("p_partkey", F.coalesce(contigs.contig_name(i), lit("none")).alias("name"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment || c_nationkey WHEN 1 THEN c_mktsegment ELSE '' END AS sample FROM customer""")
def sample_names(spark, d):
    from ..sources.breakpoints import sample_name

    k = c("c_custkey") % 3
    path = F.when(k == 0, F.concat(lit("/data/x_bps_v1/"), "c_mktsegment", "c_nationkey", lit("_bps_v1.bed.gz"))).when(k == 1, F.concat("c_mktsegment", lit("_bps_v1.bed"))).otherwise("/data/other.bed")
    return table(spark, d, "customer").select("c_custkey", sample_name(path, "_bps_v1").alias("sample"))
