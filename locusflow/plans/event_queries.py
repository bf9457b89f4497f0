"""Queries that build events from positions, loci, panel and control, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import builders
from ..sources.breakpoints import COUNTS
from .locus_view import LV, locus, positions

c, lit = F.col, F.lit
_B2 = {n: f"(({n} + sup3) % 23)" for n in COUNTS}
#: What an event has besides loci and counts.
_MORE = {"hc1": "over16 % 9", "hc2": "largest_pool % 8", "wide1": "sec3", "wide2": "sec2", "hits": "sup3 + 3", "gc1": "CASE WHEN has_over THEN CAST(over16 AS DOUBLE) / 32 ELSE 0 END", "gc2": "CAST(loci AS DOUBLE) / 8", "kc": "CAST(sec3 AS DOUBLE) / 16"}
_TEXT = "CASE WHEN has_over THEN concat('>1_0:', repeat('A', CAST(over16 * 6 AS INT)), '(3);') END"


def sides(spark, d) -> DataFrame:
    rows = positions(spark, d).selectExpr("*", *(f"{v} AS {k}" for k, v in _MORE.items()), f"{_TEXT} AS text1", "CAST(NULL AS STRING) AS text2")
    third = locus(3)
    return rows.select(
        "o_orderkey", c("bctg").alias("ctg1"), c("bpos").alias("pos1"), c("ctg3").alias("ctg2"), c("pos3").alias("pos2"), locus(1).alias("x1"), locus(2).alias("x2"), F.struct(*(c(n).alias(n) for n in COUNTS)).alias("b1"),
        F.struct(*(F.expr(v).alias(k) for k, v in _B2.items())).alias("b2"), "hc1", (c("hc1") + c("wide1")).alias("ha1"), "hc2", (c("hc2") + c("wide2")).alias("ha2"), "gc1", "gc2", "text1", "text2",
        *(F.array(third.withField("secondary", c("hits"))).alias(f"panel{i}") for i in (1, 2)), *(F.array(F.struct(third.alias("locus"), c("kc").alias("clonality"))).alias(f"control{i}") for i in (1, 2)),
        c("repetitive").alias("left2"), c("low_breaks_hard").alias("right2"), c("bctg").cast("string").alias("contig1"), c("ctg3").cast("string").alias("contig2"),
    )


SHOWN = ["type", "size", "inv", "distant", "e1", "e2", "ev1", "ev2", "h1", "h2", "germ1", "germ2", "germline", "status1", "artifact", "reason", "score"]


def _shown(df: DataFrame) -> DataFrame:
    return df.select("o_orderkey", "type", c("size").cast("long").alias("size"), "inv", "distant", *(c(k).cast("long").alias(k) for k in ("e1", "e2", "ev1", "ev2", "h1", "h2")), "germ1", "germ2", "germline", "status1", "artifact", c("reason").cast("int").alias("reason"), c("score").cast("int").alias("score"))


def two_sided_events(spark, d):
    return _shown(builders.two_sided(sides(spark, d)))


def one_sided_events(spark, d):
    return _shown(builders.one_sided(sides(spark, d)))


def unknown_events(spark, d):
    return _shown(builders.unknown(sides(spark, d)))


def event_rows(spark, d):
    rows = builders.two_sided(sides(spark, d))
    return rows.select("o_orderkey", builders.rows(rows, 2, 40).alias("line"))


def _links(i: int) -> str:
    return f"ctg{i} AS lctg{i}, pos{i} AS lpos{i}, ext{i} AS lext{i}, right{i} AS lright{i}, inv{i}, sup{i}, sec{i}, mate{i}, exp{i}, susp{i}, semi{i} AS sui{i}, prone{i}, fuzzy{i}, vague{i} AS strict{i}, sup{i} + sec{i} < 3 AS cand{i}, far{i} AS xfar{i}"


def _near(i: int) -> str:
    return f"kctg = lctg{i} AND CASE WHEN kvague OR strict{i} THEN greatest(0, kpos - lext{i}, lpos{i} - kext) <= 252 ELSE abs(kpos - lpos{i}) <= 606 END"


_COUNTS_SQL = ", ".join(f"{n} AS {n}1" for n in COUNTS) + ", " + ", ".join(f"{v} AS {n}2" for n, v in _B2.items())
_PARTNER = "(SELECT bctg AS ctg1, bpos AS pos1, ctg3 AS ctg2, pos3 AS pos2"
_BASE = f"""{LV}, a0 AS (SELECT o_orderkey, bctg AS q1, bpos AS p1, ctg3 AS q2, pos3 AS p2, {_links(1)}, {_links(2)}, ctg3 AS kctg, pos3 AS kpos, ext3 AS kext, vague3 AS kvague, {', '.join(f'{v} AS {k}' for k, v in _MORE.items())},
 repetitive AS left2, low_breaks_hard AS right2, has_over AND over16 * 6 / 101.0 BETWEEN 0.25 AND 0.8 AS full1, false AS full2, CASE WHEN has_over THEN over16 * 6 / 101.0 ELSE 0 END AS over1, {_COUNTS_SQL}, {_TEXT} AS text1 FROM lv)"""
_SIDE2 = "1 AS one"


def _common(i: int) -> str:
    return f"short_indel{i} AS indel{i}, paired_soft{i} + paired_hard{i} + unpaired_soft{i} AS brk{i}, normal_spans{i} AS span{i}, mate_support{i} AS bpmate{i}, CASE WHEN exp{i} > 0 THEN mate{i} / exp{i} ELSE 1.0 END AS m{i}"


def _type(p2: str, r1: str, r2: str) -> str:
    return f"""CASE WHEN q1 <> q2 OR p1 = {p2} THEN 'TRA' WHEN inv THEN 'INV' WHEN CASE WHEN p1 < {p2} THEN {r1} AND NOT {r2} ELSE {r2} AND NOT {r1} END THEN 'DEL' WHEN CASE WHEN p1 < {p2} THEN {r2} AND NOT {r1} ELSE {r1} AND NOT {r2} END THEN 'DUP' ELSE 'TRA' END AS type,
 CASE WHEN q1 <> q2 THEN -1 ELSE abs(p1 - {p2}) END AS size, q1 <> q2 AS inter"""


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN NULL ELSE ({a}) / ({b}) END"


def _share(i: int, support: str) -> str:
    poor, event = f"(low_spans_soft{i} + low_breaks_soft{i} + repetitive{i})", f"({support} + unpaired_soft{i})"
    return f"{_ratio(poor, f'({poor} + {event})')} AS ar{i}, {_ratio(event, f'({event} + normal_spans{i})')} AS cl{i}"


def _status(i: int, common: str, good: str) -> str:
    return f"CASE WHEN cl{i} >= 0.85 THEN 'HOMO' WHEN cl{i} >= 0.05 THEN 'HETERO' WHEN {common} THEN 'EXTREME_SUBCLONAL' WHEN distant AND ({good}) THEN 'SUBCLONAL' ELSE 'EXTREME_SUBCLONAL' END AS status{i}"


def _good(i: int, a: float, b: float) -> str:
    return f"(mate{i} > 9 AND m{i} >= {a}) OR (mate{i} > 4 AND m{i} >= {b})"


def _control(i: int) -> str:
    return f"CASE WHEN xfar{i} AND {_near(i)} THEN greatest(gc{i}, kc) ELSE gc{i} END AS gl{i}"


def _hits(i: int, level: str) -> str:
    return f"{_near(i)} AS match{i}, CASE WHEN {_near(i)} AND hits > hc{i} THEN hits WHEN (strict1 OR strict2) AND {level} < 3 THEN hc{i} + wide{i} ELSE hc{i} END AS h{i}"


def _split(i: int, zero: str) -> str:
    t = f"CASE WHEN {zero} THEN 0 ELSE 2 END"
    return f"CAST(sup{i} > {t} OR (sure AND sup{i} > 0 AND sec{i} > {t}) AS INT) + CAST(sec{i} > {t} OR (sure AND sec{i} > 0 AND sup{i} > {t}) AS INT)"


def _artifact() -> str:
    over = lambda x: f"(ar1 > {x} AND ar2 > {x})"
    either = lambda x: f"(coalesce(ar1 > {x}, false) OR coalesce(ar2 > {x}, false))"
    return f"CASE WHEN ar1 < 0.33 AND ar2 < 0.33 THEN 'CLEAN' WHEN {over(0.85)} THEN 'ARTIFACT' WHEN {either(0.85)} AND NOT (e1 >= 2 OR e2 >= 2) THEN 'ARTIFACT' WHEN {over(0.5)} AND h1 > 5 THEN 'ARTIFACT' WHEN {either(0.5)} AND (status1 = 'EXTREME_SUBCLONAL' OR status2 = 'EXTREME_SUBCLONAL') THEN 'ARTIFACT' ELSE 'BORDERLINE' END AS artifact"


_GERM = ", ".join(f"gl{i} > 0.15 OR (gl{i} > 0 AND h{i} > 5) AS germ{i}" for i in (1, 2))


def _level(i: int) -> str:
    j = 3 - i
    t1, t2 = f"(prone{i} OR (sui1 AND sui2) OR m1 + m2 < 1.1)", f"(sui{i} AND cand{i})"
    least = f"CASE WHEN {t1} AND {t2} THEN 9 WHEN {t1} OR {t2} THEN 4 WHEN sui{i} OR fuzzy{i} THEN 2 ELSE 0 END"
    share = f"CASE WHEN {t1} THEN 0.8 WHEN {t2} OR sui{i} OR fuzzy{i} OR cand{i} THEN 0.6 WHEN mate{i} < 10 THEN 0.4 ELSE 0.33 END"
    return f"""s{i} + CASE WHEN xfar{i} AND mate{i} > {least} AND m{i} >= {share} THEN CASE WHEN s{i} < 2 AND (comp{i} OR (NOT "semi" AND comp{j})) AND NOT (sui1 AND sui2) AND sure AND (mate{i} > 2 OR exp{i} = mate{i}) THEN 2 ELSE 1 END ELSE 0 END AS e{i}"""


_STAND_IN = """CASE WHEN xfar1 THEN greatest(1, round(p1 - 151.5)) ELSE p1 END AS lpos2, CASE WHEN xfar1 THEN floor(p1 + 151.5) ELSE p1 END AS lext2, q1 AS lctg2, inv1 AS inv2, 0 AS sup2, 0 AS sec2, 0 AS mate2, 0 AS exp2, susp1 AS susp2, sui1 AS sui2, prone1 AS prone2, xfar1 AS fuzzy2, xfar1 AS strict2, true AS cand2, xfar1 AS xfar2, true AS lright2"""


def sql(made: dict[str, str], unknown_score: str, scored: str) -> dict[str, str]:
    """SQL of the queries above; made has that of the reasons and scores of given columns."""
    reason = lambda name: made[name].rsplit("SELECT o_orderkey, ", 1)[1].rsplit(" AS reason FROM ev", 1)[0]
    both, one, none = reason("reason_codes"), reason("reason_codes_one_sided"), reason("reason_codes_unknown")
    tail = made["event_scores"].split(scored, 1)[1]
    scores, picked = tail.split(" SELECT o_orderkey, ", 1)
    named = "*, q1 AS ctg1, q2 AS ctg2, p1 AS pos1, p2 AS pos2"

    def finish(chain: str, kind: str, early: str = "false") -> str:
        plain = "type, CAST(size AS BIGINT) AS size, inv, distant, " + ", ".join(f"CAST({k} AS BIGINT) AS {k}" for k in ("e1", "e2", "ev1", "ev2", "h1", "h2")) + ", germ1, germ2, germline, status1, artifact"
        return f"""{chain}, u AS (SELECT *, {unknown_score} AS unknown FROM ev){scores}, sc AS (SELECT o_orderkey, {picked})
 SELECT o_orderkey, {plain}, CAST(reason AS INT) AS reason, CAST(CASE WHEN {early} THEN 0 ELSE sc.{kind} END AS INT) AS score FROM ev JOIN sc USING (o_orderkey)"""

    apart = "CASE WHEN NOT inter AND p1 = p2 THEN 3 ELSE"
    two = f"""WITH {_BASE}, a1 AS (SELECT *, {_common(1)}, {_common(2)}, inv1 OR inv2 AS inv, sui1 OR sui2 AS "semi", sup1 + sec1 + mate1 AS ev1, sup2 + sec2 + mate2 AS ev2, 0 AS over2 FROM a0), a2 AS (SELECT *, {_type('p2', 'lright1', 'lright2')} FROM a1),
 a3 AS (SELECT *, (inter OR exp1 > 0 OR exp2 > 0 OR size > 1500) AND NOT (NOT inter AND (fuzzy1 OR cand1 OR fuzzy2 OR cand2) AND size < 5000) AS distant, {_share(1, 'ev1')}, {_share(2, 'ev2')}, {_control(1)}, {_control(2)}, NOT prone1 AND NOT prone2 AS sure FROM a2),
 a4 AS (SELECT *, {_status(1, 'hc1 > 5 AND hc2 > 5', f'{_good(1, 0.4, 0.6)} OR {_good(2, 0.4, 0.6)}')}, {_status(2, 'hc1 > 5 AND hc2 > 5', f'{_good(1, 0.4, 0.6)} OR {_good(2, 0.4, 0.6)}')},
 {_split(1, 'sure AND NOT sui1 AND m1 >= 0.6')} AS s1, {_split(2, 'sure AND NOT sui2 AND m2 >= 0.6')} AS s2 FROM a3),
 a5 AS (SELECT *, status1 <> 'EXTREME_SUBCLONAL' AND xfar1 AND full1 AS comp1, status2 <> 'EXTREME_SUBCLONAL' AND xfar2 AND full2 AS comp2 FROM a4), a6 AS (SELECT *, {_level(1)}, {_level(2)} FROM a5), a7 AS (SELECT *, {_hits(1, 'e1')}, {_hits(2, 'e2')} FROM a6),
 a8 AS (SELECT *, {_GERM}, {_artifact()} FROM a7), a9 AS (SELECT {named}, (germ1 OR germ2) AND NOT (sup1 + sec1 > 200 AND sup1 + sec2 > 200) AS germline FROM a8),
 b1 AS (SELECT *, {apart} {both} END AS r_two, {apart} {none} END AS r_none FROM a9), b2 AS (SELECT *, NOT sui1 AND sui2 AND r_none = 0 AND r_two <> 0 AS alone_ok FROM b1),
 ev AS (SELECT * EXCLUDE ("semi"), CASE WHEN alone_ok THEN 0 ELSE r_two END AS reason, "semi" AND NOT alone_ok AS "semi" FROM b2)"""
    other = f"{_BASE}, z0 AS (SELECT * EXCLUDE (lctg2, lpos2, lext2, lright2, inv2, sup2, sec2, mate2, exp2, susp2, sui2, prone2, fuzzy2, strict2, cand2, xfar2) FROM a0), z1 AS (SELECT *, {_STAND_IN} FROM z0)"
    single = f"""WITH {other}, a1 AS (SELECT *, {_common(1)}, {_common(2)}, inv1 AS inv, sui1 AS "semi", false AS comp1, false AS comp2, 0 AS over2 FROM z1), a2 AS (SELECT *, {_type('p2', 'lright1', '(left2 > right2)')} FROM a1),
 a3 AS (SELECT *, (inter OR exp1 > 0 OR size > 1500) AND NOT (NOT inter AND (fuzzy1 OR cand1) AND size < 5000) AND NOT (size BETWEEN 1 AND 999) AS distant, {_control(1)}, gc2 AS gl2, NOT prone1 AS sure, xfar1 AND m1 >= 0.4 AND (NOT (prone1 OR sui1 OR cand1) OR mate1 > 4) AS mm1, xfar1 AND bpmate2 > 4 AS mm2 FROM a2),
 a4 AS (SELECT *, {_split(1, 'sure AND NOT sui2 AND m1 >= 0.66')} + CAST(mm1 AS INT) AS f1, CAST(paired_soft2 + unpaired_soft2 > 0 AS INT) + CAST(paired_hard2 + unpaired_hard2 > 0 AS INT) + CAST(mm2 AS INT) AS f2 FROM a3), a5 AS (SELECT *, {_hits(1, 'f1')}, {_hits(2, 'f2')} FROM a4),
 a6 AS (SELECT *, {_GERM}, paired_soft2 + paired_hard2 + unpaired_soft2 + unpaired_hard2 AS k2, f1 - CAST(NOT distant AND mm1 AS INT) AS e1, f2 - CAST(NOT distant AND mm2 AS INT) AS e2, {_share(1, 'sup1 + sec1 + mate1')}, {_share(2, 'brk2')} FROM a5),
 a7 AS (SELECT *, (germ1 OR germ2) AND NOT (sup1 + sec1 > 200 AND k2 > 200) AS germline, sup1 + sec1 + CASE WHEN NOT distant AND mm1 THEN 0 ELSE mate1 END AS ev1, k2 + indel2 + CASE WHEN NOT distant AND mm2 THEN 0 ELSE bpmate2 END AS ev2,
 {_status(1, 'h1 > 5 AND h2 > 5', _good(1, 0.5, 0.8))}, {_status(2, 'h1 > 5 AND h2 > 5', _good(1, 0.5, 0.8))} FROM a6), a8 AS (SELECT {named}, {_artifact()} FROM a7), ev AS (SELECT *, {apart} {one} END AS reason FROM a8)"""
    alone = f"""WITH {other.replace('FROM a0), z1', ', lctg1 AS cc, lpos1 AS pp FROM a0), z1')}, z2 AS (SELECT * EXCLUDE (q2, p2, cc, pp), cc AS q2, pp AS p2 FROM z1), a1 AS (SELECT *, {_common(1)}, {_common(2)}, inv1 AS inv, sui1 AS "semi", false AS comp2, 0 AS over2, CASE WHEN q1 = q2 AND abs(p1 - p2) > abs(p1 - lext1) THEN lext1 ELSE p2 END AS pe FROM z2),
 a2 AS (SELECT *, {_type('pe', 'lright1', '(NOT lright1)')}, lext1 - lpos1 AS wid FROM a1), a3 AS (SELECT *, (inter OR exp1 > 0 OR size > 2500) AND NOT (fuzzy1 AND NOT inter AND cand1 AND ((greatest(0, p1 - wid) <= lext1 AND lpos1 <= p1 + wid) OR size < 5000)) AND NOT (size BETWEEN 1 AND 1999) AS distant,
 {_control(1)}, gc2 AS gl2, NOT prone1 AS sure, {_share(1, 'sup1 + sec1 + mate1')}, xfar1 AND m1 >= 0.4 AND (NOT (cand1 OR prone1) OR mate1 > 4) AS mm1 FROM a2), a4 AS (SELECT *, {_status(1, 'hc1 > 5', _good(1, 0.5, 0.8))}, {_split(1, 'sure AND m1 >= 0.66')} AS s1 FROM a3),
 a5 AS (SELECT *, status1 <> 'EXTREME_SUBCLONAL' AND xfar1 AND full1 AS comp1 FROM a4), a6 AS (SELECT *, s1 + CAST(mm1 AS INT) + CAST(mm1 AND s1 < 2 AND comp1 AND sure AND (mate1 > 2 OR exp1 = mate1) AS INT) AS f1 FROM a5), a7 AS (SELECT *, {_hits(1, 'f1')}, {_hits(2, '0')} FROM a6),
 a8 AS (SELECT {named}, {_GERM}, CASE WHEN distant THEN f1 ELSE s1 END AS e1, 0 AS e2, 0 AS ev2, sup1 + sec1 + CASE WHEN NOT distant AND mm1 THEN 0 ELSE mate1 END AS ev1, '' AS status2, CASE WHEN ar1 < 0.33 THEN 'CLEAN' WHEN ar1 > 0.5 THEN 'ARTIFACT' ELSE 'BORDERLINE' END AS artifact, NOT inter AND NOT distant AND type = 'TRA' AS early FROM a7),
 ev AS (SELECT *, (germ1 OR germ2) AND NOT (sup1 + sec1 > 200) AS germline, CASE WHEN early THEN 3 ELSE {none} END AS reason FROM a8)"""
    sign = lambda i: f"concat(CASE WHEN lright{i} THEN '|' ELSE '' END, lctgname{i}, ':', lpos{i}, CASE WHEN lpos{i} <> lext{i} THEN concat('-', lext{i}) ELSE '' END, CASE WHEN inv{i} THEN '_INV' ELSE '' END, CASE WHEN lright{i} THEN '' ELSE '|' END, '(', sup{i}, ',', sec{i}, ',', CASE WHEN susp{i} THEN '!' ELSE concat(mate{i}, CASE WHEN sui{i} THEN '?' ELSE '' END) END, '/', exp{i}, ')', CASE WHEN prone{i} THEN '#' ELSE '' END)"
    origin = lambda i: f"concat(CASE WHEN NOT germ{i} THEN 'SOMATIC' WHEN germline OR h{i} > 5 THEN 'GERMLINE' ELSE 'RESCUED' END, '(', h{i}, '/40):', printf('%.3f', CAST(gl{i} AS DOUBLE)))"
    share = lambda i: f"CASE WHEN ev{i} + span{i} = 0 THEN '{'0.000' if i == 2 else '-nan'}' ELSE printf('%.3f', ev{i} / (ev{i} + span{i})) END"
    line = f"""{two}, u AS (SELECT *, {unknown_score} AS unknown FROM ev){scores}, sc AS (SELECT o_orderkey, {picked}), nm AS (SELECT *, q2 AS lctgname1, q1 AS lctgname2 FROM ev)
 SELECT o_orderkey, concat_ws(chr(9), q1, p1 - 1, p1, q2, p2 - 1, p2, {origin(1)}, {origin(2)}, type, CASE WHEN reason = 0 THEN sc.two_sided ELSE -reason END, CASE WHEN size > 0 THEN CAST(size AS VARCHAR) ELSE 'NA' END, CASE WHEN inv THEN 'INV' ELSE 'NORMAL' END,
 ev1, {share(1)}, ev2, {share(2)}, {sign(1)}, {sign(2)}, coalesce(text1, '.'), '.') AS line FROM nm JOIN sc USING (o_orderkey)"""
    return {"two_sided_events": finish(two, "two_sided"), "one_sided_events": finish(single, "one_sided"), "unknown_events": finish(alone, "unknown", "early"), "event_rows": line}


QUERIES = {f.__name__: f for f in (two_sided_events, one_sided_events, unknown_events, event_rows)}
