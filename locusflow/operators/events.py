"""Classification of rearrangement events: type, clonality, artefacts, mate tiers, contamination, reasons, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import holds, ratio


def event_type(c1: Column, p1: Column, right1: Column, c2: Column, p2: Column, right2: Column, inverted: Column) -> Column:
    """TRA, INV, DEL or DUP from order, sides and inversion."""
    before = p1 < p2
    lower, upper = F.when(before, right1).otherwise(right2), F.when(before, right2).otherwise(right1)
    return F.when((c1 != c2) | (p1 == p2), "TRA").when(inverted, "INV").when(lower & ~upper, "DEL").when(~lower & upper, "DUP").otherwise("TRA")


def event_size(c1: Column, p1: Column, c2: Column, p2: Column) -> Column:
    return F.when(c1 != c2, -1).otherwise(F.abs(p1 - p2))


def clonality(evidence: Column, spans: Column) -> Column:
    return ratio(evidence, evidence + spans)


def clonality_status(r: Column, both_common: Column, distant: Column, mates: Column, mate_ratio: Column, low: float = 0.05, high: float = 0.85, a: float = 0.4, b: float = 0.6) -> Column:
    good = ((mates > 9) & holds(mate_ratio >= a)) | ((mates > 4) & holds(mate_ratio >= b))
    return F.when(holds(r >= high), "HOMO").when(holds(r >= low), "HETERO").when(both_common, "EXTREME_SUBCLONAL").when(distant & good, "SUBCLONAL").otherwise("EXTREME_SUBCLONAL")


def artifact_status(r1: Column, r2: Column, e1: Column, e2: Column, common1: Column, extreme: Column, low: float = 0.33, high: float = 0.5) -> Column:
    over = lambda x: holds((r1 > x) & (r2 > x))
    either = lambda x: holds(r1 > x) | holds(r2 > x)
    return (
        F.when(holds((r1 < low) & (r2 < low)), "CLEAN").when(over(0.85), "ARTIFACT").when(either(0.85) & ~((e1 >= 2) | (e2 >= 2)), "ARTIFACT")
        .when(over(high) & common1, "ARTIFACT").when(either(high) & extreme, "ARTIFACT").otherwise("BORDERLINE")
    )


def mate_tier(error_prone: Column, semi: Column, strict: Column, fuzzy: Column, both_semi: Column, ratio_sum: Column, mates: Column, category: int = 2) -> Column:
    """struct(least mates, least ratio) that a locus must reach."""
    t1 = error_prone | both_semi | holds(ratio_sum < 1.1)
    t2 = semi & strict
    pair = lambda m, r: F.struct(F.lit(m).alias("min_mates"), F.lit(r).alias("min_ratio"))
    return F.when(t1 & t2, pair(9, 0.8)).when(t1 | F.lit(category == 0), pair(4, 0.8)).when(t2, pair(4, 0.6)).when(semi | fuzzy, pair(2, 0.6)).when(strict, pair(0, 0.6)).when(mates < 10, pair(0, 0.4)).otherwise(pair(0, 0.33))


def contamination_grade(overhang_ratio: Column, secondary: Column, one_sided: Column) -> Column:
    return F.when(secondary > 4, 0).when((overhang_ratio > 0.7) & (secondary == 0), 3).when((overhang_ratio > 0.7) & ((secondary < 3) | (one_sided & (secondary < 10))), 2).when((overhang_ratio > 0.6) & (secondary < 3), 1).otherwise(0)


def count_repair(spans: str, left: str, right: str, paired: str, unpaired: str) -> dict[str, Column]:
    """Spans beyond the lower coverage become paired breaks, or unpaired ones where there are none paired."""
    excess = F.greatest(F.lit(0), F.col(spans) - F.least(left, right))
    has = F.col(paired) > 0
    return {spans: F.col(spans) - excess, paired: F.col(paired) + F.when(has, excess).otherwise(0), unpaired: F.col(unpaired) + F.when(has, 0).otherwise(excess)}


def first_reason(rules: list[tuple[int, Column]]) -> Column:
    """Code of the first rule that holds, 0 if none does. Undefined comparisons don't hold."""
    out = None
    for code, rule in rules:
        out = F.when(holds(rule), code) if out is None else out.when(holds(rule), code)
    return out.otherwise(0)


def two_sided_reasons(limit: int = 5, read_length: int = 101, bpfreq: float = 3.0, no_control: bool = False) -> list[tuple[int, Column]]:
    """Reasons against an event with links both ways, in order. Columns: semi, distant, inter (contigs differ), size,
    bridged (no control or either side germline), and for each side i: susp, sui (semi-suspicious), e, m (mate ratio), h
    (panel hits), sup, sec, mate, exp, fuzzy, strict, prone, comp, cl (clonality), indel, brk, status, germ, match; artifact."""
    c = F.col
    s = lambda name: (c(f"{name}1"), c(f"{name}2"))
    (e1, e2), (m1, m2), (h1, h2), (f1, f2), (t1, t2) = s("e"), s("m"), s("h"), s("fuzzy"), s("strict")
    (sup1, sup2), (sec1, sec2), (mate1, mate2), (p1, p2), (q1, q2) = s("sup"), s("sec"), s("mate"), s("prone"), s("sui")
    common1, common2 = h1 > limit, h2 > limit
    total1, total2 = sup1 + sec1 + mate1, sup2 + sec2 + mate2
    local, far, prone = ~c("distant"), c("distant"), p1 | p2
    t = F.when(c("semi") | prone, 5).otherwise(3)
    either_fuzzy = f1 | f2
    control_bad = F.lit(no_control) | c("germ1") | c("germ2")

    def frequent(h, other, e, other_e, match):
        rare = ~match & (e == 3) & (other_e > 1) & (other == 0) & ~either_fuzzy
        return ((h > bpfreq) & (control_bad | (other > limit))) | (h > 7.5 * bpfreq) | ((h > 3 * bpfreq) & ~rare)

    return [
        (1, c("susp1") | c("susp2") | (q1 & q2 & ~((e1 == 3) & (e2 == 3)))),
        (2, ((c("exp1") > 0) & (m1 < 0.1)) | ((c("exp2") > 0) & (m2 < 0.1))),
        (4, common1 & q1 & (e1 < 3) & ~((sup1 > 9) | (sec1 > 9) | (mate1 > 9) | c("comp1"))),
        (5, common2 & q2 & (e2 < 3) & ~((sup2 > 9) | (sec2 > 9) | (mate1 > 9) | c("comp2"))),
        (4, common1 & common2 & (c("cl1") < 0.2) & (c("cl2") < 0.2)),
        (5, common1 & common2 & ~(c("germ1") & c("germ2")) & (c("size") > 0) & (2 * c("size") < read_length)),
        (13, local & (c("semi") | t1 | t2 | ((common1 | common2) & ((total1 < 5) | (total2 < 5))))),
        (6, far & c("inter") & (m1 == 0)),
        (7, far & c("inter") & (m2 == 0)),
        (8, far & (F.greatest(sup1, sec1, mate2, sup2, sec2) < t)),
        (11, far & (m1 < 0.4) & (m2 < 0.4)),
        (12, far & ((m1 < 0.25) | (m2 < 0.25))),
        (14, far & either_fuzzy & ~c("inter") & (t1 | t2) & (c("size") < 5000)),
        (173, far & either_fuzzy & (common1 | common2)),
        (174, far & f1 & f2 & ((m1 < 0.5) | (m2 < 0.5))),
        (175, far & f1 & (sup1 + sec1 == 0) & q2),
        (176, far & f2 & (sup2 + sec2 == 0) & q1),
        (16, (c("inter") | (c("size") > 150)) & ((c("indel1") > c("brk1")) | (c("indel2") > c("brk2")))),
        (39, c("status1") == "EXTREME_SUBCLONAL"),
        (40, c("status2") == "EXTREME_SUBCLONAL"),
        (41, c("artifact") == "ARTIFACT"),
        (42, control_bad & common1 & common2),
        (431, frequent(h1, h2, e1, e2, c("match1"))),
        (432, frequent(h2, h1, e2, e1, c("match2"))),
    ]


def unless_dominated(df: DataFrame, candidate: Column, dominated: Column, share: float, least: int, remove: Column) -> DataFrame:
    """df without the rows to remove, if among candidates more than a share is dominated and they are more than `least`."""
    n = df.agg(F.count_if(candidate).alias("n"), F.count_if(candidate & dominated).alias("d")).first()  # two numbers
    return df.where(~holds(remove)) if n["n"] > least and n["d"] > share * n["n"] else df
