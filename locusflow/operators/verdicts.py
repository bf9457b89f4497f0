"""Reasons against events with one known side, their scores, and the two cascades that look at all events of a sample.

Columns are those of events.two_sided_reasons(), and: inv, type, and for each side i: cand (strictly fuzzy candidate), ev
(splits and mates together), ctg (contig index), span (normal spans), bpmate (mates of the position), over (overhang
ratio). Scores use distant, semi and the columns of the sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import holds

#: Contig indices of the decoy and of the viral contig (fixed values).
DECOY, VIRAL = 999, 1000


def _one_locus() -> list[tuple[int, Column]]:
    c = F.col
    return [(1, c("susp1") | c("sui1")), (2, (c("exp1") > 0) & (c("m1") < 0.1))]


def _tiny(read_length: int) -> Column:
    return ((F.col("size") > 0) & (2 * F.col("size") < read_length)) | (F.col("type") == "TRA")


def one_sided_reasons(limit: int = 5, read_length: int = 101, bpfreq: float = 3.0, no_control: bool = False) -> list[tuple[int, Column]]:
    """Reasons against an event whose partner position exists but has no link back, in order; for events.first_reason()."""
    c = F.col
    far, local = c("distant"), ~c("distant")
    usual = lambda i: c(f"h{i}") > limit
    proper = lambda i: ~c(f"ctg{i}").isin(DECOY, VIRAL)
    splits, bad = c("sup1") + c("sec1"), F.lit(no_control) | c("germ1") | c("germ2")
    vague = far & ~c("inter") & (c("fuzzy1") | (splits < 3))
    seen = lambda a, b, contigs: (c(f"h{a}") > bpfreq) & (contigs | (c(f"h{b}") > bpfreq) | (c(f"h{a}") > 3 * bpfreq) | bad | usual(b))
    return [
        *_one_locus(),
        (171, (usual(1) & proper(1)) | (usual(2) & proper(2))),
        (22, local & c("inv")),
        (23, local & _tiny(read_length)),
        (20, local & (c("size") > 150) & (2 * c("indel1") > c("brk1"))),
        (21, local & (c("size") > 150) & (2 * c("indel2") > c("brk2"))),
        (25, local & (c("fuzzy1") | c("sui1") | (c("e1") == 1) | (splits < 3) | ((usual(1) | usual(2)) & (c("ev1") < 5)))),
        (18, far & ((F.greatest("sup1", "sec1", "mate1") < 3) | (c("inter") & (c("mate1") == 0)))),
        (19, far & c("inter") & (c("e1") == 1) & (c("bpmate2") == 0)),
        (24, far & ((c("mate1") < 3) | (c("m1") < 0.4))),
        (26, vague & (c("size") < 5000)),
        (27, vague & c("inv") & (c("size") < 10000)),
        (271, far & c("fuzzy1") & (splits == 0)),
        (28, (c("indel1") > c("brk1")) | (c("indel2") > c("brk2"))),
        (39, c("status1") == "EXTREME_SUBCLONAL"),
        (40, c("status2") == "EXTREME_SUBCLONAL"),
        (41, c("artifact") == "ARTIFACT"),
        (42, bad & usual(1) & usual(2)),
        (431, seen(1, 2, (c("ctg1") != DECOY) | (c("ctg2") == DECOY))),
        (432, seen(2, 1, (c("ctg1") == DECOY) | (c("ctg2") != DECOY))),
    ]


def unknown_reasons(limit: int = 5, read_length: int = 101, bpfreq: float = 3.0, no_control: bool = False) -> list[tuple[int, Column]]:
    """Reasons against an event without a partner position, in order; side 2 is the place the link names."""
    c = F.col
    far, local = c("distant"), ~c("distant")
    u1, u2 = c("h1") > limit, c("h2") > limit
    splits, germ = c("sup1") + c("sec1"), c("germ1") | c("germ2")
    vague = c("fuzzy1") | c("cand1")
    return [
        *_one_locus(),
        (29, c("brk1") + c("mate1") + c("span1") < 10),
        (301, u1 & ~c("ctg1").isin(DECOY, VIRAL)),
        (302, u2 & ~c("ctg2").isin(DECOY, VIRAL)),
        (30, local & (c("inv") | (c("ev1") < 5) | (c("e1") == 1))),
        (31, local & (_tiny(read_length) | vague | c("sui1") | ((u1 | u2) & (c("ev1") < 5)))),
        (18, far & (F.greatest("sup1", "sec1", "mate1") < 3)),
        (32, far & (c("mate1") < 3) & ((u1 & u2) | ((c("e1") < 3) & (c("sup1") < 5)))),
        (33, far & ((c("m1") < 0.33) | ((c("e1") != 3) & (c("ev1") < 5) & (c("m1") < 0.5)))),
        (36, far & vague & (splits == 0)),
        (38, c("indel1") > c("brk1")),
        (44, c("status1") == "EXTREME_SUBCLONAL"),
        (45, c("artifact") == "ARTIFACT"),
        (46, F.lit(no_control) & u1 & u2),
        (47, F.lit(not no_control) & germ & (u1 | u2)),
        (471, (c("h1") > bpfreq) & ((c("ctg1") != DECOY) | (c("ctg2") == DECOY) | (c("h2") > bpfreq) | (c("h1") > 3 * bpfreq) | F.lit(no_control) | germ | u2)),
        (472, c("h2") > bpfreq),
    ]


def contaminated(side: int, limit: int = 5) -> Column:
    """Many supporting splits without the rest, at a place that the panel knows."""
    c = F.col
    own, other = c(f"h{side}") > limit, c(f"h{3 - side}") > limit
    sup, mate = c(f"sup{side}"), c(f"mate{side}")
    lone = lambda least: (c(f"sec{side}") < 10) & (((sup > least) & (mate < 10)) | ((sup > 100) & (mate < 20)))
    return holds(c("distant") & ((own & other & lone(30)) | (own & ~other & lone(50))))


def _clip_only() -> Column:
    """Hard clips alone tell of the link."""
    return (F.col("sup1") == 0) & (F.col("sec1") > 0) & (F.col("mate1") <= F.col("sec1") + 4)


def unknown_score(limit: int = 5) -> Column:
    c = F.col
    many = ((c("mate1") > 9) & (c("m1") >= 0.5)) | ((c("mate1") > 5) & (c("exp1") - c("mate1") < 3))
    vague = c("fuzzy1") | c("cand1")
    good = F.when(vague, ((c("e1") == 3) | ~c("cand1")) & many & ((c("h1") == 0) | (c("h2") == 0))).otherwise(~_clip_only() & ((c("sup1") > 4) | (c("e1") == 3) | (c("mate1") > 9)))
    return F.when(holds(c("distant") & ~contaminated(1, limit) & good), 4).otherwise(1)


def one_sided_score(limit: int = 5) -> Column:
    c = F.col
    by_level = lambda low: F.when(c("e1") == 3, 3).otherwise(low)
    weak = ~c("distant") & ((c("ev1") < 5) | (c("sup1") < 2) | (c("sec1") < 2))
    return F.when(contaminated(1, limit), 1).when(c("distant") & (c("fuzzy1") | c("cand1")), by_level(0)).when(weak, 1).when(~_clip_only() & ~c("cand1"), by_level(1)).otherwise(0)


def two_sided_score(limit: int = 5) -> Column:
    """Score of an event with links both ways. A partner that is in doubt leaves the event to its first link alone."""
    c = F.col
    (e1, e2), (m1, m2), (n1, n2) = ((c(f"{k}1"), c(f"{k}2")) for k in ("e", "m", "mate"))
    alone = F.when(unknown_score(limit) > 2, unknown_score(limit)).otherwise(2)
    unseen, sure = (c("h1") == 0) & (c("h2") == 0), ~c("prone1") & ~c("prone2")
    strong = holds((m1 >= 0.8) & (m2 >= 0.8)) & (n1 > 4) & (n2 > 4)
    local = F.when((c("ev1") < 5) & (c("ev2") < 5), F.when((c("h1") > limit) | (c("h2") > limit), 1).otherwise(3)).otherwise(5)
    both = c("fuzzy1") & c("fuzzy2")
    doubted = holds(((n1 < 10) & (m1 < 0.5)) | ((n2 < 10) & (m2 < 0.5)) | (((n1 < 10) | (n2 < 10)) & (m1 + m2 < 1.1)))
    low = (
        F.when(doubted, 2)
        .when((e1 <= 1) & (e2 <= 1), F.when(~c("semi") & unseen & sure & strong & ((n1 > 9) | (n2 > 9)), 3).otherwise(2))
        .when(e2 == 1, F.when(holds(m2 >= 0.8) & (n2 > 9), alone).otherwise(2))
        .when(e1 == 1, F.when(holds((m1 >= 0.8) & (m2 >= 0.6)) & (n1 > 9), 5).otherwise(2))
        .otherwise(F.when(~c("semi") & (c("h1") < limit) & (c("h2") < limit) & sure & strong, 5).otherwise(2))
    )
    return (
        F.when(~c("distant"), local)
        .when(contaminated(1, limit) | contaminated(2, limit), 2)
        .when(c("sui1") & ((e1 < 3) | (((c("sec1") == 0) | (c("sup1") == 0)) & (e2 == 0))), 2)
        .when(c("sui2") & (e1 < 3), alone)
        .when(both & ~c("semi") & unseen & sure & ((e1 > 1) | (e2 > 1)) & holds((m1 > 0.5) & (m2 > 0.5)), 3)
        .when(both & ((e1 < 3) | (e2 < 3)), 2)
        .when((c("fuzzy1") != c("fuzzy2")) & (e1 < 2) & (e2 < 2), 2)
        .when((e1 < 3) & (e2 < 3), low)
        .otherwise(5)
    )


def drop_inversions(events: DataFrame, share: float = 0.7, least: int = 300, least_strict: int = 200) -> tuple[DataFrame, int]:
    """Events without the doubtful ones of a sample in which inversions swamp all else, and how many passes were needed (0-2).

    events has reason, score and grade (of contamination) besides. What triggers a pass is two counts over all events, so
    nothing but numbers reaches the driver.
    """
    c = F.col
    e1, e2, s1, s2 = c("e1"), c("e2"), c("sup1"), c("sup2")
    semi1, semi2 = c("sui1"), c("sui2")
    thin1, thin2 = c("ev1") < 5, c("ev2") < 5
    held = (c("reason") == 0) & (c("grade") == 0)

    def doubtful(strict: bool) -> Column:
        far = (c("prone1") & (c("mate1") < 6)) | (c("prone2") & (c("mate2") < 6)) | (
            c("semi") & ((c("score") < 3) | (semi1 & semi2) | (semi1 & (e2 < 3) & ((e1 < 3) | (s1 < 5))) | (semi2 & (e1 < 3) & ((e2 < 3) | (s2 < 5)))))
        out = F.when(c("distant"), far).otherwise((c("score") == 3) | (e2 == 0))
        kind = (c("cand1") | c("cand2") | c("semi")) if strict else (c("cand1") & c("cand2"))
        near = (c("size") > 0) & (c("size") < 10000)
        thin = F.when(near, F.lit(strict) | thin1 | thin2).otherwise(thin1 & thin2)
        out = out | (c("inv") & (kind | (c("score") < 3) | holds((c("m1") < 0.6) & (c("m2") < 0.6)) | thin))
        if strict:
            weak1 = (e1 < 3) | (s1 < 5)
            far = (c("prone1") & (c("prone2") | (e2 == 0)) & ((s1 < 5) | (s2 < 5) | ((c("sec1") < 3) & (c("sec2") < 3)))) | (semi1 & weak1) | (semi2 & ((e2 < 3) | (s2 < 5))) | ((e2 == 0) & weak1) | ((e1 < 3) & (e2 < 3))
            out = (
                out | ((e2 == 0) & ((s1 < 10) | ~c("comp1"))) | ((c("score") == 3) & ((s1 < 10) | (c("sec1") < 5) | (c("distant") & (c("mate1") < 10))))
                | F.when(c("distant"), far).otherwise((e1 < 2) | (e2 < 2) | (thin1 & thin2)) | (thin2 & (e1 < F.when(c("distant"), 3).otherwise(2)))
            )
        return holds(held & out)

    level = 0
    for strict, many in ((False, least), (True, least_strict)):
        one = holds(held & (c("score") > 2))
        turned = c("inv") | c("semi") | (e2 == 0) if strict else c("inv") | c("semi")
        n = events.agg(F.count_if(one).alias("n"), F.count_if(one & turned).alias("k")).first()  # two numbers
        if not (n["n"] > many and n["k"] > share * n["n"]):
            break
        events, level = events.where(~doubtful(strict)), level + 1
    return events, level


def contamination(kind: Column, score: Column, reason: Column, grade1: Column, grade2: Column) -> Column:
    """Whether an event may come of foreign sequence: 2 surely, 1 by both sides a little, 0 not."""
    known = (reason == 0) & (score > 2)
    return F.when(known & ((kind == "CONTAMINATION") | (grade1 > 1) | (grade2 > 1)), 2).when(known & (grade1 == 1) & (grade2 == 1), 1).otherwise(0)


def mark_contamination(events: DataFrame, flag_above: int = 9, act_above: int = 19) -> tuple[DataFrame, bool]:
    """Events with type and score put down where a sample is contaminated, and whether it is. events has grade1, grade2, reason, score."""
    c = F.col
    events = events.withColumn("grade", contamination(c("type"), c("score"), c("reason"), c("grade1"), c("grade2")))
    n = events.agg(F.count_if((c("grade") == 2) & (c("reason") == 0) & (c("score") >= 3)).alias("n")).first()["n"]  # one number
    if n > act_above:
        odd = lambda i: ((c(f"sup{i}") > 19) & (c(f"sec{i}") < 3)) | (c(f"over{i}") > 0.7)
        hit = holds((c("reason") == 0) & (c("score") >= 2) & ((c("grade") > 0) | odd(1) | odd(2)))
        events = events.withColumns({"score": F.when(hit, 1).otherwise(c("score")), "type": F.when(hit, "CONTAMINATION").otherwise(c("type"))})
    return events, n > flag_above
