"""Events from a position, one of its loci and what lies at the other end: with a link back, with a position only, with nothing.

Columns of an event: for each side i: ctg{i}, pos{i}, x{i} (locus), the counts b{i} (struct of sources.breakpoints.COUNTS), hc{i} and
ha{i} (panel hits nearby and in a wider search), panel{i} (array of panel loci, whose secondary count is their hits), gc{i} (clonality in the control),
control{i} (array of struct(locus, clonality)) and text{i} (overhangs, null without). They become the columns that events.two_sided_reasons() and
verdicts name, with reason and score; rows() writes them out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contigs, loci, numeric, partners, sequence
from ..functions.numeric import holds, ratio
from . import events, verdicts

LIMIT, READ_LENGTH = 5, 101
c = F.col


def _sided(i: int) -> dict[str, Column]:
    x, b = c(f"x{i}"), c(f"b{i}")
    return {
        f"susp{i}": x["suspicious"], f"sui{i}": x["semi_suspicious"], f"sup{i}": x["support"], f"sec{i}": x["secondary"], f"mate{i}": x["mates"], f"exp{i}": x["expected"], f"fuzzy{i}": x["fuzzy"], f"strict{i}": x["strict_fuzzy"],
        f"cand{i}": partners.few_splits(x), f"prone{i}": x["error_prone"], f"indel{i}": b["short_indel"], f"brk{i}": b["paired_soft"] + b["paired_hard"] + b["unpaired_soft"], f"span{i}": b["normal_spans"], f"bpmate{i}": b["mate_support"],
        f"over{i}": sequence.longest_overhang(c(f"text{i}")) / F.lit(float(READ_LENGTH)), f"full{i}": sequence.overhang_compensates(F.coalesce(c(f"text{i}"), F.lit("")), READ_LENGTH) & c(f"text{i}").isNotNull(),
    }


def _mate_ratio(i: int) -> Column:
    return F.when(c(f"exp{i}") > 0, c(f"mate{i}") / c(f"exp{i}").cast("double")).otherwise(1.0)


def _shares(i: int, support: Column) -> dict[str, Column]:
    """Clonality and share of artefacts of a position with so much support."""
    b = c(f"b{i}")
    poor, event = b["low_spans_soft"] + b["low_breaks_soft"] + b["repetitive"], support + b["unpaired_soft"]
    return {f"ar{i}": ratio(poor, poor + event), f"cl{i}": ratio(event, event + b["normal_spans"])}


def _status(i: int, common: Column, good: Column) -> Column:
    r = c(f"cl{i}")
    return F.when(holds(r >= 0.85), "HOMO").when(holds(r >= 0.05), "HETERO").when(common, "EXTREME_SUBCLONAL").when(c("distant") & good, "SUBCLONAL").otherwise("EXTREME_SUBCLONAL")


def _good(i: int, a: float, b: float) -> Column:
    return ((c(f"mate{i}") > 9) & (c(f"m{i}") >= a)) | ((c(f"mate{i}") > 4) & (c(f"m{i}") >= b))


def _control(i: int) -> Column:
    """Clonality in the control, of the first control locus that is close if that is more."""
    met = F.get(F.filter(f"control{i}", lambda g: partners.close(g["locus"], c(f"x{i}"), 6 * READ_LENGTH)), F.lit(0))["clonality"]
    return F.when(c(f"x{i}.distant"), F.greatest(c(f"gc{i}"), F.coalesce(met, c(f"gc{i}")))).otherwise(c(f"gc{i}"))


def _hits(i: int, level: Column) -> dict[str, Column]:
    """Panel hits of a side: those of panel loci close to its own if they are more than those nearby, else of the wider search where a locus is vague."""
    near = F.filter(f"panel{i}", lambda p: partners.close(p, c(f"x{i}"), 6 * READ_LENGTH))
    most = F.coalesce(F.array_max(F.transform(near, lambda p: p["secondary"])), F.lit(0))
    vague = (c("strict1") | c("strict2")) & (level < 3)
    return {f"match{i}": F.size(near) > 0, f"h{i}": F.when(most > c(f"hc{i}"), most).when(vague, c(f"ha{i}")).otherwise(c(f"hc{i}"))}


def _splits(i: int, least: Column) -> Column:
    """Levels by split reads of either kind; one kind alone has to be more than `least`, unless the other helps on sure ground."""
    sup, sec = c(f"sup{i}"), c(f"sec{i}")
    one = lambda a, b: ((a > least) | (c("sure") & (a > 0) & (b > least))).cast("int")
    return one(sup, sec) + one(sec, sup)


def _all_mates(i: int) -> Column:
    return (c(f"mate{i}") > 2) | (c(f"exp{i}") == c(f"mate{i}"))


def _primary() -> Column:
    at = lambda i: contigs.is_primary(contigs.panel_index(c(f"ctg{i}")))
    return at(1) & at(2)


def _germ(i: int) -> Column:
    return (c(f"gl{i}") > 0.15) | ((c(f"gl{i}") > 0) & (c(f"h{i}") > LIMIT))


def _typed(pos2: Column, right1: Column, right2: Column) -> dict[str, Column]:
    return {
        "inter": c("ctg1") != c("ctg2"), "type": events.event_type(c("ctg1"), c("pos1"), right1, c("ctg2"), pos2, right2, c("inv")), "size": events.event_size(c("ctg1"), c("pos1"), c("ctg2"), pos2),
    }


def two_sided(df: DataFrame) -> DataFrame:
    """Events whose loci name each other."""
    df = df.withColumns(_sided(1) | _sided(2)).withColumns({"inv": c("x1.inverted") | c("x2.inverted"), "semi": c("sui1") | c("sui2"), "m1": _mate_ratio(1), "m2": _mate_ratio(2)})
    df = df.withColumns({f"ev{i}": c(f"sup{i}") + c(f"sec{i}") + c(f"mate{i}") for i in (1, 2)}).withColumns(_typed(c("pos2"), c("x1.right_side"), c("x2.right_side")))
    vague = c("fuzzy1") | c("cand1") | c("fuzzy2") | c("cand2")
    far = c("inter") | (c("exp1") > 0) | (c("exp2") > 0) | (c("size") > 1500)
    df = df.withColumn("distant", far & ~(~c("inter") & vague & (c("size") < 5000))).withColumns(_shares(1, c("ev1")) | _shares(2, c("ev2")))
    common, good = (c("hc1") > LIMIT) & (c("hc2") > LIMIT), _good(1, 0.4, 0.6) | _good(2, 0.4, 0.6)
    df = df.withColumns({f"status{i}": _status(i, common, good) for i in (1, 2)})
    df = df.withColumns({f"comp{i}": (c(f"status{i}") != "EXTREME_SUBCLONAL") & c(f"x{i}.distant") & c(f"full{i}") for i in (1, 2)} | {f"gl{i}": _control(i) for i in (1, 2)} | {"sure": ~c("prone1") & ~c("prone2") & _primary()})
    both = c("sui1") & c("sui2")

    def level(i: int) -> dict[str, Column]:
        other = 3 - i
        splits = _splits(i, F.when(c("sure") & ~c(f"sui{i}") & (c(f"m{i}") >= 0.6), 0).otherwise(2))
        tier = events.mate_tier(c(f"prone{i}"), c(f"sui{i}"), c(f"cand{i}"), c(f"fuzzy{i}"), both, c("m1") + c("m2"), c(f"mate{i}"))
        mates = c(f"x{i}.distant") & (c(f"mate{i}") > tier["min_mates"]) & (c(f"m{i}") >= tier["min_ratio"])
        more = (splits < 2) & (c(f"comp{i}") | (~c("semi") & c(f"comp{other}"))) & ~both & c("sure") & _all_mates(i)
        return {f"e{i}": splits + F.when(mates, F.when(more, 2).otherwise(1)).otherwise(0)}

    df = df.withColumns(level(1) | level(2))
    df = df.withColumns(_hits(1, c("e1")) | _hits(2, c("e2"))).withColumns({"germ1": _germ(1), "germ2": _germ(2)})
    df = df.withColumn("germline", (c("germ1") | c("germ2")) & ~((c("sup1") + c("sec1") > 200) & (c("sup1") + c("sec2") > 200)))
    extreme = (c("status1") == "EXTREME_SUBCLONAL") | (c("status2") == "EXTREME_SUBCLONAL")
    df = df.withColumn("artifact", events.artifact_status(c("ar1"), c("ar2"), c("e1"), c("e2"), c("h1") > LIMIT, extreme))
    alone = ~c("sui1") & c("sui2") & (c("__unknown") == 0) & (c("__two") != 0)
    apart = F.when(~c("inter") & (c("pos1") == c("pos2")), 3)
    df = df.withColumns({"__two": F.coalesce(apart, events.first_reason(events.two_sided_reasons())), "__unknown": F.coalesce(apart, events.first_reason(verdicts.unknown_reasons()))})
    df = df.withColumns({"reason": F.when(alone, 0).otherwise(c("__two")), "semi": c("semi") & ~alone}).drop("__two", "__unknown")
    return df.withColumn("score", verdicts.two_sided_score())


def one_sided(df: DataFrame) -> DataFrame:
    """Events whose partner position has no locus that names the first; besides, left2 and right2 are the coverages beside it. x2 is made."""
    df = df.withColumn("x2", partners.stand_in(c("ctg1"), c("pos1"), c("x1"), READ_LENGTH)).withColumns(_sided(1) | _sided(2))
    b = c("b2")
    df = df.withColumns({"inv": c("x1.inverted"), "semi": c("sui1"), "m1": _mate_ratio(1), "m2": F.lit(1.0), "comp1": F.lit(False), "comp2": F.lit(False)}).withColumns(_typed(c("pos2"), c("x1.right_side"), c("left2") > c("right2")))
    far = c("inter") | (c("exp1") > 0) | (c("size") > 1500)
    vague = ~c("inter") & (c("fuzzy1") | c("cand1")) & (c("size") < 5000)
    df = df.withColumn("distant", far & ~vague & ~c("size").between(1, 999)).withColumns({"gl1": _control(1), "gl2": c("gc2"), "sure": ~c("prone1") & _primary()})
    sure = F.when(c("sure") & ~c("sui2") & (c("m1") >= 0.66), 0).otherwise(2)
    doubt = c("prone1") | c("sui1") | c("cand1")
    mates1 = c("x1.distant") & (c("m1") >= 0.4) & (~doubt | (c("mate1") > 4))
    mates2 = c("x1.distant") & (c("bpmate2") > 4)
    has = lambda *names: (sum((b[n] for n in names[1:]), b[names[0]]) > 0).cast("int")
    df = df.withColumns({"__m1": mates1, "__m2": mates2, "e1": _splits(1, sure) + mates1.cast("int"), "e2": has("paired_soft", "unpaired_soft") + has("paired_hard", "unpaired_hard") + mates2.cast("int")})
    df = df.withColumns(_hits(1, c("e1")) | _hits(2, c("e2"))).withColumns({"germ1": _germ(1), "germ2": _germ(2)})
    breaks2 = b["paired_soft"] + b["paired_hard"] + b["unpaired_soft"] + b["unpaired_hard"]
    df = df.withColumn("germline", (c("germ1") | c("germ2")) & ~((c("sup1") + c("sec1") > 200) & (breaks2 > 200)))
    gone1, gone2 = ~c("distant") & c("__m1"), ~c("distant") & c("__m2")
    df = df.withColumns({
        "e1": c("e1") - gone1.cast("int"), "e2": c("e2") - gone2.cast("int"), "ev1": c("sup1") + c("sec1") + F.when(gone1, 0).otherwise(c("mate1")), "ev2": breaks2 + b["short_indel"] + F.when(gone2, 0).otherwise(b["mate_support"]),
    }).drop("__m1", "__m2")
    df = df.withColumns(_shares(1, c("sup1") + c("sec1") + c("mate1")) | _shares(2, b["paired_soft"] + b["paired_hard"] + b["unpaired_soft"]))
    common = (c("h1") > LIMIT) & (c("h2") > LIMIT)
    df = df.withColumns({f"status{i}": _status(i, common, _good(1, 0.5, 0.8)) for i in (1, 2)})
    extreme = (c("status1") == "EXTREME_SUBCLONAL") | (c("status2") == "EXTREME_SUBCLONAL")
    df = df.withColumn("artifact", events.artifact_status(c("ar1"), c("ar2"), c("e1"), c("e2"), c("h1") > LIMIT, extreme))
    apart = F.when(~c("inter") & (c("pos1") == c("pos2")), 3)
    return df.withColumns({"reason": F.coalesce(apart, events.first_reason(verdicts.one_sided_reasons())), "score": verdicts.one_sided_score()})


def unknown(df: DataFrame) -> DataFrame:
    """Events without a partner position; side 2 is the place that the locus names, and x2, ctg2, pos2 are made."""
    df = df.withColumns({"x2": partners.stand_in(c("ctg1"), c("pos1"), c("x1"), READ_LENGTH), "ctg2": c("x1.contig_idx"), "pos2": c("x1.pos")})
    df = df.withColumns(_sided(1) | _sided(2)).withColumns({"inv": c("x1.inverted"), "semi": c("sui1"), "m1": _mate_ratio(1), "m2": F.lit(1.0), "comp2": F.lit(False)})
    end = F.when((c("ctg1") == c("ctg2")) & (F.abs(c("pos1") - c("pos2")) > F.abs(c("pos1") - c("x1.ext_pos"))), c("x1.ext_pos")).otherwise(c("pos2"))
    df = df.withColumn("__end", end).withColumns(_typed(c("__end"), c("x1.right_side"), ~c("x1.right_side")))
    far = c("inter") | (c("exp1") > 0) | (c("size") > 2500)
    width = c("x1.ext_pos") - c("x1.pos")
    around = (F.greatest(F.lit(0), c("pos1") - width) <= c("x1.ext_pos")) & (c("x1.pos") <= c("pos1") + width)
    vague = c("fuzzy1") & ~c("inter") & c("cand1") & (around | (c("size") < 5000))
    df = df.withColumn("distant", far & ~vague & ~c("size").between(1, 1999)).withColumns(_shares(1, c("sup1") + c("sec1") + c("mate1")))
    df = df.withColumn("status1", _status(1, c("hc1") > LIMIT, _good(1, 0.5, 0.8))).withColumns({"comp1": (c("status1") != "EXTREME_SUBCLONAL") & c("x1.distant") & c("full1"), "gl1": _control(1), "gl2": c("gc2"), "sure": ~c("prone1") & _primary()})
    splits = _splits(1, F.when(c("sure") & (c("m1") >= 0.66), 0).otherwise(2))
    mates = c("x1.distant") & (c("m1") >= 0.4) & (~(c("cand1") | c("prone1")) | (c("mate1") > 4))
    more = mates & (splits < 2) & c("comp1") & c("sure") & _all_mates(1)
    df = df.withColumns({"__m": mates, "__s": splits, "e1": splits + mates.cast("int") + more.cast("int")})
    df = df.withColumns(_hits(1, c("e1")) | _hits(2, F.lit(0))).withColumns({"germ1": _germ(1), "germ2": _germ(2)})
    df = df.withColumn("germline", (c("germ1") | c("germ2")) & ~(c("sup1") + c("sec1") > 200))
    df = df.withColumns({"e1": F.when(c("distant"), c("e1")).otherwise(c("__s")), "e2": F.lit(0), "ev2": F.lit(0), "ev1": c("sup1") + c("sec1") + F.when(~c("distant") & c("__m"), 0).otherwise(c("mate1"))}).drop("__m", "__s", "__end")
    df = df.withColumn("artifact", F.when(holds(c("ar1") < 0.33), "CLEAN").when(holds(c("ar1") > 0.5), "ARTIFACT").otherwise("BORDERLINE"))
    early = ~c("inter") & ~c("distant") & (c("type") == "TRA")
    return df.withColumns({"reason": F.when(early, 3).otherwise(events.first_reason(verdicts.unknown_reasons())), "score": F.when(early, 0).otherwise(verdicts.unknown_score())})


def origin(i: int, n_samples: int, unknown_side: bool = False) -> Column:
    """SOMATIC, GERMLINE or RESCUED (UNKNOWN for a side without a position) with panel hits and clonality in the control."""
    name = F.when(~c(f"germ{i}"), "UNKNOWN" if unknown_side else "SOMATIC").when(c("germline") | (c(f"h{i}") > LIMIT), "GERMLINE").otherwise("RESCUED")
    return F.concat(name, F.lit("("), c(f"h{i}").cast("string"), F.lit(f"/{n_samples}):"), numeric.fixed3(c(f"gl{i}").cast("double")))


def rows(df: DataFrame, category: int, n_samples: int) -> Column:
    """The twenty columns of an event as text. category: 2 for loci that name each other, 1 with a position at the other end, 0 without.

    df is only looked at for its columns: contig1 and contig2 (names) besides those the builders make.
    """
    text = lambda x: x.cast("string")
    share = lambda i: F.coalesce(numeric.fixed3(ratio(c(f"ev{i}"), c(f"ev{i}") + c(f"span{i}"))), F.lit("0.000" if i == 2 else "-nan"))
    known = category > 0
    shown = lambda i: loci.format_locus(c(f"x{i}").withField("contig", c(f"contig{3 - i}")))
    last = c("pos2") if known else c("x1.ext_pos")
    return F.concat_ws(
        "\t", "contig1", text(c("pos1") - 1), text(c("pos1")), "contig2", text(c("pos2") - 1), text(last), origin(1, n_samples), origin(2, n_samples, not known), "type",
        text(F.when(c("reason") == 0, c("score")).otherwise(-c("reason"))), F.when(c("size") > 0, text(c("size"))).otherwise("NA"), F.when(c("inv"), "INV").otherwise("NORMAL"), text(c("ev1")), share(1),
        text(c("ev2")) if known else F.lit("UNKNOWN"), share(2) if known else F.lit("UNKNOWN"), shown(1), shown(2) if category == 2 else F.lit("_"), F.coalesce("text1", F.lit(".")), F.coalesce("text2", F.lit(".")),
    )


def preamble(control_level: int, level: int, foreign_in_control: bool, foreign: bool) -> list[str]:
    """Lines before the events of a sample, for what was seen only: how hard control and sample were filtered, foreign sequence in them (fixed texts)."""
    lines = [(control_level > 0, f"#controlMassiveInvPrefilteringLevel\t{control_level}"), (level > 0, f"#tumorMassiveInvFilteringLevel\t{level}"), (foreign_in_control, "#likelyPathogenInControl\tTRUE"), (foreign, "#likelyPathogenInTumor\tTRUE")]
    return [text for seen, text in lines if seen]
