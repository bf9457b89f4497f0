"""Lookups of positions in panels and among other positions: hits nearby, the better of two places, the nearest partner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import fixed3
from .intervals import band_join, best_within


def nearby_hits(rows: DataFrame, panel: DataFrame, row_id: str, within: int, close: int) -> DataFrame:
    """row_id, hits, close_hits, gap: the most hits of a panel position less than `within` away, the most of one at most
    `close` away (0 if there is none), and how far the best one lies (null if none; the nearer, then the left one, of equals).

    rows: row_id, contig, pos; row_id tells rows apart. panel: contig, pos, hits. Positions are looked up once each, left and right of them apart, where
    the best is the one with most hits that lies last or first.
    """
    c = F.col
    ranges = {"l": (within - 1, 0, F.struct("hits", "pos")), "r": (0, within - 1, F.struct("hits", (-c("pos")).alias("pos"))), "close": (close, close, c("hits"))}
    met = rows.select(row_id, "contig", "pos").join(best_within(rows, panel, ["contig"], ranges), ["contig", "pos"], "left")
    one = lambda k, off: F.when(c(k).isNotNull(), F.struct(c(k)["hits"].alias("hits"), (-F.abs(off)).alias("near"), (-off).alias("left")))
    best = met.withColumn("b", F.greatest(one("l", c("l.pos") - c("pos")), one("r", -c("r.pos") - c("pos"))))
    return best.select(row_id, F.coalesce("b.hits", F.lit(0)).alias("hits"), F.coalesce("close", F.lit(0)).alias("close_hits"), (-c("b.left")).alias("gap"))


def better_place(links: DataFrame, panel: DataFrame, within: int, close: int, wide: int) -> DataFrame:
    """id, pos, hits of the place that stands for a partner without a position of its own.

    links: id, contig, lo, hi. A range wider than `wide` has two candidates, its ends; the one with more hits stays, the low one of equals.
    """
    ends = F.explode(F.when(F.col("hi") - F.col("lo") > wide, F.array("lo", "hi")).otherwise(F.array("lo")))
    places = links.select("id", "contig", ends.alias("pos"))
    met = places.join(best_within(places, panel, ["contig"], {"hits": (within - 1, within - 1, F.col("hits"))}), ["contig", "pos"], "left")
    best = met.groupBy("id").agg(F.max(F.struct(F.coalesce("hits", F.lit(0)).alias("hits"), (-F.col("pos")).alias("p"))).alias("b"))
    return best.select("id", (-F.col("b.p")).alias("pos"), F.col("b.hits").alias("hits"))


def nearest_partner(edges: DataFrame, nodes: DataFrame, within: int, widened: int = 3) -> DataFrame:
    """id, partner_pos, widened: of each link the nearest node at its end, the left one of equals; beyond `within`, up to
    `widened` times as far, it counts as found in the wider search. Links that find none are left out.

    edges: id, b_contig, b_pos. nodes: contig, pos.
    """
    c, reach = F.col, widened * within
    ends = edges.select("id", c("b_contig").alias("contig"), c("b_pos").alias("pos"))
    met = ends.join(best_within(ends, nodes, ["contig"], {"l": (reach, 0, c("pos")), "r": (0, reach, -c("pos"))}), ["contig", "pos"])
    one = lambda at: F.when(at.isNotNull(), F.struct(F.abs(c("pos") - at).alias("far"), at.alias("pos")))
    best = met.select("id", F.least(one(c("l")), one(-c("r"))).alias("b")).where(c("b").isNotNull())
    return best.select("id", c("b.pos").alias("partner_pos"), (c("b.far") > within).alias("widened"))


def conservative_hits(rows: DataFrame, panel: DataFrame, row_id: str, close: int, rare: float) -> DataFrame:
    """row_id, hits: the most hits of a panel position at most `close` away; rare ones whose only locus explains more than four fifths of their
    hits don't count.

    rows: row_id, contig, pos. panel: contig, pos, hits, n_loci, locus_support (of its first locus).
    """
    known = panel.where(~((F.col("hits") < rare) & (F.col("n_loci") == 1) & (F.col("locus_support") > 0.8 * F.col("hits"))))
    marks = known.select("contig", F.col("pos").alias("p_pos"), F.col("hits").alias("p_hits"))
    best = band_join(rows.select(row_id, "contig", "pos"), marks, ["contig"], "pos", "p_pos", close).groupBy(row_id).agg(F.max("p_hits").alias("h"))
    return rows.select(row_id).join(best, row_id, "left").select(row_id, F.coalesce("h", F.lit(0)).alias("hits"))


def control_clonality(rows: DataFrame, control: DataFrame | None, row_id: str, close: int) -> DataFrame:
    """row_id, clonality: of the control position at most `close` away that has most support (the larger span count of equals); 0 without
    one, 1 without a control.

    rows: row_id, contig, pos. control: contig, pos, support, spans.
    """
    if control is None:
        return rows.select(row_id, F.lit(1.0).alias("clonality"))
    marks = control.select("contig", F.col("pos").alias("p_pos"), "support", "spans")
    best = band_join(rows.select(row_id, "contig", "pos"), marks, ["contig"], "pos", "p_pos", close).groupBy(row_id).agg(F.max(F.struct("support", "spans")).alias("b"))
    share = F.when(F.col("b.support") > 0, F.col("b.support") / (F.col("b.support") + F.col("b.spans")).cast("double"))
    return rows.select(row_id).join(best, row_id, "left").select(row_id, F.coalesce(share, F.lit(0.0)).alias("clonality"))


def overhang_report(positions: DataFrame, overhangs: DataFrame, visited: DataFrame, limit: int, n_samples: int) -> DataFrame:
    """line_index, line: positions that no event has visited and the panel hardly knows, with their overhangs.

    positions: line_index, contig, pos, hits, clonality. overhangs: line_index, overhang. visited: line_index.
    """
    left = positions.where(F.col("hits") < limit).join(visited.select("line_index"), "line_index", "left_anti").join(overhangs.where("overhang <> ''"), "line_index")
    origin = F.concat(F.when(F.col("clonality") > 0.1, "GERMLINE(").otherwise("SOMATIC("), F.col("hits"), F.lit(f"/{n_samples}):"), fixed3(F.col("clonality")))
    return left.select("line_index", F.concat_ws("\t", F.concat(F.lit("##"), "contig"), F.col("pos") - 1, "pos", origin, "overhang").alias("line"))
