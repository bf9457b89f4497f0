"""Directed links between positions: reciprocal, one-sided and unmatched ones, and the canonical pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import best_within

EDGE = ["id", "a_contig", "a_pos", "b_contig", "b_pos"]


def _back(edges: DataFrame, within: int, how: str, wide: int) -> DataFrame:
    """edges joined with the links back.

    Links are met in cells of their contigs and both positions, `wide` distances wide: a link goes to the cells that its surroundings reach (2.25 of
    them on average at 4, 1.56 at 8), and a link back only to its own. So a crowded pair of contigs is split both ways.
    """
    c, width = F.col, max(1, wide * within)
    cell = lambda p: F.floor(p / width).cast("int")
    reached = lambda p: F.explode(F.array_distinct(F.array(cell(c(p) - within), cell(c(p) + within))))
    left = edges.select(*EDGE, reached("a_pos").alias("__a")).withColumn("__b", reached("b_pos"))
    back = edges.select(c("id").alias("mate_id"), c("a_contig").alias("m_from"), c("a_pos").alias("m_a"), c("b_contig").alias("m_to"), c("b_pos").alias("m_b"), cell(c("b_pos")).alias("m_cell_a"), cell(c("a_pos")).alias("m_cell_b"))
    near = (F.abs(c("b_pos") - c("m_a")) <= within) & (F.abs(c("a_pos") - c("m_b")) <= within) & (c("id") != c("mate_id"))
    same = (c("a_contig") == c("m_to")) & (c("b_contig") == c("m_from")) & (c("__a") == c("m_cell_a")) & (c("__b") == c("m_cell_b"))
    return left.join(back, same & near, how)


def reciprocal(edges: DataFrame, within: int) -> DataFrame:
    """(id, mate_id): links A->B with a link B->A, both ends within the distance."""
    return _back(edges, within, "inner", 4).select("id", "mate_id")


def partner_status(edges: DataFrame, nodes: DataFrame, within: int) -> DataFrame:
    """id, status of each link: 'two-sided' with a reciprocal link, 'one-sided' with a node at its end, else 'unknown'.

    Neither search makes pairs: one link back is enough, and of the nodes the positions of ends are told apart once.
    """
    c = F.col
    two = _back(edges, within, "left_semi", 8).select("id").distinct().withColumn("__two", F.lit(True))
    ends = edges.select("id", c("b_contig").alias("contig"), c("b_pos").alias("pos"))
    met = ends.join(best_within(ends, nodes, ["contig"], {"one": (within, within, c("pos"))}), ["contig", "pos"], "left").select("id", "one")
    return met.join(two, "id", "left").select("id", F.when(c("__two"), "two-sided").when(c("one").isNotNull(), "one-sided").otherwise("unknown").alias("status"))


def canonical_key(c1: Column, p1: Column, c2: Column, p2: Column, score: Column) -> Column:
    a, b = F.struct(c1.alias("c"), p1.alias("p")), F.struct(c2.alias("c"), p2.alias("p"))
    lo, hi = F.least(a, b), F.greatest(a, b)
    return F.concat_ws("_", lo["c"], lo["p"], hi["c"], hi["p"], score)


def first_of_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def unvisited(df: DataFrame, visited: DataFrame, key: str, visited_key: str) -> DataFrame:
    return df.join(visited.select(F.col(visited_key).alias("__v")), df[key] == F.col("__v"), "left_anti")
