"""Orders as positions with three partner loci and counts; every value comes from the two keys by arithmetic that SQL has too."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import partners
from ..sources.breakpoints import COUNTS
from .adapters import table

_n = count(300)


def _draw(m: int) -> str:
    k = next(_n)
    return f"((o_orderkey * {7919 + 2 * k} + o_custkey * {104729 + 38 * k}) % 99991 % {m})"


def _yes(m: int) -> str:
    return f"({_draw(m)} = 0)"


def _side(i: int) -> dict[str, str]:
    return {
        f"ctg{i}": f"({_draw(2)} + 1)", f"pos{i}": f"(1000 + {_draw(1500)})", f"len{i}": f"(CASE WHEN {_yes(2)} THEN {_draw(400)} ELSE 0 END)", f"right{i}": _yes(2), f"inv{i}": _yes(2), f"sup{i}": _draw(9), f"sec{i}": _draw(7),
        f"mate{i}": _draw(14), f"exp{i}": _draw(16), f"susp{i}": _yes(6), f"semi{i}": _yes(3), f"prone{i}": _yes(6),
    }


#: Positions: contig, pos, counts and what else rules ask for.
POSITION = {
    "bctg": f"({_draw(2)} + 1)", "bpos": f"(1000 + {_draw(1500)})", **{n: f"(CASE WHEN {_yes(3)} THEN {_draw(60)} ELSE {_draw(8)} END)" for n in COUNTS}, "soft_reads": f"(CASE WHEN {_yes(7)} THEN 2000 ELSE {_draw(1000)} END)",
    "largest_pool": _draw(12), "loci": _draw(3), "overhang_chars": _draw(4), "has_over": _yes(2), "over16": _draw(17), "many": _yes(5),
}
LOCI = {**_side(1), **_side(2), **_side(3)}
_ALL = POSITION | LOCI
LV = (
    f"lr AS (SELECT o_orderkey, {', '.join(f'{v} AS {k}' for k, v in _ALL.items())} FROM orders), lv AS (SELECT *, "
    + ", ".join(f"pos{i} + len{i} AS ext{i}, (len{i} > 0 OR sup{i} + sec{i} = 0) AS fuzzy{i}, (len{i} > 0 OR sup{i} + sec{i} < 3) AS vague{i}, (susp{i} OR exp{i} > 0) AS far{i}" for i in (1, 2, 3))
    + " FROM lr)"
)


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", *(f"{v} AS {k}" for k, v in _ALL.items()))


def locus(i: int) -> Column:
    c = lambda k: F.col(f"{k}{i}")
    return partners.locus(c("ctg"), c("pos"), c("pos") + c("len"), c("right"), c("inv"), c("sup"), c("sec"), c("mate"), c("exp"), c("susp"), c("semi"), c("prone"))


#: Reads with CIGARs of seven shapes; a and c are clips, b matches, d an indel.
READ = {"shape": _draw(7), "a": f"({_draw(30)} + 1)", "b": f"({_draw(60)} + 20)", "cc": f"({_draw(30)} + 1)", "d": f"({_draw(9)} + 1)", "start": f"(1000 + {_draw(3000)})", "mapq": f"({_draw(5)} * 7)", "clip_q": f"({_draw(8)} * 5)", "clip2_q": f"({_draw(8)} * 5)", "full_q": f"({_draw(8)} * 5)", "supp": _yes(9), "mate_far": _yes(4), "unique": f"({_draw(5)} > 0)", "fwd": _yes(2), "plus": _yes(2), "here_ctg": f"({_draw(2)} + 1)", "here": f"(1000 + {_draw(6000)})", "mctg": f"({_draw(3)} + 1)", "mpos": f"(1000 + {_draw(6000)})", "right": _yes(2)}
_TEXT = "CASE shape WHEN 0 THEN concat(a, 'S', b, 'M') WHEN 1 THEN concat(b, 'M', a, 'S') WHEN 2 THEN concat(a, 'S', b, 'M', cc, 'S') WHEN 3 THEN concat(a, 'H', b, 'M') WHEN 4 THEN concat(b, 'M', a, 'H') WHEN 5 THEN concat(b, 'M', d, 'D', b, 'M', a, 'S') ELSE concat(b, 'M', d, 'I', b, 'M') END"
_LENGTH = "CASE shape WHEN 0 THEN a + b WHEN 1 THEN a + b WHEN 2 THEN a + b + cc WHEN 3 THEN b WHEN 4 THEN b WHEN 5 THEN a + 2 * b ELSE 2 * b + d END"
RV = f"rr AS (SELECT o_orderkey, {', '.join(f'{v} AS {k}' for k, v in READ.items())} FROM orders), rv AS (SELECT *, {_TEXT} AS cigar, {_LENGTH} AS n FROM rr)"


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", *(f"{v} AS {k}" for k, v in READ.items())).selectExpr("*", f"{_TEXT} AS cigar", f"{_LENGTH} AS n")
