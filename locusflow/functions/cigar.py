"""CIGAR strings as expressions: chunks, end of the alignment, break points and overhangs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CHUNK = "struct<op:string,right:boolean,off:int,n:int,adj:int>"


def is_candidate(cigar: Column) -> Column:
    """Has a clip or an indel, or doesn't end in a match."""
    return cigar.rlike("[SHID]") | ~cigar.endswith("M")


def decode(start: Column, cigar: Column, length: Column) -> Column:
    """struct(end, chunks): chunks of S, H, I and D with whether a match came before, offset in the read, size and
    shift against the reference. The read's length counts soft-clipped and inserted bases."""
    ops = F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+)([A-Z=])"), 0), lambda x: F.struct(F.substring(x, F.lit(1), F.length(x) - 1).cast("int").alias("n"), F.right(x, F.lit(1)).alias("op")))
    zero = lambda: F.lit(0)
    first = F.struct(zero().alias("cum"), zero().alias("indel"), zero().alias("left"), zero().alias("right"), F.lit(False).alias("seen"), F.array().cast(f"array<{_CHUNK}>").alias("chunks"))

    def step(s: Column, x: Column) -> Column:
        op, n = x["op"], x["n"]
        is_s = op == "S"
        adj = F.when(is_s, s["indel"] - s["left"]).otherwise(s["indel"])
        off = F.when(is_s, s["cum"] + s["indel"] - s["left"]).otherwise(s["cum"] + s["indel"] - s["left"])
        chunk = F.struct(op.alias("op"), s["seen"].alias("right"), F.when(is_s, s["cum"]).otherwise(off).alias("off"), n.alias("n"), adj.alias("adj"))
        return F.struct(
            F.when(op.isin("M", "S", "I"), s["cum"] + n).otherwise(s["cum"]).alias("cum"),
            F.when(op == "I", s["indel"] - n).when(op == "D", s["indel"] + n).otherwise(s["indel"]).alias("indel"),
            F.when(is_s & ~s["seen"], n).otherwise(s["left"]).alias("left"),
            F.when(is_s & s["seen"], n).otherwise(s["right"]).alias("right"),
            (s["seen"] | (op == "M")).alias("seen"),
            F.when(op.isin("S", "H", "I", "D"), F.concat(s["chunks"], F.array(chunk))).otherwise(s["chunks"]).alias("chunks"),
        )

    done = lambda s: F.struct((start + length + s["indel"] - s["left"] - s["right"]).cast("int").alias("end"), s["chunks"].alias("chunks"))
    return F.aggregate(ops, first, step, done)


def breaks(start: Column, decoded: Column) -> Column:
    """Break points in CIGAR order: clips at the side they are on; a deletion has both its ends, the second as '#'."""

    def of(c: Column) -> Column:
        point = lambda pos, kind, size, right: F.struct(pos.cast("int").alias("pos"), kind.alias("type"), size.cast("int").alias("size"), right.alias("right"))
        at = start + c["off"]
        clip = point(F.when(c["right"], decoded["end"]).otherwise(start), c["op"], c["n"], c["right"])
        deletion = F.array(point(at, c["op"], c["n"], F.lit(True)), point(at + c["n"], F.lit("#"), F.lit(-1), F.lit(True)))
        return F.when(c["op"].isin("S", "H"), F.array(clip)).when(c["op"] == "I", F.array(point(at, c["op"], c["n"], F.lit(True)))).otherwise(deletion)

    return F.flatten(F.transform(decoded["chunks"], of))


def overhangs(start: Column, decoded: Column) -> Column:
    """Soft-clipped stretches: side, break position, offset in the read, length."""
    clips = F.filter(decoded["chunks"], lambda c: c["op"] == "S")
    return F.transform(clips, lambda c: F.struct(c["right"].alias("right"), F.when(c["right"], decoded["end"]).otherwise(start).cast("int").alias("pos"), c["off"].alias("off"), c["n"].alias("n")))
