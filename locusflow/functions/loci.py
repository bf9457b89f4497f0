"""Partner loci as text: [|]contig:pos[-end][_INV][|](support,secondary,mates[?]/expected)[#], '!' for suspicious mates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .contigs import contig_index

GRAMMAR = r"^(\|?)([^:|]+):(\d+)(?:-(\d+))?(_INV)?(\|?)\((\d+),(\d+),(?:(\d+)(\??)|(!))/(\d+)\)(#?)$"


def parse_locus(text: Column) -> Column:
    """The grammar is matched once, into fields; where it doesn't match, texts are empty and numbers null."""
    fields = F.split(F.regexp_replace(text, GRAMMAR, "$1\t$2\t$3\t$4\t$5\t$6\t$7\t$8\t$9\t$10\t$11\t$12\t$13"), "\t")
    none = F.array(*[F.lit("")] * 13)

    def stored(f: Column) -> Column:
        g = lambda k: F.get(f, F.lit(k - 1))
        number = lambda k: F.when(g(k) != "", g(k).try_cast("int"))
        return F.struct(
            g(2).alias("contig"), contig_index(g(2)).alias("contig_idx"), number(3).alias("pos"), number(4).alias("end"), (g(1) == "|").alias("right_side"), (g(5) != "").alias("inverted"), number(7).alias("support"), number(8).alias("secondary"),
            F.coalesce(number(9), F.lit(0)).alias("mates"), number(12).alias("expected"), (g(11) == "!").alias("suspicious"), (g(10) == "?").alias("semi_suspicious"), (g(13) == "#").alias("error_prone"),
        )

    def of(x: Column) -> Column:
        return F.struct(
            x["contig"].alias("contig"), x["contig_idx"].alias("contig_idx"), x["pos"].alias("pos"), F.coalesce(x["end"], x["pos"]).alias("ext_pos"),
            *(x[k].alias(k) for k in ("right_side", "inverted", "support", "secondary", "mates", "expected", "suspicious", "semi_suspicious", "error_prone")), (x["pos"] != F.coalesce(x["end"], x["pos"])).alias("fuzzy"),
            ((x["pos"] != F.coalesce(x["end"], x["pos"])) | (x["support"] + x["secondary"] < 3)).alias("strict_fuzzy"), (x["suspicious"] | (x["expected"] > 0)).alias("distant"),
        )

    checked = F.transform(F.array(fields), lambda f: F.when(F.size(f) == 13, f).otherwise(none))
    return F.transform(F.transform(checked, stored), of)[0]


def format_locus(s: Column, no_quality: Column | None = None) -> Column:
    """Text of a locus. no_quality: whether the reads it comes from have no mapping quality, which is marked as doubt about the mates is."""
    side = lambda right: F.when(s["right_side"] == F.lit(right), "|").otherwise("")
    mates = F.when(s["suspicious"], F.lit("!")).otherwise(F.concat(s["mates"].cast("string"), F.when(s["semi_suspicious"] if no_quality is None else s["semi_suspicious"] | no_quality, "?").otherwise("")))
    return F.concat(
        side(True), s["contig"], F.lit(":"), s["pos"], F.when(s["fuzzy"] & (s["pos"] != s["ext_pos"]), F.concat(F.lit("-"), s["ext_pos"])).otherwise(""), F.when(s["inverted"], "_INV").otherwise(""),
        side(False), F.lit("("), s["support"], F.lit(","), s["secondary"], F.lit(","), mates, F.lit("/"), s["expected"], F.lit(")"), F.when(s["error_prone"], "#").otherwise(""),
    )


def parse_loci(text: Column) -> Column:
    """A ';' list of loci; '.' and '#' are empty."""
    return F.when(text.isin(".", "#", ""), F.array().cast("array<string>")).otherwise(F.split(text, ";"))


def range_distance(contig: Column, pos: Column, other_contig: Column, lo: Column, hi: Column, far: int = 1_000_000) -> Column:
    """0 within the range, else the gap; far on another contig."""
    return F.when(contig != other_contig, far).otherwise(F.greatest(F.lit(0), lo - pos, pos - hi))
