"""The driver's lineitem table as alignment text, and queries that read it back and call breakpoints from it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import partners
from ..operators import evidence
from ..sources import alignments
from . import calling
from .adapters import table
from .cuts import deleted, folder

c, lit = F.col, F.lit

#: A line is one alignment at one of some 1200 places: clipped, hard-clipped and supplementary, or whole, by its flag. For Spark and DuckDB alike.
FIELDS = {
    "n": "CAST(l_suppkey % 24 AS INT)",
    "place": "1000 + 200 * CAST(floor(({days}) / 50) AS INT)",
    "k": "10 + CAST(l_quantity AS INT)",
    "kind": "l_returnflag",
    "ahead": "l_linestatus = 'O' OR l_returnflag = 'N'",
    "tagged": "l_returnflag <> 'N' AND l_linenumber % 3 > 0",
    "far": "l_partkey % 2 = 0",
    "mapq": "CASE CAST(l_partkey % 9 AS INT) WHEN 0 THEN 0 WHEN 1 THEN 7 ELSE 60 END",
    "name": "concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT), l_returnflag, l_linestatus)",
}
PLACED = {
    "rname": "CASE n WHEN 20 THEN 'X' WHEN 21 THEN 'MT' WHEN 22 THEN 'hs37d5' WHEN 23 THEN 'chrUn' ELSE CAST(n + 1 AS {text}) END",
    "start": "CASE WHEN kind = 'N' THEN place - 120 + k WHEN ahead THEN place - (101 - k) ELSE place END",
    "flag": "CASE WHEN kind = 'A' THEN 2147 ELSE 99 END",
    "mate": "(n + 5) % 20 + 1",
    "mate_pos": "50000 + place + CASE WHEN kind = 'N' THEN k ELSE 3 END",
}
#: Lines of a file of them. Compressed files can't be split, so tasks share files.
LINES = 50_000
DAYS = {"spark": "datediff(to_date(l_shipdate), DATE'1992-01-01')", "duck": "date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE))"}


def _select(fields: dict[str, str], engine: str) -> list[str]:
    return [f"{v.format(days=DAYS[engine], text='STRING' if engine == 'spark' else 'VARCHAR') if '{' in v else v} AS {k}" for k, v in fields.items()]


def aligned(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").selectExpr(*_select(FIELDS, "spark"))
    return rows.selectExpr("*", *_select(PLACED, "spark"))


def sam_lines(rows: DataFrame) -> DataFrame:
    """value: alignment text. A place's clipped bases are the same in all its reads."""
    own = F.translate(F.concat(F.md5(F.concat_ws("_", "n", "place")), F.md5(F.concat_ws("-", "n", "place"))), "0123456789abcdef", "ACGTACGTACGTACGT")
    body = F.substring(lit("ACGT" * 26), lit(1), 101 - c("k"))
    soft = F.when(c("ahead"), F.concat(body, F.substring(own, lit(1), c("k")))).otherwise(F.concat(F.reverse(F.substring(own, lit(1), c("k"))), body))
    seq = F.when(c("kind") == "R", soft).when(c("kind") == "A", body).otherwise(F.substring(lit("ACGT" * 26), 1, 101))
    clip, match = F.concat(c("k"), F.when(c("kind") == "R", "S").otherwise("H")), F.concat(101 - c("k"), lit("M"))
    cigar = F.when(c("kind") == "N", "101M").when(c("ahead"), F.concat(match, clip)).otherwise(F.concat(clip, match))
    tag = F.concat(lit("\tSA:Z:"), c("mate"), lit(","), 50000 + c("place") - c("k"), lit(",+,"), c("k"), lit("M"), 101 - c("k"), lit("S,60,0;"))
    line = F.concat_ws("\t", "name", "flag", "rname", "start", "mapq", cigar, F.when(c("far"), c("mate").cast("string")).otherwise("="), F.when(c("far"), c("mate_pos")).otherwise(c("start") + 150), F.when(c("far"), 0).otherwise(250), seq, F.repeat(lit("I"), F.length(seq)))
    return rows.select(F.concat(line, F.when(c("tagged"), tag).otherwise("")).alias("value"))


def written(spark: SparkSession, d: str) -> str:
    """The lines as compressed text in the folder of the session's checkpoints."""
    at = f"{folder(spark)}/alignments-{uuid.uuid4().hex}"
    sam_lines(aligned(spark, d)).write.option("compression", "lz4").option("maxRecordsPerFile", LINES).text(at)
    return at


def reads(spark: SparkSession, d: str) -> DataFrame:
    """The lines, written and read as alignments."""
    return alignments.read_alignments(spark, written(spark, d))


READS = f"al AS (SELECT *, CASE n WHEN 20 THEN 40 WHEN 22 THEN 999 ELSE n + 1 END AS chr_idx FROM (SELECT *, {', '.join(_select(PLACED, 'duck'))} FROM (SELECT {', '.join(_select(FIELDS, 'duck'))} FROM lineitem)) WHERE n NOT IN (21, 23))"
KIND = "CASE WHEN kind = 'A' THEN 2 WHEN kind = 'N' THEN CASE WHEN mapq BETWEEN 1 AND 12 THEN 5 WHEN far THEN 4 ELSE 0 END WHEN mapq BETWEEN 1 AND 12 THEN CASE WHEN 2 * k > 101 THEN 1 ELSE 5 END ELSE 1 END"


def sam_reads(spark, d):
    """Decoded alignments: contig, span, class, flags, breaks and mates."""
    r = reads(spark, d)
    shown = F.array_join(F.transform("breaks", lambda b: F.concat_ws(":", b["pos"], b["type"], b["size"], F.when(b["right"], "right").otherwise("left"))), ";")
    return r.select("name", "chr_idx", "start", "end", "read_type", "low_mapq", "null_mapq", "supplementary", "distant_mate", "mate_chr_idx", "mate_pos", "has_sa", shown.alias("spots"))


def attached_reads(spark, d):
    """Reads of each position by kind, numbered, within the limits of its lists."""
    return evidence.attached_reads(reads(spark, d).withColumn("order", c("name")), ["start", "name", "flag"]).select("chr_idx", "pos", "kind", "number", "overhang", F.size("loci").alias("n_loci"))


def distinct_support(spark, d):
    """For each position the loci that its soft-clipped reads tell of, with how many different reads tell of each, after they are merged."""
    soft = evidence.attached_reads(reads(spark, d), ["start", "name", "flag"], kinds=("soft",))
    offers = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("number", F.filter("loci", lambda x: ~x["fuzzy"]).alias("loci")))), lambda r: r["loci"]))
    merge = lambda a, x, xs: evidence.narrowed(a, x).withField("ids", F.array_union(a["ids"], x["ids"]))
    merged = evidence.absorbed(evidence.none_of(evidence.SEEN), c("offers"), partners.READ_LENGTH, merge)
    rows = soft.groupBy("chr_idx", "pos").agg(offers.alias("offers")).select("chr_idx", "pos", F.explode(merged).alias("x"))
    return rows.select("chr_idx", "pos", c("x.contig_idx").alias("partner"), c("x.pos").alias("partner_pos"), "x.right_side", F.size("x.ids").alias("support"))


def excluded_mates(spark, d):
    """Distant mates outside a set of regions."""
    regions = table(spark, d, "nation").select((c("n_nationkey") % 20 + 1).cast("int").alias("contig"), (51000 + 1100 * c("n_regionkey")).cast("int").alias("lo"), (52000 + 1150 * c("n_regionkey")).cast("int").alias("hi"))
    mates = aligned(spark, d).where("far").select("name", c("mate").alias("mate_chr_idx"), "mate_pos")
    return evidence.excluded(regions, mates, 256)


def competing_loci(spark, d):
    """Three loci of a position that lie at the same clusters of mates: mates of each, and of all with each cluster counted once."""
    own = F.collect_list(F.struct((c("l_suppkey") % 4).cast("int").alias("contig"), (c("l_orderkey") % 2000).cast("int").alias("start"), (c("l_orderkey") % 2000 + 60).cast("int").alias("end"), c("l_quantity").cast("int").alias("power"), (c("l_linenumber") % 3 + 1).cast("int").alias("evidence"), lit(False).alias("inverted"), F.struct(lit(0).alias("start"), lit(0).alias("end")).alias("read")))
    rows = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.array_sort(own).alias("left_clusters"))
    no, zero = lit(False), lit(0)
    locus = lambda i: F.struct(
        (c("l_partkey") % 4).cast("int").alias("contig_idx"), (c("l_partkey") % 1000 + 300 * i).cast("int").alias("pos"), (c("l_partkey") % 1000 + 300 * i).cast("int").alias("ext_pos"), lit(True).alias("right_side"), zero.alias("mapq"), no.alias("inverted"), no.alias("fuzzy"), lit(True).alias("distant"), lit(505).alias("slack"),
        no.alias("low"), no.alias("nul"), lit(1).alias("distinct"), F.array(lit(1)).alias("ids"), evidence.none_of("int").alias("ids2"),
    ).cast(evidence.SEEN)
    empty = rows.withColumns({"right_clusters": F.filter("left_clusters", lambda x: lit(False)), "left_poor": evidence.none_of("struct<contig:int,start:int,evidence:int,own:boolean,n:int>"), "right_poor": evidence.none_of("struct<contig:int,start:int,evidence:int,own:boolean,n:int>"), "right_total": lit(0)})
    empty = empty.withColumn("left_total", F.aggregate("left_clusters", lit(0), lambda s, m: s + m["power"]))
    got = empty.withColumn("loci", evidence.with_mates(F.array(locus(0), locus(1), locus(2))))
    each = lambda i: c("loci")[i]["mates"].alias(f"mates_{i}")
    return got.select("l_partkey", each(0), each(1), each(2), evidence.mate_total(c("loci")).alias("counted_once"), c("loci")[0]["semi_suspicious"].alias("in_doubt"))


def called_breakpoints(spark, d):
    """Breakpoint table of the alignments, whose text is deleted as soon as it is decoded."""
    at = written(spark, d)
    made = calling.called_breakpoints(alignments.read_alignments(spark, at), decoded=lambda: deleted(spark, at))
    shown = lambda k: F.array_join(F.transform(k, lambda x: F.concat_ws(":", x["contig"], x["pos"], x["support"], x["secondary"], x["mates"], x["expected"])), ";").alias(k)
    return made.select(*(k for k in made.columns if not k.endswith("_loci")), shown("double_loci"), shown("single_loci"))


QUERIES = {f.__name__: f for f in (sam_reads, attached_reads, distinct_support, excluded_mates, competing_loci, called_breakpoints)}
ATTACHED = f"""b AS (SELECT *, place AS pos, CASE WHEN t = 1 THEN 'soft' WHEN mapq > 12 THEN 'hard' ELSE 'poor' END AS sort FROM (SELECT *, {KIND} AS t FROM al) WHERE t IN (1, 2)),
o AS (SELECT *, row_number() OVER (PARTITION BY chr_idx, pos, sort ORDER BY start, name, flag) AS rank, count(*) OVER (PARTITION BY chr_idx, pos, sort) AS many FROM b),
h AS (SELECT chr_idx, pos, count(*) AS hards FROM o WHERE sort = 'hard' AND rank <= 2001 GROUP BY ALL),
a AS (SELECT o.*, rank - 1 + CASE WHEN sort = 'poor' THEN coalesce(hards, 0) ELSE 0 END AS number FROM o LEFT JOIN h USING (chr_idx, pos) WHERE CASE WHEN sort = 'poor' THEN many <= 50 ELSE rank <= 2001 END)"""
OWN = "translate(md5(concat_ws('_', n, place)) || md5(concat_ws('-', n, place)), '0123456789abcdef', 'ACGTACGTACGTACGT')"
SQL = {
    "sam_reads": f"""WITH {READS} SELECT name, chr_idx, start, CASE WHEN kind = 'N' THEN start + 101 ELSE start + 101 - k END AS "end", {KIND} AS read_type, mapq < 13 AS low_mapq, mapq = 0 AS null_mapq, kind = 'A' AS supplementary, far AS distant_mate,
 CASE WHEN far THEN mate ELSE chr_idx END AS mate_chr_idx, CASE WHEN far THEN mate_pos ELSE start + 150 END AS mate_pos, tagged AS has_sa,
 CASE WHEN kind = 'N' THEN '' ELSE concat_ws(':', place, CASE WHEN kind = 'R' THEN 'S' ELSE 'H' END, k, CASE WHEN ahead THEN 'right' ELSE 'left' END) END AS spots FROM al""",
    "attached_reads": f"""WITH {READS}, {ATTACHED} SELECT chr_idx, pos, sort AS kind, CAST(number AS INT) AS number, CASE WHEN sort = 'soft' THEN CASE WHEN ahead THEN left({OWN}, k) ELSE reverse(left({OWN}, k)) END END AS overhang,
 CAST(tagged AS INT) + CAST(far AND NOT tagged AS INT) AS n_loci FROM a""",
    "distinct_support": f"""WITH {READS}, {ATTACHED} SELECT chr_idx, pos, mate AS partner, 50000 + place AS partner_pos, ahead AS right_side, CAST(count(DISTINCT number) AS INT) AS support FROM a WHERE sort = 'soft' AND tagged GROUP BY ALL""",
    "excluded_mates": f"""WITH al AS (SELECT *, {', '.join(_select(PLACED, 'duck'))} FROM (SELECT {', '.join(_select(FIELDS, 'duck'))} FROM lineitem)), r AS (SELECT n_nationkey % 20 + 1 AS contig, 51000 + 1100 * n_regionkey AS lo, 52000 + 1150 * n_regionkey AS hi FROM nation)
SELECT name, mate AS mate_chr_idx, mate_pos FROM al WHERE far AND NOT EXISTS (SELECT 1 FROM r WHERE r.contig = mate AND mate_pos >= lo AND mate_pos < hi)""",
    "competing_loci": """WITH m AS (SELECT l_partkey, row_number() OVER (PARTITION BY l_partkey) AS i, l_suppkey % 4 AS contig, l_orderkey % 2000 AS s, l_orderkey % 2000 + 60 AS e, CAST(l_quantity AS INT) AS power, l_linenumber % 3 + 1 AS evidence FROM lineitem),
x AS (SELECT *, [contig = l_partkey % 4 AND l_partkey % 1000 + 300 * j BETWEEN s - 505 AND e + 505 FOR j IN [0, 1, 2]] AS hit FROM m)
SELECT l_partkey, CAST(sum(CASE WHEN hit[1] THEN power ELSE 0 END) AS INT) AS mates_0, CAST(sum(CASE WHEN hit[2] THEN power ELSE 0 END) AS INT) AS mates_1, CAST(sum(CASE WHEN hit[3] THEN power ELSE 0 END) AS INT) AS mates_2,
CAST(sum(CASE WHEN hit[1] OR hit[2] OR hit[3] THEN power ELSE 0 END) AS INT) AS counted_once, coalesce(max(CASE WHEN hit[1] THEN evidence END) < 3, false) AS in_doubt FROM x GROUP BY l_partkey""",
}
