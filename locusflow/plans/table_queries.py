"""Breakpoint tables and panels written as text from a driver table and read back, as queries with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import breakpoints
from .adapters import table
from .cuts import folder

c, lit = F.col, F.lit

#: One row a contig and position, for DuckDB; {last} names what stands for contig 20. Counts, loci and overhangs are for Spark as well.
ROWS = """SELECT CASE n WHEN 20 THEN '{last}' WHEN 21 THEN 'MT' WHEN 22 THEN 'hs37d5' WHEN 23 THEN 'chrUn' ELSE CAST(n + 1 AS VARCHAR(9)) END AS contig, pos, cnt, ln, q FROM
 (SELECT CAST(l_suppkey % 24 AS INT) AS n, CAST(l_partkey AS INT) AS pos, CAST(count(*) AS INT) AS cnt, CAST(sum(l_linenumber) AS INT) AS ln, CAST(sum(CAST(l_quantity AS INT)) AS INT) AS q FROM lineitem GROUP BY ALL)"""
COUNTS = ["cnt", "ln % 5", "ln % 7", "q % 11", "q % 6", "ln % 3", "q % 50", "q % 4", "0", "ln % 2", "0", "cnt % 3"]
LOCI = "CASE WHEN ln % 2 = 0 THEN '.' ELSE concat('|5:', pos, '-', pos + 40, '_INV(', ln % 4, ',', cnt, ',', q % 9, '?/', q % 9 + 2, ')#;X:77|(1,0,!/3)') END"
OVER = "CASE WHEN q % 3 = 0 THEN '.' ELSE concat('>', pos, '_1:|ACGT(', cnt, ')') END"


def _selected(lines: DataFrame, last: str) -> DataFrame:
    g = lines.groupBy((c("l_suppkey") % 24).cast("int").alias("n"), c("l_partkey").cast("int").alias("pos")).agg(F.count(lit(1)).cast("int").alias("cnt"), F.sum("l_linenumber").cast("int").alias("ln"), F.sum(c("l_quantity").cast("int")).cast("int").alias("q"))
    names = {20: last, 21: "MT", 22: "hs37d5", 23: "chrUn"}
    contig = (c("n") + 1).cast("string")
    for n, name in names.items():
        contig = F.when(c("n") == n, name).otherwise(contig)
    return g.select(contig.alias("contig"), "pos", "cnt", "ln", "q")


def _text(lines: DataFrame, header: str | None) -> str:
    """Folder of the lines as text, after a header in each file."""
    at = f"{folder(lines.sparkSession)}/text-{uuid.uuid4().hex}"
    if header:
        lines = lines.sparkSession.createDataFrame([(header,)], "value string").unionByName(lines)
    lines.write.text(at)
    return at


def breakpoint_table(spark, d):
    """A breakpoint table read back: contigs outside panels left out, counts put right, and the line as it is written again."""
    rows = _selected(table(spark, d, "lineitem"), "X")
    line = F.concat_ws("\t", "contig", "pos", c("pos") + 1, F.concat_ws(",", *(F.expr(x) for x in COUNTS)), F.concat_ws(",", c("q") % 40, c("ln") % 45 + 5), F.expr(LOCI), lit("."), F.expr(OVER))
    back = breakpoints.read_breakpoints(spark, _text(rows.select(line.alias("value")), breakpoints.HEADER))
    return back.select("contig", "pos", "chr_idx", "panel_idx", "normal_spans", "paired_soft", "left_coverage", "right_coverage", F.size("double_loci").alias("n_loci"), breakpoints.line_of().alias("line"))


def panel_table(spark, d):
    """A panel read back: hits, doubled on Y, and the first locus's range with the hits it stands for."""
    rows = _selected(table(spark, d, "lineitem"), "Y")
    line = F.concat_ws("\t", "contig", "pos", c("pos") + 1, "cnt", lit(0), lit("0.10000"), lit("0.00000"), lit("NA"), F.expr(LOCI))
    back = breakpoints.read_panel(spark, _text(rows.select(line.alias("value")), None), 7)
    first = F.get("loci", lit(0))
    return back.select("contig", "panel_idx", "pos", "hits", F.size("loci").alias("n_loci"), F.coalesce(first["ext_pos"], lit(-1)).alias("first_end"), F.coalesce(first["secondary"], lit(-1)).alias("first_hits"))


QUERIES = {f.__name__: f for f in (breakpoint_table, panel_table)}
NUMBER = "CASE contig WHEN '{last}' THEN {n} WHEN 'hs37d5' THEN 999 ELSE CAST(contig AS INT) END"
PANEL = "CASE contig WHEN 'X' THEN 22 WHEN 'Y' THEN 23 WHEN 'hs37d5' THEN 83 ELSE CAST(contig AS INT) - 1 END"
SQL = {
    "breakpoint_table": f"""WITH g AS ({ROWS.format(last='X')}), k AS (SELECT *, q % 40 AS l, ln % 45 + 5 AS r, greatest(0, q % 50 - least(q % 40, ln % 45 + 5)) AS excess FROM g WHERE contig NOT IN ('MT', 'chrUn'))
SELECT contig, pos, {NUMBER.format(last='X', n=40)} AS chr_idx, {PANEL} AS panel_idx, q % 50 - excess AS normal_spans, cnt + excess AS paired_soft, l AS left_coverage, r AS right_coverage, CASE WHEN ln % 2 = 0 THEN 0 ELSE 2 END AS n_loci,
concat(contig, chr(9), pos, chr(9), pos + 1, chr(9), concat_ws(',', cnt + excess, {', '.join(COUNTS[1:6])}, q % 50 - excess, {', '.join(COUNTS[7:])}), chr(9), l, ',', r, chr(9), {LOCI}, chr(9), '.', chr(9), {OVER}) AS line FROM k""",
    "panel_table": f"""WITH g AS ({ROWS.format(last='Y')}), k AS (SELECT *, CASE WHEN contig = 'Y' THEN least(7, 2 * cnt) ELSE cnt END AS hits FROM g WHERE contig NOT IN ('MT', 'chrUn'))
SELECT contig, {PANEL} AS panel_idx, pos, hits, CASE WHEN ln % 2 = 0 THEN 0 ELSE 2 END AS n_loci, CASE WHEN ln % 2 = 1 THEN pos + 40 ELSE -1 END AS first_end, CASE WHEN ln % 2 = 1 THEN hits ELSE -1 END AS first_hits FROM k""",
}
