"""Breakpoint tables and panels as text: readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contigs, loci, numeric
from ..operators.events import count_repair
from .formats import NumberedLines, numbered_lines

#: Counts of the fourth column, in order (fixed format).
COUNTS = ["paired_soft", "paired_hard", "mate_support", "unpaired_soft", "unpaired_hard", "short_indel", "normal_spans", "low_spans_soft", "low_spans_hard", "low_breaks_soft", "low_breaks_hard", "repetitive"]
HEADER = "#chr\tstart\tend\tcovTypes(pairedBreaksSoft,pairedBreaksHard,mateReadSupport,unpairedBreaksSoft,unpairedBreaksHard,shortIndelReads,normalSpans,lowQualSpansSoft,lowQualSpansHard,lowQualBreaksSoft,lowQualBreaksHard,repetitiveOverhangs)\tleftCoverage,rightCoverage\tsuppAlignmentsDoubleSupport(primary,secondary,mate)\tsuppAlignments(primary,0,mate)\tsignificantOverhangs"


def _loci(text: Column) -> Column:
    return F.transform(loci.parse_loci(text), loci.parse_locus)


def _first_field() -> Column:
    """contig by itself: rows are left out by it before any line is split."""
    return F.substring_index("value", "\t", 1).alias("contig")


def read_list(spark: SparkSession, path: str) -> list[str]:
    """Paths in a list file, one a line; a path's place is its file's number."""
    return [x.strip() for x in spark.read.text(path, wholetext=True).first()[0].splitlines() if x.strip()]


def sample_name(path: Column, version: str) -> Column:
    """What stands before the last occurrence of the version in a path, back to the slash; empty without it."""
    before = F.regexp_extract(path, rf"^(.*)\Q{version}\E", 1)
    return F.substring_index(before, "/", -1)


def read_breakpoints(spark: SparkSession, paths: str | list[str], panel_only: bool = True, strict: bool = False, line_index: bool = False) -> DataFrame:
    """Breakpoints of any number of (gzipped) tables, read as one scan; counts beyond the coverage are put right.

    strict: a row without its eight fields, with a number that is none or a locus out of the grammar ends the run; else what can't be read is null. line_index:
    paths are single files, one task each, and rows have file_id, their file's place in the list, and line_index, their own among the file's rows.
    """
    if line_index:
        read = numbered_lines(spark, [paths] if isinstance(paths, str) else paths)
        rows = read.select(_first_field(), F.split("value", "\t").alias("f"), "file", "file_id", "line_index")
    else:
        rows = spark.read.text(paths).where(~F.col("value").startswith("#")).select(_first_field(), F.split("value", "\t").alias("f"), F.input_file_name().alias("file"))
    if strict:
        rows = rows.withColumn("f", F.when(F.size("f") >= 8, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("a row has not eight fields, in "), "file"))))
    f = lambda k: F.get("f", F.lit(k))
    counts, cover = F.split(f(3), ","), F.split(f(4), ",")
    number = lambda x: x.try_cast("int")
    numbers = {"pos": number(f(1))} | {n: number(F.get(counts, F.lit(k))) for k, n in enumerate(COUNTS)} | {f"{side}_coverage": number(F.get(cover, F.lit(k))) for k, side in enumerate(("left", "right"))}
    out = rows.select(
        *(k for k in rows.columns if k not in ("f", "contig")), "contig", contigs.contig_index(F.col("contig")).alias("chr_idx"), *(v.alias(k) for k, v in numbers.items()), (f(5) == "#").alias("missing_info"), _loci(f(5)).alias("double_loci"), _loci(f(6)).alias("single_loci"),
        F.when(f(7).isin(".", "#"), None).otherwise(f(7)).alias("overhangs"),
    )
    if strict:
        bad = F.exists(F.array(*numbers), lambda x: x.isNull()) | F.exists(F.concat("double_loci", "single_loci"), lambda x: x["pos"].isNull() | x["expected"].isNull())
        out = out.withColumn("chr_idx", F.when(bad, F.raise_error(F.concat(F.lit("a field cannot be read, at "), "contig", F.lit(":"), F.coalesce(F.col("pos").cast("string"), F.lit("?")), F.lit(", in "), "file"))).otherwise(F.col("chr_idx")).cast("int"))
    out = out.withColumn("panel_idx", contigs.panel_index(F.col("chr_idx"))).withColumns(count_repair("normal_spans", "left_coverage", "right_coverage", "paired_soft", "unpaired_soft"))
    return out.where("panel_idx >= 0") if panel_only else out


def line_of() -> Column:
    """A row as a line of a breakpoint table."""
    listed = lambda name: F.when(F.col("missing_info"), "#").when(F.size(name) == 0, ".").otherwise(F.array_join(F.transform(name, lambda x: loci.format_locus(x)), ";"))
    over = F.when(F.col("missing_info"), "#").otherwise(F.coalesce("overhangs", F.lit(".")))
    return F.concat_ws("\t", "contig", "pos", F.col("pos") + 1, F.concat_ws(",", *COUNTS), F.concat_ws(",", "left_coverage", "right_coverage"), listed("double_loci"), listed("single_loci"), over)


def breakpoint_lines(df: DataFrame) -> DataFrame:
    """value: lines of a breakpoint table."""
    return df.select(line_of().alias("value"))


def write_breakpoints(df: DataFrame, path: str) -> None:
    """df as text in order of contig and position, the header first."""
    keyed = df.select("chr_idx", "pos", line_of().alias("value"))
    header = df.sparkSession.createDataFrame([(-1, -1, HEADER)], "chr_idx int, pos int, value string")
    header.unionByName(keyed.select(F.col("chr_idx").cast("int"), F.col("pos").cast("int"), "value")).orderBy("chr_idx", "pos").select("value").write.text(path)


def write_breakpoint_files(df: DataFrame, path: str) -> None:
    """df as gzip files of a folder, each a table with header, in order of contig and position from one file to the next; either all of them get there or none."""
    df.sparkSession.dataSource.register(NumberedLines)
    ordered = df.select(F.col("chr_idx").cast("int").alias("chr_idx"), F.col("pos").cast("int").alias("pos"), line_of().alias("value")).orderBy("chr_idx", "pos")
    ordered.select("value").write.format("numbered_lines").option("header", HEADER).mode("append").save(path)


def panel_file(root: str, n_samples: int) -> str:
    """Name of a panel's file (fixed form)."""
    return f"{root}_{n_samples}_mergedBpCounts.bed"


def read_panel(spark: SparkSession, path: str, n_samples: int) -> DataFrame:
    """Positions of a panel with their number of samples; doubled on Y, of which half the samples have none."""
    f = lambda k: F.get("f", F.lit(k))
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(_first_field(), F.split("value", "\t").alias("f"))
    hits = F.when(F.col("contig").startswith("Y"), F.least(F.lit(n_samples), 2 * f(3).cast("int"))).otherwise(f(3).cast("int"))
    return rows.select("contig", contigs.panel_index(contigs.contig_index(F.col("contig"))).alias("panel_idx"), f(1).cast("int").alias("pos"), hits.alias("hits"), F.transform(_loci(f(8)), lambda x: x.withField("secondary", hits)).alias("loci")).where("panel_idx >= 0")


def panel_lines(df: DataFrame, n_samples: int) -> DataFrame:
    """value: lines of a panel, contigs last to first. df: contig, panel_idx, pos, file_ids, ratios, loci."""
    n, a = F.size("file_ids"), F.size("ratios")
    share = lambda x: numeric.fixed5((x / F.lit(float(n_samples))).cast("double"))
    mean = F.when(a > 0, numeric.fixed5(F.aggregate("ratios", F.lit(0.0), lambda s, x: s + x) / a)).otherwise("NA")
    strong = F.when(F.size("loci") >= 11, F.filter("loci", lambda x: x["support"] >= 0.2 * n)).otherwise(F.col("loci"))
    text = F.when(F.size(strong) == 0, ".").otherwise(F.array_join(F.transform(strong, lambda x: loci.format_locus(x)), ";"))
    line = F.concat_ws("\t", "contig", "pos", F.col("pos") + 1, n, a, share(n), share(a), mean, text, F.array_join("file_ids", ","))
    return df.orderBy(F.desc("panel_idx"), "pos").select(line.alias("value"))
