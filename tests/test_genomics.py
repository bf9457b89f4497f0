"""Reads to counters, and text tables there and back."""

import gzip

from locusflow.plans import calling
from locusflow.sources import alignments, breakpoints


def sam(flag, rname, pos, mapq, cig, rnext, pnext, tlen, n=101, tags=""):
    return "\t".join(map(str, ("q", flag, rname, pos, mapq, cig, rnext, pnext, tlen, "A" * n, "I" * n))) + tags


def test_reads_to_counters(spark, tmp_path):
    lines = ["@HD\tVN:1.6", sam(99, 1, 1000, 60, "20S81M", "=", 1200, 300), sam(99, 1, 1010, 60, "101M", "=", 1200, 300), sam(99, 1, 990, 60, "101M", 5, 100, 0), sam(99, "MT", 5, 60, "101M", "=", 9, 9), sam(99, 2, 2000, 60, "50M5D51M", "=", 2100, 200)]
    (tmp_path / "a.sam").write_text("\n".join(lines) + "\n")
    reads = alignments.read_alignments(spark, str(tmp_path / "a.sam"))
    assert sorted((r.chr_idx, r.start, r.end, r.read_type) for r in reads.collect()) == [(1, 990, 1091, 4), (1, 1000, 1081, 1), (1, 1010, 1111, 0), (2, 2000, 2106, 3)]
    got = calling.breakpoint_counters(reads).collect()
    assert [(r.chr_idx, r.pos, r.unpaired_soft, r.left_coverage, r.right_coverage, r.normal_spans) for r in got] == [(1, 1000, 1, 1, 2, 1)]
    spans = {(r.chr_idx, r.pos): r.normal_spans for r in calling.depth_profile(reads).collect()}
    assert spans[(2, 2000)] == 1 and spans[(2, 2050)] == 0 and spans[(2, 2055)] == 1 and spans[(2, 2106)] == 0


def test_breakpoint_table_round_trip(spark, tmp_path):
    lines = ["1\t1000\t1001\t2,1,0,3,0,0,10,1,0,0,0,0\t10,14\t|5:1000(3,2,4/6)\t7:200-450_INV|(0,0,5?/9)#;X:77|(1,0,!/3)\t>1_1:|ACGT(3);", "X\t5\t6\t0,0,0,9,0,0,1,0,0,0,0,0\t8,9\t#\t#\t#", "chr1\t5\t6\t0,0,0,9,0,0,1,0,0,0,0,0\t8,9\t.\t.\t."]
    with gzip.open(tmp_path / "a.bed.gz", "wt") as f:
        f.write(breakpoints.HEADER + "\n" + "\n".join(lines) + "\n")
    got = breakpoints.read_breakpoints(spark, str(tmp_path / "a.bed.gz"))
    assert sorted(r.value for r in breakpoints.breakpoint_lines(got).collect()) == sorted(lines[:2])


def test_count_repair(spark, tmp_path):
    (tmp_path / "a.bed").write_text("1\t1000\t1001\t2,1,0,3,0,0,12,1,0,0,0,0\t10,14\t.\t.\t.\n")
    r = breakpoints.read_breakpoints(spark, str(tmp_path / "a.bed")).first()
    assert (r.normal_spans, r.paired_soft, r.unpaired_soft) == (10, 4, 3)


def test_panel(spark, tmp_path):
    from pyspark.sql import functions as F

    for k in range(3):
        (tmp_path / f"{k}.bed").write_text(f"1\t1000\t1001\t6,6,0,3,0,0,2,1,0,0,0,0\t30,30\t.\t|5:1000({5 + k},1,4/6)\t.\nY\t{7 + k}\t{8 + k}\t0,0,0,12,0,0,1,0,0,0,0,0\t30,30\t.\t.\t.\n")
    bps = breakpoints.read_breakpoints(spark, [str(tmp_path / f"{k}.bed") for k in range(3)]).withColumn("file_id", F.regexp_extract("file", r"(\d)\.bed", 1).cast("int"))
    lines = [r.value.split("\t") for r in breakpoints.panel_lines(calling.build_panel(bps, 3), 3).collect()]
    assert [x[:5] + x[9:] for x in lines][-1] == ["1", "1000", "1001", "3", "3", "0,1,2"] and [x[0] for x in lines] == ["Y", "Y", "Y", "1"]
    (tmp_path / "panel.bed").write_text("\n".join("\t".join(x) for x in lines) + "\n")
    back = breakpoints.read_panel(spark, str(tmp_path / "panel.bed"), 3)
    assert sorted((r.contig, r.hits) for r in back.collect()) == [("1", 3), ("Y", 2), ("Y", 2), ("Y", 2)]


def test_panel_reduces_loci_of_neighbours(spark, tmp_path):
    from pyspark.sql import functions as F

    line = lambda pos, at, soft: f"1\t{pos}\t{pos + 1}\t{soft},0,0,3,0,0,90,1,0,0,0,0\t99,99\t.\t|5:{at}(6,1,9/9)\t.\n"
    for k, (pos, at) in enumerate(((1000, 9000), (1010, 9050), (1020, 9100), (9000, 50000))):
        (tmp_path / f"{k}.bed").write_text(line(pos, at, 20 if k in (1, 3) else 0))
    bps = breakpoints.read_breakpoints(spark, [str(tmp_path / f"{k}.bed") for k in range(4)]).withColumn("file_id", F.regexp_extract("file", r"(\d)\.bed", 1).cast("int"))
    got = {r.pos: (r.file_ids, [(x.pos, x.ext_pos, x.support) for x in r.loci]) for r in calling.build_panel(bps, 4).collect()}
    # the first of three near ones takes in the samples of all; a position that stood for its locus alone goes, one with breaks of its own stays
    assert got == {1000: ([0, 1, 2], [(9000, 9000, 3)]), 1010: ([1], []), 9000: ([3], [(50000, 50000, 1)])}
