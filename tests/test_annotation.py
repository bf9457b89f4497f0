"""Breakpoint tables and a panel to events, file to file, and sources of odd files."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from locusflow.functions import contigs
from locusflow.operators import intervals, support
from locusflow.plans import annotating
from locusflow.sources import breakpoints


def row(contig, pos, double=".", single=".", soft=9, spans=30, over="."):
    return f"{contig}\t{pos}\t{pos + 1}\t{soft},4,8,3,0,0,{spans},0,0,0,0,0\t60,60\t{double}\t{single}\t{over}"


TUMOUR = [
    row(1, 10000, "|5:20000(9,6,12/13)", over=">1_1:" + "A" * 40 + "(3);"), row(5, 20000, "1:10000|(9,6,12/13)"), row(2, 30000, "|7:40000(12,6,14/14)"), row(7, 40003), row(3, 50000, "|8:60000(12,6,14/14)"), row(9, 70000, "|1:90000(1,0,!/9)"),
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("bps")
    for name, lines in (("t.bed.gz", TUMOUR), ("c.bed.gz", [row(11, 5)])):
        with gzip.open(at / name, "wt") as f:
            f.write(breakpoints.HEADER + "\n" + "\n".join(lines) + "\n")
    read = lambda name: annotating.positions(breakpoints.read_breakpoints(spark, str(at / name), line_index=True))
    (at / "panel.bed").write_text("11\t5\t6\t3\t0\t0.1\t0.0\tNA\t.\n")
    panel = breakpoints.read_panel(spark, str(at / "panel.bed"), 30).withColumn("at", contigs.contig_index(F.col("contig")))
    return at, read("t.bed.gz"), read("c.bed.gz"), panel


def test_events_of_a_table(spark, tables):
    _, tumour, control, panel = tables
    got = annotating.annotated(tumour, panel, control, 30).collect()
    assert sorted((r.category, r.ctg1, r.pos1, r.ctg2, r.pos2) for r in got) == [(0, 3, 50000, 8, 60000), (1, 2, 30000, 7, 40003), (2, 1, 10000, 5, 20000)]
    lines = {r.category: r.line.split("\t") for r in got}
    assert all(len(x) == 20 for x in lines.values())
    assert lines[2][:9] == ["1", "9999", "10000", "5", "19999", "20000", "SOMATIC(0/30):0.000", "SOMATIC(0/30):0.000", "TRA"]
    assert lines[2][9:] == ["5", "NA", "NORMAL", "27", "0.474", "27", "0.474", "|5:20000(9,6,12/13)", "1:10000|(9,6,12/13)", ">1_1:" + "A" * 40 + "(3);", "."]
    assert lines[0][7] == "UNKNOWN(0/30):0.000" and lines[0][14:18] == ["UNKNOWN", "UNKNOWN", "|8:60000(12,6,14/14)", "_"] and lines[1][17] == "_"


def test_events_without_control_or_positions(spark, tables):
    _, tumour, control, panel = tables
    assert annotating.annotated(tumour.where("id < 0"), panel, control, 30).count() == 0
    assert annotating.annotated(tumour, panel.where("pos < 0"), None, 30).count() <= 3


def test_line_index_and_writer(spark, tables, tmp_path):
    at, *_ = tables
    got = breakpoints.read_breakpoints(spark, str(at / "t.bed.gz"), line_index=True)
    assert sorted((r.line_index, r.contig) for r in got.collect()) == [(0, "1"), (1, "5"), (2, "2"), (3, "7"), (4, "3"), (5, "9")]
    breakpoints.write_breakpoints(got, str(tmp_path / "out"))
    lines = [x.strip("\n") for f in sorted((tmp_path / "out").glob("part-*")) for x in open(f)]
    assert lines[0] == breakpoints.HEADER and sorted(lines[1:]) == sorted(TUMOUR) and [int(x.split("\t")[0]) for x in lines[1:]] == [1, 2, 3, 5, 7, 9]
    assert breakpoints.panel_file("x/y", 9) == "x/y_9_mergedBpCounts.bed"


def test_bad_rows_end_a_strict_run(spark, tmp_path):
    (tmp_path / "bad.bed").write_text("1\t5\t6\n")
    breakpoints.read_breakpoints(spark, str(tmp_path / "bad.bed")).count()
    with pytest.raises(Exception, match="eight fields"):
        breakpoints.read_breakpoints(spark, str(tmp_path / "bad.bed"), strict=True).collect()
    (tmp_path / "list").write_text("b.bed\n\na.bed\n")
    assert breakpoints.read_list(spark, str(tmp_path / "list")) == ["b.bed", "a.bed"]


def test_files_are_numbered_and_written_whole(spark, tables, tmp_path):
    at, *_ = tables
    paths = [str(at / "c.bed.gz"), str(at / "t.bed.gz")]
    got = breakpoints.read_breakpoints(spark, paths, line_index=True)
    assert sorted((r.file_id, r.line_index) for r in got.collect()) == [(0, 0)] + [(1, k) for k in range(6)]
    out = tmp_path / "files"
    breakpoints.write_breakpoint_files(got.where("file_id = 1"), str(out))
    files = sorted(p.name for p in out.iterdir())
    assert files[-1].endswith(".gz") and "_files.json" in files and not any(f.startswith("_tmp") for f in files)
    back = breakpoints.read_breakpoints(spark, [str(out / f) for f in files if f.endswith(".gz")], line_index=True)
    assert [r.value for r in breakpoints.breakpoint_lines(back.orderBy("file_id", "line_index")).collect()] == sorted(TUMOUR, key=lambda x: int(x.split("\t")[0]))
    with pytest.raises(Exception):
        broken = got.withColumn("pos", F.when(F.col("contig") == "9", F.raise_error(F.lit("stop"))).otherwise(F.col("pos")))
        breakpoints.write_breakpoint_files(broken, str(tmp_path / "none"))
    assert not list((tmp_path / "none").glob("*.gz")) if (tmp_path / "none").exists() else True


def test_every_field_is_checked_in_a_strict_run(spark, tmp_path):
    good = row(1, 5, "|5:1000(3,2,4/6)")
    for k, bad in enumerate((good.replace("\t5\t", "\tx\t", 1), good.replace("9,4,8", "9,,8"), good.replace("60,60", "60"), good.replace("(3,2,4/6)", "(3,2/6)"))):
        (tmp_path / f"{k}.bed").write_text(good + "\n" + bad + "\n")
        assert breakpoints.read_breakpoints(spark, str(tmp_path / f"{k}.bed")).count() == 2
        with pytest.raises(Exception, match="cannot be read"):
            breakpoints.read_breakpoints(spark, str(tmp_path / f"{k}.bed"), strict=True).collect()


def test_bins_of_sessions_and_marks_change_nothing(spark):
    r = random.Random(8)
    data = [(r.choice([1, 2, None]), r.randrange(-300, 3000), r.randrange(9)) for _ in range(300)]
    df = spark.createDataFrame(data, "contig int, pos int, n int")
    rows = lambda x: sorted(map(str, x.collect()))
    whole = rows(intervals.gap_sessions(df, ["contig"], "pos", 12))
    assert all(rows(intervals.gap_sessions(df, ["contig"], "pos", 12, width=w)) == whole for w in (5, 40, 700, 1 << 16))
    known = df.where("contig is not null")
    counts = {(c, p) for c, p, _ in data if c}
    starts = {c: sorted(p for k, p, _ in data if k == c) for c in (1, 2)}
    want = sorted((c, p, m, sum(m - 55 <= x <= m for x in starts[c])) for c, p in counts for m in [max(x for x in starts[c] if x <= p + 25)])
    for w in (60, 300, 1 << 16):
        assert sorted(map(tuple, intervals.watermark_pool(known, "contig", "pos", 30, 25, width=w).collect())) == want
    profile = df.groupBy("contig", "pos").agg(F.max("n").alias("depth"))
    near = [rows(intervals.neighbour_depth(profile, ["contig"], width=w)) for w in (7, 100, 1 << 16)]
    assert near[0] == near[1] == near[2]


def test_bins_change_nothing(spark):
    r = random.Random(3)
    reads = spark.createDataFrame([(r.randint(1, 2), s, s + r.randint(0, 90)) for s in (r.randint(-300, 900) for _ in range(400))], "contig int, start int, end int")
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole = rows(intervals.coverage(reads, ["contig"], "start", "end"))
    assert all(rows(intervals.coverage(reads, ["contig"], "start", "end", width=w)) == whole for w in (7, 64, 1000))
    at = reads.select("contig", "start").distinct()
    index = rows(support.running_index(at, ["contig"], "start", 50).select("running_index", "contig", "start"))
    assert [x[1:] for x in index] == sorted(map(tuple, at.collect())) and [x[0] for x in index] == list(range(1, at.count() + 1))


MORE = [
    *TUMOUR[:5], row(4, 80000, "|6:90000(12,6,14/14)"), row(6, 90010, "4:80700|(9,6,12/13)"), row(10, 5000, "|12:7000-7040(0,9,14/14)"),
    "13\t4000\t4001\t0,0,0,9,0,0,20,0,0,0,0,0\t60,60\t.\t.\t>7_1:|" + "ACGT" * 8 + "(9)",
]


def read_all(spark, at, name, lines):
    with gzip.open(at / name, "wt") as f:
        f.write(breakpoints.HEADER + "\n" + "\n".join(lines) + "\n")
    return breakpoints.read_breakpoints(spark, str(at / name), line_index=True)


def test_annotation_of_a_sample(spark, tmp_path):
    tumour = annotating.positions(read_all(spark, tmp_path, "t.bed.gz", MORE))
    control = annotating.control_positions(read_all(spark, tmp_path, "c.bed.gz", [row(11, 5), row(1, 10001, "|5:20001(5,5,9/9)"), row(1, 10200, "|5:20100(9,9,9/9)")]))
    (tmp_path / "panel.bed").write_text("12\t7052\t7053\t2\t0\t0.1\t0.0\tNA\t.\n12\t6000\t6001\t1\t0\t0.1\t0.0\tNA\t.\n")
    panel = breakpoints.read_panel(spark, str(tmp_path / "panel.bed"), 30).withColumn("at", contigs.contig_index(F.col("contig")))
    seen = []
    for n in (1, 16):
        got = annotating.annotate(tumour.repartition(n), panel, control.repartition(n), 30, control_level=1)
        got.write(str(tmp_path / f"out{n}"))
        seen.append([x.strip("\n") for f in sorted((tmp_path / f"out{n}").glob("part-*")) for x in open(f)])
        assert (got.level, got.foreign) == (0, False)
    assert seen[0] == seen[1]  # lines and their order don't follow the partitions
    rows = [x.split("\t") for x in seen[0]]
    assert rows[0] == ["##13", "3999", "4000", "SOMATIC(0/30):0.000", ">7_1:|" + "ACGT" * 8 + "(9)"] and seen[0][1] == "#controlMassiveInvPrefilteringLevel\t1"
    events = {(x[0], x[2], x[3], x[4]): x for x in rows[2:]}
    assert set(events) == {("3", "50000", "8", "59999"), ("2", "30000", "7", "40002"), ("10", "5000", "12", "6999"), ("4", "80000", "6", "90009"), ("6", "90010", "4", "80699")} | ({("1", "10000", "5", "19999")} & set(events))
    assert events["4", "80000", "6", "90009"][17] == "4:80700|(9,6,12/13)"  # the wider search
    assert events["10", "5000", "12", "6999"][7] == "UNKNOWN(2/30):0.000"  # the end with more panel hits


def test_control_in_doubt_is_left_out(spark, tmp_path):
    lines = [row(1, 1000, "|1:5000_INV(9,9,9/9)"), row(1, 2000, "|1:5000_INV(9,2,9/9)"), row(1, 3000, "|5:5000(2,2,9/9)"), row(1, 4000, soft=1), row(1, 6000, soft=30)]
    bps = read_all(spark, tmp_path, "c.bed.gz", lines)
    kept = lambda level: sorted(r.pos for r in annotating.control_positions(bps, level).collect())
    assert kept(0) == [1000, 2000, 3000, 4000, 6000] and kept(1) == [1000, 3000, 6000] and kept(2) == [3000, 6000]


def test_partners_against_brute_force(spark):
    r = random.Random(11)
    loci = []
    for _ in range(120):
        pos = r.randrange(9000)
        wide = r.choice([0, 0, 30, 900, 40_000])
        loci.append(f"{'|' if r.random() < 0.5 else ''}{r.choice([1, 2, 'MT', 30])}:{pos}{'-' + str(pos + wide) if wide else ''}")
    text = lambda t: (t if t[0] == "|" else t + "|") + f"({r.randint(0, 3)},{r.randint(0, 3)},{r.choice(['0', '4', '!'])}/{r.randint(0, 9)})"
    rows = [(i, r.choice(["1", "2"]), p, ";".join(text(r.choice(loci)) for _ in range(r.randint(0, 3))) or ".") for i, p in enumerate(sorted(r.sample(range(9000), 60)))]
    raw = spark.createDataFrame(rows, "id long, contig string, pos int, text string").withColumn("at", contigs.contig_index(F.col("contig"))).withColumn("loci", breakpoints._loci(F.col("text")))
    within, size = 303, 2 * int(2.5 * 101)
    bps = [x.asDict(recursive=True) for x in raw.collect()]
    gap = lambda x, p: max(0, x["pos"] - p, p - x["ext_pos"])
    near = lambda a, y, far: a["at"] == y["contig_idx"] and (gap(y, a["pos"]) <= size if y["fuzzy"] else abs(a["pos"] - y["pos"]) <= far)
    want = []
    for a in bps:
        for k, x in enumerate(a["loci"]):
            if x["suspicious"] or x["support"] + x["secondary"] + x["mates"] < 3 or x["contig_idx"] == 30:
                continue
            met = sorted((gap(x, b["pos"]), b["pos"], b["id"], b) for b in bps if b["at"] == x["contig_idx"] and b["id"] != a["id"] and gap(x, b["pos"]) <= within)
            double = [(a["id"], k, b["id"], j) for *_, b in met for j, y in enumerate([y for y in b["loci"] if not y["suspicious"] and near(a, y, within)])]
            wide = next((y for y in met[0][3]["loci"] if not y["suspicious"] and near(a, y, 3 * within)), None) if met else None
            want += double or [(a["id"], k, met[0][2] if met else None, 0 if wide else None)]
    got = [(x["id"], x["k"], x["other"], x["j"] if x["y"] else None) for x in annotating.partnered(raw, bins=256).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len({w[2] is None for w in want}) == 2


def test_events_put_down_in_a_contaminated_sample(spark, tmp_path):
    long = ">1_1:|" + "A" * 80 + "(9)"
    lines = [line for i in range(25) for line in (row(1, 10_000 + 5000 * i, f"|5:{20_000 + 5000 * i}(9,0,12/13)", over=long), row(5, 20_000 + 5000 * i, f"1:{10_000 + 5000 * i}|(9,6,12/13)"))]
    lines.sort(key=lambda x: (int(x.split("\t")[0]), int(x.split("\t")[1])))
    (tmp_path / "panel.bed").write_text("11\t5\t6\t3\t0\t0.1\t0.0\tNA\t.\n")
    panel = breakpoints.read_panel(spark, str(tmp_path / "panel.bed"), 30).withColumn("at", contigs.contig_index(F.col("contig")))
    got = annotating.annotate(annotating.positions(read_all(spark, tmp_path, "t.bed.gz", lines)), panel, None, 30)
    found = [r.line.split("\t") for r in got.events.collect()]
    assert got.foreign and got.overhangs is None and got.preamble == ["#likelyPathogenInTumor\tTRUE"]
    assert len(found) == 25 and all(x[8:10] == ["CONTAMINATION", "1"] for x in found)
