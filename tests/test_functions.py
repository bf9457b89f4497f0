"""Functions on fixtures worked out by hand, and against sequential versions."""

import random
from fractions import Fraction

import pandas as pd
import pytest
from pyspark.sql import functions as F

from locusflow.functions import cigar, contigs, loci, numeric, reads, sequence
from locusflow.operators import consensus, intervals
from locusflow.sources import breakpoints

CIGARS = [
    (1000, "20S81M", 101, 1081, [(1000, "S", 20, False)], [(False, 1000, 0, 20)]),
    (1000, "81M20S", 101, 1081, [(1081, "S", 20, True)], [(True, 1081, 81, 20)]),
    (2000, "50M5D51M", 101, 2106, [(2050, "D", 5, True), (2055, "#", -1, True)], []),
    (2000, "50M5I46M", 101, 2096, [(2050, "I", 5, True)], []),
    (3000, "10S40M5D51M", 101, 3096, [(3000, "S", 10, False), (3040, "D", 5, True), (3045, "#", -1, True)], [(False, 3000, 0, 10)]),
    (4000, "30H71M", 71, 4071, [(4000, "H", 30, False)], []),
    (5000, "10S81M10S", 101, 5081, [(5000, "S", 10, False), (5081, "S", 10, True)], [(False, 5000, 0, 10), (True, 5081, 91, 10)]),
    (6000, "10S40M5D31M20S", 101, 6076, [(6000, "S", 10, False), (6040, "D", 5, True), (6045, "#", -1, True), (6076, "S", 20, True)], [(False, 6000, 0, 10), (True, 6076, 81, 20)]),
]


def test_cigar(spark):
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CIGARS)], "i int, start int, cigar string, n int")
    df = df.withColumn("d", cigar.decode(F.col("start"), F.col("cigar"), F.col("n")))
    got = df.select("i", "d.end", cigar.breaks(F.col("start"), F.col("d")).alias("b"), cigar.overhangs(F.col("start"), F.col("d")).alias("o")).orderBy("i").collect()
    for r, want in zip(got, CIGARS):
        assert r.end == want[3]
        assert [tuple(x) for x in r.b] == want[4]
        assert [tuple(x) for x in r.o] == want[5]


@pytest.mark.parametrize(
    "text, want",
    [
        ("|5:1000(3,2,4/6)", dict(right_side=True, contig_idx=5, pos=1000, ext_pos=1000, support=3, secondary=2, mates=4, expected=6, distant=True, fuzzy=False, strict_fuzzy=False)),
        ("7:200-450_INV|(0,0,5?/9)#", dict(right_side=False, inverted=True, fuzzy=True, mates=5, semi_suspicious=True, expected=9, error_prone=True)),
        ("X:77|(1,0,!/3)", dict(contig_idx=40, suspicious=True, expected=3, strict_fuzzy=True)),
    ],
)
def test_locus(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string").withColumn("x", loci.parse_locus(F.col("t")))
    r = df.select("x", loci.format_locus(F.col("x")).alias("again")).first()
    assert r.again == text
    assert {k: r.x[k] for k in want} == want


def test_numbers(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (1.0, 16.0)], "a double, b double").withColumn("r", numeric.ratio(F.col("a"), F.col("b")))
    got = df.select("r", numeric.holds(F.col("r") > 0.5).alias("over"), numeric.fixed3("r").alias("t")).collect()
    assert [x.over for x in got] == [False, True, False]
    assert got[0].r is None and got[1].r == float("inf") and got[2].t == "0.062"


def test_read_class(spark):
    def one(cig, mapq=60, supp=False, distant=False, clip=(), full=40.0, n=101):
        df = spark.range(1).withColumn("d", cigar.decode(F.lit(1000), F.lit(cig), F.lit(n)))
        medians = F.array(*(F.lit(float(x)) for x in clip)).cast("array<double>")
        return df.select(reads.read_class(F.lit(supp), F.lit(mapq), F.col("d.chunks"), medians, F.lit(full), F.lit(n), F.lit(distant)).alias("c")).first().c

    assert one("101M") == 0
    assert one("101M", distant=True) == 4
    assert one("20S81M", clip=[40]) == 1
    assert one("20S81M", clip=[15]) == 5
    assert one("20S81M", clip=[-1]) == 5
    assert one("30H71M", supp=True) == 2
    assert one("50M5D51M") == 3
    assert one("50M5D51M", distant=True) == 4
    assert one("20S81M", mapq=5, clip=[40]) == 5
    assert one("60S41M", mapq=5, clip=[40]) == 1
    assert one("10S81M10S", mapq=0, clip=[40, 40]) == 5


def test_quality_run(spark):
    df = spark.createDataFrame([([5] * 6 + [40] * 20,), ([5] * 5 + [40] * 20,), ([],)], "q array<int>")
    assert [r[0] for r in df.select(reads.quality_median(F.col("q"))).collect()] == [-1.0, 40.0, -1.0]


def plain_dust(seq):
    """All intervals of up to 62 triplets; those above the threshold of which no part scores more are masked."""
    t, masked = [seq[i : i + 3] for i in range(len(seq) - 2)], set()
    score = {}
    for a in range(len(t)):
        for b in range(a + 1, min(len(t), a + 62)):
            score[a, b] = Fraction(sum(t[i] == t[j] for i in range(a, b + 1) for j in range(a, i)), b - a)
    most = {}
    for a, b in sorted(score, key=lambda x: x[1] - x[0]):
        inner = max(most.get((a, b - 1), 0), most.get((a + 1, b), 0))
        if score[a, b] > 2 and score[a, b] >= inner:
            masked |= set(range(a, b + 3))
        most[a, b] = max(inner, score[a, b])
    return masked


def test_dust():
    ratio = lambda *s: sequence.masked_ratios(list(s)).tolist()
    assert ratio("A" * 40, "AC", "acgx") == [1.0, 0.0, 0.0]
    assert all(x != x for x in ratio("", "N", "xyz", "NNN"))
    assert ratio() == []
    r = random.Random(1)
    noise = "".join(r.choice("ACGT") for _ in range(60))
    assert ratio(noise)[0] < 0.3
    seqs = [noise + "CA" * 30 + noise, "A" * 100, "ACG" * 30, "TTTTTT", "TTTTT"]
    seqs += ["".join(r.choice(["A", "C", "AC", "GGG", "TTTA", "T"]) for _ in range(r.randint(1, 40))) for _ in range(25)]
    want = [len(plain_dust(s)) / len(s) for s in seqs]
    assert 0 < sum(0 < x < 1 for x in want)
    assert ratio(*seqs) == want
    assert sequence.masked_ratios(seqs, held=50).tolist() == want
    x, y = seqs[0], seqs[7]
    assert ratio(f"{x}N{y}", f"{x[:9]}x{x[9:]}") == [(len(plain_dust(x)) + len(plain_dust(y))) / len(x + y), want[0]]


def test_sessions(spark):
    rows = [(1, 1000, 0), (1, 1200, 1), (1, 1600, 2), (1, 3000, 0)]
    s = intervals.gap_sessions(spark.createDataFrame(rows, "k int, pos int, source int"), ["k"], "pos", 350)
    got = intervals.session_evidence(s, ["k"], "pos", "source", 5).orderBy("first_pos").collect()
    assert [(r.first_pos, r.last_pos, r.power, r.evidence) for r in got] == [(1000, 1200, 2, 2), (1600, 1600, 1, 3)]


def test_watermark_pool(spark):
    starts = [100, 600, 689, 1000, 1100, 1240, 1300]
    got = intervals.watermark_pool(spark.createDataFrame([(1, s) for s in starts], "k int, pos int"), "k", "pos", 300, 251)
    assert {(r.pos, r.watermark, r.pool) for r in got.collect()} >= {(1000, 1240, 4)}


def test_coverage_is_pile_up(spark):
    r = random.Random(3)
    rows = [(r.randint(1, 3), s := r.randint(0, 60), s + r.randint(1, 9)) for _ in range(200)]
    got = intervals.coverage(spark.createDataFrame(rows, "k int, s int, e int").repartition(7), ["k"], "s", "e").collect()
    for x in got:
        assert x.depth == sum(k == x.k and s <= x.pos < e for k, s, e in rows)


def test_overhang_clusters(spark):
    seqs = ["ACGTACGTACGTACGTACGTACGT", "ACGTACGTACGTACGTACGTAC", "ACGTACGTACTTACGTACGTA", "TTTTTTTTTTTTTTTTTTTTTT", "TTT"]
    df = spark.createDataFrame([(1, i, s, True) for i, s in enumerate(seqs)], "k int, i int, s string, r boolean")
    got = consensus.cluster_overhangs(df, ["k"], "s", "r", "i").collect()
    assert {(x.parent, x.children) for x in got} == {(seqs[0], 3), (seqs[3], 2)}


def test_defuzz(spark):
    cols = "k int, pos int, lo int, hi int, support int, mates int, expected int"
    rows = [(1, 100, 500, 560, 1, 3, 4), (1, 104, 540, 540, 5, 1, 9), (1, 900, 5000, 5100, 1, 2, 2), (1, 2000, 520, 520, 2, 1, 1)]
    got = consensus.defuzz(spark.createDataFrame(rows, cols), ["k"], 300, 10).toPandas().sort_values("pos")
    assert got[["pos", "lo", "mates", "expected"]].values.tolist() == [[104, 540, 3, 9], [900, 5000, 2, 2], [2000, 520, 1, 1]]


def test_tables_without_rows(spark):
    empty = spark.createDataFrame([], "k int, s int, e int")
    assert intervals.coverage(empty, ["k"], "s", "e").count() == 0
    assert isinstance(intervals.gap_sessions(empty, ["k"], "s", 5).toPandas(), pd.DataFrame)


def test_contig_numbers_of_odd_names(spark):
    names = ["1", "22", "007", "1_alt", "9999999999", "1.5", "12345", "hs37d5", "X", "Yq", "GL000191.1", "GLx", "MT", "NC_007605", "phiX174", "chr1", "", "٣", None]
    got = [r[0] for r in spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string").orderBy("k").select(contigs.contig_index(F.col("n"))).collect()]
    assert got == [1, 22, 7, 1, None, 1, 12345, 999, 40, 41, 191, 1003, 1001, 1000, 1002, 1003, 1003, 1003, 1003]


def test_rows_are_left_out_before_lines_are_split(spark, tmp_path):
    (tmp_path / "p.bed").write_text("Y\t7\t8\t3\t0\t0.1\t0.0\tNA\t|5:10-50_INV(1,2,!/3)#;X:77|(1,0,4?/0)\nchrUn\t1\t2\t1\t0\t0\t0\tNA\t.\n")
    for read in (breakpoints.read_panel(spark, str(tmp_path / "p.bed"), 7), breakpoints.read_breakpoints(spark, str(tmp_path / "p.bed"))):
        plan = read._jdf.queryExecution().optimizedPlan().toString()
        assert not any("split(" in line for line in plan.splitlines() if "Filter" in line)
    got = breakpoints.read_panel(spark, str(tmp_path / "p.bed"), 7).collect()
    assert [(r.contig, r.panel_idx, r.hits) for r in got] == [("Y", 23, 6)]
    assert [(x.contig_idx, x.pos, x.ext_pos, x.right_side, x.inverted, x.support, x.secondary, x.mates, x.expected, x.suspicious, x.semi_suspicious, x.error_prone, x.fuzzy, x.strict_fuzzy, x.distant) for x in got[0].loci] == [
        (5, 10, 50, True, True, 1, 6, 0, 3, True, False, True, True, True, True), (40, 77, 77, False, False, 1, 6, 4, 0, False, True, False, False, True, False)]
