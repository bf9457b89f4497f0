"""Reads to breakpoint tables, against a model that goes through the reads of each position one after the other."""

import math
import os
import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from locusflow.functions import reads
from locusflow.functions.sequence import masked_ratio
from locusflow.operators import evidence
from locusflow.operators.consensus import Parents, grouped_overhangs
from locusflow.plans import calling, read_view
from locusflow.plans.cuts import cut, folder, tabled
from locusflow.sources import alignments, breakpoints

RL, T = 101, 5
WIDE = int(2.5 * RL)


def contig(name):
    return {"X": 40, "Y": 41, "MT": 1001, "hs37d5": 999}.get(name) or int(name)


def name(idx):
    return {40: "X", 41: "Y", 1001: "MT", 999: "hs37d5"}.get(idx, str(idx))


def shift(cigar):
    """Where the largest clip of a supplementary alignment lies, seen from its start."""
    n, seen, total, left, indel, best = "", False, 0, 0, 0, (0, 0)
    for ch in cigar:
        if ch.isdigit():
            n += ch
            continue
        k, n = int(n), ""
        if ch in "SH":
            if ch == "S" and not seen:
                left = k
            if k > best[0]:
                best = (k, total + indel - left if seen else 0)
            total += k if ch == "S" else 0
        elif ch == "M":
            seen, total = True, total + k
        elif ch == "I":
            total, indel = total + k, indel - k
        elif ch == "D":
            indel += k
    return best[1]


class Locus:
    def __init__(self, c, pos, end, mapq, right, inv, distant, slack, low, nul, ids=(), ids2=()):
        self.c, self.pos, self.end, self.mapq, self.right, self.inv, self.distant, self.slack, self.low, self.nul = c, pos, end, mapq, right, inv, distant, slack, low, nul
        self.fuzzy, self.n, self.ids, self.ids2 = pos != end, 1, set(ids), set(ids2)
        self.sup = self.sec = self.mates = self.expected = 0
        self.suspicious = self.semi = self.gone = self.prone = False

    def copy(self):
        out = Locus.__new__(Locus)
        out.__dict__ |= self.__dict__ | {"ids": set(self.ids), "ids2": set(self.ids2)}
        return out

    def near(self, o):
        return (self.inv, self.c, self.right) == (o.inv, o.c, o.right) and o.pos - self.end <= 2 * WIDE and self.pos - o.end <= 2 * WIDE

    def take(self, o):
        if self.fuzzy and not o.fuzzy:
            self.pos = self.end = o.pos
            self.fuzzy, self.distant = False, self.distant or o.distant
        elif self.fuzzy and o.fuzzy:
            self.pos, self.end = min(self.pos, o.pos), max(self.end, o.end)

    def count(self):
        self.sup, self.sec = len(self.ids), len(self.ids2)

    def text(self):
        place = f"{name(self.c)}:{self.pos}" + (f"-{self.end}" if self.fuzzy else "")
        mates = "!" if self.suspicious else f"{self.mates}" + "?" * (self.semi or self.nul)
        return "|" * self.right + place + "_INV" * self.inv + "|" * (not self.right) + f"({self.sup},{self.sec},{mates}/{self.expected})" + "#" * self.prone


def find(xs, x):
    return next((a for a in xs if a.near(x)), None)


def loci_of(r, pos, right, number):
    out = []
    mine = dict(ids=[number]) if not r["supplementary"] else dict(ids2=[number])
    for part in [p for p in r["sa_tag"].split(";") if p]:
        f = part.split(",")
        c, at = contig(f[0]), int(f[1]) + shift(f[3])
        far = abs(pos - at)
        if c <= 1001:
            out.append(Locus(c, at, at, int(f[4]), right, (f[2] == "+") != r["fwd"], c != r["chr_idx"] or far > 2000, min(far, 5 * RL) if c == r["chr_idx"] else 5 * RL, r["low_mapq"], r["null_mapq"], **mine))
    m, c = r["mate_pos"], r["mate_chr_idx"]
    if r["distant_mate"] and c <= 1001 and not any(x.c == c and x.pos - x.slack <= m <= x.end + x.slack for x in out):
        out.append(Locus(c, m, m + 1, 0, right, r["inverted_mate"], True, 5 * RL, r["low_mapq"], r["null_mapq"], **mine))
    return out


def model(rows, counters, proper=None):
    """Lines of the breakpoint table."""
    reads = sorted(rows, key=lambda r: (r["chr_idx"], r["start"], r["name"], r["flag"]))
    lines, index = [], 0
    for b in sorted(counters, key=lambda b: (b["chr_idx"], b["pos"])):
        line, index = position(b, [r for r in reads if r["chr_idx"] == b["chr_idx"]], index, proper)
        if line:
            lines.append(line)
    return lines


def position(b, reads, index, proper):
    n, pos, chrom = dict(b), b["pos"], b["chr_idx"]
    at = lambda r, kinds: next((x for x in r["breaks"] if x["pos"] == pos and x["type"] == kinds), None)
    soft = [r for r in reads if r["read_type"] == 1 and at(r, "S") and not r["supplementary"]][:2001]
    hards = [r for r in reads if r["read_type"] == 2 and at(r, "H") and r["supplementary"]]
    hard = [r for r in hards if not (r["low_mapq"] or r["null_mapq"])][:2001]
    poor = [r for r in hards if r["low_mapq"] or r["null_mapq"]]
    poor = poor if len(poor) <= 50 else []
    event, art = n["unpaired_soft"] + n["unpaired_hard"] + n["short_indel"], n["low_breaks_soft"] + n["low_spans_soft"] + n["low_spans_hard"]
    side = lambda r: next(x for x in r["breaks"] if x["pos"] == pos)["right"]
    missing, over, double, prim = False, "", [], []
    if event + art > 50 and art / (event + art) > 0.85:
        index, missing = index + 1, True
    else:
        last = max(r["start"] for r in reads if r["start"] <= pos + round(2.51 * RL))
        near = [r for r in reads if last - round(3 * RL) - round(2.51 * RL) < r["start"] <= pos + round(2.51 * RL)]
        pools = {(right, low): [] for right in (True, False) for low in (True, False)}
        errors = {True: 0, False: 0}
        for r in near:
            sides = [True, False] if r["start"] < pos < r["end"] else [r["start"] < pos]
            low5 = r["read_type"] == 5 and not r["supplementary"] and r["distant_mate"]
            ok = r["mate_chr_idx"] <= 1001 and not (r["mate_chr_idx"] == 2 and r["mate_pos"] // 10000 == 3314)
            if r["read_type"] in (0, 3) or (r["read_type"] == 4 and ok):
                for s in sides:
                    errors[s] += 1
            if not (ok and (r["read_type"] == 4 or low5)):
                continue
            low = low5 or r["null_mapq"]
            if low and not pos - round(1.11 * RL) <= r["start"] <= pos + round(0.51 * RL):
                continue
            for s in sides:
                pools[s, low].append(dict(c=r["mate_chr_idx"], lo=r["mate_pos"], hi=r["mate_pos"], rs=r["start"], re=r["end"], inv=r["inverted_mate"], src=2, ev=3, own=low5 and any(x["pos"] == pos for x in r["breaks"]), power=1, turned=int(r["inverted_mate"]), used=False))
        if event < T and all(len(p) < T for p in pools.values()):
            if art < n["normal_spans"]:
                return None, index
            index, missing = index + 1, True
        else:
            index += 1
            over, prim, n = clusters(soft, side, pos, pools, n, index)
            double, prim, second, n = pair(hard, poor, side, pos, chrom, pools, prim, n, len(hard))
            double, prim, n = mates(pools, double, prim, second, n, pos, errors, proper)
    if event + n["mate_support"] + art < T or (event + art < T and not double and not prim):
        return None, index
    if missing or (not double and not prim and len(over) < 2):
        art2 = n["low_breaks_soft"] + n["low_spans_hard"] + n["low_spans_soft"] + n["repetitive"]
        ev2 = n["paired_soft"] + n["paired_hard"] + n["unpaired_soft"] + n["unpaired_hard"] + n["short_indel"]
        strict = n["paired_soft"] + n["unpaired_soft"] + n["paired_hard"] + n["low_breaks_soft"] + n["low_spans_soft"] + n["repetitive"]
        if not (ev2 + art2 > 10 and strict > 0):
            return None, index
    show = lambda xs: ";".join(x.text() for x in xs) or "."
    tail = ["#", "#", "#"] if missing else [show(double), show(prim), over or "."]
    return "\t".join([name(chrom), str(pos), str(pos + 1), ",".join(str(n[k]) for k in breakpoints.COUNTS), f"{n['left_coverage']},{n['right_coverage']}", *tail]), index


def mate(r, src):
    return dict(c=r["mate_chr_idx"], lo=r["mate_pos"], hi=r["mate_pos"], rs=r["start"], re=r["end"], inv=r["inverted_mate"], src=src, ev=1, own=False, power=1, turned=int(r["inverted_mate"]), used=False)


def clusters(soft, side, pos, pools, n, index):
    seq = {}
    for i, r in enumerate(soft):
        o = next((o for o in r["overhangs"] if o["pos"] == pos), None)
        seq[i] = r["seq"][o["off"] : o["off"] + o["n"]] if o else ""
        if r["distant_mate"] and r["mate_chr_idx"] <= 1001:
            pools[side(r), r["low_mapq"] or r["null_mapq"]].append(mate(r, 0))
    parents, short = [], []

    def agree(p, i):
        a, b = (seq[p], seq[i]) if side(soft[p]) else (seq[p][::-1], seq[i][::-1])
        return side(soft[p]) == side(soft[i]) and sum(x != y and "N" not in (x, y) for x, y in zip(a, b)) <= 2

    def gather(xs, found):
        for x in found:
            a = find(xs, x)
            if a is None:
                xs.append(x.copy())
            else:
                a.take(x)
                a.mapq, a.n = max(a.mapq, x.mapq), a.n + 1

    for i in sorted(seq, key=lambda i: (-len(seq[i]), i)):
        found, met = loci_of(soft[i], pos, side(soft[i]), i), False
        for p in parents:
            if agree(p["i"], i):
                met = True
                p["kids"].append(i)
                gather(p["loci"], found)
        if met:
            continue
        if (found and all(x.distant for x in found)) or masked_ratio(seq[i]) <= 0.5:
            if len(seq[i]) >= 20:
                parents.append({"i": i, "kids": [i], "loci": []})
                gather(parents[-1]["loci"], found)
            else:
                for x in found:
                    a = find(short, x)
                    if a is None:
                        short.append(x.copy())
                    else:
                        a.take(x)
                        a.ids.add(i)
                        a.nul = a.nul and soft[i]["null_mapq"]
        else:
            n["unpaired_soft"] -= 1
            n["repetitive"] += 1
    shown, prim = [], []
    for p in parents:
        if len(p["kids"]) >= T:
            s = seq[p["i"]]
            shown.append(f">{index}_{len(shown) + 1}:" + ("|" + s if side(soft[p["i"]]) else s + "|") + f"({len(p['kids'])})")
        for x in p["loci"]:
            a = find(prim, x)
            if a is None:
                prim.append(x.copy())
                prim[-1].ids |= set(p["kids"])
            else:
                a.take(x)
                a.ids |= set(p["kids"])
                a.nul = a.nul and prim[-1].nul
    if not shown:
        return "", prim, n
    for x in short:
        a = find(prim, x)
        if a is None:
            prim.append(x.copy())
        else:
            a.take(x)
            a.ids |= x.ids
            a.nul = a.nul and x.nul
    return ";".join(shown), prim, n


def pair(hard, poor, side, pos, chrom, pools, prim, n, start):
    lists = ([], [])
    for k, rows in enumerate((hard, poor)):
        for i, r in enumerate(rows):
            for x in loci_of(r, pos, side(r), i + k * start):
                if not (x.inv and x.pos == pos and x.c == chrom):
                    lists[k].append(x)
                    if x.distant:
                        pools[x.right, bool(k)].append(mate(r, 1))
    double, white = [], set()
    for p in prim:
        hit = False
        for k in (0, 1):
            for y in lists[k]:
                if p.near(y):
                    p.take(y)
                    p.ids2 |= y.ids2
                    white |= y.ids2 if k else set()
                    hit = y.gone = True
        if hit:
            double.append(p.copy())
            p.gone = True
    prim, second = [p for p in prim if not p.gone], [y for ys in lists for y in ys if not y.gone]
    n["unpaired_hard"] += len(white)
    n["low_breaks_hard"] -= len(white)
    best = max([x.mapq for x in double + prim], default=0)
    prim = [x for x in prim if not (0 < x.mapq < 13 and x.mapq < best)]
    for x in double + prim:
        x.count()
        x.gone = False
    a, c = len(set().union(*(x.ids for x in double))), len(set().union(*(x.ids2 for x in double)))
    n["unpaired_soft"], n["paired_soft"] = n["unpaired_soft"] - a, n["paired_soft"] + a
    n["unpaired_hard"], n["paired_hard"] = n["unpaired_hard"] - c, n["paired_hard"] + c
    return double, prim, second, n


def compress(pool, pos):
    out = []
    for m in sorted(pool, key=lambda m: (m["c"], m["lo"], m["rs"], m["re"], m["inv"])):
        if not out or out[-1]["c"] != m["c"] or m["lo"] - out[-1]["hi"] > 3.5 * RL:
            out.append(dict(m))
            continue
        o = out[-1]
        o["hi"], o["power"], o["turned"] = max(o["hi"], m["hi"]), o["power"] + 1, o["turned"] + m["inv"]
        left = abs(pos - m["rs"]) <= abs(pos - m["re"])
        if (abs(pos - o["re"]) > abs(pos - m["re"])) if left else (abs(pos - o["rs"]) > abs(pos - m["rs"])):
            o["rs"], o["re"] = m["rs"], m["re"]
        if {o["src"], m["src"]} == {0, 1}:
            o["ev"], o["src"] = 2, 2
        if o["ev"] != 3 and m["ev"] == 3:
            o["ev"], o["src"] = 3, 2
    return [o for o in out if o["ev"] > 1 or o["power"] >= T]


def mates(pools, double, prim, second, n, pos, errors, proper):
    good = {s: compress(pools[s, False], pos) for s in (True, False)}
    total = {s: sum(m["power"] for m in good[s]) for s in good}
    wrong = {s: 0.0 for s in good}
    if proper is not None:
        for s in good:
            e = errors[s] * (0.9 - proper)
            total[s], wrong[s] = max(0, math.floor(abs(total[s] - e) + 0.5) * (1 if total[s] >= e else -1)), e / 2

    def at(m, x):
        return m["c"] == x.c and m["lo"] - x.slack <= (x.end if x.fuzzy else x.pos) and x.pos <= m["hi"] + x.slack

    def gain(x):
        x.expected, level, k, low = total[x.right], 0, 0, pools[x.right, True]
        for m in good[x.right]:
            if at(m, x):
                n["mate_support"] += 0 if m["used"] else m["power"]
                m["used"] = True
                x.mates += m["power"]
                if x.fuzzy:
                    x.pos, x.end = min(x.pos, m["lo"]), max(x.end, m["hi"])
                level = max(level, m["ev"])
        for m in low:
            if at(m, x):
                n["mate_support"] += 0 if m["used"] else 1
                m["used"] = True
                x.mates, k = x.mates + 1, k + 1
                if not m["own"]:
                    level = max(level, m["ev"])
        x.expected += k + min(k, len(low) - k)
        thin = x.sec == 0 and x.sup < T
        if x.mates == 0:
            x.gone, x.suspicious = thin, not thin
        else:
            x.semi = level < 3
            x.gone = x.gone or (level < 3 and thin and not (x.expected and x.mates / x.expected > 0.33 or not x.expected))

    for x in double:
        if x.distant:
            gain(x)
    for x in prim:
        if x.distant:
            gain(x)
        elif x.sup < T:
            x.gone = True
        if x.mapq == 0 and x.mates == 0 and x.n < 2 * T:
            x.gone = True
    cand = []
    for _, _, x in sorted((-x.mapq, -i, x) for i, x in enumerate(second)):
        a = find(cand, x)
        if a is None:
            cand.append(x.copy())
        else:
            a.take(x)
            a.mapq, a.nul = max(a.mapq, x.mapq), a.nul and x.nul
            a.ids2 |= x.ids2
    origins = set()
    for x in cand:
        x.count()
        x.gone = False
        if x.distant:
            gain(x)
            if x.mates > 0:
                double.append(x)
            elif x.low or x.nul or x.mapq < 13:
                origins |= x.ids2
    k = min(n["low_breaks_hard"], len(origins))
    n["low_breaks_hard"], n["low_breaks_soft"] = n["low_breaks_hard"] - k, n["low_breaks_soft"] + k
    for s in (True, False):
        for m in good[s]:
            off = pos - m["re"] if s else m["rs"] - pos
            if not m["used"] and m["ev"] == 3 and (total[s] == 0 or m["power"] / total[s] >= 0.33) and off < RL // 2:
                x = Locus(m["c"], m["lo"], m["hi"], 0, s, 2 * m["turned"] > m["power"], True, 5 * RL, False, False)
                x.mates, x.expected = m["power"], total[s]
                prim.append(x)
    double = [x for x in double if not (x.gone or (x.fuzzy and x.mates == 0))]
    prim = [x for x in prim if not (x.gone or (x.fuzzy and x.mates == 0))]
    for d in double:
        for y in prim:
            if d.near(y):
                d.sup, d.sec = max(d.sup, y.sup), max(d.sec, y.sec)
                if y.expected > 0 and (d.expected <= 0 or y.mates / y.expected > d.mates / d.expected):
                    d.mates, d.expected = y.mates, y.expected
                y.gone = True
    out = []
    for xs in (double, [y for y in prim if not y.gone]):
        xs = [x for x in xs if (x.sup > 0 and x.sec > 0) or x.sup + x.sec + x.mates >= T]
        for x in xs:
            if x.distant and proper is not None:
                x.prone, x.expected = x.mates < wrong[x.right], max(x.expected, x.mates)
        out.append(xs)
    return *out, n


def sam(q, flag, rname, pos, mapq, cig, rnext, pnext, tlen, seq, sa=""):
    return "\t".join(map(str, (q, flag, rname, pos, mapq, cig, rnext, pnext, tlen, seq, "I" * len(seq)))) + (f"\tNM:i:0\tSA:Z:{sa};" if sa else "")


def stream(seed):
    """Alignments around a few places, with partners, mates and noise."""
    r = random.Random(seed)
    base = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    rows = []
    places = [(r.choice(["1", "2", "X"]), 5000 + 400 * k + r.randrange(60)) for k in range(16)]
    ends = {p: (r.choice(["5", "7", p[0]]), r.choice([9000, 20000, 33_145_000]) + r.randrange(40), base(80)) for p in places}
    for p in places:
        (c, pos), (oc, opos, over) = p, ends[p]
        for _ in range(r.choice([3, 8, 14])):  # soft clips, on either side
            k, right = r.randint(8, 60), r.random() < 0.7
            text = list(over[:k])
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                text[r.randrange(k)] = r.choice("ACGTN")
            if r.random() < 0.1:
                text = list("A" * k)
            far = r.random() < 0.6
            mate = (oc if oc != c else "=", opos + r.randint(-200, 200), 0 if oc != c else 9000) if far else ("=", pos + 200, 300)
            sa = ";".join(f"{x},{opos + r.choice([0, 0, 3, 800])},{r.choice('+-')},{k}M{101 - k}S,{r.choice([0, 9, 60])},0" for x in r.sample([oc, "9", "MT"], r.choice([0, 1, 1, 2])))
            mapq = r.choice([60, 60, 60, 9, 0])
            seq = (base(101 - k) + "".join(text)) if right else ("".join(text)[::-1] + base(101 - k))
            rows.append((c, pos - (101 - k) if right else pos, lambda q, a, s=seq, m=mate, x=sa, mq=mapq, k=k, right=right: sam(q, r.choice([99, 83, 67]), a[0], a[1], mq, f"{101 - k}M{k}S" if right else f"{k}S{101 - k}M", *m, s, x)))
        for _ in range(r.choice([0, 4, 9])):  # supplementary, hard-clipped
            k, right = r.randint(25, 60), r.random() < 0.7
            sa = f"{oc},{opos + r.choice([0, 2, 700])},{r.choice('+-')},{k}M{101 - k}S,{r.choice([0, 9, 60])},0"
            rows.append((c, pos - (101 - k) if right else pos, lambda q, a, k=k, right=right, x=sa, mq=r.choice([60, 60, 9, 0]): sam(q, 2147, a[0], a[1], mq, f"{101 - k}M{k}H" if right else f"{k}H{101 - k}M", oc if oc != a[0] else "=", opos + r.randint(-99, 99), 9000, base(101 - k), x)))
        for _ in range(r.choice([0, 6, 12])):  # whole reads with distant mates
            oc2, at = r.choice([(oc, opos), (oc, opos), ("9", 7000), ("2", 33_145_500)])
            rows.append((c, pos + r.choice([-130, -60, -40, 5, 90]) + r.randint(-9, 9), lambda q, a, o=oc2, at=at, mq=r.choice([60, 60, 9, 0]): sam(q, r.choice([97, 65]), a[0], a[1], mq, "101M", o if o != a[0] else "=", at + r.randint(-150, 150), 9999, base(101))))
        for _ in range(r.choice([2, 15, 40])):
            rows.append((c, pos + r.randint(-300, 300), lambda q, a, mq=r.choice([60, 60, 60, 5]): sam(q, 99, a[0], a[1], mq, r.choice(["101M", "101M", "50M5D51M", "50M5I46M"]), "=", a[1] + 200, 300, base(101))))
    rows = [(contig(c), at, f(f"q{i}", (c, at))) for i, (c, at, f) in enumerate(rows)]
    return [x[2] for x in sorted(rows)]


@pytest.mark.parametrize("seed, proper", [(1, None), (5, 0.7)])
def test_called_breakpoints(spark, tmp_path, seed, proper):
    (tmp_path / "a.sam").write_text("\n".join(stream(seed)) + "\n")
    reads = cut(alignments.read_alignments(spark, str(tmp_path / "a.sam")))
    rows = [r.asDict(recursive=True) for r in reads.collect()]
    want = model(rows, [r.asDict() for r in calling.breakpoint_counters(reads).collect()], proper)
    made = calling.called_breakpoints(reads, proper_ratio=proper).orderBy("chr_idx", "pos")
    got = [r.value for r in breakpoints.breakpoint_lines(made).collect()]
    assert got == want
    fields = [x.split("\t") for x in got]
    counts = [[int(n) for n in x[3].split(",")] for x in fields]
    assert any(x[5] not in ".#" for x in fields) and any(x[6] not in ".#" for x in fields) and any("(" in x[7] for x in fields)
    assert any(n[0] and n[2] for n in counts) and any(n[1] for n in counts) and any(n[11] for n in counts)


@pytest.mark.parametrize("seed", [1, 2])
def test_called_breakpoints_of_equal_mates(spark, tmp_path, seed):
    """Mates that are the same in all but their names go along as one row with a number."""
    lines = [x.split("\t", 1) for x in stream(seed)]
    more = [f"{q}_{k}\t{rest}" for q, rest in lines for k in range(4 if "\t101M\t" in rest else 1)]
    (tmp_path / "a.sam").write_text("\n".join(more) + "\n")
    reads = cut(alignments.read_alignments(spark, str(tmp_path / "a.sam")))
    want = model([r.asDict(recursive=True) for r in reads.collect()], [r.asDict() for r in calling.breakpoint_counters(reads).collect()], None)
    assert [r.value for r in breakpoints.breakpoint_lines(calling.called_breakpoints(reads).orderBy("chr_idx", "pos")).collect()] == want


def test_pools_have_a_row_for_equal_mates(spark):
    places = spark.createDataFrame([(1, 1000, 700, 1250)], "chr_idx int, pos int, lo int, hi int")
    mates = spark.createDataFrame([(1, 950, 1051, i % 3 == 0, [], 5, 9000, False) for i in range(300)], "chr_idx int, start int, end int, poor boolean, spots array<int>, mate_chr_idx int, mate_pos int, inverted_mate boolean")
    pool = evidence.pooled(places, mates, 112, 52)
    assert sorted((r.right_side, r.poor, r.n) for r in pool.collect()) == [(False, False, 200), (False, True, 100), (True, False, 200), (True, True, 100)]
    assert [r.largest_pool for r in evidence.pool_sizes(pool).collect()] == [200]


def test_counters_do_not_go_back_to_the_reads(spark, tmp_path):
    (tmp_path / "a.sam").write_text("\n".join(stream(1)) + "\n")
    made = calling.breakpoint_counters(alignments.read_alignments(spark, str(tmp_path / "a.sam")))
    assert made.inputFiles() == [] and made.count() > 0


def test_nothing_is_called_without_reads(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@HD\n")
    assert calling.called_breakpoints(alignments.read_alignments(spark, str(tmp_path / "a.sam"))).count() == 0


def test_text_and_reads_are_deleted_once_read(spark):
    there = lambda: {x for x in os.listdir(folder(spark)) if x.startswith(("alignments-", "table-"))}
    before = there()
    made = read_view.called_breakpoints(spark, "/root/testdata/sf0.001")
    assert there() == before and made.count() > 0


def test_alignment_text_is_compressed(spark, monkeypatch):
    monkeypatch.setattr(read_view, "LINES", 1000, raising=False)
    read_view.reads(spark, "/root/testdata/sf0.001")
    at = max((f"{folder(spark)}/{x}" for x in os.listdir(folder(spark)) if x.startswith("alignments-")), key=os.path.getmtime)
    sizes = [os.path.getsize(f"{at}/{x}") for x in os.listdir(at) if x.startswith("part-")]
    want = read_view.sam_lines(read_view.aligned(spark, "/root/testdata/sf0.001"))
    got = spark.read.text(at)
    assert len(sizes) > 3 and 3 * sum(sizes) < want.agg(F.sum(F.length("value") + 1)).first()[0]
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_names_are_held_of_broken_reads_only(spark, tmp_path, monkeypatch):
    """The table of reads has neither names nor other places of reads that break nowhere; those of the others are whole."""
    (tmp_path / "a.sam").write_text("\n".join(stream(1)) + "\n")
    reads = cut(alignments.read_alignments(spark, str(tmp_path / "a.sam")))
    held = []

    class Held(Exception):
        pass

    def hold(df):
        held.append(tabled(df))
        raise Held

    monkeypatch.setattr(calling, "tabled", hold)
    with pytest.raises(Held):
        calling.called_breakpoints(reads)
    assert held[0].count() == reads.count() and held[0].where("size(breaks) = 0").count() > 0
    assert held[0].where("size(breaks) = 0 and (name is not null or sa_tag is not null)").count() == 0
    own = lambda df: df.where("size(breaks) > 0").select("name", "sa_tag", "start")
    assert own(reads).exceptAll(own(held[0])).count() == 0


def test_parents_found_by_pieces():
    r = random.Random(3)
    for _ in range(300):
        root = "".join(r.choice("ACGT") for _ in range(60))
        bent = lambda n: "".join(r.choice("ACGTN") if r.random() < 0.06 else x for x in root[:n])  # noqa: B023, E731
        parents, texts = Parents(), [bent(r.randint(20, 60)) for _ in range(8)]
        for t in texts:
            parents.add(t)
        for _ in range(8):
            b = bent(r.randint(1, 20))
            assert parents.of(b) == [k for k, a in enumerate(texts) if sum(x != y and "N" not in (x, y) for x, y in zip(a, b)) <= 2]


def test_groups_of_overhangs():
    long, other = "ACGTTGCAACGGTTACCGATAGGC", "TTTGACCATGCATTAGACCAGGATC"
    got = grouped_overhangs([long, long[:12], "C" + long[1:9], other, other[::-1], "A" * 30, "A" * 30, "ACG"], [True, True, True, False, True, True, True, False], [False] * 6 + [True, False])
    assert got == ([[6], [3, 7], [4], [0, 1, 2]], [], 1)  # 5 is masked and comes before 6; 7 differs from the end of 3 in two letters


def test_attached_reads_are_capped(spark):
    kinds = "chr_idx int, start int, end int, name string, flag int, read_type int, low_mapq boolean, null_mapq boolean, supplementary boolean, fwd boolean, inverted_mate boolean, distant_mate boolean, mate_chr_idx int, mate_pos int, sa_tag string, seq string, breaks array<struct<pos:int,type:string,size:int,right:boolean>>, overhangs array<struct<right:boolean,pos:int,off:int,n:int>>"
    row = lambda i, kind, poor, pos: (1, 100, pos, f"n{i:05}", 0, kind, poor, False, kind == 2, True, False, False, 1, 9, "", "ACGTAC", [(pos, "S" if kind == 1 else "H", 3, True)], [(True, pos, 3, 3)])
    rows = [row(i, 1, False, 200) for i in range(2050)] + [row(i, 2, True, 200) for i in range(50)] + [row(i, 2, False, 200) for i in range(3)] + [row(i, 2, True, 300) for i in range(51)]
    got = evidence.attached_reads(spark.createDataFrame(rows, kinds).repartition(5), ["start", "name", "flag"])
    n = defaultdict(list)
    for r in got.collect():
        n[r.pos, r.kind].append(r.number)
        assert r.overhang == "TAC"
    assert {k: (len(v), min(v), max(v)) for k, v in n.items()} == {(200, "soft"): (2001, 0, 2000), (200, "hard"): (3, 0, 2), (200, "poor"): (50, 3, 52)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_excluded_regions(spark):
    mates = spark.createDataFrame([(2, 33_139_999), (2, 33_140_000), (2, 33_149_999), (2, 33_150_000), (3, 33_145_000)], "mate_chr_idx int, mate_pos int")
    regions = spark.createDataFrame(calling.EXCLUDED, "contig int, lo int, hi int")
    assert sorted(map(tuple, evidence.excluded(regions, mates, 1000).collect())) == [(2, 33_139_999), (2, 33_150_000), (3, 33_145_000)]


def test_text_median(spark):
    """Qualities as text: as a list of numbers has them, for odd and even lengths, runs of low ones and nothing."""
    texts = ["I", "IJ", "I#J", "#####III", "######II", "II######", ",,,,,,J", "-----,J", "JI" * 50 + "!", "5" * 7 + "9" * 7, "~!" * 9]
    df = spark.createDataFrame([(x,) for x in [*texts, "", None]], "t string")
    got = df.select("t", reads.text_median(F.col("t")).alias("m")).collect()

    def want(t):
        q = [ord(x) - 33 for x in t or ""]
        return statistics.median(q) if q and not any(max(q[i : i + 6]) < 12 for i in range(len(q) - 5)) else -1.0

    assert [r.m for r in got] == [want(r.t) for r in got]


def test_reads_are_decoded_once(spark, tmp_path):
    """The lists of a position need one scan of the alignments, and the shuffle takes no whole sequences."""
    spark.createDataFrame([("r1\t99\t1\t1000\t60\t60M41S\t=\t1150\t250\t" + "ACGT" * 25 + "A\t" + "I" * 101,)], "value string").write.text(str(tmp_path / "sam"))
    made = evidence.attached_reads(alignments.read_alignments(spark, str(tmp_path / "sam")), ["start", "name", "flag"])
    assert [(r.pos, r.kind, r.number, r.overhang) for r in made.collect()] == [(1060, "soft", 0, ("ACGT" * 25 + "A")[60:])]
    plan = made._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan text") == 1


def test_median_from_is_the_median_held_against_a_number(spark):
    r = random.Random(4)
    texts = [None, "", "I", "8", "79", "88", "7997", "!!!!!!IIIIIIII"] + ["".join(chr(33 + r.choice([r.randint(0, 41), r.randint(21, 25)])) for _ in range(r.randint(1, 12))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for least in (-1, 0, 12, 23, 24):
        assert df.where(reads.median_from(F.col("t"), least) != (reads.text_median(F.col("t")) >= least)).count() == 0
