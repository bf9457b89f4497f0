"""Queries over the driver tables and their SQL, by name. Each applies one operator to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cigar as cg
from ..functions import contigs, loci, numeric, reads, sequence
from ..operators import consensus, events, intervals, lookups, pairs, verdicts
from .adapters import ED, IV, LO, table
from .adapters import edges as edge_view
from .adapters import intervals as interval_view
from .adapters import loci as locus_view
from .event_view import EV, EVENT
from . import event_queries, partner_queries, read_view, table_queries

QUERIES: dict = {}
SQL: dict[str, str] = {}
c, lit = F.col, F.lit
DELTAS = "d AS (SELECT contig, pos, CAST(sum(x) AS BIGINT) AS x FROM (SELECT contig, s AS pos, 1 AS x FROM iv UNION ALL SELECT contig, e, -1 FROM iv) GROUP BY ALL)"
PROFILE = f"WITH {IV}, {DELTAS}, p AS (SELECT contig, pos, CAST(sum(x) OVER (PARTITION BY contig ORDER BY pos) AS BIGINT) AS depth FROM d)"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _profile(spark, d):
    return intervals.coverage(interval_view(spark, d), ["contig"], "start", "end")


@query(f"{PROFILE} SELECT contig, pos, depth FROM p")
def coverage_depth(spark, d):
    return _profile(spark, d)


@query(f"""WITH {IV}, d AS (SELECT contig, pos, sum(CASE WHEN flag = 'R' THEN x ELSE 0 END) AS r, sum(CASE WHEN flag = 'A' THEN x ELSE 0 END) AS a, sum(CASE WHEN flag = 'N' THEN x ELSE 0 END) AS n
 FROM (SELECT contig, s AS pos, 1 AS x, flag FROM iv UNION ALL SELECT contig, e, -1, flag FROM iv) GROUP BY ALL)
 SELECT contig, pos, CAST(sum(r) OVER w AS BIGINT) AS spans_r, CAST(sum(a) OVER w AS BIGINT) AS spans_a, CAST(sum(n) OVER w AS BIGINT) AS spans_n FROM d WINDOW w AS (PARTITION BY contig ORDER BY pos)""")
def coverage_by_class(spark, d):
    return intervals.coverage(interval_view(spark, d), ["contig"], "start", "end", {f"spans_{k.lower()}": F.when(c("flag") == k, 1).otherwise(0) for k in "RAN"})


@query(f"{PROFILE} SELECT contig, pos, coalesce(lag(depth) OVER (PARTITION BY contig ORDER BY pos), 0) AS left_depth, depth AS right_depth FROM p")
def left_right_coverage(spark, d):
    return intervals.neighbour_depth(_profile(spark, d), ["contig"])


@query(f"""WITH {IV}, b AS (SELECT contig, s AS pos, flag, false AS far FROM iv UNION ALL SELECT contig, e, flag, true FROM iv)
 SELECT contig, pos, count(*) FILTER (flag = 'R') AS soft, count(*) FILTER (flag = 'A') AS hard, count(*) FILTER (flag = 'N') AS indel, count(*) FILTER (far) AS right_sided FROM b GROUP BY contig, pos""")
def break_counters(spark, d):
    both = F.explode(F.array(F.struct(c("start").alias("pos"), lit(False).alias("far")), F.struct(c("end").alias("pos"), lit(True).alias("far"))))
    rows = interval_view(spark, d).select("contig", "flag", both.alias("b")).select("contig", "b.pos", "b.far", "flag")
    return rows.groupBy("contig", "pos").agg(F.count_if(c("flag") == "R").alias("soft"), F.count_if(c("flag") == "A").alias("hard"), F.count_if(c("flag") == "N").alias("indel"), F.count_if("far").alias("right_sided"))


SESSIONS = f"""WITH {LO}, g AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY contig ORDER BY pos, ord) > 120 THEN 1 ELSE 0 END AS fresh FROM lo),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY contig ORDER BY pos, ord ROWS UNBOUNDED PRECEDING) AS k FROM g)"""


@query(f"{SESSIONS} SELECT contig, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS power FROM s GROUP BY contig, k")
def gap_sessions(spark, d):
    s = intervals.gap_sessions(locus_view(spark, d), ["contig"], "pos", 120, width=4096)
    return s.groupBy("contig", "session").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count(lit(1)).alias("power")).drop("session")


@query(f"""{SESSIONS}, x AS (SELECT contig, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS power,
 CASE WHEN bool_or(ord % 3 = 2) THEN 3 WHEN bool_or(ord % 3 = 0) AND bool_or(ord % 3 = 1) THEN 2 ELSE 1 END AS evidence FROM s GROUP BY contig, k)
 SELECT * FROM x WHERE evidence > 1 OR power >= 5""")
def session_evidence(spark, d):
    s = intervals.gap_sessions(locus_view(spark, d), ["contig"], "pos", 120, width=4096).withColumn("source", c("ord") % 3)
    return intervals.session_evidence(s, ["contig"], "pos", "source", 5).drop("session")


@query(f"""WITH {LO}, a AS (SELECT contig, pos, ord FROM lo WHERE kind < 'm'), b AS (SELECT contig, pos, value FROM lo WHERE kind >= 'm')
 SELECT a.ord, count(*) AS hits, min(abs(a.pos - b.pos)) AS nearest, count(*) FILTER (abs(a.pos - b.pos) <= 5) AS conservative_hits FROM a JOIN b ON a.contig = b.contig AND abs(a.pos - b.pos) <= 60 GROUP BY a.ord""")
def band_join_nearest(spark, d):
    rows = locus_view(spark, d)
    a, b = rows.where("kind < 'm'").select("contig", "pos", "ord"), rows.where("kind >= 'm'").select("contig", c("pos").alias("b_pos"))
    gap = F.abs(c("pos") - c("b_pos"))
    return intervals.band_join(a, b, ["contig"], "pos", "b_pos", 60).groupBy("ord").agg(F.count(lit(1)).alias("hits"), F.min(gap).alias("nearest"), F.count_if(gap <= 5).alias("conservative_hits"))


@query(f"""WITH {LO}, p AS (SELECT contig, pos, count(*) AS n FROM lo GROUP BY ALL),
 w AS (SELECT contig, pos, max(pos) OVER (PARTITION BY contig ORDER BY pos RANGE BETWEEN UNBOUNDED PRECEDING AND 251 FOLLOWING) AS watermark FROM p),
 q AS (SELECT contig, pos, CAST(sum(n) OVER (PARTITION BY contig ORDER BY pos RANGE BETWEEN 551 PRECEDING AND CURRENT ROW) AS BIGINT) AS pool FROM p)
 SELECT w.contig, w.pos, w.watermark, q.pool FROM w JOIN q ON q.contig = w.contig AND q.pos = w.watermark""")
def asof_watermark_pool(spark, d):
    return intervals.watermark_pool(locus_view(spark, d), "contig", "pos", 300, 251)


RECIPROCAL = f"""WITH {ED}, r AS (SELECT a.id, b.id AS mate_id FROM ed a JOIN ed b ON a.a_contig = b.b_contig AND a.b_contig = b.a_contig
 AND abs(a.b_pos - b.a_pos) <= 20 AND abs(a.a_pos - b.b_pos) <= 20 AND a.id <> b.id)"""


@query(f"{RECIPROCAL} SELECT id, mate_id FROM r")
def reciprocal_pairs(spark, d):
    return pairs.reciprocal(edge_view(spark, d), 20)


@query(f"""{RECIPROCAL}, t AS (SELECT DISTINCT id FROM r), n AS (SELECT DISTINCT a_contig AS contig, a_pos AS pos FROM ed),
 o AS (SELECT DISTINCT ed.id FROM ed JOIN n ON n.contig = ed.b_contig AND abs(n.pos - ed.b_pos) <= 20)
 SELECT ed.id, CASE WHEN t.id IS NOT NULL THEN 'two-sided' WHEN o.id IS NOT NULL THEN 'one-sided' ELSE 'unknown' END AS status FROM ed LEFT JOIN t USING (id) LEFT JOIN o USING (id)""")
def partner_status(spark, d):
    e = edge_view(spark, d)
    return pairs.partner_status(e, e.select(c("a_contig").alias("contig"), c("a_pos").alias("pos")).distinct(), 20)


PANEL = "pa AS (SELECT contig, pos, count(*) AS hits FROM lo WHERE kind >= 'm' GROUP BY ALL)"


def _panel(spark, d):
    return locus_view(spark, d).where("kind >= 'm'").groupBy("contig", "pos").agg(F.count(lit(1)).alias("hits"))


@query(f"""WITH {LO}, {PANEL}, a AS (SELECT ord, contig, pos FROM lo WHERE kind < 'm'), j AS (SELECT a.ord, pa.hits, pa.pos - a.pos AS off FROM a JOIN pa ON a.contig = pa.contig AND abs(pa.pos - a.pos) < 600),
 b AS (SELECT ord, hits, off FROM j QUALIFY row_number() OVER (PARTITION BY ord ORDER BY hits DESC, abs(off), off) = 1), k AS (SELECT ord, max(hits) AS close_hits FROM j WHERE abs(off) <= 50 GROUP BY ord)
 SELECT a.ord, coalesce(b.hits, 0) AS hits, coalesce(k.close_hits, 0) AS close_hits, coalesce(b.off, -9999) AS gap FROM a LEFT JOIN b USING (ord) LEFT JOIN k USING (ord)""")
def panel_hits(spark, d):
    rows = locus_view(spark, d).where("kind < 'm'").select("ord", "contig", "pos")
    return lookups.nearby_hits(rows, _panel(spark, d), "ord", 600, 50).withColumn("gap", F.coalesce("gap", lit(-9999)))


@query(f"""WITH {LO}, {PANEL}, a AS (SELECT ord AS id, contig, pos AS lo, pos + CASE WHEN ord % 2 = 0 THEN 400 ELSE 10 END AS hi FROM lo WHERE kind < 'm'), c AS (SELECT id, contig, lo AS pos FROM a UNION ALL SELECT id, contig, hi FROM a WHERE hi - lo > 30),
 h AS (SELECT c.id, c.pos, coalesce(max(pa.hits), 0) AS hits FROM c LEFT JOIN pa ON c.contig = pa.contig AND abs(pa.pos - c.pos) < 200 GROUP BY c.id, c.pos)
 SELECT id, pos, hits FROM h QUALIFY row_number() OVER (PARTITION BY id ORDER BY hits DESC, pos) = 1""")
def unmatched_place(spark, d):
    links = locus_view(spark, d).where("kind < 'm'").select(c("ord").alias("id"), "contig", c("pos").alias("lo"), (c("pos") + F.when(c("ord") % 2 == 0, 400).otherwise(10)).alias("hi"))
    return lookups.better_place(links, _panel(spark, d), 200, 20, 30)


@query(f"""WITH {ED}, n AS (SELECT DISTINCT a_contig AS contig, a_pos AS pos FROM ed)
 SELECT ed.id, n.pos AS partner_pos, abs(n.pos - ed.b_pos) > 5 AS widened FROM ed JOIN n ON n.contig = ed.b_contig AND abs(n.pos - ed.b_pos) <= 15
 QUALIFY row_number() OVER (PARTITION BY ed.id ORDER BY abs(n.pos - ed.b_pos), n.pos) = 1""")
def nearest_partner(spark, d):
    e = edge_view(spark, d)
    return lookups.nearest_partner(e, e.select(c("a_contig").alias("contig"), c("a_pos").alias("pos")).distinct(), 5)


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def unvisited_anti(spark, d):
    return pairs.unvisited(table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey").select("o_orderkey")


@query(f"WITH {ED} SELECT id, CASE WHEN a_contig <> b_contig THEN 1000000 ELSE greatest(0, b_pos - a_pos, a_pos - (b_pos + 50)) END AS distance FROM ed")
def range_distance(spark, d):
    return edge_view(spark, d).select("id", loci.range_distance(c("a_contig"), c("a_pos"), c("b_contig"), c("b_pos"), c("b_pos") + 50).alias("distance"))


@query(f"WITH {LO} SELECT user_id, ord, CAST(rank AS INT) AS rank FROM (SELECT user_id, ord, row_number() OVER (PARTITION BY user_id ORDER BY pos, ord) AS rank FROM lo) WHERE rank <= 20")
def first_n_cap(spark, d):
    return intervals.first_n(locus_view(spark, d), ["user_id"], ["pos", "ord"], 20).select("user_id", "ord", "rank")


@query(f"WITH {LO} SELECT user_id, kind, ord FROM lo QUALIFY count(*) OVER (PARTITION BY user_id, kind) <= 15")
def overflow_clears(spark, d):
    return intervals.cleared_beyond(locus_view(spark, d), ["user_id", "kind"], 15).select("user_id", "kind", "ord")


@query(f"""WITH {LO}, p AS (SELECT contig, pos // 60 AS bin, list_sort(list(DISTINCT user_id)) AS ids FROM lo GROUP BY ALL)
 SELECT contig, CAST(bin AS INT) AS bin, CAST(len(ids) AS INT) AS n_files, array_to_string(ids, ',') AS file_ids FROM p""")
def panel_frequency(spark, d):
    ids = F.array_sort(F.collect_set("user_id"))
    rows = locus_view(spark, d).groupBy("contig", F.floor(c("pos") / 60).cast("int").alias("bin")).agg(ids.alias("ids"))
    return rows.select("contig", "bin", F.size("ids").alias("n_files"), F.array_join("ids", ",").alias("file_ids"))


@query("""WITH b AS (SELECT l_partkey, arg_max(l_linenumber, (l_quantity, l_linenumber)) AS spans, max(l_quantity) AS support FROM lineitem GROUP BY l_partkey)
 SELECT l_partkey, round(support / (support + spans), 6) AS clonality FROM b""")
def germline_clonality(spark, d):
    b = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.max(F.struct("l_quantity", "l_linenumber")).alias("b"))
    return b.select("l_partkey", F.round(events.clonality(c("b.l_quantity"), c("b.l_linenumber")), 6).alias("clonality"))


KEY = """CASE WHEN (a_contig, a_pos) <= (b_contig, b_pos) THEN concat_ws('_', a_contig, a_pos, b_contig, b_pos, 5) ELSE concat_ws('_', b_contig, b_pos, a_contig, a_pos, 5) END"""


@query(f"WITH {ED}, k AS (SELECT {KEY} AS key, id FROM ed) SELECT key, id FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY id) = 1")
def canonical_dedup(spark, d):
    e = edge_view(spark, d).select(pairs.canonical_key(c("a_contig"), c("a_pos"), c("b_contig"), c("b_pos"), lit(5)).alias("key"), "id")
    return pairs.first_of_key(e, "key", ["id"])


@query(f"""WITH {ED} SELECT id, CASE WHEN a_contig <> b_contig OR a_pos = b_pos THEN 'TRA' WHEN a_pos % 7 = 0 THEN 'INV'
 WHEN CASE WHEN a_pos < b_pos THEN a_right AND NOT b_right ELSE b_right AND NOT a_right END THEN 'DEL'
 WHEN CASE WHEN a_pos < b_pos THEN b_right AND NOT a_right ELSE a_right AND NOT b_right END THEN 'DUP' ELSE 'TRA' END AS type,
 CASE WHEN a_contig <> b_contig THEN -1 ELSE abs(a_pos - b_pos) END AS size FROM ed""")
def event_typing(spark, d):
    a = (c("a_contig"), c("a_pos"), c("a_right"), c("b_contig"), c("b_pos"), c("b_right"))
    return edge_view(spark, d).select("id", events.event_type(*a, c("a_pos") % 7 == 0).alias("type"), events.event_size(a[0], a[1], a[3], a[4]).alias("size"))


STATUS = "WITH s AS (SELECT l_partkey, count(*) FILTER (l_returnflag = 'R') AS ev, count(*) FILTER (l_returnflag = 'N') AS spans, count(*) FILTER (l_returnflag = 'A') AS art, max(l_linenumber) AS mates, sum(CAST(l_quantity AS BIGINT)) % 100 / 100.0 AS m FROM lineitem GROUP BY l_partkey), r AS (SELECT *, CASE WHEN ev + spans = 0 THEN NULL ELSE ev / (ev + spans) END AS cl, CASE WHEN art + ev = 0 THEN NULL ELSE art / (art + ev) END AS ar FROM s)"


def _support(spark, d):
    flag = lambda k: F.count_if(c("l_returnflag") == k)
    s = table(spark, d, "lineitem").groupBy("l_partkey").agg(flag("R").alias("ev"), flag("N").alias("spans"), flag("A").alias("art"), F.max("l_linenumber").alias("mates"), (F.sum(c("l_quantity").cast("long")) % 100 / 100.0).alias("m"))
    return s.withColumns({"cl": events.clonality(c("ev"), c("spans")), "ar": numeric.ratio(c("art"), c("art") + c("ev"))})


@query(f"""{STATUS} SELECT l_partkey, CASE WHEN cl >= 0.85 THEN 'HOMO' WHEN cl >= 0.05 THEN 'HETERO' WHEN spans > 20 THEN 'EXTREME_SUBCLONAL'
 WHEN (mates > 9 AND m >= 0.4) OR (mates > 4 AND m >= 0.6) THEN 'SUBCLONAL' ELSE 'EXTREME_SUBCLONAL' END AS status FROM r""")
def clonality_status(spark, d):
    return _support(spark, d).select("l_partkey", events.clonality_status(c("cl"), c("spans") > 20, lit(True), c("mates"), c("m")).alias("status"))


@query(f"""{STATUS} SELECT l_partkey, CASE WHEN ar < 0.33 AND m < 0.33 THEN 'CLEAN' WHEN ar > 0.85 AND m > 0.85 THEN 'ARTIFACT' WHEN coalesce(ar > 0.85, false) OR m > 0.85 AND NOT (mates >= 2 AND mates >= 6) THEN
 CASE WHEN NOT (mates >= 6) OR FALSE THEN 'ARTIFACT' WHEN ar > 0.5 AND m > 0.5 AND spans > 10 THEN 'ARTIFACT' WHEN (coalesce(ar > 0.5, false) OR m > 0.5) AND coalesce(cl < 0.05, false) THEN 'ARTIFACT' ELSE 'BORDERLINE' END
 WHEN ar > 0.5 AND m > 0.5 AND spans > 10 THEN 'ARTIFACT' WHEN (coalesce(ar > 0.5, false) OR m > 0.5) AND coalesce(cl < 0.05, false) THEN 'ARTIFACT' ELSE 'BORDERLINE' END AS status FROM r""")
def artifact_status(spark, d):
    e = F.when(c("mates") >= 6, 2).otherwise(0)
    return _support(spark, d).select("l_partkey", events.artifact_status(c("ar"), c("m"), e, e, c("spans") > 10, numeric.holds(c("cl") < 0.05)).alias("status"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(max(spans - greatest(0, spans - least(a, b))) AS INT) AS spans, CAST(max(paired + CASE WHEN paired > 0 THEN greatest(0, spans - least(a, b)) ELSE 0 END) AS INT) AS paired,
 CAST(max(unpaired + CASE WHEN paired > 0 THEN 0 ELSE greatest(0, spans - least(a, b)) END) AS INT) AS unpaired
 FROM (SELECT *, CAST(l_quantity AS INT) AS spans, l_partkey % 30 AS a, l_suppkey % 40 AS b, l_linenumber % 3 AS paired, l_linenumber AS unpaired FROM lineitem) GROUP BY ALL""")
def count_repair(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", c("l_quantity").cast("int").alias("spans"), (c("l_partkey") % 30).alias("a"), (c("l_suppkey") % 40).alias("b"), (c("l_linenumber") % 3).alias("paired"), c("l_linenumber").alias("unpaired"))
    fixed = rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *(x.cast("int").alias(k) for k, x in events.count_repair("spans", "a", "b", "paired", "unpaired").items()))
    return fixed.groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(*(F.max(k).alias(k) for k in ("spans", "paired", "unpaired")))


@query("""SELECT l_partkey, l_suppkey, l_orderkey, CASE WHEN q % 11 > 4 THEN 0 WHEN x > 0.7 AND q % 11 = 0 THEN 3 WHEN x > 0.7 AND (q % 11 < 3 OR (n > 3 AND q % 11 < 10)) THEN 2 WHEN x > 0.6 AND q % 11 < 3 THEN 1 ELSE 0 END AS grade
 FROM (SELECT DISTINCT l_partkey, l_suppkey, l_orderkey, CAST(l_quantity AS INT) AS q, l_linenumber AS n, (l_partkey % 100) / 100.0 AS x FROM lineitem)""")
def contamination_grade(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", c("l_quantity").cast("int").alias("q"), c("l_linenumber").alias("n"), (c("l_partkey") % 100 / 100.0).alias("x")).distinct()
    return rows.select("l_partkey", "l_suppkey", "l_orderkey", events.contamination_grade(c("x"), c("q") % 11, c("n") > 3).alias("grade"))


@query("""SELECT o_orderkey, CASE WHEN t1 AND t2 THEN 9 WHEN t1 THEN 4 WHEN t2 THEN 4 WHEN half OR fuzzy THEN 2 ELSE 0 END AS min_mates,
 CASE WHEN t1 AND t2 THEN 0.8 WHEN t1 THEN 0.8 WHEN t2 THEN 0.6 WHEN half OR fuzzy THEN 0.6 WHEN strict THEN 0.6 WHEN mates < 10 THEN 0.4 ELSE 0.33 END::DOUBLE AS min_ratio
 FROM (SELECT o_orderkey, o_orderkey % 5 = 0 OR o_custkey % 7 = 0 OR (o_custkey % 20) / 10.0 < 1.1 AND false AS t1, o_orderstatus = 'F' AND o_custkey % 3 = 0 AS t2, o_orderstatus = 'F' AS half, o_custkey % 2 = 0 AS fuzzy, o_custkey % 3 = 0 AS strict, o_orderkey % 20 AS mates FROM orders)""")
def mate_tier(spark, d):
    k = c("o_custkey")
    tier = events.mate_tier(c("o_orderkey") % 5 == 0, c("o_orderstatus") == "F", k % 3 == 0, k % 2 == 0, k % 7 == 0, lit(2.0), c("o_orderkey") % 20)
    return table(spark, d, "orders").select("o_orderkey", tier.alias("t")).select("o_orderkey", "t.*")


def _events(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey", *(f"{v} AS {k}" for k, v in EVENT.items()))


@query(f"""WITH {EV} SELECT o_orderkey, CASE WHEN susp1 OR susp2 OR (sui1 AND sui2 AND NOT (e1 = 3 AND e2 = 3)) THEN 1 WHEN (exp1 > 0 AND m1 < 0.1) OR (exp2 > 0 AND m2 < 0.1) THEN 2
 WHEN h1 > 5 AND sui1 AND e1 < 3 AND sup1 <= 9 AND sec1 <= 9 AND mate1 <= 9 AND NOT comp1 THEN 4 WHEN h2 > 5 AND sui2 AND e2 < 3 AND sup2 <= 9 AND sec2 <= 9 AND mate1 <= 9 AND NOT comp2 THEN 5
 WHEN h1 > 5 AND h2 > 5 AND cl1 < 0.2 AND cl2 < 0.2 THEN 4 WHEN h1 > 5 AND h2 > 5 AND NOT (germ1 AND germ2) AND size BETWEEN 1 AND 50 THEN 5
 WHEN NOT distant AND ("semi" OR strict1 OR strict2 OR ((h1 > 5 OR h2 > 5) AND (sup1 + sec1 + mate1 < 5 OR sup2 + sec2 + mate2 < 5))) THEN 13
 WHEN distant AND inter AND m1 = 0 THEN 6 WHEN distant AND inter AND m2 = 0 THEN 7 WHEN distant AND greatest(sup1, sec1, mate2, sup2, sec2) < CASE WHEN "semi" OR prone1 OR prone2 THEN 5 ELSE 3 END THEN 8
 WHEN distant AND m1 < 0.4 AND m2 < 0.4 THEN 11 WHEN distant AND (m1 < 0.25 OR m2 < 0.25) THEN 12 WHEN distant AND (fuzzy1 OR fuzzy2) AND NOT inter AND (strict1 OR strict2) AND size < 5000 THEN 14
 WHEN distant AND (fuzzy1 OR fuzzy2) AND (h1 > 5 OR h2 > 5) THEN 173 WHEN distant AND fuzzy1 AND fuzzy2 AND (m1 < 0.5 OR m2 < 0.5) THEN 174
 WHEN distant AND fuzzy1 AND sup1 + sec1 = 0 AND sui2 THEN 175 WHEN distant AND fuzzy2 AND sup2 + sec2 = 0 AND sui1 THEN 176 WHEN (inter OR size > 150) AND (indel1 > brk1 OR indel2 > brk2) THEN 16
 WHEN status1 = 'EXTREME_SUBCLONAL' THEN 39 WHEN status2 = 'EXTREME_SUBCLONAL' THEN 40 WHEN artifact = 'ARTIFACT' THEN 41 WHEN (germ1 OR germ2) AND h1 > 5 AND h2 > 5 THEN 42
 WHEN h1 > 3 AND (germ1 OR germ2 OR h2 > 5) THEN 431 WHEN h1 > 22.5 THEN 431 WHEN h1 > 9 AND (match1 OR e1 < 3 OR e2 <= 1 OR h2 > 0 OR fuzzy1 OR fuzzy2) THEN 431
 WHEN h2 > 3 AND (germ1 OR germ2 OR h1 > 5) THEN 432 WHEN h2 > 22.5 THEN 432 WHEN h2 > 9 AND (match2 OR e2 < 3 OR e1 <= 1 OR h1 > 0 OR fuzzy1 OR fuzzy2) THEN 432 ELSE 0 END AS reason FROM ev""")
def reason_codes(spark, d):
    return _events(spark, d).select("o_orderkey", events.first_reason(events.two_sided_reasons()).alias("reason"))


@query(f"""WITH {EV} SELECT o_orderkey, CASE WHEN susp1 OR sui1 THEN 1 WHEN exp1 > 0 AND m1 < 0.1 THEN 2 WHEN (h1 > 5 AND ctg1 < 999) OR (h2 > 5 AND ctg2 < 999) THEN 171 WHEN NOT distant AND inv THEN 22
 WHEN NOT distant AND (size BETWEEN 1 AND 50 OR type = 'TRA') THEN 23 WHEN NOT distant AND size > 150 AND indel1 > 0.5 * brk1 THEN 20 WHEN NOT distant AND size > 150 AND indel2 > 0.5 * brk2 THEN 21
 WHEN NOT distant AND (fuzzy1 OR sui1 OR e1 = 1 OR sup1 + sec1 < 3 OR ((h1 > 5 OR h2 > 5) AND ev1 < 5)) THEN 25 WHEN distant AND ((sup1 < 3 AND sec1 < 3 AND mate1 < 3) OR (inter AND mate1 = 0)) THEN 18
 WHEN distant AND inter AND e1 = 1 AND bpmate2 = 0 THEN 19 WHEN distant AND (mate1 < 3 OR m1 < 0.4) THEN 24 WHEN distant AND NOT inter AND (fuzzy1 OR sup1 + sec1 < 3) AND size < 5000 THEN 26
 WHEN distant AND NOT inter AND (fuzzy1 OR sup1 + sec1 < 3) AND inv AND size < 10000 THEN 27 WHEN distant AND fuzzy1 AND sup1 + sec1 = 0 THEN 271 WHEN indel1 > brk1 OR indel2 > brk2 THEN 28
 WHEN status1 = 'EXTREME_SUBCLONAL' THEN 39 WHEN status2 = 'EXTREME_SUBCLONAL' THEN 40 WHEN artifact = 'ARTIFACT' THEN 41 WHEN (germ1 OR germ2) AND h1 > 5 AND h2 > 5 THEN 42
 WHEN h1 > 3 AND (ctg1 <> 999 OR ctg2 = 999 OR h2 > 3) THEN 431 WHEN h1 > 3 AND (h1 > 9 OR germ1 OR germ2 OR h2 > 5) THEN 431
 WHEN h2 > 3 AND (ctg1 = 999 OR ctg2 <> 999 OR h1 > 3) THEN 432 WHEN h2 > 3 AND (h2 > 9 OR germ1 OR germ2 OR h1 > 5) THEN 432 ELSE 0 END AS reason FROM ev""")
def reason_codes_one_sided(spark, d):
    return _events(spark, d).select("o_orderkey", events.first_reason(verdicts.one_sided_reasons()).alias("reason"))


@query(f"""WITH {EV} SELECT o_orderkey, CASE WHEN susp1 OR sui1 THEN 1 WHEN exp1 > 0 AND m1 < 0.1 THEN 2 WHEN brk1 + mate1 + span1 < 10 THEN 29 WHEN h1 > 5 AND ctg1 < 999 THEN 301 WHEN h2 > 5 AND ctg2 < 999 THEN 302
 WHEN NOT distant AND (inv OR ev1 < 5 OR e1 = 1) THEN 30 WHEN NOT distant AND (size BETWEEN 1 AND 50 OR type = 'TRA' OR fuzzy1 OR sui1 OR cand1) THEN 31 WHEN distant AND sup1 < 3 AND sec1 < 3 AND mate1 < 3 THEN 18
 WHEN distant AND mate1 < 3 AND ((h1 > 5 AND h2 > 5) OR (e1 < 3 AND sup1 < 5)) THEN 32 WHEN distant AND m1 < 0.33 THEN 33 WHEN distant AND e1 <> 3 AND ev1 < 5 AND m1 < 0.5 THEN 33
 WHEN distant AND (fuzzy1 OR cand1) AND sup1 = 0 AND sec1 = 0 THEN 36 WHEN indel1 > brk1 THEN 38 WHEN status1 = 'EXTREME_SUBCLONAL' THEN 44 WHEN artifact = 'ARTIFACT' THEN 45
 WHEN (germ1 OR germ2) AND (h1 > 5 OR h2 > 5) THEN 47 WHEN h1 > 3 AND (ctg1 <> 999 OR ctg2 = 999 OR h2 > 3 OR h1 > 9 OR germ1 OR germ2) THEN 471 WHEN h2 > 3 THEN 472 ELSE 0 END AS reason FROM ev""")
def reason_codes_unknown(spark, d):
    return _events(spark, d).select("o_orderkey", events.first_reason(verdicts.unknown_reasons()).alias("reason"))


UNKNOWN_SCORE = """CASE WHEN NOT distant THEN 1 WHEN h1 > 5 AND sec1 < 10 AND ((mate1 < 10 AND sup1 > CASE WHEN h2 > 5 THEN 30 ELSE 50 END) OR (sup1 > 100 AND mate1 < 20)) THEN 1
 WHEN (fuzzy1 OR cand1) THEN CASE WHEN (e1 = 3 OR NOT cand1) AND ((mate1 > 9 AND m1 >= 0.5) OR (mate1 > 5 AND exp1 - mate1 < 3)) AND least(h1, h2) = 0 THEN 4 ELSE 1 END
 WHEN NOT (sup1 = 0 AND sec1 > 0 AND mate1 <= sec1 + 4) AND (sup1 > 4 OR e1 = 3 OR mate1 > 9) THEN 4 ELSE 1 END"""
SCORED = EV.replace("ev AS", "ev0 AS") + ", ev AS (SELECT * REPLACE (sup1 * sup1 AS sup1, sup2 * sup2 AS sup2) FROM ev0), u AS (SELECT *, " + UNKNOWN_SCORE + " AS unknown FROM ev)"


@query(f"""WITH {SCORED}, c AS (SELECT *, distant AND (h1 > 5 AND sec1 < 10 AND ((mate1 < 10 AND sup1 > CASE WHEN h2 > 5 THEN 30 ELSE 50 END) OR (sup1 > 100 AND mate1 < 20))) AS c1,
 distant AND (h2 > 5 AND sec2 < 10 AND ((mate2 < 10 AND sup2 > CASE WHEN h1 > 5 THEN 30 ELSE 50 END) OR (sup2 > 100 AND mate2 < 20))) AS c2, CASE WHEN unknown > 2 THEN unknown ELSE 2 END AS alone, m1 >= 0.8 AND m2 >= 0.8 AND mate1 > 4 AND mate2 > 4 AS strong FROM u)
 SELECT o_orderkey, unknown, CASE WHEN c1 THEN 1 WHEN distant AND (fuzzy1 OR cand1) THEN CASE WHEN e1 = 3 THEN 3 ELSE 0 END WHEN NOT distant AND (ev1 < 5 OR least(sup1, sec1) < 2) THEN 1
 WHEN NOT cand1 AND NOT (sup1 = 0 AND sec1 > 0 AND mate1 <= sec1 + 4) THEN CASE WHEN e1 = 3 THEN 3 ELSE 1 END ELSE 0 END AS one_sided,
 CASE WHEN NOT distant THEN CASE WHEN ev1 >= 5 OR ev2 >= 5 THEN 5 WHEN h1 > 5 OR h2 > 5 THEN 1 ELSE 3 END WHEN c1 OR c2 THEN 2 WHEN sui1 AND e1 < 3 THEN 2 WHEN sui1 AND (sec1 = 0 OR sup1 = 0) AND e2 = 0 THEN 2 WHEN sui2 AND e1 < 3 THEN alone
 WHEN fuzzy1 AND fuzzy2 AND NOT "semi" AND h1 = 0 AND h2 = 0 AND NOT prone1 AND NOT prone2 AND greatest(e1, e2) > 1 AND m1 > 0.5 AND m2 > 0.5 THEN 3 WHEN fuzzy1 AND fuzzy2 AND least(e1, e2) < 3 THEN 2
 WHEN fuzzy1 <> fuzzy2 AND greatest(e1, e2) < 2 THEN 2 WHEN greatest(e1, e2) = 3 THEN 5 WHEN (mate1 < 10 AND m1 < 0.5) OR (mate2 < 10 AND m2 < 0.5) OR (least(mate1, mate2) < 10 AND m1 + m2 < 1.1) THEN 2
 WHEN greatest(e1, e2) <= 1 THEN CASE WHEN NOT "semi" AND h1 = 0 AND h2 = 0 AND NOT prone1 AND NOT prone2 AND strong AND greatest(mate1, mate2) > 9 THEN 3 ELSE 2 END WHEN e2 = 1 THEN CASE WHEN m2 >= 0.8 AND mate2 > 9 THEN alone ELSE 2 END
 WHEN e1 = 1 THEN CASE WHEN m1 >= 0.8 AND mate1 > 9 AND m2 >= 0.6 THEN 5 ELSE 2 END WHEN NOT "semi" AND h1 < 5 AND h2 < 5 AND NOT prone1 AND NOT prone2 AND strong THEN 5 ELSE 2 END AS two_sided FROM c""")
def event_scores(spark, d):
    rows = _events(spark, d).withColumns({k: c(k) * c(k) for k in ("sup1", "sup2")})
    return rows.select("o_orderkey", verdicts.unknown_score().alias("unknown"), verdicts.one_sided_score().alias("one_sided"), verdicts.two_sided_score().alias("two_sided"))


@query(f"""WITH {ED}, n AS (SELECT count(*) FILTER (a_contig = b_contig) AS n, count(*) FILTER (a_contig = b_contig AND NOT a_right) AS k FROM ed)
 SELECT id FROM ed, n WHERE NOT (n.n > 300 AND n.k > 0.4 * n.n AND NOT b_right AND abs(a_pos - b_pos) < 1000)""")
def global_ratio_filter(spark, d):
    e = edge_view(spark, d)
    return events.unless_dominated(e, c("a_contig") == c("b_contig"), ~c("a_right"), 0.4, 300, ~c("b_right") & (F.abs(c("a_pos") - c("b_pos")) < 1000)).select("id")


@query("""WITH q AS (SELECT l_orderkey, list(CAST(l_quantity AS INT)) AS q FROM lineitem GROUP BY l_orderkey)
 SELECT l_orderkey, round(list_aggregate(q, 'median'), 6) AS median FROM q""")
def quality_median(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(c("l_quantity").cast("int")).alias("q")).select("l_orderkey", F.round(reads.median(c("q")), 6).alias("median"))


@query("""WITH r AS (SELECT DISTINCT l_orderkey, l_partkey, CAST(l_quantity AS INT) AS a, l_linenumber AS b FROM lineitem)
 SELECT l_orderkey, l_partkey, a, b, 1000 + 50 + b AS end, concat_ws(';', '1000:S:' || a, CAST(1000 + 50 AS VARCHAR) || ':D:' || b, CAST(1000 + 50 + b AS VARCHAR) || ':#:-1') AS breaks FROM r""")
def cigar_decode(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", c("l_quantity").cast("int").alias("a"), c("l_linenumber").alias("b")).distinct()
    text = F.concat(c("a"), lit("S50M"), c("b"), lit("D0M"))
    rows = rows.withColumn("dec", cg.decode(lit(1000), text, c("a") + 50))
    shown = F.array_join(F.transform(cg.breaks(lit(1000), c("dec")), lambda x: F.concat_ws(":", x["pos"], x["type"], x["size"])), ";")
    return rows.select("l_orderkey", "l_partkey", "a", "b", c("dec.end").alias("end"), shown.alias("breaks"))


LOCUS = "CASE WHEN a_right THEN '|' ELSE '' END || b_contig || ':' || b_pos || CASE WHEN b_right THEN '-' || (b_pos + 40) ELSE '' END || CASE WHEN a_pos % 3 = 0 THEN '_INV' ELSE '' END || CASE WHEN a_right THEN '' ELSE '|' END || '(' || (a_pos % 5) || ',' || (a_pos % 4) || ',' || CASE WHEN a_pos % 11 = 0 THEN '!' ELSE CAST(b_pos % 9 AS VARCHAR) || CASE WHEN b_pos % 2 = 0 THEN '?' ELSE '' END END || '/' || (b_pos % 6) || ')' || CASE WHEN a_pos % 7 = 0 THEN '#' ELSE '' END"


@query(f"""WITH {ED}, t AS (SELECT DISTINCT {LOCUS} AS text, b_contig, b_pos, b_right, a_pos % 5 + a_pos % 4 AS splits, a_pos % 11 = 0 OR b_pos % 6 > 0 AS far FROM ed)
 SELECT text, text AS again, b_contig AS contig_idx, b_pos AS pos, b_right OR splits < 3 AS strict_fuzzy, far AS distant FROM t""")
def locus_parse_format(spark, d):
    text = F.expr(LOCUS.replace("VARCHAR", "STRING"))
    rows = edge_view(spark, d).select(text.alias("text")).distinct().withColumn("x", loci.parse_locus(c("text")))
    return rows.select("text", loci.format_locus(c("x")).alias("again"), "x.contig_idx", "x.pos", "x.strict_fuzzy", "x.distant")


@query("""WITH n AS (SELECT DISTINCT CASE p_size % 9 WHEN 0 THEN CAST(p_partkey % 22 + 1 AS VARCHAR) WHEN 1 THEN 'X' WHEN 2 THEN 'Y' WHEN 3 THEN 'GL000' || (191 + p_partkey % 59) || '.1' WHEN 4 THEN 'hs37d5' WHEN 5 THEN 'NC_007605' WHEN 6 THEN 'MT' WHEN 7 THEN 'phiX174' ELSE 'chr1' END AS name,
 CASE p_size % 9 WHEN 0 THEN p_partkey % 22 + 1 WHEN 1 THEN 40 WHEN 2 THEN 41 WHEN 3 THEN 191 + p_partkey % 59 WHEN 4 THEN 999 WHEN 5 THEN 1000 WHEN 6 THEN 1001 WHEN 7 THEN 1002 ELSE 1003 END AS idx FROM part)
 SELECT name, CAST(idx AS INT) AS idx, CAST(CASE WHEN idx <= 22 THEN idx - 1 WHEN idx = 40 THEN 22 WHEN idx = 41 THEN 23 WHEN idx BETWEEN 191 AND 249 THEN idx - 167 WHEN idx = 999 THEN 83 WHEN idx = 1000 THEN 84 ELSE -2 END AS INT) AS panel FROM n""")
def chrom_index(spark, d):
    k = c("p_size") % 9
    name = F.when(k == 0, (c("p_partkey") % 22 + 1).cast("string")).when(k == 1, "X").when(k == 2, "Y").when(k == 3, F.concat(lit("GL000"), 191 + c("p_partkey") % 59, lit(".1"))).when(k == 4, "hs37d5").when(k == 5, "NC_007605").when(k == 6, "MT").when(k == 7, "phiX174").otherwise("chr1")
    rows = table(spark, d, "part").select(name.alias("name")).distinct().withColumn("idx", contigs.contig_index(c("name")))
    return rows.select("name", "idx", contigs.panel_index(c("idx")).alias("panel"))


@query("""SELECT o_orderkey, (o_orderkey >> 11) & 1 = 1 AS supplementary, (o_orderkey >> 4) & 1 = 0 AS forward, (o_orderkey >> 4) & 1 = (o_orderkey >> 5) & 1 AS inverted,
 CASE WHEN o_custkey % 61 = 0 THEN 2 WHEN o_custkey % 61 < 13 THEN 1 ELSE 0 END AS mapq FROM orders""")
def flag_bits(spark, d):
    k = c("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", reads.supplementary(k).alias("supplementary"), reads.forward(k).alias("forward"), reads.inverted_mate(k).alias("inverted"), reads.mapq_class(c("o_custkey") % 61).alias("mapq"))


@query("""WITH t AS (SELECT c_custkey, '>1_0:' || c_name || '(3);>1_1:' || c_mktsegment || '(' || c_nationkey || ');' AS s, greatest(length(c_name), length(c_mktsegment)) AS n FROM customer)
 SELECT c_custkey, n AS longest, n / 30.0 BETWEEN 0.25 AND 0.8 AS compensates FROM t""")
def overhang_longest(spark, d):
    text = F.concat(lit(">1_0:"), c("c_name"), lit("(3);>1_1:"), c("c_mktsegment"), lit("("), c("c_nationkey"), lit(");"))
    return table(spark, d, "customer").select("c_custkey", sequence.longest_overhang(text).alias("longest"), sequence.overhang_compensates(text, 30).alias("compensates"))


@query("""WITH t AS (SELECT p_partkey, p_type AS a, p_brand AS b, p_size % 2 = 0 AS r, least(length(p_type), length(p_brand)) AS n FROM part),
 u AS (SELECT p_partkey, CASE WHEN r THEN left(a, n) ELSE right(a, n) END AS a, CASE WHEN r THEN left(b, n) ELSE right(b, n) END AS b, n FROM t)
 SELECT p_partkey, CAST(len(list_filter(range(1, n + 1), lambda i: a[i] <> b[i] AND a[i] <> 'N' AND b[i] <> 'N')) AS INT) AS mismatches FROM u""")
def overhang_mismatch(spark, d):
    return table(spark, d, "part").select("p_partkey", sequence.mismatches(c("p_type"), c("p_brand"), c("p_size") % 2 == 0).alias("mismatches"))


@query("""WITH RECURSIVE seqs AS (SELECT item_id, regexp_replace(upper(coalesce(text, '')), '[^ACGTN]', '', 'g') AS seq FROM benchmark),
 pieces AS (SELECT item_id, k, string_split(seq, 'N')[k] AS piece FROM (SELECT item_id, seq, unnest(range(1, len(string_split(seq, 'N')) + 1)) AS k FROM seqs)),
 cells AS (SELECT item_id, k, piece, unnest(range(1, length(piece) - 1)) AS beg, 0 AS more, 0 AS equal, 0 AS pairs, 0.0::DOUBLE AS most, FALSE AS hit FROM pieces
  UNION ALL SELECT item_id, k, piece, beg, more + 1, now, left_out + now, greatest(most, beside, (left_out + now)::DOUBLE / (more + 1)),
   10 * (left_out + now) > 20 * (more + 1) AND (left_out + now)::DOUBLE / (more + 1) >= greatest(most, beside)
  FROM (SELECT *, lead(pairs) OVER w AS left_out, lead(most) OVER w AS beside, equal + CAST(substr(piece, beg, 3) = substr(piece, beg + more + 1, 3) AS INT) AS now
   FROM cells WHERE more < 61 WINDOW w AS (PARTITION BY item_id, k ORDER BY beg)) WHERE left_out IS NOT NULL),
 masked AS (SELECT item_id, count(*) AS hit FROM (SELECT DISTINCT item_id, k, unnest(range(beg, beg + more + 3)) AS base FROM cells WHERE hit) GROUP BY item_id),
 totals AS (SELECT item_id, sum(length(piece)) AS total FROM pieces GROUP BY item_id)
 SELECT item_id, CASE WHEN total > 0 THEN round(coalesce(hit, 0)::DOUBLE / total, 6) ELSE -1.0 END AS masked FROM totals LEFT JOIN masked USING (item_id)""")
def dust_ratio(spark, d):
    seq = F.regexp_replace(F.upper(F.coalesce("text", lit(""))), "[^ACGTN]", "")
    return table(spark, d, "benchmark").select("item_id", F.coalesce(F.round(F.nanvl(sequence.dust_ratio(seq), lit(None)), 6), lit(-1.0)).alias("masked"))


@query(None)
def greedy_overhangs(spark, d):
    seq = F.regexp_replace(F.upper(F.coalesce("text", lit(""))), "[^ACGTN]", "")
    rows = table(spark, d, "benchmark").select((c("item_id") % 50).cast("int").alias("locus"), "item_id", seq.alias("seq"), (c("item_id") % 2 == 0).alias("right"))
    return consensus.cluster_overhangs(rows.where("length(seq) > 0"), ["locus"], "seq", "right", "item_id")


@query("""WITH RECURSIVE seqs AS (SELECT p_partkey // 400 AS locus, p_partkey % 2 = 0 AS right_side, p_partkey, p_name || 'N' || p_type || 'N' || p_brand AS seq FROM part),
 ranked AS (SELECT locus, right_side, CASE WHEN right_side THEN seq ELSE reverse(seq) END AS seq, row_number() OVER (PARTITION BY locus, right_side ORDER BY length(seq) DESC, p_partkey) AS k FROM seqs),
 steps AS (SELECT DISTINCT locus, right_side, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(seq VARCHAR, n BIGINT)[]) AS parents FROM ranked
  UNION ALL SELECT locus, right_side, k, CASE WHEN NOT list_contains(met, TRUE) THEN CASE WHEN length(seq) >= 20 THEN list_append(parents, {'seq': seq, 'n': 1}) ELSE parents END
   ELSE list_transform(parents, lambda p, i: {'seq': p.seq, 'n': p.n + CAST(met[i] AS BIGINT)}) END
  FROM (SELECT steps.locus, steps.right_side, ranked.k, seq, parents,
    list_transform(parents, lambda p: len(list_filter(range(1, length(seq) + 1), lambda i: p.seq[i] <> seq[i] AND p.seq[i] <> 'N' AND seq[i] <> 'N')) <= 2) AS met
   FROM steps JOIN ranked ON ranked.locus = steps.locus AND ranked.right_side = steps.right_side AND ranked.k = steps.k + 1)),
 last AS (SELECT locus, right_side, unnest(parents) AS p FROM (SELECT locus, right_side, arg_max(parents, k) AS parents FROM steps GROUP BY ALL))
 SELECT locus, right_side, CASE WHEN right_side THEN p.seq ELSE reverse(p.seq) END AS parent, p.n AS children FROM last""")
def overhang_clusters(spark, d):
    seq = F.concat_ws("N", "p_name", "p_type", "p_brand")
    rows = table(spark, d, "part").select(F.expr("p_partkey div 400").alias("locus"), "p_partkey", seq.alias("seq"), (c("p_partkey") % 2 == 0).alias("right"))
    return consensus.cluster_overhangs(rows, ["locus"], "seq", "right", "p_partkey")


@query(None)
def defuzz_consensus(spark, d):
    e = edge_view(spark, d)
    rows = e.select("a_contig", "b_contig", "a_right", c("a_pos").alias("pos"), c("b_pos").alias("lo"), (c("b_pos") + F.when(c("b_right"), 40).otherwise(0)).alias("hi"), (c("a_pos") % 5).alias("support"), (c("b_pos") % 9).alias("mates"), (c("b_pos") % 6).alias("expected"))
    return consensus.defuzz(rows, ["a_contig", "b_contig", "a_right"], 30, 25)


@query(None)
def panel_sweep(spark, d):
    e = edge_view(spark, d)
    rows = e.select("a_contig", "b_contig", "a_right", c("a_pos").alias("pos"), c("b_pos").alias("lo"), (c("b_pos") + F.when(c("b_right"), 40).otherwise(0)).alias("hi"), (c("a_pos") % 5).alias("support"), (c("b_pos") % 9).alias("mates"), (c("b_pos") % 6).alias("expected"), F.array_distinct(F.array(c("a_pos") % 11, c("b_pos") % 11)).alias("samples"))
    out = consensus.defuzz(rows, ["a_contig", "b_contig", "a_right"], 30, 25, samples="samples")
    return out.withColumn("samples", F.array_join(F.transform("samples", lambda x: x.cast("string")), ","))


@query(f"WITH {LO} SELECT DISTINCT contig, pos FROM lo ORDER BY contig DESC, pos")
def contig_last_first_order(spark, d):
    return locus_view(spark, d).select("contig", "pos").distinct().orderBy(F.desc("contig"), "pos")


@query("""SELECT l_partkey, l_suppkey, printf('%.3f', n / 16.0) AS share, printf('%.3f', price / n / 7.0) AS part, printf('%.5f', -price / 4096.0) AS fine
 FROM (SELECT l_partkey, l_suppkey, count(*) AS n, CAST(max(l_extendedprice) AS DOUBLE) AS price FROM lineitem GROUP BY ALL)""")
def fixed_text(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(lit(1)).alias("n"), F.max("l_extendedprice").cast("double").alias("price"))
    part, fine = numeric.fixed3(c("price") / c("n") / 7.0), numeric.fixed5(-c("price") / 4096.0)
    return rows.select("l_partkey", "l_suppkey", numeric.fixed3(c("n") / 16.0).alias("share"), part.alias("part"), fine.alias("fine"))


def _add(queries: dict, sql: dict[str, str]) -> None:
    QUERIES.update(queries)
    SQL.update(sql)


_add(partner_queries.QUERIES, partner_queries.SQL)
_add(event_queries.QUERIES, event_queries.sql(SQL, UNKNOWN_SCORE, SCORED))
_add(read_view.QUERIES, read_view.SQL)
_add(table_queries.QUERIES, table_queries.SQL)
