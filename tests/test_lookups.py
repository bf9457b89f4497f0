"""Lookups at their edges: distances that just count, ties, nothing to find, empty tables."""

import random

from locusflow.operators import lookups, pairs
from locusflow.plans import adapters, registry

ROWS, PANEL, LINKS = "id long, contig int, pos int", "contig int, pos int, hits long", "id long, contig int, lo int, hi int"


def test_hits_at_the_edges(spark):
    rows = spark.createDataFrame([(1, 1, 1000), (2, 1, 5000), (3, 2, 1000), (4, 3, None)], ROWS)
    panel = spark.createDataFrame([(1, 401, 7), (1, 400, 99), (1, 1600, 99), (1, 1050, 3), (1, 951, 3), (2, 900, 4), (2, 1100, 4), (3, 5, 9)], PANEL)
    got = {r.id: (r.hits, r.close_hits, r.gap) for r in lookups.nearby_hits(rows, panel, "id", 600, 50).collect()}
    assert got == {1: (7, 3, -599), 2: (0, 0, None), 3: (4, 0, -100), 4: (0, 0, None)}


def test_empty_tables(spark):
    rows, panel, links = (spark.createDataFrame([], k) for k in (ROWS, PANEL, LINKS))
    assert lookups.nearby_hits(rows, panel, "id", 600, 50).count() == 0 and lookups.better_place(links, panel, 200, 20, 30).count() == 0
    one = spark.createDataFrame([(1, 1, 10)], ROWS)
    assert [tuple(r) for r in lookups.nearby_hits(one, panel, "id", 600, 50).collect()] == [(1, 0, 0, None)]


def test_better_place(spark):
    links = spark.createDataFrame([(1, 1, 100, 900), (2, 1, 100, 130), (3, 2, 100, 900)], LINKS)
    panel = spark.createDataFrame([(1, 905, 5), (1, 95, 2)], PANEL)
    assert sorted(map(tuple, lookups.better_place(links, panel, 200, 20, 30).collect())) == [(1, 900, 5), (2, 100, 2), (3, 100, 0)]


def test_nearest_partner(spark):
    edges = spark.createDataFrame([(1, 1, 100), (2, 1, 200), (3, 1, 300), (4, 2, 100)], "id long, b_contig int, b_pos int")
    nodes = spark.createDataFrame([(1, 95), (1, 105), (1, 215), (1, 316)], "contig int, pos int")
    assert sorted(map(tuple, lookups.nearest_partner(edges, nodes, 5).collect())) == [(1, 95, False), (2, 215, True)]


def test_nearest_partner_of_all_nodes(spark):
    sf = "/root/testdata/sf0.001"
    edges = adapters.edges(spark, sf).select("id", "a_contig", "a_pos", "b_contig", "b_pos").collect()
    nodes = {(e.a_contig, e.a_pos) for e in edges}
    near = sorted(range(-15, 16), key=lambda x: (abs(x), x))
    want = {e.id: next((e.b_pos + x for x in near if (e.b_contig, e.b_pos + x) in nodes), None) for e in edges}
    got = {r.id: (r.partner_pos, r.widened) for r in registry.QUERIES["nearest_partner"](spark, sf).collect()}
    assert got == {e.id: (want[e.id], abs(want[e.id] - e.b_pos) > 5) for e in edges if want[e.id] is not None}
    assert any(p % 16 for p, _ in got.values())


def test_lookups_against_brute_force(spark):
    """Dense marks with few different values, so that ties and ends of blocks come up everywhere."""
    rng = random.Random(5)
    rows = [(k, k % 2, rng.randrange(-40, 300)) for k in range(300)]
    panel = {(contig, pos): rng.randrange(1, 4) for contig in (0, 1) for pos in rng.sample(range(-60, 330), 120)}
    marks = spark.createDataFrame([(*at, hits) for at, hits in panel.items()], PANEL)
    for within, close in ((1, 0), (2, 1), (7, 3), (40, 12)):
        hits = lambda contig, pos, far: [(-panel[contig, pos + off], abs(off), off) for off in range(-far, far + 1) if (contig, pos + off) in panel]
        want = {k: (-min(hits(c, p, within - 1), default=(0,))[0], -min(hits(c, p, close), default=(0,))[0], min(hits(c, p, within - 1), default=(None,))[-1]) for k, c, p in rows}
        assert {r.id: (r.hits, r.close_hits, r.gap) for r in lookups.nearby_hits(spark.createDataFrame(rows, ROWS), marks, "id", within, close).collect()} == want
    near = {k: min(((abs(off), p + off) for off in range(-6, 7) if (c, p + off) in panel), default=None) for k, c, p in rows}
    got = lookups.nearest_partner(spark.createDataFrame(rows, "id long, b_contig int, b_pos int"), marks, 2).collect()
    assert {r.id: (r.partner_pos, r.widened) for r in got} == {k: (x[1], x[0] > 2) for k, x in near.items() if x}


def rows_made(df, kind):
    """The most rows that an operator of a kind has given out in the run of df."""
    df.collect()
    plan, met = df._jdf.queryExecution().executedPlan().finalPhysicalPlan(), []

    def walk(node):
        if hasattr(node, "plan") and node.nodeName().endswith("QueryStage"):
            walk(node.plan())
        if kind in node.nodeName() and node.metrics().contains("numOutputRows"):
            met.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k))

    walk(plan)
    return max(met)


def test_lookups_make_no_pairs(spark):
    """Rows of one place near many panel positions: no join gives more rows than there are rows to look up."""
    rows = spark.range(2000).selectExpr("id", "1 AS contig", "CAST(id % 50 AS INT) AS pos")
    panel = spark.range(400).selectExpr("1 AS contig", "CAST(id - 200 AS INT) AS pos", "id % 7 AS hits")
    links = rows.selectExpr("id", "contig", "pos AS lo", "pos + 100 AS hi")
    edges = rows.selectExpr("id", "contig AS b_contig", "pos AS b_pos")
    assert rows_made(lookups.nearby_hits(rows, panel, "id", 600, 50), "Join") <= 2000
    assert rows_made(lookups.better_place(links, panel, 200, 20, 30), "Join") <= 4000
    assert rows_made(lookups.nearest_partner(edges, panel, 50), "Join") <= 2000


def test_links_against_brute_force(spark):
    rng = random.Random(7)
    links = [(k, rng.randrange(2), rng.randrange(-30, 90), rng.randrange(2), rng.randrange(-30, 90)) for k in range(400)]
    edges = spark.createDataFrame(links, "id long, a_contig int, a_pos int, b_contig int, b_pos int")
    nodes = spark.createDataFrame([(x[1], x[2]) for x in links[:20]], "contig int, pos int")
    for within in (0, 1, 5):
        want = {(x[0], y[0]) for x in links for y in links if x[0] != y[0] and (x[1], x[3]) == (y[3], y[1]) and abs(x[4] - y[2]) <= within and abs(x[2] - y[4]) <= within}
        assert sorted(map(tuple, pairs.reciprocal(edges, within).collect())) == sorted(want)
        two, one = {x for x, _ in want}, {x[0] for x in links if any(x[3] == y[1] and abs(x[4] - y[2]) <= within for y in links[:20])}
        got = dict(map(tuple, pairs.partner_status(edges, nodes, within).collect()))
        assert got == {x[0]: "two-sided" if x[0] in two else "one-sided" if x[0] in one else "unknown" for x in links}


def test_partner_status_makes_no_pairs(spark):
    """Each of 1000 links one way has 1000 back within reach."""
    edges = spark.range(2000).selectExpr("id", "CAST(id % 2 AS INT) AS a_contig", "CAST(id % 5 AS INT) AS a_pos", "CAST((id + 1) % 2 AS INT) AS b_contig", "CAST(id % 7 AS INT) AS b_pos")
    nodes = edges.selectExpr("a_contig AS contig", "a_pos AS pos")
    assert rows_made(pairs.partner_status(edges, nodes, 20), "Join") <= 4 * 2000
