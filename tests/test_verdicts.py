"""The two cascades over all events of a sample."""

from pyspark.sql import functions as F

from locusflow.operators import verdicts
from locusflow.plans.event_view import EVENT


def events(spark, n, **over):
    base = spark.range(n).select((F.col("id") + 1).alias("o_orderkey"), F.lit(3).cast("long").alias("o_custkey")).selectExpr("o_orderkey", *(f"{v} AS {k}" for k, v in EVENT.items()))
    base = base.withColumns({"reason": F.lit(0), "score": F.lit(5), "grade": F.lit(0), "grade1": F.lit(0), "grade2": F.lit(0)})
    return base.withColumns({k: F.expr(v) for k, v in over.items()})


CLEAN = {"distant": "false", "semi": "false", "e1": "3", "e2": "3", "sup1": "20", "ev1": "20", "ev2": "20", "cand1": "false", "cand2": "false", "m1": "0.9D", "m2": "0.9D", "comp1": "true", "prone1": "false", "prone2": "false", "size": "20000"}


def test_few_inversions_stay(spark):
    out, level = verdicts.drop_inversions(events(spark, 300, inv="true", **CLEAN))
    assert level == 0 and out.count() == 300
    out, level = verdicts.drop_inversions(events(spark, 400, inv="o_orderkey % 10 < 7", **CLEAN))  # not more than the share
    assert level == 0 and out.count() == 400


def test_doubtful_inversions_go(spark):
    out, level = verdicts.drop_inversions(events(spark, 400, inv="o_orderkey % 10 < 8", **{**CLEAN, "ev1": "IF(o_orderkey % 10 = 0, 3, 20)", "ev2": "IF(o_orderkey % 10 = 0, 3, 20)"}))
    assert level == 2 and sorted(r[0] % 10 for r in out.select("o_orderkey").distinct().collect()) == sorted([*range(1, 10)] * 40)


def test_other_rows_are_left(spark):
    rows = events(spark, 500, inv="true", **{**CLEAN, "e2": "0"}).withColumn("reason", F.expr("IF(o_orderkey > 400, 11, 0)"))
    out, level = verdicts.drop_inversions(rows)
    assert level == 1 and out.count() == 100 and out.where("reason = 0").count() == 0


def test_contamination(spark):
    plain = {"type": "'DEL'", "sup1": "5", "sup2": "5", "over1": "0D", "over2": "0D"}
    marks = lambda n: events(spark, 60, **{**plain, "type": f"IF(o_orderkey <= {n}, 'CONTAMINATION', 'DEL')"}).withColumn("over1", F.expr("IF(o_orderkey = 60, 0.8D, 0D)"))
    for n, flagged, down in ((9, False, 0), (10, True, 0), (19, True, 0), (20, True, 21)):
        out, seen = verdicts.mark_contamination(marks(n))
        assert (seen, out.where("score = 1").count()) == (flagged, down)


def test_unknown_event_is_judged_by_its_first_reason(spark):
    row = events(spark, 1, susp1="false", sui1="false", exp1="0", brk1="20", mate1="2", span1="0", h1="0", h2="0", distant="true", sup1="6", sec1="0", m1="CAST(NULL AS DOUBLE)", e1="3", fuzzy1="false", cand1="false", indel1="0", status1="'HETERO'", artifact="'CLEAN'")
    reason = lambda df: df.select(verdicts_reason).first()[0]
    from locusflow.operators.events import first_reason

    verdicts_reason = first_reason(verdicts.unknown_reasons())
    assert reason(row) == 0  # an undefined ratio is neither high nor low
    assert reason(row.withColumn("m1", F.lit(0.2))) == 33
    assert reason(row.withColumn("h1", F.lit(6)).withColumn("ctg1", F.lit(999))) in (471, 0)
    assert reason(row.withColumn("sup1", F.lit(2))) == 18
