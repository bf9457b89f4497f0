"""Views of the driver tables as intervals, positions, links and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date"))
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 24 + 1).cast("int").alias("contig"), start.alias("start"), (start + F.col("l_quantity").cast("int")).alias("end"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))


def loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    minute = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 60_000_000)
    return table(spark, sf_dir, "events").select((F.col("user_id") % 24 + 1).cast("int").alias("contig"), minute.cast("int").alias("pos"), F.col("event_type").alias("kind"), F.col("event_id").alias("ord"), "user_id", "value")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between orders' ship days and part positions; an order line is one link, repeated lines count once."""
    start = F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date"))
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 24 + 1).cast("int").alias("a_contig"), start.alias("a_pos"), (F.col("l_partkey") % 24 + 1).cast("int").alias("b_contig"), (F.col("l_orderkey") % 3000).cast("int").alias("b_pos"), (F.col("l_linestatus") == "O").alias("a_right"), (F.col("l_returnflag") == "R").alias("b_right")).distinct().withColumn("id", F.concat_ws("_", "a_contig", "a_pos", "b_contig", "b_pos", F.col("a_right").cast("int"), F.col("b_right").cast("int")))


#: The same views for DuckDB.
IV = """iv AS (SELECT CAST(l_suppkey % 24 + 1 AS INT) AS contig, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS INT) AS s,
 CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS INT) AS INT) AS e, l_returnflag AS flag, l_linestatus AS status FROM lineitem)"""
LO = """lo AS (SELECT CAST(user_id % 24 + 1 AS INT) AS contig, CAST(floor(date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 60000000) AS INT) AS pos,
 event_type AS kind, event_id AS ord, user_id, value FROM events)"""
ED = """ed AS (SELECT DISTINCT CAST(l_suppkey % 24 + 1 AS INT) AS a_contig, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS INT) AS a_pos,
 CAST(l_partkey % 24 + 1 AS INT) AS b_contig, CAST(l_orderkey % 3000 AS INT) AS b_pos, l_linestatus = 'O' AS a_right, l_returnflag = 'R' AS b_right,
 concat_ws('_', l_suppkey % 24 + 1, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)), l_partkey % 24 + 1, l_orderkey % 3000, CAST(l_linestatus = 'O' AS INT), CAST(l_returnflag = 'R' AS INT)) AS id FROM lineitem)"""
