"""Fixtures and odds derived from the star-schema tables, for demonstration and benchmarks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three leagues of twenty teams; an order of status P is a fixture still to come."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    return orders(spark, sf_dir).select(
        key.alias("fixture_id"),
        (key % 3).cast("int").alias("league_id"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("kickoff"),
        F.year("o_orderdate").alias("season"),
        (customer % 20).alias("home"),
        ((customer % 20 + 1 + key % 19) % 20).alias("away"),
        ((key * 7 + customer * 3) % 5).alias("home_goals"),
        ((key * 11 + customer * 5) % 4).alias("away_goals"),
        (F.col("o_orderstatus") != "P").alias("is_final"),
    )


def with_drawn_goals(fixtures: DataFrame) -> DataFrame:
    """The same fixtures with goals drawn, by a hash of the fixture, from Poisson distributions (1.5 at home, 1.2 away), which goal models can fit."""

    def drawn(mean: float, seed: int) -> Column:
        u = (F.pmod(F.xxhash64("fixture_id", F.lit(seed)), F.lit(1_000_000)) + 0.5) / 1_000_000
        upto = [sum(math.exp(-mean) * mean**k / math.factorial(k) for k in range(g + 1)) for g in range(9)]
        return sum(((u > x).cast("long") for x in upto[1:]), (u > upto[0]).cast("long"))

    return fixtures.withColumns({"home_goals": drawn(1.5, 1), "away_goals": drawn(1.2, 2)})


def odds_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, season, block (Monday), target and three prices with a margin of 6 %."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    weights = [(1 + key % 7).cast("double"), (1 + customer % 5).cast("double"), (1 + (key + customer) % 6).cast("double")]
    total = weights[0] + weights[1] + weights[2]
    status = F.col("o_orderstatus")
    return orders(spark, sf_dir).select(
        key.alias("key"),
        F.year("o_orderdate").alias("season"),
        F.date_format(F.date_trunc("week", F.col("o_orderdate")), "yyyy-MM-dd").alias("block"),
        F.when(status == "F", 0).when(status == "O", 1).when(status == "P", 2).alias("target"),
        F.array(*(total / (w * 1.06) for w in weights)).alias("odds"),
    )
