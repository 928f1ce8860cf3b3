"""Elo ratings with a carry between seasons, as a fold along each league's timeline.

Ratings of a league depend on one another through every result, so a league is a sequence; leagues run in
parallel. Each is streamed in order through a task that holds only its ratings.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.asof import AsOfConfig, as_of_time

CARRY, ASK, APPLY = 0, 1, 2
NO_SEASON = -1


def timeline(fixtures: DataFrame, config: AsOfConfig, at: int | None = None) -> DataFrame:
    """Season carries and questions at as-of times, results when they are known; at one time results come last."""
    as_of = as_of_time(config, at)
    base = ["league_id", "season", "fixture_id", "kickoff", "home", "away", "home_goals", "away_goals"]
    both = F.array(F.struct(F.lit(ASK).alias("kind"), as_of.alias("time")), F.struct(F.lit(APPLY).alias("kind"), (F.col("kickoff") + config.lag).alias("time")))
    events = fixtures.select(*base, "is_final", F.explode(both).alias("e")).where((F.col("e.kind") == ASK) | F.col("is_final")).select(*base, "e.kind", "e.time")
    batches = fixtures.groupBy("league_id", "kickoff").agg(F.min("season").alias("season"))
    carries = batches.groupBy("league_id", "season").agg(F.min("kickoff").alias("kickoff"))
    carries = carries.select("league_id", "season", F.lit(-1).cast("long").alias("fixture_id"), "kickoff", *(F.lit(None).cast(fixtures.schema[c].dataType).alias(c) for c in ("home", "away", "home_goals", "away_goals")), F.lit(CARRY).alias("kind"), as_of.alias("time"))
    return events.unionByName(carries)


def expected(home: float, away: float, advantage: float) -> float:
    return 1 / (1 + 10 ** (-((home + advantage) - away) / 400))


def elo_snapshots(fixtures: DataFrame, config: AsOfConfig = AsOfConfig(), at: int | None = None) -> DataFrame:
    """fixture_id, elo_diff_home_adv: home rating and advantage less away rating, as known at the as-of time."""
    # What is sorted is one task's for each league, so it is kept narrow: the kind shares a number with twice the home side's share of a result, or with the season of a carry.
    twice = F.when(F.col("home_goals") > F.col("away_goals"), 2).when(F.col("home_goals") == F.col("away_goals"), 1).otherwise(0)
    told = F.when(F.col("kind") == APPLY, twice).when(F.col("kind") == CARRY, F.coalesce("season", F.lit(NO_SEASON))).otherwise(0)
    events = timeline(fixtures, config, at).select("league_id", "time", "kickoff", "fixture_id", "home", "away", (told.cast("long") * 4 + F.col("kind")).alias("what"))
    kind = F.col("what").bitwiseAND(3)
    order = [F.col("league_id"), F.col("time"), (kind == APPLY).cast("int"), F.col("kickoff"), kind, F.col("fixture_id")]
    events = events.repartition("league_id").sortWithinPartitions(*order).select("what", "league_id", "fixture_id", "home", "away")
    base, advantage, k = config.elo_base, config.home_advantage, config.elo_k

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        league, season, ratings = None, None, {}
        for batch in batches:
            ids, values = [], []
            for what, of, fixture, h, a in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kind, value = what & 3, what >> 2
                if of != league:
                    league, season, ratings = of, None, {}
                if kind == ASK:
                    ids.append(fixture)
                    values.append(round(ratings.get(h, base) + advantage - ratings.get(a, base), 8))
                elif kind == APPLY:
                    home, away = ratings.get(h, base), ratings.get(a, base)
                    change = k * (value / 2 - expected(home, away, advantage))
                    ratings[h], ratings[a] = home + change, away - change
                else:
                    year = None if value == NO_SEASON else value
                    if season is not None and year < season:
                        raise ValueError(f"season {year} after {season} in league {league}")
                    if season is not None and year > season:
                        ratings = {t: base + config.season_carry * (r - base) for t, r in ratings.items()}
                    season = year
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, pa.float64())], names=["fixture_id", "elo_diff_home_adv"])

    return events.mapInArrow(fold, "fixture_id long, elo_diff_home_adv double")
