"""From season files to training examples: fixtures with dense team ids, their snapshots, and the checks that tie the two together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators import asof
from touchline.sources import ingest

#: The league that season files are numbered under.
LEAGUE = 39


def as_fixtures(matches: DataFrame, league_id: int = LEAGUE) -> DataFrame:
    """Numbered matches as final fixtures; teams are numbered from 1 by name."""
    ids = ingest.dense_ids(matches, "home_team", "away_team")
    home, away = ids.select(F.col("team").alias("home_team"), F.col("team_id").alias("home")), ids.select(F.col("team").alias("away_team"), F.col("team_id").alias("away"))
    rows = matches.join(home, "home_team").join(away, "away_team")
    return rows.select("fixture_id", F.lit(league_id).alias("league_id"), F.col("season_start").alias("season"), "kickoff", "home", "away", "home_team", "away_team", "home_goals", "away_goals", F.lit(True).alias("is_final"))


def examples(matches: DataFrame, config: asof.AsOfConfig = asof.AsOfConfig()) -> DataFrame:
    """The snapshot of every match with its key, season label, block and prices; fails where target or as-of time differ from the match's."""
    snaps = asof.snapshots(as_fixtures(matches), config)
    own = matches.select("fixture_id", F.col("season").alias("season_name"), "key", "block", "closing_odds", F.col("target").alias("match_target"), F.col("kickoff").alias("match_kickoff"))
    rows = snaps.join(own, "fixture_id")
    fault = F.when(~F.col("target").eqNullSafe(F.col("match_target")), "target").when(F.col("as_of") != F.col("match_kickoff") - config.lead, "as-of time").when(F.col("source_max") >= F.col("as_of"), "source time")
    checked = F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit("fixture "), F.col("fixture_id").cast("string"), F.lit(": "), fault))).otherwise(F.col("target"))
    return rows.withColumn("target", checked.cast("int")).drop("match_target", "match_kickoff")


def coverage_faults(matches: DataFrame, found: DataFrame) -> DataFrame:
    """fixture_id, side: matches without an example, and examples without a match."""
    missing = matches.select("fixture_id").join(found.select("fixture_id"), "fixture_id", "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(found.select("fixture_id").join(matches.select("fixture_id"), "fixture_id", "left_anti").withColumn("side", F.lit("extra")))
