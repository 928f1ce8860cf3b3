"""Form as results arrive: a stream of appearances with bounded state per team."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from touchline.operators.asof import AsOfConfig

OUT = "league_id int, team long, fixture_id long, kickoff long, points_sum long, scored_sum long, conceded_sum long, games long"
STATE = "kickoff array<long>, fixture_id array<long>, points array<long>, scored array<long>, conceded array<long>"


def live_form(appearances: DataFrame, config: AsOfConfig = AsOfConfig()) -> DataFrame:
    """For each final appearance (league_id, team, fixture_id, kickoff, points, scored, conceded) the sums over the team's last ``window`` ones.

    Results come in order of kickoff; one behind those already counted is an error, as there is no allowance for late ones. Within a
    micro-batch rows are put in order first.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = [list(x) for x in state.get] if state.exists else [[] for _ in range(5)]
        rows = pd.concat(list(frames)).sort_values(["kickoff", "fixture_id"])
        out = []
        for r in rows.itertuples(index=False):
            if kept[0] and (r.kickoff, r.fixture_id) < (kept[0][-1], kept[1][-1]):
                raise ValueError(f"a result of {r.kickoff} came after one of {kept[0][-1]}")
            for column, value in zip(kept, (r.kickoff, r.fixture_id, r.points, r.scored, r.conceded), strict=True):
                column.append(int(value))
                del column[: -config.window]
            out.append((key[0], key[1], r.fixture_id, r.kickoff, sum(kept[2]), sum(kept[3]), sum(kept[4]), len(kept[0])))
        state.update(tuple(kept))
        yield pd.DataFrame(out, columns=["league_id", "team", "fixture_id", "kickoff", "points_sum", "scored_sum", "conceded_sum", "games"])

    rows = appearances.select("league_id", F.col("team").cast("long").alias("team"), "fixture_id", "kickoff", *(F.col(c).cast("long").alias(c) for c in ("points", "scored", "conceded")))
    return rows.groupBy("league_id", "team").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def weekly_results(fixtures: DataFrame, delay: str = "2 days") -> DataFrame:
    """Results by ISO week (tumbling from Monday) and league, with a watermark."""
    rows = fixtures.where("is_final").withColumn("at", F.timestamp_seconds("kickoff")).withWatermark("at", delay)
    week = F.window("at", "7 days", startTime="4 days")  # epoch began on a Thursday
    return rows.groupBy(week.alias("week"), "league_id").agg(F.count("*").alias("n"), F.sum(F.col("home_goals") + F.col("away_goals")).alias("goals")).select(F.date_format("week.start", "yyyy-MM-dd").alias("block"), "league_id", "n", "goals")
