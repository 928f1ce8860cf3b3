"""Point-in-time features: what was known of earlier fixtures a lead before kickoff, results being known a lag after theirs.

A result counts for a fixture if its kickoff lies more than ``lead + lag`` seconds before the fixture's. That is a range frame, so each
feature takes two windows: a rolling sum after each appearance, and the last of these sums within the frame. All fixtures of a key and
kickoff have the same answer, and of their results the last ``window`` at most can count, so the windows run over that many rows for each kickoff and the answers
are joined to the fixtures. Fixtures that are not final are asked about but never counted.

Fixtures: fixture_id, league_id, season, kickoff (epoch seconds), home, away, home_goals, away_goals, is_final.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.probability import normalise, outcome, points

DAY = 86_400


@dataclass(frozen=True)
class AsOfConfig:
    window: int = 5
    elo_base: float = 1500.0
    elo_k: float = 20.0
    home_advantage: float = 65.0
    season_carry: float = 0.75
    max_rest_days: float = 30.0
    lead: int = DAY
    lag: int = DAY

    def __post_init__(self):
        if self.window < 1 or not 0 <= self.season_carry <= 1 or self.lead < 0 or self.lag < 0:
            raise ValueError("window must be positive, season_carry within 0 to 1, lead and lag not negative")

    @property
    def gap(self) -> int:
        """Seconds that a counted kickoff lies before the fixture's, at least."""
        return self.lead + self.lag + 1


#: Names and order of the features.
FEATURES = [
    "home_points_sum_5",
    "away_points_sum_5",
    "home_goals_for_sum_5",
    "home_goals_against_sum_5",
    "away_goals_for_sum_5",
    "away_goals_against_sum_5",
    "home_home_points_sum_5",
    "home_home_goal_diff_sum_5",
    "away_away_points_sum_5",
    "away_away_goal_diff_sum_5",
    "elo_diff_home_adv",
    "h2h_home_points_sum_5",
    "home_rest_days",
    "away_rest_days",
]


def appearances(fixtures: DataFrame) -> DataFrame:
    """Two rows per fixture, one for each team; goals and points are null unless the fixture is final."""
    side = lambda home, team, other, scored, conceded: F.struct(F.lit(home).alias("is_home"), F.col(team).alias("team"), F.col(other).alias("opponent"), F.col(scored).alias("scored"), F.col(conceded).alias("conceded"))
    both = F.array(side(True, "home", "away", "home_goals", "away_goals"), side(False, "away", "home", "away_goals", "home_goals"))
    rows = fixtures.select("fixture_id", "league_id", "season", "kickoff", "is_final", F.explode(both).alias("x")).select("fixture_id", "league_id", "season", "kickoff", "is_final", "x.*")
    final = lambda c: F.when(F.col("is_final"), F.col(c))
    return rows.withColumns({"scored": final("scored"), "conceded": final("conceded"), "points": F.when(F.col("is_final"), points(F.col("scored"), F.col("conceded")))})


def by_kickoff(rows: DataFrame, keys: list[str], sums: dict[str, Column], config: AsOfConfig, name: str, answer: Callable[[DataFrame, dict[str, Column]], DataFrame]) -> DataFrame:
    """Adds ``name``, which ``answer`` works out from the last ``window`` results of each key and kickoff (where there are none, from a fixture that is not final)."""
    place = Window.partitionBy(*keys, "kickoff").orderBy(F.desc("is_final"), F.desc("fixture_id"))
    few = rows.select(*keys, "kickoff", "fixture_id", "is_final", *(c.alias(n) for n, c in sums.items())).withColumn("__place", F.row_number().over(place)).where(F.col("__place") <= config.window)
    answers = answer(few, {n: F.col(n) for n in sums}).where("__place = 1").select(*(F.col(c).alias(f"__{c}") for c in [*keys, "kickoff"]), name)
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in [*keys, "kickoff"]]
    return rows.join(answers, reduce(lambda a, b: a & b, same)).select(*rows.columns, name)


def rolling_as_of(rows: DataFrame, keys: list[str], sums: dict[str, Column], config: AsOfConfig, name: str = "seen") -> DataFrame:
    """Adds a struct ``name``: for each of ``sums`` the sum over the last ``window`` counted rows of the same keys, and last_kickoff."""

    def answer(few: DataFrame, sums: dict[str, Column]) -> DataFrame:
        counted = Window.partitionBy(*keys, "is_final").orderBy("kickoff", "fixture_id")
        last = counted.rowsBetween(1 - config.window, Window.currentRow)
        state = F.struct(F.row_number().over(counted).alias("seq"), *(F.sum(c).over(last).alias(n) for n, c in sums.items()), F.col("kickoff").alias("last_kickoff"))
        few = few.withColumn("state", state).withColumn("state", F.when(F.col("is_final"), F.col("state")))
        known = Window.partitionBy(*keys).orderBy("kickoff").rangeBetween(Window.unboundedPreceding, -config.gap)
        return few.withColumn(name, F.max("state").over(known))

    return by_kickoff(rows, keys, sums, config, name, answer)


def team_form(fixtures: DataFrame, config: AsOfConfig = AsOfConfig(), venue: bool = False) -> DataFrame:
    """fixture_id, is_home, seen: each team's form, over all its fixtures or those at the same venue."""
    keys = ["league_id", "team", *(["is_home"] if venue else [])]
    return rolling_as_of(appearances(fixtures), keys, form_sums(), config).select("fixture_id", "is_home", "kickoff", "seen")


def form_sums() -> dict[str, Column]:
    return {c: F.col(c) for c in ("points", "scored", "conceded")}


def by_side(form: DataFrame, columns: dict[str, tuple[bool, Column]], more: list[Column] | None = None) -> DataFrame:
    """One row per fixture from the two of its teams, with further aggregates over both."""
    return form.groupBy("fixture_id").agg(*(F.max(F.when(F.col("is_home") == home, c)).alias(n) for n, (home, c) in columns.items()), *(more or []))


def form_columns() -> dict[str, tuple[bool, Column]]:
    seen = lambda c: F.col(f"seen.{c}").cast("double")
    return {
        "home_points_sum_5": (True, seen("points")),
        "away_points_sum_5": (False, seen("points")),
        "home_goals_for_sum_5": (True, seen("scored")),
        "home_goals_against_sum_5": (True, seen("conceded")),
        "away_goals_for_sum_5": (False, seen("scored")),
        "away_goals_against_sum_5": (False, seen("conceded")),
    }


def venue_columns(seen: str = "seen") -> dict[str, tuple[bool, Column]]:
    won, diff = F.col(f"{seen}.points").cast("double"), (F.col(f"{seen}.scored") - F.col(f"{seen}.conceded")).cast("double")
    return {"home_home_points_sum_5": (True, won), "home_home_goal_diff_sum_5": (True, diff), "away_away_points_sum_5": (False, won), "away_away_goal_diff_sum_5": (False, diff)}


def rest_columns(config: AsOfConfig = AsOfConfig()) -> dict[str, tuple[bool, Column]]:
    since = (F.col("kickoff") - F.col("seen.last_kickoff")) / DAY
    days = F.when(since.isNotNull(), F.round(F.least(since, F.lit(config.max_rest_days)), 6))  # least() alone would pass over a null
    return {"home_rest_days": (True, days), "away_rest_days": (False, days)}


def head_to_head(fixtures: DataFrame, config: AsOfConfig = AsOfConfig(), carry: tuple[str, ...] = (), roll: Callable[..., DataFrame] = rolling_as_of) -> DataFrame:
    """fixture_id, h2h_home_points_sum_5 (of today's home team over the last meetings, wherever played), last_meeting, and columns to ``carry`` along."""
    first = F.col("home") <= F.col("away")
    won = F.when(F.col("is_final"), points(F.col("home_goals"), F.col("away_goals")))
    lost = F.when(F.col("is_final"), points(F.col("away_goals"), F.col("home_goals")))
    rows = fixtures.withColumns({"low": F.least("home", "away"), "high": F.greatest("home", "away"), "of_low": F.when(first, won).otherwise(lost), "of_high": F.when(first, lost).otherwise(won)})
    keys = ["league_id", "low", "high"]
    rows = roll(rows, keys, {"of_low": F.col("of_low"), "of_high": F.col("of_high")}, config)
    mine = F.when(first, F.col("seen.of_low")).otherwise(F.col("seen.of_high"))
    return rows.select("fixture_id", *carry, mine.cast("double").alias("h2h_home_points_sum_5"), F.col("seen.last_kickoff").alias("last_meeting"))


def outcome_prior(fixtures: DataFrame, config: AsOfConfig = AsOfConfig()) -> DataFrame:
    """fixture_id, p: shares of the outcomes known in the league; null before the first. Counts are windowed by kickoff, not by fixture."""
    result = outcome(F.col("home_goals"), F.col("away_goals"))
    counts = [F.sum(F.when(F.col("is_final") & (result == i), 1).otherwise(0)).alias(f"n{i}") for i in range(3)]
    times = fixtures.groupBy("league_id", "kickoff").agg(*counts)
    known = Window.partitionBy("league_id").orderBy("kickoff").rangeBetween(Window.unboundedPreceding, -config.gap)
    total = [F.sum(f"n{i}").over(known) for i in range(3)]
    times = times.select("league_id", "kickoff", F.array(*(t.cast("double") for t in total)).alias("counts"))
    shares = F.when(F.aggregate("counts", F.lit(0.0), lambda a, x: a + x) > 0, normalise(F.transform("counts", lambda x: x / F.aggregate("counts", F.lit(0.0), lambda a, y: a + y))))
    return fixtures.select("fixture_id", "league_id", "kickoff").join(times, ["league_id", "kickoff"]).select("fixture_id", shares.alias("p"))


def source_columns(config: AsOfConfig, at: int | None = None) -> list[Column]:
    """as_of, and source_max from kickoff, last_kickoff and last_meeting: when the latest counted result became known (as_of - 1 if none), which must lie before as_of."""
    as_of = as_of_time(config, at)
    known = F.coalesce(F.greatest("last_kickoff", "last_meeting") + config.lag, as_of - 1)
    checked = F.when(known >= as_of, F.raise_error(F.lit("a result was used before it was known"))).otherwise(known)
    return [as_of.alias("as_of"), checked.alias("source_max")]


def source_max(fixtures: DataFrame, config: AsOfConfig = AsOfConfig()) -> DataFrame:
    """fixture_id, as_of, source_max."""
    form = by_side(team_form(fixtures, config), {}, [F.max("seen.last_kickoff").alias("last_kickoff")])
    return head_to_head(fixtures, config, ("kickoff",)).join(form, "fixture_id").select("fixture_id", *source_columns(config))


def as_of_time(config: AsOfConfig, at: int | None = None) -> Column:
    """A lead before kickoff; with one prediction time ``at`` for all fixtures whose kickoff lies behind it, that time for them."""
    usual = F.col("kickoff") - config.lead
    return usual if at is None else F.when(F.col("kickoff") > at, F.lit(at).cast("long")).otherwise(usual)


def rolling_at(rows: DataFrame, keys: list[str], sums: dict[str, Column], config: AsOfConfig, name: str = "seen", at: int = 0) -> DataFrame:
    """As :func:`rolling_as_of`, as known at the prediction time ``at``.

    The distance to the kickoff then varies, so results and questions share a timeline: results at the time they are known,
    questions at their as-of time, questions first.
    """

    def answer(few: DataFrame, sums: dict[str, Column]) -> DataFrame:
        events = few.withColumn("event", F.explode(F.array(F.struct(F.lit(False).alias("ask"), (F.col("kickoff") + config.lag).alias("time")), F.struct(F.lit(True).alias("ask"), as_of_time(config, at).alias("time")))))
        events = events.select(*few.columns, "event.ask", "event.time").where("ask or is_final")
        told = Window.partitionBy(*keys, "ask").orderBy("kickoff", "fixture_id").rowsBetween(1 - config.window, Window.currentRow)
        state = F.struct(*(F.sum(c).over(told).alias(n) for n, c in sums.items()), F.col("kickoff").alias("last_kickoff"))
        events = events.withColumn("state", state).withColumn("state", F.when(~F.col("ask"), F.col("state")))
        line = Window.partitionBy(*keys).orderBy("time", F.col("ask").desc(), "kickoff", "fixture_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return events.withColumn(name, F.last("state", ignorenulls=True).over(line)).where("ask")

    return by_kickoff(rows, keys, sums, config, name, answer)


def form_at(fixtures: DataFrame, at: int, config: AsOfConfig = AsOfConfig()) -> DataFrame:
    """As :func:`team_form` at one prediction time."""
    keys = ["league_id", "team"]
    return rolling_at(appearances(fixtures), keys, form_sums(), config, at=at).select("fixture_id", "is_home", "kickoff", "seen")


def snapshots(fixtures: DataFrame, config: AsOfConfig = AsOfConfig(), at: int | None = None) -> DataFrame:
    """fixture_id, kickoff, as_of, source_max, target, target_available and the features by name; target is null unless final.

    ``at`` is one prediction time for all fixtures whose kickoff lies behind it. Form over all fixtures and by venue share one grouping by fixture; the meetings carry the fixture along.
    """
    from touchline.operators.elo import elo_snapshots

    teams = appearances(fixtures)
    roll = rolling_as_of if at is None else partial(rolling_at, at=at)
    both = roll(roll(teams, ["league_id", "team"], form_sums(), config), ["league_id", "team", "is_home"], form_sums(), config, "at_venue")
    form = by_side(both, form_columns() | rest_columns(config) | venue_columns("at_venue"), [F.max("seen.last_kickoff").alias("last_kickoff")])
    meetings = head_to_head(fixtures, config, ("league_id", "season", "kickoff", "is_final", "home_goals", "away_goals"), roll)
    wide = meetings.join(form, "fixture_id").join(elo_snapshots(fixtures, config, at), "fixture_id")
    target = F.when(F.col("is_final"), outcome(F.col("home_goals"), F.col("away_goals")))
    return wide.select("fixture_id", "league_id", "season", "kickoff", *source_columns(config, at), target.alias("target"), (F.col("kickoff") + config.lag).alias("target_available"), *FEATURES)
