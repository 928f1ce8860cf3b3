"""Readers: pinned season files, and nested API payloads with bad ones set apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.functions import probability as P
from touchline.operators.running import running

#: Column names of the season files.
REQUIRED = ["Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG", "FTR"]
ODDS = ["AvgCH", "AvgCD", "AvgCA"]
FINAL_STATUSES = ["FT", "AET", "PEN"]
PAYLOAD = "fixture struct<id: bigint, timestamp: bigint, date: string, status: struct<short: string>>, league struct<id: bigint, season: int>, teams struct<home: struct<id: bigint, name: string>, away: struct<id: bigint, name: string>>, goals struct<home: int, away: int>"


def read_manifest(spark: SparkSession, path: str, evaluation_seasons: list[str]) -> DataFrame:
    """season, season_index, role, url, sha256, expected_rows; a season's role follows from the evaluation list. Fails unless seasons ascend."""
    pins = spark.read.json(path, multiLine=True).select(F.posexplode("sourceInputs").alias("place", "x")).select("place", "x.*")
    line = Window.orderBy("place")  # a manifest is a handful of rows
    checked = F.when(F.lag("season").over(line) >= F.col("season"), F.raise_error(F.lit("seasons must ascend"))).otherwise(F.col("season"))
    role = F.when(F.col("season").isin(evaluation_seasons), "evaluation").otherwise("history")
    return pins.select(checked.alias("season"), F.col("place").cast("int").alias("season_index"), role.alias("role"), "url", "sha256", F.col("completedMatchRows").cast("long").alias("expected_rows"))


def digest_mismatches(spark: SparkSession, pins: DataFrame, directory: str) -> DataFrame:
    """Pins (with local_path, relative) whose file is missing or has another SHA-256."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    found = files.select(F.element_at(F.split("path", "/"), -2).alias("folder"), F.sha2("content", 256).alias("found_sha256"))
    return pins.join(found, F.split("local_path", "/")[0] == F.col("folder"), "left").where("found_sha256 is null or found_sha256 <> sha256")


def read_season(spark: SparkSession, path: str, season: str, season_index: int, with_odds: bool) -> DataFrame:
    """Completed matches of one season file, with source_order (line of the file, from 2 on, counted over all rows).

    Fails on a missing column, an empty or repeated team, a negative count, or incomplete odds where they are needed.
    """
    # With multiLine a file is one split, read from its first line to its last.
    raw = spark.read.csv(path, header=True, multiLine=True)
    lacking = [c for c in [*REQUIRED, *(ODDS if with_odds else [])] if c not in raw.columns]
    if lacking:
        raise ValueError(f"{path} lacks {lacking}")
    numbered = raw.withColumn("source_order", F.monotonically_increasing_id() + 2)
    have = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    odds = F.array(*(P.decimal_odds(have(c)) for c in ODDS))
    odds = F.when(F.forall(odds, lambda o: o.isNotNull()), odds)
    home, away = F.trim("HomeTeam"), F.trim("AwayTeam")
    fault = F.when((home == "") | (away == "") | home.isNull() | away.isNull(), "empty team").when(home == away, "a team against itself").when((F.col("FTHG").cast("int") < 0) | (F.col("FTAG").cast("int") < 0), "negative goals")
    if with_odds:
        fault = F.coalesce(fault, F.when(odds.isNull(), "incomplete odds"))
    rows = numbered.where(F.col("FTR").isin("H", "D", "A")).withColumn("fault", fault)
    checked = F.when(F.col("fault").isNotNull(), F.raise_error(F.concat(F.lit(f"{season}: "), "fault"))).otherwise(home)
    return rows.select(
        F.lit(season).alias("season"),
        F.lit(season_index).alias("season_index"),
        F.split(F.lit(season), "/")[0].cast("int").alias("season_start"),
        P.parse_kickoff(F.col("Date"), have("Time")).alias("kickoff"),
        "source_order",
        checked.alias("home_team"),
        away.alias("away_team"),
        F.col("FTHG").cast("int").alias("home_goals"),
        F.col("FTAG").cast("int").alias("away_goals"),
        P.outcome_index(F.col("FTR")).alias("target"),
        odds.alias("closing_odds"),
    )


def number_matches(matches: DataFrame) -> DataFrame:
    """Adds fixture_id (1.. by season and file order), key and block."""
    key = F.concat_ws("|", "season", F.col("kickoff").cast("string"), "home_team", "away_team")
    numbered = running(matches, "season_index", ["season_index", "source_order"], {"fixture_id": ("sum", F.lit(1))})
    return numbered.withColumns({"fixture_id": F.col("fixture_id").cast("long"), "key": key, "block": P.week_block(F.col("kickoff"))})


def source_metadata(pins: DataFrame, matches: DataFrame) -> DataFrame:
    """One row for each pinned file: what it is, how many matches and which dates it gave, and the fields that were read."""
    found = matches.groupBy("season").agg(F.count("*").alias("completed_rows"), F.min(P.iso_date(F.col("kickoff"))).alias("first_date"), F.max(P.iso_date(F.col("kickoff"))).alias("last_date"))
    every = [*REQUIRED[:1], "Time", *REQUIRED[1:]]
    fields = F.when(F.col("role") == "evaluation", F.array(*map(F.lit, [*every, *ODDS]))).otherwise(F.array(*map(F.lit, every)))
    return pins.join(found, "season", "left").select("season", "season_index", "role", "url", "sha256", F.coalesce("completed_rows", F.lit(0)).alias("completed_rows"), "first_date", "last_date", fields.alias("fields"))


def path_behind(url: Column, mark: str) -> Column:
    """What stands behind a folder of a URL, or null where it lacks the folder."""
    return F.when(F.instr(url, mark) > 0, F.substring_index(url, mark, -1))


def contract_faults(matches: DataFrame, pins: DataFrame) -> DataFrame:
    """what, detail: seasons whose count differs from the manifest, and repeated keys."""
    counts = pins.join(matches.groupBy("season").agg(F.count("*").alias("n")), "season", "left").where(F.coalesce("n", F.lit(0)) != F.col("expected_rows"))
    return counts.select(F.lit("count").alias("what"), F.col("season").alias("detail")).unionByName(duplicate_keys(matches).select(F.lit("key").alias("what"), F.col("key").cast("string").alias("detail")))


def duplicate_keys(rows: DataFrame, *columns: str) -> DataFrame:
    names = list(columns) or ["key"]
    return rows.groupBy(*names).agg(F.count("*").alias("n")).where("n > 1")


def parse_payloads(payloads: DataFrame, column: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Fixtures from JSON texts, and (payload, fault) for those that are none; a bad payload never stops the others."""
    x = F.from_json(F.col(column), PAYLOAD)
    rows = payloads.select(F.col(column), x.alias("x"))
    stamp = F.coalesce("x.fixture.timestamp", F.unix_seconds(F.try_to_timestamp(F.col("x.fixture.date"))))
    status = F.upper(F.trim(F.coalesce("x.fixture.status.short", F.lit(""))))
    positive = {"fixture.id": F.col("x.fixture.id"), "league.id": F.col("x.league.id"), "league.season": F.col("x.league.season").cast("long"), "kickoff": stamp, "teams.home.id": F.col("x.teams.home.id"), "teams.away.id": F.col("x.teams.away.id")}
    goals = {"goals.home": F.col("x.goals.home"), "goals.away": F.col("x.goals.away")}
    faults = [F.when(F.coalesce(v, F.lit(0)) <= 0, F.lit(f"{n} must be a positive integer")) for n, v in positive.items()] + [F.when(v < 0, F.lit(f"{n} must not be negative")) for n, v in goals.items()]
    rows = rows.withColumn("fault", F.coalesce(*faults))
    final = status.isin(FINAL_STATUSES) & goals["goals.home"].isNotNull() & goals["goals.away"].isNotNull()
    good = rows.where("fault is null").select(
        F.col("x.fixture.id").alias("fixture_id"),
        F.col("x.league.id").alias("league_id"),
        F.col("x.league.season").alias("season"),
        stamp.alias("kickoff"),
        F.col("x.teams.home.id").alias("home"),
        F.col("x.teams.away.id").alias("away"),
        F.col("x.teams.home.name").alias("home_name"),
        F.col("x.teams.away.name").alias("away_name"),
        status.alias("status"),
        goals["goals.home"].alias("home_goals"),
        goals["goals.away"].alias("away_goals"),
        final.alias("is_final"),
    )
    return good, rows.where("fault is not null").select(column, "fault")


def dense_ids(fixtures: DataFrame, home: str = "home", away: str = "away") -> DataFrame:
    """team, team_id: all teams in order, numbered from 1."""
    teams = fixtures.select(F.explode(F.array(home, away)).alias("team")).distinct().where("team is not null")
    return running(teams, "team", ["team"], {"team_id": ("sum", F.lit(1))}).select("team", F.col("team_id").cast("long").alias("team_id"))

