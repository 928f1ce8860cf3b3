"""Questions and results as a stream: each waits, in keyed state, for the event time at which it is due.

A fixture is asked about a lead before its kickoff, and its result counts from a lag after it. Messages come as they are observed, in any order within the watermark's delay; what
they bring is queued under its key and a timer is set for when it is due. When the watermark passes a timer, everything due by then is worked off in order of time: at one time questions come before
results, so that a result known at the very moment of a question does not count. The state of a key is a few rows per team, or a rating per team of a league, besides what is
still pending. There is no allowance for messages that are late: one that is due before something already worked off is an error, as is a season before the current one.

Messages: kind (ASK or APPLY), league_id, season, fixture_id, kickoff (epoch seconds), home, away, home_goals, away_goals, observed (timestamp, the event time). Other kinds only move the watermark.
"""

from __future__ import annotations

from abc import abstractmethod
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, LongType, StructType, TimestampType

from touchline.operators.asof import AsOfConfig
from touchline.operators.elo import expected

TICK, ASK, APPLY = -1, 1, 2
MESSAGE = "kind int, league_id int, season int, fixture_id long, kickoff long, home long, away long, home_goals long, away_goals long, observed timestamp"
TYPES = {"int": IntegerType(), "long": LongType(), "double": DoubleType(), "boolean": BooleanType(), "binary": BinaryType(), "timestamp": TimestampType(), "array<long>": ArrayType(LongType())}
#: State lives in RocksDB: timers and lists need it.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Messages that a slice of a stored feed is meant to hold, and queued ones that are looked at together.
SLICE_MESSAGES, PIECE = 2_000_000, 50_000


def struct(columns: str) -> StructType:
    """A schema from "name type, ...": workers have no session that could parse DDL."""
    out = StructType()
    for column in columns.split(", "):
        name, kind = column.split()
        out = out.add(name, TYPES[kind])
    return out


@contextmanager
def state_provider(spark: SparkSession) -> Iterator[None]:
    """While a query starts, the session's state store is RocksDB, and its state has two partitions a core at most: every batch opens and commits each."""
    shuffle = "spark.sql.shuffle.partitions"
    few = min(int(spark.conf.get(shuffle)), 2 * spark.sparkContext.defaultParallelism)
    wanted = dict([PROVIDER, (shuffle, str(few))])
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def messages(fixtures: DataFrame, config: AsOfConfig = AsOfConfig(), notice: int = 0) -> DataFrame:
    """What a feed would have sent of ``fixtures``: each one's announcement, ``notice`` seconds before its question is due, and each final's result when it counts."""
    ask = F.struct(F.lit(ASK).alias("kind"), (F.col("kickoff") - config.lead - notice).alias("at"))
    tell = F.struct(F.lit(APPLY).alias("kind"), (F.col("kickoff") + config.lag).alias("at"))
    rows = fixtures.withColumn("m", F.explode(F.array(ask, tell))).where((F.col("m.kind") == ASK) | F.col("is_final"))
    goals = [F.when(F.col("m.kind") == APPLY, F.col(c)).cast("long").alias(c) for c in ("home_goals", "away_goals")]
    return rows.select(F.col("m.kind").alias("kind"), "league_id", "season", "fixture_id", "kickoff", *(F.col(c).cast("long").alias(c) for c in ("home", "away")), *goals, F.timestamp_seconds("m.at").alias("observed"))


def tick(spark: SparkSession, at: int) -> DataFrame:
    """A message that moves the watermark to ``at`` and does nothing else."""
    row = spark.range(0, 1, 1, 1).select(F.lit(TICK).alias("kind"), F.lit(-1).alias("league_id"), F.timestamp_seconds(F.lit(at)).alias("observed"))
    wanted = struct(MESSAGE)
    return row.select(*(F.col(f.name) if f.name in row.columns else F.lit(-1).cast(f.dataType).alias(f.name) for f in wanted.fields))


class Pending(StatefulProcessor):
    """Queues a key's messages until they are due; :meth:`work_off` gets those that are, in order.

    The queue is a list of blocks, each the messages of one frame as a table of longs, and a key has a timer for its first message only: when it fires, all that is due by then is worked off and a timer
    is set for what is due next. So each batch reads and writes a key's queue once, however many times of it the watermark passes.
    """

    #: Columns that a queued message keeps, besides when it is due and its kind.
    QUEUED = "season int, fixture_id long, kickoff long, home long, away long, home_goals long, away_goals long"
    WIDTH = 2 + len(QUEUED.split(", "))

    def __init__(self, config: AsOfConfig):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getListState("queue", struct("messages binary"))
        self.next = handle.getValueState("next", struct("due long"))
        self.last = handle.getValueState("last", struct("due long, kind int"))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        lead, lag = self.config.lead, self.config.lag
        names = [c.split()[0] for c in self.QUEUED.split(", ")]
        blocks, first = [], None
        for frame in rows:
            frame = frame[frame["kind"].isin((ASK, APPLY))]
            if len(frame):
                kind, kickoff = frame["kind"].to_numpy("int64"), frame["kickoff"].to_numpy("int64")
                due = np.where(kind == ASK, kickoff - lead, kickoff + lag)
                block = np.column_stack([due, kind, *(frame[n].fillna(-1).to_numpy("int64") for n in names)])
                early = int(due.min()), int(kind[due == due.min()].min())
                first = early if first is None else min(first, early)
                blocks.append((block.tobytes(),))
        if blocks:
            if self.last.exists() and first < (done := tuple(self.last.get())):
                raise ValueError(f"key {tuple(key)}: a message due at {first[0]} came after what was due at {done[0]} had been worked off")
            self.queue.appendList(blocks)
            self._wait_for(first[0])
        return iter(())

    def _wait_for(self, due: int) -> None:
        """Sets a timer for ``due`` unless one is set for that time or an earlier one."""
        if not self.next.exists() or due < self.next.get()[0]:
            self.handle.registerTimer(due * 1000)
            self.next.update((due,))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        # The watermark may have passed more than one timer at once: the first to fire works off all that is due, the others find nothing.
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        if not self.next.exists() or self.next.get()[0] * 1000 > now:
            return
        held = np.concatenate([np.frombuffer(q[0], "int64") for q in self.queue.get()]).reshape(-1, self.WIDTH)
        is_due = held[:, 0] * 1000 <= now
        due, rest = held[is_due], held[~is_due]
        self.next.clear()
        if len(rest):
            self.queue.put([(rest[i : i + PIECE].tobytes(),) for i in range(0, len(rest), PIECE)])
            self._wait_for(int(rest[:, 0].min()))
        else:
            self.queue.clear()
        due = due[np.lexsort((due[:, 3], due[:, 4], due[:, 1], due[:, 0]))]  # time, questions first, kickoff, fixture
        yield from self.work_off(key, due)
        self.last.update((int(due[-1, 0]), int(due[-1, 1])))

    def close(self) -> None:
        pass

    @abstractmethod
    def work_off(self, key: Any, due: np.ndarray) -> Iterator[pd.DataFrame]:
        """The answers to questions among ``due``: rows of due, kind, season, fixture_id, kickoff, home, away, home_goals, away_goals."""


def pieces(due: np.ndarray) -> Iterator[list[list[int]]]:
    """The rows as lists of numbers, some at a time."""
    return (due[i : i + PIECE].tolist() for i in range(0, len(due), PIECE))


class TeamForm(Pending):
    """Sums over a team's last ``window`` results known at each question."""

    OUT = "league_id int, team long, fixture_id long, is_home boolean, points long, scored long, conceded long, last_kickoff long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.recent = handle.getValueState("recent", struct("kickoff array<long>, points array<long>, scored array<long>, conceded array<long>"))

    def work_off(self, key: Any, due: np.ndarray) -> Iterator[pd.DataFrame]:
        league, team = map(int, key)
        kept = [list(x) for x in self.recent.get()] if self.recent.exists() else [[] for _ in range(4)]
        changed = False
        for piece in pieces(due):
            out = []
            for _, kind, _, fixture, kickoff, home, _, of_home, of_away in piece:
                mine = home == team
                if kind == ASK:
                    sums = [sum(c) for c in kept[1:]] if kept[0] else [None] * 3
                    out.append((league, team, fixture, mine, *sums, kept[0][-1] if kept[0] else None))
                    continue
                scored, conceded = (of_home, of_away) if mine else (of_away, of_home)
                for column, value in zip(kept, (kickoff, 3 if scored > conceded else int(scored == conceded), scored, conceded), strict=True):
                    column.append(value)
                    del column[: -self.config.window]
                changed = True
            if out:
                frame = pd.DataFrame(out, columns=[c.split()[0] for c in self.OUT.split(", ")])
                yield frame.astype({c: "Int64" for c in ("points", "scored", "conceded", "last_kickoff")})
        if changed:
            self.recent.update(tuple(kept))


class LeagueRatings(Pending):
    """Elo ratings of a league's teams; the first question of a new season carries them over before it is answered."""

    OUT = "league_id int, fixture_id long, season int, elo_diff_home_adv double"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.season = handle.getValueState("season", struct("season int"))
        self.ratings = handle.getMapState("ratings", struct("team long"), struct("rating double"))

    def work_off(self, key: Any, due: np.ndarray) -> Iterator[pd.DataFrame]:
        league = int(key[0])
        base, advantage, k = self.config.elo_base, self.config.home_advantage, self.config.elo_k
        season = self.season.get()[0] if self.season.exists() else None
        before = {int(t[0]): float(r[0]) for t, r in self.ratings.iterator()}
        # Fixtures of one kickoff belong to the earliest season among them.
        asked = due[due[:, 1] == ASK]
        first = pd.Series(asked[:, 2]).groupby(asked[:, 4]).min().to_dict()
        ratings, begun = dict(before), season
        for piece in pieces(due):
            out = []
            for _, kind, of, fixture, kickoff, home, away, of_home, of_away in piece:
                if kind == ASK:
                    year = int(first[kickoff])
                    if season is not None and year < season:
                        raise ValueError(f"season {year} after {season} in league {league}")
                    if season is not None and year > season:
                        ratings = {t: base + self.config.season_carry * (r - base) for t, r in ratings.items()}
                    season = year
                    out.append((league, fixture, of, round(ratings.get(home, base) + advantage - ratings.get(away, base), 8)))
                else:
                    mine, theirs = ratings.get(home, base), ratings.get(away, base)
                    actual = 1.0 if of_home > of_away else 0.5 if of_home == of_away else 0.0
                    change = k * (actual - expected(mine, theirs, advantage))
                    ratings[home], ratings[away] = mine + change, theirs - change
            if out:
                yield pd.DataFrame(out, columns=["league_id", "fixture_id", "season", "elo_diff_home_adv"])
        if season != begun:
            self.season.update((season,))
        for team, rating in ratings.items():
            if before.get(team) != rating:
                self.ratings.updateValue((team,), (rating,))


def _answered(keyed: DataFrame, keys: list[str], processor: Pending) -> DataFrame:
    return keyed.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=struct(processor.OUT), outputMode="Append", timeMode="EventTime")


def form_answers(feed: DataFrame, config: AsOfConfig = AsOfConfig(), delay: str = "0 seconds") -> DataFrame:
    """A row for each question and team of the stream ``feed``: fixture_id, is_home and the team's form as known then."""
    seen = feed.withWatermark("observed", delay)
    sides = seen.withColumn("team", F.explode(F.array("home", "away")))
    return _answered(sides, ["league_id", "team"], TeamForm(config))


def rating_answers(feed: DataFrame, config: AsOfConfig = AsOfConfig(), delay: str = "0 seconds") -> DataFrame:
    """A row for each question of the stream ``feed``: fixture_id and the rating difference as known then."""
    return _answered(feed.withWatermark("observed", delay), ["league_id"], LeagueRatings(config))


def store_feed(feed: DataFrame, path: str, slices: int = 4, files: int = 2, slice_messages: int = SLICE_MESSAGES) -> str:
    """Writes the messages to ``path`` in slices of ``files`` files that follow one another in time, and a last message that lets every timer fire.

    There are ``slices`` or more, so that each has some ``slice_messages``: what is pending at once is a slice or two. Files of a slice come in any order, so a stream over them must allow for a slice's length of delay, which is returned.
    """
    found = feed.agg(F.unix_seconds(F.min("observed")).alias("low"), F.unix_seconds(F.max("observed")).alias("high"), F.count("*").alias("n")).first()
    low, high = (0, 0) if found.low is None else (found.low, found.high)
    slices = max(1, slices, -(-found.n // slice_messages))
    width = max(1, -(-(high - low + 1) // slices))
    # One pass deals the messages into slices, another writes slice after slice: a stream reads files by their age.
    dealt = feed.withColumn("slice", F.floor((F.unix_seconds("observed") - low) / width).cast("int"))
    dealt.write.partitionBy("slice").parquet(f"{path}-dealt")
    held = feed.sparkSession.read.schema(dealt.schema).parquet(f"{path}-dealt")
    for i in range(slices if found.n else 0):
        held.where(F.col("slice") == i).drop("slice").repartition(files).write.mode("append").parquet(path)
    tick(feed.sparkSession, high + 2 * width + 1_000_000).write.mode("append").parquet(path)
    return f"{width} seconds"


def replay(spark: SparkSession, path: str, answers: Callable[[DataFrame], DataFrame], out: str, checkpoints: str, batches: int | None = None, files: int = 1) -> None:
    """Runs the stream over the files at ``path``, ``files`` a micro-batch, into a table at ``out``; goes on where ``checkpoints`` says it stopped. ``batches``: stops after so many."""
    feed = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files).parquet(path)
    with state_provider(spark):
        writer = answers(feed).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoints).outputMode("append")
        if batches is None:
            query = writer.trigger(availableNow=True).start()
            query.awaitTermination()
            return
        query = writer.start()
        try:
            while query.isActive and (query.lastProgress is None or query.lastProgress["batchId"] < batches - 1):
                query.awaitTermination(0.2)
        finally:
            query.stop()
