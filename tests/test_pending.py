from functools import partial

import pytest
from pyspark.sql import functions as F

from touchline.operators import asof, elo
from touchline.plans import catalog
from touchline.sources import fixtures as source
from touchline.streaming import pending

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("feed") / "messages")
    delay = pending.store_feed(pending.messages(source.from_orders(spark, SF), notice=3600).repartition(2), path)
    return path, delay


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


def test_replayed_form_equals_the_batch_query(spark, feed, tmp_path):
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    path, delay = feed
    run = partial(pending.replay, spark, path, partial(pending.form_answers, delay=delay), out, marks, files=2)
    run(batches=3)  # stopped half way
    some = spark.read.schema(pending.TeamForm.OUT).parquet(out).count()
    run()
    form = spark.read.parquet(out).withColumn("seen", F.struct("points", "scored", "conceded"))
    assert 0 < some < form.count()
    got = asof.by_side(form, asof.form_columns())
    want = catalog.asof_points(spark, SF).join(catalog.asof_goals(spark, SF), "fixture_id")
    assert rows(got) == rows(want)


def test_replayed_ratings_equal_the_batch_query(spark, feed, tmp_path):
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    path, delay = feed
    run = partial(pending.replay, spark, path, partial(pending.rating_answers, delay=delay), out, marks, files=2)
    run(batches=3)
    run()
    assert rows(spark.read.parquet(out).select("fixture_id", "elo_diff_home_adv")) == rows(elo.elo_snapshots(source.from_orders(spark, SF)))


DAY = 86_400


def played(spark, path, sent, answers):
    """``sent``: (file, kind, season, fixture_id, kickoff, home, away, home_goals, away_goals, observed)."""
    for n in sorted({s[0] for s in sent}):
        part = [(s[1], 0, *s[2:9], s[9]) for s in sent if s[0] == n]
        df = spark.createDataFrame(part, pending.MESSAGE.replace("observed timestamp", "at long")).withColumn("observed", F.timestamp_seconds("at")).drop("at")
        df.coalesce(1).write.mode("append").parquet(path + "/feed")
    pending.replay(spark, path + "/feed", answers, path + "/out", path + "/marks")
    return spark.read.parquet(path + "/out")


ASK, APPLY = pending.ASK, pending.APPLY


def test_result_known_at_the_moment_of_a_question_does_not_count(spark, tmp_path):
    sent = [(0, ASK, 1, 1, 10 * DAY, 1, 2, -1, -1, 9 * DAY), (0, APPLY, 1, 1, 10 * DAY, 1, 2, 2, 0, 11 * DAY), (0, ASK, 1, 2, 12 * DAY, 1, 3, -1, -1, 11 * DAY), (0, ASK, 1, 3, 12 * DAY + 1, 1, 4, -1, -1, 11 * DAY), (1, pending.TICK, 1, -1, 0, -1, -1, -1, -1, 30 * DAY)]
    got = {r.fixture_id: r.points for r in played(spark, str(tmp_path), sent, pending.form_answers).where("team = 1").collect()}
    assert got == {1: None, 2: None, 3: 3}


def test_late_results_and_seasons_are_errors(spark, tmp_path):
    late = [(0, ASK, 1, 1, 10 * DAY, 1, 2, -1, -1, 9 * DAY), (0, ASK, 1, 2, 20 * DAY, 1, 2, -1, -1, 19 * DAY), (1, ASK, 1, 3, 40 * DAY, 1, 2, -1, -1, 39 * DAY), (2, APPLY, 1, 1, 10 * DAY, 1, 2, 1, 1, 40 * DAY), (3, pending.TICK, 1, -1, 0, -1, -1, -1, -1, 60 * DAY)]
    with pytest.raises(Exception, match="had been worked off"):
        played(spark, str(tmp_path / "a"), late, pending.form_answers)
    back = [(0, ASK, 2, 1, 10 * DAY, 1, 2, -1, -1, 9 * DAY), (1, ASK, 1, 2, 20 * DAY, 1, 2, -1, -1, 19 * DAY), (2, pending.TICK, 1, -1, 0, -1, -1, -1, -1, 60 * DAY)]
    with pytest.raises(Exception, match="season 1 after 2"):
        played(spark, str(tmp_path / "b"), back, pending.rating_answers)


def test_a_key_sets_one_timer_for_all_that_is_pending():
    """A timer for each due time made every one of them read the whole queue again."""
    import numpy as np
    import pandas as pd

    class Value:
        def __init__(self):
            self.value = None

        def exists(self):
            return self.value is not None

        def get(self):
            reads.append(1)
            return self.value

        def update(self, value):
            self.value = value

        put = update

        def clear(self):
            self.value = None

        def appendList(self, values):
            self.value = [*(self.value or []), *values]

    class Handle:
        def getListState(self, *_):
            return Value()

        getValueState = getListState

        def registerTimer(self, at):
            timers.append(at)

    class Seen(pending.Pending):
        def work_off(self, key, due):
            yield due

    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    reads, timers = [], []
    held = Seen(asof.AsOfConfig())
    held.init(Handle())
    days = np.arange(1000) + 10
    frame = pd.DataFrame({"kind": ASK, "kickoff": days * DAY, **{c: 1 for c in ("season", "home", "away", "home_goals", "away_goals")}, "fixture_id": days})
    list(held.handleInputRows((0, 1), iter([frame.sample(frac=1, random_state=1)]), None))
    assert timers == [9 * DAY * 1000]
    (first,) = held.handleExpiredTimer((0, 1), At(500 * DAY * 1000), At(9 * DAY * 1000))
    assert first[:, 3].tolist() == list(range(10, 502))
    assert timers == [9 * DAY * 1000, 501 * DAY * 1000]
    before = len(reads)
    assert not list(held.handleExpiredTimer((0, 1), At(500 * DAY * 1000), At(20 * DAY * 1000)))
    assert len(reads) == before + 1  # only when the next one is due
    (second,) = held.handleExpiredTimer((0, 1), At(5000 * DAY * 1000), At(501 * DAY * 1000))
    assert second[:, 3].tolist() == list(range(502, 1010))


def test_a_large_feed_has_more_slices(spark, tmp_path):
    path = str(tmp_path / "feed")
    width = int(pending.store_feed(pending.messages(source.from_orders(spark, SF)), path, files=1, slice_messages=300).split()[0])
    stored = spark.read.parquet(path).where(F.col("kind") > 0).withColumn("file", F.input_file_name())
    spans = stored.groupBy("file").agg((F.unix_seconds(F.max("observed")) - F.unix_seconds(F.min("observed"))).alias("span"), F.count("*").alias("n")).collect()
    assert len(spans) > 6 and max(r.span for r in spans) < width and sum(r.n for r in spans) == pending.messages(source.from_orders(spark, SF)).count()
