import numpy as np
import pytest

from touchline.operators import asof, candidates, gbdt, walkforward
from touchline.sources import fixtures as source

SF = "/root/testdata/sf0.001"
BOOST = gbdt.BoostConfig(rounds=4)


def test_candidate_of_a_fitted_backtest(spark, tmp_path):
    root = f"file://{tmp_path}/candidates"
    fx = source.with_drawn_goals(source.from_orders(spark, SF))
    examples = asof.snapshots(fx).where("target is not null").persist()
    done = walkforward.run(examples, asof.FEATURES, boost=BOOST)
    tables = walkforward.final_tables(examples, asof.FEATURES, done, BOOST)
    assert candidates.read_candidate(spark, root) is None
    refused = {**done.report, "gate": {"passed": False}}
    assert candidates.write_candidate(spark, root, "v0", refused, tables) is None and candidates.read_candidate(spark, root) is None

    passed = {**done.report, "gate": {"passed": True, "failures": []}}
    candidates.write_candidate(spark, root, "v1", passed, tables)
    own = {r.fixture_id: r.p for r in walkforward.candidate_probabilities(examples, tables, BOOST).collect()}
    fresh = spark.newSession()
    found = candidates.read_candidate(fresh, root)
    assert found.version == "v1" and found.report["finalFit"] == done.report["finalFit"]
    read = {r.fixture_id: r.p for r in walkforward.candidate_probabilities(examples, found.tables, BOOST).collect()}
    assert len(read) == examples.count() and all(np.array_equal(read[i], own[i]) for i in own)
    assert all(abs(sum(p) - 1) < 1e-12 for p in read.values())

    # A writer that stops before the rename leaves the old pointer; one that commits replaces it.
    staged = candidates.stage_candidate(spark, root, "v2", passed, {"curves": tables["curves"]})
    assert candidates.read_candidate(spark, root).version == "v1"
    candidates.commit_candidate(spark, root, staged)
    assert candidates.read_candidate(spark, root).version == "v2"
    with pytest.raises(FileNotFoundError):
        candidates.commit_candidate(spark, root, "v3-unfinished")

    tables["curves"].limit(1).write.mode("overwrite").parquet(f"{root}/{staged}/curves.parquet")
    with pytest.raises(ValueError, match="curves"):
        candidates.read_candidate(spark, root)
