"""The registered stored run is a whole one: as many rounds and as much patience as the operator has."""

from hotgrid.operators import boosting, run
from hotgrid.plans import queries as Q


def test_every_model_of_the_registered_run_goes_on_until_its_patience_ends(spark, sf):
    assert Q.RUN_PLAN == boosting.Plan() and (Q.RUN_PLAN.rounds, Q.RUN_PLAN.patience) == (2200, 150)
    found = spark.read.parquet(f"{Q._stored(spark, sf)}/features").select("model", "rounds", "counted").distinct().collect()
    assert {r.model for r in found} == set(run.MODELS)
    assert all(r.counted == 2200 or r.counted - r.rounds == 150 for r in found), found


def test_rows_of_a_stage_are_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(boosting, "TASK_ROWS", 100)
    rows = spark.range(250).coalesce(1)
    assert boosting._spread(rows).rdd.getNumPartitions() == 3 and boosting._spread(rows).count() == 250
    assert boosting._spread(rows.limit(0)).count() == 0
