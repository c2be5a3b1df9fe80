from contextvine.operators import selection

from .test_scoring import several


def test_changes_hold_the_best_setting(spark):
    """Thresholds at which a model changes are few, and the best by each criterion is the best of the whole grid."""
    seqs, _ = several(spark)
    grids = [selection.parameter_grid(seqs, [2, 3], [1, 2], selection.threshold_grid(0.0, 200, 0.05), changes=c).cache() for c in (False, True)]
    assert grids[0].count() == 11 * 4 * 200 and grids[1].count() < 11 * 4 * 40
    criteria = ["bic_score", "aic_score", "aicc_score"]
    whole, few = ([r.asDict() for r in selection.best_by(g, criteria).orderBy("seq_id", "criterion").collect()] for g in grids)
    assert len(few) == 33 and few == whole
    one = {r.seq_id: r.threshold for r in selection.best_parameters(grids[0], "aic_score").collect()}
    assert one == {r["seq_id"]: r["threshold"] for r in few if r["criterion"] == "aic_score"}


def test_settings_multiply_no_shuffle(spark):
    seqs, _ = several(spark, 3)
    plan = selection.parameter_grid(seqs, [2, 3], [1, 2], [0.5, 1.0])._jdf.queryExecution().executedPlan().toString()
    assert "min_count" not in "".join(line for line in plan.splitlines() if "Exchange" in line)
