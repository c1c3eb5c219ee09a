"""Registered queries do the whole job: production defaults, all periods."""

import inspect

import pytest

import __spark_entry__ as entry_points
from paywatch.operators import forest, model


class Asked(Exception):
    pass


@pytest.mark.parametrize("name", ["risk_model_scores", "attribution_importance", "streaming_model_scores"])
def test_models_are_fitted_with_the_default_rounds(spark, sf_dir, monkeypatch, name):
    defaults = inspect.signature(model.train_risk)

    def fit(*args, **kwargs):
        bound = defaults.bind(*args, **kwargs)
        bound.apply_defaults()
        raise Asked(bound.arguments["rounds"])

    monkeypatch.setattr(model, "train_risk", fit)
    with pytest.raises(Asked) as told:
        entry_points.queries()[name](spark, sf_dir)
    assert told.value.args[0] == defaults.parameters["rounds"].default


def test_streaming_forest_has_the_default_trees(spark, sf_dir, monkeypatch):
    defaults = inspect.signature(forest.train_forest)

    def grow(*args, **kwargs):
        bound = defaults.bind(*args, **kwargs)
        bound.apply_defaults()
        raise Asked(bound.arguments["trees"])

    monkeypatch.setattr(model, "train_risk", lambda *args, **kwargs: None)
    monkeypatch.setattr(forest, "train_forest", grow)
    with pytest.raises(Asked) as told:
        entry_points.queries()["streaming_model_scores"](spark, sf_dir)
    assert told.value.args[0] == defaults.parameters["trees"].default


def test_heat_table_has_every_period(spark, sf_dir):
    months = {r.period for r in entry_points.queries()["psi_by_month"](spark, sf_dir).select("period").distinct().collect()}
    table = entry_points.queries()["psi_heat_table"](spark, sf_dir)
    assert table.columns == ["feature", *sorted(months)]
    want = {(r.feature, r.period): r.psi for r in entry_points.queries()["psi_by_month"](spark, sf_dir).collect()}
    got = {(r.feature, m): r[m] for r in table.collect() for m in months if r[m] is not None}
    assert got == want
