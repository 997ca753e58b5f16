"""Stored models are compared on predictions that are computed once each."""

from screenloom.plans import models as pm


def test_predictions_are_computed_once(spark, sf_dir, monkeypatch):
    staged, real = [], pm.stage
    monkeypatch.setattr(pm, "stage", lambda df, name: (staged.append(name), real(df, name))[1])
    rows = pm.saved_models(spark, sf_dir).collect()
    assert staged.count("compared") == 4
    assert {r["kind"] for r in rows} == {"classifier", "neighbours", "preprocessor"} and all(r["same"] and r["rows"] for r in rows)
