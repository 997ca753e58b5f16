import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from screenloom.config import PreprocessConfig
from screenloom.operators import features as ft
from screenloom.operators import metrics as mt
from screenloom.operators import models as md
from screenloom.operators import neighbors as nn
from screenloom.operators import preprocess as pp
from screenloom.operators import semantic as sm
from screenloom.operators.oversample import smote
from screenloom.operators.quantiles import exact_quantiles
from screenloom.operators.training import prepare
from screenloom.plans import fixtures as fx


def columns_of(spark, arrays):
    names = [f"c{i}" for i in range(len(arrays))]
    rows = [tuple(None if v is None else float(v) for v in r) for r in zip(*arrays)]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)), names


@pytest.mark.parametrize("bins", [2, 512])
def test_exact_quantiles(spark, bins):
    rng = np.random.default_rng(1)
    arrays = [
        rng.normal(size=501), rng.integers(0, 2, 501).astype(float), np.full(501, 3.0),
        np.concatenate([np.zeros(500), [1e12]]), 10.0 ** rng.integers(-9, 9, 501),
    ]
    df, names = columns_of(spark, arrays)
    probabilities = [0.0, 0.25, 0.37, 0.5, 0.75, 1.0]
    got = exact_quantiles(df, names, probabilities, bins=bins)
    for name, values in zip(names, arrays):
        assert [q.value for q in got[name]] == pytest.approx(np.quantile(values, probabilities).tolist(), rel=1e-12)


def test_quantiles_ignore_missing(spark):
    df, names = columns_of(spark, [[1.0, None, math.nan, 4.0], [None] * 4])
    got = exact_quantiles(df, names, [0.5])
    assert got["c0"][0].value == 2.5 and "c1" not in got


def likelihood(x, lam):
    up = np.log1p(x) if lam == 0 else ((x + 1) ** lam - 1) / lam
    return -len(x) / 2 * np.log(up.var()) + (lam - 1) * np.log1p(x).sum()


def test_yeo_johnson_lambda_maximises_the_likelihood(spark):
    rng = np.random.default_rng(2)
    arrays = [rng.exponential(2.0, 800), rng.uniform(0, 1, 800) ** 0.2, (rng.random(800) < 0.1).astype(float), np.ones(800)]
    df, names = columns_of(spark, arrays)
    lams = pp.fit_yeo_johnson(df, names)
    assert lams["c3"] == 1.0
    for name, x in zip(names[:3], arrays):
        grid = np.linspace(lams[name] - 3, lams[name] + 3, 1201)
        best = max((likelihood(x, g) for g in grid if abs(g) > 1e-9))
        assert likelihood(x, lams[name]) >= best - 1e-4


def test_features_of_one_profile(spark):
    schema = (
        "candidate_id string, age double, gender string, education_level string, field_of_study string, "
        "experience_years double, skills_text string, certifications string, current_job_title string"
    )
    rows = [
        ("a", 47.0, "MALE", " PhD ", "Data Science", 12.0, "python, AWS, aws", "Cert", "Data Scientist"),
        ("b", None, None, None, None, 0.0, None, "None", None),
    ]
    got = {r.candidate_id: r for r in ft.build_features(spark.createDataFrame(rows, schema), "candidate_id", PreprocessConfig()).collect()}
    a, b = got["a"], got["b"]
    assert len(ft.FEATURES) == 79 and [c for c in a.asDict() if c in ft.FEATURES] == ft.FEATURES
    assert (a.skill_count, a.skill_python, a.skill_aws, a.cloud_flag, a.ml_flag) == (3.0, 1.0, 1.0, 1.0, 0.0)
    assert (a.education_level, a.gender_encoded, a.is_expert, a.cluster_cloud_stack) == (6.0, 1.0, 1.0, 1 / 7)
    score = 2.6 + 2.1 + 1.6 * 0.3 + 1.1 + 0.9 + 0.8 + 0.7 / 7 + 0.5 + 0.4 * 0.3 + 0.3 - 0.25 * 0.4
    assert a.hr_score == pytest.approx(score)
    assert (b.age, b.education_level, b.field_relevance_score, b.best_cluster_score) == (None, 3.0, 0.45, 0.0)
    assert b.hr_score == pytest.approx(2.1 * 0.4 + 0.9 * 0.45 + 0.8 * 0.5 + 0.3 * 0.45 * 0.4)


def test_prepare_save_and_load(spark, sf_dir, tmp_path):
    people = fx.candidates(spark, sf_dir)
    ready = prepare(people, "candidate_id")
    counts = {r.label: r["count"] for r in ready.train.groupBy("label").count().collect()}
    assert counts[0] == counts[1]
    assert ready.train.select("id").distinct().count() == sum(counts.values())
    n = people.count()
    assert abs(ready.test.count() - 0.2 * n) <= 1
    out = ready.fitted.names_out
    x = np.array([r.v for r in ready.test.select(vector_to_array("features").alias("v")).collect()])
    assert x.shape[1] == len(out) and np.isfinite(x).all()
    ready.fitted.save(spark, str(tmp_path / "fit"))
    again = pp.FittedPreprocessor.load(spark, str(tmp_path / "fit"))
    assert again == ready.fitted
    features = ft.build_features(people, "candidate_id", again.config)
    assert again.transform(features, ["candidate_id"]).columns == ["candidate_id", *out]
    assert again.metadata()["n_features_out"] == len(out)


def labelled(rnd, n):
    """Predictions with ties and both classes."""
    return [("m", i, int(rnd.random() < 0.4), rnd.randrange(20) / 20) for i in range(n)]


def test_metrics(spark):
    rnd = random.Random(4)
    rows = labelled(rnd, 500)
    df = spark.createDataFrame(rows, "model string, id long, y int, score double")
    df = df.withColumn("yhat", (F.col("score") >= 0.5).cast("int"))
    pos = [r[3] for r in rows if r[2]]
    neg = [r[3] for r in rows if not r[2]]
    wins = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    assert mt.roc_auc(df, ["model"]).first().roc_auc == pytest.approx(wins / len(pos) / len(neg))
    points = mt.roc_curve(df, ["model"]).orderBy(F.desc("threshold")).collect()
    assert (points[0].fpr, points[0].tpr, points[-1].fpr, points[-1].tpr) == (0.0, 0.0, 1.0, 1.0)
    area = sum((b.fpr - a.fpr) * (a.tpr + b.tpr) / 2 for a, b in zip(points, points[1:]))
    assert area == pytest.approx(wins / len(pos) / len(neg))
    only = df.where("y = 1")
    assert mt.roc_auc(only, ["model"]).first().roc_auc == 0.0
    assert mt.binary_metrics(only.withColumn("yhat", F.lit(0)), ["model"]).first().precision == 0.0


def test_splits_are_exact_and_stable(spark):
    rows = [(i, i % 10 == 0) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, y boolean")
    split = mt.stratified_split(df, "id", "y", 0.2)
    assert {(r.y, r.is_test): r["count"] for r in split.groupBy("y", "is_test").count().collect()} == {
        (True, True): 20, (True, False): 80, (False, True): 180, (False, False): 720,
    }
    folds = mt.stratified_folds(df, "id", "y").groupBy("y", "fold").count().collect()
    assert sorted(r["count"] for r in folds) == [20] * 5 + [180] * 5
    again = mt.stratified_split(df.repartition(7), "id", "y", 0.2)
    assert split.exceptAll(again).count() == 0


def vectors(spark, x, ids=None):
    rows = [(int(i), [float(v) for v in row]) for i, row in zip(ids if ids is not None else range(len(x)), x)]
    return spark.createDataFrame(rows, "id long, vec array<double>")


def test_nearest_neighbors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(size=(150, 3)), rng.normal(size=(60, 3)) * 0.05 + 4, np.full((80, 3), 9.0)])
    queries = np.concatenate([rng.normal(size=(40, 3)), np.full((40, 3), 9.0), rng.normal(size=(20, 3)) * 30])
    got = nn.nearest_neighbors(vectors(spark, queries), vectors(spark, points), 7).collect()
    found = {(r.query_id, r["rank"]): r.id for r in got}
    distance = np.sqrt(((queries[:, None] - points[None]) ** 2).sum(2))
    for q, row in enumerate(distance):
        assert [found[(q, k)] for k in range(1, 8)] == np.lexsort((np.arange(len(row)), row))[:7].tolist()


def test_neighbors_without_themselves(spark):
    points = vectors(spark, [[0.0], [1.0], [3.0], [3.0]])
    got = {(r.query_id, r["rank"]): r.id for r in nn.nearest_neighbors(points, points, 2, exclude_same_id=True).collect()}
    assert got == {(0, 1): 1, (0, 2): 2, (1, 1): 0, (1, 2): 2, (2, 1): 3, (2, 2): 1, (3, 1): 2, (3, 2): 1}


def test_neighbors_among_chosen_points(spark):
    points = vectors(spark, np.random.default_rng(2).normal(size=(50, 3)))
    chosen = {r.id for r in nn.chosen_points(points, 12).collect()}
    assert len(chosen) == 12
    assert {r.id for r in nn.nearest_neighbors(points, points, 12, max_points=12).collect()} == chosen
    assert nn.nearest_neighbors(points, points.limit(0), 3).count() == 0
    assert nn.nearest_neighbors(points.limit(0), points, 3).count() == 0


def test_neighbors_among_all_points(spark):
    """More points than a classifier or a block holds: none is left out; nor is a point next to its base in smote."""
    x = np.random.default_rng(4).normal(size=(20_600, 2))
    points = vectors(spark, x)
    got = nn.nearest_neighbors(points.where("id % 500 = 0"), points, 3, exclude_same_id=True).collect()
    found = {(r.query_id, r["rank"]): r.id for r in got}
    for q in range(0, len(x), 500):
        assert [found[(q, k)] for k in (1, 2, 3)] == np.argsort(((x - x[q]) ** 2).sum(1))[1:4].tolist()


@pytest.mark.parametrize(("cell", "exclude"), [(1, True), (20, False), (400, True)])
def test_cells_lose_no_neighbor(spark, cell, exclude):
    """Cells of every size, with clusters, copies without end, repeated ids and vectors far from all others."""
    rng = np.random.default_rng(cell)
    x = np.concatenate([rng.normal(size=(200, 3)), rng.normal(size=(120, 3)) * 0.01 + 50, np.full((150, 3), 9.0), rng.normal(size=(30, 3)) * 1e4])
    ids = np.arange(len(x))
    ids[190:200] = 7  # rows that share an id
    points, report = vectors(spark, x, ids), {}
    got = nn.nearest_neighbors(points, points, 6, exclude, block_points=40, cell_points=cell, report=report).collect()
    expected = []
    for q in range(len(x)):
        distance = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, distance)) if not exclude or ids[i] != ids[q]][:6]
        expected += [(int(ids[q]), k + 1, round(float(distance[i]), 9), int(ids[i])) for k, i in enumerate(order)]
    assert sorted((r.query_id, r["rank"], round(r.distance, 9), r.id) for r in got) == sorted(expected)
    assert report["queries"] == len(x) and report["cells"] >= (1 if cell == 400 else 2)
    if cell == 20:
        assert report["visits"] < 0.5 * report["cells"] * len(x)


def test_blocks_of_points_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nn, "BLOCK_POINTS", 7)
    monkeypatch.setattr(nn, "CELL_POINTS", 10)
    x = np.round(np.random.default_rng(6).normal(size=(150, 2)), 1)  # with ties
    points = vectors(spark, x)
    twice = points.where("id < 40").union(points.where("id < 3"))  # queries that share an id
    got = nn.nearest_neighbors(twice, points.withColumn("label", F.col("id") % 3), 9, payload=["label"]).collect()
    expected = []
    for q in [*range(40), *range(3)]:
        distance = np.sqrt(((x - x[q]) ** 2).sum(1))
        expected += [(q, k + 1, float(distance[i]), int(i), int(i) % 3) for k, i in enumerate(np.lexsort((np.arange(150), distance))[:9])]
    assert sorted(map(tuple, got)) == sorted(expected)
    rows = [(i, 1 if i < 30 else 0, x[i].tolist()) for i in range(150)]
    out = smote(spark.createDataFrame(rows, "id long, label int, vec array<double>")).where("synthetic").collect()
    assert len(out) == 90
    for r in out:
        near = np.argsort(((x[:30] - x[r.id]) ** 2).sum(1), kind="stable")
        reach = np.linalg.norm(x[near[5]] - x[r.id])
        assert np.linalg.norm(np.array(r.vec) - x[r.id]) <= reach + 1e-9


def test_smote_of_several_classes(spark):
    rows = [(i, i % 10 and (1 if i % 3 else 2), [float(i), 1.0]) for i in range(60)] + [(100, None, [0.0, 0.0])]
    out = smote(spark.createDataFrame(rows, "id long, label int, vec array<double>")).groupBy("label").count().collect()
    sizes = {r["label"]: r["count"] for r in out}
    assert sizes.pop(None) == 1 and len(sizes) == 3 and len(set(sizes.values())) == 1


def test_rows_without_label_or_order_stay(spark):
    rows = [(i, None if i % 4 == 0 else i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, y int")
    split = mt.stratified_split(df, "id", "y", 0.25).groupBy("y").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t"))
    assert {(r.y, r.n, r.t) for r in split.collect()} == {(None, 10, 3), (0, 10, 3), (1, 20, 5)}
    assert mt.stratified_folds(df, "id", "y").count() == 40


def test_infinite_values(spark):
    inf = math.inf
    df = spark.createDataFrame([(x, 1.0) for x in (-inf, -1.7e308, 1.0, 2.0, 1.7e308, inf, None)] + [(math.nan, inf)], "a double, b double")
    found = exact_quantiles(df, ["a", "b"], [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])
    assert [q.value for q in found["a"]] == [-inf, -1.7e308, 1.0, 2.0, 1.7e308, inf]
    assert found["b"][0].value == 1.0 and found["b"][-1].value == inf
    with pytest.raises(ValueError, match="infinite values in b"):
        pp.fit(df.select("b").withColumn("k", F.lit("1")), ["b"], "k", PreprocessConfig(noise_std=0.0))


def test_smote_balances_on_segments(spark):
    rng = np.random.default_rng(5)
    small, large = rng.normal(size=(9, 2)), rng.normal(size=(60, 2)) + 5
    rows = [(i, 1, small[i].tolist()) for i in range(9)] + [(100 + i, 0, large[i].tolist()) for i in range(60)]
    out = smote(spark.createDataFrame(rows, "id long, label int, vec array<double>")).collect()
    made = [r for r in out if r.synthetic]
    assert len(made) == 51 and all(r.label == 1 for r in made)
    per_base = [sum(r.id == i for r in made) for i in range(9)]
    assert sorted(per_base) == [5] * 3 + [6] * 6
    for r in made:
        base, point = small[r.id], np.array(r.vec)
        near = np.argsort(((small - base) ** 2).sum(1))[1:6]
        gaps = [np.linalg.norm(point - base) + np.linalg.norm(small[j] - point) - np.linalg.norm(small[j] - base) for j in near]
        assert min(gaps) < 1e-9


def test_smote_leaves_single_class_and_lone_row(spark):
    schema = "id long, label int, vec array<double>"
    assert smote(spark.createDataFrame([(1, 1, [0.0]), (2, 1, [1.0])], schema)).count() == 2
    assert smote(spark.createDataFrame([(1, 1, [0.0]), (2, 0, [1.0]), (3, 0, [2.0])], schema)).count() == 3


def test_implied_skills(spark):
    skills = spark.createDataFrame([("A", [1.0, 0.0]), ("B", [0.0, 2.0])], "skill string, vec array<double>")
    texts = spark.createDataFrame([(1, [5.0, 5.0], ["A"]), (2, [1.0, 0.1], [])], "id long, v array<double>, f array<string>")
    got = sorted((r.id, r.implied_skill) for r in sm.implied_skills(texts, skills, "id", "v", "f").collect())
    assert got == [(1, "B"), (2, "A")]
    assert sm.implied_skills(texts, skills.limit(0), "id", "v", "f").count() == 0


def test_implied_skills_in_blocks(spark):
    """Blocks of skills and of texts give what one block of each gives."""
    rng = np.random.default_rng(9)
    skills = spark.createDataFrame([(f"s{k}", rng.normal(size=6).tolist()) for k in range(70)], "skill string, vec array<double>")
    rows = [(i, rng.normal(size=6).tolist(), [f"s{i % 70}"]) for i in range(120)]
    texts = spark.createDataFrame(rows, "id long, v array<double>, f array<string>")
    one = sm.implied_skills(texts, skills, "id", "v", "f")
    many = sm.implied_skills(texts, skills, "id", "v", "f", block_skills=9, block_texts=25)
    as_rows = lambda df: sorted((r["id"], r["implied_skill"], round(r["similarity"], 9)) for r in df.collect())
    assert as_rows(one) == as_rows(many) and one.count() > 300


def test_every_model_learns(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(160, 3))
    y = (x[:, 0] + x[:, 1] > 0).astype(int)
    from pyspark.ml.linalg import Vectors

    rows = [(i, int(y[i]), Vectors.dense(x[i].tolist())) for i in range(160)]
    df = spark.createDataFrame(rows, ["id", "label", "features"]).withColumn("label", F.col("label").cast("int")).cache()
    train, test = df.where("id < 120"), df.where("id >= 120")
    for name, trainer in md.default_models(max_iter_scale=0.05).items():
        metrics, tested, fitted = md.evaluate(trainer, name, train, test, folds=0)
        values = {r.metric: r.value for r in metrics.collect()}
        assert values["test_accuracy"] > 0.75 and 0.8 < values["roc_auc"] <= 1, name
        assert tested.where("score < 0 OR score > 1").count() == 0
        md.save(fitted, spark, str(tmp_path / name))
        again = md.load(spark, str(tmp_path / name))
        assert md.predictions(again, name, test).exceptAll(tested).count() == 0, name
        if name == "RandomForest":
            top = md.feature_importance(fitted, ["a", "b", "c"], spark, 2).collect()
            assert {r.feature for r in top} == {"a", "b"}
    cv = md.cross_validate(md.default_models()["LogisticRegression"], "LR", df, 4).first()
    assert cv.cv_mean > 0.85 and cv.cv_std < 0.2
