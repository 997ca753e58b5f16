"""Queries on neighbours, oversampling, implied skills and classifiers."""

from __future__ import annotations

import json
import math
from dataclasses import asdict

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from screenloom import __version__
from screenloom.config import PreprocessConfig
from screenloom.dims.domain import CLASS_NAMES
from screenloom.functions.scores import rounded
from screenloom.operators import metrics as mt
from screenloom.operators import models as md
from screenloom.operators import neighbors as nn
from screenloom.operators import semantic as sm
from screenloom.operators import skills as sk
from screenloom.operators.oversample import smote as oversample
from screenloom.operators.features import FEATURES
from screenloom.operators.preprocess import FittedPreprocessor
from screenloom.operators.training import Prepared, prepare
from screenloom.plans import fixtures as fx
from screenloom.plans.learning import SPLIT
from screenloom.plans.oracle_inputs import lit, r, with_inputs
from screenloom.plans.registry import query
from screenloom.session import new_path, stage

_VECTORS = "SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings"


def prepared(spark, d) -> Prepared:
    return prepare(fx.candidates(spark, d), "candidate_id")


@query(
    "knn_topk",
    with_inputs(
        "",
        f"""SELECT query_id, id, rank, {r('dist', 5)} AS distance FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS id, list_distance(a.v, b.v) AS dist,
   row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS rank
  FROM vecs a JOIN vecs b ON a.vec_id <> b.vec_id) WHERE rank <= 5""",
        {"vecs": _VECTORS},
    ),
)
def knn_topk(spark, d):
    points = fx.vectors(spark, d).select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec")
    )
    near = nn.nearest_neighbors(points, points, 5, exclude_same_id=True)
    return near.withColumn("rank", F.col("rank").cast("long")).withColumn("distance", rounded(F.col("distance"), 5))


_IMPLIED = {
    "vecs": _VECTORS,
    "means": """SELECT label, list(x ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS x FROM (
   SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM vecs) GROUP BY 1, 2) GROUP BY 1""",
    "implied": """SELECT vec_id, 'area_' || m.label::VARCHAR AS implied_skill, list_cosine_similarity(v, c) AS similarity
  FROM vecs JOIN means m ON list_cosine_similarity(v, c) >= 0.1 AND m.label <> vecs.label""",
}


def implied(spark, d):
    """Areas close to a vector other than its own. The threshold suits these nearly unrelated vectors."""
    vectors = fx.vectors(spark, d)
    own = F.array(F.concat(F.lit("area_"), F.col("label").cast("string")))
    texts = vectors.select("vec_id", "embedding", own.alias("found"))
    return sm.implied_skills(texts, sm.centroids(vectors, "label", "area_"), "vec_id", "embedding", "found", 0.1)


@query(
    "semantic_join",
    with_inputs("", f"SELECT vec_id, implied_skill, {r('similarity')} AS similarity FROM implied", _IMPLIED),
)
def semantic_join(spark, d):
    return implied(spark, d).withColumn("similarity", rounded(F.col("similarity"), 6))


@query(
    "extract_all_skills",
    with_inputs(
        "docs doc_hits",
        """SELECT doc_id, coalesce(string_agg(DISTINCT skill, '|' ORDER BY skill), '') AS skills FROM docs LEFT JOIN (
  SELECT doc_id, canonical AS skill FROM doc_hits UNION SELECT vec_id, implied_skill FROM implied) USING (doc_id)
 GROUP BY 1""",
        _IMPLIED,
    ),
)
def extract_all_skills(spark, d):
    """Found skills of a document together with those its vector implies."""
    matcher = sk.Matcher.build(sk.starter_entries(spark))
    found = matcher.skills(fx.documents(spark, d), "text").select("doc_id", "skills")
    extra = implied(spark, d).select(F.col("vec_id").alias("doc_id"), "implied_skill")
    both = sk.add_implied(found, extra, "doc_id")
    return both.select("doc_id", F.array_join("skills", "|").alias("skills"))


# The label with fewer rows is filled up; each of its rows is a base ``copies`` times.
_SMOTE = {
    "given": "SELECT doc_id AS id, quality AS label FROM labels JOIN documents USING (doc_id)",
    "sizes": "SELECT label, count(*) AS n, max(count(*)) OVER () AS most FROM given GROUP BY 1",
    "bases": """SELECT g.id, g.label, (most - n) // n + CASE WHEN row_number() OVER (PARTITION BY g.label ORDER BY
  substr(md5(g.id::VARCHAR || '|42-smote'), 1, 8), g.id) <= (most - n) % n THEN 1 ELSE 0 END AS copies
  FROM given g JOIN sizes s ON g.label = s.label AND n < most AND n > 1""",
}


@query(
    "smote",
    with_inputs(
        "",
        """SELECT id, label, false AS synthetic, true AS on_segment, count(*) AS n FROM given GROUP BY 1, 2
 UNION ALL SELECT id, label, true, true, copies FROM bases WHERE copies > 0""",
        _SMOTE,
    ),
)
def smote(spark, d):
    """Every labelled document by its shape; the smaller quality class is filled up. New points are checked to lie between
    their base and one of its nearest neighbours."""
    text = F.col("text")
    shape = F.array(
        F.log1p("n_chars"), F.regexp_count(text, F.lit(" ")) / F.greatest(F.length(text), F.lit(1)),
        F.log1p(F.regexp_count(text, F.lit("\n"))), (F.col("doc_id") % 97).cast("double"),
    )
    labels = fx.table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    docs = fx.table(spark, d, "documents").withColumn("vec", shape)
    rows = stage(labels.join(docs, "doc_id").select(F.col("doc_id").alias("id"), "label", "vec"), "labelled")
    every = oversample(rows)
    small = rows.groupBy("label").count().orderBy("count").first()["label"]
    points = rows.where(F.col("label") == small).select("id", "vec")
    near = nn.nearest_neighbors(points, points.withColumn("end", F.col("vec")), 5, True, ["end"])
    ends = near.groupBy(F.col("query_id").alias("id")).agg(F.collect_list("end").alias("ends"))
    bases = rows.select("id", F.col("vec").alias("base")).join(ends, "id", "left")

    def far(a, b):
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))

    on = F.exists("ends", lambda e: far("base", "vec") + far("vec", e) - far("base", e) < 1e-6)
    checked = every.join(bases, "id").withColumn("on_segment", ~F.col("synthetic") | on)
    return checked.groupBy("id", "label", "synthetic", "on_segment").agg(F.count("*").alias("n"))


# Fitted values are beyond SQL; what must hold of them for any fit is checked, over all rows of the given tables.
_PARTS = {
    "split": SPLIT,
    "tested": "SELECT label, count(*) AS n FROM split WHERE is_test GROUP BY 1",
    "trained": "SELECT label, max(count(*)) OVER () AS n FROM split WHERE NOT is_test GROUP BY 1",  # balanced
}


@query(
    "preprocess_fit_transform",
    with_inputs(
        "labelled",
        """SELECT 'train' AS part, label, n AS rows, true AS same_width, true AS finite FROM trained
 UNION ALL SELECT 'test', label, n, true, true FROM tested""",
        _PARTS,
    ),
)
def preprocess_fit_transform(spark, d):
    """Processed rows, training rows first balanced: how many of each label, all features present and finite."""
    ready = prepared(spark, d)
    values = vector_to_array("features").alias("features")
    every = ready.train.select(F.lit("train").alias("part"), "label", values).unionByName(
        ready.test.select(F.lit("test").alias("part"), "label", values)
    )
    width = len(ready.fitted.names_out)
    finite = F.forall("features", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return every.groupBy("part", "label").agg(
        F.count("*").alias("rows"), F.bool_and(F.size("features") == width).alias("same_width"), F.bool_and(finite).alias("finite")
    )


_NAMES = ", ".join(f"({lit(c)})" for c in FEATURES)


@query(
    "preprocess_columns",
    f"SELECT name, count(*) AS n, true AS sound FROM (VALUES {_NAMES}) t(name), (SELECT 1 FROM customer LIMIT 1) GROUP BY 1",
)
def preprocess_columns(spark, d):
    """Every column is fitted once, with bounds around its fill value and a positive scale."""
    fitted = prepared(spark, d).fitted.table(spark)
    sound = (F.col("low") <= F.col("fill")) & (F.col("fill") <= F.col("high")) & (F.col("scale") > 0) & F.col("lam").isNotNull()
    return fitted.groupBy("name").agg(F.count("*").alias("n"), F.bool_and(sound).alias("sound"))


_CONFIG = json.dumps(asdict(PreprocessConfig()))


@query(
    "preproc_metadata",
    f"""SELECT {lit(__version__)} AS version, {lit(_CONFIG)} AS config, {len(FEATURES)}::INTEGER AS n_features_in,
 true AS some_kept, {lit(', '.join(CLASS_NAMES))} AS class_names, count(*) AS candidates FROM customer""",
)
def preproc_metadata(spark, d):
    people = fx.candidates(spark, d)
    meta = prepare(people, "candidate_id").fitted.metadata()
    row = (
        meta["version"], json.dumps(meta["config"]), meta["n_features_in"], 0 < meta["n_features_out"] <= meta["n_features_in"],
        ", ".join(meta["class_names"]), people.count(),
    )
    schema = "version string, config string, n_features_in int, some_kept boolean, class_names string, candidates long"
    return spark.createDataFrame([row], schema)


_ON_TRAINING = ["train_accuracy", "cv_mean", "cv_std"]
_METRIC_ROWS = ", ".join(f"({lit(m)}, {lit('train' if m in _ON_TRAINING else 'test')})" for m in mt.METRICS)


def _metric_check(name: str) -> str:
    return with_inputs(
        "labelled",
        f"""SELECT {lit(name)} AS model, metric, rows, true AS in_bounds, true AS agrees FROM (VALUES {_METRIC_ROWS}) t(metric, part)
 JOIN (SELECT 'train' AS part, sum(n)::BIGINT AS rows FROM trained UNION ALL SELECT 'test', sum(n)::BIGINT FROM tested)
 USING (part)""",
        _PARTS,
    )


def _train_eval(name: str):
    def run(spark, d):
        """All metrics of a model with 5-fold validation: on how many rows each rests, whether it lies in its bounds, and
        whether it agrees with what the predictions themselves give. The values come from ``models.evaluate``."""
        ready = prepared(spark, d)
        metrics, tested, _ = md.evaluate(md.default_models()[name], name, ready.train, ready.test, 5)
        again = tested.agg(
            F.avg((F.col("y") == F.col("yhat")).cast("double")).alias("a"), F.avg(F.pow(F.col("y") - F.col("yhat"), 2)).alias("e"),
            F.count("*").alias("n"), F.bool_and(F.col("score").between(0, 1)).alias("p"),
        ).first()
        sizes = {"train": ready.train.count(), "test": again["n"]}
        direct = {"test_accuracy": again["a"], "mse": again["e"], "mae": again["e"], "rmse": math.sqrt(again["e"])}
        rows = []
        for r_ in metrics.collect():
            m, v = r_["metric"], r_["value"]
            part = "train" if m in _ON_TRAINING else "test"
            low = 0.5 if m in ("train_accuracy", "test_accuracy", "roc_auc", "cv_mean") else 0.0  # no worse than a coin
            rows.append((name, m, sizes[part], low <= v <= 1 and again["p"], abs(direct.get(m, v) - v) < 1e-9))
        return spark.createDataFrame(rows, "model string, metric string, rows long, in_bounds boolean, agrees boolean")

    return run


for _name in ("RandomForest", "LogisticRegression", "LinearSVC", "KNN", "GradientBoosting", "MLP", "RegularizedBoosting"):
    query(f"train_eval_{_name.lower()}", _metric_check(_name))(_train_eval(_name))


@query(
    "feature_importance",
    "SELECT unnest(range(1, 21)) AS place, true AS known, true AS falling FROM (SELECT 1 FROM customer LIMIT 1)",
)
def feature_importance(spark, d):
    """The twenty most important features of a forest, from the greatest down."""
    ready = prepared(spark, d)
    forest = md.default_models()["RandomForest"](ready.train)
    top = md.feature_importance(forest, ready.fitted.names_out, spark).collect()
    places = [
        (k + 1, t["feature"] in FEATURES, 0 <= t["importance"] <= (top[k - 1]["importance"] if k else 1)) for k, t in enumerate(top)
    ]
    return spark.createDataFrame(places, "place long, known boolean, falling boolean")


@query(
    "actual_vs_predicted",
    with_inputs("labelled", "SELECT label AS actual, n AS rows, true AS consistent FROM tested", _PARTS),
)
def actual_vs_predicted(spark, d):
    """Every test row once under its own label, its probability on the side of its prediction."""
    ready = prepared(spark, d)
    fitted = md.default_models()["LogisticRegression"](ready.train)
    rows = md.actual_vs_predicted(md.predictions(fitted, "LogisticRegression", ready.test))
    sound = F.col("correct") == (F.col("actual") == F.col("predicted"))
    sound &= (F.col("predicted") == (F.col("probability") > 0.5).cast("int")) & F.col("probability").between(0, 1)
    return rows.groupBy("actual").agg(F.countDistinct("id").alias("rows"), F.bool_and(sound).alias("consistent"))


@query(
    "saved_models",
    with_inputs("labelled", "SELECT kind, sum(n)::BIGINT AS rows, true AS same FROM tested, "
    "(VALUES ('classifier'), ('neighbours'), ('preprocessor')) t(kind) GROUP BY 1", _PARTS),
)
def saved_models(spark, d):
    """Stored and loaded again, everything gives the same results on all test rows."""
    ready = prepared(spark, d)
    path = new_path(spark, "models")
    found = []
    for kind, name in (("classifier", "LogisticRegression"), ("neighbours", "KNN")):
        fitted = md.default_models()[name](ready.train)
        md.save(fitted, spark, f"{path}/{kind}")
        both = (fitted, md.load(spark, f"{path}/{kind}"))
        before, after = (stage(md.predictions(f, name, ready.test), "compared") for f in both)  # counted and compared
        found.append((kind, after.count(), before.exceptAll(after).isEmpty()))
    ready.fitted.save(spark, f"{path}/columns")
    again = FittedPreprocessor.load(spark, f"{path}/columns")
    found.append(("preprocessor", ready.test.count(), again.columns == ready.fitted.columns))
    return spark.createDataFrame(found, "kind string, rows long, same boolean")
