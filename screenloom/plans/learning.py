"""Queries on features, preprocessing statistics and classification metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from screenloom.config import PreprocessConfig
from screenloom.dims import domain as dm
from screenloom.functions.scores import lookup, rounded
from screenloom.operators import features as ft
from screenloom.operators import metrics as mt
from screenloom.operators import preprocess as pp
from screenloom.operators.quantiles import exact_quantiles
from screenloom.plans import fixtures as fx
from screenloom.plans.oracle_inputs import CTES, NEEDS, items, lit, r, with_inputs
from screenloom.plans.registry import query

CFG = PreprocessConfig()

# ---- checking SQL of the features ------------------------------------------------------------------------------


def _case(column: str, scores: dict, default: float) -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {float(v)!r}" for k, v in scores.items())
    return f"(CASE trim({column}) {whens} ELSE {float(default)!r} END)::DOUBLE"


def _u(key: str, seed: str) -> str:
    return f"('0x' || substr(md5({key} || '|{seed}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


_CLUSTERS = ", ".join(
    f"len(list_intersect(lset, {items([m.lower() for m in members])}))::DOUBLE / {len(members)} AS cluster_{name}"
    for name, members in dm.SKILL_CLUSTERS.items()
)
_CLUSTER_NAMES = [f"cluster_{name}" for name in dm.SKILL_CLUSTERS]
_BREADTH = " + ".join(f"({c} > 0)::INTEGER" for c in _CLUSTER_NAMES)

CTES |= {
    "basics": f"""SELECT *, {_BREADTH} AS breadth, greatest({', '.join(_CLUSTER_NAMES)}) AS best,
  ln(1 + exp_) / ln(13.0::DOUBLE) AS exp_norm, (edu - 1) / 5.0::DOUBLE AS edu_norm,
  least(n / 10.0::DOUBLE, 1.0::DOUBLE) AS skill_norm FROM (
 SELECT *, {_CLUSTERS} FROM (
 SELECT c.candidate_id, c.ord, c.age, c.gender, c.experience_years AS exp_, p.skills,
  list_distinct(list_transform(p.skills, lambda x: lower(x))) AS lset, len(p.skills)::DOUBLE AS n,
  {_case('education_level', dm.EDUCATION_LEVEL, dm.EDUCATION_DEFAULT)} AS edu,
  {_case('field_of_study', dm.FIELD_SCORE, dm.FIELD_DEFAULT)} AS fld,
  {_case('current_job_title', dm.TITLE_SCORE, dm.TITLE_DEFAULT)} AS title,
  CASE WHEN certifications IS NULL OR trim(certifications) IN ('None', '') THEN 0.0 ELSE 1.0 END::DOUBLE AS cert
 FROM cand c JOIN profile p USING (candidate_id)))""",
    "hr": """SELECT *, 2.6*exp_norm + 2.1*edu_norm + 1.6*skill_norm + 1.1*cert + 0.9*fld + 0.8*title + 0.7*best
  + 0.5*(exp_norm*edu_norm) + 0.4*(skill_norm*cert) + 0.3*(fld*edu_norm)
  - 0.25*greatest(0.0::DOUBLE, coalesce((age-45)/5.0::DOUBLE, 0.0)) AS hr_score FROM basics""",
    "labelled": f"""SELECT *, CASE WHEN {_u('candidate_id', '42-flip')} <
   CASE WHEN abs(hr_score - 5.0) < 0.8 THEN (0.06::DOUBLE + 0.15::DOUBLE) ELSE 0.06::DOUBLE END
  THEN 1 - (hr_score >= 5.0)::INTEGER ELSE (hr_score >= 5.0)::INTEGER END AS label FROM hr""",
    "core": f"""SELECT candidate_id, label, age, exp_ AS experience_years, ln(1 + exp_) AS experience_log,
  edu AS education_level, n AS skill_count, fld AS field_relevance_score, title AS title_relevance_score,
  cert AS has_certification, breadth::DOUBLE AS skill_breadth, best AS best_cluster_score,
  n / greatest(exp_, 1.0::DOUBLE) AS skill_density, edu_norm * fld AS edu_field_alignment,
  exp_*exp_ AS exp_squared, edu*cert AS edu_cert_product, exp_*edu AS exp_edu_product, n*cert AS skill_cert_product,
  exp_norm*fld AS exp_field_product, exp_norm*title AS exp_title_product, edu_norm*title AS edu_title_product,
  skill_norm*fld AS skill_field_product FROM labelled""",
}
NEEDS |= {"basics": ["cand", "profile"], "hr": ["basics"], "labelled": ["hr"], "core": ["labelled"]}


def basics(spark, d):
    return ft.with_basics(fx.candidates(spark, d)).withColumn("hr_score", ft.hr_score())


def features(spark, d):
    return ft.build_features(fx.candidates(spark, d), "candidate_id", CFG)


def _r(columns: list[str]) -> str:
    return ", ".join(f"{r(c)} AS {c}" for c in columns)


def _rounded(columns: list[str]) -> list:
    return [rounded(ft.quoted(c), 6).alias(c) for c in columns]


# ---- features --------------------------------------------------------------------------------------------------


@query(
    "domain_scores",
    with_inputs(
        "basics", "SELECT candidate_id, edu AS education, fld AS field_score, title AS title_score FROM basics"
    ),
)
def domain_scores(spark, d):
    return fx.candidates(spark, d).select(
        "candidate_id",
        lookup(F.col("education_level"), dm.EDUCATION_LEVEL, dm.EDUCATION_DEFAULT).alias("education"),
        lookup(F.col("field_of_study"), dm.FIELD_SCORE, dm.FIELD_DEFAULT).alias("field_score"),
        lookup(F.col("current_job_title"), dm.TITLE_SCORE, dm.TITLE_DEFAULT).alias("title_score"),
    )


@query(
    "cluster_scores",
    with_inputs("basics", f"SELECT candidate_id, {_r(_CLUSTER_NAMES)}, breadth, {r('best')} AS best FROM basics"),
)
def cluster_scores(spark, d):
    columns = [F.col("_breadth").alias("breadth"), rounded(F.col("_best"), 6).alias("best")]
    return basics(spark, d).select("candidate_id", *_rounded(_CLUSTER_NAMES), *columns)


@query("hr_score", with_inputs("hr", f"SELECT candidate_id, {r('hr_score')} AS hr_score FROM hr"))
def hr_score(spark, d):
    return basics(spark, d).select("candidate_id", rounded(F.col("hr_score"), 6).alias("hr_score"))


_CORE_ALL = [*ft.FEATURES[:20]]


@query("features_core", with_inputs("core", f"SELECT candidate_id, {_r(_CORE_ALL)} FROM core"))
def features_core(spark, d):
    return features(spark, d).select("candidate_id", *_rounded(_CORE_ALL))


_FLAG_SQL = ", ".join(
    f"list_has_any(skills, {items(v)})::INTEGER::DOUBLE AS {k}" for k, v in dm.SKILL_FLAGS.items()
)
_FLAGS = ft.FEATURES[26:39]


@query(
    "feature_flags",
    with_inputs(
        "basics",
        f"""SELECT candidate_id, CASE lower(gender) WHEN 'male' THEN 1.0 WHEN 'female' THEN 2.0 ELSE 0.0 END::DOUBLE
  AS gender_encoded, (exp_ < 2)::INTEGER::DOUBLE AS is_junior, (exp_ >= 3)::INTEGER::DOUBLE AS is_experienced,
  (exp_ >= 7)::INTEGER::DOUBLE AS is_senior, (exp_ >= 10)::INTEGER::DOUBLE AS is_expert,
  (edu >= 5)::INTEGER::DOUBLE AS high_edu_flag, (n >= 5)::INTEGER::DOUBLE AS high_skill_flag, {_FLAG_SQL}
 FROM basics""",
    ),
)
def feature_flags(spark, d):
    return features(spark, d).select("candidate_id", *_FLAGS)



def plain(skill: str) -> str:
    """One-hot name without dots and slashes."""
    return ft.one_hot_name(skill).replace(".", "_").replace("/", "_")


_ONE_HOT_SQL = ", ".join(
    f'list_contains(lset, {lit(s.lower())})::INTEGER::DOUBLE AS {plain(s)}' for s in dm.SKILL_VOCABULARY
)


@query("skill_onehot", with_inputs("basics", f"SELECT candidate_id, {_ONE_HOT_SQL} FROM basics"))
def skill_onehot(spark, d):
    columns = [ft.quoted(ft.one_hot_name(s)).alias(plain(s)) for s in dm.SKILL_VOCABULARY]
    return features(spark, d).select("candidate_id", *columns)


@query("build_target", with_inputs("labelled", "SELECT candidate_id, label FROM labelled"))
def build_target(spark, d):
    return features(spark, d).select("candidate_id", "label")


_NOISY = ", ".join(
    r(
        f"{c} + 0.15::DOUBLE * sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {_u('candidate_id', f'42-{c}a')})) "
        f"* cos(2.0::DOUBLE * pi() * {_u('candidate_id', f'42-{c}b')})"
    )
    + f" AS {c}"
    for c in ft.CORE
)


@query("add_noise", with_inputs("core", f"SELECT candidate_id, {_NOISY} FROM core"))
def add_noise(spark, d):
    noise = ft.noisy(ft.CORE, "candidate_id", CFG)
    return features(spark, d).withColumns(noise).select("candidate_id", *_rounded(ft.CORE))


@query(
    "label_distribution",
    with_inputs(
        "labelled",
        f"""SELECT label, n, {r('n / sum(n) OVER ()')} AS share FROM (SELECT label, count(*)::DOUBLE::BIGINT AS n
 FROM labelled GROUP BY 1)""",
    ),
)
def label_distribution(spark, d):
    shares = mt.label_distribution(features(spark, d).select("label"))
    return shares.withColumn("share", rounded(F.col("share"), 6))


@query(
    "class_weights",
    with_inputs(
        "labelled",
        f"""SELECT label, n, {r('(SELECT count(*) FROM labelled)::DOUBLE / (2 * n)')} AS weight
 FROM (SELECT label, count(*) AS n FROM labelled GROUP BY 1)""",
    ),
)
def class_weights(spark, d):
    weights = mt.class_weights(features(spark, d).select("label"))
    return weights.withColumn("weight", rounded(F.col("weight"), 6))


# ---- preprocessing statistics on numeric columns ---------------------------------------------------------------

NUM = fx.NUMERIC
KEYS = ["l_orderkey", "l_linenumber"]
_KEYS = ", ".join(KEYS)


def _per_column(template: str) -> str:
    return ", ".join(f"{r(template.format(c=c))} AS {c}" for c in NUM)


@query(
    "winsorize",
    f"""WITH s AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in NUM)} FROM lineitem)
 SELECT {_KEYS}, {_per_column('least(greatest({c}, m_{c} - 1.5*s_{c}), m_{c} + 1.5*s_{c})')} FROM lineitem, s""",
)
def winsorize(spark, d):
    """Clipping at 1.5 deviations, which these evenly spread columns exceed."""
    df = fx.numeric(spark, d)
    clipped = {
        c: pp.clip(F.col(c), m - 1.5 * s, m + 1.5 * s) for c, (m, s) in pp.moments(df, NUM).items()
    }
    return df.select(*KEYS, *[rounded(v, 6).alias(c) for c, v in clipped.items()])


@query(
    "impute_median",
    with_inputs(
        "cand",
        f"SELECT candidate_id, {r('coalesce(age, (SELECT quantile_cont(age, 0.5) FROM cand))')} AS age FROM cand",
    ),
)
def impute_median(spark, d):
    people = fx.candidates(spark, d).select("candidate_id", "age")
    median = exact_quantiles(people, ["age"], [0.5])["age"][0].value
    return people.withColumn("age", rounded(F.coalesce("age", F.lit(median)), 6))


def _quantile(c: str, p: float) -> str:
    return f"quantile_cont({c}, {p}) AS q{int(p * 100)}_{c}"


@query(
    "column_quantiles",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS name, {r(f'quantile_cont({c}, 0.25)')} AS q25, {r(f'quantile_cont({c}, 0.5)')} AS q50,
 {r(f'quantile_cont({c}, 0.75)')} AS q75 FROM lineitem"""
        for c in NUM
    ),
)
def column_quantiles(spark, d):
    found = exact_quantiles(fx.numeric(spark, d), NUM, [0.25, 0.5, 0.75])
    rows = [(c, *[q.value for q in qs]) for c, qs in found.items()]
    table = spark.createDataFrame(rows, "name string, q25 double, q50 double, q75 double")
    return table.select("name", *[rounded(F.col(c), 6).alias(c) for c in ("q25", "q50", "q75")])


@query(
    "robust_scale",
    f"""WITH s AS (SELECT {', '.join(_quantile(c, p) for c in NUM for p in (0.25, 0.5, 0.75))} FROM lineitem)
 SELECT {_KEYS}, {_per_column('({c} - q50_{c}) / CASE WHEN q75_{c} = q25_{c} THEN 1.0::DOUBLE ELSE q75_{c} - q25_{c} END')}
 FROM lineitem, s""",
)
def robust_scale(spark, d):
    df = fx.numeric(spark, d)
    scaled = []
    for c, (low, median, high) in exact_quantiles(df, NUM, [0.25, 0.5, 0.75]).items():
        width = (high.value - low.value) or 1.0
        scaled.append(rounded((F.col(c) - median.value) / width, 6).alias(c))
    return df.select(*KEYS, *scaled)


@query(
    "standard_scale",
    f"""WITH s AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in NUM)} FROM lineitem)
 SELECT {_KEYS}, {_per_column('({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1.0::DOUBLE ELSE s_{c} END')}
 FROM lineitem, s""",
)
def standard_scale(spark, d):
    df = fx.numeric(spark, d)
    scaled = {c: (F.col(c) - m) / (s or 1.0) for c, (m, s) in pp.moments(df, NUM).items()}
    return df.select(*KEYS, *[rounded(v, 6).alias(c) for c, v in scaled.items()])


LAMBDAS = {"l_quantity": 0.5, "l_extendedprice": 0.0, "l_discount": 1.7, "l_tax": 2.0}


def _yj(c: str, lam: float) -> str:
    x = f"({c} - 0.03::DOUBLE)"
    positive = f"ln(1 + {x})" if lam == 0 else f"(pow({x} + 1, {lam}) - 1) / {lam}::DOUBLE"
    negative = f"-ln(1 - {x})" if lam == 2 else f"-(pow(1 - {x}, {2 - lam}) - 1) / {2 - lam}::DOUBLE"
    return f"CASE WHEN {x} >= 0 THEN {positive} ELSE {negative} END"


@query(
    "yeo_johnson",
    f"SELECT {_KEYS}, {', '.join(f'{r(_yj(c, lam), 4)} AS {c}' for c, lam in LAMBDAS.items())} FROM lineitem",
)
def yeo_johnson(spark, d):
    """Fixed lambdas on shifted columns, so that both signs occur."""
    moved = {c: pp.yeo_johnson(F.col(c) - 0.03, lam) for c, lam in LAMBDAS.items()}
    return fx.numeric(spark, d).select(*KEYS, *[rounded(v, 4).alias(c) for c, v in moved.items()])


def _likelihood(grid: str) -> str:
    """(name, lam, score) of the values x for every lambda of a grid (non-negative columns)."""
    power = "CASE WHEN abs(lam) < 1e-12 THEN ln(1 + x) ELSE (pow(x + 1, lam) - 1) / lam END"
    return f"""SELECT name, lam, -count(*) / 2.0::DOUBLE * ln(var_pop({power})) + (lam - 1) * sum(ln(1 + x)) AS score
 FROM v JOIN {grid} g USING (name) GROUP BY 1, 2"""


def _finer(best: str, half: int, step: str) -> str:
    return f"SELECT name, lam + unnest(range({-half}, {half + 1})) * {step}::DOUBLE AS lam FROM {best}"


_LAMBDA = {
    "v": " UNION ALL ".join(f"SELECT '{c}' AS name, {c}::DOUBLE AS x FROM lineitem" for c in NUM),
    "g0": "SELECT name, unnest(range(-5, 6)) * 0.5::DOUBLE AS lam FROM (SELECT DISTINCT name FROM v)",
}
for _k, (_half, _step) in enumerate([(20, "0.05"), (25, "0.002"), (20, "0.0001")]):
    _LAMBDA[f"s{_k}"] = _likelihood(f"g{_k}")
    _LAMBDA[f"b{_k}"] = f"SELECT name, arg_max(lam, score) AS lam FROM s{_k} GROUP BY 1"
    _LAMBDA[f"g{_k + 1}"] = _finer(f"b{_k}", _half, _step)
_LAMBDA["s3"] = _likelihood("g3")


@query(
    "yeo_johnson_fit",
    with_inputs("", f"SELECT name, {r('arg_max(lam, score)', 2)} AS lam FROM s3 GROUP BY 1", _LAMBDA),
)
def yeo_johnson_fit(spark, d):
    lams = pp.fit_yeo_johnson(fx.numeric(spark, d), NUM)
    return spark.createDataFrame(list(lams.items()), "name string, lam double").withColumn("lam", rounded(F.col("lam"), 2))


@query(
    "variance_filter",
    " UNION ALL ".join(
        f"SELECT '{c}' AS name, {r(f'var_pop({c})', 4)} AS variance, var_pop({c}) > 0.001 AS keep FROM lineitem"
        for c in NUM
    ),
)
def variance_filter(spark, d):
    spread = pp.moments(fx.numeric(spark, d), NUM)
    rows = [(c, s * s, s * s > CFG.variance_threshold) for c, (_, s) in spread.items()]
    return spark.createDataFrame(rows, "name string, variance double, keep boolean").withColumn(
        "variance", rounded(F.col("variance"), 4)
    )


# ---- metrics ---------------------------------------------------------------------------------------------------

_COUNTS = """SELECT model, count_if(y=0 AND yhat=0) AS tn, count_if(y=0 AND yhat=1) AS fp,
  count_if(y=1 AND yhat=0) AS fn, count_if(y=1 AND yhat=1) AS tp FROM predictions GROUP BY 1"""
CTES["counts"] = _COUNTS
NEEDS["counts"] = ["predictions"]
_MISS = "avg((y <> yhat)::INTEGER)"
CTES["wide"] = f"""SELECT model, avg((y = yhat)::INTEGER) AS accuracy,
  coalesce(sum(y*yhat) / nullif(sum(yhat), 0), 0) AS precision, coalesce(sum(y*yhat) / nullif(sum(y), 0), 0) AS recall,
  coalesce(2*sum(y*yhat) / nullif(sum(y) + sum(yhat), 0), 0) AS f1_score,
  coalesce(sum((1-y)*yhat) / nullif(sum(1-y), 0), 0) AS fpr, coalesce(sum(y*(1-yhat)) / nullif(sum(y), 0), 0) AS fnr,
  avg(pow(y-yhat, 2)) AS mse, sqrt(avg(pow(y-yhat, 2))) AS rmse, avg(abs(y-yhat)) AS mae FROM predictions GROUP BY 1"""
NEEDS["wide"] = ["predictions"]
CTES["auc"] = """SELECT model, (sum(CASE WHEN y=1 THEN rk END) - p*(p+1)/2) / (p*q) AS roc_auc FROM (
  SELECT model, y, rank() OVER w + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0::DOUBLE AS rk,
   sum(y) OVER (PARTITION BY model)::DOUBLE AS p, sum(1-y) OVER (PARTITION BY model)::DOUBLE AS q
  FROM predictions WINDOW w AS (PARTITION BY model ORDER BY score)) GROUP BY model, p, q"""
NEEDS["auc"] = ["predictions"]
_FOLDED = f"""SELECT *, (row_number() OVER (PARTITION BY model, y ORDER BY
  ('0x' || substr(md5(doc_id::VARCHAR || '|42-fold'), 1, 8))::BIGINT, doc_id) - 1) % 5 AS fold FROM predictions"""
CTES["folded"] = _FOLDED
NEEDS["folded"] = ["predictions"]
CTES["cv"] = """SELECT model, avg(a) AS cv_mean, stddev_pop(a) AS cv_std FROM (
  SELECT model, fold, avg((y = yhat)::INTEGER) AS a FROM folded GROUP BY 1, 2) GROUP BY 1"""
NEEDS["cv"] = ["folded"]


@query(
    "confusion_matrix",
    with_inputs(
        "counts",
        """SELECT model, 0 AS actual, 0 AS predicted, tn AS n FROM counts UNION ALL SELECT model, 0, 1, fp FROM counts
 UNION ALL SELECT model, 1, 0, fn FROM counts UNION ALL SELECT model, 1, 1, tp FROM counts""",
    ),
)
def confusion_matrix(spark, d):
    return mt.confusion_matrix(fx.scored_labels(spark, d), ["model"])


_WIDE = ["accuracy", "precision", "recall", "f1_score", "fpr", "fnr", "mse", "rmse", "mae"]


@query("binary_metrics", with_inputs("wide", f"SELECT model, {_r(_WIDE)} FROM wide"))
def binary_metrics(spark, d):
    return mt.binary_metrics(fx.scored_labels(spark, d), ["model"]).select("model", *_rounded(_WIDE))


_PRF = ["precision", "recall", "f1", "support"]


def _class_rows() -> str:
    one = """SELECT model, '{name}' AS class, coalesce({h}/nullif({h}+{w}, 0), 0) AS precision,
  coalesce({h}/nullif({h}+{m}, 0), 0) AS recall, coalesce(2*{h}/nullif(2*{h}+{w}+{m}, 0), 0) AS f1,
  ({h}+{m})::DOUBLE AS support FROM counts"""
    classes = [one.format(name=dm.CLASS_NAMES[0], h="tn", w="fn", m="fp"), one.format(name=dm.CLASS_NAMES[1], h="tp", w="fp", m="fn")]
    return " UNION ALL ".join(classes)


@query(
    "class_report",
    with_inputs(
        "counts",
        f"""SELECT model, class, {_r(_PRF)} FROM (SELECT * FROM per_class
  UNION ALL SELECT model, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM per_class GROUP BY 1
  UNION ALL SELECT model, 'weighted avg', sum(precision*support)/sum(support), sum(recall*support)/sum(support),
   sum(f1*support)/sum(support), sum(support) FROM per_class GROUP BY 1
  UNION ALL SELECT model, 'accuracy', (tn+tp)/(tn+fp+fn+tp), (tn+tp)/(tn+fp+fn+tp), (tn+tp)/(tn+fp+fn+tp),
   (tn+fp+fn+tp)::DOUBLE FROM counts)""",
        {"per_class": _class_rows()},
    ),
)
def class_report(spark, d):
    report = mt.class_report(fx.scored_labels(spark, d), ["model"])
    return report.select("model", "class", *_rounded(_PRF))


@query("roc_auc", with_inputs("auc", f"SELECT model, {r('roc_auc')} AS roc_auc FROM auc"))
def roc_auc(spark, d):
    return mt.roc_auc(fx.scored_labels(spark, d), ["model"]).select("model", *_rounded(["roc_auc"]))


@query(
    "roc_curve",
    with_inputs(
        "predictions",
        f"""SELECT model, threshold, {_r(['fpr', 'tpr'])} FROM (
  SELECT model, 'inf'::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr FROM predictions GROUP BY 1
  UNION ALL SELECT DISTINCT model, score, sum(1-y) OVER w / sum(1-y) OVER (PARTITION BY model),
   sum(y) OVER w / sum(y) OVER (PARTITION BY model) FROM predictions
  WINDOW w AS (PARTITION BY model ORDER BY score DESC))""",
    ),
)
def roc_curve(spark, d):
    points = mt.roc_curve(fx.scored_labels(spark, d), ["model"])
    return points.select("model", "threshold", *_rounded(["fpr", "tpr"]))


def folded(spark, d):
    predictions = fx.scored_labels(spark, d)
    folds = mt.stratified_folds(predictions.select("doc_id", "y").distinct(), "doc_id", "y")
    return predictions.join(folds.select("doc_id", "fold"), "doc_id")


@query("fold_assignment", with_inputs("folded", "SELECT DISTINCT doc_id, y, fold FROM folded"))
def fold_assignment(spark, d):
    labels = fx.scored_labels(spark, d).select("doc_id", "y").distinct()
    return mt.stratified_folds(labels, "doc_id", "y").select("doc_id", "y", "fold")


@query("cv_folds", with_inputs("cv", f"SELECT model, {_r(['cv_mean', 'cv_std'])} FROM cv"))
def cv_folds(spark, d):
    return mt.cv_scores(folded(spark, d), ["model"]).select("model", *_rounded(["cv_mean", "cv_std"]))


SPLIT = """SELECT candidate_id, label, row_number() OVER (PARTITION BY label ORDER BY
  ('0x' || substr(md5(candidate_id || '|42-split'), 1, 8))::BIGINT, candidate_id)
  <= floor(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE + 0.5) AS is_test FROM labelled"""


@query(
    "stratified_split",
    with_inputs(
        "labelled",
        "SELECT * FROM split",
        {"split": SPLIT},
    ),
)
def stratified_split(spark, d):
    labels = features(spark, d).select("candidate_id", "label")
    return mt.stratified_split(labels, "candidate_id", "label").select("candidate_id", "label", "is_test")


_SUMMARY = ["test_accuracy", "roc_auc", "precision", "recall", "f1_score", "fnr", "fpr", "rmse", "mse", "mae", "cv_mean", "cv_std"]


def summary_metrics(spark, d):
    predictions = fx.scored_labels(spark, d)
    wide = (
        mt.binary_metrics(predictions, ["model"])
        .join(mt.roc_auc(predictions, ["model"]), "model")
        .join(mt.cv_scores(folded(spark, d), ["model"]), "model")
        .withColumnRenamed("accuracy", "test_accuracy")
    )
    return mt.long_metrics(wide, _SUMMARY)


_JOINED = "SELECT *, accuracy AS test_accuracy FROM wide JOIN auc USING (model) JOIN cv USING (model)"


@query(
    "model_summary",
    with_inputs("wide auc cv", f"SELECT model, {', '.join(f'{r(m, 4)} AS {m}' for m in _SUMMARY)} FROM j", {"j": _JOINED}),
)
def model_summary(spark, d):
    return mt.model_summary(summary_metrics(spark, d), _SUMMARY)


@query(
    "best_model",
    with_inputs(
        "wide",
        f"""SELECT model, {r('accuracy')} AS test_accuracy FROM wide ORDER BY accuracy DESC, model LIMIT 1""",
    ),
)
def best_model(spark, d):
    order = {f"model_{m}": i for i, m in enumerate(fx.MODELS)}
    return mt.best_model(summary_metrics(spark, d), order).select("model", *_rounded(["test_accuracy"]))


_CHART_ROWS = " UNION ALL ".join(
    f"SELECT '{chart}' AS chart, model, '{m}' AS metric, {r(m)} AS value FROM j"
    for chart, ms in mt.CHARTS.items()
    for m in ms
    if m in _SUMMARY
)


@query("chart_metrics", with_inputs("wide auc cv", _CHART_ROWS, {"j": _JOINED}))
def chart_metrics(spark, d):
    return mt.chart_metrics(summary_metrics(spark, d)).withColumn("value", rounded(F.col("value"), 6))


_THREE = "SELECT model, doc_id % 3 AS y, least(floor(score * 3), 2)::BIGINT AS yhat FROM predictions"
_MACRO = {
    "three": _THREE,
    "classes": "SELECT DISTINCT model, unnest([y, yhat]) AS c FROM three",
    "per_class": """SELECT model, c, count_if(y = c AND yhat = c) AS tp, count_if(y <> c AND yhat = c) AS fp,
  count_if(y = c AND yhat <> c) AS fn FROM three JOIN classes USING (model) GROUP BY 1, 2""",
    "means": """SELECT model, avg(coalesce(tp / nullif(tp + fp, 0), 0)) AS precision,
  avg(coalesce(tp / nullif(tp + fn, 0), 0)) AS recall, avg(coalesce(2*tp / nullif(2*tp + fp + fn, 0), 0)) AS f1_score
  FROM per_class GROUP BY 1""",
    "all_metrics": """SELECT model, avg((y = yhat)::INTEGER) AS accuracy, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS fnr,
  avg((y - yhat) * (y - yhat)) AS mse, sqrt(avg((y - yhat) * (y - yhat))) AS rmse, avg(abs(y - yhat)) AS mae
  FROM three GROUP BY 1""",
}


@query(
    "macro_metrics",
    with_inputs("predictions", f"SELECT model, {_r(_WIDE)} FROM all_metrics JOIN means USING (model)", _MACRO),
)
def macro_metrics(spark, d):
    """Three classes instead of two."""
    three = fx.scored_labels(spark, d).select(
        "model", (F.col("doc_id") % 3).alias("y"), F.least(F.floor(F.col("score") * 3), F.lit(2)).alias("yhat")
    )
    return mt.macro_metrics(three, ["model"]).select("model", *_rounded(_WIDE))
