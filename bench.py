"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from screenloom.plans import all_queries  # noqa: E402
from screenloom.session import build_session, release, ship_package  # noqa: E402

HEADLINE = [
    "normalize_text",
    "extract_skills",
    "extract_skills_joined",
    "match_scores",
    "rank_candidates",
    "schedule_interviews",
    "export_candidates",
    "full_screening",
    "full_screening_questions",
    "stage_fold",
    "transition_log",
    "status_board",
    "questions",
    "features_core",
    "winsorize",
    "robust_scale",
    "yeo_johnson_fit",
    "roc_curve",
    "cv_folds",
    "semantic_join",
    "knn_topk",
    "smote",
    "stream_transition_log",
    "preprocess_fit_transform",
    "train_eval_logisticregression",
    "train_eval_knn",
    "train_eval_randomforest",
    "train_eval_linearsvc",
    "train_eval_mlp",
    "train_eval_gradientboosting",
]
ONCE = 5.0  # a run beyond so many seconds, warm-up included, is not repeated
BUDGET = float(os.environ.get("BENCH_SECONDS", "900"))  # no query starts after so many seconds, so that the line is printed


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="bench-")  # the session is local
    spark = build_session("bench", cpus=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, shared=shared)
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    names = sys.argv[1:] or HEADLINE
    registered = all_queries()

    def timed(name: str) -> float:
        started = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    timed("candidate_preview")  # warm up
    seconds, began = {}, time.perf_counter()
    for name in names:
        if time.perf_counter() - began > BUDGET:
            print(name, "left out: the time is up", file=sys.stderr, flush=True)
            continue
        first = timed(name)
        seconds[name] = round(first if first > ONCE else statistics.median(timed(name) for _ in range(3)), 3)
        release(spark)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    scale = Path(sf_dir).name.removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
