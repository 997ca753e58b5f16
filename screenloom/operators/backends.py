"""Answers from exchangeable back-ends, asked in Arrow batches, each request once.

A back-end is a name and a function from an Arrow array of requests to an array of answers, null where it has none. A chain of
them is asked in turn: what one leaves open, by a null or by an error, goes to the next. Equal requests are one request, known
by a hash of its text and of the kind of chain that answers it.

Finished answers are a table. Before anything is asked, requests that stand in it are taken out; what is asked is appended to
it, in small parts that Spark commits one by one. So a second run asks only what is missing, and a lost task repeats no more
than its own part. Requests that no back-end answered are not stored and are asked again next time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenloom.session import new_path, stage

PART = 256  # requests of a task, so of a commit
BATCH = 32  # requests handed to a back-end at once
ANSWERS = "key string, answer string, backend string"


@dataclass(frozen=True)
class Backend:
    name: str
    ask: Callable[[pa.Array], pa.Array]


def ask_chain(chain: Sequence[Backend], requests: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(answers, names of the back-ends that gave them); null where none did. An error of a back-end, or an answer of another
    length, leaves its whole batch to the next one."""
    answers: list[str | None] = [None] * len(requests)
    names: list[str | None] = [None] * len(requests)
    for backend in chain:
        open_ = [k for k, a in enumerate(answers) if a is None and requests[k].is_valid]
        for at in range(0, len(open_), BATCH):
            some = open_[at : at + BATCH]
            try:
                given = backend.ask(requests.take(pa.array(some))).to_pylist()
            except Exception:  # noqa: BLE001 - whatever a back-end raises, the next one is asked
                continue
            for k, answer in zip(some, given, strict=False) if len(given) == len(some) else ():
                if answer is not None:
                    answers[k], names[k] = str(answer), backend.name
    return pa.array(answers, pa.string()), pa.array(names, pa.string())


def _key(request, kind: str):
    return F.sha2(F.concat(F.lit(f"{kind}\n"), request), 256)


def finished(spark, store: str) -> DataFrame:
    """The answers known so far, one for each key; none where nothing is stored yet."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], ANSWERS)
    return spark.read.schema(ANSWERS).parquet(store).groupBy("key").agg(F.min(F.struct("answer", "backend")).alias("a")).select("key", "a.*")


def answered(
    requests: DataFrame, chain: Sequence[Backend], request: str = "request", store: str | None = None, kind: str = "", part: int = PART
) -> DataFrame:
    """``requests`` with the columns answer and backend, both null where no back-end answered.

    ``store`` is the table of finished answers, kept from run to run; without it answers last as long as the application.
    ``kind`` names what the answers depend on besides the request (a model, a prompt): other kinds do not share answers. A null
    request gets no answer; repeated rows share one. An empty table asks nothing. ``requests`` are computed once and written.
    """
    spark = requests.sparkSession
    store = store or new_path(spark, "answers")
    requests = stage(requests, "requests")
    texts = requests.select(F.col(request).cast("string").alias("request")).where("request is not null").distinct()
    asked = texts.select(_key(F.col("request"), kind).alias("key"), "request")
    missing = stage(asked.join(finished(spark, store), "key", "left_anti"), "missing")
    parts = math.ceil(missing.count() / part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers, names = ask_chain(chain, batch.column("request"))
            found = pc.is_valid(answers)
            columns = [c.filter(found) for c in (batch.column("key"), answers, names)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "answer", "backend"])

    # The keys are hashes, so parts of them are even; a part is written and committed by a task of its own.
    if parts:
        missing.repartition(parts, "key").mapInArrow(run, ANSWERS).write.mode("append").parquet(store)
    known = finished(spark, store).select(F.col("key").alias("_key"), "answer", "backend")
    keyed = requests.withColumn("_key", _key(F.col(request).cast("string"), kind))
    return keyed.join(known, "_key", "left").drop("_key")
