"""Embeddings against brute force; the queries and the pipeline on the given tables."""

import math
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from screenloom.llm import decontam, embed_dedup, mixing, quality_gam, queries, simhash
from screenloom.session import stage

SMALL = "/root/testdata/sf0.001"


def roots(ids, pairs):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in parent}


def vectors(seed=1, width=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(250, width))
    rows = [base, base[:50] + rng.normal(size=(50, width)) * 0.3, base[0] + rng.normal(size=(150, width)) * 0.25]
    rows += [base[1] + rng.normal(size=(300, width)) * 0.02, np.repeat(base[2:3], 40, axis=0), base[3:8] * 1e-200, base[3:8] * 1e150]
    return np.vstack(rows)


def brute(ids, rows, threshold):
    unit = rows / np.abs(rows).max(axis=1, keepdims=True)
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    like = unit @ unit.T >= threshold
    np.fill_diagonal(like, False)
    parts = roots(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(like), strict=True)])
    return {i: (int(n), parts[i], parts[i] == i) for i, n in zip(ids, like.sum(axis=1), strict=True)}


@pytest.mark.parametrize(("cell_rows", "block_rows"), [(512, 4096), (40, 16)])
def test_embeddings_exact(spark, cell_rows, block_rows):
    """With the full slack no link is lost, in cut cells too; bad vectors link with nothing."""
    rows = vectors()
    ids = [(i * 31) % 100_003 for i in range(len(rows))]
    bad = [None, [0.0] * 16, [math.nan] * 16, [math.inf] + [1.0] * 15, [1.0] * 15 + [None], [], [1.0] * 3]
    data = [(i, r.tolist(), 0, "x") for i, r in zip(ids, rows, strict=True)]
    data += [(200_000 + k, v, 0, "x") for k, v in enumerate(bad)] + [data[5], (None, data[5][1], 0, "x"), (None, None, 0, "x")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, n_links int, unit string").repartition(3)
    found = embed_dedup.near_duplicates(df, 0.9, None, cell_rows, block_rows).collect()
    expected = brute(ids, rows, 0.9)
    expected |= {200_000 + k: (0, 200_000 + k, True) for k in range(len(bad))}
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found if r["vec_id"] is not None} == expected
    assert len(found) == len(expected) + 2
    assert [tuple(r)[1:] for r in found if r["vec_id"] is None] == [(0, None, True)] * 2


def test_embeddings_without_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert embed_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    found = embed_dedup.near_duplicates(spark.createDataFrame([(1, None), (2, [0.0]), (None, None)], schema)).collect()
    assert sorted((tuple(r) for r in found), key=repr) == [(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)]


def test_embeddings_recall(spark):
    """A small slack against brute force, on pairs close to the threshold that the centres cut apart."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=(1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    off = rng.normal(size=(1500, 64))
    off -= (off * base).sum(axis=1, keepdims=True) * base
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    cosine = rng.uniform(0.9, 0.99, size=(1500, 1))
    rows = np.vstack([base, cosine * base + np.sqrt(1 - cosine**2) * off])
    ids = list(range(len(rows)))
    expected = brute(ids, rows, 0.9)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in zip(ids, rows, strict=True)], "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r["n_links"] for r in embed_dedup.near_duplicates(df, slack=embed_dedup.SLACK, cell_rows=64).collect()}
    links = sum(n for n, _, _ in expected.values())
    assert links > 2500
    assert all(found[i] <= expected[i][0] for i in ids)
    assert sum(found.values()) / links > 0.99


@pytest.mark.parametrize("rank", [4, 8])
def test_embedding_query_loses_no_link(spark, tmp_path, rank):
    """The query on vectors of low intrinsic dimension, where links cross borders at a distance."""
    rng = np.random.default_rng(rank)
    rows = rng.normal(size=(1600, rank)) @ np.linalg.qr(rng.normal(size=(64, rank)))[0].T
    rows = np.vstack([rows, rows + rng.normal(size=(1600, rank)) @ np.linalg.qr(rng.normal(size=(64, rank)))[0].T * 0.4])
    ids = list(range(len(rows)))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in zip(ids, rows, strict=True)], "vec_id long, embedding array<double>")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    found = queries.QUERIES["op5_embedding_dedup"](spark, str(tmp_path)).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found} == brute(ids, rows, 0.9)


# ---- queries and pipeline ---------------------------------------------------------------------------------------


def test_registered():
    names = contract.queries()
    assert [n for n in names if re.match(r"op\d+_", n)] == list(queries.QUERIES)[: len(queries.QUERIES) - 1]
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 14))
    assert names["pipeline"].__wrapped__ is corpus_pipeline.run
    assert set(contract.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = queries.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    result = con.execute(queries.CHECKS[name])
    order = sorted(range(len(columns)), key=[c[0] for c in result.description].__getitem__)
    expected = sorted(repr(tuple(r[i] for i in order)) for r in result.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == expected


def test_queries_run_over_whole_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for name in ("op3_toxicity", "op4_secret_scan", "op6_token_files", "op7_lm_score", "op8_quality_gam", "op9_simhash_dedup"):
        assert queries.QUERIES[name](spark, SMALL).count() == docs, name
    assert queries.QUERIES["op5_embedding_dedup"](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/embeddings.parquet").count()
    leaks = queries.QUERIES["op10_decontamination"](spark, SMALL).collect()
    assert {r["doc_id"] for r in leaks} >= exact_copies(spark)
    assert queries.QUERIES["op1_source_mixing"](spark, SMALL).select("source").distinct().count() > 1


def exact_copies(spark):
    """Documents that hold a whole benchmark item."""
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "
    items = [plain(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"] for r in rows if any(i in plain(r["text"]) for i in items)}


def test_pipeline(spark):
    """Every stage against what its operator says of each row, and the last one against the tokenizer."""
    from tokenizers import Tokenizer

    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "SimHash near-dedup", "benchmark decontamination", "source mixing", "token files",
    ]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    read = lambda t: spark.read.parquet(f"{SMALL}/{t}.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    kept = [docs]
    for name, step in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(step(spark, kept[-1], SMALL), name.replace(" ", "-")))
        assert kept[-1].columns == docs.columns
        assert 0 < kept[-1].count()
    model = quality_gam.train(docs, read("labels"))
    assert ids(kept[1]) == ids(quality_gam.score(docs, model).where("predicted = 1"))
    assert ids(kept[2]) == ids(simhash.near_duplicates(kept[1]).where("doc_id = component_id"))
    leaked = set(ids(decontam.find_leaks(kept[2], read("benchmark"))))
    assert leaked >= exact_copies(spark) & set(ids(kept[2]))
    assert ids(kept[3]) == [i for i in ids(kept[2]) if i not in leaked]
    assert ids(kept[4]) == ids(mixing.realise(kept[3].select("doc_id", "source"), mixing.plan(kept[3])))
    tokenizer = Tokenizer.from_file(queries.tokenizer_file())
    rows = sorted((r["doc_id"], tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2]) for r in kept[4].collect())
    expected, start = [], 0
    for i, found in rows:
        expected.append((i, start, len(found), zlib.crc32(np.array(found, "<u4").tobytes())))
        start += len(found)
    final = corpus_pipeline.run(spark, SMALL)
    assert sorted(tuple(r) for r in final.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == expected


def test_stages_on_odd_documents(spark):
    """Nulls, repeated rows, blank texts and extra columns pass through all stages; so does an empty table."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    odd = docs.union(docs.limit(5)).union(docs.limit(3).selectExpr("cast(null as long)", "text", "lang", "null", "n_chars"))
    odd = odd.union(docs.limit(1).selectExpr("9999", "null", "null", "'src0'", "0")).selectExpr("*", "1 as _copy", "2 as key", "'z' as _mix_key")
    for start in (odd, odd.limit(0)):
        now = start
        for name, step in corpus_pipeline.STAGES[:-1]:
            now = stage(step(spark, now, SMALL), "odd")
            assert now.columns == odd.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, now, SMALL).count() == now.count()


def test_cells_alike_are_visited_together():
    """Spread-out vectors see many cells, but few groups of them: a row a group, not a row a cell."""
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(600, 16))
    rows /= np.sqrt((rows**2).sum(axis=1, keepdims=True))
    centres = embed_dedup.spherical_kmeans(rows, 30)
    sizes = np.bincount((rows @ centres.T).argmax(axis=1), minlength=30)
    group = embed_dedup.grouped(centres, sizes, 200)
    assert (group >= 0).all() and np.bincount(group, sizes).max() <= 200 and group.max() + 1 <= 6
    assert (embed_dedup.grouped(centres, sizes, 1) == np.arange(30)).all()
    home, cells = embed_dedup.visits(rows, centres, 0.2236, np.arange(30))
    lives, groups = embed_dedup.visits(rows, centres, 0.2236, group)
    assert (lives == group[home]).all() and groups.sum() < cells.sum() / 2
    for v in range(600):
        assert set(np.flatnonzero(groups[v])) == set(group[cells[v]]) - {lives[v]}


@pytest.mark.parametrize("near", [0.001, 0.3])
def test_single_precision_decides_nothing(near):
    """Products at the threshold are taken in double, a few by themselves, many together."""
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(300, 8)) * near + np.ones(8)
    rows /= np.sqrt((rows**2).sum(axis=1, keepdims=True))
    none = np.zeros(300, np.int64)
    block = embed_dedup._Block(rows, rows.astype("f4"), none, none, none, none, none)
    double = rows @ rows.T
    for threshold in np.sort(double.ravel())[[9, 50_000, 89_000]]:
        got = embed_dedup.linked(block, block, 0, 0, float(threshold))
        assert (got == (double >= threshold))[np.abs(double - threshold) > 1e-14].all()
