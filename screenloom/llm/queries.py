"""Registered queries of the training-data operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenloom.llm import chat, decontam, embed_dedup, hard_negatives, lm_score, mixing, quality_gam, secret_scan, simhash, substring
from screenloom.llm import periodic, token_files, toxicity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register
def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    used = mixing.realise(docs.select("doc_id", "source"), mixing.plan(docs))
    added = {"_mix_epoch": "epoch", "_mix_block": "block", "_mix_key": "mix_key", "_mix_weight": "weight"}
    return used.withColumnsRenamed(added)


@register
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


CHECKS["op2_substring_dedup"] = r"""
WITH texts AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), places AS (
    SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS pos FROM texts WHERE len(words) >= 13
), runs AS (
    SELECT doc_id, pos, md5(array_to_string(words[pos : pos + 12], ' ')) AS run FROM places
), repeated AS (
    SELECT doc_id, pos FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY run) AS least FROM runs) WHERE least < doc_id
), gone AS (
    SELECT DISTINCT doc_id, pos + step AS pos FROM repeated, (SELECT unnest(range(0, 13)) AS step)
), lists AS (
    SELECT doc_id, list(pos) AS gone FROM gone GROUP BY doc_id
), kept AS (
    SELECT t.doc_id, words, coalesce(len(gone), 0) AS n_removed,
        CASE WHEN gone IS NULL THEN words
             ELSE list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END AS kept
    FROM texts t LEFT JOIN lists l ON t.doc_id = l.doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, n_removed::BIGINT AS n_removed,
    sha256(array_to_string(kept, ' ')) AS kept_sha256
FROM kept
"""


@register
def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"), shingle=3, distance=3)


@register
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_read(spark, sf_dir, "documents"))


@register
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_read(spark, sf_dir, "documents"), tokenizer_file(), end_id=2)


@register
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))


@register
def op8_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality_gam.score(docs, quality_gam.train(docs, _read(spark, sf_dir, "labels")))


@register
def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"), threshold=0.9, slack=None)


@register
def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.cross_entropy_difference(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


@register
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


@register
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", turned), anchor=F.col("vec_id") % 100 == 0)


CHECKS["op13_hard_negatives"] = """
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
    SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
    FROM rows a, rows r WHERE a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
    SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
    FROM positives p JOIN scores s ON p.anchor_id = s.anchor_id AND NOT s.same
        AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""


@register
def op11_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    said = "\\### Assistant: </turn> ok"
    extra = [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.union(spark.createDataFrame(extra, "conv_id long, turn long, role string, text string"))
    count = chat.RankedTokens(tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return chat.digests(chat.read_back(chat.format_windows(turns, count)))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The texts of one document in ten with periodic words from some place on, by the crc32 of their doc_id."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    texts = docs.select("doc_id", "text", h.alias("h"), g.alias("g"), F.when(h % 10 == 0, words).alias("words"))
    some = texts.withColumn("n", F.size("words").cast("long"))
    placed = some.withColumn("a", F.col("g") % F.nullif(F.greatest("n", F.lit(0)), F.lit(0)))
    rest = F.col("n") - F.col("a")
    periodic_words = placed.withColumn("p", (1 + F.floor(rest / (3 + F.col("g") % 8))).cast("int")).withColumn("a", F.col("a").cast("int"))
    copies = F.ceil(rest / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), copies)), F.lit(1), rest.cast("int"))
    text = F.when(F.col("a").isNull(), F.col("text")).otherwise(F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " "))
    return periodic_words.select("doc_id", text.alias("text"))


@register
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(with_planted_runs(_read(spark, sf_dir, "documents")))
    # the least start and period come first, so only a greater exponent replaces what was best before
    greater = "CASE WHEN best IS NULL OR r.length * best.period > best.length * r.period THEN r ELSE best END"
    best = F.expr(f"aggregate(runs, CAST(NULL AS struct<start: bigint, length: bigint, period: bigint>), (best, r) -> {greater})")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    chosen = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed")
    return chosen.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


CHECKS["op12_periodic_runs"] = r"""
WITH hashed AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
        xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
            lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)),
                lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) AS h
    FROM documents
), sized AS (
    SELECT doc_id, words, len(words) AS n, h, h // 10 AS g FROM hashed
), placed AS (
    SELECT doc_id, words, n, h % 10 = 0 AND n > 0 AS planted, CASE WHEN n > 0 THEN g % n END AS a, g FROM sized
), texts AS (
    SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(n),
        lambda i: words[1 + CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END]) ELSE words END AS words
    FROM placed
), places AS (
    SELECT doc_id, n, words, unnest(range(0, n - 2)) AS i FROM texts WHERE n >= 6
), grams AS (
    SELECT doc_id, n, i, words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3] AS gram FROM places
), often AS (
    SELECT doc_id, n, i, gram FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, gram) >= 3
), pairs AS (  -- words i to i + 2 stand again q later
    SELECT x.doc_id, x.i, y.i - x.i AS q FROM often x JOIN often y ON x.doc_id = y.doc_id AND x.gram = y.gram
    WHERE y.i > x.i AND 4 * (y.i - x.i) <= x.n
), islands AS (
    SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs
), stretches AS (
    SELECT doc_id, q, min(i) AS start, count(*) + 2 + q AS length FROM islands GROUP BY doc_id, q, island
), runs AS (
    SELECT doc_id, start, length, min(q) AS period FROM stretches
    WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length
), listed AS (
    SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
        arg_min({'start': start, 'length': length, 'period': period}, (-length / period, start, period)) AS best
    FROM runs GROUP BY doc_id
), gone AS (
    SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(start + period, start + length)) AS i FROM runs) GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period,
    1000 * best.length // best.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
    sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE
        list_transform(list_filter(list_zip(words, range(n)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END, ' ')) AS collapsed_sha256
FROM texts t LEFT JOIN listed l ON t.doc_id = l.doc_id LEFT JOIN gone g ON t.doc_id = g.doc_id
"""
