"""Queries of the numbered problems and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.llm import leaks, mixing, overlap, pairs, pieces, quantiles, splits, subjects, vectors
from mnemoframe.tables import load

#: Vocabulary file of a public tokenizer.
TOKENIZER = os.environ.get("MNEMOFRAME_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.related_groups(load(spark, d, "samples"))


@query
def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(load(spark, d, "samples"))


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.oversized_turns(load(spark, d, "turns"))


ORACLES["p2_found"] = """
SELECT DISTINCT turn_id, CAST(list_max(list_transform(string_split_regex(content, '[\\s\\p{Z}\\x{85}\\x{1c}-\\x{1f}。！？]'), lambda x: length(x))) > 1603 AS INT) AS forced
FROM turns WHERE floor(length(content) / 4) > 400
"""


@query
def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.piece_rows(load(spark, d, "turns"))


@query
def p2_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Each oversized content put together from what is new in its pieces, as a hash."""
    cut = pieces.split_oversized(load(spark, d, "turns"))
    fresh = F.transform("pieces", lambda p: F.substring(p["text"], p["new_from"] - p["start"] + 1, F.length(p["text"])))
    return cut.select("turn_id", F.sha2(F.array_join(fresh, ""), 256).alias("content_hash"), F.size("pieces").alias("n_pieces")).distinct().select("turn_id", "content_hash", (F.col("n_pieces") > 1).alias("cut"))


ORACLES["p2_rebuilt"] = "SELECT DISTINCT turn_id, sha256(content) AS content_hash, true AS cut FROM turns WHERE floor(length(content) / 4) > 400"


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.outlying_days(load(spark, d, "answers"))


ORACLES["p7_found"] = """
WITH a AS (SELECT DISTINCT answer_id, system, run_day, search_ms, e2e_ms, CAST(context_tokens AS DOUBLE) AS context_tokens FROM answers WHERE error IS NULL),
v AS (
  SELECT system, run_day, 'search_ms' AS metric, search_ms AS value FROM a
  UNION ALL SELECT system, run_day, 'e2e_ms', e2e_ms FROM a
  UNION ALL SELECT system, run_day, 'context_tokens', context_tokens FROM a),
ok AS (SELECT * FROM v WHERE value >= 0 AND NOT isnan(value)),
days AS (SELECT system, run_day, metric, count(*) AS n, quantile_cont(value, [0.5, 0.95]) AS q FROM ok GROUP BY ALL),
rest AS (
  SELECT d.system, d.run_day, d.metric, count(*) AS n, quantile_cont(o.value, [0.5, 0.95]) AS q
  FROM days d JOIN ok o ON o.system = d.system AND o.metric = d.metric AND o.run_day <> d.run_day WHERE d.n >= 30 GROUP BY ALL),
both_ AS (SELECT d.system, d.run_day, d.metric, unnest([1, 2]) AS i, d.q AS dq, r.q AS rq FROM days d JOIN rest r USING (system, run_day, metric) WHERE d.n >= 30 AND r.n >= 30)
SELECT system, run_day, metric, CAST(CASE i WHEN 1 THEN 50 ELSE 95 END AS INT) AS pct FROM both_ WHERE dq[i] >= 2 * rq[i]
"""


@query
def p7_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Medians and 95th percentiles per system and run day."""
    return quantiles.quantiles(quantiles.sketch(quantiles.measures(load(spark, d, "answers"))), quantiles.KEYS)


@query
def p7_months(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per system and month from the day sketches alone."""
    days = quantiles.sketch(quantiles.measures(load(spark, d, "answers"))).withColumn("month", F.substring("run_day", 1, 7))
    keys = ["system", "month", "metric"]
    return quantiles.quantiles(quantiles.merge(days, keys), keys)


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(load(spark, d, "documents"), load(spark, d, "eval_items")).where("kind = 'verbatim'").select("doc_id", "item_id")


@query
def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(load(spark, d, "documents"), load(spark, d, "eval_items"))


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(load(spark, d, "documents"), load(spark, d, "mix_targets"), TOKENIZER).where("short").select("source")


# Any tokenizer gives the same cases, so the SQL counts characters.
ORACLES["p9_found"] = """
WITH s AS (SELECT replace(lower(trim(source)), '-', '_') AS name, sum(length(text)) AS n FROM documents GROUP BY 1)
SELECT t.source FROM mix_targets t LEFT JOIN s ON s.name = replace(lower(trim(t.source)), '-', '_')
WHERE coalesce(s.n, 0) * t.max_repeats < t.target_share * (SELECT sum(n) FROM s)
"""


@query
def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(load(spark, d, "documents"), load(spark, d, "mix_targets"), TOKENIZER)


@query
def p9_copies(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_copies(load(spark, d, "documents"), load(spark, d, "mix_targets"), TOKENIZER)


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return vectors.similar_pairs(load(spark, d, "embed_cache"))


@query
def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return vectors.most_similar(load(spark, d, "embed_cache"))


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(pairs.benchmark_pairs(load(spark, d, "samples"), load(spark, d, "answers")))


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlapping_pairs(load(spark, d, "samples")).select("sample_id_a", "sample_id_b").distinct()


@query
def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_counts(load(spark, d, "samples"))


@query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.document_subjects(load(spark, d, "documents"), load(spark, d, "doc_labels")).select("doc_id", "subject")
