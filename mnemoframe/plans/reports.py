"""Registered queries of verification, splits, calibration, health and paths, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemoframe.operators import content, ranking, reports as rp
from mnemoframe.plans.core import _CHANNELS, _FRONT, _LOG, _MOD, channels, history, query, run_log
from mnemoframe.tables import load


@query("SELECT sha256(text) AS content_hash, count(*) AS n_refs, count(DISTINCT text) = 1 AS verified FROM documents WHERE text IS NOT NULL GROUP BY 1")
def cas_verify(spark, d):
    return rp.cas_verify(load(spark, d, "documents"), "text")


@query(f"SELECT category, count(DISTINCT sample_id) AS n FROM samples WHERE {_MOD} < 20 GROUP BY 1")
def split_filter(spark, d):
    return rp.split_filter(load(spark, d, "samples"), "sample_id", "dev").groupBy("category").agg(F.countDistinct("sample_id").alias("n"))


@query(f"SELECT count(DISTINCT sample_id) AS n, count(DISTINCT sample_id) FILTER ({_MOD} < 20) AS n_dev, count(DISTINCT sample_id) FILTER ({_MOD} >= 20) AS n_test, CAST(0 AS BIGINT) AS n_both FROM samples")
def split_disjoint(spark, d):
    """Sizes of the splits, and of what is in both of them."""
    s = load(spark, d, "samples").where("sample_id IS NOT NULL").select("sample_id").distinct()
    marks = rp.split_filter(s, "sample_id", "dev").withColumn("m", F.lit(1)).unionByName(rp.split_filter(s, "sample_id", "test").withColumn("m", F.lit(2)))
    g = marks.groupBy("sample_id").agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    return g.agg(F.count("*").alias("n"), F.count_if(F.expr("lo = 1")).alias("n_dev"), F.count_if(F.expr("hi = 2")).alias("n_test"), F.count_if(F.expr("lo <> hi")).alias("n_both"))


_TYPE = "CASE WHEN lower(modality) IN ('pdf', 'image', 'audio', 'video', 'binary') THEN 'resource' WHEN regexp_matches(text, '{v}') THEN 'knowledge_vault' WHEN regexp_matches(text, '{c}') THEN 'core' WHEN regexp_matches(text, '{p}') THEN 'procedural' WHEN valid_at IS NOT NULL THEN 'semantic' ELSE 'episodic' END".format(v=content.VAULT, c=content.CORE.replace("'", "''"), p=content.PROCEDURAL)


@query(f"SELECT doc_id, nullif(coalesce(list_position(['procedural', 'semantic', 'episodic'], {_TYPE}), 0), 0)::BIGINT AS place FROM documents")
def type_priority(spark, d):
    """Place of each document for a procedural question."""
    kind = content.memory_type(F.col("text"), F.col("modality"), F.col("valid_at").isNotNull())
    return load(spark, d, "documents").select("doc_id", rp.type_rank(kind, "procedural").alias("place"))


@query(_LOG + f""", dev AS (SELECT system, extra.confidence AS c, coalesce(correct, false)::INT AS k FROM log WHERE error IS NULL AND NOT coalesce(abstained, false) AND extra.confidence IS NOT NULL AND coalesce(category, '') <> 'unanswerable' AND {_MOD} < 20),
g AS (SELECT system, c, count(*) AS n, sum(k) AS k FROM dev GROUP BY ALL), r AS (SELECT *, sum(n) OVER w AS cn, sum(k) OVER w AS ck FROM g WINDOW w AS (PARTITION BY system ORDER BY c DESC RANGE UNBOUNDED PRECEDING)),
t AS (SELECT system, coalesce(min(c) FILTER (ck::DOUBLE / cn >= 0.8), max(c) + 1e-9::DOUBLE) AS tau, CAST(sum(n) AS BIGINT) AS n, CAST(coalesce(max(cn) FILTER (ck::DOUBLE / cn >= 0.8), 0) AS BIGINT) AS covered FROM r GROUP BY 1)
SELECT t.*, round((SELECT avg(k) FROM dev WHERE dev.system = t.system AND c >= tau), 6) AS precision_at_tau, round(covered / n, 6) AS coverage_at_tau FROM t""")
def calibrate_tau(spark, d):
    log = run_log(spark, d).withColumn("confidence", F.col("extra.confidence"))
    return rp.calibrate_tau(log, "sample_id", "system", "confidence", "correct", 0.8)


@query(_LOG + """, u AS (SELECT category, sample_id, run_idx, max(coalesce(correct, false)::INT) FILTER (system = 'vec-rag') AS x, max(coalesce(correct, false)::INT) FILTER (system = 'eidos-full') AS y FROM log WHERE error IS NULL AND system IN ('vec-rag', 'eidos-full') GROUP BY ALL)
SELECT category, count(*) FILTER (x = 0 AND y = 1) AS gained, count(*) FILTER (x = 1 AND y = 0) AS regressed, count(*) FILTER (x IS NULL OR y IS NULL) AS unpaired FROM u GROUP BY 1""")
def flip_table(spark, d):
    return rp.flips(run_log(spark, d), ["sample_id", "run_idx"], "system", "vec-rag", "eidos-full", "category")


@query(_CHANNELS + """, r AS (SELECT l_partkey, c, row_number() OVER (PARTITION BY q, c ORDER BY s DESC, l_partkey) AS r FROM ch)
SELECT l_partkey, string_agg(c, '+' ORDER BY c) AS paths, CAST(count(*) AS INT) AS n_paths FROM r WHERE r <= 20 GROUP BY 1""")
def recall_paths(spark, d):
    top = ranking.top_per_group(channels(spark, d), ["q", "c"], [F.col("s").desc(), F.col("l_partkey")], 20)
    return rp.recall_paths(top, "l_partkey", "c")


@query(_LOG + """, a AS (SELECT count(*) AS n, count(*) FILTER (error IS NULL AND NOT coalesce(abstained, false)) AS w, count(*) FILTER (error IS NULL AND NOT coalesce(abstained, false) AND coalesce(extra.verified, false)) AS v,
count(*) FILTER (error IS NULL AND NOT coalesce(abstained, false) AND coalesce(correct, false)) AS k, count(*) FILTER (error IS NOT NULL) AS bad FROM log),
f AS (SELECT count(DISTINCT (user_id, event_type)) / count(*) AS cur FROM events), r AS (SELECT count(namespace) / count(*) AS s, count(valid_at) / count(*) AS t FROM documents),
c AS (SELECT round(v / w, 6) AS proof_coverage, round(k / w, 6) AS accuracy, round(bad / n, 6) AS error_rate, round(cur, 6) AS currency, round(s, 6) AS scoped_rate, round(t, 6) AS dated_rate FROM a, f, r)
SELECT *, round((proof_coverage + accuracy + 1 - error_rate + currency + scoped_rate + dated_rate) / 6, 5) AS composite FROM c""")
def brain_health(spark, d):
    return rp.brain_health(run_log(spark, d), history(spark, d), load(spark, d, "documents"))


@query(f"""WITH f1 AS ({_FRONT}), l1 AS (SELECT * FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM f1)), f2 AS ({_FRONT.replace("part p", "l1 p").replace("part o", "l1 o")}),
l2 AS (SELECT * FROM l1 WHERE p_partkey NOT IN (SELECT p_partkey FROM f2)), f3 AS ({_FRONT.replace("part p", "l2 p").replace("part o", "l2 o")})
SELECT p_partkey, 1 AS front FROM f1 UNION ALL SELECT p_partkey, 2 FROM f2 UNION ALL SELECT p_partkey, 3 FROM f3""")
def pareto_fronts(spark, d):
    p = load(spark, d, "part").select("p_partkey", "p_retailprice", "p_size").withColumn("neg", -F.col("p_size"))
    return rp.pareto_fronts(p, "p_retailprice", "neg", 3).select("p_partkey", "front")


@query(_LOG + """, r AS (SELECT system, e2e_ms AS v, row_number() OVER (PARTITION BY system ORDER BY e2e_ms) AS r, count(*) OVER (PARTITION BY system) AS n FROM log WHERE e2e_ms IS NOT NULL AND NOT isnan(e2e_ms)),
k AS (SELECT *, CASE WHEN n < 20 THEN n ELSE (n + 1)::DOUBLE * 0.95::DOUBLE END AS k FROM r), e AS (SELECT system, n, max(k) AS k, max(v) FILTER (r = floor(k)) AS lo, max(v) FILTER (r = ceil(k)) AS hi FROM k GROUP BY ALL)
SELECT system, n, round(lo + (k - floor(k)) * (hi - lo), 4) AS p95 FROM e""")
def latency_p95_exclusive(spark, d):
    return rp.exclusive_percentile(run_log(spark, d), "system", "e2e_ms", 0.95).select("system", "n", F.round("value", 4).alias("p95"))


@query(r"""WITH m AS (SELECT namespace, doc_id, valid_at, unnest(regexp_extract_all(text, '\b[A-Z][a-z]+ prefers [a-z ]+')) AS m FROM documents WHERE valid_at IS NOT NULL),
p AS (SELECT namespace, doc_id, valid_at, split_part(m, ' prefers ', 1) AS who, trim(split_part(m, ' prefers ', 2)) AS what FROM m WHERE split_part(m, ' prefers ', 2) NOT LIKE 'not %')
SELECT namespace, who, arg_max(what, (valid_at, doc_id, what)) AS preference, max(valid_at) AS valid_at, count(DISTINCT what) - 1 AS n_superseded FROM p GROUP BY ALL""")
def preference_latest(spark, d):
    return rp.preference_latest(load(spark, d, "documents"), "text", ["namespace"], "valid_at", "doc_id")
