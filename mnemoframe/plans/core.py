"""Registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.functions.text import norm_words
from mnemoframe.operators import content, evaluation as ev, graph, ranking, temporal as tp
from mnemoframe.operators.timestamps import normalise_times
from mnemoframe.streaming.activation import activation_fold, activation_spread
from mnemoframe.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AS_OF = "TIMESTAMP_NTZ '2024-01-20 00:00:00'"
_FACT = ["user_id", "event_type"]
# The history of the events in DuckDB's SQL, which many queries start from.
_HIST = "WITH h AS (SELECT *, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS invalid_at FROM events)"
# Distinct deliveries of the run log.
_LOG = "WITH log AS (SELECT DISTINCT answer_id, sample_id, system, dataset, category, run_idx, run_day, abstained, correct, error, query_tokens, e2e_ms, age_days, extra FROM answers)"
_CHANNELS = """WITH agg AS (SELECT l_partkey, round(sum(l_quantity), 4) AS qty, round(avg(l_discount), 9) AS disc, count(*) AS n FROM lineitem GROUP BY ALL),
base AS (SELECT p.p_brand AS q, a.* FROM agg a JOIN part p ON p.p_partkey = a.l_partkey),
ch AS (SELECT q, l_partkey, 'qty' AS c, qty AS s FROM base UNION ALL SELECT q, l_partkey, 'disc', disc FROM base UNION ALL SELECT q, l_partkey, 'n', n FROM base)"""

# int(sha1(text), 16) % 100 in DuckDB's SQL: eight hex digits at a time, 16 ** 8 % 100 = 96.
_MOD = "list_reduce(list_transform([1, 9, 17, 25, 33], lambda i: ('0x' || substr(sha1(sample_id), i, 8))::BIGINT % 100), lambda a, b: (a * 96 + b) % 100)"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def history(spark: SparkSession, d: str) -> DataFrame:
    return tp.with_validity(load(spark, d, "events").select("event_id", "user_id", "event_type", "value", "ts"), _FACT, "ts", "event_id")


def run_log(spark: SparkSession, d: str) -> DataFrame:
    """The run log without repeated deliveries."""
    return load(spark, d, "answers").select("answer_id", "sample_id", "system", "dataset", "category", "run_idx", "run_day", "abstained", "correct", "error", "query_tokens", "e2e_ms", "age_days", "extra").distinct()


def channels(spark: SparkSession, d: str) -> DataFrame:
    """Three score channels of parts within their brand."""
    a = load(spark, d, "lineitem").groupBy("l_partkey").agg(F.round(F.sum("l_quantity"), 4).alias("qty"), F.round(F.avg("l_discount"), 9).alias("disc"), F.count("*").cast("double").alias("n"))
    b = a.join(load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("q")), "l_partkey")
    return b.select("q", "l_partkey", F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("s")) for c in ("qty", "disc", "n")])))


@query()
def p6_found(spark, d):
    return normalise_times(load(spark, d, "turns"), load(spark, d, "sessions"), load(spark, d, "samples"))


# --- facts and time travel -------------------------------------------------------------------------------------------


@query("""SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, max(ts) AS valid_at, count(*) - 1 AS n_superseded
FROM events WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY ALL""")
def latest_value(spark, d):
    return tp.latest_value(load(spark, d, "events"), _FACT, "value", "ts", "event_id", F.expr(AS_OF))


@query(_HIST + " SELECT event_id, user_id, event_type, value, ts AS valid_at, invalid_at FROM h WHERE ts <= TIMESTAMP '2024-01-20' AND (invalid_at IS NULL OR TIMESTAMP '2024-01-20' < invalid_at)")
def facts_as_of(spark, d):
    return tp.active_at(history(spark, d), "ts", F.expr(AS_OF)).select("event_id", "user_id", "event_type", "value", F.col("ts").alias("valid_at"), "invalid_at")


@query(_HIST + " SELECT event_id, user_id, event_type, ts AS valid_at, invalid_at, invalid_at IS NULL AS is_current FROM h")
def fact_history(spark, d):
    return history(spark, d).select("event_id", "user_id", "event_type", F.col("ts").alias("valid_at"), "invalid_at", "is_current")


@query(_HIST + """ SELECT t.phase, count(*) AS n, round(sum(value), 4) AS total FROM h, (VALUES ('before', TIMESTAMP '2024-01-10'), ('after', TIMESTAMP '2024-01-20')) t(phase, t0)
WHERE ts <= t.t0 AND (invalid_at IS NULL OR t.t0 < invalid_at) GROUP BY 1""")
def invalidation_pair(spark, d):
    h = history(spark, d)
    phase = lambda name, t: tp.active_at(h, "ts", F.expr(f"TIMESTAMP_NTZ '{t}'")).agg(F.lit(name).alias("phase"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return phase("before", "2024-01-10").unionByName(phase("after", "2024-01-20"))


@query("""SELECT p.event_id, v.value AS asof_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_value(spark, d):
    e = load(spark, d, "events")
    left = e.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    return tp.asof_join(left, e.where("event_type = 'view'"), ["user_id"], "ts", "ts", "value", "event_id").select("event_id", "asof_value")


@query(_HIST + """ SELECT p.event_id AS probe_id, h.event_id AS fact_id FROM events p JOIN h ON p.user_id = h.user_id AND h.ts <= p.ts AND (h.invalid_at IS NULL OR p.ts < h.invalid_at)
WHERE p.event_type = 'error' AND h.event_type = 'click'""")
def interval_join(spark, d):
    probes = load(spark, d, "events").where("event_type = 'error'").select("user_id", F.col("event_id").alias("probe_id"), F.col("ts").alias("at"))
    return tp.interval_join(probes, history(spark, d).where("event_type = 'click'"), ["user_id"], "at", "ts").select("probe_id", F.col("event_id").alias("fact_id"))


@query("SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS total, count(DISTINCT CAST(ts AS DATE)) AS n_days FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-06' AND TIMESTAMP '2024-01-20' GROUP BY ALL")
def count_window(spark, d):
    g = tp.window_rollup(load(spark, d, "events"), _FACT, "ts", "value", F.expr(AS_OF), 14)
    return g.withColumn("total", F.round("total", 4))


@query("""SELECT user_id, string_agg(event_type, '>' ORDER BY t, i) AS sequence FROM (SELECT user_id, event_type, min(ts) AS t, arg_min(event_id, ts) AS i FROM events GROUP BY ALL) GROUP BY 1""")
def event_order(spark, d):
    return tp.first_occurrence_order(load(spark, d, "events"), "user_id", "event_type", "ts", "event_id")


@query("""SELECT user_id, nullif(abs(datediff('day', min(CAST(ts AS DATE)) FILTER (event_type = 'signup'), min(CAST(ts AS DATE)) FILTER (event_type = 'purchase'))), 0) AS delta_days FROM events GROUP BY 1""")
def temporal_delta(spark, d):
    return tp.day_delta(load(spark, d, "events"), "user_id", "event_type", "ts", "signup", "purchase")


@query("""WITH last AS (SELECT user_id, arg_max(CASE event_type WHEN 'signup' THEN 'asserted' WHEN 'error' THEN 'retracted' ELSE 'negated' END, (ts, event_id)) AS status FROM events WHERE event_type IN ('signup', 'error', 'view') GROUP BY 1)
SELECT c_custkey AS user_id, coalesce(status, 'absent') AS status FROM customer LEFT JOIN last ON c_custkey = user_id""")
def lacuna_status(spark, d):
    e = load(spark, d, "events").where("event_type IN ('signup', 'error', 'view')")
    polarity = F.when(F.col("event_type") == "signup", "asserted").when(F.col("event_type") == "error", "retracted").otherwise("negated")
    return tp.polarity_status(e, load(spark, d, "customer").select(F.col("c_custkey").alias("user_id")), ["user_id"], polarity, "ts", "event_id")


@query("""SELECT user_id, arg_max(value, (ts, event_id)) FILTER (value IS NOT NULL) AS value, arg_max(event_type, (ts, event_id)) AS event_type, count(DISTINCT props) AS n_entries, count(*) AS n_revisions
FROM events WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY 1""")
def problem_fold(spark, d):
    return tp.fold_revisions(load(spark, d, "events").where(F.col("ts") <= F.expr(AS_OF)), "user_id", ["ts", "event_id"], ["value", "event_type"], "props")


@query("""WITH cur AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS ev, max(ts) AS et FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY ALL)
SELECT e.event_id, CASE WHEN cur.user_id IS NULL THEN 'ADD' WHEN e.value IS NULL THEN 'DELETE_TOMBSTONE' WHEN e.value = cur.ev THEN 'NOOP' WHEN e.ts < cur.et THEN 'ADD' ELSE 'UPDATE' END AS op
FROM events e LEFT JOIN cur USING (user_id, event_type) WHERE e.ts >= TIMESTAMP '2024-01-10'""")
def merge_classify(spark, d):
    e = load(spark, d, "events")
    cut = lambda t: F.expr(f"TIMESTAMP_NTZ '{t}'")
    current = tp.latest_value(e.where(F.col("ts") < cut("2024-01-15")), _FACT, "value", "ts", "event_id", cut("2024-01-15")).select(*_FACT, "value", F.col("valid_at").alias("ts"))
    return tp.classify_writes(e.where(F.col("ts") >= cut("2024-01-10")), current, _FACT, "value", "ts").select("event_id", "op")


@query("SELECT event_id, CAST(CASE event_type WHEN 'click' THEN CAST(ts AS DATE) - 3 WHEN 'view' THEN CAST(ts AS DATE) - 14 WHEN 'purchase' THEN CAST(ts AS DATE) + 5 WHEN 'signup' THEN CAST(ts AS DATE) + INTERVAL 1 MONTH ELSE CAST(ts AS DATE) + 7 END AS DATE)::VARCHAR AS resolved_date FROM events")
def relative_dates(spark, d):
    phrase = F.when(F.col("event_type") == "click", "3 days ago").when(F.col("event_type") == "view", "2 weeks ago").when(F.col("event_type") == "purchase", "in 5 days").when(F.col("event_type") == "signup", "next month").otherwise("next week")
    return load(spark, d, "events").select("event_id", content.relative_date(phrase, F.to_date("ts")).cast("string").alias("resolved_date"))


@query("SELECT namespace, count(*) AS n_rows FROM documents WHERE namespace = 'ns-atrium' AND created_at <= TIMESTAMP '2024-01-01' GROUP BY 1")
def scope_filter(spark, d):
    return load(spark, d, "documents").where("namespace = 'ns-atrium' AND created_at <= TIMESTAMP_NTZ '2024-01-01 00:00:00'").groupBy("namespace").agg(F.count("*").alias("n_rows"))


@query("SELECT namespace, count(DISTINCT session_id) AS n_sessions FROM sessions WHERE created_at <= TIMESTAMP '2023-01-01' GROUP BY 1")
def sessions_as_of(spark, d):
    return load(spark, d, "sessions").where("created_at <= TIMESTAMP_NTZ '2023-01-01 00:00:00'").groupBy("namespace").agg(F.countDistinct("session_id").alias("n_sessions"))


# --- sessions, turns and content --------------------------------------------------------------------------------------


@query("SELECT session_id, lower(trim(role)) AS role, count(*) AS n_turns, CAST(sum(floor(length(content) / 4)) AS BIGINT) AS n_tokens FROM (SELECT DISTINCT turn_id, session_id, role, content FROM turns) GROUP BY ALL")
def ingest_sessions(spark, d):
    t = load(spark, d, "turns").select("turn_id", "session_id", "role", "content").distinct()
    return t.groupBy("session_id", F.lower(F.trim("role")).alias("role")).agg(F.count("*").alias("n_turns"), F.sum(content.approx_tokens(F.col("content"))).alias("n_tokens"))


@query("SELECT session_id, arg_max(sha256(content), (turn_no, turn_id)) AS content_hash FROM turns WHERE lower(trim(role)) = 'user' AND trim(content) <> '' GROUP BY 1")
def speaker_fact(spark, d):
    t = load(spark, d, "turns").where("lower(trim(role)) = 'user' AND trim(content) <> ''")
    return t.groupBy("session_id").agg(F.max_by(F.sha2("content", 256), F.struct("turn_no", "turn_id")).alias("content_hash"))


@query("SELECT sha256(text) AS content_hash, 'cas://' || sha256(text) AS raw_uri, count(*) AS n_copies FROM documents GROUP BY ALL HAVING sha256(text) NOT IN (SELECT sha256(text) FROM eval_items)")
def cas_put(spark, d):
    return content.cas_put(load(spark, d, "eval_items").select(F.sha2("text", 256).alias("content_hash")), load(spark, d, "documents"), "text")


@query("SELECT count(*) AS total, count(*) FILTER (text IS NOT NULL AND doc_id % 7 <> 0) AS lossless, false AS passed, (SELECT string_agg(h, ',' ORDER BY h) FROM (SELECT DISTINCT sha256(text || '!') AS h FROM documents WHERE doc_id % 7 = 0 ORDER BY 1 LIMIT 20)) AS failures FROM documents")
def snap_back_audit(spark, d):
    """Every seventh record is stored with the hash of another text, so that failures show."""
    docs = load(spark, d, "documents")
    stored = docs.withColumn("stored", F.when(F.col("doc_id") % 7 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256)))
    return content.snap_back_audit(stored, "text", "stored")


@query("SELECT doc_id, sha256('memvec-base' || chr(31) || '96' || chr(31) || text) AS cache_key FROM documents WHERE text IS NOT NULL")
def embed_cache_keys(spark, d):
    return load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", content.cache_key(F.lit("memvec-base"), F.lit("96"), F.col("text")).alias("cache_key"))


@query("""WITH newest AS (SELECT model, dim, cache_key, arg_max(vec, (updated_at, vec_id)) AS vec FROM embed_cache WHERE vec IS NOT NULL GROUP BY ALL)
SELECT w.model, count(*) AS n_asked, count(n.vec) AS n_hits FROM (SELECT DISTINCT model, CASE WHEN vec_id % 3 = 0 THEN dim + 1 ELSE dim END AS dim, cache_key FROM embed_cache) w LEFT JOIN newest n USING (model, dim, cache_key) GROUP BY 1""")
def embed_cache_get(spark, d):
    """Hits need model, dim and key; every third row is asked for with another dim."""
    c = load(spark, d, "embed_cache")
    asked = c.select("model", F.when(F.col("vec_id") % 3 == 0, F.col("dim") + 1).otherwise(F.col("dim")).alias("dim"), F.col("cache_key").alias("key")).distinct()
    return content.cache_get(c.where("vec IS NOT NULL"), asked).groupBy("model").agg(F.count("*").alias("n_asked"), F.count("vec").alias("n_hits"))


@query("SELECT lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g'))) AS norm, min(doc_id) AS doc_id, count(*) AS n_copies FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_dups(spark, d):
    norm = F.lower(F.trim(F.regexp_replace("text", r"[ \t\n\r\f]+", " ")))
    return load(spark, d, "documents").where("text IS NOT NULL").groupBy(norm.alias("norm")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies")).where("n_copies > 1")


@query("SELECT doc_id, CASE WHEN lower(modality) IN ('pdf', 'image', 'audio', 'video', 'binary') THEN 'resource' WHEN regexp_matches(text, '{v}') THEN 'knowledge_vault' WHEN regexp_matches(text, '{c}') THEN 'core' WHEN regexp_matches(text, '{p}') THEN 'procedural' WHEN valid_at IS NOT NULL THEN 'semantic' ELSE 'episodic' END AS memory_type FROM documents".format(v=content.VAULT, c=content.CORE.replace("'", "''"), p=content.PROCEDURAL))
def memory_type(spark, d):
    return load(spark, d, "documents").select("doc_id", content.memory_type(F.col("text"), F.col("modality"), F.col("valid_at").isNotNull()).alias("memory_type"))


@query("SELECT doc_id, unnest(regexp_extract_all(text, '[$€£]?\\d+(?:\\.\\d+)?(?: (?:million|billion|thousand))?(?: [a-z]+)?')) AS quantity FROM documents")
def quantity_claims(spark, d):
    return load(spark, d, "documents").select("doc_id", F.explode(content.quantities(F.col("text"))).alias("quantity"))


@query()
def split_sentences(spark, d):
    """DuckDB's regex engine has no lookbehind; unit tests hold the cases."""
    return load(spark, d, "documents").select("doc_id", F.posexplode(content.sentences(F.col("text"))).alias("seq", "s")).select("doc_id", "seq", F.sha2("s", 256).alias("sentence_hash"))


@query()
def chunk_documents(spark, d):
    return content.chunks(load(spark, d, "documents"), "doc_id", "text", 200)


@query("SELECT event_id, round(value * exp(-0.1 * datediff('day', CAST(ts AS DATE), DATE '2024-03-01')), 6) AS retention FROM events WHERE ts < TIMESTAMP '2024-03-01'")
def fademem_retention(spark, d):
    e = load(spark, d, "events").where("ts < TIMESTAMP_NTZ '2024-03-01 00:00:00'")
    return e.select("event_id", F.round(content.retention(F.col("value"), F.datediff(F.expr("DATE '2024-03-01'"), F.to_date("ts")).cast("double"), 0.1), 6).alias("retention"))


# --- run logs ---------------------------------------------------------------------------------------------------------


@query("SELECT category, count(DISTINCT sample_id) AS n FROM samples GROUP BY 1")
def category_counts(spark, d):
    return load(spark, d, "samples").groupBy("category").agg(F.countDistinct("sample_id").alias("n"))


@query(_LOG + """ SELECT system, count(*) AS n, count(*) FILTER (coalesce(extra.verified, false) AND coalesce(correct, false)) AS verified_correct, count(*) FILTER (coalesce(abstained, false)) AS abstained,
count(*) FILTER (NOT coalesce(abstained, false)) AS answered, count(*) FILTER (NOT coalesce(abstained, false) AND NOT coalesce(extra.verified, false)) AS unverified_answered FROM log WHERE error IS NULL GROUP BY 1""")
def integrity_rollup(spark, d):
    return ev.integrity_rollup(run_log(spark, d), ["system"])


_MISS = "CASE WHEN error IS NOT NULL THEN 'error' WHEN coalesce(abstained, false) THEN 'abstained' WHEN coalesce(correct, false) THEN NULL WHEN coalesce(extra.verified, false) THEN 'verified_wrong' ELSE 'unverified_wrong' END"


@query(_LOG + f" SELECT system, " + ", ".join(f"count(*) FILTER ({_MISS} = '{b}') AS \"{b}\"" for b in ("error", "abstained", "verified_wrong", "unverified_wrong")) + f" FROM log WHERE {_MISS} IS NOT NULL GROUP BY 1")
def miss_taxonomy(spark, d):
    return ev.pivot_counts(run_log(spark, d), "system", ev.miss_bucket(), ["error", "abstained", "verified_wrong", "unverified_wrong"])


_FORENSICS = "CASE WHEN error IS NOT NULL THEN 'infra' WHEN coalesce(abstained, false) THEN 'abstention' WHEN coalesce(correct, false) THEN NULL WHEN coalesce(extra.verified, false) OR coalesce(extra.coverage, 0) >= 0.8 THEN 'reader_error' ELSE 'retrieval_miss' END"


@query(_LOG + " SELECT dataset, " + ", ".join(f"count(*) FILTER ({_FORENSICS} = '{b}') AS \"{b}\"" for b in ("infra", "abstention", "reader_error", "retrieval_miss")) + f" FROM log WHERE {_FORENSICS} IS NOT NULL GROUP BY 1")
def forensics_buckets(spark, d):
    return ev.pivot_counts(run_log(spark, d), "dataset", ev.forensics_bucket(), ["infra", "abstention", "reader_error", "retrieval_miss"])


@query(_LOG + """ SELECT run_day, system, count(*) AS n, count(*) FILTER (coalesce(correct, false)) AS n_correct, count(*) FILTER (coalesce(extra.verified, false)) AS n_verified, round(quantile_cont(query_tokens, 0.5), 6) AS med_tokens
FROM log WHERE error IS NULL GROUP BY GROUPING SETS ((run_day, system), (system))""")
def rolling_holdout(spark, d):
    return ev.rolling_totals(run_log(spark, d), "run_day", "system")


@query(_LOG + """, g AS (SELECT system, dataset, count(*)::DOUBLE AS n, count(*) FILTER (coalesce(correct, false))::DOUBLE AS k FROM log WHERE error IS NULL GROUP BY ALL), w AS (SELECT *, k / n AS p, 1.959964::DOUBLE AS z FROM g)
SELECT system, dataset, CAST(k AS BIGINT) AS k, CAST(n AS BIGINT) AS n, round((p + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n), 6) AS lo, round((p + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n), 6) AS hi FROM w""")
def wilson_ci(spark, d):
    g = run_log(spark, d).where("error IS NULL").groupBy("system", "dataset").agg(F.count_if(F.coalesce("correct", F.lit(False))).alias("k"), F.count("*").alias("n"))
    lo, hi = ev.wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    return g.select("system", "dataset", "k", "n", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query(_LOG + """, u AS (SELECT dataset, sample_id, run_idx, max(coalesce(correct, false)::INT) FILTER (system = 'eidos-full') AS a, max(coalesce(correct, false)::INT) FILTER (system = 'vec-rag') AS b
 FROM log WHERE error IS NULL AND system IN ('eidos-full', 'vec-rag') GROUP BY ALL),
g AS (SELECT dataset, count(*) FILTER (a = 1 AND b = 1) AS both, count(*) FILTER (a = 1 AND b = 0) AS a_only, count(*) FILTER (a = 0 AND b = 1) AS b_only, count(*) FILTER (a IS NULL OR b IS NULL) AS unpaired FROM u GROUP BY 1)
SELECT g.*, round(least(1.0, 2 * (SELECT sum(exp(lgamma(a_only + b_only + 1) - lgamma(i + 1) - lgamma(a_only + b_only - i + 1) - (a_only + b_only) * ln(2::DOUBLE))) FROM range(0, least(a_only, b_only) + 1) t(i))), 6) AS p FROM g""")
def mcnemar_pairs(spark, d):
    return ev.paired_outcomes(run_log(spark, d), ["sample_id", "run_idx"], "system", "eidos-full", "vec-rag", ["dataset"])


@query(_LOG + " SELECT system, count(*) AS n, round(quantile_cont(e2e_ms, 0.5), 4) AS p50, round(quantile_cont(e2e_ms, 0.95), 4) AS p95 FROM log WHERE error IS NULL AND e2e_ms >= 0 AND NOT isnan(e2e_ms) GROUP BY 1")
def latency_p95(spark, d):
    ok = run_log(spark, d).where("error IS NULL AND e2e_ms >= 0 AND NOT isnan(e2e_ms)")
    return ok.groupBy("system").agg(F.count("*").alias("n"), F.round(F.percentile("e2e_ms", 0.5), 4).alias("p50"), F.round(F.percentile("e2e_ms", 0.95), 4).alias("p95"))


@query()
def age_curves(spark, d):
    return ev.age_curves(run_log(spark, d), "system", "age_days", "correct", "e2e_ms")


@query(_LOG + """, g AS (SELECT system, extra.confidence AS c, count(*) AS n, count(*) FILTER (coalesce(correct, false)) AS k FROM log WHERE error IS NULL AND NOT coalesce(abstained, false) AND extra.confidence IS NOT NULL GROUP BY ALL),
r AS (SELECT *, sum(n) OVER w AS cn, sum(k) OVER w AS ck FROM g WINDOW w AS (PARTITION BY system ORDER BY c DESC RANGE UNBOUNDED PRECEDING))
SELECT system, coalesce(min(c) FILTER (ck::DOUBLE / cn >= 0.8), max(c) + 1e-9::DOUBLE) AS tau, CAST(coalesce(max(cn) FILTER (ck::DOUBLE / cn >= 0.8), 0) AS BIGINT) AS covered, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1""")
def pick_tau(spark, d):
    return ev.pick_tau(run_log(spark, d).withColumn("confidence", F.col("extra.confidence")), "system", "confidence", "correct", 0.8)


@query(_LOG + """, s AS (SELECT dataset, 1 - extra.coverage AS s, row_number() OVER (PARTITION BY dataset ORDER BY 1 - extra.coverage) AS r, count(*) OVER (PARTITION BY dataset) AS n FROM log WHERE extra.coverage IS NOT NULL AND NOT isnan(extra.coverage))
SELECT dataset, max(n) AS n, round(max(s) FILTER (r = ceil((n + 1)::DOUBLE * 0.9::DOUBLE)), 9) AS qhat, round(1 - max(s) FILTER (r = ceil((n + 1)::DOUBLE * 0.9::DOUBLE)), 9) AS cutoff FROM s GROUP BY 1""")
def conformal_qhat(spark, d):
    c = ev.conformal_cutoff(run_log(spark, d).withColumn("sim", F.col("extra.coverage")), "dataset", "sim")
    return c.select("dataset", "n", F.round("qhat", 9).alias("qhat"), F.round("cutoff", 9).alias("cutoff"))


@query(f"SELECT DISTINCT sample_id, {_MOD} AS bucket, CASE WHEN {_MOD} < 20 THEN 'dev' ELSE 'test' END AS split FROM samples")
def split_assign(spark, d):
    return load(spark, d, "samples").select("sample_id").distinct().select("sample_id", ev.sha1_mod100(F.col("sample_id")).alias("bucket"), ev.split_of(F.col("sample_id")).alias("split"))


@query("""WITH u AS (SELECT DISTINCT sample_id, dataset FROM samples), r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY sha256('epoch-1:' || sample_id), sample_id) AS rank, count(*) OVER (PARTITION BY dataset) AS n FROM u)
SELECT sample_id, dataset, rank, round((rank - 0.5::DOUBLE) / n, 9) AS place FROM r""")
def holdout_ring(spark, d):
    return ev.holdout_ring(load(spark, d, "samples").select("sample_id", "dataset").distinct(), "sample_id", "dataset", "epoch-1")


@query("""WITH a AS (SELECT DISTINCT answer_id, sample_id, answer, extra.confidence AS conf FROM answers WHERE error IS NULL AND answer IS NOT NULL),
g AS (SELECT sample_id, trim(regexp_replace(lower(answer), '\\s+', ' ', 'g')) AS a, count(*) AS votes, round(sum(conf), 6) AS conf, min(answer_id) AS seen FROM a GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY votes DESC, conf DESC NULLS LAST, seen) AS r, sum(votes) OVER (PARTITION BY sample_id) AS total FROM g)
SELECT sample_id, CASE WHEN votes >= 2 THEN a END AS answer, votes, round(votes / total, 6) AS support FROM r WHERE r = 1""")
def debate_vote(spark, d):
    a = load(spark, d, "answers").where("error IS NULL AND answer IS NOT NULL").select("answer_id", "sample_id", "answer", F.col("extra.confidence").alias("confidence")).distinct()
    return ev.vote(a, ["sample_id"], "answer", "confidence", "answer_id")


@query("SELECT namespace, modality AS channel, count(*) AS n FROM documents GROUP BY GROUPING SETS ((namespace, modality), (modality))")
def channel_wins(spark, d):
    return load(spark, d, "documents").groupingSets([["namespace", "modality"], ["modality"]], "namespace", "modality").agg(F.count("*").alias("n")).withColumnRenamed("modality", "channel")


# --- ranking ----------------------------------------------------------------------------------------------------------

_NORM = {
    "zscore": "CASE WHEN stddev_pop(s) OVER w = 0 THEN 0 ELSE (s - avg(s) OVER w) / stddev_pop(s) OVER w END",
    "minmax": "CASE WHEN max(s) OVER w = min(s) OVER w THEN 0 ELSE (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) END",
    "dbsf": "CASE WHEN stddev_pop(s) OVER w = 0 THEN 0 ELSE greatest(0, least(1, (s - (avg(s) OVER w - 3 * stddev_pop(s) OVER w)) / (6 * stddev_pop(s) OVER w))) END",
    "rrf": "1.0::DOUBLE / (60 + row_number() OVER (w ORDER BY s DESC, l_partkey))",
    "borda": "count(*) OVER w - row_number() OVER (w ORDER BY s DESC, l_partkey) + 1",
}


def _fuse(method: str):
    def run(spark, d):
        f = ranking.fuse_scores(channels(spark, d), "q", "l_partkey", "c", "s", method, {"disc": 0.5})
        return f.select("l_partkey", F.round("fused", 6).alias("fused"))

    run.__name__ = f"fuse_{method}"
    sql = f"{_CHANNELS}, n AS (SELECT l_partkey, CASE c WHEN 'disc' THEN 0.5::DOUBLE ELSE 1 END * ({_NORM[method]}) AS f FROM ch WINDOW w AS (PARTITION BY q, c)) SELECT l_partkey, round(sum(f)::DOUBLE, 6) AS fused FROM n GROUP BY 1"
    return query(sql)(run)


for _m in _NORM:
    _fuse(_m)


@query(_CHANNELS + """, r AS (SELECT q, row_number() OVER w AS k, s - lead(s) OVER w AS gap FROM ch WHERE c = 'qty' WINDOW w AS (PARTITION BY q ORDER BY s DESC, l_partkey))
SELECT q, count(*) AS n, CAST(coalesce(arg_max(k, (gap, -k)) FILTER (gap IS NOT NULL AND k BETWEEN 2 AND 20), 2) AS INT) AS k FROM r GROUP BY 1""")
def adaptive_k(spark, d):
    return ranking.adaptive_k(channels(spark, d).where("c = 'qty'"), "q", "s", "l_partkey", 2, 20)


@query(_CHANNELS + """, e AS (SELECT q, s, exp(s - max(s) OVER (PARTITION BY q)) AS e, row_number() OVER (PARTITION BY q ORDER BY s DESC) AS r FROM ch WHERE c = 'disc'), p AS (SELECT *, e / sum(e) OVER (PARTITION BY q) AS p FROM e)
SELECT q, count(*) AS n, round(max(s) FILTER (r = 1) - coalesce(max(s) FILTER (r = 2), 0), 6) AS margin, round(CASE WHEN count(*) <= 1 THEN 0 ELSE sum(-p * ln(p)) / ln(count(*)) END, 6) AS entropy FROM p GROUP BY 1""")
def score_gates(spark, d):
    return ranking.score_gates(channels(spark, d).where("c = 'disc'"), "q", "s")


@query("""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS sim FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(sim, 5) AS sim, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")
def cosine_topk(spark, d):
    """The stated query set, every row whose id is divisible by 20, against all rows."""
    e = load(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    top = ranking.cosine_topk(q, e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec")), 5)
    return top.select("query_id", F.col("item_id").alias("vec_id"), F.round("sim", 5).alias("sim"), "rank")


@query()
def mmr_order(spark, d):
    e = load(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    items = e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))
    return ranking.mmr(ranking.cosine_topk(q, items, 20).join(items, "item_id"), "query_id", "item_id", "sim", "vec", 5)


@query()
def bm25_topk(spark, d):
    """Evaluation passages as queries over all documents."""
    w = load(spark, d, "documents").select("doc_id", norm_words(F.col("text")).alias("w"))
    asked = load(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(norm_words(F.col("text")))).alias("term"))
    return ranking.bm25(ranking.asked_postings(w, asked), w.select("doc_id", F.size("w").alias("dl")).where("dl > 0"), asked, 5)


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, len(w) AS dl FROM w WHERE len(w) > 0), st AS (SELECT count(*) AS n, avg(dl) AS a FROM l),
q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM eval_items), p AS (SELECT doc_id, unnest(w) AS term FROM w), t AS (SELECT term, doc_id, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
s AS (SELECT term, doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a)) AS s FROM t JOIN df USING (term) JOIN l USING (doc_id), st), g AS (SELECT query_id, doc_id, round(sum(s::DOUBLE), 6) AS score FROM s JOIN q USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM g) SELECT query_id, doc_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")
def bm25_words(spark, d):
    """As bm25_topk, over runs of ASCII letters and digits."""
    token = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    w = load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", token("text").alias("w"))
    asked = load(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(token("text"))).alias("term"))
    return ranking.bm25(ranking.asked_postings(w, asked), w.select("doc_id", F.size("w").alias("dl")).where("dl > 0"), asked, 5)


@query("""WITH t AS (SELECT event_type AS cur, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events), g AS (SELECT cur, nxt, count(*) AS n FROM t WHERE nxt IS NOT NULL GROUP BY ALL)
SELECT cur, nxt, n, round(n / sum(n) OVER (PARTITION BY cur), 6) AS prob FROM g""")
def markov_transitions(spark, d):
    return ranking.transitions(load(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"]).withColumn("prob", F.round("prob", 6))


@query("""WITH t AS (SELECT event_type AS cur, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events), g AS (SELECT cur, nxt, count(*) AS n FROM t WHERE nxt IS NOT NULL GROUP BY ALL),
r AS (SELECT cur, nxt, row_number() OVER (PARTITION BY cur ORDER BY n DESC, nxt) AS rank FROM g) SELECT cur, nxt, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3""")
def markov_predict(spark, d):
    t = ranking.transitions(load(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"])
    return ranking.top_per_group(t, ["cur"], [F.col("n").desc(), F.col("nxt")], 3).select("cur", "nxt", "rank")


_FRONT = "SELECT * FROM part p WHERE NOT EXISTS (SELECT 1 FROM part o WHERE o.p_retailprice <= p.p_retailprice AND -o.p_size <= -p.p_size AND (o.p_retailprice < p.p_retailprice OR -o.p_size < -p.p_size))"


@query(f"SELECT p_partkey, p_retailprice, p_size FROM ({_FRONT})")
def pareto_front(spark, d):
    p = load(spark, d, "part").select("p_partkey", "p_retailprice", "p_size").withColumn("neg", -F.col("p_size"))
    return ranking.pareto_front(p, "p_retailprice", "neg").select("p_partkey", "p_retailprice", "p_size")


@query(f"WITH f AS (SELECT DISTINCT p_retailprice AS x, -p_size AS y FROM ({_FRONT})), n AS (SELECT x, y, lead(x, 1, 10000) OVER (ORDER BY x) AS nx FROM f WHERE x <= 10000 AND y <= 0) SELECT round(sum((nx - x) * (0 - y)), 4) AS hv, count(*) AS n_front FROM n")
def hypervolume_2d(spark, d):
    p = load(spark, d, "part").select("p_partkey", "p_retailprice", "p_size").withColumn("neg", -F.col("p_size"))
    return ranking.hypervolume_2d(ranking.pareto_front(p, "p_retailprice", "neg"), "p_retailprice", "neg", 10000.0, 0.0)


@query("""WITH w AS (SELECT p_brand, p_partkey, lead(p_retailprice) OVER a - lag(p_retailprice) OVER a AS g1, lead(p_size) OVER b - lag(p_size) OVER b AS g2, max(p_retailprice) OVER p - min(p_retailprice) OVER p AS s1, max(p_size) OVER p - min(p_size) OVER p AS s2
 FROM part WINDOW p AS (PARTITION BY p_brand), a AS (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey), b AS (PARTITION BY p_brand ORDER BY p_size, p_partkey)),
i AS (SELECT *, (s1 <> 0 AND g1 IS NULL) OR (s2 <> 0 AND g2 IS NULL) AS is_inf FROM w)
SELECT p_brand, p_partkey, is_inf, CASE WHEN NOT is_inf THEN round(coalesce(CASE WHEN s1 = 0 THEN 0 ELSE g1 / s1 END, 0) + coalesce(CASE WHEN s2 = 0 THEN 0 ELSE g2 / s2 END, 0), 6) END AS distance FROM i""")
def crowding_distance(spark, d):
    return ranking.crowding_distance(load(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice", "p_size"), "p_brand", "p_partkey", ["p_retailprice", "p_size"])


# --- graph ------------------------------------------------------------------------------------------------------------


def triples(spark: SparkSession, d: str) -> DataFrame:
    """Customers in nations, nations in regions, and the customers of three segments in their region."""
    c, n = load(spark, d, "customer"), load(spark, d, "nation")
    a = c.select(F.concat(F.lit("c"), "c_custkey").alias("h"), F.lit("in_nation").alias("r"), F.concat(F.lit("n"), "c_nationkey").alias("t"), F.col("c_custkey").alias("seq"))
    b = n.select(F.concat(F.lit("n"), "n_nationkey").alias("h"), F.lit("nation_in").alias("r"), F.concat(F.lit("r"), "n_regionkey").alias("t"), F.col("n_nationkey").cast("bigint").alias("seq"))
    e = c.where("c_mktsegment <> 'BUILDING'").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # nations are a fixed table of 25 rows
    return a.unionByName(b).unionByName(e.select(F.concat(F.lit("c"), "c_custkey").alias("h"), F.lit("in_region").alias("r"), F.concat(F.lit("r"), "n_regionkey").alias("t"), F.col("c_custkey").alias("seq")))


_TRIPLES = """WITH e AS (SELECT 'c' || c_custkey AS h, 'in_nation' AS r, 'n' || c_nationkey AS t FROM customer UNION ALL SELECT 'n' || n_nationkey, 'nation_in', 'r' || n_regionkey FROM nation
UNION ALL SELECT 'c' || c_custkey, 'in_region', 'r' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment <> 'BUILDING'),
p AS (SELECT DISTINCT a.h AS x, a.r AS r1, b.r AS r2, b.t AS z FROM e a JOIN e b ON a.t = b.h WHERE a.h <> b.t), body AS (SELECT r1, r2, count(*) AS body FROM p GROUP BY ALL),
rules AS (SELECT r1, r2, h.r AS r3, any_value(body) AS body, round(count(*) / any_value(body), 6) AS conf FROM p JOIN (SELECT DISTINCT * FROM e) h ON h.h = p.x AND h.t = p.z JOIN body USING (r1, r2) GROUP BY ALL HAVING any_value(body) >= 2 AND count(*) / any_value(body) >= 0.5)"""


@query(_TRIPLES + " SELECT r1, r2, count(*) AS n_paths FROM (SELECT a.r AS r1, b.r AS r2 FROM e a JOIN e b ON a.t = b.h WHERE a.h <> b.t) GROUP BY ALL")
def kg_two_hop(spark, d):
    return graph.two_hop(triples(spark, d)).groupBy("r1", "r2").agg(F.count("*").alias("n_paths"))


@query(_TRIPLES + " SELECT * FROM rules")
def rule_mine(spark, d):
    return graph.mine_rules(triples(spark, d))


@query(_TRIPLES + " SELECT p.x, r3, p.z, max(conf) AS conf FROM p JOIN rules USING (r1, r2) WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.h = p.x AND e.r = r3 AND e.t = p.z) GROUP BY ALL")
def rule_apply(spark, d):
    t = triples(spark, d)
    return graph.apply_rules(t, graph.mine_rules(t))


@query("WITH a AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, event_type FROM events) SELECT x.event_type AS a, y.event_type AS b, count(*) AS n FROM a x JOIN a y ON x.user_id = y.user_id AND x.day = y.day AND x.event_type < y.event_type GROUP BY ALL")
def coactivation_edges(spark, d):
    return graph.coactivation(load(spark, d, "events").withColumn("day", F.to_date("ts")), ["user_id", "day"], "event_type")


@query("SELECT event_id, user_id, event_type FROM events WHERE lower(event_type) IN ('purchase', 'error')")
def edges_touching(spark, d):
    return graph.edges_touching(load(spark, d, "events").withColumn("src", F.col("user_id").cast("string")), ["PURCHASE", "Error"], "src", "event_type").select("event_id", "user_id", "event_type")


def supply(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b"))


@query("""WITH e AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem), h1 AS (SELECT DISTINCT b AS node FROM e WHERE a = 'p1'), h2 AS (SELECT DISTINCT a AS node FROM e WHERE b IN (SELECT node FROM h1) AND a <> 'p1')
SELECT 'p1' AS node, 0 AS hop UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2""")
def khop_entities(spark, d):
    return graph.khop(supply(spark, d), spark.range(1).select(F.lit("p1").alias("node")), 2)


@query()
def ppr(spark, d):
    return graph.pagerank(supply(spark, d), spark.range(1).select(F.lit("p1").alias("node")), 5).withColumn("score", F.round("score", 9))


# --- activation -------------------------------------------------------------------------------------------------------


@query()
def activation_final(spark, d):
    return activation_fold(load(spark, d, "events").withColumn("turn", F.datediff(F.to_date("ts"), F.expr("DATE '2020-01-01'"))), _FACT, "turn")


@query("""WITH a AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, event_type FROM events), l AS (SELECT x.event_type AS a, y.event_type AS b FROM a x JOIN a y ON x.user_id = y.user_id AND x.day = y.day AND x.event_type < y.event_type GROUP BY ALL),
s AS (SELECT event_type AS id, least(1.0, count(*) / 1e6) AS activation FROM events GROUP BY 1), both_ AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
u AS (SELECT id, activation FROM s UNION ALL SELECT b, activation * 0.4 FROM s JOIN both_ ON id = a) SELECT id, round(least(1.0, sum(activation)), 6) AS activation FROM u GROUP BY 1""")
def activation_neighbours(spark, d):
    e = load(spark, d, "events")
    active = e.groupBy(F.col("event_type").alias("id")).agg(F.least(F.lit(1.0), F.count("*") / 1e6).alias("activation"))
    return activation_spread(active, graph.coactivation(e.withColumn("day", F.to_date("ts")), ["user_id", "day"], "event_type"))
