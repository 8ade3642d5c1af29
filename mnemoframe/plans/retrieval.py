"""Registered queries of retrieval, upkeep and further rollups, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemoframe.operators import content, evaluation as ev, retrieval as rt
from mnemoframe.plans.core import _FACT, _LOG, query, run_log, triples
from mnemoframe.tables import load

_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 3 AND x NOT IN (" + ", ".join(f"'{w}'" for w in rt.STOP_WORDS) + ")))"
_ASKED = ["webhook", "mortgage", "goalkeeper", "oven"]
_IN = "('webhook', 'mortgage', 'goalkeeper', 'oven')"


def records(spark, d):
    return load(spark, d, "documents").select("doc_id", "text", "namespace", "source", "created_at")


@query(f"SELECT term, count(*) AS n_docs FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY 1")
def reflex_tokens(spark, d):
    return rt.reflex_postings(records(spark, d), "namespace", "doc_id", "text").groupBy("term").agg(F.count("*").alias("n_docs"))


@query(f"""WITH p AS (SELECT namespace, doc_id, unnest({_TOKENS}) AS term FROM documents), h AS (SELECT namespace, doc_id, count(DISTINCT term) AS n_hits FROM p WHERE term IN {_IN} GROUP BY ALL),
r AS (SELECT *, round(n_hits / 4, 6) AS coverage, row_number() OVER (PARTITION BY namespace ORDER BY n_hits DESC, doc_id) AS rank FROM h) SELECT namespace, doc_id, n_hits, coverage, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")
def reflex_recall(spark, d):
    return rt.reflex_recall(rt.reflex_postings(records(spark, d), "namespace", "doc_id", "text"), "namespace", "doc_id", _ASKED, 5)


@query(f"SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) WHERE term IN {_IN}")
def reflex_seeds(spark, d):
    p = rt.reflex_postings(records(spark, d), "namespace", "doc_id", "text")
    return p.where(F.col("term").isin(_ASKED)).select("doc_id").distinct()


@query(f"SELECT min(namespace) AS namespace, term FROM (SELECT DISTINCT namespace, unnest({_TOKENS}) AS term FROM documents) WHERE term IN ('webhook', 'isotope', 'vinaigrette', 'peloton', 'subpoena') AND namespace IS NOT NULL GROUP BY term HAVING count(*) = 1")
def region_hints(spark, d):
    p = rt.reflex_postings(records(spark, d).where("namespace IS NOT NULL"), "namespace", "doc_id", "text")
    return rt.region_hints(p, "namespace", ["webhook", "isotope", "vinaigrette", "peloton", "subpoena"])


@query("SELECT event_id, substr(props, 1, 240) AS snippet, round_even(value, 3) AS salience FROM events WHERE value >= 0.6 ORDER BY value DESC, user_id DESC, event_id LIMIT 5")
def scratchpad(spark, d):
    return rt.scratchpad(load(spark, d, "events"), "value", "user_id", "event_id", "props")


@query("SELECT sample_id, least(count(DISTINCT answer_id) FILTER (correct) / 5, 1) AS signal FROM answers WHERE error IS NULL GROUP BY 1")
def helpful_signal(spark, d):
    a = load(spark, d, "answers").where("error IS NULL")
    return a.groupBy("sample_id").agg(F.least(F.countDistinct(F.when(F.col("correct"), F.col("answer_id"))) / 5, F.lit(1.0)).alias("signal"))


@query("""WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0), m AS (SELECT label, i, 1.0::DOUBLE * max(q.v[i])::DOUBLE + 0.6::DOUBLE * avg(e.embedding[i]::DOUBLE) AS x FROM embeddings e, q, range(1, 65) t(i) GROUP BY ALL),
n AS (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY label)) AS n FROM m) SELECT label, CAST(i - 1 AS INT) AS pos, round(CASE WHEN n = 0 THEN x ELSE x / n END, 5) AS x FROM n""")
def rocchio(spark, d):
    """The vector of id 0 moved towards the mean of each label."""
    e = load(spark, d, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("_query"))
    j = e.crossJoin(F.broadcast(q))  # one row
    return rt.rocchio(F.col("_query"), j, "label", "embedding").withColumn("x", F.round("x", 5))


@query("""WITH s AS (SELECT e.vec_id AS item_id, c.vec_id AS centroid_id, round(list_cosine_similarity(e.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS sim FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id < 16) c)
SELECT item_id, arg_max(centroid_id, (sim, -centroid_id)) AS centroid_id, max(sim) AS sim, max(sim) >= 0.9 AS hit FROM s GROUP BY 1""")
def prefetch_match(spark, d):
    """The sixteen vectors of a prefetch table as centroids."""
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))
    return rt.nearest_centroid(e, e.where("item_id < 16").select(F.col("item_id").alias("centroid_id"), "vec"), 0.9)


@query()
def lof_scores(spark, d):
    return rt.local_outliers(load(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec")))


@query()
def query_clusters(spark, d):
    return rt.query_clusters(load(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec")))


@query()
def transe_score(spark, d):
    """Customers' segments as namespaces."""
    t = triples(spark, d).where("r <> 'nation_in'").join(load(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("h"), F.col("c_mktsegment").alias("ns")), "h")
    return rt.translation_scores(t)


@query(_LOG + """ SELECT answer_id, (0.5 * greatest(0, least(1, extra.confidence)) + 0.5 * greatest(0, least(1, extra.coverage))) >= 0.6 AS passed, round(0.5 * greatest(0, least(1, extra.confidence)) + 0.5 * greatest(0, least(1, extra.coverage)), 6) AS confidence FROM log WHERE extra.confidence IS NOT NULL AND extra.coverage IS NOT NULL""")
def gate_inferred(spark, d):
    log = run_log(spark, d).where("extra.confidence IS NOT NULL AND extra.coverage IS NOT NULL")
    passed, blend, _ = rt.gate(F.col("extra.confidence"), F.col("extra.coverage"), 0.6)
    return log.select("answer_id", passed.alias("passed"), F.round(blend, 6).alias("confidence"))


@query(_LOG + """ SELECT answer_id, CASE WHEN coalesce(extra.verified, false) AND coalesce(correct, false) THEN 'SKIP' WHEN coalesce(extra.verified, false) THEN 'MERGE' WHEN coalesce(extra.coverage, 0) < 0.3 THEN 'INSERT' ELSE 'MERGE' END AS route FROM log""")
def repair_route(spark, d):
    verified, correct = F.coalesce("extra.verified", F.lit(False)), F.coalesce("correct", F.lit(False))
    return run_log(spark, d).select("answer_id", rt.repair_route(verified & correct, verified & ~correct, F.col("extra.coverage")).alias("route"))


@query(_LOG + """ SELECT system, count(*) FILTER (NOT coalesce(abstained, false)) AS answered, round(avg(coalesce(correct, false)::INT), 6) AS accuracy,
round(count(*) FILTER (NOT coalesce(abstained, false) AND NOT coalesce(correct, false)) / count(*) FILTER (NOT coalesce(abstained, false)), 6) AS hallucination, round(count(*) FILTER (coalesce(abstained, false)) / count(*), 6) AS omission FROM log WHERE error IS NULL GROUP BY 1""")
def qa_rates(spark, d):
    gone, right = F.coalesce("abstained", F.lit(False)), F.coalesce("correct", F.lit(False))
    g = run_log(spark, d).where("error IS NULL").groupBy("system").agg(F.count("*").alias("n"), F.count_if(~gone).alias("answered"), F.count_if(right).alias("k"), F.count_if(~gone & ~right).alias("wrong"))
    n = F.col("n").cast("double")
    return g.select("system", "answered", F.round(F.col("k") / n, 6).alias("accuracy"), F.round(ev.share(F.col("wrong"), F.col("answered")), 6).alias("hallucination"), F.round((n - F.col("answered")) / n, 6).alias("omission"))


@query(_LOG + """, c AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'RETRIEVAL_MISSED' WHEN coalesce(abstained, false) THEN 'ANSWER_ABSTAINED' WHEN coalesce(extra.verified, false) THEN 'ANSWER_VERIFIED' END AS t FROM log)
SELECT dataset, round(count(*) FILTER (t = 'ANSWER_VERIFIED') / count(t), 6) AS verified, round(count(*) FILTER (t = 'ANSWER_ABSTAINED') / count(t), 6) AS abstained, round(count(*) FILTER (t = 'RETRIEVAL_MISSED') / count(t), 6) AS missed FROM c GROUP BY 1""")
def integrity_report(spark, d):
    t = F.when(F.col("error").isNotNull(), "m").when(F.coalesce("abstained", F.lit(False)), "a").when(F.coalesce("extra.verified", F.lit(False)), "v")
    g = run_log(spark, d).groupBy("dataset").agg(*[F.count_if(F.coalesce(t == x, F.lit(False))).alias(x) for x in "vam"], F.count(t).alias("n"))
    return g.select("dataset", *[F.round(ev.share(F.col(x), F.col("n")), 6).alias(name) for x, name in (("v", "verified"), ("a", "abstained"), ("m", "missed"))])


@query("""SELECT (SELECT count(*) FROM events) AS memories, (SELECT count(DISTINCT user_id) FROM events) AS entities, (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events)) AS subjects,
(SELECT count(*) - count(DISTINCT (user_id, event_type)) FROM events) AS contradiction_load""")
def memory_health(spark, d):
    g = load(spark, d, "events").groupBy(*_FACT).agg(F.count("*").alias("n"))
    return g.agg(F.sum("n").alias("memories"), F.countDistinct("user_id").alias("entities"), F.count("*").alias("subjects"), F.sum(F.col("n") - 1).alias("contradiction_load"))


@query(_LOG + """ SELECT answer_id, round((extra.coverage + extra.confidence) / 2, 6) AS combined FROM log WHERE extra.coverage IS NOT NULL AND extra.confidence IS NOT NULL AND error IS NULL""")
def abstention_signals(spark, d):
    return run_log(spark, d).where("extra.coverage IS NOT NULL AND extra.confidence IS NOT NULL AND error IS NULL").select("answer_id", F.round((F.col("extra.coverage") + F.col("extra.confidence")) / 2, 6).alias("combined"))


@query(_LOG + """, r AS (SELECT sample_id, answer_id, extra.coverage AS c, row_number() OVER (PARTITION BY sample_id ORDER BY extra.coverage DESC NULLS LAST, answer_id) AS r FROM log WHERE error IS NULL)
SELECT sample_id, answer_id FROM r WHERE c >= 0.8 OR r <= 1""")
def conformal_select(spark, d):
    """Answers at or above a cut-off, and the best of each sample in any case."""
    from pyspark.sql import Window

    w = Window.partitionBy("sample_id").orderBy(F.col("extra.coverage").desc_nulls_last(), "answer_id")
    r = run_log(spark, d).where("error IS NULL").withColumn("r", F.row_number().over(w))
    return r.where("extra.coverage >= 0.8 OR r <= 1").select("sample_id", "answer_id")


@query("WITH g AS (SELECT DISTINCT sample_id, list_distinct(regexp_extract_all(lower(gold), '[a-z0-9]+')) AS g FROM samples WHERE gold IS NOT NULL), a AS (SELECT DISTINCT answer_id, sample_id, list_distinct(regexp_extract_all(lower(answer), '[a-z0-9]+')) AS p FROM answers WHERE answer IS NOT NULL), j AS (SELECT answer_id, len(list_intersect(g, p)) AS hit, len(g) AS ng, len(p) AS np FROM a JOIN g USING (sample_id)) SELECT answer_id, round(CASE WHEN ng + np = 0 THEN 0 ELSE 2 * hit / (ng + np) END, 6) AS f1 FROM j")
def extraction_f1(spark, d):
    token = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    g = load(spark, d, "samples").where("gold IS NOT NULL").select("sample_id", token("gold").alias("g")).distinct()
    a = load(spark, d, "answers").where("answer IS NOT NULL").select("answer_id", "sample_id", token("answer").alias("p")).distinct()
    total = F.size("g") + F.size("p")
    return a.join(g, "sample_id").select("answer_id", F.round(ev.share(2 * F.size(F.array_intersect("g", "p")), total), 6).alias("f1"))


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS items FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-13' AND TIMESTAMP '2024-01-20' GROUP BY 1")
def list_window(spark, d):
    e = load(spark, d, "events").where("ts BETWEEN TIMESTAMP_NTZ '2024-01-13 00:00:00' AND TIMESTAMP_NTZ '2024-01-20 00:00:00'")
    return e.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("items"))


@query("SELECT c_mktsegment, n_name, round(sum(c_acctbal), 2) AS cell FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name IN (SELECT n_name FROM nation WHERE n_nationkey < 5) GROUP BY ALL")
def table_lookup(spark, d):
    c, n = load(spark, d, "customer"), load(spark, d, "nation").where("n_nationkey < 5")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("c_mktsegment", "n_name").agg(F.round(F.sum("c_acctbal"), 2).alias("cell"))


@query("SELECT DISTINCT a.value FROM events a JOIN events b ON a.value = b.value AND a.event_type = 'view' AND b.event_type = 'click'")
def shared_value(spark, d):
    e = load(spark, d, "events")
    return e.where("event_type = 'view'").select("value").intersect(e.where("event_type = 'click'").select("value"))


@query("SELECT doc_id, sha256('reader-1' || chr(31) || 'extract facts' || chr(31) || text) AS cache_key FROM documents WHERE text IS NOT NULL")
def extract_cache_keys(spark, d):
    return load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", content.cache_key(F.lit("reader-1"), F.lit("extract facts"), F.col("text")).alias("cache_key"))


@query("SELECT CAST(doc_id AS VARCHAR) AS name, octet_length(encode(text)) AS n_bytes, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def log_fingerprint(spark, d):
    return rt.fingerprint(load(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("name"), "text"), "name", "text")


@query("SELECT session_id, CAST(sum(regexp_extract(lower(content), '(\\d+) minutes', 1)::BIGINT) AS BIGINT) AS minutes FROM (SELECT DISTINCT turn_id, session_id, content FROM turns) WHERE regexp_matches(lower(content), '\\d+ minutes') GROUP BY 1")
def multi_session_sum(spark, d):
    t = load(spark, d, "turns").select("turn_id", "session_id", "content").distinct().where(F.lower("content").rlike(r"\d+ minutes"))
    return t.groupBy("session_id").agg(F.sum(F.regexp_extract(F.lower("content"), r"(\d+) minutes", 1).cast("bigint")).alias("minutes"))


_UNITS = ", ".join(f"('{w}', '{family}', '{unit}')" for family, units in rt.UNITS.items() for unit, words in units.items() for w in words)
_AMOUNT, _NUMBER = (r.replace("'", "''") for r in (rt.AMOUNT, rt.NUMBER))


@query(f"""WITH t AS (SELECT DISTINCT turn_id AS id, namespace, session_id, content FROM turns UNION ALL SELECT DISTINCT doc_id, namespace, NULL, text FROM documents),
m AS (SELECT namespace, session_id, unnest(regexp_extract_all(lower(content), '{_AMOUNT}')) AS m FROM t),
x AS (SELECT namespace, session_id, regexp_extract(m, '{_NUMBER}', 1) AS x, regexp_extract(m, '[a-z]+$') AS w FROM m), u(w, family, unit) AS (VALUES {_UNITS})
SELECT namespace, family, unit, count(*) AS n_amounts, count(DISTINCT session_id) AS n_sessions, round(sum(CAST(replace(x, ',', '') AS DOUBLE)), 6) AS total FROM x JOIN u USING (w) WHERE x <> '' GROUP BY ALL""")
def measure_sum(spark, d):
    t = load(spark, d, "turns").select(F.col("turn_id").alias("id"), "namespace", "session_id", "content").distinct()
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("id"), "namespace", F.lit(None).cast("string").alias("session_id"), F.col("text").alias("content")).distinct()
    return rt.measure_sum(t.unionByName(docs), "namespace", "session_id", "content")


@query("SELECT c_mktsegment, n_name, round(sum(c_acctbal), 2) AS cell FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def table_lookup_all(spark, d):
    c, n = load(spark, d, "customer"), load(spark, d, "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("c_mktsegment", "n_name").agg(F.round(F.sum("c_acctbal"), 2).alias("cell"))


@query("SELECT turn_id, CAST(floor(length(content) / 4) AS BIGINT) AS n_tokens FROM (SELECT DISTINCT turn_id, content FROM turns WHERE content IS NOT NULL)")
def approx_tokens(spark, d):
    t = load(spark, d, "turns").where("content IS NOT NULL").select("turn_id", "content").distinct()
    return t.select("turn_id", content.approx_tokens(F.col("content")).alias("n_tokens"))
