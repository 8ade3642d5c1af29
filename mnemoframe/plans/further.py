"""Registered queries of answers, proofs, confidence, upkeep and windows, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemoframe.operators import answers as an, content, evaluation as ev, graph, ranking, reports as rp, retrieval as rt, temporal as tp
from mnemoframe.plans.core import _FACT, _LOG, _TRIPLES, ORACLES, query, run_log, triples
from mnemoframe.plans.retrieval import measure_sum, records
from mnemoframe.tables import load

_ANSWERS = "WITH a AS (SELECT DISTINCT answer_id, sample_id, answer, abstained, error, e2e_ms, correct, extra FROM answers), s AS (SELECT DISTINCT sample_id, question, gold FROM samples), j AS (SELECT * FROM a JOIN s USING (sample_id))"
_OP = "CASE WHEN regexp_matches(lower(question), '\\b(how much|total)\\b') THEN 'multi_session_sum' WHEN regexp_matches(lower(question), '\\bhow (many|often)\\b') THEN 'count_aggregate' WHEN regexp_matches(lower(question), '\\bhow long\\b') THEN 'temporal_delta' ELSE 'latest_value' END"


def asked(spark, d):
    """Distinct answers with the question and gold of their sample."""
    a = load(spark, d, "answers").select("answer_id", "sample_id", "answer", "abstained", "error", "e2e_ms", "correct", "extra").distinct()
    return a.join(load(spark, d, "samples").select("sample_id", "question", "gold").distinct(), "sample_id")


@query(_ANSWERS + f""", f AS (SELECT answer_id, trim(coalesce(answer, '')) AS t, {_OP} AS op FROM j)
SELECT answer_id, op, (t = '' OR NOT ((contains(t, ',') AND regexp_matches(t, '(^|[ ,])[A-Z][a-z]+: ')) OR
 (regexp_matches(t, '(?i)^(i|it|he|she|they|we|you)(''(m|s|re|ve|d|ll))?\\b') AND NOT regexp_matches(t, '"|“|[0-9]| [A-Z][a-z]+'))))
 AND (t = '' OR op = 'latest_value' OR regexp_matches(t, '[0-9]') OR regexp_matches(lower(t), '\\b(zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)\\b')) AS credible FROM f""")
def answer_form(spark, d):
    op = an.question_op(F.col("question"))
    return asked(spark, d).select("answer_id", op.alias("op"), an.form_credible(F.col("answer"), op).alias("credible"))


@query(_ANSWERS + f""", f AS (SELECT answer IS NOT NULL AND NOT coalesce(abstained, false) AND error IS NULL AS answered, coalesce(extra.verified, false) AS v, {_OP} AS op FROM j)
SELECT op, count(*) AS n, count(*) FILTER (v AND op NOT IN ('count_aggregate', 'multi_session_sum')) AS verified, count(*) FILTER (answered AND op IN ('count_aggregate', 'multi_session_sum')) AS abstaining FROM f GROUP BY 1""")
def fail_closed(spark, d):
    answered = F.col("answer").isNotNull() & ~F.coalesce("abstained", F.lit(False)) & F.col("error").isNull()
    op = an.question_op(F.col("question"))
    verified, status = an.fail_closed(answered, F.col("extra.verified"), op)
    return asked(spark, d).select(op.alias("op"), verified.alias("v"), status.alias("s")).groupBy("op").agg(F.count("*").alias("n"), F.count_if("v").alias("verified"), F.count_if(F.expr("s = 'abstain'")).alias("abstaining"))


@query(_ANSWERS + """ SELECT answer_id, regexp_matches(lower(answer), '(^|[^\\p{L}\\p{N}])\\Q' || lower(gold) || '\\E($|[^\\p{L}\\p{N}])') AS stated FROM j WHERE answer IS NOT NULL AND trim(gold) <> ''""")
def phrase_stated(spark, d):
    """Whether an answer states the gold between boundaries."""
    j = asked(spark, d).where("answer IS NOT NULL AND trim(gold) <> ''")
    return j.select("answer_id", an.states_phrase(F.col("answer"), F.col("gold")).alias("stated"))


@query("""SELECT doc_id, trim(regexp_extract(text, '\\bis ((?:\\b(?:Dr|Mr|Ms|St|Jr|Sr|Mrs|Prof|Mt|vs|no|No|[A-Z])\\.|[^.!?\\n])+)', 1)) AS value FROM documents WHERE regexp_matches(text, '\\bis ((?:\\b(?:Dr|Mr|Ms|St|Jr|Sr|Mrs|Prof|Mt|vs|no|No|[A-Z])\\.|[^.!?\\n])+)')
AND trim(regexp_extract(text, '\\bis ((?:\\b(?:Dr|Mr|Ms|St|Jr|Sr|Mrs|Prof|Mt|vs|no|No|[A-Z])\\.|[^.!?\\n])+)', 1)) <> ''""")
def copular_value(spark, d):
    return load(spark, d, "documents").select("doc_id", an.copular_value(F.col("text")).alias("value")).where("value IS NOT NULL")


@query("""WITH p AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(trim(replace(text, chr(160), ' ')), '\\b(Dr|Mr|Ms|St|Jr|Sr|Mrs|Prof|Mt|vs|no|No|[A-Z])\\.', '\\1' || chr(1), 'g'), '([.!?])\\s+', '\\1' || chr(2), 'g'), chr(2)) AS parts FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, list_filter(list_transform(parts, lambda x: trim(replace(x, chr(1), '.'), E' \\t\\n\\r')), lambda x: x <> '') AS parts FROM p)
SELECT doc_id, len(parts) AS n, sha256(array_to_string(parts, '|')) AS digest FROM s""")
def sentence_digest(spark, d):
    """Sentences of each text as one hash: the same split by marking titles first, without lookbehind, in SQL."""
    s = load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.transform(content.sentences(F.col("text")), lambda x: F.btrim(x, F.lit(" \t\n\r"))).alias("parts"))
    return s.select("doc_id", F.size("parts").alias("n"), F.sha2(F.array_join("parts", "|"), 256).alias("digest"))


_KINDS = """CASE WHEN lower(modality) IN ('pdf', 'image', 'audio', 'video', 'binary') THEN 'resource'
WHEN regexp_matches(lower(text), '\\b(password|passcode|api[\\s_-]?key|secret\\s*key|ssn|social security|credit\\s*card|account\\s*(number|no)|routing\\s*number|pin|private\\s*key|access\\s*token)\\b') THEN 'knowledge_vault'
WHEN regexp_matches(lower(text), '\\b(i (prefer|like|love|hate|enjoy|favou?rite)|my favou?rite|i''?m allergic|i (always|usually|never)|please (always|never)|call me)\\b') THEN 'core'
WHEN regexp_matches(lower(text), '\\b(how to|step\\s*[0-9]|first\\b[^\\n]*\\bthen|procedure|instructions?|recipe|to (install|configure|set ?up|deploy|build))\\b') THEN 'procedural'
WHEN valid_at IS NOT NULL THEN 'semantic' ELSE 'episodic' END"""


@query(f"SELECT {_KINDS} AS kind, count(*) AS n, count(DISTINCT namespace) AS n_namespaces FROM documents GROUP BY 1")
def memory_type_counts(spark, d):
    """Counts of the memory types, against the patterns written out once more."""
    kind = content.memory_type(F.col("text"), F.col("modality"), F.col("valid_at").isNotNull())
    return load(spark, d, "documents").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("namespace").alias("n_namespaces"))


# --- citations and proofs ---------------------------------------------------------------------------------------------

_CITES = """WITH c AS (SELECT DISTINCT sample_id, gold, unnest(session_ids) AS session_id FROM samples WHERE gold IS NOT NULL AND trim(gold) <> ''),
h AS (SELECT session_id, sha256(array_to_string(list_sort(list_distinct(list(sha256(content)))), chr(10))) AS content_hash FROM turns WHERE content IS NOT NULL GROUP BY 1),
g AS (SELECT DISTINCT sample_id, c.session_id FROM c JOIN turns t ON t.session_id = c.session_id AND contains(lower(content), lower(gold)) AND regexp_matches(lower(content), '(^|[^\\p{L}\\p{N}])\\Q' || lower(gold) || '\\E($|[^\\p{L}\\p{N}])')),
e AS (SELECT DISTINCT c.sample_id, c.session_id, content_hash, g.session_id IS NOT NULL AS grounded FROM c LEFT JOIN h USING (session_id) LEFT JOIN g ON g.sample_id = c.sample_id AND g.session_id = c.session_id)"""


def claims(spark, d):
    s = load(spark, d, "samples").where("gold IS NOT NULL AND trim(gold) <> ''")
    return s.select("sample_id", F.col("session_ids").alias("memories"), F.col("gold").alias("value")).distinct()


def citations(spark, d):
    return an.cite(claims(spark, d), load(spark, d, "turns"), "sample_id", "session_id", "content")


@query(_CITES + " SELECT sample_id, session_id, content_hash FROM e WHERE grounded")
def grounded_citations(spark, d):
    return citations(spark, d).where("grounded").select("sample_id", "session_id", "content_hash")


@query(_CITES + """, p AS (SELECT DISTINCT sample_id FROM samples WHERE gold IS NOT NULL AND trim(gold) <> '') SELECT sample_id, count(*) FILTER (grounded) AS grounded_count, count(e.session_id) AS evidence_count,
count(e.session_id) > 0 AND count(e.session_id) = count(content_hash) AS complete, round(CASE WHEN count(e.session_id) = 0 THEN 0 ELSE count(content_hash) / count(e.session_id) END, 6) AS completeness, min(e.session_id) AS first_memory FROM p LEFT JOIN e USING (sample_id) GROUP BY 1""")
def proof_tree(spark, d):
    t = an.proof_trees(citations(spark, d), claims(spark, d), "sample_id", "session_id")
    return t.select("sample_id", "grounded_count", "evidence_count", "complete", F.round("completeness", 6).alias("completeness"), F.get_json_object("proof", "$.evidence[0].memory_id").alias("first_memory"))


@query(_CITES + """, m AS (SELECT sample_id, count(content_hash) / count(*) AS proof FROM e GROUP BY 1), log AS (SELECT DISTINCT answer_id, sample_id, extra, error FROM answers)
SELECT answer_id, round(((extra.confidence > 0)::INT + (extra.coverage > 0)::INT + coalesce(extra.verified, false)::INT) / 3, 6) AS agreement, round(0.4 * extra.confidence + 0.2 * greatest(0, least(1, extra.coverage))
 + 0.2 * ((extra.confidence > 0)::INT + (extra.coverage > 0)::INT + coalesce(extra.verified, false)::INT) / 3 + 0.2 * coalesce(proof, 0), 6) AS confidence FROM log LEFT JOIN m USING (sample_id) WHERE error IS NULL AND extra.confidence IS NOT NULL AND extra.coverage IS NOT NULL""")
def combined_confidence(spark, d):
    """Entailment, coverage, agreement of three signals and completeness of the proof."""
    proofs = an.proof_trees(citations(spark, d), claims(spark, d), "sample_id", "session_id").select("sample_id", "completeness")
    log = run_log(spark, d).where("error IS NULL AND extra.confidence IS NOT NULL AND extra.coverage IS NOT NULL").join(proofs, "sample_id", "left")
    agree = an.agreement(F.col("extra.confidence"), F.col("extra.coverage"), F.coalesce("extra.verified", F.lit(False)).cast("double"))
    total = an.combined_confidence(F.col("extra.confidence"), F.col("extra.coverage"), agree, F.coalesce("completeness", F.lit(0.0)))
    return log.select("answer_id", F.round(agree, 6).alias("agreement"), F.round(total, 6).alias("confidence"))


@query("""WITH s AS (SELECT DISTINCT sample_id, dataset, question, session_ids FROM samples), k AS (SELECT DISTINCT session_id FROM turns WHERE content IS NOT NULL),
r AS (SELECT s.*, regexp_matches(lower(question), 'how (many|much)|total|weight|number of|\\bcount\\b') AS numeric_q, len(list_filter(session_ids, lambda x: x IN (SELECT session_id FROM k))) AS n FROM s)
SELECT dataset, count(*) AS n_samples, count(*) FILTER (numeric_q) AS n_numeric, round(avg((n > 0)::INT), 6) AS resolved FROM (SELECT sample_id, dataset, coalesce(numeric_q, false) AS numeric_q, coalesce((SELECT count(*) FROM k WHERE list_contains(session_ids, session_id)), 0) AS n FROM r) GROUP BY 1""".replace(", len(list_filter(session_ids, lambda x: x IN (SELECT session_id FROM k))) AS n", ""))
def store_probes(spark, d):
    """Numeric questions, and the share of samples with a citation that resolves to stored content."""
    s = load(spark, d, "samples").select("sample_id", "dataset", "question", "session_ids").distinct()
    stored = load(spark, d, "turns").where("content IS NOT NULL").select("session_id").distinct()
    found = s.select("sample_id", F.explode("session_ids").alias("session_id")).join(stored, "session_id", "left_semi").select("sample_id").distinct().withColumn("ok", F.lit(1))
    numeric = F.coalesce(F.lower("question").rlike(r"how (many|much)|total|weight|number of|\bcount\b"), F.lit(False))
    return s.join(found, "sample_id", "left").groupBy("dataset").agg(F.count("*").alias("n_samples"), F.count_if(numeric).alias("n_numeric"), F.round(F.avg(F.coalesce("ok", F.lit(0))), 6).alias("resolved"))


@query("""WITH c AS (SELECT DISTINCT sample_id, unnest(session_ids) AS session_id FROM samples), o AS (SELECT session_id FROM sessions GROUP BY 1 HAVING min(created_at) <= TIMESTAMP '2025-01-01'),
t AS (SELECT DISTINCT turn_id, session_id, turn_no, content FROM turns WHERE content IS NOT NULL)
SELECT sample_id, count(*) AS n_turns, sha256(string_agg(content, chr(10) ORDER BY session_id, turn_no, turn_id)) AS context_hash FROM c JOIN o USING (session_id) JOIN t USING (session_id) GROUP BY 1""")
def full_context(spark, d):
    """All turns of the sessions of a sample that were there at an instant, in order: the full-context baseline. A sample names few sessions."""
    c = load(spark, d, "samples").select("sample_id", F.explode("session_ids").alias("session_id")).distinct()
    there = load(spark, d, "sessions").groupBy("session_id").agg(F.min("created_at").alias("at")).where("at <= TIMESTAMP_NTZ '2025-01-01 00:00:00'").select("session_id")
    t = load(spark, d, "turns").where("content IS NOT NULL").select("turn_id", "session_id", "turn_no", "content").distinct()
    g = c.join(there, "session_id").join(t, "session_id").groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("session_id", "turn_no", "turn_id", "content"))).alias("x"))
    return g.select("sample_id", F.size("x").cast("bigint").alias("n_turns"), F.sha2(F.array_join(F.col("x.content"), "\n"), 256).alias("context_hash"))


# --- questions, errors and misses -------------------------------------------------------------------------------------


@query("""SELECT DISTINCT sample_id, CAST(round(greatest(0.80, least(0.98, 0.9 + CASE WHEN len(list_filter(regexp_split_to_array(trim(question), '\\s+'), lambda x: x <> '')) <= 2 THEN 0.04 WHEN regexp_matches(lower(question), '\\b(now|today|currently|yesterday|before|after|when)\\b') THEN 0.03
WHEN len(list_filter(regexp_split_to_array(trim(question), '\\s+'), lambda x: x <> '')) >= 12 THEN -0.04 ELSE 0 END)), 4) AS DOUBLE) AS threshold FROM samples WHERE question IS NOT NULL""")
def cache_threshold(spark, d):
    s = load(spark, d, "samples").where("question IS NOT NULL").select("sample_id", "question").distinct()
    return s.select("sample_id", F.round(an.cache_threshold(F.col("question")), 4).alias("threshold"))


@query("""WITH q AS (SELECT DISTINCT sample_id, question, least(15, len(list_filter(regexp_split_to_array(trim(question), '\\s+'), lambda x: x <> ''))) AS n, len(regexp_extract_all(lower(question), '\\b(and|both|before|after|then|between)\\b')) AS k FROM samples WHERE question IS NOT NULL)
SELECT sample_id, CAST(ceil(3 + 7 * round(least(1.0, 0.04 * n + 0.1 * k)::DOUBLE, 6)) AS INT) AS depth FROM q""")
def adaptive_depth(spark, d):
    s = load(spark, d, "samples").where("question IS NOT NULL").select("sample_id", "question").distinct()
    return s.select("sample_id", an.adaptive_depth(F.col("question")).alias("depth"))


@query("SELECT system, CASE WHEN regexp_matches(lower(error), 'quota|exhausted') THEN 'quota_exhausted' WHEN regexp_matches(lower(error), 'bad_model|model.*not exist|unknown model') THEN 'bad_model_id' WHEN regexp_matches(lower(error), 'api key|unauthori[sz]ed|\\b401\\b') THEN 'auth' ELSE 'error' END AS error_class, count(DISTINCT answer_id) AS n FROM answers WHERE error IS NOT NULL GROUP BY ALL")
def error_classes(spark, d):
    a = load(spark, d, "answers").where("error IS NOT NULL")
    return a.groupBy("system", an.error_class(F.col("error")).alias("error_class")).agg(F.countDistinct("answer_id").alias("n"))


@query(_ANSWERS + """, m AS (SELECT coalesce(answer, '') AS p, coalesce(gold, '') AS g, coalesce(abstained, false) AS ab, e2e_ms FROM j WHERE NOT coalesce(correct, false) AND error IS NULL)
SELECT CASE WHEN regexp_matches(p, '^\\s*the week(end)? of \\d{4}-\\d{2}-\\d{2}') THEN 'week_window' WHEN (contains(g, ',') OR contains(g, ' and ')) AND p <> '' AND NOT contains(p, ',') AND NOT contains(lower(p), ' and ') THEN 'partial_list' WHEN ab AND e2e_ms > 3000 AND NOT isnan(e2e_ms) THEN 'abstained_late' ELSE '' END AS shape, count(*) AS n FROM m GROUP BY 1""")
def miss_shapes(spark, d):
    m = asked(spark, d).where("NOT coalesce(correct, false) AND error IS NULL")
    shape = an.miss_shape(F.col("question"), F.coalesce("gold", F.lit("")), F.coalesce("answer", F.lit("")), F.coalesce("abstained", F.lit(False)), F.nanvl("e2e_ms", F.lit(None).cast("double")))
    return m.groupBy(shape.alias("shape")).agg(F.count("*").alias("n"))


@query(_LOG + ", r AS (SELECT dataset, answer_id, row_number() OVER (PARTITION BY dataset ORDER BY 1 - extra.confidence DESC NULLS LAST, answer_id) AS rank FROM log WHERE error IS NULL) SELECT dataset, answer_id, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10")
def repair_targets(spark, d):
    log = run_log(spark, d).where("error IS NULL").withColumn("anomaly", 1 - F.col("extra.confidence"))
    return an.first_by_anomaly(log, "dataset", "anomaly", "answer_id", 10)


@query(_LOG + """ SELECT system, count(*) AS n, count(*) FILTER (coalesce(extra.verified, false)) AS verified, count(*) FILTER (coalesce(abstained, false)) AS abstained, bool_or(extra.verified IS NOT NULL OR coalesce(abstained, false)) AS has_verify FROM log WHERE error IS NULL GROUP BY 1""")
def verify_presence(spark, d):
    """Whether a system's log shows verification at all: a verified mark, or an abstention."""
    verified, gone = F.coalesce("extra.verified", F.lit(False)), F.coalesce("abstained", F.lit(False))
    return run_log(spark, d).where("error IS NULL").groupBy("system").agg(F.count("*").alias("n"), F.count_if(verified).alias("verified"), F.count_if(gone).alias("abstained"), F.bool_or(F.col("extra.verified").isNotNull() | gone).alias("has_verify"))


@query("WITH g AS (SELECT DISTINCT sample_id, list_distinct(regexp_extract_all(lower(gold), '[a-z0-9]+')) AS g FROM samples WHERE gold IS NOT NULL), a AS (SELECT DISTINCT answer_id, sample_id, list_distinct(regexp_extract_all(lower(answer), '[a-z0-9]+')) AS p FROM answers WHERE answer IS NOT NULL), j AS (SELECT answer_id, len(list_intersect(g, p)) AS hit, len(g) AS ng, len(p) AS np FROM a JOIN g USING (sample_id)) SELECT answer_id, round(CASE WHEN np = 0 THEN 0 ELSE hit / np END, 6) AS precision, round(CASE WHEN ng = 0 THEN 0 ELSE hit / ng END, 6) AS recall FROM j")
def extraction_precision(spark, d):
    token = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    g = load(spark, d, "samples").where("gold IS NOT NULL").select("sample_id", token("gold").alias("g")).distinct()
    a = load(spark, d, "answers").where("answer IS NOT NULL").select("answer_id", "sample_id", token("answer").alias("p")).distinct()
    hit = F.size(F.array_intersect("g", "p"))
    return a.join(g, "sample_id").select("answer_id", F.round(ev.share(hit, F.size("p")), 6).alias("precision"), F.round(ev.share(hit, F.size("g")), 6).alias("recall"))


@query(_LOG + """, s AS (SELECT dataset, answer_id, extra.coverage AS c, row_number() OVER (PARTITION BY dataset ORDER BY 1 - extra.coverage, answer_id) AS r, count(*) OVER (PARTITION BY dataset) AS n FROM log WHERE extra.coverage IS NOT NULL AND NOT isnan(extra.coverage)),
q AS (SELECT dataset, max(1 - (1 - c)) FILTER (r = ceil((n + 1)::DOUBLE * 0.9::DOUBLE)) AS cut FROM s GROUP BY 1) SELECT dataset, count(*) FILTER (cut IS NULL OR c >= cut) AS n_kept, count(*) AS n FROM s JOIN q USING (dataset) GROUP BY 1""")
def conformal_kept(spark, d):
    """Answers at or above the calibrated cut-off of their dataset; without one all are kept."""
    log = run_log(spark, d).withColumn("sim", F.col("extra.coverage")).where("sim IS NOT NULL AND NOT isnan(sim)")
    cut = ev.conformal_cutoff(log, "dataset", "sim").select("dataset", "cutoff")
    return log.join(cut, "dataset").groupBy("dataset").agg(F.count_if(F.col("cutoff").isNull() | (F.col("sim") >= F.col("cutoff"))).alias("n_kept"), F.count("*").alias("n"))


# --- facts, windows and measures --------------------------------------------------------------------------------------


@query("""SELECT user_id, event_type, count(*) FILTER (ts >= TIMESTAMP '2024-01-13') AS past_week, count(*) FILTER (ts >= TIMESTAMP '2024-01-06') AS fortnight, count(*) FILTER (ts >= TIMESTAMP '2023-12-21') AS past_30_days, count(*) FILTER (ts >= TIMESTAMP '2023-10-22') AS past_few_months,
round(coalesce(sum(value) FILTER (ts >= TIMESTAMP '2024-01-13'), 0), 4) AS week_total FROM events WHERE ts <= TIMESTAMP '2024-01-20' AND ts >= TIMESTAMP '2023-10-22' GROUP BY ALL""")
def count_windows(spark, d):
    """All windows before an anchor in one pass."""
    return tp.window_counts(load(spark, d, "events"), _FACT, "ts", "value", F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'"), {"past_week": 7, "fortnight": 14, "past_30_days": 30, "past_few_months": 90}).withColumnRenamed("past_week_total", "week_total").withColumn("week_total", F.round("week_total", 4)).select("user_id", "event_type", "past_week", "fortnight", "past_30_days", "past_few_months", "week_total")


@query("""WITH m AS (SELECT id, day, unnest(regexp_extract_all(t, '\\b(\\d+ days? ago|\\d+ weeks? ago|a fortnight ago|in \\d+ days?|next month|next week)\\b')) AS phrase FROM (SELECT DISTINCT turn_id AS id, CAST(ingested_at AS DATE) AS day, lower(content) AS t FROM turns WHERE content IS NOT NULL)), n AS (SELECT *, CAST(coalesce(nullif(regexp_extract(phrase, '(\\d+)', 1), ''), '0') AS INT) AS k FROM m)
SELECT id AS turn_id, phrase, CAST(CAST(CASE WHEN phrase LIKE '% day_ ago' OR phrase LIKE '% day ago' THEN day - k WHEN phrase LIKE '%week%ago' THEN day - 7 * k WHEN phrase LIKE '%fortnight%' THEN day - 14 WHEN phrase LIKE 'in %' THEN day + k WHEN phrase = 'next month' THEN CAST(day + INTERVAL 1 MONTH AS DATE) ELSE day + 7 END AS DATE) AS VARCHAR) AS resolved FROM n""")
def relative_mentions(spark, d):
    """Relative phrases that turns say, as dates seen from the day of the turn."""
    t = load(spark, d, "turns").where("content IS NOT NULL").select(F.col("turn_id"), F.to_date("ingested_at").alias("day"), F.lower("content").alias("t")).distinct()
    m = t.select("turn_id", "day", F.explode(content.relative_phrases(F.col("t"))).alias("phrase"))
    return m.select("turn_id", "phrase", content.relative_date(F.col("phrase"), F.col("day")).cast("string").alias("resolved"))


@query("""WITH f AS (SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings), cur AS (SELECT label, embedding AS ev, vec_id AS et FROM f WHERE r = 1)
SELECT f.vec_id, CASE WHEN coalesce(list_cosine_similarity(embedding::DOUBLE[], ev::DOUBLE[]) >= 0.97, false) THEN 'NOOP' WHEN coalesce(list_cosine_similarity(embedding::DOUBLE[], ev::DOUBLE[]) < 0.0, false) THEN 'DELETE_TOMBSTONE' WHEN f.vec_id < et THEN 'ADD' ELSE 'UPDATE' END AS op FROM f JOIN cur USING (label)""")
def merge_near(spark, d):
    """Writes against the first vector of their label: the same by cosine, opposed, or newer."""
    e = load(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("vec")).withColumn("value", F.col("vec_id") + 0.5)
    first = e.groupBy("label").agg(F.min_by(F.struct("vec", "vec_id"), "vec_id").alias("f")).select("label", F.col("f.vec").alias("vec"), F.col("f.vec_id").alias("vec_id"), F.lit(-1.0).alias("value"))
    opposed = e.join(first.select("label", F.col("vec").alias("fv")), "label").withColumn("opposed", ranking.cosine(F.col("vec"), F.col("fv")) < 0).drop("fv")
    return tp.classify_writes(opposed, first, ["label"], "value", "vec_id", vec="vec", contradicts="opposed").select("vec_id", "op")


@query("""SELECT event_id, round(0.1 * exp(-greatest(0, value / 100)), 9) AS rate, round(ln(2) / (0.1 * exp(-greatest(0, value / 100))), 6) AS half_life, round(least(1.0, least(1, value / 100) + 0.3 * (1 - least(1, value / 100)) * exp(-(event_id % 10) / 5)), 6) AS reinforced FROM events WHERE value IS NOT NULL""")
def decay_family(spark, d):
    v = F.col("value") / 100
    rate = content.decay_rate(v)
    e = load(spark, d, "events").where("value IS NOT NULL")
    return e.select("event_id", F.round(rate, 9).alias("rate"), F.round(content.half_life(rate), 6).alias("half_life"), F.round(content.reinforce(F.least(F.lit(1.0), v), 0.3, F.col("event_id") % 10, 5), 6).alias("reinforced"))


@query("""WITH s AS (SELECT event_id, 2 + 9 * (least(1, value / 100) + 0.5) AS s, datediff('day', CAST(ts AS DATE), DATE '2025-01-01') AS t, event_type = 'error' AS lapsed, least(1, value / 100) AS i FROM events WHERE ts < TIMESTAMP '2025-01-01'), r AS (SELECT *, 1 / (1 + greatest(0, t) / (9 * s)) AS r FROM s)
SELECT event_id, round(s, 6) AS stability, round(r, 6) AS retrievability, round(CASE WHEN lapsed THEN s / 2 ELSE s * (1 + (0.5 + i) * (1 - r) + 0.1) END, 6) AS reviewed FROM r""")
def review_states(spark, d):
    """Stability and retrievability of each memory, and its stability after a recall that confirms it or lapses."""
    e = load(spark, d, "events").where("ts < TIMESTAMP_NTZ '2025-01-01 00:00:00'")
    importance, days = F.least(F.lit(1.0), F.col("value") / 100), F.datediff(F.expr("DATE '2025-01-01'"), F.to_date("ts"))
    s = content.review_stability(importance, F.lit(0.5))
    return e.select("event_id", F.round(s, 6).alias("stability"), F.round(content.retrievability(days, s), 6).alias("retrievability"), F.round(content.review(s, days, importance, F.col("event_type") == "error"), 6).alias("reviewed"))


@query(f"""SELECT namespace, family, regexp_replace(CAST(CAST(total AS DECIMAL(18,2)) AS VARCHAR), '\\.0+$|(\\.[0-9]*?)0+$', '\\1') || ' ' || CASE WHEN total = 1 THEN unit WHEN unit = 'foot' THEN 'feet' ELSE unit || 's' END AS label FROM ({ORACLES['measure_sum']})""")
def measure_labels(spark, d):
    """Sums of measure_sum as they are said."""
    return measure_sum(spark, d).select("namespace", "family", an.measure_label(F.col("total"), F.col("unit")).alias("label"))


@query("""WITH g AS (SELECT event_type AS namespace, user_id AS id, least(1.0, 0.3 * count(*))::DOUBLE AS activation, min(ts) AS first_seen FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY activation DESC, first_seen DESC, id DESC) AS r FROM g)
SELECT namespace, id, round(activation, 6) AS activation FROM r WHERE r <= 64""")
def activation_capped(spark, d):
    """The 64 most active of each namespace; of equals the earliest goes first."""
    from mnemoframe.streaming.activation import evict

    g = load(spark, d, "events").groupBy(F.col("event_type").alias("namespace"), F.col("user_id").alias("id")).agg(F.least(F.lit(1.0), 0.3 * F.count("*")).alias("activation"), F.min("ts").alias("first_seen"))
    return evict(g, "namespace", "activation", ["first_seen", "id"], 64).select("namespace", "id", F.round("activation", 6).alias("activation"))


# --- ranking and graph ------------------------------------------------------------------------------------------------


@query(f"""WITH k AS (SELECT namespace, doc_id, {_KINDS} AS kind, (regexp_matches(lower(text), '\\boven\\b'))::INT + (regexp_matches(lower(text), '\\bwebhook\\b'))::INT AS hits, row_number() OVER (PARTITION BY namespace ORDER BY created_at DESC NULLS LAST, doc_id) AS age FROM documents WHERE namespace IS NOT NULL),
f AS (SELECT namespace, doc_id, hits / 2 AS lexical, CASE WHEN age <= 5 THEN 0.4 ELSE 0 END AS active, coalesce(0.3 / nullif(list_position(['procedural', 'semantic', 'episodic'], kind), 0), 0) AS prior FROM k WHERE hits > 0 OR age <= 5),
r AS (SELECT namespace, doc_id, round(lexical + active + prior, 6) AS score, row_number() OVER (PARTITION BY namespace ORDER BY round(lexical + active + prior, 6) DESC, doc_id) AS rank FROM f) SELECT namespace, doc_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10""")
def hybrid_recall(spark, d):
    """Lexical hits, an activation channel that surfaces what no word asks for, and a prior by memory type for a procedural question."""
    docs = load(spark, d, "documents").where("namespace IS NOT NULL")
    hits = rt.reflex_recall(rt.reflex_postings(docs, "namespace", "doc_id", "text"), "namespace", "doc_id", ["oven", "webhook"], 2**31 - 1)
    newest = ranking.top_per_group(docs.select("namespace", "doc_id", "created_at"), ["namespace"], [F.col("created_at").desc_nulls_last(), F.col("doc_id")], 5)
    channels = hits.select("namespace", "doc_id", F.col("coverage").alias("score")).unionByName(newest.select("namespace", "doc_id", F.lit(0.4).alias("score")))
    place = rp.type_rank(content.memory_type(F.col("text"), F.col("modality"), F.col("valid_at").isNotNull()), "procedural")
    fused = ranking.with_priors(channels.groupBy("namespace", "doc_id").agg(F.sum("score").alias("score")), docs.select("namespace", "doc_id", place.alias("place")), ["namespace", "doc_id"], 0.3)
    return ranking.top_per_group(fused, ["namespace"], [F.col("score").desc(), F.col("doc_id")], 10).select("namespace", "doc_id", "score", "rank")


_SCORES = "WITH s AS (SELECT l_suppkey AS item, b AS budget, avg(l_quantity) FILTER (l_linenumber <= b) AS score FROM lineitem, (VALUES (1), (3), (7)) t(b) GROUP BY ALL)"


@query(_SCORES + """, r1 AS (SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, item) AS r, count(*) OVER () AS n FROM s WHERE budget = 1), k1 AS (SELECT * FROM r1 WHERE r <= ceil(n / 3)),
r2 AS (SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, item) AS r, count(*) OVER () AS n FROM s WHERE budget = 3 AND item IN (SELECT item FROM k1)), k2 AS (SELECT * FROM r2 WHERE r <= ceil(n / 3)),
r3 AS (SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, item) AS r, count(*) OVER () AS n FROM s WHERE budget = 7 AND item IN (SELECT item FROM k2)), a AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3)
SELECT CAST(budget AS INT) AS budget, n AS n_in, CAST(ceil(n / 3) AS BIGINT) AS n_out, item AS survivor, round(score, 6) AS score FROM a WHERE r = 1""")
def asha_rungs(spark, d):
    """Suppliers as trials: the more of an order's lines a rung may look at, the fewer are left."""
    l = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("item"), "l_quantity", "l_linenumber", F.explode(F.array(F.lit(1), F.lit(3), F.lit(7))).alias("budget"))
    s = l.groupBy("item", "budget").agg(F.avg(F.when(F.col("l_linenumber") <= F.col("budget"), F.col("l_quantity"))).alias("score"))
    return ranking.successive_halving(s, "item", "budget", "score", [1, 3, 7]).withColumn("score", F.round("score", 6))


@query("""WITH e AS (SELECT vec_id AS a, (vec_id * 7 + 3) % (SELECT count(*) + 50 FROM embeddings) AS b FROM embeddings) SELECT a, b, round(CASE WHEN y.embedding IS NULL THEN 0.5 ELSE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) END, 5) AS coherence,
round(0.5 * (1 - CASE WHEN y.embedding IS NULL THEN 0.5 ELSE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) END) / 2 + 0.5 * (1 - 1 / (1 + abs(a - b))), 5) AS anomaly FROM e JOIN embeddings x ON x.vec_id = a LEFT JOIN embeddings y ON y.vec_id = b""")
def edge_anomaly(spark, d):
    """Edges between vectors, some of which aren't there: incoherence blended with an implausibility of the edge."""
    v = load(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    n = v.count() + 50
    e = v.select(F.col("vec_id").alias("a"), ((F.col("vec_id") * 7 + 3) % n).alias("b"))
    c = graph.edge_coherence(e, v, "a", "b", "vec_id", "vec")
    odd = graph.blend_anomaly([(0.5, (1 - F.col("coherence")) / 2), (0.5, 1 - 1 / (1 + F.abs(F.col("a") - F.col("b"))))])
    return c.select("a", "b", F.round("coherence", 5).alias("coherence"), F.round(odd, 5).alias("anomaly"))


@query(_TRIPLES + """, f AS (SELECT p.x, r3, p.z, max(conf) AS conf, count(DISTINCT r1 || '>' || r2) AS n FROM p JOIN rules USING (r1, r2) WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.h = p.x AND e.r = r3 AND e.t = p.z) GROUP BY ALL)
SELECT r3, count(*) AS n, count(*) FILTER (0.5 * greatest(0, least(1, conf)) + 0.5 * least(1, n / 2) >= 0.6) AS n_admitted FROM f GROUP BY 1""")
def dream_infer(spark, d):
    """Facts that two hops and a rule suggest, admitted by the gate on the rule's confidence and the paths that support it."""
    t = triples(spark, d)
    rules = graph.mine_rules(t)
    new = graph.apply_rules(t, rules)
    paths = graph.two_hop(t, None).select("r1", "r2", "x", "z").distinct().join(rules.select("r1", "r2", "r3"), ["r1", "r2"]).groupBy("x", "r3", "z").agg(F.count("*").alias("n"))
    passed, _, _ = rt.gate(F.col("conf"), F.col("n") / 2, 0.6)
    return new.join(paths, ["x", "r3", "z"]).groupBy("r3").agg(F.count("*").alias("n"), F.count_if(passed).alias("n_admitted"))


@query("""WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0), m AS (SELECT label, i, 1.0::DOUBLE * max(q.v[i])::DOUBLE + 0.6::DOUBLE * coalesce(avg(e.embedding[i]::DOUBLE) FILTER (vec_id % 3 <> 0), 0) - 0.2::DOUBLE * coalesce(avg(e.embedding[i]::DOUBLE) FILTER (vec_id % 3 = 0), 0) AS x FROM embeddings e, q, range(1, 65) t(i) GROUP BY ALL),
n AS (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY label)) AS n FROM m) SELECT label, CAST(i - 1 AS INT) AS pos, round(CASE WHEN n = 0 THEN x ELSE x / n END, 5) AS x FROM n""")
def rocchio_away(spark, d):
    """As rocchio, and away from every third vector of the label."""
    e = load(spark, d, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("_query"))
    j = e.crossJoin(F.broadcast(q))  # one row
    return rt.rocchio(F.col("_query"), j, "label", "embedding", gamma=0.2, relevant=F.col("vec_id") % 3 != 0).withColumn("x", F.round("x", 5))


@query("""WITH u AS (SELECT DISTINCT sample_id, dataset, category FROM samples), r AS (SELECT *, (row_number() OVER (PARTITION BY dataset, category ORDER BY sha256('epoch-1:' || sample_id), sample_id) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY dataset, category) AS place FROM u),
w AS (SELECT *, CAST(floor(round(place, 9) * 4) AS BIGINT) AS win FROM r) SELECT dataset, win, count(*) AS n, count(DISTINCT category) AS n_categories FROM w GROUP BY ALL""")
def holdout_windows(spark, d):
    """Four disjoint windows of the ring of each dataset, with their categories."""
    u = load(spark, d, "samples").select("sample_id", "dataset", "category").distinct()
    w = ev.ring_windows(ev.holdout_ring(u, "sample_id", "category", "epoch-1", within="dataset"), 4)
    return w.groupBy("dataset", "win").agg(F.count("*").alias("n"), F.countDistinct("category").alias("n_categories"))


@query()
def knob_importance(spark, d):
    """Which of system, dataset and category a correct answer depends on."""
    log = run_log(spark, d).where("error IS NULL").withColumn("score", F.coalesce("correct", F.lit(False)).cast("double"))
    return ev.knob_importance(log.withColumn("category", F.lower(F.trim(F.coalesce("category", F.lit("unknown"))))), ["system", "dataset", "category", "run_idx"], "score")


@query("""SELECT namespace, count(DISTINCT session_id) AS n_sessions, count(DISTINCT turn_id) AS n_turns, count(DISTINCT turn_id) FILTER (content IS NULL OR trim(content) = '') AS n_empty, count(DISTINCT turn_id) FILTER (turn_time IS NULL) AS n_deferred, max(ingested_at) AS last_ingested FROM turns GROUP BY 1""")
def consolidation_counters(spark, d):
    """What consolidation finds per namespace: processed, empty, deferred for want of a time."""
    t = load(spark, d, "turns")
    once = lambda c: F.countDistinct(F.when(c, F.col("turn_id")))
    return t.groupBy("namespace").agg(F.countDistinct("session_id").alias("n_sessions"), F.countDistinct("turn_id").alias("n_turns"), once(F.col("content").isNull() | (F.trim("content") == "")).alias("n_empty"), once(F.col("turn_time").isNull()).alias("n_deferred"), F.max("ingested_at").alias("last_ingested"))


@query("""WITH newest AS (SELECT sha256('reader-1' || chr(31) || 'extract facts' || chr(31) || text) AS key, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL AND modality IS NOT NULL GROUP BY 1)
SELECT count(*) AS n_asked, count(n.key) AS n_hits, count(DISTINCT n.key) AS n_entries FROM documents d LEFT JOIN newest n ON n.key = sha256('reader-1' || chr(31) || 'extract facts' || chr(31) || text) WHERE text IS NOT NULL AND d.doc_id % 2 = 0""")
def extract_cache_get(spark, d):
    """Cached extractions under their key, asked for by every second document."""
    docs = load(spark, d, "documents").where("text IS NOT NULL").withColumn("key", content.cache_key(F.lit("reader-1"), F.lit("extract facts"), F.col("text")))
    cache = docs.where("modality IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("hit"))
    return docs.where("doc_id % 2 = 0").join(cache, "key", "left").agg(F.count("*").alias("n_asked"), F.count("hit").alias("n_hits"), F.countDistinct(F.when(F.col("hit").isNotNull(), F.col("key"))).alias("n_entries"))


@query("""SELECT coalesce(namespace, '') AS namespace, count(*) AS memories, count(*) FILTER (NOT regexp_matches(coalesce(text, ''), '[a-z,;] [A-Z][a-z]+')) AS orphans, round(count(*) FILTER (NOT regexp_matches(coalesce(text, ''), '[a-z,;] [A-Z][a-z]+')) / count(*), 6) AS orphan_rate FROM documents GROUP BY 1""")
def orphan_rate(spark, d):
    """Memories without a named entity, per namespace."""
    orphan = ~F.coalesce("text", F.lit("")).rlike(r"[a-z,;] [A-Z][a-z]+")
    g = load(spark, d, "documents").groupBy(F.coalesce("namespace", F.lit("")).alias("namespace")).agg(F.count("*").alias("memories"), F.count_if(orphan).alias("orphans"))
    return g.withColumn("orphan_rate", F.round(F.col("orphans") / F.col("memories"), 6))
