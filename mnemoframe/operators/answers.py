"""Answers and what they rest on: forms, citations and proofs, confidence, depth of retrieval, errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Operations whose answers are numbers, and number words.
NUMERIC_OPS = ["count_aggregate", "multi_session_sum", "temporal_delta"]
NUMBER_WORDS = "zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve"
#: Titles and single capitals whose full stop ends no sentence.
TITLES = r"(?:Dr|Mr|Ms|St|Jr|Sr|Mrs|Prof|Mt|vs|[Nn]o|[A-Z])\."


def question_op(question: Column) -> Column:
    """Class of a question by its words: a sum, a count, a time between two events, or a plain value."""
    q = F.lower(question)
    return (
        F.when(q.rlike(r"\b(how much|total)\b"), "multi_session_sum")
        .when(q.rlike(r"\bhow (many|often)\b"), "count_aggregate")
        .when(q.rlike(r"\bhow long\b"), "temporal_delta")
        .otherwise("latest_value")
    )


def form_credible(answer: Column, op: Column | None = None) -> Column:
    """Whether an answer has the form of one: no filler clause without an anchor, no list with a speaker's header in it.

    Anchors are quotations, digits and names within the text. With op, numeric operations need a number or a number word.
    Empty and NULL answers aren't judged by their form.
    """
    a = F.trim(F.coalesce(answer, F.lit("")))
    header = a.contains(",") & a.rlike(r"(^|[ ,])[A-Z][a-z]+: ")
    filler = a.rlike(r"(?i)^(i|it|he|she|they|we|you)('(m|s|re|ve|d|ll))?\b") & ~a.rlike(r'"|“|\d| [A-Z][a-z]+')
    fine = (a == "") | ~(header | filler)
    if op is None:
        return fine
    number = a.rlike(rf"\d|(?i)\b({NUMBER_WORDS})\b")
    return fine & ((a == "") | ~op.isin(NUMERIC_OPS) | number)


def fail_closed(answered: Column, verified: Column, op: Column) -> tuple[Column, Column]:
    """(verified, status): derived counts and sums are never verified by claims, so in the full path they abstain."""
    derived = op.isin("count_aggregate", "multi_session_sum")
    return F.coalesce(verified, F.lit(False)) & ~derived, F.when(~answered, "absent").when(derived, "abstain").otherwise("answer")


def states_phrase(text: Column, phrase: Column) -> Column:
    """Whether text has the phrase with no letter or digit right before or after it: '90 usd' isn't in '290 usd'."""
    quoted = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), F.lower(phrase), F.lit(r"\E(?![\p{L}\p{N}])"))
    # Few texts have the phrase at all: the pattern, a new one a row, is for those.
    return F.lower(text).contains(F.lower(phrase)) & F.rlike(F.lower(text), quoted)


def copular_value(text: Column) -> Column:
    """What follows the first ' is ' up to the end of its sentence; titles don't end it. NULL where there is none."""
    found = F.regexp_extract(text, rf"\bis ((?:\b{TITLES}|[^.!?\n])+)", 1)
    return F.when(F.trim(found) != "", F.trim(found))


def measure_label(total: Column, unit: Column) -> Column:
    """'70 pounds', '1 pound', '7.5 feet': the number without trailing zeros, the unit in the singular for one."""
    number = F.regexp_replace(total.cast("decimal(18,2)").cast("string"), r"\.0+$|(\.\d*?)0+$", "$1")
    plural = F.when(unit == "foot", "feet").otherwise(F.concat(unit, F.lit("s")))
    return F.concat(number, F.lit(" "), F.when(total == 1, unit).otherwise(plural))


def cite(claims: DataFrame, sources: DataFrame, key: str, memory: str, text: str) -> DataFrame:
    """(key, memory, content_hash, grounded): each cited memory of a claim with its hash, NULL where it isn't stored.

    claims (key, memories, value), sources (memory, text). grounded: a text of the memory states the claim's value.
    """
    c = claims.select(key, F.explode(F.array_distinct("memories")).alias(memory), "value")
    of = sources.where(F.col(text).isNotNull()).select(memory, text)
    known = of.groupBy(memory).agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_set(F.sha2(text, 256)))), 256).alias("content_hash"))
    says = c.join(of, memory).where(states_phrase(F.col(text), F.col("value"))).select(key, memory).distinct().withColumn("grounded", F.lit(True))
    return c.join(known, memory, "left").join(says, [key, memory], "left").select(key, memory, "content_hash", F.coalesce("grounded", F.lit(False)).alias("grounded"))


def proof_trees(citations: DataFrame, claims: DataFrame, key: str, memory: str) -> DataFrame:
    """(key, proof, ...) of each claim (key, value): its evidence in order of memory, as JSON, with the counts it rests on.

    complete: there is evidence and all of it has a hash. completeness: the share that has one, 0 without evidence. A
    claim's citations are few.
    """
    e = F.struct(F.col(memory).alias("memory_id"), "content_hash", "grounded")
    g = citations.groupBy(key).agg(F.array_sort(F.collect_list(e)).alias("evidence"))
    j = claims.select(key, "value").join(g, key, "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(g.schema["evidence"].dataType)))
    hashed = F.size(F.filter("evidence", lambda x: x["content_hash"].isNotNull()))
    grounded = F.size(F.filter("evidence", lambda x: x["grounded"]))
    n = F.size("evidence")
    j = j.select(key, F.col("value").alias("claim"), "evidence", grounded.alias("grounded_count"), n.alias("evidence_count"), ((n > 0) & (hashed == n)).alias("complete"), F.when(n == 0, 0.0).otherwise(hashed / n).alias("completeness"))
    return j.select(key, F.to_json(F.struct("claim", "grounded_count", "evidence_count", "evidence", F.col("complete").alias("provenance_complete"))).alias("proof"), "grounded_count", "evidence_count", "complete", "completeness")


def agreement(*scores: Column) -> Column:
    """Share of the channels that give a positive score."""
    return sum(F.when(s > 0, 1.0).otherwise(0.0) for s in scores) / len(scores)


def combined_confidence(entail: Column, coverage: Column, agree: Column, proof: Column, weights: Sequence[float] = (0.4, 0.2, 0.2, 0.2)) -> Column:
    """Weighted sum of four signals, coverage clipped to [0, 1]; the weights are this library's choice."""
    parts = [entail, F.greatest(F.lit(0.0), F.least(F.lit(1.0), coverage)), agree, proof]
    return sum(w * p for w, p in zip(weights, parts))


def _word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != ""))


def cache_threshold(question: Column, base: float = 0.9) -> Column:
    """Similarity a cached question must have: stricter for short and for time-bound questions, looser for long ones."""
    n, timely = _word_count(question), F.lower(question).rlike(r"\b(now|today|currently|yesterday|before|after|when)\b")
    shift = F.when(n <= 2, 0.04).when(timely, 0.03).when(n >= 12, -0.04).otherwise(0.0)
    return F.greatest(F.lit(0.80), F.least(F.lit(0.98), base + shift))


def difficulty(question: Column) -> Column:
    """Difficulty of a question in [0, 1] by its length and its joining words; the form is this library's choice."""
    joins = F.size(F.regexp_extract_all(F.lower(question), F.lit(r"\b(and|both|before|after|then|between)\b"), F.lit(1)))
    return F.least(F.lit(1.0), 0.04 * F.least(_word_count(question), F.lit(15)) + 0.1 * joins)


def adaptive_depth(question: Column, least: int = 3, most: int = 10) -> Column:
    """How many records to retrieve: from least to most by the question's difficulty."""
    return F.ceil(least + (most - least) * F.round(difficulty(question), 6)).cast("int")


def error_class(error: Column) -> Column:
    """Class of a model's error text; NULL where there is none."""
    e = F.lower(error)
    return (
        F.when(e.isNull(), None)
        .when(e.rlike("quota|exhausted"), "quota_exhausted")
        .when(e.rlike("bad_model|model.*not exist|unknown model"), "bad_model_id")
        .when(e.rlike("api key|unauthori[sz]ed|\\b401\\b"), "auth")
        .otherwise("error")
    )


def miss_shape(question: Column, gold: Column, predicted: Column, abstained: Column, e2e_ms: Column) -> Column:
    """Sub-shape of a miss, the first that fits: week_window, partial_list, abstained_late (over 3 s); else ''."""
    listed = (gold.contains(",") | gold.contains(" and ")) & (predicted != "") & ~predicted.contains(",") & ~F.lower(predicted).contains(" and ")
    return F.when(predicted.rlike(r"^\s*the week(end)? of \d{4}-\d{2}-\d{2}"), "week_window").when(listed, "partial_list").when(abstained & (e2e_ms > 3000), "abstained_late").otherwise("")


def first_by_anomaly(df: DataFrame, group: str, anomaly: str, item: str, k: int) -> DataFrame:
    """(group, item, rank): the k most anomalous of each group; those without a score follow in their own order."""
    from mnemoframe.operators.ranking import top_per_group

    return top_per_group(df, [group], [F.col(anomaly).desc_nulls_last(), F.col(item)], k).select(group, item, "rank")
