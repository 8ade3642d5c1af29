"""Content-addressed records and their texts: hashes, audits, cache keys, sentences, chunks, quantities, types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of the memory types, in the order they are tried, and abbreviations that end no sentence.
RESOURCE_MODALITIES = ["pdf", "image", "audio", "video", "binary"]
VAULT = r"(?i)\b(password|passcode|api[\s_-]?key|secret\s*key|ssn|social security|credit\s*card|account\s*(number|no)|routing\s*number|pin\b|private\s*key|access\s*token)\b"
CORE = r"(?i)\b(i (prefer|like|love|hate|enjoy|favou?rite)|my favou?rite|i'?m allergic|i (always|usually|never)|please (always|never)|call me)\b"
PROCEDURAL = r"(?i)\b(how to|step\s*\d|first\b.*\bthen\b|procedure|instructions?|recipe|to (install|configure|set ?up|deploy|build))\b"
ABBREVIATIONS = ["Dr", "Mr", "Ms", "St", "Jr", "Sr", "Mrs", "Prof", "Mt", "vs", "no", "No"]
TYPE_ORDER = ["resource", "knowledge_vault", "core", "procedural", "semantic", "episodic"]
SEPARATOR = "\u001f"


def cas_put(existing_hashes: DataFrame, incoming: DataFrame, content: str) -> DataFrame:
    """(content_hash, raw_uri, n_copies) of contents that aren't stored yet, one row per distinct content."""
    h = incoming.where(F.col(content).isNotNull()).groupBy(F.sha2(F.col(content), 256).alias("content_hash")).agg(F.count("*").alias("n_copies"))
    new = h.join(existing_hashes.select("content_hash"), "content_hash", "left_anti")
    return new.select("content_hash", F.concat(F.lit("cas://"), "content_hash").alias("raw_uri"), "n_copies")


def snap_back_audit(records: DataFrame, content: str, stored_hash: str, least: int = 1, first: int = 20) -> DataFrame:
    """(total, lossless, passed, failures): passed if each of at least `least` records hashes to its stored hash.

    At most `first` failing hashes are listed, least first.
    """
    ok = F.coalesce(F.sha2(F.col(content), 256) == F.col(stored_hash), F.lit(False))
    d = records.select(ok.alias("ok"), F.col(stored_hash).alias("h"))
    bad = d.where("NOT ok AND h IS NOT NULL").select("h").distinct().orderBy("h").limit(first).agg(F.array_join(F.array_sort(F.collect_list("h")), ",").alias("failures"))
    t = d.agg(F.count("*").alias("total"), F.count_if("ok").alias("lossless"))
    return t.crossJoin(bad).select("total", "lossless", ((F.col("total") >= least) & (F.col("total") == F.col("lossless"))).alias("passed"), "failures")  # one row each


def cache_key(*parts: Column) -> Column:
    """sha256 of the parts put together with the unit separator."""
    return F.sha2(F.concat_ws(SEPARATOR, *parts), 256)


def cache_get(cache: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (model, dim, key) with vec: the newest entry of the key, a miss (NULL) where model or dim differ."""
    newest = cache.groupBy("model", "dim", F.col("cache_key").alias("key")).agg(F.max_by("vec", F.struct("updated_at", "vec_id")).alias("vec"))
    return wanted.join(newest, ["model", "dim", "key"], "left")


def sentences(c: Column) -> Column:
    """Sentences: split after . ! ? and white space, but not after abbreviations and single capitals."""
    keep = "".join(rf"(?<!\b{a}\.)" for a in ABBREVIATIONS)
    parts = F.split(F.trim(F.regexp_replace(c, r"\x{a0}", " ")), rf"(?<=[.!?]){keep}(?<!\b[A-Z]\.)\s+")
    # A lambda of one argument: transform would give a second one, the position, to trim.
    return F.filter(F.transform(parts, lambda x: F.btrim(x, F.lit(" \t\n\r\f"))), lambda x: x != "")


def chunks(df: DataFrame, key: str, text: str, budget: int) -> DataFrame:
    """(key, chunk, n_sentences, n_chars): consecutive sentences packed by the running length before them, budget a chunk.

    budget 0 leaves each text whole. A chunk is at most one sentence longer than its budget.
    """
    s = df.select(key, F.posexplode(sentences(F.col(text))).alias("pos", "s")).withColumn("n", F.length("s"))
    if budget <= 0:
        return s.groupBy(key).agg(F.lit(0).cast("bigint").alias("chunk"), F.count("*").alias("n_sentences"), F.sum("n").alias("n_chars")).select(key, "chunk", "n_sentences", "n_chars")
    from pyspark.sql import Window

    before = F.sum("n").over(Window.partitionBy(key).orderBy("pos")) - F.col("n")
    return s.withColumn("chunk", F.floor(before / budget)).groupBy(key, "chunk").agg(F.count("*").alias("n_sentences"), F.sum("n").alias("n_chars"))


def memory_type(text: Column, modality: Column, consolidated: Column) -> Column:
    return (
        F.when(F.lower(modality).isin(RESOURCE_MODALITIES), "resource")
        .when(text.rlike(VAULT), "knowledge_vault")
        .when(text.rlike(CORE), "core")
        .when(text.rlike(PROCEDURAL), "procedural")
        .when(consolidated, "semantic")
        .otherwise("episodic")
    )


def quantities(c: Column) -> Column:
    """Numbers with their decimals, money sign and unit word; a full stop ends a number unless a digit follows."""
    return F.regexp_extract_all(c, F.lit(r"[$€£]?\d+(?:\.\d+)?(?: (?:million|billion|thousand))?(?: [a-z]+)?"), F.lit(0))


def approx_tokens(c: Column) -> Column:
    return F.floor(F.length(c) / 4)


def relative_phrases(c: Column) -> Column:
    """Phrases of a lower-case text that relative_date knows."""
    return F.regexp_extract_all(c, F.lit(r"\b(\d+ days? ago|\d+ weeks? ago|a fortnight ago|in \d+ days?|next month|next week)\b"), F.lit(1))


def relative_date(phrase: Column, anchor: Column) -> Column:
    """Date a relative phrase means, seen from the anchor; NULL for an unknown phrase."""
    n = F.regexp_extract(phrase, r"^(?:in )?(\d+) ", 1)
    num = F.when(n != "", n).otherwise("0").cast("int")
    return (
        F.when(phrase.rlike(r"^\d+ days? ago$"), F.date_sub(anchor, num))
        .when(phrase.rlike(r"^\d+ weeks? ago$"), F.date_sub(anchor, num * 7))
        .when(phrase == "a fortnight ago", F.date_sub(anchor, 14))
        .when(phrase.rlike(r"^in \d+ days?$"), F.date_add(anchor, num))
        .when(phrase == "next month", F.add_months(anchor, 1))
        .when(phrase == "next week", F.date_add(anchor, 7))
    )


def decay_rate(importance: Column, base: float = 0.1, mu: float = 1.0) -> Column:
    """Rate of forgetting: the more important, the slower."""
    return base * F.exp(-mu * F.greatest(F.lit(0.0), importance))


def half_life(lam: Column, beta: float = 1.0) -> Column:
    """Time until half of the strength is left; infinite for a rate of 0 or less."""
    return F.when(lam <= 0, F.lit(float("inf"))).otherwise(F.pow(F.log(F.lit(2.0)) / lam, F.lit(1.0 / beta)))


def reinforce(v: Column, dv: float, n: Column, most: float) -> Column:
    """Strength after an access: a step towards 1 that shrinks with the accesses before, 1 at most."""
    return F.least(F.lit(1.0), v + dv * (1 - v) * F.exp(-n / max(1e-9, most)))


def review_stability(importance: Column, surprise: Column) -> Column:
    """Days of stability of a new memory; this library's choice: 2 to 20 by importance and surprise."""
    return 2 + 9 * (importance + surprise)


def retrievability(days: Column, stability: Column) -> Column:
    """Power curve of forgetting: 1 at once, 0.9 after stability days, falling towards 0."""
    return 1 / (1 + F.greatest(F.lit(0.0), days) / (9 * stability))


def review(stability: Column, days: Column, importance: Column, lapsed: Column) -> Column:
    """Stability after a recall: more the longer it was unused if confirmed, half of it if it lapsed."""
    return F.when(lapsed, stability / 2).otherwise(stability * (1 + (0.5 + importance) * (1 - retrievability(days, stability)) + 0.1))


def retention(v0: Column, age: Column, lam: float, beta: float = 1.0, tau: float = 0.0) -> Column:
    """Stretched-exponential retention after an age; ages below tau count as 0."""
    return v0 * F.exp(-lam * F.pow(F.greatest(F.lit(0.0), age - tau), F.lit(beta)))
