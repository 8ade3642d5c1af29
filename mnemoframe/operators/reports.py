"""Reports over stores and run logs: verification, splits, calibration, health, flips, recall paths, fronts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.operators.evaluation import pick_tau, share, split_of
from mnemoframe.operators.ranking import pareto_front
from mnemoframe.session import cut_lineage

# Memory types by class of query, most wanted first; an unknown class means default.
TYPE_PRIORITY = {
    "preference": ["core", "semantic", "episodic"],
    "procedural": ["procedural", "semantic", "episodic"],
    "factual": ["semantic", "episodic", "core"],
    "temporal": ["episodic", "semantic"],
    "default": ["semantic", "episodic", "core", "procedural", "resource", "knowledge_vault"],
}
SPLITS = ["all", "dev", "test"]


def cas_verify(records: DataFrame, content: str) -> DataFrame:
    """(content_hash, n_refs, verified) of a content-addressed store: each hash must stand for one content only.

    NULL contents aren't stored. Both counts are taken before the exchange, on hashes and not on texts.
    """
    h = records.where(F.col(content).isNotNull()).select(F.sha2(content, 256).alias("content_hash"), F.xxhash64(content).alias("x"), F.length(content).alias("n"))
    return h.groupBy("content_hash").agg(F.count("*").alias("n_refs"), ((F.min("x") == F.max("x")) & (F.min("n") == F.max("n"))).alias("verified"))


def split_filter(df: DataFrame, unit: str, split: str | None) -> DataFrame:
    """Rows of one split by the hash of the unit; None and all keep every row, an unknown split is an error."""
    if split not in (None, *SPLITS):
        raise ValueError(f"unknown split: {split}")
    return df if split in (None, "all") else df.where(split_of(F.col(unit)) == split)


def type_rank(memory_type: Column, query_class: str) -> Column:
    """Place of a memory type in the order of a class of query, from 1; NULL for a type that isn't in it."""
    order = TYPE_PRIORITY.get(query_class, TYPE_PRIORITY["default"])
    return F.nullif(F.array_position(F.array(*[F.lit(t) for t in order]), memory_type), F.lit(0).cast("bigint"))


def calibrate_tau(log: DataFrame, unit: str, by: str, conf: str, correct: str, target: float) -> DataFrame:
    """(by, tau, n, covered, precision_at_tau, coverage_at_tau) on the dev split, without unanswerable questions.

    Confidences are NULL-free after the filter; with no threshold that reaches the target, nothing is covered and the
    precision is NULL.
    """
    dev = split_filter(log.where("coalesce(category, '') <> 'unanswerable'"), unit, "dev")
    tau = pick_tau(dev, by, conf, correct, target)
    ok = dev.where(f"error IS NULL AND NOT coalesce(abstained, false) AND {conf} IS NOT NULL")
    # One row a system: joined back without moving the log where it is small enough for the optimizer.
    hit = ok.join(tau.select(by, "tau"), by).where(F.col(conf) >= F.col("tau")).groupBy(by).agg(F.avg(F.coalesce(correct, F.lit(False)).cast("int")).alias("p"))
    return tau.join(hit, by, "left").select(by, "tau", "n", "covered", F.round("p", 6).alias("precision_at_tau"), F.round(share(F.col("covered"), F.col("n")), 6).alias("coverage_at_tau"))


def flips(log: DataFrame, unit: Sequence[str], system: str, a: str, b: str, by: str) -> DataFrame:
    """(by, gained, regressed, unpaired): units that b has right and a wrong, the other way round, and in one run only."""
    won = lambda s: F.max(F.when(F.col(system) == s, F.coalesce("correct", F.lit(False)).cast("int")))
    u = log.where(F.col("error").isNull() & F.col(system).isin(a, b)).groupBy(by, *unit).agg(won(a).alias("x"), won(b).alias("y"))
    return u.groupBy(by).agg(F.count_if(F.expr("x = 0 AND y = 1")).alias("gained"), F.count_if(F.expr("x = 1 AND y = 0")).alias("regressed"), F.count_if(F.expr("x IS NULL OR y IS NULL")).alias("unpaired"))


def recall_paths(hits: DataFrame, item: str, channel: str) -> DataFrame:
    """(item, paths, n_paths): the channels that surfaced an item, in order of name. Channels are few."""
    g = hits.groupBy(item).agg(F.array_sort(F.collect_set(channel)).alias("c"))
    return g.select(item, F.array_join("c", "+").alias("paths"), F.size("c").alias("n_paths"))


def brain_health(log: DataFrame, facts: DataFrame, records: DataFrame) -> DataFrame:
    """One row of named components in [0, 1] and their mean.

    log (error, abstained, extra, correct), facts (is_current), records (namespace, valid_at, source); every component is
    0 where its table is empty. The weights of the composite are this library's choice: equal.
    """
    gone, verified = F.coalesce("abstained", F.lit(False)), F.coalesce("extra.verified", F.lit(False))
    ok = F.col("error").isNull()
    a = log.agg(F.count("*").alias("n"), F.count_if(ok & ~gone).alias("answered"), F.count_if(ok & ~gone & verified).alias("verified"), F.count_if(ok & ~gone & F.coalesce("correct", F.lit(False))).alias("right"), F.count_if(~ok).alias("bad"))
    f = facts.agg(F.count("*").alias("facts"), F.count_if("is_current").alias("current"))
    r = records.agg(F.count("*").alias("records"), F.count("namespace").alias("scoped"), F.count("valid_at").alias("dated"))
    j = a.crossJoin(f).crossJoin(r)  # one row each
    part = lambda x, n: F.round(share(F.col(x).cast("double"), F.col(n)), 6)
    c = j.select(part("verified", "answered").alias("proof_coverage"), part("right", "answered").alias("accuracy"), part("bad", "n").alias("error_rate"), part("current", "facts").alias("currency"), part("scoped", "records").alias("scoped_rate"), part("dated", "records").alias("dated_rate"))
    total = F.col("proof_coverage") + F.col("accuracy") + (1 - F.col("error_rate")) + F.col("currency") + F.col("scoped_rate") + F.col("dated_rate")
    return c.withColumn("composite", F.round(total / 6, 5))


def pareto_fronts(points: DataFrame, x: str, y: str, first: int) -> DataFrame:
    """points with front, 1 to first: the non-dominated points, those left when they are taken away, and so on.

    Each front is one pass over the points left, which are written between passes. Only the first fronts are asked for.
    """
    left, out = points.where(f"{x} IS NOT NULL AND {y} IS NOT NULL"), None
    for i in range(1, first + 1):
        front = pareto_front(left, x, y).withColumn("front", F.lit(i))
        out = front if out is None else out.unionByName(front)
        if i < first:
            left = cut_lineage(left.join(front.select(x, y).distinct(), [x, y], "left_anti").select(*points.columns))
    return out


def exclusive_percentile(df: DataFrame, by: str, value: str, p: float) -> DataFrame:
    """(by, n, value) by the (n + 1) * p rank, interpolated between neighbours; the greatest of fewer than 1 / (1 - p) values.

    Values are counted once each first, so a rank is found among distinct values. NULL and NaN don't count.
    """
    g = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(by, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(by)
    g = g.withColumn("_upto", F.sum("_c").over(w.orderBy("_v"))).withColumn("_n", F.sum("_c").over(w))
    rank = F.when(F.col("_n") < 1 / (1 - p), F.col("_n").cast("double")).otherwise((F.col("_n") + 1) * F.lit(p))
    at = lambda k: F.min(F.when(F.col("_upto") >= k, F.col("_v")))
    e = g.groupBy(by, "_n").agg(at(F.floor(rank)).alias("_lo"), at(F.ceil(rank)).alias("_hi"), F.max(rank).alias("_k"))
    return e.select(by, F.col("_n").alias("n"), (F.col("_lo") + (F.col("_k") - F.floor("_k")) * (F.col("_hi") - F.col("_lo"))).alias("value"))


def preference_latest(records: DataFrame, text: str, by: Sequence[str], at: str, key: str) -> DataFrame:
    """(by, who, preference, at, n_superseded): newest positive preference that a text states of someone.

    Later statements supersede earlier ones, ties go to the greater key. Someone without a positive one has no row, and
    neither have undated records.
    """
    said = F.explode(F.regexp_extract_all(F.col(text), F.lit(r"\b[A-Z][a-z]+ prefers [a-z ]+"), F.lit(0)))
    m = records.where(F.col(at).isNotNull()).select(*by, at, key, said.alias("_s")).withColumn("_m", F.split("_s", " prefers "))
    p = m.select(*by, at, key, F.col("_m")[0].alias("who"), F.trim(F.col("_m")[1]).alias("_w")).where("_m[1] NOT LIKE 'not %'")
    return p.groupBy(*by, "who").agg(F.max_by("_w", F.struct(at, key, "_w")).alias("preference"), F.max(at).alias(at), (F.countDistinct("_w") - 1).alias("n_superseded"))
