"""Evaluation of run logs: rollups, taxonomies, intervals, paired tests, calibration and splits."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.959964


def share(numerator: Column, denominator: Column) -> Column:
    """Quotient, 0 where the denominator is 0."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(numerator / denominator)


def integrity_rollup(log: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts of answers without error: verified and correct, abstained, answered, answered without verification."""
    ok = log.where("error IS NULL")
    verified, abstained = F.coalesce("extra.verified", F.lit(False)), F.coalesce("abstained", F.lit(False))
    return ok.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(verified & F.coalesce("correct", F.lit(False))).alias("verified_correct"),
        F.count_if(abstained).alias("abstained"),
        F.count_if(~abstained).alias("answered"),
        F.count_if(~abstained & ~verified).alias("unverified_answered"),
    )


def miss_bucket() -> Column:
    """First that applies: error, abstained, verified-wrong, unverified-wrong; NULL for a correct answer."""
    return (
        F.when(F.col("error").isNotNull(), "error")
        .when(F.coalesce("abstained", F.lit(False)), "abstained")
        .when(F.coalesce("correct", F.lit(False)), None)
        .when(F.coalesce("extra.verified", F.lit(False)), "verified_wrong")
        .otherwise("unverified_wrong")
    )


def forensics_bucket(coverage: float = 0.8) -> Column:
    """Another taxonomy of misses: infra, abstention, reader_error (verified or well covered), retrieval_miss."""
    covered = F.coalesce("extra.verified", F.lit(False)) | (F.coalesce("extra.coverage", F.lit(0.0)) >= coverage)
    return F.when(F.col("error").isNotNull(), "infra").when(F.coalesce("abstained", F.lit(False)), "abstention").when(F.coalesce("correct", F.lit(False)), None).when(covered, "reader_error").otherwise("retrieval_miss")


def pivot_counts(df: DataFrame, row: str, bucket: Column, values: Sequence[str]) -> DataFrame:
    """Counts of row by bucket with a fixed list of columns, zero where there is none; no pass to find the values."""
    return df.withColumn("_b", bucket).where("_b IS NOT NULL").groupBy(row).pivot("_b", list(values)).count().fillna(0)


def rolling_totals(log: DataFrame, window: str, system: str) -> DataFrame:
    """Per window and system, and per system over all windows (window NULL), in one pass over grouping sets."""
    return log.where("error IS NULL").groupingSets([[window, system], [system]], window, system).agg(
        F.count("*").alias("n"),
        F.count_if(F.coalesce("correct", F.lit(False))).alias("n_correct"),
        F.count_if(F.coalesce("extra.verified", F.lit(False))).alias("n_verified"),
        F.round(F.percentile("query_tokens", 0.5), 6).alias("med_tokens"),
    )


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of k of n."""
    p, z2 = k / n, z * z
    middle, spread = (p + z2 / (2 * n)) / (1 + z2 / n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return middle - spread, middle + spread


def mcnemar_p(a: Column, b: Column) -> Column:
    """Two-sided exact p of a against b discordant pairs: twice the binomial tail at one half, at most 1."""
    n, m = a + b, F.least(a, b)
    # log C(n, i) as a running sum, so that large n neither overflow nor underflow; one exp per term.
    start = F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.exp(-n * F.log(F.lit(2.0))).alias("sum"))
    step = lambda acc, i: F.struct((acc["term"] + F.log((n - i + 1).cast("double") / i)).alias("term"), (acc["sum"] + F.exp(acc["term"] + F.log((n - i + 1).cast("double") / i))).alias("sum"))
    tail = F.aggregate(F.when(m > 0, F.sequence(F.lit(1).cast("bigint"), m)).otherwise(F.array().cast("array<bigint>")), start, step)
    return F.least(F.lit(1.0), 2 * tail["sum"])


def paired_outcomes(log: DataFrame, unit: Sequence[str], system: str, a: str, b: str, by: Sequence[str]) -> DataFrame:
    """Discordant and concordant counts of systems a and b on the same units, unpaired units, and the exact p."""
    won = lambda s: F.max(F.when(F.col(system) == s, F.coalesce("correct", F.lit(False)).cast("int")))
    u = log.where((F.col("error").isNull()) & F.col(system).isin(a, b)).groupBy(*by, *unit).agg(won(a).alias("a"), won(b).alias("b"))
    g = u.groupBy(*by).agg(
        F.count_if(F.expr("a = 1 AND b = 1")).alias("both"),
        F.count_if(F.expr("a = 1 AND b = 0")).alias("a_only"),
        F.count_if(F.expr("a = 0 AND b = 1")).alias("b_only"),
        F.count_if(F.expr("a IS NULL OR b IS NULL")).alias("unpaired"),
    )
    return g.withColumn("p", F.round(mcnemar_p(F.col("a_only"), F.col("b_only")), 6))


def age_curves(log: DataFrame, by: str, age: str, correct: str, latency: str, bins: int = 8) -> DataFrame:
    """Mean correctness and p95 latency over equal-width age bins, and the slopes over the bin centres."""
    ok = log.where(f"error IS NULL AND {age} IS NOT NULL AND NOT isnan({age})")
    span = ok.groupBy(by).agg(F.min(age).alias("lo"), F.max(age).alias("hi"))
    width = (F.col("hi") + 1e-9 - F.col("lo")) / bins
    b = ok.join(span, by).withColumn("bin", F.floor((F.col(age) - F.col("lo")) / width)).withColumn("centre", F.col("lo") + (F.col("bin") + 0.5) * width)
    usable = F.when(~F.isnan(latency), F.col(latency))
    g = b.groupBy(by, "bin", "centre").agg(F.avg(F.coalesce(correct, F.lit(False)).cast("double")).alias("recall"), F.percentile(usable, 0.95).alias("p95"))
    return g.groupBy(by).agg(F.count("*").alias("n_bins"), F.round(F.regr_slope("recall", "centre"), 8).alias("recall_slope"), F.round(F.regr_slope("p95", "centre"), 4).alias("latency_slope"))


def sha1_mod100(c: Column) -> Column:
    """int(sha1(text), 16) % 100, folded over eight hex digits at a time."""
    digest, step = F.sha1(c), pow(16, 8, 100)
    part = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") % 100
    out = part(0)
    for i in range(1, 5):
        out = (out * step + part(i)) % 100
    return out


def split_of(c: Column, dev_percent: int = 20) -> Column:
    return F.when(sha1_mod100(c) < dev_percent, "dev").otherwise("test")


def holdout_ring(df: DataFrame, unit: str, category: str, epoch: str, within: str | None = None) -> DataFrame:
    """Ring position of each unit: a fixed permutation per epoch in which every stretch holds all categories evenly.

    Units are ranked by hash within their category (of each `within`) and lie at rank / size of the category. A category
    is ranked in one task, by a sort that spills.
    """
    h = F.sha2(F.concat_ws(":", F.lit(epoch), unit), 256)
    by = [c for c in (within, category) if c]
    w = Window.partitionBy(*by)
    ranked = df.select(unit, *by, h.alias("h")).withColumn("rank", F.row_number().over(w.orderBy("h", unit)))
    return ranked.withColumn("place", F.round((F.col("rank") - 0.5) / F.count("*").over(w), 9)).select(unit, *by, "rank", "place")


def ring_windows(ring: DataFrame, n: int) -> DataFrame:
    """ring with win, 0 to n - 1: disjoint windows of about equal size, each with all categories in proportion."""
    if n < 1:
        raise ValueError("at least one window is needed")
    return ring.withColumn("win", F.least(F.lit(n - 1).cast("bigint"), F.floor(F.col("place") * n)))


def draw_window(ring: DataFrame, size: int, drawn: int, epoch: int = 0) -> tuple[int, int, bool]:
    """(epoch, window, rollover) of the draw after `drawn` earlier ones of so many units each.

    An epoch gives its windows once; the next epoch, with another permutation, follows. More units than the ring has is
    an error.
    """
    n = ring.count()
    if not 0 < size <= n:
        raise ValueError(f"a window of {size} exceeds the {n} units of the ring")
    per_epoch = n // size
    return epoch + drawn // per_epoch, drawn % per_epoch, drawn > 0 and drawn % per_epoch == 0


def knob_importance(trials: DataFrame, knobs: Sequence[str], score: str, lam: float = 0.05, levels: int = 64, rounds: int = 200) -> DataFrame:
    """(knob, importance): greatest absolute Lasso coefficient over the one-hot levels of each knob.

    Spark sums the moments of the levels in one pass over counts per combination; the coordinate descent then sees one
    small matrix. A knob may have at most `levels` levels; more is an error. NULL is a level.
    """
    g = trials.groupBy(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in knobs]).agg(F.count("*").alias("n"), F.sum(score).alias("s"))
    found = [(k, r[0]) for k in knobs for r in g.select(k).distinct().orderBy(k).limit(levels + 1).collect()]
    for k in knobs:
        if sum(name == k for name, _ in found) > levels:
            raise ValueError(f"{k} has more than {levels} levels")
    spark = trials.sparkSession
    on = [(F.col(k) == v).cast("double") for k, v in found]
    p = len(on)
    sums = [F.sum("n"), F.sum("s"), *[F.sum(F.col("n") * x) for x in on], *[F.sum(F.col("s") * x) for x in on], *[F.sum(F.col("n") * x * y) for i, x in enumerate(on) for y in on[: i + 1]]]
    row = [float(x or 0.0) for x in g.agg(*[x.alias(f"m{i}") for i, x in enumerate(sums)]).first()]
    n = row[0]
    if n == 0:
        return spark.createDataFrame([(k, 0.0) for k in knobs], "knob string, importance double")
    mean, with_score = np.array(row[2 : 2 + p]) / n, np.array(row[2 + p : 2 + 2 * p]) / n
    both = np.zeros((p, p))
    both[np.tril_indices(p)] = np.array(row[2 + 2 * p :]) / n
    both = both + np.tril(both, -1).T
    dev = np.sqrt(np.maximum(mean * (1 - mean), 0))
    dev[dev == 0] = 1.0
    cov, rho = (both - np.outer(mean, mean)) / np.outer(dev, dev), (with_score - mean * row[1] / n) / dev
    w = np.zeros(p)
    for _ in range(rounds):
        before = w.copy()
        for j in range(p):
            z = rho[j] - cov[j] @ w + cov[j, j] * w[j]
            w[j] = np.sign(z) * max(0.0, abs(z) - lam) / (cov[j, j] or 1.0)
        if np.abs(w - before).max() < 1e-6:
            break
    return spark.createDataFrame([(k, round(max(float(abs(x)) for x, (name, _) in zip(w, found) if name == k), 6)) for k in knobs], "knob string, importance double")


def pick_tau(log: DataFrame, by: str, conf: str, correct: str, target: float = 0.95) -> DataFrame:
    """Lowest confidence whose precision among all at least as confident reaches the target, else just above the highest.

    Rows are counted per distinct confidence first; the running totals are then over distinct values only.
    """
    ok = log.where(f"error IS NULL AND NOT coalesce(abstained, false) AND {conf} IS NOT NULL")
    g = ok.groupBy(by, conf).agg(F.count("*").alias("n"), F.count_if(F.coalesce(correct, F.lit(False))).alias("k"))
    w = Window.partitionBy(by).orderBy(F.col(conf).desc())
    run = g.withColumn("cn", F.sum("n").over(w)).withColumn("ck", F.sum("k").over(w))
    meets = F.col("ck") / F.col("cn") >= target
    out = run.groupBy(by).agg(F.min(F.when(meets, F.col(conf))).alias("tau"), F.max(conf).alias("top"), F.sum("n").alias("n"), F.max(F.when(meets, F.col("cn"))).alias("covered"))
    return out.select(by, F.coalesce("tau", F.col("top") + 1e-9).alias("tau"), F.coalesce("covered", F.lit(0)).alias("covered"), "n")


def conformal_cutoff(df: DataFrame, by: str, sim: str, alpha: float = 0.1) -> DataFrame:
    """Split-conformal cut-off: 1 - q, q the ceil((n + 1)(1 - alpha))-th smallest of 1 - similarity; NULL if n is too small."""
    g = df.where(f"{sim} IS NOT NULL AND NOT isnan({sim})").withColumn("_s", 1 - F.col(sim))
    w = Window.partitionBy(by)
    r = g.withColumn("rank", F.row_number().over(w.orderBy("_s"))).withColumn("n", F.count("*").over(w))
    wanted = F.ceil((F.col("n") + 1).cast("double") * F.lit(1.0 - alpha))
    return r.groupBy(by).agg(F.max("n").alias("n"), F.max(F.when(F.col("rank") == wanted, F.col("_s"))).alias("qhat")).withColumn("cutoff", 1 - F.col("qhat"))


def vote(answers: DataFrame, by: Sequence[str], text: str, confidence: str, first: str, least: int = 2) -> DataFrame:
    """Winning answer by votes, then summed confidence, then first seen; NULL without consensus of at least `least` votes."""
    norm = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    g = answers.withColumn("_a", norm).groupBy(*by, "_a").agg(F.count("*").alias("votes"), F.sum(confidence).alias("conf"), F.min(first).alias("seen"))
    # Confidences are summed in no fixed order; rounding keeps ties ties.
    best = F.max_by(F.struct(F.col("_a").alias("answer"), "votes"), F.struct("votes", F.round("conf", 6), -F.col("seen")))
    out = g.groupBy(*by).agg(best.alias("b"), F.sum("votes").alias("total"))
    return out.select(*by, F.when(F.col("b.votes") >= least, F.col("b.answer")).alias("answer"), F.col("b.votes").alias("votes"), F.round(F.col("b.votes") / F.col("total"), 6).alias("support"))
