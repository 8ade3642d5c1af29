"""Bi-temporal facts: validity, point-in-time reads, history, windows and folds.

Facts are append-only rows (subject keys, valid_at, serial); nothing is updated. Validity ends where the next fact of the
same subject begins, so late and concurrent writes need no order of arrival.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_validity(facts: DataFrame, keys: Sequence[str], valid_at: str, serial: str) -> DataFrame:
    """facts with invalid_at (start of the next fact of the keys, NULL for the current one) and is_current.

    Ties in valid_at go by serial, so that of several facts of one instant only the last is ever valid.
    """
    w = Window.partitionBy(*keys).orderBy(valid_at, serial)
    nxt = F.lead(valid_at).over(w)
    return facts.withColumn("invalid_at", nxt).withColumn("is_current", F.col("invalid_at").isNull())


def active_at(history: DataFrame, valid_at: str, t: Column) -> DataFrame:
    """Rows of a history valid at t: valid_at <= t < invalid_at."""
    return history.where((F.col(valid_at) <= t) & (F.col("invalid_at").isNull() | (t < F.col("invalid_at"))))


def latest_value(facts: DataFrame, keys: Sequence[str], value: str, valid_at: str, serial: str, as_of: Column) -> DataFrame:
    """Newest value of the keys as of an instant, with the number of superseded facts; one partial aggregate, one shuffle.

    Facts of the future don't count; a key with none before as_of has no row. A fact without valid_at is an error.
    """
    dated = F.when(F.col(valid_at).isNull(), F.raise_error(F.lit(f"fact without {valid_at}"))).otherwise(F.lit(True))
    facts = facts.where(F.col(valid_at).isNull() | (F.col(valid_at) <= as_of)).where(dated)
    newest = F.max_by(F.struct(value, valid_at), F.struct(valid_at, serial))
    g = facts.groupBy(*keys).agg(newest.alias("_n"), (F.count("*") - 1).alias("n_superseded"))
    return g.select(*keys, F.col(f"_n.{value}").alias(value), F.col(f"_n.{valid_at}").alias("valid_at"), "n_superseded")


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, value: str, serial: str) -> DataFrame:
    """left with the right value of the newest right row not after it: union, one sort per key, last value carried on.

    One shuffle of both sides on the keys, instead of a join of every pair that a range condition would make.
    """
    l = left.select(*keys, F.col(left_time).alias("_t"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_side"), F.lit(None).cast("bigint").alias("_s"))
    r = right.select(*keys, F.col(right_time).alias("_t"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"), F.lit(0).alias("_side"), F.col(serial).cast("bigint").alias("_s"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side", "_s").rowsBetween(Window.unboundedPreceding, 0)
    return l.unionByName(r).withColumn("asof_value", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select("_row.*", "asof_value")


def interval_join(probes: DataFrame, history: DataFrame, keys: Sequence[str], probe_time: str, valid_at: str) -> DataFrame:
    """Every probe with the facts of its keys that are valid at its time: equi-join on the keys, interval as a residual."""
    inside = (F.col(valid_at) <= F.col(probe_time)) & (F.col("invalid_at").isNull() | (F.col(probe_time) < F.col("invalid_at")))
    return probes.join(history, list(keys)).where(inside)


def window_rollup(facts: DataFrame, keys: Sequence[str], valid_at: str, value: str, anchor: Column, days: int) -> DataFrame:
    """Count, sum and distinct-day count of the facts in the days before the anchor, both ends included."""
    start = anchor - F.expr(f"INTERVAL {days} DAYS")
    inside = facts.where((F.col(valid_at) >= start) & (F.col(valid_at) <= anchor))
    return inside.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.countDistinct(F.to_date(valid_at)).alias("n_days"))


def window_counts(facts: DataFrame, keys: Sequence[str], valid_at: str, value: str, anchor: Column, windows: dict[str, int]) -> DataFrame:
    """Per window name its count, and name_total, the sum of value, of the facts in so many days before the anchor, in one pass."""
    widest = max(windows.values())
    inside = facts.where((F.col(valid_at) <= anchor) & (F.col(valid_at) >= anchor - F.expr(f"INTERVAL {widest} DAYS")))
    within = {n: F.col(valid_at) >= anchor - F.expr(f"INTERVAL {days} DAYS") for n, days in windows.items()}
    totals = [F.coalesce(F.sum(F.when(w, F.col(value))), F.lit(0.0)).alias(f"{n}_total") for n, w in within.items()]
    return inside.groupBy(*keys).agg(*[F.count_if(w).alias(n) for n, w in within.items()], *totals)


def first_occurrence_order(facts: DataFrame, key: str, name: str, valid_at: str, serial: str) -> DataFrame:
    """Names in the order of their first occurrence per key, joined by '>'. Only one entry a name is collected."""
    first = facts.groupBy(key, name).agg(F.min(F.struct(valid_at, serial)).alias("at"))
    listed = F.array_sort(F.collect_list(F.struct("at", name)))
    return first.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x[name]), ">").alias("sequence"))


def day_delta(facts: DataFrame, key: str, name: str, valid_at: str, a: str, b: str) -> DataFrame:
    """Absolute days between the first a and the first b of a key; NULL where one is missing or the day is the same."""
    first = lambda n: F.min(F.when(F.col(name) == n, F.to_date(valid_at)))
    g = facts.groupBy(key).agg(first(a).alias("_a"), first(b).alias("_b"))
    return g.select(key, F.nullif(F.abs(F.datediff("_b", "_a")), F.lit(0)).alias("delta_days"))


def polarity_status(facts: DataFrame, subjects: DataFrame, keys: Sequence[str], polarity: Column, valid_at: str, serial: str) -> DataFrame:
    """Status of each proposition: the last polarity by time ('asserted', 'negated' or 'retracted'), or 'absent'."""
    last = facts.groupBy(*keys).agg(F.max_by(polarity, F.struct(valid_at, serial)).alias("status"))
    return subjects.join(last, list(keys), "left").withColumn("status", F.coalesce("status", F.lit("absent")))


def fold_revisions(revisions: DataFrame, key: str, at: Sequence[str], scalars: Sequence[str], counted: str) -> DataFrame:
    """State of a chain of immutable revisions: later non-NULL scalars override, and distinct entries are counted."""
    order = F.struct(*at)
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in scalars]
    return revisions.groupBy(key).agg(*latest, F.countDistinct(counted).alias("n_entries"), F.count("*").alias("n_revisions"))


def classify_writes(incoming: DataFrame, existing: DataFrame, keys: Sequence[str], value: str, valid_at: str, vec: str | None = None, contradicts: str | None = None, near: float = 0.97) -> DataFrame:
    """Kind of each incoming fact against the current one: NOOP, ADD (new, or older history), UPDATE or DELETE_TOMBSTONE.

    existing has one row per key. A NULL value retracts. With vec, a column of both, a fact whose vector has a cosine of
    near or more to the current one's is the same fact; with contradicts, a boolean column of incoming, a fact that
    contradicts the current one ends it.
    """
    from mnemoframe.operators.ranking import cosine

    known = [F.col(vec).alias("_ex")] if vec else []
    e = existing.select(*keys, F.col(value).alias("_ev"), F.col(valid_at).alias("_et"), F.lit(True).alias("_known"), *known)
    j = incoming.join(e, list(keys), "left")
    same = F.col(value) == F.col("_ev")
    if vec:
        same = same | F.coalesce(cosine(F.col(vec), F.col("_ex")) >= near, F.lit(False))
    against = F.coalesce(contradicts, F.lit(False)) if contradicts else F.lit(False)
    op = (
        F.when(F.col("_known").isNull(), "ADD")
        .when(F.col(value).isNull(), "DELETE_TOMBSTONE")
        .when(same, "NOOP")
        .when(against, "DELETE_TOMBSTONE")
        .when(F.col(valid_at) < F.col("_et"), "ADD")
        .otherwise("UPDATE")
    )
    return j.withColumn("op", op).drop("_ev", "_et", "_known", "_ex")
