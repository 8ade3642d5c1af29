import math
import statistics

import pytest

from mnemoframe.operators import reports as rp
from pyspark.sql import functions as F

LOG = "answer_id bigint, sample_id string, run_idx int, system string, category string, error string, abstained boolean, correct boolean, extra struct<verified: boolean, confidence: double>"


def log(spark, rows):
    names = [c.split(" ")[0] for c in LOG.split(", ")][:8]
    return spark.createDataFrame([(*(r.get(n) for n in names), r.get("extra")) for r in rows], LOG)


def test_cas_verify(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("", None), (None, None), ("b" * 100_000, "")], "text string, n_refs string")
    got = {(r.n_refs, r.verified) for r in rp.cas_verify(df, "text").collect()}
    assert got == {(2, True), (1, True)} and rp.cas_verify(df, "text").count() == 3
    assert rp.cas_verify(df.limit(0), "text").count() == 0


def test_splits(spark):
    df = spark.createDataFrame([(f"s{i}",) for i in range(500)] + [(None,)], "sample_id string")
    dev, test = (set(r[0] for r in rp.split_filter(df, "sample_id", s).collect()) for s in ("dev", "test"))
    assert not dev & test - {None} and len(dev | test) >= 500 and 60 < len(dev) < 140
    assert rp.split_filter(df, "sample_id", None) is df and rp.split_filter(df, "sample_id", "all") is df
    with pytest.raises(ValueError):
        rp.split_filter(df, "sample_id", "train")


def test_type_rank(spark):
    df = spark.createDataFrame([("core",), ("episodic",), ("resource",), (None,)], "t string")
    assert [r[0] for r in df.select(rp.type_rank(F.col("t"), "preference")).collect()] == [1, 3, None, None]
    assert [r[0] for r in df.select(rp.type_rank(F.col("t"), "no such class")).collect()] == [3, 2, 5, None]


def test_flips_and_calibration(spark):
    rows = [{"sample_id": s, "run_idx": 0, "system": y, "category": "c", "correct": ok} for s, y, ok in [("1", "a", False), ("1", "b", True), ("2", "a", True), ("2", "b", None), ("3", "a", True), ("4", "z", True)]]
    rows += [dict(rows[0]), {"sample_id": "5", "run_idx": 0, "system": "b", "category": "c", "error": "boom"}]
    assert [tuple(r) for r in rp.flips(log(spark, rows), ["sample_id", "run_idx"], "system", "a", "b", "category").collect()] == [("c", 1, 1, 1)]
    assert rp.flips(log(spark, []), ["sample_id", "run_idx"], "system", "a", "b", "category").count() == 0
    answers = [{"sample_id": f"s{i}", "system": "a", "category": "unanswerable" if i % 5 == 0 else None, "correct": i % 3 != 0, "extra": (None, 0.9 if i % 3 else 0.2)} for i in range(300)]
    df = log(spark, answers).withColumn("confidence", F.col("extra.confidence"))
    r = rp.calibrate_tau(df, "sample_id", "system", "confidence", "correct", 0.95).collect()[0]
    dev = {x[0] for x in rp.split_filter(df.where("category IS NULL"), "sample_id", "dev").select("sample_id").collect()}
    assert (r.tau, r.n, r.precision_at_tau) == (0.9, len(dev), 1.0) and 0 < r.coverage_at_tau < 1
    assert rp.calibrate_tau(df.limit(0), "sample_id", "system", "confidence", "correct", 0.95).count() == 0


def test_recall_paths_and_health(spark):
    hits = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, None), (None, "a")], "i int, ch string")
    assert {tuple(r) for r in rp.recall_paths(hits, "i", "ch").collect()} == {(1, "a+b", 2), (2, "", 0), (None, "a", 1)}
    empty = log(spark, [])
    facts, records = spark.createDataFrame([], "is_current boolean"), spark.createDataFrame([], "namespace string, valid_at timestamp")
    r = rp.brain_health(empty, facts, records).collect()[0]
    assert r.proof_coverage == 0 and r.currency == 0 and r.composite == round(1 / 6, 5)


def test_fronts(spark):
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate([(1, 5), (2, 3), (2, 3), (4, 1), (3, 4), (5, 2), (6, 6)])] + [(9, None, 1.0)]
    got = {r.i: r.front for r in rp.pareto_fronts(spark.createDataFrame(pts, "i int, x double, y double"), "x", "y", 3).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 3}


def test_exclusive_percentile(spark):
    groups = {"a": [float(i * i % 37) for i in range(60)], "b": [3.0, 1.0, 2.0], "c": [1.0] * 25 + [2.0]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in [*vs, None, math.nan]], "k string, v double")
    got = {r.k: r.value for r in rp.exclusive_percentile(df, "k", "v", 0.95).collect()}
    assert got["a"] == pytest.approx(statistics.quantiles(groups["a"], n=20)[18]) and got["c"] == pytest.approx(statistics.quantiles(groups["c"], n=20)[18]) and got["b"] == 3.0


def test_preferences(spark):
    rows = [(1, "n", 10, "Bo prefers tea. Al prefers not to talk."), (2, "n", 20, "Since May Bo prefers black coffee, and Al left."), (3, "n", None, "Bo prefers milk"), (4, "m", 5, None), (5, None, 1, "Cy prefers rain"), (5, None, 1, "Cy prefers rain")]
    df = spark.createDataFrame(rows, "doc_id int, namespace string, valid_at int, text string").withColumn("who", F.lit("clash"))
    assert {tuple(r) for r in rp.preference_latest(df, "text", ["namespace"], "valid_at", "doc_id").collect()} == {("n", "Bo", "black coffee", 20, 1), (None, "Cy", "rain", 1, 0)}
    assert rp.preference_latest(df.limit(0), "text", ["namespace"], "valid_at", "doc_id").count() == 0
