import math
import time

import pytest
from pyspark.sql import functions as F

from mnemoframe.functions.text import norm_words, plain_text
from mnemoframe.operators import content, evaluation as ev, graph, ranking, retrieval as rt, temporal as tp
from mnemoframe.sources import runlogs
from mnemoframe.streaming.activation import activation_fold, activation_stream

FACT = "k string, v string, t double, n bigint"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_history_and_latest(spark):
    f = spark.createDataFrame([("Alice", "Acme", 100.0, 1), ("Alice", "Gamma", 300.0, 3), ("Alice", "Beta", 200.0, 2), ("Bob", "X", 5.0, 4), ("Bob", "Y", 5.0, 5)], FACT)
    h = tp.with_validity(f, ["k"], "t", "n")
    assert rows(h.where("k = 'Alice'"), "t", "v", "is_current") == [(100.0, "Acme", False), (200.0, "Beta", False), (300.0, "Gamma", True)]
    assert rows(tp.active_at(h, "t", F.lit(250.0)), "k", "v") == [("Alice", "Beta"), ("Bob", "Y")]
    assert tp.active_at(h, "t", F.lit(1.0)).count() == 0
    assert rows(tp.latest_value(f, ["k"], "v", "t", "n", F.lit(250.0)), "k", "v", "n_superseded") == [("Alice", "Beta", 1), ("Bob", "Y", 1)]


def test_concurrent_writes_leave_one_active(spark):
    f = spark.createDataFrame([("a", f"Co{i}", 100.0 + i, i) for i in range(20)], FACT)
    h = tp.with_validity(f, ["k"], "t", "n")
    assert h.count() == 20 and rows(h.where("is_current"), "v") == [("Co19",)]


def test_asof(spark):
    left = spark.createDataFrame([("a", 1.0, 1), ("a", 5.0, 2), ("b", 9.0, 3)], "k string, t double, id bigint")
    right = spark.createDataFrame([("a", "x", 2.0, 1), ("a", "y", 5.0, 2), ("a", "z", 6.0, 3)], FACT)
    assert rows(tp.asof_join(left, right, ["k"], "t", "t", "v", "n"), "id", "asof_value") == [(1, None), (2, "y"), (3, None)]


def test_pareto_hypervolume(spark):
    import random

    rnd = random.Random(1)
    pts = [(i, float(rnd.randrange(50)), float(rnd.randrange(50))) for i in range(400)] + [(900, None, 1.0)]
    df = spark.createDataFrame(pts, "id bigint, x double, y double")
    ok = pts[:-1]
    want = sorted(i for i, x, y in ok if not any(a <= x and b <= y and (a < x or b < y) for _, a, b in ok))
    front = ranking.pareto_front(df, "x", "y")
    assert [r[0] for r in rows(front, "id")] == want
    assert ranking.hypervolume_2d(spark.createDataFrame([(1.0, 3.0), (2.0, 1.0)], "x double, y double"), "x", "y", 4.0, 4.0).first().hv == 7.0
    assert ranking.pareto_front(df.where("id < 0"), "x", "y").count() == 0


def test_fusion(spark):
    df = spark.createDataFrame([("q", "a", "c", 1.0), ("q", "b", "c", 3.0), ("q", "a", "d", 5.0), ("q", "b", "d", 5.0)], "q string, i string, c string, s double")
    got = lambda m: {r.i: round(r.fused, 6) for r in ranking.fuse_scores(df, "q", "i", "c", "s", m).collect()}
    assert got("zscore") == {"a": -1.0, "b": 1.0} and got("minmax") == {"a": 0.0, "b": 1.0} and got("borda") == {"a": 3.0, "b": 3.0}
    assert got("dbsf") == {"a": round(1 / 3, 6), "b": round(2 / 3, 6)}
    with pytest.raises(ValueError):
        ranking.fuse_scores(df, "q", "i", "c", "s", "nope")


def test_adaptive_k_flat_keeps_min(spark):
    df = spark.createDataFrame([("flat", i, 1.0) for i in range(5)] + [("gap", i, s) for i, s in enumerate([9.0, 8.0, 2.0, 1.0])] + [("one", 0, 1.0)], "q string, i int, s double")
    assert rows(ranking.adaptive_k(df, "q", "s", "i", 1, 4), "q", "k") == [("flat", 1), ("gap", 2), ("one", 1)]


def test_mcnemar_and_wilson(spark):
    df = spark.createDataFrame([(9, 2), (0, 0), (3, 4), (4000, 3900)], "a bigint, b bigint")
    got = {r.a: r.p for r in df.select("a", ev.mcnemar_p(F.col("a"), F.col("b")).alias("p")).collect()}
    exact = lambda a, b: min(1.0, 2 * sum(math.comb(a + b, i) for i in range(min(a, b) + 1)) / 2 ** (a + b))
    assert all(got[a] == pytest.approx(exact(a, b), rel=1e-6) for a, b in [(9, 2), (0, 0), (3, 4)]) and 0.2 < got[4000] < 0.3
    lo, hi = ev.wilson(F.lit(13.0), F.lit(22.0))
    r = spark.range(1).select(lo.alias("lo"), hi.alias("hi")).first()
    assert (round(r.lo, 3), round(r.hi, 3)) == (0.387, 0.767)


def test_tau(spark):
    data = [("s", 0.9, True)] * 10 + [("s", 0.7, True)] * 2 + [("s", 0.6, False)] * 3 + [("bad", 0.5, False)]
    df = spark.createDataFrame([(*r, None, False) for r in data], "s string, c double, ok boolean, error string, abstained boolean")
    got = {r.s: r.tau for r in ev.pick_tau(df, "s", "c", "ok").collect()}
    assert got["s"] == 0.7 and got["bad"] > 0.5


def test_sha1_split(spark):
    import hashlib

    ids = [f"id{i}" for i in range(300)]
    df = spark.createDataFrame([(i,) for i in ids], "id string").select("id", ev.sha1_mod100(F.col("id")).alias("b"))
    assert all(r.b == int(hashlib.sha1(r.id.encode()).hexdigest(), 16) % 100 for r in df.collect())


def test_vote(spark):
    df = spark.createDataFrame([("q", "A", 0.99, 1), ("q", " b", 0.5, 2), ("q", "B", 0.51, 3), ("r", "x", 0.9, 4), ("r", "y", 0.8, 5)], "q string, a string, c double, n bigint")
    assert rows(ev.vote(df, ["q"], "a", "c", "n"), "q", "answer", "votes") == [("q", "b", 2), ("r", None, 1)]


def test_rules(spark):
    e = spark.createDataFrame([(f"c{i}", "in_nation", "n", i) for i in range(4)] + [("n", "nation_in", "r", 9)] + [(f"c{i}", "in_region", "r", i) for i in range(3)], "h string, r string, t string, seq bigint")
    rules = graph.mine_rules(e)
    assert rows(rules, "r1", "r2", "r3", "body", "conf") == [("in_nation", "nation_in", "in_region", 4, 0.75)]
    assert rows(graph.apply_rules(e, rules), "x", "r3", "z") == [("c3", "in_region", "r")]
    assert graph.two_hop(e, cap=0).count() == 0


def test_khop_and_pagerank(spark):
    e = spark.createDataFrame([("alice", "acme"), ("acme", "paris"), ("x", "y")], "a string, b string")
    seeds = spark.createDataFrame([("alice",)], "node string")
    assert rows(graph.khop(e, seeds, 2), "node", "hop") == [("acme", 1), ("alice", 0), ("paris", 2)]
    p = {r.node: r.score for r in graph.pagerank(e, seeds).collect()}
    assert set(p) == {"alice", "acme", "paris"} and sum(p.values()) == pytest.approx(1.0)


def test_sentences_and_types(spark):
    text = "Dr. Who met J. R. R. Tolkien. It cost $5. Then he left! Really?"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string")
    got = {r.id: r.s for r in df.select("id", content.sentences(F.col("t")).alias("s")).collect()}
    assert got == {1: ["Dr. Who met J. R. R. Tolkien.", "It cost $5.", "Then he left!", "Really?"], 2: None, 3: []}
    cases = [("x", "PDF", "resource"), ("my password is x", "text", "knowledge_vault"), ("I prefer tea", "text", "core"), ("Step 1 do it", "text", "procedural"), ("hello", None, "episodic")]
    d = spark.createDataFrame(cases, "t string, m string, want string")
    assert d.where(content.memory_type(F.col("t"), F.col("m"), F.lit(False)) != F.col("want")).count() == 0
    q = spark.createDataFrame([("It cost $11.99 and 7.5 miles, then $8.5 million. On Monday.",)], "t string").select(content.quantities(F.col("t")).alias("q")).first().q
    assert q[0].startswith("$11.99") and q[1] == "7.5 miles" and q[2] == "$8.5 million"


def test_plain_text(spark):
    df = spark.createDataFrame([("Wｈｉｃｈ <b>the</b> to​wn&#63;<p>a</p><p>neighbour's</p>",), (None,), ("",)], "t string")
    assert [r.w for r in df.select(norm_words("t").alias("w")).collect()] == [["which", "the", "town", "a", "neighbours"], None, []]
    assert df.select(plain_text(F.col("t")).alias("p")).collect()[1].p is None


def test_lof_and_mmr(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.concatenate([np.array([1.0, 0, 0, 0]) + 0.02 * rng.normal(size=(30, 4)), [[-1.0, 0.3, 0, 0]]])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "item_id bigint, vec array<double>")
    lof = {r.item_id: r.lof for r in rt.local_outliers(df, 5).collect()}
    assert max(lof, key=lof.get) == 30
    short = spark.createDataFrame([("q", 1, 0.9, [1.0, 0.0]), ("q", 2, 0.89, [1.0, 0.0]), ("q", 3, 0.5, [0.0, 1.0])], "q string, i bigint, rel double, vec array<double>")
    assert [r.i for r in sorted(ranking.mmr(short, "q", "i", "rel", "vec", 2).collect(), key=lambda r: r.position)] == [1, 3]


def test_run_logs(spark, tmp_path):
    assert runlogs.read_run_logs(spark, str(tmp_path / "none*.jsonl")).count() == 0
    (tmp_path / "a.jsonl").write_text('{"system": "s", "correct": true, "extra": {"verified": true}}\n\n{"system": "t"}\n')
    assert rows(runlogs.read_run_logs(spark, str(tmp_path / "*.jsonl")), "system") == [("s",), ("t",)]
    with pytest.raises(FileNotFoundError):
        runlogs.read_first_present(spark, str(tmp_path), ["x.json"], runlogs.RUN_LOG)
    (tmp_path / "b.json").write_text('[{"system": "u"}]')
    assert runlogs.read_first_present(spark, str(tmp_path), ["a.jsonl", "b.json"], runlogs.RUN_LOG).count() == 3


def test_stream_equals_fold(spark, tmp_path):
    schema = "user_id bigint, event_type string, turn bigint"
    data = [(u, "click", t) for u in range(3) for t in (1, 1, 2, 5 + u, 40)]
    spark.createDataFrame([d for d in data if d[2] <= 2], schema).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    time.sleep(1.1)
    spark.createDataFrame([d for d in data if d[2] > 2], schema).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = activation_stream(stream).writeStream.outputMode("update").format("memory").queryName("act").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    last = spark.table("act").groupBy("user_id", "event_type").agg(F.max_by("activation", "turn").alias("activation"))
    fold = activation_fold(spark.createDataFrame(data, schema), ["user_id", "event_type"], "turn")
    assert rows(last, "user_id", "event_type", "activation") == rows(fold, "user_id", "event_type", "activation")


def test_cosine_blocks(spark):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(90, 5))
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(200, [0.0] * 5), (201, [1.0, 2.0]), (202, None), (None, [1.0] * 5)]
    items = spark.createDataFrame(data, "item_id bigint, vec array<double>")
    q = items.where("item_id % 3 = 0").selectExpr("item_id AS query_id", "vec", "'x' AS row")
    whole, blocks = (sorted(map(tuple, ranking.cosine_topk(q, items, 4, *n).select("query_id", "item_id", "rank").collect())) for n in ((4096, 65536), (7, 11)))
    assert whole == blocks and len(whole) == 30 * 4 + 1
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert [i for q_, i, _ in sorted(whole, key=lambda r: (r[0], r[2])) if q_ == 3] == np.argsort(-(u @ u[3]))[:4].tolist()
    assert ranking.cosine_topk(q.limit(0), items, 4).count() == 0


def test_translation_scores(spark):
    facts = [("n", f"c{i}", "in", f"t{i % 4}") for i in range(80)] + [("n", f"c{i}", "lives", f"t{(i + 1) % 4}") for i in range(80)] + [("m", "a", "in", "b"), ("m", "a", "in", "b"), (None, "a", "in", "b"), ("m", "a", None, "b")]
    df = spark.createDataFrame(facts, "ns string, h string, r string, t string")
    for block in (20_000, 40):
        got = rt.translation_scores(df, epochs=60, block_rows=block).toPandas()
        assert len(got) == 161 and got["score"].between(0, 1).all()
        start = rt.translation_scores(df, epochs=0, block_rows=block).toPandas()
        assert got["score"].mean() > 2 * start["score"].mean()
    assert rt.translation_scores(df.limit(0)).count() == 0


def test_measure_sum(spark):
    from mnemoframe.operators import retrieval

    texts = [("a", "s1", "I bought 40 pounds of feed and 1,000.5 coins, then 2 miles 3 miles."), ("a", "s2", "Another 30 lbs, a $28 coins voucher, item ho30 cups."), ("b", "s3", "It weighed 1 pound (5kg)."), ("b", None, None)]
    df = spark.createDataFrame(texts, "ns string, session string, text string")
    got = {(r.ns, r.family, r.unit): (r.n_amounts, r.n_sessions, r.total) for r in retrieval.measure_sum(df, "ns", "session", "text").collect()}
    assert got == {("a", "mass", "pound"): (2, 2, 70.0), ("a", "money", "coin"): (1, 1, 1000.5), ("a", "distance", "mile"): (2, 1, 5.0), ("b", "mass", "pound"): (1, 1, 1.0), ("b", "mass", "kilogram"): (1, 1, 5.0)}
