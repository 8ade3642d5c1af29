import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemoframe.operators import answers as an
from mnemoframe.operators import content, evaluation as ev, graph, ranking, retrieval as rt, temporal as tp
from mnemoframe.sources import runlogs
from mnemoframe.streaming.activation import evict


def column(spark, values, make, kind="string"):
    """make(column) for each value, in order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[1] for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_forms(spark):
    cases = {
        "I took": False, "It's just like": False, "I already have three at home": False, 'I\'m currently reading "The Quiet Machine"': True, "I am going to Reykjavik next spring": True,
        "It is 12 years old": True, "Norway, Iceland, Sam: Everything went great, and later": False, "2021": True, "Jasper": True, "improve accuracy, win the league": True, "": True,
    }
    assert column(spark, list(cases), an.form_credible) == list(cases.values())
    assert column(spark, [None], an.form_credible) == [True]
    counts = {"Apply the Dr": False, "It's just like": False, "three": True, "$1,300": True}
    assert column(spark, list(counts), lambda c: an.form_credible(c, F.lit("count_aggregate"))) == list(counts.values())
    assert column(spark, ["studio repaint, then housewarming"], lambda c: an.form_credible(c, F.lit("event_order"))) == [True]


def test_phrases_and_values(spark):
    text = lambda p: lambda c: an.states_phrase(c, F.lit(p))
    assert column(spark, ["My fund is 290 usd.", "My fund is 90 usd."], text("90 usd")) == [False, True]
    assert column(spark, ["My fund is $290.", "My fund is $90."], text("$90")) == [False, True]
    said = ["My dentist is Dr. Alvarez at Maple Dental.", "The plan is simple. We leave at dawn.", "No verb here", None]
    assert column(spark, said, an.copular_value) == ["Dr. Alvarez at Maple Dental", "simple", None, None]
    assert column(spark, [70.0, 1.0, 7.5, 100.0], lambda c: an.measure_label(c, F.lit("pound")), "double") == ["70 pounds", "1 pound", "7.5 pounds", "100 pounds"]
    assert column(spark, ["HTTP 403: quota", "model x does not exist", "Invalid API key provided", "connection reset", None], an.error_class) == ["quota_exhausted", "bad_model_id", "auth", "error", None]


def test_sentences(spark):
    cases = {
        "We met Prof. Chen at 3 pm. Then we left.": ["We met Prof. Chen at 3 pm.", "Then we left."],
        "J. R. R. Tolkien wrote it. I loved it!": ["J. R. R. Tolkien wrote it.", "I loved it!"],
        "It is on Mt. Fuji. No. 5 is best. 1 more. 14 left.": ["It is on Mt. Fuji.", "No. 5 is best.", "1 more.", "14 left."],
        "": [], None: None,
    }
    assert column(spark, list(cases), content.sentences) == list(cases.values())


def test_memory_types(spark):
    texts = ["my api_key is", "the apikey", "a creditcard", "step3 of it", "im allergic to nuts", "how to setup", "to setup it", "we met on tuesday"]
    kinds = column(spark, texts, lambda c: content.memory_type(c, F.lit("text"), F.lit(False)))
    assert kinds == ["knowledge_vault"] * 3 + ["procedural", "core", "procedural", "procedural", "episodic"]


def test_review(spark):
    s = content.review_stability(F.lit(0.9), F.lit(0.9))
    day = lambda d: content.retrievability(F.lit(float(d)), s)
    r = spark.range(1).select(day(0).alias("now"), day(30).alias("month"), day(50 * 365).alias("old"), s.alias("s"), content.review(s, F.lit(30.0), F.lit(0.8), F.lit(False)).alias("up"), content.review(s, F.lit(30.0), F.lit(0.8), F.lit(True)).alias("down")).first()
    assert r.now == 1.0 and r.now > r.month > r.old and r.old < 0.2 and r.up > r.s > r.down
    assert spark.range(1).select(content.half_life(F.lit(0.0)).alias("x")).first().x == float("inf")


def test_proofs(spark):
    claims = spark.createDataFrame([("q1", ["m1", "m2", "m1"], "90 usd"), ("q2", ["gone"], "x"), ("q3", [], "y"), ("q4", None, "z")], "k string, memories array<string>, value string")
    sources = spark.createDataFrame([("m1", "It was 90 USD."), ("m1", "It was 90 USD."), ("m2", "It was 290 usd"), ("m2", None)], "m string, t string")
    cites = an.cite(claims, sources, "k", "m", "t")
    got = {(r.k, r.m): (r.content_hash is not None, r.grounded) for r in cites.collect()}
    assert got == {("q1", "m1"): (True, True), ("q1", "m2"): (True, False), ("q2", "gone"): (False, False)}
    trees = {r.k: r for r in an.proof_trees(cites, claims, "k", "m").collect()}
    assert (trees["q1"].grounded_count, trees["q1"].evidence_count, trees["q1"].complete) == (1, 2, True)
    assert (trees["q2"].complete, trees["q2"].completeness) == (False, 0.0) and not trees["q3"].complete and trees["q4"].evidence_count == 0
    assert '"memory_id":"m1"' in trees["q1"].proof and '"provenance_complete":true' in trees["q1"].proof


def test_thresholds_and_depth(spark):
    t = column(spark, ["Alice?", "Where does Alice work now?", "What city did Alice say she would move to after the finance conference in May?"], an.cache_threshold)
    assert t[0] > 0.9 and t[1] > 0.9
    easy, hard = column(spark, ["what is tea", "how did Alice and Bob and Carol both change after the merger then before"], an.adaptive_depth)
    assert 3 <= easy < hard <= 10


def test_undated_facts_are_an_error(spark):
    f = spark.createDataFrame([("a", 1, None, 1), ("a", 2, 5, 2)], "k string, v int, at int, s int")
    with pytest.raises(Exception, match="fact without at"):
        tp.latest_value(f, ["k"], "v", "at", "s", F.lit(9)).collect()
    assert tp.latest_value(f.where("at IS NOT NULL"), ["k"], "v", "at", "s", F.lit(9)).first().v == 2


def test_writes_by_vector_and_contradiction(spark):
    old = spark.createDataFrame([("a", "tea", 5, [1.0, 0.0])], "k string, v string, at int, vec array<double>")
    new = spark.createDataFrame([("a", "Tea!", 5, [1.001, 0.0], False), ("a", "green", 11, [0.0, 1.0], True), ("a", "milk", 20, [0.0, 1.0], None), ("a", "old", 1, [0.0, 0.0], False), ("b", "x", 1, None, None)], "k string, v string, at int, vec array<double>, no boolean")
    got = {r.v: r.op for r in tp.classify_writes(new, old, ["k"], "v", "at", vec="vec", contradicts="no").collect()}
    assert got == {"Tea!": "NOOP", "green": "DELETE_TOMBSTONE", "milk": "UPDATE", "old": "ADD", "x": "ADD"}


def test_broken_logs_are_an_error(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"system": "s"}\n{"system": \n')
    with pytest.raises(Exception):
        runlogs.read_run_logs(spark, str(tmp_path / "*.jsonl")).collect()


def test_zero_vectors(spark):
    items = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "item_id bigint, vec array<double>")
    got = {r.item_id: (r.sim, r.hit) for r in rt.nearest_centroid(items, items.select(F.col("item_id").alias("centroid_id"), "vec"), 0.9).collect()}
    assert got == {1: (0.0, False), 2: (1.0, True)}
    e = spark.createDataFrame([(1, 2), (2, 9)], "a bigint, b bigint")
    assert {r.b: r.coherence for r in graph.edge_coherence(e, items, "a", "b", "item_id", "vec").collect()} == {2: 0.0, 9: 0.5}


def test_windows_of_the_ring(spark):
    u = spark.createDataFrame([(f"{c}{i}", c) for c in "abc" for i in range(12)], "u string, c string")
    ring = ev.holdout_ring(u, "u", "c", "e0")
    wins = ev.ring_windows(ring, 3).groupBy("win").agg(F.count("*").alias("n"), F.countDistinct("c").alias("k")).collect()
    assert sorted((r.win, r.n, r.k) for r in wins) == [(0, 12, 3), (1, 12, 3), (2, 12, 3)]
    assert [ev.draw_window(ring, 12, i) for i in range(4)] == [(0, 0, False), (0, 1, False), (0, 2, False), (1, 0, True)]
    with pytest.raises(ValueError):
        ev.draw_window(ring, 37, 0)


def test_knobs(spark):
    rng = np.random.default_rng(0)
    rows = [(str(a), str(b), float(a + 0.1 * rng.normal())) for a, b in rng.integers(0, 3, (300, 2))]
    got = {r.knob: r.importance for r in ev.knob_importance(spark.createDataFrame(rows, "a string, b string, s double"), ["a", "b"], "s").collect()}
    assert got["a"] > 0.2 and got["b"] < 0.05
    assert ev.knob_importance(spark.createDataFrame([], "a string, s double"), ["a"], "s").first().importance == 0.0


def test_halving_and_eviction(spark):
    rows = [(i, b, float(i if b < 9 else -i)) for i in range(10) for b in (1, 3, 9)]
    got = [tuple(r) for r in ranking.successive_halving(spark.createDataFrame(rows, "i int, b int, s double"), "i", "b", "s", [1, 3, 9]).orderBy("budget").collect()]
    assert got == [(1, 10, 4, 9, 9.0), (3, 4, 2, 9, 9.0), (9, 2, 1, 8, -8.0)]
    with pytest.raises(ValueError):
        ranking.successive_halving(spark.createDataFrame(rows, "i int, b int, s double"), "i", "b", "s", [0])
    field = spark.createDataFrame([("n", "a", 0.5, 1), ("n", "b", 0.5, 2), ("n", "c", 0.9, 0), ("m", "d", 0.1, 0)], "ns string, id string, a double, at int")
    assert sorted(r.id for r in evict(field, "ns", "a", ["at"], 2).collect()) == ["b", "c", "d"]


def test_bm25(spark):
    docs = {1: "red lamp red", 2: "lamp", 3: "blue chair near the lamp", 4: "chair"}
    post = spark.createDataFrame([(t, d, w.split().count(t)) for d, w in docs.items() for t in set(w.split())], "term string, doc_id int, tf int")
    lengths = spark.createDataFrame([(d, len(w.split())) for d, w in docs.items()], "doc_id int, dl int")
    asked = spark.createDataFrame([(7, "red"), (7, "lamp"), (8, "none")], "query_id int, term string")
    got = ranking.bm25(post, lengths, asked, 2).orderBy("rank").collect()

    def weight(term, d, k1=1.2, b=0.75):
        df, tf, avg = sum(term in w.split() for w in docs.values()), docs[d].split().count(term), sum(len(w.split()) for w in docs.values()) / 4
        return np.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(docs[d].split()) / avg))

    assert [(r.query_id, r.doc_id) for r in got] == [(7, 1), (7, 2)]
    assert got[0].score == pytest.approx(weight("red", 1) + weight("lamp", 1), abs=1e-5)
