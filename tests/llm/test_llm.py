import random
import re

import pytest
from pyspark.sql import functions as F

pytest.importorskip("mnemoframe.llm.queries")

from mnemoframe.llm.queries import TOKENIZER  # noqa: E402
from mnemoframe.llm import leaks, mixing, overlap, pairs, pieces, quantiles, splits, subjects, vectors  # noqa: E402

SAMPLE = "sample_id string, dataset string, category string, question string, gold string, split string, author string, source_ref string, entity string, class string, key string"


def samples(spark, rows):
    cols = [c.split(" ")[0] for c in SAMPLE.split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], SAMPLE)


def test_groups(spark):
    rows = [
        {"sample_id": "pl_c1_q1", "dataset": "palaver", "author": "Dova Li"},
        {"sample_id": "pl_c1_q2", "dataset": "palaver"},
        {"sample_id": "MG7.Q3", "dataset": "memgrid", "author": " LI,  dova", "entity": "red  Lamp "},
        {"sample_id": "qz-3-1", "dataset": "quartz", "entity": "Red lamp", "source_ref": "n/a"},
        {"sample_id": "longtide:5/q00", "dataset": "longtide", "author": "unknown", "entity": "assistant", "source_ref": "n/a"},
        {"sample_id": "longtide:6/q00", "dataset": "longtide", "author": "Unknown ", "entity": None, "source_ref": ""},
        {"sample_id": "longtide:6/q00", "dataset": "longtide", "author": "Unknown ", "entity": None, "source_ref": ""},
        {"sample_id": None, "dataset": None, "author": "Dova Li"},
    ]
    got = {r.sample_id: r.group_id for r in splits.related_groups(samples(spark, rows)).collect()}
    one = dict.fromkeys(["pl_c1_q1", "pl_c1_q2", "MG7.Q3", "qz-3-1"], "MG7.Q3")
    assert got == one | {"longtide:5/q00": "longtide:5/q00", "longtide:6/q00": "longtide:6/q00"}
    assert splits.related_groups(samples(spark, [])).count() == 0


def test_components_against_union_find(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(260)] + [(i, i + 1) for i in range(400, 460)]
    edges = [(max(e), min(e)) for e in edges if e[0] != e[1]]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    want = {x: find(x) for x in parent if find(x) != x}
    got = {r.u: r.v for r in splits.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == want


def test_split_keeps_groups(spark):
    rnd = random.Random(1)
    rows = [{"sample_id": f"qz-{i // 4}-{i % 4}", "dataset": "quartz", "category": rnd.choice(["A b", "a-b", None, "c"]), "author": f"p{rnd.randrange(60_000)}"} for i in range(2000)]
    out = splits.assign_splits(samples(spark, rows)).toPandas()
    assert len(out) == 2000 and out.groupby("group_id")["split"].nunique().max() == 1
    assert 0.7 < (out["split"] == "train").mean() < 0.9


TURN = "turn_id bigint, content string, forced string"


def test_pieces_round_trip(spark):
    rnd = random.Random(2)
    words = ["alpha", "beta.", "gamma,", "漢字。", "d" * 30, "\n\n", "é😀"]
    texts = [" ".join(rnd.choice(words) for _ in range(n)) for n in (10, 900, 5000)] + ["x" * 5000, "", None, "a" * 1603, "a" * 1604, ("b" * 1500 + " ") * 3]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] * 2 + [(None, "y" * 9000, None)], TURN)
    rows = {r.turn_id: r for r in pieces.split_oversized(df).collect()}
    assert set(rows) == {i for i, t in enumerate(texts) if t and len(t) // 4 > 400}
    for i, r in rows.items():
        assert "".join(p.text[p.new_from - p.start :] for p in r.pieces) == texts[i]
        assert all(len(p.text) // 4 <= 400 for p in r.pieces)
        for a, b in zip(r.pieces, r.pieces[1:]):
            assert b.new_from - b.start == min(160, b.new_from)
            assert texts[i][b.start : b.new_from] == texts[i][: b.new_from][-160:] and a.new_from < b.new_from
        assert r.forced == int(max(map(len, re.split(r"[\s。！？]", texts[i]))) > 1603)
    found = pieces.oversized_turns(df).collect()
    assert len(found) == len(rows)
    assert pieces.oversized_turns(spark.createDataFrame([], TURN)).count() == 0


def test_pieces_of_other_sizes(spark):
    """Overlaps longer than a part, none at all, and a text of a megabyte."""
    rnd = random.Random(9)
    text = "".join(rnd.choice(["alpha ", "beta. ", "gam, ", "x", "\n"]) for _ in range(5000))
    df = spark.createDataFrame([(1, text, "")], TURN)
    for limit, overlap in ((50, 40), (50, 0), (400, 40)):
        rows = pieces.piece_rows(df, limit=limit, overlap=overlap).orderBy("piece_no").collect()
        assert "".join(r.text[r.new_from - r.start :] for r in rows) == text
        assert all(r.text == text[r.start : r.start + len(r.text)] and len(r.text) // 4 <= limit and r.new_from - r.start == min(4 * overlap, r.new_from) for r in rows)
    with pytest.raises(ValueError):
        pieces.piece_rows(df, limit=40, overlap=41)
    long = "word and more. " * 70_000
    rows = pieces.piece_rows(spark.createDataFrame([(1, long, "")], TURN)).orderBy("piece_no").collect()
    assert "".join(r.text[r.new_from - r.start :] for r in rows) == long


PAIR = "pair_kind string, pair_key string, question string, response string"
Q = "How long had Vilen Zibojini owned the glass radio when Nomon Vanopoji borrowed it in Mamoford?"


@pytest.mark.parametrize(
    ("response", "defect"),
    [
        (None, "empty"), ("  \t", "empty"), ("<br>", "empty"), ("N/A", "empty"), ("…", "empty"),
        ("23 months", None), ("Vilen Zibojini had owned the glass radio for 23 months when Nomon Vanopoji borrowed it in Mamoford.", None),
        ("Vilen Zibojini had owned the glass radio for 23 mon", "truncated"), ("the oval bench, the round", "truncated"),
        ("I won't be able to share that.", "refusal"), ("No stored record covers this question.", "refusal"), ("Lo siento, no puedo responder a esa pregunta.", "refusal"),
        ('He had it for 2 years. Vilen Zibojini said "I can\'t carry it alone."', None),
        (Q, "echo"), ("You asked: " + Q, "echo"), (Q.lower().replace("?", "."), "echo"),
        ("porque el dueño de la casa lo pidió", "other_language"), ("C'était pendant la deuxième visite.", "other_language"), ("Hatte Zosehime", None), ("x" * 100_000, None),
    ],
)
def test_defects(spark, response, defect):
    df = spark.createDataFrame([("answer", "1", Q, response)] * 2 + [("sample", "2", None, "fine")] + [("sample", str(i + 10), "What is the oval bench, then?", "fine") for i in range(6)], PAIR)
    got = {r.pair_key: r.defect for r in pairs.defects(df).collect()}
    assert got == ({"1": defect} if defect else {})


@pytest.mark.parametrize("response", ["他把灯借给了他的朋友", "彼はそのランプを友人に貸しました", "Он одолжил лампу своему другу", "أعار المصباح لصديقه", "Hij heeft het niet naar de stad gebracht, maar wel verkocht", "On jest tam, gdzie lampa była dla przyjaciela"])
def test_other_scripts_and_languages(spark, response):
    df = spark.createDataFrame([("answer", "1", Q, response), ("answer", "2", response, response[: len(response) // 2]), ("answer", "3", "彼は誰にランプを貸しましたか", "友人に貸しました。")], PAIR)
    got = {r.pair_key: r.defect for r in pairs.defects(df).collect()}
    assert got.get("1") == "other_language" and got.get("2") != "other_language" and "3" not in got


def test_truncation_needs_no_template(spark):
    """Lists in any language, words that break off, and statements that only sound like refusals."""
    asked = [("sample", str(i), f"Where did the red bicycle stand for 23 months after visit {i}?", "Next to the wooden shed") for i in range(8)]
    cases = {
        "der rote Tisch, der runde": "truncated", "der rote Tisch, der runde Stuhl": None, "- la mesa roja\n- la silla": "truncated", "red bicy": "truncated", "23 mont": "truncated",
        "red bicycle": None, "23 months": None, "Ada Lovelace": None, "The Elbe was never mentioned as being crossed by car.": None, "That was never mentioned.": "refusal", "It was never mentioned in the sessions.": "refusal",
    }
    df = spark.createDataFrame(asked + [("answer", k, None if re.search("tisch|mesa", k.lower()) else "Which river did Ada cross and what stood there?", k) for k in cases], PAIR)
    got = {r.pair_key: r.defect for r in pairs.defects(df).where("pair_kind = 'answer'").collect()}
    assert got == {k: v for k, v in cases.items() if v}


def test_equal_answers_are_judged_once(spark):
    """Equal answers to a sample are one row, whatever their number; each of their keys has the defect."""
    asked = spark.createDataFrame([("s1", Q, "23 months"), ("s1", Q, "23 months"), ("s2", Q, None)], "sample_id string, question string, gold string")
    rows = [(i, "s1", "I can't share that.", None, None) for i in [*range(20), 3, 70_000]] + [(30, "s1", "23 months", None, False), (31, "s2", "I can't share that.", None, None), (32, "s1", None, None, None), (33, "s1", "I can't share that.", "timeout", None)]
    rows += [(34, "s1", "I can't share that.", None, True), (None, "s1", "I can't share that.", None, None), (35, None, "I can't share that.", None, None), (36, "s3", "I can't share that.", None, None)]
    df = pairs.benchmark_pairs(asked, spark.createDataFrame(rows, "answer_id bigint, sample_id string, answer string, error string, abstained boolean"))
    assert df.where("pair_kind = 'answer'").count() == 5 and df.where("pair_kind = 'sample'").count() == 2
    got = {(r.pair_kind, r.pair_key, r.defect) for r in pairs.defects(df).collect()}
    assert got == {("answer", str(i), "refusal") for i in [*range(20), 31, 70_000]} | {("answer", "32", "empty"), ("sample", "s2", "empty")}


def test_automaton():
    q = tuple("a b c d e f".split())
    assert pairs._copied(q, "b c d x e f".split()) == 0.5
    assert pairs._copied(q, list(q)) == 1.0
    assert pairs._copied(q, "f e d".split()) == 0.0


VEC = "vec_id bigint, model string, dim int, vec array<float>, cell string, codes string"


def test_vectors_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 16))
    x = np.concatenate([c + 0.25 * rng.normal(size=(10, 16)) for c in centres])
    rows = [(i, "m", 16, [float(f) for f in v], "", "") for i, v in enumerate(x)] + [(0, "m", 16, [float(f) for f in x[0]], "", "")]
    rows += [(9001, "m", 16, None, "", ""), (9002, "m", 16, [0.0] * 16, "", ""), (9003, "m", 16, [float("nan")] * 16, "", ""), (9004, "m", 8, [1.0] * 16, "", ""), (9005, None, 16, [1.0] * 16, "", ""), (9006, "solo", 2, [1.0, 2.0], "", "")]
    got = {(r.vec_id_a, r.vec_id_b) for r in vectors.similar_pairs(spark.createDataFrame(rows, VEC)).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    true = {(min(i, j), max(i, j)) for i in range(len(u)) for j in np.argsort(-s[i], kind="stable")[:5] if s[i, j] >= 0.85}
    assert len(got & true) >= 0.95 * len(true) and len(got - true) <= 0.05 * len(true)
    assert vectors.similar_pairs(spark.createDataFrame([], VEC)).count() == 0


def test_vectors_by_the_index(spark, monkeypatch):
    """Two models by codebooks: recall of all neighbours at least 0.9, for every query with an id divisible by 20."""
    import numpy as np

    monkeypatch.setattr(vectors, "PAYS", 1.0)
    monkeypatch.setattr(vectors, "BLOCK", 500)
    rng = np.random.default_rng(5)
    x = {"m": rng.normal(size=(400, 24)).repeat(12, axis=0) + 0.3 * rng.normal(size=(4800, 24)), "n": rng.normal(size=(4000, 8))}
    x["m"][:1600] = x["m"][0] + 0.5 * rng.normal(size=(1600, 24))  # a third of the rows in one cluster
    rows = [(i, m, v.shape[1], [float(f) for f in r], "", "") for m, v in x.items() for i, r in enumerate(v.astype(np.float32))]
    df = spark.createDataFrame(rows, VEC).repartition(4)
    assert set(vectors.build_index(df, -2.0, 5)) == {"m", "n"}
    got = vectors.most_similar(df).where("vec_id % 20 = 0").toPandas()
    for m, v in x.items():
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        near = got[got["model"] == m].groupby("vec_id")["neighbour"].apply(set)
        hits = 0
        for i in range(0, len(u), 20):
            s = u @ u[i]
            s[i] = -2
            hits += len(near[i] & set(np.argsort(-s)[:5].tolist()))
        assert hits >= 0.9 * 5 * len(range(0, len(u), 20))


def test_vectors_met_in_many_cells(spark, monkeypatch):
    """Of the pairs of small clusters over many cells three in a thousand are missed at most, also where vectors have copies."""
    import numpy as np

    monkeypatch.setattr(vectors, "PAYS", 1.0)
    rng = np.random.default_rng(17)
    x = rng.normal(size=(3000, 32)).repeat(6, axis=0)
    x = (x + rng.uniform(0.2, 0.4, size=(len(x), 1)) * rng.normal(size=x.shape)).astype(np.float32)
    rows = [(i, "m", 32, v.tolist(), "", "") for i, v in enumerate(x)] + [(i + 10**6 * c, "n", 32, v.tolist(), "", "") for i, v in enumerate(x[:9000]) for c in (0, 1)]
    df = spark.createDataFrame(rows, VEC).repartition(4)
    assert set(vectors.build_index(df, 0.85, 5)) == {"m", "n"}
    got = {(r.model, r.vec_id_a, r.vec_id_b) for r in vectors.most_similar(df, 5, 0.85).selectExpr("model", "least(vec_id, neighbour) vec_id_a", "greatest(vec_id, neighbour) vec_id_b").collect()}
    for m, n, copies in (("m", len(x), (0,)), ("n", 9000, (0, 10**6))):
        u = x[:n].astype(np.float64) / np.linalg.norm(x[:n].astype(np.float64), axis=1, keepdims=True)
        true = set()
        for i in range(n):
            near = [j for j in range(i - i % 6, i - i % 6 + 6) if j == i or u[i] @ u[j] >= 0.85]
            others = sorted((-1.0 if j == i else -(u[i] @ u[j]), j + c) for j in near for c in copies)
            for c in copies:
                best = [j for _, j in others if j != i + c][:5]
                true |= {(m, min(i + c, j), max(i + c, j)) for j in best}
        found = {p for p in got if p[0] == m}
        assert len(true - found) <= 0.003 * len(true) and len(found - true) <= 0.003 * len(true), (m, len(true), len(true - found), len(found - true))


def test_vectors_in_one_dense_cluster(spark, monkeypatch):
    """A third of the rows lie in one cluster, and there are many more cells than a fixed number of visits."""
    import numpy as np

    monkeypatch.setattr(vectors, "BLOCK_BYTES", 100_000, raising=False)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(9000, 16)).astype(np.float32)
    x[:3000] = rng.normal(size=16) + 0.45 * x[:3000]
    got = {(r.vec_id_a, r.vec_id_b) for r in vectors.similar_pairs(spark.createDataFrame([(i, "m", 16, v.tolist(), "", "") for i, v in enumerate(x)], VEC)).collect()}
    u = vectors._unit(__import__("pandas").Series(list(x))).astype(np.float64)
    true = set()
    for i, v in enumerate(u):
        s = u @ v
        s[i] = -2
        true |= {(min(i, int(j)), max(i, int(j))) for j in np.lexsort((np.arange(len(s)), -s))[:5] if s[j] >= 0.85}
    assert got == true


def test_only_copies_are_grouped(spark):
    """Rows that are the only one of their vector aren't shuffled to find that out, nor are copies or repeated rows kept."""
    rows = [(i, "m", 3, [float(i % 3900), 1.0, 2.0], "", "") for i in range(4000)] + [(7, "m", 3, [7.0, 1.0, 2.0], "", ""), (7, "n", 3, [7.0, 1.0, 2.0], "", "")]
    df = spark.createDataFrame(rows, VEC).repartition(4)
    repeated = vectors._repeated(df)
    assert 200 <= vectors._keyed(df).where(repeated.may_have(F.col("h1"))).count() <= 300
    got = sorted((r.model, r.dim, r.vec_id, tuple(r.vec)) for r in vectors._distinct(df, repeated).collect())
    assert got == sorted([("m", 3, i, (float(i), 1.0, 2.0)) for i in range(3900)] + [("n", 3, 7, (7.0, 1.0, 2.0))])


def test_shortlist_by_its_definition():
    """Scores within the errors' reach of the wanted cosine and of the k + 1 best, without sorting queries that have fewer."""
    import numpy as np

    rng = np.random.default_rng(23)
    for n, least, low, high in ((400, 0.6, 0.1, 0.2), (400, -2.0, 0.1, 0.2), (5, -2.0, 0.1, 0.2), (0, 0.6, 0.1, 0.2)):
        s = rng.uniform(-1, 1, size=(n, 30)).astype(np.float32) ** 3
        bound = np.full(30, least)
        if n > 6:
            bound = np.maximum(bound, np.sort(s, axis=0)[-7] - low)
        assert (vectors.shortlist(s, least, 6, low, high) == (s >= (bound - high).astype(np.float32))).all()


def test_first_cell_in_common():
    """The bits of the cells before tell whether two rows of a cell meet in an earlier one."""
    import numpy as np

    rows = [[0, 3, 70, 300], [1, 70, 300], [3, 300, 301], [300], [2, 299, 300, 400]]
    n, cells = np.array([len(r) for r in rows]), np.array(sum(rows, []), dtype=np.int16)
    bits = vectors.earlier(n, cells, 300)
    assert [[bool((bits[i] & bits[j]).any()) for j in range(5)] for i in range(5)] == [[min(set(p) & set(q)) < 300 for q in rows] for p in rows]
    assert not vectors.earlier(n, cells, 0).any()


def test_copies_of_a_vector(spark, monkeypatch):
    """Copies under other vec_ids rank by vec_id, and a model of few vectors with negative cosines keeps them all."""
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 1000, raising=False)
    ids = [(i * 37) % 101 for i in range(101)]
    rows = [(i, "m", 2, [1.0, 0.5], "", "") for i in ids] + [(500, "m", 2, [1.0, 0.6], "", ""), (3, "n", 2, [1.0, 0.0], "", ""), (4, "n", 2, [-1.0, 0.0], "", "")]
    df = spark.createDataFrame(rows, VEC)
    got = {}
    for r in vectors.most_similar(df).orderBy("rank").collect():
        got.setdefault((r.model, r.vec_id), []).append(r.neighbour)
    want = {("m", i): [j for j in range(6) if j != i][:5] for i in [*ids, 500]} | {("n", 3): [4], ("n", 4): [3]}
    assert got == want
    assert vectors.similar_pairs(df).count() == len({(min(i, j), max(i, j)) for (m, i), near in want.items() if m == "m" for j in near})


def test_overlap(spark):
    base = {"dataset": "d", "question": "When did Nomon Sigohiga hand the woven lamp over to Jotte Denemabo in Nefedorf?", "gold": "25 April 2024"}
    other = [{"sample_id": f"f{i}", "dataset": "d", "split": "train", "question": f"When did Person{i} Family{i} hand the woven lamp over to Other{i} Name{i} in Town{i}?", "gold": "25 April 2024"} for i in range(30)]
    variants = ["when did  nomon sigohiga hand the woven lamp over to jotte denemabo in nefedorf", "<p>When did Nomon Sigohiga hand the wvoen lamp over to Jotte Denemabo in Nefedorf&#63;</p> Thanks"]
    rows = [base | {"sample_id": "a", "split": "train"}, base | {"sample_id": "a", "split": "train"}, base | {"sample_id": "g", "split": "test", "gold": "26 April 2024"}]
    rows += [base | {"sample_id": f"e{i}", "split": "test", "question": v, "gold": '"25 april 2024".'} for i, v in enumerate(variants)]
    rows += [base | {"sample_id": "n", "split": "validation", "question": base["question"].replace("Jotte Denemabo", "Person1 Family2")}]
    rows += [base | {"sample_id": None, "split": "test"}, {"sample_id": "z", "split": "test"}, {"sample_id": "y", "split": "train", "question": "", "gold": ""}]
    got = {(r.sample_id_a, r.sample_id_b) for r in overlap.overlapping_pairs(samples(spark, rows + other)).collect()}
    assert got == {("a", "e0"), ("a", "e1")}
    assert overlap.overlap_counts(samples(spark, [])).count() == 0


def test_overlap_of_rewritten_questions(spark):
    """Two of four rare words replaced by unseen ones: a cosine of about a half, and most words shared."""
    base = {"dataset": "d", "gold": "25 April 2024"}
    other = [base | {"sample_id": f"f{i}", "split": "train", "question": f"When did Person{i} hand the woven lamp over to Other{i}?"} for i in range(300)]
    rows = [base | {"sample_id": f"{split}{i}", "split": split, "question": f"When did Zanobi{x} of Tenno{x} hand the woven lamp over to {w}{x}?"} for i, x in enumerate("xyz") for split, w in (("train", "people nearby"), ("test", "everybody there"))]
    got = {(r.sample_id_a, r.sample_id_b) for r in overlap.overlapping_pairs(samples(spark, rows + other)).collect()}
    assert got == {(f"test{i}", f"train{i}") for i in range(3)}


def test_overlap_cosine_does_not_depend_on_size(spark, monkeypatch):
    monkeypatch.setattr(overlap, "RAREST", 1 / 50, raising=False)

    def cosine(n):
        words = [["when", "did", "zanobi", "hand", "it"], ["when", "did", "zanobi", "throw", "it"], *[["when", f"w{i}", "it"] if i % 2 else ["did", f"w{i}"] for i in range(n)]]
        classes = spark.createDataFrame([(i, "k", w, " ".join(w), "k") for i, w in enumerate(words)], "class bigint, key string, words array<string>, question string, gold string")
        a, b = ({x["term"]: x["w"] for x in r["vec"]} for r in overlap._vectors(classes, len(words)).where("class < 2").orderBy("class").collect())
        return sum(w * b.get(t, 0) for t, w in a.items())

    assert abs(cosine(200) - cosine(2000)) < 0.004


ANSWER = "answer_id bigint, system string, run_day string, error string, search_ms double, e2e_ms double, context_tokens int, metric string, value string"


def test_quantiles(spark):
    import numpy as np

    rnd = np.random.default_rng(5)
    rows = []
    for d in range(6):
        for i in range(200):
            v = float(rnd.lognormal(5, 0.5)) * (4 if d == 2 else 1)
            rows.append((d * 1000 + i, "s", f"2025-07-0{d + 1}", None, v, float("nan"), -5, "clash", "clash"))
    rows += [rows[0], (99, "s", "2025-07-01", "boom", 1e12, 1.0, 1, "", ""), (98, None, None, None, 1.0, None, None, "", "")]
    df = spark.createDataFrame(rows, ANSWER)
    got = {tuple(r) for r in quantiles.outlying_days(df).collect()}
    assert got == {("s", "2025-07-03", "search_ms", 50), ("s", "2025-07-03", "search_ms", 95)}
    days = quantiles.sketch(quantiles.measures(df))
    q = quantiles.quantiles(quantiles.merge(days.where("system = 's'"), ["system", "metric"]), ["system", "metric"]).where("metric = 'search_ms'").toPandas()
    exact = np.percentile([r[4] for r in rows[:1200]], [50, 95])
    assert np.allclose(q.sort_values("pct")["value"], exact, rtol=0.03)
    # Deleting a day leaves the sketch of the others.
    day = quantiles.measures(df).where("run_day = '2025-07-03'")
    left = quantiles.merge(days.unionByName(quantiles.sketch(day, sign=-1)), quantiles.KEYS)
    assert quantiles.quantiles(left, quantiles.KEYS).where("run_day = '2025-07-03' AND n <> 0").count() == 0
    assert quantiles.outlying_days(spark.createDataFrame([], ANSWER)).count() == 0


def test_stated_error_of_percentiles(spark):
    """Over many groups of unlike sizes and shapes, the true percentile lies within the stated bounds."""
    import numpy as np

    assert quantiles.SIZE * 5 < 1 << quantiles.BITS and quantiles.SKETCHED >= 6
    rnd = np.random.default_rng(6)
    shapes = [lambda n: rnd.lognormal(6, 0.8, n), lambda n: rnd.exponential(900, n), lambda n: rnd.uniform(0, 1e6, n), lambda n: rnd.integers(0, 40, n).astype(float), lambda n: np.full(n, 250.0)]
    groups = {(f"s{j}", f"d{i}"): shapes[i % 5](30 * 4 ** (i % 5)) for j in range(4) for i in range(10)}
    rows = [(a, b, "m", float(v)) for (a, b), g in groups.items() for v in g]
    q = quantiles.quantiles(quantiles.sketch(spark.createDataFrame(rows, "system string, run_day string, metric string, value double").repartition(4)), quantiles.KEYS).toPandas()
    exact = np.array([np.percentile(groups[r.system, r.run_day], r.pct) for r in q.itertuples()])
    assert len(q) == 2 * len(groups) and ((q["low"] <= exact) & (exact <= q["high"])).mean() >= 0.995


def test_days_near_the_factor(spark):
    """Percentiles just above, at and below twice the others' are told apart by the exact check."""
    def rows(day, values):
        return [(hash((day, i)), "s", day, None, float(v), None, None, "", "") for i, v in enumerate(values)]

    base = list(range(100, 301, 2))
    df = spark.createDataFrame(rows("d0", base) + rows("d1", base) + rows("same", [2 * v for v in base]) , ANSWER)
    # The median of d0, d1 is 200 and that of the third day 400.
    assert {(r.run_day, r.pct) for r in quantiles.outlying_days(df).collect()} == {("same", 50), ("same", 95)}
    less = spark.createDataFrame(rows("d0", base) + rows("d1", base) + rows("less", [2 * v - 1e-6 for v in base]), ANSWER)
    assert quantiles.outlying_days(less).count() == 0


ITEM = "item_id bigint, dataset string, text string"
DOC = "doc_id bigint, text string, lang string, source string, h string, w string"
PASSAGE = "Later Tanna Dedileri carried everything to Hiniport. Nobody told Dova Kinefato until the 475 woven lamps arrived."


def test_leaks(spark):
    items = spark.createDataFrame([(1, "d", PASSAGE), (2, "d", None), (3, "d", "too short")], ITEM)
    texts = {
        1: "x y. " + PASSAGE.upper(), 2: "<p>Later <i>Tanna</i> De​dileri\n> carried everything to Hiniport. Nobody told Dova Kinefato until</p>",
        3: "Later Tanna Dedileri carried everything to Hiniport.", 4: None, 5: "", 6: PASSAGE.replace("Dova", "Xava").replace("475", "12").replace("Hiniport", "Zelahaven"),
        7: PASSAGE.replace("told", "asked"), 8: "w " * 100_000,
    }
    docs = spark.createDataFrame([(k, v, None, None, "h", "w") for k, v in texts.items()], DOC)
    got = {(r.doc_id, r.item_id): r.kind for r in leaks.leaks(docs, items).collect()}
    assert got == {(1, 1): "verbatim", (2, 1): "verbatim", (6, 1): "reparameterised"}
    assert leaks.leaks(spark.createDataFrame([], DOC), items).count() == 0
    assert leaks.leaks(docs, spark.createDataFrame([], ITEM)).count() == 0


def test_leaks_with_filters_that_hold_nothing_back(spark, monkeypatch):
    """Full filters let every window into the join; verbatim rows don't depend on them."""
    rnd = random.Random(8)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{i % 7}x" for i in range(400)]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(60)) for _ in range(300)]
    items = spark.createDataFrame([(i, "d", t) for i, t in enumerate(texts)], ITEM)
    docs = spark.createDataFrame([(i, "Say " + t[: 200 + i].upper() + " done", None, None, "", "") for i, t in enumerate(texts)] * 2 + [(900, "12 " * 500, None, None, "", "")], DOC)
    want = leaks.leaks(docs, items).where("kind = 'verbatim'").select("doc_id", "item_id").collect()
    assert sorted(want) == [(i, i) for i in range(300)]
    monkeypatch.setattr(leaks, "MAX_BITS", 64)
    assert sorted(leaks.leaks(docs, items).where("kind = 'verbatim'").select("doc_id", "item_id").collect()) == sorted(want)


TARGET = "source string, target_share double, max_repeats int"


def test_mix(spark):
    words = {"mail": "dear regards sincerely", "gist": "summary brief gist"}
    docs = spark.createDataFrame([(i, f"{words['mail' if i % 4 else 'gist']} number {i}", None, ("Mail" if i % 8 else None) if i % 4 else "GIST ", "", "") for i in range(80)] + [(900, None, None, "mail", "", ""), (901, "", None, "other", "", "")], DOC)
    targets = spark.createDataFrame([("mail", 0.4, 1), ("gist", 0.6, 2)], TARGET)
    r = {x.source: x for x in mixing.mix_report(docs, targets, TOKENIZER).collect()}
    assert r["gist"].short and not r["mail"].short and r["gist"].mix_tokens == pytest.approx(2 * r["gist"].tokens, rel=1e-6)
    assert mixing.mix_copies(docs, targets, TOKENIZER).count() == 82
    assert mixing.mix_report(spark.createDataFrame([], DOC), targets, TOKENIZER).where("short").count() == 0
    assert mixing.mix_report(docs, spark.createDataFrame([], TARGET), TOKENIZER).count() == 0


def test_mix_by_the_classifier_alone(spark):
    """Two thirds of the labels are hidden: expected tokens come from the words, and caps hold for every document."""
    rnd = random.Random(7)
    words = {"mail": "dear regards sincerely signed reply".split(), "gist": "summary brief points short recap".split()}
    text = lambda s: " ".join(rnd.choice(words[s] + ["the", "of", "and"]) for _ in range(30))
    true = ["mail" if i % 4 else "gist" for i in range(600)]
    docs = spark.createDataFrame([(i, text(s), None, s if i % 3 == 0 else None, "", "") for i, s in enumerate(true)], DOC)
    targets = spark.createDataFrame([("mail", 0.3, 1), ("gist", 0.7, 2)], TARGET)
    r = {x.source: x for x in mixing.mix_report(docs, targets, TOKENIZER).collect()}
    assert r["gist"].tokens / (r["gist"].tokens + r["mail"].tokens) == pytest.approx(0.25, abs=0.02)
    assert r["gist"].short and not r["mail"].short and r["mail"].mix_tokens == pytest.approx(0.3 * (r["gist"].tokens + r["mail"].tokens), rel=0.02)
    copies = {x.doc_id: x.copies for x in mixing.mix_copies(docs, targets, TOKENIZER).collect()}
    assert all(copies[i] <= (1 if s == "mail" else 2) for i, s in enumerate(true)) and sum(copies[i] for i, s in enumerate(true) if s == "gist") >= 295


def test_subjects(spark):
    rnd = random.Random(6)
    syllables = ["ba", "ko", "li", "mu", "re"]
    terms = {s: [f"{s[:2]}{a}{b}" for a in syllables for b in syllables] for s in ("law", "sport")}
    docs, labels = [], []
    for i in range(300):
        s = rnd.choice(list(terms))
        text = " ".join(f"We talked about the {rnd.choice(terms[s])}." for _ in range(4)) + " It rained all week."
        docs.append((i, text, "en", None, "", ""))
        if i % 3 == 0:
            labels.append((i, s))
    docs += [(1000, None, None, None, "", ""), (1001, "", None, None, "", ""), (1002, "It rained all week.", "en", None, "", "")]
    df, lab = spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, "doc_id bigint, subject string")
    got = {r.doc_id: r.subject for r in subjects.document_subjects(df, lab).collect()}
    want = {i: ("law" if any(t in d for t in terms["law"]) else "sport") for i, d, *_ in docs[:300]}
    assert sum(got.get(i) == s for i, s in want.items()) >= 285 and not {1000, 1001, 1002} & set(got)
    assert subjects.document_subjects(spark.createDataFrame([], DOC), lab).count() == 0
