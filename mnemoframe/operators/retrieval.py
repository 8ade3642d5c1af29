"""Retrieval and memory upkeep: reflex postings, region hints, scratchpad, feedback, gates, outliers, clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.operators.ranking import cosine_topk, dot
from mnemoframe.session import cut_lineage

#: Words too common to seed a recall (this library's choice).
STOP_WORDS = "the and for that this with from was were are has have had but not you your his her its they them who what when where which why how all any can will would than then there into over been before after about until".split()

#: Spellings of units, by family and unit.
UNITS = {
    "mass": {"pound": ["pound", "pounds", "lb", "lbs"], "ounce": ["ounce", "ounces", "oz"], "kilogram": ["kilogram", "kilograms", "kg"], "gram": ["gram", "grams", "g"]},
    "distance": {"mile": ["mile", "miles"], "kilometer": ["kilometer", "kilometers", "kilometre", "kilometres", "km"], "meter": ["meter", "meters", "metre", "metres"], "foot": ["foot", "feet"]},
    "volume": {"liter": ["liter", "liters", "litre", "litres"], "milliliter": ["milliliter", "milliliters", "ml"], "gallon": ["gallon", "gallons"], "cup": ["cup", "cups"]},
    "duration": {"minute": ["minute", "minutes", "min", "mins"], "hour": ["hour", "hours"], "day": ["day", "days"], "week": ["week", "weeks"], "month": ["month", "months"], "year": ["year", "years"]},
    "money": {"coin": ["coin", "coins"]},
}
#: A number with all before it up to white space, and the word after it; numbers with a currency sign or part of a name don't count.
AMOUNT, NUMBER = r"\S{0,24}\d\s?[a-z]+", r"^[\(\[\"'*]*(\d+(?:,\d\d\d)*(?:\.\d+)?)\s?[a-z]+$"


def reflex_tokens(c: Column) -> Column:
    """Lower-case words of three letters or more without stop words, each once."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), lambda x: (F.length(x) >= 3) & ~x.isin(STOP_WORDS)))


def reflex_postings(records: DataFrame, scope: str, key: str, text: str) -> DataFrame:
    """(scope, term, key) of the records: the inverted index of a scope."""
    return records.select(scope, F.explode(reflex_tokens(F.col(text))).alias("term"), key)


def reflex_recall(postings: DataFrame, scope: str, key: str, terms: list[str], k: int) -> DataFrame:
    """(scope, key, n_hits, coverage, rank): records of each scope by the share of the terms that they match."""
    hits = postings.where(F.col("term").isin([t.lower() for t in terms])).groupBy(scope, key).agg(F.countDistinct("term").alias("n_hits"))
    w = Window.partitionBy(scope).orderBy(F.col("n_hits").desc(), key)
    return hits.withColumn("coverage", F.round(F.col("n_hits") / len(terms), 6)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def region_hints(postings: DataFrame, region: str, terms: list[str]) -> DataFrame:
    """(region, term): query terms that stand in one region only and so tell it from its competitors."""
    d = postings.where(F.col("term").isin([t.lower() for t in terms])).select(region, "term").distinct()
    only = d.groupBy("term").agg(F.count("*").alias("n"), F.min(region).alias(region)).where("n = 1")
    return only.select(region, "term")


def scratchpad(records: DataFrame, salience: str, helpful: str, key: str, text: str, k: int = 5, least: float = 0.6) -> DataFrame:
    """The k most salient records (then most helpful), with a snippet of 240 characters."""
    top = records.where(F.col(salience) >= least).orderBy(F.col(salience).desc(), F.col(helpful).desc(), F.col(key)).limit(k)
    return top.select(key, F.substring(text, 1, 240).alias("snippet"), F.bround(salience, 3).alias("salience"))


def measure_sum(texts: DataFrame, scope: str, session: str, text: str) -> DataFrame:
    """(scope, family, unit, n_amounts, n_sessions, total): every amount with a unit of the texts, summed over the sessions of a scope."""
    spelled = F.create_map(*[F.lit(x) for family, units in UNITS.items() for unit, words in units.items() for w in words for x in (w, f"{family} {unit}")])
    found = texts.select(scope, session, F.explode(F.regexp_extract_all(F.lower(text), F.lit(AMOUNT), F.lit(0))).alias("m"))
    found = found.withColumn("x", F.regexp_extract("m", NUMBER, 1)).where("x <> ''").withColumn("u", F.split(spelled[F.regexp_extract("m", "[a-z]+$", 0)], " ")).where("u IS NOT NULL")
    keys = [F.col(scope), F.get("u", F.lit(0)).alias("family"), F.get("u", F.lit(1)).alias("unit")]
    total = F.round(F.sum(F.regexp_replace("x", ",", "").cast("double")), 6)
    return found.groupBy(*keys).agg(F.count("*").alias("n_amounts"), F.countDistinct(session).alias("n_sessions"), total.alias("total"))


def rocchio(query: Column, judged: DataFrame, group: str, vec: str, alpha: float = 1.0, beta: float = 0.6, gamma: float = 0.0, relevant: Column | None = None) -> DataFrame:
    """(group, pos, x): alpha * query + beta * mean of the relevant vectors - gamma * mean of the others, scaled to length 1.

    One row per dimension. Without `relevant` all judged vectors are relevant; gamma of 0 leaves the others out.
    """
    d = judged.select(group, query.alias("_q"), (F.lit(True) if relevant is None else relevant).alias("_r"), F.posexplode(vec).alias("pos", "x"))
    mean = lambda r: F.coalesce(F.avg(F.when(F.col("_r") == r, F.col("x").cast("double"))), F.lit(0.0))
    m = d.groupBy(group, "pos").agg((alpha * F.max(F.get("_q", F.col("pos"))).cast("double") + beta * mean(True) - max(0.0, gamma) * mean(False)).alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(group)))
    return m.select(group, "pos", F.when(norm == 0, F.col("x")).otherwise(F.col("x") / norm).alias("x"))


def nearest_centroid(items: DataFrame, centroids: DataFrame, threshold: float) -> DataFrame:
    """items (item_id, vec) with the nearest of the centroids (centroid_id, vec) and whether it is near enough.

    Centroids are few (16 at most in a prefetch table), so they are broadcast.
    """
    norm = F.sqrt(dot(F.col("vec"), F.col("vec")))
    c = centroids.select("centroid_id", F.col("vec").alias("cv"), norm.alias("cn"))
    # The norms are taken once a row; a zero vector is near to nothing.
    sim = F.coalesce(F.try_divide(dot(F.col("iv"), F.col("cv")), F.col("in") * F.col("cn")), F.lit(0.0))
    j = items.select("item_id", F.col("vec").alias("iv"), norm.alias("in")).crossJoin(F.broadcast(c)).withColumn("sim", F.round(sim, 6))
    best = j.groupBy("item_id").agg(F.max(F.struct("sim", -F.col("centroid_id"))).alias("b"))
    return best.select("item_id", (-F.col("b.col2")).alias("centroid_id"), F.col("b.sim").alias("sim"), (F.col("b.sim") >= threshold).alias("hit"))


def local_outliers(items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, lof): local outlier factor over the k nearest by cosine distance of every item (item_id, vec).

    Neighbours come from a blocked exact search over a stated set of items; the three passes are window aggregates.
    """
    q = items.select(F.col("item_id").alias("query_id"), "vec")
    near = cosine_topk(q, items, k + 1).where("query_id <> item_id").withColumn("d", F.greatest(F.lit(0.0), 1 - F.col("sim")))
    w = Window.partitionBy("query_id").orderBy("rank")
    near = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("query_id", "item_id", "d")
    kd = near.groupBy(F.col("query_id").alias("item_id")).agg(F.max("d").alias("kd"))
    lrd = near.join(kd, "item_id").groupBy("query_id").agg((1.0 / (F.avg(F.greatest("d", "kd")) + 1e-10)).alias("lrd"))
    other = near.join(lrd.select(F.col("query_id").alias("item_id"), F.col("lrd").alias("lo")), "item_id").groupBy("query_id").agg(F.avg("lo").alias("lo"))
    return other.join(lrd, "query_id").select(F.col("query_id").alias("item_id"), F.round(F.col("lo") / F.col("lrd"), 6).alias("lof"))


def query_clusters(items: DataFrame, k: int = 16, seed: int = 7) -> DataFrame:
    """(item_id, cluster) by k-means over the vectors, k at most 16."""
    x = items.select("item_id", array_to_vector(F.transform("vec", lambda v: v.cast("double"))).alias("features"))
    return KMeans(k=min(k, 16), seed=seed, maxIter=10).fit(x).transform(x).select("item_id", F.col("prediction").alias("cluster"))


def gate(confidence: Column, support: Column, threshold: float) -> tuple[Column, Column, Column]:
    """(passed, blended confidence, reason) of an inferred fact: half score and half support, both clipped to [0, 1]."""
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    blend = 0.5 * clip(confidence) + 0.5 * clip(support)
    return blend >= threshold, blend, F.when(blend >= threshold, "ok").otherwise("below-confidence-threshold")


def repair_route(passed: Column, contradicted: Column, coverage: Column, low: float = 0.3) -> Column:
    return F.when(passed, "SKIP").when(contradicted, "MERGE").when(F.coalesce(coverage, F.lit(0.0)) < low, "INSERT").otherwise("MERGE")


def translation_scores(triples: DataFrame, dim: int = 16, epochs: int = 20, lr: float = 0.05, margin: float = 1.0, seed: int = 0, block_rows: int = 20_000, rounds: int = 2) -> DataFrame:
    """(ns, h, r, t, score) with exp(-|h + r - t|) of embeddings fitted per namespace by margin ranking over tails.

    Iterative parameter mixing: a namespace is cut into blocks of about block_rows triples, each block is fitted on its
    own from the same start, and the vectors of its blocks are averaged after each round. So no task holds a namespace.
    Rows with a NULL take no part; a namespace within one block is fitted as a whole.
    """
    d = triples.select("ns", "h", "r", "t").dropna().distinct()
    parts = d.groupBy("ns").agg(F.ceil(F.count("*") / block_rows).alias("n"))
    d = d.join(parts, "ns").select("ns", "h", "r", "t", F.pmod(F.xxhash64("h", "r", "t"), F.col("n")).alias("block"))

    def start(c: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.xxhash64(F.lit(seed), "ns", c, i) / F.lit(2.0**63) * (6 / dim**0.5))

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["h", "r", "t"]).reset_index(drop=True)
        first = {"e": dict(zip(g["t"], g["tv"])) | dict(zip(g["h"], g["hv"])), "r": dict(zip(g["r"], g["rv"]))}
        at = {kind: {x: i for i, x in enumerate(vs)} for kind, vs in first.items()}
        h, r, t = g["h"].map(at["e"]).to_numpy(), g["r"].map(at["r"]).to_numpy(), g["t"].map(at["e"]).to_numpy()
        e, w = (np.stack(list(first[kind].values())).astype(float) for kind in "er")
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            bad = rng.integers(len(e), size=len(g))
            dp, dn = e[h] + w[r] - e[t], e[h] + w[r] - e[bad]
            far, near = np.linalg.norm(dp, axis=1), np.linalg.norm(dn, axis=1)
            on = (margin + far - near > 0)[:, None]
            gp, gn = on * dp / np.maximum(far, 1e-9)[:, None], on * dn / np.maximum(near, 1e-9)[:, None]
            np.add.at(e, h, -lr * (gp - gn))
            np.add.at(w, r, -lr * (gp - gn))
            np.add.at(e, t, lr * gp)
            np.add.at(e, bad, -lr * gn)
            e /= np.maximum(1.0, np.linalg.norm(e, axis=1, keepdims=True))
        return pd.DataFrame({"ns": g["ns"].iloc[0], "kind": ["e"] * len(e) + ["r"] * len(w), "id": [*at["e"], *at["r"]], "vec": [*e, *w]})

    v = d.withColumns({"hv": start("h"), "rv": start("r"), "tv": start("t")})
    for _ in range(rounds):
        found = v.groupBy("ns", "block").applyInPandas(fit, "ns string, kind string, id string, vec array<double>")
        mean = cut_lineage(found.groupBy("ns", "kind", "id").agg(F.array(*[F.avg(F.col("vec")[i]) for i in range(dim)]).alias("vec")))
        v = d
        for kind, c in (("e", "h"), ("r", "r"), ("e", "t")):
            v = v.join(mean.where(F.col("kind") == kind).select("ns", F.col("id").alias(c), F.col("vec").alias(c + "v")), ["ns", c])
    gap = F.zip_with(F.zip_with("hv", "rv", lambda a, b: a + b), "tv", lambda a, b: a - b)
    return v.select("ns", "h", "r", "t", F.exp(-F.sqrt(dot(gap, gap))).alias("score"))


def fingerprint(files: DataFrame, name: str, content: str) -> DataFrame:
    """(name, n_bytes, sha256) of each file: the rows whose ordered digest identifies a set of logs."""
    return files.select(F.col(name).alias("name"), F.octet_length(content).alias("n_bytes"), F.sha2(F.col(content), 256).alias("sha256"))
