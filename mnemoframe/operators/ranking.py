"""Ranking: score fusion, cut-offs, lexical and vector search, diversity, Pareto fronts, successive halving, Markov."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.session import cut_lineage


def fuse_scores(long: DataFrame, query: str, item: str, channel: str, score: str, method: str, weights: dict[str, float] | None = None, k: int = 60) -> DataFrame:
    """Fused score per query and item of a long table (query, channel, item, score); an absent item adds nothing.

    zscore (population deviation, 0 where constant), minmax, dbsf (mean -/+ 3 deviations clipped to [0, 1]), rrf, borda.
    """
    w = Window.partitionBy(query, channel)
    s = F.col(score)
    mean, dev, lo, hi = F.avg(s).over(w), F.stddev_pop(s).over(w), F.min(s).over(w), F.max(s).over(w)
    rank = F.row_number().over(w.orderBy(s.desc(), item))
    zero = F.lit(0.0)
    forms = {
        "zscore": F.when(dev == 0, zero).otherwise((s - mean) / dev),
        "minmax": F.when(hi == lo, zero).otherwise((s - lo) / (hi - lo)),
        "dbsf": F.when(dev == 0, zero).otherwise(F.greatest(zero, F.least(F.lit(1.0), (s - (mean - 3 * dev)) / (6 * dev)))),
        "rrf": 1.0 / (k + rank),
        "borda": (F.count("*").over(w) - rank + 1).cast("double"),
    }
    if method not in forms:
        raise ValueError(f"unknown fusion method: {method}")
    weight = F.lit(1.0)
    for name, x in (weights or {}).items():
        weight = F.when(F.col(channel) == name, F.lit(float(x))).otherwise(weight)
    return long.withColumn("_f", weight * forms[method]).groupBy(query, item).agg(F.sum("_f").alias("fused"))


def with_priors(fused: DataFrame, places: DataFrame, keys: Sequence[str], weight: float) -> DataFrame:
    """fused (keys, score) plus weight / place of each item whose type has a place (from 1) in the order wanted."""
    j = fused.join(places.select(*keys, "place"), list(keys), "left")
    return j.withColumn("score", F.round(F.col("score") + F.coalesce(weight / F.col("place"), F.lit(0.0)), 6)).drop("place")


def adaptive_k(scored: DataFrame, query: str, score: str, item: str, min_k: int = 1, max_k: int | None = None) -> DataFrame:
    """k at the first largest gap between neighbours within [min_k, max_k]; a flat list keeps min_k."""
    w = Window.partitionBy(query).orderBy(F.col(score).desc(), item)
    g = scored.withColumn("k", F.row_number().over(w)).withColumn("gap", F.col(score) - F.lead(score).over(w))
    inside = F.col("gap").isNotNull() & (F.col("k") >= min_k) & (F.col("k") <= (max_k or 2**31 - 1))
    pick = F.max_by("k", F.when(inside, F.struct("gap", -F.col("k"))))
    return g.groupBy(query).agg(F.count("*").alias("n"), F.coalesce(pick, F.least(F.lit(min_k), F.count("*"))).cast("int").alias("k"))


def score_gates(scored: DataFrame, query: str, score: str) -> DataFrame:
    """Margin of the first over the second score and normalised entropy of the softmax, per query."""
    w = Window.partitionBy(query)
    d = scored.withColumn("_e", F.exp(F.col(score) - F.max(score).over(w)))
    d = d.withColumn("_p", F.col("_e") / F.sum("_e").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.col(score).desc())))
    top = lambda r: F.max(F.when(F.col("_r") == r, F.col(score)))
    entropy = F.sum(F.when(F.col("_p") > 0, -F.col("_p") * F.log("_p")).otherwise(0.0))
    g = d.groupBy(query).agg(F.count("*").alias("n"), top(1).alias("s1"), top(2).alias("s2"), entropy.alias("h"))
    return g.select(query, "n", F.round(F.col("s1") - F.coalesce("s2", F.lit(0.0)), 6).alias("margin"), F.round(F.when(F.col("n") <= 1, 0.0).otherwise(F.col("h") / F.log("n")), 6).alias("entropy"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def cosine_topk(queries: DataFrame, items: DataFrame, k: int, block_rows: int = 4096, item_rows: int = 65536) -> DataFrame:
    """(query_id, item_id, sim, rank): exact top k of items (item_id, vec) for a stated set of queries (query_id, vec).

    Queries and items lie on a grid of blocks of bounded size; each cell is one matrix product in one task, and only k
    rows a query leave it. The driver sees two counts. A NULL vector or id takes no part, a zero vector has similarity 0,
    and only vectors of one length meet. Ties go to the smaller item_id.
    """
    q = queries.select("query_id", F.col("vec").alias("qv")).where("vec IS NOT NULL AND query_id IS NOT NULL")
    x = items.select("item_id", "vec").where("vec IS NOT NULL AND item_id IS NOT NULL")
    n_rows, n_cols = (max(1, math.ceil(df.count() / most)) for df, most in ((q, block_rows), (x, item_rows)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.select(F.size("qv").alias("dim"), block("query_id", n_rows).alias("row"), every(n_cols).alias("col"), "query_id", "qv")
    x = x.select(F.size("vec").alias("dim"), every(n_rows).alias("row"), block("item_id", n_cols).alias("col"), "item_id", "vec")

    def unit(vecs: pd.Series) -> np.ndarray:
        m = np.stack(vecs.to_list()).astype(np.float64)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(n == 0, 1, n)

    def best(qs: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
        if qs.empty or xs.empty:
            return pd.DataFrame({"query_id": [], "item_id": [], "sim": []})
        xs = xs.sort_values("item_id")
        s = unit(qs["qv"]) @ unit(xs["vec"]).T
        kk = min(k, s.shape[1])
        order = np.argsort(-np.round(s, 9), axis=1, kind="stable")[:, :kk]
        return pd.DataFrame({"query_id": np.repeat(qs["query_id"].to_numpy(), kk), "item_id": xs["item_id"].to_numpy()[order].ravel(), "sim": np.take_along_axis(s, order, 1).ravel()})

    cell = ["dim", "row", "col"]
    found = q.groupBy(*cell).cogroup(x.groupBy(*cell)).applyInPandas(best, "query_id bigint, item_id bigint, sim double")
    w = Window.partitionBy("query_id").orderBy(F.round("sim", 9).desc(), "item_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def asked_postings(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(term, doc_id, tf) of docs (doc_id, w) for the terms of the queries alone: the others go before the shuffle."""
    return docs.select("doc_id", F.explode("w").alias("term")).join(queries.select("term").distinct(), "term", "left_semi").groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def bm25(postings: DataFrame, lengths: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score, rank): top k documents of postings (term, doc_id, tf), lengths (doc_id, dl), queries (query_id, term).

    Only postings of the queries' terms are weighed. k1, b and the idf form are this library's configuration.
    """
    stats = lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    hit = postings.join(queries.select("term").distinct(), "term", "left_semi")
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    w = hit.join(df, "term").join(lengths, "doc_id").crossJoin(F.broadcast(stats))  # one row of statistics
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    w = w.select("term", "doc_id", (idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).alias("s"))
    g = w.join(queries, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return g.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mmr(shortlist: DataFrame, query: str, item: str, relevance: str, vec: str, k: int, lam: float = 0.5) -> DataFrame:
    """(query, item, position): greedy maximal marginal relevance on a bounded shortlist per query.

    Relevance is scaled to [0, 1] (0.5 where constant), similarity to what is chosen counts from 0, ties go to the
    first by relevance and id.
    """
    types = {f.name: f.dataType.simpleString() for f in shortlist.schema.fields}

    def greedy(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([relevance, item], ascending=[False, True]).reset_index(drop=True)
        x = np.stack(g[vec].to_list()).astype(np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        r = g[relevance].to_numpy(dtype=float)
        r = (r - r.min()) / (r.max() - r.min()) if r.max() > r.min() else np.full(len(r), 0.5)
        near, left, out = np.zeros(len(r)), np.ones(len(r), bool), []
        for _ in range(min(k, len(r))):
            j = int(np.argmax(np.where(left, lam * r - (1 - lam) * near if out else r, -np.inf)))
            out.append(j)
            left[j] = False
            near = np.maximum(near, x @ x[j])
        return pd.DataFrame({query: g[query].iloc[0], item: g[item].iloc[out].to_numpy(), "position": range(1, len(out) + 1)})

    return shortlist.groupBy(query).applyInPandas(greedy, f"{query} {types[query]}, {item} {types[item]}, position int")


def pareto_front(points: DataFrame, x: str, y: str) -> DataFrame:
    """Points no other point dominates (both at most as large, one smaller), both minimised.

    The least y of each x, and of all smaller x, decide. The minima over smaller x are taken over ranges of x first, so
    that the running minimum spans ranges and not points.
    """
    cols = points.columns
    best = points.where(f"{x} IS NOT NULL AND {y} IS NOT NULL").groupBy(x).agg(F.min(y).alias("_m"))
    parts = best.repartitionByRange(F.col(x)).withColumn("_p", F.spark_partition_id())
    inner = Window.partitionBy("_p").orderBy(x)
    local = parts.withColumn("_before", F.min("_m").over(inner.rowsBetween(Window.unboundedPreceding, -1)))
    spans = local.groupBy("_p").agg(F.min("_m").alias("_pm"))  # one row a partition
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    prior = spans.withColumn("_prior", F.min("_pm").over(w)).select("_p", "_prior")
    kept = local.join(F.broadcast(prior), "_p").where((F.least("_before", "_prior").isNull()) | (F.col("_m") < F.least("_before", "_prior")))
    return points.join(kept.select(x, F.col("_m").alias(y)), [x, y], "left_semi").select(*cols)


def hypervolume_2d(front: DataFrame, x: str, y: str, ref_x: float, ref_y: float) -> DataFrame:
    """Area between a two-dimensional front and a reference point; points beyond the reference don't count."""
    inside = front.where((F.col(x) <= ref_x) & (F.col(y) <= ref_y)).select(x, y).distinct()
    w = Window.orderBy(x)  # a front is small next to its points
    return inside.withColumn("_next", F.lead(x, 1, ref_x).over(w)).agg(F.round(F.coalesce(F.sum((F.col("_next") - F.col(x)) * (ref_y - F.col(y))), F.lit(0.0)), 4).alias("hv"), F.count("*").alias("n_front"))


def crowding_distance(points: DataFrame, group: str, item: str, objectives: Sequence[str]) -> DataFrame:
    """Crowding distance within a group: per objective (next - previous) / span, infinite at the ends, ties by item."""
    d = points
    for i, o in enumerate(objectives):
        w = Window.partitionBy(group).orderBy(o, item)
        span = F.max(o).over(Window.partitionBy(group)) - F.min(o).over(Window.partitionBy(group))
        gap = F.lead(o).over(w) - F.lag(o).over(w)
        d = d.withColumn(f"_d{i}", F.when(span == 0, 0.0).otherwise(gap / span)).withColumn(f"_i{i}", (span != 0) & gap.isNull())
    n = range(len(objectives))
    ends = F.greatest(*[F.col(f"_i{i}").cast("int") for i in n]) == 1
    total = F.round(sum((F.coalesce(f"_d{i}", F.lit(0.0)) for i in n), F.lit(0.0)), 6)
    return d.select(group, item, ends.alias("is_inf"), F.when(~ends, total).alias("distance"))


def halving_rungs(trials: DataFrame, item: str, score: Column, least: int = 1, most: int = 9, eta: int = 3) -> DataFrame:
    """(rung, budget, n_in, n_out) of successive halving that keeps ceil(n / eta) a rung; budgets least * eta**i, then most."""
    if least < 1 or eta < 2:
        raise ValueError("least >= 1 and eta >= 2 are required")
    budgets, b = [], least
    while b < most:
        budgets.append(b)
        b *= eta
    budgets.append(most)
    n, rows = trials.count(), []
    for i, b in enumerate(budgets):
        out = math.ceil(n / eta)
        rows.append((i, b, n, out))
        n = out
    return trials.sparkSession.createDataFrame(rows, "rung int, budget int, n_in bigint, n_out bigint")


def successive_halving(scores: DataFrame, item: str, budget: str, score: str, budgets: Sequence[int], eta: int = 3) -> DataFrame:
    """(budget, n_in, n_out, survivor, score): each rung keeps the best ceil(n / eta) of those left by their score at its budget.

    scores (item, budget, score) has every trial's score at every budget, NULL counting as the worst; ties go to the
    smaller item. Stops when one is left. Trials are few next to what they are scored on.
    """
    if not budgets or min(budgets) < 1 or eta < 2:
        raise ValueError("budgets of 1 or more and eta >= 2 are required")
    spark = scores.sparkSession
    alive, rows = scores.select(item).distinct(), []
    n = alive.count()
    for b in budgets:
        if n == 0:
            break
        out = math.ceil(n / eta)
        at = scores.where(F.col(budget) == b).select(item, score)
        alive = cut_lineage(alive.select(item).join(at, item, "left").orderBy(F.col(score).desc_nulls_last(), item).limit(out))
        best = alive.orderBy(F.col(score).desc_nulls_last(), item).first()
        rows.append((b, n, out, best[item], best[score]))
        n = out
        if n <= 1:
            break
    kind = dict((f.name, f.dataType.simpleString()) for f in scores.schema.fields)
    return spark.createDataFrame(rows, f"budget int, n_in bigint, n_out bigint, survivor {kind[item]}, score {kind[score]}")


def transitions(events: DataFrame, key: str, state: str, order: Sequence[str]) -> DataFrame:
    """(cur, nxt, n, prob): counts of consecutive states within a key, and their share of the current state's total."""
    nxt = F.lead(state).over(Window.partitionBy(key).orderBy(*order))
    g = events.select(F.col(state).alias("cur"), nxt.alias("nxt")).where("nxt IS NOT NULL").groupBy("cur", "nxt").agg(F.count("*").alias("n"))
    return g.withColumn("prob", F.col("n") / F.sum("n").over(Window.partitionBy("cur")))


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
