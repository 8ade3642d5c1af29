"""Knowledge graph: two-hop paths, rules, co-activation, neighbourhoods and personalised PageRank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.operators.ranking import cosine
from mnemoframe.session import cut_lineage


def two_hop(edges: DataFrame, cap: int | None = 200) -> DataFrame:
    """(x, r1, y, r2, z), x <> z, of edges (h, r, t, seq); at most cap paths a start, in order of the edges' seq."""
    a = edges.select(F.col("h").alias("x"), F.col("r").alias("r1"), F.col("t").alias("y"), F.col("seq").alias("s1"))
    b = edges.select(F.col("h").alias("y"), F.col("r").alias("r2"), F.col("t").alias("z"), F.col("seq").alias("s2"))
    p = a.join(b, "y").where("x <> z")
    if cap is not None:
        p = p.withColumn("_n", F.row_number().over(Window.partitionBy("x").orderBy("s1", "s2"))).where(F.col("_n") <= cap)
    return p.select("x", "r1", "y", "r2", "z")


def mine_rules(edges: DataFrame, min_body: int = 2, min_conf: float = 0.5, cap: int | None = 200) -> DataFrame:
    """(r1, r2, r3, body, conf): share of the distinct (x, z) of a two-hop body that r3 links directly."""
    paths = two_hop(edges, cap).select("r1", "r2", "x", "z").distinct()
    body = paths.groupBy("r1", "r2").agg(F.count("*").alias("body"))
    direct = edges.select(F.col("h").alias("x"), F.col("r").alias("r3"), F.col("t").alias("z")).distinct()
    head = paths.join(direct, ["x", "z"]).groupBy("r1", "r2", "r3").agg(F.count("*").alias("head"))
    j = head.join(body, ["r1", "r2"]).withColumn("conf", F.col("head") / F.col("body"))
    return j.where((F.col("body") >= min_body) & (F.col("conf") >= min_conf)).select("r1", "r2", "r3", "body", F.round("conf", 6).alias("conf"))


def apply_rules(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """(x, r3, z, conf): facts that rules imply and the graph lacks, with the greatest confidence of a rule for each."""
    paths = two_hop(edges, None).select("r1", "r2", "x", "z").distinct()
    new = paths.join(rules.select("r1", "r2", "r3", "conf"), ["r1", "r2"]).groupBy("x", "r3", "z").agg(F.max("conf").alias("conf"))
    return new.join(edges.select(F.col("h").alias("x"), F.col("r").alias("r3"), F.col("t").alias("z")), ["x", "r3", "z"], "left_anti")


def coactivation(access: DataFrame, group: list[str], item: str) -> DataFrame:
    """(a, b, n): how many groups hold both items. Each group's distinct items are few (one turn's confirmed ids)."""
    d = access.select(*group, item).distinct()
    return d.select(*group, F.col(item).alias("a")).join(d.select(*group, F.col(item).alias("b")), group).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def edges_touching(edges: DataFrame, names: list[str], src: str, dst: str) -> DataFrame:
    """Edges with an end among the names, whatever the case."""
    wanted = [n.lower() for n in names]
    return edges.where(F.lower(src).isin(wanted) | F.lower(dst).isin(wanted))


def edge_coherence(edges: DataFrame, vectors: DataFrame, a: str, b: str, key: str, vec: str) -> DataFrame:
    """edges (a, b) with coherence, the cosine of the vectors of their ends; 0.5 where one is missing."""
    side = lambda c: vectors.select(F.col(key).alias(c), F.col(vec).alias(f"_{c}"))
    j = edges.join(side(a), a, "left").join(side(b), b, "left")
    return j.withColumn("coherence", F.coalesce(cosine(F.col(f"_{a}"), F.col(f"_{b}")), F.lit(0.5))).drop(f"_{a}", f"_{b}")


def blend_anomaly(parts: list[tuple[float, Column]]) -> Column:
    """Weighted sum of signals in [0, 1], more for the more anomalous; a missing signal counts as a half."""
    return sum(w * F.coalesce(c, F.lit(0.5)) for w, c in parts)


def khop(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(node, hop): nodes within hops of the seeds along undirected edges (a, b), with the least number of steps."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    found = seeds.select("node").distinct().withColumn("hop", F.lit(0))
    for i in range(1, hops + 1):
        step = found.where(F.col("hop") == i - 1).join(both, F.col("node") == F.col("a")).select(F.col("b").alias("node"), F.lit(i).alias("hop"))
        found = cut_lineage(found.unionByName(step).groupBy("node").agg(F.min("hop").alias("hop")))
    return found


def pagerank(edges: DataFrame, seeds: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(node, score): personalised PageRank from the seeds along undirected edges; damping and rounds are our choice.

    One shuffle join and one partial aggregate a round; each round is checkpointed.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut_lineage(both.withColumn("deg", F.count("*").over(Window.partitionBy("a"))))
    n = seeds.select("node").distinct().count()
    base = seeds.select("node").distinct().withColumn("base", F.lit(1.0 / max(1, n)))
    rank = base.withColumnRenamed("base", "score")
    for _ in range(rounds):
        flow = rank.join(both, F.col("node") == F.col("a")).groupBy(F.col("b").alias("node")).agg(F.sum(F.col("score") / F.col("deg")).alias("in"))
        rank = cut_lineage(flow.join(base, "node", "full").select("node", (damping * F.coalesce("in", F.lit(0.0)) + (1 - damping) * F.coalesce("base", F.lit(0.0))).alias("score")))
    return rank
