"""Splits that keep related records together.

Records that share an entity are linked in two-level stars, connected components come from alternating large-star and
small-star steps, and the component's hash falls into a range of its stratum that belongs to one split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.session import cut_lineage

# Texts that name nobody and nothing, and mere roles.
NO_VALUE = [
    "", "-", "--", "?", ".", "n/a", "na", "n.a.", "none", "null", "nil", "nan", "unknown", "anonymous", "anon", "nobody", "no one", "noone",
    "nothing", "unspecified", "undefined", "not known", "not available", "not specified", "missing", "tbd", "unbekannt", "desconocido", "anonym",
    "user", "assistant", "system", "human", "bot", "agent", "ai", "model", "tool", "annotator", "author", "speaker", "guest",
]

#: The members of a hub are spread over so many parts, so that no task sees a whole hub.
SALTS = 16
PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}
HASH_BINS = 1000


def entity_value(c: Column, person: bool = False) -> Column:
    """Comparable form of an entity: one case, single spaces, 'Last, First' turned round; NULL where it says nothing."""
    plain = F.lower(F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " ")))
    plain = F.regexp_replace(plain, r"^([^,]*[^, ]) ?, ?([^,]+)$", "$2 $1") if person else plain
    return F.when(~plain.isin(NO_VALUE), plain)


def conversation(sample_id: Column) -> Column:
    """Conversation part of a sample_id: all before the question's number and its mark, in each dataset's style."""
    return F.regexp_replace(F.trim(sample_id), r"[_/.\-:]?[qQ]?\d+$", "")


def _halves(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with m, the least v of its u. Hubs are aggregated in SALTS parts, whose minima are then joined."""
    e = edges.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    parts = e.groupBy("u", "part").agg(F.min("v").alias("m"))
    least = parts.withColumn("m", F.min("m").over(Window.partitionBy("u")))
    return e.join(least, ["u", "part"]).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    x = _halves(both).where("v > u")
    return x.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    x = _halves(edges)
    return x.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(x.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v): v is the least node of u's component; least nodes themselves have no row.

    edges: (u, v) of any orientable type, u > v. Alternates large-star and small-star until neither changes an edge;
    each round is checkpointed, so that the plan stays short and a lost executor costs no earlier round.
    """
    current, seen = cut_lineage(edges.where("u > v").distinct()), None
    while True:
        state = tuple(current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == seen or state[0] == 0:
            return current
        seen = state
        current = cut_lineage(_small_star(_large_star(current)))


def related_groups(samples: DataFrame) -> DataFrame:
    """(sample_id, group_id): group_id is the least sample_id of all samples that must stay together.

    Samples belong together through one conversation of one dataset, one author, one source_ref or one entity, across
    datasets, and transitively. Rows without sample_id give no row; repeated rows count once; if copies of a sample_id
    differ, the values of all copies link it. A NULL dataset is a dataset of its own.
    """
    s = samples.select("sample_id", "dataset", "author", "source_ref", "entity").where("sample_id IS NOT NULL").distinct()
    # Numbers for nodes: minima and joins of them are cheap. The written table keeps them as they are.
    ids = cut_lineage(s.select("sample_id").distinct().withColumn("id", F.monotonically_increasing_id()))
    s = s.join(ids, "sample_id")
    key = lambda kind, v: F.concat(F.lit(kind + "\u0001"), v)
    keys = F.array(
        key("c", F.concat_ws("\u0001", F.coalesce("dataset", F.lit("\u0002")), conversation(F.col("sample_id")))),
        key("a", entity_value(F.col("author"), person=True)),
        key("s", entity_value(F.col("source_ref"))),
        key("e", entity_value(F.col("entity"))),
    )
    member = s.select(F.explode(F.array_compact(keys)).alias("key"), "id").select(F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("key"), "key").alias("k2"), "id", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("part"))
    # Two-level stars: to the least sample of the part, and from there to the least of all parts of the key.
    near = member.withColumn("m", F.min("id").over(Window.partitionBy("k1", "k2", "part")))
    far = member.groupBy("k1", "k2", "part").agg(F.min("id").alias("u")).withColumn("v", F.min("u").over(Window.partitionBy("k1", "k2")))
    edges = near.select(F.col("id").alias("u"), F.col("m").alias("v")).unionByName(far.select("u", "v"))
    roots = connected_components(edges)
    placed = ids.join(roots, F.col("id") == F.col("u"), "left").select("sample_id", F.coalesce("v", "id").alias("root"))
    least = placed.groupBy("root").agg(F.min("sample_id").alias("group_id"))
    return placed.join(least, "root").select("sample_id", "group_id")


def assign_splits(samples: DataFrame, proportions: dict[str, float] | None = None) -> DataFrame:
    """(sample_id, group_id, category, split) with no group in two splits.

    A group's stratum is the most frequent category of its samples. The stratum's hash bins are cut where the counted
    samples reach the proportions, so the shares hold per category as far as whole groups allow. At most HASH_BINS rows
    per category decide the cuts, whatever the number of samples. Category NULL counts as 'unknown'.
    """
    wanted = proportions or PROPORTIONS
    total = sum(wanted.values())
    groups = cut_lineage(related_groups(samples))
    label = F.coalesce(F.regexp_replace(F.lower(F.trim("category")), r"[\s\-]+", "_"), F.lit("unknown"))
    cats = samples.where("sample_id IS NOT NULL").groupBy("sample_id").agg(F.min(label).alias("category"))
    rows = groups.join(cats, "sample_id")
    sizes = rows.groupBy("group_id", "category").agg(F.count("*").alias("n"))
    strata = sizes.groupBy("group_id").agg(F.max_by("category", F.struct("n", "category")).alias("stratum"), F.sum("n").alias("n"))
    strata = strata.withColumn("bin", F.pmod(F.xxhash64("group_id"), F.lit(HASH_BINS)).cast("int"))
    bins = strata.groupBy("stratum", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("stratum")
    middle = (F.sum("n").over(w.orderBy("bin")) - F.col("n") / 2) / F.sum("n").over(w)
    split, edge = F.lit(list(wanted)[-1]), total
    for name in reversed(list(wanted)[:-1]):
        edge = sum(list(wanted.values())[: list(wanted).index(name) + 1])
        split = F.when(middle <= edge / total, name).otherwise(split)
    cuts = bins.select("stratum", "bin", split.alias("split"))
    return rows.join(strata.select("group_id", "stratum", "bin"), "group_id").join(cuts, ["stratum", "bin"]).select("sample_id", "group_id", "category", "split")
