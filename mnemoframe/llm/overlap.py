"""The same question and answer in training and evaluation splits, by a weighted cosine join.

Questions are vectors of term weights. Inverted lists hold only the heaviest terms of each vector: once the norm of what
is left falls below the threshold, a pair that shares none of the listed terms can't reach it. The terms met, the greatest
weights and the residual norms bound the cosine of a candidate; exact dot products and a comparison of the words that
differ decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoframe.functions.text import norm_words, plain_text
from mnemoframe.session import cut_lineage

THRESHOLD = 0.45
#: A term in more than this share of the questions is joined by broadcast: with words once per question there can't be
#: more such terms than the mean number of words divided by the share.
COMMON = 0.01
#: Words in less than this share of the questions all weigh the same, so that the cosine of a pair doesn't fall as others
#: are added and its own rare words grow rarer.
RAREST = 1 / 5000
#: An entry of the inverted lists (term and gold) with more classes of one side than this is spread over that side's parts.
HOT = 2000
#: A word of so many questions is an established one, and no slip of another.
ESTABLISHED = 3

_ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
_BASE = "aaaaaaeeeeiiiiooooouuuuncyy"


def question_words(c: Column) -> Column:
    return norm_words(F.translate(F.lower(plain_text(c)), _ACCENTED, _BASE))


def gold_key(c: Column) -> Column:
    """Gold without case, punctuation and white space; NULL where nothing is left."""
    key = F.array_join(norm_words(c), "")
    return F.when(key != "", key)


def _vocabulary(classes: DataFrame) -> DataFrame:
    """(term, df, entity): entity words are numbers, words mostly written with a capital, and words of the objects in golds.

    The share of capitals is taken within sentences, over all questions; 'the x y' golds tell the words of objects.
    """
    n = F.count("*")
    seen = classes.select("class", F.explode(F.regexp_extract_all(plain_text("question"), F.lit(r"(?<=[\p{L}\p{N},;] )[\p{L}\p{N}]+"), F.lit(0))).alias("raw"))
    raw = seen.groupBy(F.translate(F.lower("raw"), _ACCENTED, _BASE).alias("term")).agg(F.avg(F.col("raw").rlike(r"^\p{Lu}").cast("double")).alias("capital"))
    objects = F.flatten(F.transform(F.regexp_extract_all(F.lower("gold"), F.lit(r"\bthe \p{L}+ \p{L}+(?=$|[,.\" ])"), F.lit(0)), lambda x: F.slice(F.split(x, " "), 2, 2)))
    things = classes.where(F.lower("gold").rlike(r"^\W*the \p{L}+ \p{L}+\W*$")).select("class", F.explode(objects).alias("term")).groupBy("term").agg(n.alias("things"))
    terms = classes.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(n.alias("df"))
    joined = terms.join(raw, "term", "left").join(things.where("things >= 2"), "term", "left")
    entity = F.col("term").rlike(r"\p{N}") | (F.coalesce("capital", F.lit(0.0)) > 0.5) | F.col("things").isNotNull()
    return joined.select("term", "df", entity.alias("entity"))


def _vectors(classes: DataFrame, total: int) -> DataFrame:
    """(class, gold, vec): vec is ARRAY<STRUCT<w, term, df, entity>>, heaviest first, of norm 1."""
    vocabulary = cut_lineage(_vocabulary(classes))
    rows = classes.select("class", "key", F.explode(F.array_distinct("words")).alias("term"))
    common = F.broadcast(vocabulary.where(F.col("df") > COMMON * total))
    rare = rows.join(common.select("term"), "term", "left_anti").join(vocabulary.where(F.col("df") <= COMMON * total), "term")
    known = rows.join(common, "term").unionByName(rare)
    weight = F.least(F.log(F.lit(float(total + 1)) / F.col("df")), -F.log(F.lit(RAREST))) + 0.05
    v = known.groupBy("class", "key").agg(F.sort_array(F.collect_list(F.struct(weight.alias("w"), "term", "df", "entity")), False).alias("vec"))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
    v = v.withColumn("norm", norm)
    return v.select("class", "key", F.transform("vec", lambda x: F.struct((x["w"] / F.col("norm")).alias("w"), x["term"].alias("term"), x["df"].alias("df"), x["entity"].alias("entity"))).alias("vec"))


def _listed(v: DataFrame, threshold: float) -> DataFrame:
    """Inverted lists: (term, key, class, w, after, n): the terms before which the rest's norm still reaches the threshold.

    after and n are the norm and the number of the terms that follow in the vector.
    """
    left = lambda i: F.sqrt(F.aggregate(F.slice("vec", i, F.size("vec")), F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
    after = lambda i: F.when(i + 2 <= F.size("vec"), left(i + 2)).otherwise(0.0)
    marked = F.transform("vec", lambda x, i: F.struct(x["term"].alias("term"), x["w"].alias("w"), left(i + 1).alias("left"), after(i).alias("after"), (F.size("vec") - i - 1).alias("n")))
    return v.select("class", "key", F.inline(F.filter(marked, lambda x: x["left"] >= threshold))).drop("left")


def _slip(a: Column, b: Column) -> Column:
    """Whether two words are one but for a slip of spelling: near, no numbers, and not both established."""
    near = F.levenshtein(a["term"], b["term"]) <= F.when(F.length(a["term"]) >= 5, 2).otherwise(1)
    return near & ~a["term"].rlike(r"\p{N}") & ~b["term"].rlike(r"\p{N}") & ~(a["entity"] & b["entity"] & (a["df"] >= ESTABLISHED) & (b["df"] >= ESTABLISHED))


def _same_question(a: str, b: str) -> Column:
    """No entity word of one side is replaced on the other, and most words are shared."""
    only = lambda x, y: F.filter(x, lambda p: ~F.exists(y, lambda q: q["term"] == p["term"]))
    xa, xb = only(F.col(a), F.col(b)), only(F.col(b), F.col(a))
    changed = lambda x, y: F.size(F.filter(x, lambda p: p["entity"] & ~F.exists(y, lambda q: _slip(p, q))))
    shared = F.size(a) - F.size(xa)
    return (F.least(changed(xa, xb), changed(xb, xa)) == 0) & (F.greatest(changed(xa, xb), changed(xb, xa)) <= 1) & (shared * 2 >= F.least(F.size(a), F.size(b)))


def _candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """a (term, key, ca, ...) and b (term, key, cb, ...) joined on (term, key).

    An entry that many classes of one side share, such as a frequent gold, is cut into parts by the class's hash, and met
    by every class of the other side in each part, so that no task holds a whole one.
    """
    sizes = a.groupBy("term", "key").agg(F.count("*").alias("n")).where(F.col("n") > HOT)
    parts = sizes.select("term", "key", F.ceil(F.col("n") / HOT).cast("int").alias("parts"))
    one = lambda d: d.join(parts, ["term", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    x = one(a).withColumn("part", F.pmod(F.xxhash64("ca"), F.col("parts")).cast("int")).drop("parts")
    y = one(b).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return x.join(y, ["term", "key", "part"])


def overlapping_classes(samples: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(links (ca, cb), members (class, sample_id, train, split, dataset)) of classes alike, train on the left.

    Samples whose question and gold agree but for case, punctuation, white space, markup and forms of characters are one
    class, and classes are joined; a class with both kinds of samples is linked to itself. Questions without words, golds
    without letters or digits, NULL ids and other splits belong to no class.
    """
    s = samples.select("sample_id", "dataset", F.lower(F.trim("split")).alias("split"), "question", "gold").where("sample_id IS NOT NULL").distinct()
    s = s.select("sample_id", "dataset", (F.col("split") == "train").alias("train"), "split", "question", "gold", question_words(F.col("question")).alias("words"), gold_key(F.col("gold")).alias("key"))
    s = s.withColumn("class", F.xxhash64(F.array_join("words", " "), "key"))
    # Generators keep the optimizer from computing the words again in a filter.
    s = cut_lineage(s.select("sample_id", "dataset", "train", "split", "question", "gold", "words", "key", "class")).where("split IN ('train', 'validation', 'test') AND size(words) > 0 AND key IS NOT NULL")
    classes = cut_lineage(s.groupBy("class").agg(F.min("key").alias("key"), F.min("words").alias("words"), F.min("question").alias("question"), F.min("gold").alias("gold"), F.max("train").alias("has_train"), F.min("train").alias("all_train")))
    total = classes.count()
    v = cut_lineage(_vectors(classes, total))
    listed = _listed(v, threshold).join(classes.select("class", "has_train", "all_train"), "class")
    a = listed.where("has_train").select("term", "key", F.col("class").alias("ca"), F.col("w").alias("wa"), F.col("after").alias("ra"), F.col("n").alias("na"))
    b = listed.where("NOT all_train").select("term", "key", F.col("class").alias("cb"), F.col("w").alias("wb"), F.col("after").alias("rb"), F.col("n").alias("nb"))
    sums = [F.sum(F.col("wa") * F.col("wb")).alias("dot"), *[F.min(c).alias(c) for c in ("ra", "rb", "na", "nb", "wa", "wb")]]
    met = _candidates(a, b).where("ca <> cb").groupBy("ca", "cb").agg(*sums)
    # All terms come in one order, so what both have before the last term they met at is in dot. What follows adds no
    # more than the product of the norms of the rests, nor than their greatest weights times their number of terms.
    bound = F.col("dot") + F.least(F.col("ra") * F.col("rb"), F.least("na", "nb") * F.col("wa") * F.col("wb"))
    met = met.where(bound >= threshold - 1e-9).select("ca", "cb")
    va, vb = v.select(F.col("class").alias("ca"), F.col("vec").alias("va")), v.select(F.col("class").alias("cb"), F.col("vec").alias("vb"))
    full = met.join(va, "ca").join(vb, "cb")
    dot = F.aggregate("va", F.lit(0.0), lambda acc, x: acc + x["w"] * F.coalesce(F.get(F.filter("vb", lambda y: y["term"] == x["term"]), F.lit(0))["w"], F.lit(0.0)))
    near = full.where((dot >= threshold) & _same_question("va", "vb")).select("ca", "cb")
    both = classes.where("has_train AND NOT all_train").select(F.col("class").alias("ca"), F.col("class").alias("cb"))
    return near.unionByName(both), s.select("class", "sample_id", "train", "split", "dataset").distinct()


def overlapping_pairs(samples: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(sample_id_a, sample_id_b, train_id, eval_id, split, dataset): a train sample and a validation or test sample alike.

    sample_id_a is the smaller id. split and dataset are those of the evaluation sample. The links of overlapping_classes,
    with their members: as many rows as there are such pairs.
    """
    links, s = overlapping_classes(samples, threshold)
    t = s.where("train").select(F.col("class").alias("ca"), F.col("sample_id").alias("train_id")).distinct()
    e = s.where("NOT train").select(F.col("class").alias("cb"), F.col("sample_id").alias("eval_id"), "split", "dataset").distinct()
    out = links.join(t, "ca").join(e, "cb").where("train_id <> eval_id")
    return out.select(F.least("train_id", "eval_id").alias("sample_id_a"), F.greatest("train_id", "eval_id").alias("sample_id_b"), "train_id", "eval_id", "split", "dataset").distinct()


def overlap_counts(samples: DataFrame) -> DataFrame:
    """(split, dataset, n_pairs, n_eval, n_train) of the overlapping pairs, per split and dataset of the evaluation sample.

    Counted on classes and their sizes: no pair of samples is written out.
    """
    links, s = overlapping_classes(samples)
    links = cut_lineage(links.distinct())
    train = s.where("train").groupBy(F.col("class").alias("ca")).agg(F.countDistinct("sample_id").alias("nt"))
    held = s.where("NOT train").groupBy(F.col("class").alias("cb"), "split", "dataset").agg(F.countDistinct("sample_id").alias("ne"))
    j = links.join(train, "ca").join(held, "cb")
    none = F.lit(0).cast("bigint")
    rows = j.select("split", "dataset", (F.col("nt") * F.col("ne")).alias("n_pairs"), none.alias("n_eval"), none.alias("n_train"))
    rows = rows.unionByName(j.select("cb", "split", "dataset", none.alias("n_pairs"), F.col("ne").alias("n_eval"), none.alias("n_train")).distinct().drop("cb"))
    rows = rows.unionByName(j.select("ca", "split", "dataset", none.alias("n_pairs"), none.alias("n_eval"), F.col("nt").alias("n_train")).distinct().drop("ca"))
    return rows.groupBy("split", "dataset").agg(*[F.sum(c).alias(c) for c in ("n_pairs", "n_eval", "n_train")])
