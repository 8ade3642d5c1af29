"""Mixing sources to target weights.

A classifier fitted on labelled documents gives every document its posteriors over the sources; the document's own label,
where it has one, is strong evidence on top. Projected gradient steps fit nonnegative rates per document whose expected
tokens per source meet the targets as far as the caps on repetition allow.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import HashingTF, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoframe.functions.text import norm_words
from mnemoframe.session import cut_lineage

#: Fixed value: the split pattern published with byte-pair vocabularies of this kind.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The classifier is fitted on at most about this many labelled documents, chosen by hash.
MAX_LABELLED = 20_000
#: A given label is right with this probability, and this part of a posterior is spread over all sources alike, as naive
#: Bayes is too sure of itself. A label thus outweighs the words, and a document without one goes by its words.
TRUST, SPREAD = 0.9999, 0.01
#: Decimal places of a membership: documents with equal ones are added up before the fit.
PLACES = 3
STEPS, RATE = 40, 0.7
#: A source is short if the fit leaves more than this part of the corpus missing from its share.
TOLERANCE = 1e-4


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """df without the text column, with n_tokens of the tokenizer whose vocabulary file is at path (0 for NULL)."""
    keep = [f for f in df.schema.fields if f.name != text]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(path)
        for b in batches:
            n = [len(x) for x in enc.encode_ordinary_batch(b[text].fillna("").tolist(), num_threads=1)]
            yield b.drop(columns=text).assign(n_tokens=n)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return df.mapInPandas(run, f"{schema}, n_tokens bigint")


def source_name(c: Column) -> Column:
    """One spelling per source: lower case, underscores; NULL where blank."""
    x = F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")
    return F.when(x != "", x)


def _posteriors(docs: DataFrame, names: list[str]) -> DataFrame:
    """docs (text, label, ...) with q, the classifier's probabilities of the sources in the order of names.

    Without any labelled document to learn from all sources are equally probable.
    """
    fed = docs.withColumn("w", F.coalesce(norm_words("text"), F.array().cast("array<string>")))
    labelled = fed.where(F.col("label").isin(names))
    n = labelled.count()
    if n == 0:
        return docs.withColumn("q", F.array(*[F.lit(1.0 / len(names))] * len(names)))
    train = labelled if n <= MAX_LABELLED else labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(MAX_LABELLED / n * (1 << 20)))
    index = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc", handleInvalid="keep")
    model = Pipeline(stages=[index, HashingTF(inputCol="w", outputCol="x", numFeatures=1 << 14), NaiveBayes(featuresCol="x", labelCol="y")]).fit(train)
    classes = list(model.stages[0].labels)
    of = model.transform(fed).withColumn("q", vector_to_array("probability"))
    return of.select(*docs.columns, F.array(*[F.get("q", F.lit(classes.index(n))) if n in classes else F.lit(0.0) for n in names]).alias("q"))


def memberships(documents: DataFrame, targets: DataFrame, path: str) -> tuple[DataFrame, list[dict]]:
    """((doc_id, n_tokens, p), targets): p is the array of memberships in the targets' order, which add up to about 1.

    Every document is classified. A label without a target is no evidence for any of them: such a document has no
    membership, and still counts in the corpus. mix_targets is a table of settings: one row per source, read by the driver.
    """
    wanted = [r.asDict() for r in targets.select("source", source_name("source").alias("name"), "target_share", "max_repeats").where("source IS NOT NULL").orderBy("name").collect()]
    names = [t["name"] for t in wanted]
    docs = documents.select("doc_id", "text", source_name("source").alias("label"))
    if not names:
        return token_counts(docs, path).select("doc_id", "n_tokens", F.array().cast("array<double>").alias("p")), wanted
    counted = token_counts(_posteriors(docs, names), path)
    smooth = lambda k: (1 - SPREAD) * F.get("q", F.lit(k)) + SPREAD / len(names)
    other = (1 - TRUST) / max(1, len(names) - 1)
    p = F.array(*[smooth(k) * F.when(F.col("label").isNull(), 1.0).when(F.col("label") == n, TRUST).otherwise(other) for k, n in enumerate(names)])
    counted = counted.withColumn("p", p).withColumn("sum", F.aggregate("p", F.lit(0.0), lambda a, x: a + x))
    outside = F.coalesce(~F.col("label").isin(names), F.lit(False))
    members = counted.select("doc_id", "n_tokens", F.transform("p", lambda x: F.when(outside, 0.0).otherwise(F.round(x / F.col("sum"), PLACES))).alias("p"))
    return cut_lineage(members), wanted


def _with_cap(members: DataFrame, wanted: list[dict]) -> DataFrame:
    """members with _cap, the most copies of a document: those its most probable source allows."""
    caps = F.array(*[F.lit(float(t["max_repeats"])) for t in wanted])
    at = F.array_position("p", F.array_max("p")).cast("int")
    return members.withColumn("_cap", F.when(F.array_max("p") > 0, F.get(caps, at - 1)).otherwise(0.0))


def _rate(history: list[list[float]]) -> Column:
    """Rate of a document after the steps whose scaled residuals are in history: projected onto [0, cap] each time."""
    start = F.least(F.lit(1.0), F.col("_cap"))
    if not history:
        return start
    steps = F.array(*[F.array(*[F.lit(float(x)) for x in h]) for h in history])
    inner = lambda r, h: F.greatest(F.lit(0.0), F.least(F.col("_cap"), r - RATE * F.aggregate(F.zip_with("p", h, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)))
    return F.aggregate(steps, start, inner)


def fit_rates(members: DataFrame, wanted: list[dict]) -> tuple[list[list[float]], float, list[float], list[float]]:
    """(history, total, capacity, reached): residuals of each step, tokens of the corpus, tokens per source once, and in the mix.

    Documents with equal memberships have equal rates, so they are added up first. Only one number per source comes back
    to the driver in a step.
    """
    rows = cut_lineage(_with_cap(members.groupBy("p").agg(F.sum("n_tokens").cast("double").alias("t")), wanted))
    total = float(rows.agg(F.sum("t")).first()[0] or 0.0)
    at = lambda k: F.get("p", F.lit(k))
    sums = lambda rate: [float(x or 0.0) for x in rows.agg(*[F.sum(rate * F.col("t") * at(k)) for k in range(len(wanted))]).first()]
    capacity = sums(F.lit(1.0))
    goal = [t["target_share"] * total for t in wanted]
    history: list[list[float]] = []
    reached = sums(_rate(history))
    for _ in range(STEPS):
        step = [(s - g) / c if c else 0.0 for s, g, c in zip(reached, goal, capacity)]
        history.append(step)
        before, reached = reached, sums(_rate(history))
        if total == 0 or max(abs(a - b) for a, b in zip(before, reached)) < 1e-6 * total:
            break
    return history, total, capacity, reached


def mix_report(documents: DataFrame, targets: DataFrame, path: str) -> DataFrame:
    """(source, target_share, max_repeats, tokens, mix_tokens, actual_share, short) per source of the targets.

    tokens are expected ones by the memberships. short: the fitted rates, at their caps, leave the source below its share
    of a mix as large as the corpus.
    """
    members, wanted = memberships(documents, targets, path)
    spark = documents.sparkSession
    schema = "source string, target_share double, max_repeats int, tokens double, mix_tokens double, actual_share double, short boolean"
    if not wanted:
        return spark.createDataFrame([], schema)
    _, total, capacity, reached = fit_rates(members, wanted)
    mixed = sum(reached) or 1.0
    rows = [(t["source"], t["target_share"], t["max_repeats"], c, r, r / mixed, r < t["target_share"] * total - TOLERANCE * total) for t, c, r in zip(wanted, capacity, reached)]
    return spark.createDataFrame(rows, schema)


def mix_copies(documents: DataFrame, targets: DataFrame, path: str) -> DataFrame:
    """(doc_id, copies): how often each document stands in the mix; the part of a rate below one is drawn by hash."""
    members, wanted = memberships(documents, targets, path)
    if not wanted:
        return members.select("doc_id", F.lit(0).alias("copies"))
    history, *_ = fit_rates(members, wanted)
    rate = _with_cap(members, wanted).withColumn("rate", _rate(history))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1_000_000)) / 1_000_000
    return rate.select("doc_id", (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int").alias("copies"))
