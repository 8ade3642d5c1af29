"""Subjects of documents by topic models.

Latent Dirichlet allocations over words and word pairs find topics; a topic's top terms, looked up in the documents of
annotators, name its subject or leave it without one. With the topics fixed, each document gets its topic proportions,
and under these each of its sentences; a document has the subjects whose topics hold two or more of its sentences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoframe.functions.text import norm_words, plain_text
from mnemoframe.session import cut_lineage

#: Terms of the model: at most VOCABULARY of those in at least LEAST and at most MOST of the documents, and in at most
#: MOST_IN_LANGUAGE of those of any language. A language with few sentence patterns has higher shares of all its words.
VOCABULARY, LEAST, LEAST_DOCS, MOST, MOST_IN_LANGUAGE = 4000, 0.0004, 4, 0.12, 0.25
#: A pair of words is a term if it makes up at least this part of the documents of its rarer word.
TOGETHER = 0.3
#: Topics of a model, fewer where there are less than DOCS_A_TOPIC documents for each; rounds of the fit, and models that
#: are averaged: each starts at random, and costs a fit of its own.
TOPICS, DOCS_A_TOPIC, ITERATIONS, MODELS = 100, 20, 40, 1
#: Documents of a round: this part of them, or so many where that is more.
PART, LEAST_OF_ROUND = 0.05, 3000
#: Top terms that name a topic, and how much likelier than by chance their documents must have the subject (a logarithm).
TOP_TERMS, NAMED = 40, 0.5
#: Concentration and rounds of the proportions of a document; share of a sentence that its subject's topics must hold.
CONCENTRATION, ROUNDS, HELD = 0.1, 8, 0.5
SENTENCES, SUBJECTS = 2, 2


def sentences(c: Column) -> Column:
    """Sentences of a text: its lines, cut after end marks."""
    return F.filter(F.split(plain_text(c), r"\n+|(?<=[.!?…])[\s\p{Z}]+"), lambda x: F.trim(x) != "")


def _terms(w: Column) -> Column:
    """Words of a sentence and pairs of neighbouring words."""
    pairs = F.transform(F.slice(w, 2, F.size(w)), lambda x, i: F.concat_ws(" ", F.get(w, i), x))
    return F.concat(w, F.when(F.size(w) > 1, pairs).otherwise(F.array().cast("array<string>")))


def _documents(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, text, s, terms): the word lists of the sentences, and all terms of the document."""
    lang = F.lower(F.substring(F.coalesce("lang", F.lit("un")), 1, 2))
    d = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", lang.alias("lang"), "text")
    d = d.withColumn("s", F.transform(sentences(F.col("text")), lambda x: norm_words(x)))
    return d.withColumn("terms", F.array_distinct(F.flatten(F.transform("s", lambda x: _terms(x)))))


def _vocabulary(docs: DataFrame, n: int) -> list[str]:
    """Terms of middling frequency, in all n documents and within each language, that are no names.

    Names are words with a capital in the languages that keep it for names.
    """
    sizes = docs.groupBy("lang").agg(F.count("*").alias("n"))
    inner = F.regexp_extract_all(plain_text(F.col("text")), F.lit(r"(?<=[\p{L}\p{N},;] )[\p{L}\p{N}]+"), F.lit(0))
    latin = docs.where("lang <> 'de'").select(F.explode(inner).alias("w"))
    capital = latin.groupBy(F.lower("w").alias("term")).agg(F.avg(F.col("w").rlike(r"^\p{Lu}|^\p{N}").cast("double")).alias("c"), F.count("*").alias("k"))
    by_lang = docs.select("lang", F.explode("terms").alias("term")).groupBy("lang", "term").agg(F.count("*").alias("k"))
    shares = by_lang.join(sizes, "lang").where("k >= 2").groupBy("term").agg(F.sum("k").alias("df"), F.max(F.when(F.col("n") >= 0.01 * n, F.col("k") / F.col("n"))).alias("most"))
    good = cut_lineage(shares.where((F.col("df") >= max(LEAST_DOCS, LEAST * n)) & (F.col("df") <= MOST * n) & (F.coalesce("most", F.lit(0.0)) <= MOST_IN_LANGUAGE)))
    # Documents with a wrong or no language don't make names of the nouns of another.
    named = capital.join(good.select("term", "df"), "term").where("c > 0.6 AND k >= 3 AND k >= 0.3 * df").select("term")
    single = good.where(~F.col("term").contains(" ")).join(named, "term", "left_anti").select("term", "df")
    # A pair counts only if its words are terms that keep together, or one is and the other is frequent.
    pair = good.where(F.col("term").contains(" ")).select("term", F.col("df"), F.explode(F.split("term", " ")).alias("x"))
    rarer = pair.join(single.select(F.col("term").alias("x"), F.col("df").alias("dx")), "x").groupBy("term").agg(F.max("df").alias("df"), F.min("dx").alias("dx"))
    names_in = pair.join(named.withColumnRenamed("term", "x"), "x", "left_semi").select("term").distinct()
    keep = rarer.where(F.col("df") >= TOGETHER * F.col("dx")).join(names_in, "term", "left_anti").select("term", "df")
    return [r["term"] for r in single.unionByName(keep).orderBy(F.desc("df"), "term").limit(VOCABULARY).collect()]


def _numbered(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, s): the numbers of the terms of each sentence that has any, once each."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = shared.value
        for b in batches:
            rows = [[sorted({at[t] for t in (*w, *map(" ".join, zip(w, w[1:]))) if t in at}) for w in s] for s in b["s"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "s": [[w for w in r if w] for r in rows]})

    return docs.select("doc_id", "s").mapInPandas(run, "doc_id bigint, s array<array<int>>").where(F.size("s") > 0)


def fit_topics(numbered: DataFrame, vocabulary: list[str], n: int) -> list[np.ndarray]:
    """Term weights (vocabulary x topics) of each model. Their size is fixed, whatever the number of documents."""
    words = numbered.select(F.transform(F.array_distinct(F.flatten("s")), lambda i: i.cast("string")).alias("terms"))
    x = CountVectorizerModel.from_vocabulary([str(i) for i in range(len(vocabulary))], inputCol="terms", outputCol="features").setBinary(True).transform(words).select("features").persist()
    k, part = int(np.clip(n // DOCS_A_TOPIC, 8, TOPICS)), min(1.0, max(PART, LEAST_OF_ROUND / max(1, n)))
    fits = [LDA(k=k, maxIter=ITERATIONS, optimizer="online", subsamplingRate=part, learningOffset=16.0, learningDecay=0.6, optimizeDocConcentration=False, docConcentration=[0.02], topicConcentration=0.01, seed=11 + i).fit(x) for i in range(MODELS)]
    x.unpersist()
    return [m.topicsMatrix().toArray() for m in fits]


def name_topics(phi: np.ndarray, lift: np.ndarray) -> np.ndarray:
    """The subject of each topic, -1 for none: its top terms' lift, weighted by their part in the topic and by how specific they are to it.

    lift (vocabulary x subjects) is how much likelier than by chance a labelled document with the term has the subject.
    """
    theta, specific = phi / phi.sum(0), phi / phi.sum(1, keepdims=True)
    owner = np.full(phi.shape[1], -1)
    for t in range(phi.shape[1]):
        top = np.argsort(-theta[:, t])[:TOP_TERMS]
        w = theta[top, t] * specific[top, t]
        score = (w[:, None] * lift[top]).sum(0) / w.sum()
        if score.max() > NAMED:
            owner[t] = score.argmax()
    return owner


def _lift(numbered: DataFrame, labels: DataFrame, names: list[str], size: int) -> np.ndarray:
    """How the labelled documents that have a term are labelled: log ratio to the share of the subject among all labels."""
    said = labels.select("doc_id", "subject").where("subject IS NOT NULL").distinct()
    marked = said.join(numbered, "doc_id").select("subject", F.explode(F.array_distinct(F.flatten("s"))).alias("term"))
    seen, total = np.zeros((size, len(names) + 1)), np.ones(len(names) + 1)
    place = {s: i for i, s in enumerate(names)}
    # At most vocabulary x subjects counts.
    for r in marked.groupBy("term", "subject").agg(F.count("*").alias("n")).collect():
        seen[r["term"], place.get(r["subject"], len(names))] += r["n"]
    for r in said.groupBy("subject").agg(F.count("*").alias("n")).collect():
        total[place.get(r["subject"], len(names))] += r["n"]
    prior = total / total.sum()
    return np.log((seen + 2 * prior) / (seen.sum(1, keepdims=True) + 2) / prior)[:, :-1]


def topic_proportions(docs: list[list[list[int]]], phi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(of documents, of sentences): topic proportions with the topics' term probabilities phi (vocabulary x topics) fixed.

    The proportions of a document are those under which its terms are likeliest, by a few rounds of expectation and
    maximisation; those of a sentence are the topics' probabilities given its terms and the document's proportions.
    """
    k = phi.shape[1]
    words = [w for d in docs for w in d]
    terms = np.concatenate([np.asarray(w) for w in words])
    of_sentence = np.cumsum([0] + [len(w) for w in words])[:-1]
    of_doc = np.cumsum([0] + [sum(map(len, d)) for d in docs])
    p, doc = phi[terms], np.repeat(np.arange(len(docs)), np.diff(of_doc))
    theta = np.full((len(docs), k), 1.0 / k, dtype=np.float32)
    for _ in range(ROUNDS):
        r = theta[doc] * p
        r /= r.sum(1, keepdims=True)
        theta = CONCENTRATION / k + np.add.reduceat(r, of_doc[:-1], axis=0)
        theta /= theta.sum(1, keepdims=True)
    log = np.add.reduceat(np.log(p), of_sentence, axis=0) + np.log(theta)[np.repeat(np.arange(len(docs)), [len(d) for d in docs])]
    log -= log.max(1, keepdims=True)
    e = np.exp(log)
    return theta, e / e.sum(1, keepdims=True)


def document_subjects(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, subject, n_sentences): the subjects, two at most, that two or more sentences of a document deal with.

    Documents without text or about none of the subjects have no row. Labels name topics and do nothing else; without
    any there is no row at all. Subjects are a table of settings, whose names the driver reads.
    """
    schema = "doc_id bigint, subject string, n_sentences int"
    docs = _documents(documents)
    n = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").count()
    names = sorted(r["subject"] for r in labels.select("subject").where("subject IS NOT NULL AND subject <> 'none'").distinct().collect())
    vocabulary = _vocabulary(docs, n) if n and names else []
    if not vocabulary:
        return documents.sparkSession.createDataFrame([], schema)
    # Few bytes and much work: spread over the cores, whatever the number of files.
    parts = 2 * documents.sparkSession.sparkContext.defaultParallelism
    numbered = cut_lineage(_numbered(docs, vocabulary).repartition(parts, "doc_id"))
    lift = _lift(numbered, labels, names, len(vocabulary))
    models = []
    for phi in fit_topics(numbered, vocabulary, n):
        owner = name_topics(phi, lift)
        models.append((np.maximum(phi / phi.sum(0), 1e-9).astype(np.float32), np.eye(len(names) + 1, dtype=np.float32)[owner][:, :-1]))
    shared = documents.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 512):
                b = batch.iloc[i : i + 512]
                held = sum(topic_proportions(b["s"].tolist(), phi)[1] @ of for phi, of in shared.value) / len(shared.value)
                at = np.repeat(np.arange(len(b)), b["s"].str.len())
                deals = held.max(1) >= HELD
                votes = np.zeros((len(b), len(names)), dtype=int)
                np.add.at(votes, (at[deals], held[deals].argmax(1)), 1)
                out = []
                for doc, v in zip(b["doc_id"], votes):
                    order = sorted(np.flatnonzero(v >= SENTENCES), key=lambda k: (-v[k], names[k]))
                    out += [(doc, names[k], int(v[k])) for k in order[:SUBJECTS]]
                yield pd.DataFrame(out, columns=["doc_id", "subject", "n_sentences"])

    return numbered.mapInPandas(run, schema)
