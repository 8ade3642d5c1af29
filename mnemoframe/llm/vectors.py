"""Most similar vectors by additive quantisation.

A vector is the sum of one word of each of several full-dimensional codebooks, the later ones fitted on the residuals of
the earlier. Beam search encodes; the words of the first codebook are the cells of the index. A vector is placed in every
cell whose distance is within a margin of its nearest one's, so that two vectors meet wherever they have a cell in common,
scores the others there by lookup tables over the codes and the stored norms, and ranks those within a slack of the best
by dot products of the vectors, which travel in 20 bits a component. Margin and slack aren't chosen: they are what the
true neighbours of a bounded set of queries, found among all rows, need for the wanted recall.

Where the margin lets a query visit a large part of a model's rows the index doesn't pay, and the model is searched
exactly instead: its vectors are cut into blocks by hash, and every block meets every block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from mnemoframe.llm.leaks import KeyFilter
from mnemoframe.session import cut_lineage

#: Codebooks are fitted on at most about SAMPLE vectors of a model and calibrated by the neighbours of about ASKED vectors,
#: both chosen by hash. Every vector is indexed.
SAMPLE, ASKED = 20_000, 2000
#: Further codebooks and their words, and partial sums kept while encoding.
BOOKS, WORDS, BEAM = 3, 64, 4
#: Rows of a model from which on it is indexed.
INDEXED = 3200
#: Mean rows whose nearest cell it is, most cells of a model, and most rows of either part of a cell that meet in one task.
CELL, MAX_CELLS, BLOCK = 200, 4096, 8192
#: Part of the pairs of true neighbours that the margin must let meet, and the slack as a multiple of the greatest distance
#: of the table scores' errors from their median.
MET, SLACK = 0.999, 1.25
#: Part of a model's rows from which on meeting them costs more than the exact search of all.
PAYS = 0.1
#: Size of a block's vectors in the exact search.
BLOCK_BYTES = 8 << 20
#: Queries of one product, columns in a group whose greatest products bound the k-th best, and pairs ranked at once.
QUERIES, GROUP, RANKED = 512, 64, 1 << 18
#: Queries scored by tables at once, so that their scores stay in the cache, and the part of a cell's pairs from which on
#: one product of all is cheaper than those of the shortlist.
SCORED, LISTED = 256, 1 / 32


def usable(df: DataFrame) -> DataFrame:
    """(vec_id, model, vec) of the rows that are no misses: vec has dim finite elements, not all zero."""
    fine = "vec_id IS NOT NULL AND model IS NOT NULL AND size(vec) = dim AND dim > 0 AND NOT exists(vec, x -> x IS NULL OR isnan(x) OR abs(x) = float('Infinity')) AND exists(vec, x -> x <> 0)"
    return df.select("vec_id", "model", "dim", "vec").where(fine).select("vec_id", "model", "vec")


def _unit(vecs: pd.Series) -> np.ndarray:
    x = np.stack(vecs.to_list()).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # no overflow or underflow in the norm
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def best_of(q: np.ndarray, qid: np.ndarray, x: np.ndarray, ids: np.ndarray, least: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, item, cos): the k best items of each query, of cosine least or more; ties by the smaller id."""
    slack = 2 * (q.shape[1] + 4) * 2.0**-24  # twice the rounding of a dot product of 32-bit floats
    n, groups = len(x), -(-len(x) // GROUP)
    room = np.full((min(QUERIES, len(q)), groups * GROUP), -4, dtype=np.float32)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(0, len(q), QUERIES):
        part = q[i : i + QUERIES]
        s = room[: len(part)]
        np.matmul(part, x.T, out=s[:, :n])
        # Item c is in group c % groups. The greatest products of groups are products of different items, so the k-th
        # best item reaches the k-th of them.
        top = s.reshape(len(s), GROUP, groups).max(1)
        bound = np.full(len(s), least)
        if groups > k:
            bound = np.maximum(bound, np.partition(top, groups - k, axis=1)[:, groups - k])
        bound = (np.maximum(bound, -2) - slack).astype(np.float32)
        at, group = np.nonzero(top >= bound[:, None])
        ends = np.searchsorted(at, np.arange(len(s) + 1))
        a = 0
        while a < len(s):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + RANKED // GROUP, side="right")) - 1)
            r, g = at[ends[a] : ends[b]], group[ends[a] : ends[b]]
            c = g[:, None] + groups * np.arange(GROUP)
            m, inner = np.nonzero(s[r[:, None], c] >= bound[r, None])
            r, c = r[m], c[m, inner]
            cos = (part[r].astype(np.float64) * x[c]).sum(1)
            keep = cos >= least
            r, c, cos = r[keep], c[keep], cos[keep]
            order = np.lexsort((ids[c], -cos, r))
            r, c, cos = r[order], c[order], cos[order]
            keep = np.arange(len(r)) - np.searchsorted(r, r) < k
            out.append((qid[i + r[keep]], ids[c[keep]], cos[keep]))
            a = b
    return tuple(np.concatenate(z) for z in zip(*out))


def _keyed(df: DataFrame) -> DataFrame:
    """The usable rows, with dim and a key of 128 bits by which exact copies of a vector agree."""
    return usable(df).select("model", F.size("vec").alias("dim"), F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit("copy"), "vec").alias("h2"), "vec_id", "vec")


def _copies(df: DataFrame) -> DataFrame:
    """(model, rep, vec_id) of the vectors of which there are several; rep is the smallest vec_id."""
    key = ["model", "dim", "h1", "h2"]
    ids = _keyed(df).select(*key, "vec_id")
    several = ids.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.max("vec_id").alias("last")).where("rep < last").drop("last")
    return ids.join(several, key).select("model", "rep", "vec_id").distinct()


def _repeated(df: DataFrame) -> KeyFilter:
    """Filter that has the keys of all vectors with more than one row."""
    key = ["model", "dim", "h1", "h2"]
    return KeyFilter(_keyed(df).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(F.col("h1").alias("h")))


def _distinct(df: DataFrame, repeated: KeyFilter) -> DataFrame:
    """(model, dim, vec_id, vec): exact copies of a vector are one row, under the smallest vec_id.

    Only what the filter may have is grouped: a row that it doesn't have is the only one of its vector and stays in place.
    """
    keyed, maybe = _keyed(df), repeated.may_have(F.col("h1"))
    several = keyed.where(maybe).groupBy("model", "dim", "h1", "h2").agg(F.min("vec_id").alias("vec_id"), F.any_value("vec").alias("vec"))
    return keyed.where(~maybe).drop("h1", "h2").unionByName(several.drop("h1", "h2"))


def _halves(words: np.ndarray) -> np.ndarray:
    return (words**2).sum(1) / 2


def _distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Half the squared distances to the words, less what is the same for all of them."""
    return _halves(words) - x @ words.T


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    words = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = np.concatenate([_distances(x[i : i + 2048], words).argmin(1) for i in range(0, len(x), 2048)])
        n = np.bincount(at, minlength=k)
        order = np.argsort(at, kind="stable")
        words[n > 0] = np.add.reduceat(x[order], np.searchsorted(at[order], np.flatnonzero(n)), axis=0) / n[n > 0, None]
    return words


def fit_books(sample: np.ndarray, n: int) -> list[np.ndarray]:
    """Codebooks for n vectors: the first with about n / CELL words, the others on the residuals of those before."""
    rng = np.random.default_rng(7)
    books, rest = [], sample
    for b in range(1 + BOOKS):
        most = max(1, min(MAX_CELLS, n // CELL)) if b == 0 else WORDS
        books.append(_kmeans(rest, min(most, max(1, len(sample) // 4)), 6, rng))
        rest = rest - books[b][np.concatenate([_distances(rest[i : i + 2048], books[b]).argmin(1) for i in range(0, len(rest), 2048)])]
    return books


def encode(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, norms of the sums of words): beam search over the codebooks, keeping the nearest partial sums."""
    rows = np.arange(len(x))[:, None]
    codes, rest = np.zeros((len(x), 1, 0), dtype=np.int64), x[:, None, :]
    for words in books:
        far = (rest**2).sum(2)[:, :, None] / 2 + _distances(rest.reshape(-1, x.shape[1]), words).reshape(len(x), rest.shape[1], -1)
        far = far.reshape(len(x), -1)
        k = min(BEAM, far.shape[1])
        best = np.argpartition(far, k - 1, axis=1)[:, :k]
        best = np.take_along_axis(best, np.take_along_axis(far, best, 1).argsort(1), 1)
        old, word = best // len(words), best % len(words)
        codes, rest = np.concatenate([codes[rows, old], word[:, :, None]], axis=2), rest[rows, old] - words[word]
    return codes[:, 0], np.linalg.norm(x - rest[:, 0], axis=1)


def table_scores(q: np.ndarray, codes: np.ndarray, norms: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """Cosines of encoded members (rows) and queries: sums of one table row a codebook, over the stored norms."""
    s = (books[0] @ q.T)[codes[:, 0]]
    for b, words in enumerate(books[1:], 1):
        s += (words @ q.T)[codes[:, b]]
    s /= np.maximum(norms, 1e-6)[:, None]
    return s


def shortlist(s: np.ndarray, least: float, k: int, low: float, high: float) -> np.ndarray:
    """Whether a table score (members x queries) is within the errors' reach of the wanted cosine and of the query's k + 1 best."""
    bound = np.full(s.shape[1], least, dtype=np.float32)
    # The k + 1 best raise the bound of a query only if so many scores are beyond it.
    beyond = np.bincount(np.flatnonzero(s > bound[0] + np.float32(low)) % s.shape[1], minlength=s.shape[1]) > k
    if beyond.any():
        bound[beyond] = np.maximum(bound[beyond], np.partition(s[:, beyond], len(s) - k - 1, axis=0)[len(s) - k - 1] - low)
    return s >= bound - high


def _calibrate(books: list[np.ndarray], q: np.ndarray, x: np.ndarray, sample: np.ndarray) -> tuple[float, float, float, float]:
    """(margin, low, high, share) from pairs of queries q and true neighbours x: cells to be placed in, errors of the table
    scores, and the part of the sample's rows that a row meets, once for each cell in common."""
    cells = lambda v: np.concatenate([_distances(v[i : i + 2048], books[0]) for i in range(0, len(v), 2048)])
    # A pair meets in the cell that is least far from being the nearest of both.
    over = lambda v: (d := cells(v)) - d.min(1, keepdims=True)
    margin = float(np.quantile(np.concatenate([np.maximum(over(q[i : i + 2048]), over(x[i : i + 2048])).min(1) for i in range(0, len(q), 2048)]), MET)) + 1e-6
    codes, norms = encode(x, books)
    error = (q * x).sum(1) - np.concatenate([table_scores(q[i : i + 1], codes[i : i + 1], norms[i : i + 1], books)[0] for i in range(len(q))])
    reach = lambda e: float(np.median(e) + SLACK * (e.max() - np.median(e))) + 1e-6
    placed = over(sample) <= margin
    return margin, reach(-error), reach(error), float((placed @ placed.mean(0)).mean())


def build_index(df: DataFrame, least: float, k: int) -> dict[str, tuple]:
    """model: (books, margin, low, high) of the models whose index pays; all that is collected has a fixed size a model.

    Models with too few vectors or without neighbours of the wanted cosine among the queries' are left to exact search.
    """
    spark = df.sparkSession
    good = usable(df)
    n = {r["model"]: r["n"] for r in good.groupBy("model").agg(F.count("*").alias("n")).collect() if r["n"] >= INDEXED}
    if not n:
        return {}
    part = lambda most: F.create_map(*[v for m, c in n.items() for v in (F.lit(m), F.lit(most / c))])[F.col("model")] * (1 << 30)
    chosen = F.pmod(F.xxhash64("vec_id", F.lit("fit")), F.lit(1 << 30))

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        m = g["model"].iloc[0]
        x = np.unique(_unit(g["vec"]), axis=0)
        return pd.DataFrame({"model": m, "book": range(1 + BOOKS), "dim": x.shape[1], "words": [b.tobytes() for b in fit_books(x, n[m])]})

    # A bounded sample a model, fitted where Spark puts it.
    drawn = good.where(F.col("model").isin(list(n))).where(chosen < part(SAMPLE))
    fitted = drawn.groupBy("model").applyInPandas(fit, "model string, book int, dim int, words binary").orderBy("model", "book").collect()
    books: dict[str, list[np.ndarray]] = {}
    for r in fitted:
        books.setdefault(r["model"], []).append(np.frombuffer(r["words"], dtype=np.float32).reshape(-1, r["dim"]))
    seen = {m: np.unique(_unit(g["vec"]), axis=0) for m, g in drawn.where(chosen < part(2 * ASKED)).toPandas().groupby("model") if m in books}
    asked = spark.sparkContext.broadcast({m: x[:: max(1, len(x) // ASKED)] for m, x in seen.items()})

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for m, g in b.groupby("model"):
                if m in asked.value:
                    x = np.unique(_unit(g["vec"]), axis=0)
                    q, at, cos = best_of(asked.value[m], np.arange(len(asked.value[m])), x, np.arange(len(x)), max(least, -2), k + 1)
                    other = cos < 1 - 1e-6  # neither the query itself nor its copies
                    yield pd.DataFrame({"model": m, "q": q[other], "cos": cos[other], "v": [x[i].tobytes() for i in at[other]]})

    w = Window.partitionBy("model", "q").orderBy(F.desc("cos"))
    # Copies of a neighbour in several batches count once.
    true = good.mapInPandas(neighbours, "model string, q int, cos double, v binary").dropDuplicates(["model", "q", "v"]).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).toPandas()
    index = {}
    for m, g in true.groupby("model"):
        q, x = asked.value[m][g["q"]], np.frombuffer(b"".join(g["v"]), dtype=np.float32).reshape(len(g), -1)
        margin, low, high, share = _calibrate(books[m], q, x, seen[m])
        if share <= PAYS:
            index[m] = (books[m], margin, low, high)
    return index


def _placed(x: np.ndarray, books: list[np.ndarray], margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell): the cells that each vector is placed in, in their order."""
    out = []
    for i in range(0, len(x), 2048):
        d = _distances(x[i : i + 2048], books[0])
        at, cell = np.nonzero(d <= d.min(1, keepdims=True) + margin)
        out.append((at + i, cell))
    return tuple(np.concatenate(z) for z in zip(*out))


def pack_unit(x: np.ndarray) -> np.ndarray:
    """Each row's direction in 20 bits a component: 16 bits of each, then the other four in pairs."""
    z = np.rint(x / np.abs(x).max(1, keepdims=True) * (2**19 - 1)).astype(np.int32)
    low = np.zeros((len(z), z.shape[1] + z.shape[1] % 2), dtype=np.uint8)
    low[:, : z.shape[1]] = z & 15
    return np.concatenate([(z >> 4).astype("<i2").view(np.uint8), low[:, ::2] | low[:, 1::2] << 4], axis=1)


def unpack_unit(packed: np.ndarray, dim: int) -> np.ndarray:
    low = packed[:, 2 * dim :]
    z = np.ascontiguousarray(packed[:, : 2 * dim]).view("<i2") * 16.0 + np.stack([low & 15, low >> 4], axis=2).reshape(len(low), -1)[:, :dim]
    return (z / np.linalg.norm(z, axis=1, keepdims=True)).astype(np.float32)


def earlier(n: np.ndarray, cells: np.ndarray, cell: int) -> np.ndarray:
    """One bit for each cell before the given one that a row is placed in; row i has the next n[i] of the cells."""
    placed = np.zeros((len(n), -(-max(cell, 1) // 64) * 64), dtype=bool)
    row = np.repeat(np.arange(len(n)), n)
    placed[row[cells < cell], cells[cells < cell]] = True
    return np.packbits(placed, axis=1).view(np.uint64)


def _parts_of_cells(good: DataFrame, shared) -> dict[tuple[str, int], int]:
    """(model, cell): number of parts of BLOCK rows or so. At most MAX_CELLS a model."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for m, b in batch.groupby("model"):
                books, margin, *_ = shared.value[m]
                n = np.bincount(_placed(_unit(b["vec"]), books, margin)[1], minlength=len(books[0]))
                yield pd.DataFrame({"model": m, "cell": range(len(n)), "n": n})

    rows = good.mapInPandas(count, "model string, cell bigint, n bigint").groupBy("model", "cell").agg(F.sum("n").alias("n")).collect()
    return {(r["model"], r["cell"]): max(1, -(-r["n"] // BLOCK)) for r in rows}


def search_cells(df: DataFrame, index: dict[str, tuple], least: float, k: int, repeated: KeyFilter) -> DataFrame:
    """(model, a, b, cos) for the models of the index: a's and b's best partners among those with a cell in common, both ways.

    The rows of a cell meet in parts of about BLOCK rows, cut by hash, however many there are. A pair comes out of the
    first cell in common only. Rows travel as arrays, one for each batch and cell, with the cells before that one.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(index)
    mine = df.where(F.col("model").isin(list(index)))
    parts = spark.sparkContext.broadcast(_parts_of_cells(usable(mine), shared))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for m, b in batch.groupby("model"):
                books, margin, *_ = shared.value[m]
                x, ids = _unit(b["vec"]), b["vec_id"].to_numpy(np.int64)
                codes = np.concatenate([encode(x[i : i + 2048], books)[0] for i in range(0, len(x), 2048)])
                at, cell = _placed(x, books, margin)
                cells, first = cell.astype(np.int16), np.searchsorted(at, np.arange(len(x) + 1))
                before = (np.arange(len(at)) - first[at]).astype(np.int16)
                rows = np.concatenate([ids[:, None].view(np.uint8), codes.astype(np.int16).view(np.uint8), pack_unit(x)], axis=1)
                n = np.array([parts.value.get((m, c), 1) for c in range(len(books[0]))])[cell]
                own = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)[at] % n
                one, cell, own, other = np.repeat(np.arange(len(at)), n), np.repeat(cell, n), np.repeat(own, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                low, high = np.minimum(own, other), np.maximum(own, other)
                order = np.lexsort((own, high, low, cell))
                one, key = one[order], np.stack([cell, low, high, own], axis=1)[order]
                ends = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1), len(key)]
                keys = key[ends[:-1]].T
                groups = [one[s:e] for s, e in zip(ends, ends[1:])]
                yield pd.DataFrame({
                    "model": m, "cell": keys[0], "low": keys[1], "high": keys[2], "own": keys[3],
                    "rows": [rows[at[r]].tobytes() for r in groups],
                    "n": [before[r].tobytes() for r in groups],
                    "cells": [b"".join(cells[first[at[i]] : i].tobytes() for i in r) for r in groups],
                })

    def read(g: pd.DataFrame, books: list[np.ndarray], cell: int) -> tuple[np.ndarray, ...]:
        n = np.frombuffer(b"".join(g["n"]), dtype=np.int16).astype(np.int64)
        rows = np.frombuffer(b"".join(g["rows"]), dtype=np.uint8).reshape(len(n), -1)
        field = lambda a, b, t: np.ascontiguousarray(rows[:, a:b]).view(t)
        end = 8 + 2 * len(books)
        codes = field(8, end, np.int16)
        norms = np.linalg.norm(sum(words[codes[:, b]] for b, words in enumerate(books)), axis=1)
        cells = np.frombuffer(b"".join(g["cells"]), dtype=np.int16)
        return field(0, 8, np.int64)[:, 0], norms, codes, unpack_unit(rows[:, end:], books[0].shape[1]), earlier(n, cells, cell)

    def match(g: pd.DataFrame) -> pd.DataFrame:
        m, cell, low_part, high_part = (g[c].iloc[0] for c in ("model", "cell", "low", "high"))
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        books, _, low, high = shared.value[m]
        sides = [read(s, books, cell) for p in sorted({low_part, high_part}) if len(s := g[g["own"] == p])]
        pairs = [(0, 0)] if low_part == high_part else [(0, 1), (1, 0)] if len(sides) == 2 else []
        for l, r in pairs:
            (qids, _, _, qs, qbefore), (ids, norms, codes, x, before) = sides[l], sides[r]
            for i in range(0, len(qs), SCORED):
                q, qid = qs[i : i + SCORED], qids[i : i + SCORED]
                listed = shortlist(table_scores(q, codes, norms, books), least, k, low, high)
                # Many candidates are cheaper as one product; its rounding is left for the products of 64 bits.
                if dense := np.count_nonzero(listed) > LISTED * listed.size:
                    listed &= x @ q.T >= least - 1e-4
                b, a = np.divmod(np.flatnonzero(listed), len(q))
                if not dense:
                    keep = np.einsum("ij,ij->i", q[a], x[b]) >= least - 1e-4
                    a, b = a[keep], b[keep]
                cos = (q[a].astype(np.float64) * x[b]).sum(1)
                keep = cos >= least
                a, b, cos = a[keep], b[keep], cos[keep]
                order = np.lexsort((ids[b], -cos, a))
                a, b, cos = a[order], b[order], cos[order]
                keep = np.arange(len(a)) - np.searchsorted(a, a) <= k
                a, b, cos = a[keep], b[keep], cos[keep]
                here = ~(qbefore[i + a] & before[b]).any(1)
                a, b, cos = qid[a[here]], ids[b[here]], cos[here]
                out += [(a, b, cos), (b, a, cos)]
        a, b, cos = (np.concatenate(z) for z in zip(*out))
        order = np.lexsort((b, a))
        a, b, cos = a[order], b[order], cos[order]
        once = np.ones(len(a), dtype=bool)
        once[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b, cos = a[once], b[once], cos[once]
        order = np.lexsort((b, -cos, a))
        a, b, cos = a[order], b[order], cos[order]
        keep = np.arange(len(a)) - np.searchsorted(a, a) <= k
        return pd.DataFrame({"model": m, "a": a[keep], "b": b[keep], "cos": cos[keep]})

    placed = _distinct(mine, repeated).mapInPandas(place, "model string, cell bigint, low bigint, high bigint, own bigint, rows binary, n binary, cells binary")
    return placed.groupBy("model", "cell", "low", "high").applyInPandas(match, "model string, a bigint, b bigint, cos double")


def search_blocks(df: DataFrame, least: float, k: int, repeated: KeyFilter) -> DataFrame:
    """(model, a, b, cos): for each query a its k best members b of each block, of cosine least or more.

    Exact copies are one query and one member, under the smallest vec_id; a query is a member too.
    """
    spark = df.sparkSession
    good = _distinct(df, repeated)
    # One row per model.
    sizes = usable(df).groupBy("model", F.size("vec").alias("dim")).agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") * F.col("dim") * 4 / BLOCK_BYTES))
    block = F.pmod(F.xxhash64("vec_id"), F.col("blocks"))

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        one = g.iloc[0]
        return pd.DataFrame({"model": [one["model"]], "dim": [one["dim"]], "ids": [g["vec_id"].to_numpy(np.int64).tobytes()], "v": [_unit(g["vec"]).tobytes()]})

    placed = good.join(F.broadcast(sizes.drop("n")), ["model", "dim"]).select("model", "dim", block.alias("block"), "vec_id", "vec")
    blocks = cut_lineage(placed.groupBy("model", "dim", "block").applyInPandas(pack, "model string, dim int, ids binary, v binary"))

    def read(b: Row) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b["ids"], dtype=np.int64), np.frombuffer(b["v"], dtype=np.float32).reshape(-1, b["dim"])

    def match(pairs: Iterator[tuple[Row, Row]]) -> Iterator[tuple[str, bytes, bytes, bytes]]:
        for left, right in pairs:
            if (left["model"], left["dim"]) == (right["model"], right["dim"]):
                (qid, q), (ids, x) = read(left), read(right)
                a, b, cos = best_of(q, qid, x, ids, least, k)
                yield left["model"], a.tobytes(), b.tobytes(), cos.tobytes()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                yield pd.DataFrame({"model": r.model, "a": np.frombuffer(r.a, dtype=np.int64), "b": np.frombuffer(r.b, dtype=np.int64), "cos": np.frombuffer(r.cos, dtype=np.float64)})

    rdd = blocks.rdd
    found = spark.createDataFrame(rdd.cartesian(rdd).mapPartitions(match), "model string, a binary, b binary, cos binary")
    return found.mapInPandas(rows, "model string, a bigint, b bigint, cos double")


def most_similar(df: DataFrame, k: int = 5, least: float = -2.0, exact: bool = False) -> DataFrame:
    """(model, vec_id, rank, neighbour, cos): the k most similar vectors of every vector, of cosine least or more.

    By the index where it pays, else, or if exact is asked for, by exact search. Cosines are exact in either case.
    Vectors equal in similarity rank by vec_id. Rows that are misses never appear; repeated rows count once. Of the copies
    of a vector only the k + 1 smallest vec_ids can be anyone's neighbours.
    """
    w = Window.partitionBy("model", "a").orderBy(F.col("cos").desc(), "b")
    ranked = lambda d, n: d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    copies = _copies(df)
    first = copies.withColumn("i", F.row_number().over(Window.partitionBy("model", "rep").orderBy("vec_id"))).where(F.col("i") <= k + 1)
    first = first.groupBy("model", F.col("rep").alias("b")).agg(F.collect_list("vec_id").alias("same"))
    index = {} if exact else build_index(df, least, k)
    rest = df.where(~F.col("model").isin(list(index))) if index else df
    repeated = _repeated(df)
    near = search_blocks(rest, least, k + 1, repeated)
    if index:
        near = near.unionByName(search_cells(df, index, least, k + 1, repeated))
    near = ranked(near, k + 1).drop("rank")
    near = near.join(first, ["model", "b"], "left").select("model", "a", F.explode(F.coalesce("same", F.array("b"))).alias("b"), "cos")
    near = ranked(near, k + 1).drop("rank")
    near = near.join(copies.withColumnRenamed("rep", "a"), ["model", "a"], "left").select("model", F.coalesce("vec_id", "a").alias("a"), "b", "cos")
    return ranked(near.where("a <> b"), k).select("model", F.col("a").alias("vec_id"), "rank", F.col("b").alias("neighbour"), "cos")


def similar_pairs(df: DataFrame, least: float = 0.85, k: int = 5, exact: bool = False) -> DataFrame:
    """(vec_id_a, vec_id_b): pairs of one model of cosine least or more, one among the other's k most similar."""
    best = most_similar(df, k, least, exact)
    return best.select(F.least("vec_id", "neighbour").alias("vec_id_a"), F.greatest("vec_id", "neighbour").alias("vec_id_b")).distinct()
