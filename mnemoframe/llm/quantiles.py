"""Percentiles by dyadic Count-sketches.

Values are encoded on a logarithmic scale of 2**BITS codes. For each binary resolution of the codes there is one
counter array: exact where the resolution has no more nodes than WIDTH, a signed Count-sketch of ROWS rows below. All
counters are sums, so sketches merge by addition and give up data by subtraction. A percentile is found by descending
from the coarsest resolution to the finest.

Stated error: the encoding is off by at most STEP / 2 of (1 + value). A rank is a sum of one estimate a level, and the
estimate of a sketched level, a median of ROWS signed counters, has a variance of about 1.57 / ROWS * F2 / WIDTH, F2
being the level's sum of squared counts, which the counters themselves give. So each percentile comes with the values
ERRORS standard errors of its rank below and above it. Sketches have one size, whatever the number of values.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.session import cut_lineage

METRICS = ["search_ms", "e2e_ms", "context_tokens"]
BITS, WIDTH, ROWS, STEP, ERRORS = 16, 256, 5, 0.0005, 4.0
SKETCHED = BITS - int(math.log2(WIDTH))  # the levels below which nodes outnumber counters
KEYS = ["system", "run_day", "metric"]

# Counter numbers: exact levels first, coarsest first, then the rows of each sketched level.
_EXACT = {lv: (1 << (BITS - lv)) - 1 for lv in range(BITS, SKETCHED - 1, -1)}
_BASE = (2 << (BITS - SKETCHED)) - 1
SIZE = _BASE + SKETCHED * ROWS * WIDTH


def measures(answers: DataFrame) -> DataFrame:
    """(system, run_day, metric, value): values of rows without error that are not NULL, NaN, infinite or negative.

    Repeated rows count once. Rows with NULL system or run_day form groups of their own.
    """
    rows = answers.where("error IS NULL").select("answer_id", "system", "run_day", *[F.col(m).cast("double").alias(m) for m in METRICS]).distinct()
    out = rows.select("system", "run_day", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])))
    return out.where("value >= 0 AND NOT isnan(value) AND value < double('Infinity')")


def code_of(value: Column) -> Column:
    return F.least(F.lit((1 << BITS) - 1), F.floor(F.log1p(value) / math.log1p(STEP))).cast("int")


def _places(node: np.ndarray, level: int, row: int) -> tuple[np.ndarray, np.ndarray]:
    """(counter, sign) of the nodes of a sketched level in one row: 64 mixed bits of the node and its place."""
    h = node.astype(np.uint64) + np.uint64((level * ROWS + row + 1) << 32)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    h ^= h >> np.uint64(31)
    return _BASE + (level * ROWS + row) * WIDTH + (h % np.uint64(WIDTH)).astype(np.int64), 1 - 2 * (h >> np.uint64(63)).astype(np.int64)


def _counters(codes: np.ndarray, n: np.ndarray) -> np.ndarray:
    c = np.zeros(SIZE, dtype=np.int64)
    for lv, base in _EXACT.items():
        np.add.at(c, base + (codes >> lv), n)
    for lv in range(SKETCHED):
        for r in range(ROWS):
            at, sign = _places(codes >> lv, lv, r)
            np.add.at(c, at, sign * n)
    return c


def _pack(c: np.ndarray) -> bytes:
    return zlib.compress(c.tobytes(), 1)


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), dtype=np.int64)


def _schema(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for k in keys for f in df.schema.fields if f.name == k)


def sketch(values: DataFrame, keys: list[str] | None = None, sign: int = 1) -> DataFrame:
    """(keys, sketch) of (keys, value); sign -1 gives the sketch that deletes the values.

    Values are counted per code with partial sums before the shuffle, so a group of any size comes to its task as at
    most 2**BITS rows.
    """
    keys = keys or KEYS
    hist = values.groupBy(*keys, code_of(F.col("value")).alias("code")).agg(F.count("*").alias("n"))

    def build(g: pd.DataFrame) -> pd.DataFrame:
        c = _counters(g["code"].to_numpy(np.int64), sign * g["n"].to_numpy(np.int64))
        return g[keys].head(1).assign(sketch=[_pack(c)])

    return hist.groupBy(*keys).applyInPandas(build, _schema(hist, keys) + "sketch binary")


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sketch): sum of sketches over all columns that aren't in keys. Batches are added up before the shuffle."""
    schema = _schema(sketches, keys) + "sketch binary"

    def add(g: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SIZE, dtype=np.int64)
        for s in g["sketch"]:
            total += _unpack(s)
        return g[keys].head(1).assign(sketch=[_pack(total)])

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, g in b.groupby(keys, dropna=False, sort=False):
                yield add(g)

    return sketches.select(*keys, "sketch").mapInPandas(combine, schema).groupBy(*keys).applyInPandas(add, schema)


def _rank_error(c: np.ndarray) -> float:
    """Standard error of a rank, from the sums of squares of the sketched levels' rows."""
    rows = c[_BASE:].reshape(SKETCHED, ROWS, WIDTH).astype(np.float64)
    return math.sqrt(1.57 / ROWS * np.median((rows**2).sum(2), axis=1).sum() / WIDTH)


def _value_at_rank(c: np.ndarray, rank: float) -> float:
    """Value of the 0-based rank: at each level go left if the left child's count exceeds what is left of the rank."""
    node, rank = 0, min(max(rank, 0.0), c[0] - 1.0)
    for lv in range(BITS - 1, -1, -1):
        left = node * 2
        if lv >= SKETCHED:
            count = c[_EXACT[lv] + left]
        else:
            seen = [_places(np.array([left]), lv, r) for r in range(ROWS)]
            count = max(0.0, float(np.median([c[at[0]] * sign[0] for at, sign in seen])))
        if rank < count:
            node = left
        else:
            rank, node = rank - count, left + 1
    return math.expm1((node + 0.5) * math.log1p(STEP)) if node else 0.0


def percentile_of(c: np.ndarray, pct: float) -> tuple[float, float, float]:
    """(value, low, high): percentile of the n = c[0] values, and the bounds of its stated error."""
    n = int(c[0])
    if n <= 0:
        return (math.nan,) * 3
    at, slack = (n - 1) * pct / 100, ERRORS * _rank_error(c)
    low, high = _value_at_rank(c, math.floor(at) - slack), _value_at_rank(c, math.ceil(at) + slack)
    return _value_at_rank(c, at), low - (1 + low) * STEP, high + (1 + high) * STEP


def quantiles(sketches: DataFrame, keys: list[str], pcts: tuple[int, ...] = (50, 95)) -> DataFrame:
    """(keys, pct, n, value, low, high) of each sketch; the true percentile lies between low and high."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for rec in b.itertuples(index=False):
                c = _unpack(rec.sketch)
                out += [[*[getattr(rec, k) for k in keys], p, int(c[0]), *percentile_of(c, p)] for p in pcts]
            yield pd.DataFrame(out, columns=[*keys, "pct", "n", "value", "low", "high"])

    return sketches.select(*keys, "sketch").mapInPandas(run, _schema(sketches, keys) + "pct int, n bigint, value double, low double, high double")


def _exact(values: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (KEYS, pct) with x, the exact percentile of the group; only the codes that hold its ranks are looked into."""
    own = values.join(asked.select(*KEYS).distinct(), KEYS, "left_semi").withColumn("code", code_of(F.col("value")))
    w = Window.partitionBy(*KEYS)
    hist = own.groupBy(*KEYS, "code").agg(F.count("*").alias("n"))  # at most 2**BITS rows a group
    hist = hist.withColumn("upto", F.sum("n").over(w.orderBy("code"))).withColumn("total", F.sum("n").over(w))
    at = (F.col("total") - 1) * F.col("pct") / 100
    ranks = F.explode(F.array(F.struct(F.lit(0).alias("hi"), F.floor(at).alias("rank")), F.struct(F.lit(1).alias("hi"), F.ceil(at).alias("rank"))))
    found = hist.join(asked, KEYS).select(*KEYS, "pct", "code", "n", "upto", (at - F.floor(at)).alias("part"), ranks.alias("r")).select("*", "r.*")
    found = found.where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    found = found.select(*KEYS, "pct", "code", "part", "hi", (F.col("rank") - F.col("upto") + F.col("n")).alias("offset"))
    seen = own.groupBy(*KEYS, "code", "value").agg(F.count("*").alias("k")).join(found, [*KEYS, "code"])
    v = Window.partitionBy(*KEYS, "pct", "hi").orderBy("value")
    seen = seen.withColumn("u", F.sum("k").over(v)).where("offset < u AND offset >= u - k")
    side = lambda i: F.max(F.when(F.col("hi") == i, F.col("value")))
    return seen.groupBy(*KEYS, "pct").agg((side(0) + F.max("part") * (side(1) - side(0))).alias("x"))


def outlying_days(answers: DataFrame, factor: float = 2.0, least: int = 30, pcts: tuple[int, ...] = (50, 95)) -> DataFrame:
    """(system, run_day, metric, pct): days whose percentile is at least factor times that of all other days together.

    The other days' sketch is the sketch of all days minus that of the day. Both need least values. Where the stated
    error leaves it open which side of the factor a day is on, its values and the counts of the others decide exactly.
    """
    values = measures(answers).where("system IS NOT NULL AND run_day IS NOT NULL")
    days = cut_lineage(sketch(values))
    # The day sketches are added up as they are: no second pass over the rows.
    everything = merge(days, ["system", "metric"]).withColumnRenamed("sketch", "whole")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for rec in b.itertuples(index=False):
                own = _unpack(rec.sketch)
                rest = _unpack(rec.whole) - own
                if own[0] >= least and rest[0] >= least:
                    for p in pcts:
                        (_, x_low, x_high), (_, y_low, y_high) = percentile_of(own, p), percentile_of(rest, p)
                        if x_high >= factor * y_low:
                            out.append((rec.system, rec.run_day, rec.metric, p, x_low >= factor * y_high))
            yield pd.DataFrame(out, columns=[*KEYS, "pct", "sure"])

    marked = cut_lineage(days.join(everything, ["system", "metric"]).select(*KEYS, "sketch", "whole").mapInPandas(run, "system string, run_day string, metric string, pct int, sure boolean"))
    sure, unsure = marked.where("sure").drop("sure"), marked.where("NOT sure").drop("sure")
    if unsure.isEmpty():
        return sure
    # Whether the others' percentile is at most y: by how many of them are, and at the rank itself by its neighbours.
    y = _exact(values, unsure).withColumn("y", F.col("x") / factor).withColumnRenamed("run_day", "day")
    rest = values.join(y, ["system", "metric"]).where("run_day <> day")
    low = F.col("value") <= F.col("y")
    g = rest.groupBy("system", "day", "metric", "pct", "y").agg(F.count("*").alias("n"), F.count_if(low).alias("c"), F.max(F.when(low, F.col("value"))).alias("lo"), F.min(F.when(~low, F.col("value"))).alias("hi"))
    at = (F.col("n") - 1) * F.col("pct") / 100
    between = F.col("lo") + (at - F.floor(at)) * (F.coalesce("hi", "lo") - F.col("lo")) <= F.col("y")
    out = (F.col("c") > F.floor(at) + 1) | ((F.col("c") == F.floor(at) + 1) & between)
    return sure.unionByName(g.where(out).select("system", F.col("day").alias("run_day"), "metric", "pct"))
