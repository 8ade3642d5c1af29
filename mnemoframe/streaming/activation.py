"""Activation of memories: additive injections with a cap, decay per turn, pruning below a floor."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DECAY, FLOOR, AMOUNT = 0.85, 0.05, 1.0
_OUT = "user_id bigint, event_type string, turn bigint, activation double"


def activation_fold(events: DataFrame, keys: list[str], turn: str, amount: float = 0.4) -> DataFrame:
    """Activation of each key after its last turn: per turn decay, prune, then inject with a cap of 1.

    turns are numbers; between two of them the activation decays once a step. Clamping and pruning depend on order, so the
    turns of a key are folded in order; equal turns are counted first, so that a key holds one entry a turn.
    """
    per_turn = events.where(F.col(turn).isNotNull()).groupBy(*keys, turn).agg(F.count("*").alias("n"))
    log = F.array_sort(F.collect_list(F.struct(F.col(turn).cast("bigint").alias("turn"), "n")))

    def step(acc, x):
        faded = acc["a"] * F.pow(F.lit(DECAY), (x["turn"] - acc["turn"]).cast("double"))
        return F.struct(x["turn"].alias("turn"), F.least(F.lit(1.0), F.when(faded < FLOOR, 0.0).otherwise(faded) + amount * x["n"]).alias("a"))

    g = per_turn.groupBy(*keys).agg(log.alias("log"))
    folded = F.aggregate("log", F.struct(F.get("log", F.lit(0))["turn"].alias("turn"), F.lit(0.0).alias("a")), step)
    return g.select(*keys, folded["turn"].alias("turn"), F.round(folded["a"], 6).alias("activation"))


def evict(field: DataFrame, namespace: str, activation: str, inserted: list[str], cap: int = 512) -> DataFrame:
    """The cap most active rows of each namespace; of equally active ones those inserted earliest go first."""
    w = Window.partitionBy(namespace).orderBy(F.col(activation).desc(), *[F.col(c).desc() for c in inserted])
    return field.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")


def activation_stream(events: DataFrame, amount: float = 0.4) -> DataFrame:
    """Streaming form over (user_id, event_type, turn): state (turn, activation) per key, updated batch by batch.

    Turns of a batch are applied in order; turns older than the state's are late and only injected.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turn, a = state.get if state.exists else (None, 0.0)
        turns = pd.concat([f["turn"] for f in frames]).value_counts().sort_index()
        for t, n in turns.items():
            faded = a * DECAY ** max(0, t - turn) if turn is not None else 0.0
            a = min(1.0, (0.0 if faded < FLOOR else faded) + amount * n)
            turn = t if turn is None else max(turn, t)
        state.update((int(turn), float(a)))
        yield pd.DataFrame({"user_id": [key[0]], "event_type": [key[1]], "turn": [turn], "activation": [round(a, 6)]})

    return events.groupBy("user_id", "event_type").applyInPandasWithState(update, _OUT, "turn bigint, activation double", "update", GroupStateTimeout.NoTimeout)


def activation_spread(active: DataFrame, links: DataFrame, factor: float = 0.4) -> DataFrame:
    """(id, activation) after one hop: neighbours along (a, b) get factor times the activation, at most 1 in all."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = active.join(both, F.col("id") == F.col("a")).select(F.col("b").alias("id"), (F.col("activation") * factor).alias("activation"))
    return active.select("id", "activation").unionByName(near).groupBy("id").agg(F.round(F.least(F.lit(1.0), F.sum("activation")), 6).alias("activation"))
