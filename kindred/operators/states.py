"""Mergeable states of groups of vectors: counts, weighted sums, and the best member."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import ship
from ..functions.vectors import unit
from .search import matrices

#: Groups that a task holds before it writes their states.
HELD = 50_000


def partial_states(rows: DataFrame, key: str, vector: str, weight: str, quality: str, payload: str) -> DataFrame:
    """key, n, weight, sums and best (quality, payload) of the rows of each group that a task saw: a state a task, however hot a key.

    sums are those of weight times vector, padded with zeros to the longest; null vectors count in n and weight alone. Of equal
    qualities the smallest payload (a long) is the best; null qualities never are.
    """
    ship(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()
    picked = rows.select(key, vector, F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("w"), F.col(quality).cast("double").alias("q"), F.col(payload).cast("long").alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def flushed() -> pa.RecordBatch:
            states = list(held.values())
            best = [None if s[3] is None else {"quality": s[3][0], "payload": -s[3][1]} for s in states]
            return pa.RecordBatch.from_arrays([
                pa.array(list(held), key_kind), pa.array([s[0] for s in states], pa.int64()), pa.array([s[1] for s in states], pa.float64()), pa.array([s[2] for s in states], pa.list_(pa.float64())),
                pa.array(best, pa.struct([("quality", pa.float64()), ("payload", pa.int64())])),
            ], names=[key, "n", "weight", "sums", "best"])

        for batch in batches:
            key_kind = batch.schema.types[0]
            coded = batch.column(0).dictionary_encode(null_encoding="encode")
            codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            w, q, p = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            counts, weights = np.bincount(codes, minlength=len(names)), np.bincount(codes, w, len(names))
            order = np.lexsort((p, -q, codes))
            order = order[~np.isnan(q[order])]
            first = order[np.flatnonzero(np.diff(codes[order], prepend=-1))]
            tops = {int(codes[i]): (float(q[i]), -int(p[i])) for i in first.tolist()}
            for c, name in enumerate(names):
                state = held.setdefault(name, [0, 0.0, np.zeros(0), None])
                state[0] += int(counts[c])
                state[1] += float(weights[c])
                if c in tops:
                    state[3] = tops[c] if state[3] is None else max(state[3], tops[c])
            for at, x in matrices(batch.column(1)):
                for c in np.unique(codes[at]).tolist():
                    mine = codes[at] == c
                    add, state = (x[mine] * w[at][mine, None]).sum(axis=0), held[names[c]]
                    if len(state[2]) < len(add):
                        state[2] = np.pad(state[2], (0, len(add) - len(state[2])))
                    state[2][: len(add)] += add
            if len(held) >= HELD:
                yield flushed()
                held.clear()
        if held:
            yield flushed()

    return picked.mapInArrow(run, f"{key} {kind}, n long, weight double, sums array<double>, best struct<quality:double,payload:bigint>")


def merged_states(states: DataFrame, key: str) -> DataFrame:
    """The states of each key as one. Sums are added by element, so partial sums are combined before the shuffle, and any order or
    grouping of merges gives the same."""
    facts = states.groupBy(key).agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.max(F.when(F.col("best").isNotNull(), F.struct(F.col("best.quality").alias("q"), (-F.col("best.payload")).alias("p")))).alias("_b"))
    cells = states.select(key, F.posexplode("sums").alias("_i", "_v")).groupBy(key, "_i").agg(F.sum("_v").alias("_v"))
    sums = cells.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda c: c["_v"]).alias("sums")).withColumnRenamed(key, "_of")
    best = F.when(F.col("_b").isNotNull(), F.struct(F.col("_b.q").alias("quality"), (-F.col("_b.p")).alias("payload")))
    met = facts.join(sums, F.col(key).eqNullSafe(F.col("_of")), "left")
    return met.select(key, "n", "weight", F.coalesce("sums", F.expr("cast(array() as array<double>)")).alias("sums"), best.alias("best"))


def group_states(rows: DataFrame, key: str, vector: str, weight: str, quality: str, payload: str) -> DataFrame:
    """key, n, weight, sums and best of each group, in two phases."""
    return merged_states(partial_states(rows, key, vector, weight, quality, payload), key)


def centroid(sums: str = "sums"):
    """The mean direction of a state."""
    return unit(F.col(sums))
