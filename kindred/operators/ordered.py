"""Operators over rows in order per key: run lengths and folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(rows: DataFrame, key: str, order: str, hit: Column) -> DataFrame:
    """Length of the current run of hits and of misses at each row."""
    w = Window.partitionBy(key).orderBy(order)
    marked = rows.withColumn("hit", hit)
    islands = marked.withColumn("_hits", F.sum(F.col("hit").cast("long")).over(w)).withColumn("_misses", F.sum((~F.col("hit")).cast("long")).over(w))
    miss_run = F.when(~F.col("hit"), F.row_number().over(Window.partitionBy(key, "_hits").orderBy(F.col("hit").desc(), order)) - F.max(F.col("hit").cast("int")).over(Window.partitionBy(key, "_hits")))
    hit_run = F.when(F.col("hit"), F.row_number().over(Window.partitionBy(key, "_misses").orderBy(F.col("hit"), order)) - F.max((~F.col("hit")).cast("int")).over(Window.partitionBy(key, "_misses")))
    out = islands.withColumn("miss_run", F.coalesce(miss_run, F.lit(0)).cast("long")).withColumn("hit_run", F.coalesce(hit_run, F.lit(0)).cast("long"))
    return out.drop("_hits", "_misses")


def miss_policy(run: Column, predicted: int = 6, held: int = 24) -> Column:
    """What a tracker shows in a run of misses: predictions, then the last confirmed camera, then nothing (null)."""
    return F.when(run == 0, "observed").when(run <= predicted, "predicted").when(run <= predicted + held, "held")


#: Rows, and then maps, that are folded as one array.
CHUNK = 1024


@dataclass(frozen=True)
class Maps:
    """Steps of a fold as maps from state to state that compose: `then(a, b)` is a first, and b after it."""

    identity: Column
    then: Callable[[Column, Column], Column]
    applied: Callable[[Column, Column], Column]


def affine() -> Maps:
    """Maps s -> s * a + b as structs of a and b."""
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    return Maps(pair(F.lit(1.0), F.lit(0.0)), lambda x, y: pair(x["a"] * y["a"], x["b"] * y["a"] + y["b"]), lambda m, s: s * m["a"] + m["b"])


def finite(states: int) -> Maps:
    """Maps over the states 0 to n - 1 as arrays of their images."""
    return Maps(F.array(*[F.lit(i) for i in range(states)]), lambda x, y: F.transform(x, lambda i: F.get(y, i)), lambda m, s: F.get(m, s))


def _ranged(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows range-partitioned and sorted by key and order, so that a hot key is spread, with _part and _at, their place in it."""
    sorted_ = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    placed = sorted_.withColumn("_at", F.monotonically_increasing_id())  # the partition's number, then 33 bits for the row
    return placed.withColumn("_part", F.shiftright("_at", 33).cast("int"))


def _chunks(rows: DataFrame, key: str, order: list[str], step: Column, maps: Maps) -> DataFrame:
    """key, _part, _chunk, n, _steps and their map, for each run of at most CHUNK places."""
    ranged = _ranged(rows.select(key, *order, step.alias("_m")), key, order)
    lists = ranged.groupBy(key, "_part", F.floor(F.col("_at") / CHUNK).alias("_chunk")).agg(F.array_sort(F.collect_list(F.struct("_at", "_m", *[F.col(c).alias(f"_by_{c}") for c in order if c != key]))).alias("_steps"))
    return lists.select(key, "_part", "_chunk", F.size("_steps").cast("long").alias("n"), "_steps", F.aggregate("_steps", maps.identity, lambda m, x: maps.then(m, x["_m"])).alias("_map"))


def _joined(parts: DataFrame, by: list[str], place: str, maps: Maps) -> DataFrame:
    """The maps of each group in order of `place` as one map, with their number of rows."""
    lists = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(place, F.col("_map").alias("_m")))).alias("_maps"), F.sum("n").alias("n"))
    return lists.select(*by, "n", F.aggregate("_maps", maps.identity, lambda m, x: maps.then(m, x["_m"])).alias("_map"))


def folded(rows: DataFrame, key: str, order: list[str], step: Column, first: Column, maps: Maps) -> DataFrame:
    """key, state and n: the state of each key after all its steps in order, started at `first`.

    Composition is associative, so runs of rows are folded to one map each, those of a range partition to one, and those of a key in
    order of partitions. No array holds more than CHUNK rows, a partition's runs, or one map a partition.
    """
    parts = _joined(_chunks(rows, key, order, step, maps).drop("_steps"), [key, "_part"], "_chunk", maps)
    whole = _joined(parts, [key], "_part", maps)
    return whole.select(key, maps.applied(F.col("_map"), first).alias("state"), "n")


def _entered(parts: DataFrame, by: list[str], place: str, maps: Maps) -> DataFrame:
    """Each group's `place`s with the map of all that lies before them in the group."""
    lists = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(place, F.col("_map").alias("_m")))).alias("_maps"))
    start = F.struct(maps.identity.alias("now"), F.slice("_maps", 1, 0).alias("out"))
    step = lambda s, x: F.struct(maps.then(s["now"], x["_m"]).alias("now"), F.array_append(s["out"], F.struct(x[place].alias(place), s["now"].alias("_m"))).alias("out"))
    return lists.select(*by, F.explode(F.aggregate("_maps", start, step, lambda s: s["out"])).alias("_e")).select(*by, F.col(f"_e.{place}").alias(place), F.col("_e._m").alias("_before"))


def scanned(rows: DataFrame, key: str, order: list[str], step: Column, first: Column, maps: Maps) -> DataFrame:
    """key, the columns of order, and state: the state after each row. Each run of rows is entered with the state before it."""
    chunks = _chunks(rows, key, order, step, maps)
    parts = _joined(chunks.drop("_steps"), [key, "_part"], "_chunk", maps)
    outer = _entered(parts, [key], "_part", maps).withColumnRenamed("_before", "_outer")
    inner = _entered(chunks.drop("_steps"), [key, "_part"], "_chunk", maps)
    entry = inner.join(outer, [key, "_part"]).select(key, "_chunk", maps.applied(maps.then(F.col("_outer"), F.col("_before")), first).alias("_s"))
    met = chunks.select(key, "_chunk", "_steps").join(entry, [key, "_chunk"])
    none = F.transform(F.slice("_steps", 1, 0), lambda x: F.col("_s"))
    run = F.aggregate("_steps", none, lambda out, x: F.array_append(out, maps.applied(x["_m"], F.coalesce(F.get(out, F.size(out) - 1), F.col("_s")))))
    return met.select(key, F.explode(F.arrays_zip("_steps", run.alias("_run"))).alias("_x")).select(
        key, *[F.col(f"_x._steps._by_{c}").alias(c) for c in order if c != key], F.col("_x._run").alias("state"))


def _average(value: Column, keep: float) -> Column:
    return F.struct(F.lit(keep).alias("a"), (value * (1 - keep)).alias("b"))


def smoothed(rows: DataFrame, key: str, order: list[str], value: Column, keep: float = 0.85, first: float = 0.6) -> DataFrame:
    """Exponential moving average at the end of each key, started at `first`."""
    return folded(rows, key, order, _average(value, keep), F.lit(first), affine())


def smoothed_rows(rows: DataFrame, key: str, order: list[str], value: Column, keep: float = 0.85, first: float = 0.6) -> DataFrame:
    """Exponential moving average after each row of a key."""
    return scanned(rows, key, order, _average(value, keep), F.lit(first), affine())


def _chains(at: np.ndarray, gap: int) -> list[dict]:
    """What entering sorted times does: for a last emission before them, the first row not before its time + gap, and from there on
    the last row emitted and how many are.

    Each row points to the first row at least `gap` later; pointer doubling gives all chains' ends and lengths. The last emission lies before the
    first row, so only rows in the first gap, and the next one, can come first. Of neighbours with one outcome the last is kept.
    """
    n = len(at)
    after = np.append(np.maximum(np.searchsorted(at, at + gap, "left"), np.arange(1, n + 1)), n)
    count, end = np.append(np.ones(n, np.int64), 0), np.arange(n + 1)
    while (after[:n] < n).any():
        count = count + count[after]
        end = np.where(after < n, end[after], end)
        after = after[after]
    first = np.flatnonzero(np.diff(at, prepend=at[0] - 1))  # of equal times only the first row can be emitted
    first = first[: np.searchsorted(at[first], at[0] + gap, "left") + 1] if gap > 0 else first[:1]
    outcome = np.column_stack((end[first], count[first]))
    last = np.append((outcome[1:] != outcome[:-1]).any(axis=1), True)
    return [{"at": int(at[i]), "last": int(at[end[i]]), "n": int(count[i]), "ends": bool(end[i] == n - 1)} for i in first[last].tolist()]


def throttled(rows: DataFrame, key: str, at: str, order: list[str], gap: int = 180) -> DataFrame:
    """How many rows of each key are emitted: the first, those `gap` after the last emitted one, and the last.

    Rows are range-partitioned by key and time; each partition gives what it makes of any last emission before it, and a key's
    partitions are then passed in order, one row each. Rows without a time are left out.
    """
    kind = rows.schema[key].dataType.simpleString()
    entries = "array<struct<at: bigint, last: bigint, n: bigint, ends: boolean>>"
    ranged = rows.filter(F.col(at).isNotNull()).select(key, F.col(at).cast("long").alias("_t"), *[F.col(c).alias(f"_by_{i}") for i, c in enumerate(order)])
    by = [f"_by_{i}" for i in range(len(order))]
    ranged = ranged.repartitionByRange(key, *by).sortWithinPartitions(key, *by).select(key, "_t", F.spark_partition_id().alias("_part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = pa.list_(pa.struct([("at", pa.int64()), ("last", pa.int64()), ("n", pa.int64()), ("ends", pa.bool_())]))
        held: list[np.ndarray] = []
        name = part = None

        def packed() -> pa.RecordBatch:
            times = np.concatenate(held)
            return pa.RecordBatch.from_arrays([pa.array([name], names.type), pa.array([part], pa.int32()), pa.array([len(times)], pa.int64()), pa.array([_chains(times, gap)], form)], names=[key, "_part", "n", "_map"])

        for batch in batches:
            if not batch.num_rows:
                continue
            names, times = batch.column(0), batch.column(1).to_numpy()
            part, coded = batch.column(2)[0].as_py(), names.dictionary_encode()
            codes = coded.indices.fill_null(-1).to_numpy()
            edges = np.append(np.flatnonzero(np.diff(codes, prepend=codes[0] - 1)), len(codes))
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
                now = names[low].as_py()
                if held and now != name:
                    yield packed()
                    held = []
                name = now
                held.append(times[low:high])
        if held:
            yield packed()

    maps = ranged.mapInArrow(run, f"{key} {kind}, _part int, n long, _map {entries}")
    lists = maps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_part", "_map"))).alias("_maps"), F.sum("n").alias("n"))
    state = lambda last, n, ends: F.struct(last.alias("last"), n.alias("n"), ends.alias("ends"))

    def step(s: Column, x: Column) -> Column:
        hit = F.get(F.filter(x["_map"], lambda e: s["last"].isNull() | (e["at"] >= s["last"] + gap)), F.lit(0))
        return F.when(hit.isNull(), state(s["last"], s["n"], F.lit(False))).otherwise(state(hit["last"], s["n"] + hit["n"], hit["ends"]))

    done = F.aggregate("_maps", state(F.lit(None).cast("long"), F.lit(0).cast("long"), F.lit(False)), step)
    return lists.select(key, done.alias("_s"), "n").select(key, (F.col("_s.n") + (~F.col("_s.ends")).cast("long")).alias("emitted"), "n")


def cumulative_mean(rows: DataFrame, key: str, order: str, value: str, every: int = 300) -> DataFrame:
    """The mean so far at every `every`-th row of a key."""
    w = Window.partitionBy(key).orderBy(order)
    out = rows.select(key, F.row_number().over(w).cast("long").alias("n"), F.avg(value).over(w).alias("mean"))
    return out.filter(F.col("n") % every == 0)
