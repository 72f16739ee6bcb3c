"""Best matches of many vectors in a gallery: matrix products of blocks, and an exact index for galleries too large to broadcast."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import checkpoints, small_batches

#: Bytes of a gallery's components that are broadcast at most; a larger gallery is indexed and its blocks are met by joins.
GALLERY_BYTES = 64 << 20
#: Vectors of a block, of the index or of a product.
BLOCK = 1024
#: Gallery vectors that the others are dealt to, at most (besides one for each length of vectors).
PIVOTS = 1024
#: Pivots are chosen from so many times as many gallery vectors.
SAMPLE = 8
#: Pairs of a row and a block, and bytes of rows, that a task holds before it writes packs for the blocks of the index.
HELD = 500_000
HELD_BYTES = 16 << 20
_SLACK = 1e-6


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) for each length of the column's vectors; null vectors, and those with a null component, are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    some = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    rows = column.take(pa.array(some)) if len(some) < len(column) else column
    sizes = rows.value_lengths().to_numpy(zero_copy_only=False)
    values = rows.flatten()
    whole = np.ones(len(rows), bool)
    if values.null_count:
        bad = np.repeat(np.arange(len(rows)), sizes)[values.is_null().to_numpy(zero_copy_only=False)]
        whole[bad] = False
    values = values.to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    for n in np.unique(sizes[whole]).tolist():
        at = np.flatnonzero(whole & (sizes == n))
        yield some[at], values[starts[at][:, None] + np.arange(n)[None]]


def dots(x: np.ndarray, g: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the largest finite product with a row of g, over the shorter length, and the smallest id that has it.

    Products come from blocks of the matrix product, at most BLOCK rows of either side at once, whatever a batch holds; those next to
    the largest are added up again in one fixed order, so that equal vectors tie. Without a finite product it is -inf.
    """
    n = min(x.shape[1], g.shape[1])
    x, g = x[:, :n], g[:, :n]
    best, who = np.full(len(x), -np.inf), np.zeros(len(x), np.int64)
    for top in range(0, len(x), BLOCK):
        for low in range(0, len(g), BLOCK):
            _raise(best[top : top + BLOCK], who[top : top + BLOCK], x[top : top + BLOCK], g[low : low + BLOCK], ids[low : low + BLOCK])
    return best, who


def _raise(best: np.ndarray, who: np.ndarray, x: np.ndarray, block: np.ndarray, names: np.ndarray) -> None:
    """Put into best and who what a block has better than they."""
    with np.errstate(all="ignore"):
        product = x @ block.T
    product[~np.isfinite(product)] = -np.inf
    top = product.max(axis=1)
    near = (product >= (top - 1e-9 * (1 + np.abs(top)))[:, None]) & np.isfinite(top)[:, None]
    r, c = np.nonzero(near)
    for a in range(0, len(r), BLOCK * 16):
        rr, cc = r[a : a + BLOCK * 16], c[a : a + BLOCK * 16]
        exact = (x[rr] * block[cc]).sum(axis=1)
        order = np.lexsort((names[cc], -exact, rr))
        rr, exact, found = rr[order], exact[order], names[cc][order]
        first = np.flatnonzero(np.diff(rr, prepend=-1))
        rr, exact, found = rr[first], exact[first], found[first]
        better = (exact > best[rr]) | ((exact == best[rr]) & (found < who[rr]))
        best[rr[better]], who[rr[better]] = exact[better], found[better]


def _met(x: np.ndarray, classes: dict[int, tuple[np.ndarray, np.ndarray]], same_length: bool) -> tuple[np.ndarray, np.ndarray]:
    best, who = np.full(len(x), -np.inf), np.zeros(len(x), np.int64)
    for n, (ids, g) in classes.items():
        if same_length and n != x.shape[1]:
            continue
        score, found = dots(x, g, ids)
        better = (score > best) | ((score == best) & (found < who))
        best[better], who[better] = score[better], found[better]
    return best, who


def distinct_vectors(gallery: DataFrame, vector: str, key: str | None = None) -> DataFrame:
    """_g and _id: each different vector that is finite, with its smallest id (0 without ids)."""
    whole = F.forall(vector, lambda v: F.coalesce((F.abs(v) < float("inf")) & ~F.isnan(v.cast("double")), F.lit(False)))
    rows = gallery.filter(F.coalesce(whole, F.lit(False))).select(F.col(vector).cast("array<double>").alias("_g"), (F.col(key).cast("long") if key else F.lit(0).cast("long")).alias("_id"))
    return rows.groupBy("_g").agg(F.min("_id").alias("_id"))


def best_matches(
    rows: DataFrame, galleries: dict[str, DataFrame], key: str, vector: str = "embedding", same_length: bool = False, gallery_bytes: int = GALLERY_BYTES,
) -> DataFrame:
    """`rows` with a column struct(score, id) for each gallery (of _g and _id, see distinct_vectors), null where nothing is finite.

    Galleries within `gallery_bytes` together are broadcast, and rows keep their place and order: one pass, no shuffle. Others are
    indexed one by one; `key` must then be unique.
    """
    spark = rows.sparkSession
    small_batches(spark)
    tagged = None
    for name, g in galleries.items():
        one = g.select(F.lit(name).alias("_of"), "_g", "_id")
        tagged = one if tagged is None else tagged.unionByName(one)
    size = tagged.agg(F.sum(F.size("_g") * 8 + 16)).first()[0] or 0
    if size > gallery_bytes:
        out = rows
        for name, g in galleries.items():
            found = indexed_matches(rows.select(F.col(key).alias("_key"), F.col(vector).alias("_x")), g, same_length)
            out = out.join(found.select(F.col("_key").alias(key), F.col("_best").alias(name)), key, "left")
        return out
    held: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]] = {name: {} for name in galleries}
    table = tagged.toArrow()
    for name in galleries:
        some = table.filter(pc.equal(table.column("_of"), name))
        for at, g in matrices(some.column("_g")):
            held[name][g.shape[1]] = (some.column("_id").to_numpy()[at], g)
    shared = spark.sparkContext.broadcast(held)
    schema = ", ".join(f"`{n}` {t}" for n, t in [*rows.dtypes, *((name, "struct<score:double,id:bigint>") for name in galleries)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = list(batch.columns)
            groups = list(matrices(batch.column(vector)))
            for classes in shared.value.values():
                score, who = np.full(batch.num_rows, -np.inf), np.zeros(batch.num_rows, np.int64)
                for at, x in groups:
                    score[at], who[at] = _met(x, classes, same_length)
                out.append(_struct(score, who))
            yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names, *shared.value])

    return rows.mapInArrow(run, schema)


def _struct(score: np.ndarray, who: np.ndarray) -> pa.Array:
    none = ~np.isfinite(score)
    return pa.StructArray.from_arrays([pa.array(score), pa.array(who)], names=["score", "id"], mask=pa.array(none))


@dataclass
class Pivots:
    """Unit vectors of one length, with the first block, the number of blocks, the largest angle and the norms of what is dealt to each."""

    at: np.ndarray
    first: np.ndarray
    blocks: np.ndarray
    radius: np.ndarray
    least: np.ndarray
    most: np.ndarray

    def angles(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Angle to each pivot, and the norm, of each row over the pivots' length."""
        n = self.at.shape[1]
        x = x[:, :n] if x.shape[1] >= n else np.pad(x, ((0, 0), (0, n - x.shape[1])))
        norm = np.sqrt((x * x).sum(axis=1))
        return np.arccos(np.clip((x @ self.at.T) / np.maximum(norm, 1e-300)[:, None], -1, 1)), norm

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """No vector dealt to a pivot has a larger product with the row: the angle between them is at least the pivot's less the radius."""
        angle, norm = self.angles(x)
        cosine = np.cos(np.maximum(angle - self.radius[None] - _SLACK, 0))
        bound = np.where(cosine >= 0, self.most[None], self.least[None]) * cosine * norm[:, None]
        return bound + _SLACK * (1 + np.abs(bound))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-300)[:, None]


def spread(x: np.ndarray, most: int) -> np.ndarray:
    """At most `most` different rows of unit vectors, each the farthest in angle from those before it."""
    nearest, chosen = np.full(len(x), -2.0), [0]
    while len(chosen) < most:
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
        far = int(nearest.argmin())
        if nearest[far] > 1 - 1e-9:
            break
        chosen.append(far)
    return x[chosen]


def _dealt(gallery: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            size, pivot, angle, norm = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n), np.zeros(n)
            for at, x in matrices(batch.column(0)):
                cosine = np.clip(_unit(x) @ pivots[x.shape[1]].T, -1, 1)
                size[at], pivot[at], angle[at], norm[at] = x.shape[1], cosine.argmax(axis=1), np.arccos(cosine.max(axis=1)), np.sqrt((x * x).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size), pa.array(pivot), pa.array(angle), pa.array(norm)], names=["_g", "_id", "_size", "_pivot", "_angle", "_norm"])

    return gallery.select("_g", "_id").mapInArrow(run, "_g array<double>, _id long, _size int, _pivot int, _angle double, _norm double")


def build_index(gallery: DataFrame, pivots: int = PIVOTS) -> tuple[DataFrame, dict[int, Pivots]]:
    """Blocks (_block, _ids, _size, _data) of at most about BLOCK vectors that lie near one pivot, and the pivots by length.

    The driver gets the pivots, a bounded number, and five numbers of each; every vector is in one block.
    """
    spark = gallery.sparkSession
    sample = gallery.select("_g").orderBy(F.xxhash64("_g"), "_g").limit(SAMPLE * pivots).unionByName(gallery.groupBy(F.size("_g")).agg(F.min("_g").alias("_g")).select("_g"))
    chosen = {g.shape[1]: spread(_unit(g), pivots) for _, g in matrices(sample.toArrow().column("_g"))}
    checkpoints(spark)
    dealt = _dealt(gallery, chosen).checkpoint()
    facts = dealt.groupBy("_size", "_pivot").agg(F.count("*").alias("n"), F.max("_angle").alias("radius"), F.min("_norm").alias("least"), F.max("_norm").alias("most")).collect()
    index, first = {n: Pivots(p, *[np.zeros(len(p), np.int64) for _ in range(2)], *[np.zeros(len(p)) for _ in range(3)]) for n, p in chosen.items()}, 0
    for r in sorted(facts, key=lambda r: (r["_size"], r["_pivot"])):
        p, i = index[r["_size"]], r["_pivot"]
        p.first[i], p.blocks[i], p.radius[i], p.least[i], p.most[i] = first, -(-r["n"] // BLOCK), r["radius"], r["least"], r["most"]
        first += int(p.blocks[i])
    places = [(n, i, int(p.first[i]), int(p.blocks[i])) for n, p in index.items() for i in range(len(p.at)) if p.blocks[i]]
    where = F.broadcast(spark.createDataFrame(places, "_size int, _pivot int, _first long, _blocks long"))  # a row a pivot
    numbered = dealt.join(where, ["_size", "_pivot"]).withColumn("_block", F.col("_first") + F.pmod(F.xxhash64("_g"), F.col("_blocks")))

    def pack(group: pa.Table) -> pa.Table:
        size = group.column("_size")[0].as_py()
        data = group.column("_g").combine_chunks().flatten().to_numpy(zero_copy_only=False).tobytes()
        return pa.table({"_block": [group.column("_block")[0].as_py()], "_ids": [group.column("_id").to_pylist()], "_size": pa.array([size], pa.int32()), "_data": pa.array([data], pa.binary())})

    blocks = numbered.select("_block", "_id", "_size", "_g").groupBy("_block").applyInArrow(pack, "_block long, _ids array<long>, _size int, _data binary")
    return blocks.checkpoint(), index


def _packs(rows: DataFrame, index: dict[int, Pivots], same_length: bool, again: bool) -> DataFrame:
    """Rows packed for the blocks that they must meet: _block, _keys, _xs, and (again) the best so far.

    First every row meets one block, of the pivot of the highest bound. Again, with the score from there, it is sent to every block
    that may hold a better one or an equal one, and to no other.
    """
    kind = rows.schema["_key"].dataType.simpleString()

    def wanted(x: np.ndarray, first: np.ndarray | None, score: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        rows_, blocks, tops = [], [], []
        for n, p in index.items():
            if same_length and n != x.shape[1]:
                continue
            bound = np.where(p.blocks[None] > 0, p.bounds(x), -np.inf)
            if score is None:
                pivot = bound.argmax(axis=1)
                tops.append(bound.max(axis=1))
                blocks.append(p.first[pivot] + np.arange(len(x)) % np.maximum(p.blocks[pivot], 1))
            else:
                r, pivot = np.nonzero(bound >= score[:, None])
                some = p.blocks[pivot]
                sub = np.arange(int(some.sum())) - np.repeat(np.cumsum(some) - some, some)
                rows_.append(np.repeat(r, some))
                blocks.append(np.repeat(p.first[pivot], some) + sub)
        if not blocks:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if score is None:
            best = np.argmax(np.stack(tops), axis=0)
            return np.arange(len(x)), np.stack(blocks)[best, np.arange(len(x))]
        r, b = np.concatenate(rows_), np.concatenate(blocks)
        keep = b != first[r]
        return r[keep], b[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows_: list[tuple[pa.Array, pa.Array]] = []
        pairs = count = size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            block, row = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            keys, xs = (pa.concat_arrays([r[i] for r in rows_]) for i in (0, 1))
            order = np.argsort(block, kind="stable")
            starts = np.flatnonzero(np.diff(block[order], prepend=-1))
            cuts = [(a, min(a + BLOCK, e)) for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(block)]) for a in range(s, e, BLOCK)]
            for a, e in cuts:
                some = pa.array(row[order[a:e]])
                ends = pa.array([0, e - a], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block[order[a]]], pa.int64()), pa.ListArray.from_arrays(ends, keys.take(some)), pa.ListArray.from_arrays(ends, xs.take(some))], names=["_block", "_keys", "_xs"])

        for batch in batches:
            keys, xs = batch.column(0), batch.column(1).cast(pa.list_(pa.float64()))
            for at, x in matrices(xs):
                finite = np.isfinite(x).all(axis=1)
                at, x = at[finite], x[finite]
                # a few rows at once: a row may be wanted by every block
                for low in range(0, len(at), BLOCK):
                    few, part = at[low : low + BLOCK], x[low : low + BLOCK]
                    if again:
                        r, b = wanted(part, batch.column(2).to_numpy(zero_copy_only=False)[few], batch.column(3).to_numpy(zero_copy_only=False)[few])
                    else:
                        r, b = wanted(part, None, None)
                    if not len(r):
                        continue
                    held.append((b, r + count))
                    rows_.append((keys.take(pa.array(few)), xs.take(pa.array(few))))
                    pairs, count, size = pairs + len(r), count + len(few), size + part.nbytes
                    if pairs >= HELD or size >= HELD_BYTES:
                        yield from flushed()
                        held, rows_, pairs, count, size = [], [], 0, 0, 0
        if held:
            yield from flushed()

    return rows.mapInArrow(run, f"_block long, _keys array<{kind}>, _xs array<array<double>>")


def _against(packs: DataFrame, blocks: DataFrame, kind: str) -> DataFrame:
    """_key, _x, _block, _score, _id of every packed row against its block: one matrix product for a pack and a block.

    A block that no vector was dealt to is not there; its rows have the score -inf.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, xs = batch.column(1)[i].values, batch.column(2)[i].values
                score, who = np.full(len(keys), -np.inf), np.zeros(len(keys), np.int64)
                if batch.column(5)[i].is_valid:
                    ids = np.array(batch.column(3)[i].as_py(), np.int64)
                    g = np.frombuffer(batch.column(5)[i].as_py(), np.float64).reshape(len(ids), batch.column(4)[i].as_py())
                    for at, x in matrices(xs):
                        score[at], who[at] = dots(x, g, ids)
                yield pa.RecordBatch.from_arrays([keys, xs, pa.array(np.full(len(keys), batch.column(0)[i].as_py(), np.int64)), pa.array(score), pa.array(who)], names=["_key", "_x", "_block", "_score", "_id"])

    joined = packs.join(blocks, "_block", "left").select("_block", "_keys", "_xs", "_ids", "_size", "_data")
    return joined.mapInArrow(run, f"_key {kind}, _x array<double>, _block long, _score double, _id long")


def indexed_matches(rows: DataFrame, gallery: DataFrame, same_length: bool = False, pivots: int = PIVOTS) -> DataFrame:
    """_key and _best (score, id) of the rows (_key, _x) that have a finite product, by the index; exact.

    Rows with a non-finite component have none. A pack and its block are one row of the join, so a block that very many
    rows must meet is met by many tasks.
    """
    kind = rows.schema["_key"].dataType.simpleString()
    blocks, index = build_index(gallery, pivots)
    met = _against(_packs(rows, index, same_length, False), blocks, kind).checkpoint()
    more = _against(_packs(met.select("_key", "_x", "_block", "_score"), index, same_length, True), blocks, kind)
    every = met.unionByName(more).filter(F.col("_score") > float("-inf"))
    best = every.groupBy("_key").agg(F.max(F.struct(F.col("_score").alias("score"), (-F.col("_id")).alias("k"))).alias("_m"))
    return best.select("_key", F.struct(F.col("_m.score").alias("score"), (-F.col("_m.k")).alias("id")).alias("_best"))
