"""SimHash fingerprints and near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import LOWER, UPPER, checked_broadcast, cut, same, small_batches, table

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Variants that one bucket of a task is meant to hold; the number of buckets follows from it. One of twice as many is dealt again.
BUCKET_VARIANTS = 5_000_000
#: Points that one bucket of a task holds at most. A larger one is dealt again, and split by chunks where no bits are left.
BUCKET_ROWS = 200_000
#: Leading bits by which a larger bucket is dealt again.
MORE_BITS = 8
#: Pairs that a task holds before it writes them.
PAIRS_AT_ONCE = 1_000_000
#: Pairs whose sketches are compared at once (512 bytes a pair).
SKETCHES_AT_ONCE = 1 << 15
#: Pairs a member of a run up to which a turn looks at all of them; in runs with more it looks at one a member until the last turn.
PAIRS_A_MEMBER = 64
#: New links, as a share of the documents that collided, down to which turns of forests go on before all pairs are verified.
FEW_LINKS = 0.01
#: Bytes of text that are broadcast at most to verify pairs; more of them are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: Shingles of documents seen last that a verifying task keeps.
RECENT_SHINGLES = 1_000_000
#: Keys of documents (8 bytes each) that are broadcast at most; more of them are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Sketch words of 64 bits, and how many of their bits may differ at most for a pair to be verified, as a share. At a similarity of
#: 0.8 a share of 0.151 differs, with a deviation of 0.008: one such pair in several thousand is beyond.
WIDE, FAR = 32, 0.18


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `words` words, repeats included; fewer words give one hash of all of them."""
    found = (text or "").encode().translate(_LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], 42) for a, b in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist())], np.uint64)


def majorities(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of `sizes` hashes the 64-bit number with a bit set where over half of them have it; 0 for an empty run."""
    out = np.zeros(len(sizes), np.uint64)
    has = np.flatnonzero(sizes)
    n = sizes[has]
    if not len(n):
        return out
    parts = -(-n // 255)  # a byte counts 255 rows at most
    first = np.cumsum(parts) - parts
    starts = np.repeat(np.cumsum(n) - n, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    counts = np.empty((len(starts), 8, 8), np.uint8)
    for bit in range(8):  # one bit of each of the eight bytes at a time: eight counters in a word
        lanes = (hashes >> np.uint64(bit)) & np.uint64(0x0101010101010101)
        counts[:, :, bit] = np.add.reduceat(lanes, starts).astype("<u8").view(np.uint8).reshape(-1, 8)
    totals = np.add.reduceat(counts.reshape(-1, 64), first, axis=0, dtype=np.int64)
    out[has] = np.packbits(totals * 2 > n[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def majority(hashes: np.ndarray) -> int:
    return int(majorities(hashes, np.array([len(hashes)]))[0])


def _mixed(hashes: np.ndarray, salt: int) -> np.ndarray:
    """Further hashes of the same shingles (the finaliser of splitmix64)."""
    z = hashes + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """id and fp (64 bits as a long)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_hashes(text, words) for text in batch.column(1).to_pylist()]
            fps = majorities(np.concatenate([np.empty(0, np.uint64), *found]), np.array([len(h) for h in found], np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def sketches(docs: DataFrame, text_col: str, words: int, blocks: int, bits: int) -> DataFrame:
    """The other columns of `docs` with same, keys, blocks and sketch, for texts that have words.

    All are taken over the set of a text's shingles (a repeated one counts once). `same` is a 128-bit hash of the whole set, `sketch`
    its SimHash of WIDE * 64 bits, `blocks` the first `blocks` parts of `bits` bits of that, and `keys` an anchor for each
    block: its smallest shingle hash under a multiplication of the block's own.
    """
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != text_col]
    odd = [np.uint64(((2 * k + 1) * 0x9E3779B97F4A7C15 | 1) & 0xFFFFFFFFFFFFFFFF) for k in range(1, blocks + 1)]
    weights = np.int64(1) << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(text, words)) for text in batch.column(text_col).to_pylist()]
            has = [len(h) > 0 for h in sets]
            sets = [h for h in sets if len(h)]
            n = len(sets)
            if not n:
                continue
            sizes = np.array([len(h) for h in sets], np.int64)
            flat, starts = np.concatenate(sets), np.cumsum(sizes) - sizes
            wide = np.stack([majorities(_mixed(flat, k), sizes) for k in range(1, WIDE + 1)], axis=1).astype("<u8")
            each = np.unpackbits(wide.view(np.uint8).reshape(n, WIDE * 8), axis=1)[:, : blocks * bits].reshape(n, blocks, bits) @ weights
            keys = np.stack([np.minimum.reduceat(flat * o, starts) ^ o for o in odd], axis=1).view(np.int64)
            ends = pa.array(np.arange(n + 1, dtype=np.int32) * blocks)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.select(rest).filter(pa.array(has)).columns, pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in sets], pa.binary()),
                    pa.ListArray.from_arrays(ends, pa.array(keys.ravel())), pa.ListArray.from_arrays(ends, pa.array(each.ravel())),
                    pa.array([w.tobytes() for w in wide], pa.binary()),
                ],
                names=[*rest, "same", "keys", "blocks", "sketch"],
            )

    added = [T.StructField("same", T.BinaryType()), *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("keys", "blocks")], T.StructField("sketch", T.BinaryType())]
    return docs.mapInArrow(run, T.StructType([*[docs.schema[c] for c in rest], *added]))


def ball_masks(bits: int, radius: int) -> np.ndarray:
    """Every mask of at most `radius` of `bits` bits."""
    return np.array([sum(1 << b for b in c) for r in range(min(radius, bits) + 1) for c in combinations(range(bits), r)], np.uint64)


@dataclass
class _Members:
    """The points of some whole buckets: rank of the document (in order of id), value, flips used, bucket, and what a round needs."""

    ids: np.ndarray
    doc: np.ndarray
    value: np.ndarray
    flips: np.ndarray
    bucket: np.ndarray
    root: np.ndarray | None = None
    sketch: np.ndarray | None = None
    at: np.ndarray | None = None  # the number of the block
    keys: np.ndarray | None = None  # of all blocks
    blocks: np.ndarray | None = None

    def met_before(self, a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
        """Whether points a and b collide in a block before this one too, where the pair is written already."""
        out = np.zeros(len(a), bool)
        for k in range(self.keys.shape[1]):
            out |= (k < self.at[a]) & (self.keys[a, k] == self.keys[b, k]) & (np.bitwise_count(self.blocks[a, k] ^ self.blocks[b, k]) <= radius)
        return out

    def runs(self, low: int, half: int) -> tuple[np.ndarray, np.ndarray]:
        """Every variant of every point, equal ones of a bucket next to each other: their points, and a number of each run of two or more."""
        owner, made = [], []
        base = (self.bucket.astype(np.uint64) << np.uint64(low)) if low < 64 else np.zeros(len(self.doc), np.uint64)
        base |= self.value & np.uint64((1 << low) - 1)
        for r in range(half + 1):
            at, tails = np.flatnonzero(self.flips == r).astype(np.int32), ball_masks(low, half - r)
            made.append((base[at][:, None] ^ tails[None, :]).ravel())
            owner.append(np.repeat(at, len(tails)))
        variant, owner = np.concatenate(made), np.concatenate(owner)
        order = np.argsort(variant)
        variant = variant[order]
        same = variant[1:] == variant[:-1]
        inside = np.append(same, False)
        inside[1:] |= same
        number = np.cumsum(np.concatenate(([True], ~same)))[inside] if len(variant) else np.empty(0, np.int64)
        return owner[order[inside]], number


def _starts(number: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1]))) if len(number) else np.empty(0, np.int64)


def _forest(m: _Members, owner: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Colliding pairs that connect all documents which any chain of runs connects, each with the first of its run where possible."""
    starts = _starts(number)
    doc = m.doc[owner]
    if not len(starts):
        return doc, doc
    first = np.repeat(np.minimum.reduceat(doc, starts), np.diff(np.append(starts, len(doc))))
    keys = np.unique((first[first != doc] << 32) | doc[first != doc])
    parent: dict[int, int] = {}
    left, right = [], []
    for a, b in zip((keys >> 32).tolist(), (keys & 0xFFFFFFFF).tolist()):
        x, y = a, b
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        while parent.setdefault(y, y) != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[y] = x
            left.append(a)
            right.append(b)
    return np.array(left, np.int64), np.array(right, np.int64)


def _unlinked(m: _Members, owner: np.ndarray, number: np.ndarray, radius: int, turn: int, everything: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that share a run, whose roots differ and whose sketches are near: `everything`, or a forest of them.

    The forest joins roots by their nearest sketches first, so its pairs are the likeliest links. In runs of more than PAIRS_A_MEMBER pairs a
    member each member offers one pair to it only, with the first of another root in an order that changes with `turn`. After the forest follow
    pairs (a, a) of the documents that are still open: those of a near pair left out of the forest, and all of such long runs. No other document
    has a near pair of different roots that was not written, and none can come later, as roots only grow.
    """
    most = int(FAR * WIDE * 64)

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rows of far, document, document, place, place: a row for each of the pairs."""
        a, b = owner[a], owner[b]
        far = np.empty(len(a), np.int64)
        for lo in range(0, len(a), SKETCHES_AT_ONCE):
            some = slice(lo, lo + SKETCHES_AT_ONCE)
            far[some] = np.bitwise_count(m.sketch[a[some]] ^ m.sketch[b[some]]).sum(axis=1, dtype=np.int64)
        keep = far <= most
        if everything:  # a pair that collides in several blocks is written in the first of them
            keep[keep] = ~m.met_before(a[keep], b[keep], radius)
        a, b = a[keep], b[keep]
        x, y = m.doc[a], m.doc[b]
        _, first = np.unique((np.minimum(x, y) << 32) | np.maximum(x, y), return_index=True)
        return np.stack([far[keep], np.minimum(x, y), np.maximum(x, y), a, b])[:, first]

    if not len(owner):
        return
    turned = _mixed(m.ids[m.doc[owner]].view(np.uint64), turn)
    order = np.lexsort((turned, m.root[owner], number))
    owner, number, turned = owner[order], number[order], turned[order]
    root = m.root[owner]
    starts = _starts(number)
    ends = np.append(starts[1:], len(owner))
    firsts = np.flatnonzero(np.concatenate(([True], (number[1:] != number[:-1]) | (root[1:] != root[:-1]))))
    group_end = np.repeat(np.append(firsts[1:], len(owner)), np.diff(np.append(firsts, len(owner))))
    run_end = np.repeat(ends, ends - starts)
    beyond = run_end - group_end  # members of later roots in the same run
    offers, waiting = [], np.empty(0, np.int64)
    if not everything:
        long = np.repeat(np.add.reduceat(beyond, starts) > PAIRS_A_MEMBER * (ends - starts), ends - starts)
        if long.any():
            heads = firsts[long[firsts]]  # the first of each root in its run
            best = heads[np.lexsort((turned[heads], number[heads]))]
            place = _starts(number[best])
            one, other = best[place], best[place + 1]
            run = np.searchsorted(number[one], number[long])
            at = np.flatnonzero(long)
            waiting = m.doc[owner[at]]
            offers.append(near(at, np.where(root[at] == root[one[run]], other[run], one[run])))
            beyond = np.where(long, 0, beyond)
    at = np.flatnonzero(beyond)
    total = np.cumsum(beyond[at])
    for lo in range(0, int(total[-1]) if len(total) else 0, PAIRS_AT_ONCE):
        step = np.arange(lo, min(lo + PAIRS_AT_ONCE, int(total[-1])))
        i = np.searchsorted(total, step, side="right")
        left = at[i]
        found = near(left, group_end[left] + step - (total[i] - beyond[left]))
        if everything:
            yield found[1], found[2]
        else:
            offers.append(found)
    if not offers:
        return
    far, a, b, x, y = np.concatenate(offers, axis=1)
    order = np.lexsort((b, a, far))
    parent: dict[int, int] = {}
    keep = []
    for k, p, q in zip(order.tolist(), m.root[x[order]].tolist(), m.root[y[order]].tolist()):
        while parent.setdefault(p, p) != p:
            parent[p] = p = parent[parent[p]]
        while parent.setdefault(q, q) != q:
            parent[q] = q = parent[parent[q]]
        if p != q:
            parent[q] = p
            keep.append(k)
    yield a[keep], b[keep]
    left = np.ones(len(a), bool)
    left[keep] = False
    left = np.unique(np.concatenate((a[left], b[left], waiting)))
    yield left, left


def _meet(dealt: DataFrame, bits: int, radius: int, lead: int, pairs_of: Callable, whole: bool) -> DataFrame:
    """kind 0: a colliding pair (a, b); 1: a point of a bucket that is too large for one task, with its columns (none if `whole`)."""
    half, low = radius // 2, bits - lead
    each = np.array([len(ball_masks(low, half - r)) for r in range(half + 1)])
    names = dealt.columns
    rounds, most_buckets = "root" in names, 1 << min(40, 64 - low)
    most_variants, most_rows = BUCKET_VARIANTS, BUCKET_ROWS
    kinds = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), *[T.StructField(f.name, f.dataType) for f in dealt.schema]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def written(kind: int, a, b, rows: pa.RecordBatch | None = None) -> pa.RecordBatch:
            n = len(a)
            rest = rows.columns if rows is not None else [pa.nulls(n, f.type) for f in schema[0]]
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), *rest], names=["kind", "a", "b", *names])

        def spilled(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            for part in rows.to_batches(10_000):
                yield written(1, np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64), part)

        def close(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            """Whole buckets: those of one point go, too large ones are handed on, the others are matched some at a time."""
            key, prefix = rows.column("key").to_numpy(), rows.column("prefix").to_numpy()
            starts = _starts(np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (prefix[1:] != prefix[:-1])))))
            sizes = np.diff(np.append(starts, len(key)))
            variants = np.add.reduceat(each[rows.column("flips").to_numpy()], starts)
            large = ((variants > 2 * most_variants) | (sizes > most_rows)) & (not whole)
            if large.any():
                yield from spilled(rows.filter(pa.array(np.repeat(large, sizes))))
            keep = ~large & (sizes > 1)
            rows, sizes, variants = rows.filter(pa.array(np.repeat(keep, sizes))), sizes[keep], variants[keep]
            first, row, ends = 0, 0, np.cumsum(sizes)
            while first < len(sizes):
                until = first + max(1, min(most_buckets, int(np.searchsorted(np.cumsum(variants[first:]), most_variants))))
                yield from match(rows.slice(row, int(ends[until - 1]) - row), np.repeat(np.arange(until - first), sizes[first:until]))
                first, row = until, int(ends[until - 1])

        def match(rows: pa.Table, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
            ids, doc = np.unique(rows.column("id").to_numpy(), return_inverse=True)
            m = _Members(ids, doc.astype(np.int64), rows.column("value").to_numpy().view(np.uint64), rows.column("flips").to_numpy(), bucket)
            if rounds:
                m.root = rows.column("root").to_numpy()
                m.sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(-1, WIDE)
                m.at = rows.column("at").to_numpy()
                m.keys, m.blocks = (rows.column(c).combine_chunks().flatten().to_numpy().reshape(len(m.at), -1) for c in ("keys", "blocks"))
            for a, b in pairs_of(m, *m.runs(low, half)):
                yield written(0, ids[a], ids[b])

        schema: list[pa.Schema] = []
        held, rows, variants, open_rows, open_variants, last, spilling = [], 0, 0, 0, 0, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            schema[:] = [batch.schema]
            key, prefix = batch.column("key").to_numpy(), batch.column("prefix").to_numpy()
            starts = np.flatnonzero(np.concatenate(([last != (key[0], prefix[0])], (key[1:] != key[:-1]) | (prefix[1:] != prefix[:-1]))))
            last = (key[-1], prefix[-1])
            if spilling:
                at = int(starts[0]) if len(starts) else batch.num_rows
                yield from spilled(pa.Table.from_batches([batch.slice(0, at)]))
                if not len(starts):
                    continue
                batch, starts, spilling = batch.slice(at), starts - at, False
            count = each[batch.column("flips").to_numpy()]
            held.append(batch)
            if len(starts):
                open_rows, open_variants = batch.num_rows - int(starts[-1]), int(count[starts[-1] :].sum())
            else:
                open_rows, open_variants = open_rows + batch.num_rows, open_variants + int(count.sum())
            rows, variants = rows + batch.num_rows, variants + int(count.sum())
            spilling = not whole and (open_variants > 2 * most_variants or open_rows > most_rows)
            if spilling or ((rows >= 100_000 or variants >= most_variants) and open_rows < rows):
                every = pa.Table.from_batches(held)
                if open_rows < rows:
                    yield from close(every.slice(0, rows - open_rows))
                left = every.slice(rows - open_rows)
                held, rows, variants = left.to_batches(), open_rows, open_variants
                if spilling:
                    yield from spilled(left)
                    held, rows, variants, open_rows, open_variants = [], 0, 0, 0, 0
        if held:
            yield from close(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, kinds)


def _deal(points: DataFrame, bits: int, radius: int, lead: int, more: int) -> DataFrame:
    """Each point to every bucket of `more` further leading bits that holds one of its variants; a bucket is a key and a prefix."""
    if more:
        half = radius // 2
        masks = F.array(*[F.struct(F.lit(int(x)).cast("long").alias("m"), F.lit(int(x).bit_count()).alias("n")) for x in ball_masks(more, half)])
        part = F.shiftrightunsigned("value", bits - lead - more).bitwiseAND(F.lit((1 << more) - 1).cast("long"))
        rest = [c for c in points.columns if c not in ("prefix", "flips")]
        points = points.withColumn("_x", F.explode(F.filter(masks, lambda x: x["n"] + F.col("flips") <= half)))
        points = points.select(
            *rest, F.shiftleft("prefix", more).bitwiseOR(part.bitwiseXOR(F.col("_x.m"))).alias("prefix"), (F.col("flips") + F.col("_x.n")).alias("flips"),
        )
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return points.repartition(parts, "key", "prefix").sortWithinPartitions("key", "prefix")


def _split(points: DataFrame) -> DataFrame:
    """Points of buckets of a single variant, which are too large for a task, dealt to smaller buckets that have the same pairs.

    Points without roots go to chunks that all have the bucket's first point, which connects them. Points with roots need every pair of
    different roots: those of the bucket's commonest root (the copies of one text, in a large bucket) meet each chunk of the other points,
    and chunks of the other points meet each other. A bucket of one root has no such pairs and goes.
    """
    half = max(1, BUCKET_ROWS // 2)
    bucket, number = ["key", "prefix"], F.xxhash64("id", F.lit(7))
    chunks = lambda n: F.ceil(n / F.lit(half)).cast("long")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    meeting = lambda kind, x, y: F.struct(F.lit(kind).alias("k"), x.alias("x"), y.alias("y"))
    if "root" in points.columns:
        sizes = points.groupBy(*bucket, "root").agg(F.count("*").alias("n")).groupBy(*bucket).agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("top"))
        sizes = sizes.select("key", "prefix", F.col("top.root").alias("_top"), chunks(F.col("top.n")).alias("_h"), chunks(F.col("n") - F.col("top.n")).alias("_o")).filter("_o > 0")
        mine = F.pmod(number, F.when(F.col("root") == F.col("_top"), F.col("_h")).otherwise(F.col("_o")))
        of_top = F.transform(upto("_o"), lambda j: meeting(0, F.col("_c"), j))
        of_rest = F.concat(
            F.transform(upto("_h"), lambda i: meeting(0, i, F.col("_c"))),
            F.transform(upto("_o"), lambda j: meeting(1, F.least(F.col("_c"), j), F.greatest(F.col("_c"), j))),
        )
        meetings = F.when(F.col("root") == F.col("_top"), of_top).otherwise(of_rest)
    else:
        sizes = points.groupBy(*bucket).agg(F.min("id").alias("_top"), chunks(F.count("*")).alias("_h"))
        mine = F.pmod(number, F.col("_h"))
        zero = F.lit(0).cast("long")
        meetings = F.when(F.col("id") == F.col("_top"), F.transform(upto("_h"), lambda i: meeting(0, i, zero))).otherwise(F.array(meeting(0, F.col("_c"), zero)))
    sizes = cut(sizes)
    sized = points.join(checked_broadcast(sizes, sizes.count(), BROADCAST_KEYS), bucket).withColumn("_c", mine).withColumn("_m", F.explode(meetings))
    keys = {"key": F.xxhash64("key", "prefix", "_m.k", "_m.x", "_m.y"), "prefix": F.lit(0).cast("long")}
    return sized.select(*[keys.get(c, F.col(c)).alias(c) for c in points.columns])


def ball_pairs(points: DataFrame, bits: int, radius: int, rows: int = 0, pairs_of: Callable | None = None) -> DataFrame:
    """Colliding pairs (a, b) of `points` (id long, key long, value long): of one key, and with a variant in common.

    Every value emits all variants within radius / 2 of it, and variants meet: two values within `radius` bits share at
    least one, and two that share one are within `radius` bits. Variants are dealt by key and leading bits, so many
    that `rows` points of one key fill buckets of BUCKET_VARIANTS. A value goes once to each bucket that holds any of its variants (not once
    per variant), and the bucket's task derives the variants that fall into it and sorts them. A bucket that turns out
    too large, as when many points share a key or a neighbourhood, is not matched there: its points are dealt again by further
    leading bits, until buckets fit or all bits are used. What is too large even then, as when many points share a value, is split by chunks.

    Without `pairs_of` the pairs written connect all documents that collisions connect, fewer than the points of a bucket. Each
    of these is a link only if every collision is one; otherwise see `verified_components`.
    """
    half = radius // 2
    pairs_of = pairs_of or (lambda m, owner, number: [_forest(m, owner, number)])
    lead, whole = 0, False
    more = max(0, min(bits - 2, int(np.ceil(np.log2(max(1, rows * len(ball_masks(bits, half)) / BUCKET_VARIANTS))))))
    todo = points.withColumns({"prefix": F.lit(0).cast("long"), "flips": F.lit(0)})
    pairs = None
    while True:
        dealt = _deal(todo, bits, radius, lead, more)
        lead += more
        found = cut(_meet(dealt, bits, radius, lead, pairs_of, whole))
        part = found.filter("kind = 0").select("a", "b").distinct()
        pairs = part if pairs is None else pairs.unionByName(part).distinct()
        todo, more = found.filter("kind = 1").drop("kind", "a", "b"), min(MORE_BITS, bits - lead)
        if whole or todo.isEmpty():
            return pairs
        if lead == bits:
            todo, whole = _split(todo), True


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node that a chain of edges reaches; only nodes that have an edge.

    Alternates large-star and small-star steps until the edges no longer change. Neighbours are reduced by map-side
    minima, so a node with very many edges is never gathered.
    """
    now = cut(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u < v").distinct())
    state = None
    while True:
        # large star: neighbours above a node point to the smallest of its neighbourhood
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        # written out and counted, so that a node with very many edges meets a broadcast or a plain exchange, which can be split
        large = both.join(checked_broadcast(least, least.count(), BROADCAST_KEYS), "u").filter("v > u").select(F.col("m").alias("u"), "v").filter("u < v").distinct()
        # small star: a node and its smaller neighbours point to the smallest of them
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(down, "v").select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).filter("u < v").distinct()
        now = cut(small)
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == state:
            break
        state = tuple(found)
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(
        now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    )


def verified_components(marked: DataFrame, bits: int, radius: int, holds: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root) as in `components`, over those colliding pairs that `holds` returns when given pairs (a, b).

    `marked` has id, keys, blocks and sketch (see `sketches`). First each bucket's forest is verified, which joins true groups at the
    cost of about a pair a member. A pair that fails may have stood for others, so all documents that collided go on with their
    roots, in turns: a forest of the colliding pairs of different roots with near sketches is verified, the nearest first, and links
    are contracted. Documents without a near pair left to verify take no part in later turns. When a turn brings few links, every
    colliding pair left of different roots whose sketches are near is verified. At the end each colliding pair is connected, or its sketches are far apart, or it was refuted itself.
    """
    points = marked.select("id", F.explode(F.arrays_zip("keys", "blocks")).alias("_p"))
    tried = cut(ball_pairs(points.select("id", F.col("_p.keys").alias("key"), F.col("_p.blocks").alias("value")), bits, radius))
    none = F.expr("cast(array() as array<bigint>)")
    links = cut(holds(tried))
    roots = components(links)
    live = cut(tried.select(F.col("a").alias("_l")).distinct().union(tried.select("b").distinct()).distinct())
    many = live.count()
    rest = cut(marked.join(checked_broadcast(live, many, BROADCAST_KEYS), F.col("id") == F.col("_l"), "left_semi").select("id", "keys", "blocks", "sketch"))
    turn, everything = 0, False
    while True:
        turn += 1
        rooted = rest.join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("root"), "sketch", "keys", "blocks")
        points = rooted.select("*", F.posexplode(F.arrays_zip("keys", "blocks")).alias("at", "_p"))
        points = points.select(
            "id", F.col("_p.keys").alias("key"), F.col("_p.blocks").alias("value"), "root", "sketch", "at",
            *[(F.col(c) if everything else none).alias(c) for c in ("keys", "blocks")],
        )
        found = cut(ball_pairs(points, bits, radius, 0, lambda m, owner, number, t=turn, e=everything: _unlinked(m, owner, number, radius, t, e)))
        fresh = cut(found.filter("a <> b").join(tried, ["a", "b"], "left_anti"))
        good = cut(holds(fresh))
        new = good.count()
        if new:
            links = links.unionByName(good)
            roots = components(links)
        if everything:
            return roots
        left = found.filter("a = b").select(F.col("a").alias("_l"))
        rest = cut(rest.join(checked_broadcast(left, left.count(), BROADCAST_KEYS), F.col("id") == F.col("_l"), "left_semi"))
        tried, everything = tried.unionByName(fresh), new <= FEW_LINKS * many


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """Documents whose 64-bit SimHash fingerprints link within `radius` bits, as connected components; a row per input row.

    Returns doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable). Equal fingerprints
    collapse first, so a group of copies costs one fingerprint. Null or empty texts have fingerprint zero and link like any
    other; a null id takes part but never names a component unless all its ids are null. Repeated rows
    stay repeated. An empty table gives no rows.
    """
    marked = cut(fingerprints(docs, id_col, text_col, words))
    distinct = cut(marked.groupBy("fp").agg(F.min("id").alias("first")))
    points = distinct.select(F.col("fp").alias("id"), F.lit(0).cast("long").alias("key"), F.col("fp").alias("value"))
    pairs = ball_pairs(points, 64, radius, distinct.count())
    roots = components(pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
    linked = cut(distinct.join(roots, distinct.fp == roots.node).select("fp", "root", "first"))
    smallest = cut(linked.groupBy("root").agg(F.min("first").alias("_least")))
    many = smallest.count()
    named = linked.join(checked_broadcast(smallest, many, BROADCAST_KEYS), "root").select(F.col("fp").alias("_fp"), "_least")
    of = cut(distinct.join(named, F.col("fp") == F.col("_fp"), "left").select(F.col("fp").alias("_of"), F.coalesce("_least", "first").alias("component_id")))
    return marked.join(of, F.col("fp") == F.col("_of")).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def jaccard_of_pairs(pairs: DataFrame, texts: DataFrame, words: int, least: float, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The pairs (a, b) of ids whose sets of word shingles have a Jaccard similarity of at least `least`.

    `texts` has _t and _x of the documents in the pairs.
    """
    size = texts.agg(F.sum(F.octet_length("_x"))).first()[0] or 0
    texts = F.broadcast(texts) if size <= broadcast_bytes else texts
    full = pairs.join(texts, F.col("a") == F.col("_t")).select("a", "b", F.col("_x").alias("x"))
    full = full.join(texts, F.col("b") == F.col("_t")).select("a", "b", "x", F.col("_x").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: OrderedDict[int, np.ndarray] = OrderedDict()
        held = 0

        def shingles(doc: int, text: str) -> np.ndarray:
            nonlocal held
            found = recent.pop(doc, None)
            if found is None:
                found = np.unique(shingle_hashes(text, words))
                held += len(found)
            recent[doc] = found
            while held > RECENT_SHINGLES and len(recent) > 2:
                held -= len(recent.popitem(last=False)[1])
            return found

        for batch in batches:
            keep = []
            for a, b, x, y in zip(*(batch.column(k).to_pylist() for k in range(4))):
                p, q = shingles(a, x), shingles(b, y)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= least * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return full.mapInArrow(run, "a long, b long")


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, blocks: int = 20, bits: int = 24, radius: int = 2
) -> DataFrame:
    """The rows of `docs` without near copies: of linked documents the one with the largest id stays.

    At a similarity of 0.8 about 15 in 100 bits of a SimHash differ. A fingerprint of 64 bits within 4 misses most such pairs, and
    blocks short enough to find them collide by chance so often that their pairs grow with the square of the table. So the
    same ball hashing runs on `blocks` blocks of `bits` bits, within `radius` bits each, and each block's variants meet only
    among documents that share the block's anchor, their smallest shingle under a hash of its own. A pair of similarity
    0.8 shares an anchor and is within the radius in at least one block in about 99 of 100 cases (measured figures are
    in the README); unlike documents share no anchor, and those with a common passage differ in the block. Colliding pairs
    are verified by the exact Jaccard similarity of their sets of `words`-word shingles (`verified_components`).

    Documents with the same set of shingles collapse to one first. Texts without words, null ones too, are all kept. Rows that repeat
    an id and a text are one document: all of them stay or go. A null id is below all others. An empty table gives no rows; other
    columns are kept as they are, whatever their names.
    """
    names = docs.columns
    source = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_h"), F.col(text_col).alias("_x"))
    marked = sketches(source, "_x", words, blocks, bits)
    marked = cut(marked.withColumn("id", F.monotonically_increasing_id()))
    named = cut(marked.groupBy("same").agg(F.min("id").alias("rep"), F.count("*").alias("n")).filter("n > 1").select(F.col("same").alias("_s"), "rep"))
    named = checked_broadcast(named, named.count(), BROADCAST_KEYS)
    equal = cut(marked.select("id", "same").join(named, F.col("same") == F.col("_s")).filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")))
    copies = checked_broadcast(equal.select(F.col("b").alias("_l")), equal.count(), BROADCAST_KEYS)
    keys = marked.select(F.col("_id").alias("_i"), F.col("_h").alias("_k"), F.col("id").alias("_t"))
    every = same(F.col("_id"), F.col("_i")) & (F.col("_h") == F.col("_k"))

    def holds(pairs: DataFrame) -> DataFrame:
        wanted = cut(pairs.select(F.col("a").alias("_w")).distinct().union(pairs.select("b").distinct()).distinct())
        n = wanted.count()
        wanted = cut(keys.join(checked_broadcast(wanted, n, BROADCAST_KEYS), F.col("_t") == F.col("_w"), "left_semi"))
        texts = source.join(checked_broadcast(wanted, n, BROADCAST_KEYS), every).select("_t", "_x")
        return jaccard_of_pairs(pairs, texts, words, similarity)

    near = verified_components(marked.join(copies, F.col("id") == F.col("_l"), "left_anti"), bits, radius, holds)
    near = near.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = components(near.unionByName(equal))
    member = cut(roots.join(keys, F.col("node") == F.col("_t")).select("root", "_i", "_k"))
    best = cut(member.groupBy("root").agg(F.max(F.struct("_i", "_k")).alias("stays")))
    gone = member.join(checked_broadcast(best, best.count(), BROADCAST_KEYS), "root").filter(~same(F.struct("_i", "_k"), F.col("stays")))
    gone = cut(gone.select(F.col("_i").alias("_k_i"), F.col("_k").alias("_k_k")).distinct())
    gone = checked_broadcast(gone, gone.count(), BROADCAST_KEYS)
    mine = docs.select(F.col(id_col).alias("_k_id"), F.xxhash64(text_col).alias("_k_h"), F.struct(*names).alias("_k_row"))
    return mine.join(gone, same(F.col("_k_id"), F.col("_k_i")) & (F.col("_k_h") == F.col("_k_k")), "left_anti").select("_k_row.*")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """All documents with their SimHash fingerprint and component."""
    return simhash_components(table(spark, sf_dir, "documents"))
