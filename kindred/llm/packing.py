"""Packing token ids into windows: combinations of lengths by non-negative least squares, residuals one after another."""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..cluster import shared_folder
from ._common import checked_broadcast, cut, running_total, small_batches, table
from .token_files import WordIds, default_tokenizer, word_ids

#: Tokens of a window.
WINDOW = 2048
#: Passes of the solver over all combinations at most.
PASSES = 200
#: Chunks whose ids a task's tokenizer keeps; about 200 bytes each.
CACHE = 600_000
#: Bytes of texts that are split into chunks at once; the more, the fewer chunks are looked up again.
AT_ONCE = 4 << 20
#: Bytes of rows that a task holds before it writes them.
_ROW_GROUP = 16 << 20
#: Cut pieces whose keys are broadcast at most; those of more meet their ids by a shuffle.
BROADCAST_CUTS = 500_000


@dataclass
class Combinations:
    """Column j fills a window with times[j] pieces of length first[j] and, unless second[j] is 0, one of length second[j]."""

    first: np.ndarray
    times: np.ndarray
    second: np.ndarray


def combinations(window: int) -> Combinations:
    """All ways to fill a window with pieces of at most two lengths, the second once; about window * ln(window) of them."""
    first = np.repeat(np.arange(1, window + 1), window // np.arange(1, window + 1))
    starts = np.flatnonzero(np.diff(first, prepend=0))
    times = np.arange(len(first)) - np.repeat(starts, np.diff(np.append(starts, len(first)))) + 1
    second = window - first * times
    once = (times > 1) | (second == 0) | (first > second)  # (a, b) and (b, a) are one; (a, a) is two times a
    once &= second != first
    return Combinations(first[once], times[once], second[once])


def solve(histogram: np.ndarray, ways: Combinations, passes: int = PASSES, close: float = 1e-3) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared difference of the lengths used and `histogram` (by length, from 0).

    Cyclic coordinate descent: each step is the exact minimum over one count. The longest pieces, which fit in fewest ways, are
    settled first. The work depends on the window alone, not on the number of pieces. It ends when no count of a pass changes
    by more than `close`.
    """
    left = histogram.astype(np.float64).tolist()
    left[0] = 0.0
    order = np.lexsort((ways.times, -np.maximum(ways.first, ways.second)))
    have = histogram > 0
    order = order[have[ways.first[order]] & (have[ways.second[order]] | (ways.second[order] == 0))]
    cells = list(zip(ways.first[order].tolist(), ways.times[order].tolist(), ways.second[order].tolist()))
    x = [0.0] * len(cells)
    for _ in range(passes):
        most = 0.0
        for j, (a, k, b) in enumerate(cells):
            old = x[j]
            new = old + ((k * left[a] + left[b]) / (k * k + 1) if b else left[a] / k)
            if new < 0.0:
                new = 0.0
            step = new - old
            if step:
                x[j] = new
                left[a] -= k * step
                if b:
                    left[b] -= step
                most = max(most, step, -step)
        if most <= close:
            break
    out = np.zeros(len(ways.first))
    out[order] = x
    return out


def whole_counts(histogram: np.ndarray, ways: Combinations, x: np.ndarray) -> np.ndarray:
    """x rounded to whole counts that use no more pieces of a length than there are, then raised while pieces last.

    Counts are dealt in order of the rounded solution's tokens, so that rounding first costs the rarest combinations; a second
    pass gives what is left to any combination that it fills exactly.
    """
    left = histogram.astype(np.int64).tolist()
    counts = np.zeros(len(x), np.int64)
    wanted = np.floor(x + 0.5).astype(np.int64)
    order = np.lexsort((np.arange(len(x)), -x))
    for top in (wanted, None):
        for j in order.tolist():
            a, k, b = int(ways.first[j]), int(ways.times[j]), int(ways.second[j])
            n = left[a] // k
            if b:
                n = min(n, left[b])
            if top is not None:
                n = min(n, int(top[j]))
            if n > 0:
                counts[j] += n
                left[a] -= k * n
                if b:
                    left[b] -= n
    return counts


def plan(histogram: np.ndarray, window: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rows (length, low, high, times, first sequence, offset) and the number of sequences that they fill.

    The pieces of a length that are numbered from low until high go to the row, `times` of them in a sequence from `offset` on.
    """
    ways = combinations(window)
    counts = whole_counts(histogram, ways, solve(histogram, ways))
    used, rows, sequences = [0] * (window + 1), [], 0
    for j in np.flatnonzero(counts).tolist():
        a, k, b, n = int(ways.first[j]), int(ways.times[j]), int(ways.second[j]), int(counts[j])
        rows.append((a, used[a], used[a] + n * k, k, sequences, 0))
        used[a] += n * k
        if b:
            rows.append((b, used[b], used[b] + n, 1, sequences, a * k))
            used[b] += n
        sequences += n
    return rows, sequences


def _pieces(batches: Iterator[pa.RecordBatch], model: WordIds, part: int, window: int, end_id: int) -> Iterator[pa.RecordBatch]:
    seq, ranks = 0, [0] * (window + 1)
    for batch in batches:
        names, texts = batch.column(0), batch.column(1)
        for low in range(0, len(texts), 1024):
            where, starts, lengths, totals, crcs, rank = [], [], [], [], [], []
            got = model.encode(texts.slice(low, 1024), end_id)
            data = np.concatenate(got).astype("<u4", copy=False).view(np.uint8)
            at = 0
            for i, n in enumerate(map(len, got)):
                for start in range(0, n, window):
                    length = min(window, n - start)
                    where.append(low + i)
                    starts.append(start)
                    lengths.append(length)
                    totals.append(n)
                    crcs.append(zlib.crc32(data[at : at + 4 * length]))
                    at += 4 * length
                    rank.append(ranks[length])
                    ranks[length] += 1
            m = len(where)
            # pieces follow each other in `data`. pa.array of memoryviews would never free their bytes (seen with pyarrow 23.0.1)
            ends = np.concatenate(([0], np.cumsum(np.array(lengths, np.int64) * 4))).astype(np.int32)
            ids = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(ends), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, part, np.int32)), pa.array(np.arange(seq, seq + m)), names.take(pa.array(where, pa.int64())), pa.array(starts, pa.int64()),
                 pa.array(lengths, pa.int32()), pa.array(totals, pa.int64()), pa.array(crcs, pa.int64()), pa.array(rank, pa.int64()), ids],
                names=["part", "seq", "doc_id", "start", "length", "doc_tokens", "ids_crc32", "rank", "ids"])
            seq += m


def token_pieces(docs: DataFrame, window: int, id_col: str, text_col: str, tokenizer: str, end_id: int) -> DataFrame:
    """The ids of each text and `end_id`, cut into windows and a rest: part, seq and rank, doc_id, start, length, doc_tokens, ids_crc32, ids.

    (part, seq) names a piece; rank numbers the pieces of a length within a part. ids are little-endian 32-bit numbers.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pieces(batches, word_ids(tokenizer, CACHE, AT_ONCE), TaskContext.get().partitionId(), window, end_id)

    schema = f"part int, seq long, doc_id {kind}, start long, length int, doc_tokens long, ids_crc32 long, rank long, ids binary"
    return docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).mapInArrow(run, schema)


def _ends(rest: int) -> list[tuple[int, int]]:
    """`rest` tokens as runs of powers of two, the longest first."""
    out, at = [], 0
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            out.append((at, at + (1 << bit)))
            at += 1 << bit
    return out


def place(pieces: DataFrame, window: int) -> DataFrame:
    """part, seq, from, length, sequence_id, offset: where each piece, or each part of a cut piece, goes.

    The histogram of lengths (at most `window` numbers) is all that the driver gets. Pieces of a length are numbered by part and
    rank, so a very common length costs a row a part, not a sort. Pieces that the plan has no place for are laid one
    after another, the longest first, and cut where a window ends; what remains at the very end is cut at powers of two, so that no
    sequence needs padding.
    """
    spark = pieces.sparkSession
    counts = cut(pieces.groupBy("length", "part").agg(F.count("*").alias("_n")))
    histogram = np.zeros(window + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    rows, filled = plan(histogram, window)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = pieces.select("part", "seq", "length", "rank").join(base, ["length", "part"]).withColumn("_rank", F.col("_base") + F.col("rank"))
    # the plan has two rows a combination at most, so the window bounds it
    slots = F.broadcast(spark.createDataFrame(rows, "_length int, _low long, _high long, _times long, _sequence long, _offset long"))
    meets = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high"))
    ranked = cut(ranked.join(slots, meets, "left").select("part", "seq", "length", "_rank", "_low", "_times", "_sequence", "_offset"))
    nth = F.col("_rank") - F.col("_low")
    planned = ranked.filter("_low is not null").select(
        "part", "seq", F.lit(0).alias("from"), "length",
        (F.col("_sequence") + F.floor(nth / F.col("_times"))).cast("long").alias("sequence_id"), (F.col("_offset") + nth % F.col("_times") * F.col("length")).cast("long").alias("offset"))
    loose = running_total(ranked.filter("_low is null").select("part", "seq", "length"), [F.col("length").desc(), F.col("part"), F.col("seq")], F.col("length"), "_at")
    total = int((histogram * np.arange(window + 1)).sum()) - filled * window
    full, rest = divmod(total, window)
    end = F.col("_at") + F.col("length")
    windows = F.transform(F.sequence(F.floor(F.col("_at") / window), F.floor((end - 1) / window)), lambda w: F.struct((w * window).alias("low"), (w * window + window).alias("high"), (w + filled).alias("id")))
    last = [F.struct(F.lit(full * window + a).cast("long").alias("low"), F.lit(full * window + b).cast("long").alias("high"), F.lit(filled + full + i).cast("long").alias("id")) for i, (a, b) in enumerate(_ends(rest))]
    spans = F.filter(windows, lambda w: w["high"] <= full * window)
    if last:
        spans = F.concat(spans, F.filter(F.array(*last), lambda w: (w["low"] < end) & (w["high"] > F.col("_at"))))
    low, high = F.greatest(F.col("_at"), F.col("w.low")), F.least(end, F.col("w.high"))
    laid = loose.withColumn("w", F.explode(spans)).select(
        "part", "seq", (low - F.col("_at")).cast("int").alias("from"), (high - low).cast("int").alias("length"), F.col("w.id").alias("sequence_id"), (low - F.col("w.low")).alias("offset"))
    return planned.unionByName(laid)


def pack_documents(
    docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1, with_ids: bool = False,
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of each piece; with `with_ids` also its ids.

    Each text's ids, `end_id` last, are cut into pieces that lie whole in one sequence. Sequences number from 0, have `window` ids, or
    a power of two for the last ones; there is no padding. A null text is empty and gives `end_id` alone. Rows that repeat an
    id, null too, are packed each; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    path = os.path.join(shared_folder(spark), f"packing-{uuid.uuid4().hex}")
    token_pieces(docs, window, id_col, text_col, tokenizer or default_tokenizer(), end_id).write.option("parquet.block.size", _ROW_GROUP).parquet(path)
    pieces = spark.read.parquet(path)
    # (part, seq) names a row for good: the table is written, so a lost executor's rows are read again as they were
    placed = cut(place(pieces.drop("ids"), window).withColumnsRenamed({"length": "_length", "part": "_part", "seq": "_seq"}))
    where = (F.col("part") == F.col("_part")) & (F.col("seq") == F.col("_seq"))
    slots = ["sequence_id", "offset", "from", "_length"]
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, start long, length int, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    keep = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {n: batch.column(n) for n in batch.schema.names}
            spans = zip(col["ids"].to_pylist(), col["from"].to_pylist(), col["_length"].to_pylist())
            some = [ids[4 * a : 4 * (a + n)] for ids, a, n in spans]
            out = {**col, "start": pa.array(col["start"].to_numpy() + col["from"].to_numpy()), "length": col["_length"], "ids_crc32": pa.array([zlib.crc32(x) for x in some], pa.int64())}
            if with_ids:
                out["ids"] = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in some], pa.list_(pa.int32()))
            names = [*keep, "ids"] if with_ids else keep
            yield pa.RecordBatch.from_arrays([out[n] for n in names], names=names)

    def sliced(met: DataFrame) -> DataFrame:
        return met.select("doc_id", "start", "doc_tokens", "ids", *slots).mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))

    if with_ids:
        return sliced(pieces.join(placed, where))
    # only what is cut needs its ids again
    known = pieces.drop("ids").join(placed, where)
    parted = cut(known.filter(F.col("length") != F.col("_length")).select("_part", "_seq", *slots))
    again = sliced(pieces.join(checked_broadcast(parted, parted.count(), BROADCAST_CUTS), where))
    return known.filter(F.col("length") == F.col("_length")).select(*keep).unionByName(again)


def packed_sequences(docs: DataFrame, **how) -> DataFrame:
    """sequence_id and ids of each sequence, and the doc_ids of its pieces in order, for training."""
    pieces = pack_documents(docs, with_ids=True, **how)
    # a sequence has at most `window` ids
    rows = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("_p"))
    return rows.select("sequence_id", F.flatten(F.col("_p.ids")).alias("ids"), F.col("_p.doc_id").alias("doc_ids"), F.col("_p.length").alias("lengths"))


def op13_packing(spark, sf_dir: str) -> DataFrame:
    """Every document's ids in sequences of at most 2,048."""
    found = pack_documents(table(spark, sf_dir, "documents"))
    return found.withColumn("length", F.col("length").cast("long"))
