"""Document fingerprints by winnowing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, small_batches, table

K, WINDOW = 16, 32
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_POSITION_BITS = 25
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Code points that are hashed side by side; well below the 2 ** 25 positions that a key can hold.
_CHUNK = 1 << 20


def winnow(codes: list[np.ndarray], k: int = K, window: int = WINDOW) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each array of code points the selected (hashes, positions), positions in order.

    Hashes of all k-grams, 39 bits each, roll by doubling; of each window of `window` successive grams the least hash is selected,
    the rightmost of equal ones. Any common substring of at least window + k - 1 code points shares a selected
    gram. A text with fewer than k code points is one gram, with fewer grams than a window one window; an empty one has none.
    `k` and `window` must be powers of two.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = []
    part, n = [], 0
    for c in codes:
        if part and n + len(c) > _CHUNK:
            out += _winnow(part, k, window)
            part, n = [], 0
        part.append(c)
        n += len(c) + k + window
    return out + (_winnow(part, k, window) if part else [])


def _winnow(codes: list[np.ndarray], k: int, window: int) -> list[tuple[np.ndarray, np.ndarray]]:
    sizes = np.array([len(c) for c in codes], np.int64)
    pad = k + window
    starts = np.concatenate(([0], np.cumsum(sizes + pad)[:-1]))
    total = int((sizes + pad).sum())
    if total >= 1 << _POSITION_BITS:
        return [_long(c, k, window) for c in codes]
    h = np.zeros(total, np.uint64)
    for s, c in zip(starts.tolist(), codes):
        h[s : s + len(c)] = c
        h[s : s + len(c)] += np.uint64(1)  # a code point of 0 differs from the padding
    power, m = _MULTIPLIER, 1
    while m < k:
        h[: total - m] = h[: total - m] * np.uint64(power) + h[m:]
        power, m = power * power & 0xFFFFFFFFFFFFFFFF, 2 * m
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    low = np.uint64((1 << _POSITION_BITS) - 1)
    h &= ~low  # the upper bits are the hash; a key holds it with its position, so that minima need no second look
    grams = np.where(sizes == 0, 0, np.maximum(sizes - k + 1, 1))
    marks = np.zeros(total + 1, np.int8)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + grams, -1)
    valid = np.cumsum(marks[:-1]) > 0
    key = h | (low - np.arange(total, dtype=np.uint64))
    key[~valid] = _TOP
    m = 1
    while m < window:
        np.minimum(key[: total - m], key[m:], out=key[: total - m])
        m *= 2
    windows = np.where(grams == 0, 0, np.maximum(grams - window + 1, 1))
    out = []
    for s, w in zip(starts.tolist(), windows.tolist()):
        if not w:
            out.append((np.empty(0, np.uint64), np.empty(0, np.int64)))
            continue
        at = (low - (key[s : s + w] & low)).astype(np.int64)
        at = at[np.concatenate(([True], at[1:] != at[:-1]))]
        out.append((h[at], at - s))
    return out


def _long(codes: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """A text of more code points than a key can hold, in pieces that overlap by a window of grams."""
    step, hashes, places = _CHUNK, [], []
    for a in range(0, max(1, len(codes) - (window + k - 2)), step):
        (h, at), *_ = _winnow([codes[a : a + step + window + k - 2]], k, window)
        hashes.append(h)
        places.append(at + a)
    at, first = np.unique(np.concatenate(places), return_index=True)
    return np.concatenate(hashes)[first], at


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le"), np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes (sorted, unique); 1 for two empty ones."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def digest(hashes: np.ndarray) -> str:
    return hashlib.sha256(hashes.tobytes()).hexdigest()[:32]


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, hashes and positions (the selected k-grams in order) of each row; null and empty texts have none.

    Repeated rows are fingerprinted each; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = winnow([code_points(t) for t in batch.column(1).to_pylist()], k, window)
            hashes = pa.array([h.view(np.int64) for h, _ in got], pa.list_(pa.int64()))
            at = pa.array([p.astype(np.int32) for _, p in got], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), hashes, at], names=["doc_id", "hashes", "positions"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, hashes array<long>, positions array<int>")


#: places: the selected grams' positions, each by its distance from the one before (the first from 0), a byte each; no distance exceeds a window.
_RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, places binary"
_KINDS = [pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, pa.binary()]


def _compare(texts: list[str], nexts: list[str], k: int, window: int) -> list[list]:
    """The columns of _RESULT for each text and the next document's text."""
    edited = []
    for t, n in zip(texts, nexts):
        half = len(t) // 2
        edited.append(t[: len(t) - half] + n[:half])
    # a text is mostly the next of its predecessor: each distinct object is hashed once
    own = {id(t): t for t in (*texts, *nexts)}
    selected = dict(zip(own, winnow([code_points(t) for t in own.values()], k, window)))
    sets = {key: np.unique(h) for key, (h, _) in selected.items()}
    changed = [np.unique(h) for h, _ in winnow([code_points(t) for t in edited], k, window)]
    return [
        [len(t) for t in texts],
        [hashlib.sha256(t.encode()).hexdigest() for t in edited],
        [digest(sets[id(t)]) for t in texts],
        [digest(c) for c in changed],
        [likeness(sets[id(t)], c) for t, c in zip(texts, changed)],
        [likeness(sets[id(t)], sets[id(n)]) for t, n in zip(texts, nexts)],
        [np.diff(selected[id(t)][1], prepend=0).astype(np.uint8).tobytes() for t in texts],
    ]


def _packed(first: list[pa.Array], columns: list[list]) -> list[pa.Array]:
    return [*first, *[pa.array(c, k) for c, k in zip(columns, _KINDS)]]


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose second half is the start of the next document's.

    The next document is the one with the next smaller id; the last one's is the first. Rows that share an id are ordered
    by their texts' hash. Null text counts as empty, a null id comes last. With one row, it is its own next. An empty table gives no
    rows; other columns are ignored, whatever their names. Texts of any length are fingerprinted whole; `k` and `window` are at most 255.

    Rows are range-partitioned and sorted by id and streamed, so a row meets its next in its own task; only the first and the
    last text of each partition go through a second step, of two rows per partition.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    names = ["doc_id", *[c.split()[0] for c in _RESULT.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, first = [], [], True

        def edge(which: str, at: int) -> pa.RecordBatch:
            none = [pa.array([None], k) for k in _KINDS]
            return pa.RecordBatch.from_arrays(
                [pa.array([ids[at]], id_kind), *none, pa.array([which]), pa.array([texts[at]], pa.string()), pa.array([pid[0]], pa.int32())],
                names=[*names, "edge", "text", "pid"],
            )

        id_kind, pid = pa.int64(), [0]
        for batch in batches:
            if not batch.num_rows:
                continue
            id_kind = batch.column(0).type
            pid[0] = batch.column(2)[0].as_py()
            ids += batch.column(0).to_pylist()
            texts += [t or "" for t in batch.column(1).to_pylist()]
            if first:
                yield edge("first", 0)
                first = False
            if len(texts) > 1:
                columns = _packed([pa.array(ids[:-1], id_kind)], _compare(texts[:-1], texts[1:], k, window))
                n = len(texts) - 1
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32())], names=[*names, "edge", "text", "pid"])
                ids, texts = ids[-1:], texts[-1:]
        if texts:
            yield edge("last", 0)

    order = [F.col("_id").desc_nulls_last(), F.col("_hash").desc()]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(F.col(text_col)).alias("_hash"))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("_id", "_text", F.spark_partition_id().alias("_pid"))
    schema = f"doc_id {kind.simpleString()}, {_RESULT}, edge string, text string, pid int"
    found = cut(ranged.mapInArrow(run, schema))

    # two rows per partition: each partition's last document and the first one of the next partition, or of the first;
    # only partition numbers are put in order, and the texts find each other by them
    edges = found.filter(F.col("edge").isNotNull()).select("doc_id", "edge", "text", "pid")
    around = Window.orderBy("pid")
    numbers = edges.filter("edge = 'first'").select("pid")
    numbers = numbers.select(F.col("pid").alias("_head"), F.lag("pid").over(around).alias("_before"), F.max("pid").over(Window.partitionBy(F.lit(1))).alias("_end"))
    numbers = F.broadcast(numbers.select("_head", F.coalesce("_before", "_end").alias("_of")))  # a row per partition
    heads = edges.filter("edge = 'first'").join(numbers, F.col("pid") == F.col("_head")).select("_of", F.col("text").alias("next"))
    pairs = edges.filter("edge = 'last'").join(heads, F.col("pid") == F.col("_of")).select("doc_id", "text", "next")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = _compare(batch.column(1).to_pylist(), batch.column(2).to_pylist(), k, window)
            yield pa.RecordBatch.from_arrays(_packed([batch.column(0)], columns), names=names)

    last = pairs.mapInArrow(finish, f"doc_id {kind.simpleString()}, {_RESULT}")
    return found.filter(F.col("edge").isNull()).select(*names).unionByName(last)


def op4_winnowing(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and its edited text's."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))
