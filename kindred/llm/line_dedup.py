"""Line deduplication: hashes are range-partitioned and streamed in order; documents get compressed keep bitmaps."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import ASCII_SPACE, LOWER, UPPER, cut, same, small_batches, table

_LOWER = str.maketrans(UPPER, LOWER)
_BOTTOM = -(1 << 63)


def line_key(line: str) -> str:
    return line.strip(ASCII_SPACE).translate(_LOWER)


def _occurrences(docs: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """(h1, h2, doc, tag, pos) of each line whose key is long enough; h1, h2 are its 128-bit hash, tag tells texts of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, docs_, tags, at = [], [], [], []
            for doc, text, tag in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if not text or len(text) < least_chars:
                    continue
                for i, line in enumerate(text.split("\n")):
                    if len(line) >= least_chars and len(key := line_key(line)) >= least_chars:
                        digests.append(xxhash.xxh3_128_digest(key.encode()))
                        docs_.append(_BOTTOM if doc is None else doc)
                        tags.append(tag)
                        at.append(i)
            hashes = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.array(docs_, pa.int64()), pa.array(tags, pa.int64()), pa.array(at, pa.int32())],
                names=["h1", "h2", "doc", "tag", "pos"],
            )

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col), F.xxhash64(F.col(text_col)))
    return rows.mapInArrow(run, "h1 long, h2 long, doc long, tag long, pos int")


def _streamed(ranged: DataFrame, least_docs: int) -> DataFrame:
    """Stream each sorted partition: lines to drop (open = false), and all lines of the first and last hash (open = true).

    A partition's first and last hash may go on in its neighbours, so they are decided afterwards. Every other hash is
    whole here: it is in one partition, sorted by document from the largest, so its first document keeps its lines.
    """

    def decide(run: np.ndarray) -> np.ndarray:
        docs = run["doc"]
        many = 1 + np.count_nonzero(docs[1:] != docs[:-1])
        return run[docs != docs[0]] if many >= least_docs else run[:0]

    def packed(run: np.ndarray, is_open: bool) -> pa.RecordBatch:
        arrays = [pa.array(np.ascontiguousarray(run[n])) for n in ("h1", "h2", "doc", "tag", "pos")]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(len(run), is_open))], names=["h1", "h2", "doc", "tag", "pos", "open"])

    kind = [("h1", "i8"), ("h2", "i8"), ("doc", "i8"), ("tag", "i8"), ("pos", "i4")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held = True, []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.empty(batch.num_rows, kind)
            for name, _ in kind:
                rows[name] = batch.column(name).to_numpy()
            edges = (np.flatnonzero((rows["h1"][1:] != rows["h1"][:-1]) | (rows["h2"][1:] != rows["h2"][:-1])) + 1).tolist()
            if held and (held[0]["h1"][0] != rows["h1"][0] or held[0]["h2"][0] != rows["h2"][0]):
                edges = [0, *edges]
            if not edges:
                held.append(rows)
                continue
            whole = np.concatenate([*held, rows[: edges[0]]])
            yield packed(whole if first else decide(whole), first)
            first = False
            out = [decide(rows[a:b]) for a, b in zip(edges, edges[1:]) if b - a >= least_docs]
            if out:
                yield packed(np.concatenate(out), False)
            held = [rows[edges[-1] :]]
        if held:
            yield packed(np.concatenate(held), True)

    return ranged.mapInArrow(run, "h1 long, h2 long, doc long, tag long, pos int, open boolean")


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """Compressed keep bitmaps of the documents that lose lines: doc_id, tag, n_dropped, keep.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased. Keys of at least `least_chars` code points
    in at least `least_docs` documents stay only in the largest doc_id that holds them. `keep` is a zlib-compressed
    bit string, a bit per line up to the byte of the last one dropped, 0 for a dropped line; `tag` is xxhash64 of the text, which
    tells apart rows that share an id. Rows that repeat an id count as one document and decide alike; a null id is below all.

    Occurrences are range-partitioned by hash and document together, so a line in a third of all documents is spread over many
    tasks; only the hashes at partition edges, two per partition at most, are settled by a second count.
    """
    small_batches(docs.sparkSession)
    found = cut(_occurrences(docs, id_col, text_col, least_chars))
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc()]
    ranged = found.repartitionByRange(*order).sortWithinPartitions(*order, "tag", "pos")
    streamed = cut(_streamed(ranged, least_docs))
    closed, edge = streamed.filter(~F.col("open")), streamed.filter("open")
    # as many keys as twice the partitions at most
    counts = edge.select("h1", "h2", "doc").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc").alias("stays"))
    late = edge.join(F.broadcast(counts.filter(F.col("n") >= least_docs)), ["h1", "h2"]).filter("doc <> stays")
    lost = closed.select("doc", "tag", "pos").unionByName(late.select("doc", "tag", "pos"))
    lost = lost.groupBy("doc", "tag").agg(F.array_sort(F.collect_set("pos")).alias("lost"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps, n = [], []
            for pos in batch.column("lost").to_pylist():
                bits = np.ones((pos[-1] // 8 + 1) * 8, np.uint8)
                bits[pos] = 0
                maps.append(zlib.compress(np.packbits(bits).tobytes()))
                n.append(len(pos))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("tag"), pa.array(n, pa.int64()), pa.array(maps, pa.binary())], names=["doc", "tag", "n_dropped", "keep"]
            )

    packed = lost.mapInArrow(pack, "doc long, tag long, n_dropped long, keep binary")
    return packed.select(F.when(F.col("doc") != _BOTTOM, F.col("doc")).alias("doc_id"), "tag", "n_dropped", "keep")


def kept_lines(text: str | None, keep: bytes | None) -> tuple[int, int, str]:
    """Lines, dropped lines, and the text that stays."""
    lines = (text or "").split("\n")
    if keep is None:
        return len(lines), 0, text or ""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[: len(lines)].tolist()
    bits += [1] * (len(lines) - len(bits))
    left = [line for line, bit in zip(lines, bits) if bit]
    return len(lines), len(lines) - len(left), "\n".join(left)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that stays (or its SHA-256), a row per row of `docs`.

    A row without a bitmap keeps all of its lines. A null text is one empty line. Rows that repeat an id and a text share their bitmap; an
    empty table gives no rows; other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"), F.xxhash64(F.col(text_col)).alias("_tag"))
    maps = bitmaps.select(F.col("doc_id").alias("_doc"), F.col("tag").alias("_of"), "keep")
    joined = rows.join(maps, same(F.col(id_col).cast("long"), F.col("_doc")) & (F.col("_tag") == F.col("_of")), "left")
    out = "kept_sha256" if digests else "kept_text"
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [kept_lines(t, k) for t, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            texts = [hashlib.sha256(t.encode()).hexdigest() if digests else t for _, _, t in got]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _, _ in got], pa.int64()), pa.array([d for _, d, _ in got], pa.int64()), pa.array(texts, pa.string())],
                names=["doc_id", "n_lines", "n_dropped", out],
            )

    return joined.select(id_col, "_text", "keep").mapInArrow(run, schema)


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document after its repeated lines went."""
    docs = table(spark, sf_dir, "documents")
    return apply_bitmaps(docs, line_bitmaps(docs), digests=True)


OP7_SQL = """
WITH l AS (
  SELECT d.doc_id, u.pos, u.line, translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM documents d, LATERAL (SELECT unnest(string_split(coalesce(d.text, ''), chr(10))) AS line,
                                    generate_subscripts(string_split(coalesce(d.text, ''), chr(10)), 1) AS pos) u),
f AS (SELECT key, max(doc_id) AS stays FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.*, f.key IS NOT NULL AND l.doc_id <> f.stays AS gone FROM l LEFT JOIN f USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
