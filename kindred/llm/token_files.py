"""Token ids as files of range-coded segments, in ascending document order."""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import shared_folder
from ._common import cut, running_total, small_batches, table
from .range_coder import read_segment, write_segment
from .word_bpe import Merges

#: Ids that a segment is filled to; the last document may exceed it.
SEGMENT_IDS = 4_000_000


#: A chunk that consists of such pieces alone is encoded piece by piece: the tokenizer lower-cases these letters one by one and
#: splits runs of letters, single digits and runs of signs apart. Apostrophes start contractions, so chunks with one are encoded whole.
_PIECE = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Runs of signs, which the tokenizer parts from what is around them, so spaces may.
_RUN = r"([!-&(-/:-@\[-`{-~]+)"
#: Bytes of texts that are split at once; a longer text is cut at spaces.
_AT_ONCE = 1 << 20
#: For token files: the more at once, the fewer words are looked up again.
_FILE_AT_ONCE = 4 << 20


class WordIds:
    """The tokenizers library behind a cache of chunks between spaces.

    The tokenizer drops white space and never looks across it, so chunks can be encoded apart, each different one of a batch once. Arrow
    lower-cases A-Z, parts signs and finds the different chunks. Pieces of known form are merged many at once as the library merges
    them (see Merges); all other text goes to the library, which is used as it loads: the strings of special tokens in a text get
    those tokens' ids.
    """

    def __init__(self, path: str, most: int = 600_000, at_once: int = _AT_ONCE) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.merges = Merges.of_file(path)
        self.special = tuple(t.content for t in self.model.get_added_tokens_decoder().values())
        self.most, self.at_once, self.cache = most, at_once, {"": b""}

    def encode(self, texts: list[str | None] | pa.Array, end_id: int) -> list[np.ndarray]:
        """The ids of each text with `end_id` after them; null counts as empty."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        column = column.fill_null("")
        sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
        out, low, end = [], 0, np.array([end_id], np.int32)
        while low < len(column):
            high = low + max(1, int(np.searchsorted(np.cumsum(sizes[low:]), self.at_once, "right")))
            part = column.slice(low, high - low)
            if high == low + 1 and sizes[low] > self.at_once:
                out.append(np.concatenate([*(self._encoded(pa.array([x], pa.string()))[0] for x in _cut(part[0].as_py(), self.at_once)), end]))
            else:
                out += [np.concatenate((ids, end)) for ids in self._encoded(part)]
            low = high
        return out

    def _encoded(self, column: pa.Array) -> list[np.ndarray]:
        if not any(pc.any(pc.match_substring(column, x)).as_py() for x in self.special):
            column = pc.replace_substring_regex(pc.ascii_lower(column), _RUN, r" \1 ")
        lists = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        names, cache = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.cache
        found = list(map(cache.get, names))
        new = [w for w, x in zip(names, found) if x is None]
        if new:
            made = self.made(new)
            found = [made[w] if x is None else x for w, x in zip(names, found)]
            if len(cache) > self.most:
                cache.clear()
                cache[""] = b""
            cache.update((w, x) for w, x in made.items() if len(w) <= 64)
        ids = np.frombuffer(b"".join(found), np.int32)
        n = np.fromiter(map(len, found), np.int32, len(found)) // 4
        word = coded.indices.to_numpy()
        # 32 bits hold all places, as so many bytes have fewer ids
        counts, first = n[word], (np.cumsum(n, dtype=np.int32) - n)[word]
        stops = np.cumsum(counts, dtype=np.int32)
        every = ids[np.repeat(first - (stops - counts), counts) + np.arange(stops[-1] if len(stops) else 0, dtype=np.int32)]
        ends = np.concatenate(([0], stops))[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return [every[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def made(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks that are not in the cache."""
        out, plain, parts, whole = {}, [], {}, []
        for w in chunks:
            if w.isalpha() if w.isascii() else _LETTERS.fullmatch(w):
                plain.append(w)
                continue
            found = _PIECE.findall(w)
            if len("".join(found)) == len(w) and not any(x in w for x in self.special):
                parts[w] = [x.lower() for x in found]
            else:
                whole.append(w)
        pieces = [w.lower() for w in plain]
        rest = list({x for found in parts.values() for x in found})
        ids = [x for at in range(0, len(pieces) + len(rest), 8192) for x in self._merged((pieces + rest)[at : at + 8192])]
        out.update(zip(plain, ids))
        known = dict(zip(rest, ids[len(pieces) :]))
        for w, found in parts.items():
            out[w] = b"".join(map(known.__getitem__, found))
        out.update((w, array("i", e.ids).tobytes()) for w, e in zip(whole, self.model.encode_batch_fast(whole, add_special_tokens=False)))
        return out

    def _merged(self, pieces: list[str]) -> list[bytes]:
        if self.merges:
            return self.merges.encode(pieces)
        return [array("i", e.ids).tobytes() for e in self.model.encode_batch_fast(pieces, add_special_tokens=False)]


def _cut(text: str, at_once: int) -> Iterator[str]:
    """A long text in parts that end before a space or line break."""
    edge, at = re.compile("[ \n]"), 0
    while at < len(text):
        found = edge.search(text, at + at_once)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


@lru_cache(maxsize=2)
def word_ids(path: str, most: int = 600_000, at_once: int = _AT_ONCE) -> WordIds:
    return WordIds(path, most, at_once)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write_token_files(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1,
    segment_ids: int = SEGMENT_IDS,
) -> None:
    """Encode every text, append `end_id`, and write segments under `path` in ascending document order.

    Each row of the Parquet files is one segment: (part, seq, n_ids, content). Documents are whole within a segment, and
    segments are in document order by (part, seq). Rows that share an id follow each other by their texts' hash; a null id
    comes first; null text is empty and gives the end id alone. An empty table gives no segments. Ids are integers or texts of
    integers; any other text is an error. Other columns are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    model_path = tokenizer or default_tokenizer()
    order = [F.col("_id").asc_nulls_first(), F.col("_hash")]
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(F.col(text_col)).alias("_hash"))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("_id", "_text", F.spark_partition_id().alias("_part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_ids(model_path, at_once=_FILE_AT_ONCE)
        names, ids, n, seq, part = [], [], 0, 0, 0

        def segment() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([n], pa.int64()), pa.array([write_segment(names, ids)], pa.binary())],
                names=["part", "seq", "n_ids", "content"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(2)[0].as_py()
            for doc, got in zip(batch.column(0).to_pylist(), model.encode(batch.column(1), end_id)):
                names.append(doc)
                ids.append(got)
                n += len(got)
                if n >= segment_ids:
                    yield segment()
                    names, ids, n, seq = [], [], 0, seq + 1
        if names:
            yield segment()

    ranged.mapInArrow(run, "part int, seq int, n_ids long, content binary").write.parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and the ids or their CRC-32, from the files alone.

    A row for each row that was written, repeated ids and null ones too. Files of an empty table give no rows.
    """
    small_batches(spark)
    segments = spark.read.parquet(path)
    totals = running_total(segments.select("part", "seq", "n_ids"), [F.col("part"), F.col("seq")], F.col("n_ids"), "base")
    last = ("ids", pa.list_(pa.int32()), "ids array<int>") if with_ids else ("ids_crc32", pa.int64(), "ids_crc32 long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                names, ids = read_segment(batch.column(2)[i].as_py())
                counts = np.array([len(x) for x in ids], np.int64)
                before = np.cumsum(counts) - counts
                values = ids if with_ids else [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                where = [pa.array(np.full(len(names), batch.column(k)[i].as_py(), np.int32)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*where, pa.array(names, pa.int64()), pa.array(before), pa.array(counts), pa.array(values, last[1])],
                    names=["part", "seq", "doc_id", "before", "n_tokens", last[0]],
                )

    rows = segments.select("part", "seq", "content").mapInArrow(run, f"part int, seq int, doc_id long, before long, n_tokens long, {last[2]}")
    placed = rows.join(cut(totals.select("part", "seq", "base")), ["part", "seq"])
    return placed.select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", last[0])


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back."""
    path = os.path.join(shared_folder(spark), f"token-files-{uuid.uuid4().hex}")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path)
