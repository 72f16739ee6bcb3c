"""Phrase collocation mining over vertical positional inverted lists."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..cluster import remove, shared_folder
from ._common import checked_broadcast, cut, same, small_batches, table

#: Words of a block, whose lists one task holds at once.
BLOCK_WORDS = 1 << 20
#: Bytes of a text that are split into words at once; a slice ends at the next separator.
_SLICE = 1 << 20
#: Words before a block's own that it knows, so that a phrase may begin in the block before.
_BEFORE = 3
#: Blocks' worth of words whose phrases one task counts at once.
_PART_BLOCKS = 4
#: Phrases (two longs and a count each) that are broadcast at most, and four times the words; with more, the join shuffles.
BROADCAST_PHRASES = 1_000_000
#: Phrases (some 100 bytes of counts and ids each) that are broadcast at most to those one word longer; with more, they are shuffled.
BROADCAST_PARTS = 400_000

_SPLIT = bytes.maketrans(b"\t.,;:!?\n\x0b\x0c\r", b" " + b"\n" * 10)
_EDGE = re.compile(rb"[ \n]")
_SPACE, _BREAK = -2, -1


class _Codes(dict):
    """Numbers for the words of one language; a new word gets the next number of the block."""

    def __init__(self, lang: str, names: list[tuple[str, bytes]]) -> None:
        super().__init__({b"": _SPACE, b"\n": _BREAK})
        self.lang, self.names = lang, names

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self.names)
        self.names.append((self.lang, word))
        return code


class _Block:
    """Words of whole documents or of parts of them, in order; breaks between pieces take a position, so that they part neighbours."""

    def __init__(self, number: int, lang: str = "", before: list[bytes] = ()) -> None:
        self.number, self.names, self.codes, self.langs = number, [], [], {}
        known = self.of(lang)
        self.codes.append(np.array([_BREAK] * (_BEFORE - len(before)) + [known[w] for w in before], np.int32))
        self.size = _BEFORE

    def of(self, lang: str) -> _Codes:
        if lang not in self.langs:
            self.langs[lang] = _Codes(lang, self.names)
        return self.langs[lang]

    def add(self, codes: np.ndarray) -> None:
        self.codes.append(codes)
        self.size += len(codes)

    def lists(self) -> Iterator[pa.RecordBatch]:
        codes = np.concatenate(self.codes)
        at = np.flatnonzero(codes >= 0).astype(np.int32)
        order = np.argsort(codes[at], kind="stable")
        at, codes = at[order], codes[at][order]
        starts = np.flatnonzero(np.diff(codes, prepend=-1)).astype(np.int32)
        names = [self.names[c] for c in codes[starts].tolist()]
        first = [pa.array([x[0] for x in names], pa.string()), pa.array([x[1] for x in names], pa.binary()).cast(pa.string())]
        yield from _packed(self.number, first, ["lang", "word"], starts, at)


def _packed(block: int, keys: list[pa.Array], names: list[str], starts: np.ndarray, at: np.ndarray, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Lists as rows of block, keys, n (own positions in the list) and at: the first position, then the steps to the next ones.

    Steps are small, so rows compress to about half of what positions take."""
    if not len(starts):
        return
    n = np.add.reduceat((at >= _BEFORE).astype(np.int32), starts)
    steps = np.diff(at, prepend=0).astype(np.int32)
    steps[starts] = at[starts]
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(at)), pa.int32()), pa.array(steps, pa.int32()))
    whole = pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(starts), block, np.int64)), *keys, pa.array(n, pa.int32()), lists], names=["block", *names, "n", "at"])
    for i in range(0, len(starts), rows):
        yield whole.slice(i, rows)


def _slices(text: bytes) -> Iterator[bytes]:
    """The text lower-cased and separated by spaces and newlines alone, in slices that end before a separator."""
    text, at = text.lower().translate(_SPLIT), 0  # of bytes, lower() changes A-Z alone
    while at < len(text):
        edge = _EDGE.search(text, at + _SLICE)
        end = edge.start() if edge else len(text)
        yield text[at:end]
        at = end


def word_lists(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", block_words: int = BLOCK_WORDS) -> DataFrame:
    """block, lang, word, n, at: the positions (as steps) of every word in each block of consecutive words.

    Texts are split at `[.,;:!?\\x0A-\\x0D]` into pieces and those at spaces and tabs into words. A text longer than a block goes on
    in the next, which also lists the last three words of the piece at positions below 3; they do not count in n. A null language
    is `und`, a null text empty.
    """
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("_lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        block, stop = _Block(first), np.array([_BREAK], np.int32)
        for batch in batches:
            for text, lang in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
                for part in _slices(text):
                    words = part.replace(b"\n", b" \n ").split(b" ")
                    codes = np.fromiter(map(block.of(lang).__getitem__, words), np.int32, len(words))
                    block.add(codes[codes != _SPACE])
                    if block.size >= block_words:
                        tail = np.concatenate(block.codes)[-_BEFORE:]
                        broken = np.flatnonzero(tail < 0)
                        before = [block.names[c][1] for c in tail[broken[-1] + 1 if len(broken) else 0 :]]
                        yield from block.lists()
                        block = _Block(block.number + 1, lang, before)
                block.add(stop)
        yield from block.lists()

    return rows.mapInArrow(run, "block long, lang string, word string, n int, at array<int>")


def _squeezed(x: np.ndarray, kind: str) -> bytes:
    """Compressed bytes of the numbers, all first bytes, then all second ones, ..., as the high ones are mostly zero."""
    width = np.dtype(kind).itemsize
    return pa.compress(np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(-1, width).T).tobytes(), codec="zstd", asbytes=True)


def _loosened(data: bytes, n: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(data, decompressed_size=n * width, codec="zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, n).T).view(kind).ravel()


def _bundled(lists: DataFrame, rows: int = 100_000) -> DataFrame:
    """Lists (block, id, at) as bundles of a block's lists in order of id (as steps): block, n, m, ids, sizes, steps.

    `rows` are held at once at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def flushed() -> pa.RecordBatch:
            table_ = pa.Table.from_batches(held)
            block, ids = table_.column("block").to_numpy(), table_.column("id").to_numpy()
            lists_ = table_.column("at").combine_chunks()
            order = np.lexsort((ids, block))
            block, ids, lists_ = block[order], ids[order], lists_.take(pa.array(order))
            sizes, steps = lists_.value_lengths().to_numpy(), lists_.flatten().to_numpy()
            starts = np.flatnonzero(np.diff(block, prepend=-1))
            ends = np.append(starts[1:], len(block))
            at = np.concatenate(([0], np.cumsum(sizes)))
            out = [[], [], [], [], [], []]
            for x, y in zip(starts.tolist(), ends.tolist()):
                values = (int(block[x]), y - x, int(at[y] - at[x]), _squeezed(np.diff(ids[x:y], prepend=0), "<i8"), _squeezed(sizes[x:y], "<i4"), _squeezed(steps[at[x] : at[y]], "<i4"))
                for c, v in zip(out, values):
                    c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["block", "n", "m", "ids", "sizes", "steps"])

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= rows:
                yield flushed()
                held, count = [], 0
        if count:
            yield flushed()

    return lists.select("block", "id", "at").mapInArrow(run, "block long, n int, m int, ids binary, sizes binary, steps binary")


def _kept(rows: list[dict], parts: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, sizes and steps of a block's bundles; where ids were given after counting, of the frequent lists alone."""
    told = {r["part"]: r for r in rows if r["steps"] is None}
    for r in rows:
        if r["steps"] is not None and (r["ids"] is not None or r["part"] in told):
            sizes, steps = _loosened(r["sizes"], r["n"], "<i4"), _loosened(r["steps"], r["m"], "<i4")
            if r["ids"] is not None:
                yield np.cumsum(_loosened(r["ids"], r["n"], "<i8")), sizes, steps
            else:
                t = told[r["part"]]
                kept = np.unpackbits(np.frombuffer(t["kept"], np.uint8), count=r["n"]).astype(bool)
                yield _loosened(t["ids"], t["n"], "<i8") * parts + r["part"], sizes[kept], steps[np.repeat(kept, sizes)]


def extend(bundles: DataFrame, parts: int, last: bool = False) -> DataFrame:
    """Phrases one word longer than those of `bundles`, by a merge join within each block: block, part, n, m, a, b, own, sizes, steps.

    A position is that of a phrase's last word. Where a list of phrase a has a position and a list of phrase b, of the same length,
    has the next one, the two overlap in all but one word and make a phrase of a's words and b's last. A block's lists, which
    BLOCK_WORDS bounds, are merged in order of position; neighbours that are adjacent join. Phrases are dealt to parts by a + b, so
    that b is known from its quotient; `own` has the number of own positions of each list. The `last` ones go without lists.
    """

    def run(group: pa.Table) -> pa.Table:
        found = list(_kept(group.to_pylist(), parts))
        ids, sizes, steps = (np.concatenate([x[i] for x in found] or [np.zeros(0, np.int64)]) for i in range(3))
        names, order = np.unique(ids, return_inverse=True)
        row, at, first = np.repeat(order, sizes), np.cumsum(steps, dtype=np.int64), np.cumsum(sizes) - sizes
        at -= np.repeat(at[first] - steps[first], sizes)
        order = np.argsort(at, kind="stable")
        at, row = at[order], row[order]
        near = np.flatnonzero(at[1:] == at[:-1] + 1)
        left, right, at = row[near], row[near + 1], at[near + 1]
        key = ((names[left] + names[right]) % parts * len(names) + left) * len(names) + right
        order = np.argsort(key, kind="stable")
        key, left, right, at = key[order], left[order], right[order], at[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        a, b = names[left[starts]], names[right[starts]]
        part, ends = (a + b) % parts, np.append(starts[1:], len(at))
        own, sizes = np.add.reduceat(at >= _BEFORE, starts, dtype=np.int64) if len(starts) else starts, ends - starts
        steps = np.diff(at, prepend=0)
        steps[starts] = at[starts]
        cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
        out = []
        for x, y in zip(cuts, [*cuts[1:], len(part)]):
            u, v = int(starts[x]), int(ends[y - 1])
            lists = (None, None) if last else (_squeezed(sizes[x:y], "<i4"), _squeezed(steps[u:v], "<i4"))
            out.append((group.column("block")[0].as_py(), int(part[x]), y - x, v - u, _squeezed(np.diff(a[x:y], prepend=0), "<i8"), _squeezed(b[x:y] // parts, "<i8"), _squeezed(own[x:y], "<i4"), *lists))
        kinds = dict(block=pa.int64(), part=pa.int64(), n=pa.int32(), m=pa.int32()) | dict.fromkeys(("a", "b", "own", "sizes", "steps"), pa.binary())
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds.values())], list(kinds))

    return bundles.groupBy("block").applyInArrow(run, "block long, part long, n int, m int, a binary, b binary, own binary, sizes binary, steps binary")


def _counted(bundles: DataFrame, parts: int, least: int, last: bool) -> DataFrame:
    """Rows of two kinds: a part's frequent phrases (id, a, b, f; block is null), and which of a bundle's lists are theirs (n, kept, ids).

    Lists stay behind: of a phrase, however frequent, a part gets one number a block. The most frequent phrases have the smallest ids.
    """

    def run(group: pa.Table) -> pa.Table:
        rows, part = group.to_pylist(), group.column("part")[0].as_py()
        a = np.concatenate([np.cumsum(_loosened(r["a"], r["n"], "<i8")) for r in rows])
        b = np.concatenate([_loosened(r["b"], r["n"], "<i8") for r in rows]) * parts + (part - a) % parts
        own = np.concatenate([_loosened(r["own"], r["n"], "<i4") for r in rows])
        order = np.argsort(a << 32 | b, kind="stable") if max(a.max(), b.max()) < 1 << 31 else np.lexsort((b, a))
        a, b = a[order], b[order]
        starts = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        f = np.add.reduceat(own[order], starts, dtype=np.int64)
        best = np.argsort(-f, kind="stable")[: np.count_nonzero(f >= least)]
        rank = np.full(len(f), -1)
        rank[best] = np.arange(len(best))
        of = np.empty(len(a), np.int64)
        of[order] = np.repeat(rank, np.diff(starts, append=len(a)))
        out, at = [], 0
        for r in [] if last else rows:
            ids, at = of[at : at + r["n"]], at + r["n"]
            kept = ids >= 0
            if kept.any():
                out.append((r["block"], part, int(kept.sum()), np.packbits(kept).tobytes(), _squeezed(ids[kept], "<i8"), None, None, None, None))
        if len(best):
            out.append((None, part, len(best), None, None, np.arange(len(best)) * parts + part, a[starts[best]], b[starts[best]], f[best]))
        kinds = dict(block=pa.int64(), part=pa.int64(), n=pa.int32(), kept=pa.binary(), ids=pa.binary()) | dict.fromkeys(("id", "a", "b", "f"), pa.list_(pa.int64()))
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds.values())], list(kinds))

    return bundles.select("block", "part", "n", "a", "b", "own").groupBy("part").applyInArrow(
        run, "block long, part long, n int, kept binary, ids binary, id array<long>, a array<long>, b array<long>, f array<long>")


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def frequent_phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, longest: int = 4, block_words: int = BLOCK_WORDS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All phrases of 2 to `longest` (4 at most) words that occur `least` times, their words, and the number of words of each language.

    Phrases have id (its own among those of a size), lang, size, w (ids of words), f, a and b (ids of the phrases without the last and the
    first word), heads and tails (occurrences of the first and last 1, 2, ... words); words have id and word. A list's length is its
    phrase's number of occurrences in the block, so sums of lengths are exact. Phrases of a level are counted by part, from bundles of
    keys and lengths; a block's bundles of lists then meet what the parts tell of them, and those of frequent phrases are extended.
    Both are tables in the shared folder, each deleted when the next is written.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    top = os.path.join(shared_folder(spark), f"collocations-{uuid.uuid4().hex}")
    lists = _written(word_lists(docs, text_col, lang_col, block_words), f"{top}/1")
    totals = cut(lists.groupBy("lang").agg(F.sum("n").alias("n")))
    parts = -(-(totals.agg(F.sum("n")).first()[0] or 1) // (_PART_BLOCKS * block_words))
    counted = lists.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    counted = cut(counted.sortWithinPartitions(F.desc("f")).withColumn("id", F.monotonically_increasing_id()))
    # small ids for frequent words: the place in the partition counts first, then the partition
    n, last = counted.agg(F.count("*"), F.max(F.shiftright("id", 33))).first()
    words = counted.withColumn("id", F.col("id").bitwiseAND((1 << 33) - 1) * ((last or 0) + 1) + F.shiftright("id", 33))
    known = words.select("id", "lang", F.array("id").alias("w"), F.array("f").alias("heads"), F.array("f").alias("tails"))
    most = BROADCAST_PHRASES // 4
    met = lists.join(checked_broadcast(words.select("id", "lang", "word"), n, most), ["lang", "word"])
    # past the bound the join deals by word; a block's lists are brought together before they are bundled
    bundles, every = _bundled(met if n <= most else met.sortWithinPartitions("block")), None
    nothing = F.lit(None)
    bundles = bundles.select("block", nothing.cast("long").alias("part"), "n", "m", "ids", "sizes", "steps", nothing.cast("binary").alias("kept"))
    for size in range(2, longest + 1):
        lists = extend(bundles, parts, size == longest)
        if size < longest:
            lists = _written(lists, f"{top}/{size}")
            for used in (f"{size - 1}", f"told{size - 1}"):
                remove(spark, f"{top}/{used}")
        told = _written(_counted(lists, parts, least, size == longest), f"{top}/told{size}")
        counted = told.filter("block is null").select(F.inline(F.arrays_zip("id", "a", "b", "f")))
        left = known.select(F.col("id").alias("a"), "lang", F.col("w").alias("_head"), "heads")
        right = known.select(F.col("id").alias("b"), F.element_at("w", -1).alias("_last"), "tails")
        left, right = (checked_broadcast(x, n, BROADCAST_PARTS) for x in (left, right))
        known = cut(counted.join(left, "a").join(right, "b").select(
            "id", "lang", F.lit(size).alias("size"), F.concat("_head", F.array("_last")).alias("w"), "f", "a", "b",
            F.concat("heads", F.array("f")).alias("heads"), F.concat("tails", F.array("f")).alias("tails")))
        n = known.count()
        every = known if every is None else every.unionByName(known)
        bundles = lists.select("block", "part", "n", "m", nothing.cast("binary").alias("ids"), "sizes", "steps", nothing.cast("binary").alias("kept")).unionByName(
            told.filter("block is not null").select("block", "part", "n", nothing.cast("int").alias("m"), "ids", nothing.cast("binary").alias("sizes"), nothing.cast("binary").alias("steps"), "kept"))
    remove(spark, top)
    return every, words.select("id", "word"), totals


def _score(a: Column, l: Column, r: Column) -> Column:
    """floor(2000000 a / (l + r)) in decimals of 27 digits, an exact division without a fraction."""
    return F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * a.cast("decimal(20,0)"), l.cast("decimal(20,0)") + r.cast("decimal(20,0)"))


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, longest: int = 4, keep: int = 2000, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `keep` best phrases of 2 to `longest` words.

    A phrase's score is that of its worst cut in two, 2,000,000 times its occurrences over the sum of both parts' (ties: the shorter
    first part). A phrase that a phrase one word longer accompanies in 80 of 100 occurrences is left out; longer ones need no look, as
    what is in them is in one of those too. Ties of score go by occurrences, then by the phrase's bytes. Null texts count as empty,
    null languages as `und`; an empty table gives no rows; repeated rows count each; other columns are ignored.
    """
    every, words, totals = frequent_phrases(docs, text_col, lang_col, least, longest, block_words)
    longer = every.filter("size > 2").select((F.col("size") - 1).alias("size"), "f", F.explode(F.array_distinct(F.array("a", "b"))).alias("id"))

    def one(k: Column) -> Column:
        l, r = F.element_at("heads", k), F.element_at("tails", F.col("size") - k)
        return F.struct(_score(F.col("f"), l, r).cast("long").alias("score"), k.alias("k"), l.alias("l"), r.alias("r"))

    worst = F.array_min(F.transform(F.sequence(F.lit(1), F.col("size") - 1), one))
    rows = every.select("size", "id", "lang", "w", F.col("f").alias("a"), worst.alias("_cut"))
    rows = rows.select("size", "id", "lang", "w", "a", F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"), F.col("_cut.score").alias("score"))
    longer = cut(longer.groupBy("size", "id").agg(F.max("f").alias("_longer")))
    rows = rows.join(checked_broadcast(longer, longer.count(), BROADCAST_PHRASES), ["size", "id"], "left")
    rows = rows.filter(F.coalesce(F.col("_longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * 80, F.lit(True))).drop("_longer")
    # the best of each of 64 shares first, ties kept: a language's sort sees 64 * keep rows and what ties with the last
    order = [F.col("score").desc(), F.col("a").desc()]
    rows = rows.withColumn("_share", F.pmod(F.xxhash64("size", "id"), F.lit(64)))
    for by in (("lang", "_share"), ("lang",)):
        rows = rows.withColumn("_rank", F.rank().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_rank") <= keep)
    rows = cut(rows.drop("_share", "_rank"))
    named = rows.select("size", "id", F.posexplode("w").alias("_i", "_w")).join(words.select(F.col("id").alias("_w"), "word"), "_w")
    texts = named.groupBy("size", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = rows.join(texts, ["size", "id"]).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")).filter(F.col("rank") <= keep)
    return ranked.join(totals.withColumnRenamed("lang", "_of"), same(F.col("lang"), F.col("_of"))).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language of documents."""
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split(replace(piece, chr(9), ' '), ' '), lambda x: x <> '') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
grams AS (SELECT lang, array_to_string(w[i : i + size - 1], ' ') AS phrase, size FROM starts CROSS JOIN (VALUES (1), (2), (3), (4)) AS s(size) WHERE i + size - 1 <= len(w)),
counts AS MATERIALIZED (SELECT lang, phrase, size, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
parts AS MATERIALIZED (SELECT lang, phrase, size, f, string_split(phrase, ' ') AS w FROM counts WHERE size > 1),
cuts AS (SELECT lang, phrase, f, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 : size], ' ') AS tail
  FROM parts CROSS JOIN (VALUES (1), (2), (3)) AS c(k) WHERE k < size),
scored AS (SELECT c.lang, c.phrase, c.f, c.k, h.f AS l, t.f AS r, CAST(CAST(2000000 AS HUGEINT) * c.f // (h.f + t.f) AS BIGINT) AS score
  FROM cuts c JOIN counts h ON h.lang = c.lang AND h.phrase = c.head JOIN counts t ON t.lang = c.lang AND t.phrase = c.tail),
worst AS (SELECT lang, phrase, f, unnest(min(struct_pack(score := score, k := k, l := l, r := r))) FROM scored GROUP BY lang, phrase, f),
inner_ AS (SELECT p.lang, p.f, array_to_string(p.w[i : j], ' ') AS phrase FROM parts p CROSS JOIN (VALUES (1, 2), (2, 3), (3, 4), (1, 3), (2, 4)) AS s(i, j) WHERE j <= p.size AND j - i + 1 < p.size),
kept AS (SELECT * FROM worst WHERE NOT EXISTS (SELECT 1 FROM inner_ x WHERE x.lang = worst.lang AND x.phrase = worst.phrase AND 100 * CAST(x.f AS HUGEINT) >= 80 * CAST(worst.f AS HUGEINT))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, f AS a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
