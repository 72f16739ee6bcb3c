"""Byte-level BPE: vectorised pre-tokenisation by a scan of transition functions, cached merges, exact decoding."""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import small_batches, table

# Classes of code points. The letters that a contraction can hold have classes of their own.
RESET, SPACE, BLANK, LETTER, DIGIT, OTHER, QUOTE, STMD, RV, L_, E_ = range(11)
#: Unicode's White_Space code points.
WHITE_SPACE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

#: Letters and numbers that Unicode 16 adds to the tables of Python 3.13, first and last code point.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]

# States after a code point: in blanks, after a space, in letters, digits or others, after an apostrophe that
# starts a slice, after a whole contraction, after 'r or 'v, after 'l.
IN_BLANK, IN_SPACE, IN_LETTERS, IN_DIGITS, IN_OTHERS, AT_QUOTE, CONTRACTED, AT_RV, AT_L = range(9)
_STATES = 9


def _next(state: int, kind: int) -> int:
    if kind in (RESET, BLANK):
        return IN_BLANK
    if kind == SPACE:
        return IN_SPACE
    if kind == DIGIT:
        return IN_DIGITS
    if kind == OTHER:
        return IN_OTHERS
    if kind == QUOTE:
        return IN_OTHERS if state in (IN_SPACE, IN_OTHERS, AT_QUOTE) else AT_QUOTE
    if state == AT_QUOTE:
        return {STMD: CONTRACTED, RV: AT_RV, L_: AT_L}.get(kind, IN_LETTERS)
    if (state, kind) in ((AT_RV, E_), (AT_L, L_)):
        return CONTRACTED
    return IN_LETTERS


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class of each code point; number of each class's function; products of functions; functions' values by state."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        c = unicodedata.category(chr(cp))
        if c[0] == "L":
            kinds[cp] = LETTER
        elif c[0] == "N":
            kinds[cp] = DIGIT
    for ranges, kind in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, DIGIT)):
        for a, b in ranges:
            kinds[a : b + 1] = kind
    kinds[WHITE_SPACE] = BLANK
    kinds[0x20] = SPACE
    kinds[ord("'")] = QUOTE
    for letters, kind in (("stmd", STMD), ("rv", RV), ("l", L_), ("e", E_)):
        for x in letters:
            kinds[ord(x)] = kind
    first = [tuple(_next(s, k) for s in range(_STATES)) for k in range(11)]
    seen = {f: i for i, f in enumerate(dict.fromkeys(first))}
    todo = list(seen)
    for f in todo:  # every product of the classes' functions
        for g in dict.fromkeys(first):
            h = tuple(g[s] for s in f)
            if h not in seen:
                seen[h] = len(seen)
                todo.append(h)
    every = list(seen)
    products = np.array([[seen[tuple(g[s] for s in f)] for g in every] for f in every], np.uint16)
    return kinds, np.array([seen[f] for f in first], np.uint16), products, np.array(every, np.uint8)


def states(kinds: np.ndarray) -> np.ndarray:
    """The state after each position, by an associative scan over transition functions.

    Blocks compose their functions side by side, block products are scanned the same way, and each block is then
    entered with its state.
    """
    _, of_class, products, values = _tables()
    return _scan(of_class[kinds], products, values)


def _scan(functions: np.ndarray, products: np.ndarray, values: np.ndarray, width: int = 64) -> np.ndarray:
    n = len(functions)
    if n <= width:
        out, f = np.empty(n, np.uint8), None
        for i, g in enumerate(functions.tolist()):
            f = g if f is None else int(products[f, g])
            out[i] = values[f, IN_BLANK]
        return out
    blocks = -(-n // width)
    padded = np.empty(blocks * width, functions.dtype)
    padded[:n], padded[n:] = functions, functions[-1]
    grid = np.ascontiguousarray(padded.reshape(blocks, width).T)
    flat, m = products.ravel(), products.shape[1]
    for j in range(1, width):
        grid[j] = flat[grid[j - 1].astype(np.intp) * m + grid[j]]
    entry = np.empty(blocks, np.uint8)
    entry[0] = IN_BLANK
    entry[1:] = _scan(grid[-1], products, values, width)[:-1]
    return values[grid, entry[None, :]].T.ravel()[:n]


def slice_starts(texts: list[str]) -> tuple[str, np.ndarray]:
    """The texts joined by a separator each, and the starts of all slices and separators in it, in order."""
    joined = "\0".join(texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kinds = _tables()[0][codes]
    ends = np.fromiter(accumulate(len(t) + 1 for t in texts), np.int64, len(texts)) - 1
    kinds[ends] = RESET
    after = states(kinds)
    before = np.concatenate(([IN_BLANK], after[:-1])).astype(np.uint8)
    before_kind = np.concatenate(([RESET], kinds[:-1]))
    blank = (kinds == SPACE) | (kinds == BLANK)
    next_kind = np.append(kinds[1:], RESET)
    solid_next = (next_kind != SPACE) & (next_kind != BLANK) & (next_kind != RESET)
    blank_before = (before_kind == SPACE) | (before_kind == BLANK)
    joins = np.zeros(len(kinds), bool)
    joins |= blank & blank_before & ~solid_next
    letter = (kinds == LETTER) | (kinds >= STMD)
    going = letter & ((before == IN_LETTERS) | (before == AT_RV) | (before == AT_L))
    whole_next = np.append(after[1:], IN_BLANK) == CONTRACTED
    started = letter & (before == AT_QUOTE) & ((after == CONTRACTED) | (((after == AT_RV) | (after == AT_L)) & whole_next))
    other = (kinds == OTHER) | (kinds == QUOTE)
    joins |= going | started
    joins |= (kinds == DIGIT) & (before == IN_DIGITS)
    joins |= other & ((before == IN_OTHERS) | (before == AT_QUOTE))
    joins |= ~blank & (kinds != RESET) & (before_kind == SPACE)
    joins[ends] = False
    return joined, np.flatnonzero(~joins)


class Merges:
    """Ranked merges with a cache of slices."""

    def __init__(self, path: str, most: int = 200_000) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.most, self.cache = most, {}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.decimal: dict[int, bytes] = {}

    def slice_ids(self, pieces: list[str]) -> list[tuple[int, ...]]:
        found = list(map(self.cache.get, pieces))
        if None in found:
            if len(self.cache) >= self.most:
                self.cache.clear()
            for i, ids in enumerate(found):
                if ids is None:
                    piece = pieces[i]
                    found[i] = self.cache.get(piece) or self.merge(piece.encode())
                    if len(piece) <= 64:
                        self.cache[piece] = found[i]
        return found

    def merge(self, raw: bytes) -> tuple[int, ...]:
        """Merge the pair of lowest rank, leftmost first, until none is left; a heap keeps long slices near-linear."""
        ranks = self.ranks
        whole = ranks.get(raw)
        if whole is not None:
            return (whole,)
        n = len(raw)
        if n <= 200:
            return self._merge_short(raw)
        end, prev = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at each byte
        get = ranks.get
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n:
                continue
            j = end[i]
            if end[j] != stop:
                continue
            alive[j] = 0
            end[i] = stop
            if stop < n:
                prev[stop] = i
                if (r := get(raw[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := prev[i]) >= 0 and (r := get(raw[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return tuple(out)

    def _merge_short(self, raw: bytes) -> tuple[int, ...]:
        get, none = self.ranks.get, 1 << 60
        parts = [raw[i : i + 1] for i in range(len(raw))]
        pairs = [get(raw[i : i + 2], none) for i in range(len(raw) - 1)]
        while pairs and (least := min(pairs)) != none:
            i = pairs.index(least)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        return tuple(map(self.ranks.__getitem__, parts))

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int], list[int]]]:
        """For each text its ids, the start (code point) of each slice, and the number of ids of each slice."""
        joined, starts = slice_starts(texts)
        bounds = starts.tolist()
        pieces = list(map(joined.__getitem__, map(slice, bounds, [*bounds[1:], len(joined)])))
        ends = list(accumulate(len(t) + 1 for t in texts))
        cuts = np.searchsorted(starts, ends).tolist()
        at, base = 0, 0
        for stop, end in zip(cuts, ends):  # the last slice of each text is the separator
            parts = self.slice_ids(pieces[at : stop - 1])
            yield list(chain.from_iterable(parts)), [x - base for x in bounds[at : stop - 1]], list(map(len, parts))
            at, base = stop, end

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _chunks(texts: list[str | None], most: int = 250_000) -> Iterator[list[str]]:
    part, n = [], 0
    for t in texts:
        part.append(t or "")
        n += len(part[-1])
        if n >= most:
            yield part
            part, n = [], 0
    if part:
        yield part


def encode_documents(docs: DataFrame, text_col: str = "text", ranks: str | None = None, digests: bool = False) -> DataFrame:
    """Every row of `docs` with its token ids, and what decoding needs.

    Slices follow the fixed pattern of the rank file: contractions, letters, digits, others with an optional space before,
    and blanks. Each slice is merged by rank on its own, without special tokens. Added columns: n_tokens, ids,
    slice_starts (code points) and slice_tokens (ids in each slice). With `digests` these are left out for ids_sha256,
    decoded_sha256 and n_tokens. Columns of the input that bear these names are replaced.

    Null text is empty and has no ids. Slices of any length are merged whole. An empty table gives no rows; repeated rows are
    encoded each.
    """
    small_batches(docs.sparkSession)
    path = ranks or default_ranks()
    added = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "slice_starts", "slice_tokens"]
    inside = docs.drop(*[c for c in added if c != text_col])
    kinds = [T.LongType(), T.StringType(), T.StringType()] if digests else [T.LongType(), *[T.ArrayType(T.IntegerType())] * 3]
    schema = T.StructType([*inside.schema.fields, *[T.StructField(n, k) for n, k in zip(added, kinds)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merges(path)
        if digests and not model.decimal:
            model.decimal = {r: b"%d" % r for r in model.tokens}
        for batch in batches:
            columns: list[list] = [[] for _ in added]
            for texts in _chunks(batch.column(text_col).to_pylist()):
                for ids, starts, counts in model.encode(texts):
                    columns[0].append(len(ids))
                    if digests:
                        columns[1].append(hashlib.sha256(b",".join(map(model.decimal.__getitem__, ids))).hexdigest())
                        columns[2].append(hashlib.sha256(model.decode(ids)).hexdigest())
                    else:
                        for into, x in zip(columns[1:], (ids, starts, counts)):
                            into.append(np.array(x, np.int32))
            kinds = [pa.int64(), *([pa.string()] * 2 if digests else [pa.list_(pa.int32())] * 3)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=[*batch.schema.names, *added]
            )

    return inside.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, ids_col: str = "ids", out: str = "decoded", ranks: str | None = None) -> DataFrame:
    """Every row with the text of its ids in column `out`, which replaces one of that name.

    Null ids decode to an empty text. Ids that end inside a character, as those of a cut text may, decode to U+FFFD there; an id
    that is no token's is an error. An empty table gives no rows.
    """
    small_batches(encoded.sparkSession)
    path = ranks or default_ranks()
    encoded = encoded.drop(out) if out != ids_col else encoded
    schema = T.StructType([*encoded.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merges(path)
        for batch in batches:
            texts = [model.decode(ids or []).decode(errors="replace") for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return encoded.mapInArrow(run, schema)


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document's ids and decoded bytes, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, digests=True).drop("text")
