"""Adaptive context-mixing range coder for token ids, many blocks side by side.

Every block starts from the same model and can be decoded on its own. An id is coded as one of three events: the
order-2 prediction holds, the order-1 prediction holds, or neither, and then as a literal under the order-0 model, which the
segment's counts give. The event's probabilities mix adaptive counts kept by the confidence of the order-2 prediction with those
kept by the confidence of the order-1 prediction. Blocks of one segment advance together, one id each at a time, as arrays.

Segment layout (little-endian): magic, number of documents, number of blocks, ids per block, number of ids, bytes and CRC-32 of the
order-0 model; doc ids (i8), has-id flags (u1), id counts (u4); the order-0 model (zlib: number of ids, the ids u2, their shares u4);
per block the size and CRC-32 of its bytes (u4, u4); then the blocks.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"KIDS0003"
_HEAD = struct.Struct("<8sIIIQII")
_SLOTS = 8  # bits of each of the two tables of predictions of a block
_IDS = 1 << 16  # ids are below
_SHARES = 1 << 18  # of the order-0 model, dealt to the ids that occur
_MOST = 2048  # ids of a block at most, so that sums of event counts, which grow by 4 an id, stay below 2^32 / _SHARES
_LEAST = float(1 << 32)  # a block's range never falls below this between two ids
_WORD = float(1 << 16)

#: Cumulative counts of the three events, of 16 bits each above 16 bits of 0, so that a shift by 16 times the event gives its lower end.
_EVENT = np.array([sum(2 << 16 * k for k in range(e + 1, 4)) for e in range(3)], np.int64)


def _start(counts: list[int]) -> list[int]:
    return [sum(sum(counts[i : i + k]) << 16 * k for k in (1, 2, 3)) for i in range(0, len(counts), 3)]


class _Order0:
    """Shares of the ids in a segment, at least one each, in order of id; below[i] is the sum of those before id i's."""

    def __init__(self, ids: np.ndarray, shares: np.ndarray) -> None:
        self.ids, self.shares = ids, shares
        self.share, self.below = np.zeros(_IDS), np.zeros(_IDS)
        self.share[ids], self.below[ids] = shares, np.cumsum(shares) - shares

    @classmethod
    def of(cls, flat: np.ndarray) -> _Order0:
        counts = np.bincount(flat, minlength=_IDS)
        ids = np.flatnonzero(counts)
        counts = counts[ids]
        shares = 1 + counts * (_SHARES - len(ids)) // max(1, counts.sum())
        shares[counts.argmax()] += _SHARES - shares.sum()
        return cls(ids, shares)

    def packed(self) -> bytes:
        return zlib.compress(struct.pack("<I", len(self.ids)) + self.ids.astype("<u2").tobytes() + self.shares.astype("<u4").tobytes())

    @classmethod
    def unpacked(cls, raw: bytes) -> _Order0:
        raw = zlib.decompress(raw)
        n = struct.unpack_from("<I", raw)[0]
        return cls(np.frombuffer(raw, "<u2", n, 4).astype(np.int64), np.frombuffer(raw, "<u4", n, 4 + 2 * n).astype(np.int64))


class _Model:
    """The adaptive state of `n` blocks. A prediction is kept as id * 4 + confidence; those of order 2 and order 1 are the two rows of arrays."""

    def __init__(self, n: int) -> None:
        order, lane = np.arange(2, dtype=np.int64)[:, None], np.arange(n, dtype=np.int64)
        # a block's tables lie side by side
        self.row, self.row4 = (lane << _SLOTS + 1) + (order << _SLOTS), (order * n + lane) << 2
        self.entries = np.full(2 * n << _SLOTS, -4, np.int32)
        # counts of the three events, for each block and confidence
        first = [_start([1, 1, 6, 3, 1, 2, 6, 1, 1, 12, 1, 1]), _start([1, 1, 6, 1, 3, 2, 1, 6, 1, 1, 12, 1])]
        self.counts = np.concatenate([np.tile(np.array(x, np.int64), n) for x in first])
        self.context, self.mixed = np.zeros((2, n), np.uint32), np.zeros(n, np.uint32)

    def look(self) -> None:
        self.at = self.row + (self.context >> np.uint32(32 - _SLOTS))
        self.entry = self.entries.take(self.at)
        self.p = self.entry >> 2
        self.count_at = self.row4 + (self.entry & 3)
        self.count = self.counts.take(self.count_at)
        self.ends = self.count[0] + self.count[1]
        self.total = (self.ends >> 48).astype(np.float64)

    def event_range(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the events' parts start, and their sizes."""
        ends = self.ends >> (e << 4)
        start = ends & 65535
        return start.astype(np.float64), ((ends >> 16 & 65535) - start).astype(np.float64)

    def learn(self, x: np.ndarray, e: np.ndarray) -> None:
        self.counts[self.count_at] = self.count + _EVENT.take(e)
        # a prediction that held gains confidence, up to three; another is replaced, or from two on loses some. Products with 0 and 1 choose
        entry, fresh = self.entry, x << 2
        new = fresh + (entry - 1 - fresh) * (entry >> 1 & 1)
        new += (np.minimum(entry + 1, entry | 3) - new) * (self.p == x)
        self.entries[self.at] = new
        first = x.astype(np.uint32) * np.uint32(0x9E3779B1)
        np.add(first * np.uint32(5), self.mixed, out=self.context[0])
        self.context[1] = first
        self.mixed = x.astype(np.uint32) * np.uint32(0x85EBCA77)


class _Coder:
    """Carryless range coding with 48-bit states and 16-bit words, one state per block.

    States are whole numbers below 2^49 held as doubles, whose products, differences and floors of quotients are exact there."""

    def __init__(self, n: int) -> None:
        self.low, self.range = np.zeros(n), np.full(n, float((1 << 48) - 1))

    def settle(self) -> None:
        """Move settled words out of blocks whose ranges are too small."""
        short = np.flatnonzero(self.range < _LEAST)
        while len(short):
            low, wide = self.low.take(short), self.range.take(short)
            word = np.floor(low / _LEAST)
            ahead = (word + 1) * _LEAST - low
            self.shift(short, word)
            # where the word would not settle, the part beyond its next multiple is given up
            wide = np.minimum(wide, ahead) * _WORD
            self.low[short], self.range[short] = (_LEAST - ahead) * _WORD, wide
            short = short[wide < _LEAST]

    def narrow(self, start: np.ndarray, size: np.ndarray, unit: np.ndarray) -> None:
        """Take part `start`, `size` of the ranges of all blocks, in units."""
        self.low += start * unit
        self.range = size * unit

    def narrow_some(self, on: np.ndarray, low: np.ndarray, start: np.ndarray, size: np.ndarray, unit: np.ndarray) -> None:
        self.low[on] = low + start * unit
        self.range[on] = size * unit


class _Writer(_Coder):
    def __init__(self, n: int, ids: int) -> None:
        super().__init__(n)
        self.width = 5 * ids + 8
        self.out, self.at = np.zeros(n * self.width, np.uint16), np.arange(n) * self.width

    def shift(self, on: np.ndarray, word: np.ndarray) -> None:
        at = self.at.take(on)
        self.out[at] = word
        self.at[on] = at + 1

    def blocks(self) -> list[bytes]:
        every = np.arange(len(self.low))
        for k in (32, 16, 0):
            self.shift(every, self.low.astype(np.int64) >> k & 65535)
        out = self.out.reshape(-1, self.width)
        return [out[i, :n].astype("<u2").tobytes() for i, n in enumerate((self.at - every * self.width).tolist())]


class _Reader(_Coder):
    def __init__(self, blocks: list[bytes]) -> None:
        super().__init__(len(blocks))
        # blocks one after another; only a damaged block, which fails its checksum, reads words beyond its own
        self.data = np.frombuffer(b"".join(blocks), "<u2")
        sizes = np.array([len(b) // 2 for b in blocks], np.int64)
        self.at = np.cumsum(sizes) - sizes
        self.code = np.zeros(len(blocks))
        for _ in range(3):
            self.code = self.code * _WORD + self.data[self.at]
            self.at += 1

    def shift(self, on: np.ndarray, word: np.ndarray) -> None:
        at = self.at.take(on)
        self.code[on] = (self.code.take(on) - word * _LEAST) * _WORD + self.data.take(at)
        self.at[on] = at + 1


def encode_blocks(ids: np.ndarray, order0: _Order0) -> list[bytes]:
    """Code each row of a matrix of ids as a block."""
    n, width = ids.shape
    model, coder = _Model(n), _Writer(n, width)
    for x in np.ascontiguousarray(ids.T.astype(np.int32)):
        model.look()
        new = model.p != x
        literal = new[0] & new[1]
        e = new[0].astype(np.int64) + literal
        coder.narrow(*model.event_range(e), np.floor(coder.range / model.total))
        on = np.flatnonzero(literal)
        new = x.take(on)
        unit = np.floor(coder.range.take(on) * (1 / _SHARES))
        coder.narrow_some(on, coder.low.take(on), order0.below.take(new), order0.share.take(new), unit)
        coder.settle()
        model.learn(x, e)
    return coder.blocks()


def decode_blocks(blocks: list[bytes], width: int, order0: _Order0) -> np.ndarray:
    """The inverse of encode_blocks."""
    n = len(blocks)
    model, coder = _Model(n), _Reader(blocks)
    out, of_share = np.empty((width, n), np.int32), np.repeat(order0.ids, order0.shares).astype(np.uint16)
    for t in range(width):
        model.look()
        unit = np.floor(coder.range / model.total)
        value = np.floor((coder.code - coder.low) / unit)
        # a range's rest beyond its units belongs to no event
        other, literal = value >= (model.ends >> 16 & 65535), value >= (model.ends >> 32 & 65535)
        e = other.astype(np.int64) + literal
        coder.narrow(*model.event_range(e), unit)
        x = model.p[0] + (model.p[1] - model.p[0]) * other
        on = np.flatnonzero(literal)
        low, unit = coder.low.take(on), np.floor(coder.range.take(on) * (1 / _SHARES))
        new = of_share.take(((coder.code.take(on) - low) / unit).astype(np.int64))
        coder.narrow_some(on, low, order0.below.take(new), order0.share.take(new), unit)
        coder.settle()
        x[on] = new
        model.learn(x, e)
        out[t] = x
    return np.ascontiguousarray(out.T)


def write_segment(doc_ids: list[int | None], ids: list[np.ndarray], most: int = _MOST, lanes: int = 4096) -> bytes:
    """One segment of whole documents: about `lanes` blocks, or as many as blocks of `most` ids need. Ids beyond 65,535 are an error."""
    counts = np.array([len(x) for x in ids], np.uint32)
    flat = np.concatenate([*ids, np.empty(0, np.int32)]).astype(np.int32)
    total = len(flat)
    if total and (flat.min() < 0 or flat.max() >= _IDS):
        raise ValueError("this format holds token ids from 0 to 65,535")
    width = max(64, min(most, _MOST, -(-total // lanes)))
    n = -(-total // width)
    padded = np.full(n * width, flat[-1] if total else 0, np.int32)
    padded[:total] = flat
    order0, blocks = b"", []
    if n:
        model = _Order0.of(flat)
        order0, blocks = model.packed(), encode_blocks(padded.reshape(n, width), model)
    index = np.array([(len(b), zlib.crc32(b)) for b in blocks], "<u4").reshape(-1, 2)
    names = np.array([d or 0 for d in doc_ids], "<i8")
    given = np.array([d is not None for d in doc_ids], np.uint8)
    head = _HEAD.pack(MAGIC, len(doc_ids), n, width, total, len(order0), zlib.crc32(order0))
    return b"".join([head, names.tobytes(), given.tobytes(), counts.astype("<u4").tobytes(), order0, index.tobytes(), *blocks])


def read_segment(raw: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """The doc ids and ids of a segment; an order-0 model or a block that fails its checksum is an error."""
    magic, docs, n, width, total, size0, check0 = _HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    at = _HEAD.size
    names = np.frombuffer(raw, "<i8", docs, at).tolist()
    given = np.frombuffer(raw, np.uint8, docs, at := at + 8 * docs).tolist()
    counts = np.frombuffer(raw, "<u4", docs, at := at + docs)
    order0 = raw[(at := at + 4 * docs) : at + size0]
    if zlib.crc32(order0) != check0:
        raise ValueError("the counts of token ids fail their checksum")
    index = np.frombuffer(raw, "<u4", 2 * n, at := at + size0).reshape(-1, 2)
    at += 8 * n
    blocks = []
    for size, check in index.tolist():
        blocks.append(raw[at : at + size])
        if zlib.crc32(blocks[-1]) != check:
            raise ValueError("a block of token ids fails its checksum")
        at += size
    flat = decode_blocks(blocks, width, _Order0.unpacked(order0)).ravel()[:total] if n else np.empty(0, np.int32)
    return [d if g else None for d, g in zip(names, given)], np.split(flat, np.cumsum(counts.astype(np.int64))[:-1]) if docs else []
