"""Byte pair merges of many short pieces at once, as array steps."""

from __future__ import annotations

import json

import numpy as np

_NONE = np.iinfo(np.int32).max


def _byte_signs() -> list[str]:
    """The sign that byte-level vocabularies write for each byte: printable bytes as they are, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merges:
    """Merges of a vocabulary with marked word ends. A round merges, in every piece, the pair of lowest rank wherever it occurs."""

    def __init__(self, vocab: dict[str, int], merges: list[list[str]], suffix: str) -> None:
        signs = _byte_signs()
        self.inner = np.array([vocab[s] for s in signs], np.int64)
        self.last = np.array([vocab[s + suffix] for s in signs], np.int64)
        self.wide = int(max(vocab.values())) + 1
        keys = np.array([vocab[a] * self.wide + vocab[b] for a, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.bits = max(4, (8 * len(keys)).bit_length())
        self.slots, self.ranks = np.full((1 << self.bits) + 64, -1, np.int64), np.zeros((1 << self.bits) + 64, np.int32)
        for rank, (key, at) in enumerate(zip(keys.tolist(), self._home(keys).tolist())):
            probe = 0
            while self.slots[at + probe] not in (-1, key):
                probe += 1
            if self.slots[at + probe] == -1:  # the first of repeated merges counts
                self.slots[at + probe], self.ranks[at + probe] = key, rank

    @classmethod
    def of_file(cls, path: str) -> Merges | None:
        """Of a tokenizer's file, or None if its pieces are not merged from bytes with marked ends."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        fits = model.get("type") == "BPE" and model.get("end_of_word_suffix") and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        if not fits or not steps or steps[-1].get("type") != "ByteLevel" or steps[-1].get("add_prefix_space") or not all(s in model["vocab"] and s + model["end_of_word_suffix"] in model["vocab"] for s in _byte_signs()):
            return None
        return cls(model["vocab"], model["merges"], model["end_of_word_suffix"])

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.wide + right
        at = self._home(keys)
        slot = self.slots[at]
        hit = slot == keys
        out = np.where(hit, self.ranks[at], _NONE)
        open_ = np.flatnonzero(~hit & (slot != -1))
        while len(open_):
            at[open_] += 1
            slot = self.slots[at[open_]]
            hit = slot == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (slot != -1)]
        return out

    def encode(self, pieces: list[str]) -> list[bytes]:
        """Each piece's ids, as bytes of 32-bit numbers. Pieces are not empty and have no line break."""
        flat = np.frombuffer("\n".join(pieces).encode() + b"\n", np.uint8)
        ends = np.flatnonzero(flat == 10)
        symbol = self.inner[flat]
        symbol[ends - 1] = self.last[flat[ends - 1]]
        piece = np.repeat(np.arange(len(pieces)), np.diff(ends, prepend=-1))
        kept = np.ones(len(flat), bool)
        kept[ends] = False
        symbol, piece = symbol[kept], piece[kept]
        done_symbols, done_pieces = [], []
        rank = np.full(len(symbol), _NONE, np.int32)
        rank[:-1] = self.rank_of(symbol[:-1], symbol[1:])
        rank[:-1][piece[1:] != piece[:-1]] = _NONE  # no pair across pieces
        while len(symbol):
            starts = np.flatnonzero(np.diff(piece, prepend=-1))
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(piece)))
            least = np.repeat(least, sizes)
            over = least == _NONE
            done_symbols.append(symbol[over])
            done_pieces.append(piece[over])
            at = np.flatnonzero((rank == least) & ~over)
            # of pairs that overlap, as in aaa, the first goes, and then every other one
            run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            symbol[at] = self.made[rank[at]]
            stay = ~over
            stay[at + 1] = False
            place = np.cumsum(stay) - 1
            symbol, piece, rank = symbol[stay], piece[stay], rank[stay]
            # only pairs with a merged symbol have new ranks
            new = np.zeros(len(symbol) + 1, bool)
            new[place[at]] = True
            new[place[at] - 1] = True  # of place 0, the spare last one
            new = np.flatnonzero(new[:-1])
            ahead = np.minimum(new + 1, len(symbol) - 1)
            rank[new] = np.where((ahead > new) & (piece[ahead] == piece[new]), self.rank_of(symbol[new], symbol[ahead]), _NONE)
        symbol, piece = np.concatenate(done_symbols).astype(np.int32), np.concatenate(done_pieces)
        order = np.argsort(piece, kind="stable")
        data = symbol[order].tobytes()
        stops = (np.cumsum(np.bincount(piece, minlength=len(pieces))) * 4).tolist()
        return [data[a:b] for a, b in zip([0, *stops[:-1]], stops)]
