"""Monotone sequences of 64-bit integers in Elias-Fano blocks, of which numpy looks up many values at a time.

A block has BLOCK values. Above its first value, their high parts stand in unary in two machine words, of BLOCK ones and HIGH
zeros; their low parts have as few bits as that leaves, so that there are more high parts than values and few values share one.
A value is found by selecting a one, its place by selecting zeros: no block is decoded for a lookup.
"""

from __future__ import annotations

import numpy as np

from tidegauge.llm.common import U64

BLOCK, HIGH = 32, 96
#: Words of a block beside its first value and its low parts: where those begin, with their bits, and the unary part.
_WORDS = 3
#: Lookups that are worked on together, so that what they need stays in the processor's cache.
TOGETHER = 1 << 14
_MASKS = np.array([(1 << w) - 1 for w in range(64)], dtype=U64)
_ONE, _SIX, _LAST = U64(1), U64(6), U64(63)


def encode(values: np.ndarray) -> bytes:
    """Of a non-decreasing sequence, whose values span less than 2**62."""
    n = len(values)
    blocks = -(-n // BLOCK)
    full = np.full(blocks * BLOCK, values[-1] if n else 0, dtype=U64)
    full[:n] = values
    full = full.reshape(blocks, BLOCK)
    first, top = full[:, 0].copy(), full[:, -1] - full[:, 0]
    width = np.maximum(np.frexp(top.astype(float))[1] - 7, 0).astype(U64)
    width += (top >> width) >= U64(HIGH)
    at = np.concatenate((np.zeros(1, U64), np.cumsum(width * U64(BLOCK), dtype=U64)))
    # low parts are one sequence of bits, and a word more, since lookups read eight bytes
    head, low = np.empty((blocks, _WORDS), U64), np.zeros(int(at[-1] >> _SIX) + 2, U64)
    head[:, 0] = (at[:-1] << _SIX) | width
    for lo in range(0, blocks, TOGETHER // BLOCK):
        own = slice(lo, lo + TOGETHER // BLOCK)
        off = full[own] - first[own, None]
        bit = (off >> width[own, None]) + np.arange(BLOCK, dtype=U64)
        one, second = _ONE << (bit & _LAST), bit >> _SIX
        head[own, 1], head[own, 2] = (np.bitwise_or.reduce(one * half, axis=1) for half in (_ONE - second, second))
        _pack(low, off & _MASKS[width[own].view(np.int64)][:, None], at[own], width[own])
    return np.array([n, blocks], "<i8").tobytes() + b"".join(x.astype("<u8", copy=False).tobytes() for x in (first, head, low))


def _pack(out: np.ndarray, low: np.ndarray, at: np.ndarray, width: np.ndarray) -> None:
    """Put the low parts of blocks of these widths into the sequence of bits, from `at` on."""
    some = np.flatnonzero(width)
    if not len(some):
        return
    place = (at[some, None] + width[some, None] * np.arange(BLOCK, dtype=U64)).reshape(-1)
    low, width = low[some].reshape(-1), np.repeat(width[some], BLOCK)
    word, shift = (place >> _SIX).view(np.int64), place & _LAST
    begins = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[begins]] |= np.bitwise_or.reduceat(low << shift, begins)
    over = np.flatnonzero(shift + width > U64(64))  # their upper bits begin the next word
    out[word[over] + 1] |= low[over] >> (U64(64) - shift[over])


def _places_in_bytes() -> np.ndarray:
    """By rank * 256 + byte: the place of the byte's one that has `rank` ones below it."""
    out = np.zeros(8 * 256, np.uint8)
    for byte in range(256):
        for rank, place in enumerate(i for i in range(8) if byte >> i & 1):
            out[rank * 256 + byte] = place
    return out


_IN_BYTE = _places_in_bytes()
_EACH, _TOP = U64(0x0101010101010101), U64(0x8080808080808080)


def _select(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The place of the one with `rank` ones below it, in 64-bit words: sums of ones up to each byte find its byte, and a
    table its place there."""
    x = word - ((word >> U64(1)) & U64(0x5555555555555555))
    x = (x & U64(0x3333333333333333)) + ((x >> U64(2)) & U64(0x3333333333333333))
    x = ((x + (x >> U64(4))) & U64(0x0F0F0F0F0F0F0F0F)) * _EACH
    bits = np.bitwise_count(((rank * _EACH) | _TOP) - x & _TOP).astype(U64) * U64(8)
    before = ((x << U64(8)) >> bits) & U64(255)
    return (bits + _IN_BYTE[(((rank - before) << U64(8)) | ((word >> bits) & U64(255))).view(np.int64)]).view(np.int64)


def _ones(first: np.ndarray, second: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The place of the one with `rank` ones below it, in pairs of words."""
    below = np.bitwise_count(first)
    later = rank >= below
    return 64 * later + _select(np.where(later, second, first), (rank - below * later).view(U64))


class EliasFano:
    """A sequence in a buffer, which may be a memory map; only what is asked for is read."""

    def __init__(self, buffer: np.ndarray):
        self.n, blocks = (int(x) for x in buffer[:16].view("<i8"))
        at = 16

        def take(size: int, kind: str) -> np.ndarray:
            nonlocal at
            out = buffer[at : at + size].view(kind)
            at += size
            return out

        self.first, self.head = take(8 * blocks, "<u8"), take(8 * _WORDS * blocks, "<u8")
        low = np.ascontiguousarray(buffer[at:])
        self.low = np.ndarray(max(len(low) - 7, 0), "<u8", low, strides=(1,))  # eight bytes from every place on

    def _heads(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the low parts of blocks begin, with their bits, and both words of the unary parts."""
        at = block * _WORDS
        return self.head.take(at), self.head.take(at + 1), self.head.take(at + 2)

    def _low(self, where: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Low parts of the values at places of blocks, of which `where` has begin and width."""
        width = where & _LAST
        bit = (where >> _SIX) + place.view(U64) * width
        return (self.low[(bit >> U64(3)).view(np.int64)] >> (bit & U64(7))) & _MASKS.take(width.view(np.int64))

    def get(self, index: np.ndarray) -> np.ndarray:
        """Values at positions."""
        out = np.zeros(len(index), U64)
        for lo in range(0, len(index), TOGETHER):
            own = index[lo : lo + TOGETHER]
            block, place = own // BLOCK, own % BLOCK
            where, *words = self._heads(block)
            high = (_ones(*words, place) - place).view(U64)
            out[lo : lo + TOGETHER] = self.first.take(block) + ((high << (where & _LAST)) | self._low(where, place))
        return out

    def find(self, values: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Positions of values in a sequence without repeats, -1 for those that it hasn't. Sorted values are found fastest.

        Where it is known that a value can stand from `begin` to before `end` only, which mustn't be empty, its block is
        searched for only if they are in several.
        """
        out = np.full(len(values), -1, dtype=np.int64)
        if not self.n:
            return out
        for lo in range(0, len(values), TOGETHER):
            own = values[lo : lo + TOGETHER]
            if begin is None:
                block = np.searchsorted(self.first, own, side="right") - 1
            else:
                block = begin[lo : lo + TOGETHER] // BLOCK
                several = np.flatnonzero((end[lo : lo + TOGETHER] - 1) // BLOCK > block)
                block[several] = np.searchsorted(self.first, own[several], side="right") - 1
            where, *words = self._heads(np.maximum(block, 0))
            off, width = own - self.first.take(block, mode="clip"), where & _LAST
            high, want = off >> width, off & _MASKS.take(width.view(np.int64))
            open_ = np.flatnonzero((block >= 0) & (high < HIGH))
            if len(open_) < len(own):
                block, high, want, where, *words = (x.take(open_) for x in (block, high, want, where, *words))
            # values of this high part stand after the zero before it, up to the next zero
            high = high.view(np.int64)
            place = np.where(high > 0, _ones(~words[0], ~words[1], np.maximum(high, 1) - 1) + 1 - high, 0)
            there = (np.where(place + high < 64, *words) >> (place + high & 63).view(U64)) & _ONE
            low = self._low(where, place)
            hit = np.flatnonzero((low == want) & (there > 0))
            out[lo + open_.take(hit)] = block.take(hit) * BLOCK + place.take(hit)
            # the few that others come before: halve what is left up to the next zero
            on = np.flatnonzero((low < want) & (there > 0))
            open_, block, high, want, where, left, *words = (x.take(on) for x in (open_, block, high, want, where, place + 1, *words))
            right = _ones(~words[0], ~words[1], high) - high
            while len(on := np.flatnonzero(left < right)):
                open_, block, want, where, left, right = (x.take(on) for x in (open_, block, want, where, left, right))
                place = (left + right) >> 1
                low = self._low(where, place)
                hit = np.flatnonzero(low == want)
                # what fills up the last block equals the last value
                out[lo + open_.take(hit)] = np.minimum(block.take(hit) * BLOCK + place.take(hit), self.n - 1)
                left, right = np.where(low < want, place + 1, left), np.where(low > want, place, np.where(low < want, right, left))
        return out

    def all(self) -> np.ndarray:
        """All values, whole blocks at a time."""
        out, head = np.empty((len(self.first), BLOCK), U64), self.head.reshape(-1, _WORDS)
        for lo in range(0, len(out), TOGETHER // BLOCK):
            own = slice(lo, lo + TOGETHER // BLOCK)
            unary, where = np.ascontiguousarray(head[own, 1:]), head[own, :1]
            ones = np.flatnonzero(np.unpackbits(unary.view(np.uint8), axis=1, bitorder="little")).reshape(len(unary), BLOCK)
            high = (ones - (BLOCK + HIGH) * np.arange(len(unary))[:, None] - np.arange(BLOCK)).view(U64)
            out[own] = self.first[own, None] + ((high << (where & _LAST)) | self._low(where, np.arange(BLOCK)))
        return out.reshape(-1)[: self.n]
