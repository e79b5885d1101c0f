"""Simple-8b: whole numbers packed into 64-bit words, in blocks that decode on their own.

A word holds a selector in its top four bits and, in the other sixty, as many equal slots as the
selector says. Numbers of over sixty bits are escapes: their word holds a place in a list of raw
numbers. A block has ``BLOCK`` numbers (the last one may have fewer) and starts a word of its own;
its place among the words is stored, so any block can be read alone. A word's slots are all used:
every length can be made up from the slot counts, so decoding needs no padding rule.
"""

from __future__ import annotations

import struct

import numpy as np

# Slots and bits of selectors 0 to 13. Selector 15 is the escape.
SLOTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 15
BLOCK = 1024
MAGIC = b"PWS8\x01\x00\x00\x00"
HEADER = struct.Struct("<8sQIII")


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits of each number, one at least."""
    bits = np.ones(len(values), np.uint8)
    for b in (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60):
        bits[values >= np.uint64(1) << np.uint64(b)] = b + 1
    return bits


def _choices(bits: np.ndarray) -> np.ndarray:
    """For each place, the selector that takes most numbers from there, blocks left aside."""
    best = np.full(len(bits), len(SLOTS) - 1, np.uint8)
    for s in range(len(SLOTS) - 2, -1, -1):
        fits = np.flatnonzero(bits <= BITS[s])
        n = SLOTS[s]
        if len(fits) < n:
            break
        run = fits[: len(fits) - n + 1]
        best[run[fits[n - 1:] - run == n - 1]] = s
    return best


def encode(values: np.ndarray) -> bytes:
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    n_blocks = -(-n // BLOCK)
    bits = bit_lengths(values)
    best = _choices(bits)
    pos = np.arange(n_blocks, dtype=np.int64) * BLOCK
    end = np.minimum(pos + BLOCK, n)
    slots = np.array(SLOTS, np.int64)
    chosen = np.full(n, 255, np.uint8)  # at the first number of each word: its selector
    while len(pos):  # every block moves on by one word
        s = best[pos]
        left = end - pos
        while (long := slots[s] > left).any():  # a selector that takes more than is left of the block
            s = np.where(long, s + 1, s).astype(np.uint8)
        chosen[pos] = s
        pos = pos + slots[s]
        go = pos < end
        pos, end = pos[go], end[go]
    first = np.flatnonzero(chosen != 255)
    selector = chosen[first].astype(np.uint64)
    words = np.zeros(len(first), np.uint64)
    escaped = bits[first] > 60
    for s in np.unique(selector).tolist():
        at = np.flatnonzero((selector == s) & ~escaped)
        shift = np.arange(SLOTS[s], dtype=np.uint64) * np.uint64(BITS[s])
        part = values[first[at][:, None] + np.arange(SLOTS[s])]
        words[at] = np.bitwise_or.reduce(part << shift, axis=1) | np.uint64(s) << np.uint64(60)
    raw = values[first[escaped]]
    words[escaped] = np.arange(len(raw), dtype=np.uint64) | np.uint64(ESCAPE) << np.uint64(60)
    offsets = np.searchsorted(first, np.arange(n_blocks + 1) * BLOCK).astype(np.uint32)
    return b"".join((HEADER.pack(MAGIC, n, n_blocks, len(words), len(raw)), offsets.astype("<u4").tobytes(),
                     words.astype("<u8").tobytes(), raw.astype("<u8").tobytes()))


def _parts(data: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    magic, n, n_blocks, n_words, n_raw = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b stretch of this version")
    at = HEADER.size
    offsets = np.frombuffer(data, "<u4", n_blocks + 1, at)
    words = np.frombuffer(data, "<u8", n_words, at := at + offsets.nbytes)
    return n, offsets, words, np.frombuffer(data, "<u8", n_raw, at + words.nbytes)


def _unpack(words: np.ndarray, raw: np.ndarray) -> np.ndarray:
    selector = (words >> np.uint64(60)).astype(np.int64)
    slots = np.array([*SLOTS, 0, 1], np.int64)[selector]
    upto = np.cumsum(slots)
    out = np.empty(int(upto[-1]) if len(upto) else 0, np.uint64)
    first = upto - slots
    payload = words & np.uint64((1 << 60) - 1)
    for s in np.unique(selector).tolist():
        at = np.flatnonzero(selector == s)
        if s == ESCAPE:
            out[first[at]] = raw[payload[at].astype(np.int64)]
            continue
        shift = np.arange(SLOTS[s], dtype=np.uint64) * np.uint64(BITS[s])
        mask = np.uint64((1 << BITS[s]) - 1)
        out[first[at][:, None] + np.arange(SLOTS[s])] = (payload[at][:, None] >> shift) & mask
    return out


def decode(data: bytes) -> np.ndarray:
    _, _, words, raw = _parts(data)
    return _unpack(words, raw)


def decode_range(data: bytes, start: int, stop: int) -> np.ndarray:
    """Numbers start to stop, from the blocks that hold them alone."""
    n, offsets, words, raw = _parts(data)
    start, stop = max(0, start), min(stop, n)
    if start >= stop:
        return np.zeros(0, np.uint64)
    a, b = start // BLOCK, -(-stop // BLOCK)
    return _unpack(words[offsets[a]:offsets[b]], raw)[start - a * BLOCK:stop - a * BLOCK]
