"""Word-aligned coding of ids: Simple-8b with escapes, in blocks that decode by themselves.

A word of 64 bits holds a selector in its low four bits and ids of one width in the other sixty. Ids
are cut into blocks of ``BLOCK``; a block starts with a new word and what its last word has to spare
is zero, so a block is found by its offset and decoded without the ones before it. An id of more than
60 bits is an escape: its word holds its place among the block's escapes, which follow the words.

Both directions run over all blocks at once: for every place the fullest word that could start there
is found by running maxima, the starts are followed through all blocks in step, and words of one
selector are filled or emptied together.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

BLOCK = 256
# Ids a word and bits an id, by selector. Selector 0 is an escape, 1 a run of zeros.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])

_PAD = int(COUNTS.max())
_ROW = BLOCK + _PAD
_ESCAPED = 16
_LEVEL = np.array([next((s for s in range(1, 16) if BITS[s] >= width), _ESCAPED) for width in range(66)], np.uint8)


class Packed(NamedTuple):
    """Words and escapes of all blocks, and for each block how many of both it has."""

    words: np.ndarray
    escapes: np.ndarray
    block_words: np.ndarray
    block_escapes: np.ndarray


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id takes, 0 for 0: the exponents of floats, in halves where floats would round."""
    out = np.frexp(ids.astype(np.float64))[1]
    wide = np.flatnonzero(ids >> np.uint64(52))
    out[wide] = 32 + np.frexp((ids[wide] >> np.uint64(32)).astype(np.float64))[1]
    return out


def _selectors(ids: np.ndarray, blocks: int) -> np.ndarray:
    """For every place the selector of the fullest word that may start there."""
    levels = np.zeros((blocks, _ROW), np.uint8)
    flat = np.zeros(blocks * BLOCK, np.uint8)
    flat[: len(ids)] = _LEVEL[_widths(ids)]
    levels[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    most, width = levels[:, :BLOCK].copy(), 1
    out = np.full((blocks, BLOCK), 15, np.uint8)
    for s in range(14, 0, -1):
        while width < COUNTS[s]:
            np.maximum(most, levels[:, width : width + BLOCK], out=most)
            width += 1
        fits = most <= s
        if not fits.any():  # then no word of more ids fits either
            break
        out[fits] = s
    out[levels[:, :BLOCK] == _ESCAPED] = 0
    return out


def _starts(steps: np.ndarray, n: int) -> np.ndarray:
    """Where words start: every block is followed from its first place, all blocks in step."""
    blocks = len(steps)
    out = np.zeros((blocks, BLOCK), bool)
    end = np.minimum(BLOCK, n - BLOCK * np.arange(blocks))
    live, at = np.arange(blocks), np.zeros(blocks, np.int64)
    while len(live):
        out[live, at] = True
        at = at + steps[live, at]
        on = at < end[live]
        live, at = live[on], at[on]
    return out


def _ranks(member: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each member, how many members of its group come before it (groups are in order)."""
    of = group[member]
    return np.arange(len(of)) - np.searchsorted(of, of)


def pack(ids: np.ndarray) -> Packed:
    """ids (unsigned, up to 64 bits) as words. No ids make no block."""
    ids = np.ascontiguousarray(ids, np.uint64)
    blocks = -(-len(ids) // BLOCK)
    if not blocks:
        return Packed(np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.uint32))
    selectors = _selectors(ids, blocks)
    starts = _starts(COUNTS[selectors], len(ids))
    place = np.flatnonzero(starts)
    chosen, block = selectors.ravel()[place], place // BLOCK
    padded = np.zeros((blocks, _ROW), np.uint64)
    whole = len(ids) // BLOCK
    padded[:whole, :BLOCK] = ids[: whole * BLOCK].reshape(whole, BLOCK)
    if whole < blocks:
        padded[whole, : len(ids) - whole * BLOCK] = ids[whole * BLOCK :]
    values, at = padded.ravel(), block * _ROW + place % BLOCK
    words = chosen.astype(np.uint64)
    for s in range(1, 16):
        mine = np.flatnonzero(chosen == s)
        if len(mine) and BITS[s]:
            first, packed = at[mine], np.zeros(len(mine), np.uint64)
            for j in range(COUNTS[s]):
                packed |= values[first + j] << np.uint64(BITS[s] * j)
            words[mine] |= packed << np.uint64(4)
    out = np.flatnonzero(chosen == 0)
    words[out] = _ranks(out, block).astype(np.uint64) << np.uint64(4)
    counted = lambda b: np.bincount(b, minlength=blocks).astype(np.uint32)
    return Packed(words, values[at[out]], counted(block), counted(block[out]))


def unpack(packed: Packed, n: int) -> np.ndarray:
    """The n ids of some blocks that follow one another."""
    words, escapes, block_words, block_escapes = packed
    blocks = len(block_words)
    if not blocks:
        return np.empty(0, np.uint64)
    chosen = (words & np.uint64(15)).astype(np.int64)
    payload = words >> np.uint64(4)
    block = np.repeat(np.arange(blocks), block_words)
    counts = COUNTS[chosen]
    before = np.cumsum(counts) - counts
    first = np.cumsum(block_words, dtype=np.int64) - block_words
    at = before - before[first][block] + block * _ROW
    values = np.zeros(blocks * _ROW, np.uint64)
    for s in range(2, 16):
        mine = np.flatnonzero(chosen == s)
        if len(mine):
            start, held, mask = at[mine], payload[mine], np.uint64((1 << int(BITS[s])) - 1)
            for j in range(COUNTS[s]):
                values[start + j] = (held >> np.uint64(BITS[s] * j)) & mask
    out = np.flatnonzero(chosen == 0)
    if len(out):
        first_escape = np.cumsum(block_escapes, dtype=np.int64) - block_escapes
        values[at[out]] = escapes[first_escape[block[out]] + payload[out].astype(np.int64)]
    return values.reshape(blocks, _ROW)[:, :BLOCK].ravel()[:n]
