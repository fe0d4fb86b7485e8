"""Bit-sliced comparison of fingerprints: bits stand in vertical planes, and differences are added up by bitwise counters."""

from __future__ import annotations

import numpy as np

FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def planes(values: np.ndarray) -> np.ndarray:
    """Rows of bits, plane k with bit k of every value, 64 values to a word. values: one 64-bit number each, or a row of them."""
    wide = np.ascontiguousarray(values[:, None] if values.ndim == 1 else values, "<u8")
    bits = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little")
    padded = np.zeros((-(-len(values) // 64) * 64, bits.shape[1]), np.uint8)
    padded[: len(values)] = bits
    return np.ascontiguousarray(np.packbits(padded.T, axis=1, bitorder="little")).view("<u8")


def beyond(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter, from the lowest bit up, is larger than the radius."""
    larger, equal = over, np.full_like(over, FULL)
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            larger, equal = larger | (equal & counters[k]), equal & ~counters[k]
    return larger


def within(rows: np.ndarray | None, lanes: np.ndarray, radius: int) -> np.ndarray:
    """Bit masks of the lanes within the radius: of each row's value, or of zero if rows is None.

    lanes: planes(). A lane's differing bits are added to a counter that is as wide as the radius and has a bit for what runs
    over; the carry goes up bit by bit. A row is abandoned as soon as all its lanes have passed the radius.
    """
    n, width = (1 if rows is None else len(rows)), lanes.shape[1]
    wide = rows[:, None] if rows is not None and rows.ndim == 1 else rows
    out, alive = np.zeros((n, width), np.uint64), np.arange(n)
    counters, over = [np.zeros((n, width), np.uint64) for _ in range(radius.bit_length())], np.zeros((n, width), np.uint64)
    for k in range(len(lanes)):
        if wide is None:
            bits = lanes[k][None, :]
        else:
            bits = lanes[k][None, :] ^ np.where((wide[alive, k >> 6] >> np.uint64(k & 63)) & np.uint64(1), FULL, np.uint64(0))[:, None]
        for j, counter in enumerate(counters):
            counters[j], bits = counter ^ bits, counter & bits
        over = over | bits
        if k % 8 == 7 and k >= radius:
            open_rows = (beyond(counters, over, radius) != FULL).any(axis=1)
            if not open_rows.all():
                alive, counters, over = alive[open_rows], [c[open_rows] for c in counters], over[open_rows]
                if not len(alive):
                    return out
    out[alive] = ~beyond(counters, over, radius)
    return out


def marked(mask: np.ndarray, n: int) -> np.ndarray:
    """Masks of n lanes as booleans."""
    return np.unpackbits(np.ascontiguousarray(mask).view(np.uint8), axis=-1, bitorder="little")[..., :n].astype(bool)
