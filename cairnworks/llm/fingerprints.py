"""Bit-sliced search for 64-bit fingerprints within a small Hamming radius.

A block of fingerprints is stored vertically: plane ``b`` holds bit ``b`` of all of them, 64 to a
word. One query bit against one plane is then one XOR that updates 64 distances at once; the
distances are bitwise counters fed through a carry-save adder. A query's block is abandoned as
soon as all its counters exceed the radius.
"""

from __future__ import annotations

import numpy as np

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """uint64 (64, words): plane b has, at position i, bit b of fingerprint i; the rest is zero."""
    bits = np.unpackbits(np.ascontiguousarray(prints, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    words = -(-len(prints) // 64)
    full = np.zeros((64, words * 64), np.uint8)
    full[:, : len(prints)] = bits.T
    return np.packbits(full, axis=1, bitorder="little").view("<u8")


def close_pairs(prints: np.ndarray, radius: int, queries: int = 256, last: np.ndarray | None = None):
    """Yields (query indexes, other indexes), arrays of pairs i < j of at most ``radius`` differing bits.

    ``last``: bits to look at after all others, such as those that the block has in common.
    """
    n = len(prints)
    planes = bit_planes(prints)
    order = np.arange(64)
    if last is not None and len(last):
        order = np.concatenate([np.setdiff1d(order, last), last])
    width = max(1, int(radius).bit_length())
    spare = (1 << width) - 1 - radius  # counters start here, so that exceeding the radius overflows
    real = np.packbits(np.arange(planes.shape[1] * 64) < n, bitorder="little").view("<u8")
    for first in range(0, n, queries):
        rows = np.arange(first, min(first + queries, n))
        low = first // 64  # pairs with earlier fingerprints came up before
        held = planes[:, low:]
        over = np.repeat(~real[None, low:], len(rows), axis=0)
        counters = [np.full(over.shape, ALL if spare >> k & 1 else 0, np.uint64) for k in range(width)]
        for step, b in enumerate(order):
            wanted = (prints[rows] >> np.uint64(b)) & np.uint64(1)
            carry = held[b][None, :] ^ (np.uint64(0) - wanted)[:, None]
            for k in range(width):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            over |= carry
            if step % 8 == 7:
                alive = (over != ALL).any(axis=1)
                if not alive.all():
                    rows, over = rows[alive], over[alive]
                    counters = [c[alive] for c in counters]
                    if not len(rows):
                        break
        if len(rows):
            near = np.unpackbits((~over).view(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")
            i, j = np.nonzero(near)
            i, j = rows[i], j + low * 64
            later = j > i
            if later.any():
                yield i[later], j[later]


def smallest_linked(n: int, pairs) -> np.ndarray:
    """For each of n items the smallest index it is linked to, over any steps."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:  # shorten chains
                root = label[label]
                if (root == label).all():
                    break
                label = root
    return label
