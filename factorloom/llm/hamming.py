"""All rows at most a radius apart in Hamming distance, without comparing all rows.

Masks that can't miss: the bits are cut into parts, in one of which a pair within the radius differs in
few bits. The nonzero words of a linear code of one more dimension are the masks of a part; the columns
of so few bits leave a dimension free, so some mask holds none of them and the pair agrees under it.
Rows that agree under a mask are compared in full. A mask holds about half of its part's bits, so few
others agree; where the rows are so alike that this would take longer than all pairs, all pairs are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from factorloom.llm.tiles import Forest

#: Seconds of a row under a mask, of a mask, of two rows that agree under one, and of two of all rows: they choose the parts, not the result.
ROW_S, MASK_S, AGREE_S, PAIR_S = 12e-9, 3e-4, 3e-8, 4e-9
#: Longer runs of rows that agree under a mask are compared by what is not linked yet.
LONG_RUN = 32
_MOST_DIMENSIONS = 9
_STRIP = 128
_ODD = np.uint64(0x9E3779B97F4A7C15)


def near_pairs(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index arrays (i, j) of rows a[i], b[j] (each of one or more words) at most radius bits apart, strip by strip; i < j where both are one tile."""
    for at in range(0, len(a), _STRIP):
        from_b = at if same else 0
        apart = np.bitwise_count(a[at : at + _STRIP, 0, None] ^ b[None, from_b:, 0])
        if a.shape[1] > 1:
            apart = apart.astype(np.uint16)
            for k in range(1, a.shape[1]):
                apart += np.bitwise_count(a[at : at + _STRIP, k, None] ^ b[None, from_b:, k])
        i, j = np.nonzero(apart <= radius)
        i, j = i + at, j + from_b
        yield (i[i < j], j[i < j]) if same else (i, j)


@lru_cache(maxsize=64)
def code_masks(width: int, dimensions: int) -> np.ndarray:
    """The nonzero words of a linear code as masks of width bits, of nearly the same weight; any dimensions - 1 bits are outside one of them."""
    names = np.arange(1, 1 << dimensions)
    holds = (np.bitwise_count(names[:, None] & names[None, :]) & 1).astype(np.uint8)  # word by column
    weight, masks = np.zeros(len(names)), np.zeros(len(names), dtype=np.uint64)
    for bit in range(width):  # the column that leaves the fewest agreements by chance
        column = holds[:, np.argmin((2.0 ** -(weight[:, None] + holds)).sum(axis=0))]
        weight += column
        masks |= column.astype(np.uint64) << np.uint64(bit)
    return masks


@lru_cache(maxsize=64)
def cut_parts(bits: int, radius: int, n_rows: int) -> tuple[tuple[int, int, int], ...]:
    """(first bit, width, dimensions) of the parts that take the least time for so many rows; none where all pairs take less.

    A pair within the radius differs in fewer bits than dimensions in one part at least, since these sum to radius + 1.
    """
    best, least = (), PAIR_S * n_rows * n_rows / 2 * -(-bits // 64)
    for n in range(1, radius + 2):
        cuts = [bits * i // n for i in range(n + 1)]
        parts = tuple((cuts[i], min(64, cuts[i + 1] - cuts[i]), (radius + 1 + i) // n) for i in range(n))
        if any(width < 1 or d > _MOST_DIMENSIONS for _, width, d in parts):
            continue
        weight = np.bitwise_count(np.concatenate([code_masks(width, d) for _, width, d in parts])).astype(float)
        took = len(weight) * (MASK_S + ROW_S * n_rows) + AGREE_S * n_rows * n_rows / 2 * (2.0**-weight).sum()
        if took < least:
            best, least = parts, took
    return best


def _bits(rows: np.ndarray, first: int, width: int) -> np.ndarray:
    """Bits first to first + width of each row, whose words have their highest bit first."""
    k, off = divmod(first, 64)
    found = rows[:, k] << np.uint64(off)
    if off + width > 64:
        found |= rows[:, k + 1] >> np.uint64(64 - off)
    return found >> np.uint64(64 - width)


def _all_pairs(rows: np.ndarray, radius: int, forest: Forest) -> None:
    for i, j in near_pairs(rows, rows, True, radius):
        forest.link(i, j)


def _link(rows: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int, forest: Forest) -> None:
    """Links those of the pairs (i, j) that are within the radius and not linked yet."""
    new = forest.up[i] != forest.up[j]
    i, j = i[new], j[new]
    ones = np.bitwise_count(rows[i] ^ rows[j])
    apart = ones[:, 0].astype(np.uint16)
    for k in range(1, ones.shape[1]):
        apart += ones[:, k]
    near = apart <= radius
    if near.any():
        forest.link(i[near], j[near])


def _rest(rows: np.ndarray, run: np.ndarray, radius: int, forest: Forest) -> np.ndarray:
    """Rows of a run outside its largest component, once each row has met its neighbour and the first one."""
    _link(rows, run[1:], run[:-1], radius, forest)
    _link(rows, run[1:], np.broadcast_to(run[:1], len(run) - 1), radius, forest)
    _, of, sizes = np.unique(forest.roots(run), return_inverse=True, return_counts=True)
    return run[of != sizes.argmax()]


def link_near(rows: np.ndarray, radius: int, forest: Forest, parts: tuple[tuple[int, int, int], ...] | None = None) -> None:
    """Links in forest all rows (of one or more 64-bit words) at most radius bits apart; pairs whose rows others connect may be left out."""
    n = len(rows)
    parts = cut_parts(64 * rows.shape[1], radius, 1 << max(0, n - 1).bit_length()) if parts is None else parts
    if not parts or n < 2:
        return _all_pairs(rows, radius, forest)
    low = np.uint64((1 << n.bit_length()) - 1)
    index, spent = np.arange(n, dtype=np.uint64), 0
    key, unlike, goes_on = np.empty(n, np.uint64), np.empty(n - 1, np.uint64), np.zeros(n + LONG_RUN, dtype=bool)
    place = lambda key: (key & low).view(np.int64)
    for first, width, dimensions in parts:
        part = _bits(rows, first, width)
        for mask in code_masks(width, dimensions):
            np.bitwise_and(part, mask, out=key)
            key *= _ODD  # upper bits tell masked bits apart (if two share them, a pair is compared in vain); lower ones hold the row
            key &= ~low
            key |= index
            key.sort()
            np.bitwise_xor(key[1:], key[:-1], out=unlike)
            np.less_equal(unlike, low, out=goes_on[: n - 1])
            at = np.flatnonzero(goes_on)
            if len(at) >= LONG_RUN and (at[LONG_RUN - 1 :] - at[: 1 - LONG_RUN] == LONG_RUN - 1).any():
                ends = np.flatnonzero(~goes_on[:n]) + 1
                sizes = np.diff(ends, prepend=0)
                long = sizes > LONG_RUN
                within = np.repeat(long, sizes)
                runs, sizes = place(key[within]), sizes[long]
                starts = np.cumsum(sizes) - sizes
                roots = forest.roots(runs)
                mixed = np.minimum.reduceat(roots, starts) != np.maximum.reduceat(roots, starts)
                for start, size in zip(starts[mixed], sizes[mixed], strict=True):
                    run = runs[start : start + size]
                    rest = _rest(rows, run, radius, forest)
                    spent += len(rest) * len(run)
                    if spent > n * n // 2:
                        return _all_pairs(rows, radius, forest)
                    for i, j in near_pairs(rows[rest], rows[run], False, radius):
                        forest.link(rest[i], run[j])
                at = at[~within[at]]
            lag = 1
            while len(at):
                i, j = place(key[at]), place(key[at + lag])
                near = np.bitwise_count(part[i] ^ part[j]) < dimensions
                if near.any():
                    _link(rows, i[near], j[near], radius, forest)
                at = at[goes_on[at + lag]]
                lag += 1
