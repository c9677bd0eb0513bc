"""Sets of hashed tokens: signatures that bound what two sets share, and the pairs of a bucket that may be similar.

A signature counts the tokens of each of a power of two of groups, modulo 16. Two sets whose counts in a group differ by
d (around the circle of 16) have d tokens at least that only one of them has, so the sum over groups bounds the overlap
from above. A wide signature folds onto a narrower one by adding halves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Groups of the signature that travels with the entries of the index, and tokens a group of the full one.
GROUPS, TOKENS_PER_GROUP = 256, 2
SIGNATURE_BYTES = GROUPS // 2
#: Buckets up to this many entries are gone through together, by the distance of two entries.
SMALL = 32
#: Pairs that are looked at together, and of these signatures that are summed together.
BLOCK_PAIRS, BLOCK_SUMS = 1 << 16, 1 << 12

_LOWEST_BITS = np.uint64(0x1111111111111111)
_NIBBLES = np.minimum(np.arange(16), 16 - np.arange(16))
_APART = np.zeros((256, 256), np.uint8)
for _x in range(256):
    _y = np.arange(256)
    _APART[_x] = _NIBBLES[((_x & 15) - (_y & 15)) & 15] + _NIBBLES[((_x >> 4) - (_y >> 4)) & 15]


def signature(tokens: np.ndarray) -> bytes:
    """Counts modulo 16 of GROUPS groups or more, two in a byte: group k with group k + half, so that folding is a sum."""
    groups = max(GROUPS, 1 << max(0, -(-len(tokens) // TOKENS_PER_GROUP) - 1).bit_length())
    counts = np.bincount((tokens >> np.uint64(20)).astype(np.int64) & (groups - 1), minlength=groups) & 15
    return _packed(counts).tobytes()


def _packed(counts: np.ndarray) -> np.ndarray:
    half = len(counts) // 2
    return (counts[:half] | counts[half:] << 4).astype(np.uint8)


def folded(x: np.ndarray, size: int = SIGNATURE_BYTES) -> np.ndarray:
    """A signature (array of bytes) in so many bytes, a power of two not above its own."""
    while len(x) > size:
        x = _packed(((x & 15) + (x >> 4)) & 15)
    return x


def apart(x: bytes, y: bytes) -> int:
    """No fewer tokens than this are in just one of two sets with these signatures."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    n = min(len(a), len(b))
    return int(_APART[folded(a, n), folded(b, n)].sum(dtype=np.int64))


def overlap_needed(a, b, percent: int):
    """The least intersection of sets of these sizes with similarity of percent or more."""
    return -(-percent * (a + b) // (100 + percent))


class Entries:
    """Columns of a stretch of the index, sorted by cell: sid, size, pos, root, role and signature of each entry, and
    `often`: of entries under a pair of frequent tokens the places in the class of all frequent tokens of the set's
    prefix, in ascending order (bytes of int32), else None; key: the pair, as places in the class."""

    def __init__(self, cell, sid, size, pos, root, role, sig, key=None, often=None):
        self.cell, self.sid, self.size, self.pos, self.root, self.role, self.key, self.often = cell, sid, size, pos, root, role, key, often
        self.sig, self.words = sig, np.ascontiguousarray(sig).view(np.uint64)

    def likely(self, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Pairs (a, b) of sids, a < b, of those entries that are of two components and may be similar.

        A pair is looked at as if the key were its first common one: nothing before it is shared, and no more after it
        than the shorter rest. At the first common key this is true, so a similar pair passes there. Under pairs of
        frequent tokens, of which copies share many, it passes at the first common pair only.
        """
        m, n = self.size[i], self.size[j]
        ok = (self.root[i] != self.root[j]) & (np.minimum(m, n) * 100 >= np.maximum(m, n) * percent)
        ok &= np.minimum(m - self.pos[i], n - self.pos[j]) >= overlap_needed(m, n, percent)
        i, j = i[ok], j[ok]
        alone = self.size[i] + self.size[j]
        alone -= 2 * overlap_needed(alone, 0, percent)  # the most tokens that just one of them may have
        ok = np.bitwise_count((self.words[i] ^ self.words[j]) & _LOWEST_BITS).sum(axis=1, dtype=np.int64) <= alone
        i, j, alone = i[ok], j[ok], alone[ok]
        ok = np.ones(len(i), bool)
        for k in range(0, len(i), BLOCK_SUMS):
            block = slice(k, k + BLOCK_SUMS)
            ok[block] = _APART[self.sig[i[block]], self.sig[j[block]]].sum(axis=1, dtype=np.int64) <= alone[block]
        i, j = i[ok], j[ok]
        if self.often is not None and len(i):
            ok = self.first_shared(i, j)
            i, j = i[ok], j[ok]
        a, b = self.sid[i], self.sid[j]
        return np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1)

    def first_shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """False where the two sets of a pair share an earlier pair of frequent tokens than the one they meet under."""
        out = np.ones(len(i), bool)
        under = np.flatnonzero(np.array([self.often[k] is not None for k in i.tolist()], bool))
        if not len(under):
            return out
        rows, at = np.unique(np.concatenate((i[under], j[under])), return_inverse=True)
        lists = [np.frombuffer(self.often[k], np.int32) for k in rows.tolist()]
        wide = max(map(len, lists))
        padded = np.full((len(rows), wide), -1, np.int32)
        for row, x in zip(padded, lists, strict=True):
            row[: len(x)] = x
        x, y = at[: len(under)], at[len(under) :]
        step = max(1, (1 << 22) // (wide * wide))
        for k in range(0, len(under), step):
            left, right = padded[x[k : k + step]], padded[y[k : k + step]]
            both = (left[:, :, None] == right[:, None, :]).any(axis=2) & (left >= 0)
            order = np.cumsum(both, axis=1)
            first = np.where(both & (order == 1), left, 0).sum(axis=1, dtype=np.int64)
            second = np.where(both & (order == 2), left, 0).sum(axis=1, dtype=np.int64)
            out[under[k : k + step]] = (first << 32 | second) == self.key[i[under[k : k + step]]]
        return out

    def pairs(self, percent: int) -> Iterator[np.ndarray]:
        """Likely pairs of the whole cells that are held here, block by block.

        Entries of role 0 meet all others of their cell; of a cell that was split, entries of role 2 meet those of role 1.
        """
        total = len(self.cell)
        if not total:
            return
        starts = np.flatnonzero(np.concatenate(([True], self.cell[1:] != self.cell[:-1])))
        sizes = np.diff(np.append(starts, total))
        mixed = np.minimum.reduceat(self.root, starts) != np.maximum.reduceat(self.root, starts)
        whole = np.maximum.reduceat(self.role, starts) == 0
        together = mixed & whole & (sizes <= SMALL)
        i = np.flatnonzero(np.repeat(together, sizes))
        off = 1
        while len(i):
            i = i[i + off < total]
            i = i[self.cell[i] == self.cell[i + off]]
            for at in range(0, len(i), BLOCK_PAIRS):
                part = i[at : at + BLOCK_PAIRS]
                yield self.likely(part, part + off, percent)
            off += 1
        for start, size in zip(starts[mixed & ~together].tolist(), sizes[mixed & ~together].tolist(), strict=True):
            at = np.arange(start, start + size)
            if self.role[start : start + size].any():
                rest, facing = at[self.role[at] == 2], at[self.role[at] == 1]
                several = True
            else:  # each entry outside the largest component meets all others
                roots, counts = np.unique(self.root[at], return_counts=True)
                rest, facing = at[self.root[at] != roots[counts.argmax()]], at
                several = False
            step = max(1, BLOCK_PAIRS // max(1, len(facing)))
            inside = np.isin(facing, rest)
            for k in range(0, len(rest), step):
                some = rest[k : k + step]
                x, y = np.repeat(some, len(facing)), np.tile(facing, len(some))
                if not several:
                    ok = ~np.tile(inside, len(some)) | (x < y)
                    x, y = x[ok], y[ok]
                yield self.likely(x, y, percent)
