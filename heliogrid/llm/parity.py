"""Parity sketches of token sets, and the pigeonhole keys that find similar sets.

The sketch of a set has one bit per residue of its tokens' hashes: the parity of how many
tokens fall on it.  The Hamming distance of two sketches is at most the size of the
symmetric difference, because every token in both sets cancels.  The same holds for a
sketch cut into blocks: at most as many blocks differ as there are tokens in only one set.

Let similar mean intersection >= num/den * union.  Then the symmetric difference of sets
of sizes a and b is at most (a + b) * (den - num) / (den + num).  So of any D + 1 blocks,
D being that bound, one is equal in both.  Blocks that hold no token are equal by chance
and say nothing; a set therefore gives out its blocks in order until D + 1 of them hold a
token.  Of two similar sets, take the one that stops first: all its non-empty blocks are
also given out by the other, and one of them is equal.  A set that runs out of blocks
gives out its single tokens as well, so two such sets meet on a shared token.  No pair of
similar sets is missed.

Blocks are kept at full width: a block's sketch is the XOR of its tokens' 64-bit hashes.

A set gives out EXTRA more non-empty blocks than that, so that two similar sets, unless both
run out, have EXTRA + 1 keys in common in one band.  A key that very many sets share, as a
passage does that stands in many documents, can then be passed over: of the frequent keys
that a set has in a band it may forget the EXTRA most frequent, as the rarest of EXTRA + 1
common ones is among these for neither set.  A key says in its lowest bits which band it is
of (BAND_BITS) and whether its set ran out (SHORT), in which case it may forget none.

How many blocks a set is cut into depends on its size band alone.  Bands grow by less
than den/num, so sets in one band or in neighbouring ones are compared: each set gives
out keys for its own band, and for the next one if a partner there is possible.
"""

from __future__ import annotations

import numpy as np

from .textblocks import U64, mix

SKETCH_WORDS = 16  # of 64 bits
EXTRA = 8
SHORT = 1
BAND_BITS = 7
_LOW = U64((1 << BAND_BITS + 1) - 1)


class Bands:
    """Size bands and the number of blocks in each, for the similarity num/den."""

    def __init__(self, num: int = 80, den: int = 100, growth: float = 1.25, slack: float = 1.1, largest: int = 1 << 40):
        self.num, self.den = num, den
        edges = [1]
        while edges[-1] < largest:
            edges.append(max(edges[-1] + 1, int(edges[-1] * growth)))
        self.edges = np.array(edges, np.int64)  # band i holds the sizes edges[i] <= n < edges[i + 1]
        self.blocks = ((2 * (self.edges[1:] - 1) * (den - num) // (den + num) + 1 + EXTRA) * slack).astype(np.int64) + 2

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, n, "right") - 1

    def bound(self, n: np.ndarray, partner: np.ndarray) -> np.ndarray:
        return (n + partner) * (self.den - self.num) // (self.den + self.num)

    def roles(self, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(sets, band, D) for each band that sets of sizes n take part in."""
        band = self.of(n)
        most = n * self.den // self.num
        out, up = [], 0
        at = np.arange(len(n))
        while len(at):
            top = self.edges[band[at] + up + 1] - 1
            out.append((at, band[at] + up, self.bound(n[at], np.minimum(most[at], top))))
            at = at[most[at] > top]
            up += 1
        return out


def distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (token, set) pairs, ordered by set; doc is ascending."""
    key = mix(h + doc.astype(U64) * U64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    keep = np.sort(order[new])
    return h[keep], doc[keep]


def sketches(h: np.ndarray, doc: np.ndarray, n_sets: int, words: int = SKETCH_WORDS) -> np.ndarray:
    """Bit sketches, n_sets x words of 64 bits."""
    bits = words * 64
    flat = doc * bits + (h % U64(bits)).astype(np.int64)
    odd = (np.bincount(flat, minlength=n_sets * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n_sets, bits), axis=1).view(U64)


def keys(h: np.ndarray, doc: np.ndarray, n: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """The pigeonhole keys of all sets (tokens h of sets doc, of sizes n), and each key's set."""
    out_key, out_set = [], []
    first = np.cumsum(n) - n
    for sets, band, most in bands.roles(n):
        some = n[sets] > 0
        sets, band, most = sets[some], band[some], most[some]
        if not len(sets):
            continue
        blocks = bands.blocks[band]
        start = np.cumsum(blocks) - blocks
        at = np.repeat(np.arange(len(sets)), n[sets])
        token = np.arange(len(at)) - np.repeat(np.cumsum(n[sets]) - n[sets], n[sets]) + first[sets][at]
        block = ((h[token] >> U64(32)) * blocks[at].astype(U64) >> U64(32)).astype(np.int64)
        flat = start[at] + block
        total = int(blocks.sum())
        parity = np.zeros(total, U64)
        np.bitwise_xor.at(parity, flat, h[token])
        filled = np.bincount(flat, minlength=total) > 0
        owner = np.repeat(np.arange(len(sets)), blocks)
        rank = np.cumsum(filled)
        rank -= np.concatenate([[0], rank])[start][owner]
        give = filled & (rank <= most[owner] + 1 + EXTRA)
        salt = mix((band[owner[give]] * (1 << 40) + np.flatnonzero(give) - start[owner[give]]).astype(U64))
        short = np.add.reduceat(filled.astype(np.int64), start) < most + 1 + EXTRA
        low = (band.astype(U64) << U64(1)) & _LOW | short.astype(U64)
        out_key.append(mix(parity[give] ^ salt) & ~_LOW | low[owner[give]])
        out_set.append(sets[owner[give]])
        alone = short[at]
        out_key.append(mix(h[token[alone]] ^ mix((band[at[alone]] + (1 << 62)).astype(U64))) & ~_LOW | low[at[alone]])
        out_set.append(sets[at[alone]])
    if not out_key:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(out_key), np.concatenate(out_set)
