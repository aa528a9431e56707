"""Locally consistent parsing by recompression, on arrays: runs, then pairs, round after round.

The name of a word is the XXH64 of its bytes; the name of a run is made from its symbol and length,
the name of a pair from its two symbols. Names are thus the same in every task of a job, and equal
stretches of text get equal symbols except near their ends. How near is tracked: every symbol has an
extent, the words that decide that it stands there. Where the words of an extent stand again, so does the symbol.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import xxhash

from .common import Powers, mix, range_hash

ROUNDS = 3
# one in so many symbols is used, chosen by name and so alike everywhere
THIN = 2
KNOWN_WORDS = 1 << 18
_EXTENT = Powers(0xD6E8FEB86659FD93)
_RUN, _PAIR, _SIDE = np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3)


@dataclass
class Symbols:
    """Symbols of some rows in order: row, name in its extent's words, extent (end exclusive)."""

    row: np.ndarray
    name: np.ndarray
    begin: np.ndarray
    end: np.ndarray


class _Names(dict):
    """Names of words met in this task."""

    def __missing__(self, word: bytes) -> int:
        self[word] = name = xxhash.xxh64_intdigest(word)
        return name


_names = _Names()


def words_of(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """(words, first, names) of some rows: words by row, the index of a row's first word, and all words' names."""
    if len(_names) > KNOWN_WORDS:
        _names.clear()
    words = [t.split() for t in texts]  # splits at ASCII white space
    first = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
    names = np.fromiter((n for w in words for n in map(_names.__getitem__, w)), np.uint64, int(first[-1]))
    return words, first, names


def digests(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64 bits, 48 bits) of the BLAKE2b digest of each run of words joined by blanks: equal only where the words are."""
    raw = b"".join([hashlib.blake2b(r, digest_size=16).digest() for r in runs])
    both = np.frombuffer(raw, np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), (both[:, 1] >> np.uint64(16)).astype(np.int64)


def parse(words: np.ndarray, first: np.ndarray, width: int, rounds: int = ROUNDS, thin: int = THIN) -> Symbols:
    """Symbols after ``rounds`` of run and pair naming, for rows of words given by their hashes.

    Those whose extent fits into ``width`` words of their row, one in ``thin``. Their names take in the words
    of the extent, which tells more places apart than the symbol alone.
    """
    n = len(words)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    sym, lo = words.copy(), np.arange(n)
    hi, a, z = lo + 1, lo.copy(), lo + 1
    for k in range(rounds):
        if not len(sym):
            break
        # runs of one symbol become one
        joins = (sym[1:] == sym[:-1]) & (row[1:] == row[:-1])
        if joins.any():
            head = np.flatnonzero(np.concatenate(([True], ~joins)))
            size = np.diff(head, append=len(sym))
            name = np.where(size > 1, mix(sym[head] * _RUN + size.astype(np.uint64)), sym[head])
            a, z = np.minimum.reduceat(a, head), np.maximum.reduceat(z, head)
            sym, lo, hi, row = name, lo[head], hi[head + size - 1], row[head]
        # that a run ends here is decided by the next word if it differs from the run's own first
        # (last) word, else by the next symbol; at a row's end by what is not there
        near_a, near_z = np.minimum(a, lo - 1), np.maximum(z, hi + 1)
        follows = row[1:] == row[:-1]
        left = np.flatnonzero(follows & (words[lo[1:] - 1] == words[hi[1:] - 1])) + 1
        right = np.flatnonzero(follows & (words[np.minimum(hi[:-1], n - 1)] == words[lo[:-1]]))
        near_a[left] = np.minimum(near_a[left], a[left - 1])
        near_z[left] = np.maximum(near_z[left], z[left - 1])
        near_z[right] = np.maximum(near_z[right], z[right + 1])
        near_a[right] = np.minimum(near_a[right], a[right + 1])
        a, z = near_a, near_z
        # a symbol of the left side and one of the right side after it become a pair, whatever stands around
        on_left = (mix(sym ^ mix(np.array([k], np.uint64) + _SIDE)) & np.uint64(1)).astype(bool)
        pair = np.zeros(len(sym), bool)
        pair[:-1] = on_left[:-1] & ~on_left[1:] & follows
        second = np.zeros(len(sym), bool)
        second[1:] = pair[:-1]
        # one that stays alone does so because of its neighbour
        i = np.flatnonzero(on_left[:-1] & ~pair[:-1] & follows)
        j = np.flatnonzero(~on_left[1:] & ~second[1:] & follows) + 1
        p = np.flatnonzero(pair)
        na, nz = a.copy(), z.copy()
        for at, other in ((i, i + 1), (j, j - 1), (p, p + 1)):
            na[at] = np.minimum(a[at], a[other])
            nz[at] = np.maximum(z[at], z[other])
        sym[p] = mix(sym[p] * _PAIR + mix(sym[p + 1]))
        hi[p] = hi[p + 1]
        keep = ~second
        sym, lo, hi, a, z, row = sym[keep], lo[keep], hi[keep], na[keep], nz[keep], row[keep]
    fits = (z - a <= width) & (a >= first[row]) & (z <= first[row + 1])
    row, a, z, sym = row[fits], a[fits], z[fits], sym[fits]
    name = mix(range_hash(words, a, z, _EXTENT) ^ sym)
    some = name % np.uint64(thin) == 0
    return Symbols(row[some], name[some], a[some], z[some])


def window_digests(words: list[list[bytes]], first: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the ``width`` words from each of ``at``, ascending indexes over all rows."""
    runs: list[bytes] = []
    cut = np.searchsorted(at, first)
    for r in np.flatnonzero(np.diff(cut)):
        text = b" ".join(words[r])
        stop = np.cumsum([len(w) + 1 for w in words[r]])
        begin = at[cut[r] : cut[r + 1]] - first[r]
        starts = np.concatenate(([0], stop))[begin].tolist()
        runs += [text[a:b] for a, b in zip(starts, (stop[begin + width - 1] - 1).tolist())]
    return digests(runs)


def possible(symbols: Symbols, shared: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Start words of the windows that hold no extent of a symbol that stands nowhere else."""
    n = int(first[-1])
    change = np.zeros(n + 2, np.int64)
    # the windows around an extent start between its end less the width and its begin
    lone = ~shared
    change += np.bincount(np.maximum(symbols.end[lone] - width, 0), minlength=n + 2)
    change -= np.bincount(symbols.begin[lone] + 1, minlength=n + 2)
    free = np.cumsum(change)[:n] == 0
    room = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    return np.flatnonzero(free & (room >= width))
