"""Words of texts and their hashes: runs of characters other than ASCII white space, A to Z in lower case."""

from __future__ import annotations

import numpy as np
import xxhash

MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of a batch of texts, and which text it belongs to."""
    split = [(t or "").encode().lower().split() for t in texts]  # bytes: only A-Z change, only ASCII white space splits
    known = {w: xxhash.xxh3_64_intdigest(w) for w in {w for ws in split for w in ws}}
    n = [len(ws) for ws in split]
    hashes = np.fromiter((known[w] for ws in split for w in ws), np.uint64, sum(n))
    return hashes, np.repeat(np.arange(len(texts)), n)


def ngram_hashes(words: np.ndarray, of: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 to order: places where an n-gram within one text ends, and its hash."""
    out, places, hashes = [], np.arange(len(words)), words ^ MIX
    for n in range(1, order + 1):
        if n > 1:
            # the n-gram that ends here is the (n-1)-gram that ends one word before, and this word
            longer = np.flatnonzero((places[1:] == places[:-1] + 1) & (of[places[1:]] == of[places[:-1]]))
            mixed = (hashes[longer] ^ hashes[longer] >> np.uint64(29)) * MIX + words[places[longer + 1]] * np.uint64(2 * n + 1)
            places, hashes = places[longer + 1], mixed ^ mixed >> np.uint64(32)
        out.append((places, hashes))
    return out


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Rising distinct hashes of the ``size``-word shingles of each text; of fewer words the whole sequence is one."""
    words, of = word_hashes(texts)
    grams = ngram_hashes(words, of, size)
    n = np.bincount(of, minlength=len(texts))
    places, hashes = grams[-1]
    order = np.lexsort((hashes, of[places]))
    owner, hashes = of[places][order], hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    owner, hashes = owner[new], hashes[new]
    out = np.split(hashes, np.searchsorted(owner, np.arange(1, len(texts))))
    ends = np.cumsum(n) - 1
    for i in np.flatnonzero((n > 0) & (n < size)):
        places, hashes = grams[n[i] - 1]
        out[i] = hashes[np.searchsorted(places, ends[i]) :][:1]
    return out
