"""Words, lower-cased in A-Z only, and hashed shingles of whole texts."""

from __future__ import annotations

import numpy as np

from isotherm.llm.chunks import U64, Rolling, mix, unpack

#: space and \x09-\x0D separate words
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_table(lens: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Document number and hash of every word of a chunk."""
    # a separator before each document keeps words within it
    ends = np.cumsum(lens)
    raw = np.frombuffer(data.lower(), dtype=np.uint8)  # bytes.lower() changes A-Z alone
    if not len(raw):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    space = SPACES[raw]
    starts_word = ~space
    starts_word[1:] &= space[:-1]
    inner = ends[:-1][(ends[:-1] > 0) & (ends[:-1] < len(raw))]
    starts_word[inner] |= ~space[inner]
    start = np.flatnonzero(starts_word)
    ends_word = ~space
    ends_word[:-1] &= space[1:]
    ends_word[inner - 1] |= ~space[inner - 1]
    end = np.flatnonzero(ends_word) + 1
    return np.searchsorted(ends, start, side="right"), Rolling(raw).of(start, end)


def shingles(doc: np.ndarray, word: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Document number and hash of each run of ``width`` words; a shorter text is one shingle of all its words."""
    n = len(word)
    if not n:
        return doc, word
    h = np.zeros(max(0, n - width + 1), dtype=np.uint64)
    for i in range(width):
        h = mix(h + word[i : n - width + 1 + i]) if n >= width else h
    at = doc[: len(h)]
    within = at == doc[width - 1 :] if n >= width else np.zeros(0, dtype=bool)
    at, h = at[within], h[within]
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    size = np.diff(np.concatenate([first, [n]]))
    short = size < width
    extra = []
    for s, k in zip(first[short], size[short], strict=True):
        x = np.full(1, k, dtype=np.uint64)
        for w in word[s : s + k]:
            x = mix(x + w)
        extra.append(x[0])
    return np.concatenate([at, doc[first[short]]]), np.concatenate([h, np.array(extra, dtype=np.uint64)])


def shingle_sets(lens: bytes, data: bytes, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of documents, and document number and hash of their distinct shingles, sorted by both."""
    n, raw = unpack(lens, data)
    doc, h = shingles(*word_table(n, raw), width)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if len(h):
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])
        doc, h = doc[new], h[new]
    return len(n), doc, h


def set_digests(n_docs: int, doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set sizes and 128 bits of digest of each document's set."""
    sizes = np.bincount(doc, minlength=n_docs).astype(np.int64)
    out = []
    for salt in (U64(0x632BE59BD9B4E019), U64(0xE220A8397B1DCDAF)):
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(h ^ salt))])
        at = np.concatenate([[0], np.cumsum(sizes)])
        out.append(mix(sums[at[1:]] - sums[at[:-1]] + sizes.astype(np.uint64)).view(np.int64))
    return sizes, out[0], out[1]
