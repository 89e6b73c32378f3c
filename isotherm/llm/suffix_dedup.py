"""Removal of repeated byte strings by sampled, distributed prefix doubling.

A byte goes if a string of ``length`` bytes covers it that also starts at
another position of the corpus.  Prefix doubling ranks positions by growing
prefixes and drops a position once its rank is unique or the threshold is
passed.  Two things keep the sorted pairs small:

* Sampling.  Of the ``length - k + 1`` k-byte prefixes within a window of
  ``length`` bytes the least (leftmost of equals) stands for the window.  Equal
  windows choose the same relative place, so it is enough to rank the chosen
  positions, about 2 / (length - k + 2) of all.
* Names instead of dense ranks.  A rank is a 64-bit fingerprint of the prefix,
  which needs no second sort to be looked up at a further offset.

Round 1 ranks the chosen positions at k bytes; a unique one ends all windows
that chose it.  Round 2 ranks the survivors by their whole reach (all windows
that chose the position, ``length`` to ``2 length - k`` bytes): a repeated reach
settles all its windows at once, one copy of it staying as a witness.  Round 3
ranks single windows at the full ``length`` where several reaches meet on
one k-byte prefix.  Rounds 1 and 2 share one shuffle.

Texts are whole; null is empty; matches never cross documents; rows that repeat
a ``doc_id`` are documents of their own.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from isotherm.llm.chunks import CHUNK_BYTES, U64, Rolling, answer, ask, ask_rows, build_chunks, flags_of, mix, ranges_for, unpack, with_answers
from isotherm.llm.store import stage

K = 50
FULL, SHOW = 1, 2


class Anchors:
    """The chosen positions of a chunk."""

    def __init__(self, lens: np.ndarray, raw: bytes, length: int, k: int):
        data = np.frombuffer(raw, dtype=np.uint8)
        self.roll = Rolling(data)
        w = length - k + 1
        n = len(data)
        ends = np.cumsum(lens)
        starts = ends - lens
        room = np.maximum(0, lens - length + 1)
        total = int(room.sum())
        if not total:
            self.at = self.low = self.high = np.zeros(0, dtype=np.int64)
            self.key = self.reach = np.zeros(0, dtype=np.uint64)
            return
        # the least k-gram of every window, and where: hash above, position below
        bits = U64(max(1, n).bit_length())
        grams = self.roll.every(k)
        least = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
        span = 1
        while span * 2 <= w:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < w:
            least = np.minimum(least[: len(least) - (w - span)], least[w - span :])
        owner = np.repeat(np.arange(len(lens)), room)
        p = np.arange(total) - np.repeat(np.cumsum(room) - room, room) + starts[owner]
        chosen = (least[p] & ((U64(1) << bits) - U64(1))).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])]))
        self.at = chosen[new]
        self.low = p[new]
        self.high = p[np.concatenate([new[1:] - 1, [total - 1]])]
        self.key = mix(grams[self.at])  # least hashes crowd near 0; the ranges want them even
        self.reach = mix(self.roll.of(self.low, self.high + length) ^ mix((self.at - self.low).astype(np.uint64)))

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order of the anchors by key and reach, starts of the distinct ones in it, and their counts."""
        order = np.lexsort((self.reach, self.key))
        k, r = self.key[order], self.reach[order]
        first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])])) if len(k) else np.zeros(0, dtype=np.int64)
        return order, first, np.diff(np.concatenate([first, [len(k)]]))


REACH = np.dtype([("reach", "<u8"), ("many", "u1")])


def _ask(length: int, k: int):
    def asked(row):
        a = Anchors(*unpack(row.lens, row.data), length, k)
        order, first, count = a.distinct()
        extra = np.zeros(len(first), dtype=REACH)
        extra["reach"], extra["many"] = a.reach[order[first]], count > 1
        return a.key[order[first]], extra

    return asked


def _answer(keys: list[np.ndarray], extra: list[bytes]) -> list[np.ndarray]:
    """FULL: this reach is repeated.  SHOW: several reaches meet on the key, and this is the witness of its reach."""
    key = np.concatenate(keys)
    more = np.concatenate([np.frombuffer(x, dtype=REACH) for x in extra])
    order = np.lexsort((more["reach"], key))
    k, r = key[order], more["reach"][order]
    new_key = np.concatenate([[True], k[1:] != k[:-1]])
    new = new_key | np.concatenate([[True], r[1:] != r[:-1]])
    group = np.cumsum(new) - 1
    count = np.bincount(group, weights=1 + more["many"][order])
    reaches = np.bincount(np.cumsum(new_key) - 1, weights=new)
    flags = np.zeros(len(key), dtype=np.uint8)
    flags[order] = FULL * (count[group] > 1) + SHOW * (new & (reaches[np.cumsum(new_key) - 1] > 1))
    return np.split(flags, np.cumsum([len(x) for x in keys])[:-1])


def _shown(a: Anchors, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors that show their windows, in the order of their keys; and windows of each: number and first start."""
    order, first, _ = a.distinct()
    own = order[first[(flags & SHOW) > 0]]
    return own, a.high[own] - a.low[own] + 1, a.low[own]


def _windows(own: np.ndarray, number: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    which = np.repeat(np.arange(len(own)), number)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(number) - number, number) + low[which]


def _ask_windows(length: int, k: int, n_ranges: int):
    """Per shown anchor its key, and as extra data the six-byte names of its windows by offset from the anchor."""

    def run(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = chunk.iloc[0]
        a = Anchors(*unpack(row.lens, row.data), length, k)
        own, number, low = _shown(a, flags_of(answers))
        which, start = _windows(own, number, low)
        names = a.roll.of(start, start + length).view(np.uint8).reshape(-1, 8)[:, :6].reshape(-1).tobytes()
        ends = np.cumsum(number)
        extra = np.empty(len(own), dtype=object)
        for i in range(len(own)):
            extra[i] = np.array([a.at[own[i]] - low[i], number[i]], dtype="<u2").tobytes() + names[6 * (ends[i] - number[i]) : 6 * ends[i]]
        keys = a.key[own]
        frame = ask_rows(row.chunk_id, keys, _Joined(extra), n_ranges)
        return frame

    return run


class _Joined:
    """Variable-length extra data, cut like an array."""

    def __init__(self, parts):
        self.parts = parts

    def __getitem__(self, s):
        return _Joined(self.parts[s])

    def tobytes(self):
        return b"".join(self.parts)


def _answer_windows(keys: list[np.ndarray], extra: list[bytes]) -> list[np.ndarray]:
    """For each window in order: is its name found under the same key and offset elsewhere?  As bits per row."""
    names, sizes = [], []
    for key, data in zip(keys, extra, strict=True):
        at, n = 0, 0
        for x in key:
            offset, number = np.frombuffer(data, dtype="<u2", count=2, offset=at).astype(np.int64)
            body = np.zeros((number, 8), dtype=np.uint8)
            body[:, :6] = np.frombuffer(data, dtype=np.uint8, count=6 * number, offset=at + 4).reshape(number, 6)
            place = mix(np.full(number, x, dtype=np.uint64) + (offset - np.arange(number)).astype(np.uint64) * U64(0x9E3779B97F4A7C15))
            names.append(mix(place ^ body.reshape(-1).view("<u8")))
            at, n = at + 4 + 6 * number, n + number
        sizes.append(n)
    flat = np.concatenate(names)
    order = np.argsort(flat, kind="stable")
    s = flat[order]
    same = s[1:] == s[:-1]
    again = np.zeros(len(flat), dtype=np.uint8)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    return [np.packbits(x) for x in np.split(again, np.cumsum(sizes)[:-1])]


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def _cut(length: int, k: int, n_ranges: int, texts: bool):
    def run(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = chunk.iloc[0]
        lens, raw = unpack(row.lens, row.data)
        a = Anchors(lens, raw, length, k)
        flags = flags_of(answers)
        order, first, count = a.distinct()
        whole = np.zeros(len(a.at), dtype=bool)
        whole[order] = np.repeat((flags & FULL) > 0, count)
        cover = np.zeros(len(raw) + 1, dtype=np.int32)
        np.add.at(cover, a.low[whole], 1)
        np.add.at(cover, a.high[whole] + length, -1)
        own, number, low = _shown(a, flags)
        if len(own):
            _, start = _windows(own, number, low)
            # bits were packed for each range on its own
            by = answers[answers["kind"] == 2].sort_values("r")
            bits = dict(zip(by["r"], by["flags"], strict=True))
            again = []
            r = (np.searchsorted(np.array([(i << 64) // n_ranges for i in range(1, n_ranges)], dtype=np.uint64), a.key[own], side="right"))
            for x in np.unique(r):
                again.append(np.unpackbits(np.frombuffer(bits[x], dtype=np.uint8), count=int(number[r == x].sum())))
            start = start[np.concatenate(again) > 0]
            np.add.at(cover, start, 1)
            np.add.at(cover, start + length, -1)
        gone = np.cumsum(cover[:-1]) > 0
        data = np.frombuffer(raw, dtype=np.uint8)
        ends = np.cumsum(lens)
        rows = []
        for i, (s, e) in enumerate(zip(ends - lens, ends, strict=True)):
            g = gone[s:e]
            n = int(g.sum())
            spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()) if n else 0
            kept = data[s:e][~g].tobytes() if n else raw[s:e]
            rows.append((row.ids[i], e - s, n, spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if texts else None))
        out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
        return out.astype({"doc_id": "Int64"})

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, k: int = K, texts: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, with ``texts``, ``kept``: the bytes left, as text.

    ``chunk_bytes``: text packed into one row; larger chunks ask in fewer rows and take more memory in a task.
    """
    chunks = build_chunks(docs, id_col, text_col, chunk_bytes)
    n_ranges = ranges_for(chunks)
    first = stage(answer(ask(chunks, _ask(length, k), n_ranges), _answer), "answers")
    shown = with_answers(chunks, first, _ask_windows(length, k, n_ranges), "r int, chunk_id long, keys binary, extra binary")
    second = answer(shown, _answer_windows, kind=2)
    return with_answers(chunks, first.unionByName(second), _cut(length, k, n_ranges, texts), RESULT).drop(*[] if texts else ["kept"])
