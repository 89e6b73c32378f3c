"""Token ids of whole texts, on arrays.

For byte-pair vocabularies of the kind "words end in </w>, white space is dropped,
letters | one digit | other characters are words of their own".  A text's
ids are those of its words one after another, as no token, composition or added token
reaches across white space.  Words are found, hashed and made distinct by
array operations; merges run on all distinct words of a batch at once, a
round per rank level.  What arrays do not settle is left to the tokenizer
itself, a white-space word at a time: apostrophes, control characters, ``<|``,
and anything but ASCII and the Latin-1 letters.
"""

from __future__ import annotations

import json

import numpy as np

from isotherm.llm.chunks import U64, Rolling, mix

SPACE, LETTER, DIGIT, OTHER, ODD = range(5)
NONE = np.int64(1 << 40)


def byte_names() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names, shifted = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in names:
            names[b] = chr(0x100 + shifted)
            shifted += 1
    return [names[b] for b in range(256)]


def byte_classes() -> np.ndarray:
    c = np.full(256, ODD, dtype=np.uint8)
    c[0x21:0x7F] = OTHER
    c[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = SPACE
    c[ord("a") : ord("z") + 1] = c[ord("A") : ord("Z") + 1] = LETTER
    c[ord("0") : ord("9") + 1] = DIGIT
    c[ord("'")] = ODD
    return c


class PairTable:
    """Rank and result of merging two symbols, by open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, result: np.ndarray, bits: int = 18):
        self.mask = U64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.rank = np.full(1 << bits, NONE, dtype=np.int64)
        self.result = np.zeros(1 << bits, dtype=np.int64)
        code = left << 20 | right
        todo = np.arange(len(code))
        at = self.slot(code)
        self.probes = 0
        while len(todo):
            free = self.keys[at] == -1
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            won = np.zeros(len(at), dtype=bool)
            won[first] = True
            won &= free
            self.keys[at[won]], self.rank[at[won]], self.result[at[won]] = code[todo[won]], todo[won], result[todo[won]]
            todo, at = todo[~won], (at[~won] + 1) & int(self.mask)
            self.probes += 1

    def slot(self, code: np.ndarray) -> np.ndarray:
        return (mix(code.astype(np.uint64)) & self.mask).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if there is no such merge) and slot."""
        code = left << 20 | right
        at = self.slot(code)
        keys = self.keys[at]
        rank = np.where(keys == code, self.rank[at], NONE)
        open_ = np.flatnonzero((keys != code) & (keys != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & int(self.mask)
            keys = self.keys[at[open_]]
            hit = keys == code[open_]
            rank[open_[hit]] = self.rank[at[open_[hit]]]
            open_ = open_[~hit & (keys != -1)]
        return rank, at


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(self.tokenizer.to_str())["model"]
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pairs = PairTable(*(np.array(x, dtype=np.int64) for x in zip(*[(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs], strict=True)))
        names = byte_names()
        self.inner = np.array([vocabulary[n] for n in names], dtype=np.int64)
        self.last = np.array([vocabulary[n + end] for n in names], dtype=np.int64)
        self.classes = byte_classes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        raw = b"\n".join(parts)
        if not raw:
            return [b""] * len(texts)
        ends = np.cumsum([len(x) + 1 for x in parts])
        data = np.frombuffer(raw.lower(), dtype=np.uint8).copy()
        cls = self.classes[data]
        # Latin-1 letters: C3 and a byte; capitals become small
        lead = np.flatnonzero(data[:-1] == 0xC3)
        low = data[lead + 1]
        lead = lead[(low != 0x97) & (low != 0xB7)]
        cls[lead] = cls[lead + 1] = LETTER
        capital = lead[data[lead + 1] < 0x9F]
        data[capital + 1] += 0x20
        bar = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
        cls[bar] = ODD

        filled = cls != SPACE
        edge = np.flatnonzero(np.diff(np.concatenate([[False], filled, [False]])))
        start, stop = edge[::2], edge[1::2]
        if not len(start):
            return [b""] * len(texts)
        # reduceat runs on to the next word, over white space alone
        odd_word = np.add.reduceat(cls == ODD, start, dtype=np.int64) > 0
        begins = filled & (cls == DIGIT)
        begins[1:] |= filled[1:] & (cls[1:] != cls[:-1])
        begins[0] |= filled[0]
        if odd_word.any():
            for s, e in zip(start[odd_word], stop[odd_word], strict=True):
                begins[s + 1 : e] = False
        unit = np.flatnonzero(begins)
        word = np.searchsorted(start, unit, side="right") - 1
        until = np.minimum(np.concatenate([unit[1:], [len(data)]]), stop[word])
        odd = odd_word[word]

        # distinct words and their ids
        plain = ~odd
        _, first, kind = np.unique(Rolling(data).of(unit[plain], until[plain]), return_index=True, return_inverse=True)
        counts, ids = self.merge(data, unit[plain][first], until[plain][first])
        which = np.zeros(len(unit), dtype=np.int64)
        which[plain] = kind
        if odd.any():
            strange: dict[bytes, int] = {}
            which[odd] = [strange.setdefault(raw[s:e], len(strange)) + len(counts) for s, e in zip(unit[odd], until[odd], strict=True)]
            more = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in strange], add_special_tokens=False)
            counts = np.concatenate([counts, [len(e.ids) for e in more]]).astype(np.int64)
            ids = np.concatenate([ids, *[np.array(e.ids, dtype=np.int64) for e in more]])
        # spread to all words, and cut by text
        at = np.cumsum(counts) - counts
        n = counts[which]
        total = np.cumsum(n)
        flat = ids[np.arange(total[-1]) - np.repeat(total - n, n) + np.repeat(at[which], n)].astype("<u4")
        upto = np.concatenate([[0], total])[np.searchsorted(unit, ends, side="left")]
        out, last = [], 0
        for u in upto:
            out.append(flat[last:u].tobytes())
            last = u
        return out

    def merge(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and all ids in order."""
        size = stop - start
        if not len(size):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        owner = np.repeat(np.arange(len(size)), size)
        position = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
        symbol = self.inner[data[position]]
        tail = np.cumsum(size) - 1
        symbol[tail] = self.last[data[stop - 1]]
        owners, symbols = [], []
        while len(symbol):
            inside = owner[1:] == owner[:-1]
            rank = np.full(len(symbol), NONE, dtype=np.int64)
            slot = np.zeros(len(symbol), dtype=np.int64)
            pair = np.flatnonzero(inside)
            rank[pair], slot[pair] = self.pairs.find(symbol[pair], symbol[pair + 1])
            first = np.flatnonzero(np.concatenate([[True], ~inside]))
            best = np.minimum.reduceat(rank, first)
            group = np.cumsum(np.concatenate([[True], ~inside])) - 1
            done = (best == NONE)[group]
            owners.append(owner[done])
            symbols.append(symbol[done])
            chosen = (rank == best[group]) & ~done
            # of overlapping equal pairs the first, the third, ...
            at = np.flatnonzero(chosen)
            if len(at) > 1:
                new = np.concatenate([[True], np.diff(at) > 1])
                run = np.flatnonzero(new)
                odd = (np.arange(len(at)) - run[np.cumsum(new) - 1]) % 2 == 1
                at = at[~odd]
            symbol[at] = self.pairs.result[slot[at]]
            keep = ~done
            keep[at + 1] = False
            owner, symbol = owner[keep], symbol[keep]
        owner, symbol = np.concatenate(owners), np.concatenate(symbols)
        order = np.argsort(owner, kind="stable")
        return np.bincount(owner, minlength=len(size)), symbol[order]
