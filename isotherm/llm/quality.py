"""Quality rules: base counts, then line labelling by a linear-chain conditional random field.

Viterbi decoding marks each line as content or boilerplate; a text is kept if
its base counts pass and content lines hold at least ``SHARE`` of its words.

The field has one weight per (label, line feature) and per label pair.  It is
trained by maximum likelihood (forward-backward gradients) on a bounded sample of labelled texts
(``sampling``), in one task.  Only texts are labelled, so lines are labelled by constrained EM:

* a line of fewer than ``SHORT`` words that stands in ``COMMON`` or more groups of near copies in the sample is boilerplate (these lines
  are part of the model, and being one of them is a feature).  A text and its near copies (five-word shingles, similarity 0.8 or more)
  count once, so prose that was copied is not taken for boilerplate;
* other lines of a text of quality 1 are content;
* lines of a text of quality 0 are latent.  They start as boilerplate where their features are more usual
  in quality 0 than in quality 1; then, in turns, the field is fitted and they take its Viterbi labels, at least one
  of them boilerplate (the likeliest), until no label changes or ``TURNS`` are over.

So one text holds lines of both labels, and transitions are learnt.  All lines of a sampled text
count; sequences longer than ``SEGMENT`` lines are trained in segments and decoded whole.

Null texts have no words, fail the base rule, and are not kept.  Rows that repeat an id get rows of
their own; extra columns are ignored.  Without labels every line is content.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotherm.llm.sampling import labelled_sample

PER_CLASS = 600
SEGMENT = 256
SHORT, COMMON = 16, 3
TURNS = 6
SHARE = 0.5
#: fixed value: characters that count as symbols
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8
N_FEATURES = 16
RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_boilerplate long, content_share double"


# ---- base rules ----------------------------------------------------------------


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows of ``window`` words (a power of two) that are found twice or more; exact, by doubling ranks."""
    n = len(words)
    if n <= window:
        return 0
    number: dict[bytes, int] = {}
    rank = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    step = 1
    while step < window:
        _, rank = np.unique(rank[: len(rank) - step] * (n + 1) + rank[step:], return_inverse=True)
        step *= 2
    again = np.bincount(rank)[rank] > 1
    if not again.any():
        return 0
    cover = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(again)
    cover[:n] += np.bincount(at, minlength=n)
    cover -= np.bincount(at + window, minlength=n + 1)
    return int((np.cumsum(cover[:n]) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space alone
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(SPACES):
            seen.add(line)
    return len(words), chars, symbols, dup, repeated_words(words)


# ---- line features ---------------------------------------------------------------


def line_masks(text: str, common: frozenset[str] = frozenset()) -> tuple[list[int], list[int]]:
    """For each line with a word: its binary features as a bit mask, and its number of words; ``common``: lines known from many texts."""
    masks, sizes, seen = [], [], set()
    for line in text.split("\n"):
        words = line.split()
        n = len(words)
        if not n:
            continue
        chars = len(line)
        symbols = sum(map(line.count, SYMBOLS))
        mask = 1
        mask |= 2 if n < 4 else 4 if n < 10 else 8 if n < 30 else 32768
        if symbols * 10 > chars:
            mask |= 16
        elif symbols:
            mask |= 32
        if line in seen:
            mask |= 64
        if line.rstrip()[-1] in ".!?:;":
            mask |= 128
        if line.count("!!") * 3 > n:
            mask |= 256
        if line.isupper() and n > 1:
            mask |= 512
        if n >= 8 and len(set(words)) * 2 < n:
            mask |= 1024
        if chars > 12 * n:
            mask |= 2048
        if line in common:
            mask |= 16384
        seen.add(line)
        masks.append(mask)
        sizes.append(n)
    if len(masks) > 3:  # in a shorter text a place says little
        masks[0] |= 4096
        masks[-1] |= 8192
    return masks, sizes


BITS = (np.arange(1 << N_FEATURES)[:, None] >> np.arange(N_FEATURES)) & 1


# ---- the field -------------------------------------------------------------------


#: emission weights, transition weights, and the common lines
Model = tuple[np.ndarray, np.ndarray, frozenset[str]]


def fit(sequences: list[list[int]], labels: list[list[int]], start: tuple[np.ndarray, np.ndarray] | None = None, rounds: int = 150, penalty: float = 1e-3, stay: float = 3e-2) -> tuple[np.ndarray, np.ndarray]:
    """Emission weights (feature, label) and transition weights (label, label), from ``start`` on.

    ``penalty`` and ``stay`` are their L2 penalties; a strong one on transitions keeps a plain line among marked ones content.
    """
    cut = [(s[i : i + SEGMENT], y[i : i + SEGMENT]) for s, y in zip(sequences, labels, strict=True) for i in range(0, len(s), SEGMENT)]
    if not cut:
        return np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    n, length = len(cut), max(len(s) for s, _ in cut)
    mask = np.zeros((length, n), dtype=np.int64)
    gold = np.zeros((length, n), dtype=np.int64)
    real = np.zeros((length, n), dtype=bool)
    for j, (s, y) in enumerate(cut):
        mask[: len(s), j], gold[: len(s), j], real[: len(s), j] = s, y, True
    total = real.sum()
    one = np.stack([gold == 0, gold == 1], axis=-1) & real[..., None]
    counts = np.stack([np.bincount(mask[real], weights=one[real][:, k], minlength=len(BITS)) for k in (0, 1)], axis=1)
    gold_e = BITS.T @ counts
    both = real[1:] & real[:-1]
    gold_t = np.bincount((gold[:-1] * 2 + gold[1:])[both], minlength=4).reshape(2, 2).astype(float)
    we, wt = (x.copy() for x in start) if start else (np.zeros((N_FEATURES, 2)), np.zeros((2, 2)))
    me, ve, mt, vt = np.zeros_like(we), np.zeros_like(we), np.zeros_like(wt), np.zeros_like(wt)
    for r in range(1, rounds + 1):
        e = (BITS @ we)[mask]
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[0] = e[0]
        for t in range(1, length):
            x = np.logaddexp(a[t - 1, :, 0, None] + wt[0], a[t - 1, :, 1, None] + wt[1]) + e[t]
            a[t] = np.where(real[t][:, None], x, a[t - 1])
        for t in range(length - 2, -1, -1):
            x = e[t + 1] + b[t + 1]
            y = np.logaddexp(x[:, 0, None] + wt[:, 0], x[:, 1, None] + wt[:, 1])
            b[t] = np.where(real[t + 1][:, None], y, 0)
        z = np.logaddexp(a[-1, :, 0], a[-1, :, 1])
        p = np.exp(np.minimum(a + b - z[:, None], 0)) * real[..., None]
        counts = np.stack([np.bincount(mask[real], weights=p[real][:, k], minlength=len(BITS)) for k in (0, 1)], axis=1)
        pair = np.exp(np.minimum(a[:-1, :, :, None] + wt + (e[1:] + b[1:])[:, :, None, :] - z[:, None, None], 0)) * both[..., None, None]
        ge = (gold_e - BITS.T @ counts) / total - penalty * we
        gt = (gold_t - pair.sum((0, 1))) / total - stay * wt
        me, ve = 0.9 * me + 0.1 * ge, 0.99 * ve + 0.01 * ge**2
        mt, vt = 0.9 * mt + 0.1 * gt, 0.99 * vt + 0.01 * gt**2
        rate = 0.2 / np.sqrt(1 + r / 20)
        we += rate * (me / (1 - 0.9**r)) / (np.sqrt(ve / (1 - 0.99**r)) + 1e-6)
        wt += rate * (mt / (1 - 0.9**r)) / (np.sqrt(vt / (1 - 0.99**r)) + 1e-6)
    return we, wt


def viterbi(masks: list[int], table: list[tuple[float, float]] | dict[int, tuple[float, float]], wt: list[list[float]]) -> list[int]:
    """The likeliest labels, 1 for content; ties go to content."""
    if not masks:
        return []
    (t00, t01), (t10, t11) = wt
    a, b = table[masks[0]]
    back = []
    for m in masks[1:]:
        e0, e1 = table[m]
        x0, y0, x1, y1 = a + t00, b + t10, a + t01, b + t11
        back.append((y0 >= x0, y1 >= x1))
        a, b = (y0 if y0 >= x0 else x0) + e0, (y1 if y1 >= x1 else x1) + e1
    label = int(b >= a)
    out = [label]
    for from_one in reversed(back):
        label = int(from_one[label])
        out.append(label)
    return out[::-1]


def lines_of(text: str) -> list[str]:
    """Lines with a word, as ``line_masks`` takes them."""
    return [x for x in text.split("\n") if x.split()]


def near_groups(texts: list[str], width: int = 5, similarity: tuple[int, int] = (4, 5)) -> list[int]:
    """Of each text the number of its group: texts linked, over others too, by shingle sets of a Jaccard similarity of 4/5 or more.

    Exact but for collisions of 64-bit hashes: pairs that share one of their rarest shingles are compared.  A text of fewer than ``width``
    words is one shingle; one without words is alone.  For the bounded sample, in one task.
    """
    up, down = similarity
    names: dict[str, int] = {}
    sets = []
    for t in texts:
        ids = np.array([names.setdefault(w, len(names) + 1) for w in t.split()], dtype=np.uint64)
        ids = (ids * np.uint64(0x9E3779B97F4A7C15)) ^ (ids * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(29))
        n = min(width, len(ids))
        h = np.full(len(ids) - n + 1 if n else 0, n, dtype=np.uint64)
        for k in range(n):
            h = (h ^ ids[k : k + len(h)]) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
        sets.append(np.unique(h))
    every, count = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0), np.zeros(0))
    root = list(range(len(texts)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    first: dict[bytes, int] = {}
    holders: dict[int, list[int]] = {}
    for i in sorted(range(len(texts)), key=lambda i: len(sets[i])):
        own = sets[i]
        if not len(own):
            continue
        same = first.setdefault(own.tobytes(), i)
        if same != i:
            root[i] = find(same)
            continue
        rare = own[np.lexsort((own, count[np.searchsorted(every, own)]))][: len(own) + up * len(own) // -down + 1]
        for j in {j for x in rare.tolist() for j in holders.get(x, ())}:
            if find(i) != find(j) and down * len(sets[j]) >= up * len(own):
                both = len(np.intersect1d(own, sets[j], assume_unique=True))
                if down * both >= up * (len(own) + len(sets[j]) - both):
                    root[find(i)] = find(j)
        for x in rare.tolist():
            holders.setdefault(x, []).append(i)
    return [find(i) for i in range(len(texts))]


def common_lines(texts: list[str]) -> frozenset[str]:
    """Short lines in ``COMMON`` or more groups of near copies."""
    texts = sorted(set(texts))
    held = {(x, g) for t, g in zip(texts, near_groups(texts), strict=True) for x in lines_of(t) if len(x.split()) < SHORT}
    return frozenset(x for x, n in Counter(x for x, _ in held).items() if n >= COMMON)


def fit_lines(texts: list[str], quality: list[int]) -> Model:
    """Constrained EM: line labels of texts of which only the quality is known, and the field."""
    common = common_lines(texts)
    sequences = [line_masks(t, common)[0] for t in texts]
    fixed = [[0 if x in common else 1 if y else -1 for x in lines_of(t)] for t, y in zip(texts, quality, strict=True)]
    # how much more usual each mask is in quality 0
    good, bad = (np.bincount(np.array([m for s, q in zip(sequences, quality, strict=True) if q == y for m in s], dtype=np.int64), minlength=len(BITS)) for y in (1, 0))
    odds = np.log((bad + 0.5) / max(1, bad.sum())) - np.log((good + 0.5) / max(1, good.sum()))

    def labelled(found: list[int], known: list[int], masks: list[int], score: np.ndarray) -> list[int]:
        out = [f if k < 0 else k for f, k in zip(found, known, strict=True)]
        if known and min(known) < 0 and 0 not in out:  # a text of quality 0 has a boilerplate line
            latent = [i for i, k in enumerate(known) if k < 0]
            out[max(latent, key=lambda i: score[masks[i]])] = 0
        return out

    labels = [labelled([int(odds[m] <= 0) for m in s], k, s, odds) for s, k in zip(sequences, fixed, strict=True)]
    model = None
    for turn in range(TURNS):
        model = fit(sequences, labels, model, rounds=150 if turn == 0 else 40)
        scores = BITS @ model[0]
        table, wt = [tuple(x) for x in scores.tolist()], model[1].tolist()
        new = [labelled(viterbi(s, table, wt) if -1 in k else k, k, s, scores[:, 0] - scores[:, 1]) for s, k in zip(sequences, fixed, strict=True)]
        if new == labels:
            break
        labels = new
    return *model, common


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS) -> Model:
    sample, _ = labelled_sample(docs, labels, id_col, text_col, label_col, per_class)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["id", "label", "text"])
        we, wt, common = fit_lines(frame["text"].tolist(), frame["label"].tolist())
        return pd.DataFrame({"e": [we.reshape(-1).tolist()], "t": [wt.reshape(-1).tolist()], "common": [sorted(common)]})

    rows = sample.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "e array<double>, t array<double>, common array<string>").collect()
    if not rows:
        return np.tile([-1.0, 1.0], (N_FEATURES, 1)), np.zeros((2, 2)), frozenset()
    return np.array(rows[0].e).reshape(N_FEATURES, 2), np.array(rows[0].t).reshape(2, 2), frozenset(rows[0].common)


def line_labels(text: str, model: Model) -> list[int]:
    """The field's label of each line with a word: 1 for content."""
    masks = line_masks(text, model[2])[0]
    return viterbi(masks, {m: tuple((BITS[m] @ model[0]).tolist()) for m in set(masks)}, model[1].tolist())


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    table = [tuple(x) for x in (BITS @ model[0]).tolist()]
    wt, common = model[1].tolist(), model[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py() or ""
                n, chars, symbols, dup, repeat = base_counts(text)
                failed = n < 20 or 100 * repeat > 30 * n
                masks, sizes = line_masks(text, common)
                label = viterbi(masks, table, wt)
                of = sum(sizes)
                content = sum(s for s, y in zip(sizes, label, strict=True) if y) / of if of else 0.0
                rows.append((key, n, chars, symbols, dup, repeat, failed, not failed and content >= share, len(masks), label.count(0), content))
            types = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.float64()]
            names = [x.split()[0] for x in RESULT.split(", ")]
            columns = list(zip(*rows, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, RESULT)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return judge(docs, train(docs, labels, id_col, text_col), id_col, text_col)
