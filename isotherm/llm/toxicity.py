"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Training takes a bounded sample of labelled rows (``sampling``): per class at most ``per_class``
ids of least ``xxhash64`` and ``SAMPLE_BYTES`` of text, so it is spread over the corpus and
repeatable.  It runs in one task, whose input those parameters bound.  Features
are byte n-grams of the lower-cased text, hashed to ``2 ** BITS``, present or not.
A first pass counts documents per feature and class.  Features whose counts differ between the classes beyond chance
(chi-square over ``CHI``) are kept, at most ``MOST``; a second pass takes only their occurrences.  Each is scaled by
its log-count ratio r = ln((p + a) / |p|) - ln((q + a) / |q|), and logistic
regression with an L2 penalty weighs the scaled features, the classes
counting as they do among all labelled rows of the training folds.

Scoring reads whole texts.  A text's n-grams are looked up in one table of
2 ** BITS entries (fixed size), piece by piece; repeated hits count once.  Null and empty texts
have no feature and get the intercept's score.  Rows that repeat an id get
rows of their own; labels may repeat, null labels are left out.
Labels of one class alone, or none, give a constant score of the smoothed share.
Extra columns are ignored; labels, lang, source and ids are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotherm.llm.chunks import U64, Rolling
from isotherm.llm.sampling import labelled_sample

SIZES = (3, 4, 5)
BITS = 20
PER_CLASS = 2000
CHI = 25.0
MOST = 20_000
FOLDS = 5
#: bytes of text that are hashed at once
PIECE = 1 << 18


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def grams(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For each n-gram size: hashed feature of each position, the document of each position, and the size."""
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    roll = Rolling(raw)
    for n in SIZES:
        yield (roll.every(n) >> U64(64 - BITS)).astype(np.int32), ends, n


def pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Runs of texts of about ``PIECE`` bytes, with the document of each; a longer text is cut, the cuts overlapping by an n-gram."""
    docs, parts, size = [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t), 1), PIECE):
            part = t[at : at + PIECE + max(SIZES) - 1]
            docs.append(i)
            parts.append(part)
            size += len(part)
            if size >= PIECE:
                yield np.array(docs), parts
                docs, parts, size = [], [], 0
    if parts:
        yield np.array(docs), parts


def hits(texts: list[bytes], table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature) pairs; with a table, entries above 0 of it are the features."""
    pairs = []
    for which, parts in pieces(texts):
        docs, found = [], []
        for h, ends, n in grams(parts):
            if table is None:
                at, f = np.arange(len(h)), h
            else:
                f = table[h]
                at = np.flatnonzero(f)
                f = f[at]
            doc = np.searchsorted(ends, at, side="right")
            inside = at + n <= ends[doc]
            docs.append(which[doc[inside]])
            found.append(f[inside])
        pairs.append(np.unique(np.concatenate(docs).astype(np.int64) << 32 | np.concatenate(found).astype(np.int64)))
    pair = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, dtype=np.int64)
    return pair >> 32, pair & 0xFFFFFFFF


def runs(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive texts of about ``PIECE`` bytes together."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= PIECE:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def encode(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def fit(texts: list[bytes], label: np.ndarray, share: float | None = None, penalty: float = 1.0, rounds: int = 300, alpha: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Features, their weights and squared ratios, and the intercept; ``share``: class 1 among all labelled rows."""
    yes, no = int(label.sum()), int(len(label) - label.sum())
    if not yes or not no:
        return np.zeros(0, dtype=np.int64), np.zeros(0), float(np.log((yes + 0.5) / (no + 0.5)))
    toxic = label > 0
    p, q = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for a, b in runs(texts):
        d, f = hits(texts[a:b])
        own = toxic[d + a]
        p += np.bincount(f[own], minlength=1 << BITS)
        q += np.bincount(f[~own], minlength=1 << BITS)
    n, row = yes + no, p + q
    expected = np.maximum(row * (n - row) * yes * no, 1e-9)
    chi = n * (p * no - q * yes) ** 2 / expected
    kept = np.flatnonzero((chi > CHI) & (row < n))
    kept = np.sort(kept[np.argsort(-chi[kept], kind="stable")[:MOST]])
    r = np.log((p[kept] + alpha) / (p.sum() + alpha * len(p))) - np.log((q[kept] + alpha) / (q.sum() + alpha * len(q)))
    place = np.zeros(1 << BITS, dtype=np.int32)
    place[kept] = np.arange(1, len(kept) + 1)
    docs, columns = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int32)]
    for first, last in runs(texts):
        d, f = hits(texts[first:last], place)
        docs.append((d + first).astype(np.int32))
        columns.append((f - 1).astype(np.int32))
    doc, column = np.concatenate(docs), np.concatenate(columns)
    # a text's features share its evidence: scaled to unit length
    norm = np.sqrt(np.bincount(doc, weights=r[column] ** 2, minlength=n))
    value = r[column] / np.maximum(norm[doc], 1e-9)
    w, b = np.zeros(len(kept)), 0.0
    share = yes / (yes + no) if share is None else share
    weight = np.where(label > 0, share / yes, (1 - share) / no)
    m, v, mb, vb = np.zeros(len(kept)), np.zeros(len(kept)), 0.0, 0.0
    for i in range(1, rounds + 1):
        z = np.bincount(doc, weights=value * w[column], minlength=n) + b
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label)
        g = np.bincount(column, weights=value * error[doc], minlength=len(kept)) + penalty * 1e-5 * w
        gb = error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.3 / np.sqrt(i / 10 + 1)
        w -= rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**i)) / (np.sqrt(vb / (1 - 0.999**i)) + 1e-8)
    return kept, np.stack([w * r, r**2]), float(b)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> bytes:
    """The model, from the bounded sample of labelled rows outside the held-out fold."""
    sample, marked = labelled_sample(docs, labels, id_col, text_col, label_col, per_class, ~held_out(F.col("id")))
    share = marked.agg(F.avg("label")).first()[0]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["id", "label", "text"])
        kept, w, b = fit([encode(t) for t in frame["text"]], frame["label"].to_numpy(), share)
        return pd.DataFrame({"kept": [kept.astype("<i4").tobytes()], "w": [w.astype("<f8").tobytes()], "b": [b]})

    rows = sample.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "kept binary, w binary, b double").collect()
    if not rows:
        return b"\0" * 8
    return np.float64(rows[0].b).tobytes() + rows[0].kept + rows[0].w


def unpack_model(model: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Lookup table of feature numbers from 1, weights, squared ratios, and the intercept."""
    n = (len(model) - 8) // 20
    kept = np.frombuffer(model, dtype="<i4", count=n, offset=8)
    w = np.frombuffer(model, dtype="<f8", count=2 * n, offset=8 + 4 * n).reshape(2, n)
    table = np.zeros(1 << BITS, dtype=np.uint16 if n < 65535 else np.int32)
    table[kept] = np.arange(1, n + 1)
    return table, np.concatenate([[0.0], w[0]]), np.concatenate([[0.0], w[1]]), float(np.frombuffer(model, dtype="<f8", count=1)[0])


def scores(texts: list[bytes], table: np.ndarray, w: np.ndarray, r2: np.ndarray, b: float) -> np.ndarray:
    n = len(texts)
    doc, feature = hits(texts, table)
    norm = np.sqrt(np.bincount(doc, weights=r2[feature], minlength=n))
    z = b + np.bincount(doc, weights=w[feature], minlength=n) / np.maximum(norm, 1e-9)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def scored(docs: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """``row`` (a struct of the columns of ``docs``, whatever their names) and ``score``; whole texts, piece by piece."""
    held = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    schema = held.select("row", F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = unpack_model(model)
        for batch in batches:
            texts, out, size = [], [np.zeros(0)], 0
            for t in batch.column(1):
                texts.append(encode(t.as_py()))
                size += len(texts[-1])
                if size >= PIECE:
                    out.append(scores(texts, *parts))
                    texts, size = [], 0
            if texts:
                out.append(scores(texts, *parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out), pa.float64())], names=["row", "score"])

    return held.mapInArrow(run, schema)


def score(docs: DataFrame, model: bytes, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a column of scores; a column of that name is replaced."""
    found = scored(docs, model, text_col)
    return found.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != score_col], F.col("score").alias(score_col))


def below(docs: DataFrame, model: bytes, most: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under ``most``."""
    return scored(docs, model, text_col).where(F.col("score") < most).select("row.*")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    model = train(docs, labels, id_col, text_col)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return score(own, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
