"""Prefix doubling over every position against brute force and against the sampled form."""

import hashlib
import random
from collections import Counter

from isotherm.llm.prefix_doubling import prefix_doubling_dedup
from isotherm.llm.suffix_dedup import suffix_dedup


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    found = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if found[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_every_position_against_brute_force(spark):
    g = random.Random(3)
    passage = "".join(g.choice("abcdé ") for _ in range(300))
    texts = [None, "", "short", "x" * 900, "ab" * 250, passage, passage, passage[:199], passage[50:] + "tail", "head " + passage[10:240] + " mid " + passage[30:290]]
    texts += ["".join(g.choice("ab") for _ in range(g.randrange(150, 700))) for _ in range(12)]
    texts += [t[:60] + "!" + t[60:] for t in texts[-4:]]
    rows = [(None if i == 4 else 7 if i in (5, 6) else i, t, "n") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3)
    for length in (8, 13, 64, 200):
        want = Counter((i, *b) for (i, _, _), b in zip(rows, brute(texts, length), strict=True))
        assert Counter(tuple(r) for r in prefix_doubling_dedup(df, length=length).collect()) == want
        assert any(k[2] for k in want)
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert Counter(tuple(r) for r in suffix_dedup(df, length=200).select(*columns).collect()) == want
    assert prefix_doubling_dedup(df.limit(0)).count() == 0
