"""Operators 11 to 13 against plain Python: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from isotherm.llm import fim, merkle, mixture, rope  # noqa: E402
from isotherm.llm.store import stage  # noqa: E402
from isotherm.llm.totals import running_totals  # noqa: E402

# extra columns with names that the operators use inside
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, id string, tree int, index long, row long, part int, total double, key string"
EXTRA = ("i", 1, 2, 3, 4, 0.5, "k")
LONG = " ".join(f"w{i % 977}\n" * (1 + i % 3) for i in range(60_000))
TEXTS = [None, "", " \n ", "one", "a<P>b", "x<S", "<", "é🙂 two\nlines\n", "many words in one line here", LONG, "<P><S><M>", "P>tail", "same text"]


@pytest.fixture(scope="module")
def docs(spark):
    g = random.Random(3)
    rows = [(i, t, ["b", "a", None, "c", "é"][i % 5], None if i % 4 == 0 else "en", None if i % 3 == 0 else i, *EXTRA) for i, t in enumerate(TEXTS)]
    rows += [(100 + i, " ".join(g.choices(["red", "blue\n", "<S", "P>"], k=g.randrange(40))), "hot" if i % 3 else "a", "fr", i, *EXTRA) for i in range(120)]
    rows += [rows[8], rows[12], (None, "no id", "a", "en", 5, *EXTRA), (None, "no id\n", "a", "en", 6, *EXTRA), (9, None, "alone", None, None, *EXTRA)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- running totals ----------------------------------------------------------------------


def test_running_totals(spark):
    g = random.Random(1)
    rows = [(g.choice(["x", "x", "x", "y", None]), g.randrange(20), g.randrange(5), i) for i in range(700)]
    table = stage(spark.createDataFrame(rows, "g string, k int, v long, row int").repartition(6), "t")
    want = Counter()
    for name in {r[0] for r in rows}:
        before, own = 0, sorted((r for r in rows if r[0] == name), key=lambda r: (r[1], r[3]))
        total = sum(r[2] for r in own)
        for r in own:
            want[(*r, before, total)] += 1
            before += r[2]
    assert Counter(tuple(r) for r in running_totals(table, "g", ["k", "row"], "v").collect()) == want
    assert running_totals(stage(table.limit(0), "t"), "g", ["k", "row"], "v").count() == 0


# ---- 11 ------------------------------------------------------------------------------------


@pytest.mark.parametrize("pattern", [None, r"\w+", "\n"])
def test_rope_splits_anywhere(pattern):
    units, g = rope.Units(pattern), random.Random(2)
    for text in ("", "a", "é🙂x" * 700, LONG[:20_000], " lead and  trail  "):
        r = units.build(text)
        starts = list(units.starts(text))
        assert rope.text_of(r) == text and (r.units, r.chars) == (len(starts), len(text))
        for k in {0, len(starts), len(starts) + 3, *(g.randrange(len(starts) + 1) for _ in range(20))}:
            at = [*starts, len(text)][min(k, len(starts))] if text else 0
            a, b = units.split(r, k)
            assert (rope.text_of(a), rope.text_of(b)) == (text[:at], text[at:])
            assert (a.units, a.chars, b.units, b.chars) == (min(k, len(starts)), at, len(starts) - min(k, len(starts)), len(text) - at)
        k = g.randrange(len(text) + 1)
        assert [rope.text_of(x) for x in units.split(r, k, "chars")] == [text[:k], text[k:]]


def brute_fim(doc_id, text):
    text = text or ""
    h = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    form = "spm" if h4 % 100 < 20 else "psm"
    p, m, s = text[:a], text[a:b], text[b:]
    return doc_id, n, form, len(p), len(m), sha(f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"), sha(text)


def test_fim(docs, none):
    got = Counter(tuple(r) for r in fim.fim_digests(docs).collect())
    assert got == Counter(brute_fim(r.doc_id, r.text) for r in docs.collect())
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fim.fim_digests(none).count() == 0


def test_fim_by_words(docs):
    made = fim.fill_in_middle(docs.select(F.col("text").alias("t"), F.col("doc_id").alias("k")), "k", "t", unit=r"\w+")
    rows = fim.restore(made, r"\w+").collect()
    assert Counter(r.restored for r in rows) == Counter(r.text or "" for r in docs.collect())
    cut = [r for r in rows if r.form != "plain"]
    assert len(cut) > 60 and all(r.prefix_units + r.middle_units <= r.n and r.prefix_chars + r.middle_chars <= r.chars for r in cut)
    for r in cut:
        prefix = r.restored[: r.prefix_chars]
        assert r.prefix_chars in (0, r.chars) or r.restored[r.prefix_chars - 1 :][1:2].isalnum() or not re.search(r"\w", prefix)


def test_inverse_at_every_seam():
    """Pieces of sentinels at every seam; texts that hold one stay plain."""
    units = rope.Units()
    for text in ("<P", "S><", "M>x<S", "<<<", "P>S>M>", "<M<P<S"):
        for low in range(len(text) + 1):
            for high in range(low, len(text) + 1):
                for form in ("psm", "spm"):
                    out = rope.text_of(fim.arrange(units, units.build(text), low, high, form)[0])
                    assert fim.invert(units, out, form) == text


# ---- 12 ------------------------------------------------------------------------------------


def tree_levels(nodes, fanout=3):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def path(levels, i, fanout=3):
    out = []
    for level in levels[:-1]:
        first = i // fanout * fanout
        out.append([None if k == i else level[k] for k in range(first, min(first + fanout, len(level)))])
        i //= fanout
    return out


def folded(leaf, proof):
    for run in proof:
        leaf = sha("".join(leaf if x is None else x for x in run))
    return leaf


def value(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_manifest(rows, fanout=3):
    sources = defaultdict(list)
    for r in rows:
        even = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
        cut = r.text if r.text is None or not even else r.text.replace("\n", "")
        leaf, other = (sha("".join(map(value, (r.doc_id, r.source, r.lang, r.n_chars, t)))) for t in (r.text, cut))
        sources["" if r.source is None else "=" + r.source].append((r.doc_id is not None, r.doc_id or 0, leaf, other, r.doc_id))
    names = sorted(sources, key=lambda s: s.encode())
    trees = {s: tree_levels([x[2] for x in sorted(sources[s])], fanout) for s in names}
    top = tree_levels([trees[s][-1][0] for s in names], fanout)
    out = Counter()
    for at, s in enumerate(names):
        for i, x in enumerate(sorted(sources[s])):
            proof = path(trees[s], i, fanout) + path(top, at, fanout)
            root = folded(x[3], proof)
            out[x[4], x[2], trees[s][-1][0], top[-1][0], sha("".join(h for run in proof for h in run if h)), root, root == top[-1][0]] += 1
    return out


def test_merkle(docs, none):
    want = brute_manifest(docs.collect())
    got = Counter(tuple(r) for r in merkle.merkle_digests(docs).collect())
    assert got == want and {k[-1] for k in want} == {True, False}
    assert merkle.merkle_digests(none).count() == 0
    one = docs.where("doc_id = 3")
    assert Counter(tuple(r) for r in merkle.merkle_digests(one).collect()) == brute_manifest(one.collect())


@pytest.mark.parametrize(("fanout", "levels"), [(3, 1), (3, 2), (2, 3), (16, 1)])
def test_merkle_in_any_rounds(docs, fanout, levels):
    made = merkle.build_manifest(docs, fanout=fanout, levels=levels)
    assert len(made.sources) > (fanout < 16)
    want = {k[1]: k[2:4] for k in brute_manifest(docs.collect(), fanout)}
    rows = made.proofs().select("leaf", "subroot", "root", merkle.fold(F.col("leaf"), F.col("proof")).alias("again")).collect()
    assert {r.leaf: (r.subroot, r.root) for r in rows} == want and all(r.again == r.root for r in rows) and len(rows) == docs.count()


# ---- 13 ------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1), share=Fraction(3, 2), most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        target = {s: Fraction(left * w[s], sum(w[x] for x in rest)) for s in rest} | {s: Fraction(most * sizes[s]) for s in capped}
        above = {s for s in rest if target[s] > most * sizes[s]}
        if not above:
            return target
        capped |= above


def check_mix(df, **how):
    rows = [(r.doc_id, len(re.findall(r"[^\x20\x09-\x0d]+", r.text or "")), r.source) for r in df.collect()]
    sizes = defaultdict(int)
    for _, n, s in rows:
        sizes[s] += n
    target = brute_targets(sizes, **how)
    mixed = mixture.mix(df, **how).collect()
    assert Counter((r.id, r.size, r.source) for r in mixed) == Counter(rows)
    taken = defaultdict(int)
    for r in mixed:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(target[r.source]), abs=1e-6)
        assert 0 <= r.taken <= how.get("most", 2) * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sizes)
    return mixed


def test_mixture(docs, none):
    mixed = check_mix(docs)
    # all passes of a source differ by one at most, and one document of a source is cut at most
    for s in {r.source for r in mixed}:
        own = [r for r in mixed if r.source == s and r.size]
        assert len({r.epochs for r in own}) <= 1 and sum(0 < r.cut < r.size for r in own) <= 1
    assert Counter(map(tuple, mixed)) == Counter(map(tuple, mixture.mix(docs.repartition(2)).collect()))
    assert mixture.mixture(none).count() == 0 and mixture.mixture(docs.where("text is null or text = ''")).agg(F.sum("taken")).first()[0] == 0
    check_mix(docs, weights=(1,), share=Fraction(7, 10), most=1)
    check_mix(docs, weights=(1, 50), share=Fraction(3), most=5)


def test_order_is_that_of_the_keys(docs):
    """Of a source that is cut, what a brute-force walk along the keys takes."""
    mixed = mixture.mix(docs).collect()
    key = lambda i: int(sha(f"mix:{'' if i is None else i}")[:15], 16)
    for s in {r.source for r in mixed}:
        own = sorted((r for r in mixed if r.source == s), key=lambda r: (key(r.id), r.id is not None, r.id or 0, r.size, r.text_hash))
        left = round(own[0].target) - (round(own[0].target) // own[0].source_size if own[0].source_size else 0) * own[0].source_size
        for r in own:
            assert r.cut == min(r.size, left)
            left -= r.cut


def test_mixed_texts(docs):
    mixed = mixture.mix(docs)
    rows = mixture.mixed_texts(docs, mixed).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t))
    taken, got = defaultdict(int), defaultdict(int)
    for r in mixed.collect():
        taken[r.source] += r.taken
    for r in rows:
        got[r.source] += count(r.text)
    assert got == {s: n for s, n in taken.items() if n}
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text or "")
    assert all(any(t.startswith(r.text) for t in texts[r.id]) for r in rows)
