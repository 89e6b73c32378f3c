"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import base64
import hashlib
import itertools
import random
import re
import sys
import time
import zlib
from collections import Counter
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from isotherm.llm import arc_to_warc, chat_format, decontaminate, jaccard_join, packing, pii, quality, secret_scan, suffix_dedup, toxicity  # noqa: E402
from isotherm.llm.components import connected_components  # noqa: E402
from isotherm.llm.encoder import WordEncoder  # noqa: E402
from isotherm.llm.queries import tokenizer_path  # noqa: E402

# extra columns with names that operators use inside
SCHEMA = "doc_id long, text string, lang string, rep long, key string, block int, length long, score double"
EXTRA = ("xx", 7, "k", 1, 2, 0.5)


def words(n, seed):
    g = random.Random(seed)
    return " ".join("".join(g.choices("abcdefgh", k=5)) for _ in range(n))


LONG = words(30_000, 99)
TEXTS = [None, "", "  \n\t ", "one", "One two", words(300, 1), words(300, 1), words(300, 1).upper(), words(300, 1).replace("a", "b", 3), LONG, LONG + " tail", "\n".join(["same line here"] * 40), "é🙂 token=abcdef123 a@b.co", "x" * 5000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, *EXTRA) for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, "one", *EXTRA)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(14)] + [(5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


# ---- 1 -------------------------------------------------------------------------------------


def shingle_set(text, width=3):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute_components(rows, width, t):
    sets = [(i, shingle_set(x, width)) for i, x in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and t.denominator * len(a & b) >= t.numerator * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(sets):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return Counter((k, len(s), least.get(find(i))) for i, (k, s) in enumerate(sets))


@pytest.mark.parametrize(("width", "t"), [(3, Fraction(9, 10)), (5, Fraction(4, 5))])
def test_jaccard_components(docs, width, t):
    got = Counter(tuple(r) for r in jaccard_join.jaccard_components(docs, width=width, threshold=t).collect())
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()], width, t)


def test_jaccard_in_blocks(spark):
    g, base = random.Random(5), words(120, 7).split()
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(g.randrange(6)):
            w[g.randrange(len(w))] = f"w{g.randrange(50)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in jaccard_join.jaccard_components(df, block=8).collect())
    assert got == brute_components(rows, 3, Fraction(9, 10))


def test_every_link_is_counted(spark):
    g, base = random.Random(6), words(120, 7).split()
    rows = [(100, ""), (101, None), (102, words(50, 3))]
    for i in range(60):
        w = list(base)
        for _ in range(g.randrange(4)):
            w[g.randrange(len(w))] = f"w{g.randrange(50)}"
        rows += [(i, " ".join(w))] * (1 + (i % 20 == 0))
    sets = [(i, shingle_set(x)) for i, x in rows]
    want = Counter((i, sum(bool(a and b) and 10 * len(a & b) >= 9 * len(a | b) for k, (_, b) in enumerate(sets) if k != j)) for j, (i, a) in enumerate(sets))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (8, 1500):
        got = jaccard_join.jaccard_links(df, block=block).collect()
        assert Counter((r.doc_id, r.n_links) for r in got) == want
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 3, Fraction(9, 10))
    assert max(n for _, n in want) > 10 and jaccard_join.jaccard_links(df.limit(0)).count() == 0


def test_a_large_family_is_linked_in_levels(spark):
    g, base = random.Random(8), words(200, 17).split()
    rows, chain = [], list(base)
    for i in range(150):  # near copies, some far enough to hang by one link or by none
        w = list(base)
        for _ in range(g.choice([0, 1, 1, 2, 2, 3, 9])):
            w[g.randrange(len(w))] = f"w{g.randrange(9)}"
        rows.append((i, " ".join(w)))
    for i in range(40):  # a chain, each link linked with its neighbours alone
        chain[5 * i] = f"c{i}"
        rows.append((200 + i, " ".join(chain)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_components(rows, 3, Fraction(9, 10))
    assert Counter(tuple(r) for r in jaccard_join.jaccard_components(df, block=6).collect()) == want
    assert len({c for _, _, c in want}) > 3


def brute_keep(rows, width, t):
    """Rows that stay: of each group the least (no id, id, text hash); what has no words stays."""
    sets = [shingle_set(x, width) for _, x in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and t.denominator * len(a & b) >= t.numerator * len(a | b):
                root[find(i)] = find(j)
    h = lambda x: int(np.uint64(xxhash.xxh64_intdigest((x or "").encode(), 42)).astype(np.int64))
    best = {}
    for i, (k, x) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), (2,)), (k is None, k or 0, h(x)))
    kept, seen = Counter(), set()
    for i, (k, x) in enumerate(rows):
        if not sets[i]:
            kept[k, x] += 1
        elif best[find(i)] == (k is None, k or 0, h(x)) and (find(i), k, x) not in seen:
            seen.add((find(i), k, x))
            kept[k, x] += 1
    return kept


def test_jaccard_empty_and_keep_one(spark, docs, none):
    assert jaccard_join.jaccard_components(none).count() == 0
    kept = jaccard_join.keep_one(docs, width=5, threshold=Fraction(4, 5))
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == brute_keep([(r.doc_id, r.text) for r in docs.collect()], 5, Fraction(4, 5))
    # ids that repeat with linked, equal and other texts; rows without an id; columns named as the operator's own
    a, b, c = words(60, 1), words(60, 2), words(60, 3)
    rows = [(1, a), (1, b), (2, a), (2, a + " more"), (2, c), (2, c), (None, b), (None, None), (None, ""), (None, words(60, 4)), (None, words(60, 4)), (7, ""), (7, "")]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, gone_id long, gone_hash long, first long, count long").repartition(3)
    got = jaccard_join.keep_one(df, width=5, threshold=Fraction(4, 5))
    assert got.columns == df.columns and Counter((r.doc_id, r.text) for r in got.collect()) == brute_keep(rows, 5, Fraction(4, 5))
    assert jaccard_join.keep_one(none).count() == 0


def test_components_of_a_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 90)], "a long, b long")
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 90, 90: 90}

def test_components_of_many_shapes(spark):
    r = np.random.default_rng(5)
    star, ring, pairs = [(100, i) for i in range(101, 140)], [(i, 200 + (i - 199) % 30) for i in range(200, 230)], [(int(a), int(b)) for a, b in r.integers(300, 360, (50, 2))]
    edges = star + ring + pairs + pairs[:5] + [(b, a) for a, b in pairs[5:9]]
    least = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in least:
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {x.node: x.component for x in got} == least and len(got) == len(least)


# ---- 2 -------------------------------------------------------------------------------------


def brute_cut(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "k"), [(200, 50), (40, 12)])
def test_suffix_dedup(spark, length, k):
    g = random.Random(3)
    shared = words(60, 4)
    texts = [None, "", "ab" * 300, "z" * 199, "z" * 200, "z" * 201, shared, "é" + shared[20:], words(50, 5) + shared[:220] + words(50, 6), words(400, 8), words(400, 8)]
    texts += [words(20, i) + shared[g.randrange(100) : 150 + g.randrange(150)] for i in range(20)]
    df = spark.createDataFrame([(i, t, *EXTRA) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.suffix_dedup(df, length=length, k=k).collect()}
    assert [got[i] for i in range(len(texts))] == brute_cut(texts, length)
    assert suffix_dedup.suffix_dedup(df, length=length, k=k, texts=True).where("n_removed = 0 and doc_id = 9").count() == 0
    assert suffix_dedup.suffix_dedup(df.limit(0)).count() == 0


# ---- 3 -------------------------------------------------------------------------------------


def brute_repeats(w, k=8):
    seen = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    cover = {j for i in range(len(w) - k + 1) if seen[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
    return len(cover)


def test_base_counts():
    g = random.Random(1)
    for _ in range(60):
        w = [g.choice("abc").encode() for _ in range(g.randrange(60))]
        assert quality.repeated_words(w) == brute_repeats(w)
    assert quality.base_counts("a #b\n\n  \na #b c\nx\x1cy") == (5, 11, 2, 0, 0)
    assert quality.base_counts("l l\nl l\n \n ")[3] == 1


def test_viterbi_is_the_best_labelling():
    g = np.random.default_rng(2)
    wt = g.normal(size=(2, 2))
    table = [tuple(x) for x in g.normal(size=(4, 2)).tolist()]
    for n in range(1, 8):
        masks = g.integers(0, 4, n).tolist()
        value = lambda y, m=masks: sum(table[k][b] for k, b in zip(m, y, strict=True)) + sum(wt[a][b] for a, b in zip(y, y[1:], strict=False))
        best = max(value([(i >> j) & 1 for j in range(n)]) for i in range(1 << n))
        assert value(quality.viterbi(masks, table, wt.tolist())) == pytest.approx(best)


def brute_base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, brute_repeats(w)


def test_all_columns_equal_brute_force(spark, docs):
    g = random.Random(4)
    bank = ["a b | c", "#x $y", "Buy!! NOW!!", " ", "", "one two three four five six seven eight", "é\x1cx", "\tz "]
    rows = [(i, "\n".join(g.choices([*bank, *(words(12, 20 * i + k) for k in range(6))], k=g.randrange(10))) + g.choice(["", "\n", " tail"]) * g.randrange(3)) for i in range(150)] + [(200, None), (200, "x"), (None, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    n = np.random.default_rng(3)
    model = (n.normal(size=(quality.N_FEATURES, 2)), n.normal(size=(2, 2)), frozenset(["a b | c"]))
    model[0][0], model[0][3] = (0, 0), (0, 4)  # lines of 10 to 29 words lean to content
    want = Counter()
    for i, t in rows:
        base = brute_base(t or "")
        failed = base[0] < 20 or 100 * base[4] > 30 * base[0]
        masks, sizes = quality.line_masks(t or "", model[2])
        e = [quality.BITS[m] @ model[0] for m in masks]
        value = lambda y, e=e: sum(x[b] for x, b in zip(e, y, strict=True)) + sum(model[1][a, b] for a, b in zip(y, y[1:], strict=False))
        best = max(itertools.product((0, 1), repeat=len(masks)), key=value)
        share = sum(k for k, b in zip(sizes, best, strict=True) if b) / sum(sizes) if sizes else 0.0
        want[(i, *base, failed, not failed and share >= quality.SHARE, len(masks), best.count(0), share)] += 1
    assert Counter(tuple(r) for r in quality.judge(df, model).collect()) == want and any(k[7] for k in want)


def test_planted_boilerplate_is_found(spark):
    g = random.Random(12)
    junk = lambda i: g.choice([f"Home | {words(2, i)} | Login | Help", f"SALE!! {words(3, i).upper()}!! BUY!!", f"### {words(4, i)} *** $$$"])
    stock = ["Subscribe to our letter", "All rights reserved by us", "Share this page with friends"]
    prose = lambda i: words(25, i).capitalize() + "."
    rows, marks, planted = [], [], {}
    for i in range(700):
        if i % 5 == 0:
            lines = [(junk(i * 50 + k), 0) for k in range(g.randrange(3, 7))] + [(prose(i * 50), 1)] * (i % 2)
        else:
            lines = [(prose(i * 50 + k), 1) for k in range(g.randrange(3, 7))]
            if i % 3 == 0:
                lines.insert(g.randrange(len(lines)), (g.choice(stock), 0))
            if i >= 600:  # held out: boilerplate inside good texts
                lines.insert(g.randrange(len(lines)), (junk(i * 50 + 40), 0))
        text = "\n".join(x for x, _ in lines)
        rows.append((i, text))
        if i < 600:
            marks.append((i, int(i % 5 > 0)))
        elif i % 5:
            planted[i] = (text, [y for _, y in lines])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.train(df, spark.createDataFrame(marks, "doc_id long, quality int"))
    labels = [(y, z) for text, gold in planted.values() for y, z in zip(gold, quality.line_labels(text, model), strict=True)]
    assert sum(z == 0 for y, z in labels if y == 0) / sum(y == 0 for y, _ in labels) >= 0.9
    assert sum(z == 1 for y, z in labels if y == 1) / sum(y == 1 for y, _ in labels) >= 0.95
    kept = {r.doc_id: r.kept for r in quality.judge(df, model).collect()}
    assert all(kept[i] for i in planted) and not any(kept[i] for i in range(0, 700, 10))


def test_common_lines_count_near_copies_once():
    """Groups of the sample against all pairs by plain sets, and a line of copied prose beside one of unrelated texts."""
    g = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    texts = ["", "  ", "one two", "one two", "two one", "one  two"]
    for n in (5, 12, 40, 200):
        base = [g.choice(words) for _ in range(n)]
        for _ in range(12):
            own = list(base)
            for _ in range(g.randrange(4)):
                own[g.randrange(n)] = g.choice(words)
            texts.append(" ".join(own))
    g.shuffle(texts)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.split()) else set() for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for a, b in itertools.combinations(range(len(texts)), 2):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    got = quality.near_groups(texts)
    pairs = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if root[a] == root[b]}
    assert {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if got[a] == got[b]} == pairs and len(pairs) > 60
    long = " ".join(g.choice(words) for _ in range(400))
    copies = [f"{long} tail{i}\nthis prose was copied" for i in range(5)]
    others = [" ".join(g.choice(words) for _ in range(40)) + "\nall rights reserved" for _ in range(3)]
    assert quality.common_lines(copies + others) == {"all rights reserved"} and quality.near_groups([]) == []


def test_quality_edges(docs, none, labels):
    rows = {r.doc_id: r for r in quality.quality_rules(docs, labels).collect()}
    assert not rows[0].kept and rows[0].base_failed and rows[0].n_words == 0
    assert rows[11].n_dup_lines == 39 and rows[11].base_failed
    assert quality.quality_rules(docs, labels.limit(0)).count() == docs.count()
    assert quality.quality_rules(none, labels).count() == 0


# ---- 4 -------------------------------------------------------------------------------------


def test_packing(docs, none):
    from tokenizers import Tokenizer

    rows = packing.best_fit_packing(docs, tokenizer_path(), capacity=256).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for d in docs.collect():
        ids = np.array([*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.update((d.doc_id, i, s, len(ids[s : s + 256]), zlib.crc32(ids[s : s + 256].tobytes())) for i, s in enumerate(range(0, len(ids), 256)))
    assert Counter(tuple(r)[:5] for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 256
    assert packing.best_fit_packing(none, tokenizer_path()).count() == 0


def test_plan_is_best_fit_decreasing():
    g = random.Random(1)
    for _ in range(30):
        h = Counter(g.randrange(1, 33) for _ in range(g.randrange(1, 200)))
        lines = packing.plan(h, 32)
        used = max(b + (n - 1) // p for _, _, n, b, p, _ in lines) + 1
        room = []
        for size in sorted(h.elements(), reverse=True):
            fit = [r for r in room if r >= size]
            if fit:
                room.remove(min(fit))
                room.append(min(fit) - size)
            else:
                room.append(32 - size)
        assert used == len(room)


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    tokenizer, own = Tokenizer.from_file(tokenizer_path()), WordEncoder(tokenizer_path())
    texts = ["", " ", "a<|endoftext|>b x<|startoftext|>", "<|ENDOFTEXT|>", "it's 'S WE'LL", "É×÷ÿŸ ÀÉ a×b aaaaaaa ----- 日本語", "é ́x", "12ab!!..", "\x00\x1c\x7f\u0085 ßẞ İ ﬁ ΣΑΣ", "zz" * 200, LONG[:2000]]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


# ---- 5 -------------------------------------------------------------------------------------


def test_archives(spark):
    pages = [(1, "http://a", "same"), (2, "b c", "same"), (3, None, None), (4, "d", ""), (5, "e", "é\r\n\r\nWARC/1.0\r\n"), (6, "f", "x" * 200_000), (6, "f", "x" * 200_000), (None, "g", "same")]
    df = spark.createDataFrame([(*p, "kept", 1) for p in pages], "page_id long, url string, html string, head string, offset int").repartition(3)
    rows = arc_to_warc.archive_round_trip(df).collect()
    assert len(rows) == len(pages)
    by = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in rows)
    assert by == Counter({(1, 4, "revisit", 2): 1, (2, 4, "response", None): 1, (None, 4, "revisit", 2): 1, (3, 0, "revisit", 4): 1, (4, 0, "response", None): 1, (5, 16, "response", None): 1, (6, 200_000, "response", None): 1, (6, 200_000, "revisit", 6): 1})
    digests = {r.page_id: r.payload_digest for r in rows}
    assert digests[5] == base64.b32encode(hashlib.sha1("é\r\n\r\nWARC/1.0\r\n".encode()).digest()).decode()
    assert {r.record_type for r in arc_to_warc.archive_round_trip(df, min_bytes=5).where("payload_bytes = 4").collect()} == {"response"}
    assert arc_to_warc.archive_round_trip(df.limit(0)).count() == 0


def arc_file(version, *records):
    extra = b" 200 - - 0 n.arc" if version == 2 else b""
    block = f"{version} 0 x\n{arc_to_warc.ARC_FIELDS[version]}\n".encode()
    out = b"filedesc://n.arc 0.0.0.0 20200102030405 text/plain%s %d\n%s\n" % (extra, len(block), block)
    return out + b"\n".join(r if isinstance(r, bytes) else b"%s 1.2.3.4 20200102030405 text/html%s %d\n%s" % (r[0], extra, len(r[1]), r[1]) for r in records)


def test_arc_versions_and_damage():
    for v in (1, 2):
        good = [(b"http://u", b"ab\ncd"), (b"http://a b/c d", b"x"), (b"http://\xe9", b"HTTP/1.0 200 OK\r\n\r\n\xff\x00")]
        data = arc_file(v, *good)
        got = list(arc_to_warc.arc_records(data))
        assert [(r["URL"], r["body"]) for r in got] == [("http://u", b"ab\ncd"), ("http://a b/c d", b"x"), ("http://%E9", good[2][1])]
        # cut short: the last record is rejected where it starts
        *_, last = arc_to_warc.arc_records(data[:-1])
        assert last["offset"] == got[2]["offset"] and "are left" in last["reason"]
        # a header without a length, and the lines of its body; the next record is found again
        broken = list(arc_to_warc.arc_records(arc_file(v, good[0], b"http://u 1.2.3.4 20200102030405 text/html x\nlost\nlines", good[1])))
        assert [("reason" in r, r.get("body")) for r in broken] == [(False, b"ab\ncd"), (True, None), (False, b"x")]
        packed = zlib.compressobj(wbits=31)
        packed = packed.compress(data) + packed.flush()
        assert [r["body"] for r in arc_to_warc.arc_records(packed)] == [b for _, b in good]
        assert "reason" in [*arc_to_warc.arc_records(packed[:40] + b"\0\0\0\0" + packed[44:])][-1]
    assert [r["reason"] for r in arc_to_warc.arc_records(b"no archive\n")] == ["the file has no version block"]
    assert list(arc_to_warc.arc_records(b"")) == []


def zipped(data):
    packer = zlib.compressobj(wbits=31)
    return packer.compress(data) + packer.flush()


@pytest.mark.parametrize("v", [1, 2])
def test_records_behind_a_damage(v):
    """Lengths that are too long (beyond the file, or into other records) and too short; broken members and broken streams."""
    good = [(f"http://u/{i}".encode(), f"body {i}\nof lines\n".encode() * 20) for i in range(6)]
    whole = arc_file(v, *good)
    starts = [whole.index(b"http://u/%d" % i) for i in range(6)]

    def urls(data):
        out = list(arc_to_warc.arc_records(data))
        return [r["URL"][-1] for r in out if "reason" not in r], sum("reason" in r for r in out)

    assert urls(whole) == (list("012345"), 0)
    length = str(len(good[2][1])).encode()
    for wrong in (b"99999", b"700", b"100"):
        line = whole[starts[2] : whole.index(b"\n", starts[2])]
        assert line.endswith(b" " + length)
        bad = whole[: starts[2]] + line[: -len(length)] + wrong + whole[starts[2] + len(line) :]
        assert urls(bad) == (list("01345"), 1)
        assert urls(zipped(bad)) == (list("01345"), 1)
    # a member per record, as crawlers write: one is broken in its midst, one at its end
    members = [zipped(whole[: starts[0]])] + [zipped(whole[a:b]) for a, b in zip(starts, [*starts[1:], len(whole)], strict=True)]
    for k in (1, 3, 6):
        cut = members[k][:20] + b"\xff\xff\xff\xff" + members[k][24:]
        got = urls(b"".join([*members[:k], cut, *members[k + 1 :]]))
        assert got == ([c for i, c in enumerate("012345") if i != k - 1], 1)
    late = members[3][:-8] + b"\0\0\0\0" + members[3][-4:]  # a wrong checksum: the record itself is whole
    assert urls(b"".join([*members[:3], late, *members[4:]])) == (list("012345"), 1)
    # one stream: what comes before the damage is read
    g = random.Random(1)
    many = arc_file(v, *[(f"http://u/{i % 10}".encode(), bytes(g.choices(range(97, 123), k=3000))) for i in range(40)])
    packed = zipped(many)
    found, rejects = urls(packed[: len(packed) // 2] + b"\xff" * 8 + packed[len(packed) // 2 + 8 :])
    assert 12 <= len(found) <= 22 and rejects == 1


def test_convert_foreign_archives(spark, tmp_path):
    page = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\n\r\ncaf\xe9"
    files = {"a.arc": arc_file(1, (b"http://x/1 2", page), (b"dns:x", b"1.2.3.4"), b"http://u damaged", (b"http://x/2", page)), "b.arc": arc_file(2, (b"http://x/3", page))[:-2]}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rejects = arc_to_warc.convert(spark, [f"file://{tmp_path}/*.arc"], f"file://{tmp_path}/warc").collect()
    assert sorted((r.reason.split(" ")[0]) for r in rejects) == sorted(["no", str(len(page))]) and all(r.offset > 0 for r in rejects)
    index = {r.url: r for r in arc_to_warc.read_warc(arc_to_warc.archive_files(spark, f"file://{tmp_path}/warc")).collect()}
    latin = base64.b32encode(hashlib.sha1(b"caf\xe9").digest()).decode()
    assert {u: (r.record_type, r.payload_bytes, r.date) for u, r in index.items() if u.startswith("dns")} == {"dns:x": ("resource", 7, "2020-01-02T03:04:05Z")}
    web = [r for u, r in index.items() if u.startswith("http")]
    assert {r.url for r in web} == {"http://x/1 2", "http://x/2"} and {r.payload_digest for r in web} == {latin} and sorted(r.record_type for r in web) == ["response", "revisit"]


# ---- 6 -------------------------------------------------------------------------------------


def test_toxicity_learns_and_scores_everything(spark, docs, none):
    g = random.Random(4)
    rows = []
    for i in range(600):
        w = words(60, i + 1000).split()
        if i % 4 == 0:
            w[g.randrange(60)] = g.choice(["vilewordly", "grumposaur"])
        rows.append((i, " ".join(w), *EXTRA))
    df = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")
    got = toxicity.toxicity(df, marks).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) / len(held) >= 0.95
    model = toxicity.train(df, marks)
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, model, score_col="s2").select(toxicity.F.col("s2").alias("score")).collect())
    assert toxicity.toxicity(none, marks).count() == 0
    assert toxicity.toxicity(docs, marks.limit(0)).count() == docs.count()


def test_ratios_weights_and_scores_by_recount():
    """Counts, chi-square, log-count ratios and unit length by plain loops over n-grams; the weights by their own objective; scores from the packed model."""
    g = random.Random(13)
    texts, label = [], []
    for i in range(160):
        w = words(12, 3000 + i).split()
        label.append(int(g.random() < 0.4))
        if label[-1] != (g.random() < 0.05):
            w[g.randrange(12)] = g.choice(["vileword", "Grumpo", "vile\u00e9"])
        texts.append(toxicity.encode(" ".join(w)))
    label = np.array(label)
    kept, weights, b = toxicity.fit(texts, label, share=0.25)
    feature = lambda gram: int((toxicity.Rolling(np.frombuffer(gram, dtype=np.uint8)).every(len(gram)) >> np.uint64(64 - toxicity.BITS))[0])
    sets = [{feature(t[i : i + n]) for n in (3, 4, 5) for i in range(len(t) - n + 1)} for t in texts]
    p, q = (Counter(f for x, y in zip(sets, label, strict=True) if y == k for f in x) for k in (1, 0))
    yes, no, n = int(label.sum()), int(len(label) - label.sum()), len(label)
    chi = {f: n * (p[f] * no - q[f] * yes) ** 2 / ((p[f] + q[f]) * (n - p[f] - q[f]) * yes * no) for f in p | q if p[f] + q[f] < n}
    want = sorted(f for f, c in chi.items() if c > toxicity.CHI)
    assert kept.tolist() == want and len(want) > 10
    size = 1 << toxicity.BITS
    r = np.array([np.log((p[f] + 1) / (sum(p.values()) + size)) - np.log((q[f] + 1) / (sum(q.values()) + size)) for f in want])
    assert np.allclose(weights[1], r**2)
    x = np.array([[v if f in s else 0.0 for f, v in zip(want, r, strict=True)] for s in sets])
    x /= np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]
    each = np.where(label > 0, 0.25 / yes, 0.75 / no)

    def loss(w, b):
        z = x @ w + b
        return float(each @ (np.logaddexp(0, z) - label * z) + 0.5e-5 * w @ w)

    w = weights[0] / r
    best, at, bias = None, w.copy(), b
    for _ in range(30):  # Newton's steps from there
        z = x @ at + bias
        s = 1 / (1 + np.exp(-z))
        one = np.column_stack([x, np.ones(n)])
        grad = one.T @ (each * (s - label)) + np.append(1e-5 * at, 0)
        step = np.linalg.solve(one.T @ (one * (each * s * (1 - s))[:, None]) + np.diag([1e-5] * len(at) + [1e-9]), grad)
        at, bias = at - 0.5 * step[:-1], bias - 0.5 * step[-1]
        best = min(loss(at, bias), best or 9)
    assert loss(w, b) <= best + 0.02 < loss(0 * w, b)
    model = np.float64(b).tobytes() + kept.astype("<i4").tobytes() + weights.astype("<f8").tobytes()
    assert np.allclose(toxicity.scores(texts, *toxicity.unpack_model(model)), 1 / (1 + np.exp(-(x @ w + b))))


# ---- 7 -------------------------------------------------------------------------------------


def test_containment_search(spark, docs, none):
    item = " ".join(TEXTS[5].split()[40:70])
    near = item.split()
    near[12] = "other"
    items = spark.createDataFrame([(1, item, 0), (2, "nothing of this kind is anywhere here", 0), (3, None, 0), (4, "", 0), (5, "One TWO", 0), (6, LONG, 0)], "item_id long, text string, doc_id long")
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(50, words(2000, 3) + " " + " ".join(near) + " " + words(2000, 4)), (51, "say one two now")], "doc_id long, text string"))
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in decontaminate.contaminated_pairs(more, items).collect()}

    def grams(t, k):
        w = (t or "").lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    want = {}
    for i in items.collect():
        k = min(5, len((i.text or "").split()))
        s = grams(i.text, k) if k else set()
        for d in more.collect():
            both = len(s & grams(d.text, k)) if k else 0
            if s and d.doc_id is not None and 5 * both >= 4 * len(s):
                want[d.doc_id, i.item_id] = (both, len(s))
    assert got == want and (50, 1) in got and (51, 5) in got and (10, 6) in got
    clean = decontaminate.decontaminate(docs, items)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in want}
    assert decontaminate.contaminated_pairs(none, items).count() == 0
    assert decontaminate.contaminated_pairs(docs, items.limit(0)).count() == 0


# ---- 8 -------------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(digits):
    twice = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(twice) + sum(map(int, digits[-1::-2]))) % 10 == 0


def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(t):
        digits = re.sub("[ -]", "", m[0])
        if 12 <= len(digits) <= 19 and plain_luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_patterns_equal_plain_regexes():
    g = random.Random(8)
    for letters in ("a@.1-+ ()25", "0123456789 -", "+12 ()-.", "4111 -") * 2000:
        t = "".join(g.choices(letters, k=g.randrange(60)))
        assert pii.base_spans(t) == plain_spans(t), t
    assert pii.base_spans("1" * 200_000 + "@" * 3 + "a" * 200_000) == []
    assert pii.base_spans("4111 1111-1111 1111") == [(0, 2, 19)]


def test_disclosure_equals_brute_force(spark):
    g = random.Random(11)
    vocabulary = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(150)]
    rows = []
    for i in range(260):
        w = g.choices(vocabulary, weights=[1 / (k + 1) for k in range(150)], k=12)
        if i % 9 == 0:
            who = g.randrange(8)
            w += [f"u{who}@d{who % 3}.example.com", f"nick{'abcdefgh'[who]}"]
        if i % 31 == 0:
            w += [f"10.0.{i % 2}.{i % 250}"]
        rows.append((i, " ".join(g.sample(w, len(w)))))
    rows += [(300 + i, rows[i][1]) for i in range(0, 40, 9)]  # copies count once
    texts = {t for _, t in rows}
    held, words_ = {}, {}
    for t in texts:
        spans = plain_spans(t)
        for s, k, e in spans:
            for x in pii.levels(k, t[s:e]):
                held.setdefault(x, set()).add(t)
        for m in re.finditer(r"[^\W\d_]+", t):
            if not any(s < m.end() and m.start() < e for s, _, e in spans):
                words_.setdefault(m[0].lower(), set()).add(t)
    n, want = len(texts), {}
    for e, own in held.items():
        for w, at in words_.items():
            both = len(own & at)
            if not both or len(own) == n:
                continue
            share = np.log2(both * n / (len(own) * len(at))) / np.log2(n / len(own))
            f, q = both / len(own), len(at) / n
            bound = np.exp(-len(own) * (f * np.log(f / q) + ((1 - f) * np.log((1 - f) / (1 - q)) if f < 1 else 0))) if f > q else 1
            if share >= pii.ALPHA and bound <= pii.LEVEL:
                want[e, w] = (len(own), len(at), both, round(share, 9))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.entity, r.term): (r.n_e, r.n_t, r.n_et, round(r.share, 9)) for r in pii.disclosing(df).collect()}
    assert got == want and any("*" in e for e, _ in want) and len(want) > 5


def test_values_are_generalised(spark):
    rows = [(i, f"{words(6, i)} mail a{i}@many.example.com {words(6, 900 + i)}") for i in range(40)]
    rows += [(50 + i, words(9, 50 + i)) for i in range(160)] + [(300, "only zed@rare.example.org here"), (301, "host 10.1.2.3 up"), (302, None)]
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "<EMAIL *@many.example.com>" in clean[0] and "a0@" not in clean[0]  # a fifth of all texts: little is given away
    assert "<EMAIL>" in clean[300] and "rare" not in clean[300] and "<IP>" in clean[301] and clean[302] == ""
    gone = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string"), general=False).collect()}
    assert "<" not in gone[0] and "@" not in gone[300]


def test_two_kinds_at_one_place(spark):
    """An address that is an email and an ip from its first character on, both with a wider entity that is safe."""
    rows = [(i, f"{words(5, i)} 10.0.0.{i % 250}@corp.example {words(5, 900 + i)}") for i in range(80)] + [(200 + i, words(9, 50 + i)) for i in range(320)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert len(clean) == 400 and all("<EMAIL *@corp.example>" in clean[i] and "10.0.0" not in clean[i] for i in range(80))


def test_disclosing_terms(spark, docs, none):
    rows = [(100 + i, f"{words(8, i)} secretmoniker bob@corp.example.com {words(8, i + 50)}", *EXTRA) for i in range(6)]
    df = docs.unionByName(spark.createDataFrame(rows, SCHEMA))
    got = {r.doc_id: r for r in pii.find_personal(df).collect() if r.doc_id is not None}
    assert all("term:" in got[100 + i].spans and got[100 + i].base.startswith("email:") for i in range(6))
    assert not any("term:" in r.spans for k, r in got.items() if k < 100)
    clean = {r.doc_id: r.text for r in pii.sanitise(df).where("doc_id >= 100").collect()}
    assert all("<TERM> <EMAIL>" in t and "bob" not in t for t in clean.values())
    assert pii.find_personal(none).count() == 0 and pii.find_personal(df).count() == df.count()


def test_terms_of_an_entity_seen_once(spark):
    rows = [(i, " ".join(f"{w}word" for w in words(12, i).split())) for i in range(500)]
    rows += [(500, "the zephyrmoniker ann@solo.example.com the end"), (501, "the end the zulu")]
    got = {r.doc_id: r for r in pii.find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "term:4:17" in got[500].spans and not any("term" in r.spans for k, r in got.items() if k < 500)


def test_terms_are_marked_wherever_they_stand(spark):
    # the term is twelve words from the entity, repeated, and in a text that does not name the entity; "zq" has two letters
    rows = [(i, " ".join(f"{w}word" for w in words(12, i).split())) for i in range(500)]
    far = rows[3][1]
    rows += [(600, f"zephyrmoniker zq {far} ann@solo.example.com"), (601, f"and Zephyrmoniker {rows[4][1]} zephyrmoniker"), *[(602 + i, f"zephyrmoniker zq {far} ann@solo.example.com") for i in range(30)], (None, "zephyrmoniker")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find_personal(df).collect()}
    assert got[600].startswith("term:0:13,term:14:16") and got[602] == got[600] and got[None] == "term:0:13"
    assert got[601].startswith("term:4:17") and got[601].endswith(f"term:{len(rows[501][1]) - 13}:{len(rows[501][1])}")
    # different texts count, not copies: 31 rows with the entity are one text of 503
    shares = {r.term: r.share for r in pii.disclosing(df).collect()}
    assert abs(shares["zephyrmoniker"] - np.log2(503 / 3) / np.log2(503)) < 1e-12 and shares["zq"] == 1
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert not any("zephyrmoniker" in t.lower() for t in clean.values())


# ---- 9 -------------------------------------------------------------------------------------


def test_chats_round_trip(spark):
    odd = ["<|im_end|>\n<|im_start|>user\n", "\\", "<\\|", "\\<|", "<", "", None, "<|im_sep|>", "é🙂\n\n", "a\\\\<|<\\\\|"]
    g = random.Random(9)
    rows = [(c, t, g.choice(["user", "assistant", "sys\ntem", None]), g.choice(odd) if g.random() < 0.7 else words(3, t), "x", 1) for c in [*range(30), None] for t in range(g.randrange(1, 9))]
    rows += [rows[0], (3, 1, "assistant", "<|x", "x", 1), (3, 1, "assistant", "<ax", "x", 1), (3, 1, "assistant", "<\\x", "x", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, loss int")
    back = {r.conv_id: r for r in chat_format.read_chats(chat_format.format_chats(df)).collect()}
    for c in [*range(30), None]:
        own = sorted((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c)
        assert [(t.role, t.text) for t in back[c].turns] == [(a, b) for _, a, b in own]
        learnt = [back[c].formatted[s.start : s.start + s.length] for s in back[c].loss]
        said = [b for _, a, b in own if a == "assistant"]
        assert [re.sub(r"<\\\|", "<|", x).replace("\\\\", "\\") for x in learnt] == said and back[c].learnt == "".join(said)
    assert chat_format.chat_digests(df.limit(0)).count() == 0


def test_a_long_chat_is_linear(spark):
    df = spark.range(16_000).selectExpr("1L as conv_id", "id as turn", "if(id % 3 = 0, 'user', 'assistant') as role", "concat('said <| ', id) as text")
    chat_format.chat_digests(df.limit(10)).collect()
    began = time.time()
    got = chat_format.read_chats(chat_format.format_chats(df)).collect()[0]
    assert time.time() - began < 8 and len(got.turns) == 16_000 and got.turns[15_999].text == "said <| 15999"
    assert [got.formatted[s.start : s.start + s.length] for s in got.loss[-2:]] == ["said <\\| 15997", "said <\\| 15998"]


# ---- 10 ------------------------------------------------------------------------------------


def test_ledger_scans_what_is_new(spark, docs, none, tmp_path):
    ledger = secret_scan.BlobLedger(spark, str(tmp_path / "ledger"))
    n = lambda: ledger.read().count()
    first = secret_scan.scan_secrets(docs, ledger=ledger)
    blobs = docs.select("text").distinct().collect()
    distinct = len({r.text or "" for r in blobs})
    assert n() == 3 * distinct and first.count() == docs.count()
    secret_scan.scan_secrets(docs, ledger=ledger)
    assert n() == 3 * distinct
    ledger = secret_scan.BlobLedger(spark, str(tmp_path / "ledger"))
    new = spark.createDataFrame([(77, "password: hunter2hunter2"), (78, "password: hunter2hunter2"), (79, None)], "doc_id long, text string")
    got = {r.path: [(s.kind, s.start, s.stop) for s in r.found] for r in secret_scan.scan_secrets(new, ledger=ledger).collect()}
    assert n() == 3 * distinct + 3
    assert got == {77: [("assign", 0, 24)], 78: [("assign", 0, 24)], 79: []}
    newer = (*secret_scan.RULES[:2], secret_scan.Rule("hex", "2", "[0-9a-f]{30,}"))
    secret_scan.scan_secrets(new, ledger=ledger, rules=newer)
    assert n() == 3 * distinct + 3 + 2
    assert secret_scan.scan_secrets(none).count() == 0


def test_scans_in_increments_share_a_ledger(spark, docs, tmp_path):
    ledger = secret_scan.BlobLedger(spark, str(tmp_path / "ledger"))
    got = Counter((r.path, r.blob, str(r.found)) for r in secret_scan.scan_in_increments(docs, increments=3, ledger=ledger).collect())
    assert got == Counter((r.path, r.blob, str(r.found)) for r in secret_scan.scan_secrets(docs).collect())
    rows = ledger.read().groupBy("blob", "rule").count()
    assert rows.where("count > 1").count() == 0 and rows.count() == 3 * len({r.text or "" for r in docs.select("text").collect()})
    # a known blob's text is not scanned again: a rule that would fail on it is never run for its version
    before = ledger.read().count()
    secret_scan.scan_secrets(docs, ledger=ledger)
    assert ledger.read().count() == before


def brute_secrets(text):
    found = []
    for k, rule in enumerate(secret_scan.RULES):
        for m in re.finditer(rule.pattern.replace("(?i:", "(?i:"), text):
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def brute_masked(text, mask="[SECRET]"):
    done, at = [], 0
    for a, _, b in brute_secrets(text):
        if a >= at:
            done += [text[at:a], mask]
        at = max(at, b)
    return "".join(done) + text[at:]


def test_spans_and_masks_as_plain_patterns(spark):
    """Matches of several kinds, some over each other, in runs longer than one cut of the text."""
    g = random.Random(8)
    parts = ["token=abcdef123", "secret: AKIA" + "A" * 18, "api_key='" + "ab" * 15 + "'", "deadbeef" * 4, "é🙂", " ", "password =x", "AKIA1", "\n", "plain words"]
    rows = [(i, "".join(g.choices(parts, k=n))) for i, n in enumerate((0, 1, 2, 30, 300, 2500))] + [(90, "token=abcdef"), (91, "token=" + "ab" * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.path: [(s.start, s.order, s.stop) for s in r.found] for r in secret_scan.scan_secrets(df).collect()}
    assert {i: [(a, k + 1, b) for a, k, b in brute_secrets(t)] for i, t in rows} == got and len(got[5]) > 2 * secret_scan.PIECE
    assert {r.doc_id: r.text for r in secret_scan.redact_secrets(df).collect()} == {i: brute_masked(t) for i, t in rows}


def test_many_findings_are_linear(spark):
    """Four times the findings take some four times as long, not sixteen times."""

    def took(n):
        df = spark.createDataFrame([(1, "token=abcdef123 x " * n)], "doc_id long, text string")
        began = time.time()
        assert secret_scan.secret_digests(df).first().n_assign == n
        assert secret_scan.redact_secrets(df).first().text == "[SECRET] x " * n
        return time.time() - began

    took(100)
    few = took(8000)
    assert took(32_000) < 8 * few + 2


def test_secrets_masked(spark, docs):
    clean = {r.doc_id: r.text for r in secret_scan.redact_secrets(docs).collect()}
    assert clean[12] == "é🙂 [SECRET] a@b.co" and clean[9] == LONG and clean[0] is None
    assert secret_scan.redact_secrets(docs).columns == docs.columns
    clash = spark.createDataFrame([(1, "token=abcdef123", "f", "b", "r", "c", 1), (1, "token=abcdef123", "f", "b", "r", "c", 1), (None, None, "f", "b", "r", "c", 2)], "doc_id long, text string, found string, _blob string, row string, clean string, blob int")
    assert Counter(tuple(r) for r in secret_scan.redact_secrets(clash).collect()) == Counter({(1, "[SECRET]", "f", "b", "r", "c", 1): 2, (None, None, "f", "b", "r", "c", 2): 1})
    assert secret_scan.redact_secrets(clash.limit(0)).count() == 0


def test_words_are_the_same_by_either_pattern():
    from isotherm.llm.pii import NARROW, WORD, words_of

    every = "".join(map(chr, range(256)))
    for text in (every, "Zoë’s 2² naïve_words", "ÿĀ", "a1b2 c_d", "", "\U00010400x", "\ud800y"):
        assert words_of(text).findall(text) == WORD.findall(text)
    assert words_of(every) is NARROW and words_of("ĀB") is WORD
