"""N-gram Jaccard join by multiple-global-order filtering.

Two texts can only reach the threshold t if, under *any* fixed order of all
shingles, they share one among the first ``n - ceil(t n) + 1`` of each.  So a
pair must pass this prefix test under every one of several orders:

1. rarest first by exact document frequency (ties by hash); this order makes
   the buckets.  Shingles of one text only come first and never meet anything;
2. frequency class, then a second hash;
3. frequency one (unshared) first, then a third hash.

Steps.  Chunks ask for the frequency of their distinct shingles (see
``chunks``) and keep, per text, its size, a 128-bit digest of its set and its
shared shingles.  Equal sets fold into one class.  Texts that
share a prefix shingle under order 1 form families (connected components of a
table that is linear in the postings).  A family of more than ``block`` texts (or ``block_tokens`` shingles) is split
into the components that its texts still form under order 2, and these under order 3: linked texts share a prefix
shingle under each order, so no split parts them.  Within a family only texts that share a prefix shingle
of order 1 meet; they pass length and orders 2 and 3, and only then exact verification.

A family that fits a block is compared in one task.  A larger one, such as a large group of near copies, is linked in levels:
its blocks each on their own, then one text of each group found there, until these fit one block.  What is not in the family's
largest group by then (few texts, in a group of near copies) is compared with all blocks.  So every pair that is not
connected through others is compared, and a group of n copies costs about n rows, not n^2 / block.
Pairs already joined through
others are left out, since only reachability is asked.  ``jaccard_links`` also asks for
the number of links of each row: there every candidate pair is verified, block by block, and a task returns one sum per text.

Null or blank texts have an empty set and are linked with nothing.  Rows link by their texts: a null id takes part, and is
never a least one; rows that repeat a ``doc_id`` each keep their own row.  Extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotherm.llm.chunks import CHUNK_BYTES, U64, answer, ask, build_chunks, flags_of, mix, ranges_for, unpack, with_answers
from isotherm.llm.components import connected_components, of_stars
from isotherm.llm.store import release, small, stage
from isotherm.llm.words import set_digests, shingle_sets

BLOCK = 128
BLOCK_TOKENS = 400_000
#: salts of the second and third order
SALTS = (U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB))


def prefix_length(n: np.ndarray, t: Fraction) -> np.ndarray:
    return n - -(-n * t.numerator // t.denominator) + 1


def frequency_class(df: np.ndarray) -> np.ndarray:
    """Frequencies in a byte: exact to 100, then in steps of a twelfth of a doubling."""
    return np.where(df <= 100, df, np.minimum(255, 100 + np.floor(12 * np.log2(np.maximum(df, 1) / 100)))).astype(np.uint8)


def _ask(width: int):
    def asked(row):
        _, _, h = shingle_sets(row.lens, row.data, width)
        keys, count = np.unique(h, return_counts=True)
        return keys, np.minimum(count, 65535).astype("<u2").view("V2")

    return asked


def _answer(keys: list[np.ndarray], extra: list[bytes]) -> list[np.ndarray]:
    _, at = np.unique(np.concatenate(keys), return_inverse=True)
    df = np.bincount(at, weights=np.concatenate([np.frombuffer(x, dtype="<u2") for x in extra]))
    return np.split(frequency_class(df)[at], np.cumsum([len(k) for k in keys])[:-1])


SETS = "chunk_id long, at int, doc_id long, text_hash long, n_shingles long, d1 long, d2 long, bucket array<long>, shared binary, classes binary"


def _sets(width: int, t: Fraction):
    def run(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = chunk.iloc[0]
        n_docs, doc, h = shingle_sets(row.lens, row.data, width)
        keys = np.unique(h)
        cls = flags_of(answers)[np.searchsorted(keys, h)] if len(h) else np.zeros(0, dtype=np.uint8)
        sizes, d1, d2 = set_digests(n_docs, doc, h)
        at = np.concatenate([[0], np.cumsum(sizes)])
        spare = prefix_length(sizes, t)
        out = []
        for i in range(n_docs):
            own, c = h[at[i] : at[i + 1]], cls[at[i] : at[i + 1]]
            shared = c > 1
            left = spare[i] - (len(own) - shared.sum())
            if not len(own) or left <= 0:
                out.append((None, None, None))
                continue
            own, c = own[shared], c[shared]
            order = np.lexsort((own, c))
            bucket = own[order[:left]]
            out.append((bucket.view(np.int64), own.tobytes(), c.tobytes()) if len(bucket) else (None, None, None))
        buckets, shared, classes = zip(*out, strict=True)
        lens, raw = unpack(row.lens, row.data)
        ends = np.cumsum(lens)
        hashes = np.array([xxhash.xxh64_intdigest(raw[e - n : e], 42) for e, n in zip(ends, lens, strict=True)], dtype=np.uint64).view(np.int64)  # as F.xxhash64 has it
        place = {"chunk_id": np.full(n_docs, row.chunk_id, dtype=np.int64), "at": np.arange(n_docs, dtype=np.int32), "text_hash": hashes}
        return pd.DataFrame(place | {"doc_id": pd.array(list(row.ids), dtype="Int64") if any(x is None or x != x for x in row.ids) else list(row.ids), "n_shingles": sizes, "d1": d1, "d2": d2, "bucket": buckets, "shared": shared, "classes": classes})[[x.split()[0] for x in SETS.split(", ")]]

    return run


def prefixes(n: int, shared: np.ndarray, classes: np.ndarray, t: Fraction) -> list[np.ndarray]:
    """A text's prefix under each of the three orders."""
    left = int(prefix_length(np.int64(n), t) - (n - len(shared)))
    width = np.log2(classes).astype(np.uint8)
    orders = np.lexsort((shared, classes)), np.lexsort((mix(shared ^ SALTS[0]), width)), np.argsort(mix(shared ^ SALTS[1]))
    return [shared[o[:left]] for o in orders]


class Family:
    """Texts that are compared with one another; ``group``: groups known to be connected."""

    def __init__(self, frame: pd.DataFrame, t: Fraction, group: np.ndarray | None = None):
        self.t = t
        self.n = frame["n_shingles"].to_numpy()
        self.sets, self.first, self.others = [], [], []
        for n, shared, classes in zip(self.n, frame["shared"], frame["classes"], strict=True):
            own = np.frombuffer(shared, dtype=np.uint64)
            one, two, three = prefixes(n, own, np.frombuffer(classes, dtype=np.uint8), t)
            self.sets.append(own)
            self.first.append(one.tolist())
            self.others.append((frozenset(two.tolist()), frozenset(three.tolist())))
        self.full: dict[int, frozenset] = {}
        self.degree = np.zeros(len(frame), dtype=np.int64)
        at: dict[int, int] = {}
        self.parent = list(range(len(frame))) if group is None else [at.setdefault(x, i) for i, x in enumerate(group.tolist())]

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def tokens(self, i: int) -> frozenset:
        if i not in self.full:
            self.full[i] = frozenset(self.sets[i].tolist())
        return self.full[i]

    def linked(self, i: int, j: int) -> bool:
        p, q = self.t.numerator, self.t.denominator
        small, large = sorted((int(self.n[i]), int(self.n[j])))
        if q * small < p * large:
            return False
        if any(x.isdisjoint(y) for x, y in zip(self.others[i], self.others[j], strict=True)):
            return False
        both = len(self.tokens(i) & self.tokens(j))
        return q * both >= p * (small + large - both)

    def links(self, side: np.ndarray | None, weight: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
        """Links that join what is still apart; with ``side``, only those between the two sides.

        With ``weight`` (rows of each text) every candidate pair is verified and ``degree`` sums the rows that each text links with.
        """
        # texts with few shingles of their own first: they link with most
        order = np.lexsort((self.n, self.n - np.array([len(x) for x in self.sets])))
        met: dict[int, list[int]] = {}
        for i in order.tolist():
            tried = set()
            for token in self.first[i]:
                for j in met.get(token, ()):
                    if j in tried or (side is not None and side[i] == side[j]):
                        continue
                    tried.add(j)
                    a, b = self.root(i), self.root(j)
                    if (a == b and weight is None) or not self.linked(i, j):
                        continue
                    if weight is not None:
                        self.degree[i] += weight[j]
                        self.degree[j] += weight[i]
                    if a != b:
                        self.parent[a] = b
                        yield i, j
            for token in self.first[i]:
                met.setdefault(token, []).append(i)


def _compare(t: Fraction, known: bool = False):
    """Links ``a, b`` of a family's texts: from each text to the least of its group; ``known``: only between the sides, groups given, to the root it reached."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        nodes = frame["node"].to_numpy()
        family = Family(frame, t, frame["group"].to_numpy() if known else None)
        before = [family.root(i) for i in range(len(nodes))]
        for _ in family.links(frame["side"].to_numpy() if known else None):
            pass
        roots = [family.root(i) for i in range(len(nodes))]
        if known:
            pairs = [(nodes[i], nodes[r]) for i, (b, r) in enumerate(zip(before, roots, strict=True)) if b != r and nodes[i] != nodes[r]]
        else:
            least: dict[int, int] = {}
            for i, r in enumerate(roots):
                least[r] = min(least.get(r, nodes[i]), nodes[i])
            pairs = [(nodes[i], least[r]) for i, r in enumerate(roots) if nodes[i] != least[r]]
        return pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")

    return run


def _count(t: Fraction):
    """Links as ``_compare``'s, and on rows where a = b the sum of rows that each text links with."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        one = frame["i"].iloc[0] == frame["j"].iloc[0]
        family = Family(frame, t)
        for _ in family.links(None if one else frame["block"].to_numpy(), frame["copies"].to_numpy()):
            pass
        nodes = frame["node"].to_numpy()
        rows = [(nodes[i], nodes[family.root(i)], 0) for i in range(len(nodes)) if family.root(i) != i] + [(i, i, n) for i, n in zip(nodes, family.degree, strict=True) if n]
        return pd.DataFrame(rows, columns=["a", "b", "n"], dtype="int64")

    return run


# ---- families --------------------------------------------------------------------------


def stars(posts: DataFrame, *by: str) -> DataFrame:
    """Edges from each text to the least one that shares its key."""
    least = posts.groupBy(*by).agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    return posts.join(least, list(by)).select(F.col("node").alias("a"), "b")


def families(edges: DataFrame) -> DataFrame:
    return connected_components(edges).select("node", F.col("component").alias("family"))


def sizes(placed: DataFrame, block: int, block_tokens: int) -> DataFrame:
    """``family, blocks``"""
    size = placed.groupBy("family").agg(F.count("*").alias("texts"), F.sum(F.length("classes").cast("long")).alias("tokens"))
    return size.select("family", F.greatest(F.ceil(F.col("texts") / block), F.ceil(F.col("tokens") / block_tokens)).cast("int").alias("blocks"))


def posts_of(placed: DataFrame, order: int, t: Fraction) -> DataFrame:
    """``family, token, node``: the prefixes of an order (1 for the second)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own = [prefixes(n, np.frombuffer(s, dtype=np.uint64), np.frombuffer(c, dtype=np.uint8), t)[order].view(np.int64) for n, s, c in zip(frame["n_shingles"], frame["shared"], frame["classes"], strict=True)]
            many = [len(x) for x in own]
            yield pd.DataFrame({"family": np.repeat(frame["family"].to_numpy(), many), "token": np.concatenate([np.zeros(0, dtype=np.int64), *own]), "node": np.repeat(frame["node"].to_numpy(), many)})

    return placed.select("family", "node", "n_shingles", "shared", "classes").mapInPandas(run, "family long, token long, node long")


def split(placed: DataFrame, t: Fraction, block: int, block_tokens: int) -> tuple[DataFrame, DataFrame]:
    """Families beyond a block split by the second and the third order; and ``family, blocks`` of those still beyond it."""
    for order in (1, 2, None):
        large = stage(sizes(placed, block, block_tokens).where("blocks > 1"), "large")
        if order is None or large.isEmpty():
            break
        ids = large.select("family")
        many = placed.join(small(ids), "family", "left_semi")
        finer = families(stars(posts_of(many, order, t), "family", "token"))
        rest = placed.join(small(ids), "family", "left_anti")
        # texts that meet nothing under this order leave
        placed = stage(rest.unionByName(many.drop("family").join(finer, "node").select(*rest.columns)), "split")
    return placed, large


def in_blocks(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("node"), blocks).cast("int")


def link_families(placed: DataFrame, t: Fraction, block: int, block_tokens: int) -> DataFrame:
    """``node, component`` of the texts that are linked within their family."""
    placed, large = split(placed, t, block, block_tokens)
    payload = ["node", "n_shingles", "shared", "classes"]
    if large.isEmpty():
        # each family in one comparison: its links are stars already
        links = stage(placed.repartition("family").groupBy("family").applyInPandas(_compare(t), "a long, b long"), "links")
        return of_stars(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    ids = large.select("family")
    whole = placed.join(small(ids), "family", "left_anti").repartition("family")
    links = [stage(whole.groupBy("family").applyInPandas(_compare(t), "a long, b long"), "links")]
    level = texts = stage(placed.join(small(ids), "family", "left_semi").select("family", *payload), "level")
    while not texts.isEmpty():
        blocks = stage(sizes(texts, block, block_tokens), "blocks")
        dealt = texts.join(small(blocks), "family").withColumn("i", in_blocks(F.col("blocks"))).repartition("family", "i")
        links.append(stage(dealt.groupBy("family", "i").applyInPandas(_compare(t), "a long, b long"), "links"))
        # of each group found in a block one text goes on, while a family has several blocks
        more = blocks.where("blocks > 1").select("family")
        roots = links[-1].select(F.col("b").alias("node")).distinct()
        texts = stage(texts.join(small(more), "family", "left_semi").join(roots, "node", "left_semi").select("family", *payload), "level")
    links.append(stage(_outside(level, _union(links[1:]), t, block, block_tokens), "links"))
    return connected_components(_union(links).where("a <> b"))


def _union(tables: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, tables)


def _outside(level: DataFrame, links: DataFrame, t: Fraction, block: int, block_tokens: int) -> DataFrame:
    """Links between the texts outside their family's largest group and all others."""
    group = connected_components(links).select("node", F.col("component").alias("group"))
    named = stage(level.select("family", "node", F.length("classes").alias("tokens")).join(group, "node", "left").select("family", "node", "tokens", F.coalesce("group", "node").alias("group")), "named")
    largest = named.groupBy("family", "group").agg(F.count("*").alias("n")).groupBy("family").agg(F.max_by("group", F.struct("n", "group")).alias("largest"))
    out = stage(named.join(largest, "family").where(F.col("group") != F.col("largest")).select("family", "node", "group", "tokens"), "outside")
    deal = lambda df: df.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("tokens") / block_tokens)).cast("int").alias("m"))
    bounds = stage(deal(out).select("family", F.col("m").alias("ob")).join(deal(named).select("family", F.col("m").alias("nb")), "family"), "bounds")
    both = level.join(named.select("node", "group"), "node").join(small(bounds), "family")
    ids = out.select("node").withColumn("out", F.lit(True))
    both = both.join(ids, "node", "left")
    # side 0: every text in its block, once for each block of the texts outside; side 1: those, once for each block of all
    zero = both.select("*", F.lit(0).alias("side"), in_blocks(F.col("nb")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("ob") - 1)).alias("j"))
    one = both.where("out").select("*", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("i"), in_blocks(F.col("ob")).alias("j"))
    dealt = zero.unionByName(one).select("family", "i", "j", "side", "group", "node", "n_shingles", "shared", "classes").repartition("family", "i", "j")
    return dealt.groupBy("family", "i", "j").applyInPandas(_compare(t, known=True), "a long, b long")


def count_links(placed: DataFrame, t: Fraction, block: int, block_tokens: int) -> DataFrame:
    """``a, b, n``: every candidate pair verified, in pairs of blocks."""
    large = stage(sizes(placed, block, block_tokens).where("blocks > 1"), "large")
    dealt = (
        placed.join(small(large), "family", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", in_blocks(F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n_shingles", "shared", "classes", "copies")
    )
    # else a shuffle by family alone would do for the grouping, and a large family be one task again
    return dealt.repartition("family", "i", "j").groupBy("family", "i", "j").applyInPandas(_count(t), "a long, b long, n long")


# ---- the join --------------------------------------------------------------------------------


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, threshold: Fraction = Fraction(9, 10), block: int = BLOCK, block_tokens: int = BLOCK_TOKENS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    ``threshold`` is compared in integers.  ``component_id`` is the least id
    reachable by links, the row's own id included; null ids are never least.
    ``chunk_bytes``: text packed into one row; larger chunks ask in fewer rows and take more memory in a task.
    """
    return _join(docs, id_col, text_col, width, threshold, block, block_tokens, chunk_bytes, False).select("doc_id", "n_shingles", "component_id")


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, threshold: Fraction = Fraction(9, 10), block: int = 4 * BLOCK, block_tokens: int = BLOCK_TOKENS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``jaccard_components`` and ``n_links``: how many other rows the row is linked with, rows of equal sets included."""
    return _join(docs, id_col, text_col, width, threshold, block, block_tokens, chunk_bytes, True).select("doc_id", "n_shingles", "component_id", "n_links")


def _join(docs: DataFrame, id_col: str, text_col: str, width: int, threshold: Fraction, block: int, block_tokens: int, chunk_bytes: int, count: bool) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id, first`` (the row of the least id, then text hash, in its group), and ``n_links``."""
    chunks = build_chunks(docs, id_col, text_col, chunk_bytes)
    asks = ask(chunks, _ask(width), ranges_for(chunks))
    answers = answer(asks, _answer)
    sets = stage(with_answers(chunks, answers, _sets(width, threshold), SETS), "sets")
    release(chunks)  # all that follows reads ``sets``

    # equal sets are one class, compared by one of its rows
    digest = ["n_shingles", "d1", "d2"]
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    filled = sets.where("n_shingles > 0")
    classes = filled.groupBy(*digest).agg(F.min(row).alias("first"), F.count("*").alias("copies"), F.min(F.struct("chunk_id", "at")).alias("place"))
    places = classes.select("place.*", "first", "copies")
    with_bucket = filled.where("bucket is not null").join(places, ["chunk_id", "at"])
    reps = stage(with_bucket.select(F.monotonically_increasing_id().alias("node"), *digest, "first", "copies", "bucket", "shared", "classes"), "reps")
    family = families(stars(reps.select("node", F.explode("bucket").alias("token")), "token"))
    placed = stage(reps.select("node", "n_shingles", "copies", "shared", "classes").join(family, "node"), "placed")
    if count:
        links = stage(count_links(placed, threshold, block, block_tokens), "links")
        component = connected_components(links.where("a <> b"))
    else:
        component = link_families(placed.drop("copies"), threshold, block, block_tokens)
    least = component.join(reps.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("first"))
    joined = component.join(least, "component").select("node", "first")
    found = reps.select("node", *digest).join(joined, "node")
    if count:
        sums = links.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
        found = found.join(sums, "node", "left")
    found = found.drop("node")
    both = classes.select(*digest, F.col("first").alias("own"), "copies").join(found, digest, "left")
    n_links = [(F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")] if count else []
    # a table of its own, so that a digest which a third of all rows share is a skewed join that Spark can split
    both = stage(both.select(*digest, F.coalesce("first", "own").alias("first"), *n_links), "groups")
    out = sets.select("doc_id", "text_hash", *digest).join(both, digest, "left")
    return out.select("doc_id", "text_hash", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"), "first", *([F.coalesce("n_links", F.lit(0)).alias("n_links")] if count else []))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each group of linked texts: that of the least id, of equal ids that of the least text hash.

    A row without an id stays only in a group without ids.  Blank texts all stay.  Of rows that
    repeat an id and a text one stays; rows that repeat an id with texts that are not linked all stay.
    """
    how = {"width": 3, "threshold": Fraction(9, 10), "block": BLOCK, "block_tokens": BLOCK_TOKENS, "chunk_bytes": CHUNK_BYTES} | how
    found = stage(_join(docs, id_col, text_col, count=False, **how).where("n_shingles > 0"), "linked")
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    key = [F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")]
    gone = stage(found.where(own != F.col("first")).select(*key).distinct(), "gone")
    again = stage(found.where(own == F.col("first")).groupBy("doc_id", "text_hash").count().where("count > 1").select(*key), "again")
    same = lambda other: docs[id_col].cast("long").eqNullSafe(other["gone_id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == other["gone_hash"])
    kept = docs.join(small(gone), same(gone), "left_anti")
    if again.isEmpty():
        return kept
    once = kept.join(small(again), same(again), "left_semi")
    return kept.join(small(again), same(again), "left_anti").unionByName(once.dropDuplicates([id_col, text_col]))
