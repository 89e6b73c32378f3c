"""A Merkle manifest of a dataset, by superblocks.

Every row is a leaf; the leaves of a source, in the order of their ids, make its tree,
and the sources' subroots, in the order of their names, make the tree of the whole.
``fanout`` consecutive nodes become their hash, level by level, until one is left; a last run
may be shorter, even a single node, and is hashed all the same.

Indices are bucketed by ``fanout ** levels``: one task collapses up to ``levels`` levels of a
bucket and leaves a superblock, one row with its nodes and its root.  Superblock roots are the nodes
of the next round, so rounds are few and no tree has to fit a task.  Proofs
come down again: a node's steps within its superblock, then those of its superblock's root.

A step is the run of its level with null at the node's own place, so a fold puts the
hash there (``fold``) and the siblings are what is not null (``siblings``).

Null source: the first source; null id: before all others; rows that repeat an id are in
the order of their leaves, equal rows have equal leaves.  Null values hash as ``-``.  Very long texts
are hashed by Spark's own function.  No rows: no rows.  Extra columns are not hashed and
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotherm.llm.store import small, stage
from isotherm.llm.totals import running_totals

FANOUT = 3
#: levels that one superblock collapses: at most 243 nodes of fanout 3
LEVELS = 5
#: fixed values: the columns of a leaf, in the order of hashing
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_hash(columns: list[Column]) -> Column:
    """Lowercase hex of a row's digest: each value as its length in bytes, a colon and itself, or a dash."""
    return F.sha2(F.encode(F.concat(*[encoded(c) for c in columns]), "UTF-8"), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf, lambda h, run: F.sha2(F.encode(F.array_join(F.transform(run, lambda x: F.coalesce(x, h)), ""), "UTF-8"), 256))


def siblings(proof: Column) -> Column:
    """Digests of a proof, level by level, left to right."""
    return F.filter(F.flatten(proof), lambda x: x.isNotNull())


# ---- trees ------------------------------------------------------------------------------


def depth(n: int, fanout: int) -> int:
    """Levels above ``n`` nodes."""
    out = 0
    while n > 1:
        n, out = -(-n // fanout), out + 1
    return out


def collapse(nodes: list[str], fanout: int, levels: int) -> list[list[str]]:
    """The nodes and the levels above them."""
    out = [nodes]
    for _ in range(levels):
        nodes = [hashlib.sha256("".join(nodes[i : i + fanout]).encode()).hexdigest() for i in range(0, len(nodes), fanout)]
        out.append(nodes)
    return out


def steps(tower: list[list[str]], i: int, fanout: int) -> list[list[str | None]]:
    """What stands beside node ``i`` on each level of a superblock."""
    out = []
    for level in tower[:-1]:
        first = i // fanout * fanout
        run: list[str | None] = list(level[first : first + fanout])
        run[i - first] = None
        out.append(run)
        i //= fanout
    return out


BLOCKS = "tree string, block long, n long, nodes binary, ids array<string>, others array<binary>, root binary"


def superblocks(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """A row per bucket of ``nodes`` (tree, index, n, node, and id and other of leaves); ``n``: nodes of the whole tree in this round."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("index")
        first = frame.iloc[0]
        n, nodes_ = int(first["n"]), list(frame["node"])
        root = collapse([x.hex() for x in nodes_], fanout, min(levels, depth(n, fanout)))[-1][0]
        row = {"tree": first["tree"], "block": int(first["block"]), "n": n, "nodes": b"".join(map(bytes, nodes_)), "ids": list(frame["id"]), "others": list(frame["other"]), "root": bytes.fromhex(root)}
        return pd.DataFrame([row])

    block = F.floor(F.col("index") / F.lit(fanout**levels)).cast("long")
    return nodes.select("tree", "index", "n", "node", "id", "other", block.alias("block")).groupBy("tree", "block").applyInPandas(run, BLOCKS)


def climb(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """Superblocks round by round; the last has one per tree."""
    rounds = [stage(superblocks(nodes, fanout, levels), "superblocks")]
    most = rounds[0].agg(F.max("n")).first()[0] or 0
    while depth(most, fanout) > levels:
        size = fanout**levels
        up = rounds[-1].select("tree", F.col("block").alias("index"), F.ceil(F.col("n") / size).cast("long").alias("n"), F.col("root").alias("node"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("binary").alias("other"))
        rounds.append(stage(superblocks(up, fanout, levels), "superblocks"))
        most = -(-most // size)
    return rounds


PATHS = "tree string, index long, subroot binary, whole binary, steps array<array<string>>"
LEAVES = "id string, leaf string, other string, subroot string, root string, proof array<array<string>>"
_STEPS = pa.list_(pa.list_(pa.string()))


def expand(blocks: DataFrame, upper: DataFrame, fanout: int, levels: int, leaves: bool) -> DataFrame:
    """A row per node of ``blocks``: its steps, then those that ``upper`` (PATHS) has of its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                nodes = [b["nodes"][i : i + 32].hex() for i in range(0, len(b["nodes"]), 32)]
                tower = collapse(nodes, fanout, min(levels, depth(b["n"], fanout)))
                paths = pa.array([steps(tower, i, fanout) + b["steps"] for i in range(len(nodes))], _STEPS)
                many = len(nodes)
                if leaves:
                    other = [x if x is None else x.hex() for x in b["others"]]
                    texts = [b["ids"], nodes, other, [b["subroot"].hex()] * many, [b["whole"].hex()] * many]
                    yield pa.RecordBatch.from_arrays([*(pa.array(t, pa.string()) for t in texts), paths], names=["id", "leaf", "other", "subroot", "root", "proof"])
                else:
                    first = b["block"] * fanout**levels
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b["tree"]] * many, pa.string()), pa.array(range(first, first + many), pa.int64()), pa.array([b["subroot"]] * many, pa.binary()), pa.array([b["whole"]] * many, pa.binary()), paths],
                        names=["tree", "index", "subroot", "whole", "steps"],
                    )

    above = upper.select(F.col("tree").alias("in_tree"), F.col("index").alias("in_block"), "subroot", "whole", "steps")
    joined = blocks.join(small(above), (F.col("tree") == F.col("in_tree")) & (F.col("block") == F.col("in_block"))).drop("in_tree", "in_block", "root")
    return joined.mapInArrow(run, LEAVES if leaves else PATHS)


def descend(rounds: list[DataFrame], upper: DataFrame, fanout: int, levels: int, leaves: bool) -> DataFrame:
    for blocks in reversed(rounds[1:]):
        upper = stage(expand(blocks, upper, fanout, levels, False), "paths")
    return expand(rounds[0], upper, fanout, levels, leaves)


# ---- the manifest -------------------------------------------------------------------------


@dataclass
class Manifest:
    """Superblocks of the sources' trees and of the tree above them, round by round, and that tree's order of sources."""

    sources: list[DataFrame]
    top: list[DataFrame]
    order: DataFrame
    id_type: str
    fanout: int
    levels: int

    def proofs(self) -> DataFrame:
        """``id, leaf, other, subroot, root, proof`` of every row."""
        none = F.array().cast("array<array<string>>")
        whole = self.top[-1].select("tree", F.lit(0).cast("long").alias("index"), F.lit(None).cast("binary").alias("subroot"), F.col("root").alias("whole"), none.alias("steps"))
        paths = descend(self.top, whole, self.fanout, self.levels, False).drop("tree", "subroot")
        named = self.order.select("id", F.col("index").alias("place"), F.col("node").alias("subroot")).join(paths, F.col("place") == F.col("index"))
        upper = stage(named.select(F.col("id").alias("tree"), F.lit(0).cast("long").alias("index"), "subroot", "whole", "steps"), "paths")
        rows = descend(self.sources, upper, self.fanout, self.levels, True)
        return rows.withColumn("id", F.col("id").cast(self.id_type))


def indexed(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``rows`` (a stage table) with ``index``, their place within the group, and ``n``, its size."""
    numbered = running_totals(rows.withColumn("one", F.lit(1)), by, order, "one")
    return numbered.withColumnsRenamed({"before": "index", "total": "n"}).drop("one")


def build_manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", columns: tuple[str, ...] = COLUMNS, other: dict[str, Column] | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> Manifest:
    """The manifest of ``docs``.

    ``other``: columns to replace for a second hash of each row, which the leaves carry as ``other`` where it
    differs; it is in no tree, and serves to hold changed rows against the manifest.
    """
    own = leaf_hash([F.col(c) for c in columns])
    changed = leaf_hash([(other or {}).get(c, F.col(c)) for c in columns]) if other else own
    tree = F.when(F.col(source_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(source_col)))
    hashed = docs.select(F.col(id_col).alias("key"), tree.alias("tree"), own.alias("own"), changed.alias("changed"))
    rows = hashed.select("key", F.col("key").cast("string").alias("id"), "tree", F.unhex("own").alias("node"), F.when(F.col("changed") != F.col("own"), F.unhex("changed")).alias("other"), F.monotonically_increasing_id().alias("row"))
    leaves = indexed(stage(rows, "leaves"), "tree", ["key", "node", "row"])
    sources = climb(leaves, fanout, levels)
    roots = stage(sources[-1].select(F.lit("").alias("tree"), F.col("tree").alias("id"), F.col("root").alias("node"), F.lit(None).cast("binary").alias("other")), "subroots")
    order = stage(indexed(roots, "tree", ["id"]), "order")
    return Manifest(sources, climb(order, fanout, levels), order, dict(hashed.dtypes)["key"], fanout, levels)


def merkle_digests(docs: DataFrame) -> DataFrame:
    """Every row held against the manifest after line ends were deleted from half of the texts."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    proofs = build_manifest(docs, other={"text": tampered}).proofs()
    rows = proofs.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root",
        F.sha2(F.encode(F.array_join(siblings(F.col("proof")), ""), "UTF-8"), 256).alias("proof_sha256"),
        fold(F.coalesce("other", "leaf"), F.col("proof")).alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
