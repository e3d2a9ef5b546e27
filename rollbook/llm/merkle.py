"""A Merkle manifest as a persistent tree: a change copies only the nodes above its leaf.

Every row is a leaf. Leaves of a group stand in key order; while more than one node remains, each
run of ``FANOUT`` consecutive nodes becomes its digest. The last node of a group is its subroot, and
the subroots, in group order, become the root of the dataset in the same way.

The tree is cut into aligned blocks of ``FANOUT ** DEPTH`` leaves, one row each. Version 0 of a
block (``Block``) holds all its nodes. Every tampered leaf makes a version of its own: it copies the
nodes from the leaf to the block's root and reads every other node from version 0. Upper rounds do
the same with the block roots as leaves, so a round shrinks the table 512 times and the loop ends
after log512 of the largest group. On the way down each block gets the siblings of its root up to
the dataset's root, with which its versions go on above the block. A block holds at most 512
versions, so no task grows with the number of changes, however many lie below one upper node.

Positions come from a range partitioning by (group, key, leaf): the rows of a group in a partition
are counted, and a running sum over partitions gives the first position. Neither a group nor the
order of all rows ever lies in one task, and only the height of the tree reaches the driver.

Nulls: a null field is ``-``; null groups and keys come first and are leaves like all others; a row
with a null key or text is never tampered. Rows of one key are ordered by their leaf; equal rows are
separate, equal leaves. An empty table has no rows and no root. Texts of any length go through one
digest expression in the JVM, and only digests go to Python. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

FANOUT = 8
#: Levels of an aligned block.
DEPTH = 3
BLOCK = FANOUT**DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
NODES = "version long, grp string, level int, digest string"


def sha(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(c: Column) -> Column:
    value = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(*values: Column) -> Column:
    """Digest of a row: every value with its byte count, so no two rows of values read alike."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


class Block:
    """An aligned block. Version 0 holds every node; a version holds only what it copied."""

    def __init__(self, leaves: list[str], levels: int):
        self.levels = [list(leaves)]
        for _ in range(levels):
            below = self.levels[-1]
            self.levels.append([sha(below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)])

    def siblings(self, i: int) -> list[tuple[list[str], list[str]]]:
        """Per level, the nodes left and right of the path from leaf ``i``."""
        out = []
        for below in self.levels[:-1]:
            lo = i - i % FANOUT
            out.append((below[lo:i], below[i + 1 : lo + FANOUT]))
            i //= FANOUT
        return out

    def version(self, i: int, digest: str) -> list[tuple[int, int, str]]:
        """(level, position, digest) of the copied nodes: the new leaf and its ancestors in the block."""
        copied = [(0, i, digest)]
        for level, (left, right) in enumerate(self.siblings(i)):
            i //= FANOUT
            copied.append((level + 1, i, sha([*left, copied[-1][2], *right])))
        return copied


def levels_of(nodes: int) -> int:
    """Levels that a block climbs in a group of so many nodes: none above the last node."""
    n = 0
    while nodes > 1 and n < DEPTH:
        nodes, n = -(-nodes // FANOUT), n + 1
    return n


def positions(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``_pos`` in its ``grp`` by ``order`` and ``_n``, the rows of the group; written before they are counted."""
    placed = stored(
        rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), name)
    runs = placed.groupBy("grp", "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"))
    w = Window.partitionBy("grp")
    before = F.coalesce(F.sum("_rows").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("grp", "_part", "_first", before.alias("_before"), F.sum("_rows").over(w).alias("_n"))
    return placed.join(runs, ["grp", "_part"]).withColumn("_pos", F.col("_before") + F.col("_row") - F.col("_first")).drop("_part", "_row", "_first", "_before")


def blocks_of(nodes: DataFrame, *extra: str) -> DataFrame:
    """One row per aligned block: (grp, _n, _block, nodes), nodes by position."""
    return nodes.groupBy("grp", F.expr(f"_pos div {BLOCK}").alias("_block")).agg(
        F.max("_n").alias("_n"), F.sort_array(F.collect_list(F.struct("_pos", "digest", *extra))).alias("nodes"))


def _roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        roots = [Block(list(digests), levels_of(n)).levels[-1][0] for digests, n in zip(b["digests"], b["_n"])]
        yield pd.DataFrame({"grp": b["grp"], "_n": -(-b["_n"] // BLOCK), "_pos": b["_block"], "digest": roots})


def _children(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For every child of an upper block, its siblings up to the root: within the block, then above it."""
    for b in batches:
        for grp, block, n, digests, left, right, subroot, root in zip(b["grp"], b["_block"], b["_n"], b["digests"], b["left"], b["right"], b["subroot"], b["root"]):
            tree = Block(list(digests), levels_of(n))
            paths = [tree.siblings(i) for i in range(len(digests))]
            yield pd.DataFrame({
                "grp": grp, "_block": block * BLOCK + pd.RangeIndex(len(digests)).to_numpy(), "left": [["".join(x) for x, _ in p] + list(left) for p in paths],
                "right": [["".join(x) for _, x in p] + list(right) for p in paths], "subroot": subroot, "root": root})


PATHS = "grp string, _block long, left array<string>, right array<string>, subroot string, root string"


class Upper:
    """The blocks of every round over the leaf blocks of one tree, and its top: one node per group."""

    def __init__(self, blocks: DataFrame, rounds: int):
        self.rounds = [blocks]
        for r in range(rounds):
            slim = self.rounds[-1].select("grp", "_n", "_block", F.col("nodes.digest").alias("digests"))
            nodes = slim.mapInPandas(_roots, "grp string, _n long, _pos long, digest string")
            if r == rounds - 1:
                self.top = stored(nodes.select("grp", "digest"), "merkle_top")
            else:
                self.rounds.append(stored(blocks_of(nodes), "merkle_blocks"))

    def paths(self, above: DataFrame) -> DataFrame:
        """(grp, _block, left, right, subroot, root) for the leaf blocks; ``above`` is the same for the top, by grp."""
        found = above.withColumn("_block", F.lit(0).cast("long"))
        for blocks in self.rounds[:0:-1]:
            slim = blocks.select("grp", "_n", "_block", F.col("nodes.digest").alias("digests"))
            found = slim.join(found, ["grp", "_block"]).mapInPandas(_children, PATHS)
        return found


def rounds_of(positioned: DataFrame) -> int:
    most, n = positioned.agg(F.max("_n")).first()[0] or 1, 1
    while most > BLOCK:
        most, n = -(-most // BLOCK), n + 1
    return n


def above(node: str, left: list[str], right: list[str]) -> list[str]:
    """A block's root and, level by level, the nodes that its change copies above the block."""
    out = [node]
    for lo, hi in zip(left, right):
        out.append(sha([lo, out[-1], hi]))
    return out


def _proofs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for n, digests, changed, left, right, subroot, root, ids in zip(b["_n"], b["digests"], b["changed"], b["left"], b["right"], b["subroot"], b["root"], b["ids"]):
            tree, proofs, folded = Block(list(digests), levels_of(n)), [], []
            for i, (digest, new) in enumerate(zip(digests, changed)):
                beside = [d for pair in tree.siblings(i) for side in pair for d in side]
                proofs.append(sha([*beside, *(d for pair in zip(left, right) for d in pair)]))
                folded.append(above(tree.version(i, new or digest)[-1][2], left, right)[-1])
            out = pd.DataFrame({"leaf": list(digests), "subroot": subroot, "root": root, "proof_sha256": proofs, "folded_root": folded})
            out.insert(0, "doc_id", pd.array([int(x) if x else None for x in ids], dtype="Int64"))
            yield out.assign(verified=out["folded_root"] == out["root"])


def _copied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for grp, n, digests, changed, left, right, ids in zip(b["grp"], b["_n"], b["digests"], b["changed"], b["left"], b["right"], b["ids"]):
            tree, out = Block(list(digests), levels_of(n)), []
            for i, new in enumerate(changed):
                if new:
                    copied = tree.version(i, new)
                    upper = above(copied[-1][2], left, right)[1:]
                    nodes = [digest for _, _, digest in copied] + upper
                    out += [(int(ids[i]), grp, level, digest) for level, digest in enumerate(nodes)]
            yield pd.DataFrame(out, columns=["version", "grp", "level", "digest"])


class Manifest:
    """The tree over ``docs`` (columns ``FIELDS``), grouped by lang and ordered by doc_id, with its tampered versions."""

    def __init__(self, docs: DataFrame):
        text = F.col("text")
        tampered = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0) & text.rlike("[A-Z]")
        rows = docs.select(
            F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("lang"))).alias("grp"), F.col("doc_id").cast("long").alias("doc_id"),
            leaf(*[F.col(c) for c in FIELDS]).alias("digest"),
            F.when(tampered, leaf(*[F.col(c) for c in FIELDS[:-1]], F.translate(text, UPPER, LOWER))).alias("changed"))
        placed = positions(rows, ["doc_id", "digest"], "merkle_leaves")
        self.blocks = stored(blocks_of(placed, "doc_id", "changed"), "merkle_blocks")
        groups = Upper(self.blocks, rounds_of(self.blocks))
        # the subroots are the leaves of one more tree, whose only group is the dataset
        tops = positions(groups.top.select(F.lit("").alias("grp"), F.col("grp").alias("of"), "digest"), ["of"], "merkle_subroots")
        tops = stored(blocks_of(tops, "of"), "merkle_blocks")
        whole = Upper(tops, rounds_of(tops))
        start = whole.top.select("grp", F.array().cast("array<string>").alias("left"), F.array().cast("array<string>").alias("right"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
        down = tops.join(whole.paths(start), ["grp", "_block"]).select("grp", "_n", "_block", F.col("nodes.digest").alias("digests"), F.col("nodes.of").alias("ofs"), "left", "right", "root")
        self.paths = stored(groups.paths(down.mapInPandas(_tops, "grp string, left array<string>, right array<string>, subroot string, root string")), "merkle_paths")

    def proofs(self) -> DataFrame:
        """One row per leaf: its digest, roots, digest of its proof, and the root folded from its version."""
        return self._with_paths().mapInPandas(_proofs, PROOFS)

    def copied_nodes(self) -> DataFrame:
        """The nodes that each version (the id of its tampered leaf) copied: ``NODES``, up to the dataset's root."""
        return self._with_paths().mapInPandas(_copied, NODES)

    def _with_paths(self) -> DataFrame:
        ids = F.transform("nodes.doc_id", lambda x: F.coalesce(x.cast("string"), F.lit("")))
        return self.blocks.join(self.paths, ["grp", "_block"]).select(
            "grp", "_n", ids.alias("ids"), F.col("nodes.digest").alias("digests"), F.col("nodes.changed").alias("changed"), "left", "right", "subroot", "root")


def _tops(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for n, digests, ofs, left, right, root in zip(b["_n"], b["digests"], b["ofs"], b["left"], b["right"], b["root"]):
            tree = Block(list(digests), levels_of(n))
            paths = [tree.siblings(i) for i in range(len(digests))]
            yield pd.DataFrame({
                "grp": list(ofs), "left": [["".join(x) for x, _ in p] + list(left) for p in paths], "right": [["".join(x) for _, x in p] + list(right) for p in paths],
                "subroot": list(digests), "root": root})
