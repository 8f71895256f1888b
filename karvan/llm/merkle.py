"""Merkle dataset manifest with incremental witnesses.

The rows of a tree are appended in order to a frontier of open subtrees. A new node takes the
nodes already in its run as a partial witness; every node of the run that completes later
extends the witness of the earlier ones, so a leaf's witness grows from left to right, level by
level, and no node is visited twice. Trees of any size are built from aligned blocks of
``FANOUT ** HEIGHT`` leaves: a block is appended inside one task, and the roots of the blocks
are the appends of the next round, until every tree has one node. The roots of all trees are
appended to one tree on top of them in the same way.

Cases: a null field is the text ``-``; rows are ordered by id with null first, equal ids by leaf;
repeated rows are leaves of their own; null is a tree of its own and the first one; an empty
table has no tree. Columns of the input that are not fields do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from karvan.llm.common import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes in a run, and the levels of a block that one task builds (4,096 leaves).
FANOUT, HEIGHT = 8, 4
WITNESS = "tree string, pos long, size long, witness binary, block_root binary"


def leaf_hash(values: Sequence[Column]) -> Column:
    """Digest of fields, each as its UTF-8 byte count, a colon and the value; ``-`` for null."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def node_hash(digests: Sequence[bytes]) -> bytes:
    return sha256("".join([d.hex() for d in digests]).encode()).digest()


def levels_of(size: int, fanout: int = FANOUT) -> int:
    """Levels that a tree of ``size`` leaves needs above them."""
    levels = 0
    while size > 1:
        size, levels = -(-size // fanout), levels + 1
    return levels


class Frontier:
    """Open subtrees of a block and the witnesses of its leaves so far."""

    def __init__(self, levels: int, fanout: int) -> None:
        self.levels, self.fanout = levels, fanout
        #: Per level the run being filled: digest, first leaf, end of leaves.
        self.runs: list[list[tuple[bytes, int, int]]] = [[] for _ in range(levels + 1)]
        self.witnesses: list[bytearray] = []

    def append(self, digest: bytes) -> None:
        at = len(self.witnesses)
        self.witnesses.append(bytearray())
        self._join(0, digest, at, at + 1)

    def _join(self, level: int, digest: bytes, start: int, end: int) -> None:
        run = self.runs[level]
        if run:
            partial = b"".join([d for d, _, _ in run])
            for witness in self.witnesses[run[0][1] : start]:
                witness += digest
            for witness in self.witnesses[start:end]:
                witness += partial
        run.append((digest, start, end))
        if len(run) == self.fanout and level < self.levels:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.runs[level] = self.runs[level], []
        self._join(level + 1, node_hash([d for d, _, _ in run]), run[0][1], run[-1][2])

    def close(self) -> bytes:
        """End of the block: short runs become nodes as they are. Returns the root."""
        for level in range(self.levels):
            if self.runs[level]:
                self._complete(level)
        return self.runs[self.levels][0][0]


def append_blocks(nodes: DataFrame, fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """``(tree, pos, size, digest)`` -> the witness of each node in its block.

    The first row of a block carries the block's root, the rest null.
    """
    span = fanout**height

    def build(block: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        frontier = Frontier(min(height, levels_of(block["size"][0].as_py(), fanout)), fanout)
        for digest in block["digest"].to_pylist():
            frontier.append(digest)
        root = frontier.close()
        roots = pa.array([root] + [None] * (len(block) - 1), pa.binary())
        witnesses = pa.array([bytes(w) for w in frontier.witnesses], pa.binary())
        return pa.table([block["tree"], block["pos"], block["size"], witnesses, roots], ["tree", "pos", "size", "witness", "block_root"])

    blocks = nodes.select("tree", "pos", "size", "digest", F.floor(F.col("pos") / span).alias("_block"))
    return blocks.groupBy("tree", "_block").applyInArrow(lambda block: build(block), WITNESS)


def in_positions(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Add ``pos`` (rank in the tree, from 0) and ``size`` (of the tree) to rows with ``tree``.

    Rows are range-partitioned, so a tree of any size spreads over tasks; only one count per
    tree and partition is added up. Rows equal in all of ``order`` may be in different tasks.
    """
    keys = ["tree", *order, "_tie"]
    spread = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    kept = written(spread.drop("_tie").withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), name)
    counts = kept.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("tree").alias("_tree"),
        F.col("_part").alias("_of"),
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("long")) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(Window.partitionBy("tree")).alias("size"),
    )
    placed = kept.join(starts, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("_part") == F.col("_of")))
    return placed.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_tree", "_of", "_shift")


def _grown(nodes: DataFrame, name: str, fanout: int, height: int) -> tuple[list[DataFrame], DataFrame]:
    """All rounds of appends (written tables), and ``(tree, root)`` of the finished trees."""
    size = nodes.agg(F.max("size")).first()[0] or 0
    rounds, span = [], fanout**height
    while True:
        rounds.append(written(append_blocks(nodes, fanout, height), f"{name}-{len(rounds)}"))
        roots = rounds[-1].where("block_root IS NOT NULL")
        size = math.ceil(size / span)
        if size <= 1:
            return rounds, roots.select("tree", F.col("block_root").alias("root"))
        nodes = roots.select("tree", F.floor(F.col("pos") / span).alias("pos"), F.ceil(F.col("size") / span).alias("size"), F.col("block_root").alias("digest"))


def _with_upper(rounds: list[DataFrame], upper: DataFrame, extra: Sequence[str], span: int) -> DataFrame:
    """Witnesses of the first round, completed by those of the rounds above and of ``upper``.

    ``upper`` has one row per tree: ``tree``, ``witness`` and the columns ``extra``. Tables are
    joined from the top, so that no join has more rows to a key than a block has nodes.
    """
    above = upper.withColumn("pos", F.lit(0).cast("long"))
    for part in reversed(rounds):
        a, p = above.select("tree", "pos", "witness", *extra).alias("a"), part.drop("block_root").alias("p")
        same = F.col("p.tree").eqNullSafe(F.col("a.tree")) & (F.floor(F.col("p.pos") / span) == F.col("a.pos"))
        above = p.join(a, same).select(
            "p.tree", "p.pos", "p.size", F.concat("p.witness", "a.witness").alias("witness"), *[F.col(f"a.{c}") for c in extra]
        )
    return above


def manifest(leaves: DataFrame, order: Sequence[str], fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """``(tree, digest, ...)`` -> the rows with the proof of each leaf.

    Added: ``pos, size`` in the tree; ``witness``, the siblings' digests level by level through
    the tree and the tree of roots; ``top_pos, top_size`` in that one; ``subroot`` and ``root``.
    """
    span = fanout**height
    placed = written(in_positions(leaves, [*order, "digest"], "merkle-leaves"), "merkle-placed")
    rounds, subroots = _grown(placed, "merkle-round", fanout, height)
    named = subroots.select(F.lit(None).cast("string").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    tops = written(in_positions(named, ["name"], "merkle-roots"), "merkle-tops")
    top_rounds, root = _grown(tops, "merkle-top", fanout, height)
    apex = root.select("tree", "root", F.lit(b"").alias("witness"))
    lifted = _with_upper(top_rounds, apex, ["root"], span).alias("w")
    named_tops = tops.alias("t").join(lifted, F.col("t.pos") == F.col("w.pos"))
    upper = named_tops.select(
        F.col("t.name").alias("tree"), F.col("t.digest").alias("subroot"), "root", "witness", F.col("t.pos").alias("top_pos"), F.col("t.size").alias("top_size")
    )
    full = _with_upper(rounds, upper, ["subroot", "root", "top_pos", "top_size"], span).drop("size").alias("f")
    same = F.col("l.tree").eqNullSafe(F.col("f.tree")) & (F.col("l.pos") == F.col("f.pos"))
    return placed.alias("l").join(full, same).select("l.*", "f.witness", "f.subroot", "f.root", "f.top_pos", "f.top_size")


def fold(leaf: bytes, witness: bytes, places: Sequence[tuple[int, int]], fanout: int = FANOUT) -> bytes:
    """Root recomputed from a leaf and its siblings; ``places`` are (pos, size) per tree, upwards."""
    digest, at, width = leaf, 0, len(leaf)
    for pos, size in places:
        while size > 1:
            before, run = pos % fanout, min(fanout, size - pos // fanout * fanout)
            siblings = [witness[at + i * width : at + (i + 1) * width] for i in range(run - 1)]
            digest = node_hash([*siblings[:before], digest, *siblings[before:]])
            at, pos, size = at + (run - 1) * width, pos // fanout, -(-size // fanout)
    return digest


def verify(proofs: DataFrame, claimed: str, fanout: int = FANOUT) -> DataFrame:
    """Add ``proof`` (digest of the siblings) and ``folded`` (root from column ``claimed``)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (claimed, "witness", "pos", "size", "top_pos", "top_size")]
            proof = [sha256(w.hex().encode()).digest() for w in columns[1]]
            folded = [fold(leaf, w, ((p, n), (tp, tn)), fanout) for leaf, w, p, n, tp, tn in zip(*columns, strict=True)]
            rest = batch.drop_columns(["witness"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(proof, pa.binary()), pa.array(folded, pa.binary())], [*rest.schema.names, "proof", "folded"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in proofs.schema.fields if f.name != "witness")
    return proofs.mapInArrow(check, f"{kept}, proof binary, folded binary")
