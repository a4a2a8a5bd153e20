"""Merkle manifest of a table as a persistent tree: one tree for each source, one tree over the sources' roots.

A digest is the lower-case hexadecimal SHA-256 of its inputs in a row. Leaves of a source ascend by id (rows equal in id
by leaf); while several nodes remain, every ``FANOUT`` neighbours become one.

* Leaves get their places by ranges of (source, id), so a source of any size is dealt like many small ones. Aligned blocks
  of ``BLOCK`` leaves, a power of the fan-out, are rows of a table; whatever the size of a source, a task sees one block.
* Above the blocks every level is one aggregation of at most ``FANOUT`` nodes to a group, written once; it holds a
  sixteenth of the level below. The tree over the sources is built the same way.
* Siblings go down again level by level, so every block knows its way up to the root.
* A changed leaf makes a version of the tree. It shares every node but the ancestors of its leaf, which are copied: those
  inside the block from the block's own levels, those above it along the block's way up. Versions stay with their block,
  so any number of them is spread as the leaves are.

Nulls: a null source is a source of its own and comes first; null ids come first in their source. Rows equal in all fields
are leaves of their own, one after the other. Extra columns play no part. An empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar.operators.ordering import ordinal
from isobar.session import materialize

FANOUT, BLOCK = 16, 256


def field(value: Column) -> Column:
    """A field with its length in front, so that no two rows read alike; ``-`` for null."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _joined(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, ""), 256)


def _narrower(width: Column, by: int) -> Column:
    return F.ceil(width / by).cast("long")


# --- one block --------------------------------------------------------------------------------------------


class BlockTree:
    """The levels of one aligned block. Versions share them and hold only the ancestors of their changed leaf."""

    def __init__(self, leaves: list[str], depth: int):
        self.levels = [leaves]
        for _ in range(depth):
            below = self.levels[-1]
            self.levels.append([digest(below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)])

    def siblings(self, at: int) -> Iterator[tuple[str, str]]:
        """What stands before and after the ancestors of a leaf in their runs, level by level."""
        for level in self.levels[:-1]:
            first = at - at % FANOUT
            yield "".join(level[first:at]), "".join(level[at + 1 : first + FANOUT])
            at //= FANOUT


def copied(leaf: str, way: Sequence[tuple[str, str]]) -> list[str]:
    """The ancestors of a leaf in its version, up to the version's root; all other nodes are shared."""
    out = []
    for before, after in way:
        leaf = digest((before, leaf, after))
        out.append(leaf)
    return out


def _depth(width: int) -> int:
    return 0 if width == 1 else 1 if width <= FANOUT else 2


PROOFS = pa.schema(
    [("doc_id", pa.int64()), ("tree", pa.string()), ("place", pa.int64()), ("leaf", pa.string()), ("changed", pa.string()),
     ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("copies", pa.list_(pa.string()))]
)


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            block = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
            rows, upper = block["rows"], list(zip(block["before"], block["after"]))
            tree = BlockTree([r["leaf"] for r in rows], _depth(block["width"]))
            out = []
            for at, r in enumerate(rows):
                way = [*tree.siblings(at), *upper]
                changed = r["changed"]
                version = copied(r["leaf"] if changed is None else changed, way)
                out.append({
                    "doc_id": r["doc_id"], "tree": block["tree"], "place": r["place"], "leaf": r["leaf"], "changed": changed,
                    "subroot": block["subroot"], "root": block["root"],
                    "proof_sha256": digest([x for pair in way for x in pair]),
                    "folded_root": version[-1] if version else r["leaf"] if changed is None else changed,
                    "copies": None if changed is None else version,
                })
            yield pa.RecordBatch.from_pylist(out, schema=PROOFS)


# --- levels above the blocks ------------------------------------------------------------------------------


def rise(nodes: DataFrame, widest: int, label: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """Runs (tree, idx, width, digests, digest) of every level above (tree, idx, width, digest), and the tops by level.

    ``width`` is the number of nodes of the tree on that level; a tree ends where it is 1.
    """
    levels, tops = [], [nodes.where("width = 1")]
    while widest > 1:
        run = F.floor(F.col("idx") / FANOUT).cast("long").alias("idx")
        grouped = nodes.where("width > 1").groupBy("tree", run, _narrower(F.col("width"), FANOUT).alias("width"))
        runs = grouped.agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("run"))
        runs = runs.select("tree", "idx", "width", F.col("run.digest").alias("digests")).withColumn("digest", _joined(F.col("digests")))
        levels.append(materialize(runs, label))
        nodes = levels[-1].select("tree", "idx", "width", "digest")
        tops.append(nodes.where("width = 1"))
        widest = -(-widest // FANOUT)
    return levels, tops


def descend(levels: list[DataFrame], tops: list[DataFrame], seeds: DataFrame, label: str) -> DataFrame:
    """(tree, idx, before, after, subroot, root) of the lowest nodes: their siblings on every level up to the root.

    ``seeds`` holds (tree, before, after, subroot, root), the way on from the top of each tree.
    """
    carried = ("before", "after", "subroot", "root")

    def started(top: DataFrame) -> DataFrame:
        return top.select("tree", "idx").join(seeds, "tree")

    now = started(tops[-1])
    for runs, top in zip(reversed(levels), reversed(tops[:-1])):
        children = runs.select("tree", "idx", "digests").join(now, ["tree", "idx"]).select(
            "tree", "idx", "digests", *carried, F.posexplode("digests").alias("pos", "own")
        )
        left = F.array_join(F.slice("digests", F.lit(1), F.col("pos")), "")
        right = F.array_join(F.slice("digests", F.col("pos") + 2, F.lit(FANOUT)), "")
        below = children.select(
            "tree", (F.col("idx") * FANOUT + F.col("pos")).alias("idx"),
            F.concat(F.array(left), F.col("before")).alias("before"), F.concat(F.array(right), F.col("after")).alias("after"), "subroot", "root",
        )
        now = materialize(below.unionByName(started(top).select("tree", "idx", *carried)), label)
    return now


def manifest(docs: DataFrame, doc_id: Column, source: Column, leaf: Column, changed: Column) -> DataFrame:
    """(doc_id, tree, place, leaf, changed, subroot, root, proof_sha256, folded_root, copies) for every row.

    ``changed`` is the digest of a changed leaf, else null. ``folded_root`` is the root of the row's version, recomputed
    from its leaf and the original siblings; ``copies`` lists the copied ancestors of a changed leaf, from the lowest up.
    ``tree`` is ``+`` and the source, or empty for a null source.
    """
    tree = F.coalesce(F.concat(F.lit("+"), source.cast("string")), F.lit(""))
    rows = materialize(docs.select(doc_id.cast("long").alias("doc_id"), tree.alias("tree"), leaf.alias("leaf"), changed.alias("changed")), "merkle-leaves")
    placed = ordinal(rows, ["tree"], ["doc_id", "leaf"], name="place", total="width")
    block = F.floor((F.col("place") - 1) / BLOCK).cast("long").alias("idx")
    grouped = placed.groupBy("tree", block, "width").agg(F.sort_array(F.collect_list(F.struct("place", "doc_id", "leaf", "changed"))).alias("rows"))
    leaves = F.col("rows.leaf")
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("rows") - 1) / FANOUT).cast("int")), lambda i: _joined(F.slice(leaves, i * FANOUT + 1, F.lit(FANOUT))))
    top = F.when(F.col("width") == 1, leaves[0]).when(F.col("width") <= FANOUT, runs[0]).otherwise(_joined(runs))
    blocks = materialize(grouped.withColumn("digest", top), "merkle-blocks")
    nodes = blocks.select("tree", "idx", _narrower(F.col("width"), BLOCK).alias("width"), "digest")
    levels, tops = rise(nodes, nodes.agg(F.max("width")).first()[0] or 0, "merkle-levels")

    roots = tops[0]
    for more in tops[1:]:
        roots = roots.unionByName(more)
    numbered = ordinal(roots.select(F.col("tree").alias("of"), "digest"), [], ["of"], name="place", total="width")
    numbered = materialize(numbered.select("of", F.lit("").alias("tree"), (F.col("place") - 1).alias("idx"), "width", "digest"), "merkle-roots")
    upper = rise(numbered.drop("of"), numbered.agg(F.max("width")).first()[0] or 0, "merkle-levels")
    nothing = F.array().cast("array<string>")
    start = upper[1][-1].select(
        "tree", nothing.alias("before"), nothing.alias("after"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root")
    )
    ways = descend(*upper, start, "merkle-ways").select("idx", "before", "after", "root")
    seeds = materialize(numbered.join(ways, "idx").select(F.col("of").alias("tree"), "before", "after", F.col("digest").alias("subroot"), "root"), "merkle-seeds")
    ways = descend(levels, tops, seeds, "merkle-ways")
    return blocks.select("tree", "idx", "width", "rows").join(ways, ["tree", "idx"]).mapInArrow(
        _prove,
        "doc_id long, tree string, place long, leaf string, changed string, subroot string, root string, proof_sha256 string, "
        "folded_root string, copies array<string>",
    )


def copied_nodes(proved: DataFrame) -> DataFrame:
    """(tree, version, level, digest): the nodes that the version of each changed leaf has of its own.

    ``version`` is the place of the changed leaf in its tree, ``level`` counts from 1 above the leaves; levels beyond
    those of the source belong to the tree over the sources.
    """
    return proved.where("copies is not null").select(
        "tree", F.col("place").alias("version"), F.posexplode("copies").alias("level", "digest")
    ).withColumn("level", F.col("level") + 1)
