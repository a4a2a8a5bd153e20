"""N-gram Jaccard join by chosen paths.

A text is the set of its shingles of five words (fewer words: one shingle of all). Texts with one set are one member.

1. A member keeps ``SIGNATURE`` MinHash tokens, an equal-sized sample of its set: two members share a token with the
   probability of their Jaccard similarity.
2. A run starts all members at one node. A member chooses each of its tokens with the probability
   ``BRANCHES / (threshold * SIGNATURE)``, by a hash of node and token, and goes to the child node of every token chosen;
   members that share a token choose it alike. Nodes of at most ``SMALL`` members are compared by brute force, larger
   ones are split again by new tokens. A node that keeps most of its parent holds copies that no token separates; it is
   compared by brute force in blocks.
3. A pair at the threshold shares ``BRANCHES`` chosen tokens in the mean at every node, so a run loses it with at most the
   extinction probability q = exp(-BRANCHES (1 - q)) of that branching process. Runs repeat until the product of their
   losses is below ``1 - recall``.
4. Brute force counts equal tokens, with a margin of more than four standard deviations below the threshold. A bucket
   gives a spanning forest of its similar pairs, never all of them.
5. The connected candidates meet once, in blocks, and are compared by their exact shingle sets. Every block pair gives
   link counts per member and a spanning forest; a member's links are counted once for each partner.

Nulls: a null text, or one without words, is in no class and has no links. Rows equal in id and text are copies as any
others. Extra columns play no part. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isobar.llm.common import IS_ALNUM, LOWER_LUT, U64, Rolling, as_signed, buffers, mix, partitions_for, pieces, release, runs, word_bounds
from isobar.llm.components import components
from isobar.session import materialize

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.999
SIGNATURE, BRANCHES, SMALL, BLOCK, DEPTH, KEEPS = 64, 3.0, 512, 512, 12, 0.7
SEEDS = mix(np.arange(1, SIGNATURE + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def runs_for(recall: float, branches: float = BRANCHES) -> int:
    q = 0.0
    for _ in range(200):
        q = math.exp(-branches * (1 - q))
    return max(1, math.ceil(math.log(1 - recall) / math.log(q)))


def least_equal(threshold: float) -> int:
    """Equal tokens that a pair at the threshold misses with less than 1 in 30,000."""
    return max(1, math.floor(SIGNATURE * threshold - 4.5 * math.sqrt(SIGNATURE * threshold * (1 - threshold))))


# --- sets -------------------------------------------------------------------------------------------------


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted within it, and their offsets."""
    data = LOWER_LUT[data]
    starts, ends, doc = word_bounds(data, offsets, IS_ALNUM)
    n = len(offsets) - 1
    counts = np.bincount(doc, minlength=n)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(n + 1, np.int64)
    word = Rolling(data).hash(starts, ends)
    total = np.zeros(len(word), U64)
    last = np.cumsum(counts)[doc]  # first word after the text
    at = np.arange(len(word))
    for k in range(width):
        ok = at + k < last
        part = word[np.minimum(at + k, len(word) - 1)] * U64(2 * k + 3)
        total = np.where(ok, mix(total + part), total)
    inside = (last - at >= width) | (at == last - counts[doc])  # whole shingles, or the only one of a short text
    total, doc = total[inside], doc[inside]
    order = np.lexsort((total, doc))
    total, doc = total[order], doc[order]
    fresh = np.ones(len(total), bool)
    fresh[1:] = (total[1:] != total[:-1]) | (doc[1:] != doc[:-1])
    return total[fresh], np.concatenate(([0], np.cumsum(np.bincount(doc[fresh], minlength=n))))


def segment(op, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``op.reduceat`` of non-empty segments; 0 for empty ones."""
    out = np.zeros(len(offsets) - 1, U64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = op.reduceat(values, offsets[:-1][full])
    return out


MEMBER = T.StructType(
    [T.StructField("size", T.IntegerType()), T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()), T.StructField("signature", T.BinaryType())]
)


@F.arrow_udf(MEMBER)
def member_of(texts: pa.Array) -> pa.Array:
    """Size, two sums that name the set, and the signature (32-bit tokens)."""
    data, offsets = buffers(texts)
    out: list[list[np.ndarray]] = [[], [], [], []]
    for i, j in pieces(offsets):
        values, at = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        tokens = np.empty((j - i, SIGNATURE), np.uint32)
        for s in range(SIGNATURE):
            hashed = values * SEEDS[s]
            hashed ^= hashed >> U64(29)
            hashed *= U64(0xBF58476D1CE4E5B9)
            tokens[:, s] = segment(np.minimum, hashed >> U64(32), at)
        for part, column in zip((np.diff(at), segment(np.add, mix(values), at), segment(np.bitwise_xor, mix(values + U64(77)), at), tokens), out):
            column.append(part)
    size, a, b, tokens = (np.concatenate(c) if c else np.zeros((0, SIGNATURE) if k == 3 else 0) for k, c in enumerate(out))
    release()
    raw = pa.Array.from_buffers(pa.binary(SIGNATURE * 4), len(size), [None, pa.py_buffer(np.ascontiguousarray(tokens, np.uint32))])
    return pa.StructArray.from_arrays(
        [pa.array(size, pa.int32()), pa.array(as_signed(a.astype(U64)), pa.int64()), pa.array(as_signed(b.astype(U64)), pa.int64()), raw.cast(pa.binary())],
        ["size", "set_a", "set_b", "signature"],
    )


@F.arrow_udf(T.BinaryType())
def set_of(texts: pa.Array) -> pa.Array:
    """The sorted distinct shingle hashes, packed."""
    data, offsets = buffers(texts)
    out = []
    for i, j in pieces(offsets):
        values, at = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        out += [values[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
    release()
    return pa.array(out, pa.binary())


# --- paths ------------------------------------------------------------------------------------------------


def _signatures(column: pa.Array) -> np.ndarray:
    data, _ = buffers(column)
    return data.view(np.uint32).reshape(len(column), SIGNATURE)


PATH_SCHEMA = pa.schema([("node", pa.int64()), ("set_id", pa.int64()), ("parent_size", pa.int64())])


def descend(rows: DataFrame, threshold: float, n_runs: int) -> DataFrame:
    """Children (node, set_id, parent_size) of rows (node, set_id, size, signature); without nodes, the starts of all runs."""
    limit = U64(min(2**32 - 1, int(BRANCHES / (threshold * SIGNATURE) * 2**32)))
    root = "node" not in rows.columns
    positions = mix(np.arange(SIGNATURE, dtype=U64) + U64(12345))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = _signatures(batch.column("signature"))
            ids = batch.column("set_id").to_numpy()
            size = np.full(len(ids), -1) if root else batch.column("size").to_numpy()
            for run in range(n_runs if root else 1):
                above = np.full(len(ids), mix(np.array([run + 1], U64))[0]) if root else np.ascontiguousarray(batch.column("node").to_numpy()).view(U64)
                child = mix(mix(above[:, None] + positions) + tokens.astype(U64))
                row, _ = chosen = np.nonzero((child >> U64(32)) < limit)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(as_signed(mix(child[chosen] + U64(5)))), pa.array(ids[row], pa.int64()), pa.array(size[row], pa.int64())], schema=PATH_SCHEMA
                )

    return rows.mapInArrow(choose, "node long, set_id long, parent_size long")


def leaf_rows(members: DataFrame, threshold: float, recall: float, small: int = SMALL) -> DataFrame:
    """(node, set_id, n): the members of all nodes to be compared, with the size of the node."""
    paths = materialize(descend(members.select("set_id", "signature"), threshold, runs_for(recall)), "chosen-paths")
    leaves = None
    for depth in range(DEPTH):
        sizes = paths.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sized = materialize(paths.join(sizes, "node"), "chosen-sized")
        done = (F.col("n") <= small) | (F.col("n") >= KEEPS * F.col("parent_size")) & (F.col("parent_size") > 0) | F.lit(depth == DEPTH - 1)
        found = sized.where(done).select("node", "set_id", "n")
        leaves = found if leaves is None else leaves.unionByName(found)
        deeper = sized.where(~done)
        if deeper.isEmpty():
            break
        larger = deeper.join(members.select("set_id", "signature"), "set_id").select("node", "set_id", F.col("n").alias("size"), "signature")
        paths = materialize(descend(larger, threshold, 1), "chosen-paths")
    return leaves


def in_blocks(rows: DataFrame, key: str, size: Column, block: int = BLOCK) -> DataFrame:
    """Rows dealt to cells, one for each pair of blocks of their group; groups up to a block have one cell.

    Cells are (cell, side): side 0 or 1 tells the blocks apart, -1 marks a block compared with itself.
    """
    n = F.ceil(size / block).cast("int")
    own = F.pmod(F.xxhash64("set_id"), n.cast("long")).cast("int")
    other = F.explode(F.sequence(F.lit(0), n - 1))
    dealt = rows.withColumn("_own", own).withColumn("_other", other)
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    side = F.when(F.col("_own") == F.col("_other"), -1).when(F.col("_own") < F.col("_other"), 0).otherwise(1)
    return dealt.withColumn("cell", F.xxhash64(key, low, high)).withColumn("side", side.cast("int")).drop("_own", "_other")


def grouped(batches: Iterator[pa.RecordBatch], key: str, limit: int = 64 << 20) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        if held and held[-1].column(key)[-1].as_py() != keys[0] and sum(b.nbytes for b in held) >= limit // 8:
            yield pa.Table.from_batches(held)
            held = []
        first = np.searchsorted(keys, keys[-1]) if (keys[1:] >= keys[:-1]).all() else int(np.flatnonzero(keys == keys[-1])[0])
        if first and sum(b.nbytes for b in held) + batch.nbytes >= limit // 8:
            yield pa.Table.from_batches([*held, batch.slice(0, first)])
            held = [batch.slice(first)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, root) of the components of pairs a-b among n members."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    member = np.flatnonzero(root != np.arange(n))
    return member, root[member]


def pairs_of(first: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of all groups, groups of one size together, in bounded pieces."""
    for s in np.unique(size[size > 1]):
        base = first[size == s]
        i, j = np.triu_indices(s, 1)
        step = max(1, (1 << 19) // len(i))
        for at in range(0, len(base), step):
            yield (base[at : at + step, None] + i).ravel(), (base[at : at + step, None] + j).ravel()


def spanning(n: int, side: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the pairs a-b. Where two blocks meet, their own cells have the edges inside each of them, so only
    edges between components of the blocks are added."""
    inside = side[a] == side[b]
    root = np.arange(n)
    member, top = forest(n, a[inside], b[inside])
    root[member] = top
    alone = side[member] < 0
    within = member[alone], top[alone]
    member, top = forest(n, a, b)
    across = (side[member] >= 0) & (root[member] == member)
    return np.concatenate([within[0], member[across]]), np.concatenate([within[1], top[across]])


def candidate_edges(cells: DataFrame, least: int) -> DataFrame:
    """Spanning forests (a, b) of the pairs with at least ``least`` equal tokens in each cell."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, "cell"):
            ids, side = rows.column("set_id").to_numpy(), rows.column("side").to_numpy()
            tokens = _signatures(rows.column("signature").combine_chunks())
            hits: list[list[np.ndarray]] = [[], []]
            for a, b in pairs_of(*runs(rows.column("cell").to_numpy())):
                for k in range(0, len(a), 1 << 16):
                    x, y = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
                    some = (tokens[x, :16] == tokens[y, :16]).sum(axis=1) >= least - (SIGNATURE - 16)
                    x, y = x[some], y[some]
                    same = (tokens[x] == tokens[y]).sum(axis=1) >= least
                    hits[0].append(x[same])
                    hits[1].append(y[same])
            if hits[0]:
                member, root = spanning(len(ids), side, np.concatenate(hits[0]), np.concatenate(hits[1]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[member], pa.int64()), pa.array(ids[root], pa.int64())], schema=schema)
        release()

    return cells.mapInArrow(compare, "a long, b long")


LINK_SCHEMA = pa.schema([("set_id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def exact_links(cells: DataFrame, threshold: float) -> DataFrame:
    """(set_id, links, root) from cells with packed sets: links weigh each partner by its copies."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, "cell"):
            ids, side, copies = (rows.column(c).to_numpy() for c in ("set_id", "side", "copies"))
            data, offsets = buffers(rows.column("shingles").combine_chunks())
            values, at = data.view(U64), offsets // 8
            sizes = np.diff(at)
            hits: list[list[np.ndarray]] = [[], []]
            for first, size in zip(*runs(rows.column("cell").to_numpy())):
                if size < 2:
                    continue
                a, b = similar_pairs(values, at, sizes, first, size, side, threshold)
                hits[0].append(a)
                hits[1].append(b)
            if not hits[0]:
                continue
            a, b = np.concatenate(hits[0]), np.concatenate(hits[1])
            links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
            member, root = forest(len(ids), a, b)
            top = np.arange(len(ids))
            top[member] = root
            linked = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[linked], pa.int64()), pa.array(links[linked].astype(np.int64)), pa.array(ids[top[linked]], pa.int64())], schema=LINK_SCHEMA
            )
        release()

    return cells.mapInArrow(verify, "set_id long, links long, root long")


def similar_pairs(values, at, sizes, first, n, side, threshold):
    """Pairs of one group with an exact Jaccard similarity of at least the threshold.

    Only shingles that two members share can meet; they become a 0/1 matrix in slices of bounded size.
    """
    own, member = values[at[first] : at[first + n]], np.repeat(np.arange(n), sizes[first : first + n])
    order = np.argsort(own, kind="stable")
    own, member = own[order], member[order]
    start, count = runs(own)
    shared = np.repeat(count > 1, count)
    token = np.repeat(np.arange(len(start)), count)[shared]
    member = member[shared]
    token = np.unique(token, return_inverse=True)[1]
    common = np.zeros((n, n), np.float32)
    width = max(1, (1 << 23) // n)
    for low in range(0, int(token.max(initial=-1)) + 1, width):
        a, b = np.searchsorted(token, [low, low + width])
        grid = np.zeros((n, min(width, int(token[-1]) + 1 - low)), np.float32)
        grid[member[a:b], token[a:b] - low] = 1
        common += grid @ grid.T
    i, j = np.triu_indices(n, 1)
    total = sizes[first + i] + sizes[first + j] - common[i, j]
    sides = side[first : first + n]
    ok = (common[i, j] >= threshold * total - 1e-6) & (common[i, j] > 0) & ((sides[i] != sides[j]) | (sides[i] < 0))
    return first + i[ok], first + j[ok]


def by_cell(spark: SparkSession, cells: DataFrame, size: float) -> DataFrame:
    """Cells brought together and sorted; the number of partitions follows the bytes."""
    return cells.repartition(partitions_for(spark, size, 32e6), "cell").sortWithinPartitions("cell")


def jaccard_classes(
    docs: DataFrame, doc_id: Column, text: Column, threshold: float = THRESHOLD, recall: float = RECALL, small: int = SMALL, block: int = BLOCK
) -> DataFrame:
    """(doc_id, text_key, class_id, first_key, n_links) for every row.

    ``class_id`` is the smallest id of the class, (class_id, first_key) names its first document; ``n_links`` counts the
    other rows with at least the threshold. Without words both are null and there are no links.
    """
    spark = docs.sparkSession
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"))
    base = rows.select("doc_id", "text_key", member_of(F.coalesce("text", F.lit(""))).alias("m")).select("doc_id", "text_key", "m.*")
    base = materialize(base.withColumn("set_id", F.when(F.col("size") > 0, F.xxhash64("size", "set_a", "set_b"))), "jaccard-rows")
    members = materialize(
        base.where("set_id is not null").groupBy("set_id").agg(
            F.count(F.lit(1)).alias("copies"), F.max("signature").alias("signature"), F.min(F.struct("doc_id", "text_key")).alias("first")
        ),
        "jaccard-members",
    )
    leaves = leaf_rows(members, threshold, recall, small)
    with_tokens = in_blocks(leaves.join(members.select("set_id", "signature"), "set_id"), "node", F.col("n"), block)
    found = leaves.count()
    pairs = candidate_edges(by_cell(spark, with_tokens.select("cell", "side", "set_id", "signature"), found * 300.0), least_equal(threshold))
    groups = components(pairs, "jaccard-candidates")
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    placed = materialize(
        groups.join(sizes, "root").join(members.select("set_id", "copies", "first"), groups["node"] == members["set_id"])
        .select("set_id", "root", "n", "copies", "first"), "jaccard-placed",
    )
    # One text for each member: rows equal in id and text are the same text.
    texts = rows.join(
        placed.select("set_id", "root", "n", "copies", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_key")).hint("merge"),
        F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("first_key")),
    ).select("set_id", "root", "n", "copies", set_of(F.coalesce("text", F.lit(""))).alias("shingles"))
    sets = materialize(texts, "jaccard-sets").dropDuplicates(["set_id"])
    volume = sets.agg(F.sum(F.octet_length("shingles") * F.ceil(F.col("n") / block))).first()[0] or 0
    cells = in_blocks(sets, "root", F.col("n"), block).select("cell", "side", "set_id", "copies", "shingles")
    links = materialize(exact_links(by_cell(spark, cells, float(volume)), threshold), "jaccard-links")
    classes = components(links.select(F.col("set_id").alias("a"), F.col("root").alias("b")), "jaccard-classes")
    counted = links.groupBy("set_id").agg(F.sum("links").alias("links"))
    described = (
        members.select("set_id", "copies", "first")
        .join(counted, "set_id", "left")
        .join(classes.select(F.col("node").alias("set_id"), "root"), "set_id", "left")
        .select("set_id", F.coalesce("root", "set_id").alias("root"), "first", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    firsts = described.groupBy("root").agg(F.min("first").alias("first"))
    named = described.drop("first").join(firsts, "root").select("set_id", "first", "n_links")
    return base.select("doc_id", "text_key", "set_id").join(named, "set_id", "left").select(
        "doc_id", "text_key", F.col("first.doc_id").alias("class_id"), F.col("first.text_key").alias("first_key"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
