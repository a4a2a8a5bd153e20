"""Prefix trie of conversations, rolled up by centroid decomposition.

A node is a distinct sequence of first turns. It is named by its smallest conversation and its depth, so a parent edge
needs no further key: the parent is one turn shorter and has a smallest conversation of its own.

1. Sequences are compared by two 64-bit sums that a turn and its depth enter by exclusive or. Such sums run along a
   conversation in chunks of ``CHUNK`` turns, so one of any length is spread over tasks; texts are read once.
2. A node gathers its members by an aggregation with map-side partials. A conversation owns the nodes of which it is the
   smallest member, the deepest of its path. The nodes below a node are therefore the sum, over its members, of the owned
   nodes at its depth or deeper: the size of every subtree comes from the same aggregation.
3. Roll-up. The forest of parent edges is split at the centroid of every component: the deepest node that has at least
   half of the component below it. The centroid and the nodes on its way to the top of the component receive the totals
   of what lies below it; the sizes of the way shrink by as much. What is left are the subtrees of the children and the
   component above, each with at most half of the nodes. Components of more than ``SMALL`` nodes are split by joins, one
   round for all of them at once; the others are split to the end inside a task, many at a time as arrays.
4. The ids of a node's ends are joined in pieces of bounded size by ranges of (node, id); only the pieces meet to be hashed
   in order, as a stream.

Nulls: rows without a conversation id belong to none and are left out; a null role or text is empty; a null turn comes
first. Rows equal in conversation and turn go by a digest of role and text; equal rows are turns of their own. Extra
columns play no part. An empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isobar.llm.common import partitions_for
from isobar.llm.spread import spread_join
from isobar.operators.ordering import ordinal
from isobar.session import materialize

CHUNK, SMALL, PIECE = 1024, 4096, 1 << 20
TURN = ["key_a", "key_b", "n_bytes"]


# --- turns ------------------------------------------------------------------------------------------------


def turns_in_order(rows: DataFrame, conv_id: Column, turn: Column, role: Column, text: Column) -> DataFrame:
    """(conv_id, pos, total, key_a, key_b, n_bytes): turns numbered from 1, with two hashes that name role and text."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    name = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    narrow = rows.where(conv_id.isNotNull()).select(
        conv_id.cast("long").alias("conv_id"), turn.alias("turn"), F.octet_length(text).cast("long").alias("n_bytes"), name.alias("name")
    )
    hashed = narrow.select("conv_id", "turn", "n_bytes", F.xxhash64("name", F.lit(1)).alias("key_a"), F.xxhash64("name", F.lit(2)).alias("key_b"))
    return ordinal(materialize(hashed, "trie-turns"), ["conv_id"], ["turn", "key_a", "key_b"], name="pos", total="total").drop("turn")


def with_shared_heads(turns: DataFrame, head: Column, base: Column) -> DataFrame:
    """(conv_id, depth, length, TURN) of conversations that begin with the first turns of another.

    ``head`` turns of conversation ``base``, both functions of ``conv_id``, are followed by the conversation's own turns
    after its first ``head``. A conversation left without turns has one row of depth 0.
    """
    turns = materialize(turns, "trie-placed")
    totals = materialize(turns.groupBy("conv_id").agg(F.max("total").alias("total")), "trie-totals")
    convs = totals.select("conv_id", "total", head.cast("long").alias("head"), base.cast("long").alias("base"))
    bases = totals.select(F.col("conv_id").alias("base"), F.col("total").alias("base_total"))
    lent = F.least(F.col("head"), F.coalesce("base_total", F.lit(0)))
    own = F.greatest(F.col("total") - F.col("head"), F.lit(0))
    convs = materialize(convs.join(bases, "base", "left").select("conv_id", "head", "base", lent.alias("lent"), (lent + own).alias("length")), "trie-convs")
    # A conversation begins with few turns of its base: the position is part of the key, so no key is hot.
    first = convs.where("lent > 0").select("conv_id", "base", "length", F.explode(F.sequence(F.lit(1).cast("long"), "lent")).alias("depth"))
    heads = first.join(turns.select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), *TURN), ["base", "depth"])
    tails = spread_join(turns.select("conv_id", "pos", *TURN), convs.select("conv_id", "head", "lent", "length"), ["conv_id"], ["pos"])
    tails = tails.where("pos > head").select("conv_id", (F.col("pos") - F.col("head") + F.col("lent")).alias("depth"), "length", *TURN)
    nothing = F.lit(0).cast("long")
    bare = convs.where("length = 0").select("conv_id", nothing.alias("depth"), "length", *[nothing.alias(c) for c in TURN])
    return heads.select("conv_id", "depth", "length", *TURN).unionByName(tails).unionByName(bare)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, length, n_bytes, a, b, up_a, up_b): the sums of every prefix and of the one before it."""
    mixed = turns.where("depth > 0").select(
        "conv_id", "depth", "length", "n_bytes", F.floor(F.col("depth") / CHUNK).cast("long").alias("chunk"),
        F.xxhash64("key_a", "key_b", "depth").alias("x"), F.xxhash64("key_b", "depth", "key_a").alias("y"),
    )
    mixed = materialize(mixed, "trie-mixed")
    chunks = mixed.groupBy("conv_id", "chunk").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = chunks.select("conv_id", "chunk", *[F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in "xy"])
    inside = Window.partitionBy("conv_id", "chunk").orderBy("depth")
    a, b = (F.bit_xor(c).over(inside).bitwiseXOR(F.col(f"{c}0")) for c in "xy")
    summed = mixed.join(before, ["conv_id", "chunk"]).withColumn("a", a).withColumn("b", b)
    return summed.select(
        "conv_id", "depth", "length", "n_bytes", "a", "b",
        F.col("a").bitwiseXOR(F.col("x")).alias("up_a"), F.col("b").bitwiseXOR(F.col("y")).alias("up_b"),
    )


# --- nodes ------------------------------------------------------------------------------------------------


def own_nodes(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (conv_id, depth, up, n_convs, n_bytes, size) and steps (member, depth, conv_id, up, length).

    ``conv_id`` is the smallest member of a node, ``up`` that of its parent (null at depth 1), ``size`` the number of
    nodes in its subtree. A step is one turn of a member's way down.
    """
    node = ["depth", "a", "b"]
    named = materialize(paths.groupBy(*node).agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs")), "trie-named")
    steps = materialize(spread_join(paths, named, node, ["conv_id"]), "trie-steps")
    # A conversation owns its path from the first depth at which no smaller one goes along.
    owned = steps.where("owner = conv_id").groupBy("conv_id").agg(F.min("depth").alias("from"))
    sized = spread_join(steps, owned, ["conv_id"], ["depth"], "left")
    below = F.col("length") - F.greatest(F.coalesce("from", F.col("length") + 1), "depth") + 1
    sizes = sized.groupBy(*node).agg(F.sum(below).alias("size"))
    parents = named.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("owner").alias("up"))
    with_up = spread_join(steps, parents, ["depth", "up_a", "up_b"], ["conv_id"], "left")
    with_up = materialize(with_up.select(F.col("conv_id").alias("member"), "depth", F.col("owner").alias("conv_id"), "up", "length", "n_bytes", "a", "b"), "trie-ways")
    first = with_up.where("member = conv_id").join(sizes, node).join(named.select(*node, "n_convs"), node)
    return first.select("conv_id", "depth", "up", "n_convs", "n_bytes", "size"), with_up.select("member", "depth", "conv_id", "up", "length")


# --- centroids --------------------------------------------------------------------------------------------


def split_components(
    comp: np.ndarray, up: np.ndarray, depth: np.ndarray, size: np.ndarray, weights: np.ndarray
) -> np.ndarray:
    """Totals of ``weights`` (n, k) over every subtree by centroid decomposition of all components at once.

    ``comp`` numbers the components from 0, ``up`` is the position of the parent inside the component or -1, ``size`` the
    number of nodes of the component below a node, itself included.
    """
    n = len(comp)
    totals = np.zeros_like(weights)
    size, up, comp = size.copy(), up.copy(), comp.copy()
    # Preorder numbers: a subtree is a run of them. Children follow one another in their parent's run.
    order = np.lexsort((depth, comp))
    pre, room = np.zeros(n, np.int64), np.ones(n, np.int64)
    base = np.zeros(comp.max(initial=-1) + 1, np.int64)
    np.add.at(base, comp, 1)
    base = np.cumsum(base) - base
    for level in np.unique(depth):
        at = order[depth[order] == level]
        top = at[up[at] < 0]
        pre[top] = base[comp[top]]
        rest = at[up[at] >= 0]
        if len(rest):
            rest = rest[np.argsort(up[rest], kind="stable")]
            head = np.concatenate(([True], up[rest][1:] != up[rest][:-1]))
            ahead = np.cumsum(size[rest]) - size[rest]
            ahead -= np.repeat(ahead[head], np.diff(np.append(np.flatnonzero(head), len(rest))))
            pre[rest] = pre[up[rest]] + room[up[rest]] + ahead
    span = size.copy()
    by_depth = np.argsort(depth, kind="stable")
    live = np.arange(n)
    parent = up.copy()
    while len(live):
        whole = np.zeros(comp.max() + 1, np.int64)
        np.add.at(whole, comp[live], 1)
        # The centroid: the deepest node with at least half of its component below it.
        heavy = by_depth[np.isin(by_depth, live)] if len(live) < n else by_depth
        heavy = heavy[2 * size[heavy] >= whole[comp[heavy]]]
        centre = np.full(len(whole), -1)
        centre[comp[heavy]] = heavy  # deeper ones come later and stay
        mine = centre[comp[live]]
        below = live[(pre[live] >= pre[mine]) & (pre[live] < pre[mine] + span[mine])]
        sums = np.zeros((len(whole), weights.shape[1]), weights.dtype)
        np.add.at(sums, comp[below], weights[below])
        count = np.zeros(len(whole), np.int64)
        np.add.at(count, comp[below], 1)
        at = centre[centre >= 0]
        which = comp[at]
        totals[at] += sums[which]
        step = up[at]
        while True:  # from every centroid to the top of its component
            on = step >= 0
            if not on.any():
                break
            step, which = step[on], which[on]
            totals[step] += sums[which]
            size[step] -= count[which]
            step = up[step]
        # Children of centroids are the tops of new components; who lies below them goes along.
        gone = np.zeros(n, bool)
        gone[at] = True
        tops = live[(parent[live] >= 0) & gone[parent[live]] & (up[live] >= 0)]
        fresh = np.full(n, -1)
        tops = tops[np.lexsort((pre[tops], comp[tops]))]
        under = below[~gone[below]]
        keys = comp[tops] * (n + 1) + pre[tops]
        fresh[under] = len(whole) + np.searchsorted(keys, comp[under] * (n + 1) + pre[under], "right") - 1
        up[tops] = -1
        live = live[~gone[live]]
        moved = fresh[live] >= 0
        comp[live[moved]] = fresh[live[moved]]
        if len(live):
            comp[live] = np.unique(comp[live], return_inverse=True)[1]
    return totals


ROLLED = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64())])
WEIGHTS = ["n_leaves", "saved_tokens"]


def _roll(rows: pa.Table) -> pa.RecordBatch:
    conv, depth, up, size, top, top_depth = (rows.column(c).to_numpy() for c in ("conv_id", "depth", "above", "size", "top", "top_depth"))
    order = np.lexsort((conv, depth, top, top_depth))
    conv, depth, up, size, top, top_depth = (x[order] for x in (conv, depth, up, size, top, top_depth))
    fresh = np.ones(len(conv), bool)
    fresh[1:] = (top[1:] != top[:-1]) | (top_depth[1:] != top_depth[:-1])
    comp = np.cumsum(fresh) - 1
    # Parents by (component, depth, owner), which is the order of the rows.
    _, owner = np.unique(np.concatenate([conv, up]), return_inverse=True)
    wide, deep = owner.max(initial=0) + 1, depth.max(initial=0) + 2
    own = (comp * deep + depth) * wide + owner[: len(conv)]
    wanted = (comp * deep + depth - 1) * wide + owner[len(conv):]
    place = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
    parent = np.where((own[place] == wanted) & ~((conv == top) & (depth == top_depth)), place, -1)
    weights = np.stack([rows.column(f"w_{c}").to_numpy()[order] for c in WEIGHTS], axis=1)
    out = split_components(comp, parent, depth, size, weights)
    for k, c in enumerate(WEIGHTS):
        out[:, k] += rows.column(f"t_{c}").to_numpy()[order]
    return pa.RecordBatch.from_arrays([pa.array(conv), pa.array(depth), *[pa.array(np.ascontiguousarray(out[:, k])) for k in range(len(WEIGHTS))]], schema=ROLLED)


def _whole_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by component, rolled up some thousand at a time and never across the edge of one."""
    held: list[pa.RecordBatch] = []

    def last(batch: pa.RecordBatch) -> tuple:
        return batch.column("top_depth")[-1].as_py(), batch.column("top")[-1].as_py()

    for batch in batches:
        if not batch.num_rows:
            continue
        edge = last(batch)
        same = (batch.column("top_depth").to_numpy() == edge[0]) & (batch.column("top").to_numpy() == edge[1])
        first = int(np.argmax(same))
        if sum(b.num_rows for b in held) + first >= 4 * SMALL and (first or last(held[-1]) != edge):
            yield _roll(pa.Table.from_batches([*held, batch.slice(0, first)]))
            held = [batch.slice(first)]
        else:
            held.append(batch)
    if held:
        yield _roll(pa.Table.from_batches(held))


def roll_up(nodes: DataFrame, steps: DataFrame, small: int = SMALL) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens): sums over subtrees of the columns ``w_n_leaves``, ``w_saved_tokens``.

    ``nodes`` holds (conv_id, depth, up, size, w_...), every node of depth 1 being the top of a component;
    ``steps`` (member, depth, conv_id, up) the way down of every conversation.
    """
    key, comp, sums = ["conv_id", "depth"], ["top", "top_depth"], [f"t_{c}" for c in WEIGHTS]
    # The top of a node is the first node of its smallest member.
    tops = steps.where("depth = 1").select(F.col("member").alias("conv_id"), F.col("conv_id").alias("top"))
    state = spread_join(nodes, tops, ["conv_id"], ["depth"]).withColumn("top_depth", F.lit(1).cast("long"))
    zero = F.lit(0).cast("long")
    state = materialize(state.select(*key, F.coalesce("up", F.lit(-1)).alias("above"), *comp, "size", *[f"w_{c}" for c in WEIGHTS], *[zero.alias(c) for c in sums]), "trie-state")
    done = None
    while True:
        large = materialize(state.groupBy(*comp).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > small), "trie-large")
        if large.isEmpty():
            break
        inside = materialize(spread_join(state, large, comp, key), "trie-inside")
        outside = spread_join(state, large.select(*comp, F.lit(1).alias("is_large")), comp, key, "left").where("is_large is null").drop("is_large")
        best = inside.where("2 * size >= n").groupBy(*comp).agg(F.max_by(F.struct(*key), "depth").alias("c"))
        centres = materialize(best.select(*comp, F.col("c.conv_id").alias("c_conv"), F.col("c.depth").alias("c_depth")), "trie-centres")
        # Members that go on below the centroid, and the child that each of them takes.
        on = steps.join(centres, (steps["up"] == centres["c_conv"]) & (steps["depth"] == centres["c_depth"] + 1))
        child = on.select(*comp, F.col("member").alias("conv_id"), F.col("conv_id").alias("child"), "c_depth")
        placed = spread_join(inside, child, [*comp, "conv_id"], ["depth"], "left").withColumn("lower", F.coalesce(F.col("depth") > F.col("c_depth"), F.lit(False)))
        middle = centres.select(*comp, F.col("c_conv").alias("conv_id"), F.col("c_depth").alias("depth"), F.lit(True).alias("is_centre"))
        placed = materialize(placed.join(middle, [*comp, *key], "left").withColumn("is_centre", F.coalesce("is_centre", F.lit(False))), "trie-split")
        totals = placed.where("lower or is_centre").groupBy(*comp).agg(
            F.count(F.lit(1)).alias("a_size"), *[F.sum(f"w_{c}").alias(f"a_{c}") for c in WEIGHTS]
        )
        # From the centroid to the top of its component, the steps of the centroid's smallest member.
        paid = centres.join(totals, comp)
        way = steps.select("member", F.col("conv_id").alias("at"), F.col("depth").alias("at_depth")).join(
            paid, (F.col("member") == F.col("c_conv")) & (F.col("at_depth") <= F.col("c_depth")) & (F.col("at_depth") >= F.col("top_depth"))
        )
        way = way.select(F.col("at").alias("conv_id"), F.col("at_depth").alias("depth"), "a_size", *[f"a_{c}" for c in WEIGHTS])
        added = placed.join(way, key, "left")
        add = {f"t_{c}": F.col(f"t_{c}") + F.coalesce(f"a_{c}", zero) for c in WEIGHTS}
        add["size"] = F.col("size") - F.coalesce("a_size", zero)
        added = materialize(added.withColumns(add).withColumns({
            "top": F.when(F.col("lower"), F.col("child")).otherwise(F.col("top")),
            "top_depth": F.when(F.col("lower"), F.col("c_depth") + 1).otherwise(F.col("top_depth")),
        }), "trie-added")
        settled = added.where("is_centre").select(*key, *[F.col(f"t_{c}").alias(c) for c in WEIGHTS])
        done = settled if done is None else done.unionByName(settled)
        state = materialize(outside.unionByName(added.where("not is_centre").select(*outside.columns)), "trie-state")
    parts = partitions_for(state.sparkSession, state.count() * 100.0, 32e6)
    rolled = state.repartition(parts, *comp).sortWithinPartitions("top_depth", "top").mapInArrow(
        _whole_components, "conv_id long, depth long, n_leaves long, saved_tokens long"
    )
    return rolled if done is None else rolled.unionByName(done)


# --- ends -------------------------------------------------------------------------------------------------

PIECES = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])


def ends_digest(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """(conv_id, depth, ends_sha256): the hash of the ascending ids ``member`` of every node, joined by commas."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, size = None, [], 0
        out: list[tuple] = []
        for batch in batches:
            for conv, depth, member in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "member"))):
                if ids and ((conv, depth) != key or size >= piece):
                    out.append((*key, ids[0], ",".join(map(str, ids))))
                    ids, size = [], 0
                key = conv, depth
                ids.append(member)
                size += len(str(member)) + 1
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(PIECES.names, r)) for r in out], schema=PIECES)
                out = []
        if ids:
            out.append((*key, ids[0], ",".join(map(str, ids))))
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(PIECES.names, r)) for r in out], schema=PIECES)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
        for batch in batches:
            out = []
            for conv, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "ids"))):
                if (conv, depth) == key:
                    state.update(b",")
                else:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (conv, depth), hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, state.hexdigest())))], schema=schema)

    by = ["conv_id", "depth", "member"]
    pieces = ends.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(join, "conv_id long, depth long, first long, ids string")
    return pieces.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").mapInArrow(fold, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, small: int = SMALL) -> DataFrame:
    """All nodes of conversations given as (conv_id, depth, length, TURN), the root included.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256); see the contract of the
    columns in the module's text. ``saved_tokens`` counts the bytes of turns that members of a node share beyond the first.
    """
    turns = materialize(turns, "trie-rows")
    nodes, steps = own_nodes(prefixes(turns))
    nodes = materialize(nodes, "trie-nodes")
    children = nodes.where("up is not null").groupBy(F.col("up").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    n_children = F.coalesce("n_children", F.lit(0)).cast("long")
    nodes = materialize(nodes.join(children, ["conv_id", "depth"], "left").withColumns({
        "n_children": n_children, "w_n_leaves": (n_children == 0).cast("long"), "w_saved_tokens": (F.col("n_convs") - 1) * F.col("n_bytes"),
    }), "trie-weighted")
    rolled = materialize(roll_up(nodes, steps, small), "trie-rolled")
    # The root is the first centroid: its components are the nodes of depth 1, and its totals are theirs. One row of numbers.
    convs = turns.where("depth = 1 or length = 0").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).first()
    first = rolled.where("depth = 1").agg(F.count(F.lit(1)).alias("n"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")).first()
    root = turns.sparkSession.createDataFrame(
        [(convs["conv_id"], 0, None, convs["n_convs"], first["n"], first["leaves"] or 1, first["saved"] or 0)] if convs["n_convs"] else [],
        "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long",
    )
    top = F.lit(convs["conv_id"]).cast("long")
    inner = nodes.join(rolled, ["conv_id", "depth"]).select(
        "conv_id", "depth", F.when(F.col("depth") == 1, top).otherwise(F.col("up")).alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens",
    )
    last = steps.where("depth = length").select("conv_id", "depth", "member")
    bare = turns.where("length = 0").select(top.alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.col("conv_id").alias("member"))
    digests = ends_digest(last.unionByName(bare))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return root.unionByName(inner).join(digests, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", empty))
