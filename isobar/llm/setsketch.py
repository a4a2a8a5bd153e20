"""Near-duplicate classes by SetSketch registers.

A text is the set of its shingles of three words (fewer words: one shingle of all). Texts with one set are one member.

1. A register is ``floor(1 - log_b h)`` of the least exponential hash ``h`` of the set, cut to 16 bits: minima on a scale of
   powers of ``b``. Registers of a union are the maxima of the registers, so sketches merge; two sets agree in a register
   with a probability close to their Jaccard similarity.
2. Bands of ``ROWS`` registers name buckets. A pair at the threshold misses all bands with a probability of
   (1 - 0.85^8)^32, less than 5 in 100,000.
3. In every bucket all members of other classes meet one member, the pivot; so work is linear in the bucket. In all rounds
   but the last a member meets only the pivot with which it shares the most buckets. Pairs pass a test of likelihood
   ratios: sizes are known, and the counts of greater, smaller and equal registers give the joint likelihood of every
   similarity; only pairs whose best similarity is far more likely than the threshold are put aside. The others are
   verified on their full sets, and the classes grow together. Buckets with one class are finished.
4. After ``ROUNDS`` pivots what is left are buckets of several classes. All pairs of different classes in them are tested
   and verified in blocks; no pair of a bucket is left out, whatever its size.

Nulls: a null text, or one without words, is linked with nothing. A class without ids has a null ``component_id``, and a
row with a null id is kept if its class has none. Rows equal in id and text are copies as any others. Extra columns play
no part. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isobar.llm.common import IS_SPACE, LOWER_LUT, U64, Rolling, as_signed, buffers, mix, partitions_for, pieces, release, runs, word_bounds
from isobar.llm.components import components
from isobar.llm.spread import spread_join
from isobar.session import materialize

WORDS, THRESHOLD = 3, 0.85
REGISTERS, ROWS, BASE, RATE, BITS = 256, 8, 1.02, 20.0, 16
ROUNDS, BLOCK, BLOCK_BYTES, BROADCAST_KEYS = 2, 512, 16 << 20, 300_000
#: Log-likelihood that a pair may fall short by; a true pair does with less than 1 in 100,000.
MARGIN = 10.0
_U32 = np.uint32
_SEEDS = (mix(np.arange(1, 2 * REGISTERS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) >> U64(32)).astype(_U32).reshape(2, REGISTERS) | _U32(1)


# --- sets and registers -----------------------------------------------------------------------------------


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted within it, and their offsets; words are cut at white space."""
    data = LOWER_LUT[data]
    starts, ends, doc = word_bounds(data, offsets, ~IS_SPACE)
    n = len(offsets) - 1
    if not len(starts):
        return np.zeros(0, U64), np.zeros(n + 1, np.int64)
    counts = np.bincount(doc, minlength=n)
    after = np.cumsum(counts)
    room = after[doc] - np.arange(len(doc))  # words from here to the end of the text
    word = np.concatenate([Rolling(data).hash(starts, ends), np.zeros(width, U64)])
    total = np.zeros(len(doc), U64)
    for k in range(width):
        total = np.where(room > k, mix(total + word[k : k + len(doc)] * U64(2 * k + 3)), total)
    first = np.arange(len(doc)) == (after - counts)[doc]
    whole = (room >= width) | first  # all windows, or the only one of a short text
    total, doc = total[whole], doc[whole]
    order = np.lexsort((total, doc))
    total, doc = total[order], doc[order]
    fresh = np.ones(len(total), bool)
    fresh[1:] = (total[1:] != total[:-1]) | (doc[1:] != doc[:-1])
    return total[fresh], np.concatenate(([0], np.cumsum(np.bincount(doc[fresh], minlength=n))))


def sketches(values: np.ndarray, offsets: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """SetSketch registers (n, registers) of sets given as hashes with offsets; an empty set has zeros."""
    low = np.full((len(offsets) - 1, registers), np.iinfo(_U32).max, _U32)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        x, at = (values ^ (values >> U64(32))).astype(_U32), offsets[:-1][full]
        hashed, moved = np.empty_like(x), np.empty_like(x)
        for i in range(registers):
            np.multiply(x, _SEEDS[0, i], out=hashed)
            np.right_shift(hashed, 15, out=moved)
            np.bitwise_xor(hashed, moved, out=hashed)
            np.multiply(hashed, _SEEDS[1, i], out=hashed)
            np.right_shift(hashed, 13, out=moved)
            np.bitwise_xor(hashed, moved, out=hashed)
            low[full, i] = np.minimum.reduceat(hashed, at)
    least = -np.log1p(-(low + 0.5) / 2.0**32) / RATE  # of exponential hashes, one for each hash
    out = np.clip(np.floor(1.0 - np.log(least) / math.log(BASE)), 0, 2**BITS - 1).astype(np.uint16)
    out[np.diff(offsets) == 0] = 0
    return out


MEMBER = T.StructType(
    [T.StructField("size", T.LongType()), T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()), T.StructField("sketch", T.BinaryType())]
)


def _segments(op, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offsets) - 1, U64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = op.reduceat(values, offsets[:-1][full])
    return out


@F.arrow_udf(MEMBER)
def member_of(texts: pa.Array) -> pa.Array:
    """Size, two sums that name the set, and the registers."""
    data, offsets = buffers(texts)
    size, a, b, packed = [], [], [], []
    for i, j in pieces(offsets):
        values, at = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        size.append(np.diff(at))
        a.append(_segments(np.add, mix(values), at))
        b.append(_segments(np.bitwise_xor, mix(values + U64(77)), at))
        packed += [row.tobytes() for row in sketches(values, at)]
    release()
    joined = [np.concatenate(c) if c else np.zeros(0, U64) for c in (size, a, b)]
    return pa.StructArray.from_arrays(
        [pa.array(joined[0].astype(np.int64)), pa.array(as_signed(joined[1])), pa.array(as_signed(joined[2])), pa.array(packed, pa.binary())],
        ["size", "set_a", "set_b", "sketch"],
    )


@F.arrow_udf(T.BinaryType())
def set_of(texts: pa.Array) -> pa.Array:
    data, offsets = buffers(texts)
    out = []
    for i, j in pieces(offsets):
        values, at = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        out += [values[x:y].tobytes() for x, y in zip(at[:-1], at[1:])]
    release()
    return pa.array(out, pa.binary())


def bands(members: DataFrame) -> DataFrame:
    """(bucket, set_id, size): one row for each member and band."""
    count = REGISTERS // ROWS
    schema = pa.schema([("bucket", pa.int64()), ("set_id", pa.int64()), ("size", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, _ = buffers(batch.column("sketch"))
            words = np.ascontiguousarray(data).view(U64).reshape(batch.num_rows, count, ROWS * 2 // 8)
            total = np.broadcast_to(np.arange(1, count + 1, dtype=U64), (batch.num_rows, count))
            for k in range(words.shape[2]):
                total = mix(total * U64(0x9E3779B97F4A7C15) + words[:, :, k])
            yield pa.RecordBatch.from_arrays(
                [pa.array(as_signed(np.ascontiguousarray(total).ravel())), *[pa.array(np.repeat(batch.column(c).to_numpy(), count)) for c in ("set_id", "size")]], schema=schema
            )

    return members.select("set_id", "size", "sketch").mapInArrow(cut, "bucket long, set_id long, size long")


# --- the test ---------------------------------------------------------------------------------------------


def _differ(x: np.ndarray) -> np.ndarray:
    """Probability that one set's register is greater, where ``x`` is its share of the union's elements of its own."""
    return -np.log1p(-np.clip(x, 1e-9, 1.0) * (BASE - 1) / BASE) / math.log(BASE)


def log_likelihood(jaccard, greater, smaller, equal, size_a, size_b):
    """Joint log-likelihood of a similarity, given the sizes and the counts of registers."""
    u = size_a / (size_a + size_b)
    up, down = _differ(u - (1 - u) * jaccard), _differ((1 - u) - u * jaccard)
    return greater * np.log(up) + smaller * np.log(down) + equal * np.log(np.maximum(1 - up - down, 1e-12))


def estimate(greater, smaller, equal, size_a, size_b, steps: int = 200) -> np.ndarray:
    """Most likely similarity of every pair, on a grid up to the largest that the sizes allow."""
    grid = np.linspace(0, 1, steps + 1)[None, :] * (np.minimum(size_a, size_b) / np.maximum(size_a, size_b))[:, None]
    columns = [np.asarray(x, float)[:, None] for x in (greater, smaller, equal, size_a, size_b)]
    return np.take_along_axis(grid, log_likelihood(grid, *columns).argmax(axis=1)[:, None], 1)[:, 0]


def may_link(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs of sketches whose similarity may reach the threshold."""
    size_a, size_b = size_a.astype(float), size_b.astype(float)
    ok = np.minimum(size_a, size_b) >= threshold * np.maximum(size_a, size_b) - 1e-9
    greater, smaller = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = REGISTERS - greater - smaller
    at = np.flatnonzero(ok)
    for k in range(0, len(at), 1 << 13):
        part = at[k : k + (1 << 13)]
        counts = [x[part] for x in (greater, smaller, equal, size_a, size_b)]
        best = estimate(*counts)
        short = best < threshold
        lost = log_likelihood(best, *counts) - log_likelihood(np.full(len(part), threshold), *counts)
        ok[part] = ~short | (lost <= MARGIN)
    return ok


# --- pairs ------------------------------------------------------------------------------------------------

PAIR = "a long, b long, size_a long, size_b long"
PAIR_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("size_a", pa.int64()), ("size_b", pa.int64())])


def meet(pairs: DataFrame, payload: DataFrame, volume: float, judge: Callable) -> DataFrame:
    """Pairs (a, b, size_a, size_b) that ``judge`` accepts by the payloads (set_id, payload) of both.

    ``a`` may stand in any number of pairs: its payload goes once to each of its salted groups and is held there while the
    payloads of its partners stream by.
    """
    spark = pairs.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int"))
    none = F.lit(None).cast("long")
    heads = salted.select("a", "salt").distinct().join(payload, F.col("a") == F.col("set_id"))
    heads = heads.select("a", "salt", none.alias("b"), none.alias("size_a"), none.alias("size_b"), "payload")
    partners = salted.join(payload, F.col("b") == F.col("set_id")).select("a", "salt", "b", "size_a", "size_b", "payload")
    rows = heads.unionByName(partners).repartition(partitions_for(spark, volume, 32e6), "a", "salt").sortWithinPartitions("a", "salt", "b")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = b""
        for batch in batches:
            is_head = np.asarray(batch.column("b").is_null())
            if not len(is_head):
                continue
            raw = batch.column("payload")
            which = np.maximum.accumulate(np.where(is_head, np.arange(len(is_head)), -1))
            at = np.flatnonzero(~is_head)
            if len(at):
                carried = held
                ok = judge(batch, raw, at, which[at], carried)
                keep = pa.array(at[ok])
                yield pa.RecordBatch.from_arrays([batch.column(c).take(keep) for c in PAIR_SCHEMA.names], schema=PAIR_SCHEMA)
            if which[-1] >= 0:
                held = raw[int(which[-1])].as_py()
        release()

    return rows.mapInArrow(stream, PAIR)


def likely(pairs: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose registers may belong to linked sets."""

    def judge(batch, raw, at, head, carried):
        out = np.zeros(len(at), bool)
        for k in range(0, len(at), 1 << 12):
            rows, top = at[k : k + (1 << 12)], head[k : k + (1 << 12)]
            a = np.frombuffer(b"".join(carried if t < 0 else raw[int(t)].as_py() for t in top), np.uint16).reshape(-1, REGISTERS)
            b = np.frombuffer(b"".join(raw[int(r)].as_py() for r in rows), np.uint16).reshape(-1, REGISTERS)
            sizes = [batch.column(c).to_numpy(zero_copy_only=False)[rows] for c in ("size_a", "size_b")]
            out[k : k + (1 << 12)] = may_link(a, b, *sizes, threshold)
        return out

    return meet(pairs, members.select("set_id", F.col("sketch").alias("payload")), pairs.count() * 4.0 * REGISTERS, judge)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets, both not empty, have at least so many per cent of their union in common."""
    place = np.minimum(np.searchsorted(a, b), len(a) - 1)
    common = int((a[place] == b).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose full sets have at least the threshold of Jaccard similarity."""
    percent = round(100 * threshold)

    def judge(batch, raw, at, head, carried):
        out, now, top = np.zeros(len(at), bool), None, None
        for k, (row, t) in enumerate(zip(at.tolist(), head.tolist())):
            if now is None or t != top:
                now, top = np.frombuffer(carried if t < 0 else raw[t].as_py(), U64), t
            out[k] = linked(now, np.frombuffer(raw[row].as_py(), U64), percent)
        return out

    volume = pairs.agg(F.coalesce(F.sum(F.col("size_a") + F.col("size_b")), F.lit(0))).first()[0] * 8.0
    return meet(pairs, sets.select("set_id", F.col("shingles").alias("payload")), volume, judge)


def fitting(threshold: float) -> Column:
    return F.least("size_a", "size_b") >= F.lit(threshold) * F.greatest("size_a", "size_b") - 1e-9


def pivot_pairs(rows: DataFrame, turn: int, threshold: float, every: bool) -> DataFrame:
    """Members of open buckets with the pivots of their buckets, where their classes differ.

    ``every`` gives all pivots of a member; otherwise a member meets one pivot, with which it shares the most buckets.
    """
    me = F.struct("set_id", "size", "class_id")
    pivots = rows.groupBy("bucket").agg(F.min_by(me, F.struct(F.xxhash64("set_id", F.lit(turn)), F.col("set_id"))).alias("p"))
    met = spread_join(rows, pivots, ["bucket"], ["set_id"]).where("class_id <> p.class_id")
    pairs = met.select(F.col("p.set_id").alias("a"), F.col("set_id").alias("b"), F.col("p.size").alias("size_a"), F.col("size").alias("size_b"))
    pairs = pairs.where(fitting(threshold))
    if every:
        return pairs.distinct()
    shared = pairs.groupBy("a", "b", "size_a", "size_b").agg(F.count(F.lit(1)).alias("n"))
    return shared.groupBy("b").agg(F.max_by(F.struct("a", "size_a", "size_b"), F.struct("n", "a")).alias("p")).select("p.a", "b", "p.size_a", "p.size_b")


def remaining_links(rows: DataFrame, members: DataFrame, sets: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect the classes of open buckets as all their links would.

    Members that open buckets connect meet in blocks, once, whatever the number of buckets they share; blocks are bounded in
    members and in bytes. The largest class does not meet itself: its blocks are met by the blocks of all others. A task
    tests the registers of pairs of different classes that share a band, verifies the likely ones on their sets, and gives
    a spanning forest of the links.
    """
    spark = rows.sparkSession
    least = rows.groupBy("bucket").agg(F.min("set_id").alias("a"))
    edges = spread_join(rows, least, ["bucket"], ["set_id"]).select("a", F.col("set_id").alias("b"))
    parts = materialize(components(edges, "sketch-parts"), "sketch-parts").select(F.col("node").alias("set_id"), F.col("root").alias("part"))
    nodes = materialize(rows.select("set_id", "size", "class_id").distinct().join(parts, "set_id"), "sketch-nodes")
    classes = nodes.groupBy("part", "class_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight"))
    top = F.max(F.struct("n", "weight", "class_id")).alias("top")
    main = classes.groupBy("part").agg(top, F.sum("n").alias("n_all"), F.sum("weight").alias("all")).select("part", "top.*", "n_all", "all")
    main = main.select("part", F.col("class_id").alias("main"), "n", "weight", "n_all", "all")

    def blocks(n: Column, weight: Column) -> Column:
        return F.greatest(F.ceil(n / block), F.ceil(weight * 8 / BLOCK_BYTES)).cast("int")

    placed = spread_join(nodes, main, ["part"], ["set_id"]).where("n < n_all")
    mains, others = blocks(F.col("n"), F.col("weight")), blocks(F.col("n_all") - F.col("n"), F.col("all") - F.col("weight"))
    is_main = F.col("class_id") == F.col("main")
    own = F.pmod(F.xxhash64("set_id"), F.when(is_main, mains).otherwise(others)).cast("int")
    # Cells (i, j): block i of the others with block j of the others (j >= i) or with block j of the main class.
    span = F.sequence(F.lit(0), others - 1)
    dealt = placed.withColumn("own", own).withColumn(
        "cells",
        F.when(is_main, F.transform(span, lambda i: F.struct(i.alias("i"), (others + F.col("own")).alias("j")))).otherwise(
            F.concat(
                F.transform(span, lambda i: F.struct(F.least(i, F.col("own")).alias("i"), F.greatest(i, F.col("own")).alias("j"))),
                F.transform(F.sequence(F.lit(0), mains - 1), lambda j: F.struct(F.col("own").alias("i"), (others + j).alias("j"))),
            )
        ),
    )
    cells = dealt.select("part", "set_id", "size", "class_id", F.explode("cells").alias("c")).select(
        F.xxhash64("part", "c.i", "c.j").alias("cell"), "set_id", "size", "class_id"
    )
    cells = materialize(cells, "sketch-cells")
    payload = cells.join(members.select("set_id", "sketch"), "set_id").join(sets.select("set_id", "shingles"), "set_id")
    volume = cells.agg(F.coalesce(F.sum(F.col("size") * 8 + 600), F.lit(0))).first()[0]
    floor = REGISTERS * threshold - 6 * math.sqrt(REGISTERS * threshold * (1 - threshold))
    percent = round(100 * threshold)

    def compare(rows: pa.Table) -> pa.Table:
        ids, size, classes = (rows.column(c).to_numpy() for c in ("set_id", "size", "class_id"))
        data, _ = buffers(rows.column("sketch"))
        registers = np.ascontiguousarray(data).view(np.uint16).reshape(len(ids), REGISTERS)
        keys = registers.view(np.dtype((np.void, ROWS * 2))).reshape(len(ids), REGISTERS // ROWS)
        data, offsets = buffers(rows.column("shingles"))
        values, at = np.ascontiguousarray(data).view(U64), offsets // 8
        group = np.unique(classes, return_inverse=True)[1]  # classes as this cell knows them
        found: list[list[int]] = [[], []]
        for i in range(len(ids)):
            later = np.flatnonzero(group[i + 1 :] != group[i]) + i + 1
            later = later[np.minimum(size[later], size[i]) >= threshold * np.maximum(size[later], size[i]) - 1e-9]
            later = later[(registers[later] == registers[i]).sum(axis=1) >= floor]
            later = later[(keys[later] == keys[i]).any(axis=1)]
            later = later[may_link(np.broadcast_to(registers[i], (len(later), REGISTERS)), registers[later], np.full(len(later), size[i]), size[later], threshold)]
            mine = values[at[i] : at[i + 1]]
            for j in later.tolist():
                if group[i] != group[j] and linked(mine, values[at[j] : at[j + 1]], percent):
                    group[group == group[j]] = group[i]
                    found[0].append(i), found[1].append(j)
        release()
        return pa.table({"a": pa.array(ids[found[0]], pa.int64()), "b": pa.array(ids[found[1]], pa.int64())})

    by_cell = payload.select("cell", "set_id", "size", "class_id", "sketch", "shingles").repartition(partitions_for(spark, volume, 32e6), "cell")
    return by_cell.groupBy("cell").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: Column, text: Column, threshold: float = THRESHOLD, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: the size of its set and the smallest id of its class."""
    rows = docs.select(doc_id.cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"))
    base = rows.select("doc_id", "text_key", member_of(F.coalesce("text", F.lit(""))).alias("m")).select("doc_id", "text_key", "m.*")
    base = materialize(base.withColumn("set_id", F.when(F.col("size") > 0, F.xxhash64("size", "set_a", "set_b"))), "sketch-rows")
    members = materialize(
        base.where("set_id is not null").groupBy("set_id").agg(
            F.max("size").alias("size"), F.max("sketch").alias("sketch"), F.min("doc_id").alias("least_id"),
            F.min(F.struct("doc_id", "text_key")).alias("first"),
        ), "sketch-members",
    )
    banded = materialize(bands(members), "sketch-bands")
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = materialize(spread_join(banded, shared, ["bucket"], ["set_id"]), "sketch-buckets")
    firsts = materialize(
        buckets.select("set_id").distinct().join(members, "set_id").select("set_id", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_key")),
        "sketch-texts",
    )
    # Few documents have partners: up to so many keys, a bound of 8 MB, go to the texts instead of the texts to them.
    texts = F.broadcast(firsts) if firsts.count() <= BROADCAST_KEYS else firsts
    same = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("first_key"))
    sets = materialize(rows.join(texts, same).select("set_id", set_of(F.coalesce("text", F.lit(""))).alias("shingles")), "sketch-sets").dropDuplicates(["set_id"])

    links = None
    classes = None
    for turn in range(rounds + 1):
        now = buckets.withColumn("class_id", F.col("set_id"))
        if classes is not None:
            now = spread_join(buckets, classes.select(F.col("node").alias("set_id"), "root"), ["set_id"], ["bucket"], "left")
            now = now.withColumn("class_id", F.coalesce("root", "set_id")).drop("root")
            # One class: nothing to link. Two members have met as pivot and partner, where all pivots were met.
            several = now.groupBy("bucket").agg(F.min("class_id").alias("lo"), F.max("class_id").alias("hi")).where("lo <> hi").select("bucket")
            now = materialize(spread_join(now.where(F.col("n") > (2 if turn == rounds else 1)), several, ["bucket"], ["set_id"]), "sketch-open")
            if now.isEmpty():
                break
        if turn < rounds:
            pairs = materialize(pivot_pairs(now, turn, threshold, turn == rounds - 1), "sketch-pairs")
            new = verified(materialize(likely(pairs, members, threshold), "sketch-likely"), sets, threshold).select("a", "b")
        else:
            new = remaining_links(now, members, sets, threshold, block)
        new = materialize(new, "sketch-links")
        links = new if links is None else links.unionByName(new)
        classes = materialize(components(links, "sketch-classes"), "sketch-roots")
    least = members.select("set_id", "least_id").join(classes.select(F.col("node").alias("set_id"), "root"), "set_id", "left")
    least = materialize(least.withColumn("root", F.coalesce("root", "set_id")), "sketch-least")
    smallest = least.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = materialize(spread_join(least, smallest, ["root"], ["set_id"]).select("set_id", "component_id"), "sketch-named")
    linked = spread_join(base.where("set_id is not null").select("doc_id", "size", "set_id"), named, ["set_id"], ["doc_id"])
    bare = base.where("set_id is null").select("doc_id", "size", F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", "size", "component_id").unionByName(bare).withColumnRenamed("size", "n_shingles")
