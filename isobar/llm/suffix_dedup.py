"""Suffix-array dedup: removes every byte covered by a string of ``LENGTH`` bytes that also starts earlier.

Texts are UTF-8 bytes; "earlier" means a smaller id, or the same text and a smaller start. Of all suffixes only those
that can share ``LENGTH`` bytes with another are ever sorted:

1. Every start has an anchor, the k-gram with the least hash in its ``LENGTH`` bytes (the leftmost one), so equal
   strings have equal anchors at equal offsets. Neighbouring starts with one anchor form a part. Parts are cut in the
   middle of the offsets, so that all strings of a part contain a common core of more than half of ``LENGTH`` bytes.
2. Parts with equal bytes are found by hash, first inside each task and then per core: all but the earliest are covered.
   A part whose core occurs in no other part holds no repeat and is dropped here; that is nearly all of a corpus.
3. What is left (different parts around one core: edges of repeated passages) is sorted by deep-shallow sorting: a
   multikey refinement by 8-byte words to ``SHALLOW`` words beyond the anchor, then a blind trie orders each group that
   is still tied. Runs of common prefixes, together with the bytes left of the anchor, give the equal strings of every
   offset and their earliest place.

Cores that a sample of the texts shows to be frequent are not brought together: their parts are cut into single starts,
each with its whole string as core, so copies of it merge in the tasks and the rest spread. The sample only steers the
balance; it changes no result, and every text is processed whole.

Hashes have 64 bits. Nulls: a null text is empty; a null id comes after all others. Texts with one id are ordered by a
hash of the text; rows equal in id and text are one document and get the same result. Input columns are kept in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isobar.llm.chosen_path import grouped
from isobar.llm.common import U64, Rolling, as_signed, buffers, input_bytes, mix, partitions_for, pieces, release, runs
from isobar.session import materialize

LENGTH, GRAM, SHALLOW = 100, 16, 2
OFFSETS = LENGTH - GRAM + 1
MIDDLE = OFFSETS // 2
#: Parts of a core in the sample that make it frequent, and the least size of the sample.
FREQUENT, SAMPLE = 16, 20_000
PLACE_BITS = U64(24)
NULL_ID = np.iinfo(np.int64).max


# --- parts ------------------------------------------------------------------------------------------------


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` values."""
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    grid = np.full(rows * width, np.iinfo(np.uint64).max, U64)
    grid[: len(x)] = x
    grid = grid.reshape(rows, width)
    up = np.minimum.accumulate(grid, axis=1).ravel()
    down = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n], up[width - 1 : width - 1 + n])


def segments(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int, int, int]]:
    """(first, last document, from, to): pieces of whole texts; a longer text comes in overlapping segments."""
    for i, j in pieces(offsets, limit):
        low, high = int(offsets[i]), int(offsets[j])
        if high - low <= 4 * limit:
            yield i, j, low, high
            continue
        while low + LENGTH <= high:
            yield i, j, low, min(high, low + limit + LENGTH - 1)
            low += limit


class Parts:
    """Parts of some texts: document, start, number of starts, offset of the anchor in the first, hash and core."""

    FIELDS = ("doc", "start", "count", "offset", "hash", "core")

    def __init__(self, **columns: np.ndarray):
        self.__dict__.update(columns)

    @classmethod
    def join(cls, parts: list[Parts]) -> Parts:
        return cls(**{f: np.concatenate([getattr(p, f) for p in parts]) for f in cls.FIELDS})

    def take(self, at: np.ndarray) -> Parts:
        return Parts(**{f: getattr(self, f)[at] for f in self.FIELDS})


def parts_of(data: np.ndarray, offsets: np.ndarray, frequent: np.ndarray) -> Parts:
    """All parts; cores in the sorted array ``frequent`` are cut into single starts."""
    none = {"doc": np.zeros(0, np.int64), "start": np.zeros(0, np.int64), "count": np.zeros(0, np.int64), "offset": np.zeros(0, np.int64),
            "hash": np.zeros(0, U64), "core": np.zeros(0, U64)}
    out = [Parts(**none)]
    for i, j, low, high in segments(offsets):
        if high - low < LENGTH:
            continue
        rolling = Rolling(data[low:high])
        bounds = np.clip(offsets[i : j + 1] - low, 0, high - low)
        place = np.arange(high - low - GRAM + 1)
        grams = mix(rolling.raw(place, place + GRAM))
        least = sliding_min((grams & ~((U64(1) << PLACE_BITS) - U64(1))) | place.astype(U64), OFFSETS)
        starts = np.arange(len(least))
        doc = np.searchsorted(bounds, starts, "right") - 1
        inside = starts + LENGTH <= bounds[doc + 1]
        starts, doc = starts[inside], doc[inside]
        if not len(starts):
            continue
        anchor = (least[starts] & ((U64(1) << PLACE_BITS) - U64(1))).astype(np.int64)
        right = anchor - starts < MIDDLE
        fresh = np.ones(len(starts), bool)
        fresh[1:] = (starts[1:] != starts[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (right[1:] != right[:-1])
        first = np.flatnonzero(fresh)
        count = np.diff(np.append(first, len(starts)))
        s, p, r, d = starts[first], anchor[first], right[first], doc[first]
        begin = np.where(r, p, p - MIDDLE)
        core = rolling.hash(begin, np.where(r, p + LENGTH - MIDDLE + 1, p + GRAM))
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, core), len(frequent) - 1)
            hot = frequent[at] == core
            if hot.any():
                n = count[hot]
                single = np.repeat(s[hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                whole = rolling.hash(single, single + LENGTH)
                base = offsets[i + np.repeat(d[hot], n)]
                out.append(Parts(doc=i + np.repeat(d[hot], n), start=low + single - base, count=np.ones(len(single), np.int64),
                                 offset=np.zeros(len(single), np.int64), hash=whole, core=whole))
                s, p, d, count, core = s[~hot], p[~hot], d[~hot], count[~hot], core[~hot]
        out.append(Parts(doc=i + d, start=low + s - offsets[i + d], count=count, offset=p - s, hash=rolling.hash(s, s + count - 1 + LENGTH), core=core))
    return Parts.join(out)


def merged(ids: np.ndarray, keys: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans joined where they touch."""
    order = np.lexsort((start, keys, ids))
    ids, keys, start, length = ids[order], keys[order], start[order], length[order]
    same = np.zeros(len(ids), bool)
    same[1:] = (ids[1:] == ids[:-1]) & (keys[1:] == keys[:-1])
    number = np.cumsum(~same)
    # Ends grow within a document; shifting documents apart makes one running maximum do for all.
    shift = number * (int((start + length).max(initial=0)) + 1)
    reach = np.maximum.accumulate(start + length + shift) if len(ids) else start
    fresh = np.ones(len(ids), bool)
    fresh[1:] = ~same[1:] | (start[1:] + shift[1:] > reach[:-1])
    first = np.flatnonzero(fresh)
    end = reach[np.append(first[1:], len(ids)) - 1] - shift[first] if len(ids) else start
    return ids[first], keys[first], start[first], end - start[first]


# --- fingerprints -----------------------------------------------------------------------------------------

CHUNK = pa.schema([("bucket", pa.int32()), ("spans", pa.bool_()), *[(f"c{i}", pa.binary()) for i in range(7)]])
CHUNK_DDL = "bucket int, spans boolean, " + ", ".join(f"c{i} binary" for i in range(7))
ROW = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int32()), ("length", pa.int32()), ("offset", pa.int32()), ("core", pa.int64())])
ROW_DDL = "doc_id long, text_key long, start int, length int, offset int, core long"


def _fingerprints(buckets: int, frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").fill_null(NULL_ID).to_numpy()
            keys = batch.column("text_key").to_numpy()
            parts = parts_of(*buffers(batch.column("text")), frequent)
            rank = np.empty(len(ids), np.int64)
            rank[np.lexsort((keys, ids))] = np.arange(len(ids))
            order = np.lexsort(((rank[parts.doc] << 32) | parts.start, parts.hash))
            parts = parts.take(order)
            first, size = runs(parts.hash)
            lead = np.repeat(first, size)
            again = lead != np.arange(len(lead))
            same_place = (ids[parts.doc] == ids[parts.doc[lead]]) & (keys[parts.doc] == keys[parts.doc[lead]]) & (parts.start == parts.start[lead])
            covered = parts.take(again & ~same_place)
            spans = merged(ids[covered.doc], keys[covered.doc], covered.start, covered.count - 1 + LENGTH)
            bucket = ((parts.core >> U64(33)) % U64(buckets)).astype(np.int32)
            if len(spans[0]):
                packed = [x.astype(t).tobytes() for x, t in zip(spans, (np.int64, np.int64, np.int32, np.int32))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(spans[1][0] % buckets)], pa.int32()), pa.array([True]), *[pa.array([x], pa.binary()) for x in [*packed, b"", b"", b""]]], schema=CHUNK
                )
            parts, bucket = parts.take(first), bucket[first]
            order = np.argsort(bucket, kind="stable")
            parts, bucket = parts.take(order), bucket[order]
            rows: list[list] = [[] for _ in CHUNK]
            for at, n in zip(*runs(bucket)):
                cut = slice(at, at + n)
                docs, index = np.unique(parts.doc[cut], return_inverse=True)
                columns = (ids[docs], keys[docs], index.astype(np.uint32 if len(docs) > 65535 else np.uint16), parts.start[cut].astype(np.int32),
                           np.stack([parts.count[cut], parts.offset[cut]]).astype(np.uint8), parts.hash[cut], parts.core[cut])
                for column, value in zip(rows, (bucket[at], False, *(c.tobytes() for c in columns))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, CHUNK)], schema=CHUNK)
            del parts, rows, columns, order
            release()

    return run


def _rows(ids, keys, start, length, offset, core) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(start.astype(np.int32)), pa.array(length.astype(np.int32)),
         pa.array(offset.astype(np.int32)), pa.array(core, pa.int64())], schema=ROW,
    )


def _compare_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans (offset -1) of parts with an earlier equal one, and the parts (length: starts) whose core occurs in others.

    Chunks come in the order of their buckets; a core lies in one bucket, so one bucket at a time is held.
    """
    columns: list[list[np.ndarray]] = [[] for _ in range(7)]
    current = None
    for batch in batches:
        for bucket, *row in zip(*(batch.column(i).to_pylist() for i in range(9))):
            if bucket != current:
                yield from _compare_bucket(columns)
                columns, current = [[] for _ in range(7)], bucket
            raw = row[1:]
            if row[0]:
                ids, keys, start, length = (np.frombuffer(x, t) for x, t in zip(raw, (np.int64, np.int64, np.int32, np.int32)))
                yield _rows(ids, keys, start, length, np.full(len(ids), -1), np.zeros(len(ids), np.int64))
                continue
            start = np.frombuffer(raw[3], np.int32)
            index = np.frombuffer(raw[2], np.uint16 if len(raw[2]) == 2 * len(start) else np.uint32)
            shape = np.frombuffer(raw[4], np.uint8).reshape(2, -1)
            values = (np.frombuffer(raw[0], np.int64)[index], np.frombuffer(raw[1], np.int64)[index], start, shape[0], shape[1],
                      np.frombuffer(raw[5], U64), np.frombuffer(raw[6], U64))
            for column, value in zip(columns, values):
                column.append(value)
    yield from _compare_bucket(columns)
    release()


def _compare_bucket(columns: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    if not columns[0]:
        return
    ids, keys, start, count, offset, whole, core = (np.concatenate(c) for c in columns)
    for column in columns:
        column.clear()
    order = np.argsort(whole, kind="stable")
    first, size = runs(whole[order])
    tied = np.repeat(size > 1, size)
    some = order[tied]
    order[tied] = some[np.lexsort((start[some], keys[some], ids[some], whole[some]))]
    lead = np.repeat(order[first], size)
    again = (np.arange(len(order)) != np.repeat(first, size)) & ~((ids[order] == ids[lead]) & (keys[order] == keys[lead]) & (start[order] == start[lead]))
    covered = order[again]
    spans = merged(ids[covered], keys[covered], start[covered].astype(np.int64), count[covered].astype(np.int64) - 1 + LENGTH)
    yield _rows(*spans, np.full(len(spans[0]), -1), np.zeros(len(spans[0]), np.int64))
    only = order[first]
    only = only[np.argsort(core[only], kind="stable")]
    begin, size = runs(core[only])
    shared = only[np.repeat(size > 1, size)]
    # Single starts have their whole string as core; another part with it would be a collision, which sorting settles.
    yield _rows(ids[shared], keys[shared], start[shared], count[shared], offset[shared], as_signed(core[shared]))


# --- deep-shallow sorting ---------------------------------------------------------------------------------


def blind_trie(strings: list[bytes]) -> list[int]:
    """Order of strings of one length by a blind trie.

    An inner node knows only the depth at which its children differ. A string descends by those bytes to some leaf; the
    comparison with this leaf alone gives the depth at which it branches off, and so its place on the path.
    """
    width = len(strings[0])
    numbers = [int.from_bytes(s, "big") for s in strings]
    root: list = [[0]]  # a leaf: the list of equal strings; an inner node: (depth, children by byte)
    for i in range(1, len(strings)):
        text, path, node = strings[i], [], root[0]
        while type(node) is tuple:
            path.append(node)
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        other = node[0]
        differ = numbers[i] ^ numbers[other]
        if not differ:
            node.append(i)
            continue
        depth = width - (differ.bit_length() + 7) // 8
        k = 0
        while k < len(path) and path[k][0] < depth:
            k += 1
        if k < len(path) and path[k][0] == depth:
            path[k][1][text[depth]] = [i]
            continue
        below = path[k] if k < len(path) else node
        inner = (depth, {strings[other][depth]: below, text[depth]: [i]})
        if k:
            path[k - 1][1][text[path[k - 1][0]]] = inner
        else:
            root[0] = inner
    out: list[int] = []
    stack = [root[0]]
    while stack:
        node = stack.pop()
        if type(node) is tuple:
            stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
        else:
            out += node
    return out


def deep_shallow(group: np.ndarray, text: np.ndarray, known: int, shallow: int = SHALLOW) -> np.ndarray:
    """Order of rows by (group, text); the first ``known`` bytes agree within a group.

    ``text`` has rows of one length, a multiple of 8. Words beyond the known bytes refine the groups that are not yet
    decided (multikey quicksort by words); after ``shallow`` words blind tries finish them.
    """
    words = text.view(">u8")
    order = np.argsort(group, kind="stable")
    label = group[order].astype(np.int64)
    low = known // 8
    for word in range(low, min(low + shallow, words.shape[1])):
        _, size = runs(label)
        tied = np.flatnonzero(np.repeat(size > 1, size))
        if not len(tied):
            return order
        part = order[tied]
        inner = np.lexsort((words[part, word].astype(U64), label[tied]))
        part = part[inner]
        order[tied] = part
        fresh = np.ones(len(order), bool)
        fresh[1:] = label[1:] != label[:-1]
        value = np.zeros(len(order), U64)
        value[tied] = words[part, word]
        fresh[1:] |= value[1:] != value[:-1]
        label = np.cumsum(fresh)
    for at, n in zip(*runs(label)):
        if n > 1:
            part = order[at : at + n]
            order[at : at + n] = part[blind_trie([text[i].tobytes() for i in part])]
    return order


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of all strings in parts (core, doc_id, text_key, start, count, offset, bytes) that start earlier elsewhere."""
    for rows in grouped(batches, "core"):
        core, ids, keys, start, count, offset = (rows.column(c).to_numpy() for c in ("core", "doc_id", "text_key", "start", "count", "offset"))
        data, at = buffers(rows.column("bytes").combine_chunks())
        n, size = len(core), np.diff(at)
        padded = np.concatenate([data, np.zeros(2 * LENGTH, np.uint8)])
        width = LENGTH + -LENGTH % 8
        right = padded[(at[:-1] + offset)[:, None] + np.arange(width)]
        right[np.arange(width) >= (size - offset)[:, None]] = 0
        # The anchor is compared as well: should two cores ever share a hash, equal strings still stand side by side.
        order = deep_shallow(core, np.ascontiguousarray(right), 0, GRAM // 8 + SHALLOW)
        ordered = right[order]
        differ = ordered[1:] != ordered[:-1]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        common[core[order][1:] != core[order][:-1]] = -1
        core_of, ids, keys, start, count, offset, at = core[order], ids[order], keys[order], start[order].astype(np.int64), count[order], offset[order], at[:-1][order]
        anchor = start + offset
        rank = np.empty(n, np.int64)
        rank[np.lexsort((anchor, keys, ids))] = np.arange(n)
        left, found = np.zeros(n, U64), []
        for a in range(OFFSETS):
            if a:
                byte = padded[np.maximum(at + offset - a, 0)].astype(U64)
                left = mix(left + byte + U64(1))
            active = np.flatnonzero((a <= offset) & (a > offset - count))
            if len(active) < 2:
                continue
            label = np.concatenate(([0], np.cumsum(common < LENGTH - a)))[active]
            own = np.lexsort((rank[active], left[active], label))
            active, label = active[own], label[own]
            again = np.zeros(len(active), bool)
            again[1:] = (label[1:] == label[:-1]) & (left[active[1:]] == left[active[:-1]])
            lead = active[np.maximum.accumulate(np.where(again, 0, np.arange(len(active))))]
            again &= ~((ids[active] == ids[lead]) & (keys[active] == keys[lead]) & (anchor[active] == anchor[lead]))
            hit = active[again]
            found.append((ids[hit], keys[hit], anchor[hit] - a))
        if found:
            i, k, s = (np.concatenate(x) for x in zip(*found))
            spans = merged(i, k, s, np.full(len(s), LENGTH))
            yield _rows(*spans, np.full(len(spans[0]), -1), np.zeros(len(spans[0]), np.int64))
    release()


PART = pa.schema([("core", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int32()), ("count", pa.int32()), ("offset", pa.int32()), ("bytes", pa.binary())])
PART_DDL = "core long, doc_id long, text_key long, start int, count int, offset int, bytes binary"


def _cut_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the asked parts of each text."""
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        asked = batch.column("asked")
        flat = asked.flatten()
        start, count, offset, core = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
        doc = np.repeat(np.arange(batch.num_rows), np.diff(asked.offsets.to_numpy()))
        begin, size = offsets[doc] + start, count.astype(np.int64) + LENGTH - 1
        for low in range(0, len(doc), 1 << 16):
            cut = slice(low, low + (1 << 16))
            ends = np.concatenate(([0], np.cumsum(size[cut])))
            index = np.repeat(begin[cut] - ends[:-1], size[cut]) + np.arange(ends[-1])
            raw = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[index]))])
            key = pa.array(doc[cut])
            yield pa.RecordBatch.from_arrays(
                [pa.array(core[cut]), batch.column("doc_id").fill_null(NULL_ID).take(key), batch.column("text_key").take(key), pa.array(start[cut]),
                 pa.array(count[cut]), pa.array(offset[cut]), raw], schema=PART,
            )
        release()


def _core_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = parts_of(*buffers(batch.column("text")), np.zeros(0, U64))
        cores, n = np.unique(parts.core, return_counts=True)
        # Distinct parts: copies merge in the tasks anyway.
        distinct = np.unique(np.stack([parts.core, parts.hash]), axis=1)[0] if len(cores) else cores
        some, n = np.unique(distinct, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(as_signed(some), pa.int64()), pa.array(n, pa.int64())], ["core", "n"])


def frequent_cores(rows: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Cores with at least FREQUENT different parts in a sample of the texts, of bounded size (one part in 50,000 beyond it)."""
    total = rows.count()
    share = min(1.0, max(sample, total // 50_000) / max(total, 1))
    picked = rows.where(F.pmod(F.col("text_key"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    counts = picked.select("text").mapInArrow(_core_counts, "core long, n long").where("n > 1").groupBy("core").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "core").limit(1 << 17).toPandas()
    return np.sort(found["core"].to_numpy(np.int64).view(U64))


# --- operator ---------------------------------------------------------------------------------------------

def cutter(as_text: bool):
    """Arrow function from text and spans to the numbers of removed bytes and runs, and what remains: bytes, or text without
    characters that were cut in two."""
    kind = T.StringType() if as_text else T.BinaryType()
    result = T.StructType([T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", kind)])

    @F.arrow_udf(result)
    def cut_out(texts: pa.Array, spans: pa.Array) -> pa.Array:
        data, offsets = buffers(texts)
        out: list[tuple] = []
        for i, found in enumerate(spans.to_pylist()):
            own = data[offsets[i] : offsets[i + 1]]
            if not found:
                out.append((0, 0, own.tobytes()))
                continue
            ids = np.zeros(len(found), np.int64)
            _, _, start, length = merged(ids, ids, np.array([s["start"] for s in found], np.int64), np.array([s["length"] for s in found], np.int64))
            keep, at = [], 0
            for s, n in zip(start.tolist(), length.tolist()):
                keep.append(own[at:s])
                at = s + n
            out.append((int(length.sum()), len(start), np.concatenate([*keep, own[at:]]).tobytes()))
        removed, number, kept = zip(*out) if out else ((), (), ())
        left = pa.array([b.decode("utf-8", "ignore") for b in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
        release()
        return pa.StructArray.from_arrays([pa.array(removed, pa.int64()), pa.array(number, pa.int64()), left], ["n_removed", "n_spans", "kept"])

    return cut_out


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(doc_id, text_key, start, length) of repeats in rows (doc_id, text_key, text); a null id is the largest number."""
    spark = rows.sparkSession
    size = input_bytes(rows, "text")
    n = partitions_for(spark, size, 32e6)
    frequent = frequent_cores(rows)
    chunks = rows.mapInArrow(_fingerprints(8 * n, frequent), CHUNK_DDL).repartition(n, "bucket").sortWithinPartitions("bucket")
    compared = materialize(chunks.mapInArrow(_compare_parts, ROW_DDL), "suffix-parts")
    asked = compared.where("offset >= 0").groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct("start", F.col("length").alias("count"), "offset", "core")).alias("asked")
    )
    keyed = rows.withColumn("doc_key", F.coalesce("doc_id", F.lit(int(NULL_ID))))
    same = (F.col("d.doc_key") == F.col("q.doc_id")) & (F.col("d.text_key") == F.col("q.text_key"))
    texts = keyed.alias("d").join(asked.alias("q"), same).select("d.doc_id", "d.text_key", "d.text", "q.asked")
    parts = texts.mapInArrow(_cut_parts, PART_DDL)
    sorted_parts = parts.repartition(n, "core").sortWithinPartitions("core")
    edges = sorted_parts.mapInArrow(_settle, ROW_DDL)
    return materialize(
        compared.where("offset < 0").unionByName(edges).select("doc_id", "text_key", "start", "length"), "suffix-spans"
    )


def remove_repeats(docs: DataFrame, doc_id: Column, text: Column, keep: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, kept); ``kept`` are the remaining bytes, or the text of them, ``row`` has the
    columns ``keep``."""
    body = F.coalesce(text, F.lit(""))
    rows = docs.select(doc_id.cast("long").alias("doc_id"), F.xxhash64(body).alias("text_key"), body.alias("text"))
    spans = repeated_spans(rows).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    row = F.struct("*") if keep is None else F.struct(*keep)
    base = docs.select(
        row.alias("row"), F.coalesce(doc_id.cast("long"), F.lit(int(NULL_ID))).alias("doc_id"), F.xxhash64(body).alias("text_key"), body.alias("text")
    )
    joined = base.join(spans, ["doc_id", "text_key"], "left")
    cut = joined.select("row", F.octet_length("text").cast("long").alias("n_bytes"), cutter(as_text)("text", "spans").alias("c"))
    return cut.select("row", "n_bytes", "c.n_removed", "c.n_spans", "c.kept")
