"""Merkle manifest and prefix trie against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobar.llm import merkle, trie
from isobar.llm.common import lower_ascii
from tests.llm.data import DOCUMENTS, documents


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- manifest ---------------------------------------------------------------------------------------------


def encoded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(digests):
    """Top of a list of digests, and the siblings of each on its way up."""
    ways = [[] for _ in digests]
    where = list(range(len(digests)))
    while len(digests) > 1:
        for i, at in enumerate(where):
            first = at - at % 16
            ways[i].append(("".join(digests[first:at]), "".join(digests[at + 1 : first + 16])))
        where = [w // 16 for w in where]
        digests = [sha(*digests[i : i + 16]) for i in range(0, len(digests), 16)]
    return digests[0], ways


def expected(rows):
    """(doc_id, leaf, subroot, root, proof, folded) of rows (doc_id, source, text)."""
    groups = {}
    for doc_id, source, text in rows:
        leaf = sha(encoded(doc_id), encoded(source), encoded(text))
        low = None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        changed = sha(encoded(doc_id), encoded(source), encoded(low)) if doc_id is not None and doc_id % 3 == 0 else None
        groups.setdefault(source, []).append((doc_id, leaf, changed))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    tops = {s: climb([r[1] for r in groups[s]]) for s in order}
    root, upper = climb([tops[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for r, way in zip(groups[s], tops[s][1]):
            way = way + upper[k]
            now = r[1] if r[2] is None else r[2]
            for before, after in way:
                now = sha(before, now, after)
            out.append((r[0], r[1], tops[s][0], root, sha(*[x for p in way for x in p]), now))
    return sorted(out, key=str)


def manifested(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, text string, leaf string, tree int").repartition(3)
    fields = [F.col("doc_id"), F.col("source")]
    changed = F.when(F.col("doc_id") % 3 == 0, merkle.leaf_digest(*fields, lower_ascii(F.col("text"))))
    return merkle.manifest(docs, F.col("doc_id"), F.col("source"), merkle.leaf_digest(*fields, F.col("text")), changed)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]


@pytest.mark.parametrize("sizes", [[1], [17, 1], [5000, 256, 257, 16, 1, 2], [1] * 40])
def test_manifest_equals_plain_trees(spark, sizes):
    rng = random.Random(len(sizes))
    rows = [(rng.randrange(10**6), f"s{k}", rng.choice(["Ab", "b", "É", None])) for k, n in enumerate(sizes) for _ in range(n)]
    got = sorted((tuple(r) for r in manifested(spark, rows).select(*COLUMNS).collect()), key=str)
    assert got == expected(rows)


def test_manifest_of_awkward_rows(spark):
    rows = [(None, None, None), (None, "", ""), (3, "", "A" * 100_000), (3, "", "A" * 100_000), (3, "", "b"), (6, "é", "Z"), (9, "z", None), (-4, "\U0001f600", "x")]
    got = manifested(spark, rows)
    assert sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=str) == expected(rows)
    unequal = {r["doc_id"] for r in got.where("folded_root <> root").collect()}
    assert unequal == {3, 6}  # only a changed text changes the root
    assert manifested(spark, []).collect() == []


def test_versions_share_all_but_the_ancestors(spark):
    rows = [(i, "s", "A") for i in range(600)] + [(i, "t", "A") for i in range(3)]
    proved = manifested(spark, rows)
    copies = merkle.copied_nodes(proved)
    per = {(r["tree"], r["version"]): r["count"] for r in copies.groupBy("tree", "version").count().collect()}
    assert set(per.values()) == {4, 2} and len(per) == 201  # three levels of s, one of t, and the root
    last = copies.where("(tree = '+s' and level = 4) or (tree = '+t' and level = 2)").select("digest").distinct().count()
    assert last == 201


# --- trie -------------------------------------------------------------------------------------------------


def rebuilt(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def plain_trie(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    done = {}
    for path in sorted(members, key=len, reverse=True):
        below = [done[p] for p in children.get(path, [])]
        own = (len(members[path]) - 1) * (len(path[-1][1].encode()) if path else 0)
        done[path] = (sum(b[0] for b in below) or 1, own + sum(b[1] for b in below))
    out = []
    for path, who in members.items():
        ends = sorted(c for c in who if len(convs[c]) == len(path))
        out.append((
            min(who), len(path), min(members[path[:-1]]) if path else None, len(who), len(children.get(path, [])), *done[path],
            sha(",".join(map(str, ends))),
        ))
    return sorted(out, key=str)


def trie_of(spark, rows, **options):
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, depth string").repartition(3)
    turns = trie.turns_in_order(table, F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text"))
    head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(9))
    found = trie.prefix_trie(trie.with_shared_heads(turns, head, F.col("conv_id") - F.col("conv_id") % 5), **options)
    return sorted((tuple(r) for r in found.collect()), key=str)


def conversations(seed, n, words, longest):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(words)) for c in range(n) for t in range(rng.randint(1, longest))]
    rows += [(n + 5 + k, t, "user", "same") for k in range(n // 2) for t in range(12)]  # a third are copies
    rows += [(3 * n + 8, t, "user", f"w{t % 7}") for t in range(150)]  # a chain
    return rows


@pytest.mark.parametrize("small", [2, 7, trie.SMALL])
def test_trie_equals_plain_python(spark, small):
    rows = conversations(small, 40, ["a", "é", "", None], 14)
    assert trie_of(spark, rows, small=small) == plain_trie(rebuilt(rows))


def test_trie_of_awkward_rows(spark):
    rows = [(None, 1, "user", "x"), (7, None, None, None), (7, 1, "user", "b" * 100_000), (7, 1, "user", "b" * 100_000), (-3, 1, "u", "x"), (21, 0, "u", "x"), (2**40, 0, "u", "")]
    assert trie_of(spark, rows) == plain_trie(rebuilt(rows))
    assert trie_of(spark, []) == []
    turnless = [(c, 0, "u", "x") for c in (11, 12, 13) if zlib.crc32(str(c).encode()) % 9]
    assert turnless and trie_of(spark, turnless) == plain_trie(rebuilt(turnless))


def test_long_conversations_run_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 4)
    rows = conversations(5, 10, ["a", "b"], 30)
    assert trie_of(spark, rows, small=16) == plain_trie(rebuilt(rows))


def test_ends_are_hashed_in_pieces(spark):
    ends = spark.createDataFrame([(1, 2, i) for i in range(3000)] + [(4, 2, 9)], "conv_id long, depth long, member long").repartition(5)
    got = {r["conv_id"]: r["ends_sha256"] for r in trie.ends_digest(ends, piece=100).collect()}
    assert got == {1: sha(",".join(map(str, range(3000)))), 4: sha("9")}


@pytest.mark.parametrize("seed", range(6))
def test_centroids_sum_subtrees(seed):
    rng = np.random.default_rng(seed)
    comp, up, depth, size = [], [], [], []
    for k in range(5):
        n, first = int(rng.integers(1, 60)), len(comp)
        for i in range(n):
            parent = -1 if i == 0 else first + int(rng.integers(max(0, i - 3) if seed % 2 else 0, i))
            comp.append(k), up.append(parent), depth.append(1 if i == 0 else depth[parent] + 1)
    size = np.ones(len(comp), np.int64)
    weights = rng.integers(0, 100, (len(comp), 2))
    want = weights.copy()
    for v in range(len(comp) - 1, -1, -1):  # parents come before their children
        if up[v] >= 0:
            size[up[v]] += size[v]
            want[up[v]] += want[v]
    got = trie.split_components(np.array(comp), np.array(up), np.array(depth), size, weights)
    assert (got == want).all()


def test_manifest_of_the_documents_fixture(spark):
    rows = [(r[0], r[3], r[1]) for r in documents()]
    assert len(DOCUMENTS) and sorted((tuple(r) for r in manifested(spark, rows).select(*COLUMNS).collect()), key=str) == expected(rows)
