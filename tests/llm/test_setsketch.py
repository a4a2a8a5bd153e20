"""SetSketch registers and near-duplicate classes against plain Python."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobar.llm import setsketch
from tests.llm.data import DOCUMENTS, documents, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def plain_classes(rows):
    """(doc_id, n_shingles, component_id) of rows (doc_id, text)."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, len(sets[i]), least.get(find(i))) for i, (doc, _) in enumerate(rows)), key=str)


def found(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, size string, set_id int").repartition(3)
    return sorted((tuple(r) for r in setsketch.near_duplicates(docs, F.col("doc_id"), F.col("text"), **options).collect()), key=str)


def edited(rng, text, share):
    words = text.split()
    for i in rng.sample(range(len(words)), max(1, round(share * len(words)))):
        words[i] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def near_groups(seed, n=150):
    """Copies with one to ten in a hundred words changed, so similarities lie on both sides of the threshold."""
    rng = random.Random(seed)
    hot = prose(rng, 300)
    rows = [(i, edited(rng, hot, rng.choice([0.004, 0.01, 0.02, 0.03, 0.05, 0.1]))) for i in range(n // 2)]
    for i in range(n // 2, n):
        rows.append((i, edited(rng, rows[rng.randrange(i)][1], 0.02) if i % 2 else prose(rng, rng.randint(1, 200))))
    return rows


@pytest.mark.parametrize("rounds", [0, 1, setsketch.ROUNDS])
def test_classes_equal_plain_python(spark, rounds):
    """Without pivots everything is left to the blocks; both ways find the same classes."""
    rows = near_groups(rounds)
    assert found(spark, rows, rounds=rounds, block=16) == plain_classes(rows)


def test_classes_of_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in documents()] + [(None, None), (None, "lone text of a row without id"), (500, " \t "), (501, "A b"), (502, "a  B\n")]
    assert found(spark, rows) == plain_classes(rows)
    assert found(spark, []) == []
    assert DOCUMENTS


def sets_of(*sizes):
    rng = np.random.default_rng(3)
    values = [np.sort(rng.integers(0, 2**63, n).astype(np.uint64)) for n in sizes]
    return np.concatenate(values), np.concatenate(([0], np.cumsum(sizes)))


def test_sketches_merge():
    values, at = sets_of(500, 1, 300)
    parts = setsketch.sketches(values, at)
    whole = setsketch.sketches(np.sort(values), np.array([0, len(values)]))
    assert (parts.max(axis=0) == whole[0]).all()


@pytest.mark.parametrize("shared,own_a,own_b", [(900, 50, 50), (500, 250, 250), (300, 10, 400), (50, 0, 8)])
def test_joint_estimate_is_close(shared, own_a, own_b):
    rng = np.random.default_rng(shared)
    errors = []
    for _ in range(40):
        v = rng.integers(0, 2**63, shared + own_a + own_b).astype(np.uint64)
        a, b = np.sort(v[: shared + own_a]), np.sort(np.concatenate([v[:shared], v[shared + own_a :]]))
        k = setsketch.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])).astype(int)
        up, down = (k[0] > k[1]).sum(), (k[0] < k[1]).sum()
        counts = [np.array([x]) for x in (up, down, setsketch.REGISTERS - up - down, len(a), len(b))]
        errors.append(setsketch.estimate(*counts)[0] - shared / len(v))
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.05


def test_pairs_at_the_threshold_are_found(spark):
    """Two thousand pairs just above the threshold, each alone in its class."""
    rng = random.Random(8)
    rows, want = [], 0
    while want < 2000:
        base = [f"w{rng.randrange(10**9)}" for _ in range(rng.randint(60, 200))]
        other = list(base)
        for i in rng.sample(range(2, len(base) - 2), max(1, len(base) // 45)):
            other[i] = f"x{rng.randrange(10**9)}"
        a, b = shingle_set(" ".join(base)), shingle_set(" ".join(other))
        if 0.85 <= len(a & b) / len(a | b) < 0.9:
            rows += [(2 * want, " ".join(base)), (2 * want + 1, " ".join(other))]
            want += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = setsketch.near_duplicates(docs, F.col("doc_id"), F.col("text"))
    assert got.where("doc_id % 2 = 1 and component_id = doc_id - 1").count() >= 1999
