import numpy as np
import pytest

from isobar.operators import knn
from isobar.operators.knn import VectorIndex


def frame(spark, ids, vectors, groups, kind="float"):
    rows = [(i, [float(x) for x in v], g) for i, v, g in zip(ids, vectors, groups, strict=True)]
    return spark.createDataFrame(rows, f"candidate_id string, vector array<{kind}>, group_id string")


def brute(ids, vectors, groups, k):
    out = {}
    for i, v, g in zip(ids, vectors, groups, strict=True):
        gaps = vectors - v
        dist = np.einsum("ij,ij->i", gaps, gaps, dtype=np.float64)
        best = sorted((d, c) for d, c, h in zip(dist, ids, groups, strict=True) if c != i and (g is None or h is None or h != g))
        out[i] = [c for _, c in best[:k]]
    return out


def test_small_fixture_with_ties_and_exclusions(spark):
    df = frame(spark, ["self", "a", "b", "c"], [[0, 0], [1, 0], [-1, 0], [4, 0]], ["same", "x", "y", "z"])
    query = spark.createDataFrame([("self", [0.0, 0.0], "same")], "query_id string, vector array<float>, group_id string")
    hits = VectorIndex.fit(df).search(query, 2).orderBy("rank").collect()
    assert [(h["candidate_id"], h["rank"], h["distance"]) for h in hits] == [("a", 1, 1.0), ("b", 2, 1.0)]
    assert hits[0]["provenance"] == "background_context_index"
    assert VectorIndex.fit(df).search(query, 0).count() == 0
    assert VectorIndex.fit(df).search(query, 99).count() == 3


@pytest.mark.parametrize("cells,limit", [(1, None), (12, None), (80, None), (12, 0)])
def test_join_equals_brute_force(spark, monkeypatch, cells, limit):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8)) * 4
    vectors = (centres[rng.integers(0, 6, 300)] + rng.normal(size=(300, 8))).astype(np.float32)
    # One group owns a third of the rows, and some rows have no group.
    groups = ["hot" if i % 3 == 0 else None if i % 7 == 0 else f"g{i % 5}" for i in range(300)]
    ids = [str(i) for i in range(300)]
    if limit is not None:
        monkeypatch.setattr(knn, "BROADCAST_BYTES", limit)
    df = frame(spark, ids, vectors, groups)
    index = VectorIndex.fit(df, cells=cells, probes=100, block_rows=16)
    got = {}
    for r in index.search(df, 7, id_col="candidate_id").orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["candidate_id"])
    assert got == brute(ids, vectors, groups, 7)


def test_pruned_cells_do_not_change_results(spark):
    rng = np.random.default_rng(5)
    vectors = np.concatenate([rng.normal(size=(60, 4)) + 100 * i for i in range(5)]).astype(np.float64)
    ids, groups = [str(i) for i in range(300)], [None] * 300
    df = frame(spark, ids, vectors, groups, "double")
    index = VectorIndex.fit(df, cells=20, probes=200)
    got = {}
    for r in index.search(df, 5, id_col="candidate_id").orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["candidate_id"])
    assert got == brute(ids, vectors, groups, 5)


def test_ivf_recall_and_bad_input(spark):
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(200, 4)).astype(np.float32)
    ids, groups = [str(i) for i in range(200)], [None] * 200
    df = frame(spark, ids, vectors, groups)
    approx = VectorIndex.fit(df, backend="ivf", cells=10, nprobe=5).search(df, 10, id_col="candidate_id")
    truth = {(q, c) for q, cs in brute(ids, vectors, groups, 10).items() for c in cs}
    found = {(r["query_id"], r["candidate_id"]) for r in approx.collect()}
    assert len(found & truth) / len(truth) > 0.8
    with pytest.raises(ValueError, match="unique"):
        VectorIndex.fit(df.unionByName(df.limit(1)))
    with pytest.raises(ValueError, match="dimension|values"):
        VectorIndex.fit(df, dimension=5)
    with pytest.raises(ValueError, match="backend"):
        VectorIndex.fit(df, backend="tree")
    with pytest.raises(Exception, match="finite"):
        VectorIndex.fit(frame(spark, ["a", "b"], [[float("nan"), 0], [1, 1]], [None, None]))


def test_copies_are_cut_inside_the_task(spark):
    vectors = np.concatenate([np.zeros((100, 3)), np.random.default_rng(2).normal(size=(200, 3))]).astype(np.float32)
    ids, groups = [f"i{i:03d}" for i in range(300)], [None] * 300
    df = frame(spark, ids, vectors, groups)
    index = VectorIndex.fit(df, cells=3, block_rows=50)
    got = {}
    for r in index.search(df, 4, id_col="candidate_id").orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["candidate_id"])
    assert got == brute(ids, vectors, groups, 4)
    score = knn._score(3, np.float32, 4, True)
    import pyarrow as pa

    kinds = {"cell": pa.int32(), "q_visits": pa.list_(pa.list_(pa.int32())), "q_bounds": pa.list_(pa.float64())}
    names = ("cell", "q_ids", "q_grps", "q_vecs", "q_bounds", "q_visits", "a_ids", "a_grps", "a_vecs")
    schema = pa.schema([(n, kinds.get(n, pa.list_(pa.float32() if n.endswith("vecs") else pa.string()))) for n in names])

    def block(a_ids, a_vecs, **more):
        row = {"cell": 1, "q_ids": ["q"], "q_grps": [None], "q_vecs": [0.0, 0.0, 0.0], "q_bounds": [float("inf")], "q_visits": None,
               "a_ids": a_ids, "a_grps": [None] * len(a_ids), "a_vecs": a_vecs}
        return pa.RecordBatch.from_pylist([{**row, **more}], schema=schema)

    def emitted(*blocks):
        return [b.column(1).to_pylist() for b in score(iter(blocks))]

    copies = block(ids[:100], [0.0] * 300)
    assert emitted(copies) == [["i000", "i001", "i002", "i003"]]
    far = block([f"f{i}" for i in range(50)], [9.0] * 150)
    assert emitted(copies, far) == [["i000", "i001", "i002", "i003"], []]  # the task knows four nearer rows
    assert emitted(block(["a", "b"], [1.0] * 3 + [3.0] * 3, q_bounds=[2.0])) == [["a"]]
    assert emitted(block(["a"], [1.0] * 3, q_visits=[[2, 3]])) == [[]] and emitted(block(["a"], [1.0] * 3, q_visits=[[1]])) == [["a"]]


def test_only_the_best_rows_leave_a_part(spark):
    """However many blocks a query meets, k rows leave, and the number of parts does not follow the queries."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    queries, archive = rng.normal(size=(7, 3)).astype(np.float32), rng.normal(size=(2000, 3)).astype(np.float32)
    archive = archive[np.argsort(-(archive**2).sum(axis=1))]  # the far ones first, so that every block has better rows
    schema = pa.schema(
        [("part", pa.int32()), ("met", pa.int32()), ("ids", pa.list_(pa.string())), ("grps", pa.list_(pa.string())), ("vecs", pa.list_(pa.float32())),
         ("bounds", pa.list_(pa.float64())), ("visits", pa.list_(pa.list_(pa.int32()))), ("cells", pa.list_(pa.int32()))]
    )

    def row(met, name, values):
        ids = [f"{name}{i:04d}" for i in range(len(values))]
        return {"part": 3, "met": met, "ids": ids, "grps": [None] * len(ids), "vecs": values.ravel().tolist(),
                "bounds": None if met else [float("inf")] * len(ids), "visits": None, "cells": [0]}

    rows = [row(0, "q", queries)]
    rows += [row(1, f"b{i:02d}-", archive[100 * i : 100 * i + 100]) for i in range(20)]
    batches = [pa.RecordBatch.from_pylist(rows[i : i + 4], schema=schema) for i in range(0, len(rows), 4)]
    out = pa.Table.from_batches(list(knn._meet(3, np.float32, 5, True, np.zeros(3))(iter(batches)))).to_pylist()
    assert len(out) == 7 * 5
    for i, q in enumerate(queries):
        best = np.sort(((archive - q).astype(np.float64) ** 2).sum(axis=1))[:5]
        assert np.allclose(sorted(r["distance"] for r in out if r["query_id"] == f"q{i:04d}"), best)
    assert knn._parts(100_000, 12) == knn._parts(600_000, 12) == 36 and knn._parts(10, 12) == 1


@pytest.mark.parametrize("kind", ["float", "double"])
def test_near_rows_far_from_the_origin(spark, kind):
    """Single precision would lose these distances; the error margin has to notice."""
    rng = np.random.default_rng(6)
    vectors = np.concatenate([1000 + rng.integers(0, 9, (150, 4)) / 64, rng.normal(size=(150, 4)) * 1000, np.full((9, 4), 1000.0)])
    vectors = vectors.astype(np.float32 if kind == "float" else np.float64)
    ids, groups = [f"i{i:03d}" for i in range(len(vectors))], [f"g{i % 4}" for i in range(len(vectors))]
    rows = [(i, v.tolist(), g) for i, v, g in zip(ids, vectors, groups)]
    df = spark.createDataFrame(rows, f"candidate_id string, vector array<{kind}>, group_id string")
    got = {}
    for r in VectorIndex.fit(df, cells=5, block_rows=40).search(df, 6, id_col="candidate_id", broadcast_bytes=0).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["candidate_id"])
    assert got == brute(ids, vectors, groups, 6)


def test_shells_beyond_the_kth_distance_are_passed_by(spark, monkeypatch):
    """Once a query has met k near rows, blocks that cannot hold nearer ones are not compared with it."""
    rng = np.random.default_rng(8)
    vectors = np.concatenate([rng.normal(size=(400, 3)) * 0.1 + 10.0 * i for i in range(6)]).astype(np.float32)
    ids, groups = [f"i{i:04d}" for i in range(len(vectors))], [f"g{i % 3}" for i in range(len(vectors))]
    df = frame(spark, ids, vectors, groups).repartition(1)
    index = VectorIndex.fit(df, cells=12, probes=12, block_rows=20)  # too few probes for a bound that skips a cell
    got, seen, plain = {}, [], VectorIndex.search
    for r in plain(index, df, 15, id_col="candidate_id").orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["candidate_id"])
    assert got == brute(ids, vectors, groups, 15)

    near, far = (np.full((30, 3), x, np.float32) for x in (0.0, 9.0))
    names = {"part": 0, "visits": None, "grps": [None] * 30}
    rows = [{**names, "met": 0, "ids": [f"q{i}" for i in range(30)], "vecs": near.ravel(), "bounds": [np.inf] * 30, "cells": [0, 1], "shell": None}]
    rows += [{**names, "met": 1, "ids": [f"a{i}" for i in range(30)], "vecs": near.ravel(), "bounds": None, "cells": [0], "shell": [0.0, 0.0]}]
    rows += [{**names, "met": 2, "ids": [f"b{i}" for i in range(30)], "vecs": far.ravel(), "bounds": None, "cells": [1], "shell": [0.0, 0.0]}]
    import pyarrow as pa

    schema = pa.schema(
        [("part", pa.int32()), ("met", pa.int32()), ("ids", pa.list_(pa.string())), ("grps", pa.list_(pa.string())), ("vecs", pa.list_(pa.float32())),
         ("bounds", pa.list_(pa.float64())), ("visits", pa.list_(pa.list_(pa.int32()))), ("cells", pa.list_(pa.int32())), ("shell", pa.list_(pa.float64()))]
    )

    class Shared:
        value = {"vectors": np.stack([near[0], far[0]]), "cells": 2}

    meet = knn._Asked.meet
    monkeypatch.setattr(knn._Asked, "meet", lambda self, cell, *rest: (seen.append(cell), meet(self, cell, *rest))[1])
    run = knn._meet(3, np.float32, 5, True, np.zeros(3), Shared)
    out = pa.Table.from_batches(list(run(iter([pa.RecordBatch.from_pylist(rows, schema=schema)])))).to_pylist()
    assert seen == [0] and len(out) == 150 and {r["distance"] for r in out} == {0.0}


def test_routing_holds_few_queries_and_its_sample_grows(spark, monkeypatch):
    """A task holds distances from the probes for few queries at a time, so the probes may grow with the archive."""
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(400, 6)).astype(np.float32)
    ids, groups = [f"i{i:03d}" for i in range(400)], [f"g{i % 5}" for i in range(400)]
    df = frame(spark, ids, vectors, groups).repartition(1)
    monkeypatch.setattr(knn, "ROWS_PER_PROBE", 2)
    index = VectorIndex.fit(df, cells=3, probes=10, block_rows=64)
    assert len(index.probes.ids) == 200
    got = {}
    for r in index.search(df, 9, id_col="candidate_id").orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["candidate_id"])
    assert got == brute(ids, vectors, groups, 9)

    import pyarrow as pa

    class Shared:
        value = {"ids": index.probes.ids, "groups": index.probes.groups, "vectors": index.probes.vectors, "cells": 3, "radii": index.radii,
                 "k": 9, "exclude_self": True, "nprobe": None}

    monkeypatch.setattr(knn, "ROUTED_ROWS", 90)
    held, gram = [], knn._gram_distance
    monkeypatch.setattr(knn, "_gram_distance", lambda left, right: (held.append(len(left)), gram(left, right))[1])
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(groups), pa.array(vectors.tolist(), pa.list_(pa.float32()))], names=["id", "grp", "vec"])
    routed = pa.Table.from_batches(list(knn._route(Shared, 6, np.float32)(iter([batch])))).to_pylist()
    assert held == [90, 90, 90, 90, 40] and [r["id"] for r in routed] == ids
    kth = [np.sort(((vectors - v).astype(np.float64) ** 2).sum(axis=1)[[g != h for h in groups]])[8] for v, g in zip(vectors, groups)]
    assert all(r["bound"] ** 2 >= d for r, d in zip(routed, kth))


def test_few_queries_of_a_block_have_hits():
    """Queries whose least value is beyond their limit are not looked at again; the others lose nothing."""
    import pyarrow as pa

    rng = np.random.default_rng(10)
    queries, archive = rng.normal(size=(50, 4)), rng.normal(size=(300, 4))
    archive[7], archive[11] = queries[3] + 1e-3, queries[41] - 1e-3

    def row(name, values, groups):
        return {"ids": pa.array([f"{name}{i:03d}" for i in range(len(values))]), "grps": pa.array(groups), "vecs": pa.array(values.ravel()),
                "bounds": pa.array(np.full(len(values), 0.01)), "visits": None, "cells": pa.array([0], pa.int32())}

    codes: dict = {}
    asked = knn._Asked(row("q", queries, ["x"] * 10 + ["y"] * 40), 4, np.zeros(4), codes, 3, True)
    asked.meet(0, knn._Side(row("a", archive, ["x"] * 9 + ["z"] * 291), 4, np.zeros(4), codes))
    assert [(r["query_id"], r["candidate_id"]) for r in asked.best().to_pylist()] == [("q041", "a011")]  # a007 has the group of q003
