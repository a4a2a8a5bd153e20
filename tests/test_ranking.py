import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobar.operators import blend, features, metrics
from isobar.operators.anchor import anchor_merge
from isobar.operators.fusion import enrich, excluded, fuse_candidate_channels
from isobar.operators.graph import add_graph_scores, heavy_keys, label_graph_edges, spread_join
from isobar.operators.ordering import ordinal
from isobar.plans import offline


def channel(spark, rows, columns="candidate_id string, rank int, distance double"):
    return spark.createDataFrame(rows, columns).withColumn("query_id", F.lit("q"))


def test_fusion_ranks_and_priors(spark):
    channels = {
        "event": channel(spark, [("a", 1, 0.1), ("b", 2, 0.2), ("b", 9, 0.9)]),
        "context": channel(spark, [("b", 1, 0.5), ("c", 2, 0.6)]).withColumn("event_type", F.lit("wind")),
        "metadata": channel(spark, [("c", 1, None)]),
    }
    got = {r["candidate_id"]: r for r in fuse_candidate_channels(channels, limit=3).collect()}
    assert [got[c]["pool_rank"] for c in "abc"] == [1, 2, 3]
    assert got["b"]["score_context_rank_prior"] == 0.5 and got["a"]["score_context_rank_prior"] == 0.2
    assert got["a"]["source_context_rank"] == 4 and got["b"]["source_event_rank"] == 2
    assert got["b"]["source_membership"] == ["event", "context"] and got["b"]["source_ranks"] == {"event": 2, "context": 1}
    assert got["c"]["source_distances"] == {"context": 0.6} and got["b"]["event_type"] == "wind"
    assert got["a"]["source_sequence_rank"] == 4 and got["a"]["source_rank_gap"] == 3
    assert got["a"]["source_provenance"]["event"] == "event_candidate_path"
    assert fuse_candidate_channels(channels, limit=2).count() == 2
    with pytest.raises(Exception, match="positive"):
        fuse_candidate_channels({"event": channel(spark, [("a", 0, 0.1)])}, limit=3).collect()


def test_rows_without_a_rank_take_their_place(spark):
    rows = [("a", 1, 0.1, 1), ("b", None, 0.2, 2), ("c", None, 0.3, 3), ("b", 1, 0.4, 4)]
    channels = {"event": channel(spark, rows, "candidate_id string, rank int, distance double, ordinal long")}
    got = {r["candidate_id"]: r for r in fuse_candidate_channels(channels, limit=5).collect()}
    assert {c: (r["pool_rank"], r["source_min_rank"], r["source_membership"]) for c, r in got.items()} == {
        "a": (1, 1, ["event"]), "b": (2, 2, ["event"]), "c": (3, 3, ["event"])
    }
    assert got["b"]["source_distances"] == {"event": 0.2}
    with pytest.raises(Exception, match="rank or ordinal"):
        fuse_candidate_channels({"event": channel(spark, [("a", None, 0.1)])}, limit=3).collect()


def test_enrichment_and_exclusion(spark):
    rows = spark.createDataFrame([("q", "a", None, "g"), ("q", "q", "x", "g"), ("q", "b", "mine", None)],
                                 "query_id string, candidate_id string, group_id string, query_group_id string")
    meta = spark.createDataFrame([("a", "g"), ("b", "other")], "candidate_id string, group_id string")
    merged = {r["candidate_id"]: r["group_id"] for r in enrich(rows, meta).collect()}
    assert merged == {"a": "g", "q": "x", "b": "mine"}
    over = {r["candidate_id"]: r["group_id"] for r in enrich(rows, meta, overwrite=True).collect()}
    assert over["b"] == "other"
    joined = enrich(rows, meta)
    flags = {r["candidate_id"]: r["out"] for r in joined.withColumn("out", excluded(joined)).collect()}
    assert flags == {"a": True, "q": True, "b": False}


def test_standardisation_forms_agree(spark):
    rnd = random.Random(1)
    rows = [("hot" if i % 3 == 0 else f"q{i % 4}", i, rnd.random() if i % 11 else None, 5.0) for i in range(200)]
    df = spark.createDataFrame(rows, "query_id string, i int, v double, flat double")
    joined = features.group_z(df, {"z": "v", "flat_z": "flat"}, ["query_id"])
    over = df.withColumn("w", features.column_z(df.columns, "v")).withColumn("none", features.column_z(df.columns, "gone"))
    a = {r["i"]: (r["z"], r["flat_z"]) for r in joined.collect()}
    b = {r["i"]: (r["w"], r["none"]) for r in over.collect()}
    for q in {r[0] for r in rows}:
        values = np.array([r[2] or 0.0 for r in rows if r[0] == q])
        expected = (values - values.mean()) / values.std()
        found = [a[r[1]][0] for r in rows if r[0] == q]
        np.testing.assert_allclose(found, expected, atol=1e-5)
    assert all(a[i][0] == pytest.approx(b[i][0], abs=1e-6) and a[i][1] == 0.0 == b[i][1] for i in a)


def test_labels_medians_and_matrix(spark):
    df = spark.createDataFrame(
        [(True, "12", 1.0), (True, None, None), (False, "3", float("inf")), (True, "2.9", 3.0)],
        "is_gt_top20 boolean, grade string, x double",
    )
    got = [(r["b"], r["g"]) for r in df.select(features.labels(df).alias("b"), features.labels(df, "graded").alias("g")).collect()]
    assert got == [(1, 10), (1, 1), (0, 0), (1, 2)]
    assert features.train_medians(df.filter("x < 100"), ["x"]) == {"x": 2.0}
    rows = [r["features"] for r in features.model_matrix(df, ["x"], {"x": 2.0}).collect()]
    assert rows == [[1.0], [2.0], [0.0], [3.0]]
    raw = [r["features"] for r in features.model_matrix(df, ["x"], {}, scrub_infinite=False).collect()]
    assert raw[2] == [math.inf]


def test_graph_scores_equal_a_plain_walk(spark):
    rnd = random.Random(4)
    train = [(f"t{q}", f"c{rnd.randrange(30)}", True, float(rnd.randrange(11))) for q in range(25) for _ in range(6)]
    train += [("t0", "c0", False, 9.0)]
    pool = [(f"q{q}", f"c{c}", rnd.random(), rnd.random()) for q in range(5) for c in rnd.sample(range(30), 20)]
    pool += [("lost", "nowhere", 0.5, 0.5)]
    edges = label_graph_edges(spark.createDataFrame(train, "query_id string, candidate_id string, is_gt_top20 boolean, grade double"))
    df = spark.createDataFrame(pool, "query_id string, candidate_id string, score_final double, source_min_rank_inv_safe double")
    configs = (("narrow", 3, 4), ("wide", 8, 100))
    got = {(r["query_id"], r["candidate_id"]): r for r in add_graph_scores(df, edges, configs=configs).collect()}
    top = max(max(g for _, _, p, g in train if p), 1.0)
    by_seed, best = {}, {}
    for q, c, p, g in train:
        if p:
            by_seed.setdefault(c, []).append((q, 1 + g / top))
            best.setdefault(q, {})
            best[q][c] = max(best[q].get(c, 0.0), 1 + g / top)
    z = lambda v: (np.array(v) - np.mean(v)) / (np.std(v) or 1.0)
    for query in sorted({p[0] for p in pool}):
        rows = [p for p in pool if p[0] == query]
        score = 0.7 * z([r[2] for r in rows]) + 0.3 * z([r[3] for r in rows])
        order = [rows[i][1] for i in np.argsort(-score, kind="stable")]
        for name, k, cap in configs:
            active, first = {}, {}
            for place, seed in enumerate(order[:k], 1):
                for t, w in by_seed.get(seed, []):
                    active[t] = active.get(t, 0.0) + w / place
                    first.setdefault(t, place)
            kept = sorted(active, key=lambda t: (-active[t], first[t], t))[:cap]
            norm = 1e-6 + sum(active[t] for t in kept)
            for r in rows:
                expected = sum(active[t] * best[t].get(r[1], 0.0) for t in kept) / norm
                assert got[(query, r[1])][name] == pytest.approx(expected, rel=1e-5, abs=1e-7)


def test_one_candidate_that_is_a_seed_of_all_queries_is_split(spark):
    """Candidate c0 tops every pool and is relevant to every train query; c1 to c9 have one edge each."""
    pool = spark.range(400).select(F.format_string("q%d", "id").alias("query_id"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("c")).select(
        "query_id", F.format_string("c%d", "c").alias("candidate_id"), (1.0 / (1 + F.col("c"))).alias("score_final"),
        F.lit(0.0).alias("source_min_rank_inv_safe"),
    )
    train = spark.range(60).select(F.format_string("t%d", "id").alias("query_id"), F.explode(F.array(F.lit("c0"), F.format_string("c%d", F.col("id") % 10))).alias("candidate_id"), F.lit(True).alias("is_gt_top20"))
    edges = label_graph_edges(train)
    heavy = {r["candidate_id"]: r["salts"] for r in heavy_keys(pool, edges, "candidate_id", 5_000).collect()}
    assert heavy == {"c0": 5}  # 400 pool rows times 60 edges, in parts of 5,000
    joined = spread_join(pool, edges, "candidate_id", "query_id", heavy_rows=5_000)
    assert joined.count() == pool.join(edges, "candidate_id").count()
    dealt = pool.filter("candidate_id = 'c0'").groupBy(F.pmod(F.xxhash64("query_id"), F.lit(5))).count().collect()
    assert len(dealt) == 5 and max(r["count"] for r in dealt) * 60 < 2 * 5_000
    configs = (("g", 4, 30),)
    plain = {(r["query_id"], r["candidate_id"]): r["g"] for r in add_graph_scores(pool, edges, configs=configs).collect()}
    split = {(r["query_id"], r["candidate_id"]): r["g"] for r in add_graph_scores(pool, edges, configs=configs, heavy_rows=500).collect()}
    assert len(plain) == 2_400 and set(plain) == set(split)
    assert all(split[k] == pytest.approx(v, rel=1e-6) for k, v in plain.items())


def test_profile_grid_counts():
    assert len(blend.profile_grid()) == 54 and len(blend.profile_grid(exact=True)) == 59
    assert blend.FROZEN_BLEND.name in {b.name for b in blend.profile_grid()}


def brute_merge(anchors, proposal, keep, tail):
    out = list(dict.fromkeys(anchors[:keep]))
    for c in proposal:
        if len(out) >= max(tail - 1, keep):
            break
        if c not in out:
            out.append(c)
    for c in (anchors if tail <= 20 else []) + proposal:
        if c not in out:
            out.append(c)
    return out[:20]


@pytest.mark.parametrize("keep,tail", [(0, 21), (5, 21), (3, 11), (0, 6), (25, 21)])
def test_anchor_merge(spark, keep, tail):
    rnd = random.Random(keep * 31 + tail)
    ids = [f"c{i}" for i in range(40)]
    lists = {q: (rnd.sample(ids, 20), rnd.sample(ids, 20)) for q in ("p", "q")}
    lists["short"] = (["c1", "c2"], ["c2", "c3", "c4"])
    lists["no_anchor"] = ([], ["c9", "c8"])
    rows = lambda i: [(q, c, r) for q, both in lists.items() for r, c in enumerate(both[i], 1)]
    schema = "query_id string, candidate_id string, rank int"
    anchors = spark.createDataFrame([*rows(0), ("only_anchor", "c1", 1)], schema)
    merged = anchor_merge(anchors, spark.createDataFrame(rows(1), schema), keep_top=keep, tail_from=tail)
    got = {}
    for r in merged.orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["candidate_id"])
        known = r["candidate_id"] in lists[r["query_id"]][0]
        source = "retained_head" if r["rank"] <= keep and known else "retained_tail" if r["rank"] >= tail and known else "proposal"
        assert r["anchor_source"] == source
    assert got == {q: brute_merge(a, p, keep, tail) for q, (a, p) in lists.items()}


def reference_metrics(ranked, relevant):
    hits = [c in relevant for c in ranked]
    gains = sum(h / math.log2(i + 2) for i, h in enumerate(hits[:10]))
    ideal = sum(1 / math.log2(i + 2) for i in range(min(10, len(relevant))))
    ap = sum(sum(hits[: i + 1]) / (i + 1) for i in range(min(10, len(hits))) if hits[i]) / min(10, len(relevant))
    return (len(set(ranked[:10]) & relevant) / len(relevant), len(set(ranked[:20]) & relevant) / len(relevant), gains / ideal, ap)


def test_metrics_both_forms(spark):
    rnd = random.Random(9)
    ids = [f"c{i}" for i in range(50)]
    lists = {f"q{i}": (rnd.sample(ids, 20), set(rnd.sample(ids, rnd.randrange(1, 25)))) for i in range(6)}
    ranked = spark.createDataFrame([(q, c, r) for q, (cs, _) in lists.items() for r, c in enumerate(cs, 1)] + [("none", "c1", 1)],
                                   "query_id string, candidate_id string, rank int")
    relevant = spark.createDataFrame([(q, c) for q, (_, rel) in lists.items() for c in rel], "query_id string, candidate_id string")
    got = {r["query_id"]: r for r in metrics.query_metrics(ranked, relevant).collect()}
    assert set(got) == set(lists)
    arrays = spark.createDataFrame([(q, cs, sorted(rel)) for q, (cs, rel) in lists.items()], "q string, ids array<string>, rel array<string>")
    hits = F.transform("ids", lambda c: F.array_contains("rel", c))
    other = arrays.select("q", *[c.alias(n) for n, c in metrics.hit_metrics(hits, F.size("rel")).items()])
    other = {r["q"]: r for r in other.collect()}
    for q, (cs, rel) in lists.items():
        for name, value in zip(metrics.METRICS, reference_metrics(cs, rel), strict=True):
            assert got[q][name] == pytest.approx(value) and other[q][name] == pytest.approx(value)
    macro = metrics.macro_metrics(metrics.query_metrics(ranked, relevant)).withColumn("c", metrics.composite()).first()
    weights = {"ndcg_at_10": 0.3, "map_at_10": 0.3, "recall_at_20": 0.25, "recall_at_10": 0.1}
    assert macro["c"] == pytest.approx(sum(w * macro[m] for m, w in weights.items())) and macro["query_count"] == 6
    with pytest.raises(ValueError):
        metrics.query_metrics(ranked, relevant, denominator="other")


def test_continuous_ndcg_ties_and_zero(spark):
    rows = [("a", 0, 1.0, 0.5), ("a", 1, 1.0, 2.0), ("a", 2, 0.0, 1.0), ("z", 0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "query_id string, position int, score double, relevance double")
    got = {r["query_id"]: r["ndcg"] for r in metrics.continuous_ndcg(df, k=2).collect()}
    gain = lambda g, i: (2**g - 1) / math.log2(i + 2)
    assert got["a"] == pytest.approx((gain(0.5, 0) + gain(2.0, 1)) / (gain(2.0, 0) + gain(1.0, 1))) and got["z"] == 0.0
    with pytest.raises(ValueError):
        metrics.continuous_ndcg(df, k=0)


def test_ledger_equals_merging_each_profile(spark):
    rnd = random.Random(2)
    rows = [(f"q{q}", f"c{c}", *[rnd.random() for _ in range(6)], rnd.random() < 0.3) for q in range(4) for c in range(30)]
    df = spark.createDataFrame(
        rows,
        "query_id string, candidate_id string, score_final double, score_calibrated double, graph_max_z double, "
        "source_min_rank_inv_safe double, m1 double, m2 double, is_gt_top20 boolean",
    )
    anchors = spark.createDataFrame(
        [(f"q{q}", f"c{c}", r) for q in range(3) for r, c in enumerate(rnd.sample(range(40), 8), 1)],
        "query_id string, candidate_id string, rank int",
    )
    relevant = metrics.relevance_pairs(df)
    blends = blend.profile_grid()[:3]
    got = {r["profile"]: r for r in offline.ledger(df, anchors, relevant, models={"x": "m1", "y": "m2"}, blends=blends).collect()}
    assert len(got) == 2 * 3 * 4
    for name, column in (("x", "m1"), ("y", "m2")):
        for b in blends:
            scored = blend.score_terms(df, column).withColumn("score", blend.blend_score(b))
            for keep in (0, 5):
                merged = anchor_merge(anchors, blend.rank_proposals(scored), keep_top=keep)
                row = metrics.macro_metrics(metrics.query_metrics(merged, relevant)).first()
                for m in metrics.METRICS:
                    assert got[f"{name}|{b.name}|anchor_keep{keep}"][m] == pytest.approx(row[m])
    table = offline.ledger(df, anchors, relevant, models={"x": "m1"}, blends=blends)
    chosen = offline.select_profile(table).first()
    best = max((r for r in table.collect() if r["keep_top"] >= 1), key=lambda r: (r["recall_at_20"], r["composite"], r["map_at_10"]))
    assert not chosen["passes_floors"] and chosen["recall_at_20"] == best["recall_at_20"]
    assert offline.select_profile(table, floors={"recall_at_20": 0.0}).first()["passes_floors"]


def test_ledger_of_wide_pools_is_exact(spark):
    """50,000 rows in one pool, ties included, and a narrow pool beside it; chunks of any size agree."""
    wide = spark.range(50_000).select(
        F.lit("wide").alias("query_id"), F.format_string("c%05d", "id").alias("candidate_id"),
        # 977 is prime to 5,000: every score occurs ten times.
        (F.pmod(F.col("id") * 977, F.lit(5_000)) / 5_000).alias("m1"), (F.pmod("id", F.lit(3)) == 0).alias("is_gt_top20"),
    )
    narrow = wide.filter("candidate_id < 'c00030'").withColumn("query_id", F.lit("narrow"))
    df = wide.unionByName(narrow).withColumns(
        {n: F.lit(0.0) for n in ("score_final", "score_calibrated", "graph_max_z", "source_min_rank_inv_safe")}
    )
    anchors = spark.createDataFrame([("wide", "c00003", 1), ("wide", "c00004", 2)], "query_id string, candidate_id string, rank int")
    relevant = metrics.relevance_pairs(df)
    blends = blend.profile_grid()[:2]
    table = offline.ledger(df, anchors, relevant, models={"x": "m1"}, blends=blends, keeps=(0, 1))
    small = offline.ledger(df, anchors, relevant, models={"x": "m1"}, blends=blends, keeps=(0, 1), chunk_rows=17)
    got = {r["profile"]: r for r in table.collect()}
    assert len(got) == 4 and got == {r["profile"]: r for r in small.collect()}
    per_query = []
    for size in (50_000, 30):
        order = sorted(range(size), key=lambda i: (-(i * 977 % 5_000), i))[:20]
        per_query.append(reference_metrics(order, {i for i in range(size) if i % 3 == 0}))
    row = got[f"x|{blends[0].name}|anchor_keep0"]
    for name, values in zip(metrics.METRICS, zip(*per_query, strict=True), strict=True):
        assert row[name] == pytest.approx(sum(values) / 2)


def test_gates_never_pass_without_physical_errors(spark):
    row = {m: 1.0 for m in metrics.METRICS} | {"track_rmse_km": None, "landfall_dist_km": 1.0}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} double" for c in row))
    got = df.select(*[c.alias(n) for n, c in metrics.promotion_gates().items()]).first()
    assert not got["strict_promotion_pass"] and not got["hard_target_pass"]
    got = df.na.fill(0.0).select(*[c.alias(n) for n, c in metrics.promotion_gates().items()]).first()
    assert got["strict_promotion_pass"] and got["hard_target_pass"]


def test_ordinal_equals_row_number(spark):
    # All of the hot key's values lie close together, and a null key is a key.
    rows = [("hot" if i % 3 else ("cold" if i % 2 else None), (i * 7919) % 1000 + (0 if i % 3 else i * 10**6)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(4)
    got = ordinal(df, ["k"], ["v"], name="n", total="t").collect()
    for key in ("hot", "cold", None):
        values = sorted(v for k, v in rows if k == key)
        mine = sorted((r["n"], r["v"], r["t"]) for r in got if r["k"] == key)
        assert mine == [(i, v, len(values)) for i, v in enumerate(values, 1)]
