import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobar.catalog.tables import MODELS, ContextPriorModel
from isobar.operators.boosting import fit_ranker
from isobar.operators.ranker import MODEL_SPECS, lambda_gradients
from isobar.plans import audit, contract, offline, online
from isobar.plans.retrieval import RetrievalResult, run_retrieval
from isobar.sources import archive, candidates, sinks
from isobar.streaming.serving import serve

EDGES = "train_query string, candidate_id string, seed_weight double, weight double, edge_rows long"


def event(name, group, hour):
    t = np.datetime64("2020-01-01T00") + np.timedelta64(hour, "h")
    return (name, group, "weather", str(t), str(t + np.timedelta64(24, "h")))


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("archive")
    starts = np.datetime64("2020-01-01T00", "h") + np.arange(96).astype("timedelta64[h]")
    matrix = np.random.default_rng(5).normal(size=(96, 32)).astype(np.float32)
    archive.write_npy_archive(str(folder), matrix, starts, starts + np.timedelta64(24, "h"))
    schema = "candidate_id string, group_id string, event_type string, time_coverage_start string, time_coverage_end string"
    stored = [event("query", "storm-q", 0), event("a", "storm-a", 24), event("b", "storm-b", 30), event("c", "storm-c", 48),
              event("d", "storm-d", 72), event("twin", "storm-q", 60)]
    events = spark.createDataFrame(stored, schema)
    ranks = [("a", 1), ("b", 2), ("c", 3), ("d", 4), ("twin", 5), ("query", 6)]
    rows = spark.createDataFrame(ranks, "candidate_id string, rank int").withColumn("query_id", F.lit("query"))
    edges = spark.createDataFrame([], EDGES)
    return {
        "archive": archive.read_npy_archive(spark, str(folder), expected_dim=32),
        "queries": events.filter("candidate_id = 'query'").withColumnRenamed("candidate_id", "query_id"),
        "archive_events": events,
        "event_candidates": rows.withColumn("score_final", 1.0 / (F.col("rank") + 1)).withColumn("score_calibrated", 1.0 / (F.col("rank") + 2)),
        "metadata_candidates": rows.filter("rank in (3, 4)").withColumn("rank", F.col("rank") - 2),
        "anchors": rows.filter("rank <= 4"),
        "model": ContextPriorModel,
        "edges": edges,
        "manifest": contract.build_manifest(ContextPriorModel, edges),
        "fill": dict.fromkeys(contract.FEATURE_NAMES, 0.0),
        "candidate_limit": 5,
        "top_k": 3,
        "start_time_delta_hours": 12.0,
    }


def test_retrieval_end_to_end(spark, world):
    result = run_retrieval(**world)
    top = result.top_k.orderBy("rank").collect()
    # b starts six hours after a, d overlaps c in no way; twin shares the query's storm.
    assert [r["candidate_id"] for r in top] == ["a", "c", "d"] and [r["rank"] for r in top] == [1, 2, 3]
    assert top[1]["source_membership"] == ["event", "context", "metadata"]
    row = result.audit.first()
    record = json.loads(row["audit_json"])
    audit.validate_record(record)
    assert row["certified"]
    assert record["temporal_suppression"]["start_proximity_suppressed_candidate_ids"] == ["b"]
    removed = record["exclusions_and_deduplication"]
    assert removed["query_and_same_group_exclusion"] == {
        "query_event_excluded": True, "same_group_excluded": True, "excluded_candidate_ids": ["query", "twin"]
    }
    assert removed["pre_reranking_same_event_deduplication"] == {"removed_candidate_ids": []}
    assert removed["post_ranking_event_deduplication"]["applied"] is True and row["status"] == "ok"
    assert record["output"]["returned_count"] == 3 and record["context_stage"]["retrieved_count"] == 4
    for bad in ({"top_k": 0}, {"candidate_limit": 0}):
        with pytest.raises(ValueError):
            run_retrieval(**{**world, **bad})
    with pytest.raises(ValueError, match="rank or an ordinal"):
        run_retrieval(**{**world, "anchors": world["anchors"].drop("rank")})


def test_queries_without_candidates_or_anchors_are_told_apart(spark, world):
    # "lost" has anchors that are not in its pool; the anchors have their order only.
    asked = world["queries"].unionByName(world["queries"].withColumn("query_id", F.lit("lost")))
    more = {n: world[n].unionByName(world[n].withColumn("query_id", F.lit("lost"))) for n in ("event_candidates", "metadata_candidates")}
    anchors = world["anchors"].unionByName(
        world["anchors"].withColumn("query_id", F.lit("lost")).withColumn("candidate_id", F.lit("zz"))
    ).withColumnRenamed("rank", "ordinal")
    result = run_retrieval(**{**world, **more, "queries": asked, "anchors": anchors})
    assert {r["query_id"]: r["status"] for r in result.audit.collect()} == {"query": "ok", "lost": "no anchor left"}
    assert [r["candidate_id"] for r in result.top_k.orderBy("rank").collect()] == ["a", "c", "d"]


def test_serving_replaces_replayed_batches(spark, tmp_path):
    rows = spark.createDataFrame([("q1",), ("q2",)], "query_id string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))

    def retrieve(batch):
        return RetrievalResult(batch.withColumn("rank", F.lit(1)), batch, batch.withColumn("audit_json", F.lit("{}")))

    for attempt in ("a", "b"):
        run = serve(stream, retrieve, str(tmp_path / "out"), checkpoint=str(tmp_path / f"checkpoint-{attempt}"))
        run.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "top_k")).count() == 2
    assert spark.read.parquet(str(tmp_path / "out" / "audit")).count() == 2


def candidate_rows(spark, queries, seed):
    rng = np.random.default_rng(seed)
    names = ["score_final", "score_calibrated", "score_event_rank_prior", "score_context_rank_prior", "score_pool_rank_prior"]
    rows = []
    for q in queries:
        for c in range(30):
            good = bool(rng.random() < 0.3)
            rows.append((q, f"c{c}", good, float(rng.integers(1, 9)), c + 1.0, c + 2.0, c + 1.0, 1.0,
                         *[float(rng.random() + 0.5 * good) for _ in names]))
    schema = ("query_id string, candidate_id string, is_gt_top20 boolean, grade double, source_event_rank double, "
              "source_sequence_rank double, source_min_rank double, source_rank_gap double, " + ", ".join(f"{n} double" for n in names))
    return spark.createDataFrame(rows, schema).withColumn("rank", F.col("source_min_rank"))


def test_online_ranking_protects_anchors(spark):
    pool = candidate_rows(spark, ["q1", "q2"], 3)
    from isobar.operators.features import add_reciprocal_ranks

    pool = add_reciprocal_ranks(pool).drop("rank")
    edges = spark.createDataFrame([("t1", "c1", 1.5, 1.5, 1), ("t1", "c2", 1.0, 1.0, 1)], EDGES)
    anchors = spark.createDataFrame([(q, f"c{29 - r}", r) for q in ("q1", "q2") for r in range(1, 21)], "query_id string, candidate_id string, rank int")
    options = {"feature_columns": contract.FEATURE_NAMES, "fill": {}, "manifest": contract.build_manifest(ContextPriorModel, edges)}

    def lists(rows):
        ranked, receipt = online.rank_online(rows, anchors, ContextPriorModel, edges, **options)
        assert receipt["asset_binding_passed"]
        out = {}
        for r in ranked.orderBy("rank").collect():
            assert r["uses_test_for_tuning"] is False and r["graph_hash_match"]
            out.setdefault(r["query_id"], []).append(r["candidate_id"])
        return out

    first = lists(pool)
    second = lists(pool.withColumn("score_context_rank_prior", -F.col("score_context_rank_prior")))
    for q in ("q1", "q2"):
        assert len(set(first[q])) == 20 and first[q][:5] == second[q][:5] == [f"c{29 - r}" for r in range(1, 6)]
        assert first[q][5:] != second[q][5:]
    with pytest.raises(Exception, match="not in its pool"):
        missing = anchors.withColumn("candidate_id", F.when(F.col("rank") == 1, "zz").otherwise(F.col("candidate_id")))
        online.rank_online(pool, missing, ContextPriorModel, edges, strict=True, **options)[0].collect()


def test_matrix_predictors_run_on_arrow_batches(spark):
    class Doubler:
        def predict(self, matrix):
            return matrix[:, 0] * 2.0

    class Classifier:
        def predict_proba(self, matrix):
            return np.stack([1 - matrix[:, 0], matrix[:, 0]], axis=1)

    df = spark.createDataFrame([([0.25, 1.0],), ([0.5, 1.0],)], "features array<float>")
    assert [r["model_score"] for r in online.score_model(df, Doubler()).collect()] == [0.5, 1.0]
    assert [r["model_score"] for r in online.score_model(df, Classifier()).collect()] == [0.25, 0.5]


def test_lambda_gradients_push_relevant_rows_up():
    step, curve = lambda_gradients(np.array([0.0, 1.0, 0.5]), np.array([1.0, 0.0, 0.0]), 30)
    assert step[0] > 0 > step[1] and step.sum() == pytest.approx(0.0) and (curve > 0).all()
    assert not lambda_gradients(np.zeros(3), np.zeros(3), 30)[0].any()


def test_offline_search_and_files(spark, tmp_path):
    splits = {"train": ["t1", "t2", "t3"], "validation": ["v1", "v2"], "test": ["x1", "x2"]}
    paths = {}
    for i, (name, queries) in enumerate(splits.items()):
        rows = candidate_rows(spark, queries, i)
        paths[name] = str(tmp_path / name)
        sinks.write_csv(rows, paths[name])
    tables = {n: candidates.read_candidate_rows(spark, p) for n, p in paths.items()}
    assert dict(tables["train"].dtypes)["is_gt_top20"] == "boolean" and "rank_inv" in tables["train"].columns
    anchors = {n: tables[n].select("query_id", "candidate_id", F.col("rank").cast("int").alias("rank")) for n in ("validation", "test")}
    descriptor = spark.createDataFrame([(n, f"k-{n}", "2020-01-01", "2020-01-09") for n in ("x1", "x2", *[f"c{i}" for i in range(30)])],
                                       "event_id string, tc_id string, window_start string, window_end string")
    mapping = descriptor.select(F.col("tc_id").alias("tracklet_id"), F.col("event_id").alias("tc_id"))
    track = mapping.select("tc_id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("d")).select(
        "tc_id", F.concat(F.lit("2020-01-0"), F.col("d").cast("string")).alias("time_utc"), (F.col("d") * 3.0).alias("lat"),
        F.lit(110.0).alias("lon"), F.lit(990.0).alias("pres"), F.lit(20.0).alias("wnd"),
    )
    result = offline.run_offline(
        spark, **tables, validation_anchors=anchors["validation"], test_anchors=anchors["test"], output=str(tmp_path / "out"),
        models=dict(MODELS), descriptor=descriptor, mapping=mapping, best_track=track,
    )
    assert result.ledger.count() == 2 * 54 * 4 and result.selected["keep_top"] >= 1
    assert result.test_ranking.groupBy("query_id").count().filter("count = 20").count() == 2
    assert result.summary["track_rmse_km"] == pytest.approx(0.0) and result.summary["feature_count"] == 31
    for name in ("selected_summary.json", "asset_manifest.json", "feature_names.csv", "search_ledger", "progress/progress.json"):
        assert os.path.exists(tmp_path / "out" / name)
    events = [json.loads(r["value"])["stage"] for r in spark.read.text(str(tmp_path / "out" / "progress" / "events.jsonl")).collect()]
    assert sorted(events) == ["complete", "start"]


@pytest.mark.parametrize("position", [0, 1, 2])
def test_rankers_learn_the_relevant_rows(spark, position):
    rng = np.random.default_rng(1)
    rows = [(f"q{q}", f"c{c}", int(v > 0.7) * 3, [float(v), float(rng.random())]) for q in range(12) for c, v in enumerate(rng.random(25))]
    df = spark.createDataFrame(rows, "query_id string, candidate_id string, label int, features array<float>")
    spec = MODEL_SPECS[position]
    spec = type(spec)(**{**spec.__dict__, "min_child": 5, "feature_fraction": 1.0, "learning_rate": 0.3})
    names = ("score_context_rank_prior", "other")
    model = fit_ranker(df, names, spec, trees=2)
    scored = model.score(df).collect()
    good = [r["model_score"] for r in scored if r["label"]]
    bad = [r["model_score"] for r in scored if not r["label"]]
    assert min(good) > max(bad)
    splits, gain = model.importance("score_context_rank_prior")
    assert splits >= 1 and gain > 0 and len(model.sha256()) == 64 and model.input_dimension == 2
