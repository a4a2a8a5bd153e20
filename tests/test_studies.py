import copy
import json
import random

import pytest

from isobar import cli
from isobar.plans import studies

FOLDS = [
    {"fold": f"f{i}", "train_end": f"200{i}-01-01", "evaluation_start": f"200{i}-02-01T00:00:00Z", "evaluation_end": f"200{i}-12-31"}
    for i in range(3)
]


def portability():
    rnd = random.Random(1)
    queries = [
        {
            "query_id": f"q{i}", "fold": f"f{i % 3}", "timestamp": f"200{i % 3}-06-01T00:00:00Z",
            "continuous_relevance": [1.0, 0.5, 0.0],
            "seed_scores": [
                {"seed": s, "control_scores": [rnd.random() for _ in range(3)], "system_scores": [3.0, 2.0, 1.0]} for s in range(5)
            ],
        }
        for i in range(6)
    ]
    return {
        "study_scope": "development", "formal_test_opened": False, "scores_sealed_before_relevance": True,
        "input_and_evaluation_annotations_disjoint": True, "object_count": 18, "model_seed_count": 5,
        "temporal_folds": FOLDS, "queries": queries,
    }


def matched():
    ids = [f"c{i}" for i in range(1000)]
    queries = [
        {
            "query_id": f"q{q}", "ground_truth_ids": ids[:20],
            "sealed_scores": [{"candidate_id": c, "score": float(-i)} for i, c in enumerate(ids)],
            "systems": {"backend": ids[10:200], "full": ids},
        }
        for q in range(2)
    ]
    return {"study_scope": "development", "scorer_sealed_before_labels": True, "scorer_seal": "s", "full_pool_size": 1000, "queries": queries}


def physical():
    queries = [
        {
            "query_id": f"q{i}", "fold": f"f{i % 3}", "timestamp": f"200{i % 3}-03-01", "baseline_ndcg10": 0.2 + i / 100,
            "system_ndcg10": 0.3 + i / 100, "baseline_top1_track_error_km": 900.0, "system_top1_track_error_km": 400.0,
        }
        for i in range(6)
    ]
    return {"study_scope": "development", "temporal_folds": FOLDS, "queries": queries}


def run(spark, kind, payload):
    schema, evaluate = {
        "portability": (studies.portability_schema(), studies.evaluate_portability),
        "matched": (studies.matched_schema(), studies.evaluate_matched_scoring),
        "physical": (studies.physical_schema(), studies.evaluate_physical_ablation),
    }[kind]
    return evaluate(studies.payload_frame(spark, payload, schema), resamples=200, seed=3)


def changed(payload, path, value):
    out = copy.deepcopy(payload)
    spot = out
    for key in path[:-1]:
        spot = spot[key]
    spot[path[-1]] = value
    return out


def test_portability(spark):
    result = run(spark, "portability", portability())
    assert result["system_mean"] == pytest.approx(1.0) and result["all_temporal_folds_positive"]
    assert result["query_count"] == 6 and set(result["fold_deltas"]) == {"f0", "f1", "f2"}
    for path, value, message in (
        (["study_scope"], "final", "development"),
        (["formal_test_opened"], True, "opened"),
        (["temporal_folds", 0, "train_end"], "2000-03-01", "strictly after"),
        (["queries", 1, "query_id"], "q0", "unique"),
        (["queries", 0, "timestamp"], "2005-01-01", "outside"),
        (["queries", 0, "seed_scores", 1, "seed"], 0, "unique per query"),
        (["queries", 0, "continuous_relevance"], [1.0, -0.5, 0.0], "not negative"),
        (["queries", 0, "seed_scores", 0, "control_scores"], [1.0], "aligned"),
    ):
        with pytest.raises(ValueError, match=message):
            run(spark, "portability", changed(portability(), path, value))


def test_matched_scoring(spark):
    result = run(spark, "matched", matched())
    assert result["full_system_mean"] == pytest.approx(1.0) and result["full_system_relevant_at_20"] == 20.0
    assert result["backend_relevant_at_20"] == 10.0 and result["backend_mean"] == pytest.approx(1.0)
    for path, value, message in (
        (["queries", 0, "ground_truth_ids"], ["c1"], "20 distinct"),
        (["queries", 0, "systems", "backend"], ["zz"], "part of the full"),
        (["scorer_seal"], " ", "seal"),
        (["full_pool_size"], 5, "1000"),
        (["queries", 0, "sealed_scores", 0, "candidate_id"], "c1", "unique"),
    ):
        with pytest.raises(ValueError, match=message):
            run(spark, "matched", changed(matched(), path, value))


def test_physical_and_command_line(spark, tmp_path):
    result = run(spark, "physical", physical())
    assert result["top1_track_rmse_reduction_km"] == 500.0
    assert result["paired_bootstrap"]["estimate"] == pytest.approx(0.1)
    with pytest.raises(ValueError, match="exceed one"):
        run(spark, "physical", changed(physical(), ["queries", 0, "system_ndcg10"], 1.5))
    (tmp_path / "in.json").write_text(json.dumps(physical(), indent=1))
    out = tmp_path / "deep" / "out.json"
    assert cli.main(["study", "physical-ablation", "--input", str(tmp_path / "in.json"), "--output", str(out), "--resamples", "200", "--seed", "3"]) == 0
    assert json.loads(out.read_text())["paired_bootstrap"] == result["paired_bootstrap"]


def test_evidence_directory(spark, tmp_path):
    lines = ["query_id,fold,c,s"] + [f"q{i},f{i % 3},{0.1 * i},{0.1 * i + 0.2}" for i in range(9)]
    (tmp_path / "port_per_query.csv").write_text("\n".join(lines))
    (tmp_path / "match_per_query.csv").write_text("query_id,c,s,cn,sn\nq1,0.1,0.3,2,5\nq2,0.2,0.2,4,6\n")
    (tmp_path / "phys_per_query.csv").write_text("query_id,fold,c,s,ce,se\nq1,f,0.1,0.3,900,300\nq2,g,0.2,0.1,800,400\n")
    base = {"bootstrap_resamples": 300, "bootstrap_seed": 1}
    (tmp_path / "port_metadata.json").write_text(json.dumps({**base, "query_count": 9, "object_count": 3, "model_seed_count": 2}))
    (tmp_path / "match_metadata.json").write_text(json.dumps({**base, "query_count": 2, "full_pool_size": 1000}))
    (tmp_path / "phys_metadata.json").write_text(json.dumps({**base, "query_count": 2}))
    (tmp_path / "seeds.json").write_text(json.dumps({"seed_values": {"1": 0.5, "2": 0.7}}))
    (tmp_path / "div.csv").write_text("task,ratio\n" + "".join(f"x{i},{i}\n" for i in range(1500)))
    (tmp_path / "audit.json").write_text("{}")
    layout = {
        "portability": ["port", "c", "s"], "matched": ["match", "c", "s", "cn", "sn"],
        "physical": ["phys", "c", "s", "ce", "se"], "seeds": "seeds.json", "diversity": "div.csv", "audit": "audit.json",
    }
    result = studies.verify_evidence(spark, tmp_path, **{k: tuple(v) if isinstance(v, list) else v for k, v in layout.items()})
    assert result["portability"]["gain"] == pytest.approx(0.2) and result["portability"]["seed_sd"] == pytest.approx(0.1)
    assert result["candidate_diversity"] == {"row_count": 1500, "ratio_mean": 749.5, "ratio_min": 0, "ratio_max": 1499}
    assert result["matched_scoring"]["system_relevant_at20"] == 5.5
    assert result["physical_ablation"]["track_rmse_reduction_km"] == 500.0
    assert not result["physical_ablation"]["all_temporal_folds_positive"]
    (tmp_path / "phys_metadata.json").write_text(json.dumps({**base, "query_count": 3}))
    with pytest.raises(ValueError, match="differs"):
        studies.verify_evidence(spark, tmp_path, **{k: tuple(v) if isinstance(v, list) else v for k, v in layout.items()})
