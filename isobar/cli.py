"""Command line: development studies and the offline search."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from isobar.plans import offline, studies
from isobar.session import build_session
from isobar.sources import candidates, sinks


def parser() -> argparse.ArgumentParser:
    root = argparse.ArgumentParser(prog="isobar")
    commands = root.add_subparsers(dest="command", required=True)
    study = commands.add_parser("study", help="evaluate a development study")
    study.add_argument("study", choices=("portability", "matched-scoring", "physical-ablation", "evidence"))
    study.add_argument("--input", required=True)
    study.add_argument("--output", required=True)
    study.add_argument("--resamples", type=int, default=10_000)
    study.add_argument("--seed", type=int, default=20262202)
    study.add_argument("--control", help="control field (portability) or prefix (physical)")
    study.add_argument("--system", help="system field (portability) or prefix (physical)")
    study.add_argument("--backend", default="backend")
    study.add_argument("--full-system", default="full")
    study.add_argument("--layout", help="JSON with the verify_evidence file and column names")
    search = commands.add_parser("offline", help="train, select on validation and report test")
    for split in ("train", "validation", "test", "validation-anchors", "test-anchors"):
        search.add_argument(f"--{split}", required=True)
    search.add_argument("--descriptor")
    search.add_argument("--mapping")
    search.add_argument("--best-track")
    search.add_argument("--trees", type=int)
    search.add_argument("--output", required=True)
    return root


def run_study(spark, args) -> dict:
    common = {"resamples": args.resamples, "seed": args.seed}
    if args.study == "evidence":
        if not Path(args.input).is_dir():
            raise ValueError("evidence input must be a directory")
        layout = json.loads(Path(args.layout).read_text(encoding="utf-8"))
        return studies.verify_evidence(
            spark, args.input, **{k: tuple(v) if isinstance(v, list) else v for k, v in layout.items()}
        )
    if args.study == "portability":
        control, system = args.control or "control_scores", args.system or "system_scores"
        payload = studies.read_payload(spark, args.input, studies.portability_schema(control, system))
        return studies.evaluate_portability(payload, control=control, system=system, **common)
    if args.study == "matched-scoring":
        payload = studies.read_payload(spark, args.input, studies.matched_schema(args.backend, args.full_system))
        return studies.evaluate_matched_scoring(payload, backend=args.backend, full_system=args.full_system, **common)
    control, system = args.control or "baseline", args.system or "system"
    payload = studies.read_payload(spark, args.input, studies.physical_schema(control, system))
    return studies.evaluate_physical_ablation(payload, control=control, system=system, **common)


def run_offline(spark, args) -> dict:
    optional = {
        "descriptor": args.descriptor and candidates.read_descriptor(spark, args.descriptor),
        "mapping": args.mapping and candidates.read_mapping(spark, args.mapping),
        "best_track": args.best_track and candidates.read_best_track(spark, args.best_track),
    }
    return offline.run_offline(
        spark,
        **{s: candidates.read_candidate_rows(spark, getattr(args, s)) for s in ("train", "validation", "test")},
        validation_anchors=candidates.read_ranking(spark, args.validation_anchors),
        test_anchors=candidates.read_ranking(spark, args.test_anchors),
        output=args.output,
        trees=args.trees,
        **optional,
    ).summary


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = build_session()
    result = run_study(spark, args) if args.command == "study" else run_offline(spark, args)
    if args.command != "offline":
        sinks.write_json(result, args.output)
    print(json.dumps(result, indent=2, sort_keys=True, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
