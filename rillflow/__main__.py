"""Command line: ``python -m rillflow COMMAND BASELINE SCENARIOS OUT`` over CSV readings.

``detect`` writes incidents, ``events`` absolute residual events, ``evaluate`` the scores against ``--manifest``; ``packets``, ``diagnose`` and ``replay`` (as known at each
hour) need the building of ``--layout``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rillflow.functions.lineage import cut
from rillflow.operators import building, day, detect, evaluate, tabular
from rillflow.plans import study
from rillflow.schemas import THRESHOLDS
from rillflow.sources import tables

# Absolute and relative noise by parameter (m, m3/s) of a town's instruments.
NOISE = {"pressure": (0.30, 0.0), "flowrate": (0.001, 0.01), "demand": (0.0005, 0.01)}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="rillflow")
    p.add_argument("command", choices=("detect", "events", "evaluate", "packets", "diagnose", "replay"))
    for name in ("baseline", "scenarios", "out"):
        p.add_argument(name)
    p.add_argument("--detector", choices=sorted(detect.DETECTORS), default="residual")
    p.add_argument("--threshold", type=float, default=4.0)
    p.add_argument("--min-assets", type=int, default=3)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--noise-scale", type=float, default=1.0)
    p.add_argument("--no-noise", action="store_true")
    p.add_argument("--instruments", choices=("town", "building"), default="town")
    p.add_argument("--max-gap", type=int, default=3600)
    p.add_argument("--manifest")
    p.add_argument("--layout")
    p.add_argument("--every", type=int, default=3600, help="seconds between the steps of a replay")
    a = p.parse_args(argv)
    for command, flag in (("evaluate", "manifest"), ("packets", "layout"), ("diagnose", "layout"), ("replay", "layout")):
        if a.command == command and not getattr(a, flag):
            p.error(f"{command} needs --{flag}")
    spark = SparkSession.builder.appName("rillflow").getOrCreate()
    base, rows = tables.read_baseline(spark, a.baseline), tables.read_scenarios(spark, a.scenarios)
    spec = {k: (x * a.noise_scale, y * a.noise_scale) for k, (x, y) in (NOISE if a.instruments == "town" else day.BUILDING_NOISE).items()}
    expected = base.withColumn("truth", F.col("value"))
    if a.command == "detect":
        seen = detect.observe(rows.unionByName(base), spec, seed=a.seed, noise=not a.no_noise)  # the baseline is the negative control
        summary, found = study.batch_report(seen, expected, a.detector, a.threshold, a.min_assets)
        tables.write_report(summary.withColumn("top_candidates", F.array_join("top_candidates", "|")), f"{a.out}/summary", "scenario")
        found.write.mode("overwrite").json(f"{a.out}/incidents")
    elif a.command == "evaluate":
        seen = detect.observe(rows.unionByName(base), spec, seed=a.seed, noise=not a.no_noise)
        scored, control = study.evaluation(seen, expected, tables.read_manifest(spark, a.manifest), a.detector, a.threshold, a.min_assets)
        tables.write_report(scored, f"{a.out}/evaluation", "scenario")
        summary = cut(evaluate.overall(scored, control))
        summary.coalesce(1).write.mode("overwrite").json(f"{a.out}/summary")
        tables.write_report(evaluate.overall(scored, control, by="fault_type"), f"{a.out}/fault_types", "fault_type")
        evaluate.report_text(summary).coalesce(1).write.mode("overwrite").text(f"{a.out}/report")
    elif a.command in ("packets", "diagnose", "replay"):
        house = building.read_layout(spark, a.layout)
        seen = day.building_observed(rows, house, a.seed, not a.no_noise)
        limits = {"threshold": a.threshold, "min_assets": a.min_assets}
        found = day.run_live(seen, expected, house, a.every, **limits) if a.command == "replay" else day.run(seen, expected, house, **limits)
        if a.command == "packets":
            found = found.drop("diagnosis", "grounded")
        found.write.mode("overwrite").partitionBy("scenario").json(f"{a.out}/{a.command}")
    else:
        aligned = tabular.align(base.drop("scenario", "state"), rows)
        detected = tabular.classify(tabular.residuals(aligned), THRESHOLDS)
        tables.write_report(tabular.events(detected, a.max_gap), f"{a.out}/events", "scenario", "event_number")
        tables.write_report(tabular.point_summary(detected), f"{a.out}/summary", "scenario")


if __name__ == "__main__":
    main()
