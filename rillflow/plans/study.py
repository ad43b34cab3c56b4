"""Whole-batch reports: detection over many scenarios, repeated-seed studies over sensor layouts, generated-batch checks, matrix counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.functions.columns import state_at
from rillflow.functions.lineage import cut
from rillflow.operators import detect, evaluate

SEP = "\x1f"


def batch_report(observed: DataFrame, baseline: DataFrame, detector: str = "residual", threshold: float = 4.0, min_assets: int = 2, top: int = 5) -> tuple[DataFrame, DataFrame]:
    """(summary by scenario, incidents). Give the baseline's own observation as one more scenario for a negative control."""
    flagged, found = detect.detect(observed, baseline, detector, threshold, min_assets)
    first = found.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("incident_count"), F.min("detected_at_s").alias("first_detection_s"), F.min_by("epicenter", "incident_no").alias("epicenter"),
        F.min_by(F.transform(F.slice("candidates", 1, top), lambda c: c["asset_id"]), "incident_no").alias("top_candidates"))
    every = observed.select("scenario").distinct()
    out = every.join(detect.report(flagged), "scenario", "left").join(first, "scenario", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("event_count", "incident_count")}), found


def evaluation(observed: DataFrame, baseline: DataFrame, manifest: DataFrame, detector: str = "residual", threshold: float = 4.0, min_assets: int = 2,
               ks: Sequence[int] = (1, 3, 5, 10)) -> tuple[DataFrame, DataFrame]:
    """(a row for each scenario of the manifest that was observed, the step scores of the ``normal`` control) for ``evaluate.overall``.

    Localisation is scored on the incident that overlaps the fault, else the first. Without an incident all ranks are null.
    """
    _, found = detect.detect(observed, baseline, detector, threshold, min_assets)
    found = cut(found)
    steps = cut(evaluate.step_scores(observed, found))
    hour = [(F.col(c) * 3600).cast("long").alias(n) for c, n in (("start_hour", "begin_s"), ("end_hour", "end_s"))]
    first = cut(evaluate.scored_incident(found, manifest.select("scenario", *hour)))
    ranked = first.select("scenario", F.explode("candidates").alias("c")).select("scenario", "c.position", "c.asset_id")
    hits = evaluate.hits_at(ranked, manifest.select("scenario", F.col("target_id").alias("asset_id")), ks)
    number = found.groupBy("scenario").agg(F.count(F.lit(1)).alias("incident_count"))
    about = first.select("scenario", "epicenter", F.size("candidates").alias("candidate_count"))
    rows = steps.join(manifest.select("scenario", "fault_type", "target_id", "severity"), "scenario").join(hits, "scenario").join(number, "scenario", "left").join(about, "scenario", "left")
    rows = rows.withColumn("incident_count", F.coalesce("incident_count", F.lit(0)))
    control = steps.where("scenario = 'normal'").join(number, "scenario", "left").withColumn("fired", F.col("incident_count").isNotNull())
    return cut(rows.withColumn("detected", F.col("incident_count") > 0)), control


def replicated(readings: DataFrame, layouts: Mapping[str, DataFrame], seeds: Sequence[int]) -> DataFrame:
    """Readings once for each layout that covers them and each seed; the scenario's name carries both, so all runs are one job."""
    tables = [s.select("asset_id", "parameter").distinct().withColumn("layout", F.lit(name)) for name, s in layouts.items()]
    cover = tables[0]
    for t in tables[1:]:
        cover = cover.union(t)
    rows = readings.join(cover, ["asset_id", "parameter"]).withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    return rows.withColumn("scenario", F.concat_ws(SEP, "layout", F.col("seed").cast("string"), "scenario"))


def seed_study(readings: DataFrame, baseline: DataFrame, truth: DataFrame, layouts: Mapping[str, DataFrame], seeds: Sequence[int], noise: Mapping[str, tuple[float, float]],
               threshold: float = 4.0, min_assets: int = 2) -> tuple[DataFrame, DataFrame]:
    """(runs by layout, seed and scenario; layouts with mean rates and their deviation over the seeds); truth(scenario, target_id).

    ``normal`` scenarios are controls: their incidents are false alarms.
    """
    rows = replicated(readings, layouts, seeds)
    seen = detect.observe(rows, noise, seed=F.col("seed"))
    expected = baseline.select("timestamp_s", "asset_id", "parameter", "value")
    scored = detect.residual_scores(seen, expected)
    flagged = detect.flag(scored, threshold)
    ranks = detect.candidates(detect.members(seen, flagged, min_assets)).where("incident_no = 1")
    part = F.split("scenario", SEP)
    keys = [part[0].alias("layout"), part[1].cast("int").alias("seed"), part[2].alias("scenario")]
    found = ranks.select(*keys, "position", "asset_id").join(truth, "scenario", "left").groupBy("layout", "seed", "scenario").agg(
        F.lit(True).alias("fired"), F.min(F.when(F.col("asset_id") == F.col("target_id"), F.col("position"))).alias("rank"))
    every = rows.select("scenario").distinct().select(*keys)
    runs = every.join(found, ["layout", "seed", "scenario"], "left").withColumn("fired", F.coalesce("fired", F.lit(False)))
    fault = F.col("scenario") != "normal"
    by_seed = runs.groupBy("layout", "seed").agg(
        F.try_divide(F.count_if(fault & F.col("fired")), F.count_if(fault)).alias("detected"), F.try_divide(F.count_if(fault & (F.col("rank") <= 3)), F.count_if(fault)).alias("hit_at_3"),
        F.count_if(~fault & F.col("fired")).alias("false_alarms"))
    table = by_seed.groupBy("layout").agg(
        F.count(F.lit(1)).alias("seeds"), F.avg("detected").alias("detected"), F.stddev_pop("detected").alias("detected_sd"), F.avg("hit_at_3").alias("hit_at_3"),
        F.stddev_pop("hit_at_3").alias("hit_at_3_sd"), F.sum("false_alarms").alias("false_alarms"))
    return runs, table


def matrix_counts(matrix: DataFrame, config: str) -> DataFrame:
    """Scenarios by kind of fault, and all, of one configuration's matrix."""
    return evaluate.all_and_each(matrix, "fault_type", scenarios=F.count(F.lit(1)), targets=F.count_distinct("target_id")).withColumn("config", F.lit(config))


def batch_problems(readings: DataFrame, manifest: DataFrame, rows: int, last_s: int, step_s: int) -> DataFrame:
    """What is wrong with generated scenarios, a row for each: missing, of another size, with missing steps, or with states that don't fit the window."""
    windows = manifest.select("scenario", (F.col("start_hour") * 3600).cast("long").alias("a"), (F.col("end_hour") * 3600).cast("long").alias("b"))
    joined = readings.join(windows, "scenario")
    own = joined.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col("timestamp_s") % step_s == 0, F.col("timestamp_s"))).alias("steps"), F.max("timestamp_s").alias("last"),
        F.count_if(F.col("state") != state_at(F.col("timestamp_s"), F.col("a"), F.col("b"))).alias("wrong"))
    out = windows.select("scenario").join(own, "scenario", "left")
    found = F.array_compact(F.array(
        F.when(F.col("n").isNull(), "missing"), F.when(F.col("n") != rows, F.format_string("%d rows", "n")),
        F.when((F.col("steps") != last_s // step_s + 1) | (F.col("last") != last_s), "time steps are missing"), F.when(F.col("wrong") > 0, F.format_string("%d wrong states", "wrong"))))
    return out.withColumn("problems", found).where(F.size("problems") > 0).select("scenario", "problems")


def incident_snapshots(incidents: DataFrame) -> DataFrame:
    """Live incidents(scenario, as_of_s, incident) without those hours at which nothing changed, numbered by content."""
    from pyspark.sql import Window

    w = Window.partitionBy("scenario").orderBy("as_of_s")
    changed = F.coalesce(~F.col("incident").eqNullSafe(F.lag("incident").over(w)), F.lit(True)) | (F.row_number().over(w) == 1)
    kept = incidents.withColumn("_c", changed).where("_c").drop("_c")
    return kept.withColumn("version", F.dense_rank().over(Window.partitionBy("scenario").orderBy("incident")))
