"""Live diagnosis as a stream: open incidents are held as state, and each reading is worked on once, however long the replay.

Readings are scored against a static baseline as they come. Tasks keep flagged readings and one mark for each other time step. A ``transformWithState`` operator keyed by scenario
buffers them until the watermark has passed a window of ``every_s`` seconds, then walks its steps in order: a step with enough flagged assets opens an incident or goes on with
the open one, any other step ends it. At the window's end the evidence of the incidents that changed in it is told: their flagged readings so far, flags of the look-back before
them, and a flag of each asset that ran dry. From such rows ``diagnosed`` makes packets and diagnoses in bulk. An incident that did not change is not told again.

State is the evidence of one open incident, the look-back and one row for each dry asset of a scenario, not its history. Readings of a window that has been told already are ``late``: they
are given back with that role and change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from rillflow.functions.lineage import cut
from rillflow.functions.shipping import ship
from rillflow.operators import day, detect
from rillflow.operators.retrieval import Building, Retrieval

FIELDS = ["timestamp_s", "asset_id", "asset_type", "parameter", "score", "residual", "observed", "expected"]
_TYPES = "timestamp_s long, asset_id string, asset_type string, parameter string, score double, residual double, observed double, expected double"
_SLIM = f"scenario string, {_TYPES}"
TOLD = f"scenario string, as_of_s long, incident_no long, role string, {_TYPES}"
_ORDER = ["scenario", "as_of_s", "incident_no", "role", *FIELDS]
_EMPTY = pd.DataFrame({"timestamp_s": pd.Series(dtype="int64"), **{c: pd.Series(dtype="object") for c in FIELDS[1:4]}, **{c: pd.Series(dtype="float64") for c in FIELDS[4:]}})

#: State in RocksDB, as transformWithState needs it; set these in the session.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def _slim(threshold: float):
    """Of each batch the flagged readings, and a mark (no asset) for each other step of a scenario."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.to_pandas()
            over = t["score"] > threshold
            quiet = t.loc[~over, ["scenario", "timestamp_s"]].drop_duplicates()
            out = pd.concat([t[over], quiet], ignore_index=True)[["scenario", *FIELDS]]
            yield pa.RecordBatch.from_pandas(out, schema=_SCHEMA, preserve_index=False)

    return run


_SCHEMA = pa.schema([("scenario", pa.string()), ("timestamp_s", pa.int64()), *((c, pa.string()) for c in FIELDS[1:4]), *((c, pa.float64()) for c in FIELDS[4:])])


class OpenIncidents(StatefulProcessor):
    """The steps of one scenario, in order of time, window by window."""

    def __init__(self, every_s: int, min_assets: int, config: Retrieval):
        self.every, self.least, self.config = every_s, min_assets, config

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "told_s long, incidents long, is_open boolean, rows binary")

    def _load(self, key) -> None:
        self.scenario = key[0]
        held = self.state.get() if self.state.exists() else None
        self.told, self.number, self.open = (held[0], held[1], held[2]) if held else (-1, 0, False)
        rows = pa.ipc.open_stream(bytes(held[3])).read_pandas() if held else _EMPTY.assign(part="")
        self.parts = {p: rows.loc[rows["part"] == p, FIELDS] for p in ("pending", "early", "member", "recent", "dry")}

    def _save(self) -> None:
        rows = pd.concat([df.assign(part=p) for p, df in self.parts.items()], ignore_index=True)
        batch = pa.RecordBatch.from_pandas(rows, schema=pa.schema([*_SCHEMA][1:] + [pa.field("part", pa.string())]), preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        self.state.update((self.told, self.number, self.open, sink.getvalue().to_pybytes()))
        if len(self.parts["pending"]):
            self.handle.registerTimer(int(self._window(self.parts["pending"]["timestamp_s"]).min()) * 1000 + 1)

    def _window(self, seconds):
        return -(-seconds // self.every) * self.every

    def _step(self, rows: pd.DataFrame) -> bool:
        """Take one time step; whether it belongs to an incident."""
        flags = rows[rows["asset_id"].notna()]
        positive = len(flags[["asset_type", "asset_id"]].drop_duplicates()) >= self.least
        now = int(rows["timestamp_s"].iloc[0])
        if positive:
            if not self.open:
                self.number += 1
                before = self.parts["recent"]
                self.parts["early"] = before[before["timestamp_s"] >= now - self.config.lookback_hours * 3600]
                self.parts["member"] = _EMPTY
            self.parts["member"] = pd.concat([self.parts["member"], flags], ignore_index=True)
        self.open = positive
        recent = pd.concat([self.parts["recent"], flags], ignore_index=True)
        self.parts["recent"] = recent[recent["timestamp_s"] > now - self.config.lookback_hours * 3600]
        c = self.config
        dry = flags[(flags["parameter"] == "pressure") & (flags["expected"] > c.dry_expected) & (flags["observed"] <= (c.dry_share * flags["expected"]).clip(lower=c.dry_level))]
        self.parts["dry"] = pd.concat([self.parts["dry"], dry], ignore_index=True).drop_duplicates("asset_id")
        return positive

    def _advance(self, mark_ms: int) -> Iterator[pd.DataFrame]:
        pending = self.parts["pending"]
        window = self._window(pending["timestamp_s"])
        ready = window * 1000 < mark_ms
        self.parts["pending"] = pending[~ready]
        for as_of, rows in pending[ready].groupby(window[ready], sort=True):
            changed: dict[int, list[pd.DataFrame]] = {}
            for _, step in rows.groupby("timestamp_s", sort=True):
                if self._step(step):
                    changed[self.number] = [self.parts[r].assign(role=r) for r in ("early", "member")]
            self.told = int(as_of)
            for number, evidence in changed.items():
                told = pd.concat([*evidence, self.parts["dry"].assign(role="dry")], ignore_index=True)
                yield told.assign(scenario=self.scenario, as_of_s=self.told, incident_no=number)[_ORDER]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self._load(key)
        for part in rows:
            part = part[FIELDS]
            late = self._window(part["timestamp_s"]) <= self.told
            if late.any():
                yield part[late & part["asset_id"].notna()].assign(scenario=self.scenario, as_of_s=self.told, incident_no=0, role="late")[_ORDER]
            self.parts["pending"] = pd.concat([self.parts["pending"], part[~late]], ignore_index=True)
        yield from self._advance(timerValues.getCurrentWatermarkInMs())
        self._save()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load(key)
        yield from self._advance(timerValues.getCurrentWatermarkInMs())
        self._save()

    def close(self) -> None:
        pass


def open_incidents(scored: DataFrame, every_s: int = 3600, late: str = "0 seconds", threshold: float = 4.0, min_assets: int = 2, config: Retrieval = Retrieval()) -> DataFrame:
    """What is told of the incidents of a stream of scored readings (scenario, as_of_s, incident_no, role and the reading).

    Roles: ``member``, ``early`` (of the look-back), ``dry`` (one flag of each asset that ran dry), ``late``. The session needs ``SETTINGS``.
    """
    ship(scored.sparkSession)
    timed = scored.select("scenario", *FIELDS).withColumn("ts", F.timestamp_seconds("timestamp_s")).withWatermark("ts", late).drop("ts")
    slim = timed.mapInArrow(_slim(threshold), _SLIM)
    told = slim.groupBy("scenario").transformWithStateInPandas(OpenIncidents(every_s, min_assets, config), TOLD, "append", "eventTime")
    return told


def diagnosed(told: DataFrame, building: Building, config: Retrieval = Retrieval()) -> DataFrame:
    """Packets and diagnoses of told evidence, as ``day.run_live`` gives them: one row for each incident and window at which it changed."""
    name = F.concat_ws(day.SEP, "scenario", F.col("as_of_s").cast("string"), F.col("incident_no").cast("string"))
    rows = cut(told.where("role <> 'late'").withColumn("scenario", name))
    found = rows.where("role = 'member'").drop("role", "as_of_s")
    flagged = rows.drop("role", "as_of_s", "incident_no").distinct()
    out = day.diagnosed(day.evidence_of(found, flagged, building, config))
    part = F.split("scenario", day.SEP)
    return out.withColumns({"as_of_s": part[1].cast("long"), "scenario": part[0], "incident": F.concat_ws("-", part[0], "incident_no")})


def start(observed: DataFrame, baseline: DataFrame, building: Building, folder: str, every_s: int = 3600, late: str = "0 seconds", threshold: float = 4.0, min_assets: int = 2,
          config: Retrieval = Retrieval(), by: tuple[str, ...] = ("timestamp_s", "asset_id", "parameter"), **trigger):
    """Start the live diagnosis of a stream of observations; each batch's rows go to ``folder/diagnoses/batch=n``, so that a batch that is made again replaces its own."""

    def told(batch: DataFrame, number: int) -> None:
        diagnosed(batch, building, config).write.mode("overwrite").parquet(f"{folder}/diagnoses/batch={number}")

    scored = detect.residual_scores(observed, baseline, by)
    stream = open_incidents(scored, every_s, late, threshold, min_assets, config).writeStream.foreachBatch(told).option("checkpointLocation", f"{folder}/checkpoint")
    return stream.trigger(**(trigger or {"availableNow": True})).start()
