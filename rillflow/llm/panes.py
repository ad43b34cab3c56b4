"""Window panes with revisions: hourly totals by kind from a stateful stream, corrected when late rows come, as a change log.

A run cuts the clicks into batches, writes them to a folder, and feeds one batch after the other to a streaming query that is started anew for
each on one checkpoint, as a scheduled job would. A pane is a kind and an event hour. With W, the greatest event hour of all earlier batches,
a pane is *due* (its total is written) and later *closed* (its rows count as late, its state goes).

Method: each task first adds its rows to one row for each pane with ``bincount``; closed panes' rows stay single. A ``transformWithState`` operator keyed by kind and
shard of hours (so a hot kind, or a hot hour, reaches a task as a few sums) keeps one value: NumPy arrays as an Arrow batch, a ring over
consecutive hours of the shard and a sparse overflow for hours outside of it. Slices of the arrays past a threshold are the due, dirty and closed panes.
A tick for each key and batch reaches keys that get no rows.

Defined cases: rows without ``ts`` or ``click_id`` are left out; of rows with one click_id the least (by ts, then the other columns) counts;
a null ``arrived_at`` counts as ``ts``; a null kind is ``none``; a null, infinite or not-a-number value has 0 cents; an empty table gives no rows; only the
named columns are read, so extra columns never clash.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from rillflow.functions.shipping import ship
from rillflow.llm.common import map_arrow, shared_folder

#: Hours from a pane's start until it is due (its end and 12 hours) and until it is closed (its end and 2 days).
DUE, CLOSED = 1 + 12, 1 + 48
#: Slots of a ring: with 16 shards, 512 consecutive hours.
SLOTS = 32

_STAGED = "kind string, shard int, hour long, click_id long, cents long"
_PARTIAL = "kind string, shard int, hour long, click_id long, n long, cents long"
_CHANGES = "hour long, click_id long, n_rows long, cents long, record string, kind string"


def batched(clicks: DataFrame, batches: int = 10) -> DataFrame:
    """Each click once, as (batch, hour, kind, click_id, cents).

    Event time is ``ts`` less D - q days (D: the day of ``arrived_at`` since 1970, q: D mod batches), so a batch is about a day and a row may come up to six batches late. Calendar parts
    are read off the timestamps as they stand, whatever the session's zone.
    """
    rows = clicks.where("ts IS NOT NULL AND click_id IS NOT NULL").select("click_id", F.struct("ts", F.coalesce("arrived_at", "ts").alias("arrived"), "kind", "value").alias("row"))
    once = rows.groupBy("click_id").agg(F.min("row").alias("row")).select("click_id", "row.*")
    day = F.unix_date(F.to_date("arrived")).cast("long")
    once = once.withColumn("D", day).withColumn("q", F.pmod("D", F.lit(batches)))
    delay = F.greatest(F.lit(0), F.crc32(F.col("click_id").cast("string").cast("binary")) % 30 - 23)
    hundredfold = F.floor(100 * F.col("value") + 0.5)
    return once.select(
        F.least(F.lit(batches - 1), F.col("q") + delay).cast("int").alias("batch"),
        ((F.unix_date(F.to_date("ts")).cast("long") - F.col("D") + F.col("q")) * 24 + F.hour("ts")).alias("hour"),
        F.coalesce("kind", F.lit("none")).alias("kind"), F.col("click_id").cast("long").alias("click_id"),
        F.when(F.abs("value") < 9e15, hundredfold).otherwise(0).cast("long").alias("cents"))


def _sums(slots: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """Exact integer sums by slot: ``bincount`` adds doubles, so high and low bits are added apart."""
    low = np.bincount(slots, weights=weights & 0xFFFFFF, minlength=size).astype(np.int64)
    return low + (np.bincount(slots, weights=weights >> 24, minlength=size).astype(np.int64) << 24)


def partial(rows: DataFrame, mark: int, shards: int) -> DataFrame:
    """One row for each pane of an Arrow batch, and each row of a closed pane (W - hour >= CLOSED) by itself. Ticks (no click_id) go on as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.to_pandas()
            tick = t["click_id"].isna().to_numpy()
            hour = t["hour"].fillna(0).to_numpy(np.int64)
            late = ~tick & (hour <= mark - CLOSED)
            alone = t[tick | late]
            alone = alone.assign(n=np.where(alone["click_id"].isna(), 0, 1))
            rest, hour = t[~tick & ~late], hour[~tick & ~late]
            codes, kinds = pd.factorize(rest["kind"])
            first = int(hour.min()) if len(hour) else 0
            panes, slot = np.unique(codes * (np.int64(1) << 40) + (hour - first), return_inverse=True)  # kinds in a batch are few, hours are under 2^40
            at = (panes & ((1 << 40) - 1)) + first
            added = pd.DataFrame({
                "kind": kinds.take(panes >> 40) if len(panes) else [], "shard": (at % shards).astype(np.int32), "hour": at, "click_id": -1,
                "n": np.bincount(slot, minlength=len(panes)), "cents": _sums(slot, rest["cents"].to_numpy(np.int64), len(panes))})
            for part in (added, alone):
                if len(part):
                    yield pa.RecordBatch.from_pandas(part[["kind", "shard", "hour", "click_id", "n", "cents"]].astype({"click_id": "Int64", "hour": "Int64"}), schema=_ARROW, preserve_index=False)

    return map_arrow(rows, run, _PARTIAL)


_ARROW = pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("hour", pa.int64()), ("click_id", pa.int64()), ("n", pa.int64()), ("cents", pa.int64())])


class Ring:
    """The panes of one kind and shard: arrays n, cents and what was last written of both (out_n 0: nothing yet), by slot.

    Slot k stands for hour ``k * shards + shard``. Slots ``start .. start + SLOTS`` lie in a ring (slot k at k mod SLOTS), others in sorted overflow arrays.
    """

    def __init__(self, blob: bytes | None = None):
        self.start, self.ring = None, np.zeros((4, SLOTS), dtype=np.int64)
        self.keys, self.over = np.empty(0, dtype=np.int64), np.zeros((4, 0), dtype=np.int64)
        if blob:
            batch = pa.ipc.open_stream(blob).read_next_batch()
            slot, *columns = (c.to_numpy() for c in batch.columns)
            start = int(batch.schema.metadata[b"start"])
            self.start, ring = start, (slot >= start) & (slot < start + SLOTS)
            self.ring[:, slot[ring] % SLOTS] = np.stack(columns)[:, ring]
            self.keys, self.over = slot[~ring], np.stack(columns)[:, ~ring]

    def dump(self) -> bytes:
        slot, values = self.held()
        schema = pa.schema([(c, pa.int64()) for c in ("slot", "n", "cents", "out_n", "out_cents")], metadata={"start": str(self.start or 0)})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, schema) as out:
            out.write_batch(pa.record_batch([pa.array(slot), *map(pa.array, values)], schema=schema))
        return sink.getvalue().to_pybytes()

    def held(self) -> tuple[np.ndarray, np.ndarray]:
        """Slots with rows, ascending, and their values."""
        if self.start is None:
            return self.keys, self.over
        at = np.arange(self.start, self.start + SLOTS)
        values = self.ring[:, at % SLOTS]
        below = np.searchsorted(self.keys, self.start)
        slot = np.concatenate([self.keys[:below], at[values[0] > 0], self.keys[below:]])
        return slot, np.concatenate([self.over[:, :below], values[:, values[0] > 0], self.over[:, below:]], axis=1)

    def put(self, slot: np.ndarray, values: np.ndarray) -> None:
        """Hold just these panes (slots ascending); the ring starts at the first."""
        self.__init__()
        self.start = int(slot[0]) if len(slot) else None
        inside = slot < (self.start or 0) + SLOTS
        self.ring[:, slot[inside] % SLOTS] = values[:, inside]
        self.keys, self.over = slot[~inside], values[:, ~inside]

    def add(self, slot: np.ndarray, n: np.ndarray, cents: np.ndarray) -> None:
        """Add rows to their panes."""
        if self.start is None:
            self.start = int(slot.min())
        inside = (slot >= self.start) & (slot < self.start + SLOTS)
        at = slot[inside] % SLOTS
        self.ring[0] += _sums(at, n[inside], SLOTS)
        self.ring[1] += _sums(at, cents[inside], SLOTS)
        if not inside.all():
            keys, at = np.unique(np.concatenate([self.keys, slot[~inside]]), return_inverse=True)
            over = np.zeros((4, len(keys)), dtype=np.int64)
            over[:, at[: len(self.keys)]] = self.over
            over[0] += _sums(at[len(self.keys) :], n[~inside], len(keys))
            over[1] += _sums(at[len(self.keys) :], cents[~inside], len(keys))
            self.keys, self.over = keys, over


class Panes(StatefulProcessor):
    """One batch's step of a key (kind, shard): late rows, additions, then due, dirty and closed panes by the mark W (an hour)."""

    def __init__(self, mark: int, last: bool, shards: int):
        self.mark, self.last, self.shards = mark, last, shards

    def init(self, handle) -> None:
        self.state = handle.getValueState("panes", "arrays binary")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        kind, shard = key
        held = self.state.get() if self.state.exists() else None
        ring = Ring(bytes(held[0]) if held else None)

        def told(hour, record, n, cents, ids=-1):
            return pd.DataFrame({"hour": hour, "click_id": ids, "n_rows": n, "cents": cents, "record": record, "kind": kind})

        for part in rows:
            part = part[part["n"] > 0]
            hour, ids, n, cents = (part[c].to_numpy(np.int64) for c in ("hour", "click_id", "n", "cents"))
            late = hour <= self.mark - CLOSED
            if late.any():
                yield told(hour[late], "late", n[late], cents[late], ids[late])
            if not late.all():
                ring.add((hour[~late] - shard) // self.shards, n[~late], cents[~late])
        slot, values = ring.held()
        hour, (n, cents, out_n, out_cents) = slot * self.shards + shard, values
        due, dirty = (out_n == 0) & (hour <= self.mark - DUE), (out_n > 0) & (n > out_n)
        parts = [told(hour[due], "emit", n[due], cents[due]), told(hour[dirty], "retract", out_n[dirty], out_cents[dirty]), told(hour[dirty], "replace", n[dirty], cents[dirty])]
        values[2:, due | dirty] = values[:2, due | dirty]
        if self.last:
            rest = values[2] == 0
            parts.append(told(hour[rest], "final", n[rest], cents[rest]))
        ring.put(slot[open_ := hour > self.mark - CLOSED], values[:, open_])
        if len(slot) or held:
            self.state.update((ring.dump(),))
        yield from (p for p in parts if len(p))

    def close(self) -> None:
        pass


def _folder(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _make(spark: SparkSession, name: str) -> None:
    fs, path = _folder(spark, name)
    fs.mkdirs(path)


def _move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder, if it is there, in whatever file system it lies."""
    (fs, here), (_, there) = _folder(spark, source), _folder(spark, target)
    if fs.exists(here) and not fs.rename(here, there):
        raise OSError(f"could not move {source} to {target}")


@contextlib.contextmanager
def _settings(spark: SparkSession, **values: str) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no space set aside for each
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # each start makes its stores anew, so none need stay open
}


def revisions(rows: DataFrame, batches: int = 10, shards: int = 16) -> DataFrame:
    """The change log (batch, hour, click_id, n_rows, cents, record, kind) of rows (batch, hour, kind, click_id, cents).

    The batches lie in a new folder under ``spark.checkpoint.dir``, as do checkpoint and results. If a start fails, the same start can be made again: the checkpoint knows what was written.
    """
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/panes-{uuid.uuid4().hex}"
    shard = F.pmod(F.col("click_id"), F.lit(shards)).cast("int").alias("shard")
    rows.select("batch", "kind", shard, "hour", "click_id", "cents").write.partitionBy("batch").parquet(f"{folder}/written")
    written = spark.read.schema(f"{_STAGED}, batch int").parquet(f"{folder}/written")
    tops = {r.batch: r.top for r in written.groupBy("batch").agg(F.max("hour").alias("top")).collect()}  # a number for each batch
    key = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    ticks = written.select("kind").distinct().select("kind", key.alias("shard"))
    ticks = ticks.select("kind", "shard", F.lit(None).cast("long").alias("hour"), F.lit(None).cast("long").alias("click_id"), F.lit(0).cast("long").alias("cents"), F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch"))
    ticks.coalesce(1).write.partitionBy("batch").parquet(f"{folder}/ticks")
    for name in ("fed", "changes"):
        _make(spark, f"{folder}/{name}")
    ship(spark)
    mark = -(1 << 60)
    with _settings(spark, **_STATE):
        for b in range(batches):
            for part in ("written", "ticks"):
                _move(spark, f"{folder}/{part}/batch={b}", f"{folder}/fed/{part}-{b}")
            fed = spark.readStream.schema(_STAGED).option("recursiveFileLookup", "true").parquet(f"{folder}/fed")
            changes = partial(fed, mark, shards).groupBy("kind", "shard").transformWithStateInPandas(Panes(mark, b == batches - 1, shards), _CHANGES, "append", "none")
            query = (
                changes.select(F.lit(b).cast("long").alias("batch"), "*").writeStream.format("parquet").outputMode("append")
                .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/changes"))
            query.awaitTermination()
            mark = max(mark, tops.get(b, mark))
    return spark.read.schema(f"batch long, {_CHANGES}").parquet(f"{folder}/changes")


def op11_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log of all ``clicks`` in 10 batches."""
    clicks = spark.read.parquet(f"{sf_dir}/clicks.parquet")
    return revisions(batched(clicks))
