"""Helpers of the corpus operators: lineage cuts, Arrow batches, words, and graph components.

Conventions that hold for every operator here:

* only the named columns of the input are read, so extra columns (whatever their names) never clash;
* a null text counts as the empty text, unless an operator says otherwise;
* a row is never dropped: repeated rows give repeated results, an empty table gives an empty result.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions.shipping import ship

#: Words are counted in pieces of this many while a text is worked on, so that memory follows the piece.
PIECE = 1 << 16

_SEPARATORS = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
#: Lower-cases A-Z and turns every ASCII byte that is not a letter or digit into a space.
_ALNUM = bytes.maketrans(
    _SEPARATORS + bytes(range(65, 91)), b" " * len(_SEPARATORS) + bytes(range(97, 123))
)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there.

    The folder comes from ``spark.checkpoint.dir``. Only where that is unset (tests, a laptop) is a
    temporary folder used. Unlike a local checkpoint, the files outlive any executor.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Without one, only a session on this machine alone gets a temporary folder."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="rillflow")


_stored: dict[str, SparkSession] = {}
_scratch: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("_scratch", default=None)


def store(df: DataFrame) -> DataFrame:
    """Like ``cut``, but as a compressed table in the shared folder, for what would be large as a checkpoint.

    The tables are deleted by ``discard``, at the end of ``scratch``, or when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", 32 << 20).parquet(path)
    _stored[path] = spark
    if (here := _scratch.get()) is not None:
        here.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def _delete(path: str) -> None:
    spark = _stored.pop(path, None)
    if spark is not None:
        with contextlib.suppress(Exception):  # the session may be gone, and the folder with it
            jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``store`` returned and that no later plan reads."""
    for table in tables:
        _delete(getattr(table, "_stored_at", ""))


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are stored while this lasts go at its end, but for those given to the function that it yields."""
    held: list[str] = []
    token = _scratch.set(held)

    def keep(table: DataFrame) -> DataFrame:
        held.remove(table._stored_at)
        return table

    try:
        yield keep
    finally:
        _scratch.reset(token)
        for path in held:
            _delete(path)


@atexit.register
def _delete_stored() -> None:
    for path in list(_stored):
        _delete(path)


@contextlib.contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """While this lasts, shuffle files go as soon as the query that made them has ended, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release() -> None:
    """Give memory that is free back to the system: workers outlive their tasks, and several wait on one executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Have Spark send texts to Python in batches of this size, unless the session asks for less: a worker and its
    executor hold several at a time. This is a setting of the session, as plans read it when they run."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "64m").lower()
    scale = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    digits = now.rstrip("bkmg")
    unit = now[len(digits) :].removesuffix("b") or "b"
    if digits.isdigit() and int(digits) * scale.get(unit, 1) > int(size[:-1]) << 20:
        spark.conf.set(key, size)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` whose tasks leave no free memory behind."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    ship(df.sparkSession)
    small_batches(df.sparkSession)
    return df.mapInArrow(tidy, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, so that few texts at a time are Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply f to Arrow batches of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(f, slices(batches))

    return map_arrow(df, run, schema)


def body(text_col: str = "text") -> Column:
    """The text as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")


def alnum_words(raw: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return raw.translate(_ALNUM).split()


def space_words(raw: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``; ``bytes.split`` parts at just these bytes."""
    return raw.split()


def carried(docs: DataFrame, *more: Column) -> DataFrame:
    """All columns in one struct ``_row``, beside more columns, so that no name of the input can clash with ours."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *more)


def field(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column of the carried rows, so that a text goes to Python once."""
    return pc.struct_field(batch.column("_row"), name)


def row_type(docs: DataFrame) -> str:
    return f"_row {docs.schema.simpleString()}"


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n (null for a null id)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def ranks(batches: Iterator[pa.RecordBatch], key: str, names: tuple[str, str] = ("_part", "_nth")) -> Iterator[pa.RecordBatch]:
    """A task's batches with the partition's number and each row's place (from 0) among the task's rows of one key.

    No shuffle and no sort: ranks over the whole table follow by adding, for each partition, what the
    partitions before it hold (``offsets``). Cut the lineage before using both.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    seen: dict[int, int] = {}
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        order = np.argsort(keys, kind="stable")
        values, first, counts = np.unique(keys[order], return_index=True, return_counts=True)
        nth = np.empty(len(keys), dtype=np.int64)
        base = np.array([seen.get(int(v), 0) for v in values], dtype=np.int64)
        nth[order] = np.arange(len(keys)) - np.repeat(first, counts) + np.repeat(base, counts)
        for v, c in zip(values, counts):
            seen[int(v)] = seen.get(int(v), 0) + int(c)
        columns = [*batch.columns, pa.array(np.full(len(keys), part, dtype=np.int32)), pa.array(nth)]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *names])


RANKS = "_part int, _nth long"


def ranked(df: DataFrame, key: str) -> DataFrame:
    """The rows with ``ranks`` by key."""
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return map_arrow(df, lambda batches: ranks(batches, key), f"{out}, {RANKS}")


def offsets(df: DataFrame, key: str) -> DataFrame:
    """For what ``ranked`` returns: (key, _part, _before), the rows of the key in earlier partitions."""
    from pyspark.sql import Window

    counts = df.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(key, "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of undirected edges: (node, root), root the least node of its component.

    Alternating large-star and small-star rounds, each a pair of aggregations and joins, so a node of
    any degree is spread over tasks: minima are pre-aggregated, and skewed joins can be split.
    Every round is written to the shared folder, so no round is computed again after a loss.
    """
    now = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    size = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        now = cut(small)
        # a star forest maps to itself: each node once on the left, and no root on the left
        state = now.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")
        ).first()
        if not state.n or size == state:
            break
        size = state
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
