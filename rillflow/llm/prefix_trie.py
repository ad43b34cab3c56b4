"""Prefix trie of conversations: every distinct run of first turns, with its conversations, children, leaves and the text that sharing it saves.

Method: conversations become sequences of turn digests; equal sequences are one row; the rows are sorted, each partition of the sorted table being a block. LCP[i] is the number of
turns that row i shares with the row before. The trie's branching nodes are the nodes of the Cartesian tree over LCP: the interval between an entry's nearest smaller values on
both sides; entries of one interval with equal LCP are one node. Each block finds the nearest smaller values among its own entries with a stack; for those beyond it, the block's
minima tell the block that holds them, and what has been left open is joined with that block's suffix (or prefix) minima. Counts and text sizes of an interval are differences of
running sums, so a node takes no walk over its subtree. A node stands for all depths down from its parent's; the missing ones are expanded last.

To the driver go a row for each block (its ends, minima and sums); all else is distributed. A conversation's digests (16 bytes a turn) lie in one row.

Defined cases: turns of one conversation with the same ``turn`` are ordered by digest (repeated rows are repeated turns); a null turn comes first; null role or text is
empty; rows without ``conv_id`` belong to no conversation and are left out; an empty table has no conversation and gives no node, not even the root; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.common import cut, map_arrow

_NONE = hashlib.sha256(b"").hexdigest()
_INF = np.iinfo(np.int64).max
_PARTS = (
    "what string, block int, depth long, above long, n long, conv long, full long, fresh long, leaves long, count long, length long, ends string,"
    " sizes array<long>, key binary, parent_key binary, left_block int, right_block int"
)


def rebuilt(conversations: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, turns, sizes): each conversation after the first h turns are replaced by those of the first conversation of its hundred; h is a hash below ``most``.

    turns: a digest for each (role, text); sizes: the text's code points.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest.alias("d"), F.char_length(text).cast("long").alias("size")).alias("t"))
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", F.col("t.d").alias("d"), F.col("t.size").alias("s"))
    first = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("d", 1, most - 1).alias("bd"), F.slice("s", 1, most - 1).alias("bs"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    rows = own.withColumn("base", F.expr(f"conv_id - conv_id % {group}")).withColumn("h", h).join(first, "base", "left")
    return rows.select("conv_id", *(
        F.concat(F.coalesce(F.expr(f"slice({b}, 1, h)"), F.expr(f"slice({o}, 1, 0)")), F.expr(f"slice({o}, h + 1, greatest(size({o}) - h, 0))")).alias(name)
        for o, b, name in (("d", "bd", "turns"), ("s", "bs", "sizes"))))


def _ends(convs: DataFrame) -> DataFrame:
    """(sid, ends): SHA-256 of a sequence's conversation ids, ascending and comma-joined. Tasks join runs of sorted ids; then a sequence's runs are hashed one after the other."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid, ids = batch.column("sid").to_pylist(), batch.column("conv_id").to_pylist()
            at = [0, *(i for i in range(1, len(sid)) if sid[i] != sid[i - 1]), len(sid)]
            own = [(sid[i], ids[i], ",".join(map(str, ids[i:j]))) for i, j in zip(at, at[1:]) if i < j]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in own], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.string()))], names=["sid", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, out = None, None, []
        for batch in batches:
            for sid, ids in zip(batch.column("sid").to_pylist(), batch.column("ids").to_pylist()):
                if sid != now:
                    if now is not None:
                        out.append((now, h.hexdigest()))
                    now, h = sid, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.binary(), pa.string()))], names=["sid", "ends"])
            out = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([h.hexdigest()])], names=["sid", "ends"])

    joined = map_arrow(convs.select("sid", "conv_id").repartitionByRange("sid", "conv_id").sortWithinPartitions("sid", "conv_id"), runs, "sid binary, first long, ids string")
    return map_arrow(joined.repartition("sid").sortWithinPartitions("sid", "first"), hashed, "sid binary, ends string")


def _lcp(a: list[bytes], b: list[bytes]) -> int:
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return i
    return min(len(a), len(b))


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names))


def _block_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a block: rows, least LCP inside, first and last sequence."""
    from pyspark import TaskContext

    first, last, n, least = None, None, 0, 1 << 30
    for (turns,) in _rows(batches, "turns"):
        if last is None:
            first = turns
        else:
            least = min(least, _lcp(last, turns))
        last, n = turns, n + 1
    if n:
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64()), pa.array([least], pa.int64()), *(pa.array([x], pa.list_(pa.binary())) for x in (first, last))],
            names=["block", "n", "least", "first", "last"])


def _block_nodes(batches: Iterator[pa.RecordBatch], around: dict[int, tuple[int, int]], numbers: list[int], minima: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A block's nodes, and what of nodes that reach beyond it.

    around: by block, the LCP at its first row and at the row after its last. numbers, minima: the blocks with rows, in order, and their least LCP.
    ``left`` and ``right`` rows are suffix and prefix minima with the sums from there to the block's end (the first row's text as a whole), or from its start to before it; ``open`` are parts of nodes.
    """
    from pyspark import TaskContext

    block = TaskContext.get().partitionId()
    rows = list(_rows(batches, "turns", "sizes", "n", "conv", "ends"))
    if not rows:
        return
    at, (v_first, v_next) = numbers.index(block), around[block]
    m = len(rows)
    v, chains, cums, last = np.empty(m + 1, dtype=np.int64), [], [], ([], [b""], [0])
    for i, (turns, sizes, *_) in enumerate(rows):
        v[i] = k = _lcp(last[0], turns) if i else 0
        chain, cum = last[1][: k + 1], last[2][: k + 1]
        for d, s in zip(turns[k:], sizes[k:]):
            chain.append(hashlib.md5(chain[-1] + d).digest())
            cum.append(cum[-1] + s)
        chains.append(chain)
        cums.append(cum)
        last = (turns, chain, cum)
    v[0], v[m] = v_first, v_next
    size = np.array([len(r[0]) for r in rows])
    n, conv = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    whole = np.array([c[-1] for c in cums])
    leaf = size > v[1:]
    run = lambda x: np.r_[0, np.cumsum(x)]
    sums = {"n": run(n), "full": run(n * whole), "fresh": run([c[-1] - c[max(k, 0)] for c, k in zip(cums, v)]), "leaves": run(leaf)}
    out: list[dict] = []

    def total(i: int, j: int) -> dict:
        """Sums over the rows from i to before j; fresh leaves out row i's."""
        return {k: int(s[j] - s[i]) for k, s in sums.items()} | {"fresh": int(sums["fresh"][j] - sums["fresh"][min(i + 1, j)])}

    def node(depth: int, above: int, i: int, count: int, values: dict) -> None:
        out.append({"what": "node", "depth": depth, "above": above, "count": count, "length": int(size[i]), "ends": rows[i][4] if size[i] == depth else _NONE, "sizes": cums[i][above : depth], "key": chains[i][depth],
                    "parent_key": chains[i][above] if above else None} | values | {"fresh": values["fresh"] + int(whole[i])})

    stack: list[list] = []  # value, last place of it, left end (None: before the block), how many, least conv since the left end
    for i in range(m + 1):
        value, carry = (int(v[i]) if i < m else None), int(conv[i - 1]) if i else _INF
        while stack and value is not None and stack[-1][0] > value or value is None and stack:
            depth, place, left, count, least = stack.pop()
            least = min(least, carry)
            if value is None:  # open to the right: a suffix minimum
                out.append({"what": "left", "depth": depth, "length": int(size[place]), "ends": rows[place][4], "conv": int(conv[place:].min())} | total(place, m) | {"fresh": total(place, m)["fresh"] + int(whole[place])})
            if depth > 0 and value is not None and left is not None:
                node(depth, max(int(v[left]), value), left, count, total(left, i) | {"conv": least})
            elif depth > 0:
                out.append({"what": "open", "depth": depth, "count": count, "key": chains[place][depth], "sizes": cums[place][:depth], "parent_key": b"".join(chains[place][: depth]),
                            "left_block": block if left is not None else numbers[max(j for j in range(at) if minima[j] < depth)],
                            "right_block": block if value is not None else next((numbers[j] for j in range(at + 1, len(numbers)) if minima[j] < depth), -1)})
            carry = least
        if value is None:
            break
        if stack and stack[-1][0] == value:
            stack[-1][1], stack[-1][3], stack[-1][4] = i, stack[-1][3] + 1, min(stack[-1][4], carry)
        else:
            if not stack:  # a prefix minimum
                out.append({"what": "right", "depth": value, "conv": int(conv[:i].min()) if i else _INF} | {k: int(s[i]) for k, s in sums.items()})
            stack.append([value, i, stack[-1][1] if stack else None, 1, carry])
        if size[i] > max(value, v[i + 1], 0):
            node(int(size[i]), max(value, int(v[i + 1]), 0), i, -1, {"n": int(n[i]), "conv": int(conv[i]), "full": int(n[i] * whole[i]), "fresh": 0, "leaves": 1})
    out.append({"what": "block", "conv": int(conv.min()), "count": int((v[:m] == 0).sum()), "length": int(size[0]), "ends": rows[0][4] if not size[0] else _NONE} | {k: int(s[m]) for k, s in sums.items()})
    yield pa.RecordBatch.from_pylist([r | {"block": block} for r in out], schema=_SCHEMA)


_SCHEMA = pa.schema([
    ("what", pa.string()), ("block", pa.int32()), *((c, pa.int64()) for c in ("depth", "above", "n", "conv", "full", "fresh", "leaves", "count", "length")), ("ends", pa.string()),
    ("sizes", pa.list_(pa.int64())), ("key", pa.binary()), ("parent_key", pa.binary()), ("left_block", pa.int32()), ("right_block", pa.int32())])


def _closed(parts: DataFrame, blocks: list) -> DataFrame:
    """The nodes that lie in several blocks: open parts merged, their ends taken from the minima of the blocks that hold them."""
    from pyspark.sql import Window

    merged = parts.where("what = 'open'").groupBy("left_block", "right_block", "depth").agg(
        F.sum("count").alias("count"), F.min(F.struct("block", "key", "sizes", "parent_key")).alias("path")).select("*", F.monotonically_increasing_id().alias("id"))
    merged = cut(merged)

    def nearest(side: str) -> DataFrame:
        """(id, end): the chain's entry with the greatest LCP below the node's depth."""
        end = F.struct("depth", "conv", "n", "full", "fresh", "leaves", "length", "ends")
        chain = parts.where(F.col("what") == side).select(F.col("block"), "depth", F.lit(1).alias("later"), F.lit(None).cast("long").alias("id"), end.alias("end"))
        asked = merged.select(F.col(f"{side}_block").alias("block"), "depth", F.lit(0).alias("later"), "id", F.lit(None).cast(chain.schema["end"].dataType).alias("end"))
        below = Window.partitionBy("block").orderBy("depth", "later").rowsBetween(Window.unboundedPreceding, -1)
        return chain.union(asked).select("id", F.last("end", ignorenulls=True).over(below).alias(f"{side}_end")).where("id IS NOT NULL")

    both = merged.join(nearest("left"), "id").join(nearest("right"), "id", "left")
    numbers = [b.block for b in blocks]
    held = {k: np.r_[0, np.cumsum([b[k] for b in blocks])] for k in ("n", "full", "fresh", "leaves")}
    convs = np.array([b.conv for b in blocks])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {b: i for i, b in enumerate(numbers)}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                left, right, depth = r["left_end"], r["right_end"] or {"depth": -1, "conv": _INF, "n": 0, "full": 0, "fresh": 0, "leaves": 0}, r["depth"]
                i, j = place[r["left_block"]] + 1, place.get(r["right_block"], len(numbers))
                values = {k: left[k] + int(held[k][j] - held[k][i]) + right[k] for k in held}
                conv = min([left["conv"], right["conv"], *convs[i:j].tolist()])
                above, path = max(left["depth"], right["depth"], 0), r["path"]
                keys = path["parent_key"]  # digests by depth; that of depth 0 is empty
                out.append({"what": "node", "depth": depth, "above": above, "conv": conv, "count": r["count"], "length": left["length"], "ends": left["ends"] if left["length"] == depth else _NONE,
                            "sizes": path["sizes"][above:], "key": path["key"], "parent_key": keys[16 * (above - 1) : 16 * above] if above else None} | values)
            yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)

    return map_arrow(both, close, _PARTS)


def trie(sequences: DataFrame) -> DataFrame:
    """The nodes of sequences (conv_id, turns, sizes): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = sequences.sparkSession
    convs = cut(sequences.withColumn("sid", F.unhex(F.md5(F.concat_ws("", F.transform("turns", F.hex)).cast("binary")))))
    once = convs.groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv"), F.first("turns").alias("turns"), F.first("sizes").alias("sizes"))
    rows = cut(once.join(_ends(convs), "sid").select("turns", "sizes", "n", "conv", "ends").orderBy("turns"))
    ends = sorted(map_arrow(rows.select("turns"), _block_ends, "block int, n long, least long, first array<binary>, last array<binary>").collect(), key=lambda r: r.block)
    joins = [-1, *(_lcp(list(a.last), list(b.first)) for a, b in zip(ends, ends[1:])), -1]
    numbers, minima = [r.block for r in ends], np.array([min(r.least, k) for r, k in zip(ends, joins)])
    around = {r.block: (joins[i], joins[i + 1]) for i, r in enumerate(ends)}
    parts = cut(map_arrow(rows, lambda batches: _block_nodes(batches, around, numbers, minima), _PARTS))
    blocks = sorted(parts.where("what = 'block'").select("block", "conv", "n", "full", "fresh", "leaves", "count", "length", "ends").collect(), key=lambda r: r.block)
    nodes = cut(parts.where("what = 'node'").unionByName(_closed(parts, blocks)).select("depth", "above", "conv", "n", "full", "fresh", "leaves", "count", "length", "ends", "sizes", "key", "parent_key"))
    out = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if not blocks:
        return spark.createDataFrame([], out)
    top, total = blocks[0], {k: sum(b[k] for b in blocks) for k in ("n", "full", "fresh", "leaves", "count")}
    root = spark.createDataFrame([(min(b.conv for b in blocks), 0, None, total["n"], total["count"] + (top.length > 0), total["leaves"], total["full"] - total["fresh"], top.ends)], out)
    parents = nodes.select(F.col("key").alias("parent_key"), F.col("conv").alias("up"))
    placed = nodes.where("above > 0").join(parents, "parent_key").unionByName(nodes.where("above = 0").withColumn("up", F.lit(root.first().conv_id)))
    each = placed.select("*", F.posexplode("sizes").alias("step", "before")).withColumn("at", F.expr("above + step + 1"))
    bottom = F.col("at") == F.col("depth")
    children = F.when(F.col("count") < 0, 0).otherwise(F.expr("count + 1 - int(length = depth)"))
    return each.select(
        F.col("conv").alias("conv_id"), F.col("at").alias("depth"), F.when(F.col("step") == 0, F.col("up")).otherwise(F.col("conv")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(bottom, children).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), F.expr("full - fresh - (n - 1) * before").alias("saved_tokens"),
        F.when(bottom, F.col("ends")).otherwise(_NONE).alias("ends_sha256")).unionByName(root)


def op13_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt ``conversations``."""
    return trie(rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
