"""Best-fit packing of token sequences.

Method: length-histogram planning. Only the number of pieces of each length (at most ``capacity`` numbers)
comes to the driver. Best-fit decreasing runs over these counts: open sequences are held as groups
(first number, how many, room left), so one step places all pieces of a length into a whole group. Each step
gives a slot range: length, ranks [lo, hi), first sequence, offset. The pieces then take their slots by joining on
their rank within their length; ranks come from counts by partition, so no length is gathered in one task.
"""

from __future__ import annotations

import json
import zlib
from array import array
from bisect import bisect_left, insort
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import RANKS, cut, map_arrow, offsets, ranks, slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> token ids, equal to those of ``tokenizers`` with the file at path (byte-level BPE).

    The file's vocabulary and merges are run by the faster of two libraries where both split text alike
    (code points up to U+024F, where their character classes agree, and no name of a special token), else by ``tokenizers`` itself.
    """
    import regex
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # the byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(letter[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
    from public_tokenizers import PATTERN

    fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    latin = regex.compile("[\x00-ɏ]*+")
    apart = regex.compile("|".join([r"[^\s]{2000}", r"\s{2000}", *map(regex.escape, sorted(special))]))

    def encode(text: str) -> list[int]:
        if latin.fullmatch(text) and not apart.search(text):
            return fast.encode_ordinary(text)
        return slow.encode(text, add_special_tokens=False).ids

    return encode


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole up to capacity, else full pieces after a shorter first one."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document, ranked by length in their task; a null text is empty."""

    def cut_up(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(tokenizer)
        out: list[list] = [[], [], [], [], []]
        tokens: list[list[int]] = []
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            ids = array("I", encode(text))
            ids.append(end_id)
            view = memoryview(ids)
            for n, (start, length) in enumerate(cuts(len(ids), capacity)):
                part = view[start : start + length]
                for column, value in zip(out, (doc_id, n, start, length, zlib.crc32(part))):
                    column.append(value)
                if with_ids:
                    tokens.append(part.tolist())
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        columns = [pa.array(c, t) for c, t in zip(out, kinds)]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            columns.append(pa.array(tokens, pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    schema = PIECES + (", ids array<int>" if with_ids else "")
    return map_arrow(rows, lambda batches: ranks(map(cut_up, slices(batches)), "length"), f"{schema}, {RANKS}")


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, lo, hi, first_sequence, offset) for ranks [lo, hi) of a length."""
    slots: list[tuple[int, int, int, int, int]] = []
    rooms: list[tuple[int, int, int]] = []  # (room, first sequence, how many), sorted
    made = 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]

        def fill(room: int, first: int, many: int, each: int) -> None:
            """Each of these sequences takes ``each`` pieces of this length."""
            nonlocal rank
            for i in range(each):
                slots.append((length, rank, rank + many, first, capacity - room + i * length))
                rank += many
            if room - each * length:
                insort(rooms, (room - each * length, first, many))

        while left:
            at = bisect_left(rooms, (length, 0, 0))
            if at == len(rooms):
                each = capacity // length
                room, first, many = capacity, made, -(-left // each)
                made += many
            else:
                room, first, many = rooms.pop(at)
                each = room // length
            whole = min(many, left // each)
            if whole:
                fill(room, first, whole, each)
                left -= whole * each
            if whole < many:
                if left:  # fewer than ``each`` are left: one more sequence takes them
                    fill(room, first + whole, 1, left)
                    whole, left = whole + 1, 0
                if whole < many:
                    insort(rooms, (room, first + whole, many - whole))
    return slots


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id",
    text_col: str = "text", with_ids: bool = False, broadcast_rows: int = 200_000,
) -> DataFrame:
    """The pieces with sequence_id and offset. Repeated documents are packed each; an empty table gives no rows.

    The plan has at most a few rows for each length. It is broadcast up to broadcast_rows of them; a longer
    plan is joined by length like any table.
    """
    cutted = cut(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids))
    histogram = {r.length: r["count"] for r in cutted.groupBy("length").count().collect()}
    slots = plan(histogram, capacity)
    spark = docs.sparkSession
    table = spark.createDataFrame(slots, "slot_length long, lo long, hi long, first long, offset long")
    table = F.broadcast(table) if len(slots) <= broadcast_rows else table
    before = offsets(cutted, "length").withColumnsRenamed({"length": "l", "_part": "p"})
    rank = F.col("_nth") + F.col("_before")
    on = (F.col("length") == F.col("slot_length")) & (rank >= F.col("lo")) & (rank < F.col("hi"))
    placed = cutted.join(before, (F.col("length") == F.col("l")) & (F.col("_part") == F.col("p"))).join(table, on)
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + rank - F.col("lo")).alias("sequence_id"), "offset", *(["ids"] if with_ids else []),
    )


def tokenizer_path() -> str:
    from public_tokenizers import path

    return str(path("byte_bpe_50k.json"))


def op5_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, tokenizer_path())
