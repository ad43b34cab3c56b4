import random
import zlib
from array import array
from collections import defaultdict

from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rillflow.llm import packing as p


def plain_ids(text, end=2):
    return Tokenizer.from_file(p.tokenizer_path()).encode(text or "", add_special_tokens=False).ids + [end]


def check(docs, capacity):
    rows = p.pack(docs, p.tokenizer_path(), capacity).collect()
    want = defaultdict(int)
    for r in docs.collect():
        ids = plain_ids(r.text)
        for n, (start, length) in enumerate(p.cuts(len(ids), capacity)):
            want[r.doc_id, n, start, length, zlib.crc32(array("I", ids[start : start + length]))] += 1
    got = defaultdict(int)
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
    assert got == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), -(-sum(r.length for r in rows) // capacity) if rows else 0


def test_round_trip_and_few_sequences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    made, least = check(docs, 1024)
    assert made <= least * 1.02 + 1


def test_odd_rows(spark):
    texts = [None, "", "a", "a", "x" * 30_000, " " * 5000, "tab\t\n\r\n  end ", "中文 текст ünï ø", "<|endoftext|> 123 'll", "🙂" * 50]
    docs = spark.createDataFrame([(i % 9, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = docs.withColumn("length", F.lit("clash")).withColumn("_part", F.lit(1))
    check(docs, 64)
    assert p.pack(docs.limit(0), p.tokenizer_path()).count() == 0


def test_ids_are_kept_on_demand(spark):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    assert p.pack(docs, p.tokenizer_path(), with_ids=True).first().ids == plain_ids("some words here")


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - n)
    return len(rooms)


def test_plan_equals_best_fit_by_item():
    rng = random.Random(3)
    for _ in range(20):
        histogram = {rng.randint(1, 100): rng.randint(1, 40) for _ in range(30)}
        slots = p.plan(histogram, 100)
        assert {n: sum(hi - lo for a, lo, hi, *_ in slots if a == n) for n in histogram} == histogram
        made = {s for _, lo, hi, first, _ in slots for s in range(first, first + hi - lo)}
        assert len(made) == best_fit([k for k, v in histogram.items() for _ in range(v)], 100)


def test_names_of_special_tokens_are_what_the_tokenizer_makes_of_them():
    encode = p.encoder(p.tokenizer_path())
    names = [a.content for a in Tokenizer.from_file(p.tokenizer_path()).get_added_tokens_decoder().values()]
    assert names
    for name in names:
        for text in (name, f"{name}x", f"a {name} b", f"{name}{name}", name[:-1], f"é {name.upper()}"):
            assert list(encode(text)) + [2] == plain_ids(text)
