import hashlib
import math
import random
import zlib

from rillflow.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, key string"
COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def plain(rows):
    """The trie of (conv_id, turn, role, text) by dicts of prefixes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:])
    members = {}
    for c, t in full.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saved[p] = sum(saved[k] for k in kids.get(p, [])) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        ends = ",".join(map(str, sorted(c for c in members[p] if len(full[c]) == len(p))))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows):
    df = spark.createDataFrame([(*r, "d", "k") for r in rows], SCHEMA)
    return sorted((tuple(r[c] for c in COLUMNS) for r in prefix_trie.trie(prefix_trie.rebuilt(df)).collect()), key=str)


def test_random_tries_over_many_blocks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for seed, partitions in ((1, 3), (2, 17), (3, 40)):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            rng, rows = random.Random(seed), []
            for c in rng.sample(range(-150, 900), 260):
                rows += [(c, t, rng.choice(["user", "bot"]), rng.choice(["a", "bb", "ccc", "é"])) for t in range(rng.choice([0, 1, 2, 3, 5, 9]))]
            rng.shuffle(rows)
            assert got(spark, rows) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (5, None, "user", "first"), (5, 0, None, None), (5, 0, None, None), (5, 1, "user", "a" * 100_000), (7, 3, "", ""), (100, 0, "user", "hi"), (101, 0, "user", "hi"), (102, 0, "user", "other")]
    rows += [(100, t, "user", "again") for t in range(1, 8)] * 2
    assert got(spark, rows) == plain(rows)


def test_one_conversation_and_none(spark):
    assert got(spark, [(0, 0, "user", "hi")]) == plain([(0, 0, "user", "hi")])
    assert got(spark, []) == []
