import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np

from rillflow.llm import panes

SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, kind string, value double, hour string, batch int"


def plain(rows, batches=10):
    """The change log of (click_id, ts, arrived_at, kind, value) by a loop over batches and rows."""
    epoch, fed, seen = datetime(1970, 1, 1), defaultdict(list), set()
    for i, ts, arrived, kind, value in rows:
        if ts is None or i is None or i in seen:
            continue
        seen.add(i)
        d = ((arrived or ts) - epoch).days
        q = d % batches
        b = min(batches - 1, q + max(0, zlib.crc32(str(i).encode()) % 30 - 23))
        hour = int((ts - timedelta(days=d - q) - epoch).total_seconds() // 3600)
        fed[b].append((i, hour, kind or "none", 0 if value is None or value != value or abs(value) > 9e15 else int(np.floor(100 * value + 0.5))))
    out, state, top = [], {}, -(10**9)
    for b in range(batches):
        new = set()
        for i, hour, kind, cents in fed[b]:
            if top >= hour + 49:
                out.append((b, hour, i, 1, cents, "late", kind))
                continue
            pane = state.setdefault((kind, hour), [0, 0, None])
            pane[0], pane[1] = pane[0] + 1, pane[1] + cents
            new.add((kind, hour))
        for (kind, hour), pane in list(state.items()):
            if pane[2] is None and top >= hour + 13:
                out.append((b, hour, -1, pane[0], pane[1], "emit", kind))
                pane[2] = (pane[0], pane[1])
            elif pane[2] is not None and (kind, hour) in new:
                out += [(b, hour, -1, *pane[2], "retract", kind), (b, hour, -1, pane[0], pane[1], "replace", kind)]
                pane[2] = (pane[0], pane[1])
            if top >= hour + 49:
                del state[kind, hour]
        top = max([top, *(r[1] for r in fed[b])])
    return out + [(batches - 1, hour, -1, p[0], p[1], "final", kind) for (kind, hour), p in state.items() if p[2] is None]


def log(df):
    return sorted(tuple(r[c] for c in ("batch", "hour", "click_id", "n_rows", "cents", "record", "kind")) for r in df.collect())


def test_change_log_with_odd_rows(spark):
    rng, start = random.Random(3), datetime(2024, 1, 1)
    rows = []
    for i in range(900):
        arrived = start + timedelta(seconds=rng.randrange(40 * 86400))
        ts = arrived - timedelta(seconds=int(rng.expovariate(1 / 3600))) if rng.random() > 0.03 else arrived - timedelta(days=rng.randrange(1, 400))
        rows.append((i, ts, arrived if i % 50 else None, rng.choice(["view", "view", "buy", None, "none"]), rng.choice([1.005, -2.5, None, float("nan"), float("inf"), 1e7 + 0.125])))
    rows += rows[:60] + [(None, start, start, "view", 1.0), (901, None, start, "view", 1.0)]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)  # hour and batch: columns with names of ours
    got, want = log(panes.revisions(panes.batched(df), shards=3)), sorted(plain(rows))
    assert got == want
    assert {r[5] for r in want} == {"late", "emit", "retract", "replace", "final"}
    assert spark.conf.get("spark.sql.streaming.stateStore.unloadOnCommit", "false") == "false"  # settings are put back


def test_empty_table(spark):
    assert log(panes.revisions(panes.batched(spark.createDataFrame([], SCHEMA)))) == []


def test_ring_with_overflow_survives_its_arrow_form():
    rng, ring, plain_sums = random.Random(1), panes.Ring(), defaultdict(lambda: [0, 0])
    for _ in range(20):
        slots = np.array([rng.randrange(-200, 200) for _ in range(30)])
        n, cents = np.ones(30, dtype=np.int64), np.array([rng.randrange(-(1 << 52), 1 << 52) for _ in range(30)])
        ring.add(slots, n, cents)
        for s, c in zip(slots.tolist(), cents.tolist()):
            plain_sums[s][0] += 1
            plain_sums[s][1] += c
        ring = panes.Ring(ring.dump())
        slot, values = ring.held()
        assert {s: [a, b] for s, a, b in zip(slot.tolist(), *values[:2].tolist())} == plain_sums
        if rng.random() < 0.3:
            keep = slot > np.median(slot)
            ring.put(slot[keep], values[:, keep])
            plain_sums = defaultdict(lambda: [0, 0], {s: [a, b] for s, a, b in zip(slot[keep].tolist(), *values[:2, keep].tolist())})
