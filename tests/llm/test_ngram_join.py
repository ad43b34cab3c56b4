import random

from rillflow.llm import ngram_join


def plain(rows, percent=80, words=5):
    """doc_id -> (size, least reachable id) by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, len(sets[i]), least.get(find(i))) for i, (k, _) in enumerate(rows)), key=str)


def got(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n long, key string")
    return sorted((tuple(r) for r in ngram_join.components_of(df, **kw).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def edited(rng, words, share):
    return [w if rng.random() > share else rng.choice(["x", "y", "z", f"w{rng.randrange(50)}"]) for w in words]


def test_groups_of_near_copies(spark, monkeypatch):
    rng = random.Random(7)
    rows = []
    common = [f"c{i}" for i in range(12)]
    for g in range(12):
        base = [f"g{g % 9}_{rng.randrange(400)}" for _ in range(rng.choice([4, 6, 9, 14, 30, 60, 120]))] + (common if g % 3 == 0 else [])
        for _ in range(rng.choice([3, 8, 25])):
            text = edited(rng, base, rng.choice([0, 0.005, 0.01, 0.02, 0.03]))
            rows.append((len(rows), " ".join(text + [f"t{len(rows)}"] * rng.randrange(2))))
    rng.shuffle(rows)
    monkeypatch.setattr(ngram_join, "CLASSES", (32, 1024))
    want = plain(rows)
    assert got(spark, rows) == want
    assert len({r[2] for r in want}) < len(rows)
    assert got(spark, rows, percent=60, words=3) == plain(rows, 60, 3)


def test_combinations_meet_wherever_sets_link():
    """Two linked sets share a combination, whatever the classes of their n-grams, and one in the short prefix of the smaller."""
    rng = random.Random(11)
    for trial in range(3000):
        n, percent = rng.choice([1, 2, 4, 5, 7, 10, 19, 40, 90]), rng.choice([60, 80, 90])
        a = rng.sample(range(1 << 40), n)
        b = a[: rng.randint((n * percent + 99) // 100, n)]
        b += [rng.randrange(1 << 40) for _ in range(rng.randrange(0, n // 4 + 1))]
        both = len(set(a) & set(b))
        if 100 * both < percent * (len(set(a) | set(b))):
            continue
        count = {x: rng.choice([2, 2, 40, 40, 2000]) for x in {*a, *b}}
        own = [sorted((count[x], x) for x in s if x in set(a) & set(b) or rng.random() < 0.5) for s in (a, b)]
        x, y = sorted(((s, own[i]) for i, s in enumerate((a, b))), key=lambda p: len(p[0]))
        small, large = (ngram_join.combinations(len(s), t, percent) for s, t in (x, y))
        met = set(small) & set(large)
        assert met and any(small[h] for h in met), (trial, n, percent)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (None, "one two"), (None, "alone here"), (7, "ÉA b c d e f"), (8, "Éa b c d e f"), (9, "éa b c d e f"), (9, "éa b c d e f"), (10, "éa b c d e f"),
            (11, " ".join(f"w{i}" for i in range(30_000))), (12, " ".join(f"w{i}" for i in range(29_000)))]
    assert got(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert got(spark, []) == []
