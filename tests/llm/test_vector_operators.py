"""Near vectors, hard negatives and divergence against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from gapline.llm import divergence, negatives, vectors

KINDS = "vec_id long, embedding array<float>, label int, component string, n_links string"


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)


def plain_links(rows, cosine=0.9):
    """rows: (id, vector); per row the number of links and the smallest id reachable."""
    near = defaultdict(set)
    units = [np.array(v) / np.linalg.norm(v) if usable(v) else None for _, v in rows]
    for i, u in enumerate(units):
        for j in range(i):
            if u is not None and units[j] is not None and len(u) == len(units[j]) and u @ units[j] >= cosine:
                near[i].add(j)
                near[j].add(i)
    root = {}
    for start in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0)):
        todo = [start] if start not in root else []
        root.setdefault(start, rows[start][0])
        while todo:
            for j in near[todo.pop()]:
                if j not in root:
                    root[j] = root[start]
                    todo.append(j)
    return sorted(((r[0], len(near[i]), root[i]) for i, r in enumerate(rows)), key=str)


def check_links(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], KINDS)
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = sorted(((r.vec_id, r.n_links, r.component) for r in vectors.near_vectors(df, **more).collect()), key=str)
    assert got == plain_links(single)
    return got


def near(rng, v, cosine):
    z = rng.standard_normal(len(v))
    z -= (z @ v) * v / (v @ v)
    return cosine * v / np.linalg.norm(v) + math.sqrt(1 - cosine**2) * z / np.linalg.norm(z)


def test_links_at_all_distances(spark):
    """Chains, pairs on both sides of the threshold, a group whose members all link, and one of which only some do."""
    rng = np.random.default_rng(3)
    out = [rng.standard_normal(32) for _ in range(300)]
    for i in range(60):
        out += [near(rng, out[i], c) for c in (0.88, 0.905, 0.93, 0.99)]
    centre, wide = rng.standard_normal(32), rng.standard_normal(32)
    out += [near(rng, centre, 0.99) for _ in range(400)] + [near(rng, wide, 0.945) for _ in range(300)]
    at = rng.standard_normal(32)
    for _ in range(30):
        out.append(at := near(rng, at, 0.93))
    order = rng.permutation(len(out))
    check_links(spark, [(int(i) + 10, out[k].tolist()) for i, k in enumerate(order)], recall=0.99999)


def test_partition_borders_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PART", 100)
    monkeypatch.setattr(vectors, "CHUNK", 16)
    monkeypatch.setattr(vectors, "LEADERS", 8)
    rng = np.random.default_rng(4)
    out = [rng.standard_normal(16) for _ in range(200)]
    out += [near(rng, out[i], 0.95) for i in range(100)] + [near(rng, out[0], 0.96) for _ in range(150)]
    check_links(spark, [(i, v.tolist()) for i, v in enumerate(out)], recall=0.99999, window=32)


def test_odd_vectors(spark):
    inf, nan = math.inf, math.nan
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [inf, 1.0]), (6, [nan, 1.0]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [1.0, 2.0, 0.0]), (9, [1.0, 2.0, 0.0]), (None, [-1.0, 0.0]), (None, [-1.0, 0.0]), (None, None), (10, [-2.0, -0.0]), (11, [1e-38, 2e-38]), (12, [1e38, 2e38]), (13, [0.0, -1.0])]
    check_links(spark, rows)
    assert vectors.near_vectors(spark.createDataFrame([], KINDS)).count() == 0
    assert vectors.near_vectors(spark.createDataFrame([(1, None, 1, "", "")], KINDS)).collect()[0][:] == (1, 0, 1)


def test_number_of_passes_follows_the_number_of_vectors():
    assert vectors.passes_for(0) == vectors.passes_for(vectors.WINDOW) == 1
    counts = [vectors.passes_for(n) for n in (1_000, 10_000, 1_000_000, 100_000_000)]
    assert counts == sorted(counts) and 50 < counts[-1] < 200


def plain_negatives(rows):
    """rows: (id, vector, label, anchor), in order of their row numbers."""
    fine = [(i, [math.floor(256 * x) for x in v], label, anchor) for i, v, label, anchor in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = lambda found: sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:5]
    out = []
    for at, (i, v, label, anchor) in enumerate(fine):
        scored = [(sum(a * b for a, b in zip(v, w, strict=True)), j, other) for k, (j, w, other, _) in enumerate(fine) if k != at and len(w) == len(v)]
        for score, j, _ in first([x for x in scored if x[2] == label]) if anchor else ():
            found = first([x for x in scored if x[2] != label and 80 * score <= 100 * x[0] <= 100 * score])
            out += [(i, j, n + 1, other, score, s) for n, (s, other, _) in enumerate(found)]
    return sorted(out, key=str)


def check_negatives(spark, rows, **more):
    df = spark.createDataFrame([(i, v, label, "x", "y", bool(a)) for i, v, label, a in rows], KINDS + ", anchor boolean")
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], *rest) for i, v, *rest in rows]
    got = sorted((tuple(r) for r in negatives.hard_negatives(df, F.col("anchor"), **more).collect()), key=str)
    assert got == plain_negatives(single)
    return got


def test_negatives_equal_all_products(spark, monkeypatch):
    monkeypatch.setattr(negatives, "SLICE", 64)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(70) * rng.choice([0.1, 1, 3])).tolist(), int(rng.integers(3)), i % 25 == 0) for i in range(400)]
    assert len(check_negatives(spark, rows)) > 100
    check_negatives(spark, rows, block=3)


def test_negatives_of_ties_and_odd_rows(spark):
    rows = [(1, [1.0, 0.5], 0, True), (2, [1.0, 0.5], 0, False), (2, [1.0, 0.5], 0, False), (3, [1.0, 0.5], 0, True), (7, [0.9, 0.5], 1, False), (5, [0.9, 0.5], 1, False), (None, [0.9, 0.5], 2, True), (6, [1.0, 0.5], 2, False)]
    rows += [(8, None, 0, True), (9, [1.0, None], 0, True), (10, [math.nan, 1.0], 0, False), (11, [1.0, 1.0], None, True), (12, [1.0], 0, True), (13, [0.5], 1, True), (14, [], 0, True), (15, [], 1, False), (16, [-1.0, -0.4], 0, True), (17, [0.0, 0.0], 1, True), (18, [0.0, 0.0], 1, False), (19, [1.0, 0.5], 0, None)]
    check_negatives(spark, rows)
    for none in (rows[:0], [(1, None, None, True)], [(1, [1.0], 0, False)]):
        assert check_negatives(spark, none) == []


def test_vectors_too_long_for_exact_products_take_no_part(spark):
    rows = [(1, [1e30], 0, True), (2, [1e30], 0, False), (3, [1e30], 1, False), (4, [1.0], 0, True), (5, [1.0], 0, False), (6, [0.9], 1, False)]
    df = spark.createDataFrame([(i, v, label, "", "", a) for i, v, label, a in rows], KINDS + ", anchor boolean")
    assert [tuple(r) for r in negatives.hard_negatives(df, F.col("anchor")).collect()] == [(4, 5, 1, 6, 65536, 256 * 230)]


def plain_divergence(docs, least, top=50):
    """docs: (lang, source, text)."""
    df, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in ((x or "" for x in d) for d in docs):
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        groups[lang].add(source)
        df[lang].update(set(words))
        n[lang, source].update(words)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, d in df[lang].items() if d >= least]
        sums = Counter({t: sum(n[lang, s][t] for s in sources) for t in kept})
        price = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: price(n[lang, s]) for s in sources}, price(sums)
        for s in sources:
            parts = {"pair": {o: sum(abs(p[s][t] - p[o][t]) for t in kept) for o in sources - {s}}, "term": {t: p[s][t] - q[t] for t in kept if n[lang, s][t] and p[s][t] > q[t]}}
            for part, values in parts.items():
                ranked = sorted(values.items(), key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, r + 1) for r, (item, v) in enumerate(ranked) if part == "pair" or r < top]
    return sorted(out)


def test_divergence_equals_all_terms(spark, monkeypatch):
    monkeypatch.setattr(divergence, "GATHER", 50)
    rng = random.Random(2)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)] + ["é", "Zü", "ß日本"]
    docs = [(rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "d", "é", None]), " ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.choice([0, 3, 40])))) for _ in range(300)]
    docs += [("en", "none", None), ("en", "digits", "1 2 3-4"), ("fr", "a", "rare"), ("fr", "b", ""), ("xx", "alone", "one two"), (None, None, None)] + [("en", "a", "same same X-x")] * 20 + [("de", "long", "lang " * 50_000)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "lang string, source string, text string, term string, n int")
    for least in (1, 5, 30):
        got = divergence.divergence(df, least_docs=least, top=50 if least > 1 else 3)
        assert sorted(map(tuple, got.collect())) == plain_divergence(docs, least, 50 if least > 1 else 3)
    assert divergence.divergence(df.limit(0)).count() == 0
