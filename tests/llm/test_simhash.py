"""SimHash near-duplicates against brute force."""

import random
import re

import numpy as np
import xxhash

from gapline.llm import components, queries, simhash

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text, n=3):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """rows: (key, fingerprint); key to the smallest reachable key, for unique keys."""
    values = np.array([f for _, f in rows], np.uint64)
    root = {}
    for start in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0)):
        if start in root:
            continue
        todo = [start]
        root[start] = rows[start][0]
        while todo:
            at = todo.pop()
            for j in np.flatnonzero(np.bitwise_count(values ^ values[at]) <= 3):
                if int(j) not in root:
                    root[int(j)] = rows[start][0]
                    todo.append(int(j))
    return [root[i] for i in range(len(rows))]


def check(docs, **more):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    want = sorted(((d, f, c) for (d, f), c in zip(prints, plain_components(prints), strict=True)), key=str)
    got = [(r.doc_id, r.fingerprint & (2**64 - 1), r.component) for r in simhash.near_duplicates(docs, **more).collect()]
    assert sorted(got, key=str) == want
    return want


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = check(docs)
    assert len({c for *_, c in want}) < len(want)
    rows = queries.op5_simhash(spark, SF).collect()
    assert sorted((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in rows) == sorted(want)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for *_, c in want})


def test_odd_rows(spark):
    long = " ".join(random.Random(3).choices(["Aé", "b", "c\td", "e"], k=200_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A b"), (5, "a  B"), (5, "a  B"), (6, "a b c d"), (None, "a b c d"), (None, "zz"), (9, long), (8, long + " x")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, component string, fingerprint int")
    check(docs)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = sorted(((r.doc_id, r.text) for r in simhash.one_of_each(docs).collect()), key=str)
    assert kept == sorted([(1, None), (4, "A b"), (6, "a b c d"), (8, long + " x"), (None, "a b c d"), (None, "zz")], key=str)


def test_large_groups_are_dealt_again(spark):
    """Many fingerprints that share most of their bits: all links survive small groups."""
    rng = random.Random(7)
    values = {0}
    centre = rng.getrandbits(64)
    for _ in range(600):
        values.add(centre ^ sum(1 << b for b in rng.sample(range(40), rng.randint(0, 6))))
    for _ in range(300):
        values.add(rng.getrandbits(64))
    values = sorted(values)
    signed = [int(np.array(v, np.uint64).view(np.int64)) for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    want = plain_components(list(zip(range(len(values)), values, strict=True)))
    for group in (4, 16, 256):
        found = components.connected_components(simhash.links(df, group=group)).collect()
        root = {r.node: r.root for r in found}
        sets = {}
        for i, v in enumerate(signed):
            sets.setdefault(root.get(v, v), set()).add(i)
        expected = {}
        for i, c in enumerate(want):
            expected.setdefault(c, set()).add(i)
        assert sorted(map(sorted, sets.values())) == sorted(map(sorted, expected.values()))


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 200)] + [(5, None)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.root for r in components.connected_components(df).collect()}
    assert got == {x: find(x) for x in root}
    assert components.connected_components(df.limit(0)).count() == 0
