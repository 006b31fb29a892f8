"""Best partners from posting lists against the join of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from gapline.operators import postings, relational, similarity

SCHEMA = "item long, genres array<string>, themes array<string>, modes array<string>, studios array<string>"


@pytest.mark.parametrize("chunk, block", [(8192, 2048), (37, 11)])
def test_top_equals_the_full_join(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(postings, "CHUNK", chunk)
    monkeypatch.setattr(postings, "BLOCK", block)
    rng = random.Random(3)
    some = lambda words, n: rng.choice([None, []] + [rng.choices(words, k=rng.randint(1, n)) for _ in range(8)])
    rows = [(i, ["hot"] if i % 3 else some("abcd", 2), some([f"t{n}" for n in range(12)], 4), some("xyz", 2), some("pq", 1)) for i in range(300)]
    rows += [(900, None, None, None, None), (901, ["hot", None], [None, "t1"], [], [])]
    items = spark.createDataFrame(rows, SCHEMA)
    anchors = items.filter("item % 7 = 0 OR item > 890")
    clean = items.select("item", *[F.array_distinct(F.filter(c, lambda v: v.isNotNull())).alias(c) for c in items.columns[1:]])
    full = similarity.shared_facets(clean.filter("item % 7 = 0 OR item > 890"), clean).drop("confidence")
    for k in (1, 5, 500):
        want = relational.topk_per_group(full, ["anchor"], [F.desc("score"), F.asc("candidate")], k, "rank")
        assert sorted(map(tuple, postings.top_shared(anchors, items, k).collect())) == sorted(map(tuple, want.collect()))
    assert postings.top_shared(anchors.limit(0), items, 5).count() == 0 and postings.top_shared(anchors, items.limit(0), 5).count() == 0
