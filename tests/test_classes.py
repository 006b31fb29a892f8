"""Pairs by classes of equal items against all pairs, and the queries built on them on tables of copies."""

import random

import pytest
from pyspark.sql import functions as F

from gapline.operators import classes
from gapline.plans import mining_queries as mq
from tests.test_whole_queries import rows_and_sql

#: Few kinds of items, many copies of each; every fiftieth is an anchor.
KINDS = [("hot rod", "Brand#1", "LARGE", 5, 100.0), ("hot bolt", "Brand#1", "LARGE", 20, 300.0), ("cold rod", "Brand#2", "LARGE", 5, 100.0), ("large bolt", "Brand#2", "ECONOMY", 40, 900.0), ("small anvil", "Brand#2", "ECONOMY", 40, 900.0), ("lone gear", "Brand#3", "PROMO", 1, 1.0)]
PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
QUERIES = ["AGG-22_relationship_confusion", "JOI-08_neighbour_items", "JOI-10_neighbour_kinds", "JOI-15_scored_pairs", "SIM-06_candidate_pools", "SIM-06_vector_pool", "SIM-08_adjusted_scores", "SIM-08_final_scores", "SIM-11_neighbours", "SIM-11_published", "SIM-13_served_neighbours", "SIM-14_explanations", "SRT-05_top_of_all", "TAX-26_conditional_relationships", "FN-53_token_scores", "TAX-27_pair_scores"]


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("copies"))
    spark.createDataFrame([(i, *KINDS[(i // 7) % len(KINDS)]) for i in range(240)], PART).coalesce(1).write.parquet(f"{d}/part.parquet")
    return d


@pytest.mark.parametrize("name", QUERIES)
def test_copies_give_the_rows_of_the_sql(spark, copies, monkeypatch, name):
    monkeypatch.setattr(classes, "CHUNK", 9)
    assert rows_and_sql(spark, copies, name)


def test_copies_are_judged_once(spark, copies):
    shared = mq.facet_classes(spark, copies)
    assert shared.anchors.kinds.count() <= 5 and shared.items.kinds.count() == len(KINDS)
    assert shared.scores.count() <= 5 * len(KINDS) < shared.pairs().count() == shared.counts().agg(F.sum("pairs")).first()[0]


def test_diverse_of_copies(spark, copies):
    """The pool of the best six hundred is all that there are."""
    from gapline.operators import similarity

    rows = mq.facets(spark, copies, "brand")
    plain = similarity.shared_facets(rows.filter("item % 50 = 0"), rows).join(rows.select(F.col("item").alias("candidate"), F.col("brand").alias("group")), "candidate")
    assert sorted(map(tuple, mq.diverse(spark, copies).collect())) == sorted(map(tuple, similarity.diverse(plain, 5).collect()))


@pytest.mark.parametrize("chunk", [4096, 3])
def test_pairs_counts_and_best_are_those_of_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(classes, "CHUNK", chunk)
    rng = random.Random(2)
    rows = [(i, rng.choice("abc"), rng.choice([None, 1.0, 2.0]), f"x{i}") for i in range(60)] + [(None, "a", 1.0, "x")]
    items = spark.createDataFrame(rows, "item long, kind string, price double, said string")
    asking, listed = classes.Classes(items.filter("item % 7 = 0"), "item", ["kind"]), classes.Classes(items, "item", ["kind", "price"], ["said"])
    found = asking.kinds.select(F.col("class").alias("a_class"), "kind").join(listed.kinds.select(F.col("class").alias("c_class"), "kind", F.coalesce("price", F.lit(0.0)).alias("score")), "kind")
    want = [(a[0], c[0], c[2] or 0.0, c[3]) for a in rows[:60:7] for c in rows[:60] if a[1] == c[1] and a[0] != c[0]]
    assert sorted((r.anchor, r.candidate, r.score, r.c_said) for r in classes.pairs(found, asking, listed).collect()) == sorted(want)
    assert classes.counts(found, asking, listed).agg(F.sum("pairs")).first()[0] == len(want)
    for k in (1, 4, 100):
        best = []
        for a in rows[:60:7]:
            mine = sorted((w for w in want if w[0] == a[0]), key=lambda w: (-w[2], w[1]))[:k]
            best += [(w[0], w[1], w[2], n + 1) for n, w in enumerate(mine)]
        assert sorted(map(tuple, classes.best(found, asking, listed, k).collect())) == sorted(best)
    assert classes.best(found.limit(0), asking, listed, 2).count() == 0 == classes.pairs(found.limit(0), asking, listed).count()
