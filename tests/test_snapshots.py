"""Incremental statistics against full ones."""

import random

from pyspark.sql import functions as F

from gapline.operators import disparity, snapshots


def frame(spark, rows):
    kinds = "id int, outlet int, s long, d_a long, d_b long, d long"
    return spark.createDataFrame(rows, kinds).select("id", "outlet", F.timestamp_seconds("s").alias("published_at"), "d_a", "d_b", "d")


def review(rng, i):
    d_a, d_b = (rng.choice([None, rng.randint(-90_000, 90_000)]) for _ in range(2))
    d = d_a if d_b is None else d_b if d_a is None else (d_a + d_b) // 2
    return (i, rng.choice([None, 1, 2, 3, 4]), rng.choice([None, *[86_400 * rng.randint(0, 5) + rng.randint(0, 80_000)] * 9]), d_a, d_b, d)


def test_rounds_of_changes_equal_the_whole(spark):
    rng = random.Random(8)
    rows = {i: review(rng, i) for i in range(120)}
    fixed = lambda df: spark.createDataFrame(df.collect(), df.schema)
    states = fixed(snapshots.cells(frame(spark, list(rows.values())), "outlet"))
    stats = snapshots.stats(states, "outlet")
    for turn in range(4):
        changed = rng.sample(sorted(rows), 25)
        gone = [rows.pop(i) for i in changed]
        come = [review(rng, i) for i in changed[:15]] + [review(rng, 1000 * (turn + 1) + i) for i in range(8)]
        come += [(5000 + turn, 9, 86_400, 1, 1, 1)] if turn < 2 else []
        if turn == 2:
            gone += [rows.pop(i) for i in (5000, 5001) if i in rows]
        rows |= {r[0]: r for r in come}
        now = frame(spark, list(rows.values()))
        touched = snapshots.changed_cells(states, frame(spark, gone), frame(spark, come), now, "outlet")
        touched = fixed(touched)
        new = snapshots.updated(states, touched, "outlet")
        stats = snapshots.snapshot(stats, new, touched, "outlet")
        states, stats = fixed(new), fixed(stats)
        assert sorted(map(str, states.collect())) == sorted(map(str, snapshots.cells(now, "outlet").select(*states.columns).collect()))
        want = disparity.entity_stats(now.filter("published_at IS NOT NULL"), "outlet")
        assert sorted(map(str, stats.drop("last").collect())) == sorted(map(str, want.collect()))


def test_only_cells_that_lost_an_extreme_are_read_again(spark):
    day = [(i, 1, 100 + i, None, None, 10 * i) for i in range(5)] + [(9, 2, 100, None, None, 7)]
    states = snapshots.cells(frame(spark, day), "outlet")
    nothing = frame(spark, [])
    middle = snapshots.changed_cells(states, frame(spark, [day[2]]), nothing, nothing, "outlet").collect()
    assert [(r.n, r.min_d, r.max_d, r.sum_d) for r in middle] == [(4, 0, 40, 80)]
    top = snapshots.changed_cells(states, frame(spark, [day[4]]), nothing, frame(spark, day[:4]), "outlet").collect()
    assert [(r.n, r.min_d, r.max_d) for r in top] == [(4, 0, 30)]
    assert snapshots.changed_cells(states, nothing, nothing, nothing, "outlet").count() == 0
