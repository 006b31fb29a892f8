"""Exact and indexed neighbours against brute force."""

import numpy as np
import pytest

from gapline.operators import neighbors
from gapline.plans import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows, k):
    """rows: (id, vector, is anchor); (anchor, candidate, rank) by rounded cosine."""
    out = set()
    unit = lambda v: np.zeros(0) if v is None or not any(v) else np.array(v) / np.linalg.norm(v)
    for i, v, wanted in rows:
        if wanted:
            a = unit(v)
            scored = sorted((-round(float(a @ unit(w)) if len(a) and len(a) == len(unit(w)) else 0.0, 6), j) for j, w, _ in rows if j != i)
            out |= {(i, j, n + 1) for n, (_, j) in enumerate(scored[:k])}
    return out


@pytest.fixture
def clustered(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 24))
    rows = [(i, (centres[i % 40] + 0.35 * rng.standard_normal(24)).tolist(), i % 50 == 0) for i in range(3000)]
    rows += [(5000, None, True), (5001, [0.0] * 24, True), (5002, [1.0, 2.0], False), (5003, rows[0][1], True)]
    return rows, spark.createDataFrame(rows, "id long, v array<double>, wanted boolean")


def test_exact_equals_brute_force_in_blocks_of_any_size(spark, clustered, monkeypatch):
    rows, df = clustered
    want = brute(rows, 5)
    for chunk, block in ((4096, 1024), (257, 7)):
        monkeypatch.setattr(neighbors, "CHUNK", chunk)
        found = neighbors.nearest(df.filter("wanted"), df, 5, "id", "v", block)
        assert {(r.anchor, r.candidate, r["rank"]) for r in found.collect()} == want
    assert neighbors.nearest(df.limit(0), df, 5, "id", "v").count() == 0
    assert neighbors.nearest(df.filter("id = 0"), df.limit(0), 5, "id", "v").count() == 0


def test_inverted_file_indexes_every_row_and_keeps_its_recall(spark, clustered, monkeypatch):
    monkeypatch.setattr(neighbors, "CHUNK", 64)
    rows, df = clustered
    index = neighbors.InvertedFile(df, "id", "v")
    assert index.rows.count() == len(rows) and index.rows.select("candidate").distinct().count() == len(rows)
    anchors = df.filter("wanted AND id < 5000")
    probes = index.probes_for(anchors, 10)
    assert 1 <= probes < len(index.centroids) // 2
    found = {(r.anchor, r.candidate) for r in index.search(anchors, 10, probes).collect()}
    want = {(a, c) for a, c, _ in brute([r for r in rows if r[0] < 5000 or not r[2]], 10)}
    assert len(found & want) >= 0.9 * len(want)
    all_lists = {(r.anchor, r.candidate, r["rank"]) for r in index.search(anchors, 10, len(index.centroids)).collect()}
    assert all_lists == {(r.anchor, r.candidate, r["rank"]) for r in neighbors.nearest(anchors, df, 10, "id", "v").collect()}


@pytest.mark.parametrize("indexed, exact", [("SRT-09_indexed", "SRT-09_nearest")])
def test_recall_of_the_query(spark, indexed, exact):
    found, want = ({(r.anchor, r.candidate) for r in QUERIES[n](spark, SF).collect()} for n in (indexed, exact))
    assert len(found & want) >= 0.9 * len(want)


def test_recall_of_fused_documents(spark):
    from gapline.plans import label_queries

    vectors = label_queries.title_vectors(spark, SF)
    want = {(r.anchor, r.candidate) for r in neighbors.nearest(vectors.filter("item % 50 = 0"), vectors, 8, "item", "vector").filter("similarity > 0").collect()}
    found = {(r.anchor, r.candidate) for r in QUERIES["SIM-06_indexed_pool"](spark, SF).collect()}
    assert len(found & want) >= 0.9 * len(want)
