"""Gallery search by blocks and by the index, against all pairs."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import galleries, search


def brute(rows, gallery, same):
    """key -> (score, id), all pairs by loops over the shorter length."""
    out = {}
    for key, x in rows:
        best = None
        for i, g in gallery:
            if x is None or any(v is None for v in x) or g is None or any(v is None or not np.isfinite(v) for v in g) or (same and len(g) != len(x)):
                continue
            n = min(len(x), len(g))
            score = float((np.array(x[:n], np.float64) * np.array(g[:n], np.float64)).sum())
            if np.isfinite(score) and (best is None or (score, -i) > (best[0], -best[1])):
                best = (score, i)
        out[key] = best
    return out


def sample(n, m, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (9, max(dims)))
    vector = lambda: (centres[rng.integers(9)] + rng.normal(0, 0.25, max(dims)))[: rng.choice(dims)].tolist()
    gallery = [(i, vector()) for i in range(m)]
    gallery += [(m + i, gallery[3][1]) for i in range(40)] + [(m + 50, [float("nan")] * dims[0]), (m + 51, None), (m + 52, [0.0] * dims[0])]
    rows = [(i, gallery[int(rng.integers(m))][1] if i % 5 == 0 else vector()) for i in range(n)]
    rows += [(n, None), (n + 1, [float("nan")] * dims[0]), (n + 2, [0.0] * dims[0]), (n + 3, gallery[3][1])]
    rows += [(n + 10 + i, rows[1][1]) for i in range(60)]
    return rows, gallery


@pytest.mark.parametrize("dims", [[8], [8, 5, 11]])
@pytest.mark.parametrize("same", [False, True])
@pytest.mark.parametrize("most", [0, 1 << 20])
def test_best_match_is_that_of_all_pairs(spark, monkeypatch, dims, same, most):
    monkeypatch.setattr(search, "BLOCK", 16)
    rows, gallery = sample(300, 250, dims, 1)
    df = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5)
    of = spark.createDataFrame(gallery, "id long, embedding array<float>").repartition(3)
    found = search.best_matches(df, {"best": search.distinct_vectors(of, "embedding", "id")}, "id", same_length=same, gallery_bytes=most).collect()
    as_float = lambda vs: [(i, None if v is None else np.array(v, np.float32).tolist()) for i, v in vs]
    want = brute(as_float(rows), as_float(gallery), same)
    assert len(found) == len(rows)
    for r in found:
        assert (r.best is None) == (want[r.id] is None)
        if r.best:
            assert abs(r.best.score - want[r.id][0]) < 1e-9 and r.best.id == want[r.id][1]


def test_margin_and_nearest_by_either_way(spark):
    rows, gallery = sample(120, 90, [8], 2)
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    of = spark.createDataFrame([g for g in gallery if g[1]], "id long, embedding array<float>")
    for most in (0, 1 << 20):
        got = {r.id: (round(r.similarity, 9), round(r.margin, 9)) for r in galleries.target_margin(df, of.filter("id < 40"), of.filter("id >= 40"), "id", most).collect()}
        near = {r.id: r.nearest_id for r in galleries.nearest(df, of, "id", most).collect()}
        assert most == 0 or (got, near) == first
        first = (got, near)
        assert galleries.best_in_gallery(df, of.limit(0), "id", "best", gallery_bytes=most).filter("best is not null").count() == 0
        alone = galleries.target_margin(df, of, of.limit(0), "id", most).agg(F.max("impostor_similarity")).first()[0]
        assert alone == -1.0


def test_rows_go_only_to_blocks_that_can_win(spark, monkeypatch):
    """Eight tight groups far apart: a row meets its own group's blocks, not those of the others."""
    monkeypatch.setattr(search, "BLOCK", 16)
    rng = np.random.default_rng(3)
    group = lambda c: (np.eye(8)[c] + rng.normal(0, 0.01, 8)).tolist()
    gallery = spark.createDataFrame([(group(i % 8), i) for i in range(640)], "_g array<double>, _id long")
    rows = spark.createDataFrame([(i, group(i % 8)) for i in range(400)], "_key long, _x array<double>")
    blocks, index = search.build_index(gallery, 8)
    assert blocks.count() >= 40
    met = search._against(search._packs(rows, index, False, False), blocks, "bigint")
    copies = search._packs(met.select("_key", "_x", "_block", "_score"), index, False, True).agg(F.sum(F.size("_keys"))).first()[0] or 0
    assert met.count() == 400 and copies <= 400 * blocks.count() / 4


def test_products_take_no_more_memory_for_larger_batches():
    rng = np.random.default_rng(3)
    x, g = rng.normal(size=(20_000, 16)), rng.normal(size=(3_000, 16))
    x[5], g[7] = np.inf, g[2_500]
    tracemalloc.start()
    score, who = search.dots(x, g, np.arange(len(g)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
    for i in [*range(4), *range(6, 60), *range(19_950, 20_000)]:
        every = (x[i] * g).sum(axis=1)
        assert who[i] == every.argmax() and score[i] == every.max()
    assert np.isneginf(score[5])


def test_packs_of_rows_that_many_blocks_want(spark, monkeypatch):
    monkeypatch.setattr(search, "HELD", 40)
    monkeypatch.setattr(search, "BLOCK", 16)
    rng = np.random.default_rng(4)
    x, g = rng.normal(size=(150, 6)), rng.normal(size=(200, 6))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").coalesce(1)
    gallery = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(g)], "id long, embedding array<double>")
    found = {r.id: r["_b"] for r in search.best_matches(rows, {"_b": search.distinct_vectors(gallery, "embedding", "id")}, "id", gallery_bytes=0).collect()}
    assert {k: v.id for k, v in found.items()} == dict(enumerate((x @ g.T).argmax(axis=1).tolist()))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
