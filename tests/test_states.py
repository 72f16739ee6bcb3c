"""Group states merge in any order to those of one pass."""

import numpy as np

from kindred.operators import states


def test_states_merge_in_any_order(spark, monkeypatch):
    monkeypatch.setattr(states, "HELD", 3)
    rng = np.random.default_rng(6)
    rows = [(str(rng.choice(["hot", "hot", "hot", "a", "b", "c", "d"])), rng.normal(size=int(rng.choice([4, 4, 3]))).tolist(), float(rng.integers(0, 5)), float(rng.integers(0, 4)), i) for i in range(500)]
    rows += [(None, [1.0, 2.0], 1.0, None, 900), (None, None, 2.0, 0.5, 901), ("none", None, 1.0, None, 902), ("hot", [None, 1.0], 1.0, 9.0, 903)]
    df = spark.createDataFrame(rows, "k string, v array<double>, w double, q double, p long")
    want = {}
    for k, v, w, q, p in rows:
        n, weight, sums, best = want.get(k, (0, 0.0, np.zeros(0), None))
        if v is not None and None not in v:
            size = max(len(sums), len(v))
            sums = np.pad(sums, (0, size - len(sums))) + np.pad(np.array(v) * w, (0, size - len(v)))
        if q is not None and (best is None or (q, -p) > best):
            best = (q, -p)
        want[k] = (n + 1, weight + w, sums, best)
    once = states.group_states(df.repartition(6), "k", "v", "w", "q", "p")
    parts = [states.partial_states(df.filter(f"p % 3 = {i}"), "k", "v", "w", "q", "p") for i in (2, 0, 1)]
    twice = states.merged_states(states.merged_states(parts[0].unionByName(parts[1]), "k").unionByName(parts[2]), "k")
    for found in (once, twice):
        got = {r.k: r for r in found.collect()}
        assert set(got) == set(want)
        for k, (n, weight, sums, best) in want.items():
            assert got[k].n == n and abs(got[k].weight - weight) < 1e-9 and np.allclose(got[k].sums, sums)
            assert (got[k].best is None) == (best is None) and (best is None or (got[k].best.quality, -got[k].best.payload) == best)


def test_a_hot_key_is_a_state_a_task(spark):
    rows = spark.range(20_000).selectExpr("'hot' as k", "array(cast(id as double), 1.0D) as v", "1.0D as w", "0.0D as q", "id as p").repartition(5)
    assert states.partial_states(rows, "k", "v", "w", "q", "p").count() <= 5
    r = states.group_states(rows, "k", "v", "w", "q", "p").first()
    assert r.n == 20_000 and r.sums == [199_990_000.0, 20_000.0] and r.best.payload == 0
