import numpy as np
import pytest

from daymill.llm.embed_dedup import Passes, near_duplicates
from tests.llm.helpers import roots


def vectors():
    rng = np.random.default_rng(8)
    out, at = {}, 0
    for group in range(60):
        base = rng.standard_normal(16)
        for _ in range([1, 2, 3, 50][group % 4]):
            out[at] = (base + rng.standard_normal(16) * rng.choice([0.02, 0.1, 0.3])).astype(np.float32).tolist()
            at += 1
    for i in range(40):
        out[5000 + i] = out[0]
    out[6000] = [2 * x for x in out[0]]
    out |= {7000: None, 7001: [], 7002: [0.0] * 16, 7003: [float("nan")] * 16, 7004: [float("inf")] + [1.0] * 15, 7005: [None] + [1.0] * 15, 7006: [1.0], 7007: [3.0]}
    return out


def brute(vs):
    good = {k: np.array(v, np.float64) for k, v in vs.items() if v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = []
    for size in {len(v) for v in good.values()}:
        ids = [k for k, v in good.items() if len(v) == size]
        x = np.array([good[k] / np.linalg.norm(good[k]) for k in ids])
        links += [(ids[i], ids[j]) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.95, 1)))]
    root = roots(vs, links)
    return {k: (sum(k in p for p in links), root[k], root[k] == k) for k in vs}


@pytest.mark.parametrize("how", [Passes(), Passes(tile=7, bucket=100)])
def test_equals_brute_force(spark, how):
    vs = vectors()
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in vs.items()], "vec_id long, embedding array<float>, c int, class string").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(df, how=how).collect()}
    assert got == brute(vs)


def test_null_ids_repeats_and_empty(spark):
    rows = [(None, [1.0, 2.0]), (4, [1.0, 2.0]), (4, [1.0, 2.0]), (None, None)]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == [(0, 0, 0, True), (0, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True)]
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def hot_family(n, pairs, family, seed=3, size=64):
    """``n`` vectors, a share of them with mutual cosines about 0.8, and planted pairs at 0.96 within that share."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(rng.standard_normal((n, size)))
    hot = int(n * family)
    centre = unit(rng.standard_normal(size))
    own = unit(x[:hot] - (x[:hot] @ centre)[:, None] * centre)
    other = unit(rng.standard_normal((pairs, size)))
    other = unit(other - (other @ centre)[:, None] * centre - np.einsum("ij,ij->i", other, own[:pairs])[:, None] * own[:pairs])
    own[pairs:2 * pairs] = 0.8 * own[:pairs] + 0.6 * other
    x[:hot] = 0.8 ** 0.5 * centre + 0.2 ** 0.5 * own
    return dict(enumerate(x.tolist()))


@pytest.mark.parametrize("family", [1.0, 0.4])
def test_passes_go_on_until_nothing_is_new(spark, family):
    vs = hot_family(4000, 300, family)
    df = spark.createDataFrame(list(vs.items()), "vec_id long, embedding array<double>").repartition(3)
    how = Passes(passes=2, window=8, bucket=250)  # too few and too narrow for one go
    got = {r.vec_id: r.n_links for r in near_duplicates(df, how=how).collect()}
    x = np.array(list(vs.values()))
    want = (x @ x.T >= 0.95).sum(axis=1) - 1
    assert want.sum() >= 550 and got == dict(enumerate(want.tolist()))
