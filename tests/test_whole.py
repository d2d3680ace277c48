"""Searches read the whole of what they are named for."""

from pathlib import Path

import numpy as np
import pytest

from tessera.functions import blocking_keys as K
from tessera.functions import text as X
from tessera.functions.similarity import word_grams
from tessera.operators import blocking as B
from tessera.operators import vectors as N
from tessera.plans import registry as G


def test_large_blocks_are_ranked_whole(spark):
    columns = "entity_id string, business_name string, business_address string, country string"
    s1 = spark.createDataFrame([(f"S1-{k:07d}", f"alpha number{k}", f"{k} main road", "US") for k in range(40)], columns)
    pool = spark.createDataFrame([(f"S2-{k:07d}", f"alpha number{k % 97} x{k}", f"{k % 53} main road", "US") for k in range(899, -1, -1)] + [("S3-0000001", "alpha number7", "7 main road", "US")], columns)
    texts = [{r.entity_id: word_grams(r.m) for r in K.with_normal_columns(df).select("entity_id", X.match_text("name_norm", "addr_norm").alias("m")).collect()} for df in (s1, pool)]

    def cosine(p, q):
        return round(sum(v * q[g] for g, v in p.items() if g in q) / (sum(v * v for v in p.values()) ** 0.5 * sum(v * v for v in q.values()) ** 0.5), 9)

    wanted = {(a, b) for a, p in texts[0].items() for b in sorted(texts[1], key=lambda b: (-cosine(p, texts[1][b]), b))[:60]}
    for size in ({}, {"block": 100}, {"block": 16}):
        got = B.cosine_candidates(s1, pool, {"k1": 60}, **size).collect()
        assert {(r.s1_id, r.cand_id) for r in got} == wanted
        assert ("S1-0000007", "S3-0000001", 1) in {tuple(r) for r in got}


def nearest(queries, targets):
    """q_id, t_id of the 20 nearest by brute force."""
    q, t = (x.toPandas().sort_values("id") for x in (queries, targets))
    score = np.round(np.stack(q.vec).astype(float) @ np.stack(t.vec).astype(float).T, 9)
    return {(int(a), int(b)) for a, row in zip(q.id, np.argsort(-score, axis=1, kind="stable")[:, :20], strict=True) for b in t.id.to_numpy()[row]}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_approximate_search_keeps_its_recall(spark, sf):
    d = f"/root/testdata/{sf}"
    if not Path(d).exists():
        pytest.skip(d)
    wanted = nearest(*G.whole_search(spark, d))
    found = {(r.q_id, r.t_id) for r in G.QUERIES["ann_ivf_topk"](spark, d).collect()}
    assert len(wanted & found) >= 0.9 * len(wanted)


def test_every_row_is_indexed(spark, sf_dir):
    found = G.QUERIES["ann_ivf_topk"](spark, sf_dir).collect()
    queries = {r.q_id for r in found}
    assert queries == {r.id for r in G.all_vectors(spark, sf_dir).select("id").collect() if r.id % 50 == 0}
    assert any(r.t_id % 5 == 0 and r.t_id != r.q_id for r in found)
    assert all((q, q) in {(r.q_id, r.t_id) for r in found} for q in queries)


def test_no_row_holds_a_block_of_vectors(spark):
    rows = spark.createDataFrame([(k, 0, [1.0, float(k)]) for k in range(30)], "id bigint, part int, vec array<float>")
    near = N.top_k(rows, rows, 2, block=4)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan
    assert "collect_list(struct(" not in plan
    assert {(r.q_id, r.t_id) for r in near.collect()} == {(0, 0), (0, 1)} | {(q, t) for q in range(1, 30) for t in (29, 28)}


@pytest.mark.parametrize("kind", ["random", "copies", "close", "zero", "huge", "infinite"])
def test_single_precision_leaves_nothing_out(kind):
    rng = np.random.default_rng(3)
    q, t = (rng.standard_normal((n, 24)).astype(np.float32) for n in (37, 400))
    if kind == "copies":
        t[::3] = q[0]
    elif kind == "close":  # apart by less than single precision tells
        q, t = q.astype(np.float64), np.ones((400, 24)) + rng.standard_normal((400, 24)) * 1e-8
    elif kind == "zero":
        t[100:] = 0
    elif kind == "huge":
        q, t = q * np.float32(1e25), t * np.float32(1e10)
    elif kind == "infinite":
        t[7, 0], q[5, 1] = np.inf, np.inf
    best, order = N._Best(q, 20), rng.permutation(400)
    for lo in range(0, 400, 90):
        part = np.sort(order[lo : lo + 90])
        best.add(t[part], part)
    with np.errstate(invalid="ignore"):
        score = np.round(q.astype(np.float64) @ t.T.astype(np.float64), 9)
    wanted = np.argsort(-score, axis=1, kind="stable")[:, :20]
    assert (best.row == np.repeat(np.arange(37), 20)).all()
    if kind != "huge":  # rounding at 9 digits tells nothing there
        assert (best.order.reshape(37, 20) == wanted).all()
    np.testing.assert_allclose(best.score.reshape(37, 20), np.take_along_axis(score, wanted, 1), rtol=1e-12, atol=2e-9)
