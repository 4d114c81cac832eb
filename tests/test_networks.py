"""The numpy networks: kernels against dense recurrences, shapes, and what must not change."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from seqloom.operators import networks, neural
from seqloom.plans import fixtures as fx


def test_low_rank_form_is_the_matrix():
    w, p, b, v = networks.nplr_legs(12)
    a, root = neural.hippo_legs(12)
    assert np.allclose(v @ (np.diag(w) - np.outer(p, p.conj())) @ v.conj().T, a, atol=1e-9)
    assert np.allclose(v @ b, root)


def test_pole_kernel_equals_the_recurrence():
    n, length, dt = 8, 32, 0.05
    w, p, b, v = networks.nplr_legs(n)
    a, root = neural.hippo_legs(n)
    c = np.linspace(-1, 1, n)
    da, db = neural.bilinear(a, root, dt)
    want = neural.krylov_kernel(da, db, c, length)
    rest = networks.truncated(c, da, length).astype(complex) @ v
    assert np.allclose(networks.nplr_kernel(w, p, b, rest, dt, length), want, atol=1e-5)


def test_pools_are_inverse_up_to_the_shift():
    x = np.arange(24.0).reshape(1, 8, 3)
    back = networks.up_pool(networks.down_pool(x, 4), 4)
    assert back.shape == x.shape and (back[:, 4:] == x[:, :4]).all() and (back[:, :4] == 0).all()


def test_dilated_convolution_by_hand():
    x = np.arange(6.0).reshape(1, 6, 1)
    out = networks.dilated_conv(x, np.ones((3, 1, 1)), 2)[0, :, 0]
    assert out.tolist() == [2, 4, 6, 9, 6, 8]


def test_attention_does_not_mind_the_order():
    w = networks.random_weights({"q": (8, 8), "k": (8, 8), "v": (8, 8), "o": (8, 8), "f": (8, 16), "g": (16, 8)})
    x = np.random.default_rng(0).normal(size=(2, 5, 8))
    order = [3, 1, 4, 0, 2]
    assert np.allclose(networks.attention(x, w, 2)[:, order], networks.attention(x[:, order], w, 2))


def test_imputation_over_a_table(spark):
    rows = fx.table(spark, "/root/testdata/sf0.001", "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.withColumn("m", F.transform("v", lambda x, i: (i % 3 != 0).cast("int"))).limit(6)
    net = networks.GatedImputer(channels=4, hidden=8, layers=2, steps=5)
    got = {(r.vec_id, r.sample): r.x for r in networks.impute(rows, "vec_id", "v", "m", 4, net, samples=2, seed=1).collect()}
    assert len(got) == 12
    for r in rows.collect():
        a, b = np.array(got[r.vec_id, 0]), np.array(got[r.vec_id, 1])
        keep = np.array(r.m) == 1
        assert (a[keep] == np.array(r.v)[keep]).all() and not np.allclose(a[~keep], b[~keep])
    again = {(r.vec_id, r.sample): r.x for r in networks.impute(rows.repartition(3), "vec_id", "v", "m", 4, net, samples=2, seed=1).collect()}
    assert all(np.allclose(again[k], got[k]) for k in got)
