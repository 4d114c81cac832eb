"""Queries against their SQL on rows that the test tables lack."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import same

import duckdb
from seqloom import registry


def against_sql(spark, tmp_path, name: str, **tables: pa.Table) -> None:
    db = duckdb.connect()
    for t, rows in tables.items():
        pq.write_table(rows, f"{tmp_path}/{t}.parquet")
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    same(registry.queries()[name](spark, str(tmp_path)), db, registry.oracle_sql()[name])


def embeddings(x: np.ndarray) -> pa.Table:
    return pa.table({"vec_id": pa.array(range(len(x)), pa.int64()), "embedding": pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))})


def test_products_near_halves_are_rounded_as_single_precision(spark, tmp_path):
    halves = (np.arange(-1000, 1000).reshape(400, 5) + 0.5) / 1000
    against_sql(spark, tmp_path, "channel_select", embeddings=embeddings(halves))


@pytest.mark.parametrize("name", ["crps", "impute_rmse_mae"])
def test_samples_of_repeated_and_ragged_series(spark, tmp_path, name):
    """Vectors that share an id pool their samples; lengths differ, and entries, vectors and ids may be null. Nothing of the size of the
    samples is shuffled."""
    rng = np.random.default_rng(9)
    rows = [(i % 40, rng.normal(size=rng.choice([64, 64, 30, 0])).astype(np.float32).tolist()) for i in range(60)] + [(50, None), (None, [1.0, 2.0]), (51, [None, 1.0, None] * 8)]
    t = pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32()))})
    against_sql(spark, tmp_path, name, embeddings=t)
    plan = registry.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "percentile" not in plan
