"""A radius that counts scores as they are shown: rows that round up to its edge are in, as in the SQL."""

import duckdb
import numpy as np
import pytest

from tesserine.plans import catalog as C
from tesserine.plans.catalog_search import ORACLES, QUERIES


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    """Items around the edge of 0.1: above, rounded up to it, rounded down from it, and far."""
    rng = np.random.default_rng(5)
    probe = np.array(C._probe) / np.linalg.norm(C._probe)
    rows = []
    for i, score in enumerate([0.1000001, 0.0999998, 0.09999951, 0.09999949, 0.0999, *rng.uniform(-0.9, 0.9, 300)]):
        side = rng.normal(size=64)
        side -= side @ probe * probe
        rows.append((i, (score * probe + np.sqrt(1 - score * score) * side / np.linalg.norm(side)).tolist(), i % 10))
    out = str(tmp_path_factory.mktemp("edge"))
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").coalesce(1).write.parquet(f"{out}/embeddings.parquet")
    return out


@pytest.mark.parametrize("name", ["custom_radius", "cells_radius"])
def test_radius_as_shown(spark, path, name):
    got = {r.id: r.score for r in QUERIES[name](spark, path).collect()}
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet/*.parquet'")
        want = dict(db.execute(ORACLES[name]).fetchall())
    assert got == want
    assert {"0", "1", "2"} <= set(got) and not {"3", "4"} & set(got)
