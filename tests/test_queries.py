"""Every registered query of the engine against its SQL."""

import pytest
from helpers import DATA, same_rows

from marlstone.functions.media import path_vector
from marlstone.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, str(DATA)), duck.sql(ORACLES[name]))


def test_path_vectors(spark):
    rows = QUERIES["path_vector"](spark, str(DATA)).join(spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url"), "page_id").collect()
    assert rows
    assert all(r["vector"] == path_vector(r["url"]) for r in rows)


def test_kmeans(spark):
    """Within 10 % of Lloyd's algorithm on the same vectors from the best of several starts."""
    import numpy as np

    rows = QUERIES["kmeans_inertia"](spark, str(DATA)).collect()
    x = np.array([r["embedding"] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()])
    best = np.inf
    for seed in range(5):
        c = x[np.random.default_rng(seed).choice(len(x), 10, replace=False)]
        for _ in range(500):  # until it converges
            d = ((x[:, None] - c[None]) ** 2).sum(-1)
            at = d.argmin(1)
            last, c = c, np.array([x[at == i].mean(0) if (at == i).any() else c[i] for i in range(10)])
            if np.array_equal(last, c):
                break
        best = min(best, ((x[:, None] - c[None]) ** 2).sum(-1).min(1).sum())
    assert sum(r["n"] for r in rows) == len(x)
    assert rows[0]["inertia"] <= 1.1 * best


def test_pushdown(spark):
    """Filters and columns reach the scan."""
    text = QUERIES["range_and_eq"](spark, str(DATA))._jdf.queryExecution().toString()
    assert "PushedFilters: [" in text
    assert "l_comment" not in text.split("== Physical Plan ==")[1]
