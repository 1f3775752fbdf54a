import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.functions import vectors as V
from facetry.operators import embed


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_length_of_a_vector_is_taken_once(spark):
    wide = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(40_000)), lambda i: i.cast("double")).alias("x")).localCheckpoint()
    begin = time.monotonic()
    got = wide.select(V.unit(F.col("x")).alias("u")).select(F.element_at("u", 40_000).alias("last"), F.size("u").alias("n")).head()
    assert time.monotonic() - begin < 20  # squared, it is minutes
    assert got.n == 40_000 and got["last"] == pytest.approx(40_000 / np.sqrt((np.arange(1.0, 40_001) ** 2).sum()), rel=1e-12)


def test_coordinates_equal_sums_in_order(spark):
    rng = np.random.default_rng(5)
    x, axes = rng.standard_normal((50, 7)), rng.standard_normal((3, 7))
    odd = [(100, None), (101, [1.0, 2.0]), (102, [1.0, None, 1.0, 1.0, 1.0, 1.0, 1.0])]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, "entity_id long, vector array<double>").repartition(3)
    found = embed.project(rows, axes, "c")
    assert "lambda" not in plan(found)
    got = {r.entity_id: r.c for r in found.collect()}
    mu = embed.mean_vector(rows)
    for i, v in enumerate(x):
        assert got[i] == [sum(((a - m) * w for a, m, w in zip(v, mu, axis)), 0.0) for axis in axes]
    assert [got[i] for i, _ in odd] == [[None] * 3] * 3
    assert mu == pytest.approx(np.array([np.mean([v[d] for _, v in enumerate(x.tolist())] + [v[d] for _, v in odd if v and d < len(v) and v[d] is not None]) for d in range(7)]))


def test_dense_rows_equal_lists(spark, monkeypatch):
    monkeypatch.setattr(embed, "CELLS", 12)  # some rows a batch
    cells = [(e, "ing" if f % 2 else "met", f"f{f}", float(e * 10 + f + 1)) for e in range(9) for f in range(5) if (e + f) % 3]
    profile = spark.createDataFrame(cells + [(1, "ing", "rare", 3.0), (50, "ing", "rare2", 1.0), (70, "met", "f0", None)], "entity_id long, kind string, feature string, score double")
    found = embed.dense_profile(profile, 2)
    assert "lambda" not in plan(found)
    names = sorted({(k, f) for _, k, f, _ in cells})
    want = {e: [0.0] * len(names) for e in range(9)} | {70: [0.0] * len(names)}
    for e, k, f, s in cells:
        want[e][names.index((k, f))] = s
    assert {r.entity_id: r.vector for r in found.collect()} == want
    assert embed.dense_profile(profile.limit(0), 2).collect() == []
    with pytest.raises(Exception, match="twice"):
        embed.dense_profile(profile.unionByName(profile), 1).collect()
