"""Values that meet a limit: the outcome may not hang on the order of a sum."""

import math

from facetry.operators import profiles, quality


def test_share_at_the_threshold_is_not_above_it(spark):
    rows = [(1, "k", "f", math.nextafter(0.01, 1.0)), (2, "k", "f", 0.01), (3, "k", "f", 0.0101), (4, "k", "f", 0.5)]
    got = profiles.idf(spark.createDataFrame(rows, "entity_id long, kind string, feature string, score double")).head()
    assert got["df"] == 2 and abs(got["idf"] - (math.log(5 / 3) + 1)) < 1e-12


def test_deviation_at_the_limit_is_not_flat(spark):
    rows = [(2 * n, "ing", f"f{i}", (1.0, 0.6)[i % 2]) for n in range(1, 60) for i in range(2 * n)]
    rows += [(2 * n + 1, "ing", f"f{i}", (0.4, 0.8)[i < n]) for n in range(1, 60) for i in range(2 * n)]
    rows += [(1000, "ing", f"f{i}", (1.0, 0.61)[i % 2]) for i in range(10)]
    profile = spark.createDataFrame(rows, "entity_id long, kind string, feature string, score double")
    entities = spark.createDataFrame([(e, "g") for e in {r[0] for r in rows}], "entity_id long, group string")
    found = quality.coverage_rules(profile, entities, min_std=0.2).where("rule = 'flat_profile'").collect()
    assert [r["entity_id"] for r in found] in ([1000], ["1000"])
