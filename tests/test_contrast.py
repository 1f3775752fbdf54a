import numpy as np

from facetry.operators import profiles


def _moved(spark) -> int:
    """Records that all stages so far have written to shuffles."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_contrast_sums_only_the_features_that_are_compared(spark):
    rng = np.random.default_rng(2)
    n, features, k = 60, 120, 6
    score = rng.random((n, features)).round(4)
    near = [rng.choice([j for j in range(n) if j != i], k, replace=False) for i in range(n)]
    profile = spark.createDataFrame([(i, "ing", f"f{f:03d}", float(score[i, f])) for i in range(n) for f in range(features)],
                                    "entity_id bigint, kind string, feature string, score double")
    pairs = spark.createDataFrame([(i, int(j)) for i in range(n) for j in near[i]], "entity_id bigint, neighbour_id bigint")
    before = _moved(spark)
    got = {(r.entity_id, r.feature): round(r.excess, 9) for r in profiles.neighbour_contrast(profile, pairs).collect()}
    moved = _moved(spark) - before
    want = {}
    for i in range(n):
        top = sorted(range(features), key=lambda f: (-score[i, f], f))[:8]
        excess = sorted(((score[i, f] - score[near[i], f].mean(), f) for f in top), key=lambda e: (-e[0], e[1]))
        want.update({(i, f"f{f:03d}"): round(e, 9) for e, f in [e for e in excess if e[0] > 0.15][:5]})
    assert got == want
    assert moved < 1.6 * n * features
