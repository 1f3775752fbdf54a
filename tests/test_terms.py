import random

import pytest
from pyspark.sql import functions as F

from facetry.operators import terms
from facetry.plans import search

ROWS = [(1, "Green Smoothie", {"olive oil": 0.5, "salt": 1.0}, ["soup"]), (2, "green small bowl", {"oliv": 0.2}, None), (3, None, None, ["Gren", "tea"]), (4, "", {}, []),
        (5, "smlal smoothies", {"sea-salt": 0.1}, ["x"]), (6, "straße Éclair", {"O'Neil 12": 0.3}, ["éclair"])]
SCHEMA = "id long, name string, scores map<string,double>, dishes array<string>"
FIELDS = ["name", "scores", "dishes"]


def edits(a, b):
    """Edit distance with swaps of neighbours, unrestricted."""
    last, big = {}, len(a) + len(b)
    d = {(-1, -1): big}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = big, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = big, j
    for i in range(1, len(a) + 1):
        seen = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), seen
            same = a[i - 1] == b[j - 1]
            if same:
                seen = j
            d[i, j] = min(d[i - 1, j - 1] + (not same), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def brute(words):
    import re
    out = {}
    for i, name, scores, dishes in ROWS:
        best = 0.0
        for texts in ([name or ""], list(scores or {}), dishes or []):
            found = [t for x in texts for t in re.split(r"[\W_]+", x.lower()) if t]
            best = max(best, sum(max([1 - edits(t, w) / len(w) for t in found if edits(t, w) <= terms.allowed_edits(w)], default=0.0) for w in words))
        if best > 0:
            out[i] = round(best, 9)
    return out


@pytest.mark.parametrize("query", ["green smoothie", "samll", "slat olvie", "eclair", "oneil 12", "zzz", "soup gren"])
def test_scores_equal_plain_comparison(spark, query, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    want = brute(query.split())
    got = {r["id"]: round(r["score"], 9) for r in search.ranked_search(df, query, FIELDS).collect()}
    assert got == want
    index = terms.SearchIndex.build(df, FIELDS, "id", str(tmp_path / "index"))
    assert {r["id"]: round(r["score"], 9) for r in index.scores(query.split()).where("score > 0").collect()} == want


def test_every_term_within_the_limit_is_a_candidate(spark, tmp_path):
    rng = random.Random(1)
    vocabulary = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(300)})
    df = spark.createDataFrame([(i, t) for i, t in enumerate(vocabulary)], "id long, name string")
    index = terms.SearchIndex.build(df, ["name"], "id", str(tmp_path / "index"))
    for word in rng.sample(vocabulary, 12) + ["abcabcab", "ccccc"]:
        found = {r["term"] for r in index.candidates([word]).collect()}
        assert {t for t in vocabulary if edits(t, word) <= terms.allowed_edits(word)} <= found


def test_long_terms_have_few_keys(spark):
    df = spark.createDataFrame([("x" * 5000,), ("abcdefghijk",)], "term string")
    assert {r["term"][:3]: r["n"] for r in terms.with_keys(df).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()} == {"xxx": 3, "abc": 29}


def test_one_comparison_a_distinct_term(spark):
    df = spark.createDataFrame([(i, f"green t{i % 3}") for i in range(50)], "id long, name string")
    near = terms.close_terms(terms.postings(df, ["name"], "id").select("term").distinct(), ["gren"])
    assert [(r["term"], r["close"]) for r in near.collect()] == [("green", [0.75])]
