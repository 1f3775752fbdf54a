import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from facetry.llm import ngram_join
from facetry.llm.components import components
from facetry.llm.shingles import shingle_sets, word_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def closure(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def jaccard_components(texts):
    """Component of each text by comparing all pairs; texts without words are alone."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    return [len(s) for s in sets], closure(len(texts), pairs)


def random_sets(rng):
    base = [np.unique(rng.integers(0, 300, rng.integers(1, 60))) for _ in range(4)]
    rows = set()
    for _ in range(rng.integers(2, 40)):
        b = base[rng.integers(0, 4)]
        keep = b[rng.random(len(b)) > rng.random() * 0.25]
        rows.add(tuple(np.unique(np.concatenate((keep, rng.integers(0, 300, rng.integers(1, 3))))).tolist()))
    return [np.array(r) for r in sorted(rows)]


def test_tree_finds_exactly_the_linked_components():
    rng = np.random.default_rng(1)
    for _ in range(150):
        rows = random_sets(rng)
        sets = [set(r.tolist()) for r in rows]
        true = [(i, j) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
        links, _ = ngram_join.tree_links(rows, np.array([len(r) for r in rows]), np.arange(len(rows)))
        assert {(max(p), min(p)) for p in links} <= set(true)
        got, want = closure(len(rows), links), closure(len(rows), true)
        assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_tree_of_prefixes_keeps_linked_sets_together():
    rng = np.random.default_rng(2)
    for _ in range(150):
        rows = random_sets(rng)
        sets = [set(r.tolist()) for r in rows]
        heads = sorted(range(len(rows)), key=lambda i: rows[i][:ngram_join.prefix_size(len(rows[i]))].tolist())
        prefixes = [rows[i][:ngram_join.prefix_size(len(rows[i]))] for i in heads]
        _, label = ngram_join.tree_links(prefixes, np.array([len(rows[i]) for i in heads]), np.arange(len(rows)))
        for a in range(len(rows)):
            for b in range(a):
                x, y = sets[heads[a]], sets[heads[b]]
                if 100 * len(x & y) >= 75 * len(x | y):
                    assert label[a] == label[b]


def test_word_hashes_split_like_the_contract():
    texts = ["Ab  cD\t", "", None, "\n", "ab\x0bCD x", "é É z", "ab", "ef"]
    flat, sizes = word_hashes(pa.array(texts))
    words = [(t or "").encode().lower().split() for t in texts]
    assert sizes.tolist() == [len(w) for w in words]
    every = [w for ws in words for w in ws]
    known = {}
    for w, h in zip(every, flat.tolist(), strict=True):
        assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)
    part = pa.array(texts).slice(4, 2)
    assert word_hashes(part)[1].tolist() == [3, 2]
    assert [len(s) for s in shingle_sets(pa.array(["a b c d e f", "a b", None]))] == [2, 1, 0]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200)]
    got = {r.v: r.root for r in components(spark.createDataFrame(edges, "v long, u long")).collect()}
    assert all(got[i] == 0 for i in range(1, 21)) and all(got[i] == 100 for i in range(101, 140)) and got[201] == 200
    assert components(spark.createDataFrame([], "v long, u long")).count() == 0


@pytest.mark.parametrize("block", [512, 4])
def test_documents_against_all_pairs(spark, monkeypatch, block):
    """Small blocks send every group through the comparison of blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "COARSE", 4096 if block > 4 else 6)
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [list(rng.choice(vocabulary, rng.integers(8, 60))) for _ in range(6)]
    passage = list(rng.choice(vocabulary, 40))
    texts = [None, "", " \n\t", "one two", "One  TWO", "one two three", "long " * 3000]
    for i in range(70):
        w = list(base[i % 6])
        for _ in range(rng.integers(0, 3)):
            w[rng.integers(0, len(w))] = str(rng.choice(vocabulary))
        texts.append(" ".join(w))
    texts += [" ".join([*passage, *rng.choice(vocabulary, 60)]) for _ in range(12)]
    texts += texts[10:14]
    sizes, want = jaccard_components(texts)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in ngram_join.linked_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    least = {}
    for i, c in enumerate(want):
        least.setdefault(c, i)
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id) == (sizes[i], least[want[i]]), i


def test_nulls_ties_empty_and_extra_columns(spark):
    text = "a b c d e f g h"
    rows = [(None, text, 1, "x"), (5, text, 1, "x"), (5, text, 1, "x"), (3, text, 2, "y"), (None, "only here, no copy of it", 3, "z"), (4, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sid long, token string")
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in ngram_join.linked_documents(docs).collect())
    assert got == [("3", 4, 3), ("4", 0, 4), ("5", 4, 3), ("5", 4, 3), ("None", 2, None), ("None", 4, 3)]
    empty = ngram_join.linked_documents(docs.where(F.lit(False)))
    assert empty.count() == 0
